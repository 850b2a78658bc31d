"""Places on a chart: labels that keep a distance, boxes that overlap, a line's crossing."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.scratch import Scratch

#: Boxes of a cell that meet as many others at once; a fuller cell is dealt to shares.
SHARE = 2048
#: Pairs of boxes that a task compares, about.
TASK_PAIRS = 1 << 25

def declutter(marks: DataFrame, keys: list[str], y: str, tie: str, gap: float) -> DataFrame:
    """``marks`` with ``placed``: from the top, each label is pushed down until it is ``gap`` below the one before.

    ``tie`` orders labels of one place.

    With k the sorted position, the pushed place is max(y - gap k) so far, plus gap k.
    """
    order = Window.partitionBy(*keys).orderBy(y, tie)
    k = F.row_number().over(order) - 1
    rows = marks.withColumn("__k", k).withColumn("__free", F.col(y) - gap * F.col("__k"))
    top = F.max("__free").over(Window.partitionBy(*keys).orderBy("__k").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("placed", top + gap * F.col("__k")).drop("__k", "__free")


def overlaps(boxes: DataFrame, keys: list[str], gap: float = 0.0) -> DataFrame:
    """Pairs (i < j) of the boxes (keys, idx, x, y, w, h) of one chart that come nearer than ``gap``.

    Boxes meet by the cells of a grid, not chart by chart. A cell is as wide as the root of the mean square of the
    chart's box sizes, so a box covers ten cells or fewer on average, whatever the sizes; a pair counts in the cell
    where what they share begins. Where charts are crowded the pairs grow with the square of the boxes: the number of tasks follows
    the pairs to compare, and a full cell is a grid of shares, each of which meets each.
    """
    spark = boxes.sparkSession
    scratch = Scratch(spark)
    size = F.greatest("w", "h") + gap
    sides = boxes.groupBy(*keys).agg(F.sqrt(F.avg(size * size)).alias("__g"))
    rows = boxes.select(*keys, "idx", "x", "y", "w", "h").join(sides.withColumn("__g", F.when(F.col("__g") > 0, F.col("__g")).otherwise(1.0)), keys)

    def cells(at: str, extent: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(at) / F.col("__g")), F.floor((F.col(at) + F.col(extent) + gap) / F.col("__g"))))

    spread = rows.withColumn("__cx", cells("x", "w")).withColumn("__cy", cells("y", "h"))
    spread = scratch.keep(spread, "cells")
    cell = [*keys, "__cx", "__cy"]
    counts = scratch.keep(spread.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n")), "counts")
    compared = counts.agg(F.sum(F.col("__n").cast("double") * F.col("__n"))).first()[0] or 0.0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(compared / TASK_PAIRS) + 1)
    full = counts.where(F.col("__n") > SHARE).select(*cell, F.ceil(F.col("__n") / SHARE).cast("int").alias("__shares"))
    shares = F.coalesce("__shares", F.lit(1))
    dealt = spread.join(full, cell, "left").withColumn("__own", F.pmod(F.xxhash64("idx"), shares).cast("int")).withColumn("__each", F.explode(F.sequence(F.lit(0), shares - 1))).drop("__shares")
    # Tasks by number: few bytes make many pairs, so their size does not tell how many tasks it takes.
    met = [*cell, "__i", "__j"]
    a = dealt.withColumnsRenamed({"__own": "__i", "__each": "__j"}).repartition(tasks, *met).alias("a")
    b = dealt.withColumnsRenamed({"__own": "__j", "__each": "__i"}).repartition(tasks, *met).hint("merge").alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in met]
    near = (
        (F.col("a.x") < F.col("b.x") + F.col("b.w") + gap) & (F.col("b.x") < F.col("a.x") + F.col("a.w") + gap)
        & (F.col("a.y") < F.col("b.y") + F.col("b.h") + gap) & (F.col("b.y") < F.col("a.y") + F.col("a.h") + gap)
    )
    begins = [F.floor(F.greatest(f"a.{at}", f"b.{at}") / F.col("a.__g")) == F.col(f"a.{c}") for at, c in (("x", "__cx"), ("y", "__cy"))]
    pairs = a.join(b, [*same, F.col("a.idx") < F.col("b.idx"), near, *begins])
    return pairs.select(*[F.col(f"a.{k}") for k in keys], F.col("a.idx").alias("i"), F.col("b.idx").alias("j"))


def outside_frame(boxes: DataFrame, width: float, height: float) -> DataFrame:
    return boxes.where((F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > width) | (F.col("y") + F.col("h") > height))


def crossings(streams: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, year, at): where cumulative b first reaches cumulative a after year 1, between the years on straight lines."""
    order = Window.partitionBy(*keys).orderBy("year")
    rows = streams.withColumns({"d": F.col("cum_b") - F.col("cum_a"), "before": F.lag(F.col("cum_b") - F.col("cum_a")).over(order)})
    hit = rows.where("year > 1 and d >= 0").groupBy(*keys).agg(F.min_by(F.struct("year", "d", "before"), "year").alias("x"))
    share = F.coalesce(F.try_divide(-F.col("x.before"), F.col("x.d") - F.col("x.before")), F.lit(0.0))
    return hit.select(*keys, F.col("x.year").alias("year"), (F.col("x.year") - 1 + F.greatest(share, F.lit(0.0))).alias("at"))
