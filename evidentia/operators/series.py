"""Statistics of numeric series, and what columns of text cells are."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.numbers import is_percent, parse_number
from evidentia.functions.text import is_currency, looks_like_time
from evidentia.scratch import Scratch


#: Accuracy of the sketch that brackets a rank, and how far to either side of it the bracket reaches.
SKETCH_ACCURACY, BRACKET = 10_000, 0.0003
#: Series whose bounds go to every task, at some 100 bytes each.
FEW_SERIES = 100_000


def nearest_rank(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys, rank_value): of each series the ceil(share * n)-th smallest value, exactly; nulls do not count.

    No series is gathered in one task, however its values lie: a sketch of its quantiles, merged before the shuffle,
    brackets the rank, counts below and within the bracket say where it is, and only the
    distinct values of that part, some ten-thousandths of the series, are ordered. A sketch that misses costs time, not exactness.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("k"), F.col(value).cast("double").alias("v"))
    ends = F.percentile_approx("v", [max(share - BRACKET, 0.0), min(share + BRACKET, 1.0)], SKETCH_ACCURACY)
    bounds = Scratch(df.sparkSession).keep(rows.groupBy("k").agg(ends.alias("q"), F.count(F.lit(1)).alias("n")), "bounds")
    # A row for each series goes to every task, so that a series of any size is no task's alone; more series than FEW_SERIES are left to adaptive execution.
    shared = F.broadcast if bounds.count() <= FEW_SERIES else lambda x: x
    rank = F.least(F.ceil(F.lit(share) * F.col("n")), F.col("n"))
    zone = F.when(F.col("v") < F.col("q")[0], 0).when(F.col("v") <= F.col("q")[1], 1).otherwise(2)
    values = rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    placed = values.join(shared(bounds.select("k", "q", rank.alias("rank"))), "k").select("k", "rank", "v", "c", zone.alias("zone"))
    below, within = F.sum(F.when(F.col("zone") == 0, F.col("c")).otherwise(0)), F.sum(F.when(F.col("zone") == 1, F.col("c")).otherwise(0))
    counts = placed.groupBy("k", "rank").agg(below.alias("below"), within.alias("within"))
    upto = F.col("below") + F.col("within")
    chosen = counts.select(
        "k", F.when(F.col("rank") <= F.col("below"), 0).when(F.col("rank") <= upto, 1).otherwise(2).alias("zone"),
        (F.col("rank") - F.when(F.col("rank") <= F.col("below"), 0).when(F.col("rank") <= upto, F.col("below")).otherwise(upto)).alias("rest"),
    )
    so_far = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = placed.join(shared(chosen), ["k", "zone"]).withColumn("upto", F.sum("c").over(so_far))
    found = ordered.where(F.col("upto") >= F.col("rest")).groupBy("k").agg(F.min("v").alias("rank_value"))
    return found.select("k.*", "rank_value")


def series_stats(df: DataFrame, keys: list[str], value: str, keep_negative: bool = True) -> DataFrame:
    """Mean, peak, nearest-rank 95th percentile, least and count of each series; all 0 for an empty one.

    Nulls are no samples. ``keep_negative`` false drops samples below zero, not their series.
    """
    x = F.col(value) if keep_negative else F.when(F.col(value) >= 0, F.col(value))
    zero = F.lit(0.0)
    rows = df.select(*keys, x.cast("double").alias("__x"))
    found = rows.groupBy(*keys).agg(
        F.coalesce(F.avg("__x"), zero).alias("avg"), F.coalesce(F.max("__x"), zero).alias("peak"),
        F.coalesce(F.min("__x"), zero).alias("least"), F.count("__x").alias("n"),
    )
    ranked = nearest_rank(rows, keys, "__x", 0.95).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    met = found.join(ranked, same, "left")
    return met.select(*keys, "avg", "peak", F.coalesce("rank_value", zero).alias("p95"), "least", "n")


def as_fraction(stats: DataFrame, header: Column) -> DataFrame:
    """Mean and peak as fractions of one: divided by 100 where the series is in percent."""
    scale = F.when(is_percent(header, F.when(F.col("n") > 0, F.col("peak"))), 100.0).otherwise(1.0)
    return stats.withColumns({"avg_fraction": F.col("avg") / scale, "peak_fraction": F.col("peak") / scale})


def long_cells(df: DataFrame, source: Column, row: Column, columns: list[str]) -> DataFrame:
    """(source, row_idx, col_idx, header, cell): a table's cells as text, one per row; nulls are empty cells."""
    cells = F.array(*[
        F.struct(F.lit(k).alias("col_idx"), F.lit(c).alias("header"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("cell"))
        for k, c in enumerate(columns)
    ])
    return df.select(source.alias("source"), row.alias("row_idx"), F.explode(cells).alias("x")).select("source", "row_idx", "x.*")


def column_facts(cells: DataFrame) -> DataFrame:
    """Of each column: whether it is a time axis or money, and how many cells start with a number."""
    filled = F.trim(F.col("cell")) != ""
    return cells.groupBy("source", "col_idx", "header").agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(F.coalesce(looks_like_time(F.col("cell")), F.lit(False)).cast("int")) >= 0.8).alias("is_time"),
        F.count(parse_number(F.col("cell"))).alias("numbers"),
        F.count_if(filled).alias("filled"),
        F.count_if(F.col("cell").rlike(r"^\s*\$")).alias("dollars"),
    ).withColumn("is_currency", is_currency(F.col("header"), F.col("filled"), F.col("dollars"))).drop("filled", "dollars")


def table_roles(cells: DataFrame) -> DataFrame:
    """(source, role, time_idx): metric-time-series, cost-model or data-table. A table without cells is in no row: noise.

    The first time axis counts; a table is a series if any other column has a number.
    """
    facts = column_facts(cells)
    per = facts.groupBy("source").agg(
        F.min(F.when(F.col("is_time"), F.col("col_idx"))).alias("time_idx"),
        F.collect_list(F.when(F.col("numbers") > 0, F.col("col_idx"))).alias("numeric"),
        F.bool_or("is_currency").alias("money"),
    )
    series = F.col("time_idx").isNotNull() & F.exists("numeric", lambda k: k != F.col("time_idx"))
    role = F.when(series, "metric-time-series").when(F.col("money"), "cost-model").otherwise("data-table")
    return per.select("source", role.alias("role"), "time_idx")
