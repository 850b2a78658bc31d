"""Consecutive numbers in a global order, without a task that holds a whole key."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.scratch import Scratch


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "n", ranges: int | None = None) -> DataFrame:
    """``rows`` with ``name``: 1, 2, 3, ... within each value of ``keys``, by ``order``.

    The rows are cut into ranges of keys and order and written once, so that they cannot change. Each range counts
    its own rows; sums over the ranges before, a row for each range and key, tell where a range begins. A key of any size is thus
    spread over as many tasks as its rows have ranges. Rows that the order does not tell apart
    are numbered in any order, but each has a number of its own. Null keys are a key.
    """
    scratch = Scratch(rows.sparkSession)
    # Rows that the order does not tell apart are told apart by chance, so that many of them make many ranges too.
    apart, by = rows.withColumn("__tie", F.rand(1)), [*keys, *order, "__tie"]
    cut = apart.repartitionByRange(ranges, *by) if ranges else apart.repartitionByRange(*by)
    held = scratch.keep(cut.withColumn("__range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*keys, "__range").orderBy(*order, "__tie")
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__size"))
    bases = sizes.select(
        *[F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)], F.col("__range").alias("__r"),
        F.coalesce(F.sum("__size").over(before), F.lit(0).cast("long")).alias("__base"),
    )
    met = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"__key_{i}"))
    own = held.withColumn("__own", F.row_number().over(inside)).join(bases, met)
    return own.select(*rows.columns, (F.col("__base") + F.col("__own")).alias(name))
