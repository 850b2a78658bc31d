"""Ledgers of use: running totals, a guard on projected totals, capped logs, version numbers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ledger(uses: DataFrame, keys: list[str], order: list[str], rate_in: float, rate_out: float) -> DataFrame:
    """``uses`` (input_tokens, output_tokens) with cost and running totals of each case, in order; rates are per 1000."""
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cost = (F.col("input_tokens") * rate_in + F.col("output_tokens") * rate_out) / 1000
    rows = uses.withColumn("cost", cost)
    return rows.withColumns({"total_tokens": F.sum(F.col("input_tokens") + F.col("output_tokens")).over(run), "total_cost": F.sum("cost").over(run)})


def totals(uses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, input_tokens, output_tokens, uses): what a ledger has come to, a row for each case."""
    return uses.groupBy(*keys).agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.count(F.lit(1)).alias("uses")
    )


def merge_totals(before: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of the history so far and of what came since, as one; no history is read again."""
    both = before.unionByName(more)
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "uses")])


def ledger_on(before: DataFrame, uses: DataFrame, keys: list[str], order: list[str], rate_in: float, rate_out: float) -> DataFrame:
    """``ledger`` of new uses that go on from the totals ``before``; a case that has none begins at zero."""
    own = ledger(uses, keys, order, rate_in, rate_out)
    zero = F.lit(0).cast("long")
    past = before.select(*keys, F.coalesce("input_tokens", zero).alias("__in"), F.coalesce("output_tokens", zero).alias("__out"))
    met = own.join(past, keys, "left").withColumns({"__in": F.coalesce("__in", zero), "__out": F.coalesce("__out", zero)})
    return met.withColumns({
        "total_tokens": F.col("total_tokens") + F.col("__in") + F.col("__out"),
        "total_cost": F.col("total_cost") + (F.col("__in") * rate_in + F.col("__out") * rate_out) / 1000,
    }).drop("__in", "__out")


def guard(ledgered: DataFrame, most_tokens: Column | None, most_cost: Column | None) -> DataFrame:
    """With ``decision``: tokens, cost or ok. Only what is strictly beyond a limit is stopped, tokens first."""
    none = F.lit(None).cast("double")
    tokens = F.coalesce(F.col("total_tokens") > (most_tokens if most_tokens is not None else none), F.lit(False))
    cost = F.coalesce(F.col("total_cost") > (most_cost if most_cost is not None else none), F.lit(False))
    return ledgered.withColumn("decision", F.when(tokens, "tokens").when(cost, "cost").otherwise("ok"))


def log_tail(events: DataFrame, keys: list[str], order: list[str], most: int = 200) -> DataFrame:
    """The last ``most`` events of each log."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("__k", F.row_number().over(last)).where(F.col("__k") <= most).drop("__k")


def category_counts(events: DataFrame, category: str) -> DataFrame:
    return events.groupBy(category).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), category)


def version_ids(versions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """With ``version``: 001, 002 and so on, by case in order."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("string")
    return versions.withColumn("version", F.when(F.length(k) < 3, F.lpad(k, 3, "0")).otherwise(k))


def context_items(items: DataFrame, keys: list[str], order: list[str], most: int = 20, chars: int = 200) -> DataFrame:
    """The first ``most`` items of each case, cut to ``chars`` characters."""
    first = Window.partitionBy(*keys).orderBy(*order)
    rows = items.withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= most).drop("__k")
    return rows.withColumn("text", F.left("text", F.lit(chars)))
