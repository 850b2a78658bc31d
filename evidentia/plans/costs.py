"""Costs in three levels: totals, savings, five years, discount, sources and their confidence."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.numbers import finite, half_up, iso_date, thousands

LEVELS = ("low", "central", "high")
PROPOSED = ("proposedPrimary", "coldDrAdd", "warmDrAdd")
#: Days after which a source is stale. Fixed value.
STALE_DAYS = 180


def by_level(costs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, component, side, level, value): the three levels as rows."""
    return costs.unpivot([*keys, "component", "side"], list(LEVELS), "level", "value")


def baseline_total(costs: DataFrame, keys: list[str]) -> DataFrame:
    own = costs.where("side = 'baseline'")
    return own.groupBy(*keys).agg(*[F.sum(k).alias(k) for k in LEVELS])


def proposed_total(costs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, posture, low, central, high) for no, cold and warm recovery: the primary and the posture's addition."""
    own = costs.where("side = 'proposed'")
    postures = F.explode(F.array(F.lit("none"), F.lit("cold"), F.lit("warm"))).alias("posture")
    part = F.col("component")
    counts = (part == "proposedPrimary") | ((part == "coldDrAdd") & (F.col("posture") == "cold")) | ((part == "warmDrAdd") & (F.col("posture") == "warm"))
    rows = own.select("*", postures)
    return rows.groupBy(*keys, "posture").agg(*[F.coalesce(F.sum(F.when(counts, F.col(k))), F.lit(0.0)).alias(k) for k in LEVELS])


def annual_saving(costs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, posture, saving, saving_pct) at the central level."""
    base = baseline_total(costs, keys).select(*keys, F.col("central").alias("base"))
    met = proposed_total(costs, keys).join(base, keys) if keys else proposed_total(costs, keys).crossJoin(base)
    saving = F.col("base") - F.col("central")
    return met.select(*keys, "posture", saving.alias("saving"), half_up(F.try_divide(100 * saving, F.col("base"))).alias("saving_pct"))


def _joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys) if keys else a.crossJoin(b)


def five_years(costs: DataFrame, keys: list[str], years: int = 5) -> DataFrame:
    """(keys, posture, year, a, b, cum_a, cum_b) of cold and warm: a moves in year 1 and pays both, b stays.

    Running sums over the few years of a case and posture.
    """
    base = baseline_total(costs, keys).select(*keys, F.col("central").alias("b"))
    move = costs.where("component = 'migration'").groupBy(*keys).agg(F.sum("central").alias("move"))
    steady = proposed_total(costs, keys).where("posture != 'none'").select(*keys, "posture", F.col("central").alias("steady"))
    rows = _joined(_joined(steady, base, keys), move, keys).withColumn("year", F.explode(F.sequence(F.lit(1), F.lit(years))))
    rows = rows.withColumn("a", F.when(F.col("year") == 1, F.col("b") + F.col("steady") + F.col("move")).otherwise(F.col("steady")))
    run = Window.partitionBy(*keys, "posture").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*keys, "posture", "year", "a", "b", F.sum("a").over(run).alias("cum_a"), F.sum("b").over(run).alias("cum_b"))


def payback(streams: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, posture, net, payback_year): what b costs more over all years, and the first later year by which a has paid; null if never."""
    return streams.groupBy(*keys, "posture").agg(
        (F.sum("b") - F.sum("a")).alias("net"),
        F.min(F.when((F.col("year") > 1) & (F.col("cum_b") >= F.col("cum_a")), F.col("year"))).alias("payback_year"),
    )


def discount(costs: DataFrame, percent: Column) -> DataFrame:
    """The proposed side at a discount between 0 and 100 percent; the baseline and anything without a discount stay as they are."""
    pct = F.when(percent.isNull() | F.isnan(percent), 0.0).otherwise(F.least(F.greatest(percent, F.lit(0.0)), F.lit(100.0)))
    hit = (F.col("side") == "proposed") & (pct > 0)
    return costs.withColumns({k: F.when(hit, F.col(k) * (1 - pct / 100)).otherwise(F.col(k)) for k in LEVELS})


def normalize_ranges(costs: DataFrame) -> DataFrame:
    """``costs`` with ``problem``: a point becomes a range of 20 percent to either side; bad ranges are told, not mended."""
    low, central, high = (F.col(k) for k in LEVELS)
    bad = [F.when(~F.coalesce(finite(F.col(k)) & (F.col(k) >= 0), F.lit(False)), F.lit(f"{k} is not a number of 0 or more")) for k in LEVELS]
    point = (central > 0) & (low <= central) & (central <= high) & (high - low < 0.1 * central)
    out = costs.withColumn("problem", F.coalesce(*bad)).withColumn("__point", F.coalesce(point, F.lit(False)) & F.col("problem").isNull())
    out = out.withColumns({
        "low": F.when(F.col("__point"), half_up(central * 0.8).cast("double")).otherwise(low),
        "high": F.when(F.col("__point"), half_up(central * 1.2).cast("double")).otherwise(high),
    })
    ordered = (F.col("low") <= central) & (central <= F.col("high"))
    return out.withColumn("problem", F.coalesce("problem", F.when(~ordered, F.lit("not in order")))).drop("__point")


def source_confidence(sources: DataFrame, keys: list[str], today: Column, searched: bool = True) -> DataFrame:
    """(keys, confidence, stale, all_cutoff) from the weakest source (quality, as_of): 0.75, 0.65 or 0.5, stale ones 0.6 at most."""
    quality = F.col("quality")
    cutoff = quality == "training-cutoff"
    base = F.when(quality == "published", 0.75).when(quality == "synthesized", 0.65).otherwise(0.5)
    stale = ~cutoff & F.coalesce(F.datediff(today, iso_date(F.col("as_of"))) > STALE_DAYS, F.lit(False))
    rows = sources.withColumns({"c": F.when(stale, F.least(base, F.lit(0.6))).otherwise(base), "stale": stale, "cutoff": cutoff})
    found = rows.groupBy(*keys).agg(F.min("c").alias("least"), F.bool_or("stale").alias("stale"), F.bool_and("cutoff").alias("all_cutoff"))
    confidence = F.least("least", F.lit(0.75))
    return found.select(*keys, F.when(F.col("all_cutoff"), F.least(confidence, F.lit(0.5))).otherwise(confidence).alias("confidence"), "stale", "all_cutoff")


def first_sources(components: DataFrame, sources: DataFrame) -> DataFrame:
    """Components with the label of the first source (ord) that cites them."""
    first = sources.groupBy("component").agg(F.min_by("label", "ord").alias("label"))
    return components.join(first, "component", "left").withColumn("label", F.coalesce("label", F.lit("no source given")))


def bars(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Segments (keys, ord, value) in thousands per bar; the last one takes what rounding left, so that they add up to the rounded total."""
    whole = Window.partitionBy(*keys)
    last = F.max("ord").over(whole)
    rounded = F.when(F.col("ord") < last, thousands(F.col("value"))).otherwise(F.lit(0))
    rows = totals.withColumns({"last": last, "k": rounded, "total": thousands(F.sum("value").over(whole))})
    rest = F.col("total") - F.sum("k").over(whole)
    return rows.select(*keys, "ord", F.when(F.col("ord") == F.col("last"), rest).otherwise(F.col("k")).alias("value_k"), F.col("total").alias("total_k"))


def axis_thousands(largest: Column) -> Column:
    return F.ceil((largest + 50) / 100) * 100


def axis_millions(largest: Column) -> Column:
    return F.ceil((largest / 1_000_000 + 0.2) * 2) / 2
