"""Claims with provenance: confidence from the signals they rest on, checklists, merges."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.numbers import half_up

#: Order of the sections in a checklist. Fixed values.
SECTIONS = ("A", "B", "C", "D", "E", "F")


def tier_of(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.6, "medium").otherwise("low")


def downgrade(tier: Column) -> Column:
    return F.when(tier == "high", "medium").otherwise("low")


def resolve_claims(claims: DataFrame, covered: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Claims (id, section, claim, depends_on, declared_label, declared_conf, derived) with confidence and source.

    A claim on signals is as sure as the least sure of them, unknown ones left out, and low without any;
    else its declared source counts; else it is unsourced. A derived claim is a tier lower. ``keys`` name the case in both tables.
    """
    links = claims.select(*keys, "id", F.posexplode("depends_on").alias("pos", "signal_id"))
    met = links.join(covered.select(*keys, "signal_id", "effective"), [*keys, "signal_id"]).groupBy(*keys, "id").agg(
        F.min("effective").alias("least"), F.array_sort(F.collect_list(F.struct("pos", "signal_id"))).alias("on")
    )
    rows = claims.join(met, [*keys, "id"], "left")
    derived = F.coalesce("derived", F.lit(False))
    from_signals = F.when(F.col("least").isNull(), "low").otherwise(tier_of(F.col("least")))
    asked = F.coalesce(F.size("depends_on") > 0, F.lit(False))
    base = F.when(asked, from_signals).when(F.col("declared_conf").isNotNull(), F.col("declared_conf")).otherwise("low")
    known = (asked & F.col("least").isNotNull()) | (~asked & F.col("declared_conf").isNotNull())
    confidence = F.when(derived & known, downgrade(base)).otherwise(base)
    source = (
        F.when(asked, F.coalesce(F.array_join(F.transform("on", lambda x: x["signal_id"]), ", "), F.lit("(no coverage)")))
        .when(F.col("declared_conf").isNotNull(), F.col("declared_label")).otherwise("(unsourced)")
    )
    return rows.select(*keys, "id", "section", "claim", source.alias("source"), confidence.alias("confidence"))


def checklist(resolved: DataFrame) -> DataFrame:
    """One row: how many claims of each confidence, and the ids that are not high."""
    return resolved.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("confidence") == k).alias(k) for k in ("high", "medium", "low")],
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("confidence") != "high", F.col("id")))), ",").alias("to_check"),
    )


def merge_claims(own: DataFrame, supplied: DataFrame) -> DataFrame:
    """Own claims, and those supplied whose id is not among them."""
    return own.unionByName(supplied.join(own.select("id"), "id", "left_anti"), allowMissingColumns=True)


def source_claims(components: DataFrame) -> DataFrame:
    """Claims of researched costs (component, label, confidence): never more than 0.75, so never high."""
    sure = F.least(F.greatest("confidence", F.lit(0.0)), F.lit(0.75))
    return components.select(
        F.concat(F.lit("cost-"), "component").alias("id"), F.lit("B").alias("section"), F.col("component").alias("claim"),
        F.array().cast("array<string>").alias("depends_on"), F.col("label").alias("declared_label"), tier_of(sure).alias("declared_conf"),
        F.lit(False).alias("derived"),
    )


def percent_pair(avg: Column, peak: Column) -> Column:
    return F.concat(half_up(avg * 100).cast("string"), F.lit("/"), half_up(peak * 100).cast("string"), F.lit("%"))
