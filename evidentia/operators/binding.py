"""From cells to values of signals: alias matches, bindings, merges, gate answers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.numbers import finite, is_percent, parse_number
from evidentia.functions.text import norm, role_token

VALUE = "struct<num:double,avg:double,peak:double,str:string>"
BINDING = ["signal_id", "value", "confidence", "method", "source", "locator"]


def _value(num=None, avg=None, peak=None, text=None) -> Column:
    none = F.lit(None).cast("double")
    parts = [(num, "num"), (avg, "avg"), (peak, "peak")]
    return F.struct(
        *[(x.cast("double") if x is not None else none).alias(n) for x, n in parts],
        (text if text is not None else F.lit(None).cast("string")).alias("str"),
    )


def alias_match(headers: DataFrame, header: str, signals: DataFrame) -> DataFrame:
    """``headers`` with the signal whose longest alias stands in the normalised header; unmatched ones go.

    The first signal in the profile's order wins a tie. The aliases of a profile are one sorted array that goes
    to every task, so rows are neither shuffled nor gathered by header.
    """
    aliases = signals.select("signal_id", "value_kind", "ord", F.explode("aliases").alias("alias"))
    ranked = aliases.agg(
        F.sort_array(F.collect_list(F.struct((-F.length("alias")).alias("by"), "ord", "alias", "signal_id", "value_kind"))).alias("__aliases")
    )
    hits = F.filter("__aliases", lambda a: F.col("__norm").contains(a["alias"]))
    met = headers.withColumn("__norm", norm(F.col(header))).join(F.broadcast(ranked)).withColumn("__hit", F.get(hits, F.lit(0)))
    return met.where("__hit is not null").select(*headers.columns, "__hit.signal_id", "__hit.value_kind")


def bind_pairs(pairs: DataFrame, signals: DataFrame) -> DataFrame:
    """Bindings of (source, key, value): exact scalars and enumerations."""
    met = alias_match(pairs, "key", signals)
    number, text = parse_number(F.col("value")), F.trim("value")
    scalar = F.col("value_kind") == "scalar"
    met = met.where((scalar & number.isNotNull()) | ((F.col("value_kind") == "enum") & (text != "")))
    value = F.when(scalar, _value(num=number)).otherwise(_value(text=text))
    return met.select(
        "signal_id", value.alias("value"), F.when(scalar, 1.0).otherwise(0.9).alias("confidence"),
        F.lit("keyvalue").alias("method"), "source", F.col("key").alias("locator"),
    )


def _firsts(order: str) -> list[Column]:
    """The first number and the first filled cell of a group, in an order."""
    number = F.struct(F.col(order), parse_number(F.col("cell")).alias("x"))
    text = F.struct(F.col(order), F.trim("cell").alias("x"))
    return [
        F.min(F.when(parse_number(F.col("cell")).isNotNull(), number))["x"].alias("num"),
        F.min(F.when(F.trim("cell") != "", text))["x"].alias("str"),
    ]


def _lookup(found: DataFrame, locator: str) -> DataFrame:
    scalar = F.col("value_kind") == "scalar"
    found = found.where((scalar & F.col("num").isNotNull()) | ((F.col("value_kind") == "enum") & F.col("str").isNotNull()))
    return found.select(
        "signal_id", F.when(scalar, _value(num=F.col("num"))).otherwise(_value(text=F.col("str"))).alias("value"),
        F.when(scalar, 0.95).otherwise(0.9).alias("confidence"), F.lit("table-lookup").alias("method"), "source",
        F.col(locator).alias("locator"),
    )


def bind_wide(cells: DataFrame, roles: DataFrame, facts: DataFrame, signals: DataFrame) -> DataFrame:
    """Tables without a time axis: each column's first value, money columns left out."""
    still = roles.where("time_idx is null").select("source")
    money = facts.where("is_currency").select("source", "col_idx")
    own = cells.join(still, "source").join(money, ["source", "col_idx"], "left_anti")
    per = own.groupBy("source", "col_idx", "header").agg(*_firsts("row_idx"))
    return _lookup(alias_match(per, "header", signals), "header")


def bind_long(cells: DataFrame, roles: DataFrame, signals: DataFrame) -> DataFrame:
    """Tables without a time axis: rows whose first cell is a label and whose next value is the signal's."""
    own = cells.join(roles.where("time_idx is null").select("source"), "source")
    labels = own.where("col_idx = 0").select("source", "row_idx", F.col("cell").alias("label"))
    rest = own.where("col_idx > 0").groupBy("source", "row_idx").agg(*_firsts("col_idx"))
    return _lookup(alias_match(labels.join(rest, ["source", "row_idx"]), "label", signals), "label")


def bind_series(cells: DataFrame, roles: DataFrame, signals: DataFrame) -> DataFrame:
    """Series tables: mean and peak of each matched column without negative samples; the first column of a signal wins.

    Utilisation is a fraction of one, other series stay as they are.
    """
    timed = roles.where("time_idx is not null").select("source", "time_idx")
    own = cells.join(timed, "source").where("col_idx != time_idx")
    x = parse_number(F.col("cell"))
    per = own.withColumn("x", F.when(x >= 0, x)).groupBy("source", "col_idx", "header").agg(
        F.avg("x").alias("avg"), F.max("x").alias("peak"), F.count("x").alias("n")
    ).where("n > 0")
    met = alias_match(per, "header", signals).where("value_kind = 'avgPeak'")
    first = Window.partitionBy("source", "signal_id").orderBy("col_idx")
    met = met.withColumn("k", F.row_number().over(first)).where("k = 1")
    scale = F.when(F.col("signal_id").startswith("util.") & is_percent(F.col("header"), F.col("peak")), 100.0).otherwise(1.0)
    return met.select(
        "signal_id", _value(avg=F.col("avg") / scale, peak=F.col("peak") / scale).alias("value"), F.lit(0.95).alias("confidence"),
        F.lit("numeric-series").alias("method"), "source", F.col("header").alias("locator"),
    )


def read_values(raw: DataFrame, signals: DataFrame) -> DataFrame:
    """Bindings of values that a reader outside delivers: (signal_id, num, avg, peak, str, confidence, method, source, locator).

    The profile's kind of value decides. Mean and peak lie in [0, 1], the mean not above the peak;
    scalars are finite and not negative; enumerations are not blank. Confidence is clamped
    to [0, 1], and is 0.6 where it is missing. All else goes.
    """
    met = raw.join(signals.select("signal_id", "value_kind"), "signal_id")
    pair = finite(F.col("avg")) & finite(F.col("peak")) & F.col("avg").between(0, 1) & F.col("peak").between(0, 1) & (F.col("avg") <= F.col("peak"))
    good = (
        F.when(F.col("value_kind") == "avgPeak", pair)
        .when(F.col("value_kind") == "scalar", finite(F.col("num")) & (F.col("num") >= 0))
        .otherwise(F.trim("str") != "")
    )
    value = (
        F.when(F.col("value_kind") == "avgPeak", _value(avg=F.col("avg"), peak=F.col("peak")))
        .when(F.col("value_kind") == "scalar", _value(num=F.col("num")))
        .otherwise(_value(text=F.trim("str")))
    )
    confidence = F.when(finite(F.col("confidence")), F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0))).otherwise(0.6)
    return met.where(F.coalesce(good, F.lit(False))).select(
        "signal_id", value.alias("value"), confidence.alias("confidence"), "method", "source", "locator"
    )


#: Where the use of a role's nodes is kept. Fixed values.
ROLE_SIGNALS = (("primary", "util.primary"), ("secondary", "util.hoSec"), ("dr", "util.dr"))


def read_panels(panels: DataFrame, signals: DataFrame) -> DataFrame:
    """Bindings of a picture's panels (source, idx, label, signal_id, num, avg, peak, str, confidence), with ``heuristic``.

    Panels of use are told apart by role, picture by picture (assign_roles), and their signal is the role's; ``heuristic``
    marks those whose role was not on the label. All others keep their signal. What read_values() refuses goes before roles are dealt.
    """
    named = panels.withColumns({"method": F.lit("vision"), "locator": F.col("idx").cast("string")})
    good = read_values(named, signals)
    use = F.col("signal_id").startswith("util.")
    placed = good.where(use).select("source", F.col("locator").cast("long").alias("idx"), "value", "confidence", "method", "locator")
    labels = panels.select("source", F.col("idx").cast("long").alias("idx"), "label")
    roles = assign_roles(placed.join(labels, ["source", "idx"]).withColumn("peak", F.col("value.peak")).select("source", "idx", "label", "peak"), ["source"])
    signal = F.lit(None).cast("string")
    for role, name in ROLE_SIGNALS:
        signal = F.when(F.col("role") == role, name).otherwise(signal)
    dealt = placed.join(roles.select("source", "idx", signal.alias("signal_id"), "heuristic"), ["source", "idx"])
    return good.where(~use).withColumn("heuristic", F.lit(False)).unionByName(dealt.drop("idx"))


def merge_bindings(candidates: DataFrame, methods: DataFrame, keys: tuple[str, ...] = ("signal_id",)) -> DataFrame:
    """One binding per signal, whatever the order of the candidates: trust, confidence, source, value.

    An aggregate, not a window: candidates of a signal are combined before the shuffle.
    """
    rank = F.struct(
        (-F.coalesce("trust", F.lit(-1))).alias("t"), (-F.col("confidence")).alias("c"), F.coalesce("source", F.lit("")).alias("s"),
        F.to_json("value").alias("v"),
    )
    others = [c for c in candidates.columns if c not in keys]
    best = candidates.join(methods.select("method", "trust"), "method", "left").groupBy(*keys).agg(
        F.min_by(F.struct(*others), rank).alias("b")
    )
    return best.select(*keys, "b.*").select(candidates.columns)


def merge_more(best: DataFrame, candidates: DataFrame, methods: DataFrame, keys: tuple[str, ...] = ("signal_id",)) -> DataFrame:
    """The best of the bindings so far and of candidates that came since.

    What wins among all wins against the winner so far, so earlier candidates are not read again.
    """
    return merge_bindings(best.unionByName(candidates.select(best.columns)), methods, keys)


def tier_lookup(names: DataFrame, tiers: DataFrame, column: str = "tier") -> DataFrame:
    """The processors of known tiers; unknown names give no row."""
    return names.withColumn("__t", F.upper(F.trim(column))).join(
        tiers.select(F.col("tier").alias("__t"), "vcpu"), "__t"
    ).drop("__t")


def synthesize_tiers(candidates: DataFrame, methods: DataFrame, tiers: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Candidates with processors from the best tier's name instead of from pictures, case by case (``keys``).

    Where the tier is known, pictures' readings of processors go, and a look-up is added
    for each kind of node that no exact method has bound.
    """
    best = merge_bindings(candidates.where("signal_id = 'node.atlasTier'"), methods, (*keys, "signal_id"))
    known = tier_lookup(best.select(*keys, "source", "locator", F.col("value.str").alias("tier")), tiers)
    nodes = ["node.hoVcpu", "node.drVcpu"]
    exact = candidates.where(F.col("method").isin("keyvalue", "numeric-series", "table-lookup", "manual")).where(F.col("signal_id").isin(nodes))
    added = known.select(*keys, F.explode(F.array(*map(F.lit, nodes))).alias("signal_id"), "source", "locator", "vcpu").join(
        exact.select(*keys, "signal_id").distinct(), [*keys, "signal_id"], "left_anti"
    )
    added = added.select(
        *keys, "signal_id", _value(num=F.col("vcpu")).alias("value"), F.lit(1.0).alias("confidence"), F.lit("table-lookup").alias("method"), "source", "locator"
    )
    seen = F.col("signal_id").isin(nodes) & (F.col("method") == "vision")
    if keys:
        flagged = candidates.join(known.select(*keys).distinct().withColumn("known", F.lit(True)), list(keys), "left")
    else:
        flagged = candidates.crossJoin(F.broadcast(known.agg((F.count(F.lit(1)) > 0).alias("known"))))
    left = flagged.where(~(F.coalesce("known", F.lit(False)) & seen))
    return left.select(*keys, *BINDING).unionByName(added.select(*keys, *BINDING))


def apply_answers(bindings: DataFrame, answers: DataFrame, methods: DataFrame) -> DataFrame:
    """Bindings with the answers of a person: (signal_id, num, avg, peak, str, confirmed). Confirmed ones override, others only fill."""
    given = answers.select(
        "signal_id", _value(F.col("num"), F.col("avg"), F.col("peak"), F.col("str")).alias("value"),
        F.lit(1.0).alias("confidence"), F.when(F.col("confirmed"), "manual").otherwise("assumption-default").alias("method"),
        F.lit("gate").alias("source"), F.col("signal_id").alias("locator"),
    )
    return merge_bindings(bindings.select(BINDING).unionByName(given), methods)


def missing_required(bindings: DataFrame, signals: DataFrame) -> DataFrame:
    """Required signals without a value."""
    bound = bindings.where("value is not null").select("signal_id").distinct()
    return signals.where("criticality = 'required'").select("signal_id", "ord").join(bound, "signal_id", "left_anti")


def sizing_inputs(bindings: DataFrame, signals: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row of inputs for each case (``keys``), or none while a required signal of it has no value."""
    wide = bindings.groupBy(*keys).agg(*[
        F.max(F.when(F.col("signal_id") == s, F.col(f"value.{part}"))).alias(name)
        for s, part, name in (
            ("cluster.shardCount", "num", "shards"), ("node.hoVcpu", "num", "ho_vcpu"), ("node.drVcpu", "num", "dr_vcpu"),
            ("util.primary", "avg", "primary_avg"), ("util.primary", "peak", "primary_peak"), ("util.hoSec", "avg", "ho_sec_avg"),
            ("util.hoSec", "peak", "ho_sec_peak"), ("util.dr", "avg", "dr_avg"), ("util.dr", "peak", "dr_peak"),
            ("data.storageSizeGb", "num", "storage_gb"),
        )
    ])
    if keys:
        required = signals.where("criticality = 'required'").select("signal_id")
        bound = bindings.where("value is not null").join(required, "signal_id").groupBy(*keys).agg(F.count_distinct("signal_id").alias("bound"))
        return wide.join(bound, list(keys)).where(F.col("bound") == required.count()).drop("bound")
    gaps = missing_required(bindings, signals).agg(F.count(F.lit(1)).alias("gaps"))
    return wide.crossJoin(gaps).where("gaps = 0").drop("gaps")


def assign_roles(panels: DataFrame, keys: list[str]) -> DataFrame:
    """Roles of utilisation panels (keys, idx, label, peak): role, heuristic.

    A label's own role holds for its highest peak, the first in order of equals. All others, by
    peak if any is known, else in their order, fill the open roles primary, secondary, dr; the rest are dr.
    """
    token = role_token(F.col("label"))
    peak = F.coalesce("peak", F.lit(-1.0))
    rows = panels.withColumns({"token": token, "pk": peak})
    claim = Window.partitionBy(*keys, "token").orderBy(F.desc("pk"), "idx")
    rows = rows.withColumn("won", F.col("token").isNotNull() & (F.row_number().over(claim) == 1))
    whole = Window.partitionBy(*keys)
    rows = rows.withColumns({
        "claimed": F.collect_set(F.when(F.col("won"), F.col("token"))).over(whole),
        "any_peak": F.max(F.when(~F.col("won"), F.col("pk"))).over(whole) >= 0,
    })
    # Losers of a claim come after the unlabelled ones at equal peaks, in the order of roles.
    late = F.coalesce(F.array_position(F.array(*map(F.lit, ("primary", "secondary", "dr"))), F.col("token")), F.lit(0))
    order = Window.partitionBy(*keys, "won").orderBy(F.when(F.col("any_peak"), -F.col("pk")).otherwise(F.col("idx")), late, "idx")
    slots = F.array_except(F.array(*map(F.lit, ("primary", "secondary", "dr"))), F.col("claimed"))
    rows = rows.withColumn("k", F.row_number().over(order))
    role = F.when(F.col("won"), F.col("token")).otherwise(F.coalesce(F.get(slots, F.col("k") - 1), F.lit("dr")))
    return rows.select(*keys, "idx", "label", "peak", role.alias("role"), (~F.col("won")).alias("heuristic"))
