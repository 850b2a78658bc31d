"""A case from its files on: triage, checks of what goes into it, the model of its costs, its business case."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.config import CONTEXT_KINDS, POSTURES, QUALITIES
from evidentia.functions.numbers import finite, iso_date, thousands
from evidentia.functions.text import escape_html, is_noise, slug
from evidentia.operators.binding import BINDING, bind_long, bind_pairs, bind_series, bind_wide, merge_bindings, read_values, synthesize_tiers
from evidentia.operators.numbering import numbered
from evidentia.operators.series import column_facts, table_roles
from evidentia.plans.charts import bar_chart, line_chart
from evidentia.plans.costs import annual_saving, baseline_total, discount, five_years, payback, proposed_total
from evidentia.plans.render import dollars, page
from evidentia.plans.sizing import restore_hours
from evidentia.scratch import Scratch
from evidentia.sources.files import cells_of

#: Files beyond this many bytes are not archived. Fixed value.
MOST_ARCHIVED = 50 << 20


@dataclass(frozen=True)
class Triage:
    """bindings: one per case and signal; inventory: what each part is; warnings: cases whose panels' roles were guessed."""

    bindings: DataFrame
    inventory: DataFrame
    warnings: DataFrame


def one_case(source: Column) -> Column:
    return F.lit("case")


def triage(
    parts: DataFrame, signals: DataFrame, methods: DataFrame, tiers: DataFrame, readings: DataFrame | None = None,
    case_of: Callable[[Column], Column] = one_case,
) -> Triage:
    """From extracted parts to the values of signals, for all cases at once.

    ``case_of`` tells a source's case. Noise is left out; tables, pairs and the values that readers outside
    deliver (``readings``: as for read_values, with ``heuristic`` where a panel's role was guessed) give candidates, tiers
    give processors, and the most trusted candidate of a signal stays. Parts, cells, candidates and bindings are written to the
    shared folder, as each is used several times; what comes after reads them there.
    """
    scratch = Scratch(parts.sparkSession)
    source = F.when(F.coalesce("part", F.lit("")) == "", F.col("name")).otherwise(F.concat_ws("#", "name", "part"))
    parts = scratch.keep(parts, "parts")
    read = parts.where("kind is not null").withColumn("source", source)
    cells = scratch.keep(cells_of(parts), "cells")
    roles, facts = table_roles(cells), column_facts(cells)
    pairs = read.where("kind = 'keyvalue'").select("source", F.explode("pairs").alias("key", "value"))
    found = bind_wide(cells, roles, facts, signals).unionByName(bind_long(cells, roles, signals)).unionByName(bind_series(cells, roles, signals))
    found = found.unionByName(bind_pairs(pairs, signals))
    if readings is not None:
        found = found.unionByName(read_values(readings, signals))
    found = scratch.keep(found, "found")
    named = found.select(case_of(F.col("source")).alias("case"), *BINDING)
    bindings = scratch.keep(merge_bindings(synthesize_tiers(named, methods, tiers, ("case",)), methods, ("case", "signal_id")), "bindings")

    own = found.groupBy("source").agg(F.array_sort(F.collect_set("signal_id")).alias("signals"))
    noise = F.when(F.col("kind") == "text", is_noise(F.col("text"))).when(F.col("kind") == "table", F.col("table_role").isNull()).otherwise(False)
    role = (
        F.when(noise, "noise").when(F.col("kind") == "table", F.col("table_role")).when(F.col("kind") == "keyvalue", "topology")
        .when(F.col("kind") == "text", "prose").when(F.col("kind") == "image", "chart").otherwise("unknown")
    )
    seen = read.join(roles.select("source", F.col("role").alias("table_role")), "source", "left").join(own, "source", "left")
    inventory = seen.select(
        case_of(F.col("source")).alias("case"), "source", "kind", role.alias("role"),
        F.when(noise, F.array().cast("array<string>")).otherwise(F.coalesce("signals", F.array().cast("array<string>"))).alias("signals"), noise.alias("ignored"),
    )
    guessed = (readings if readings is not None and "heuristic" in readings.columns else found.withColumn("heuristic", F.lit(False))).where(
        "heuristic and signal_id like 'util.%'"
    )
    warnings = guessed.groupBy(case_of(F.col("source")).alias("case")).agg(F.count(F.lit(1)).alias("n")).select(
        "case", F.concat(F.col("n").cast("string"), F.lit(" panel(s) had no role label; their roles were assigned by load. Check the topology.")).alias("warning")
    )
    return Triage(bindings, scratch.keep(inventory, "inventory"), warnings)


def asked_of(signals: DataFrame, method: str) -> DataFrame:
    """The signals that a method may derive."""
    return signals.where(F.array_contains("derivable_by", method))


def context_items(raw: DataFrame) -> DataFrame:
    """(text, source, category) of what was said: blank texts and unknown categories go, and nothing is merged."""
    return raw.select(F.trim("text").alias("text"), "source", "category").where((F.col("text") != "") & F.col("category").isin(*CONTEXT_KINDS))


def merge_context(*lists: DataFrame) -> DataFrame:
    """All items of several lists; what two sources say stays twice, as repetition is emphasis."""
    whole = lists[0]
    for more in lists[1:]:
        whole = whole.unionByName(more)
    return whole


def with_places(parts: DataFrame) -> DataFrame:
    """Extracted parts with ``idx``, their place from 0 in the order of name and part, by ranges of that order."""
    found = numbered(parts, [], ["name", F.coalesce("part", F.lit("")), "kind"], "idx")
    return found.withColumn("idx", F.col("idx") - 1)


def without_images(parts: DataFrame, excluded: DataFrame) -> DataFrame:
    """Parts without the pictures that are excluded by their place (idx), not by their source."""
    gone = excluded.select(F.col("idx").alias("__idx"))
    return parts.join(gone, (F.col("idx") == F.col("__idx")) & (F.col("kind") == "image"), "left_anti")


def archived_sources(files: DataFrame, most: int = MOST_ARCHIVED) -> DataFrame:
    return files.where(F.col("length") <= most)


def new_case_id(company: Column, at: Column) -> Column:
    """The company's slug, or ``case``, and the time's milliseconds in base 36."""
    return F.concat(slug(company, 48, "case"), F.lit("-"), F.lower(F.conv(F.unix_millis(at).cast("string"), 10, 36)))


def profile_problems(profiles: DataFrame) -> DataFrame:
    """``profiles`` (shards, ho_vcpu, dr_vcpu, data_gb, dr_posture) with ``problem``: the first thing that is wrong, or null."""
    def positive(c: str) -> Column:
        return F.when(~F.coalesce(finite(F.col(c)) & (F.col(c) > 0), F.lit(False)), F.lit(f"{c} is not a positive number"))

    recovery = F.when(~F.coalesce(finite(F.col("dr_vcpu")) & (F.col("dr_vcpu") >= 0), F.lit(False)), F.lit("dr_vcpu is not a number of 0 or more"))
    posture = F.when(F.col("dr_posture").isNotNull() & ~F.col("dr_posture").isin(*POSTURES), F.lit("dr_posture is unknown"))
    return profiles.withColumn("problem", F.coalesce(positive("shards"), positive("ho_vcpu"), positive("data_gb"), recovery, posture))


def cost_profiles(inputs: DataFrame, bindings: DataFrame, keys: tuple[str, ...] = ("case",)) -> DataFrame:
    """What cost research is asked for: a case's bound inputs and its posture if it is a known one; nothing is made up."""
    posture = bindings.where("signal_id = 'dr.posture'").select(*keys, F.col("value.str").alias("p")).where(F.col("p").isin(*POSTURES))
    return inputs.join(posture, list(keys), "left").select(
        *keys, "shards", "ho_vcpu", "dr_vcpu", F.col("storage_gb").alias("data_gb"), F.col("p").alias("dr_posture")
    )


def source_problems(sources: DataFrame, components: tuple[str, ...]) -> DataFrame:
    """``sources`` (component, source, url, as_of, quality) with ``problem``: the first thing that is wrong, or null."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    known = lambda c, few: F.coalesce(F.col(c).isin(*few), F.lit(False))
    return sources.withColumn("problem", F.coalesce(
        F.when(~known("component", components), F.lit("component is unknown")), F.when(~known("quality", QUALITIES), F.lit("quality is unknown")),
        F.when(blank(F.col("source")), F.lit("source is empty")),
        F.when(blank(F.col("url")) & (F.col("quality") != "training-cutoff"), F.lit("url is missing")),
        F.when(iso_date(F.col("as_of")).isNull(), F.lit("as_of is no date")),
    ))


def cost_model(costs: DataFrame, cases: DataFrame, keys: list[str]) -> DataFrame:
    """One row per case of ``cases`` (keys, discount_pct, data_gb): totals, savings, five years and recovery, at the discount.

    The discount holds for the proposed side only; its list prices are carried where there is one.
    """
    own = discount(costs.join(cases.select(*keys, "discount_pct"), keys), F.col("discount_pct"))

    def by_posture(df: DataFrame, *values: tuple[str, str]) -> DataFrame:
        return df.groupBy(*keys).agg(*[
            F.max(F.when(F.col("posture") == p, F.col(v))).alias(f"{name}_{p}".strip("_")) for v, name in values for p in ("warm", "cold")
        ])

    streams = five_years(own, keys)
    runs = streams.groupBy(*keys).agg(
        F.max(F.when((F.col("posture") == "warm") & (F.col("year") == 1), F.col("a"))).alias("transition"),
        *[F.transform(F.array_sort(F.collect_list(F.when(F.col("posture") == p, F.struct("year", F.col(c).alias("sum"))))), lambda x: x["sum"]).alias(n)
          for p, c, n in (("warm", "cum_b", "stay_cum"), ("warm", "cum_a", "warm_cum"), ("cold", "cum_a", "cold_cum"))],
    )
    parts = [
        baseline_total(own, keys).select(*keys, F.col("central").alias("onprem")),
        proposed_total(own, keys).where("posture = 'none'").select(*keys, F.col("central").alias("primary")), by_posture(proposed_total(own, keys), ("central", "")),
        by_posture(proposed_total(costs, keys), ("central", "list")), by_posture(annual_saving(own, keys), ("saving", "saving"), ("saving_pct", "pct")),
        by_posture(payback(streams, keys), ("net", "net"), ("payback_year", "payback")), runs,
    ]
    model = cases
    for part in parts:
        model = model.join(part, keys)
    off = F.col("discount_pct") > 0
    return model.withColumns({"list_warm": F.when(off, F.col("list_warm")), "list_cold": F.when(off, F.col("list_cold"))}).withColumnsRenamed(
        {"pct_warm": "saving_warm_pct", "pct_cold": "saving_cold_pct"}
    ).withColumn("cold_hours", restore_hours(F.col("data_gb") / 1000))


def cost_claims(model: DataFrame, sized: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, section, claim, value, depends_on, declared_label, declared_conf, derived): peak consumption, and what the costs come to."""
    none = F.array().cast("array<string>")

    def k(x: Column) -> Column:
        return F.concat(F.lit("$"), thousands(x).cast("string"), F.lit("K"))

    def claim(i: str, text: str, value: Column, label: str, sure: str, derived: bool) -> Column:
        return F.struct(F.lit(i).alias("id"), F.lit("A").alias("section"), F.lit(text).alias("claim"), value.alias("value"), none.alias("depends_on"),
                        F.lit(label).alias("declared_label"), F.lit(sure).alias("declared_conf"), F.lit(derived).alias("derived"))

    year = F.lit("/yr")
    back = F.coalesce(F.concat(F.lit("Year "), F.col("payback_warm").cast("string")), F.lit("beyond 5 yrs"))
    rows = model.select(*keys, F.explode(F.array(
        claim("tco-onprem", "Cost of staying", F.concat(k(F.col("onprem")), year), "model of current costs", "medium", False),
        claim("tco-adb-warm", "Cost with warm recovery", F.concat(k(F.col("warm")), year), "list rates", "high", False),
        claim("tco-adb-cold", "Cost with cold recovery", F.concat(k(F.col("cold")), year), "list rates", "high", False),
        claim("tco-saving-warm", "Lower cost a year, warm", F.concat(F.col("saving_warm_pct").cast("string"), F.lit("%")), "derived from both costs", "medium", True),
        claim("tco-net5-warm", "Saving over five years, warm", k(F.col("net_warm")), "derived from five years", "medium", True),
        claim("tco-payback", "Payback, warm", back, "derived from running sums", "medium", True),
    )).alias("c")).select(*keys, "c.*")
    on = F.array(*map(F.lit, ("util.primary", "util.hoSec", "util.dr", "node.hoVcpu", "cluster.shardCount")))
    peak = sized.select(
        *keys, F.lit("sz-peak-ecpu").alias("id"), F.lit("C").alias("section"), F.lit("Peak consumption").alias("claim"), F.col("work_peak").cast("string").alias("value"),
        on.alias("depends_on"), F.lit(None).cast("string").alias("declared_label"), F.lit(None).cast("string").alias("declared_conf"), F.lit(True).alias("derived"),
    )
    return peak.unionByName(rows)


#: Ways to recover: posture, title, time to restore (null: the model's hours), lost data, how one switches over. Fixed values.
RECOVERY = (
    ("warm", "Warm", "< 10 min", "0 (switchover) / ≤ 1 min (failover)", "manual cross-region"),
    ("cold", "Cold", None, "~1 min", "manual cross-region"),
)
#: Names of components for people; others go by their own.
COMPONENT_LABELS = (("license", "Licences"), ("hardware", "Servers"), ("storage", "Storage"), ("facility", "Data centre"), ("labor", "Staff"), ("backup", "Backup and recovery"))


def recovery_options(model: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, posture, title, added, total, restore, lost, failover) of cost_model() rows, two for each case."""
    hours = F.concat(F.lit("~"), F.col("cold_hours").cast("string"), F.lit(" hrs"))
    ways = F.array(*[
        F.struct(F.lit(k).alias("ord"), F.lit(p).alias("posture"), F.lit(title).alias("title"), (F.col(p) - F.col("primary")).alias("added"), F.col(p).alias("total"),
                 (F.lit(restore) if restore else hours).alias("restore"), F.lit(lost).alias("lost"), F.lit(over).alias("failover"))
        for k, (p, title, restore, lost, over) in enumerate(RECOVERY)
    ])
    return model.select(*keys, F.explode(ways).alias("o")).select(*keys, "o.*")


def component_labels(costs: DataFrame) -> DataFrame:
    """``costs`` with ``label``: a component's name for people, or its own."""
    label = F.col("component")
    for name, told in COMPONENT_LABELS:
        label = F.when(F.col("component") == name, told).otherwise(label)
    return costs.withColumn("label", label)


def case_charts(costs: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cost_svg, years_svg): today's components and both postures as bars, and the running costs of five years as lines."""
    own = component_labels(costs.where("side = 'baseline'"))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("central"), "component"))  # a case's few components
    today = own.select(*keys, F.lit(0).alias("bar"), order.alias("ord"), F.lit("today").alias("label"), thousands(F.col("central")).alias("value"))
    ways = [
        F.struct(F.lit(bar).alias("bar"), F.lit(k).alias("ord"), F.lit(p).alias("label"), thousands(x).alias("value"))
        for bar, p in ((1, "warm"), (2, "cold")) for k, x in enumerate((F.col("primary"), F.col(p) - F.col("primary")))
    ]
    bars = bar_chart(today.unionByName(model.select(*keys, F.explode(F.array(*ways)).alias("s")).select(*keys, "s.*")), keys)
    runs = model.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("line"), F.col(c).alias("ys")) for n, c in (("stay", "stay_cum"), ("warm", "warm_cum"), ("cold", "cold_cum"))])).alias("r"))
    points = runs.select(*keys, "r.line", F.posexplode("r.ys").alias("x", "y"))
    return bars.withColumnRenamed("svg", "cost_svg").join(line_chart(points, keys).withColumnRenamed("svg", "years_svg"), keys)


#: Passages of a business case, each a column of text that is supplied.
PASSAGES = ("summary", "comparison", "path", "recovery", "assumptions", "quote", "next_steps")


def business_case(model: DataFrame, keys: list[str], charts: DataFrame | None = None) -> DataFrame:
    """(keys, filename, html) of cost_model() rows with company, prepared, status and the PASSAGES; no figure is computed here.

    ``charts`` of case_charts() stand by the comparison and the path.
    """
    model = model.join(charts, keys, "left") if charts is not None else model.withColumns({"cost_svg": F.lit(""), "years_svg": F.lit("")})
    svg = lambda c: F.coalesce(c, F.lit(""))
    told = recovery_options(model, keys)
    def text(c: str) -> Column:
        return escape_html(F.coalesce(F.col(c).cast("string"), F.lit("")))

    def block(tag: str, *inside: Column) -> Column:
        return F.concat(F.lit(f"<{tag}>"), *inside, F.lit(f"</{tag.split()[0]}>"))

    def stat(value: Column, label: str) -> Column:
        return block("div", block("b", value), F.lit(f" {label}"))

    line = lambda name, value: F.concat(F.lit(f"<li>{name}: "), value, F.lit("</li>"))
    card = F.concat(
        F.lit("<h3>"), "title", F.lit("</h3><ul>"), line("Added a year", F.concat(F.lit("+"), dollars(F.col("added")), F.lit(", in all "), dollars(F.col("total")))),
        line("Restored in", escape_html(F.col("restore"))), line("Data lost", escape_html(F.col("lost"))), line("Failover", escape_html(F.col("failover"))), F.lit("</ul>"),
    )
    cards = told.withColumn("card", card).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "card"))), lambda x: x["card"]), "").alias("cards"))
    model = model.join(cards, keys)
    off = F.col("list_warm").isNotNull()
    percent = F.concat(F.col("discount_pct").cast("int").cast("string"), F.lit("%"))
    warm = F.when(off, F.concat(block("s", dollars(F.col("list_warm"))), F.lit(" "), dollars(F.col("warm")), F.lit(" ("), percent, F.lit(" discount)"))).otherwise(dollars(F.col("warm")))
    body = F.concat(
        block("p", text("prepared"), F.lit(" · "), text("status")), block("p", text("summary")),
        stat(dollars(F.col("onprem")), "a year today"), stat(warm, "a year with warm recovery"),
        stat(F.concat(F.col("saving_warm_pct").cast("string"), F.lit("%")), "lower cost"), stat(F.concat(F.lit("Yr "), F.coalesce(F.col("payback_warm").cast("string"), F.lit("—"))), "payback"),
        F.lit("<h2>Comparison</h2>"), svg(F.col("cost_svg")), block("p", text("comparison")), F.lit("<h2>Path</h2>"), block("p", text("path")), svg(F.col("years_svg")),
        F.lit("<h2>Recovery</h2>"), block("p", text("recovery")), F.col("cards"),
        F.lit("<h2>Assumptions</h2>"), block("p", text("assumptions")), block("blockquote", text("quote")), F.lit("<h2>Next steps</h2>"), block("p", text("next_steps")),
    )
    name = F.concat(F.lit("business-case-"), slug(F.col("company"), None, "case"), F.lit(".html"))
    return model.select(*keys, name.alias("filename"), page(model, F.concat("company", F.lit(" — Business Case")), body).alias("html"))
