"""One nested document for each case, and the pages that are rendered from it; no figure is computed here."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.numbers import half_up
from evidentia.functions.text import escape_html, slug
from evidentia.plans.claims import SECTIONS
from evidentia.plans.render import dollars, page

#: What people supply for a case besides its figures, each a column of text.
HEAD = ("company", "platform", "prepared", "status")
BRIEF_PASSAGES = ("context", "approach", "evidence", "questions")
REVIEW_PASSAGES = ("notes", "risk", "data_model", "validation")
INPUTS = ("shards", "ho_vcpu", "dr_vcpu", "primary_avg", "primary_peak", "ho_sec_avg", "ho_sec_peak", "dr_avg", "dr_peak", "storage_gb")
CONSUMED = ("work_avg", "work_peak", "work_ratio", "full_avg", "full_peak", "full_ratio")
SCENARIO = ("posture", "base", "ceiling_2x", "ceiling_3x", "monthly_compute", "monthly_storage", "total_monthly", "total_annual")


def _listed(rows: DataFrame, keys: list[str], name: str, order: Column | str, fields: list[str]) -> DataFrame:
    """(keys, name): the rows of each case as one array, in order. A case's rows are as few as its signals, files or claims."""
    at = order if isinstance(order, Column) else F.col(order)
    held = F.array_sort(F.collect_list(F.struct(at.alias("__at"), F.struct(*fields).alias("row"))))
    return rows.groupBy(*keys).agg(F.transform(held, lambda x: x["row"]).alias(name))


def sufficiency_report(cases: DataFrame, inventory: DataFrame, covered: DataFrame, judged: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """One row per case of ``cases``: inventory, coverage, verdict and what to collect, each in order.

    ``inventory`` (keys, name, role, signals), ``covered`` of coverage(), ``judged`` of verdict_text(), ``asked`` of what_to_collect() with requests;
    all name the case. A case without rows in one of them has an empty list there.
    """
    verdict = [c for c in judged.columns if c not in keys]
    parts = [
        _listed(inventory, keys, "inventory", "name", ["name", "role", "signals"]),
        _listed(covered, keys, "coverage", "ord", ["signal_id", "criticality", "status", "effective", "method"]),
        judged.select(*keys, F.struct(*verdict).alias("verdict")),
        _listed(asked, keys, "collect", "rank", ["signal_id", "severity", "state", "request", "why"]),
    ]
    out = cases.select(*keys).distinct()
    for part in parts:
        out = out.join(part, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.array()) for c in ("inventory", "coverage", "collect")})


def assemble(
    cases: DataFrame, sized: DataFrame, scenarios: DataFrame, report: DataFrame, keys: list[str], model: DataFrame | None = None, claims: DataFrame | None = None,
) -> DataFrame:
    """One row per case: what people supplied (``cases``), sizing, sufficiency, costs and claims, nested.

    ``sized`` of consumed(), ``scenarios`` of scenarios(), ``report`` of sufficiency_report(), ``model`` of cost_model() and ``claims`` of
    resolve_claims(), each by case. What a case lacks is null or empty; it is not left out.
    """
    basis = sized.select(*keys, F.struct(*INPUTS).alias("basis"), F.struct(*CONSUMED).alias("consumed"))
    postures = F.when(F.col("posture") == "conservative", 0).otherwise(1)
    own = basis.join(_listed(scenarios, keys, "scenarios", postures, list(SCENARIO)), keys, "left").select(*keys, F.struct("basis", "consumed", "scenarios").alias("sizing"))
    out = cases.join(own, keys, "left").join(report.select(*keys, F.struct("inventory", "coverage", "verdict", "collect").alias("sufficiency")), keys, "left")
    if model is not None:
        figures = [c for c in model.columns if c not in cases.columns]
        out = out.join(model.select(*keys, F.struct(*figures).alias("costs")), keys, "left")
    if claims is not None:
        rank = F.struct(F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")).alias("s"), F.col("id").alias("i"))
        out = out.join(_listed(claims, keys, "claims", rank, ["id", "section", "claim", "source", "confidence"]), keys, "left").withColumn("claims", F.coalesce("claims", F.array()))
    return out


def _text(c: str) -> Column:
    return escape_html(F.coalesce(F.col(c).cast("string"), F.lit("")))


def _paragraph(*inside: Column) -> Column:
    return F.concat(F.lit("<p>"), *inside, F.lit("</p>"))


def _cells(*values: Column) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), F.coalesce(v.cast("string"), F.lit("")), F.lit("</td>")) for v in values], F.lit("</tr>"))


def _table(header: tuple[str, ...], lines: Column) -> Column:
    head = "<table><tr>" + "".join(f"<th>{h}</th>" for h in header) + "</tr>"
    return F.concat(F.lit(head), F.coalesce(F.array_join(lines, ""), F.lit("")), F.lit("</table>"))


def _percent(x: Column) -> Column:
    return F.concat(half_up(x * 100).cast("string"), F.lit("%"))


def _fixed(x: Column, digits: int) -> Column:
    return F.when(x.isNull(), F.lit("—")).otherwise(F.format_string(f"%.{digits}f", half_up(x * 10**digits) / 10**digits))


def _rendered(documents: DataFrame, keys: list[str], name: str, title: str, body: Column) -> DataFrame:
    file = F.concat(F.lit(f"{name}-"), slug(F.coalesce("company", F.lit("")), None, "case"), F.lit(".html"))
    whole = F.concat(_paragraph(_text("prepared"), F.lit(" · "), _text("status")), body)
    return documents.select(*keys, file.alias("filename"), page(documents, F.concat(F.coalesce("company", F.lit("")), F.lit(f" — {title}")), whole).alias("html"))


def sizing_brief(documents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, filename, html) of documents with the BRIEF_PASSAGES: environment, load by role, scenarios, and what is still to ask."""
    b, c = F.col("sizing.basis"), F.col("sizing.consumed")
    roles = F.array(*[_cells(F.lit(n), _percent(b[f"{p}_avg"]), _percent(b[f"{p}_peak"])) for n, p in (("Primary", "primary"), ("Secondary", "ho_sec"), ("Recovery", "dr"))])
    environment = F.array(
        _cells(F.lit("Shards"), b["shards"].cast("long")), _cells(F.lit("Processors per home node"), b["ho_vcpu"].cast("long")),
        _cells(F.lit("Processors per recovery node"), b["dr_vcpu"].cast("long")), _cells(F.lit("Data on disk"), F.concat(_fixed(b["storage_gb"] / 1000, 1), F.lit(" TB"))),
    )
    ratio = F.concat(F.lit("The peak is "), _fixed(c["work_ratio"], 2), F.lit(" times the mean of "), _fixed(c["work_avg"], 1), F.lit(": "), _fixed(c["work_peak"], 1))
    years = F.transform("sizing.scenarios", lambda s: _cells(
        F.initcap(s["posture"]), s["base"], F.concat_ws(" / ", s["ceiling_2x"], s["ceiling_3x"]), dollars(12 * s["monthly_compute"]), dollars(12 * s["monthly_storage"]), dollars(s["total_annual"])
    ))
    asked = F.transform("sufficiency.collect", lambda x: F.concat(F.lit("<li>"), escape_html(F.coalesce(x["request"], x["signal_id"])), F.lit("</li>")))
    body = F.concat(
        _paragraph(_text("context")), F.lit("<h2>Environment</h2>"), _table(("Attribute", "Value"), environment),
        F.lit("<h2>Load by role</h2>"), _table(("Role", "Mean", "Peak"), roles), _paragraph(ratio), F.lit("<h2>Approach</h2>"), _paragraph(_text("approach")),
        F.lit("<h2>Scenarios</h2>"), _table(("Scenario", "Base", "2x / 3x", "Compute a year", "Storage a year", "Total a year"), years),
        F.lit("<h2>Evidence</h2>"), _paragraph(_text("evidence")), F.lit("<h2>Open questions</h2>"),
        F.when(F.size("sufficiency.collect") > 0, F.concat(F.lit("<ul>"), F.array_join(asked, ""), F.lit("</ul>"))).otherwise(_paragraph(_text("questions"))),
    )
    return _rendered(documents, keys, "sizing-brief", "Sizing Brief", body)


def technical_review(documents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, filename, html) of documents with the REVIEW_PASSAGES: verdict, inventory, coverage, what to collect, sensitivity."""
    s = F.col("sufficiency")
    v = s["verdict"]
    files = F.transform(s["inventory"], lambda i: _cells(escape_html(i["name"]), escape_html(i["role"]), escape_html(i["signals"])))
    signals = F.transform(s["coverage"], lambda i: _cells(i["signal_id"], i["criticality"], i["status"], F.format_string("%.2f", i["effective"]), F.coalesce(i["method"], F.lit("—"))))
    asked = F.transform(s["collect"], lambda i: _cells(i["signal_id"], i["severity"], escape_html(F.coalesce(i["request"], F.lit(""))), escape_html(F.coalesce(i["why"], F.lit("")))))
    bases = F.transform("sizing.scenarios", lambda i: _cells(F.initcap(i["posture"]), i["base"], F.concat_ws(" / ", i["ceiling_2x"], i["ceiling_3x"])))
    verdict = F.concat(F.lit("<b>"), v["tier"], F.lit("</b> "), escape_html(v["headline"]), F.lit(". "), escape_html(v["rationale"]))
    body = F.concat(
        F.lit("<h2>Rationale</h2>"), _paragraph(_text("notes")), F.lit("<h2>Evidence</h2>"), _paragraph(verdict),
        F.lit("<h3>Files</h3>"), _table(("File", "Role", "Signals"), files), F.lit("<h3>Signals</h3>"), _table(("Signal", "Criticality", "Status", "Confidence", "Method"), signals),
        F.when(F.size(s["collect"]) > 0, F.concat(F.lit("<h3>To collect</h3>"), _table(("Signal", "Severity", "Request", "Why"), asked))).otherwise(""),
        F.lit("<h2>Sensitivity</h2>"), _table(("Posture", "Base", "2x / 3x"), bases), F.lit("<h2>Risk</h2>"), _paragraph(_text("risk")),
        F.lit("<h2>Data model</h2>"), _paragraph(_text("data_model")), F.lit("<h2>Validation</h2>"), _paragraph(_text("validation")),
    )
    return _rendered(documents, keys, "technical-review", "Technical Review", body)


def refinements(history: DataFrame, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    """(keys, instruction): the requests of each case so far, in order, as one; blank ones go, and a case of blank ones alone has none."""
    rows = history.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    held = F.array_sort(F.collect_list(F.struct(*order, F.trim(text).alias("__t"))))  # a case's requests are a person's, and few
    return rows.groupBy(*keys).agg(F.array_join(F.transform(held, lambda x: x["__t"]), " Then: ").alias("instruction"))
