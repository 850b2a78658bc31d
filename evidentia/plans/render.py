"""Documents: rows of HTML per case, built from result tables by column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.numbers import half_up
from evidentia.functions.text import escape_html
from evidentia.plans.claims import SECTIONS


def dollars(x: Column) -> Column:
    """$1.23M from a million on, else $123K."""
    millions = F.concat(F.lit("$"), F.format_string("%.2f", x / 1_000_000), F.lit("M"))
    return F.when(F.abs(x) >= 1_000_000, millions).otherwise(F.concat(F.lit("$"), half_up(x / 1000).cast("string"), F.lit("K")))


def table_rows(df: DataFrame, keys: list[str], order: list[str], cells: list[Column], header: list[str]) -> DataFrame:
    """(keys, html): one table per case; a case's rows are few."""
    line = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), F.coalesce(escape_html(c.cast("string")), F.lit("")), F.lit("</td>")) for c in cells], F.lit("</tr>"))
    rows = df.select(*keys, F.struct(*order, line.alias("__line")).alias("__r")).groupBy(*keys).agg(F.array_sort(F.collect_list("__r")).alias("__r"))
    head = "<tr>" + "".join(f"<th>{h}</th>" for h in header) + "</tr>"
    body = F.array_join(F.transform("__r", lambda r: r["__line"]), "")
    return rows.select(*keys, F.concat(F.lit(f"<table>{head}"), body, F.lit("</table>")).alias("html"))


def page(parts: DataFrame, title: Column, body: Column) -> Column:
    name = escape_html(title)
    return F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), name, F.lit("</title></head><body><h1>"), name, F.lit("</h1>"), body, F.lit("</body></html>"))


def checklist_page(resolved: DataFrame, keys: list[str], title: str) -> DataFrame:
    """(keys, html): claims by section, in the order of the sections."""
    rank = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    rows = table_rows(resolved.withColumn("__s", rank), keys, ["__s", "id"], [F.col(c) for c in ("section", "claim", "source", "confidence")],
                      ["Section", "Claim", "Source", "Confidence"])
    return rows.withColumn("html", page(rows, F.lit(title), F.col("html")))


def scenario_page(scenarios: DataFrame, keys: list[str], title: str) -> DataFrame:
    """(keys, html): a case's scenarios with their bases, ceilings and costs."""
    cells = [F.col("posture"), F.col("base"), F.col("ceiling_2x"), F.col("ceiling_3x"), dollars(F.col("total_annual"))]
    rows = table_rows(scenarios, keys, ["posture"], cells, ["Posture", "Base", "2x", "3x", "Year"])
    return rows.withColumn("html", page(rows, F.lit(title), F.col("html")))


def coverage_page(covered: DataFrame, title: str) -> DataFrame:
    cells = [F.col("signal_id"), F.col("criticality"), F.col("status"), F.format_string("%.2f", "effective"), F.coalesce("method", F.lit(""))]
    rows = table_rows(covered.withColumn("case", F.lit(title)), ["case"], ["ord"], cells, ["Signal", "Criticality", "Status", "Confidence", "Method"])
    return rows.select(page(rows, F.lit(title), F.col("html")).alias("html"))


def as_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json): each row as one document."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("json"))
