"""Reports: events of failures, their text and mail, claims of a sizing, a folder rewritten by a map."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.numbers import thousands
from evidentia.functions.text import redact_keys
from evidentia.operators.numbering import numbered
from evidentia.operators.phrases import replace_phrases, slug_conflicts
from evidentia.plans.claims import percent_pair
from evidentia.scratch import Scratch
from evidentia.sources.files import quarantine, read_files, write_files
from evidentia.sources.folder import plain_path

MAIL_CHARS = 1500
#: Longer texts are not rewritten. Fixed value.
MOST_TEXT = 64 << 20


def file_events(parts: DataFrame, at: Column, key: Column | None = None) -> DataFrame:
    """(id, at, category, title, message, context) of files that could not be read; keys are blotted out."""
    kind = F.when(F.col("error").startswith("unsupported") | (F.col("type") == "unknown"), "unsupported_format").when(F.col("type") == "too large", "too_large").otherwise("malformed_file")
    rows = parts.where("error is not null")
    return rows.select(
        F.concat_ws("-", kind, F.xxhash64("name").cast("string")).alias("id"), at.alias("at"), kind.alias("category"), F.concat(kind, F.lit(": "), "name").alias("title"),
        redact_keys(F.col("error"), key).alias("message"), F.create_map(F.lit("file"), "name", F.lit("type"), "type").alias("context"),
    )


def hide_names(events: DataFrame, text: str = "message") -> DataFrame:
    """File names in messages and titles become file-1, file-2 and so on, in the order of time and name; an event's own name is hidden."""
    own = events.select(F.col("context")["file"].alias("__name"), "at").where("__name is not null").groupBy("__name").agg(F.min("at").alias("__at"))
    ranked = numbered(own, [], ["__at", "__name"], "__k").select("__name", "__k")
    met = events.join(ranked, events["context"]["file"] == F.col("__name"), "left")
    alias = F.concat(F.lit("file-"), F.col("__k").cast("string"))
    return met.withColumns({c: F.when(F.col("__k").isNotNull(), F.replace(c, F.col("__name"), alias)).otherwise(F.col(c)) for c in (text, "title")}).drop("__name", "__k")


def report_lines(events: DataFrame) -> DataFrame:
    """(at, line): the events of a report as text lines in order."""
    context = F.array_join(F.transform(F.array_sort(F.map_entries("context")), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")
    line = F.concat(F.lit("["), F.col("at").cast("string"), F.lit("] "), F.upper("category"), F.lit(" - "), "title", F.lit("\n  "), "message", F.lit("\n  context: "), context)
    return events.select("at", "id", line.alias("line")).orderBy("at", "id").drop("id")


def mail_body(events: DataFrame, header: str, footer: str, most: int = MAIL_CHARS) -> DataFrame:
    """One row, body: counts by category, the most frequent first, as far as they fit; the footer always stays."""
    counts = events.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    lines = counts.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "category"))).alias("c"))
    lines = lines.select(F.transform("c", lambda x: F.concat(F.lit("  - "), (-x["k"]).cast("string"), F.lit(" x "), x["category"], F.lit("\n"))).alias("c"))
    room, more = most - len(header) - len(footer), "  - more in the report\n"
    fitted = F.aggregate(
        "c", F.struct(F.lit("").alias("t"), F.lit(False).alias("full")),
        lambda a, x: F.when(a["full"], a).otherwise(F.when(
            F.length(a["t"]) + F.length(x) <= room, F.struct(F.concat(a["t"], x).alias("t"), F.lit(False).alias("full"))
        ).otherwise(F.struct(F.when(F.length(a["t"]) + len(more) <= room, F.concat(a["t"], F.lit(more))).otherwise(a["t"]).alias("t"), F.lit(True).alias("full")))),
    )["t"]
    return lines.select(F.concat(F.lit(header), fitted, F.lit(footer)).alias("body"))


def mail_link(to: Column, subject: Column, body: Column) -> Column:
    return F.concat(F.lit("mailto:"), to, F.lit("?subject="), F.url_encode(subject), F.lit("&body="), F.url_encode(body))


def sizing_claims(inputs: DataFrame, scenarios: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Claims of a sizing, or of each case (``keys``): its inputs by signal, and what was derived from them."""
    def claim(i: str, section: str, text: str, value: Column, on: tuple[str, ...], derived: bool) -> Column:
        return F.struct(F.lit(i).alias("id"), F.lit(section).alias("section"), F.lit(text).alias("claim"), value.cast("string").alias("value"),
                        F.array(*map(F.lit, on)).alias("depends_on"), F.lit(derived).alias("derived"))

    own = inputs.select(*keys, F.explode(F.array(
        claim("in-shards", "F", "Shards", F.col("shards"), ("cluster.shardCount",), False),
        claim("in-ho-vcpu", "F", "Processors per home node", F.col("ho_vcpu"), ("node.hoVcpu",), False),
        claim("in-dr-vcpu", "F", "Processors per recovery node", F.col("dr_vcpu"), ("node.drVcpu",), False),
        claim("in-primary", "F", "Use of primaries, mean/peak", percent_pair(F.col("primary_avg"), F.col("primary_peak")), ("util.primary",), False),
        claim("in-ho-sec", "F", "Use of secondaries, mean/peak", percent_pair(F.col("ho_sec_avg"), F.col("ho_sec_peak")), ("util.hoSec",), False),
        claim("in-dr", "F", "Use in recovery, mean/peak", percent_pair(F.col("dr_avg"), F.col("dr_peak")), ("util.dr",), False),
    )).alias("c")).select(*keys, "c.*")
    base = scenarios.select(
        *keys,
        F.concat(F.lit("base-"), "posture").alias("id"), F.lit("C").alias("section"), F.concat(F.initcap("posture"), F.lit(" base")).alias("claim"), F.col("base").cast("string").alias("value"),
        F.array(*map(F.lit, ("util.primary", "node.hoVcpu", "cluster.shardCount"))).alias("depends_on"), F.lit(True).alias("derived"),
    )
    return own.unionByName(base)


def total_claims(savings: DataFrame, paid: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, posture, saving, net, payback) as texts for people."""
    met = savings.join(paid, [*keys, "posture"])
    return met.select(
        *keys, "posture", F.concat(F.col("saving_pct").cast("string"), F.lit("%")).alias("saving"),
        F.concat(F.lit("$"), thousands(F.col("net")).cast("string"), F.lit("K")).alias("net"),
        F.coalesce(F.concat(F.lit("year "), F.col("payback_year").cast("string")), F.lit("beyond the years shown")).alias("payback"),
    )


def rewrite_folder(spark: SparkSession, path: str, entries: DataFrame, out: str, reverse: bool = False) -> DataFrame:
    """Replaces phrases in every text file below ``path``; returns (name, flag, n_replaced), names below the folder.

    Nothing is written if a slug already stands in some text, as it could not be undone. ``out``/texts gets the texts, name
    for name, and ``out``/flagged the files that are no texts, as they are; each all at once. A flagged file beyond
    the reader's limits is listed and stays where it is.
    """
    top = path.rstrip("/") + "/"
    files = quarantine(read_files(spark, path, MOST_TEXT)).withColumn("name", F.replace("name", F.lit(plain_path(top) or top), F.lit("")))
    files = files.withColumn("flag", F.when(F.col("content").isNull(), F.coalesce("flag", F.lit("binary"))).otherwise(F.col("flag")))
    texts = files.where("flag is null").select("name", F.decode("content", "UTF-8").alias("text"))
    if not reverse:
        held = [r.slug for r in slug_conflicts(texts, entries).limit(10).collect()]
        if held:
            raise ValueError(f"slugs already in the texts: {', '.join(sorted(held))}")
    done = Scratch(spark).keep(replace_phrases(texts, entries, reverse=reverse), "rewritten")
    write_files(done.select("name", F.col("text").alias("content")), f"{out}/texts")
    write_files(files.where("flag is not null and content is not null"), f"{out}/flagged")
    return done.select("name", F.lit(None).cast("string").alias("flag"), "n_replaced").unionByName(files.where("flag is not null").select("name", "flag", F.lit(0).alias("n_replaced")))


def format_report(rewritten: DataFrame, shown: int = 20) -> DataFrame:
    """One row, report: what ``rewrite_folder`` did as text: counts by flag, and the first ``shown`` flagged names."""
    counts = rewritten.groupBy(F.coalesce("flag", F.lit("rewritten")).alias("what")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_replaced").alias("hits"))
    lines = counts.select("what", F.concat(F.lit("  "), "what", F.lit(": "), F.col("n").cast("string"), F.lit(" file(s), "), F.col("hits").cast("string"), F.lit(" replacement(s)")).alias("line"))
    flagged = rewritten.where("flag is not null").orderBy("name").limit(shown)  # a report's length, not a result's
    both = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("what", "line"))), lambda x: x["line"]), "\n").alias("a")).crossJoin(
        flagged.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "flag"))), lambda x: F.concat(F.lit("  left as it is: "), x["name"], F.lit(" ("), x["flag"], F.lit(")"))), "\n").alias("b"))
    )
    return both.select(F.concat_ws("\n", F.lit("Files:"), F.nullif("a", F.lit("")), F.nullif("b", F.lit(""))).alias("report"))
