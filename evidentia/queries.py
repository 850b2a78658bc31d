"""The engine's queries over the driver's tables; small dimensions are literal rows."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.config import METHODS, label_table, method_table, request_table, signal_table, tier_table
from evidentia.functions import numbers as N
from evidentia.functions import text as T
from evidentia.operators import binding as B
from evidentia.operators import coverage as C
from evidentia.operators import layout as L
from evidentia.operators import phrases as P
from evidentia.operators import series as S
from evidentia.plans import archive as V
from evidentia.plans import case as X
from evidentia.plans import charts as H
from evidentia.plans import claims as K
from evidentia.plans import costs as M
from evidentia.plans import documents as O
from evidentia.plans import ledger as G
from evidentia.plans import render as D
from evidentia.plans import reports as E
from evidentia.plans import sizing as Z
from evidentia.scratch import Scratch
from evidentia.sources import files as R

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(x):
    return F.floor(x * 1e6 + 0.5) / 1e6


# --- series and columns -----------------------------------------------------------------------


@query
def series_stats(spark, d):
    s = S.series_stats(t(spark, d, "events"), ["event_type"], "value")
    return s.select("event_type", r6(F.col("avg")).alias("avg"), "peak", "p95", "least", "n")


@query
def series_nonneg_filter(spark, d):
    s = S.series_stats(t(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", keep_negative=False)
    return s.select("c_mktsegment", r6(F.col("avg")).alias("avg"), "peak", "p95", "least", "n")


@query
def percent_scale(spark, d):
    a = S.series_stats(t(spark, d, "events"), ["event_type"], "value").withColumnRenamed("event_type", "header")
    b = S.series_stats(t(spark, d, "lineitem").withColumn("header", F.concat(F.lit("discount % "), "l_returnflag")), ["header"], "l_discount")
    f = S.as_fraction(a.unionByName(b), F.col("header"))
    return f.select("header", r6(F.col("avg_fraction")).alias("avg_fraction"), r6(F.col("peak_fraction")).alias("peak_fraction"))


def table_cells(spark, d) -> DataFrame:
    parts = [("events", "event_id", ["ts", "user_id", "value", "event_type"]), ("orders", "o_orderkey", ["o_orderstatus", "o_totalprice", "o_orderpriority"]),
             ("nation", "n_nationkey", ["n_name", "n_regionkey"])]
    cells = [S.long_cells(t(spark, d, n), F.lit(n), F.col(k), c) for n, k, c in parts]
    return cells[0].unionByName(cells[1]).unionByName(cells[2])


@query
def column_role(spark, d):
    return S.table_roles(table_cells(spark, d))


@query
def column_facts(spark, d):
    return S.column_facts(table_cells(spark, d))


@query
def parse_numeric(spark, d):
    p = t(spark, d, "part")
    priced = F.concat(F.lit(" 1,"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit("% off"))
    return p.select("p_partkey", N.parse_number(F.concat(F.col("p_size").cast("string"), F.lit(" units"))).alias("size"),
                    N.parse_number(F.col("p_brand")).alias("brand"), N.parse_number(priced).alias("priced"))


# --- bindings ---------------------------------------------------------------------------------

HEADERS = ("System CPU", "Secondary  CPU (%)", "DR CPU", "Number of Shards", "instance size", "Disk IOPS", "shards", "storage size GB",
           "Logical Data Size", "RAM per node", "no such thing", "Date", "compressed data size", "Atlas Tier", "dr region cores")


@query
def alias_match(spark, d):
    """How many parts stand under each header, with the brand in it, and what it is."""
    p = t(spark, d, "part")
    word = F.element_at(F.array(*map(F.lit, HEADERS)), (F.col("p_partkey") % len(HEADERS) + 1).cast("int"))
    headers = p.groupBy(F.concat(word, F.lit(" "), "p_brand").alias("header")).agg(F.count(F.lit(1)).alias("n"))
    return B.alias_match(headers, "header", signal_table(spark)).select("header", "signal_id", "value_kind", "n")


def event_candidates(spark, d) -> DataFrame:
    method = F.element_at(F.array(*[F.lit(m[0]) for m in METHODS]), (F.col("user_id") % 8 + 1).cast("int"))
    return t(spark, d, "events").select(
        F.col("event_type").alias("signal_id"), F.struct(F.col("value").alias("num")).alias("value"),
        (F.col("event_id") % 100 / 100).alias("confidence"), method.alias("method"), F.concat(F.lit("e"), "event_id").alias("source"),
        F.col("event_id").cast("string").alias("locator"),
    )


@query
def merge_bindings(spark, d):
    best = B.merge_bindings(event_candidates(spark, d), method_table(spark))
    return best.select("signal_id", F.col("value.num").alias("num"), "confidence", "method", "source")


@query
def role_assign(spark, d):
    peaks = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_acctbal").alias("peak"))
    n = t(spark, d, "nation").join(peaks, "n_nationkey", "left")
    label = F.element_at(F.array(*map(F.lit, ("Primary CPU", "HA secondary CPU", "panel", "DR site"))), F.col("n_nationkey") % 4 + 1)
    idx = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    return B.assign_roles(n.select("n_regionkey", idx.alias("idx"), label.alias("label"), "peak"), ["n_regionkey"])


@query
def tier_lookup(spark, d):
    name = F.concat(F.lit(" m"), (F.col("s_suppkey") % 31 * 10).cast("string"), F.lit(" "))
    return B.tier_lookup(t(spark, d, "supplier").select("s_suppkey", name.alias("name")), tier_table(spark), "name").select("s_suppkey", "name", "vcpu")


def supplier_candidates(spark, d) -> DataFrame:
    """A case for each nation; its suppliers tell tiers, processors and shards, in pictures, texts and tables."""
    k = F.col("s_suppkey")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (k % 4 + 1).cast("int"))
    text = F.when(k % 4 == 0, F.concat(F.lit("M"), (k % 9 * 10).cast("string")))
    value = F.struct(F.when(k % 4 != 0, (k % 7 + 1).cast("double")).alias("num"), F.lit(None).cast("double").alias("avg"), F.lit(None).cast("double").alias("peak"), text.alias("str"))
    method = F.when((k % 4 == 2) & (F.col("s_nationkey") % 2 == 0), "keyvalue").otherwise(pick("llm-text", "vision", "vision", "table-lookup"))
    source = F.concat(F.lit("s"), k.cast("string"))
    return t(spark, d, "supplier").select(
        F.col("s_nationkey").alias("case"), pick("node.atlasTier", "node.hoVcpu", "node.drVcpu", "cluster.shardCount").alias("signal_id"), value.alias("value"),
        (k % 100 / 100).alias("confidence"), method.alias("method"), source.alias("source"), source.alias("locator"))


@query
def tier_synthesis(spark, d):
    found = B.synthesize_tiers(supplier_candidates(spark, d), method_table(spark), tier_table(spark), ("case",))
    return found.select("case", "signal_id", "confidence", "method", "source", F.col("value.num").alias("num"), F.col("value.str").alias("str"))


def nation_bindings(spark, d) -> DataFrame:
    """A binding for most signals: the nation of the same number says how it was found."""
    k = F.col("n_nationkey")
    method = F.element_at(F.array(*[F.lit(m[0]) for m in METHODS]), k % 8 + 1)
    value = F.when(k % 6 != 5, F.struct(k.cast("double").alias("num"), F.lit(None).cast("double").alias("avg"), F.lit(None).cast("double").alias("peak"), F.lit(None).cast("string").alias("str")))
    s = signal_table(spark).join(t(spark, d, "nation"), F.col("ord") == k)
    return s.select("signal_id", value.alias("value"), (k * 37 % 100 / 100).alias("confidence"), method.alias("method"), F.concat(F.lit("f#"), "n_name").alias("source"), F.lit("x").alias("locator"))


def covered(spark, d) -> DataFrame:
    return C.coverage(signal_table(spark), nation_bindings(spark, d), method_table(spark))


@query
def coverage(spark, d):
    return covered(spark, d).select("signal_id", "criticality", "status", "effective", "method")


@query
def verdict(spark, d):
    return C.verdict(covered(spark, d)).withColumn("mean_confidence", r6(F.col("mean_confidence")))


@query
def verdict_text(spark, d):
    c = covered(spark, d)
    return C.verdict_text(C.verdict(c), c, label_table(spark)).select("tier", "headline", "rationale")


@query
def nation_verdicts(spark, d):
    """A case for each nation, with the signals whose number the region divides."""
    judged = C.verdict(nation_coverage(spark, d), keys=("n_nationkey",))
    return judged.select("n_nationkey", "tier", "required_satisfied", "required_missing", r6(F.col("mean_confidence")).alias("mean_confidence"))


def nation_coverage(spark, d) -> DataFrame:
    """Coverage of a case for each nation, with the signals whose number the region divides."""
    n = t(spark, d, "nation").select("n_nationkey", (F.col("n_regionkey") + 1).alias("every"))
    k = F.col("ord")
    b = n.crossJoin(F.broadcast(signal_table(spark).select("signal_id", "ord"))).where(k % F.col("every") == 0)
    value = F.struct(k.cast("double").alias("num"), F.lit(None).cast("double").alias("avg"), F.lit(None).cast("double").alias("peak"), F.lit(None).cast("string").alias("str"))
    b = b.select("n_nationkey", "signal_id", value.alias("value"), (F.lit(1.0) - F.col("n_nationkey") / 100).alias("confidence"), F.lit("keyvalue").alias("method"))
    return C.coverage(signal_table(spark), b, method_table(spark), cases=n.select("n_nationkey"))


def nation_documents(spark, d) -> DataFrame:
    """A document for each nation: the load of its first supplier, its suppliers as files, its coverage, and claims on both."""
    key = ["n_nationkey"]
    c = nation_coverage(spark, d)
    first = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_suppkey").alias("s_suppkey"))
    sized = Z.consumed(loads(spark, d).join(first, "s_suppkey")).drop("s_suppkey")
    scenarios = Z.scenarios(sized)
    role = F.when(F.col("s_suppkey") % 2 == 0, "evidence").otherwise("noise")
    files = t(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("name"), role.alias("role"), F.lit("").alias("signals"))
    cases = t(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("company"), F.lit("x").alias("platform"), F.lit("2026-06-30").alias("prepared"), F.lit("draft").alias("status"),
                                         *[F.concat(F.lit(f"{p} <"), F.col("n_regionkey").cast("string"), F.lit(">")).alias(p) for p in (*O.BRIEF_PASSAGES, *O.REVIEW_PASSAGES)])
    judged = C.verdict_text(C.verdict(c, keys=("n_nationkey",)), c, label_table(spark), ("n_nationkey",))
    asked = C.what_to_collect(c, request_table(spark), ("n_nationkey",))
    report = O.sufficiency_report(cases, files, c, judged, asked, key)
    told = E.sizing_claims(sized, scenarios, ("n_nationkey",)).withColumns({x: F.lit(None).cast("string") for x in ("declared_label", "declared_conf")})
    return O.assemble(cases, sized, scenarios, report, key, claims=K.resolve_claims(told, c, ("n_nationkey",)))


@query
def case_documents(spark, d):
    """What the documents hold, case by case."""
    doc = nation_documents(spark, d)
    count = lambda a, f: F.size(F.filter(a, f))
    return doc.select(
        "n_nationkey", "company", F.col("sufficiency.verdict.tier").alias("tier"), F.size("sufficiency.inventory").alias("files"), F.size("sufficiency.coverage").alias("signals"),
        count("sufficiency.collect", lambda x: x["severity"] == "blocking").alias("blocking"), F.get("sufficiency.collect.signal_id", F.lit(0)).alias("ask_first"),
        F.get("sizing.scenarios.base", F.lit(0)).alias("base"), F.size("claims").alias("claims"), count("claims", lambda x: x["confidence"] == "high").alias("sure"),
    )


@query
def sizing_briefs(spark, d):
    return O.sizing_brief(nation_documents(spark, d), ["n_nationkey"])


@query
def technical_reviews(spark, d):
    return O.technical_review(nation_documents(spark, d), ["n_nationkey"])


@query
def case_claims(spark, d):
    """Claims of sizings with their confidence, by case."""
    c = nation_documents(spark, d).select("n_nationkey", F.explode("claims").alias("c"))
    return c.select("n_nationkey", "c.*")


@query
def checklist_pages(spark, d):
    c = nation_documents(spark, d).select("n_nationkey", F.explode("claims").alias("c")).select("n_nationkey", "c.*")
    return D.checklist_page(c, ["n_nationkey"], "Claims & sources")


@query
def case_json(spark, d):
    return D.as_json(t(spark, d, "nation").select("n_nationkey", "n_name", F.struct(F.col("n_regionkey").alias("region"), F.array("n_name").alias("names")).alias("more")), ["n_nationkey"])


@query
def valid_case_ids(spark, d):
    k = F.col("c_custkey")
    i = F.when(k % 5 == 0, F.col("c_name")).when(k % 5 == 1, F.concat(F.lit("-"), k.cast("string"))).when(k % 5 == 2, F.lit("../x")).otherwise(F.concat(F.lit("c-"), k.cast("string")))
    return t(spark, d, "customer").select("c_custkey", i.rlike(V.CASE_ID).alias("valid"))


@query
def archived_pages(spark, d):
    return X.archived_sources(t(spark, d, "pages").select("page_id", F.octet_length("html").alias("length")), 2000)


@query
def label_widths(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", r6(H.text_width(F.concat("s_name", F.lit(" é")), 12.5)).alias("width"))


def failures(spark, d) -> DataFrame:
    """Files of customers that could not be read."""
    k = F.col("c_custkey")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (k % 5 + 1).cast("int"))
    error = F.when(k % 5 < 4, pick("unsupported format; save it as .eml", "unrecognized file type", "over 10 bytes", "bad header sk-abcd1234 in it", ""))
    parts = t(spark, d, "customer").select(F.col("c_name").alias("name"), pick("msg", "unknown", "too large", "csv", "csv").alias("type"), error.alias("error"))
    return E.file_events(parts, F.lit("2026-01-01"))


@query
def failed_files(spark, d):
    return failures(spark, d).select("at", "category", "title", "message", F.col("context")["file"].alias("file"), F.col("context")["type"].alias("type"))


@query
def report_texts(spark, d):
    return E.report_lines(failures(spark, d))


@query
def report_mail(spark, d):
    return E.mail_body(failures(spark, d), "Files that were not read:\n", "Sent by hand")


@query
def quarantined(spark, d):
    k = F.col("doc_id")
    name = F.concat(F.lit("d"), k.cast("string"), F.element_at(F.array(*map(F.lit, (".txt", ".PNG", ".md"))), (k % 3 + 1).cast("int")))
    tail = F.when(k % 4 == 0, F.unhex(F.lit("00"))).when(k % 4 == 1, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    files = t(spark, d, "documents").select("doc_id", name.alias("name"), F.concat(F.col("text").cast("binary"), tail).alias("content"))
    return R.quarantine(files.withColumn("length", F.octet_length("content")), 3000).select("doc_id", "flag")


@query
def role_warnings(spark, d):
    k = F.col("s_suppkey")
    none = lambda c: F.lit(None).cast(c)
    readings = t(spark, d, "supplier").select(
        F.when(k % 3 == 0, "disk.iops").otherwise("util.dr").alias("signal_id"), none("double").alias("num"), F.lit(0.1).alias("avg"), F.lit(0.2).alias("peak"), none("string").alias("str"), F.lit(0.9).alias("confidence"),
        F.lit("vision").alias("method"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/"), "s_name").alias("source"), F.lit("x").alias("locator"), (k % 2 == 0).alias("heuristic"))
    return X.triage(supplier_parts(spark, d), signal_table(spark), method_table(spark), tier_table(spark), readings, lambda s: F.regexp_extract(s, "^n([0-9]+)/", 1).cast("int")).warnings


@query
def extracted_files(spark, d):
    """Pages, events and customers as files, read by their content."""
    row = F.concat(F.lit("name,segment\n"), "c_name", F.lit(","), "c_mktsegment", F.lit("\n-,"), F.col("c_custkey").cast("string"))
    parts = [(t(spark, d, "pages"), F.concat(F.lit("p"), F.col("page_id").cast("string")), F.col("html")), (t(spark, d, "events"), F.concat(F.lit("e"), F.col("event_id").cast("string")), F.col("props")),
             (t(spark, d, "customer"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")), row), (t(spark, d, "nation"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("Of "), "n_name"))]
    files = None
    for df, name, content in parts:
        one = df.select(name.alias("name"), F.octet_length(content).cast("long").alias("length"), content.cast("binary").alias("content"))
        files = one if files is None else files.unionByName(one)
    return R.extract(files).select("name", "type", "kind", "text", F.array_join("headers", "|").alias("headers"), F.array_join(F.flatten("rows"), "|").alias("cells"), "error")


@query
def refinement_history(spark, d):
    c = t(spark, d, "conversations").where("role = 'user'")
    text = F.when(F.col("turn") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.left("text", F.lit(30))))
    return O.refinements(c.select("conv_id", "turn", text.alias("text")), ["conv_id"], ["turn"])


@query
def case_models(spark, d):
    """Models of a case for each year of shipment, with a discount in odd years."""
    cases = t(spark, d, "lineitem").select(F.year("l_shipdate").alias("yr")).distinct().select(
        "yr", (F.col("yr") % 2 * 25).cast("double").alias("discount_pct"), (F.col("yr") * 10).cast("double").alias("data_gb"))
    m = X.cost_model(costs(spark, d), cases, ["yr"])
    return m.select("yr", r6(F.col("onprem")).alias("onprem"), r6(F.col("warm")).alias("warm"), r6(F.col("cold")).alias("cold"), r6(F.col("list_warm")).alias("list_warm"),
                    "saving_warm_pct", r6(F.col("net_warm")).alias("net_warm"), "payback_warm", r6(F.col("transition")).alias("transition"), "cold_hours")


@query
def business_cases(spark, d):
    """Pages of the same cases, without charts."""
    cases = t(spark, d, "lineitem").select(F.year("l_shipdate").alias("yr")).distinct().select(
        "yr", (F.col("yr") % 2 * 25).cast("double").alias("discount_pct"), (F.col("yr") * 10).cast("double").alias("data_gb"), F.concat(F.lit("Year "), F.col("yr").cast("string")).alias("company"),
        F.lit("2026-06-30").alias("prepared"), F.lit("draft").alias("status"), *[F.concat(F.lit(f"{p} & "), F.col("yr").cast("string")).alias(p) for p in X.PASSAGES])
    return X.business_case(X.cost_model(costs(spark, d), cases, ["yr"]), ["yr"])


@query
def recovery_options(spark, d):
    cases = t(spark, d, "lineitem").select(F.year("l_shipdate").alias("yr")).distinct().select("yr", F.lit(0.0).alias("discount_pct"), (F.col("yr") * 10).cast("double").alias("data_gb"))
    return X.recovery_options(X.cost_model(costs(spark, d), cases, ["yr"]), ["yr"])


@query
def component_labels(spark, d):
    return X.component_labels(costs(spark, d)).select("yr", "component", "label")


def supplier_parts(spark, d) -> DataFrame:
    """A part of each supplier, in its nation's case: settings, a note, thanks, or a picture."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/"), "s_name")
    kind = F.element_at(F.array(*map(F.lit, ("keyvalue", "text", "text", "image"))), (k % 4 + 1).cast("int"))
    pairs = F.when(k % 4 == 0, F.create_map(F.lit("Shards"), (k % 7 + 1).cast("string"), F.lit("Cores per node"), F.lit("8"), F.lit("Edition"), F.lit("standard")))
    text = F.when(k % 4 == 1, F.lit("We run 4 shards on M80 today.")).when(k % 4 == 2, F.lit("Thanks and best wishes"))
    none = lambda c: F.lit(None).cast(c)
    return t(spark, d, "supplier").select(
        name.alias("name"), F.lit("x").alias("type"), kind.alias("kind"), F.lit("").alias("part"), text.alias("text"), none("array<string>").alias("headers"),
        none("array<array<string>>").alias("rows"), pairs.alias("pairs"), none("binary").alias("bytes"), none("string").alias("error"))


def triaged(spark, d) -> X.Triage:
    return X.triage(supplier_parts(spark, d), signal_table(spark), method_table(spark), tier_table(spark), case_of=lambda s: F.regexp_extract(s, "^n([0-9]+)/", 1).cast("int"))


@query
def triage_bindings(spark, d):
    return triaged(spark, d).bindings.select("case", "signal_id", F.col("value.num").alias("num"), F.col("value.str").alias("str"), "confidence", "method", "source")


@query
def triage_inventory(spark, d):
    return triaged(spark, d).inventory.select("case", "source", "kind", "role", F.array_join("signals", ",").alias("signals"), "ignored")


@query
def cost_profiles(spark, d):
    posture = F.element_at(F.array(*map(F.lit, ("none", "cold", "warm", "hot"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    bound = t(spark, d, "supplier").select("s_suppkey", F.lit("dr.posture").alias("signal_id"), F.struct(posture.alias("str")).alias("value"))
    return X.cost_profiles(loads(spark, d), bound, ("s_suppkey",))


@query
def profile_problems(spark, d):
    k = F.col("s_suppkey")
    p = loads(spark, d).select(
        "s_suppkey", F.when(k % 7 == 1, 0.0).otherwise(F.col("shards")).alias("shards"), F.when(k % 7 == 2, F.lit(float("nan"))).otherwise(F.col("ho_vcpu")).alias("ho_vcpu"),
        F.when(k % 7 == 3, -1.0).otherwise(F.col("dr_vcpu")).alias("dr_vcpu"), F.when(k % 7 != 4, F.col("storage_gb") + 1).alias("data_gb"), F.when(k % 7 == 5, "hot").when(k % 7 == 6, "warm").alias("dr_posture"))
    return X.profile_problems(p).select("s_suppkey", "problem")


@query
def source_problems(spark, d):
    k = F.col("ord")
    url = F.when(k % 6 == 0, F.lit(" ")).otherwise(F.lit("http://x"))
    s = source_rows(spark, d).select("ord", F.when(k % 13 == 0, "zzz").otherwise(F.col("component")).alias("component"), F.when(k % 9 == 0, "  ").otherwise(F.col("label")).alias("source"), url.alias("url"), "as_of",
                                     F.when(k % 17 == 0, "guess").otherwise(F.col("quality")).alias("quality"))
    return X.source_problems(s, ("license", "hardware", "storage", "labor")).select("ord", "problem")


def said(spark, d) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("concern", "objection", "joke", "timeline", "positioning"))), (F.col("turn") % 5 + 1).cast("int"))
    text = F.when(F.col("turn") % 4 == 3, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.left("text", F.lit(20)), F.lit(" ")))
    return t(spark, d, "conversations").select(text.alias("text"), F.col("conv_id").cast("string").alias("source"), kind.alias("category"))


@query
def said_items(spark, d):
    return X.context_items(said(spark, d))


@query
def said_twice(spark, d):
    """What two lists say stays twice."""
    items = X.context_items(said(spark, d))
    return X.merge_context(items, items.where("category = 'concern'")).groupBy("source", "category", "text").agg(F.count(F.lit(1)).alias("n"))


@query
def searchable_corpus(spark, d):
    none = lambda c: F.lit(None).cast(c)
    kinds = ("table", "keyvalue", "text", "image")
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (k % 4 + 1).cast("int"))
    c = t(spark, d, "customer").select(
        F.col("c_name").alias("name"), F.lit("").alias("part"), kind.alias("kind"), F.when(k % 4 == 2, F.col("c_mktsegment")).alias("text"), F.when(k % 4 == 0, F.array(F.lit("name"), none("string"), F.lit("segment"))).alias("headers"),
        F.when(k % 4 == 0, F.array(F.array("c_name", F.lit("-"), F.col("c_mktsegment")), F.array(F.lit("x"), F.lit("y"), k.cast("string")))).alias("rows"), F.when(k % 4 == 1, F.create_map(F.lit("a"), F.col("c_name"), F.lit("b"), F.col("c_mktsegment"))).alias("pairs"))
    return P.corpus(c).select("name", "text")


@query
def company_phrases(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.initcap("c_mktsegment"), F.lit("  of Acme Co "), "c_name")).alias("company"))
    return P.company_phrases(c, ["c_custkey"])


@query
def hidden_names(spark, d):
    k = F.col("event_id")
    name = F.concat(F.lit("file "), (k * 7 % 50).cast("string"), F.lit(".csv"))
    context = F.when(k % 5 == 0, F.create_map(F.lit("other"), F.lit("x"))).otherwise(F.create_map(F.lit("file"), name))
    e = t(spark, d, "events").select("event_id", F.col("ts").alias("at"), F.concat(F.lit("cannot read "), name, F.lit(" or "), name).alias("message"), F.concat(F.lit("bad: "), name).alias("title"), context.alias("context"))
    return E.hide_names(e).select("event_id", "message", "title")


@query
def what_to_collect(spark, d):
    return C.what_to_collect(covered(spark, d), request_table(spark))


@query
def gate_items(spark, d):
    return C.gate_items(covered(spark, d)).select("signal_id", "status", "effective")


@query
def missing_required(spark, d):
    return B.missing_required(nation_bindings(spark, d), signal_table(spark)).select("signal_id")


@query
def inventory(spark, d):
    files = spark.createDataFrame([("f", True), ("g", True), ("h", False)], "name string, ok boolean")
    return C.inventory(files, nation_bindings(spark, d).where("value is not null"))


# signal, num, avg, peak, confirmed
ANSWERS = (("cluster.shardCount", 3.0, None, None, True), ("node.hoVcpu", 32.0, None, None, True), ("node.drVcpu", 16.0, None, None, False),
           ("util.primary", None, 0.18, 0.45, True), ("util.hoSec", None, 0.12, 0.35, True), ("util.dr", None, 0.08, 0.2, True), ("data.storageSizeGb", 45800.0, None, None, True))


def answered(spark, d) -> DataFrame:
    rows = spark.createDataFrame([(s, n, a, p, None, c) for s, n, a, p, c in ANSWERS], "signal_id string, num double, avg double, peak double, str string, confirmed boolean")
    return B.apply_answers(nation_bindings(spark, d).where("value is not null"), rows, method_table(spark))


@query
def gate_answers(spark, d):
    return answered(spark, d).select("signal_id", "method", "confidence", F.col("value.num").alias("num"), F.col("value.avg").alias("avg"))


@query
def sizing_inputs(spark, d):
    return B.sizing_inputs(answered(spark, d), signal_table(spark))


KEYS = ("Number of  Shards", "Atlas Tier", "System CPU", "no such thing", "DR region cores")


def flat(bindings: DataFrame) -> DataFrame:
    return bindings.select("source", "signal_id", F.col("value.num").alias("num"), F.col("value.str").alias("str"), "confidence", "method", "locator")


@query
def pair_bindings(spark, d):
    k = F.col("p_partkey")
    value = F.when(k % 4 == 0, F.lit(" ")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" units")))
    key = F.element_at(F.array(*map(F.lit, KEYS)), (k % 5 + 1).cast("int"))
    return flat(B.bind_pairs(t(spark, d, "part").select(k.cast("string").alias("source"), key.alias("key"), value.alias("value")), signal_table(spark)))


def supplier_cells(spark, d) -> DataFrame:
    """A table for each nation, a row for each of its suppliers."""
    k = F.col("s_suppkey")
    s = t(spark, d, "supplier").select(
        "s_nationkey", "s_suppkey", F.when(k % 2 == 0, F.lit("")).otherwise((k % 7).cast("string")).alias("Number of shards"),
        F.concat(F.lit(" M"), (k % 3 * 10).cast("string")).alias("Atlas Tier"), F.concat(F.lit("$"), k.cast("string")).alias("Price of storage size"))
    return S.long_cells(s, F.col("s_nationkey").cast("string"), F.col("s_suppkey"), ["Number of shards", "Atlas Tier", "Price of storage size"])


@query
def wide_bindings(spark, d):
    c = supplier_cells(spark, d)
    return flat(B.bind_wide(c, S.table_roles(c), S.column_facts(c), signal_table(spark)))


@query
def long_bindings(spark, d):
    p = t(spark, d, "part").select("p_brand", "p_partkey", F.element_at(F.array(*map(F.lit, KEYS)), (F.col("p_partkey") % 5 + 1).cast("int")).alias("label"),
                                   F.when(F.col("p_partkey") % 3 == 0, F.lit("-")).alias("note"), F.col("p_size").alias("size"))
    c = S.long_cells(p, F.col("p_brand"), F.col("p_partkey"), ["label", "note", "size"])
    rows = flat(B.bind_long(c, S.table_roles(c), signal_table(spark)))
    return rows.groupBy("source", "signal_id", "locator").agg(F.count(F.lit(1)).alias("n"), F.sum("num").alias("num"), F.max("str").alias("str"))


@query
def series_bindings(spark, d):
    e = t(spark, d, "events").select("event_type", "event_id", "ts", F.col("value").alias("System CPU"), (F.col("value") - 50).alias("DR CPU"), F.col("value").alias("Process CPU"))
    c = S.long_cells(e, F.col("event_type"), F.col("event_id"), ["ts", "System CPU", "DR CPU", "Process CPU"])
    b = B.bind_series(c, S.table_roles(c), signal_table(spark))
    return b.select("source", "signal_id", r6(F.col("value.avg")).alias("avg"), r6(F.col("value.peak")).alias("peak"), "confidence", "method", "locator")


def case_versions(spark, d) -> DataFrame:
    return t(spark, d, "orders").select(F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("case_id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("version"),
                                        F.date_format("o_orderdate", "yyyy-MM-dd").alias("saved_at"), F.array("o_orderpriority", "o_orderstatus").alias("blobs"))


@query
def archive_listing(spark, d):
    return V.listing(case_versions(spark, d))


@query
def archive_commits(spark, d):
    """What an archive of orders holds after two saves, of which the second replaces some versions, a deletion, a compaction and a save anew."""
    path = f"{Scratch(spark).top}/archive"
    rows = lambda o, state: o.select(F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("case_id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("version"),
                                     F.col("o_orderdate").cast("timestamp").alias("saved_at"), F.lit(state).alias("state"), F.array("o_orderstatus").alias("blobs"))
    o = t(spark, d, "orders")
    blobs = o.select(F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("case_id"), F.col("o_orderstatus").alias("blob"), F.col("o_orderstatus").cast("binary").alias("content")).distinct()
    V.save_version(rows(o.where("o_orderkey % 2 = 0"), "first"), blobs, path)
    V.save_version(rows(o.where("o_orderkey % 3 = 0"), "second"), blobs.where("false"), path)
    V.delete_cases(o.where("o_custkey % 5 = 0").select(F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("case_id")), path)
    V.compact(spark, path)
    V.save_version(rows(o.where("o_custkey % 10 = 0 and o_orderkey % 7 = 0"), "anew"), blobs.where("false"), path)
    held = V.stored_blobs(spark, path).groupBy("case_id").agg(F.count(F.lit(1)).alias("n_blobs"))
    return V.versions(spark, path).join(held, "case_id", "left").select("case_id", "version", "state", F.coalesce("n_blobs", F.lit(0).cast("long")).alias("n_blobs"))


@query
def clamped_values(spark, d):
    return t(spark, d, "events").select("event_id", N.clamp(F.col("value") / 100, 0.25, 1.0).alias("share"), N.finite(F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).when(F.col("event_id") % 9 != 1, F.col("value"))).alias("finite"))


@query
def bar_charts(spark, d):
    n = t(spark, d, "nation")
    segments = n.select("n_regionkey", (F.col("n_nationkey") % 3).cast("int").alias("bar"), F.floor(F.col("n_nationkey") / 3).cast("int").alias("ord"), F.concat("n_name", F.lit(" & co")).alias("label"), (F.col("n_nationkey") * 7 + 1).cast("double").alias("value"))
    return H.bar_chart(segments, ["n_regionkey"])


@query
def cells_of_tables(spark, d):
    """Tables of twenty customers each as parts, and their cells; short rows have empty ones."""
    c = t(spark, d, "customer")
    row = F.when(F.col("c_custkey") % 4 == 0, F.array("c_name")).otherwise(F.array("c_name", F.col("c_nationkey").cast("string")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("row")))), lambda x: x["row"])
    tables = c.groupBy(F.concat(F.lit("t"), F.floor(F.col("c_custkey") / 20).cast("string")).alias("name")).agg(rows.alias("rows")).withColumns({"kind": F.lit("table"), "part": F.lit("s1"), "headers": F.array(F.lit("name"), F.lit("nation"))})
    return R.cells_of(tables)


@query
def archive_blobs(spark, d):
    last = V.current(case_versions(spark, d))
    blobs = case_versions(spark, d).select("case_id", F.explode("blobs").alias("blob"))
    blobs = blobs.withColumn("content", F.concat("case_id", F.lit("/"), "blob").cast("binary"))
    return V.with_blobs(last, blobs).select("case_id", "version", "blob", F.col("content").cast("string").alias("content"))


@query
def dollar_amounts(spark, d):
    x = F.when(F.col("o_orderkey") % 2 == 0, F.floor("o_totalprice") * 10000).otherwise(F.floor("o_totalprice")).cast("double")
    return t(spark, d, "orders").select("o_orderkey", D.dollars(x).alias("amount"))


@query
def xml_text(spark, d):
    return t(spark, d, "pages").select("page_id", T.xml_text(F.col("html")).alias("text"))


@query
def office_paragraphs(spark, d):
    xml = F.concat(F.lit("<w:p><w:t>"), F.col("doc_id").cast("string"), F.lit('</w:t><w:t xml:space="preserve"> x</w:t></w:p><w:p></w:p><w:p><w:t>'), T.escape_html(F.col("text")), F.lit("</w:t></w:p>"))
    return t(spark, d, "documents").select("doc_id", T.paragraphs(xml).alias("text"))


# --- sizing -----------------------------------------------------------------------------------


def loads(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    share = lambda m, p: ((k * m) % p / 100).cast("double")
    return t(spark, d, "supplier").select(
        "s_suppkey", (k % 5 + 1).cast("double").alias("shards"), F.element_at(F.array(*[F.lit(float(x)) for x in (2, 4, 8, 16, 32)]), F.col("s_nationkey") % 5 + 1).alias("ho_vcpu"),
        F.lit(8.0).alias("dr_vcpu"), share(7, 50).alias("primary_avg"), share(11, 100).alias("primary_peak"), share(3, 40).alias("ho_sec_avg"), share(13, 90).alias("ho_sec_peak"),
        share(1, 30).alias("dr_avg"), share(5, 60).alias("dr_peak"), (k * 100).cast("double").alias("storage_gb"),
    )


@query
def consumed_load(spark, d):
    c = Z.consumed(loads(spark, d))
    return c.select("s_suppkey", *[r6(F.col(x)).alias(x) for x in ("work_avg", "work_peak", "work_ratio", "full_avg", "full_peak", "full_ratio")])


@query
def sizing_scenarios(spark, d):
    c = Z.scenarios(Z.consumed(loads(spark, d)))
    return c.select("s_suppkey", "posture", "base", "ceiling_2x", "ceiling_3x", "monthly_compute", "monthly_storage", "total_monthly", "total_annual")


@query
def restore_time(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", Z.restore_hours((F.col("s_suppkey") * 3 / 10).cast("double")).alias("hours"))


# --- costs ------------------------------------------------------------------------------------


def costs(spark, d) -> DataFrame:
    """Cost tables by year of shipment: sums of whole quantities, so that they are exact in any order."""
    q = F.col("l_quantity")
    flag = lambda f: F.coalesce(F.sum(F.when(F.col("l_returnflag") == f, q)), F.lit(0.0))
    y = t(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("yr")).agg(
        flag("A").alias("license"), flag("N").alias("hardware"), flag("R").alias("storage"), F.sum("l_quantity").alias("total")
    )
    parts = [("license", "baseline", F.col("license")), ("hardware", "baseline", F.col("hardware")), ("storage", "baseline", F.col("storage"))]
    parts += [(n, "proposed" if n != "migration" else "once", F.floor(F.col("total") * x).cast("double"))
              for n, x in (("proposedPrimary", 0.3), ("coldDrAdd", 0.05), ("warmDrAdd", 0.15), ("migration", 0.2))]
    rows = y.select("yr", F.explode(F.array(*[F.struct(F.lit(n).alias("component"), F.lit(s).alias("side"), v.alias("central")) for n, s, v in parts])).alias("x")).select("yr", "x.*")
    return rows.select("yr", "component", "side", (F.col("central") * 0.5).alias("low"), "central", (F.col("central") * 2).alias("high"))


@query
def baseline_total(spark, d):
    return M.baseline_total(costs(spark, d), ["yr"])


@query
def proposed_total(spark, d):
    return M.proposed_total(costs(spark, d), ["yr"])


@query
def cost_levels(spark, d):
    return M.by_level(costs(spark, d), ["yr"])


@query
def annual_saving(spark, d):
    return M.annual_saving(costs(spark, d), ["yr"])


@query
def five_year(spark, d):
    return M.five_years(costs(spark, d), ["yr"])


@query
def payback(spark, d):
    return M.payback(M.five_years(costs(spark, d), ["yr"]), ["yr"])


@query
def crossing(spark, d):
    c = L.crossings(M.five_years(costs(spark, d), ["yr"]), ["yr", "posture"])
    return c.select("yr", "posture", "year", r6(F.col("at")).alias("at"))


@query
def discounted(spark, d):
    return M.discount(costs(spark, d), (F.col("yr") % 4 * 50 - 25).cast("double"))


@query
def cost_bars(spark, d):
    c = costs(spark, d).where("side = 'baseline'")
    order = F.array_position(F.array(*map(F.lit, ("license", "hardware", "storage"))), F.col("component"))
    return M.bars(c.select("yr", order.alias("ord"), F.col("central").alias("value")), ["yr"])


@query
def chart_axes(spark, d):
    b = M.baseline_total(costs(spark, d), ["yr"])
    return b.select("yr", M.axis_thousands(N.thousands(F.col("central"))).alias("max_k"), M.axis_millions(F.col("central") * 5).alias("max_m"))


@query
def range_normalize(spark, d):
    """Ranges of parts: points, ranges, and some that are out of order or no numbers."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    low = F.when(k % 7 == 0, None).when(k % 7 == 1, -size).when(k % 7 == 2, size * 3).when(k % 7 == 3, size * 0.5).otherwise(size)
    high = F.when(k % 7 == 4, size * 1.01).when(k % 7 == 5, size).otherwise(size * 2)
    return M.normalize_ranges(t(spark, d, "part").select(k.alias("component"), low.alias("low"), size.alias("central"), high.alias("high")))


def source_rows(spark, d) -> DataFrame:
    """Sources of costs: an order is one, its customer's the case; some dates are missing or none."""
    k = F.col("o_orderkey")
    day = F.when(k % 11 == 0, None).when(k % 11 == 1, F.lit("2026-02-30")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    quality = F.when(k % 5 < 2, "published").when(k % 5 == 2, "synthesized").otherwise("training-cutoff")
    component = F.element_at(F.array(*map(F.lit, ("license", "hardware", "storage", "labor"))), (k % 4 + 1).cast("int"))
    return t(spark, d, "orders").select(F.col("o_custkey").alias("case"), quality.alias("quality"), day.alias("as_of"), component.alias("component"), "o_orderpriority", k.alias("ord")).withColumnRenamed("o_orderpriority", "label")


@query
def source_confidence(spark, d):
    return M.source_confidence(source_rows(spark, d), ["case"], F.lit("1996-03-01").cast("date"))


@query
def first_source(spark, d):
    components = costs(spark, d).select("component").distinct()
    return M.first_sources(components, source_rows(spark, d))


# --- claims -----------------------------------------------------------------------------------

# id, section, claim, depends on, declared label, declared confidence, derived
CLAIMS = (
    ("c1", "F", "shards", ("cluster.shardCount",), None, None, False), ("c2", "C", "peak", ("util.primary", "node.hoVcpu", "no.such"), None, None, True),
    ("c3", "A", "total", (), "cost model", "high", True), ("c4", "A", "rate", (), "list", "high", False), ("c5", "B", "guess", (), None, None, False),
    ("c6", "F", "unknown", ("no.such",), None, None, True), ("c7", "E", "tier", ("node.atlasTier",), None, None, False), ("c8", "F", "size", ("data.storageSizeGb", "util.dr"), None, None, False),
)
CLAIM = "id string, section string, claim string, depends_on array<string>, declared_label string, declared_conf string, derived boolean"


def claim_rows(spark) -> DataFrame:
    return spark.createDataFrame([(i, s, c, list(on), lab, conf, der) for i, s, c, on, lab, conf, der in CLAIMS], CLAIM)


@query
def claims_confidence(spark, d):
    return K.resolve_claims(claim_rows(spark), covered(spark, d))


@query
def checklist_summary(spark, d):
    return K.checklist(K.resolve_claims(claim_rows(spark), covered(spark, d)))


@query
def claims_merge(spark, d):
    own = t(spark, d, "nation").select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("A").alias("section"), F.col("n_name").alias("claim"))
    more = t(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.lit("B").alias("section"), F.col("c_name").alias("claim"))
    return K.merge_claims(own, more)


# --- ledgers and logs -------------------------------------------------------------------------


def uses(spark, d) -> DataFrame:
    c = t(spark, d, "conversations")
    tokens = F.length("text").cast("long")
    return c.select("conv_id", "turn", F.when(F.col("role") == "user", tokens).otherwise(0).alias("input_tokens"), F.when(F.col("role") != "user", tokens).otherwise(0).alias("output_tokens"))


def ledgered(spark, d) -> DataFrame:
    return G.ledger(uses(spark, d), ["conv_id"], ["turn"], 3.0, 15.0)


@query
def ledger(spark, d):
    return ledgered(spark, d).withColumns({"cost": r6(F.col("cost")), "total_cost": r6(F.col("total_cost"))})


@query
def ledger_in_batches(spark, d):
    """The same ledger from three batches, each on the totals of those before."""
    u, key, rows, before = uses(spark, d), ["conv_id"], None, None
    for low, high in ((0, 2), (2, 4), (4, 1 << 31)):
        batch = u.where((F.col("turn") >= low) & (F.col("turn") < high))
        new = G.ledger_on(before, batch, key, ["turn"], 3.0, 15.0) if before is not None else G.ledger(batch, key, ["turn"], 3.0, 15.0)
        rows = new if rows is None else rows.unionByName(new)
        before = G.totals(batch, key) if before is None else G.merge_totals(before, G.totals(batch, key), key)
    return rows.withColumns({"cost": r6(F.col("cost")), "total_cost": r6(F.col("total_cost"))})


@query
def bindings_in_batches(spark, d):
    """The same bindings from three batches of candidates, each merged into the best so far."""
    found, methods, k = event_candidates(spark, d), method_table(spark), F.col("locator").cast("long") % 3
    best = B.merge_bindings(found.where(k == 0), methods)
    for i in (1, 2):
        best = B.merge_more(best, found.where(k == i), methods)
    return best.select("signal_id", F.col("value.num").alias("num"), "confidence", "method", "source")


@query
def budget_guard(spark, d):
    return G.guard(ledgered(spark, d), F.lit(1500), F.lit(12.0)).select("conv_id", "turn", "decision")


@query
def error_counts(spark, d):
    return G.category_counts(t(spark, d, "events").where("event_type = 'error'").withColumn("k", F.get_json_object("props", "$.k")), "k")


@query
def log_tail(spark, d):
    return G.log_tail(t(spark, d, "events").select("event_type", "event_id", "user_id"), ["event_type"], ["event_id"], 200)


@query
def version_numbers(spark, d):
    return G.version_ids(t(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query
def qual_topk(spark, d):
    return G.context_items(t(spark, d, "conversations").select("role", "conv_id", "turn", "text"), ["role"], ["conv_id", "turn"], 20, 200)


@query
def declutter(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", F.col("value").alias("y"))
    return L.declutter(e, ["user_id"], "y", "event_id", 12.0).select("user_id", "event_id", r6(F.col("placed")).alias("placed"))


@query
def box_overlaps(spark, d):
    p = t(spark, d, "part")
    boxes = p.select(F.col("p_brand").alias("chart"), F.col("p_partkey").alias("idx"), (F.col("p_partkey") * 37 % 1000).cast("double").alias("x"),
                     (F.col("p_partkey") * 91 % 700).cast("double").alias("y"), F.col("p_size").cast("double").alias("w"), F.lit(14.0).alias("h"))
    return L.overlaps(boxes, ["chart"], 2.0)


# --- text -------------------------------------------------------------------------------------


@query
def html_text(spark, d):
    return t(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query
def html_links(spark, d):
    return t(spark, d, "pages").select("page_id", F.array_join(T.link_targets(F.col("html")), " ").alias("targets"))


@query
def entity_decode(spark, d):
    marked = F.concat("html", F.lit(" &#65;&#x42;&#38;lt; &LT;&copy;&#0;&nbsp;&quot;&amp;gt;"))
    return t(spark, d, "pages").select("page_id", T.decode_entities(marked).alias("text"))


@query
def collapse_ws(spark, d):
    return t(spark, d, "documents").select("doc_id", T.collapse(F.regexp_replace("text", r"\. ", ".  \t\n\n\n ")).alias("text"))


@query
def noise_text(spark, d):
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Thanks, "), "text")).when(F.col("doc_id") % 7 == 0, F.lit("  ")).when(
        F.col("doc_id") % 11 == 0, F.lit("Regards, 3 shard and 4 TB storage")).otherwise(F.col("text"))
    return t(spark, d, "documents").select("doc_id", T.is_noise(text).alias("noise"))


@query
def role_tokens(spark, d):
    words = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ("Primary", "HA  secondary", "Disaster site", "drone", "replica", "node"))), F.col("n_nationkey") % 6 + 1), "n_name")
    return t(spark, d, "nation").select("n_nationkey", T.role_token(words).alias("role"))


def some_docs(spark, d) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", "text")


def addressed_docs(spark, d) -> DataFrame:
    """Documents with addresses in a row, which share the characters between them, and with some that are none."""
    k = F.col("doc_id")
    part = lambda m: (k % m).cast("string")
    tail = F.concat(F.lit(" 10."), part(256), F.lit(".0.1 10.0."), part(300), F.lit(".2,10.0.0."), part(7), F.lit(";1.2.3.4_ 999.1.1.1 a.b.c_x -d"), part(9),
                    F.lit(".e-.f.g h."), part(5), F.lit(".i j.k.l.m x@y.zz,p@q.org "))
    return t(spark, d, "documents").select("doc_id", F.concat("text", tail).alias("text"))


def hits_of(kind):
    def run(spark, d):
        orders = {"emails": [2], "ipv4": [3], "hosts": [4], "names": [5], "surnames": [6]}[kind]
        return P.phrase_hits(addressed_docs(spark, d)).where(F.col("ord").isin(orders)).select("doc_id", "phrase", "type", "confidence").distinct()

    run.__name__ = f"detect_{kind}"
    return query(run)


for _kind in ("emails", "ipv4", "hosts", "names", "surnames"):
    hits_of(_kind)


@query
def detect_in_pieces(spark, d):
    """Hits of documents cut into pieces of 500 characters."""
    hits = P.phrase_hits(P.in_pieces(addressed_docs(spark, d), piece=500))
    return hits.where(F.col("ord") <= 5).select("doc_id", "phrase", "type", "confidence").distinct()


@query
def phrase_candidates(spark, d):
    return P.candidates(P.phrase_hits(some_docs(spark, d)))


@query
def candidate_counts(spark, d):
    found = P.candidates(P.phrase_hits(t(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.concat("s_name", F.lit(" Supplier Key "), F.col("s_suppkey").cast("string"), F.lit(".a.b Key Value")).alias("text"))))
    texts = t(spark, d, "supplier").select(F.concat("s_name", F.lit(" SUPPLIER KEY "), F.col("s_suppkey").cast("string"), F.lit(".a.b key value")).alias("text"))
    return P.rank_candidates(found, texts).select("phrase", "type", "occurrences", "rank")


@query
def replaced_in_turn(spark, d):
    entries = spark.createDataFrame([("Apache License", "the EV_1"), ("the", "EV_2"), ("EV", "W")], "phrase string, slug string")
    return P.replace_in_turn(some_docs(spark, d), entries)


@query
def merge_detected(spark, d):
    n = t(spark, d, "customer").select((F.col("c_custkey") % 3).cast("int").alias("ord"), F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("phrase"),
                                       F.lit("org").alias("type"), F.col("c_nationkey").cast("long").alias("occurrences"), (F.col("c_custkey") % 10 / 10).alias("confidence"))
    return P.merge_detected(n)


PHRASES = ("The", "on the", "license", "Apache License", "a.b", "ion", "zzz")
ENTRIES = (("Apache License", "EV_TERM_01"), ("Apache", "EV_ORG_01"), ("the", "EV_TERM_02"), ("on the", "EV_TERM_03"), ("(c)", "EV_TERM_04"), ("é", "EV_TERM_05"))


def entry_rows(spark) -> DataFrame:
    return spark.createDataFrame(list(ENTRIES), "phrase string, slug string")


@query
def phrase_occurrences(spark, d):
    return P.count_phrases(some_docs(spark, d), spark.createDataFrame([(p,) for p in PHRASES], "phrase string"))


@query
def slug_alloc(spark, d):
    existing = spark.createDataFrame([("FRANCE", "EV_ORG_07"), ("x", "EV_ORG_03"), ("Peru", "EV_TERM_99")], "phrase string, slug string")
    new = t(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.initcap("n_name").alias("phrase"), F.element_at(F.array(F.lit("org"), F.lit("term"), F.lit("per-son")), F.col("n_regionkey") % 3 + 1).alias("type"))
    return P.allocate_slugs(existing, new)


@query
def values_read_outside(spark, d):
    k = F.col("event_id")
    signal = F.element_at(F.array(*map(F.lit, ("util.primary", "node.hoVcpu", "mongo.edition", "unknown"))), (k % 4 + 1).cast("int"))
    raw = t(spark, d, "events").select(
        signal.alias("signal_id"), (F.col("value") - 20).alias("num"), (F.col("value") / 100).alias("avg"), (k % 110 / 100).alias("peak"),
        F.when(k % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "event_type")).alias("str"), F.when(k % 5 != 0, k % 130 / 100 - 0.1).alias("confidence"),
        F.lit("vision").alias("method"), k.cast("string").alias("source"), F.lit("x").alias("locator"))
    b = B.read_values(raw, signal_table(spark))
    return b.select("source", "signal_id", *[F.col(f"value.{c}").alias(c) for c in ("num", "avg", "peak", "str")], r6(F.col("confidence")).alias("confidence"))


@query
def panel_bindings(spark, d):
    """A picture for each twenty events, a panel for each of them; some cannot be read."""
    k = F.col("event_id")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (k % len(x) + 1).cast("int"))
    peak = k * 37 % 120 / 100
    p = t(spark, d, "events").select(
        F.floor(k / 20).cast("string").alias("source"), k.alias("idx"), pick("Primary CPU", "panel", "HA secondary", "panel", "DR site").alias("label"), pick("util.primary", "util.primary", "util.hoSec", "disk.iops", "node.hoVcpu", "none").alias("signal_id"),
        F.col("value").alias("num"), (peak / 2).alias("avg"), peak.alias("peak"), F.lit(None).cast("string").alias("str"), (k % 100 / 100).alias("confidence"))
    b = B.read_panels(p, signal_table(spark))
    return b.select("source", F.col("locator").cast("long").alias("idx"), "signal_id", r6(F.col("value.num")).alias("num"), r6(F.col("value.peak")).alias("peak"), r6(F.col("confidence")).alias("confidence"), "heuristic")


@query
def researched_claims(spark, d):
    p = t(spark, d, "part")
    found = K.source_claims(p.select(F.col("p_partkey").cast("string").alias("component"), F.col("p_brand").alias("label"), (F.col("p_partkey") % 120 / 100 - 0.1).alias("confidence")))
    return found.select("id", "section", "claim", "declared_label", "declared_conf", "derived")


@query
def unmapped_phrases(spark, d):
    entries = t(spark, d, "customer").where("c_custkey % 3 = 0").select(F.upper("c_mktsegment").alias("phrase")).union(t(spark, d, "nation").where("n_regionkey < 3").select(F.lower("n_name")))
    return P.unmapped(t(spark, d, "nation").select(F.initcap("n_name").alias("phrase")).union(t(spark, d, "part").select("p_brand")), entries)


@query
def phrase_spellings(spark, d):
    n = t(spark, d, "nation")
    entries = n.select(F.col("n_nationkey").alias("ord"), F.concat(F.lower("n_name"), F.lit("  Of  It")).alias("phrase"), F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("slug"))
    return P.variants(entries)


@query
def anonymize(spark, d):
    return P.replace_phrases(some_docs(spark, d), entry_rows(spark))


@query
def anonymize_round_trip(spark, d):
    there = P.replace_phrases(some_docs(spark, d), entry_rows(spark)).drop("n_replaced")
    return P.replace_phrases(there, entry_rows(spark), reverse=True).drop("n_replaced")


@query
def slug_conflict(spark, d):
    slugs = t(spark, d, "nation").select(F.lit("p").alias("phrase"), F.lower(F.left("n_name", F.lit(3))).alias("slug"))
    return P.slug_conflicts(some_docs(spark, d), slugs)


@query
def map_round_trip(spark, d):
    odd = t(spark, d, "nation").select(F.concat("n_name", F.lit("\t\\t\n\\"), "n_name").alias("phrase"), F.concat(F.lit("s\r"), F.col("n_nationkey").cast("string")).alias("slug"))
    return P.parse_lines(P.map_lines(odd))


@query
def map_problems(spark, d):
    """A map of suppliers' names: some are empty, their own slug, share a slug, or stand within others."""
    k = F.col("s_suppkey")
    phrase = F.when(k % 10 == 0, " ").when(k % 10 == 1, F.concat(F.lit("x"), "s_name")).otherwise(F.col("s_name"))
    slug = F.when(k % 10 == 2, F.col("s_name")).when(k % 10 == 3, F.lit("")).otherwise(F.concat(F.lit("EV_"), (k - F.when(k % 10 == 5, 1).otherwise(0)).cast("string")))
    rows = t(spark, d, "supplier").select(phrase.alias("phrase"), slug.alias("slug"))
    within = t(spark, d, "supplier").where("s_suppkey % 10 = 6").select(F.right("s_name", F.lit(6)).alias("phrase"), F.concat(F.lit("IN_"), k.cast("string")).alias("slug"))
    return P.validate_map(rows.unionByName(within))


@query
def redact_key(spark, d):
    text = F.concat("text", F.lit(" sk-abcDEF_12-3 key-"), F.col("doc_id").cast("string"), F.lit(" sk-ab"))
    key = F.concat(F.lit("key-"), F.col("doc_id").cast("string"))
    return t(spark, d, "documents").select("doc_id", T.redact_keys(text, key).alias("text"))


@query
def slugs_and_escapes(spark, d):
    return t(spark, d, "pages").select("page_id", T.slug(F.col("url"), 48, "case").alias("slug"), T.escape_html(F.col("html")).alias("escaped"))


@query
def iso_dates(spark, d):
    o = t(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.lit("2026-02-30")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return o.select("o_orderkey", N.iso_date(text).cast("string").alias("day"))


TEXTS = (
    ("a,b\n1,2\n", "csv", ","), ("a\tb\n1\t2", "tsv", "\t"), ('"x,y",b\n"p","q,r"', "csv", ","), ("a,b\n1,2,3", "text", None), ('{"a": [1]}', "json", None), ("{not json}", "text", None),
    ("<!DOCTYPE html><p>x", "html", None), ("<table><tr>", "html", None), ("<note>x</note>", "xml", None), ("<?xml version='1.0'?><a/>", "xml", None), ("{\\rtf1 x}", "rtf", None),
    ("From: a@b.c\nTo: d@e.f\nSubject: x\n\nbody", "eml", None), ("From: Alice\nTo: Team\n\nhello", "text", None), ("plain words", "text", None), ("", "text", None),
)


def written(spark, d) -> DataFrame:
    """A text of each customer, of one of the kinds of TEXTS, with the customer's number in it."""
    k = F.col("c_custkey")
    text = F.element_at(F.array(*[F.lit(x) for x, _, _ in TEXTS]), (k % len(TEXTS) + 1).cast("int"))
    return t(spark, d, "customer").select("c_custkey", F.replace(text, F.lit("1"), k.cast("string")).alias("text"))


@query
def type_detect(spark, d):
    return written(spark, d).select("c_custkey", R.text_type(F.col("text")).alias("type"))


@query
def delimiter_detect(spark, d):
    return written(spark, d).select("c_custkey", R.delimiter_of(F.col("text")).alias("delimiter"))


@query
def text_types_of_tables(spark, d):
    a = t(spark, d, "pages").select(F.lit("page").alias("k"), F.col("page_id").alias("id"), F.col("html").alias("x"))
    b = t(spark, d, "events").select(F.lit("event").alias("k"), F.col("event_id").alias("id"), F.col("props").alias("x"))
    return a.unionByName(b).select("k", "id", R.text_type(F.col("x")).alias("type"))
