"""A case from files to documents."""

import pytest
from pyspark.sql import functions as F

from evidentia.config import label_table, method_table, signal_table, tier_table
from evidentia.operators import binding as B
from evidentia.operators import coverage as C
from evidentia.plans import case as X
from evidentia.plans import sizing
from evidentia.sources.files import extract, read_files
from tests.test_goldens import CASE, COSTS, INPUTS, LONG, SERIES

READING = "signal_id string, num double, avg double, peak double, str string, confidence double, method string, source string, locator string, heuristic boolean"


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    """Two cases: one with all it needs, one with a picture's readings and mail."""
    top = tmp_path_factory.mktemp("cases")
    for name in ("one", "two"):
        (top / name).mkdir()
    (top / "one/cpu.csv").write_text(SERIES)
    (top / "one/facts.csv").write_text(LONG)
    (top / "one/note.txt").write_text("Thanks and bye")
    (top / "two/p.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    (top / "two/tell.eml").write_text("From: A <a@b.c>\nTo: d@e.f\nSubject: hello\n\nWe run 4 shards on M80.")
    files = read_files(spark, str(top))
    picture = next(r.name for r in files.select("name").collect() if r.name.endswith("p.png"))
    mail = next(r.name for r in files.select("name").collect() if r.name.endswith(".eml"))
    readings = spark.createDataFrame([
        ("util.primary", None, 0.2, 0.5, None, 0.9, "vision", picture, "panel 1", True), ("util.dr", None, 0.1, 0.2, None, 0.9, "vision", picture, "panel 2", False),
        ("node.hoVcpu", 99.0, None, None, None, 0.9, "vision", picture, "x", False), ("node.atlasTier", None, None, None, "M80", 0.8, "llm-text", mail, "x", False),
        ("cluster.shardCount", 4.0, None, None, None, 0.8, "llm-text", mail, "x", False),
    ], READING)
    case_of = lambda s: F.regexp_extract(s, "/(one|two)/", 1)
    return X.triage(extract(files), signal_table(spark), method_table(spark), tier_table(spark), readings, case_of)


def test_bindings_by_case(found):
    got = {(r.case, r.signal_id): (r.value, r.method) for r in found.bindings.collect()}
    assert got["one", "cluster.shardCount"][0].num == 3 and got["one", "node.hoVcpu"][0].num == 32
    assert (got["one", "util.primary"][0].avg, got["one", "util.primary"][0].peak) == pytest.approx((0.18, 0.45))
    # The picture's own processors go, as the tier that was read tells them.
    assert got["two", "node.hoVcpu"] == (got["two", "node.drVcpu"][0], "table-lookup") and got["two", "node.hoVcpu"][0].num == 32
    assert got["two", "cluster.shardCount"][0].num == 4 and ("two", "data.storageSizeGb") not in got


def test_inventory_and_warnings(found):
    rows = {(r.source.split("/")[-1], r.kind): r for r in found.inventory.collect()}
    assert rows["cpu.csv", "table"].role == "metric-time-series" and "util.primary" in rows["cpu.csv", "table"].signals
    assert rows["note.txt", "text"].ignored and rows["note.txt", "text"].role == "noise"
    assert rows["p.png", "image"].role == "chart" and rows["p.png", "image"].signals == ["node.hoVcpu", "util.dr", "util.primary"]
    assert rows["tell.eml#headers", "keyvalue"].role == "topology"
    assert [(r.case, r.warning[:8]) for r in found.warnings.collect()] == [("two", "1 panel(")]


def test_sufficiency_by_case(spark, found):
    cases = spark.createDataFrame([("one",), ("two",), ("three",)], "case string")
    covered = C.coverage(signal_table(spark), found.bindings, method_table(spark), cases=cases)
    assert covered.count() == 72
    judged = C.verdict_text(C.verdict(covered, keys=("case",)), covered, label_table(spark), ("case",))
    rows = {r.case: r for r in judged.collect()}
    assert rows["one"].tier == "engineering-grade" and rows["one"].headline == "Ready to build on: each of the 7 required values has strong evidence"
    assert rows["two"].tier == "blocked" and "On-disk (compressed) storage size" in rows["two"].headline
    assert rows["three"].headline.startswith("Not ready: 7 of 7 required values are unknown. Ask first for: Shard count")
    assert rows["one"].rationale.endswith("The costs also hang on what nothing shows so far: Logical data size.")
    inputs = B.sizing_inputs(found.bindings, signal_table(spark), ("case",))
    assert [(r.case, r.shards) for r in inputs.collect()] == [("one", 3.0)]
    asked = X.cost_profiles(inputs, found.bindings).first()
    assert (asked.case, asked.data_gb, asked.dr_posture) == ("one", 2000.0, None)


def test_model_claims_and_page(spark):
    parts = [("license", "baseline", 251500.0, 449500.0, 920000.0), ("proposedPrimary", "proposed", 0.0, 80926.0, 0.0), ("coldDrAdd", "proposed", 0.0, 26820.0, 0.0),
             ("warmDrAdd", "proposed", 0.0, 132723.0, 0.0), ("migration", "once", 0.0, 17281.0, 0.0)]
    costs = spark.createDataFrame([(k, *p) for k in (1, 2) for p in parts], "case int, " + COSTS)
    cases = spark.createDataFrame([(1, 0.0, 45800.0), (2, 50.0, 45800.0)], "case int, discount_pct double, data_gb double")
    model = X.cost_model(costs, cases, ["case"])
    rows = {r.case: r for r in model.collect()}
    a, b = rows[1], rows[2]
    assert (a.onprem, a.warm, a.cold, a.list_warm, a.saving_warm_pct, a.net_warm, a.payback_warm, a.transition) == (449500.0, 213649.0, 107746.0, None, 52, 712474.0, 2, 680430.0)
    assert a.warm_cum == [680430.0, 894079.0, 1107728.0, 1321377.0, 1535026.0] and a.cold_hours == 11
    assert (b.onprem, b.warm, b.list_warm) == (449500.0, 106824.5, 213649.0)
    sized = sizing.consumed(spark.createDataFrame([CASE], INPUTS)).withColumn("case", F.lit(1))
    told = {r.id: r.value for r in X.cost_claims(model.where("case = 1"), sized, ["case"]).collect()}
    assert told == {"sz-peak-ecpu": "43.2", "tco-onprem": "$450K/yr", "tco-adb-warm": "$214K/yr", "tco-adb-cold": "$108K/yr", "tco-saving-warm": "52%", "tco-net5-warm": "$712K", "tco-payback": "Year 2"}
    prose = model.withColumns({"company": F.lit("A & <B>"), "prepared": F.lit("2026-06-30"), "status": F.lit("draft"), **{p: F.lit(f"{p} <x>") for p in X.PASSAGES}})
    pages = {r.case: r for r in X.business_case(prose, ["case"]).collect()}
    assert pages[1].filename == "business-case-a-b.html" and "A &amp; &lt;B&gt;" in pages[1].html and "<x>" not in pages[1].html
    charts = X.case_charts(costs, model, ["case"])
    drawn = {r.case: r.html for r in X.business_case(prose, ["case"], charts).collect()}
    assert drawn[1].count("<svg") == 2 and drawn[1].count("<polyline") == 3 and drawn[1].count("<rect") == 5 and pages[1].html.count("<svg") == 0
    assert "Added a year: +$133K, in all $214K" in pages[1].html and "Restored in: ~11 hrs" in pages[1].html and "0 (switchover) / ≤ 1 min (failover)" in pages[1].html
    assert "$450K" in pages[1].html and "discount" not in pages[1].html and "<s>$214K</s> $107K (50% discount)" in pages[2].html


def test_small_checks(spark):
    raw = spark.createDataFrame([(" late ", "a", "timeline"), ("  ", "a", "concern"), ("x", "b", "joke"), (None, "b", "concern")], "text string, source string, category string")
    items = X.context_items(raw)
    assert [tuple(r) for r in items.collect()] == [("late", "a", "timeline")] and X.merge_context(items, items).count() == 2
    assert X.asked_of(signal_table(spark), "manual").count() == 3
    parts = spark.createDataFrame([(0, "image", "a"), (1, "image", "a"), (1, "text", "b")], "idx int, kind string, name string")
    assert [(r.idx, r.kind) for r in X.without_images(parts, spark.createDataFrame([(1,)], "idx int")).orderBy("idx").collect()] == [(0, "image"), (1, "text")]
    placed = X.with_places(spark.createDataFrame([("b", None, "image"), ("a", "2", "image"), ("a", "1", "text")], "name string, part string, kind string")).orderBy("idx").collect()
    assert [(r.idx, r.name, r.part) for r in placed] == [(0, "a", "1"), (1, "a", "2"), (2, "b", None)]
    assert X.archived_sources(spark.createDataFrame([(50 << 20,), ((50 << 20) + 1,)], "length long")).count() == 1
    made = spark.range(1).select(X.new_case_id(F.lit("Ümlaut & Co!"), F.timestamp_millis(F.lit(1700000000000))).alias("i")).first().i
    assert made == "mlaut-co-loyw3v28"
    profiles = [(1.0, 2.0, 0.0, 5.0, None), (0.0, 2.0, 0.0, 5.0, None), (1.0, float("nan"), 0.0, 5.0, None), (1.0, 2.0, -1.0, 5.0, None), (1.0, 2.0, 0.0, None, None), (1.0, 2.0, 0.0, 5.0, "hot")]
    got = X.profile_problems(spark.createDataFrame(profiles, "shards double, ho_vcpu double, dr_vcpu double, data_gb double, dr_posture string")).collect()
    assert [r.problem and r.problem.split()[0] for r in got] == [None, "shards", "ho_vcpu", "dr_vcpu", "data_gb", "dr_posture"]
    sources = [("license", "s", "http://x", "2026-02-28", "published"), ("zzz", "s", "u", "2026-01-01", "published"), ("license", "s", "u", "2026-01-01", "guess"), ("license", " ", "u", "2026-01-01", "published"),
               ("license", "s", None, "2026-01-01", "published"), ("license", "s", None, "2026-01-01", "training-cutoff"), ("license", "s", "u", "2026-02-30", "published")]
    got = X.source_problems(spark.createDataFrame(sources, "component string, source string, url string, as_of string, quality string"), ("license",)).collect()
    assert [r.problem and r.problem.split()[0] for r in got] == [None, "component", "quality", "source", "url", None, "as_of"]


def test_documents_of_cases_that_lack_parts(spark, found):
    """Two cases with files, one of them without a size, and one without anything."""
    from evidentia.config import request_table
    from evidentia.plans import claims as K
    from evidentia.plans import documents as O
    from evidentia.plans.reports import sizing_claims

    keys = ["case"]
    cases = spark.createDataFrame([("one", "A & B"), ("two", "C"), ("three", None)], "case string, company string")
    cases = cases.withColumns({c: F.lit(f"{c} <i>") for c in (*O.HEAD[1:], *O.BRIEF_PASSAGES, *O.REVIEW_PASSAGES)})
    covered = C.coverage(signal_table(spark), found.bindings, method_table(spark), cases=cases.select("case"))
    judged = C.verdict_text(C.verdict(covered, keys=("case",)), covered, label_table(spark), ("case",))
    asked = C.what_to_collect(covered, request_table(spark), ("case",))
    files = found.inventory.select("case", F.col("source").alias("name"), "role", F.array_join("signals", ",").alias("signals"))
    report = O.sufficiency_report(cases, files, covered, judged, asked, keys)
    sized = sizing.consumed(B.sizing_inputs(found.bindings, signal_table(spark), ("case",)))
    scenarios = sizing.scenarios(sized)
    told = sizing_claims(sized, scenarios, ("case",)).withColumns({x: F.lit(None).cast("string") for x in ("declared_label", "declared_conf")})
    documents = O.assemble(cases, sized, scenarios, report, keys, claims=K.resolve_claims(told, covered, ("case",)))
    rows = {r.case: r for r in documents.collect()}
    assert len(rows) == 3 and [len(rows[c].claims) for c in ("one", "two", "three")] == [8, 0, 0]
    assert rows["one"].sizing.basis.shards == 3 and [s.posture for s in rows["one"].sizing.scenarios] == ["conservative", "aggressive"] and rows["two"].sizing is None
    assert all(len(r.sufficiency.coverage) == 24 for r in rows.values()) and rows["three"].sufficiency.inventory == [] and len(rows["three"].sufficiency.collect) == 8
    assert rows["one"].claims[0].section == "C" and {c.confidence for c in rows["one"].claims} <= {"high", "medium", "low"}
    first = rows["three"].sufficiency.collect[0]
    assert (first.severity, first.why) == ("blocking", "Without it there is no size") and first.request.startswith("Shard count") and " or " in first.request
    briefs = {r.case: r for r in O.sizing_brief(documents, keys).collect()}
    reviews = {r.case: r for r in O.technical_review(documents, keys).collect()}
    assert briefs["one"].filename == "sizing-brief-a-b.html" and briefs["three"].filename == "sizing-brief-case.html"
    assert "<td>32</td>" in briefs["one"].html and "A &amp; B" in briefs["one"].html and "<i>" not in briefs["one"].html and "&lt;i&gt;" in briefs["one"].html
    assert "cpu.csv" in reviews["one"].html and reviews["three"].html.count("<td>blocking</td>") == 7 and "<h3>To collect</h3>" in reviews["three"].html


def test_pieces_of_a_long_text(spark):
    from evidentia.operators.phrases import in_pieces, phrase_hits

    words = ["plain", "Jane Okafor", "a@b.org", "10.0.0.1", "x.y.zz", "The Plan", "José Núñez Paz", "\n\n", "Ann  Lee"]
    text = " ".join(words[k * 7 % 9] for k in range(60000))
    rows = [(1, text), (2, "short Jane Okafor"), (3, None), (4, "x" * 5000 + " Jane Okafor"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    pieces = in_pieces(df, piece=1000)
    held = {}
    for r in sorted(pieces.collect()):
        held.setdefault(r.doc_id, []).append(r.text)
    assert {k: v for k, v in rows} == {k: None if v == [None] else "".join(v) for k, v in held.items()} and len(held[1]) > 400
    assert pieces.where("doc_id = 1").select(F.spark_partition_id()).distinct().count() > 1
    want = {tuple(r) for r in phrase_hits(df).collect()}
    assert {tuple(r) for r in phrase_hits(pieces).collect()} == want and len(want) == 10


def test_pieces_end_outside_of_names(spark):
    from evidentia.operators.phrases import in_pieces, phrase_hits

    # A window of ten characters ends between two words of a name; characters beyond the first plane of Unicode are one each.
    rows = [(1, "abc defg Hijk Lmnop Rstu"), (2, "abcdefghij" + "\U0001f600" * 3 + " x Jane Okafor Poe")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    pieces = in_pieces(df, piece=10).collect()
    assert [[r.text for r in sorted(pieces) if r.doc_id == k] for k in (1, 2)] == [[rows[0][1]], [rows[1][1][:14], rows[1][1][14:]]]
    want = {tuple(r) for r in phrase_hits(df).collect()}
    assert {tuple(r) for r in phrase_hits(spark.createDataFrame(pieces)).collect()} == want
