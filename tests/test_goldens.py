"""Known figures: sizing, costs, statistics, confidence."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.config import method_table, signal_table
from evidentia.functions import numbers as N
from evidentia.functions import text as T
from evidentia.operators import binding as B
from evidentia.operators import coverage as C
from evidentia.operators import phrases as P
from evidentia.operators import series as S
from evidentia.plans import archive, claims, costs, render, sizing

INPUTS = "shards double, ho_vcpu double, dr_vcpu double, primary_avg double, primary_peak double, ho_sec_avg double, ho_sec_peak double, dr_avg double, dr_peak double, storage_gb double"
CASE = (3.0, 32.0, 32.0 / 2, 0.18, 0.45, 0.12, 0.35, 0.08, 0.2, 45800.0)
COSTS = "component string, side string, low double, central double, high double"


def test_sizing(spark):
    c = sizing.consumed(spark.createDataFrame([CASE], INPUTS))
    r = c.first()
    assert (r.work_avg, r.work_peak, r.work_ratio) == pytest.approx((17.28, 43.2, 2.5))
    assert (r.full_avg, r.full_peak) == pytest.approx((32.64, 86.4))
    rows = {x.posture: x for x in sizing.scenarios(c).collect()}
    a, b = rows["conservative"], rows["aggressive"]
    assert (a.base, a.ceiling_2x, a.ceiling_3x) == (22, 44, 66) and (b.base, b.ceiling_2x, b.ceiling_3x) == (18, 36, 54)
    assert (a.monthly_compute, b.monthly_compute, a.monthly_storage) == (1296, 1060, 5294)
    assert (a.total_annual, b.total_annual) == (79080, 76248)


def test_restore_hours(spark):
    df = spark.createDataFrame([(45.8,), (0.0,), (5.0,), (10.0,)], "tb double")
    assert [r[0] for r in df.select(sizing.restore_hours(F.col("tb"))).collect()] == [11, 1, 2, 3]
    for bad in (-1.0, float("nan"), None):
        with pytest.raises(Exception, match="0 or more"):
            spark.createDataFrame([(bad,)], "tb double").select(sizing.restore_hours(F.col("tb"))).collect()


def test_costs(spark):
    parts = [("license", "baseline", 251500.0, 449500.0, 920000.0), ("proposedPrimary", "proposed", 0.0, 80926.0, 0.0), ("coldDrAdd", "proposed", 0.0, 26820.0, 0.0),
             ("warmDrAdd", "proposed", 0.0, 132723.0, 0.0), ("migration", "once", 0.0, 17281.0, 0.0)]
    df = spark.createDataFrame(parts, COSTS)
    assert {r.posture: r.central for r in costs.proposed_total(df, []).collect()} == {"none": 80926.0, "cold": 107746.0, "warm": 213649.0}
    saving = {r.posture: (r.saving, r.saving_pct) for r in costs.annual_saving(df, []).collect()}
    assert saving["warm"] == (235851.0, 52) and saving["cold"] == (341754.0, 76)
    five = costs.five_years(df, [])
    warm = [r.cum_a for r in five.where("posture = 'warm'").orderBy("year").collect()]
    assert warm == [680430.0, 894079.0, 1107728.0, 1321377.0, 1535026.0]
    back = {r.posture: (r.net, r.payback_year) for r in costs.payback(five, []).collect()}
    assert back["warm"] == (712474.0, 2) and back["cold"][1] == 2
    never = costs.payback(costs.five_years(df.withColumn("central", F.when(F.col("component") == "license", 1.0).otherwise(F.col("central"))), []), [])
    assert all(r.payback_year is None for r in never.collect())


@pytest.mark.parametrize(("pct", "factor"), [(25.0, 0.75), (0.0, 1.0), (-5.0, 1.0), (float("nan"), 1.0), (None, 1.0), (250.0, 0.0)])
def test_discount(spark, pct, factor):
    df = spark.createDataFrame([("a", "baseline", 1.0, 2.0, 3.0), ("b", "proposed", 4.0, 8.0, 12.0)], COSTS)
    got = {r.component: r.central for r in costs.discount(df, F.lit(pct).cast("double")).collect()}
    assert got == {"a": 2.0, "b": 8.0 * factor}


def test_stale_sources(spark):
    rows = [(k, "published", str(datetime.date(2026, 6, 30) - datetime.timedelta(days=n))) for k, n in enumerate((180, 181))]
    got = costs.source_confidence(spark.createDataFrame(rows, "case int, quality string, as_of string"), ["case"], F.lit("2026-06-30").cast("date"))
    assert {r.case: r.confidence for r in got.collect()} == {0: 0.75, 1: 0.6}


def test_numbers(spark):
    values = ["45%", "1,200", "32 vCPU", "", "x", "-3.5e2z", ".5", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(N.parse_number(F.col("v"))).collect()] == [45.0, 1200.0, 32.0, None, None, -350.0, 0.5, None]
    cases = [("cpu", 1.49, False), ("cpu", 1.51, True), ("cpu %", 1.2, True), ("CPU percent", 0.3, False), ("cpu", None, False)]
    df = spark.createDataFrame(cases, "h string, x double, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", N.is_percent(F.col("h"), F.col("x"))).collect())
    half = spark.createDataFrame([(2.5, 3), (-2.5, -2), (1.4999, 1)], "x double, want int").withColumn("got", N.half_up(F.col("x")))
    assert all(r.want == r.got for r in half.collect())


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_nearest_rank(spark, xs):
    got = S.series_stats(spark.createDataFrame([(1, float(x)) for x in xs], "k int, x double"), ["k"], "x").first()
    ranked = sorted(xs)
    assert got.p95 == ranked[-(-95 * len(xs) // 100) - 1] and got.n == len(xs) and got.peak == ranked[-1] and got.least == ranked[0]


def test_ranks_of_odd_series(spark):
    rows = [(None, 3.0), (None, 1.0), (1, 5.0), (1, 5.0), (2, None), (3, float("inf")), (3, 2.0), (3, 1.0), (4, -1e300), (4, 1e300), (4, 0.0)]
    got = {r.k: r.p95 for r in S.series_stats(spark.createDataFrame(rows, "k int, x double"), ["k"], "x").collect()}
    assert got == {None: 3.0, 1: 5.0, 2: 0.0, 3: float("inf"), 4: 1e300}


def test_no_samples(spark):
    got = S.series_stats(spark.createDataFrame([(1, -1.0), (1, None)], "k int, x double"), ["k"], "x", keep_negative=False).first()
    assert tuple(got) == (1, 0.0, 0.0, 0.0, 0.0, 0)


SERIES = "timestamp,System CPU,Secondary CPU,DR CPU\n" + "".join(f"2026-05-{d:02d}T00:00Z,{a},{b},{c}\n" for d, a, b, c in ((1, 5, 1, 3), (2, 4, 0, 1), (3, 45, 35, 20), (4, -7, 2, 3)))
LONG = "metric,value\nNumber of shards,3\ncores per node,32 vCPU\nDR region cores,16\nStorage size GB,\"2,000\"\nAtlas tier,M80\n"
WIDE = "Instance size,Logical data size,Price USD\nM40,3100,$5\n"


def cells(spark, name, text):
    from evidentia.sources.files import parse_delimited

    head, *body = parse_delimited(text, ",")
    rows = [(name, r, c, head[c], row[c] if c < len(row) else "") for r, row in enumerate(body) for c in range(len(head))]
    return spark.createDataFrame(rows, "source string, row_idx int, col_idx int, header string, cell string")


def test_bindings_of_tables(spark):
    signals, methods = signal_table(spark), method_table(spark)
    c = cells(spark, "s", SERIES).unionByName(cells(spark, "l", LONG)).unionByName(cells(spark, "w", WIDE))
    roles, facts = S.table_roles(c), S.column_facts(c)
    assert {r.source: r.role for r in roles.collect()} == {"s": "metric-time-series", "l": "data-table", "w": "cost-model"}
    found = B.bind_wide(c, roles, facts, signals).unionByName(B.bind_long(c, roles, signals)).unionByName(B.bind_series(c, roles, signals))
    best = {r.signal_id: r.value for r in B.merge_bindings(found, methods).collect()}
    assert best["cluster.shardCount"].num == 3 and best["node.hoVcpu"].num == 32 and best["node.drVcpu"].num == 16 and best["data.storageSizeGb"].num == 2000
    assert best["node.atlasTier"].str in ("M80", "M40") and best["data.logicalSizeGb"].num == 3100
    assert (best["util.primary"].avg, best["util.primary"].peak) == pytest.approx((0.18, 0.45))
    assert best["util.hoSec"].peak == 0.35 and best["util.dr"].avg == pytest.approx(0.0675)
    ready = B.sizing_inputs(B.merge_bindings(found, methods), signals).collect()
    assert len(ready) == 1 and ready[0].shards == 3
    assert C.verdict(C.coverage(signals, B.merge_bindings(found, methods), methods)).first().tier == "engineering-grade"
    gone = B.merge_bindings(found.where("signal_id != 'node.hoVcpu'"), methods)
    assert B.sizing_inputs(gone, signals).count() == 0
    assert C.verdict(C.coverage(signals, gone, methods)).first().tier == "blocked"


def test_merge_ignores_order(spark):
    methods = method_table(spark)
    rows = [("a", (float(k % 3), None, None, None), 0.5 + k % 2 / 10, m, f"s{k}", "x") for k, m in enumerate(["vision", "llm-text", "keyvalue", "keyvalue", "heuristic", "keyvalue"])]
    schema = f"signal_id string, value {B.VALUE}, confidence double, method string, source string, locator string"
    got = {tuple(B.merge_bindings(spark.createDataFrame(rows[k:] + rows[:k], schema), methods).first()) for k in range(4)}
    assert len(got) == 1 and next(iter(got))[3:5] == ("keyvalue", "s3")


def test_reader_values(spark):
    raw = [("util.primary", None, 0.2, 0.5, None, 2.0), ("util.dr", None, 0.6, 0.5, None, 0.5), ("util.hoSec", None, 0.2, 1.5, None, None), ("node.hoVcpu", -1.0, None, None, None, 0.4),
           ("node.drVcpu", 0.0, None, None, None, None), ("dr.posture", None, None, None, "  ", 0.9), ("mongo.edition", None, None, None, " x ", 0.9), ("zzz", 1.0, None, None, None, 1.0)]
    df = spark.createDataFrame([(*r, "vision", "p", "l") for r in raw], "signal_id string, num double, avg double, peak double, str string, confidence double, method string, source string, locator string")
    got = {r.signal_id: (r.value, r.confidence) for r in B.read_values(df, signal_table(spark)).collect()}
    assert set(got) == {"util.primary", "node.drVcpu", "mongo.edition"}
    assert got["util.primary"][1] == 1.0 and got["node.drVcpu"][1] == 0.6 and got["mongo.edition"][0].str == "x"
    pairs = spark.createDataFrame([("m", "Shards", "3 of them"), ("m", "tier", " M30 "), ("m", "system cpu", "5"), ("m", "node ram", "none")], "source string, key string, value string")
    got = {r.signal_id: r.value for r in B.bind_pairs(pairs, signal_table(spark)).collect()}
    assert got["cluster.shardCount"].num == 3 and got["node.atlasTier"].str == "M30" and len(got) == 2


def test_replacement(spark):
    def run(text, entries, reverse=False):
        e = spark.createDataFrame(entries, "phrase string, slug string")
        r = P.replace_phrases(spark.createDataFrame([(text,)], "text string"), e, reverse=reverse).first()
        return r.text, r.n_replaced

    map_ = [("Northern Mutual Insurance", "EV_ORG_01"), ("Northern", "EV_ORG_02")]
    assert run("Northern Mutual Insurance and Northern", map_) == ("EV_ORG_01 and EV_ORG_02", 2)
    assert run("X", [("X", "EV_A"), ("EV_A", "EV_B")]) == ("EV_A", 1)
    assert run("a\\E.b $1 (", [("\\E.", "s1"), ("$1", "s$2"), ("(", "p")]) == ("as1b s$2 p", 3)
    assert run("none", []) == ("none", 0) and run(None, map_)[0] is None
    there, _ = run("Northern, x Northern Mutual Insurance", map_)
    assert "Northern" not in there and run(there, map_, reverse=True)[0] == "Northern, x Northern Mutual Insurance"


def test_phrases(spark):
    text = "mail Jane Okafor at j.o@firm.example or 10.20.30.40 and db.prod.local. The Plan. José Núñez-Paz met 300.1.1.1"
    hits = P.phrase_hits(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    found = {(r.phrase, r.type) for r in hits}
    assert {("j.o@firm.example", "email"), ("10.20.30.40", "host"), ("db.prod.local", "host"), ("Okafor", "person"), ("José Núñez", "person")} <= found
    assert not any(r.phrase.startswith("The") for r in hits) and ("300.1.1.1", "host") in found  # a host by form, no address
    assert [r.phrase for r in P.company_tokens(spark, "Acme Blue co").collect()] == ["Acme Blue co", "Acme", "Blue"]
    entries = spark.createDataFrame([("okafor", "s")], "phrase string, slug string")
    left = P.unmapped(spark.createDataFrame([("Okafor",), ("Jane",)], "phrase string"), entries).collect()
    assert [r.phrase for r in left] == ["Jane"]


def test_markup(spark):
    html = '<p>A&amp;B<br>x</p><script>var a = "<p>";</script><style>p{}</style><!-- no --><a href="mailto:a@b.c">m</a><a href="/rel">r</a><img src="http://h/x"><a href="http://h/x">&copy; &#8364;&#x41;</a>'
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(T.html_text(F.col("h"))).first()[0] == "A&B\nx\nm r &copy; €A\na@b.c http://h/x"
    xml = "<w:p><w:r><w:t>One</w:t></w:r><w:r><w:t xml:space='preserve"+"'> two</w:t></w:r></w:p><w:p/><w:p><w:t>&lt;3</w:t></w:p>"
    assert spark.createDataFrame([(xml,)], "x string").select(T.paragraphs(F.col("x"))).first()[0] == "One two\n<3"


def test_documents_and_archive(spark, tmp_path):
    signals, methods = signal_table(spark), method_table(spark)
    none = spark.createDataFrame([], f"signal_id string, value {B.VALUE}, confidence double, method string, source string, locator string")
    page = render.coverage_page(C.coverage(signals, none, methods), "A <case>").first().html
    assert page.count("<tr>") == 25 and "A &lt;case&gt;" in page
    resolved = spark.createDataFrame([(1, "c2", "B", "<x>", "s", "low"), (1, "c1", "A", "y", "s", "high")], "case int, id string, section string, claim string, source string, confidence string")
    html = render.checklist_page(resolved, ["case"], "Claims").first().html
    assert html.index(">y<") < html.index("&lt;x&gt;")
    assert claims.checklist(resolved).first().to_check == "c2"
    scen = sizing.scenarios(sizing.consumed(spark.createDataFrame([CASE], INPUTS))).withColumn("case", F.lit(1))
    assert "<td>$79K</td>" in render.scenario_page(scen, ["case"], "Sizing").first().html
    assert '"base":22' in render.as_json(scen.where("posture = 'conservative'"), ["case"]).first().json

    path, blob = str(tmp_path / "a"), spark.createDataFrame([("c-1", "b1", bytearray(b"x"))], "case_id string, blob string, content binary")
    rows = "case_id string, version string, saved_at timestamp, state string, blobs array<string>"
    now = datetime.datetime(2026, 1, 1)
    for v in ("001", "002"):
        archive.save_version(spark.createDataFrame([("c-1", v, now, f"state {v}", ["b1"])], rows), blob, path)
    every = archive.versions(spark, path)
    assert archive.current(every).first().state == "state 002"
    assert archive.current(every, spark.createDataFrame([("c-1", "001")], "case_id string, version string")).first().state == "state 001"
    assert archive.listing(every).first().versions == 2
    kept = archive.stored_blobs(spark, path)
    assert archive.with_blobs(archive.current(every), kept).first().content == b"x"
    with pytest.raises(Exception, match="missing blob"):
        archive.with_blobs(archive.current(every).withColumn("blobs", F.array(F.lit("b9"))), kept).collect()
    with pytest.raises(ValueError):
        archive.save_version(spark.createDataFrame([("../x", "001", now, "", [])], rows), blob, path)


def test_neighbouring_addresses(spark):
    text = "10.0.0.1 10.0.0.2 10.0.0.3,10.0.0.4 1.2.3.4_ 1.2.3.256 a.b.c d.e.f_x"
    hits = P.phrase_hits(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert {r.phrase for r in hits if r.ord == 3} == {f"10.0.0.{k}" for k in range(1, 5)}
    assert "a.b.c" in {r.phrase for r in hits} and "d.e.f" not in {r.phrase for r in hits}


def test_counts_of_phrases(spark):
    texts = spark.createDataFrame([("aaaa Okafor OKAFORs",), ("okafor aa",), (None,)], "text string")
    phrases = spark.createDataFrame([("aa",), ("Okafor",), ("okafor",), ("none",), ("",), (None,)], "phrase string")
    want = {"aa": 3, "Okafor": 3, "okafor": 3, "none": 0, "": 0}
    assert dict(map(tuple, P.count_phrases(texts, phrases).collect())) == want
    assert dict(map(tuple, P.count_phrases(texts, phrases, filter_bytes=8).collect())) == want  # several filters
    found = spark.createDataFrame([("Okafor",), ("aa",), ("gone",), ("Acme",)], "phrase string")
    ranked = P.rank_candidates(found, texts, "Acme").collect()
    assert sorted((r.rank, r.phrase, r.occurrences) for r in ranked) == [(1, "Okafor", 3), (2, "aa", 3), (3, "Acme", 0)]


def test_replacing_in_turn(spark):
    e = spark.createDataFrame([("Northern Mutual", "EV_1"), ("EV", "x"), ("", "y")], "phrase string, slug string")
    got = P.replace_in_turn(spark.createDataFrame([("Northern Mutual EV",), (None,)], "text string"), e).collect()
    assert [r.text for r in got] == ["x_1 x", None]
