"""Phrases of any number against plain Python."""

import random
import time

import pyarrow as pa
import pytest

from evidentia.functions.text import EMAIL
from evidentia.operators import matching as M
from evidentia.operators.numbering import numbered
from evidentia.operators.phrases import allocate_slugs

random.seed(11)
LETTERS = "abé "


def plain_count(texts, phrases, lower=True):
    fold = str.lower if lower else str
    return {p: sum(fold(t or "").count(fold(p)) for t in texts) if p else 0 for p in phrases}


def plain_replace(t, table):
    out, i, n = [], 0, 0
    longest = max(map(len, table), default=0)
    while i < len(t):
        for k in range(min(longest, len(t) - i), 0, -1):
            if t[i : i + k] in table:
                out.append(table[t[i : i + k]])
                i, n = i + k, n + 1
                break
        else:
            out.append(t[i])
            i += 1
    return "".join(out), n


def plain_turn(t, table):
    for p in sorted(table, key=lambda p: (-len(p), p)):
        t = t.replace(p, table[p])
    return t


TEXTS = [None, "", "é", "aaaaaaa", *("".join(random.choice(LETTERS) for _ in range(random.randint(1, 60))) for _ in range(60)), "x" * 3000 + "ab é" * 700]
PHRASES = sorted({"".join(random.choice(LETTERS) for _ in range(random.randint(1, 9))) for _ in range(150)})


@pytest.mark.parametrize("block,filter_bytes", [(1 << 20, 1 << 25), (64, 64)])
def test_counts(spark, monkeypatch, block, filter_bytes):
    monkeypatch.setattr(M, "BLOCK", block)
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    phrases = spark.createDataFrame([(p,) for p in [*PHRASES, "", "É", None]], "phrase string")
    for lower in (True, False):
        got = dict(map(tuple, M.count_phrases(texts, phrases, either_case=lower, filter_bytes=filter_bytes).collect()))
        assert got == plain_count(TEXTS, [*PHRASES, "", "É"], lower)


@pytest.mark.parametrize("filter_bytes", [1 << 25, 64])
def test_replacing(spark, filter_bytes):
    texts = spark.createDataFrame([(k, t, [k]) for k, t in enumerate(TEXTS)], "id int, text string, phrase array<int>")
    table = {p: f"<{k}>" for k, p in enumerate(PHRASES)}
    entries = spark.createDataFrame([*table.items(), ("", "never"), (None, "never")], "phrase string, slug string")
    got = {r.id: r for r in M.replace_phrases(texts, entries, filter_bytes=filter_bytes).collect()}
    assert len(got) == len(TEXTS)
    for k, t in enumerate(TEXTS):
        assert (got[k].text, got[k].n_replaced) == ((None, None) if t is None else plain_replace(t, table)) and got[k].phrase == [k]
    back = {r.id: r.text for r in M.replace_phrases(M.replace_phrases(texts, entries).drop("n_replaced"), entries, reverse=True).collect()}
    assert back == dict(enumerate(TEXTS))


@pytest.mark.parametrize("seed", range(3))
def test_replacing_in_turn(spark, seed):
    rnd = random.Random(seed)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5))) for _ in range(25)})
    table = {w: "".join(rnd.choice("abcX") for _ in range(rnd.randint(0, 4))) for w in words}
    own = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 30))) for _ in range(40)] + [None]
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(own)], "id int, text string")
    entries = spark.createDataFrame([*table.items(), ("", "y")], "phrase string, slug string")
    got = {r.id: r.text for r in M.replace_in_turn(texts, entries).collect()}
    assert got == {k: t if t is None else plain_turn(t, table) for k, t in enumerate(own)}


def test_a_map_of_100000_entries(spark, capsys):
    n = 100_000
    entries = spark.range(n).selectExpr("concat('Customer#', lpad(id, 9, '0')) as phrase", "concat('EV_ORG_', id) as slug")
    texts = spark.range(2000).selectExpr("id", "concat('by Customer#', lpad(id * 50, 9, '0'), ', not Customer#', lpad(id + 100000, 9, '0'), repeat(' words between', 20)) as text")
    done = M.replace_phrases(texts, entries)
    done.explain(True)
    assert "Customer#00" not in capsys.readouterr().out
    rows = done.collect()
    assert all(r.text.startswith(f"by EV_ORG_{r.id * 50}, not Customer#{r.id + n:09d} words") and r.n_replaced == 1 for r in rows)
    back = M.replace_phrases(done.drop("n_replaced"), entries, reverse=True).collect()
    assert {r.id: r.text for r in back} == {r.id: r.text for r in texts.collect()}
    counts = M.count_phrases(texts, entries.select("phrase")).where("occurrences > 0")
    assert counts.count() == 2000


def test_filters_grow_with_phrases_up_to_their_bound(spark):
    phrases = spark.range(5000).selectExpr("concat('p', id) as phrase")
    one, = M.filters(phrases)
    assert one.bits >= 5000 * 2 * M.BITS_PER_ENTRY > one.bits // 2
    several = M.filters(phrases, 1 << 10)
    assert len(several) > 1 and all(f.bits <= 8 << 10 for f in several)
    batch = pa.array([f"p{k}" for k in range(5000)] + ["q q"])
    for known in ([one], several):
        assert {w for *_, w in M.windows(batch, known)} >= set(batch.to_pylist()[:-1])


def test_numbers(spark):
    rows = [("a" if k % 3 else None, k % 50, k) for k in range(1000)] + [("b", 1, -1)]
    df = spark.createDataFrame(rows, "kind string, ord int, x int")
    got = numbered(df, ["kind"], ["ord", "x"], ranges=7).collect()
    for kind in ("a", "b", None):
        own = sorted((r.ord, r.x) for r in got if r.kind == kind)
        assert [(r.ord, r.x) for r in sorted((r for r in got if r.kind == kind), key=lambda r: r.n)] == own
        assert sorted(r.n for r in got if r.kind == kind) == list(range(1, len(own) + 1))
    assert numbered(df.limit(0), ["kind"], ["ord"]).count() == 0
    assert sorted(r.n for r in numbered(df, [], ["ord"], ranges=5).collect()) == list(range(1, 1002))


def test_slugs_of_one_large_type(spark):
    new = spark.range(20_000).selectExpr("id as ord", "concat('p', id) as phrase", "'org' as type")
    known = spark.createDataFrame([("x", "EV_ORG_07")], "phrase string, slug string")
    got = allocate_slugs(known, new).collect()
    assert {r.phrase: r.slug for r in got} == {f"p{k}": f"EV_ORG_{k + 8:02d}" for k in range(20_000)}


def test_addresses_in_unbroken_text(spark):
    text = "QUJD" * 250_000 + " a@b.org x@y.com-z@w.org " + "a.b-" * 100_000 + "@"
    df = spark.createDataFrame([(text,)], "text string")
    df.selectExpr("length(text)").collect()
    began = time.perf_counter()
    found = df.selectExpr(f"regexp_extract_all(text, r'{EMAIL}', 0) as found").first().found
    assert found == ["a@b.org", "x@y.com", "-z@w.org"] and time.perf_counter() - began < 5


def test_numbers_of_equal_rows_are_dealt_to_many_ranges(spark):
    df = spark.range(20_000).selectExpr("'k' as kind", "0 as ord")
    got = numbered(df, ["kind"], ["ord"], ranges=8)
    assert sorted(r.n for r in got.collect()) == list(range(1, 20_001)) and got.columns == ["kind", "ord", "n"]
    from evidentia.scratch import Scratch

    seen = []
    keep = Scratch.keep
    try:
        Scratch.keep = lambda self, d, name: seen.append(keep(self, d, name)) or seen[-1]
        numbered(df, ["kind"], ["ord"], ranges=8).count()
    finally:
        Scratch.keep = keep
    sizes = [r["count"] for r in seen[0].groupBy("__range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_replacing_in_turn_by_tasks_and_by_joins(spark, monkeypatch, few):
    monkeypatch.setattr(M, "FEW_ENTRIES", few, raising=False)
    monkeypatch.setattr(M, "BLOCK", 64)
    table = {"Apache": "the EV_1", "the": "EV_2", "EV": "W", "W_2": "é", "é b": "", "aa": "b"}
    own = [None, "", "Apache the EV", "theEV_2 b", "aaa aa", "W_2 b", "none", *TEXTS]
    texts = spark.createDataFrame([(k, t, [k]) for k, t in enumerate(own)], "id int, text string, more array<int>")
    done = M.replace_in_turn(texts, spark.createDataFrame(list(table.items()), "phrase string, slug string"))
    assert {r.id: (r.text, r.more) for r in done.collect()} == {k: (t if t is None else plain_turn(t, table), [k]) for k, t in enumerate(own)}
    if few:  # a small map needs no text shuffled
        assert "Exchange" not in done._jdf.queryExecution().toString()


def test_slices_of_a_batch(monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 10)
    texts = ["abcd", None, "efgh", "é" * 20, "", "ab", "cdefghij", "k"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["id", "text"])
    found = [s.column(1).to_pylist() for s in M._slices(batch, 1)]
    assert sum(found, []) == texts and found == [["abcd", None, "efgh"], ["é" * 20], ["", "ab", "cdefghij"], ["k"]]
    assert not list(M._slices(batch.slice(0, 0), 1)) and [s.num_rows for s in M._slices(batch.slice(2, 2), 1)] == [1, 1]
