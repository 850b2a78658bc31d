import hashlib
import re
import string
from collections import defaultdict

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import graph
from evidentia.llm.exact import exact_dedup
from evidentia.llm.graph import components
from evidentia.llm.shared import Scratch, look_up
from evidentia.llm.simhash import covering_masks, near_dedup

SCHEMA = "doc_id long, text string, keep_id string, size int, lang string"
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], SCHEMA)


LONG = " ".join(f"w{i % 977}" for i in range(20000))
ROWS = [
    (1, "Abc d"), (5, "aBC D"), (3, "abc d"), (2, None), (4, ""), (7, "É"), (8, "é"), (9, LONG), (6, LONG),
    (10, "a b"), (11, "a b c"), (12, "a\tb\nc"), (13, "a b c "), (14, "  "), (15, "x y z w"), (15, "x y z w"),
    (None, "abc d"), (None, "none else"), (20, LONG + " tail"),
]


def test_exact(spark):
    got = sorted(map(tuple, exact_dedup(frame(spark, ROWS), salts=3).collect()), key=repr)
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[(t or "").translate(FOLD)].append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            kept = True if keep is None else None if i is None else i == keep
            want.append((i, keep, len(ids), bool(kept), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_exact_empty(spark):
    assert exact_dedup(frame(spark, [])).count() == 0


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    runs = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    votes = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(r.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(runs))


def brute_components(fps, radius=2):
    ids = list(fps)
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near(spark):
    base = [f"t{i * 7 % 301}" for i in range(400)]
    rows = [r for r in ROWS if r[0] is not None]
    for k in range(40):
        words = list(base)
        words[k * 3 % 400] = f"new{k}"
        rows.append((100 + k, " ".join(words)))
    got = near_dedup(frame(spark, rows)).collect()
    fps = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components(fps)
    assert len(got) == len(rows)
    for i, fp, component in got:
        assert fp == f"{fps[i]:016x}" and component == want[i]
    assert len({want[i] for i in range(100, 140)}) < 40


def test_near_null_ids_and_empty(spark):
    got = {tuple(r) for r in near_dedup(frame(spark, [(None, "a b c"), (3, "a b c"), (None, "q r s t u")])).collect()}
    assert {c for i, f, c in got if f == f"{brute_fingerprint('a b c'):016x}"} == {3}
    assert near_dedup(frame(spark, [])).count() == 0


def chain():
    """Three texts whose fingerprints differ by 1, 1 and at last more than 2 bits at the ends, found by trying words."""
    found = {}
    base = [f"t{i * 7 % 301}" for i in range(400)]
    for k in range(4000):
        words = list(base)
        words[k % 400] = f"new{k}"
        found.setdefault(brute_fingerprint(" ".join(words)), " ".join(words))
    fps = list(found)
    for m in fps:
        near = [f for f in fps if 0 < (f ^ m).bit_count() <= 2]
        for a in near:
            for b in near:
                if (a ^ b).bit_count() > 2:
                    return [found[a], found[m], found[b]]
    raise AssertionError("no chain")


def brute_by_fingerprint(rows):
    """component_id of each row: fingerprints are the nodes, a component is named by its least id."""
    fps = [brute_fingerprint(t) for _, t in rows]
    named = brute_components({f: f for f in fps})
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[named[f]] = min(i, least.get(named[f], i))
    return sorted(((i, f"{f:016x}", least.get(named[f])) for (i, _), f in zip(rows, fps)), key=repr)


def test_near_null_id_within_a_chain_and_shared_ids(spark):
    a, m, b = chain()
    for rows in (
        [(1, a), (None, m), (3, b)], [(1, a), (2, m), (3, b)], [(None, a), (None, m), (None, b)], [(1, a), (1, "quite another text of words"), (7, b)],
        [(0, a), (5, b), (5, "quite another text of words"), (7, "quite another text of words"), (None, "alone")],
    ):
        got = sorted(map(tuple, near_dedup(frame(spark, rows)).collect()), key=repr)
        assert got == brute_by_fingerprint(rows)
    assert {r.component_id for r in near_dedup(frame(spark, [(1, a), (None, m), (3, b)])).collect()} == {1}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 63), min_size=0, max_size=4))
def test_masks_cover(bits):
    for radius in (2, 4):
        diff = sum(1 << b for b in set(bits[:radius]))
        assert any(diff & m == 0 for m in covering_masks(radius))


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 200), (None, 3), (300, 100)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(map(tuple, components(df, Scratch(spark)).collect()))
    assert all(got[i] == 0 for i in range(61)) and got[200] == got[300] == got[100] == 100


def test_components_with_hubs(spark):
    """Stars whose hub has most edges, joined by one edge, beside many small components."""
    edges = [(0, i) for i in range(1, 3000)] + [(5000, i) for i in range(4000, 5000)] + [(2999, 4500)] + [(10000 + 2 * i, 10001 + 2 * i) for i in range(200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()))
    assert {got[i] for i in [*range(3000), *range(4000, 5001)]} == {0}
    assert all(got[10001 + 2 * i] == 10000 + 2 * i == got[10000 + 2 * i] for i in range(200)) and len(got) == 4001 + 400


def test_components_that_never_settle_are_told(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROUNDS", 2)
    with pytest.raises(RuntimeError, match="rounds"):
        components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"), Scratch(spark))


def test_look_up_hot_and_other_groups(spark):
    rows = spark.createDataFrame([(i, i % 7 if i % 3 else 99, "v") for i in range(300)] + [(None, 99, "v"), (5, None, "v"), (6, 1000, "v")], "id long, k long, v string")
    groups = rows.where("k != 1000").groupBy("k").count().withColumnRenamed("count", "n")
    want = sorted(map(tuple, rows.join(groups, "k", "left").select("id", "k", "v", "n").collect()), key=repr)
    for total in (10, 60_000, 10**9):  # all groups hot, one hot, none
        got = look_up(rows, groups, ["k"], "n", total, "id")
        assert got.columns == ["id", "k", "v", "n"] and sorted(map(tuple, got.collect()), key=repr) == want


def test_look_up_deals_rows_of_hot_keys_apart(spark, capsys):
    rows = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 7, id) as k")
    groups = rows.groupBy("k").count().withColumnRenamed("count", "n")
    look_up(rows, groups, ["k"], "n", 1000, "id").explain()
    plan = capsys.readouterr().out
    assert "__s" in plan and ("SortMergeJoin [k" in plan or "HashJoin [k" in plan)
    assert all("__s" in line for line in plan.splitlines() if "Join [k" in line and "__k" in line) and any("Join [k" in line and "__s" in line for line in plan.splitlines())
