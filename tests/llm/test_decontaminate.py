import hashlib
import re
import string

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm.decontaminate import decontaminate, winnow

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(docs, items, window=10):
    out = []
    known = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        if i is None or not n:
            continue
        for a in range(len(w) - n + 1):
            known.setdefault(tuple(w[a : a + n]), set()).add(str(i))
    for i, t in docs:
        w, hit, which = words(t), set(), set()
        for n in range(1, window + 1):
            for a in range(len(w) - n + 1):
                if found := known.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    which |= found
        joined = ",".join(sorted(which))
        out.append((i, len(w), len(hit), len(which), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


A = " ".join(f"a{i}" for i in range(30))
ITEMS = [
    (1, A), (2, "Short one, é3 here"), (10, " ".join(f"a{i}" for i in range(5, 18))), (3, None), (4, "!!"), (5, "x x x x x x x x x x x x"),
    (None, "never seen at all"), (7, "single"), (7, "a0 a1"), (8, " ".join(f"n{i}" for i in range(9))), (2, "Short one, é3 here"),
]
DOCS = [
    (1, "pre " + A.upper() + " post"), (2, None), (3, ""), (4, "short ONE é3 HERE; short one É3 here"), (5, "x " * 11), (6, "x " * 9),
    (7, " ".join(f"a{i}" for i in range(12, 21))), (8, " ".join(f"a{i}" for i in range(12, 22))), (9, "a b single-c a0:a1"),
    (10, " ".join(f"z{i}" for i in range(20000)) + " " + A + " " + " ".join(f"n{i}" for i in range(9))), (10, "dup"), (10, "dup"),
    (None, "q " + A), (11, A[:60] + " \n" + A), (12, "#$%"),
]


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_like_brute_force(spark, limit):
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in DOCS], "doc_id long, text string, items int, n_words string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate(docs, items, broadcast_bytes=limit).drop("items").collect()
    assert sorted(map(tuple, got), key=repr) == brute(DOCS, ITEMS)


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_random_and_empty(spark, limit):
    rng = np.random.default_rng(5)
    docs = [(i, " ".join("ab"[x] for x in rng.integers(0, 2, rng.integers(0, 60)))) for i in range(60)]
    items = [(i, " ".join("ab"[x] for x in rng.integers(0, 2, rng.integers(0, 16)))) for i in range(12)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontaminate(d, b, broadcast_bytes=limit).drop("items").collect()), key=repr) == brute(docs, items)
    assert decontaminate(d.limit(0), b, broadcast_bytes=limit).count() == 0
    assert not any(r.contaminated for r in decontaminate(d, b.limit(0), broadcast_bytes=limit).collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=20), min_size=1, max_size=4), st.integers(1, 6))
def test_winnow(parts, width):
    hashes = np.array([x for p in parts for x in p], dtype=np.uint64)
    left = np.array([len(p) - i for p in parts for i in range(len(p))])
    want, base = set(), 0
    for p in parts:
        for a in range(max(1, len(p) - width + 1)):
            run = p[a : a + width]
            want.add(base + a + run.index(min(run)))
        base += len(p)
    assert winnow(hashes, left, width).tolist() == sorted(want)
