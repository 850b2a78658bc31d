import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm.catalog import _misspelt
from evidentia.llm.spelling import neighbours, near_words, spelling_variants, variant_groups, word_counts, word_hashes

FOLD = {c: c + 32 for c in range(65, 91)}


def brute_neighbours(w, letters):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
    return (out | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}) - {w}


def brute_groups(counts, ratio=5):
    out = {}
    letters = sorted({c for w in counts for c in w})
    for w, n in counts.items():
        near = [x for x in brute_neighbours(w, letters) if x in counts]
        form = min(near, key=lambda x: (-counts[x], x.encode()), default=None)
        form = form if form is not None and counts[form] >= ratio * n else None
        out[w] = [w, form, None, n, len(near), counts[form] if form is not None else None]
    for w in out:
        root = w
        while out[root][1] is not None:
            root = out[root][1]
        out[w][2] = root
    return sorted(map(tuple, out.values()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé\U0001F600", min_size=0, max_size=6), min_size=1, max_size=5, unique=True))
def test_whole_neighbourhoods_once(words):
    letters = np.array(sorted(map(ord, "abé\U0001F600")), dtype=np.uint64)
    got = list(neighbours(words, letters, lambda h: np.ones(h.shape, dtype=bool)))
    assert len(got) == len(set(got))
    for w in words:
        mine = {x for o, x in got if o == w}
        assert mine == brute_neighbours(w, "abé\U0001F600")
        every = sorted(mine)
        hashes = set(word_hashes(every).tolist())
        seen = set()
        list(neighbours([w], letters, lambda h: (seen.update(h.ravel().tolist()), np.zeros(h.shape, dtype=bool))[1]))
        assert hashes <= seen


WORDS = {
    "receive": 900, "recieve": 3, "receve": 100, "recceive": 180, "receives": 20, "deceive": 900, "recxive": 5, "recxxive": 1, "straße": 50, "strasse": 9, "straßen": 250, "strabe": 5,
    "aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 625, "lonely": 7, "tiebreak": 5, "tiebreal": 25, "tiebreaj": 25, "ab\U0001F600cde": 6, "ab\U0001F601cde": 60,
}


@pytest.mark.parametrize("sketch", [1 << 25, 16])
def test_groups_by_brute_force(spark, sketch):
    words = spark.createDataFrame(list(WORDS.items()), "word string, n long")
    got = sorted(map(tuple, variant_groups(words, sketch_bytes=sketch).collect()))
    assert got == brute_groups(WORDS)
    assert dict((g[0], g[2]) for g in got)["aaaaaa"] == "aaaaaaaaa"


def test_documents_by_brute_force(spark):
    texts = [f"Letters {'Wanderung ' * 7}wanderung WANDERUNG Éclairs éclairs wanderang" for _ in range(4)] + [None, "", "12 _ ---", "ab " * 9, "Wanderungs×weg ÿÿÿÿÿÿ " * 3000]
    rows = [(k if k != 3 else None, t) for k, t in enumerate(texts)] + [(5000 + k, "Beispiel Beispiele Beispeil wanderung") for k in range(400)]
    rows.append(rows[-1])
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, word string, n int, near string")
    assert dict(map(tuple, word_counts(docs, respell=_misspelt).collect())) == counts
    assert sorted(map(tuple, spelling_variants(docs, respell=_misspelt).collect())) == brute_groups(counts)


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    assert spelling_variants(docs).count() == 0 and spelling_variants(docs.limit(0)).count() == 0
    words = spark.createDataFrame([("abcdef", 5), ("abcdeg", 5)], "word string, n long")
    assert sorted(map(tuple, near_words(words, list("abcdefg")).select("word", "n", "near", "near_n").collect())) == [("abcdef", 5, "abcdeg", 5), ("abcdeg", 5, "abcdef", 5)]
