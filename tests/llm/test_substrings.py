import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import textkit
from evidentia.llm.substrings import Chunk, _climb, lengths, pack, substring_dedup, unpack


def brute(rows, window):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1] is None, rows[k][1] or ""))
    seen, out = set(), []
    for k in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", rows[k][1] or "")
        gone, own = set(), []
        for a in range(len(words) - window + 1):
            run = tuple(words[a : a + window])
            if run in seen:
                gone |= set(range(a, a + window))
            seen.add(run)
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((rows[k][0], len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


P = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (3, "x " + P + " y"), (1, P), (2, None), (4, ""), (5, " ".join(f"p{i}" for i in range(19))), (6, "a\tb " * 30),
    (7, P + " " + P), (8, " ".join(f"w{i}" for i in range(20000)) + " " + P), (9, "é" + P), (9, "z " + P), (9, "z " + P),
    (10, " ".join(f"p{i}" for i in range(40, 60)) + " tail"), (11, "  " + P.upper()), (None, P + " own"), (12, "p1 " * 25),
]


@pytest.mark.parametrize(("window", "base", "chunk"), [(20, 5, 1 << 20), (20, 20, 300), (8, 1, 40)])
def test_like_brute_force(spark, window, base, chunk):
    df = spark.createDataFrame([(i, t, "c", 7) for i, t in ROWS], "doc_id long, text string, chunk string, level int")
    got = substring_dedup(df, window=window, base=base, chunk_bytes=chunk).collect()
    assert sorted(map(tuple, got), key=repr) == brute(ROWS, window)


def test_random(spark):
    rng = np.random.default_rng(3)
    parts = [" ".join("abc"[x] for x in rng.integers(0, 3, 40)) for _ in range(6)]
    rows = []
    for i in range(150):
        picks = [parts[p][: int(rng.integers(0, 80))] if rng.random() < 0.6 else " ".join(f"u{x}" for x in rng.integers(0, 500, 30)) for p in rng.integers(0, 6, 3)]
        rows.append((int(rng.integers(0, 120)), " ".join(picks)))
    rows = list({i: (i, t) for i, t in rows}.values())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup(df, window=12, base=3, chunk_bytes=700, with_text=True)
    assert sorted(map(tuple, got.drop("kept_text").collect()), key=repr) == brute(rows, 12)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got.collect())


def test_empty_and_lengths(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert substring_dedup(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0].n_words == 0
    assert lengths(5, 20) == [5, 10, 20]
    with pytest.raises(ValueError):
        lengths(6, 20)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1))
def test_pack(values):
    values = np.array(sorted(values), dtype=np.uint64)
    assert (unpack(pack(values)) == values).all()


def test_words_that_clash_under_every_power_hash(spark):
    """A Thue-Morse word and its complement are equal modulo 2**64 as polynomials of any odd base."""
    bits = [i.bit_count() % 2 for i in range(2048)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    tail = " ".join(f"t{i}" for i in range(19))
    rows = [(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, f"{one} {tail}"), (4, f"{one}\t{tail.replace(' ', chr(10))}")]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 20)
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 20, 4: 20}


def test_equal_hashes_remove_nothing(spark, monkeypatch):
    """With all words hashed alike every window is a candidate, and the digests alone decide."""
    monkeypatch.setattr(textkit.Block, "hashes", lambda self: np.zeros(len(self.starts), dtype=np.uint64))
    for rows in (ROWS[:8], [(i, " ".join(f"{i}w{k % 23}" for k in range(60))) for i in range(5)]):
        column = pa.table({"id": [i for i, _ in rows], "text": [t for _, t in rows]}, schema=pa.schema([("id", pa.int64()), ("text", pa.string())]))
        level = _climb(Chunk(column), [5, 10, 20], {5: {}, 10: {}}, 1)
        words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
        windows = {tuple(w[a : a + 20]) for w in words.values() for a in range(len(w) - 19)}
        assert len(level.values) == len(windows)
