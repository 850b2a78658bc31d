from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import lattice
from evidentia.llm.lattice import Pieces, Table, join, sample
from evidentia.llm.pieces import MODEL, decode, encode
from evidentia.llm.textkit import mix

PIECES = Pieces.load(MODEL)
TABLE = Table(PIECES)


def segmentations(data):
    """All segmentations of a chunk with their weights, by recursion."""
    if not data:
        return [((), 1.0)]
    found = []
    for k in range(1, min(len(data), PIECES.longest) + 1):
        piece = PIECES.by_bytes.get(data[:k])
        if piece is not None:
            found += [((piece, *rest), PIECES.weights[piece] * w) for rest, w in segmentations(data[k:])]
    return found


@pytest.mark.parametrize("wide", [60, 0])
@pytest.mark.parametrize("word", ["thing", "étré", "and"])
def test_draws_follow_the_weights(word, wide, monkeypatch):
    monkeypatch.setattr(TABLE, "safe", wide)
    n = 20000 if wide else 4000
    seeds = mix(np.arange(n).astype(np.uint64))
    drawn = Counter(tuple(x.tolist()) for x in sample([word.encode()] * n, seeds, TABLE))
    known = segmentations(b" " + word.encode())
    total = sum(w for _, w in known)
    assert set(drawn) <= {s for s, _ in known}
    for s, w in known:
        p = w / total
        assert abs(drawn[s] / n - p) <= 5 * (p * (1 - p) / n) ** 0.5 + 2 / n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_lossless(texts):
    data = [t.encode("utf-8", "ignore") for t in texts]
    found = sample(data, np.arange(len(data)).astype(np.uint64), TABLE)
    assert [join(f, PIECES) for f in found] == data


def test_long_chunks_as_short_ones(monkeypatch):
    data = ["a calm étré ▁ day\n\n  x😀".encode()] * 3
    seeds = np.array([3, 4, 5], dtype=np.uint64)
    a = sample(data, seeds, TABLE)
    monkeypatch.setattr(TABLE, "safe", 0)
    assert all((x == y).all() for x, y in zip(a, sample(data, seeds, TABLE), strict=True))


def marginals(data):
    """The chance that a piece ends at each place of a chunk, in logarithms from both ends."""
    n, ways = len(data), [[] for _ in range(len(data) + 1)]
    for j in range(1, n + 1):
        for i in range(max(0, j - PIECES.longest), j):
            piece = PIECES.by_bytes.get(data[i:j])
            if piece is not None:
                ways[j].append((i, np.log(PIECES.weights[piece])))
    ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = behind[n] = 0.0
    for j in range(1, n + 1):
        ahead[j] = np.logaddexp.reduce([ahead[i] + w for i, w in ways[j]])
    for j in range(n, 0, -1):
        for i, w in ways[j]:
            behind[i] = np.logaddexp(behind[i], behind[j] + w)
    return np.exp(ahead + behind - ahead[n])


@pytest.mark.filterwarnings("error")
@pytest.mark.parametrize("text", ["x" * 400, "theandofing" * 37, "x" * 4000, "theandofing" * 364])
def test_draws_on_long_chunks_follow_the_marginals(text):
    data, drawn = b" " + text.encode(), []
    want = marginals(data)[1:-1]
    for seed in (1, 2):
        ids = sample([text.encode()], np.array([seed], dtype=np.uint64), TABLE)[0]
        assert join(ids, PIECES) == text.encode()
        ends = np.zeros(len(data) + 1)
        ends[np.cumsum([len(PIECES.texts[i]) for i in ids])] = 1
        drawn.append(ends[1:-1])
        for part in np.array_split(np.arange(len(want)), 5):
            spread = np.sqrt((want[part] * (1 - want[part])).sum())
            assert abs(drawn[-1][part].sum() - want[part].sum()) <= 8 * spread + 1
    assert (drawn[0][:200] != drawn[1][:200]).any()


@pytest.mark.filterwarnings("error")
@pytest.mark.parametrize("theta", [0.0, 0.5, 3.0])
def test_other_weights_neither_vanish_nor_overflow(theta):
    pieces = Pieces.load(MODEL, theta)
    table, data = Table(pieces), "theandofing étré 漢字 ".encode() + b"x" * 3000
    found = sample([data], np.array([9], dtype=np.uint64), table)[0]
    table.safe = 7
    assert join(found, pieces) == data and found.tolist() == sample([data], np.array([9], dtype=np.uint64), table)[0].tolist()


def test_texts_of_many_parts(monkeypatch):
    data = [b"", ("a  calm étré day\n\n" * 40).encode(), b"unspaced" * 50, b" ", "漢字".encode() * 90, b"\n", b"the end"]
    seeds = np.arange(7).astype(np.uint64)
    whole = sample(data, seeds, TABLE)
    for size in (1, 64):
        monkeypatch.setattr(lattice, "PART_BYTES", size)
        assert [x.tolist() for x in sample(data, seeds, TABLE)] == [x.tolist() for x in whole]


TEXTS = [(1, "the same text"), (2, "the same text"), (3, None), (4, ""), (5, "▁ \t\n é 漢字 😀  two"), (6, "word " * 20000), (7, "x" * 5000),
         (8, "a"), (8, "a"), (None, "no id"), (9, "  leading"), (10, "<0x41> </s>")]


def test_round_trip_and_repeatability(spark):
    df = spark.createDataFrame([(i, t, [1], 0) for i, t in TEXTS], "doc_id long, text string, pieces array<int>, id int")
    first = encode(df.repartition(1)).orderBy("doc_id", "n_pieces").collect()
    second = encode(df.repartition(7)).orderBy("doc_id", "n_pieces").collect()
    assert first == second and all(r.lossless for r in first)
    back = sorted(map(tuple, decode(encode(df)).collect()), key=repr)
    assert back == sorted(TEXTS, key=repr)
    by_id = {r.doc_id: r for r in first}
    assert by_id[3].pieces is None and by_id[4].pieces == [] and by_id[3].n_pieces == 0
    other = {r.doc_id: r.pieces for r in encode(df, seed=1).collect()}
    assert other[6] != by_id[6].pieces and len(other) == len(by_id)
    assert encode(df.limit(0)).count() == 0
