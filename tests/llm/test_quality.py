import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evidentia.llm.simhash import near_dedup
from evidentia.llm.quality import (
    WORD_SPACE, Limits, _both, _lexicon, _sample, classify_quality, expectation_maximisation, fit_linear, insult_features, insult_votes, posterior, quality_votes,
)


def test_held_out_accuracy(spark):
    """Labels of a quarter of the groups of near copies are kept from the model and then foretold."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 6000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    groups = near_dedup(docs).select("doc_id", (F.crc32(F.col("component_id").cast("string").cast("binary")) % 4 == 2).alias("held"))
    labels = spark.createDataFrame(labels.join(groups, "doc_id").toPandas())
    got = classify_quality(docs, labels.where("not held").drop("held")).join(labels.where("held"), "doc_id").toPandas()
    clean = got[(got.quality == 1) & (got.toxic == 0)]
    assert clean.kept.mean() >= 0.97
    assert got[got.quality == 0].kept.mean() <= 0.05
    assert got[got.toxic == 1].kept.mean() <= 0.15


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "plain words of a text " * 20000), (4, "a b c"), (4, "a b c"), (None, "x!! Y!!"), (5, "!!! ### $$$")]
    rows += [(100 + i, f"a calm sentence number {i} with words in a row and some more of them here.") for i in range(40)]
    df = spark.createDataFrame([(i, t, 1, False) for i, t in rows], "doc_id long, text string, quality int, kept boolean")
    labels = spark.createDataFrame([(100, 1, 0), (101, 0, 1), (101, 1, None), (None, 1, 1), (999, None, 0)], "doc_id long, quality int, toxic int")
    small = Limits(plain_texts=30, labelled_texts=10, epochs=5)
    for given in (labels, labels.limit(0), None):
        got = classify_quality(df, given, limits=small).collect()
        assert len(got) == len(rows) and all(0 <= r.quality_score <= 1 and 0 <= r.clean_score <= 1 for r in got)
        assert len({tuple(r) for r in got if r.doc_id == 4}) == 1
    assert classify_quality(df.limit(0), labels, limits=small).count() == 0


def test_expectation_maximisation():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.97])
    votes = np.where(rng.random((20000, 4)) < right, truth[:, None], ~truth[:, None]).astype(np.int8)
    votes[rng.random((20000, 4)) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, accuracy = expectation_maximisation(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.02 and np.abs(accuracy[:, 0] - right).max() < 0.03
    assert ((posterior(votes, prior, accuracy) > 0.5) == truth).mean() > 0.97


def test_fit_linear():
    rows, cols = np.repeat(np.arange(100), 1), np.arange(100) % 2
    w = fit_linear(rows, cols, np.ones(100), (cols == 0).astype(float), 4, 200)
    assert w[0] + w[-1] > 0 > w[1] + w[-1] and w[2] == w[3] == 0


def plain_em(votes, counts, rounds):
    """Expectation-maximisation with loops over patterns and labellers."""
    good = [0.05 if 0 in v else 0.98 for v in votes]
    for _ in range(rounds):
        accuracy = []
        for m in range(len(votes[0])):
            row = []
            for k in (0, 1):
                weight = [(g if k == 0 else 1 - g) * c for g, c in zip(good, counts)]
                says = sum(w for w, v in zip(weight, votes) if v[m] == 1)
                speaks = sum(w for w, v in zip(weight, votes) if v[m] != -1)
                row.append((says + (1.0 if k == 0 else 0.1)) / (speaks + 1.1))
            accuracy.append(row)
        prior = (sum(g * c for g, c in zip(good, counts)) + 1) / (sum(counts) + 2)
        good = []
        for v in votes:
            a, b = prior, 1 - prior
            for m, x in enumerate(v):
                right = [min(max(p, 1e-4), 1 - 1e-4) for p in accuracy[m]]
                if x == 1:
                    a, b = a * right[0], b * right[1]
                elif x == 0:
                    a, b = a * (1 - right[0]), b * (1 - right[1])
            good.append(a / (a + b))
    return prior, accuracy, good


def test_estimates_by_brute_force():
    rng = np.random.default_rng(4)
    votes = rng.choice([-1, 0, 1], size=(60, 4), p=[0.3, 0.2, 0.5]).astype(np.int8)
    votes, counts = np.unique(votes, axis=0), rng.integers(1, 50, 60)
    counts = counts[: len(votes)].astype(float)
    prior, accuracy = expectation_maximisation(votes, counts, 15)
    want = plain_em(votes.tolist(), counts.tolist(), 15)
    assert abs(prior - want[0]) < 1e-9 and np.allclose(accuracy, want[1]) and np.allclose(posterior(votes, prior, accuracy), want[2])


def test_scorer_by_brute_force():
    rng = np.random.default_rng(5)
    pairs = sorted({(int(r), int(c)) for r, c in zip(rng.integers(0, 40, 200), rng.integers(0, 12, 200))})
    rows, cols = map(np.array, zip(*pairs))
    values, target = rng.random(len(pairs)), rng.random(40)
    got = fit_linear(rows, cols, values, target, 12, 20, least_texts=8)
    often = [sum(c == k for _, c in pairs) >= 8 for k in range(12)]
    low = [t < 0.5 for t in target]
    extra = min(10.0, max(1.0, sum(target) / max(sum(1 - target), 1.0)))
    balance = [extra if x else 1.0 for x in low]
    w, pace = [0.0] * 13, [0.0] * 13
    for _ in range(20):
        raw = [w[12]] * 40
        for (r, c), v in zip(pairs, values):
            raw[r] += w[c] * v if often[c] else 0.0
        error = [b / sum(balance) * (1 / (1 + math.exp(-x)) - t) for b, x, t in zip(balance, raw, target)]
        slope = [1e-3 * x for x in w]
        for (r, c), v in zip(pairs, values):
            slope[c] += v * error[r] if often[c] else 0.0
        slope[12] += sum(error)
        pace = [0.9 * p + s for p, s in zip(pace, slope)]
        w = [x - 2.0 * p for x, p in zip(w, pace)]
    want = [0.0 if abs(x) < 1e-3 and k < 12 else x for k, x in enumerate(w)]
    assert np.allclose(got, want)


def test_copies_do_not_thin_the_sample(spark):
    rows = [(i, f"text number {i % 60} of a table that is mostly copies") for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, text string")
    gold = spark.createDataFrame([], "id long, gold_quality int, gold_clean int")
    assert len(_sample(df, gold, Limits(plain_texts=40))) == 40
    assert len(_sample(df, gold, Limits(plain_texts=100))) == 60


INSULT_WORDS = {"clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"}


def plain_votes(text):
    """The six labellers' votes of one text, byte by byte and word by word."""
    data, blanks = text.encode(), b"\t\n\x0b\x0c\r "
    words = [w for w in bytes(32 if b in blanks else b for b in data).split(b" ") if w]
    n, some = len(words), max(len(words), 1)
    upper, lower = sum(65 <= b <= 90 for b in data), sum(97 <= b <= 122 for b in data)
    solid = lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    x = {
        "upper": upper / max(upper + lower, 1), "marks": sum(b in b"#$%&*!@^~|<>=_{}[]\\/+" for b in data) / some,
        "stutter": sum(a == b for a, b in zip(words, words[1:])) / some, "bare": sum(not any(map(solid, w)) for w in words) / some,
        "loops": 1 - len({tuple(words[i : i + 4]) for i in range(n - 3)}) / (n - 3) if n > 3 else 0,
    }
    x["mild"] = 2 * x["upper"] + 2 * x["marks"] + 3 * x["stutter"] + 5 * x["bare"] + 2 * x["loops"]
    limits = {"upper": (0.15, 0.30), "marks": (0.05, 0.15), "stutter": (0.05, 0.10), "bare": (0.005, 0.02), "loops": (0.10, 0.25), "mild": (0.40, 0.80)}
    return [-1 if n < 8 else 0 if x[k] > bad else 1 if x[k] < good else -1 for k, (good, bad) in limits.items()]


def plain_insult(text):
    """The fixed words' vote; longer words also count by their beginnings of 4 to 8 bytes."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
    hits = sum(x.decode(errors="replace") in INSULT_WORDS for w in map(str.encode, words) for x in [w] + [w[:k] for k in range(4, 9) if len(w) > k])
    return 0 if hits >= 2 and hits > 0.004 * len(words) else 1 if hits <= 0.001 * len(words) else -1


def test_labellers_by_brute_force(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    odd = ["", "a", "a a a a a a a a a", "WORDS IN CAPITALS AND A few in small letters to be sure", "! ! ? é é é — – word", "x\ty\nz " * 9, "Idiot, you idiot of an IDIOT " + "word " * 500]
    texts = docs + odd
    quality, insult = [], []
    fixed = np.zeros(WORD_SPACE, dtype=bool)
    fixed[insult_features()] = True
    for _, _, looks, owners, features, words in _both(pa.array(texts, pa.large_string())):
        quality += quality_votes(looks).tolist()
        insult += insult_votes(owners, features, words, [fixed])[:, 0].tolist()
    assert quality == [plain_votes(t) for t in texts]
    # Features are hashes, so another word may share one with an insult: that adds hits, and never takes any.
    both = list(zip(insult, map(plain_insult, texts)))
    assert not any((a == 1 and b != 1) or (b == 0 and a != 0) for a, b in both) and sum(a == b for a, b in both) >= 0.95 * len(texts) and insult[-1] == 0
    assert len({tuple(v) for v in quality}) > 10


def test_lexicon_by_brute_force():
    rng = np.random.default_rng(4)
    owners, features = np.unique(np.stack([rng.integers(0, 400, 9000), rng.integers(0, 300, 9000)]), axis=1)
    bad, chosen = rng.random(400) < 0.2, rng.random(400) < 0.7
    extra = np.array([(k, 1000) for k in range(400) if bad[k] and k % 2] + [(k, 1001) for k in range(400) if k % 2])
    owners, features = np.append(owners, extra[:, 0]), np.append(features, extra[:, 1])
    got = set(np.flatnonzero(_lexicon(owners, features, bad, chosen)).tolist())
    want = set()
    n_bad, n_good = sum(bad & chosen), sum(~bad & chosen)
    for f in set(features.tolist()):
        own = [o for o, x in zip(owners, features) if x == f and chosen[o]]
        b, g = sum(bool(bad[o]) for o in own), sum(not bad[o] for o in own)
        if b >= max(3, 0.03 * n_bad) and b / n_bad > 12 * (g + 0.5) / n_good:
            want.add(f)
    assert got == want and 1000 in got and 1001 not in got
