"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare
from .textkit import Block, alnum_words, blocks, grams, mix, spaced_words

GOOD, BAD, SILENT = 1, 0, -1


@dataclass(frozen=True)
class Limits:
    """Bounds of the sample on which the scorers are fitted; all other statistics cover all rows."""

    plain_texts: int = 1000
    labelled_texts: int = 3500
    chars_per_text: int = 8000
    epochs: int = 100
    least_score: float = 0.5


# --- what the labellers look at ---------------------------------------------------------------

#: Words that open insult, in lower case. Fixed values.
INSULTS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
MARKS = b"#$%&*!@^~|<>=_{}[]\\/+"
#: Words longer than this many bytes also count by their beginnings.
BEGINNINGS = (4, 5, 6, 7, 8)
WORD_SPACE = 1 << 18
#: Features of the sample that the fit multiplies at once, so that the driver holds no copies of all.
AT_ONCE = 1 << 19
SHAPE_SPACE = 1 << 12

_CLASS = np.full(256, 6, dtype=np.int64)  # other marks
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x80:] = 2, 1, 0, 3
_CLASS[list(b".,;:?'\"-()")] = 4
_CLASS[list(b"!")] = 5
_MARK = np.zeros(256, dtype=bool)
_MARK[list(MARKS)] = True


def _per_text(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many flags are set between the cuts."""
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[cuts])


@dataclass
class Looks:
    """Ratios of each text of a block, and its hashed shapes as (text, feature) of every word."""

    words: np.ndarray
    upper: np.ndarray
    marks: np.ndarray
    stutter: np.ndarray
    bare: np.ndarray
    loops: np.ndarray
    owners: np.ndarray
    shapes: np.ndarray


def look(block: Block) -> Looks:
    data, n = block.data, block.counts()
    some = np.maximum(n, 1)
    kinds = _CLASS[data]
    letters = _per_text(kinds < 2, block.offsets)
    owners, hashes = block.owners(), block.hashes()
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owners[1:] == owners[:-1])
    solid = np.concatenate(([0], np.cumsum(kinds < 4)))
    runs = grams(hashes, 4)
    inside = block.left()[: len(runs)] >= 4
    own = owners[: len(runs)][inside]
    _, first = np.unique(mix(runs[inside] + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    once = np.bincount(own[first], minlength=block.n)
    second = np.minimum(block.starts + 1, block.ends - 1)
    code = ((kinds[block.starts] * 7 + kinds[second]) * 7 + kinds[block.ends - 1]) * 2 + same
    sizes = np.minimum(block.ends - block.starts, 31) // 4
    return Looks(
        words=n,
        upper=_per_text(kinds == 1, block.offsets) / np.maximum(letters, 1),
        marks=_per_text(_MARK[data], block.offsets) / some,
        stutter=_per_text(same, block.bounds) / some,
        bare=_per_text(solid[block.ends] == solid[block.starts], block.bounds) / some,
        loops=1 - once / np.maximum(n - 3, 1) * (n > 3) - (n <= 3),
        owners=owners,
        shapes=(mix((code * 8 + sizes).astype(np.uint64)) % np.uint64(SHAPE_SPACE)).astype(np.int64),
    )


def _band(x: np.ndarray, good: float, bad: float, enough: np.ndarray) -> np.ndarray:
    return np.where(~enough, SILENT, np.where(x > bad, BAD, np.where(x < good, GOOD, SILENT))).astype(np.int8)


def quality_votes(looks: Looks) -> np.ndarray:
    """One column per labeller: shouting, marks, stutter, bare marks, loops, and all of them mildly."""
    enough = looks.words >= 8
    mild = 2 * looks.upper + 2 * looks.marks + 3 * looks.stutter + 5 * looks.bare + 2 * looks.loops
    return np.stack([
        _band(looks.upper, 0.15, 0.30, enough),
        _band(looks.marks, 0.05, 0.15, enough),
        _band(looks.stutter, 0.05, 0.10, enough),
        _band(looks.bare, 0.005, 0.02, enough),
        _band(looks.loops, 0.10, 0.25, enough),
        _band(mild, 0.40, 0.80, enough),
    ], axis=1)


def lexical(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word of a block of alphanumeric words, and of the words' beginnings."""
    owners = block.owners()
    parts = [(owners, mix(block.hashes()))]
    parts += [(owners[long], h) for long, h in block.beginnings(BEGINNINGS)]
    return (np.concatenate([o for o, _ in parts]),
            (np.concatenate([h for _, h in parts]) % np.uint64(WORD_SPACE)).astype(np.int64))


def insult_features() -> np.ndarray:
    column = pa.array([w.encode() for w in INSULTS], pa.large_binary())
    block = next(blocks(column, alnum_words()))
    return (mix(block.hashes()) % np.uint64(WORD_SPACE)).astype(np.int64)


def insult_votes(
    owners: np.ndarray, features: np.ndarray, words: np.ndarray, lexicons: list[np.ndarray], counts: np.ndarray | None = None
) -> np.ndarray:
    """One column per lexicon, a mask of features: a text is bad where it has several of them, densely.

    ``counts``: how often each (text, feature) stands; once if not given.
    """
    votes = []
    for mask in lexicons:
        found = mask[features]
        hits = np.bincount(owners[found], weights=None if counts is None else counts[found], minlength=len(words))
        bad = (hits >= 2) & (hits > 0.004 * words)
        votes.append(np.where(bad, BAD, np.where(hits <= 0.001 * words, GOOD, SILENT)).astype(np.int8))
    return np.stack(votes, axis=1)


def sparse(owners: np.ndarray, features: np.ndarray, words: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value), each pair once; the value grows with the feature's share of the words."""
    own, col, counts = tally(owners, features, space)
    return own, col, _value(counts, words[own])


def tally(owners: np.ndarray, features: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count), each pair once."""
    keys, counts = np.unique(owners.astype(np.int64) * space + features, return_counts=True)
    return keys // space, keys % space, counts


def _value(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.log1p(200.0 * counts / np.maximum(words, 1))


# --- the weak-label model ---------------------------------------------------------------------


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray]:
    """Share of good texts, and how often each labeller says good of good and of bad texts when it speaks.

    ``votes`` has a row per distinct pattern and ``counts`` its number of texts. The first
    guess is that a text is bad if any labeller objects. A labeller that is silent tells nothing.
    """
    good = np.where((votes == BAD).any(axis=1), 0.05, 0.98)
    accuracy = np.full((votes.shape[1], 2), 0.5)
    prior = 0.5
    for _ in range(rounds):
        for k, weight in enumerate((good * counts, (1 - good) * counts)):
            says = (weight[:, None] * (votes == GOOD)).sum(axis=0)
            speaks = (weight[:, None] * (votes != SILENT)).sum(axis=0)
            accuracy[:, k] = (says + (1.0 if k == 0 else 0.1)) / (speaks + 1.1)
        prior = ((good * counts).sum() + 1) / (counts.sum() + 2)
        good = posterior(votes, prior, accuracy)
    return float(prior), accuracy


def posterior(votes: np.ndarray, prior: float, accuracy: np.ndarray) -> np.ndarray:
    a = np.clip(accuracy, 1e-4, 1 - 1e-4)
    gain = np.where(votes == GOOD, np.log(a[:, 0] / a[:, 1]), np.where(votes == BAD, np.log((1 - a[:, 0]) / (1 - a[:, 1])), 0.0))
    return 1 / (1 + np.exp(-np.clip(gain.sum(axis=1) + np.log(prior / (1 - prior)), -50, 50)))


def fit_linear(
    rows: np.ndarray, cols: np.ndarray, values: np.ndarray, target: np.ndarray, space: int, epochs: int,
    rate: float = 2.0, shrink: float = 1e-3, least_texts: int = 5,
) -> np.ndarray:
    """Weights and bias of a logistic regression on soft labels, by gradient descent with momentum over the sample.

    Features of fewer than ``least_texts`` texts are left out, and weights shrink, so that
    no text is learned by heart. Bad texts weigh more where they are rare.
    """
    often = np.bincount(cols, minlength=space)[cols] >= least_texts
    rows, cols, values = rows[often], cols[often], values[often].astype(np.float32)
    del often
    parts = [slice(k, k + AT_ONCE) for k in range(0, len(rows), AT_ONCE)]
    w = np.zeros(space + 1)
    pace = np.zeros_like(w)
    balance = np.where(target < 0.5, min(10.0, max(1.0, target.sum() / max((1 - target).sum(), 1.0))), 1.0)
    balance /= max(balance.sum(), 1.0)
    for _ in range(epochs):
        raw = np.full(len(target), w[-1])
        for p in parts:
            raw += np.bincount(rows[p], weights=w[cols[p]] * values[p], minlength=len(target))
        error = balance * (_squash(raw) - target)
        slope = shrink * w
        slope[-1] += error.sum()
        for p in parts:
            slope[:-1] += np.bincount(cols[p], weights=values[p] * error[rows[p]], minlength=space)
        pace = 0.9 * pace + slope
        w -= rate * pace
    w[:-1][np.abs(w[:-1]) < 1e-3] = 0.0
    return w


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


# --- over a corpus ----------------------------------------------------------------------------


def _both(column: pa.Array) -> Iterator[tuple[int, int, Looks, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, n, looks, owners, features, words) of each block."""
    for plain, words in zip(blocks(column, spaced_words()), blocks(column, alnum_words(), lower=True), strict=True):
        owners, features = lexical(words)
        yield plain.first, plain.n, look(plain), owners, features, words.counts()


def _pattern(votes: np.ndarray) -> np.ndarray:
    """The votes of a text as one number, in base 3."""
    return ((votes + 1).astype(np.int64) * 3 ** np.arange(votes.shape[1])).sum(axis=1)


def _unpattern(numbers: np.ndarray, n: int) -> np.ndarray:
    return (numbers[:, None] // 3 ** np.arange(n) % 3 - 1).astype(np.int8)


@dataclass
class Scorer:
    shape_weights: np.ndarray
    word_weights: np.ndarray

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, how sure it is good, and how sure it is free of insult."""
        out = np.zeros((2, len(column)))
        for first, n, looks, owners, features, words in _both(column):
            for k, (own, col, count, w) in enumerate((
                (looks.owners, looks.shapes, looks.words, self.shape_weights), (owners, features, words, self.word_weights),
            )):
                space = len(w) - 1
                used = w[col] != 0 if k else slice(None)
                own, col, values = sparse(own[used], col[used], count, space)
                out[k, first : first + n] = _squash(np.bincount(own, weights=w[col] * values, minlength=n) + w[-1])
        return out[0], out[1]


def _lexicon(owners: np.ndarray, features: np.ndarray, bad: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Features that several of the chosen bad texts have, 3 % at least, and hardly any other chosen text; each pair is given once."""
    with_bad = np.bincount(features[(chosen & bad)[owners]], minlength=WORD_SPACE)
    with_good = np.bincount(features[(chosen & ~bad)[owners]], minlength=WORD_SPACE)
    n_bad, n_good = max(1, (bad & chosen).sum()), max(1, (~bad & chosen).sum())
    return (with_bad >= max(3, 0.03 * n_bad)) & (with_bad / n_bad > 12 * (with_good + 0.5) / n_good)


def classify_quality(
    docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()
) -> DataFrame:
    """One row per row of ``docs``: id, quality_score, clean_score, kept.

    Six heuristic labellers vote on each whole text's quality or are silent; three lexicons
    (fixed words, and two learned from either half of a labelled sample) vote on insult. A row
    of ``labels`` (id, quality 0/1, toxic 0/1), where there is one, is one labeller more of each.
    Expectation-maximisation over the vote patterns of all texts estimates every labeller's
    accuracy on good and on bad texts. The posterior labels of a sample bounded by
    ``limits`` train two hashed linear scorers, on word shapes and on words and their
    beginnings, and these score every text. ``kept``: both scores reach ``limits.least_score``.

    The driver gets the sample and the counts of at most 3**7 and 3**4 patterns. A null text
    is empty; texts without words get the scorers' bias alone. Without labels, the fixed
    words are the only lexicon that speaks. A score of just the least keeps. Ids are whole numbers, the first column of ``labels`` is the id; null ids and repeated rows are rows like any
    other; of labels that share an id, the worst counts. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if labels is None:
        labels = spark.createDataFrame([], "id long, quality int, toxic int")
    gold = labels.select(F.col(labels.columns[0]).cast("long").alias("id"), "quality", "toxic").where("id is not null")
    gold = gold.groupBy("id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    gold = gold.select("id", F.coalesce("quality", F.lit(SILENT)).alias("gold_quality"), F.coalesce(1 - F.col("toxic"), F.lit(SILENT)).alias("gold_clean"))

    lexicons, shape, word, votes = _study(_sample(rows, gold, limits))
    shared = spark.sparkContext.broadcast(lexicons)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, t = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for _, _, looks, owners, features, words in _both(batch.column(1)):
                q.append(_pattern(quality_votes(looks)))
                t.append(_pattern(insult_votes(owners, features, words, shared.value)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(q)), pa.array(np.concatenate(t))], ["id", "q", "t"])

    seen = rows.mapInArrow(vote, "id long, q long, t long").join(gold, "id", "left")
    seen = seen.groupBy(
        "q", "t", F.coalesce("gold_quality", F.lit(SILENT)).alias("gq"), F.coalesce("gold_clean", F.lit(SILENT)).alias("gt")
    ).agg(F.count(F.lit(1)).alias("n")).collect()
    seen = np.array([tuple(r) for r in seen], dtype=np.int64).reshape(-1, 5)
    models = []
    for k, n in ((0, votes[0].shape[1] - 1), (1, votes[1].shape[1] - 1)):
        patterns = np.concatenate([_unpattern(seen[:, k], n), seen[:, 2 + k : 3 + k].astype(np.int8)], axis=1)
        models.append(expectation_maximisation(patterns, seen[:, 4].astype(float)))
    target = [posterior(v, *m) for v, m in zip(votes, models, strict=True)]
    scorers = fit_linear(*shape, target[0], SHAPE_SPACE, limits.epochs), fit_linear(*word, target[1], WORD_SPACE, limits.epochs)
    del shape, word, votes, target
    fitted = spark.sparkContext.broadcast(Scorer(*scorers))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quality, clean = fitted.value.scores(batch.column(1))
            kept = (quality >= limits.least_score) & (clean >= limits.least_score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(quality), pa.array(clean), pa.array(kept)], ["id", "quality_score", "clean_score", "kept"]
            )

    out = rows.mapInArrow(score, "id long, quality_score double, clean_score double, kept boolean")
    return out.withColumnRenamed("id", id_col)


def _sample(rows: DataFrame, gold: DataFrame, limits: Limits) -> list[tuple]:
    """(text, gold_quality, gold_clean, half) of a bounded choice by hash: labelled texts, and any texts."""
    cut = F.substring("text", 1, limits.chars_per_text)

    def thin(df: DataFrame, most: int, key: str) -> DataFrame:
        # The share comes from the number of different keys, as copies are chosen together and count once.
        different = df.agg(F.approx_count_distinct(F.xxhash64(key), 0.03)).first()[0]
        share = min(1.0, 2.0 * most / max(1, different))
        return df.withColumn("h", F.xxhash64(key)).where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)))

    chosen = thin(gold, limits.labelled_texts, "id").orderBy("h").limit(limits.labelled_texts)
    known = rows.join(F.broadcast(chosen), "id").select(cut.alias("text"), "gold_quality", "gold_clean", F.pmod("h", F.lit(2)).alias("half"), "h")
    plain = thin(rows, limits.plain_texts, "text").select(cut.alias("text"), "h").dropDuplicates(["h"]).orderBy("h").limit(limits.plain_texts)
    return [
        *map(tuple, known.orderBy("h", "text").limit(limits.labelled_texts).drop("h").collect()),
        *((r.text, SILENT, SILENT, -1) for r in plain.collect()),
    ]


def _study(sample: list[tuple]) -> tuple[list[np.ndarray], tuple, tuple, list[np.ndarray]]:
    """Lexicons, the sample's features for both scorers, and its votes with the labels as the last labeller."""
    column = pa.array([r[0] for r in sample], pa.large_string())
    gold = np.array([r[1:] for r in sample], dtype=np.int64).reshape(-1, 3)
    quality, shapes, texts, words = [], [], [], []
    for first, _, looks, owners, features, count in _both(column):
        quality.append(quality_votes(looks))
        own, col, value = sparse(looks.owners, looks.shapes, looks.words, SHAPE_SPACE)
        shapes.append(((own + first).astype(np.int32), col.astype(np.int32), value.astype(np.float32)))
        own, col, times = tally(owners, features, WORD_SPACE)
        texts.append(((own + first).astype(np.int32), col.astype(np.int32), times.astype(np.float32)))
        words.append(count)
    none = (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32))
    shape = tuple(np.concatenate([none[k], *(s[k] for s in shapes)]) for k in range(3))
    owners, features, times = (np.concatenate([none[k], *(t[k] for t in texts)]) for k in range(3))
    count = np.concatenate([np.zeros(0, dtype=np.int64), *words])
    fixed = np.zeros(WORD_SPACE, dtype=bool)
    fixed[insult_features()] = True
    lexicons = [fixed, *(_lexicon(owners, features, gold[:, 1] == BAD, (gold[:, 2] == half) & (gold[:, 1] != SILENT)) for half in (0, 1))]
    word = (owners, features, _value(times, count[owners].astype(np.float32)))
    votes = [
        np.concatenate([np.concatenate(quality) if quality else np.zeros((0, 6), np.int8), gold[:, :1].astype(np.int8)], axis=1),
        np.concatenate([insult_votes(owners, features, count, lexicons, times), gold[:, 1:2].astype(np.int8)], axis=1),
    ]
    return lexicons, shape, word, votes
