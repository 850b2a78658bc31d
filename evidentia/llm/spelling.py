"""Spelling variants: words one edit apart, found through whole neighbourhoods."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, Scratch, prepare
from .textkit import mix

LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Bytes of one sketch of the vocabulary, at 16 bits a word or more: one for 16 million words, and one more for as many again.
SKETCH_BYTES = 1 << 25
BITS_PER_WORD = 16
PROBES = 4
#: Neighbours that a task holds at once.
HELD = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = LETTERS, least_length: int = 6, least_count: int = 5,
    respell: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """(word, n): runs of ``pattern`` with A-Z in lower case, of ``least_length`` code points and ``least_count`` occurrences or more.

    ``respell`` may give the word that a run of a document counts as, from the document's id and the run. Counts are added up
    within each task before the shuffle. The language's most frequent word is thus a row per task.
    """
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0))).alias("run"))
    plain = F.length("run") == F.octet_length("run")
    runs = runs.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    word = respell(F.col("id"), F.col("run")) if respell else F.col("run")
    counts = runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least_count)


def _by_length(words: list[str], held: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words of one length with their code points, at most ``held`` points at a time."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for n, own in groups.items():
        size = max(1, held // max(n, 1))
        for k in range(0, len(own), size):
            part = own[k : k + size]
            yield part, np.frombuffer("".join(part).encode("utf-32-le"), dtype=np.uint32).reshape(len(part), n).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    np.cumprod(np.full(n - 1, _BASE, dtype=np.uint64), out=out[1:])
    return out


def _sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, the hash of what stands before each place, and of what stands there or later."""
    terms = codes * _powers(codes.shape[1] + 1)[:-1]
    before = np.zeros((len(codes), codes.shape[1] + 1), dtype=np.uint64)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    return before, before[:, -1:] - before


def _sealed(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums + np.array([max(length, 0)], dtype=np.uint64) * _LENGTH)


def word_hashes(words: list[str]) -> np.ndarray:
    """A hash for each word, a sum over its places, so that those of its neighbours follow from sums."""
    found = {}
    for own, codes in _by_length(words, HELD):
        found.update(zip(own, _sealed(_sums(codes)[0][:, -1], codes.shape[1])))
    return np.array([found[w] for w in words], dtype=np.uint64)


def neighbours(words: list[str], letters: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[str, str]]:
    """(word, neighbour) of every distinct string that one deletion, replacement or insertion of ``letters`` makes, if its hash is ``wanted``.

    Each is made once: of equal letters in a row the first is deleted, a letter is inserted before
    its equals and never after one, and is replaced by others only. All hashes are computed; strings are made for wanted ones alone.
    """
    alphabet = [chr(c) for c in letters.tolist()]
    for own, codes in _by_length(words, max(1, HELD // max(1, len(letters)))):
        n = codes.shape[1]
        before, after = _sums(codes)
        powers = _powers(n + 1)
        first = np.ones(codes.shape, dtype=bool)
        first[:, 1:] = codes[:, 1:] != codes[:, :-1]
        gone = _sealed(before[:, :-1] + after[:, 1:] * np.uint64(_BACK), n - 1)
        for k, i in zip(*np.nonzero(wanted(gone) & first)):
            yield own[k], own[k][:i] + own[k][i + 1 :]
        placed = letters[None, :] * powers[:, None]
        other = _sealed((before[:, :-1] + after[:, 1:])[:, :, None] + placed[None, :-1], n)
        for k, i, c in zip(*np.nonzero(wanted(other) & (codes[:, :, None] != letters))):
            yield own[k], own[k][:i] + alphabet[c] + own[k][i + 1 :]
        more = _sealed((before + after * np.uint64(_BASE))[:, :, None] + placed[None], n + 1)
        free = np.ones(more.shape, dtype=bool)
        free[:, 1:] = codes[:, :, None] != letters
        for k, i, c in zip(*np.nonzero(wanted(more) & free)):
            yield own[k], own[k][:i] + alphabet[c] + own[k][i:]


def _probe(hashes: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th place of a hash in a sketch of ``bits``, a power of two."""
    mixed = mix(hashes)
    return (mixed + np.uint64(k) * ((mixed >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)


def _sketch(vocabulary: DataFrame, part: int, parts: int, bits: int) -> np.ndarray:
    """A Bloom filter of the words of one part: ``bits`` / 64 numbers, of a size that the caller bounds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = word_hashes(batch.column(0).to_pylist())
            hashes = hashes[hashes % np.uint64(parts) == part]
            at = np.unique(np.concatenate([_probe(hashes, k, bits) for k in range(PROBES)]))
            slots = np.unique(at >> np.uint64(6), return_index=True)
            set_ = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), slots[1]) if len(at) else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(slots[0].view(np.int64)), pa.array(set_.view(np.int64))], ["slot", "bits"])

    filled = vocabulary.select("word").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    found = np.zeros(bits // 64, dtype=np.uint64)
    found[filled.column("slot").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)
    return found


def near_words(vocabulary: DataFrame, letters: list[str], sketch_bytes: int = SKETCH_BYTES) -> DataFrame:
    """(word, n, near, near_n): every word of ``vocabulary`` (word, n) with each word that one edit makes of it.

    Each word's whole neighbourhood is generated where the word is; a Bloom filter of the vocabulary in every task lets
    through the few that may be words, and those meet the vocabulary in a hash join on the strings themselves, which decides. A
    filter has ``sketch_bytes`` at most: of a larger vocabulary the words are dealt to several by their hash,
    and the neighbourhoods are generated once for each.
    """
    spark = vocabulary.sparkSession
    total = vocabulary.count()
    parts = -(-total * BITS_PER_WORD // (8 * sketch_bytes)) or 1
    bits = 1 << max(6, (-(-total // parts) * BITS_PER_WORD - 1).bit_length())
    codes = np.array(sorted(map(ord, letters)), dtype=np.uint64)
    # Few rows make many: spread them over as many tasks as a shuffle has, which Spark would not do for a small table.
    spread = vocabulary.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word")
    emitted = None
    for part in range(parts):
        sketch = spark.sparkContext.broadcast(_sketch(vocabulary, part, parts, bits))

        def run(batches: Iterator[pa.RecordBatch], part: int = part, sketch=sketch) -> Iterator[pa.RecordBatch]:
            held = sketch.value

            def wanted(hashes: np.ndarray) -> np.ndarray:
                out = np.zeros(hashes.shape, dtype=bool)
                flat = hashes.ravel()
                left = np.flatnonzero(flat % np.uint64(parts) == part) if parts > 1 else np.arange(flat.size)
                for k in range(PROBES):  # few pass a probe, so only those are probed again
                    place = _probe(flat[left], k, bits)
                    left = left[(held[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
                out.ravel()[left] = True
                return out

            for batch in batches:
                counts = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                pairs = list(neighbours(list(counts), codes, wanted))
                if pairs:
                    own, near = map(list, zip(*pairs))
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([counts[w] for w in own], pa.int64()), pa.array(near)], ["word", "n", "near"])

        found = spread.select("word", "n").mapInArrow(run, "word string, n long, near string")
        emitted = found if emitted is None else emitted.unionByName(found)
    return emitted.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")


def variant_groups(words: DataFrame, ratio: int = 5, sketch_bytes: int = SKETCH_BYTES) -> DataFrame:
    """One row per word of ``words`` (word, n; each word once): word, form, root, n, n_near, form_n.

    Words are near if one inserted, deleted or replaced code point tells them apart. A word's ``form`` is its most frequent
    near word (of equally frequent ones the first in code-point order), if that is ``ratio`` times as frequent or more; else
    null. ``root`` is where the forms lead in the end, the word itself where it has none. ``n_near`` counts near words and
    ``form_n`` is the form's count.

    Every word's whole neighbourhood over the letters that the words have is generated and joined with the words: what
    meets is near and stands once, so no distance is ever computed. The driver learns the letters, as many as the pattern allows (90 by
    default). Forms grow by ``ratio`` at each step, so roots are reached in few doublings of the way; each is
    written to the shared folder. An empty table gives an empty result; words that are null go.
    """
    spark = words.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    vocabulary = scratch.keep(words.select("word", "n").where("word is not null"), "vocabulary")
    each = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substr("word", i, F.lit(1)))
    letters = [r.c for r in vocabulary.select(F.explode(F.array_distinct(each)).alias("c")).where("c != ''").distinct().collect()]
    met = near_words(vocabulary, letters, sketch_bytes)
    best = met.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("w"))).alias("best"))
    formed = -F.col("best.k") >= ratio * F.col("n")
    best = best.select("word", "n_near", F.when(formed, F.col("best.w")).alias("form"), F.when(formed, -F.col("best.k")).alias("form_n"))
    best = scratch.keep(best, "best")

    ways = scratch.keep(best.where("form is not null").select("word", F.col("form").alias("root")), "ways-0")
    step = 0
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        walked = ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step += 1
        walked = scratch.keep(walked, f"ways-{step}")
        scratch.drop(f"ways-{step - 1}")
        ways = walked.select("word", "root")
        if not walked.where("moved").limit(1).count():
            break
    return vocabulary.join(best, "word", "left").join(ways, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"
    )


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = LETTERS, least_length: int = 6, least_count: int = 5, ratio: int = 5,
    respell: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """``variant_groups`` of the words of ``docs``, counted by ``word_counts``.

    A null text has no words, and texts of any length are read whole. Repeated rows count each. Ids matter to ``respell``
    alone. Other columns are ignored. Without words of the asked length and count there are no rows.
    """
    return variant_groups(word_counts(docs, id_col, text_col, pattern, least_length, least_count, respell), ratio)
