"""Benchmark decontamination by winnowing."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare
from .textkit import Block, alnum_words, blocks, grams

#: Items are sent to every task, in one broadcast, up to this many bytes of their texts.
BROADCAST_BYTES = 32 << 20


def winnow(hashes: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
    """Places of the k-gram hashes that are least in some window of ``width`` of one text.

    ``left``: of each place, how many places of its text are there or after; a text with
    fewer than ``width`` places is one window. Every window keeps the first of its least.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    begin = np.empty(n, dtype=bool)
    begin[0] = True
    begin[1:] = left[1:] >= left[:-1]
    whole = begin & (left < width)
    least, at = hashes.copy(), np.arange(n)
    for j in range(1, width):
        other, inside = hashes[j:], left[:-j] > j
        better = inside & (other < least[:-j])
        least[:-j][better] = other[better]
        at[:-j][better] = np.arange(j, n)[better]
    return np.unique(at[(left >= width) | whole])


def _fingerprints(block: Block, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions in the block of kept k-grams, and their hashes."""
    hashes, left = grams(block.hashes(), k), block.left()
    places = np.flatnonzero(left[: len(hashes)] >= k)
    kept = places[winnow(hashes[places], left[places] - (k - 1), width)]
    return kept, hashes[kept]


class Items:
    """Benchmark items: their words, and of each winnowed fingerprint the places that have it."""

    def __init__(self, ids: list[str], column: pa.Array, window: int, k: int):
        self.ids, self.window, self.k, self.words = ids, window, k, []
        self.short: dict[int, dict[tuple, list[int]]] = {}
        prints: list[tuple[int, int, int]] = []
        for block in blocks(column, alnum_words(), lower=True):
            at, hashes = _fingerprints(block, k, window - k + 1)
            owner = block.owners()
            for p, h in zip(at.tolist(), hashes.tolist(), strict=True):
                o = int(owner[p])
                if block.bounds[o + 1] - block.bounds[o] >= window:
                    prints.append((h, block.first + o, p - int(block.bounds[o])))
            for o in range(block.n):
                words = block.words(o)
                self.words.append(words)
                if 0 < len(words) < window:
                    self.short.setdefault(len(words), {}).setdefault(tuple(words), []).append(block.first + o)
        prints.sort()
        self.hashes = np.array([p[0] for p in prints], dtype=np.uint64)
        self.owners = [p[1:] for p in prints]
        self.filter = np.zeros(1 << 16, dtype=bool)
        self.filter[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.short_hashes = {}
        for n, runs in self.short.items():
            column = pa.array([b" ".join(r) for r in runs], pa.large_binary())
            found = [grams(b.hashes(), n)[b.bounds[:-1]] for b in blocks(column, alnum_words())]
            self.short_hashes[n] = np.sort(np.concatenate(found))


def _within(sorted_hashes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(sorted_hashes):
        return np.zeros(len(hashes), dtype=bool)
    return sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)] == hashes


def hits(block: Block, items: Items) -> dict[int, tuple[np.ndarray, set[int]]]:
    """Of each text of the block with hits: which of its words are hit, and by which items.

    A fingerprint that text and item share is extended to both sides, word by word, to the
    longest common run around it; the run counts if it is as long as a window. Any
    shared window holds a fingerprint that both sides keep, so no window is missed.
    """
    window, found = items.window, {}
    owners, words = block.owners(), {}

    def words_of(o: int) -> list[bytes]:
        if o not in words:
            words[o] = block.words(o)
        return words[o]

    def note(o: int, begin: int, end: int, item: int) -> None:
        mask, which = found.setdefault(o, (np.zeros(block.bounds[o + 1] - block.bounds[o], dtype=bool), set()))
        mask[begin:end] = True
        which.add(item)

    at, hashes = _fingerprints(block, items.k, window - items.k + 1)
    maybe = items.filter[(hashes & np.uint64(0xFFFF)).astype(np.int64)]
    at, hashes = at[maybe], hashes[maybe]
    hit = _within(items.hashes, hashes)
    reached: dict[tuple[int, int, int], int] = {}
    for p, h in zip(at[hit].tolist(), hashes[hit].tolist(), strict=True):
        o = int(owners[p])
        text, q = words_of(o), p - int(block.bounds[o])
        lo, hi = (np.searchsorted(items.hashes, np.uint64(h), side) for side in ("left", "right"))
        for item, r in items.owners[lo:hi]:
            if reached.get((o, item, q - r), -1) > q:
                continue  # inside a run that is known
            other = items.words[item]
            end = 0
            while q + end < len(text) and r + end < len(other) and text[q + end] == other[r + end]:
                end += 1
            if not end:
                continue
            begin = 0
            while q - begin > 0 and r - begin > 0 and text[q - begin - 1] == other[r - begin - 1]:
                begin += 1
            reached[o, item, q - r] = q + end
            if begin + end >= window:
                note(o, q - begin, q + end, item)
    left = block.left()
    for n, known in items.short_hashes.items():
        runs = grams(block.hashes(), n)
        places = np.flatnonzero(left[: len(runs)] >= n)
        for p in places[_within(known, runs[places])].tolist():
            o = int(owners[p])
            text, q = words_of(o), p - int(block.bounds[o])
            for item in items.short[n].get(tuple(text[q : q + n]), ()):
                note(o, q, q + n, item)
    return found


OUT = "id long, n_words long, n_hit long, items array<string>"


def _scan(batch: pa.RecordBatch, items: Items) -> pa.RecordBatch:
    n_words, n_hit = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
    which: list[list[str]] = [[] for _ in range(batch.num_rows)]
    for block in blocks(batch.column(1), alnum_words(), lower=True):
        n_words[block.first : block.first + block.n] = block.counts()
        for o, (mask, found) in hits(block, items).items():
            n_hit[block.first + o] = mask.sum()
            which[block.first + o] = sorted({items.ids[i] for i in found})
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(n_words), pa.array(n_hit), pa.array(which, pa.list_(pa.string()))],
        ["id", "n_words", "n_hit", "items"],
    )


def _scan_all(docs: DataFrame, bench: DataFrame, window: int, k: int) -> DataFrame:
    """One pass over the texts with all items in every task; for items of a checked size."""
    rows = bench.toArrow()
    items = docs.sparkSession.sparkContext.broadcast(
        Items(rows.column(0).to_pylist(), rows.column(1).combine_chunks(), window, k)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _scan(batch, items.value)

    return docs.mapInArrow(run, OUT)


def _prints(frame: DataFrame, window: int, k: int, short: list[int]) -> DataFrame:
    """(id, len, fp), each once: winnowed fingerprints as length 0, and all runs of the short lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1), alnum_words(), lower=True):
                owners, left, words = block.owners(), block.left(), block.hashes()
                at, hashes = _fingerprints(block, k, window - k + 1)
                sets = [(0, at, hashes)]
                for n in short:
                    runs = grams(words, n)
                    places = np.flatnonzero(left[: len(runs)] >= n)
                    sets.append((n, places, runs[places]))
                for n, places, hashes in sets:
                    own = block.first + owners[places]
                    once = np.unique(np.stack([own.astype(np.uint64), hashes]), axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[once[0].astype(np.int64)], batch.column(0).type),
                         pa.array(np.full(once.shape[1], n, dtype=np.int32)), pa.array(once[1].view(np.int64))],
                        ["id", "len", "fp"],
                    )

    kind = dict(frame.dtypes)["id"]
    return frame.mapInArrow(run, f"id {kind}, len int, fp long")


def _scan_joined(docs: DataFrame, bench: DataFrame, window: int, k: int) -> DataFrame:
    """For items of any size: fingerprints meet in a shuffled join, and candidate pairs are extended.

    Equal rows, of the same id and text, have one key and one result. A fingerprint that
    no item has goes no further than the join, whose hot keys adaptive execution splits.
    """
    docs = docs.withColumn("row", F.sha2(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))), 256))

    def count(column: pa.Array) -> pa.Array:
        parts = [b.counts() for b in blocks(column, alnum_words(), lower=True)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), count(batch.column(1))], ["id", "n"])

    lengths = bench.mapInArrow(sized, "id string, n long")
    short = sorted(r.n for r in lengths.where(F.col("n").between(1, window - 1)).select("n").distinct().collect())
    prints = _prints(docs.select(F.col("row").alias("id"), "text"), window, k, short).withColumnRenamed("id", "row")
    own = (
        _prints(bench, window, k, short).withColumnRenamed("id", "item").join(lengths.withColumnRenamed("id", "item"), "item")
        .where(F.when(F.col("n") < window, F.col("len") == F.col("n")).otherwise(F.col("len") == 0)).select("item", "len", "fp")
    )
    met = prints.join(own, ["len", "fp"]).select("row", "item").distinct()
    texts = docs.select("row", F.col("text").alias("doc")).dropDuplicates(["row"]).join(met, "row")
    pairs = texts.join(bench.select(F.col("id").alias("item"), F.col("text").alias("passage")), "item")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans, item_ids = [], [], []
            for r, item, doc, passage in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                items = Items([item], pa.array([passage], pa.large_string()), window, k)
                for block in blocks(pa.array([doc], pa.large_string()), alnum_words(), lower=True):
                    for mask, _ in hits(block, items).values():
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0]))))
                        rows.append(r)
                        item_ids.append(item)
                        spans.append([{"s": int(s), "e": int(e)} for s, e in edge.reshape(-1, 2)])
            kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.string()), pa.array(item_ids, pa.string()), pa.array(spans, kind)], ["row", "item", "spans"]
            )

    spans = pairs.select("row", "item", "doc", "passage").mapInArrow(extend, "row string, item string, spans array<struct<s:int,e:int>>")
    spans = spans.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
                                     F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["to"], x["s"]))).alias("n"),
                              F.greatest(a["to"], x["e"]).alias("to")),
    )["n"]
    hit = spans.select("row", covered.cast("long").alias("n_hit"), "items")

    sizes = docs.select("row", "text").mapInArrow(sized, "id string, n long").select(F.col("id").alias("row"), F.col("n").alias("n_words")).distinct()
    return docs.select("row", "id").join(sizes, "row").join(hit, "row", "left").select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    window: int = 10, k: int = 5, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    Words are runs of digits, letters a-z after lower-casing A-Z, and characters beyond
    ASCII. A window is ``window`` consecutive words of an item, or all words of a shorter
    item; a word of a text inside any occurrence of a window is hit. Both sides keep
    the least of every ``window - k + 1`` k-gram hashes, fingerprints are joined, and
    shared ones are extended by comparing words, so every shared window is found and no
    other. Runs shorter than a window, from short items, are looked up whole.

    Items whose texts have at most ``broadcast_bytes`` go to every task, and the texts
    are not shuffled; beyond that, fingerprints meet in a shuffled join. A null text
    has no words. Items with a null id or without words occur nowhere; items that share
    an id count once. Repeated rows and null ids of ``docs`` are rows like any other; ids of ``docs`` are whole numbers.
    """
    prepare(docs.sparkSession)
    bench = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    bench = bench.where("id is not null and text is not null")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = bench.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        found = _scan_all(rows, bench, window, k)
    else:
        found = _scan_joined(rows, bench, window, k)
    listed = F.array_join("items", ",")
    return found.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items",
    )
