"""Substring deduplication by level-wise doubling."""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare
from .textkit import blocks, grams, mix, spaced_words

#: Bytes of text in a chunk, and windows in a bucket as many as a chunk has words.
CHUNK_BYTES = 8 << 20
#: At lower levels a window is known by so many bits of its hash: a clash only keeps a candidate.
SHORT_BITS = 48
_BLANK = ~spaced_words()
NO_ID = np.iinfo(np.int64).max


def pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, byte plane by byte plane: the high planes are nearly all zero."""
    steps = np.diff(values, prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


class Chunk:
    """The texts of a chunk in the order of their ids, and the hashes of their words."""

    def __init__(self, rows: pa.Table):
        rows = rows.select(["id", "text"])
        rows = rows.sort_by([("id", "ascending"), ("text", "ascending")])
        ids = rows.column("id")
        self.ids_column = ids
        self.ids = ids.combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.blocks = list(blocks(rows.column("text"), spaced_words()))
        none = np.zeros(0, dtype=np.uint64)
        self.words = np.concatenate([none, *(b.hashes() for b in self.blocks)])
        self.left = np.concatenate([none, *(b.left() for b in self.blocks)]).astype(np.int32)
        self.counts = np.concatenate([np.zeros(0, dtype=np.int64), *(b.counts() for b in self.blocks)])


    def digests(self, places: np.ndarray, window: int) -> np.ndarray:
        """Of the window at each place, the BLAKE2 digest of its words joined by one space, as two numbers."""
        found = [np.zeros((0, 2), dtype=np.uint64)]
        base = 0
        for block in self.blocks:
            lo, hi = np.searchsorted(places, (base, base + len(block.starts)))
            own = places[lo:hi] - base
            base += len(block.starts)
            if not len(own):
                continue
            raw = bytearray(block.data.tobytes())
            np.frombuffer(raw, dtype=np.uint8)[_BLANK[block.data]] = 0x20
            raw, starts, ends = bytes(raw), block.starts, block.ends
            gaps = np.zeros(len(starts), dtype=np.int64)
            gaps[1:] = np.cumsum(starts[1:] - ends[:-1] != 1)
            plain = gaps[own + window - 1] == gaps[own]
            each = [
                hashlib.blake2b(
                    raw[s:e] if p else b" ".join([raw[a:b] for a, b in zip(starts[o : o + window].tolist(), ends[o : o + window].tolist(), strict=True)]),
                    digest_size=16,
                ).digest()
                for o, s, e, p in zip(own.tolist(), starts[own].tolist(), ends[own + window - 1].tolist(), plain.tolist(), strict=True)
            ]
            found.append(np.frombuffer(b"".join(each), dtype=np.uint64).reshape(-1, 2))
        return np.concatenate(found)


class Level:
    """The candidate windows of one length in a chunk: each distinct key, and where it occurs.

    A key is the beginning of a window's hash or, at the last level, a digest of its words in two numbers.
    """

    def __init__(self, places: np.ndarray, keys: np.ndarray, rest: np.ndarray | None, bits: int, buckets: int):
        self.places = places
        order = np.argsort(keys, kind="stable") if rest is None else np.lexsort((rest, keys))
        ranked = keys[order]
        new = np.empty(len(keys), dtype=bool)
        new[:1] = True
        new[1:] = ranked[1:] != ranked[:-1]
        self.rest = None
        if rest is not None:
            rest = rest[order]
            new[1:] |= rest[1:] != rest[:-1]
            self.rest = rest[new]
        self.values = ranked[new]
        self.group = np.empty(len(keys), dtype=np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.first = places[order][new]  # the order is stable and places ascend
        self.counts = np.bincount(self.group, minlength=len(self.values))
        starts = [(k << bits) // buckets for k in range(buckets)]
        self.cuts = np.append(np.searchsorted(self.values, np.array(starts, dtype=np.uint64)), len(self.values))

    def flags(self, answers: dict[int, bytes]) -> np.ndarray:
        """What the buckets have answered for each distinct hash."""
        out = np.zeros(len(self.values), dtype=bool)
        for k, packed in answers.items():
            a, b = self.cuts[k], self.cuts[k + 1]
            out[a:b] = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=b - a)
        return out


def lengths(base: int, window: int) -> list[int]:
    found = [base]
    while found[-1] < window:
        found.append(2 * found[-1])
    if found[-1] != window:
        raise ValueError("the window is the base times a power of two")
    return found


def _climb(chunk: Chunk, levels: list[int], answers: dict[int, dict[int, bytes]], buckets: int) -> Level:
    """The first level without answers, or the last one.

    A window of twice the length is a candidate if both its halves are repeated; its hash
    comes from theirs, so each level works on the candidates that the one below has left.
    """
    length = levels[0]
    hashes = grams(chunk.words, length)
    places = np.flatnonzero(chunk.left[: len(hashes)] >= length)
    hashes = hashes[places]
    while True:
        if length == levels[-1]:
            first, second = chunk.digests(places, length).T
            return Level(places, first.copy(), second.copy(), 64, buckets)
        level = Level(places, hashes >> np.uint64(64 - SHORT_BITS), None, SHORT_BITS, buckets)
        if length not in answers:
            return level
        repeated = (level.counts > 1) | level.flags(answers[length])
        stay = repeated[level.group]
        at = np.full(len(chunk.words) + 1, -1, dtype=np.int32)
        at[places[stay]] = np.flatnonzero(stay)
        heads = places[stay & (chunk.left[places] >= 2 * length)]
        heads = heads[at[heads + length] >= 0]
        hashes = mix(hashes[at[heads]] * np.uint64(0xA24BAED4963EE407) + hashes[at[heads + length]])
        places, length = heads, 2 * length


ASK = "level int, bucket int, chunk int, hashes binary, rest binary, ids binary"
ANSWER = "chunk int, level int, bucket int, found binary"


def _ask(rows: pa.Table, answers: dict, levels: list[int], step: int, buckets: int) -> pa.Table:
    chunk = Chunk(rows)
    level = _climb(chunk, levels, answers, buckets)
    out: list[tuple] = []
    owners = None
    if levels[step] == levels[-1]:
        owners = np.repeat(chunk.ids, chunk.counts)[level.first] if len(level.first) else np.zeros(0, dtype=np.int64)
    number = rows.column("chunk")[0].as_py()
    for k in range(buckets):
        a, b = level.cuts[k], level.cuts[k + 1]
        if a < b:
            ids = None if owners is None else owners[a:b].view(np.uint8).reshape(-1, 8).T.tobytes()
            rest = None if owners is None else level.rest[a:b].tobytes()
            out.append((levels[step], k, number, pack(level.values[a:b]), rest, ids))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*out, strict=True)) or [[]] * 6
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    names=["level", "bucket", "chunk", "hashes", "rest", "ids"])


def _answer(rows: pa.Table) -> pa.Table:
    """Of each chunk's keys in this bucket: those that another chunk has, or has in an earlier text."""
    chunks = rows.column("chunk").to_numpy()
    parts = [unpack(x.as_py()) for x in rows.column("hashes")]
    sizes = np.array([len(p) for p in parts])
    values, which = np.concatenate(parts), np.repeat(chunks, sizes)
    last = rows.column("ids")[0].is_valid
    if last:
        rest = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint64) for x in rows.column("rest")])
        order = np.lexsort((rest, values))
    else:
        order = np.argsort(values)
    ranked = values[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    if last:
        new[1:] |= rest[order][1:] != rest[order][:-1]
    starts = np.flatnonzero(new)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ranked))))
    if last:
        ids = np.concatenate([
            np.ascontiguousarray(np.frombuffer(x.as_py(), dtype=np.uint8).reshape(8, -1).T).view(np.int64).ravel()
            for x in rows.column("ids")
        ])[order]
        least = np.minimum.reduceat(ids, starts)[group]
        # One id lies in one chunk; only rows without an id tie, and the least chunk is then first.
        ties = np.where(ids == least, which[order], np.iinfo(np.int32).max)
        found = (ids > least) | (which[order] > np.minimum.reduceat(ties, starts)[group])
    else:
        found = np.diff(np.append(starts, len(ranked)))[group] > 1
    flags = np.empty(len(values), dtype=bool)
    flags[order] = found
    packed = [np.packbits(f).tobytes() for f in np.split(flags, np.cumsum(sizes)[:-1])]
    return pa.table(
        [rows.column("chunk"), rows.column("level"), rows.column("bucket"), pa.array(packed, pa.binary())],
        names=["chunk", "level", "bucket", "found"],
    )


def _by_level(rows: pa.Table) -> dict[int, dict[int, bytes]]:
    found: dict[int, dict[int, bytes]] = {}
    for level, bucket, data in zip(*(rows.column(c).to_pylist() for c in ("level", "bucket", "found")), strict=True):
        found.setdefault(level, {})[bucket] = data
    return found


OUT = "id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _cut(rows: pa.Table, answers: dict, levels: list[int], buckets: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    chunk, window = Chunk(rows), levels[-1]
    level = _climb(chunk, levels, answers, buckets)
    later = level.flags(answers.get(window, {}))[level.group] | (level.places != level.first[level.group])
    edges = np.zeros(len(chunk.words) + 1, dtype=np.int32)
    np.add.at(edges, level.places[later], 1)
    np.add.at(edges, level.places[later] + window, -1)
    gone = np.cumsum(edges[:-1]) > 0
    base, row = 0, 0
    for block in chunk.blocks:
        mask = gone[base : base + len(block.starts)]
        removed, digests, kept_texts = [], [], []
        for k in range(block.n):
            words = block.words(k)
            own = mask[block.bounds[k] : block.bounds[k + 1]]
            removed.append(int(own.sum()))
            if removed[-1]:
                words = [w for w, g in zip(words, own.tolist(), strict=True) if not g]
            kept = b" ".join(words)
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept.decode() if with_text else None)
        yield pa.RecordBatch.from_arrays(
            [chunk.ids_column.slice(row, block.n).combine_chunks(), pa.array(block.counts()), pa.array(removed, pa.int64()),
             pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())],
            ["id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )
        base, row = base + len(block.starts), row + block.n


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, base: int = 5,
    chunk_bytes: int = CHUNK_BYTES, with_text: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256 (and kept_text on demand).

    Words are runs of characters other than the six ASCII blanks. A window of ``window``
    words is removed where its word sequence also starts earlier: in a smaller id, or
    earlier in the same text. Windows are judged on the input.

    Level-wise doubling: windows of ``base`` words that occur once are dropped; those that
    are repeated alone are extended to twice the length, and so on, until the window's
    length is reached or no candidates survive. Texts are dealt by id into chunks. At each
    level a chunk sends every distinct hash of its candidates once, however often it
    occurs, to the bucket of its hash range, and gets back one bit for each: whether
    another chunk has it, or at the last level whether an earlier text has it. So a
    passage that a third of all texts share makes one entry per chunk. Neither pairs nor
    positions are shuffled. Hashes only choose candidates: at the last level windows are
    told apart by 128-bit BLAKE2 digests of their words.

    Chunks hold ``chunk_bytes`` of text, or more than that where the corpus is so large
    that chunks times buckets would pass the number of its 64 KB pieces.

    A null text has no words. Ids are whole numbers; a row with a null id comes after all others. Rows that
    share an id follow one another in the order of their texts, so repeated rows lose
    their repeats. Other columns are ignored; no rows, no result.
    """
    spark = docs.sparkSession
    prepare(spark)
    levels = lengths(base, window)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    per_chunk = max(chunk_bytes, math.isqrt(total << 10))
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 20)
    n = max(1, least, -(-total // per_chunk))
    seed = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_col))
    rows = docs.select(
        F.pmod(seed, F.lit(n)).cast("int").alias("chunk"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")
    )
    grouped, answers = rows.groupBy("chunk"), None
    def asking(step: int):
        def first(r: pa.Table) -> pa.Table:
            return _ask(r, {}, levels, step, n)

        def later(r: pa.Table, a: pa.Table) -> pa.Table:
            return _ask(r, _by_level(a), levels, step, n) if r.num_rows else _none(ASK)

        return later if step else first

    for step in range(len(levels)):
        sides = grouped.cogroup(answers.groupBy("chunk")) if step else grouped
        found = sides.applyInArrow(asking(step), ASK).groupBy("bucket").applyInArrow(_answer, ANSWER)
        answers = answers.unionByName(found) if step else found

    def cut(r: pa.Table, a: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_cut(r, _by_level(a), levels, n, with_text)) if r.num_rows else _none(OUT)

    out = grouped.cogroup(answers.groupBy("chunk")).applyInArrow(cut, OUT).withColumnRenamed("id", id_col)
    return out if with_text else out.drop("kept_text")


def _none(ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [pa.field(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))]
    return pa.schema(fields).empty_table()
