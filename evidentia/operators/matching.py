"""Any number of phrases in any number of texts, in one pass over the texts.

The windows of a text are hashed by sums, so that a window of any length costs the same. A Bloom
filter of the phrases' beginnings and of the whole phrases, of a bounded size, is all that a task knows of them; windows that
pass it meet the phrases themselves in a join on the strings, which decides.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from evidentia.scratch import Scratch, prepare

#: Bytes of one filter; 16 bits for each of the two entries of a phrase make it one pass for 8 million phrases, and one more for as many again.
FILTER_BYTES = 1 << 25
BITS_PER_ENTRY = 16
PROBES = 4
#: Bytes of text that are looked at together; a longer text is taken in such pieces. Hashes take some fifty times as much while they are made.
BLOCK = 1 << 18
#: Entries, and their bytes, of a map that goes to every task whole where texts are replaced in turn; a larger one is looked up in joins.
FEW_ENTRIES, FEW_BYTES = 1 << 16, 1 << 22
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_WHOLE, _BEGINNING = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    np.cumprod(np.full(n - 1, base, dtype=np.uint64), out=out[1:])
    return out


def _place(mixed: np.ndarray, k: int, bits: int) -> np.ndarray:
    return (mixed + np.uint64(k) * ((mixed >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings, and where each string begins and the last one ends; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[at[0] : at[-1]], at - at[0]


class _Sums:
    """Hashes of any window of some bytes."""

    def __init__(self, data: np.ndarray, back: np.ndarray):
        self.sums, self.back = np.zeros(len(data) + 1, dtype=np.uint64), back
        np.cumsum(_BYTES[data] * _powers(_BASE, max(len(data), 1))[: len(data)], out=self.sums[1:])

    def of(self, at: np.ndarray | slice, n: int, seal: np.uint64) -> np.ndarray:
        if isinstance(at, slice):
            held, back = self.sums[n:] - self.sums[: len(self.sums) - n], self.back[: len(self.sums) - n]
        else:
            held, back = self.sums[at + n] - self.sums[at], self.back[at]
        return _mix(held * back + np.array([n], dtype=np.uint64) * seal)


@dataclass
class Filter:
    """What a task knows of the phrases: bits, the lengths that occur, and which share of all phrases it stands for."""

    words: Broadcast
    bits: int
    lengths: tuple[int, ...]
    part: int
    parts: int

    def pass_on(self, mixed: np.ndarray) -> np.ndarray:
        held, left = self.words.value, np.arange(len(mixed))
        for k in range(PROBES):  # few pass a probe, so only those are probed again
            at = _place(mixed[left], k, self.bits)
            left = left[(held[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
        return left


def _entries(phrases: pa.Array, part: int, parts: int) -> np.ndarray:
    """Sealed hashes of the phrases of one part and of their beginnings, of the largest power of two that fits."""
    found = []
    for p in phrases.to_pylist():
        data = np.frombuffer(p.encode(), dtype=np.uint8)
        sums = _Sums(data, np.ones(1, dtype=np.uint64))
        at, n = np.zeros(1, dtype=np.int64), len(data)
        whole = sums.of(at, n, _WHOLE)
        if int(whole[0]) % parts == part:
            found += [whole, sums.of(at, 1 << (n.bit_length() - 1), _BEGINNING)]
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def filters(phrases: DataFrame, filter_bytes: int = FILTER_BYTES) -> list[Filter]:
    """Filters of the column ``phrase``, not null and not empty; one unless the phrases are too many for ``filter_bytes``."""
    spark = phrases.sparkSession
    lengths = phrases.groupBy(F.octet_length("phrase").alias("n")).agg(F.count(F.lit(1)).alias("k")).collect()
    total = sum(r.k for r in lengths)
    parts = -(-total * 2 * BITS_PER_ENTRY // (8 * filter_bytes)) or 1
    bits = 1 << max(6, (-(-total // parts) * 2 * BITS_PER_ENTRY - 1).bit_length())
    made = []
    for part in range(parts if total else 0):
        def run(batches: Iterator[pa.RecordBatch], part: int = part) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mixed = _entries(batch.column(0), part, parts)
                at = np.unique(np.concatenate([_place(mixed, k, bits) for k in range(PROBES)]))
                slots, first = np.unique(at >> np.uint64(6), return_index=True)
                held = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(slots.view(np.int64)), pa.array(held.view(np.int64))], ["slot", "bits"])

        # At most bits / 64 rows reach the driver, a size that ``filter_bytes`` bounds.
        set_ = phrases.select("phrase").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(bits // 64, dtype=np.uint64)
        words[set_.column("slot").to_numpy()] = set_.column("bits").to_numpy().view(np.uint64)
        made.append(Filter(spark.sparkContext.broadcast(words), bits, tuple(sorted(r.n for r in lengths)), part, parts))
    return made


@dataclass
class Found:
    """The windows of a piece of bytes that may be phrases: where they begin in it, their lengths, hashes and texts, by place and length."""

    start: int
    piece: np.ndarray
    at: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray
    owners: np.ndarray


def _found(data: np.ndarray, offsets: np.ndarray, known: list[Filter]) -> Iterator[Found]:
    """Every window of every text is looked at, in pieces of BLOCK bytes that overlap by the longest phrase; a window belongs to the piece where it begins."""
    if not known or not len(data):
        return
    lengths = known[0].lengths
    longest = lengths[-1]
    back = _powers(_BACK, min(len(data), BLOCK + longest) + 1)
    for start in range(0, len(data), BLOCK):
        piece = data[start : start + BLOCK + longest - 1]
        sums, found = _Sums(piece, back), []
        for level in sorted({n.bit_length() - 1 for n in lengths}):
            if 1 << level > len(piece):
                break
            begins = sums.of(slice(None), 1 << level, _BEGINNING)[:BLOCK]
            for f in known:
                at = f.pass_on(begins)
                end = offsets[np.searchsorted(offsets, start + at, side="right")] - start
                for n in (n for n in lengths if n.bit_length() - 1 == level):
                    inside = at[at + n <= end]
                    mixed = sums.of(inside, n, _WHOLE)
                    if f.parts > 1:
                        own = mixed % np.uint64(f.parts) == f.part
                        inside, mixed = inside[own], mixed[own]
                    hit = f.pass_on(mixed)
                    found.append((inside[hit], np.full(len(hit), n), mixed[hit]))
        if found:
            at, n, mixed = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((n, at))
            at = at[order]
            yield Found(start, piece, at, n[order], mixed[order], np.searchsorted(offsets, start + at, side="right") - 1)


def windows(column: pa.Array, known: list[Filter]) -> Iterator[tuple[int, int, int, str]]:
    """(text, begin, end, window) in bytes of every window that may be a phrase, by text and begin."""
    data, offsets = _flat(column)
    for f in _found(data, offsets, known):
        raw = f.piece.tobytes()
        for owner, at, n in zip(f.owners.tolist(), f.at.tolist(), f.lengths.tolist()):
            try:
                spelled = raw[at : at + n].decode()
            except UnicodeDecodeError:  # it begins or ends within a character
                continue
            base = f.start - int(offsets[owner])
            yield owner, base + at, base + at + n, spelled


def _counted(column: pa.Array, known: list[Filter]) -> dict[str, int]:
    """How often each window that may be a phrase stands in the texts, without overlaps of a window with itself.

    Windows of one piece are told apart by their length and a hash of 64 bits. Only those that overlap one of the same kind, or
    such a one of the piece before, are walked one by one.
    """
    counts: dict[str, int] = {}
    ends: dict[tuple[int, int], int] = {}  # of windows that reach into the next piece, where they end
    for f in _found(*_flat(column), known):
        order = np.lexsort((f.at, f.hashes, f.lengths, f.owners))
        own, at, n, kind = f.owners[order], f.start + f.at[order], f.lengths[order], f.hashes[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (n[1:] != n[:-1]) | (kind[1:] != kind[:-1])
        cuts = np.append(np.flatnonzero(new), len(at))
        crowded = ~new
        crowded[1:] &= at[1:] < at[:-1] + n[:-1]
        group = np.cumsum(new) - 1
        odd = set(group[crowded].tolist())
        if ends:
            odd |= set(np.flatnonzero(at[cuts[:-1]] < max(ends.values())).tolist())
        taken = np.ones(len(at), dtype=bool)
        for g in odd:
            end = ends.get((int(n[cuts[g]]), int(kind[cuts[g]])), 0)
            for i in range(cuts[g], cuts[g + 1]):
                taken[i] = at[i] >= end
                end = at[i] + n[i] if taken[i] else end
        over = np.flatnonzero(taken & (at + n > f.start + BLOCK))
        ends = {k: e for k, e in ends.items() if e > f.start + BLOCK} | {(int(n[i]), int(kind[i])): int(at[i] + n[i]) for i in over}
        at, n, kind = at[taken], n[taken], kind[taken]
        order = np.lexsort((kind, n))
        n, kind = n[order], kind[order]
        first = np.flatnonzero(np.concatenate(([True], (n[1:] != n[:-1]) | (kind[1:] != kind[:-1])))) if len(n) else np.zeros(0, dtype=np.int64)
        raw = f.piece.tobytes()
        for i, size, where in zip(first.tolist(), np.diff(np.append(first, len(n))).tolist(), (at[order][first] - f.start).tolist()):
            try:
                spelled = raw[where : where + int(n[i])].decode()
            except UnicodeDecodeError:  # it begins or ends within a character
                continue
            counts[spelled] = counts.get(spelled, 0) + size
    return counts


def _folded(column: pa.Array, either_case: bool) -> pa.Array:
    return pa.array([None if t is None else t.lower() for t in column.to_pylist()], pa.large_string()) if either_case else column


def count_phrases(texts: DataFrame, phrases: DataFrame, text: str = "text", either_case: bool = True, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(phrase, occurrences) over all texts, in either case unless told otherwise, and without overlaps of a phrase with itself.

    Any number of phrases is counted in one pass over the texts; no phrase reaches the driver. A batch adds up
    its windows before anything is shuffled. A phrase that stands nowhere has 0; an empty one too. Null texts and phrases go.
    """
    spark = texts.sparkSession
    prepare(spark)
    scratch = Scratch(spark)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _folded(batch.column(0), either_case).cast(pa.string())], ["own", "phrase"])

    known = phrases.select("phrase").where("phrase is not null").distinct().mapInArrow(keyed, "own string, phrase string")
    known = scratch.keep(known, "phrases")
    wanted = filters(known.select("phrase").where("phrase != ''").distinct(), filter_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _counted(_folded(batch.column(0), either_case), wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["phrase", "n"])

    found = texts.select(F.col(text)).mapInArrow(run, "phrase string, n long").groupBy("phrase").agg(F.sum("n").alias("n"))
    return known.join(found, "phrase", "left").select(F.col("own").alias("phrase"), F.coalesce("n", F.lit(0).cast("long")).alias("occurrences"))


_HITS = ArrayType(StructType([StructField("at", IntegerType()), StructField("stop", IntegerType()), StructField("phrase", StringType())]))


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])


def _slices(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with BLOCK bytes of text at ``place``, or one row: what a task makes of a batch does not follow the batch's size."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _map_of(entries: DataFrame, reverse: bool = False) -> DataFrame:
    """phrase, slug; of several slugs of a phrase the first by order counts. Empty phrases go."""
    a, b = ("slug", "phrase") if reverse else ("phrase", "slug")
    known = entries.select(F.col(a).alias("phrase"), F.col(b).alias("slug"))
    return known.where("phrase != ''").groupBy("phrase").agg(F.min("slug").alias("slug"))


def replace_phrases(texts: DataFrame, entries: DataFrame, text: str = "text", reverse: bool = False, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``texts`` with ``text`` replaced and ``n_replaced``: one pass from the left, longest phrase first, nothing twice.

    The map has any size: the texts are written once with their windows that may be phrases, these meet the map in a join, and a sweep
    over a text's matches, from the left and the longest first, splices it. Texts without a window are not
    shuffled, and no entry is in a plan or on the driver. A null text stays null. Of several slugs of a phrase the first by order counts.
    """
    spark = texts.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    known = scratch.keep(_map_of(entries, reverse), "entries")
    wanted = filters(known, filter_bytes)
    rows = texts.withColumn("__row", F.monotonically_increasing_id())
    place = rows.columns.index(text)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("at", pa.int32()), ("stop", pa.int32()), ("phrase", pa.string())]))
        for batch in (s for whole in batches for s in _slices(whole, place)):
            hits: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for owner, begin, end, spelled in windows(batch.column(place), wanted):
                hits[owner].append({"at": begin, "stop": end, "phrase": spelled})
            yield _with_column(batch, "__hits", pa.array(hits, kind))

    marked = scratch.keep(rows.mapInArrow(find, StructType([*rows.schema.fields, StructField("__hits", _HITS)])), "marked")
    some = F.size("__hits") > 0
    hits = marked.where(some).select("__row", F.explode("__hits").alias("h")).select("__row", "h.*").join(known, "phrase")
    matches = hits.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("at", (-F.col("stop")).alias("back"), "slug"))).alias("__matches"))
    met = marked.where(some).drop("__hits").join(matches, "__row", "left")

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for whole in batches for s in _slices(whole, place)):
            done, counts = [], []
            for t, found in zip(batch.column(place).to_pylist(), batch.column(batch.schema.get_field_index("__matches")).to_pylist()):
                raw, parts, at = t.encode(), [], 0
                for m in found or ():
                    if m["at"] >= at:
                        parts += [raw[at : m["at"]], (m["slug"] or "").encode()]
                        at = -m["back"]
                done.append(b"".join([*parts, raw[at:]]).decode())
                counts.append(len(parts) // 2)
            own = [c for c in batch.schema.names if c not in ("__row", "__matches")]
            columns = [pa.array(done, pa.string()) if c == text else batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())], [*own, "n_replaced"])

    # The row number goes last, so that the text keeps its place.
    met = met.select(*texts.columns, "__row", "__matches")
    out = met.mapInArrow(splice, StructType([*texts.schema.fields, StructField("n_replaced", IntegerType())]))
    plain = marked.where(~some).select(*texts.columns, F.when(F.col(text).isNotNull(), F.lit(0)).alias("n_replaced"))
    return plain.unionByName(out)


def _apply_in_turn(t: str, pairs: dict[str, str | None]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """The text after each replacement that changes it, the longest phrase first, and where slugs stand in it then."""
    for p in sorted((p for p, s in pairs.items() if s is not None), key=lambda p: (-len(p), p)):
        parts = t.split(p)
        if len(parts) > 1:
            slug, at, places = pairs[p], 0, []
            for x in parts[:-1]:
                at += len(x)
                places.append((at, at + len(slug)))
                at += len(slug)
            t = slug.join(parts)
            yield t, places


def _turned(texts: list[str], pairs: list[dict | None], known: list[Filter]) -> tuple[list[str], list[set[str]]]:
    """Each text by the pairs that it knows, and the strings that have to be looked up: all of it without pairs, else what is new around slugs.

    The texts are looked at together, about BLOCK characters at a time.
    """
    longest = known[0].lengths[-1]
    done, asked, owners, held, size = list(texts), [set() for _ in texts], [], [], 0

    def look() -> None:
        for i, _, _, w in windows(pa.array(held, pa.string()), known):
            asked[owners[i]].add(w)
        owners.clear()
        held.clear()

    for k, (t, own) in enumerate(zip(texts, pairs)):
        first = len(held)
        if own is None:
            held.append(t)
        for done[k], places in _apply_in_turn(t, own or {}):
            held += [done[k][max(0, a - longest + 1) : b + longest - 1] for a, b in places]
        owners += [k] * (len(held) - first)
        size += sum(map(len, held[first:]))
        if size >= BLOCK:
            look()
            size = 0
    look()
    return done, [new - own.keys() if own else new for new, own in zip(asked, pairs)]


def replace_in_turn(texts: DataFrame, entries: DataFrame, text: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``texts`` with every phrase replaced in turn, the longest first, so that a later phrase also finds earlier slugs.

    A text only has to know the phrases that stand in it at some moment. Those of the text itself are found first; they are
    applied in turn, and what may be a phrase around the slugs that this brings in is looked up in the map too, until a
    round finds nothing new. The map has any size: one of FEW_ENTRIES goes to the tasks, which then need no rounds of joins. A null text stays null; of several slugs of a phrase the first by order counts.
    """
    spark = texts.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    known = scratch.keep(_map_of(entries), "entries")
    wanted = filters(known, filter_bytes)
    if not wanted:
        return texts
    n, size = known.agg(F.count(F.lit(1)), F.sum(F.octet_length("phrase") + F.coalesce(F.octet_length("slug"), F.lit(0)))).first()
    if n <= FEW_ENTRIES and size <= FEW_BYTES:
        return _in_turn_by_tasks(texts, dict(map(tuple, known.collect())), text, wanted)
    rows = scratch.keep(texts.withColumn("__row", F.monotonically_increasing_id()), "texts")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text its outcome by the pairs so far, and the strings that have to be looked up."""
        for batch in batches:
            pairs = [dict(p) if p is not None else None for p in batch.column(2).to_pylist()]
            done, asked = _turned(batch.column(1).to_pylist(), pairs, wanted)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string()), pa.array(map(sorted, asked), pa.list_(pa.string()))], ["__row", "out", "asked"])

    state = rows.where(F.col(text).isNotNull()).select("__row", F.col(text).alias("t"), F.lit(None).cast("map<string,string>").alias("pairs"))
    finished, step = None, 0
    while True:
        found = scratch.keep(state.mapInArrow(find, "__row long, out string, asked array<string>"), f"found-{step}")
        own = found.where(F.size("asked") == 0).select("__row", "out")
        finished = own if finished is None else finished.unionByName(own)
        if not found.where(F.size("asked") > 0).limit(1).count():
            break
        asked = found.where(F.size("asked") > 0).select("__row", F.explode("asked").alias("phrase")).join(known, "phrase", "left")
        learnt = asked.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("phrase", "slug"))).alias("learnt"))
        grown = state.join(learnt, "__row").select("__row", "t", F.when(F.col("pairs").isNull(), F.col("learnt")).otherwise(F.map_concat("pairs", "learnt")).alias("pairs"))
        step += 1
        state = scratch.keep(grown, f"state-{step}")
    return rows.join(finished, "__row", "left").select(*[F.col("out").alias(text) if c == text else F.col(c) for c in texts.columns])


def _in_turn_by_tasks(texts: DataFrame, entries: dict[str, str | None], text: str, wanted: list[Filter]) -> DataFrame:
    """``replace_in_turn`` by a map that every task holds."""
    held, place = texts.sparkSession.sparkContext.broadcast(entries), texts.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for whole in batches for s in _slices(whole, place)):
            done = batch.column(place).to_pylist()
            left = [k for k, t in enumerate(done) if t is not None]
            first, pairs = {k: done[k] for k in left}, dict.fromkeys(left)
            while left:
                out, asked = _turned([first[k] for k in left], [pairs[k] for k in left], wanted)
                more = []
                for k, t, new in zip(left, out, asked):
                    done[k] = t
                    learnt = {p: held.value[p] for p in new if p in held.value}
                    if learnt:
                        pairs[k] = (pairs[k] or {}) | learnt
                        more.append(k)
                left = more
            columns = [pa.array(done, pa.string()) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return texts.mapInArrow(run, texts.schema)
