"""SimHash fingerprints, and links within a radius by covering locality-sensitive hashing."""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import Scratch, look_up, prepare
from .textkit import Block, blocks, spaced_words

BITS = 64
#: Of each byte, its bits as eight counters of a byte each.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def _shingle_hashes(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 with seed 42 of every shingle of a block, and how many each text has."""
    data = block.data.copy()
    data[(data == 0x20) | ((data >= 0x09) & (data <= 0x0D))] = 0x20
    raw = data.tobytes()
    one_blank = np.ones(len(block.starts), dtype=bool)
    one_blank[:-1] = block.starts[1:] - block.ends[:-1] == 1
    digest, out, counts = xxhash.xxh64_intdigest, [], np.zeros(block.n, dtype=np.int64)
    for k in range(block.n):
        a, b = int(block.bounds[k]), int(block.bounds[k + 1])
        if a == b:
            continue
        text, starts, ends = raw, block.starts[a:b], block.ends[a:b]
        if not one_blank[a : b - 1].all():
            words = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            text, ends = b" ".join(words), np.cumsum(ends - starts + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
        if b - a > size:
            starts, ends = starts[: 1 - size or None], ends[size - 1 :]
        else:
            starts, ends = starts[:1], ends[-1:]
        out += [digest(text[s:e], 42) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        counts[k] = len(starts)
    return np.array(out, dtype=np.uint64), counts


def fingerprints(column: pa.Array, size: int) -> np.ndarray:
    """One unsigned fingerprint per text: a bit is 1 if set in over half the shingles' hashes."""
    found = np.zeros(len(column), dtype=np.uint64)
    for block in blocks(column, spaced_words(), lower=True):
        hashes, counts = _shingle_hashes(block, size)
        full = np.flatnonzero(counts)
        if not len(full):
            continue
        # Counters of a byte hold sums of 255 rows; longer texts are summed in parts.
        parts = -(-counts[full] // 255)
        first = np.cumsum(counts[full]) - counts[full]
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        cuts = np.repeat(first, parts) + 255 * within
        lanes = np.add.reduceat(_LANES[hashes.view(np.uint8).reshape(-1, 8)], cuts, axis=0)
        bits = np.add.reduceat(lanes.view(np.uint8).reshape(-1, BITS), np.cumsum(parts) - parts, axis=0, dtype=np.int64)
        major = (2 * bits > counts[full][:, None]).astype(np.uint8)
        found[block.first + full] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return found


def covering_masks(radius: int) -> list[int]:
    """Masks such that any ``radius`` bits are all outside at least one of them.

    Bit i gets a non-zero vector of radius + 1 bits; mask v holds the bits whose vector
    has an odd product with v. ``radius`` vectors leave a non-zero v orthogonal to all.
    """
    most = (1 << (radius + 1)) - 1
    vectors = [1 + i % most for i in range(BITS)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, most + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that join all nodes whose fingerprints differ in ``radius`` bits or fewer.

    ``nodes`` has node and fp, each fp once. Every pair within the radius falls into
    one bucket of some covering table. Within a bucket no pairs are made: each member
    lists the points at half the radius that differ from it outside the mask only, and
    two members share such a point exactly if they are within the radius. The few
    members around a point (65 for radius 2) are joined to the least of them.
    """
    if radius % 2:
        raise ValueError("the radius is even")
    tables = nodes.select(
        "node", "fp",
        F.explode(F.array(*[
            F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))
            for t, mask in enumerate(covering_masks(radius))
        ])).alias("x"),
    ).select("node", "fp", "x.t", "x.key")
    crowded = tables.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    flips = []
    for mask in covering_masks(radius):
        free = [i for i in range(BITS) if not mask >> i & 1]
        flips.append([_signed(sum(1 << i for i in c)) for r in range(radius // 2 + 1) for c in combinations(free, r)])
    around = F.array(*[F.array(*map(F.lit, x)) for x in flips])
    points = tables.join(crowded, ["t", "key"]).select(
        "node", F.explode(F.transform(F.get(around, "t"), lambda x: x.bitwiseXOR(F.col("fp")))).alias("point")
    )
    met = points.groupBy("point").agg(F.collect_set("node").alias("nodes")).where(F.size("nodes") > 1)
    return met.select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).where("a != b").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    Words are runs of characters other than the six ASCII blanks, after lower-casing
    A-Z; shingles of ``shingle`` words keep their repeats, and a shorter text is one
    shingle. A text without words, or null, has fingerprint zero and links like any
    other. Fingerprints link at ``radius`` or fewer differing bits; component_id is the
    smallest id reachable. A node of the graph is a fingerprint, so copies cost nothing, and
    rows are joined through their fingerprints alone: those that share an id and not a fingerprint are joined only if these
    are linked, and rows with a null id link like any other. component_id is null where a component has no id at
    all. Ids are whole numbers. Repeated rows give repeated results. Other columns are ignored; no rows, no result.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(batch.column(1), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["id", "fp"])

    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = scratch.keep(ids.mapInArrow(run, "id long, fp long"), "fingerprints")
    total = rows.count()
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    nodes = scratch.keep(nodes, "nodes")
    named = components(near_links(nodes.select(F.col("fp").alias("node"), "fp"), radius), scratch)
    owned = nodes.join(named, nodes["fp"] == named["node"], "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("c"))
    owned = scratch.keep(owned, "owned")
    firsts = owned.groupBy("c").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    groups = look_up(owned, firsts, ["c"], "size", total, "fp").select("fp", "n", "component_id")
    found = look_up(rows, groups, ["fp"], "n", total, "id")
    return found.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
