"""Token counts of the documents in flat, unindexed token files, by a separator scan."""

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, prepare

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's makers split text before merging. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_DOCUMENT = 50256
BLOCK_TOKENS = 1 << 16
#: Blocks whose sums are scanned together; their totals are scanned in turn.
BLOCKS_PER_GROUP = 1024
#: Neighbouring blocks of a file that go to one task.
BLOCKS_PER_READ = 64



def _opens(path: str) -> bool:
    """Whether tasks can read ranges of the file themselves."""
    from pyarrow import fs

    try:
        source, name = fs.FileSystem.from_uri(path)
        return source.get_file_info(name).is_file
    except (OSError, ValueError, NotImplementedError):
        return False


def file_blocks(spark: SparkSession, path: str, dtype: str = "uint16", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(shard, block, content) of flat token files: each file is cut into blocks of ``block_tokens``.

    A file's bytes must be whole little-endian tokens of ``dtype``. Spark lists the files with their lengths and deals the
    blocks out, and each task reads the ranges of its own blocks, so files of any size are spread over all tasks. Where
    only Spark itself can open the files, it reads them whole, and refuses files of 2 GB or more.
    """
    size = np.dtype(dtype).itemsize
    step = size * block_tokens
    prepare(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    odd = F.raise_error(F.concat(F.lit("not a whole number of tokens: "), F.col("path"))).cast("long")
    files = files.withColumn("length", F.when(F.col("length") % size == 0, F.col("length")).otherwise(odd))
    first = files.select("path").head()
    ranged = first is not None and _opens(first.path)
    last = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("length") / step) - 1)
    blocks = files.select(F.col("path").alias("shard"), "length", *([] if ranged else ["content"]), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    if not ranged:
        return blocks.select("shard", "block", F.substring("content", F.col("block").cast("int") * step + 1, F.lit(step)).alias("content"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name, source = None, None
        for batch in batches:
            for shard, length, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != name:
                    system, inner = fs.FileSystem.from_uri(shard)
                    name, source = shard, system.open_input_file(inner)
                content = source.read_at(min(step, length - block * step), block * step) if length else b""
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([block]), pa.array([content], pa.binary())], ["shard", "block", "content"])

    dealt = blocks.repartition("shard", F.floor(F.col("block") / BLOCKS_PER_READ)).select("shard", "length", "block")
    return dealt.mapInArrow(read, "shard string, block long, content binary")


def load_ranks(spark: SparkSession, vocabulary: str) -> dict[bytes, int]:
    """A vocabulary's ranks, read by the driver alone unless its path is one of Spark's."""
    if "://" in vocabulary:
        lines = [r.value for r in spark.read.text(vocabulary).collect()]
    else:
        with open(vocabulary) as f:
            lines = f.read().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}


def token_blocks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """(shard, block, content, before, labels): texts tokenised one after another into flat uint16 files, one per partition.

    Each text is followed by the end-of-document token; its string in a text is ordinary text.
    Nothing in the content says where a text begins. Beside it, ``labels`` holds the ids whose
    end lies in the block, in order, and ``before`` how many end in earlier blocks of the shard.
    """
    spark = docs.sparkSession
    prepare(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(spark, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        shard = f"partition-{TaskContext.get().partitionId():06d}"
        held, labels, number, before = np.zeros(0, dtype=np.uint16), [], 0, 0

        def block(content: np.ndarray) -> pa.RecordBatch:
            nonlocal before
            inside = int((content == END_OF_DOCUMENT).sum())
            own, labels[:] = labels[:inside], labels[inside:]
            before += inside
            return pa.RecordBatch.from_arrays(
                [pa.array([shard]), pa.array([number]), pa.array([content.tobytes()], pa.binary()), pa.array([before - inside]), pa.array([own], pa.list_(pa.int64()))],
                ["shard", "block", "content", "before", "labels"],
            )

        for batch in batches:
            parts = [held]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.append(np.array([*encoding.encode_ordinary(text or ""), END_OF_DOCUMENT], dtype=np.uint16))
                labels.append(key)
            held = np.concatenate(parts)
            while len(held) >= block_tokens:
                yield block(held[:block_tokens])
                held, number = held[block_tokens:], number + 1
        if len(held):
            yield block(held)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "shard string, block long, content binary, before long, labels array<long>")


def scan(blocks: DataFrame, dtype: str = "uint16", separator: int = END_OF_DOCUMENT) -> DataFrame:
    """(shard, block, n, ends): of each block its tokens, and where in it separators stand."""
    prepare(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(c.as_buffer(), dtype=dtype) for c in batch.column(2)]
            ends = [np.flatnonzero(t == separator).astype(np.int32) for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(t) for t in tokens], pa.int64()), pa.array(ends, pa.list_(pa.int32()))],
                ["shard", "block", "n", "ends"],
            )

    return blocks.select("shard", "block", "content").mapInArrow(run, "shard string, block long, n long, ends array<int>")


def stitch(scanned: DataFrame, scratch: Scratch) -> DataFrame:
    """(shard, ordinal, n_tokens, ended) of every document, in whichever blocks it lies.

    An exclusive prefix scan over the blocks of a shard gives each block where it starts, how many
    separators stand before it, and where the last of these stands. The scan has two
    levels: within groups of BLOCKS_PER_GROUP blocks, and over the groups' totals, so that
    no task holds more of a shard than that.
    """
    rows = scratch.keep(scanned.withColumn("group", F.floor(F.col("block") / BLOCKS_PER_GROUP)), "scanned")
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1).cast("long"))
    inner = Window.partitionBy("shard", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("shard").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    inside = (
        rows.withColumn("start", F.coalesce(F.sum("n").over(inner), zero))
        .withColumn("before", F.coalesce(F.sum(F.size("ends")).over(inner), zero))
        .withColumn("last", F.col("start") + last)
        .withColumn("previous", F.max("last").over(inner))
    )
    totals = inside.groupBy("shard", "group").agg(
        F.sum("n").alias("n"), F.sum(F.size("ends")).alias("ends"), F.max("last").alias("last")
    )
    base = (
        totals.withColumn("g_start", F.coalesce(F.sum("n").over(outer), zero))
        .withColumn("g_before", F.coalesce(F.sum("ends").over(outer), zero))
        .withColumn("g_previous", F.max(F.col("g_start") + F.col("last")).over(outer))
        .select("shard", "group", "g_start", "g_before", "g_previous")
    )
    placed = inside.join(base, ["shard", "group"]).select(
        "shard", (F.col("g_start") + F.col("start")).alias("start"), (F.col("g_before") + F.col("before")).alias("before"), "n",
        F.coalesce(F.col("g_start") + F.col("previous"), "g_previous", F.lit(-1).cast("long")).alias("previous"), "ends",
    )
    stops = F.transform("ends", lambda e: F.col("start") + e)
    froms = F.concat(F.array("previous"), F.slice(stops, 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    ended = placed.where(F.size("ends") > 0).select(
        "shard", "before", F.posexplode(F.zip_with(stops, froms, lambda a, b: a - b - 1)).alias("k", "n_tokens")
    ).select("shard", (F.col("before") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    # What follows a shard's last separator is a document without an end.
    whole = placed.groupBy("shard").agg(
        F.max(F.col("start") + F.col("n")).alias("size"), F.sum(F.size("ends")).alias("ordinal"),
        F.max(F.col("start") + last).alias("last"),
    )
    tail = whole.select(
        "shard", "ordinal", (F.col("size") - 1 - F.coalesce("last", F.lit(-1).cast("long"))).alias("n_tokens"),
        F.lit(False).alias("ended"),
    ).where("n_tokens > 0")
    return ended.unionByName(tail)


def count_file_tokens(spark: SparkSession, path: str, dtype: str = "uint16", separator: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(shard, ordinal, n_tokens, ended) of every document of flat token files below ``path``.

    A document is what stands before a separator, possibly nothing; the tokens after a file's last
    separator are one document more, with ``ended`` false. An empty file has none.
    """
    return stitch(scan(file_blocks(spark, path, dtype, block_tokens), dtype, separator), Scratch(spark))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, shard, ordinal, counted from the flat files that it makes of them.

    Spark has no sink for raw bytes, so the files are written as tables of their blocks. The scan reads shard, block and content alone; ids, written beside
    the blocks, meet the counts by shard and ordinal.

    A null or empty text has no tokens. Ids are whole numbers; null ids and repeated rows are documents like any
    other; other columns are ignored; no rows, no result.
    """
    scratch = Scratch(docs.sparkSession)
    blocks = scratch.keep(token_blocks(docs, id_col, text_col, vocabulary, block_tokens), "blocks")
    found = stitch(scan(blocks.select("shard", "block", "content")), scratch)
    ids = blocks.where(F.size("labels") > 0).select("shard", "before", F.posexplode("labels").alias("k", "label"))
    ids = ids.select("shard", (F.col("before") + F.col("k")).alias("ordinal"), F.col("label").alias(id_col))
    return found.join(ids, ["shard", "ordinal"]).select(id_col, "n_tokens", "shard", "ordinal")
