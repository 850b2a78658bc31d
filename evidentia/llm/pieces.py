"""SentencePiece encoding by forward filtering and backward sampling, and decoding."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice import Pieces, Table, join, sample
from .shared import prepare
from .textkit import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are segmented at once, unless one text is longer.
GROUP_BYTES = 4 << 20


def _groups(texts: list[bytes]) -> Iterator[slice]:
    first, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > GROUP_BYTES:
            yield slice(first, k)
            first, held = k, 0
        held += len(t)
    yield slice(first, len(texts))


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL, seed: int = 0, theta: float = 1.0
) -> DataFrame:
    """One row per row of ``docs``: id, pieces (array of ids), n_pieces, lossless.

    Forward filtering sums the weights of all segmentations of every prefix; backward
    sampling then draws one segmentation of the whole text from the end, in proportion
    to the product of its pieces' weights, (1 + rank) ** -theta, whatever the text's length. Draws come from ``seed`` and
    the row's id alone, so results repeat whatever the partitions, and equal texts of
    different ids get draws of their own. Characters without a piece are spelled by bytes.
    The model is read by the driver and sent to the tasks.

    Ids are whole numbers. Every text is decoded again; ``lossless`` says that it came back unchanged. A null text
    has null pieces and n_pieces 0; an empty one has no pieces. A null id has a seed of its
    own. Repeated rows have the same draw. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(Pieces.load(model_path, theta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in batches:
            ids = batch.column(0)
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            keys = ids.fill_null(-(1 << 62)).to_numpy(zero_copy_only=False).view(np.uint64)
            seeds = mix(mix(keys) + np.uint64(seed % (1 << 64)))
            full = [t or b"" for t in texts]
            for part in _groups(full):
                found = sample(full[part], seeds[part], table)
                same = [join(f, table.pieces) == t for f, t in zip(found, full[part], strict=True)]
                empty = np.array([t is None for t in texts[part]], dtype=bool)
                cuts = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
                flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat), mask=pa.array(empty))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(part.start, len(found)), lists, pa.array(np.diff(cuts).astype(np.int64)), pa.array(same, pa.bool_())],
                    ["id", "pieces", "n_pieces", "lossless"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, pieces array<int>, n_pieces long, lossless boolean").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", pieces_col: str = "pieces", model_path: str = MODEL) -> DataFrame:
    """One row per row of ``encoded``: id, text. Null pieces give a null text."""
    spark = encoded.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(Pieces.load(model_path).texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if x is None else b"".join(map(shared.value.__getitem__, x))[1:].decode() for x in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(pieces_col).alias("pieces"))
    return rows.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
