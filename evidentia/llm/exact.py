"""Exact deduplication by skew-safe combining."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, look_up


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the largest id of equal
    texts stays. Three stages, each grouping on digest *and* full content, so that
    texts whose digests collide stay apart: within each input partition (the
    aggregation's map side; the salt is the partition's), per digest and salt, and
    per digest over the salts' winners. A group of any size thus reaches the last
    stage as ``salts`` rows at most. On the way back look_up() keeps hot groups apart.

    A null text counts as empty. Rows with a null id take part with their text; a
    group of null ids alone has a null keep_id and keeps all its rows. Rows that
    share the largest id of a group are one document, and all are kept. Other
    columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    text = F.coalesce(ascii_lower(F.col(text_col)), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("norm"))
    # Two digests and the length stand for the content where no text travels.
    digest = [F.unhex(F.sha2("norm", 256)).alias("sha"), F.xxhash64("norm").alias("xx"), F.octet_length("norm").alias("size")]
    names = ["sha", "xx", "size"]

    salted = (
        keyed.select("id", "norm", *digest, (F.spark_partition_id() % salts).alias("salt"))
        .groupBy(*names, "norm", "salt")
        .agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    )
    groups = salted.groupBy(*names, "norm").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size")).drop("norm")

    found = look_up(keyed.select("id", *digest), groups, names, "group_size", docs.count(), "id")
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
