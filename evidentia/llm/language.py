"""Language identification by compression with a dictionary of each language."""

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import prepare

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: ASCII bytes other than letters become blanks; all bytes of other characters stay.
_LETTERS_ONLY = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Limits:
    """Bounds of the sample that is learned from, and of the pieces that texts are judged in."""

    texts: int = 65536
    texts_per_language: int = 256
    #: More labels than there are languages are no languages: they raise.
    languages: int = 8192
    chars_per_text: int = 1024
    piece_bytes: int = 4096
    level: int = 6
    #: Predictions whose smallest size is this near to the second smallest are rejected.
    least_margin: float = 0.02


def normal(text: str) -> bytes:
    """Lower-cased words without digits and ASCII marks, one blank between them."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS_ONLY).split())


def learn(labelled: DataFrame, limits: Limits = Limits()) -> dict[str, bytes]:
    """The dictionary of each language, from (text, lang) without nulls, the most frequent language first.

    Every language gets the beginnings, from their first letter on, of as many different texts with letters as ``limits.texts`` has
    for each language, ``limits.texts_per_language`` at most. They are chosen by the texts' hashes out
    of a share that is derived from the number of different texts. Only these reach the driver: at most 64 MB of letters with
    the default limits, whatever the input. No language is left out; more than ``limits.languages`` labels raise.
    """
    # A text's hash decides, so that copies are chosen together and then count once.
    lettered = F.col("text").rlike(r"\p{L}")
    texts = labelled.withColumn("h", F.xxhash64("text"))
    different = texts.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n"), F.max(lettered.cast("long")).alias("different"))
    counts = different.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("different").alias("different"))
    top = counts.orderBy(F.desc("n"), "lang").limit(limits.languages + 1).collect()
    if len(top) > limits.languages:
        raise ValueError(f"more than {limits.languages} languages")
    each = max(1, min(limits.texts_per_language, limits.texts // max(1, len(top))))
    share = F.pmod("h", F.lit(1 << 30)) * F.col("different") < (1 << 30) * 6.0 * each
    known = labelled.sparkSession.createDataFrame([(r.lang, r.different) for r in top], "lang string, different long")
    beginning = F.regexp_extract("text", rf"(?s)\p{{L}}.{{0,{limits.chars_per_text - 1}}}", 0)
    few = texts.where(lettered).join(F.broadcast(known), "lang").where(share).groupBy("lang", "h").agg(F.min(beginning).alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    rows = few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each)
    found: dict[str, list[bytes]] = {r.lang: [] for r in top}
    for lang, text in rows.select("lang", "text").orderBy("lang", "k").collect():
        found[lang].append(normal(text))
    return {lang: b" ".join(parts) for lang, parts in found.items() if any(parts)}


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes], limits: Limits):
        self.languages, self.limits = list(dictionaries), limits
        self.all = []
        for lang in self.languages:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=limits.level)
            self.all.append(zstandard.ZstdCompressor(
                level=limits.level, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False
            ))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is too narrow; the score is 1 - smallest / second smallest size."""
        if not text or not self.all or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        data, step = normal(text), self.limits.piece_bytes
        pieces = [data[i : i + step] for i in range(0, len(data), step)] or [b""]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.all]
        best = min(sizes)
        rest = sizes.copy()
        rest.remove(best)
        score = 1.0 - best / min(rest) if rest else 1.0
        return self.languages[sizes.index(best)], score, score < self.limits.least_margin


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()
) -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score, rejected.

    Each whole text is cut into pieces of ``limits.piece_bytes``, which are compressed with
    the dictionary of every language; the language of the smallest total is taken, the most
    frequent in training of equals. ``rejected`` marks narrow margins. A null text, or one without any
    letter, is ``und`` with score 0, and so is every text if nothing was learned. Ids are whole numbers; null ids and
    repeated rows are rows like any other; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Compressors(shared.value, limits)
        for batch in batches:
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            langs, scores, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["id", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """Learns from the rows that are not held out, and predicts all: id, held_out, lang_pred, score, rejected.

    A row is held out if crc32 of its id, written in decimal, leaves 2 when divided by 4;
    a row with a null id is not.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    dictionaries = learn(rows.where(~held_out(F.col("id"))).where("text is not null and lang is not null").select("text", "lang"), limits)
    found = identify(rows, dictionaries, "id", "text", limits)
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "rejected")
