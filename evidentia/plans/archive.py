"""An archive of cases: versions, the blobs beside them, and a log of commits that says which of them count.

A commit writes its tables first, and then creates the next entry of the log, which only one writer can. Readers take
the entries that are there, so they see whole commits, and a writer that fails between its writes leaves nothing to be seen.
"""

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.numbering import numbered

CASE_ID = r"^[a-z0-9][a-z0-9-]{0,63}$"
VERSIONS = "case_id string, version string, saved_at timestamp, state string, blobs array<string>"
BLOBS = "case_id string, blob string, content binary"
_DIGITS = 12


class Conflict(Exception):
    """Another writer has committed since the snapshot that this one read."""


class _Log:
    """Numbered entries of a folder, each created once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.top = spark, f"{path.rstrip('/')}/log"
        self.jvm = spark.sparkContext._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.top).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}")

    def last(self) -> int:
        if not self.fs.exists(self._path("")):
            return 0
        return max([0, *(int(x.getPath().getName()[:_DIGITS]) for x in self.fs.listStatus(self._path("")) if x.getPath().getName().endswith(".json"))])

    def create(self, number: int, entry: dict) -> bool:
        """False if the number is taken."""
        try:
            out = self.fs.create(self._path(f"{number:0{_DIGITS}d}.json"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return True

    def entries(self, upto: int | None = None) -> DataFrame:
        """(number, kind, data) from the last compaction on; an entry that is still being written is none."""
        number = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long").alias("number")
        read = self.spark.read.schema("kind string, data string").json(self.top).select(number, "kind", "data").where("data is not null")
        read = read.where(F.col("number") <= upto) if upto is not None else read
        start = read.where("kind = 'compact'").agg(F.coalesce(F.max("number"), F.lit(0)).alias("start"))
        return read.crossJoin(F.broadcast(start)).where("number >= start").drop("start")


def _commit(spark: SparkSession, path: str, kind: str, tables: dict[str, DataFrame], base: int | None) -> int:
    data, log = uuid.uuid4().hex, _Log(spark, path)
    for name, df in tables.items():
        df.withColumn("data", F.lit(data)).write.parquet(f"{path.rstrip('/')}/data/{data}/{name}")
    number = (log.last() if base is None else base) + 1
    while not log.create(number, {"kind": kind, "data": data}):
        if base is not None:
            raise Conflict(f"commit {number} is there already")
        number += 1
    return number


def save_version(case: DataFrame, blobs: DataFrame, path: str, base: int | None = None) -> int:
    """Commits rows (case_id, version, saved_at, state, blobs) and blobs (case_id, blob, content) at once; returns the commit's number.

    A version that is there already is replaced. Bad case ids are refused. ``base`` is the snapshot that the writer has read: if another commit
    came in between, this one is a Conflict. Without it the commit comes after whatever there is.
    """
    if case.where(~F.col("case_id").rlike(CASE_ID)).limit(1).count():
        raise ValueError("a case id has lower-case letters, digits and dashes, 64 at most")
    return _commit(case.sparkSession, path, "save", {"versions": case, "blobs": blobs}, base)


def delete_cases(cases: DataFrame, path: str, base: int | None = None) -> int:
    """Commits that cases (case_id) are gone, with all their versions and blobs; they may be saved anew."""
    return _commit(cases.sparkSession, path, "delete", {"gone": cases.select("case_id").distinct()}, base)


def last_commit(spark: SparkSession, path: str) -> int:
    return _Log(spark, path).last()


def _rows(spark: SparkSession, path: str, name: str, schema: str, upto: int | None) -> DataFrame:
    """Rows of one table with the number of their commit, without those of cases that were deleted later."""
    entries = _Log(spark, path).entries(upto)
    top = f"{path.rstrip('/')}/data/*"
    every = spark.read.option("ignoreMissingFiles", "true")
    known = every.schema(f"{schema}, data string").parquet(f"{top}/{name}") if _any(spark, f"{top}/{name}") else spark.createDataFrame([], f"{schema}, data string")
    numbered_ = known.join(F.broadcast(entries.select("data", "number")), "data")  # a row for each commit since the last compaction
    if not _any(spark, f"{top}/gone"):
        return numbered_.drop("data")
    gone = every.schema("case_id string, data string").parquet(f"{top}/gone").join(F.broadcast(entries.select("data", F.col("number").alias("__gone"))), "data")
    last = gone.groupBy("case_id").agg(F.max("__gone").alias("__gone"))
    left = numbered_.join(last, "case_id", "left").where(F.col("__gone").isNull() | (F.col("__gone") < F.col("number")))
    return left.drop("__gone", "data")


def _any(spark: SparkSession, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    others = [c for c in rows.columns if c not in (*keys, "number")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "number").alias("v")).select(*keys, "v.*")


def versions(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The versions that count, after all commits or after the commit ``upto``."""
    return _latest(_rows(spark, path, "versions", VERSIONS, upto), ["case_id", "version"])


def stored_blobs(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    return _latest(_rows(spark, path, "blobs", BLOBS, upto), ["case_id", "blob"])


def compact(spark: SparkSession, path: str) -> int:
    """Writes what counts as one commit, from which readers start; a Conflict if another writer comes in between.

    Tables of earlier commits stay for those who still read them.
    """
    base = last_commit(spark, path)
    return _commit(spark, path, "compact", {"versions": versions(spark, path, base), "blobs": stored_blobs(spark, path, base)}, base)


def current(all_versions: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Of each case the chosen version (case_id, version) if it is there, else the last."""
    rows = all_versions
    if chosen is not None:
        rows = rows.join(chosen.withColumn("__chosen", F.lit(1)), ["case_id", "version"], "left")
    else:
        rows = rows.withColumn("__chosen", F.lit(None).cast("int"))
    others = [c for c in all_versions.columns if c != "case_id"]
    best = rows.groupBy("case_id").agg(F.max_by(F.struct(*others), F.struct(F.coalesce("__chosen", F.lit(0)), "version")).alias("v"))
    return best.select("case_id", "v.*")


def with_blobs(cases: DataFrame, blobs: DataFrame) -> DataFrame:
    """(case_id, version, blob, content); a blob that is named but not there is an error."""
    named = cases.select("case_id", "version", F.explode("blobs").alias("blob"))
    met = named.join(blobs.dropDuplicates(["case_id", "blob"]), ["case_id", "blob"], "left")
    gone = F.raise_error(F.concat(F.lit("missing blob "), "blob")).cast("binary")
    return met.withColumn("content", F.when(F.col("content").isNull(), gone).otherwise(F.col("content")))


def listing(all_versions: DataFrame) -> DataFrame:
    """Cases with their number of versions and their rank, the newest first."""
    found = all_versions.groupBy("case_id").agg(F.count(F.lit(1)).alias("versions"), F.max("saved_at").alias("updated_at"))
    return numbered(found, [], [F.desc("updated_at"), F.asc("case_id")], "rank")
