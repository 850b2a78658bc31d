"""Session settings, intermediate tables and expressions that the operators share."""

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Rows that one Arrow batch hands to Python; bounds what a task holds at once.
ARROW_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Keeps Arrow batches small, and ships this package to the executors' Python once a session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)
    context = spark.sparkContext
    if not getattr(context, "_evidentia_shipped", False):
        top = Path(__file__).resolve().parents[1]
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for file in sorted(top.rglob("*.py")):
                z.write(file, file.relative_to(top.parent))
        path = os.path.join(tempfile.mkdtemp(), "evidentia.zip")
        Path(path).write_bytes(packed.getvalue())
        context.addPyFile(path)
        context._evidentia_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only for a session that runs on this machine alone.

    Tables in it stay as long as results may read them: removing them is left to whoever owns the folder.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (set_to or "file:///tmp/checkpoints").rstrip("/")


class Scratch:
    """Tables written below the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.top}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. Texts without other letters take the faster built-in function."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: A group is hot if it holds this share of all rows or more: there are at most 1/HOT_SHARE of them.
HOT_SHARE = 1 / 1000


def look_up(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, spread: str) -> DataFrame:
    """Left join of ``rows`` with ``groups``, one row per value of ``keys``, without a hot key.

    ``size`` is the column of ``groups`` with the number of rows that have the key, and
    ``total`` the number of all rows. Hot groups number at most 1 / HOT_SHARE and are
    broadcast; the rows that they serve get a key of their own, so that they spread
    over the tasks of the join with all other groups. ``spread`` is an integer column of rows.
    """
    least = max(2, int(total * HOT_SHARE))
    values = [c for c in groups.columns if c not in keys]
    hot = groups.where(F.col(size) >= least).withColumnsRenamed({c: f"__hot_{c}" for c in values})
    tagged = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    own = [F.when(F.col("__hot"), F.lit(-1)).otherwise(F.lit(0)).alias("__k"),
           F.when(F.col("__hot"), F.xxhash64(spread)).otherwise(F.lit(0)).alias("__s")]
    # Zeros that the optimiser does not know: it would turn the comparison with constants into a condition, and rows would not be dealt by it.
    zero = F.pmod(F.col(size).cast("long"), F.lit(1))
    rest = groups.where(F.col(size) < least).withColumns({"__k": zero.cast("int"), "__s": zero})
    met = tagged.select("*", *own).join(rest, [*keys, "__k", "__s"], "left")
    return met.select(
        *rows.columns, *[F.when(F.col("__hot"), F.col(f"__hot_{c}")).otherwise(F.col(c)).alias(c) for c in values]
    )
