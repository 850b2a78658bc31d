"""Tables between the steps of an operator, and this package on the executors."""

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows that one Arrow batch hands to Python; bounds what a task holds at once.
ARROW_ROWS = 2000


def prepare(spark: SparkSession) -> None:
    """Keeps Arrow batches small, and ships this package to the executors' Python once a session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)
    context = spark.sparkContext
    if not getattr(context, "_evidentia_shipped", False):
        top = Path(__file__).resolve().parent
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for file in sorted(top.rglob("*.py")):
                z.write(file, file.relative_to(top.parent))
        folder = tempfile.mkdtemp()  # the driver serves the file from here until it ends
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "evidentia.zip")
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
