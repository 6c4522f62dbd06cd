"""Shared working tables.

Long jobs cut their lineage by writing Parquet tables below the folder named in ``spark.checkpoint.dir``, which every
executor and the driver can see, so a lost executor costs one stage and not the job. Where the session names none, a local
master gets a temporary folder (tests); any other is told to name one. Operators drop tables that no later plan reads;
what a lazy result still reads stays until the folder is cleared, which is the session's own to do.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch; bounds the memory of a Python worker on tables with very long texts.
BATCH_ROWS = 2_000
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes; the setting has to outlive the call because plans run lazily."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def root(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir of the session, or on a local master a temporary one where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='donorframe-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


class Workspace:
    """A folder of intermediate tables for one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{root(spark)}/donorframe/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return a DataFrame that reads it back."""
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            delete(self.spark, t._workspace_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
