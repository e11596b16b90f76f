"""Shared scratch space and size-checked broadcasts.

Intermediate tables go to the folder that the session names in
``spark.checkpoint.dir``; every executor and the driver can read it, so a lost
executor costs only its running tasks.  Only where the setting is absent and the
master is local (tests) a temporary folder is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most a few longs each that may be broadcast (about 40 MB as a hash table).
BROADCAST_ROWS = 500_000
#: Rows of a few numbers each that a partition of a checkpoint or written table is worth, and the partitions that stay however few rows there are.
PART_ROWS, LEAST_PARTS = 20_000, 16
#: Bytes of an Arrow batch, about.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the Arrow batches that workers get, unless the session has a lower bound: texts may be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; also makes sure ``checkpoint()`` has one."""
    bounded_batches(spark)
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(base)
        return base.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="strandflow-")
    sc.setCheckpointDir(made)
    return made


class Workspace:
    """A folder of written tables under the shared folder, removed by ``close``."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back: cuts lineage, survives lost executors."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def finish(self, df: DataFrame) -> DataFrame:
        """Checkpoint a result of a few numbers a row, then drop the written tables."""
        shared_dir(self.spark)
        out = df.checkpoint()
        self.close()
        return out


def fewer(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` rows of a few numbers, in no more partitions than these are worth.

    A small table would else be written in as many files as shuffles have partitions.  Each file costs the driver a task to
    remember, and in a local folder several processes that set permissions, for a moment as large as the JVM that starts them.
    """
    return df.coalesce(max(LEAST_PARTS, -(-rows // PART_ROWS)))


def bounded_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only if ``df`` (already written or checkpointed) has at most ``most`` rows.

    Beyond that Spark joins by shuffle, so nothing that grows is ever sent whole.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def column_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until ``df`` has no such column (any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
