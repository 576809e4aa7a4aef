"""Computing a table once and cutting it from its lineage, in a folder that all executors share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Whether a query's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a checkpoint and rows of a shuffle that a task should have at least; so many tasks stay however few there are.
PART_BYTES, PART_ROWS, LEAST_PARTS = 4 << 20, 1 << 16, 8


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or that was set for checkpoints.

    Only a session within one process gets a folder of its own where none is named; on a cluster that is an error, since
    other machines wouldn't see it.
    """
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master or ""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="kvloom-checkpoint-")


def cut(df: DataFrame, together: bool = False) -> DataFrame:
    """df, written by checkpoint() to the shared folder; the shuffle files of that go at once, as nothing reads them again.

    together: small partitions are read several by a task. AQE doesn't do so for checkpoints, and each task that writes a
    shuffle leaves files of its own.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(FILES_GO, None)
    spark.conf.set(FILES_GO, "true")
    try:
        # a plan of its own takes the setting, and nothing else runs by its shuffles
        made = df.select("*").checkpoint()
    finally:
        spark.conf.unset(FILES_GO) if before is None else spark.conf.set(FILES_GO, before)
    if together:
        rdd = made._jdf.queryExecution().logical().rdd()
        path = spark._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
        size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        made = _in_parts(made, -(-size // PART_BYTES), rdd.getNumPartitions())
    return made


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, made by a shuffle of about so many rows, in fewer partitions where the session's number is far above what they ask for."""
    return _in_parts(df, -(-rows // PART_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _in_parts(df: DataFrame, wanted: int, there: int) -> DataFrame:
    """Whole partitions are put together only where that saves half of them, since it costs their being dealt by a key."""
    wanted = max(wanted, LEAST_PARTS)
    return df.coalesce(wanted) if 2 * wanted <= there else df


def release(spark: SparkSession) -> None:
    """Let the cleaner remove what no table is made from any more: checkpoints, broadcasts, shuffle files."""
    gc.collect()
    spark._jvm.System.gc()
