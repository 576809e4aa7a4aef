"""Checks and measures of results: digests that don't depend on row order, counts, key statistics, timing."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def row_digest(df: DataFrame, *columns: str):
    """MD5 of a row: its values as text, joined; nulls as a mark of their own."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns or df.columns]))


def folded_digest(df: DataFrame, *columns: str) -> DataFrame:
    """digest, n: sum and exclusive or of the rows' MD5 values (their first 60 bits), combined map-side, at any size and order."""
    h = F.conv(F.substring(row_digest(df, *columns), 1, 15), 16, 10).cast("long")
    return df.select(h.alias("h")).agg(F.concat_ws(":", F.coalesce(F.bit_xor("h"), F.lit(0)).cast("string"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string")).alias("digest"), F.count("*").alias("n"))


def key_counts(df: DataFrame, key: str = "key") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def key_range(df: DataFrame, key: str = "key") -> DataFrame:
    return df.agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count("*").alias("n"), F.count_distinct(key).alias("n_keys"))


def timed(df: DataFrame) -> dict:
    """Wall-clock seconds and nanoseconds of computing all of df, and its rows; all work is inside the measure."""
    seen = F.count(F.lit(1)).alias("n")
    from pyspark.sql import Observation

    watch = Observation()
    start = time.perf_counter_ns()
    df.observe(watch, seen).write.format("noop").mode("overwrite").save()
    took = time.perf_counter_ns() - start
    return {"duration_ns": took, "duration_sec": took / 1e9, "num_output_keys": watch.get["n"]}


_COUNTERS = ("inputBytes", "inputRecords", "outputBytes", "outputRecords", "shuffleReadBytes", "shuffleWriteBytes", "memoryBytesSpilled", "diskBytesSpilled")


def io_counters(spark: SparkSession) -> dict[str, int]:
    """Bytes and rows that all stages of the application have read, written, shuffled and spilled so far."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    total, each = dict.fromkeys(_COUNTERS, 0), stages.iterator()
    while each.hasNext():
        stage = each.next()
        for c in _COUNTERS:
            total[c] += getattr(stage, c)()
    return total
