"""Any table as pairs of key and value, and reading and writing of such tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import register, to_single_file


def pairs(df: DataFrame, key: str | Column, value: str | Column) -> DataFrame:
    """key, value; no other column is read."""
    key, value = (F.col(c) if isinstance(c, str) else c for c in (key, value))
    return df.select(key.alias("key"), value.alias("value"))


def read_table(spark: SparkSession, path: str, key_type: str = "uint64", load_in_mem: bool = False) -> DataFrame:
    """A table of key and value: a Parquet path, or a binary table (.kv) or key file (.keys, with value equal to key).

    Unsigned keys of binary files are decimals, so that keys from 2**63 on keep their value and order ("int64" reads them as
    longs, and fails on such a key).
    """
    kind = {"str": "binary", "int64": "long"}.get(key_type, "uint64")
    if path.rstrip("/").endswith((".kv", ".keys")):
        register(spark)
        df = spark.read.format("kvtable" if path.rstrip("/").endswith(".kv") else "keyfile").option("keyType", kind).load(path)
        df = df if "value" in df.columns else df.withColumn("value", F.col("key"))
    else:
        df = spark.read.parquet(path)
    return df.cache() if load_in_mem else df


def write_table(df: DataFrame, path: str, key_size: int = 8, value_size: int = 8, single: bool = False) -> None:
    """df as a table at path; single: by one task, and for a binary table as one file instead of a folder of parts."""
    df = df.coalesce(1) if single else df
    if path.rstrip("/").endswith(".kv"):
        register(df.sparkSession)
        df.select("key", "value").write.format("kvtable").mode("overwrite").option("keySize", key_size).option("valueSize", value_size).save(path)
        if single:
            to_single_file(path)
    elif path.rstrip("/").endswith(".keys"):
        register(df.sparkSession)
        df.select("key").write.format("keyfile").mode("overwrite").save(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "key") -> DataFrame:
    """df as a table in buckets of its key, sorted within: joins of such tables on the key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)
