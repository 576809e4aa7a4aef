"""Making the tables that runs read: filter, dedup, sample, shuffle, random strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .positions import with_position

#: Fixed by the key-file format: the all-ones key ends a file.
SENTINEL = (1 << 64) - 1


def as_pairs(keys: DataFrame, key: str = "key") -> DataFrame:
    """key, value with value equal to key."""
    return keys.select(F.col(key).alias("key"), F.col(key).alias("value"))


def sample_mark(key: Column, fraction: int, seed: int | None) -> Column:
    """Whether a key is of the 1/fraction sample: by its hash, or without a seed by its remainder."""
    return F.lit(True) if fraction == 1 else (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(fraction)) == 0 if seed is not None else F.pmod(key, F.lit(fraction)) == 0)


def sorted_keys(source: DataFrame, fraction: int = 1, key: str = "key", seed: int | None = None) -> DataFrame:
    """Distinct keys below the sentinel, or a sample that is the same at every run, as pairs."""
    kept = source.where(F.col(key).isNotNull() & (F.col(key).cast("decimal(20,0)") != F.lit(str(SENTINEL)).cast("decimal(20,0)")))
    return as_pairs(kept.where(sample_mark(F.col(key), fraction, seed)).dropDuplicates([key]), key)


def shuffled_keys(source: DataFrame, fraction: int = 1, key: str = "key", seed: int = 1) -> DataFrame:
    """Source without its last key, in a random order, the first n / fraction rows; repeated keys stay.

    The order is that of MD5 values of seed and key. It is cut into ranges, and rows are taken by their place in it, so no
    task holds more than its range.
    """
    given = source.where(F.col(key).isNotNull())
    at = given.agg(F.count("*").alias("n"), F.max(key).alias("last")).first()
    if not at["n"]:
        return as_pairs(given, key)
    last = given.where(F.col(key) == F.lit(at["last"])).count()
    rest = given.where(F.col(key) != F.lit(at["last"])).select(key)
    if last > 1:  # one of the rows with the last key goes
        rest = rest.union(given.sparkSession.range(last - 1).select(F.lit(at["last"]).cast(given.schema[key].dataType).alias(key)))
    n = min(at["n"] // fraction, at["n"] - 1)
    text = F.hex(key) if given.schema[key].dataType.typeName() == "binary" else F.col(key).cast("string")
    mixed = rest.withColumn("__mix", F.md5(F.concat(F.lit(f"{seed}|"), text)))
    return as_pairs(with_position(mixed, "__mix", key, name="__at").where(F.col("__at") < n), key)


def random_strings(spark: SparkSession, n: int, salt: str = "") -> DataFrame:
    """n pairs of 16 random bytes, the same at every run, in key order."""
    key = F.unhex(F.md5(F.concat(F.lit(salt), F.col("id").cast("string"))))
    return as_pairs(spark.range(n).select(key.alias("key"))).orderBy("key")


def sample_rows(source: DataFrame, fraction: int, key: str = "key", seed: int | None = 1) -> DataFrame:
    """A sample of the rows of a table, as they are."""
    return source.where(sample_mark(F.col(key), fraction, seed))


def create_input(spark: SparkSession, spec, source: DataFrame | None = None) -> DataFrame:
    """The table that a create_input description asks for."""
    if spec.method == "string":
        return random_strings(spark, spec.num_keys) if source is None else sample_rows(source, spec.fraction_of_keys).orderBy("key")
    if source is None:
        raise ValueError("this method needs a source")
    return sorted_keys(source, spec.fraction_of_keys, seed=1 if spec.fraction_of_keys > 1 else None).orderBy("key") if spec.method == "sosd" else shuffled_keys(source, spec.fraction_of_keys)
