"""Equi-joins that give rows of one side.

The outer forms give each outer row that has a match. The inner forms give, for each outer row that has a match, the
first matching inner row. Duplicate inner keys never multiply a result. Null keys match nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def semi_outer(outer: DataFrame, inner: DataFrame, key: str = "key", hint: str | None = None) -> DataFrame:
    """Rows of outer whose key is in inner. Spark picks the strategy by size and at run time, unless a hint names one."""
    probe = inner.select(key)
    return outer.join(probe.hint(hint) if hint else probe, key, "left_semi")


def semi_inner(outer: DataFrame, inner: DataFrame, key: str = "key") -> DataFrame:
    """Rows of inner whose key is in outer."""
    return inner.join(outer.select(key), key, "left_semi")


def anti_outer(outer: DataFrame, inner: DataFrame, key: str = "key") -> DataFrame:
    """Rows of outer whose key is not in inner (null keys among them)."""
    return outer.join(inner.select(key), key, "left_anti")


def first_of_key(inner: DataFrame, key: str = "key", value: str = "value", order: str | None = None) -> DataFrame:
    """One row for each key: that with the least order column, or the least value; map-side combined."""
    picked = F.min_by(value, F.struct(order, value)) if order else F.min(value)
    return inner.where(F.col(key).isNotNull()).groupBy(key).agg(picked.alias(value))


def first_match_sort(outer: DataFrame, inner: DataFrame, key: str = "key", value: str = "value", unique: bool = False, order: str | None = None) -> DataFrame:
    """For each outer row with a match its first inner row, by merging sorted sides. unique: inner keys don't repeat."""
    first = inner.select(key, value) if unique else first_of_key(inner, key, value, order)
    return outer.select(key).join(first.hint("merge"), key)


def first_match_hash(outer: DataFrame, inner: DataFrame, key: str = "key", value: str = "value", order: str | None = None) -> DataFrame:
    """The same bag by hashing: outer keys are counted first (so a hot outer key is one row), then each inner row repeats."""
    counted = outer.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    hit = first_of_key(inner, key, value, order).hint("shuffle_hash").join(counted, key)
    return hit.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(key, value)


def sorted_output(joined: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """joined in key order."""
    return joined.orderBy(key, value)
