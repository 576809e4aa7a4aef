"""Joins that are co-partitioned by a model of the keys' distribution, and statistics of its buckets.

The cut points of the buckets come from an approximate summary of all keys. Rows of both sides go to the partition of their
bucket in one exchange (the number of the partition is the bucket's, not a hash), are sorted there, and meet in one pass over
each partition. Outer rows whose key is outside of what their bucket holds of the inner side are dropped before they move.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import first_of_key


def quantile_cuts(df: DataFrame, buckets: int, key: str = "key", accuracy: int = 10_000) -> list:
    """At most buckets - 1 cut points from an approximate, mergeable summary of all keys."""
    return sorted(set(_quantiles(df, buckets, key, accuracy)))


def _quantiles(df: DataFrame, buckets: int, key: str, accuracy: int = 10_000) -> list:
    if buckets < 2:
        return []
    at = [i / buckets for i in range(1, buckets)]
    return sorted(df.agg(F.percentile_approx(key, at, accuracy).alias("q")).first()["q"] or [])


def cdf_bucket(key: Column, cuts: list) -> Column:
    """How many cut points are at or below the key, by halves; the expression is as long for many cut points as for few."""
    if not cuts:
        return F.lit(0)
    held, steps = F.lit(list(cuts)), [1 << k for k in reversed(range(len(cuts).bit_length()))]

    def ahead(found: Column, step: Column) -> Column:
        # beyond the last cut point, get gives null
        return F.when(key >= F.get(held, found + step - 1), found + step).otherwise(found)

    return F.aggregate(F.lit(steps), F.lit(0), ahead)


@dataclass
class Buckets:
    """Cut points, and how many partitions each bucket has: more than one where a single key holds several quantiles."""

    cuts: list
    width: list[int]

    @classmethod
    def of(cls, df: DataFrame, buckets: int, key: str = "key", spread: bool = True) -> Buckets:
        got = _quantiles(df, buckets, key)
        cuts = sorted(set(got))
        return cls(cuts, [1] + [got.count(c) if spread else 1 for c in cuts])

    @property
    def parts(self) -> int:
        return sum(self.width)

    def first(self, bucket: Column) -> Column:
        """The first partition of a bucket."""
        return F.element_at(F.lit([int(x) for x in np.cumsum([0, *self.width[:-1]])]), bucket + 1)

    def widths(self, bucket: Column) -> Column:
        return F.element_at(F.lit([int(x) for x in self.width]), bucket + 1)


def within_buckets(df: DataFrame, other: DataFrame, buckets: Buckets, key: str) -> DataFrame:
    """Rows of df with a key that lies between the least and greatest key of its bucket in other."""
    per = other.groupBy(cdf_bucket(F.col(key), buckets.cuts).alias("__b")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    held = {r["__b"]: (r["lo"], r["hi"]) for r in per.where("lo is not null").collect()}  # one row a bucket
    given = df.withColumn("__b", cdf_bucket(F.col(key), buckets.cuts))
    if not held:
        return given.where(F.lit(False))
    # a lookup names the bucket twice; a condition for each bucket would hold its expression as often as there are buckets
    kind, at = other.schema[key].dataType.simpleString(), F.col("__b") + 1
    lo, hi = (F.element_at(F.lit([held.get(b, (None, None))[i] for b in range(len(buckets.cuts) + 1)]).cast(f"array<{kind}>"), at) for i in (0, 1))
    return given.where(F.col(key).between(lo, hi))


def _meet(outer: DataFrame, inner: DataFrame, buckets: Buckets, key: str, carried: str | None) -> DataFrame:
    """Rows of outer whose key is in inner (distinct keys), in key order within buckets; with inner's column `carried`, if named."""
    columns = outer.columns
    left = within_buckets(outer.where(F.col(key).isNotNull()), inner, buckets, key)
    right = inner.where(F.col(key).isNotNull()).withColumn("__b", cdf_bucket(F.col(key), buckets.cuts))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), buckets.widths(F.col("__b")).cast("long")).cast("int")
    held = outer.schema[carried].dataType if carried in columns else inner.schema[carried].dataType if carried else "int"
    left = left.select(*columns, F.lit(None).cast(held).alias("__held"), F.lit(1).alias("__src"), (buckets.first(F.col("__b")) + spread).alias("__p"))
    copies = F.explode(F.sequence(F.lit(0), buckets.widths(F.col("__b")) - 1))
    right = right.select(*[F.col(key) if c == key else F.lit(None).cast(outer.schema[c].dataType).alias(c) for c in columns], (F.col(carried) if carried else F.lit(None).cast("int")).cast(held).alias("__held"), F.lit(0).alias("__src"), "__b", copies.alias("__copy"))
    right = right.select(*columns, "__held", "__src", (buckets.first(F.col("__b")) + F.col("__copy")).alias("__p"))
    both = left.union(right).repartitionById(buckets.parts, F.col("__p").cast("int"))
    # one partition holds one __p, so the window has no exchange of its own; an inner row is the first of its key
    rows = Window.partitionBy("__p", key).orderBy("__src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = [F.first(c).over(rows).alias(c) for c in ("__held", "__src")]
    met = both.select(*columns, F.col("__src").alias("__own"), *first).where("__own = 1 and __src = 0")
    return met.select(*columns, *["__held"] * bool(carried))


def even_bucket(key: Column, buckets: int, least: int, most: int) -> Column:
    """The bucket by a straight line from the least to the greatest key."""
    line = F.floor((key - F.lit(least)) * F.lit(buckets) / F.lit(most - least + 1))
    return F.least(F.greatest(line, F.lit(0)), F.lit(buckets - 1)).cast("long")


def bucketed_semi(outer: DataFrame, inner: DataFrame, buckets: Buckets, key: str = "key") -> DataFrame:
    """Rows of outer whose key is in inner, joined in the partitions of the buckets. Null keys match nothing."""
    return _meet(outer, inner.select(key).distinct(), buckets, key, None)


def bucketed_first_match(outer: DataFrame, inner: DataFrame, buckets: Buckets, key: str = "key", value: str = "value", order: str | None = None) -> DataFrame:
    """For each outer row with a match its first inner row, in key order over all partitions.

    Outer rows are counted by key first, so a hot key is one row until the end; buckets must not be spread.
    """
    counted = outer.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    met = _meet(counted, first_of_key(inner, key, value, order), buckets, key, value)
    return met.select(key, F.col("__held").alias(value), F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__i")).drop("__i")


def bucket_stats(df: DataFrame, bucket: Column, key: str = "key") -> DataFrame:
    """bucket, n, max_key, before (rows in earlier buckets), running_max, largest (rows of the largest bucket)."""
    per = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.max(key).alias("max_key"))
    ordered = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over the buckets, not the rows
    return per.select("bucket", "n", "max_key", (F.sum("n").over(ordered) - F.col("n")).alias("before"), F.max("max_key").over(ordered).alias("running_max"), F.max("n").over(Window.partitionBy()).alias("largest"))


def co_ranges(outer: DataFrame, inner: DataFrame, cuts: list, key: str = "key") -> DataFrame:
    """part, n_outer, n_inner: both tables cut at the same keys, as sorted joins deal them to threads."""
    sides = [t.groupBy(cdf_bucket(F.col(key), cuts).alias("part")).agg(F.count("*").alias(n)) for t, n in ((outer, "n_outer"), (inner, "n_inner"))]
    return sides[0].join(sides[1], "part", "full").select("part", F.coalesce("n_outer", F.lit(0)).alias("n_outer"), F.coalesce("n_inner", F.lit(0)).alias("n_inner"))
