"""Merging two sorted tables into one: all rows of both, in key order, with a fixed order of equal keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .indexes import build, find
from .positions import with_position
from .spec import IndexSpec


def merge(inner: DataFrame, outer: DataFrame, key: str = "key", ties: str = "inner") -> DataFrame:
    """Rows of both with src (0 inner, 1 outer), sorted; `ties` names the side that goes first among equal keys. Null keys first."""
    if ties not in ("inner", "outer"):
        raise ValueError(f"ties must be inner or outer, not {ties!r}")
    both = inner.withColumn("src", F.lit(0)).unionByName(outer.withColumn("src", F.lit(1)))
    return both.orderBy(F.asc_nulls_first(key), F.asc("src") if ties == "inner" else F.desc("src"), *[c for c in inner.columns if c != key])


def merge_by_position(inner: DataFrame, outer: DataFrame, key: str = "key", parts: int | None = None) -> DataFrame:
    """Rows of both with src and pos, the row's place in the merged table; outer goes first among equal keys.

    The union is cut into ranges once; a place is the rows in earlier ranges plus the place in the own one, so one range
    partitioning does all. Rows without a key are left out.
    """
    inner, outer = (t.where(F.col(key).isNotNull()).withColumn("src", F.lit(s)) for t, s in ((inner, 0), (outer, 1)))
    both = inner.unionByName(outer).withColumn("__first", -F.col("src"))
    return with_position(both, key, "__first", *[c for c in inner.columns if c not in (key, "src")], parts=parts).drop("__first")


def merge_by_index(inner: DataFrame, outer: DataFrame, spec: IndexSpec, key: str = "key", parts: int | None = None) -> DataFrame:
    """The same rows, with each place computed through indexes: the own rank plus the lower bound of the key in the other table.

    An index is built over each side; keys are looked up once each, within its bounds, by spec.search. For keys that are longs.
    """
    sides = [t.where(F.col(key).isNotNull()) for t in (inner, outer)]
    ranked = [with_position(t, key, *[c for c in t.columns if c != key], parts=parts, name="pos") for t in sides]
    keyed = [t.select(F.col(key).alias("key"), "pos") for t in ranked]
    built = [build(t, spec) for t in keyed]
    below = [find(keyed[1 - i], keyed[i], built[1 - i], spec.search).select(F.col("key").alias("__k"), F.col("pos").alias("__below")) for i in (0, 1)]
    # an inner row has the outer rows of its own key ahead of it as well
    same = keyed[1].groupBy(F.col("key").alias("__s")).agg(F.count("*").alias("__same"))
    from_inner = ranked[0].join(below[0], F.col(key) == F.col("__k")).join(same, F.col(key) == F.col("__s"), "left")
    from_outer = ranked[1].join(below[1], F.col(key) == F.col("__k")).withColumn("__same", F.lit(0))
    place = (F.col("pos") + F.col("__below") + F.coalesce("__same", F.lit(0))).cast("long")
    made = lambda t, src: t.select(*inner.columns, F.lit(src).alias("src"), place.alias("pos"))
    return made(from_inner, 0).unionByName(made(from_outer, 1))


def drop_repeats(df: DataFrame, key: str = "key") -> DataFrame:
    """One row for each key."""
    return df.dropDuplicates([key])


def key_union(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """The keys of both, each once."""
    return a.select(key).union(b.select(key)).distinct()
