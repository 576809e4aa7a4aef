"""Mixing sources to target weights by a low-discrepancy schedule of slots.

Slots are points of the golden-ratio sequence, mapped through the cumulative target weights, so any stretch of the
schedule has each source in nearly its exact share. Slots are ranked per source; slot r of a source takes block r of
the source's shuffled token stream, which starts again at its end. A source's k blocks are equal parts of its target in
whole words, so every source gives its target and no more, however few slots it has; one too small for a slot of its own
is a single block at a slot of another. What a document gives follows from where it starts in the stream, and its slot
from the block it starts in.

Scale: one shuffle of ids and sizes (no texts) by (source, slice of the shuffle order), so a source with a third of
the rows is spread over all tasks. The schedule has at most SLOTS slots at any input size. Only the per-source totals
reach the driver (one row a source; more than MAX_SOURCES is an error).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, slices, table

SLOTS = 1 << 20
MAX_SOURCES = 1_000_000
GOLDEN = (5**0.5 - 1) / 2
WEIGHTS = (5, 2, 1)
MOST = 3
#: Rows of a table that may be broadcast.
SMALL = 1_000_000


def fill_targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of sum(sizes) by weight, each at most `most` times its size, the excess dealt again by weight."""
    total, target = float(sum(sizes)), [0.0] * len(sizes)
    free, left = [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while free and left > 1e-9 * max(total, 1):
        weight = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / weight >= most * sizes[i]]
        if not full:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in full:
            target[i] = float(most * sizes[i])
        left, free = total - sum(target), [i for i in free if i not in set(full)]
    return target


def schedule(spark: SparkSession, targets: list[float], slots: int) -> DataFrame:
    """slot long, source int (place in targets), rank long: slot i belongs to the source at the i-th golden-ratio point."""
    edges = np.cumsum(targets) / max(sum(targets), 1e-300)

    def place(batches):
        for b in batches:
            u = np.mod((b["id"].to_numpy() + 0.5) * GOLDEN, 1.0)
            yield pd.DataFrame({"slot": b["id"], "source": np.minimum(np.searchsorted(edges, u, side="right"), len(edges) - 1).astype("int32")})

    points = spark.range(slots).mapInPandas(place, "slot long, source int")
    # a rank is the count in earlier stretches plus the place in the own stretch
    width = 1 << 13
    points = points.withColumn("stretch", F.expr(f"slot div {width}"))
    before = points.groupBy("source", "stretch").count().withColumn("before", F.sum("count").over(Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("source", "stretch").orderBy("slot")) - 1
    return points.withColumn("own", own).join(before, ["source", "stretch"]).select("slot", "source", (F.coalesce("before", F.lit(0)) + F.col("own")).cast("long").alias("rank"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, most: float = MOST, slots: int = SLOTS, seed: int = 7, placed: bool = True) -> DataFrame:
    """Return doc_id, size, source_size, target, taken, start (place in the source's stream), slot for each row of docs.

    slot is the place in the schedule of the block in which the row's first pass starts, null where it isn't taken;
    without `placed` there is no such column, and no schedule is made.

    Sources are ordered by code point, null last, and weigh `weights`, repeating. size counts words; a null or empty
    text has size 0 and gives 0. An empty source has target 0. Rows with equal ids are separate documents of the
    stream; equal rows in every part share their place by an arbitrary but complete order. Empty tables give no rows.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"))
    rows = cut(rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size")))
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    got = by_source.limit(MAX_SOURCES + 1).collect()
    if len(got) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    got.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [r["source_size"] for r in got]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(got))], most)
    total = sum(sizes)
    n_slots = int(min(slots, max(1, total)))
    counts = {}
    if total and placed:
        plan = cut(schedule(spark, targets, n_slots))
        counts = {r["source"]: r["n"] for r in plan.groupBy("source").agg((F.max("rank") + 1).alias("n")).collect()}
    # whole words, never above `most` passes
    runs = [min(round(t), int(most * s)) for t, s in zip(targets, sizes)]
    facts = spark.createDataFrame(
        [(r["source"], int(s), float(t), int(k), i, int(counts.get(i, 0))) for i, (r, s, t, k) in enumerate(zip(got, sizes, targets, runs))],
        "f_source string, source_size long, target double, run long, place int, blocks long",
    )
    n_slices = slices(sum(r["n"] for r in got), 2_000)
    rows = rows.withColumn("slice", F.pmod(F.shiftright("h", 20), F.lit(n_slices)).cast("int"))
    ordered = Window.partitionBy("source", "slice").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("size").over(ordered), F.lit(0)))
    offs = rows.groupBy("source", "slice").agg(F.sum("size").alias("part"))
    offs = offs.select(F.col("source").alias("o_source"), F.col("slice").alias("o_slice"), F.coalesce(F.sum("part").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = rows.join(offs, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("slice") == F.col("o_slice")))
    small = len(got) <= 10_000
    rows = rows.join(F.broadcast(facts) if small else facts, F.col("source").eqNullSafe(F.col("f_source")))
    start = F.col("before") + F.col("own")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("run") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0)).cast("long")
    rest = F.col("run") - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - start))
    out = rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), start.cast("long").alias("start"), "run", "place", "blocks")
    given = ["doc_id", "size", "source_size", "target", "taken", "start"]
    if not placed:
        return out.select(given)
    if not total:
        return out.select(*given, F.lit(None).cast("long").alias("slot"))
    rank = F.when((F.col("taken") > 0) & (F.col("blocks") > 0), F.expr("cast(cast(start as decimal(19,0)) * blocks div run as long)"))
    own = plan.select(F.col("source").alias("p_place"), F.col("rank").alias("p_rank"), F.col("slot").alias("p_slot"))
    out = out.withColumn("rank", rank).join(own, (F.col("place") == F.col("p_place")) & (F.col("rank") == F.col("p_rank")), "left")
    other = F.floor(F.pmod((F.col("place") + 0.5) * GOLDEN, F.lit(1.0)) * n_slots).cast("long")
    slot = F.when(F.col("taken") > 0, F.coalesce("p_slot", other))
    return out.select(*given, slot.alias("slot"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: each row once for every pass that takes at least half of its words (so 0 to 3 times).

    Documents without words have nothing to take and go. Rows are known by id and text; where both repeat, each is taken as
    often as the one of them that is taken most. The counts, a narrow table, are joined to docs: texts move only where that
    table is above SMALL rows.
    """
    own = F.struct(F.col("doc_id").alias("i"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    taken = mix(docs.select(own.alias("doc_id"), "text", "source"), placed=False).where("size > 0")
    keys = taken.select(F.col("doc_id.i").alias("__mix_i"), F.col("doc_id.t").alias("__mix_t"), F.floor((F.col("taken") + F.col("size") / 2) / F.col("size")).cast("int").alias("__mix_n"))
    keys = cut(keys.where("__mix_n > 0").groupBy("__mix_i", "__mix_t").agg(F.max("__mix_n").alias("__mix_n")))
    keys = F.broadcast(keys) if keys.limit(SMALL + 1).count() <= SMALL else keys
    out = docs.join(keys, F.col("doc_id").eqNullSafe(F.col("__mix_i")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__mix_t")))
    return out.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_n")))).select(*[docs[c] for c in docs.columns])
