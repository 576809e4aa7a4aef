"""Dense positions in key order, and counts of keys below a probe, without a window over the whole table.

The table is range-partitioned and sorted once and cut there, so partition ids are stable; a position is the number of
rows in the partitions before plus the place in the own partition. Only one count per partition reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.materialize import cut

_PLACE = (1 << 33) - 1  # monotonically_increasing_id() has the row's place in its low 33 bits


def _parts(df: DataFrame, parts: int | None) -> int:
    return parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _offsets(df: DataFrame, count: Column) -> dict[int, int]:
    got = {r["p"]: r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(count.alias("n")).collect()}
    out, total = {}, 0
    for p in sorted(got):
        out[p] = total
        total += got[p]
    return out


def with_position(df: DataFrame, *order: str, parts: int | None = None, name: str = "pos") -> DataFrame:
    """df in the order of the columns (nulls first), with the dense position of each row from 0."""
    spark = df.sparkSession
    ranged = cut(df.repartitionByRange(_parts(df, parts), *order).sortWithinPartitions(*order))
    offsets = _offsets(ranged, F.count("*"))
    table = spark.createDataFrame([(p, n) for p, n in offsets.items()], "p int, before long")
    here = ranged.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)))
    out = here.join(F.broadcast(table), here["__p"] == table["p"])  # one row a partition
    return out.select(*df.columns, (F.col("before") + F.col("__i")).alias(name))


def lower_bound(keys: DataFrame, probes: DataFrame, key: str = "key", parts: int | None = None) -> DataFrame:
    """probes (all columns) with pos: how many rows of keys are below the probe's key. Null probes get null.

    Both sides are range-partitioned together, each probe ahead of equal keys; a running count per partition answers.
    """
    spark = probes.sparkSession
    columns = probes.columns
    packed = F.struct(*[F.col(c) for c in columns])
    left = keys.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.lit(1).alias("tag"), F.lit(None).cast(probes.select(packed.alias("s")).schema["s"].dataType).alias("row"))
    right = probes.select(F.col(key).alias("k"), F.lit(0).alias("tag"), packed.alias("row"))
    both = cut(left.unionByName(right).repartitionByRange(_parts(probes, parts), "k", "tag").sortWithinPartitions("k", "tag"))
    sent = spark.sparkContext.broadcast(_offsets(both, F.sum("tag")))

    def count(batches):
        before = None
        for b in batches:
            if before is None and b.num_rows:
                before = sent.value[b.column(2)[0].as_py()]
            if not b.num_rows:
                continue
            tag = b.column(0).to_numpy(zero_copy_only=False)
            run = before + np.cumsum(tag)
            before = int(run[-1])
            ask = tag == 0
            yield pa.RecordBatch.from_arrays([b.column(1).filter(pa.array(ask)), pa.array(run[ask], pa.int64())], ["row", "pos"])

    kind = probes.select(packed.alias("row")).schema["row"].dataType.simpleString()
    out = both.select("tag", "row", F.spark_partition_id().alias("p")).mapInArrow(count, f"row {kind}, pos long")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], F.when(F.col(f"row.`{key}`").isNotNull(), F.col("pos")).alias("pos"))


def window_slice(positioned: DataFrame, lo: int, hi: int) -> DataFrame:
    """Rows at positions lo <= pos < hi; over Parquet sorted by pos, row groups outside are skipped."""
    return positioned.where((F.col("pos") >= lo) & (F.col("pos") < hi))


def rows_at(positioned: DataFrame, wanted: DataFrame, name: str = "pos") -> DataFrame:
    """The rows at the positions that wanted (a column of that name) holds, once for each time; positions outside give none."""
    return wanted.select(name).join(positioned, name).select(*positioned.columns)
