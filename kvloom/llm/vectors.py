"""What the two vector searches share: which rows take part, how rows and queries meet, and running best lists.

Rows are packed into chunks where they are read (no row is shuffled by a key) and chunks are dealt out to parts of bounded
size. Queries are a table too: packed into blocks, each with the k-th best value that it has among FIRST_ROWS rows, and
sent to every part. A task reads a part's chunks, makes its search structure once, and then takes the query blocks one by
one; it gives at most k rows for a query, none worse than the k-th that the query came with.

Only FIRST_ROWS rows are broadcast. The number of parts is rows / (PART_VALUES / dimensions) for large tables, so what
moves is the rows once and the queries once for each part; nothing is collected and no plan grows with the queries.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

QUERY_BLOCK = 1024
SHARD_ROWS = 8192
#: Components of all vectors of a part, of a chunk.
PART_VALUES, CHUNK_VALUES = 1 << 24, 1 << 19
#: Parts of tables that are too small for PART_VALUES to matter.
SMALL_PARTS = 256
FIRST_ROWS = 4096
_PACKED = "part int, kind int, no long, ids binary, v binary, extra binary"


def usable(rows: DataFrame, vec_id: str, vector: str, zero: bool) -> DataFrame:
    """id, v (array<double>) of the rows that take part: finite components, and not all zero unless zero.

    All must have the commonest number of components (of equally common ones the larger); others take no part, nor do
    empty vectors and rows without an id.
    """
    v = F.col("v")
    good = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = good.where(F.forall(v, fine))
    if not zero:
        good = good.where(F.exists(v, lambda x: x != 0))
    first = good.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.where(F.size(v) == (first["n"] if first else 0))


class Best:
    """The k best (value, id) of each query so far: largest values first if sign is -1, smallest if 1; ties to smaller ids.

    kth (sign * value, as a double) starts at `start`, a value that k rows are known to reach, or at infinity.
    """

    def __init__(self, n: int, k: int, sign: int, start: np.ndarray | None = None, dtype=np.float64):
        self.k, self.sign = k, sign
        self.q, self.value, self.id = np.empty(0, np.int64), np.empty(0, dtype), np.empty(0, np.int64)
        self.kth = np.full(n, np.inf) if start is None else start.astype(np.float64)

    def add(self, q: np.ndarray, value: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        q, value, ids = np.concatenate((self.q, q)), np.concatenate((self.value, self.sign * value)), np.concatenate((self.id, ids))
        order = np.lexsort((ids, value, q))
        q, value, ids = q[order], value[order], ids[order]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        keep = place < self.k
        last = place == self.k - 1
        self.kth[q[last]] = np.minimum(self.kth[q[last]], value[last].astype(np.float64))
        self.q, self.value, self.id = q[keep], value[keep], ids[keep]


def vectors_of(column: pa.Array) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed(part: int, kind: int, no: int, ids: np.ndarray, v: np.ndarray, extra: bytes) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([no], pa.int64()), *(pa.array([x], pa.binary()) for x in (ids.tobytes(), np.ascontiguousarray(v).tobytes(), extra))]
    return pa.RecordBatch.from_arrays(columns, ["part", "kind", "no", "ids", "v", "extra"])


def parts_for(n: int, dimensions: int, shard_rows: int = SHARD_ROWS) -> int:
    """In how many parts n vectors are searched: a shard each while there are few, of PART_VALUES components at most."""
    return max(1, min(-(-n // shard_rows), SMALL_PARTS), -(-n * max(dimensions, 1) // PART_VALUES))


def chunks(rows: DataFrame, parts: int, extra: Callable[[np.ndarray], np.ndarray] | None = None, values: int = CHUNK_VALUES) -> DataFrame:
    """Rows (id, v) packed as they lie; extra(v) gives each row's own bytes (a matrix of bytes), as a code."""

    def each(batches):
        held, n, made = [], 0, 0

        def done():
            ids, v = (np.concatenate(x) for x in zip(*held))
            return _packed((where + made) % parts, 0, (where << 32) + made, ids, v, extra(v).tobytes() if extra else b"")

        for b in batches:
            if not b.num_rows:
                continue
            where = b.column(2)[0].as_py()
            ids, v = b.column(0).to_numpy(zero_copy_only=False), vectors_of(b.column(1))
            step = max(1, values // v.shape[1])
            for at in range(0, len(ids), step):
                held.append((ids[at : at + step], v[at : at + step]))
                n += len(held[-1][0])
                if n >= step:
                    yield done()
                    held, n, made = [], 0, made + 1
        if held:
            yield done()

    return rows.select("id", "v", F.spark_partition_id().alias("where")).mapInArrow(each, _PACKED)


def query_blocks(queries: DataFrame, start: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = QUERY_BLOCK) -> DataFrame:
    """Queries (id, v, no) packed in blocks; extra holds their numbers and start(ids, v), their k-th best value so far."""

    def each(batches):
        for b in batches:
            for at in range(0, b.num_rows, block):
                own = b.slice(at, block)
                ids, v = own.column(0).to_numpy(zero_copy_only=False), vectors_of(own.column(1))
                no = own.column(2).to_numpy(zero_copy_only=False)
                yield _packed(0, 1, int(no[0]), ids, v, no.astype(np.int64).tobytes() + start(ids, v).astype(np.float64).tobytes())

    return queries.mapInArrow(each, _PACKED)


def over_parts(rows: DataFrame, parts: int, queries: DataFrame, k: int, sign: int, made: Callable, start: Callable, score: str, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of rows (chunks) for each query (id, v).

    made(ids, v, extra) is called once for a part and gives search(query ids, query vectors, start) -> Best. Every row of
    queries has a list of its own, also where ids repeat; a search leaves rows with the query's id out.
    """
    numbered = cut(queries.select("id", "v", F.monotonically_increasing_id().alias("no")))
    asked = query_blocks(numbered, start, block).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    both = rows.union(asked.select(*rows.columns)).repartition(parts, "part").sortWithinPartitions("part", "kind", "no")
    kind = {"double": pa.float64(), "long": pa.int64()}[score]

    def each(batches):
        part, held, search = None, [], None
        for b in batches:
            for r in range(b.num_rows):
                at, is_query = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                if at != part:
                    part, held, search = at, [], None
                ids = np.frombuffer(b.column(3)[r].as_buffer(), np.int64)
                v = np.frombuffer(b.column(4)[r].as_buffer(), np.float64).reshape(len(ids), -1)
                extra = b.column(5)[r].as_buffer()
                if not is_query:
                    held.append((ids, v, np.frombuffer(extra, np.uint8).reshape(len(ids), -1)))
                    continue
                if search is None:
                    if not held:
                        continue
                    search, held = made(*(np.concatenate(x) for x in zip(*held))), [None]
                numbers = np.frombuffer(extra, np.int64)
                best = search(ids, v, numbers[len(ids) :].view(np.float64))
                columns = [pa.array(numbers[: len(ids)][best.q]), pa.array(ids[best.q]), pa.array(best.id), pa.array(best.sign * best.value, kind)]
                yield pa.RecordBatch.from_arrays(columns, ["no", "query_id", "vec_id", "score"])

    found = both.mapInArrow(each, f"no long, query_id long, vec_id long, score {score}")
    order = Window.partitionBy("no").orderBy(F.col("score") if sign > 0 else F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def first_rows(rows: DataFrame, n: int = FIRST_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of n rows by a hash of the id: the shard that all queries read first."""
    got = rows.orderBy(F.xxhash64("id"), "id", "v").limit(n).collect()
    return np.array([r["id"] for r in got], np.int64), np.array([r["v"] for r in got], np.float64)
