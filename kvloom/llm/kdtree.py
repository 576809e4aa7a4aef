"""Exact top-k inner products with a KD-tree per shard.

The rows of a part are split at medians into shards of at most SHARD_ROWS, and each shard has a tree, split at medians of
its widest dimension down to LEAF rows; each node has the tight bounding box of its vectors. A box bounds the inner product
with a query from above by taking the better end of each side. The search is best-first: of the boxes that are open for
a query the one with the best bound comes next, an inner box opens its two children, a leaf is measured, and the query is
done with the shard when its best open bound is below its k-th best product. All queries of a block take their steps
together, so that a leaf is measured for all that stand at it. The k-th best goes on from shard to shard, and all parts
start from the k-th best among the first rows, which every query reads before it is sent out. Ties with it are never cut off.

Products are whole numbers. Doubles hold them up to 2**53; beyond, components are split into halves of 16 bits and summed
as longs; beyond 2**62 in sum they are computed in whole numbers of any size and scores outside of long become its ends.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .vectors import QUERY_BLOCK, SHARD_ROWS, Best, chunks, first_rows, over_parts, parts_for, usable

LEAF = 256
#: Bounds of sums of products: what doubles hold exactly, what longs hold.
EXACT, LONG = 2.0**53, 2.0**62
_ENDS = (1 << 63) - 1


class Products:
    """Inner products of whole numbers held as doubles, exact for sums up to `most` in absolute value."""

    def __init__(self, most: float):
        self.most = most
        self.dtype = np.float64 if most < EXACT else np.int64
        # of bounds and k-th values in doubles, beyond which they can't be trusted
        self.slack = 0.0 if most < EXACT else 1e-12 * most

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """All products of the rows of a with the rows of b."""
        if self.most < EXACT:
            return a @ b.T
        if self.most < LONG:
            (ah, al), (bh, bl) = ((np.floor(x / 65536), np.mod(x, 65536)) for x in (a, b))
            middle = (ah @ bl.T + al @ bh.T).astype(np.int64)
            return ((ah @ bh.T).astype(np.int64) << 32) + (middle << 16) + (al @ bl.T).astype(np.int64)
        whole = [np.array([[int(x) for x in row] for row in m], dtype=object) for m in (a, b)]
        return np.clip(whole[0] @ whole[1].T, -_ENDS, _ENDS).astype(np.int64)


class KdTree:
    """A tree over points; nodes in arrays, the points of a leaf next to each other (order: their places in points)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        lo, hi, self.span, left, right = [], [], [], [], []
        todo = [(0, len(points), None, -1)]
        while todo:
            a, b, side, above = todo.pop()
            own = points[self.order[a:b]]
            me = len(lo)
            lo.append(own.min(axis=0))
            hi.append(own.max(axis=0))
            self.span.append((a, b))
            left.append(-1)
            right.append(-1)
            if side is not None:
                side[above] = me
            if b - a > leaf:
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, np.argmax(hi[me] - lo[me])], middle)]
                todo += [(a, a + middle, left, me), (a + middle, b, right, me)]
        self.lo, self.hi, self.left, self.right = np.array(lo), np.array(hi), np.array(left), np.array(right)

    def leaves(self) -> list[np.ndarray]:
        """The places of each leaf's points."""
        return [self.order[a:b] for (a, b), x in zip(self.span, self.left) if x < 0]

    def bounds(self, up: np.ndarray, down: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of each query (up: positive parts, down: negative parts) with its node's box."""
        return np.einsum("qd,qd->q", up, self.hi[nodes]) + np.einsum("qd,qd->q", down, self.lo[nodes])


class Shard:
    def __init__(self, ids: np.ndarray, points: np.ndarray, products: Products, leaf: int = LEAF):
        self.tree, self.products = KdTree(points, leaf), products
        self.ids, self.points = ids[self.tree.order], points[self.tree.order]
        self.measured = 0  # pairs of a query and a leaf

    def search(self, own: np.ndarray, queries: np.ndarray, best: Best) -> None:
        tree, slack = self.tree, self.products.slack
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        trusted = self.products.most < LONG

        def bounds(q, nodes):
            return tree.bounds(up[q], down[q], nodes) if trusted else np.full(len(q), np.inf)

        live = np.arange(len(queries))
        first = bounds(live, np.zeros(len(live), np.int64))
        live = live[-(first + slack) <= best.kth]
        front = np.full((len(queries), len(tree.lo)), -np.inf)
        front[live, 0] = first[live]
        while len(live):
            node = front[live].argmax(axis=1)
            bound = front[live, node]
            on = (bound > -np.inf) & (-(bound + slack) <= best.kth[live])
            live, node = live[on], node[on]
            front[live, node] = -np.inf
            inner = tree.left[node] >= 0
            q = live[inner]
            for child in (tree.left[node[inner]], tree.right[node[inner]]):
                front[q, child] = bounds(q, child)
            self._measure(own, queries, live[~inner], node[~inner], best)

    def _measure(self, own, queries, q, node, best) -> None:
        hits = []
        for x in np.unique(node):
            mine = q[node == x]
            a, b = self.tree.span[x]
            s = self.products(queries[mine], self.points[a:b])
            good = (-s.astype(np.float64) - self.products.slack <= best.kth[mine][:, None]) & (own[mine][:, None] != self.ids[a:b][None, :])
            i, j = np.nonzero(good)
            hits.append((mine[i], s[i, j], self.ids[a + j]))
            self.measured += len(mine)
        if hits:
            best.add(*(np.concatenate(x) for x in zip(*hits)))


def inner_top(rows: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS, leaf: int = LEAF, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for rows and queries (id, v: whole numbers as doubles).

    Every row of queries gets a list, also where ids repeat; rows with a query's own id aren't its candidates, and rows
    that repeat are candidates each. No rows or no queries: no rows.
    """
    at = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    n, d = at["n"], at["d"] or 1
    most = at["most"] or 0.0
    products = Products(d * most * most)
    parts = parts_for(n, d, shard_rows)
    sent = rows.sparkSession.sparkContext.broadcast(first_rows(rows))  # at most FIRST_ROWS

    def start(ids, v):
        best = Best(len(ids), k, -1, dtype=products.dtype)
        first, points = sent.value
        if len(first):
            Shard(first, points, products, leaf).search(ids, v, best)
        return best.kth

    def made(ids, v, _):
        shards = [Shard(ids[x], v[x], products, leaf) for x in KdTree(v, shard_rows).leaves()]

        def search(own, wanted, kth):
            best = Best(len(own), k, -1, kth, products.dtype)
            for shard in shards:
                shard.search(own, wanted, best)
            return best

        return search

    return over_parts(chunks(rows, parts), parts, queries, k, -1, made, start, "long", block)


def quantised(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v: floor(256 * x) of the components of the rows that take part (null or non-finite ones don't)."""
    good = usable(rows, vec_id, vector, zero=True)
    top = 1.7976931348623157e308
    scaled = lambda x: F.greatest(F.least(x * 256, F.lit(top)), F.lit(-top))
    # from 2**52 on, doubles are whole
    whole = lambda x: F.when(F.abs(scaled(x)) < 2.0**52, F.floor(scaled(x)).cast("double")).otherwise(scaled(x))
    return good.select("id", F.transform("v", whole).alias("v"))


def op3_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: ids divisible by 50, against all other rows, by quantised inner product; the best 5. Empty table: no rows.

    Rows without an id, and vectors that are null, empty, not of the commonest dimension or not finite take no part; for
    repeated ids and rows see inner_top. Other columns of the table are not read.
    """
    rows = cut(quantised(table(spark, sf_dir, "embeddings")))
    return inner_top(rows, rows.where("id % 50 = 0"), 5)


#: The same by SQL; DuckDB reads the same table.
OP3_SQL = """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM good),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM flat q JOIN flat c ON q.i = c.i AND q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY 1, 2),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""
