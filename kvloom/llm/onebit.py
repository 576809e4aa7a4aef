"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is taken from the centre, scaled to length one and rotated at random; its code is the signs of the rotated
components, with two scalars: its length and the inner product of the code with what it stands for. From these and a
rotated query follows an unbiased estimate of the inner product and a bound on its error; a vector whose bound on the
distance is above the query's k-th best exact distance is left out, the others are measured exactly.

The centre is the mean of at most CENTRE_ROWS rows; every row is coded and searched. At EPSILON, a true neighbour is
left out with a probability far below a tenth (see the tests for the recall measured).

Scale: the index is a table of chunks (ids, packed codes with their scalars, vectors), made without a shuffle; each of its
parts is read once and searched by all blocks of queries, each with the k-th distance that it has among the first rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .vectors import QUERY_BLOCK, Best, chunks, first_rows, over_parts, parts_for, usable

CENTRE_ROWS = 20_000
EPSILON = 3.0
SEED = 5
ROWS_AT_ONCE, QUERIES_AT_ONCE = 2048, 512


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


class Coder:
    def __init__(self, centre: np.ndarray):
        self.centre, self.turn = centre, rotation(len(centre))

    def rotated(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length-one residuals, rotated, and their lengths."""
        r = v - self.centre
        length = np.sqrt((r * r).sum(axis=1))
        return (r / np.maximum(length, 1e-300)[:, None]) @ self.turn.T, length

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, lengths of the residuals, inner products of the codes with the residuals' directions."""
        o, length = self.rotated(v)
        return np.packbits(o > 0, axis=1), length, np.abs(o).sum(axis=1) / np.sqrt(o.shape[1])

    def nearest_bound(self, codes: np.ndarray, length: np.ndarray, kept: np.ndarray, o: np.ndarray, q_length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the squared distances of queries to coded vectors, and bounds that they hardly ever go below."""
        d = o.shape[1]
        signs = (np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))
        kept = np.maximum(kept, 1e-6)
        cosine = (o.astype(np.float32) @ signs.T) / kept
        error = EPSILON * np.sqrt(np.maximum(1 - kept * kept, 0) / (kept * kept)) / np.sqrt(max(d - 1, 1))
        scale = 2 * q_length[:, None] * length
        estimate = q_length[:, None] ** 2 + length**2 - scale * cosine
        bound = estimate - scale * error - 1e-6 * (1 + abs(estimate))
        # lengths whose squares are beyond doubles say nothing
        return np.where(np.isnan(estimate), np.inf, estimate), np.where(np.isfinite(bound), bound, -np.inf)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a and b; scaled where the plain sum is beyond doubles."""
    gap = a - b
    with np.errstate(over="ignore"):
        out = np.sqrt((gap * gap).sum(axis=1))
    far = ~np.isfinite(out)
    if far.any():
        half = a[far] / 2 - b[far] / 2
        most = np.maximum(abs(half).max(axis=1), 1e-300)
        with np.errstate(over="ignore"):
            out[far] = np.sqrt(((half / most[:, None]) ** 2).sum(axis=1)) * most * 2
    return out


def centre_of(rows: DataFrame) -> np.ndarray | None:
    """The mean of at most CENTRE_ROWS rows (id, v), None if there are none."""
    some = rows.orderBy(F.xxhash64("id"), "id", "v").limit(CENTRE_ROWS)
    means = some.select(F.posexplode("v")).groupBy("pos").agg(F.avg(F.col("col") / CENTRE_ROWS).alias("m")).orderBy("pos").collect()
    return np.array([r["m"] * CENTRE_ROWS for r in means]) if means else None


def build_index(rows: DataFrame, parts: int, coder: Coder) -> DataFrame:
    """The coded table of rows (id, v) in chunks: ids, vectors, and for each its length, kept and packed signs as bytes."""

    def coded(v):
        codes, length, kept = coder.encode(v)
        return np.concatenate((np.stack((length, kept), axis=1).view(np.uint8).reshape(len(v), -1), codes), axis=1)

    return cut(chunks(rows, parts, coded))


def nearest(rows: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score (distance) of the k nearest found, for rows and queries (id, v).

    Every row of queries gets a list, also where ids repeat; rows with a query's own id aren't its candidates, and rows
    that repeat are candidates each. No rows or no queries: no rows.
    """
    centre = centre_of(rows)
    if centre is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    coder = Coder(centre)
    parts = parts_for(rows.count(), len(centre))
    index = build_index(rows, parts, coder)
    sent = rows.sparkSession.sparkContext.broadcast(first_rows(rows))  # at most FIRST_ROWS

    def start(ids, v):
        best, (first, points) = Best(len(ids), k, 1), sent.value
        Codes(coder, first, points).search(ids, v, best)
        return best.kth

    def made(ids, v, extra):
        codes = Codes(coder, ids, v, extra)

        def search(own, wanted, kth):
            best = Best(len(own), k, 1, kth)
            codes.search(own, wanted, best)
            return best

        return search

    return over_parts(index, parts, queries, k, 1, made, start, "double", block)


class Codes:
    """Coded vectors in memory, ready to be searched."""

    def __init__(self, coder: Coder, ids: np.ndarray, v: np.ndarray, extra: np.ndarray | None = None):
        self.coder, self.ids, self.v = coder, ids, v
        if extra is None:
            self.codes, self.length, self.kept = coder.encode(v)
        else:
            self.codes = extra[:, 16:]
            self.length, self.kept = np.ascontiguousarray(extra[:, :16]).view(np.float64).T

    def search(self, own: np.ndarray, wanted: np.ndarray, best: Best) -> None:
        o, q_length = self.coder.rotated(wanted)
        for at in range(0, len(self.ids), ROWS_AT_ONCE):
            part = slice(at, at + ROWS_AT_ONCE)
            ids, v, codes, length, kept = self.ids[part], self.v[part], self.codes[part], self.length[part], self.kept[part]
            few = min(best.k, len(ids))
            for q in range(0, len(own), QUERIES_AT_ONCE):
                mine = slice(q, q + QUERIES_AT_ONCE)
                estimate, bound = self.coder.nearest_bound(codes, length, kept, o[mine], q_length[mine])
                other = own[mine][:, None] != ids[None, :]
                seen = np.zeros(estimate.shape, bool)
                if not np.isfinite(best.kth[mine]).all():  # the best estimates give a first k-th distance
                    first = np.argpartition(np.where(other, estimate, np.inf), few - 1, axis=1)[:, :few]
                    i, j = np.repeat(np.arange(len(first)), few), first.reshape(-1)
                    seen[i, j] = True
                    apart = other[i, j]
                    self._measure(i[apart] + q, j[apart], v, ids, wanted, best)
                i, j = np.nonzero(other & ~seen & (bound <= (best.kth[mine] ** 2 * (1 + 1e-9))[:, None]))
                self._measure(i + q, j, v, ids, wanted, best)

    def _measure(self, i, j, v, ids, wanted, best) -> None:
        for at in range(0, len(i), 100_000):
            a, b = i[at : at + 100_000], j[at : at + 100_000]
            d = distances(v[b], wanted[a])
            good = d <= best.kth[a]
            best.add(a[good], d[good], ids[b][good])


def op10_onebit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: ids divisible by 100, against all other rows; the nearest 10. Empty table: no rows.

    Rows without an id, and vectors that are null, empty, zero, not of the commonest dimension or not finite take no part;
    for repeated ids and rows see nearest. Other columns of the table are not read.
    """
    rows = cut(usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", zero=False))
    return nearest(rows, rows.where("id % 100 = 0"), 10)
