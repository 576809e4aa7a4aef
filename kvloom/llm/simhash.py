"""SimHash near-duplicates with BK-trees.

A fingerprint is the bitwise majority of the XXH64 values of a text's three-word shingles. Equal fingerprints are one
node. Two fingerprints within RADIUS bits agree in one of RADIUS + 1 bands of their bits, so the nodes of each (band,
value) form a shard with a BK-tree of its own: children are keyed by their Hamming distance to the parent, and a
search follows only the edges within the radius of the distance it has found. A shard above HOT nodes is split again
by bands of the bits that it hasn't been split by, by the same argument, and so on until none is that large, so it needs
no cap. A shard gives a spanning forest of its links, never all pairs. Components of the links are found in rounds
(graph.py).

Scale: texts never move; a row of a shuffle is a key and a fingerprint. Trees of the shards reach the tasks by that
shuffle rather than by a broadcast: together they grow with the data, and a broadcast would first gather the
fingerprints of all documents on the driver. All documents with one fingerprint are
aggregated to one row before anything else.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .graph import components

RADIUS = 3
SEED = 42
SHINGLE = 3
HOT = 2000


def fingerprint(text: str | None, words_each: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64 bits; 0 for a text without words. A bit is set if it is in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_each:
        return xxhash.xxh64_intdigest(joined, seed)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))[: len(words) - words_each + 1].tolist()
    ends = np.append(gaps, len(joined))[words_each - 1 :].tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    n, ones = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        h = np.array([digest(view[s:e], seed) for s, e in zip(starts[at : at + (1 << 14)], ends[at : at + (1 << 14)])], dtype="<u8")
        ones += _ones(h)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of h have each bit set."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for each row."""

    def each(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(each, "doc_id long, fp long")


def bands(bits: list[int], n: int) -> list[list[int]]:
    """The bits in n runs of nearly equal length."""
    edges = np.linspace(0, len(bits), n + 1).round().astype(int)
    return [bits[a:b] for a, b in zip(edges, edges[1:])]


def _key(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value of a run of neighbouring bits (two runs where a band was taken out between them)."""
    out = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(bits):
        out |= (fp >> np.uint64(b) & np.uint64(1)) << np.uint64(i)
    return out


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints that are words, or rows of words."""
    d = np.bitwise_count(x ^ y)
    return d if d.ndim == 1 else d.sum(axis=1, dtype=np.int16)


class BkForest:
    """BK-trees of many shards at once, in arrays. fps: distinct within a shard, words or rows of words; rows are sorted by shard."""

    def __init__(self, shard: np.ndarray, fps: np.ndarray):
        n = len(fps)
        self.fps, self.depth = fps, 0
        self.base = base = 128 * (fps.shape[1] if fps.ndim > 1 else 1)  # above any distance
        self.edge = np.full(n, -1, np.int16)  # distance to the parent
        self.parent = np.full(n, -1, np.int64)
        group, left = shard.astype(np.int64), np.arange(n)
        self.root = np.unique(group, return_index=True)[1]
        above, order = np.full(n, -1, np.int64), []
        while len(left):
            # the first of each (parent, distance) becomes a node, the others go below it
            if self.depth == 0:
                _, first, inverse = np.unique(group[left], return_index=True, return_inverse=True)
            else:
                key = above[left] * base + self.edge[left]
                _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            nodes = left[first]
            self.parent[nodes] = above[nodes]
            order.append(nodes)
            rest = np.ones(len(left), bool)
            rest[first] = False
            under = nodes[inverse[rest]]
            left = left[rest]
            above[left] = under
            self.edge[left] = distance(fps[left], fps[under])
            self.depth += 1
        child = np.flatnonzero(self.parent >= 0)
        self.children = child[np.lexsort((self.edge[child], self.parent[child]))]
        self.keys = self.parent[self.children] * base + self.edge[self.children]  # sorted

    def search(self, fps: np.ndarray, root: np.ndarray, radius: int):
        """Pairs (query, node) within the radius, queries starting at their root node; yields one level's at a time."""
        q, node = np.arange(len(fps)), root
        while len(q):
            d = distance(fps[q], self.fps[node]).astype(np.int64)
            hit = d <= radius
            yield q[hit], node[hit]
            lo = np.searchsorted(self.keys, node * self.base + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.keys, node * self.base + np.minimum(d + radius, self.base - 1), side="right")
            n = hi - lo
            q = np.repeat(q, n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            node = self.children[at]


def _roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent (each place's smallest linked place so far) after the links a-b as well."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def shard_links(shard: np.ndarray, fps: np.ndarray, radius: int = RADIUS, block: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b), a > b in their linked group: a spanning forest of the pairs within the radius in each shard."""
    if not len(fps):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(shard, kind="stable")
    fps_in, shard_in = fps[order], shard[order]
    forest = BkForest(shard_in, fps_in)
    starts = np.flatnonzero(np.r_[True, shard_in[1:] != shard_in[:-1]])
    root = np.repeat(starts, np.diff(np.r_[starts, len(fps_in)]))
    parent = np.arange(len(fps_in))
    for at in range(0, len(fps_in), block):
        for q, node in forest.search(fps_in[at : at + block], root[at : at + block], radius):
            parent = _roots(parent, q + at, node)
    linked = np.flatnonzero(parent != np.arange(len(parent)))
    return order[linked], order[parent[linked]]


@lru_cache(maxsize=4096)
def _plan(path: int, radius: int) -> list[list[int]]:
    """The bands of the bits that a shard hasn't been split by. path: which band was taken each time, from 1, in base radius + 2."""
    taken = []
    while path:
        path, band = divmod(path, radius + 2)
        taken.append(band - 1)
    left = list(range(64))
    for band in reversed(taken):
        own = set(bands(left, radius + 1)[band])
        left = [b for b in left if b not in own]
    return bands(left, radius + 1)


def _split(rows: DataFrame, radius: int) -> DataFrame:
    """Rows (key, path, fp) of shards, once for each band of the bits left; its value is mixed into the key."""

    def each(batches):
        for b in batches:
            key, path, fp = (b.column(c).to_numpy() for c in range(3))
            for p in np.unique(path).tolist():
                own = path == p
                for i, bits in enumerate(_plan(p, radius)):
                    mixed = (key[own].view(np.uint64) + np.uint64(i + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ _key(fp[own].view(np.uint64), bits) * np.uint64(0xC2B2AE3D27D4EB4F)
                    mixed ^= mixed >> np.uint64(29)
                    columns = [pa.array(mixed.view(np.int64)), pa.array(np.full(len(mixed), p * (radius + 2) + i + 1)), pa.array(fp[own])]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "path", "fp"])

    return rows.mapInArrow(each, "key long, path long, fp long")


def _shards(nodes: DataFrame, radius: int, hot: int) -> DataFrame:
    """key, path, fp: the nodes once for each shard that they are in, all shards of at most `hot` nodes and none of one."""
    rows, out = nodes.select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("path"), "fp"), None
    while True:
        rows = _split(rows, radius)
        full = rows.groupBy("key", "path").count().where("count > 1")  # a shard of one has no pair
        rows = rows.join(full, ["key", "path"])
        usual = rows.where(F.col("count") <= hot).select("key", "path", "fp")
        out = usual if out is None else out.union(usual)
        rows = cut(rows.where(F.col("count") > hot).select("key", "path", "fp"))
        if rows.isEmpty():
            return out


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """a, b (fingerprints): enough links to join all of nodes (fp, distinct) that are within the radius of each other.

    Distinct fingerprints that agree in all but k bits are at most 2 ** k, so splitting ends where `hot` is above 2 ** radius.
    """
    rows = _shards(nodes, radius, max(hot, 2 << radius)).repartition("key", "path").sortWithinPartitions("key", "path", "fp")

    def links(batches):
        def done(keys, fps):
            shard = np.unique(keys, axis=0, return_inverse=True)[1].reshape(-1)
            a, b = shard_links(shard, fps, radius)
            return pd.DataFrame({"a": fps[a].view(np.int64), "b": fps[b].view(np.int64)})

        kept = None
        for b in batches:  # shards come whole: the last one of a batch waits for the next batch
            keys = b[["key", "path"]].to_numpy(np.int64)
            fps = b["fp"].to_numpy(np.int64).view(np.uint64)
            if kept is not None:
                keys, fps = np.concatenate((kept[0], keys)), np.concatenate((kept[1], fps))
            same = (keys == keys[-1]).all(axis=1)
            cut_at = len(keys) - int(same.sum())
            if cut_at:
                yield done(keys[:cut_at], fps[:cut_at])
            kept = keys[cut_at:], fps[cut_at:]
        if kept is not None and len(kept[0]):
            yield done(*kept)

    return rows.mapInPandas(links, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links of at most radius bits).

    Null and empty texts have fingerprint zero and link like any other. Rows with null ids take part but don't name a
    component (a component of such rows only has a null component_id). Equal rows each come out. No rows, no rows.
    """
    marked = cut(fingerprints(docs, doc_id, text))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = cut(components(cut(fingerprint_links(nodes.select("fp"), radius))))
    nodes = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    named = nodes.groupBy("c").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(named, "c").select("fp", "component_id")
    return marked.join(nodes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
