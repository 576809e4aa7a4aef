"""Line dedup over a whole corpus, with an edit-distance join on segments.

Lines (without white space at their ends) that are equal are alike; so are lines of at least SHORTEST code points that are
within EDITS edits. A line of length l is cut into EDITS + 1 segments, one of which must occur unchanged, at nearly its
place, in any line within EDITS edits; so each line is indexed by its segments and probes, for its own and each length up to
EDITS below, the substrings that the multi-match-aware selection leaves. Lines that meet are compared by length and by
counts of characters, and then by a banded bit-parallel edit distance. Classes are the components of the links; of each
class only its first line (smallest doc_id, then line number) stays.

A segment that over HOT_ROWS rows share (lines made from one template) is refined instead of compared: what lies left and
right of it must be within the edits that are left there, so the longest such rest is cut into segments in turn, and lines
meet only if they share one of these as well, as often as it takes. Where nothing is left to be cut, and the rows are still
many, they are dealt out in blocks. In these steps lines are verified where they meet, and each block gives a spanning
forest of its links, never all pairs. So what is compared grows with the lines and not with the square of a template's.

Scale: keys move as three longs, never with texts but for lines of hot keys; equal lines are one row. Keys without both an
indexed and a probing line are dropped where they are sorted. Texts are fetched only for lines of candidate pairs. Tables
that steer a pass over the texts (wanted lines, lines to drop) are broadcast up to SENT rows, as arrays, and joined by a
shuffle beyond. Lines are equal by 128 bits; candidates go by 64 of them and are verified on the lines themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .graph import components

EDITS = 2
SHORTEST = 20
SENT = 1_000_000
BLOCK = 1024
HOT_ROWS = 4096
_COUNTERS = 11  # of four bits each
_LOW = (1 << 64) - 1


def segments(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """(start, length) of edits + 1 segments, the longer ones last."""
    n, out, at = edits + 1, [], 0
    for i in range(n):
        size = length // n + (i >= n - length % n)
        out.append((at, size))
        at += size
    return out


def probes(length: int, shorter: int, edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(segment, start, length) of the substrings with which a line of `length` probes the segments of lines of `shorter`."""
    gap, out = length - shorter, []
    for i, (start, size) in enumerate(segments(shorter, edits)):
        left, right = i, edits - i
        lo = max(0, start - left, start + gap - right)
        hi = min(length - size, start + left, start + gap + right)
        out += [(i, at, size) for at in range(lo, hi + 1)]
    return out


_plans: dict[int, tuple] = {}


def _plan(length: int) -> tuple:
    """What a line of this length is indexed and probed by: (seed, start, end)."""
    if length not in _plans:
        own = [(length * 8 + i, a, a + n) for i, (a, n) in enumerate(segments(length))]
        asks = [(x * 8 + i, a, a + n) for x in range(max(SHORTEST, length - EDITS), length + 1) for i, a, n in probes(length, x)]
        if len(_plans) > 50_000:
            _plans.clear()
        _plans[length] = own, asks
    return _plans[length]


def signature(line: str) -> int:
    """Counts of characters by code point modulo the number of counters, each modulo 16, and the length modulo 65536."""
    data = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.bincount(data % _COUNTERS, minlength=_COUNTERS) & 15
    return int(sum(int(c) << 4 * i for i, c in enumerate(counts))) | (len(line) & 0xFFFF) << 44


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether edits of each pair of signatures' lines could be within EDITS, for all pairs."""
    fit = np.ones((len(a), len(b)), bool)
    d = ((a[:, None] >> 44) - (b[None, :] >> 44)) & 0xFFFF
    fit &= np.minimum(d, 65536 - d) <= EDITS
    total = np.zeros(fit.shape, np.int16)
    for i in range(_COUNTERS):
        d = ((a >> 4 * i & 15)[:, None] - (b >> 4 * i & 15)[None, :]) & 15
        total += np.minimum(d, 16 - d).astype(np.int16)
    return fit & (total <= 2 * EDITS)


def within(a: str, b: str, k: int = EDITS) -> bool:
    """Whether a and b are within k edits: common ends are cut off, then a band of 2k+1 bits follows the diagonal."""
    if abs(len(a) - len(b)) > k:
        return False
    if a == b:
        return True
    start, most = 0, min(len(a), len(b))
    lo, hi = 0, most  # first difference, by halves
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[start:mid] == b[start:mid]:
            lo, start = mid, mid
        else:
            hi = mid - 1
    a, b = a[lo:], b[lo:]
    most, lo = min(len(a), len(b)), 0
    hi = most
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[len(a) - mid :] == b[len(b) - mid :]:
            lo = mid
        else:
            hi = mid - 1
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    n, m = len(a), len(b)
    if not n or not m:
        return n + m <= k
    if n <= k:
        return _plain(a, b) <= k
    width = 2 * k + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    up, down, score = mask & ~((1 << k) - 1), 0, k
    for j in range(1, m + 1):
        c, x = b[j - 1], 0
        for i in range(max(1, j - k), min(n, j + k) + 1):
            if a[i - 1] == c:
                x |= 1 << (i - j + k)
        d0 = ((((x & up) + up) ^ up) | x | down) & mask
        right_up, right_down = (down | ~(d0 | up)) & mask, d0 & up
        if j + k <= n:
            score += not d0 & top
        else:
            bit = 1 << (n - j + k)
            score += bool(right_up & bit) - bool(right_down & bit)
        up, down = (right_down | ~((d0 >> 1) | right_up)) & mask, (d0 >> 1) & right_up
    return score <= k


def _plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def eligible(text: str | None, least: int = SHORTEST):
    """(line number, line, its 128-bit key) of the lines of at least `least` code points; blank lines never take part."""
    for i, line in enumerate((text or "").split("\n")):
        line = line.strip()
        if len(line) >= max(least, 1):
            yield i, line, xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))


def _halves(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys as two longs: h, the lower 64 bits, and hi."""
    return _signed([k & _LOW for k in keys]), _signed([k >> 64 for k in keys])


def _signed(x) -> np.ndarray:
    return np.array(x, dtype=np.uint64).view(np.int64)


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = SHORTEST) -> DataFrame:
    """h, hi, n, first (doc_id, no): each line that takes part, how often it occurs and where first. Null ids take no part."""

    def each(batches):
        for b in batches:
            ids, at, no, keys = b.column(0), [], [], []
            for r, t in enumerate(b.column(1)):
                for i, _, key in eligible(t.as_py(), least):
                    at.append(r)
                    no.append(i)
                    keys.append(key)
            h, hi = _halves(keys)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(h), pa.array(hi)], ["doc_id", "no", "h", "hi"])

    rows = _texts(docs, doc_id, text).where("doc_id is not null").mapInArrow(each, "doc_id long, no int, h long, hi long")
    return rows.groupBy("h", "hi").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "no")).alias("first"))


def segment_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """key, h, meta for the segments (role 0) and probes (role 1, in the sign bit of meta) of each line; some repeat."""

    def each(batches):
        seen: set[int] = set()
        digest = xxhash.xxh64_intdigest
        for b in batches:
            keys, hs, metas = [], [], []
            for t in b.column(1):
                for _, line, h in eligible(t.as_py()):
                    h &= _LOW
                    if h in seen:
                        continue
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(h)
                    own, asks = _plan(len(line))
                    meta = signature(line)
                    flat = line if not line.isascii() else line.encode()
                    keys += [digest(flat[a:e], s) for s, a, e in own]
                    keys += [digest(flat[a:e], s) for s, a, e in asks]
                    hs += [h] * (len(own) + len(asks))
                    metas += [meta] * len(own) + [meta | 1 << 63] * len(asks)
                    if len(keys) > 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(_signed(x)) for x in (keys, hs, metas)], ["key", "h", "meta"])
                        keys, hs, metas = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(_signed(x)) for x in (keys, hs, metas)], ["key", "h", "meta"])

    return _texts(docs, doc_id, text).where("doc_id is not null").mapInArrow(each, "key long, h long, meta long")


def _pairs(h: np.ndarray, meta: np.ndarray):
    """Of one key's rows: (smaller, larger) of an indexed and a probing line that may be within EDITS."""
    asks = meta < 0
    hi, at = np.unique(h[~asks], return_index=True)
    mi = meta[~asks][at]
    hp, at = np.unique(h[asks], return_index=True)
    mp = meta[asks][at] & 0x7FFFFFFFFFFFFFFF
    for x in range(0, len(hi), BLOCK):
        for y in range(0, len(hp), BLOCK):
            i, j = np.nonzero(_gaps(mi[x : x + BLOCK], mp[y : y + BLOCK]) & (hi[x : x + BLOCK, None] != hp[None, y : y + BLOCK]))
            if len(i):
                yield np.minimum(hi[x + i], hp[y + j]), np.maximum(hi[x + i], hp[y + j])


def _meet(keys: DataFrame, hot: int | None) -> DataFrame:
    """a, b for the pairs of each key (key null); rows of keys with over `hot` rows go on as they are (a: h, b: meta)."""

    def batch(a, b, key=None):
        keys = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), keys], ["a", "b", "key"])

    def done(key, h, meta):
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[start[1:], len(key)]
        both = (np.minimum.reduceat(meta, start) < 0) & (np.maximum.reduceat(meta, start) >= 0) & (np.minimum.reduceat(h, start) != np.maximum.reduceat(h, start))
        found = []
        for s, e in zip(start[both].tolist(), ends[both].tolist()):
            if hot and e - s > hot:
                yield batch(h[s:e], meta[s:e], key[s:e])
            else:
                found += _pairs(h[s:e], meta[s:e])
        if found:
            yield batch(*np.unique(np.stack([np.concatenate(x) for x in zip(*found)]), axis=1))

    def each(batches):
        held, passing = None, None  # rows of the last key so far; the hot key whose rows go on
        for f in batches:
            now = [f.column(i).to_numpy() for i in range(3)]
            if passing is not None:
                n = int(np.searchsorted(now[0], passing, side="right"))
                if n:
                    yield batch(now[1][:n], now[2][:n], now[0][:n])
                now = [x[n:] for x in now]
                if len(now[0]):
                    passing = None
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            n = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on in the next batch
            if n:
                yield from done(*(x[:n] for x in now))
            held = [x[n:] for x in now]
            if hot and len(held[0]) > hot:
                yield batch(held[1], held[2], held[0])
                passing, held = held[0][0], None
        if held is not None and len(held[0]):
            yield from done(*held)

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(max(n, 8), "key").sortWithinPartitions("key").mapInArrow(each, "a long, b long, key long")


def candidates(keys: DataFrame, hot: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """a, b (a < b): different lines that share a key, one indexed and one probing, and may be within EDITS; and key, h,
    meta of the keys with over `hot` rows, which are not compared here.
    """
    met = cut(_meet(keys, hot))
    return met.where("key is null").select("a", "b").distinct(), met.where("key is not null").select("key", F.col("a").alias("h"), F.col("b").alias("meta"))


def rests(length: int, shorter: int, i: int, at: int) -> list[int]:
    """What is left of a line of `length` when segment i of lines of length `shorter` is at `at`.

    Four numbers for each rest: start, end, the length that it has in the indexed lines, and the edits left for it. Rests
    that edits could replace whole say nothing and are left out.
    """
    start, size = segments(shorter)[i]
    return _useful([(0, at, start, i), (at + size, length, shorter - start - size, EDITS - i)])


def _useful(found: list[tuple]) -> list[int]:
    return [x for rest in found if rest[2] > rest[3] for x in rest]


def finer(key: int, probing: bool, state: list[int]):
    """(key, start, end, state) of the segments of the longest rest, for an indexed line or the substrings of a probing one."""
    all_rests = [tuple(state[x : x + 4]) for x in range(0, len(state), 4)]
    k = max(range(len(all_rests)), key=lambda x: all_rests[x][2])
    a, e, m, t = all_rests[k]
    others = all_rests[:k] + all_rests[k + 1 :]
    gap = e - a - m
    for j, (s, size) in enumerate(segments(m, t)):
        lo, hi = (max(0, s - j, s + gap - (t - j)), min(e - a - size, s + j, s + gap + t - j)) if probing else (s, s)
        for at in range(lo, hi + 1):
            new = _useful([*others, (a, a + at, s, j), (a + at + size, e, m - s - size, t - j)])
            yield (key * 31 + k * 8 + j + 1) & _LOW, a + at, a + at + size, new


_FINE = "key long, h long, meta long, line string, state array<int>"
_FINE_ARROW = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("meta", pa.int64()), ("line", pa.string()), ("state", pa.list_(pa.int32()))])


def _fine_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((),) * len(_FINE_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FINE_ARROW)], schema=_FINE_ARROW)


def _refined(rows: DataFrame, first: bool) -> DataFrame:
    """Rows of hot keys (key, h, meta, line, and state unless first) once for each finer segment."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    digest = xxhash.xxh64_intdigest

    def states(key, meta, line):
        """What the rests are where the line's own plan gave this key."""
        probing = meta < 0
        for seed, a, e in _plan(len(line))[probing]:
            if signed(digest(line[a:e], seed)) == key:
                yield rests(len(line), seed >> 3, seed & 7, a)

    def each(batches):
        for b in batches:
            out = []
            for key, h, meta, line, *state in zip(*(c.to_pylist() for c in b.columns)):
                for own in states(key, meta, line) if first else state:
                    if not own:  # nothing to be cut: the key stays as it is
                        out.append((key, h, meta, line, own))
                        continue
                    for seed, a, e, new in finer(key & _LOW, meta < 0, own):
                        out.append((signed(digest(line[a:e], seed)), h, meta, line, new))
                if len(out) >= 20_000:
                    yield _fine_batch(out)
                    out = []
            yield _fine_batch(out)

    return rows.mapInArrow(each, _FINE)


def forest(h: np.ndarray, meta: np.ndarray, line: list[str]):
    """(h, h) of a spanning forest of the links within EDITS between the indexed and the probing lines of one key."""
    at = {x: i for i, x in enumerate(h.tolist())}
    root = {x: x for x in at}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in _pairs(h, meta):
        for x, y in zip(a.tolist(), b.tolist()):
            rx, ry = top(x), top(y)
            if rx != ry and within(line[at[x]], line[at[y]]):
                root[rx] = ry
                yield x, y


def _settle(rows: DataFrame, hot: int | None) -> DataFrame:
    """Links (key null, h and meta the two lines) of the keys of fine rows; rows of keys with over `hot` rows go on as they are."""

    def links(t: pa.Table):
        h, meta = t["h"].to_numpy(), t["meta"].to_numpy()
        if len(h) > 1 and (meta < 0).any() and (meta >= 0).any():
            found = [(None, x, y, None, None) for x, y in forest(h, meta, t["line"].to_pylist())]
            if found:
                yield _fine_batch(found)

    def each(batches):
        held, passing = None, None
        for b in batches:
            if not b.num_rows:
                continue
            now = pa.Table.from_batches([b]).cast(_FINE_ARROW)
            if passing is not None:
                n = int(np.searchsorted(now["key"].to_numpy(), passing, side="right"))
                yield from now.slice(0, n).to_batches()
                now = now.slice(n)
                passing = passing if not now.num_rows else None
            held = pa.concat_tables([held, now]) if held is not None else now
            if not held.num_rows:
                continue
            key = held["key"].to_numpy()
            starts = [*np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist(), len(key)]
            for s, e in zip(starts[:-2], starts[1:-1]):
                if hot and e - s > hot:
                    yield from held.slice(s, e - s).to_batches()
                else:
                    yield from links(held.slice(s, e - s))
            held = held.slice(starts[-2])
            if hot and held.num_rows > hot:
                yield from held.to_batches()
                passing, held = int(key[-1]), None
        if held is not None and held.num_rows:
            yield from links(held)

    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(each, _FINE)


def hot_links(rows: DataFrame, lines: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """a, b: links that join all lines within EDITS that share one of the hot keys of rows (key, h, meta).

    Each step divides a rest at least in two, so there are about as many steps as the longest line has halvings.
    """
    links, level = [], _refined(rows.join(lines, "h").select("key", "h", "meta", "line"), True)
    while True:
        met = cut(_settle(level, hot))
        links.append(met.where("key is null").select(F.col("h").alias("a"), F.col("meta").alias("b")))
        rest = met.where("key is not null")
        done = rest.where(F.size("state") == 0)
        if not done.isEmpty():
            # every part of a key's indexed lines meets every part of its probing ones in one block
            sizes = done.groupBy("key").agg(F.ceil(F.count("*") / hot).cast("int").alias("s"))
            dealt = done.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("h"), F.col("s").cast("long"))).withColumn("other", F.explode(F.expr("sequence(0, s - 1)")))
            block = F.when(F.col("meta") >= 0, F.xxhash64("key", "own", F.col("other").cast("long"))).otherwise(F.xxhash64("key", F.col("other").cast("long"), "own"))
            dealt = dealt.select(block.alias("key"), "h", "meta", "line", "state")
            links.append(cut(_settle(dealt, None)).select(F.col("h").alias("a"), F.col("meta").alias("b")))
        rest = rest.where(F.size("state") > 0)
        if rest.isEmpty():
            break
        level = _refined(rest, False)
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out.distinct()


def texts_of(docs: DataFrame, wanted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """h, line for the lines of docs that wanted (h, distinct) names."""
    some = wanted.limit(SENT + 1).count()
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in wanted.collect()], np.int64))) if some <= SENT else None

    def each(batches):
        seen: set[int] = set()
        for b in batches:
            lines = [(line, h) for t in b.column(1) for _, line, h in eligible(t.as_py())]
            h = _halves([h for _, h in lines])[0]
            if sent is not None and len(sent.value):
                at = np.minimum(np.searchsorted(sent.value, h), len(sent.value) - 1)
                mine = np.flatnonzero(sent.value[at] == h)
            else:
                mine = np.arange(len(h) if sent is None else 0)
            new = []
            for x, key in zip(mine.tolist(), h[mine].tolist()):
                if key not in seen:
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(key)
                    new.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(h[new] if new else [], pa.int64()), pa.array([lines[x][0] for x in new], pa.string())], ["h", "line"])

    got = _texts(docs, doc_id, text).where("doc_id is not null").mapInArrow(each, "h long, line string")
    if sent is None:
        got = got.join(wanted, "h", "left_semi")
    return got.groupBy("h").agg(F.first("line").alias("line"))


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT_ROWS) -> DataFrame:
    """a, b: the keys of different lines within EDITS; of lines that share a hot key enough of them to join all."""
    pairs, rows = candidates(segment_keys(docs, doc_id, text), hot)
    pairs = cut(pairs)
    wanted = cut(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).union(rows.select("h")).distinct())
    lines = cut(texts_of(docs, wanted, doc_id, text))
    both = pairs.join(lines.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(lines.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")

    def each(batches):
        for b in batches:
            good = [within(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in b.columns[:2]], ["a", "b"])

    found = both.select("a", "b", "x", "y").mapInArrow(each, "a long, b long")
    return found if rows.isEmpty() else found.union(hot_links(rows, lines, hot))


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = SHORTEST) -> DataFrame:
    """h, hi, doc_id, no: each line (by key) of a class with several lines or occurrences, and where the class is first."""
    seen = cut(occurrences(docs, doc_id, text, least))
    joined = cut(components(cut(links(docs, doc_id, text))))
    marked = seen.join(joined, seen["h"] == joined["node"], "left").select("h", "hi", "n", "first", F.coalesce("component", "h").alias("c"), F.col("component").isNotNull().alias("linked"))
    heads = marked.where("linked").groupBy("c").agg(F.min("first").alias("head"))
    near = marked.where("linked").join(heads, "c").select("h", "hi", "head")
    same = marked.where("not linked and n > 1").select("h", "hi", F.col("first").alias("head"))
    return near.union(same).select("h", "hi", "head.doc_id", "head.no")


class Heads:
    """The first place of each repeated line's class, in arrays sorted by key."""

    def __init__(self, h: np.ndarray, hi: np.ndarray, doc_id: np.ndarray, no: np.ndarray):
        order = np.argsort(h, kind="stable")
        self.h, self.hi, self.doc_id, self.no = h[order], hi[order], doc_id[order], no[order]

    def elsewhere(self, h: np.ndarray, hi: np.ndarray, doc_id: np.ndarray, no: np.ndarray) -> np.ndarray:
        """Which of the lines (by key and place) have their class's first line at another place."""
        lo, end = np.searchsorted(self.h, h, side="left"), np.searchsorted(self.h, h, side="right")
        out = np.zeros(len(h), bool)
        for k in range(int((end - lo).max(initial=0))):  # once, but for keys that share their lower half
            at = np.minimum(lo + k, len(self.h) - 1)
            out |= (lo + k < end) & (self.hi[at] == hi) & ((self.doc_id[at] != doc_id) | (self.no[at] != no))
        return out


def deduplicated(docs: DataFrame, *keep: str, doc_id: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """keep, __n_lines, __n_dropped, __text (without repeated lines) for each row.

    Equal lines of at least `least` code points count as repeated, and lines of at least SHORTEST that are nearly equal.
    Null texts stay null (no lines). A row whose id is null keeps all its lines and names no class. Rows with one id are
    one document: a line at the same place of each stays in each if it stays in one. Line breaks between kept lines stay.
    """
    steer = cut(repeated(docs, doc_id, text, least))
    few = steer.limit(SENT + 1).count() <= SENT
    given = docs.select(*keep, F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("__text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[: len(keep)])
    if few:
        held = steer.toPandas()  # at most SENT rows
        sent = docs.sparkSession.sparkContext.broadcast(Heads(*(held[c].to_numpy(np.int64) for c in ("h", "hi", "doc_id", "no"))))
    else:
        # every line that is repeated, to its document; the hot ones spread by their places
        def places(batches):
            for b in batches:
                rows = [(r, i, h) for r, t in enumerate(b.column(1)) for i, _, h in eligible(t.as_py(), least)]
                at, no, keys = zip(*rows) if rows else ((), (), ())
                h, hi = _halves(keys)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(h), pa.array(hi)], ["__id", "__no", "h", "hi"])

        spread = 16
        at = given.where("__id is not null").select("__id", "__text").mapInArrow(places, "__id long, __no int, h long, hi long").withColumn("s", F.pmod(F.xxhash64("__id"), F.lit(spread)))
        heads = steer.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        gone = at.join(heads, ["h", "hi", "s"]).where("__id <> doc_id or __no <> no").groupBy("__id").agg(F.collect_set(F.struct("__no", "h")).alias("__gone"))
        given = given.join(gone, "__id", "left").select(*keep, "__id", "__text", "__gone")

    def each(batches):
        k = len(keep)
        for b in batches:
            texts, ids = b.column(k + 1).to_pylist(), b.column(k)
            gone: list[set] = [set() for _ in texts]
            if few:
                found = [(r, no, key) for r, t in enumerate(texts) if t and ids[r].is_valid for no, _, key in eligible(t, least)]
                if found:
                    row, no, keys = zip(*found)
                    row, no = np.array(row), np.array(no)
                    drop = sent.value.elsewhere(*_halves(keys), ids.fill_null(0).to_numpy(zero_copy_only=False)[row], no)
                    for r, x in zip(row[drop].tolist(), no[drop].tolist()):
                        gone[r].add(x)
            else:
                for r, t in enumerate(texts):
                    named = {(x["__no"], x["h"]) for x in b.column(k + 2)[r].as_py() or ()} if ids[r].is_valid else ()
                    # rows of one id may differ: a place is dropped where it holds the line
                    if named:
                        own = list(eligible(t, least))
                        gone[r] = {no for (no, _, _), h in zip(own, _halves([x[2] for x in own])[0].tolist()) if (no, h) in named}
            out, n_lines = [], []
            for t, drop in zip(texts, gone):
                lines = t.split("\n") if t else []
                out.append("\n".join(x for no, x in enumerate(lines) if no not in drop) if drop else t)
                n_lines.append(len(lines))
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(n_lines, pa.int32()), pa.array(map(len, gone), pa.int32()), pa.array(out, pa.string())], [*keep, "__n_lines", "__n_dropped", "__text"])

    return given.mapInArrow(each, f"{kinds}__n_lines int, __n_dropped int, __text string")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, text for each row of documents."""
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.col("__text").alias("text"))


def without_repeats(docs: DataFrame, least: int = SHORTEST) -> DataFrame:
    """docs with repeated lines dropped from text (and n_chars counted anew); rows of which no text is left go.

    Lines below `least` code points stay: "Yes." may be said in many documents.
    """
    columns = docs.columns
    out = deduplicated(docs, *columns, least=least).where("__n_dropped = 0 or trim(__text) <> ''")
    new = {"text": F.col("__text"), "n_chars": F.when(F.col("__n_dropped") > 0, F.length("__text")).otherwise(F.col("n_chars") if "n_chars" in columns else F.lit(0)).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns])
