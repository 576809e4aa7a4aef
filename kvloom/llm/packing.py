"""Best-fit packing by minimum bin slack.

Documents are tokenized, cut where longer than a sequence, and counted by length. Bins are filled one after another:
the longest piece left starts a bin and a subset-sum over the lengths left, as a bitset in one integer, finds the
fullest combination with it. The combination is removed as often as the counts allow, so the plan works on at most
CAPACITY counts and has a few thousand patterns at any input size. A piece then takes its place by its rank among
the pieces of its length.

Scale: only the counts by length (at most CAPACITY rows) and the plan touch the driver. Ranks come from (length,
slice) groups, so a length that a third of the pieces have is spread over slices. Tokenizing runs once.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, slices, table

CAPACITY = 2048
CACHED_WORDS = 600_000


class WordCache:
    """Ids of a text. The tokenizer splits at white space first, so a word's ids don't depend on its neighbours.

    Words of Latin letters, perhaps with punctuation after them, go straight to the merges, lower-cased as the
    tokenizer's normaliser would; all others go through the whole tokenizer. One cache serves a Python worker's tasks.
    """

    _of: dict[str, WordCache] = {}

    @classmethod
    def at(cls, path: str) -> WordCache:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge, self.known = self.tokenizer.model.tokenize, {}
        whole = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: these stand for themselves
        rest = [x for x in range(256) if x not in set(whole)]
        self.letters = {x: chr(x) for x in whole} | {x: chr(256 + i) for i, x in enumerate(rest)}

    def _model(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin1").translate(self.letters)
        return array("I", [x.id for x in self.merge(shown)]).tobytes()

    def word(self, w: str) -> bytes:
        m = _SIMPLE.fullmatch(w)
        if not m:
            return array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes()
        core, after = m.groups()
        core = core.lower()
        out = self.known.get(core)
        if out is None:
            out = self.known[core] = self._model(core)
        if after:
            tail = self.known.get(after)
            if tail is None:
                tail = self.known[after] = self._model(after)
            out += tail
        return out

    def ids(self, text: str) -> np.ndarray:
        # an added token may take white space around it, so such texts go whole
        if "<|" in text or not _plain(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        words, known = text.split(), self.known
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > CACHED_WORDS:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = self.word(w)  # array("I") has the machine's order: little-endian here
        return np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<u4")


#: Letters up to U+00FF, then ASCII punctuation (no apostrophe, which the tokenizer may bind to letters).
_SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")


def _plain(text: str) -> bool:
    """Whether str.split() cuts the text only where the tokenizer's own pattern does."""
    return text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") or not any(ord(c) in _ODD for c in set(text))


#: Code points on which two notions of white space differ, or that normalisation could join over a cut.
_ODD = frozenset([0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF, *range(0x300, 0x370)])


def tokenize_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each row (null text: empty).

    Without a path each worker looks up where its own machine has the tokenizer.
    """

    def pieces(batches):
        cache = WordCache.at(path or default_tokenizer())
        for b in batches:
            rows = []
            for i, t in enumerate(b.column(1)):
                ids = np.append(cache.ids(t.as_py() or ""), np.uint32(0)).astype("<u4", copy=False)
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
            at, k, start, length, crc = (np.array(x, dtype=np.int64) for x in zip(*rows)) if rows else [np.empty(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(k.astype("int32")), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """A multiset of the lengths, within their counts, with the largest sum up to room; long ones are tried first."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out += [length] * take
            at -= length * take
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: copies}) for the bins, in the order of filling. Every counted piece is in one bin."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        seed = max(left)
        left[seed] -= 1
        chosen = fullest(left, capacity - seed) if seed < capacity else []
        left[seed] += 1
        use: dict[int, int] = {seed: 1}
        for x in chosen:
            use[x] = use.get(x, 0) + 1
        times = min(left[x] // n for x, n in use.items())
        out.append((times, use))
        for x, n in use.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with a length column, 1 to capacity) plus sequence_id and offset; offsets in a sequence leave no gap."""
    spark = pieces.sparkSession
    pieces = cut(pieces)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs: dict[int, list] = {}
    base, used = 0, {}
    for times, use in plan(counts, capacity):
        at = 0
        for length, n in use.items():
            lo = used.get(length, 0)
            runs.setdefault(length, []).append((lo, base, n, at))
            used[length] = lo + n * times
            at += n * length
        base += times
    known = spark.sparkContext.broadcast({k: np.array(v, dtype=np.int64) for k, v in runs.items()})
    n_slices = slices(sum(counts.values()), 20_000)
    rows = pieces.withColumn("__slice", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(n_slices)).cast("int"))
    part = rows.groupBy("length", "__slice").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("length").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.select("length", "__slice", before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("length", "__slice").orderBy("doc_id", "piece", "ids_crc32")) - 1
    rows = rows.withColumn("__own", own).join(part, ["length", "__slice"]).withColumn("__rank", F.col("__before") + F.col("__own"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for x in np.unique(lengths):
            own, runs = np.flatnonzero(lengths == x), known.value[int(x)]
            k = np.searchsorted(runs[:, 0], ranks[own], side="right") - 1
            past = ranks[own] - runs[k, 0]
            seq[own] = runs[k, 1] + past // runs[k, 2]
            off[own] = runs[k, 3] + past % runs[k, 2] * x
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return rows.withColumn("__at", place("length", "__rank")).select(*pieces.columns, "__at.sequence_id", "__at.offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every row of docs, tokenized, ended by id 0, cut at capacity and packed. See pack and tokenize_pieces.

    Null and empty texts are one piece of one id. Rows with equal ids are packed each for itself. No rows, no pieces.
    """
    return pack(tokenize_pieces(docs, path, capacity), capacity)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
