"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic texts, one on windows of ordinary texts. A window is a
word (letters only, at most WINDOW characters a piece), with each character spelt as SPELL fixed bytes, so that the
coder's least match and its fixed costs don't hide single letters. A window is compressed with each dictionary; the
pair of lengths is looked up in a table of log likelihood ratios, calibrated on labelled texts that had no part in
fitting the dictionaries. A text's score is a logistic curve of the sum over its windows.

Toxic texts are mostly ordinary words, so their dictionary is trained on the windows that set them apart: those with a
run of characters that several unrelated toxic texts of the fitting half share and that is many times as common there.
Both dictionaries are trained by zstandard; after what the trainer keeps of the toxic windows, which is too few for it,
all of them follow whole. Windows of several words, or all windows of toxic texts, don't work here: see the README.

Scale: one pass over the texts, no shuffle of texts. Dictionaries and table are below 200 kB together. They are fitted
on at most FIT_TEXTS labelled texts and FIT_CHARACTERS characters of each class, chosen by a hash of the id; lengths of
known words are kept in a bounded cache in each worker.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, given_names, remainder, table

FIT_TEXTS = 3000
FIT_CHARACTERS = 50_000_000
WINDOW = 24
SPELL = 3
GRAMS = (5, 7, 9)
CUT = 0.7
#: A mark of toxic texts is so many times as common in them.
TIMES = 12
DICTIONARY = 1 << 16
LEVEL = 9
CACHED = 500_000
#: Pairs of lengths below this log likelihood ratio say nothing for toxicity; such windows speak against it by DRIFT.
LEAST = 2.0
DRIFT = -0.01
_LONGEST = 255


def windows(text: str | None) -> Counter:
    """The windows of a text with their counts."""
    out: Counter = Counter()
    for w, n in Counter((text or "").lower().split()).items():
        core = w if w.isalpha() else _LETTERS.sub("", w)
        if core:
            for at in range(0, len(core), WINDOW):
                out[core[at : at + WINDOW]] += n
    return out


_LETTERS = re.compile(r"[\W\d_]+")
_code: dict[str, bytes] = {}


def spelt(window: str) -> bytes:
    out = []
    for c in f"^{window}$":
        b = _code.get(c)
        if b is None:
            b = _code[c] = hashlib.blake2b(c.encode("utf-8", "surrogatepass"), digest_size=SPELL).digest()
        out.append(b)
    return b"".join(out)


def grams(window: str) -> set[str]:
    """Runs of characters of a window, of the lengths in GRAMS, and the whole window, with marks at its ends."""
    marked = f"^{window}$"
    return {marked} | {marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)}


def _families(texts: list[Counter], usual: Counter) -> list[Counter]:
    """The texts without those that share half of their unusual words with earlier ones: copies count once."""
    seen: set[str] = set()
    out = []
    for t in texts:
        odd = {w for w in t if not usual[w]}
        if len(odd) >= 3 and len(odd & seen) > len(odd) / 2:
            continue
        seen |= odd
        out.append(t)
    return out


class Compressors:
    """The two dictionaries, ready to compress; made anew in each process from their bytes."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.dictionaries = ordinary, toxic

    def __reduce__(self):
        return Compressors, self.dictionaries

    def open(self):
        if not hasattr(self, "coders"):
            shape = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
            self.coders = [zstandard.ZstdCompressor(compression_params=shape, dict_data=zstandard.ZstdCompressionDict(d)) for d in self.dictionaries]
        return self.coders

    def lengths(self, window: str) -> tuple[int, int]:
        data, (ordinary, toxic) = spelt(window), self.open()
        return min(len(ordinary.compress(data)), _LONGEST), min(len(toxic.compress(data)), _LONGEST)


class Model:
    def __init__(self, coders: Compressors, ratios: dict[tuple[int, int], float], unseen: float, a: float, b: float):
        self.coders, self.ratios, self.unseen, self.a, self.b = coders, ratios, unseen, a, b
        self.known: dict[str, float] = {}

    def __reduce__(self):
        return Model, (self.coders, self.ratios, self.unseen, self.a, self.b)

    def evidence(self, found: Counter) -> float:
        total, known = 0.0, self.known
        for w, n in found.items():
            r = known.get(w)
            if r is None:
                if len(known) >= CACHED:
                    known.clear()
                r = known[w] = self.ratios.get(self.coders.lengths(w), self.unseen)
            total += n * r
        return total

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.a * math.asinh(self.evidence(windows(text))) + self.b))))


def _train(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the samples; nothing where they are too few for the trainer."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _whole(samples: list[bytes], size: int) -> bytes:
    """The different samples one after the other, the commonest last."""
    return b"".join(x for x, _ in reversed(Counter(samples).most_common()))[-size:]


def fit_texts(ordinary: list[str], toxic: list[str]) -> Model:
    """A model of labelled texts. Every second text trains the dictionaries, the others only calibrate."""
    bags = [[windows(t) for t in dict.fromkeys(texts)] for texts in (ordinary, toxic)]
    usual: Counter = Counter()
    for bag in bags[0][::2]:
        usual.update(bag.keys())
    bags[1] = _families(bags[1], usual)
    learn, check = [b[::2] for b in bags], [b[1::2] for b in bags]
    # runs of characters that several toxic texts share and that are many times as common there
    shared: Counter = Counter()
    for bag in learn[1]:
        shared.update(bag.keys())
    wanted = {g for w, n in shared.items() if n >= 3 for g in grams(w)}
    counts: list[Counter] = [Counter(), Counter()]
    for side, found in ((0, usual), (1, shared)):
        for w, n in found.items():
            for g in grams(w) & wanted:
                counts[side][g] += n
    least = max(4, 0.01 * len(learn[1]))
    marks = {g for g, n in counts[1].items() if n >= least and n * (len(learn[0]) + 1) >= TIMES * (counts[0][g] + 0.5) * (len(learn[1]) + 1)}
    toxic_windows = Counter(w for bag in learn[1] for w in bag if grams(w) & marks)
    ordinary_windows = Counter(w for bag in learn[0] for w in bag)
    samples = [spelt(w) for w, n in sorted(toxic_windows.items()) for _ in range(min(n, 20))]
    usual_samples = [spelt(w) for w, n in sorted(ordinary_windows.items(), key=lambda x: (-x[1], x[0]))[:30_000] for _ in range(min(n, 3))]
    trained = _train(usual_samples, DICTIONARY) or _whole(usual_samples, DICTIONARY) or b"\0" * 8
    apart = _train(samples, max(1024, min(DICTIONARY, sum(len(spelt(w)) for w in toxic_windows)))) + _whole(samples, DICTIONARY) or b"\0" * 8
    coders = Compressors(trained, apart)
    # table of log likelihood ratios of the pairs of lengths
    kept: dict[str, tuple[int, int]] = {}
    cells: list[Counter] = [Counter(), Counter()]
    for c in (0, 1):
        for bag in check[c]:
            for w, n in bag.items():
                if w not in kept:
                    kept[w] = coders.lengths(w)
                cells[c][kept[w]] += min(n, 3)
    totals = [sum(c.values()) for c in cells]
    prior = 2.0
    share = [(t + 1) / (sum(totals) + 2) for t in totals]
    ratios = {}
    for cell in set(cells[0]) | set(cells[1]):
        n0, n1 = (c[cell] for c in cells)
        r = math.log((n1 + prior * share[1]) / (totals[1] + prior)) - math.log((n0 + prior * share[0]) / (totals[0] + prior))
        ratios[cell] = r if r >= LEAST else DRIFT
    model = Model(coders, ratios, DRIFT, 1.0, 0.0)
    m = np.array([math.asinh(model.evidence(bag)) for c in (0, 1) for bag in check[c]])
    y = np.repeat([0.0, 1.0], [len(b) for b in check])
    model.a, model.b = _curve(m, y)
    return model


def _curve(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of the logistic curve of y in m, both classes weighing the same; the middle is moved to score CUT."""
    if not len(m) or len(set(y.tolist())) < 2:
        return 1.0, 0.0
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    design, w = np.stack([m, np.ones_like(m)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = design.T @ (design * (weight * p * (1 - p))[:, None]) + 0.1 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (weight * (y - p)) - 0.1 * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]) + math.log(CUT / (1 - CUT))


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", texts: int = FIT_TEXTS, characters: int = FIT_CHARACTERS) -> Model | None:
    """A model of at most `texts` labelled texts, of at most `characters` together, of each class that aren't held out.

    None if either class has none. Of a document with several labels each counts; labels that aren't 0 or 1, and null
    texts, count for nothing.
    """
    ids = labels.select(F.col("doc_id").alias("__id"), F.col(label).alias("__label")).where(~held_out)
    chosen = None
    for c in (0, 1):
        some = ids.where(F.col("__label") == c).orderBy(F.xxhash64("__id"), "__id").limit(texts)
        chosen = some if chosen is None else chosen.union(some)
    # at most 2 * texts ids: a bounded broadcast
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).where("text is not null")
    found = cut(found.select("__label", "__id", "text", F.length("text").alias("n"), F.xxhash64("text").alias("h")))
    order = lambda r: (hashlib.blake2b(str(r["__id"]).encode()).digest(), r["h"])
    at, most = {0: 0, 1: 0}, set()
    for r in sorted(found.select("__label", "__id", "n", "h").collect(), key=order):
        at[r["__label"]] += r["n"]
        if at[r["__label"]] > characters:
            most.add((r["__label"], r["__id"], r["h"]))
    got = found
    if most:
        gone = docs.sparkSession.createDataFrame(sorted(most), found.select("__label", "__id", "h").schema)
        got = found.join(F.broadcast(gone), ["__label", "__id", "h"], "left_anti")
    got = sorted(got.select("__label", "__id", "text", "h").collect(), key=order)
    sides = [[r["text"] for r in got if r["__label"] == c] for c in (0, 1)]
    return fit_texts(*sides) if all(sides) else None


def score_toxicity(docs: DataFrame, model: Model | None, *keep: str, text: str = "text") -> DataFrame:
    """keep, score, predicted for each row. Null and empty texts have no evidence; without a model all score 0.5.

    A kept column by the name of a result comes back as <name>_given. No rows, no rows.
    """
    kept = given_names(keep, ("score", "predicted"))

    def each(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1)
            s = np.array([model.score(t.as_py()) for t in texts] if model is not None else [0.5] * len(texts), dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= CUT).astype("int32"))], [*kept, "score", "predicted"])

    given = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)), F.col(text).cast("string").alias("__text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    return given.mapInArrow(each, f"{kinds}score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, remainder(F.col("__id"), 3) == 1)
    scored = score_toxicity(docs.select("doc_id", "text"), model, "doc_id")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
