"""Quality classifier: regularised quadratic discriminant over transformed statistics of whole texts.

Each class has a mean and a covariance shrunk towards its diagonal, kept as a Cholesky factor. A text's score comes
from the difference of the two log densities (Mahalanobis terms and log determinants), mapped to 0..1 by a logistic
curve fitted on the same rows.

Scale: statistics are made in one pass over the texts, a batch at a time, with no shuffle of texts; the model is a
few hundred numbers. It is fitted on at most FIT_ROWS labelled rows (chosen by a hash of the id), whose statistics,
not texts, reach the driver.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import given_names, remainder, table

FIT_ROWS = 20_000
SHRINK = 0.1
CUT = 0.3

_CLASS = np.zeros(256, np.int64)  # of bytes: 0 letters and the rest, 1 upper case, 2 digit, 3 sentence marks, 4 other marks, 5 white space
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 0 if _b >= 128 or _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 5 if _b in b" \t\n\r\x0b\x0c" else 3 if _c in ".,;:'\"-()" else 4

FEATURES = ("words", "word_length", "spread", "variety", "pairs", "echo", "commonest", "upper", "digits", "stops", "marks", "lines")


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a text (null: as empty); every entry is finite."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return np.zeros(len(FEATURES))
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=6)
    inked = max(int(kinds[:5].sum()), 1)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    echo = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    lines = [x for x in data.split(b"\n") if x]
    return np.array([
        np.log1p(n), np.log(lengths.mean()), np.log1p(lengths.std()), np.log((len(counts) + 1) / (n + 1)) / np.log(n + 2),
        np.log((pairs + 1) / (max(n - 1, 1) + 1)), np.sqrt(echo / n), np.sqrt((max(counts.values()) - 1) / n), np.sqrt(kinds[1] / inked),
        np.sqrt(kinds[2] / inked), np.sqrt(kinds[3] / inked), np.sqrt(kinds[4] / inked), np.log((len(set(lines)) + 1) / (len(lines) + 1)),
    ])


def with_statistics(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """keep, x (array of FEATURES) for each row."""

    def each(batches):
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(b.num_columns - 1)]).reshape(-1)
            offsets = np.arange(0, len(x) + 1, len(FEATURES), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(x))], [*keep, "x"])

    given = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(each, f"{kinds}, x array<double>")


class Discriminant:
    """Two Gaussians with shrunk covariances; score() is 0..1, higher for label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, shrink: float = SHRINK):
        self.scale = x.std(axis=0) + 1e-6
        self.middle = x.mean(axis=0)
        z = (x - self.middle) / self.scale
        self.parts = []
        for c in (0, 1):
            own = z[y == c]
            s = np.cov(own.T, bias=True) if len(own) > 1 else np.eye(z.shape[1])
            s = (1 - shrink) * s + shrink * np.diag(np.diag(s)) + 0.01 * np.eye(z.shape[1])
            factor = np.linalg.cholesky(s)
            self.parts.append((own.mean(axis=0), np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(max(len(own), 1) / len(z))))
        self.a, self.b = 1.0, 0.0
        self._calibrate(self.margin(x), y)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0, drawn in by arcsinh so that far texts stay in range."""
        z = (x - self.middle) / self.scale
        d = [-0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) - half for mean, inverse, half, _ in self.parts]
        return np.arcsinh(d[1] - d[0])

    def _calibrate(self, m: np.ndarray, y: np.ndarray) -> None:
        """Logistic curve in the margin by Newton steps, with a small ridge."""
        design = np.stack([m, np.ones_like(m)], axis=1)
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            h = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * len(m) ** 0.5 * np.eye(2)
            step = np.linalg.solve(h, design.T @ (y - p) - 1e-3 * len(m) ** 0.5 * w)
            w += step
            if abs(step).max() < 1e-8:
                break
        self.a, self.b = w

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margin(x) + self.b, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", rows: int = FIT_ROWS) -> Discriminant | None:
    """A model of at most `rows` labelled rows that aren't held out; None if either class has no row.

    Of a document with several labels each counts, as does each row of an id that repeats; labels that aren't 0 or 1 count
    for nothing, null texts as empty ones.
    """
    chosen = labels.select(F.col("doc_id").alias("__id"), F.col(label).alias("__label")).where(F.col("__label").isin(0, 1) & ~held_out)
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "__label").limit(rows)
    got = with_statistics(docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")), "__label").collect()  # at most rows ids: a bounded broadcast
    x, y = np.array([r["x"] for r in got]), np.array([r["__label"] for r in got])
    return Discriminant(x, y) if len(got) and len(set(y.tolist())) == 2 else None


def score_quality(docs: DataFrame, model: Discriminant | None, *keep: str, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """keep, score, predicted (or by other names) for each row. Null and empty texts are scored by their statistics; no model: 0.5 for all.

    A kept column by the name of a result comes back as <name>_given. Equal rows score alike, no rows give none.
    """
    kept = given_names(keep, names)

    def each(batches):
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(b.num_columns - 1)]).reshape(-1, len(FEATURES))
            s = model.score(x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= CUT).astype("int32"))], [*kept, *names])

    given = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)), F.col(text).cast("string").alias("__text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    return given.mapInArrow(each, f"{kinds}`{names[0]}` double, `{names[1]}` int")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, remainder(F.col("__id"), 5) == 0)
    scored = score_quality(docs.select("doc_id", "text"), model, "doc_id")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """The rows of docs that the classifier accepts, all columns as they were; it is fitted on learn_from (default: docs)."""
    model = fit(docs if learn_from is None else learn_from, labels, remainder(F.col("__id"), 5) == 0)
    columns = docs.columns
    return score_quality(docs, model, *columns, names=("__score", "__predicted")).where("__predicted = 1").select(*columns)
