"""Indexes over a key-sorted table, and lookups through them.

An index is built where the sorted partitions are (a segment may end at a partition's edge) and then held as a model of
small arrays, checked against MAX_ENTRIES. A lookup adds bounds on the position to each probe; find() then searches
blocks of rows by an equi-join on the block number, never by a range join.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.functions.models import Blocks, Segments, Spline, TwoLevel, cone
from kvloom.functions.search import ALL
from kvloom.materialize import cut

from .spec import IndexSpec

MAX_ENTRIES = 5_000_000
UPPER_ERROR = 4
RADIX_BITS = 18
#: Probes of a block that are searched together, and the least and most rows of a block.
PROBES = 8192
LEAST_BLOCK, MOST_BLOCK = 256, 65_536


@dataclass
class Index:
    name: str
    model: object
    entries: DataFrame
    size_bytes: int
    spec: IndexSpec | None = None
    facts: dict = field(default_factory=dict)

    @property
    def max_error(self) -> int:
        """The most places that a window of bounds spans, where the model has one number for it; else 0."""
        m = self.model
        return (2 * m.error + 4) * m.sample if isinstance(m, Segments) else 2 * m.error + 3 if isinstance(m, Spline) else m.size if isinstance(m, Blocks) else 0

    def save(self, path: str) -> None:
        """Entries as Parquet, and beside them what else the model needs as one row of JSON."""
        self.entries.write.mode("overwrite").parquet(f"{path}/entries")
        row = {"name": self.name, "spec": asdict(self.spec), "facts": self.facts}
        self.entries.sparkSession.createDataFrame([(json.dumps(row),)], "facts string").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


def load(spark: SparkSession, path: str) -> Index:
    """An index that was saved, without a look at the table."""
    row = json.loads(spark.read.parquet(f"{path}/facts").first()["facts"])
    return _made(IndexSpec(**row["spec"]), spark.read.parquet(f"{path}/entries"), row["facts"])


def _entries(df: DataFrame) -> pd.DataFrame:
    if df.limit(MAX_ENTRIES + 1).count() > MAX_ENTRIES:
        raise ValueError(f"the index has more than {MAX_ENTRIES} entries; take a larger error or a sample")
    return df.toPandas()


def segments(positioned: DataFrame, error: int) -> DataFrame:
    """first_key, slope, first_pos, n of the segments of a table (key long, pos) whose partitions are sorted by key."""

    def build(batches):
        keys, pos = [], []
        for b in batches:
            keys.append(b.column(0).to_numpy(zero_copy_only=False))
            pos.append(b.column(1).to_numpy(zero_copy_only=False))
            if sum(map(len, keys)) >= 1 << 20:
                yield made(keys, pos)
                keys, pos = [], []
        if keys:
            yield made(keys, pos)

    def made(keys, pos):
        got = cone(np.concatenate(keys), np.concatenate(pos), error)
        columns = list(zip(*got)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["first_key", "slope", "first_pos", "n"])

    return positioned.select("key", "pos").mapInArrow(build, "first_key long, slope double, first_pos long, n long")


def block_index(positioned: DataFrame, rows: int) -> DataFrame:
    """block_id, max_key, n of every block of rows."""
    return positioned.groupBy(F.expr(f"pos div {rows}").alias("block_id")).agg(F.max("key").alias("max_key"), F.count("*").alias("n"))


def _stack(keys: np.ndarray, error: int, levels: int = 8) -> Segments | None:
    """Upper levels over the segments' first keys, until one line is left."""
    if len(keys) <= 64 or not levels:
        return None
    got = cone(keys, np.arange(len(keys)), error)
    first, slope, pos, _ = (np.array(x) for x in zip(*got))
    below = Segments(first, slope, pos, error, len(keys))
    below.upper = _stack(first, error, levels - 1) if len(first) < len(keys) // 2 else None
    return below


def build(positioned: DataFrame, spec: IndexSpec) -> Index:
    """An index of the kind that spec names over a table (key long, pos), partitions sorted by key."""
    at = positioned.agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.max("pos").alias("end")).first()
    facts = {"n": at["n"], "lo": at["lo"], "hi": at["hi"], "end": at["end"]}
    if spec.type == "alex":
        return _made(spec, positioned.select("key"), facts)
    if spec.type == "btree":
        return _made(spec, cut(block_index(positioned, spec.leaf_rows)), facts)
    if spec.type == "rmi":
        facts["leaves"] = min(max(1, facts["n"] // max(spec.leaf_rows, 1)), MAX_ENTRIES)
        return _made(spec, _leaves(positioned, facts), facts)
    given = positioned
    if spec.sample > 1:
        given = positioned.where((F.col("pos") + 1) % spec.sample == 0).withColumn("pos", F.expr(f"(pos + 1) div {spec.sample} - 1"))
    entries = cut(segments(given, spec.error))
    if spec.type == "radixspline":
        facts["error"] = 0
        facts["error"] = _worst(positioned, _made(spec, entries, facts).model.guess)
    return _made(spec, entries, facts)


def _made(spec: IndexSpec, entries: DataFrame, facts: dict) -> Index:
    """The index that entries and facts describe."""
    kind, n = spec.type, facts["n"]
    if kind == "alex":
        return Index(kind, None, entries, 0, spec, facts)
    held = _entries(entries)
    if kind == "btree":
        held = held.sort_values("block_id")
        return Index(kind, Blocks(held["max_key"].to_numpy(np.int64), spec.leaf_rows, n), entries, 16 * len(held), spec, facts)
    if kind == "rmi":
        return Index(kind, _two_level(held, facts), entries, 40 * facts["leaves"], spec, facts)
    held = held.sort_values(["first_pos", "first_key"])
    keys, pos = held["first_key"].to_numpy(np.int64), held["first_pos"].to_numpy(np.int64)
    if kind == "radixspline":
        if facts["hi"] is not None and (not len(keys) or keys[-1] < facts["hi"]):
            keys, pos = np.append(keys, facts["hi"]), np.append(pos, facts["end"])
        model = Spline.of(keys, pos, n, RADIX_BITS)
        model.error = facts["error"]
        return Index(kind, model, entries, 16 * len(keys) + 8 * len(model.radix), spec, facts)
    model = Segments(keys, held["slope"].to_numpy(float), pos, spec.error, n, spec.sample)
    if kind in ("pgm", "sampledpgm"):
        model.upper = _stack(keys, UPPER_ERROR)
    return Index(kind, model, entries, 24 * len(held), spec, facts)


def _worst(positioned: DataFrame, guess) -> int:
    """The greatest error of a guess over all rows."""

    @F.pandas_udf("double")
    def off(key: pd.Series, pos: pd.Series) -> pd.Series:
        return pd.Series(np.abs(guess(key.to_numpy(np.int64)) - pos.to_numpy()))

    return int(np.ceil(positioned.select(off("key", "pos").alias("e")).agg(F.max("e")).first()[0] or 0))


def _leaves(positioned: DataFrame, facts: dict) -> DataFrame:
    """leaf, slope, intercept, first_pos, end_pos, error of the leaves of a two-level model."""
    lo, leaves = facts["lo"] or 0, facts["leaves"]
    scale = leaves / ((facts["hi"] or 0) - lo + 1)
    x = (F.col("key").cast("decimal(20,0)") - F.lit(str(lo)).cast("decimal(20,0)")).cast("double")  # may pass what longs hold
    rows = positioned.withColumn("leaf", F.least(F.greatest((x * F.lit(scale)).cast("long"), F.lit(0)), F.lit(leaves - 1))).withColumn("x", x)
    fit = rows.groupBy("leaf").agg(F.coalesce(F.regr_slope("pos", "x"), F.lit(0.0)).alias("slope"), F.avg("x").alias("mx"), F.avg("pos").alias("mp"), F.min("pos").alias("first_pos"), (F.max("pos") + 1).alias("end_pos"))
    fit = cut(fit.select("leaf", F.greatest("slope", F.lit(0.0)).alias("slope"), (F.col("mp") - F.greatest("slope", F.lit(0.0)) * F.col("mx")).alias("intercept"), "first_pos", "end_pos"))
    error = F.max(F.abs(F.col("intercept") + F.col("slope") * F.col("x") - F.col("pos"))).alias("error")
    return cut(fit.join(rows.join(fit.select("leaf", "slope", "intercept"), "leaf").groupBy("leaf").agg(error), "leaf"))


def _two_level(held: pd.DataFrame, facts: dict) -> TwoLevel:
    lo, leaves = facts["lo"] or 0, facts["leaves"]
    held = held.set_index("leaf").reindex(range(leaves))
    end = held["end_pos"].ffill().fillna(0).to_numpy(np.int64)
    first = held["first_pos"].fillna(pd.Series(end, index=held.index)).to_numpy(np.int64)
    scale = leaves / ((facts["hi"] or 0) - lo + 1)
    return TwoLevel(int(lo), scale, held["slope"].fillna(0).to_numpy(), held["intercept"].fillna(pd.Series(end.astype(float), index=held.index)).to_numpy(), first, end, held["error"].fillna(0).to_numpy(), facts["n"])


def with_bounds(probes: DataFrame, index: Index) -> DataFrame:
    """probes plus lower, upper (exclusive) and approx_pos."""
    sent = probes.sparkSession.sparkContext.broadcast(index.model)  # at most MAX_ENTRIES entries

    @F.pandas_udf("lower long, upper long, approx_pos long")
    def look(key: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("lower", "upper", "approx_pos"), sent.value.bounds(key.to_numpy(np.int64)))))

    return probes.withColumn("__b", look("key")).select(*probes.columns, "__b.lower", "__b.upper", "__b.approx_pos")


def window_rows(index: Index) -> int:
    """Rows of the blocks in which an index's lookups search: a power of two that the widest window of bounds fits in."""
    rows = LEAST_BLOCK
    while rows < min(index.max_error, MOST_BLOCK):
        rows *= 2
    return rows


def find(positioned: DataFrame, probes: DataFrame, index: Index, search: str = "binary", block: int | None = None) -> DataFrame:
    """key, pos, found for each different key of probes: its lower bound, searched within the index's bounds.

    Rows are held in blocks, as wide as the index's error asks for unless `block` says otherwise. A block meets its probes
    in groups of about PROBES, and each group is searched at once; a block that very many probes ask for makes several.
    """
    wanted = probes.select("key").where("key is not null").distinct()
    if index.model is None:
        hit = positioned.groupBy("key").agg(F.min("pos").alias("pos"))
        return wanted.join(hit, "key", "left").select("key", "pos", F.col("pos").isNotNull().alias("found"))
    if not index.model.n:
        return wanted.select("key", F.lit(0).cast("long").alias("pos"), F.lit(False).alias("found"))
    block = block or window_rows(index)
    last = (index.model.n - 1) // block
    asked = with_bounds(wanted, index)
    asked = asked.select("key", "approx_pos", F.explode(F.sequence(F.least(F.expr(f"lower div {block}"), F.lit(last)), F.least(F.expr(f"(upper - 1) div {block}"), F.lit(last)))).alias("block"))
    groups = asked.groupBy("block").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("groups"))
    held = positioned.groupBy(F.expr(f"pos div {block}").alias("block")).agg(F.sort_array(F.collect_list("key")).alias("keys"))  # block rows a group
    held = held.join(groups, "block").withColumn("group", F.explode(F.expr("sequence(0, groups - 1)")))
    asked = asked.join(groups.withColumnRenamed("block", "__b"), F.col("block") == F.col("__b")).withColumn("group", F.pmod(F.xxhash64("key"), F.col("groups").cast("long")).cast("int"))
    asked = asked.groupBy("block", "group").agg(F.collect_list("key").alias("probes"), F.collect_list("approx_pos").alias("guess"))
    step = ALL[search]

    def each(batches):
        values = lambda c: c.values.to_numpy(zero_copy_only=False)
        for b in batches:
            for r in range(b.num_rows):
                first = b.column(0)[r].as_py() * block
                keys, probe, guess = (values(b.column(c)[r]) for c in (1, 2, 3))
                at = step(keys, probe, guess - first)
                same = keys[np.minimum(at, len(keys) - 1)] == probe
                pos = np.where(at < len(keys), first + at, -1)
                yield pa.RecordBatch.from_arrays([pa.array(probe), pa.array(pos), pa.array(np.full(len(probe), first + len(keys))), pa.array(same)], ["key", "pos", "end", "found"])

    met = held.join(asked, ["block", "group"]).select("block", "keys", "probes", "guess").mapInArrow(each, "key long, pos long, end long, found boolean")
    inside = F.min(F.when(F.col("pos") >= 0, F.col("pos")))
    return met.groupBy("key").agg(F.coalesce(inside, F.max("end")).alias("pos"), F.max("found").alias("found"))


def learned_semi(outer: DataFrame, positioned: DataFrame, index: Index, search: str = "binary") -> DataFrame:
    """Rows of outer whose key is in the table, by looking its different keys up through the index.

    A plain semi join moves both sides once and is the faster form wherever the table isn't indexed already; see the README.
    """
    if index.model is None:
        return outer.join(positioned.select("key"), "key", "left_semi")
    hit = find(positioned, outer, index, search).where("found").select("key")
    return outer.join(hit, "key", "left_semi")
