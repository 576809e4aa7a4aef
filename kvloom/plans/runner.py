"""Running a described operation: tables in, rows and measures out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.functions.search import from_ordered, ordered_long
from kvloom.operators import indexes, inputs, joins, learned, merge, verify
from kvloom.operators.positions import with_position
from kvloom.operators.spec import IndexSpec, OpSpec
from kvloom.sources.views import read_table, write_table


def result(spark: SparkSession, spec: OpSpec) -> DataFrame:
    """The rows that the described operation gives, not yet computed. num_threads is the number of ranges that it is cut into."""
    if spec.algo == "create_input":
        source = read_table(spark, spec.source, spec.key_type) if spec.source else None
        return inputs.create_input(spark, spec, source)
    inner, outer = (read_table(spark, p, spec.key_type, spec.load_in_mem) for p in (spec.inner_table, spec.outer_table))
    parts = spec.num_threads if spec.num_threads > 1 else None
    by_index = spec.index is not None and spec.index.type != "alex" and spec.key_type != "str"
    if spec.algo == "standard_merge":
        return merge.merge(inner, outer)
    if spec.algo == "learned_merge":
        if by_index:
            return _on_longs(lambda i, o: merge.merge_by_index(i, o, spec.index, parts=parts), inner, outer).orderBy("pos").drop("pos")
        return merge.merge_by_position(inner, outer, parts=parts).orderBy("pos").drop("pos")
    if spec.algo in ("lsj", "inlj") and by_index:
        return _on_longs(lambda i, o: joins_by_index(o, with_position(i.where("key is not null"), "key", "value", parts=parts), spec.index), inner, outer)
    buckets = lambda spread: learned.Buckets.of(inner, max(parts or 0, int(spark.conf.get("spark.sql.shuffle.partitions"))), spread=spread)
    return {
        "lsj": lambda: joins.semi_outer(outer, inner, hint="merge"),
        "inlj": lambda: joins.semi_outer(outer, inner),
        "alex_inlj": lambda: joins.semi_outer(outer, inner),
        "unsorted_lsj": lambda: learned.bucketed_semi(outer, inner, learned.Buckets.of(outer, max(parts or 0, int(spark.conf.get("spark.sql.shuffle.partitions"))))) if spec.key_type != "str" else joins.semi_outer(outer, inner),
        "unsorted_inlj": lambda: joins.semi_inner(outer, inner),
        "sort_join": lambda: joins.first_match_sort(outer, inner),
        "hash_join": lambda: joins.first_match_hash(outer, inner),
        "unsorted_lsj_sorted_output": lambda: learned.bucketed_first_match(outer, inner, buckets(False)) if spec.key_type != "str" else joins.sorted_output(joins.first_match_sort(outer, inner)),
        "unsorted_inlj_sorted_output": lambda: joins.sorted_output(joins.first_match_hash(outer, inner)),
    }[spec.algo]()


def _on_longs(f, inner: DataFrame, outer: DataFrame) -> DataFrame:
    """f(inner, outer) with unsigned keys as longs in the same order, and its keys as they were."""
    if not any(dict(t.dtypes)["key"].startswith("decimal") for t in (inner, outer)):
        return f(inner, outer)
    got = f(*(t.withColumn("key", ordered_long(F.col("key"))) for t in (inner, outer)))
    return got.withColumn("key", from_ordered(F.col("key")))


def joins_by_index(outer: DataFrame, positioned: DataFrame, spec: IndexSpec) -> DataFrame:
    return indexes.learned_semi(outer, positioned, indexes.build(positioned, spec), spec.search)


def run(spark: SparkSession, spec: OpSpec) -> dict:
    """{spec, result}: computes the operation, writes it where asked, and measures it; the timing includes index builds."""
    import time

    before, start = verify.io_counters(spark), time.perf_counter_ns()
    rows = result(spark, spec)
    if spec.write_result_to_disk and spec.result_path:
        write_table(rows, spec.result_path, spec.key_size, spec.value_size)
        got = read_table(spark, spec.result_path, spec.key_type)
        found = {"num_output_keys": got.count()}
    else:
        got = rows
        found = {"num_output_keys": verify.timed(rows)["num_output_keys"]}
    took = time.perf_counter_ns() - start
    found |= {"duration_ns": took, "duration_sec": took / 1e9, "io": {k: v - before[k] for k, v in verify.io_counters(spark).items()}}
    found["checksum"] = verify.folded_digest(got).first()["digest"] if spec.check_checksum else 0
    if spec.algo == "create_input" and spec.create_indexes and spec.key_type != "str":
        found["index_stats"] = index_stats(got)
        found["num_keys"] = found["num_output_keys"]
    if spec.load_in_mem and spec.algo != "create_input":
        for path in (spec.inner_table, spec.outer_table):
            read_table(spark, path, spec.key_type).unpersist()
    return {"spec": spec.to_dict(), "result": found}


def index_stats(table: DataFrame, names: tuple = ("pgm256", "flatpgm256", "sampledflatpgm256", "btree256", "radixspline256", "rmi")) -> list[dict]:
    """Name, size and build time of each kind of index over a table of keys."""
    import time

    keys = table.select("key")
    if dict(keys.dtypes)["key"].startswith("decimal"):
        keys = keys.select(ordered_long(F.col("key")).alias("key"))
    positioned = with_position(keys, "key")
    out = []
    for name in names:
        start = time.perf_counter_ns()
        built = indexes.build(positioned, IndexSpec.named(name))
        out.append({"index_name": name, "index_size": built.size_bytes, "index_build_duration": time.perf_counter_ns() - start})
    return out


def run_file(spark: SparkSession, path: str) -> str:
    """The JSON result of the description in a JSON file."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).select(F.col("value")).collect())
    return json.dumps(run(spark, OpSpec.from_dict(json.loads(text))), default=str)
