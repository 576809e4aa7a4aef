"""Edge cases of joins, merges, positions, indexes, inputs and sources, against plain Python."""

import bisect
import json
import random
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvloom.functions import search
from kvloom.functions.models import Segments, Spline, cone
from kvloom.operators import indexes, inputs, joins, learned, merge, report, verify
from kvloom.operators.positions import lower_bound, with_position
from kvloom.operators.spec import IndexSpec, OpSpec, expand
from kvloom.plans import presets, runner
from kvloom.sources.views import read_table, write_bucketed, write_table

OUTER = [(1, 10), (1, 11), (2, 12), (5, 13), (None, 14), (9, 15)]
INNER = [(1, 100), (1, 99), (2, 98), (3, 97), (None, 96)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key long, value long")


def bag(df):
    return sorted(map(tuple, df.select("key", "value").collect()), key=repr)


def test_join_forms_with_duplicates_on_both_sides_and_null_keys(spark):
    outer, inner = frame(spark, OUTER), frame(spark, INNER)
    semi = sorted([(1, 10), (1, 11), (2, 12)], key=repr)
    assert bag(joins.semi_outer(outer, inner)) == semi
    assert bag(joins.semi_outer(outer, inner, hint="merge")) == semi
    for buckets in (learned.Buckets([2, 4], [1, 1, 1]), learned.Buckets([1], [2, 3]), learned.Buckets([], [1]), learned.Buckets.of(outer, 4)):
        assert bag(learned.bucketed_semi(outer, inner, buckets)) == semi
    first = sorted([(1, 99), (1, 99), (2, 98)], key=repr)
    assert bag(joins.first_match_sort(outer, inner)) == first
    assert bag(joins.first_match_hash(outer, inner)) == first
    got = [tuple(r) for r in learned.bucketed_first_match(outer, inner, learned.Buckets([2, 4], [1, 1, 1])).collect()]
    assert got == sorted(got) and sorted(got, key=repr) == first
    assert bag(joins.semi_inner(outer, inner)) == sorted([(1, 100), (1, 99), (2, 98)], key=repr)
    assert len(bag(joins.anti_outer(outer, inner))) == 3


@pytest.mark.parametrize("sides", [([], INNER), (OUTER, []), ([], [])])
def test_joins_with_empty_sides(spark, sides):
    outer, inner = (frame(spark, x) for x in sides)
    for f in (joins.semi_outer, joins.semi_inner, joins.first_match_sort, joins.first_match_hash):
        assert bag(f(outer, inner)) == []
    assert joins.anti_outer(outer, inner).count() == outer.count()


def test_first_match_by_position(spark):
    inner = spark.createDataFrame([(1, 5, 2), (1, 7, 1)], "key long, value long, pos long")
    assert bag(joins.first_match_sort(frame(spark, [(1, 0)]), inner, order="pos")) == [(1, 7)]


def test_merge_ties(spark):
    outer, inner = frame(spark, [(2, 1), (1, 1)]), frame(spark, [(1, 2), (3, 2)])
    assert [(r.key, r.src) for r in merge.merge(inner, outer).collect()] == [(1, 0), (1, 1), (2, 1), (3, 0)]
    assert [(r.key, r.src) for r in merge.merge(inner, outer, ties="outer").collect()] == [(1, 1), (1, 0), (2, 1), (3, 0)]
    with pytest.raises(ValueError):
        merge.merge(inner, outer, ties="none")


def test_merge_by_position_is_a_permutation(spark):
    rng = random.Random(1)
    outer, inner = ([(rng.randint(0, 30), i) for i in range(n)] for n in (70, 50))
    got = merge.merge_by_position(frame(spark, inner), frame(spark, outer)).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(120))
    assert [(r.key, 1 - r.src) for r in got] == sorted((r.key, 1 - r.src) for r in got)


def test_positions_and_lower_bounds(spark):
    rng = random.Random(2)
    keys = [rng.randint(-50, 50) for _ in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    got = with_position(df, "key").orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(300)) and [r.key for r in got] == sorted(keys)
    probes = spark.createDataFrame([(k, "x") for k in range(-60, 60)] + [(None, "y")], "key long, tag string")
    for r in lower_bound(df, probes).collect():
        assert r.pos == (None if r.key is None else bisect.bisect_left(sorted(keys), r.key))
    assert lower_bound(df.limit(0), probes).where("pos <> 0").count() == 0


@pytest.mark.parametrize("n", [1, 5, 256, 700])
@pytest.mark.parametrize("name", ["pgm256", "sampledflatpgm256", "btree256", "radixspline256", "rmi"])
def test_lookups(spark, name, n):
    if n in (5, 700) and name in ("pgm256", "btree256"):
        pytest.skip("covered by the other sizes")
    rng = random.Random(n)
    keys = sorted(rng.sample(range(2**60, 2**60 + 50 * n), n))
    positioned = with_position(spark.createDataFrame([(k,) for k in keys], "key long"), "key")
    probes = [*keys, *(k + 1 for k in keys), 0, 2**62]
    built = indexes.build(positioned, IndexSpec.named(name))
    got = indexes.find(positioned, spark.createDataFrame([(k,) for k in probes], "key long"), built).collect()
    assert {r.key: (r.pos, r.found) for r in got} == {k: (bisect.bisect_left(keys, k), k in set(keys)) for k in probes}


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(-(2**60), 2**60), min_size=1, max_size=300, unique=True), st.integers(1, 20), st.integers(1, 9))
def test_models_bound_every_position(keys, error, sample):
    keys = np.array(sorted(keys))
    held = keys[sample - 1 :: sample]
    probes = np.unique(np.concatenate((keys, keys + 1, keys - 1)))
    want = np.searchsorted(keys, probes)
    got = cone(held, np.arange(len(held)), error)
    first, slope, pos, _ = (np.array(x) for x in zip(*got)) if got else [np.empty(0)] * 4
    lower, upper, _ = Segments(first, slope, pos, error, len(keys), sample).bounds(probes)
    assert ((lower <= want) & (want < upper)).all()
    spline = Spline.of(keys, np.arange(len(keys)), len(keys), 6)
    lower, upper, _ = spline.bounds(probes)
    assert ((lower <= want) & (want < upper)).all()


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 40)), st.integers(-1, 41), st.integers(-3, 60))
def test_searches_agree(keys, probe, start):
    keys = np.array(sorted(keys), dtype=np.int64)
    assert {f(keys, probe, start) for f in search.STRATEGIES.values()} == {bisect.bisect_left(keys.tolist(), probe)}
    probes, starts = np.array([probe, probe + 1, -5, 99]), np.array([start, 0, 70, start])
    want = [bisect.bisect_left(keys.tolist(), x) for x in probes.tolist()]
    assert all(f(keys, probes, starts).tolist() == want and f(keys, probes[:0], starts[:0]).tolist() == [] for f in search.ALL.values())


def test_inputs(spark):
    source = spark.createDataFrame([(5,), (5,), (7,), (None,), (9,)], "key long")
    assert bag(inputs.sorted_keys(source)) == [(5, 5), (7, 7), (9, 9)]
    big = spark.createDataFrame([(Decimal(2**64 - 1),), (Decimal(2**63),), (Decimal(3),)], "key decimal(20,0)")
    assert [int(r.key) for r in inputs.sorted_keys(big).orderBy("key").collect()] == [3, 2**63]
    many = spark.range(1000).select("id").withColumnRenamed("id", "key")
    assert inputs.shuffled_keys(many, 10).collect() == inputs.shuffled_keys(many, 10).collect()
    assert inputs.shuffled_keys(many, 1).count() == 999 and inputs.shuffled_keys(many.limit(0), 3).count() == 0
    strings = [bytes(r.key) for r in inputs.random_strings(spark, 50).collect()]
    assert strings == sorted(strings) and {len(x) for x in strings} == {16}


def test_binary_keys_are_ordered_by_bytes_then_length(spark):
    keys = [bytes.fromhex(x) for x in ("01", "0102", "ff")]
    df = spark.createDataFrame([(bytearray(k), 1) for k in reversed(keys)], "key binary, value long")
    assert [bytes(r.key) for r in merge.merge(df, df.limit(0)).collect()] == keys


def test_table_and_key_files(spark, tmp_path):
    df = spark.range(1000).selectExpr("id * 3 as key", "id as value")
    path = str(tmp_path / "t.kv")
    write_table(df, path)
    assert sorted(map(tuple, read_table(spark, path).collect())) == sorted(map(tuple, df.collect()))
    big = spark.createDataFrame([(Decimal(2**63),), (Decimal(2**64 - 2),), (Decimal(1),)], "key decimal(20,0)").selectExpr("key", "key as value")
    path = str(tmp_path / "u.kv")
    write_table(big, path)
    got = spark.read.format("kvtable").option("path", path).option("keyType", "uint64").load()
    assert sorted(int(r.key) for r in got.collect()) == [1, 2**63, 2**64 - 2]
    strings = inputs.random_strings(spark, 20)
    path = str(tmp_path / "s.kv")
    write_table(strings, path, 16, 16)
    assert sorted(bytes(r.key) for r in read_table(spark, path, "str").collect()) == sorted(bytes(r.key) for r in strings.collect())
    raw = tmp_path / "k.keys"
    raw.write_bytes((3).to_bytes(8, "little") + b"".join(k.to_bytes(8, "little") for k in (4, 8, 15)))
    assert [r.key for r in spark.read.format("keyfile").option("path", str(raw)).option("partBytes", 8).load().orderBy("key").collect()] == [4, 8, 15]
    raw.write_bytes((3).to_bytes(8, "little"))
    with pytest.raises(Exception, match="ends before"):
        spark.read.format("keyfile").option("path", str(raw)).load().collect()


def test_runs_from_descriptions(spark, tmp_path):
    inner, outer = str(tmp_path / "inner"), str(tmp_path / "outer")
    write_table(frame(spark, INNER), inner)
    write_table(frame(spark, OUTER), outer)
    counts = {}
    for algo in ("sort_join", "hash_join", "lsj", "inlj", "alex_inlj", "unsorted_lsj", "unsorted_inlj", "unsorted_lsj_sorted_output", "unsorted_inlj_sorted_output", "standard_merge", "learned_merge"):
        spec = {"algo": algo, "inner_table": inner, "outer_table": outer, "check_checksum": True, "index": {"type": "sampledflatpgm256", "search": "binary"}, "common_key": 10}
        found = runner.run(spark, OpSpec.from_dict(spec))
        counts[algo] = found["result"]["num_output_keys"]
        assert found["result"]["duration_ns"] > 0 and found["spec"]["ratio"] == 10
    assert counts == {a: 3 for a in counts if "merge" not in a} | {"standard_merge": 11, "learned_merge": 9}
    path = tmp_path / "spec.json"
    path.write_text(json.dumps({"algo": "create_input", "source": inner, "method": "sosd", "result_path": str(tmp_path / "made"), "create_indexes": True}))
    made = json.loads(runner.run_file(spark, str(path)))
    assert made["result"]["num_keys"] == 3 and len(made["result"]["index_stats"]) == 6


@pytest.mark.parametrize("bad", [{"algo": "cross_join"}, {"algo": "lsj"}, {"algo": "lsj", "inner_table": "a", "outer_table": "b", "index": {"type": "hash256"}}, {"algo": "create_input"}, {"algo": "create_input", "method": "other", "source": "x"}])
def test_wrong_descriptions_are_errors(bad):
    with pytest.raises(ValueError):
        OpSpec.from_dict(bad)


def test_expansion_runs_one_more_than_repeats():
    assert len(expand("i", {1: "o"}, ["lsj", "sort_join"], ["pgm256", "btree256"], [1, 2], 2)) == 18
    assert expand("i", {1: "o"}, ["lsj"], ["pgm256"], [1, 2], 2, seed=1) == expand("i", {1: "o"}, ["lsj"], ["pgm256"], [1, 2], 2, seed=1)


def test_digests_ignore_order(spark):
    a, b = frame(spark, OUTER), frame(spark, OUTER[::-1]).repartition(3)
    assert verify.folded_digest(a).collect() == verify.folded_digest(b).collect()
    assert verify.folded_digest(a).first().digest != verify.folded_digest(a.limit(5)).first().digest


def test_reports(spark, tmp_path):
    for i, ms in enumerate((10, 30, 20)):
        (tmp_path / "fb").mkdir(exist_ok=True)
        (tmp_path / "fb" / f"{i}.json").write_text(json.dumps({"spec": {"name": "a", "index": {"type": "pgm256"}}, "result": {"duration_ns": ms}}))
    flat = report.flatten(report.read_runs(spark, str(tmp_path)))
    assert {"spec.name", "spec.index.type", "result.duration_ns", "dataset"} <= set(flat.columns)
    got = report.medians(flat.withColumnRenamed("result.duration_ns", "ns"), "ns", "dataset").first()
    assert (got.dataset, got.median_ns) == ("fb", 20.0)


def test_stream_against_a_static_table(spark, tmp_path):
    from kvloom.streaming.probe import stream_semi, windowed_matches

    spark.createDataFrame([(1, "2024-01-01 00:00:10"), (4, "2024-01-01 00:00:20"), (2, "2024-01-01 00:02:00")], "key long, at string").selectExpr("key", "cast(at as timestamp) as at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, at timestamp").parquet(str(tmp_path / "in"))
    inner = frame(spark, INNER)
    q = stream_semi(stream, inner).writeStream.format("memory").queryName("semi").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.key for r in spark.table("semi").collect()) == [1, 2]
    q = windowed_matches(stream, inner, "at", "1 minute", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("wins").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("wins").collect()) == [1, 1]


def test_semi_join_plan_reads_only_its_columns_and_pushes_the_filter(spark):
    from kvloom.plans import catalog

    text = catalog.queries()["join_lsj"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in text and "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in text


def test_bucketed_tables_join_without_a_shuffle(spark):
    outer, inner = (write_bucketed(spark.range(n).selectExpr("id % 50 as key", "id as value"), t, 4) for n, t in ((200, "b_outer"), (30, "b_inner")))
    joined = joins.semi_outer(outer, inner, hint="merge")
    assert joined.count() == 120
    assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()


def test_bucketed_join_goes_by_buckets_and_spreads_a_hot_key(spark):
    rows = [(7, i) for i in range(600)] + [(i, i) for i in range(300)]
    outer, inner = frame(spark, rows), frame(spark, [(k, 0) for k in range(0, 400, 7)] + [(7, 1), (1000, 1)])
    buckets = learned.Buckets.of(outer, 8)
    assert max(buckets.width) > 1 and buckets.parts == 8
    joined = learned.bucketed_semi(outer, inner, buckets)
    assert bag(joined) == bag(joins.semi_outer(outer, inner))
    plan = joined._jdf.queryExecution().toString()
    assert "direct_shuffle_partition_id" in plan and "Join" not in plan.split("== Physical Plan ==")[1]
    assert max(r["count"] for r in joined.where("key = 7").groupBy(F.spark_partition_id()).count().collect()) < 500
    words = [t.select(F.concat(F.lit("k"), "key").alias("key"), "value") for t in (outer, inner)]
    assert bag(learned.bucketed_semi(*words, learned.Buckets(["k2", "k5", "k7"], [1, 2, 1, 3]))) == bag(joins.semi_outer(*words))


def test_merges_by_position_and_by_index_agree(spark):
    rng = random.Random(2)
    inner, outer = (frame(spark, [(rng.choice([None, *range(-20, 20), 1 << 61]), rng.randint(0, 5)) for _ in range(n)]) for n in (150, 90))
    shown = lambda t: sorted(tuple(r) for r in t.select("key", "value", "src", "pos").collect())
    want = shown(merge.merge_by_position(inner, outer))
    assert [r[3] for r in sorted(want, key=lambda r: r[3])] == list(range(len(want)))
    for name in ("pgm256", "btree256", "radixspline256"):
        assert shown(merge.merge_by_index(inner, outer, IndexSpec.named(name, "exponential"), parts=3)) == want
    assert merge.merge_by_index(inner.limit(0), outer, IndexSpec()).count() == merge.merge_by_position(inner.limit(0), outer).count()


@pytest.mark.parametrize("name", ["pgm256", "sampledflatpgm256", "btree256", "radixspline256", "rmi", "alex"])
def test_indexes_are_saved_and_loaded(spark, tmp_path, name):
    positioned = with_position(spark.range(5000).selectExpr("id * id as key"), "key")
    built = indexes.build(positioned, IndexSpec.named(name))
    built.save(str(tmp_path / "index"))
    loaded = indexes.load(spark, str(tmp_path / "index"))
    probes = spark.range(0, 25_000_000, 7_919).selectExpr("id as key")
    assert loaded.size_bytes == built.size_bytes and loaded.max_error == built.max_error
    assert sorted(map(str, indexes.find(positioned, probes, loaded).collect())) == sorted(map(str, indexes.find(positioned, probes, built).collect()))


def test_blocks_are_as_wide_as_the_error_asks_for(spark, monkeypatch):
    monkeypatch.setattr(indexes, "PROBES", 10)  # a block's probes come in many groups
    positioned = with_position(spark.range(3000).selectExpr("id * 5 as key"), "key")
    for name, rows in (("pgm256", 512), ("pgm4096", 8192), ("btree4096", 4096)):
        index = indexes.build(positioned, IndexSpec.named(name))
        assert indexes.window_rows(index) == rows
        for step in ("linear", "binary", "exponential"):
            got = indexes.find(positioned, spark.range(0, 16_000, 13).selectExpr("id as key"), index, step).collect()
            assert all(r.pos == min(-(-r.key // 5), 3000) and r.found == (r.key % 5 == 0 and r.key < 15_000) for r in got) and len(got) == 1231


def test_key_files_with_all_unsigned_keys(spark, tmp_path):
    """A file that ends in the all-ones key, and keys from 2**63 on, through inputs, joins and indexes."""
    keys = [3, 5, 2**63 - 1, 2**63, 2**63 + 9, 2**64 - 2, 2**64 - 1]
    raw = tmp_path / "k.keys"
    raw.write_bytes(len(keys).to_bytes(8, "little") + b"".join(k.to_bytes(8, "little") for k in keys))
    made = runner.run(spark, OpSpec.from_dict({"algo": "create_input", "source": str(raw), "result_path": str(tmp_path / "inner.kv"), "create_indexes": True}))
    assert made["result"]["num_output_keys"] == 6 and len(made["result"]["index_stats"]) == 6
    assert sorted(int(r.key) for r in read_table(spark, str(tmp_path / "inner.kv")).collect()) == keys[:-1]
    outer = spark.createDataFrame([(Decimal(k), Decimal(1)) for k in (5, 6, 2**63, 2**63, 2**64 - 2)], "key decimal(20,0), value decimal(20,0)")
    write_table(outer, str(tmp_path / "outer.kv"))
    for algo in ("lsj", "inlj", "unsorted_lsj", "sort_join", "unsorted_lsj_sorted_output", "learned_merge"):
        spec = OpSpec.from_dict({"algo": algo, "inner_table": str(tmp_path / "inner.kv"), "outer_table": str(tmp_path / "outer.kv"), "index": {"type": "pgm256", "search": "linear"}, "num_threads": 3})
        got = [int(r.key) for r in runner.result(spark, spec).collect()]
        assert sorted(got) == (sorted(keys[:-1] + [5, 6, 2**63, 2**63, 2**64 - 2]) if "merge" in algo else [5, 2**63, 2**63, 2**64 - 2])
        assert got == sorted(got) or algo in ("lsj", "inlj", "unsorted_lsj", "sort_join")


def test_tables_as_single_files_and_wrong_values(spark, tmp_path):
    path = str(tmp_path / "one.kv")
    write_table(spark.range(500).selectExpr("id as key", "id * 2 as value"), path, single=True)
    assert (tmp_path / "one.kv").is_file() and read_table(spark, path).count() == 500
    for rows, schema in (([(-1, 1)], "key long, value long"), ([(None, 1)], "key long, value long"), ([(bytearray(b"abc"), 1)], "key binary, value long")):
        with pytest.raises(Exception, match="negative|nulls|bytes"):
            write_table(spark.createDataFrame(rows, schema), str(tmp_path / "bad.kv"))


def test_search_and_threads_of_a_description_are_used(spark, tmp_path, monkeypatch):
    inner, outer = str(tmp_path / "inner"), str(tmp_path / "outer")
    write_table(frame(spark, INNER), inner)
    write_table(frame(spark, OUTER), outer)
    used = []
    monkeypatch.setattr(indexes, "find", lambda *a, _f=indexes.find, **k: used.append(a[3:]) or _f(*a, **k))
    for step in ("linear", "exponential"):
        spec = OpSpec.from_dict({"algo": "inlj", "inner_table": inner, "outer_table": outer, "index": {"type": "pgm256", "search": step}})
        assert runner.result(spark, spec).count() == 3
    assert [x[0] for x in used] == ["linear", "exponential"]
    spec = OpSpec.from_dict({"algo": "unsorted_lsj", "inner_table": inner, "outer_table": outer, "num_threads": 9})
    assert runner.run(spark, spec)["result"]["io"]["inputRecords"] > 0


def test_description_fields(spark):
    spec = OpSpec.from_dict({"algo": "lsj", "inner_table": "a", "outer_table": "b", "key_size": 16, "value_size": 4, "algo_name": "x", "outer_index_file": "o", "index": {"type": "btree", "leaf_size_in_pages": 16, "dataset": "fb", "epsilon": 4096}})
    assert (spec.key_size, spec.value_size, spec.index.leaf_rows, spec.index.dataset, spec.index.epsilon, spec.extra) == (16, 4, 4096, "fb", 4096, {})
    with pytest.raises(ValueError):
        OpSpec.from_dict({"algo": "lsj", "inner_table": "a", "outer_table": "b", "index": {"type": "btree", "leafs": 1}})


def test_presets():
    made, runs = presets.merges("t", "o", repeats=1, ratios=(1, 10))
    assert [s.name for s in made] == ["inner", "input1", "input10"] and made[2].fraction_of_keys == 10 and len(runs) == 16
    assert {s.algo_name for s in runs} == {"learned_merge_flatpgm", "learned_merge_sampledflatpgm", "learned_merge_btree", "standard_merge"}
    made, runs = presets.string_joins("t", "o", num_keys=100)
    assert all(s.key_type == "str" and s.key_size == 16 for s in made + runs) and len(runs) == 16 and made[0].num_keys == 100
    assert len(presets.adaptive_joins("t", "o")[1]) == 4 and len(presets.unsorted_joins("i", "o", "r", repeats=2)) == 6
    assert len(presets.DATASETS) == 9
    with pytest.raises(ValueError):
        presets.merges("t", "o", "other")


def test_report_helpers(spark):
    df = spark.createDataFrame([("a.b.c", 1.0), ("x", None)], "name string, v double")
    assert [tuple(r) for r in df.select(report.head(F.col("name"), "."), report.tail(F.col("name"), ".")).collect()] == [("a", "c"), ("x", "x")]
    assert report.to_markdown(df) == "| name | v |\n| --- | --- |\n| a.b.c | 1.0 |\n| x |  |\n"
    with pytest.raises(ValueError):
        report.to_markdown(df, 1)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


FORMS_OF_MANY_BUCKETS = ("join_forms_agree", "join_unsorted_lsj_sorted_output", "run_unsorted_lsj", "join_unsorted_lsj", "run_unsorted_lsj_sorted_output")


@pytest.mark.parametrize("name", FORMS_OF_MANY_BUCKETS)
def test_plans_grow_with_the_buckets_and_not_with_their_square(spark, name):
    from kvloom.plans import catalog

    before, sizes = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (20, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            sizes.append(plan_of(catalog.queries()[name](spark, "/root/testdata/sf0.001")).count("CASE WHEN"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert 0 < sizes[1] < 3 * sizes[0]


def test_buckets_without_inner_rows_and_decimal_keys(spark):
    """Every key beside the bounds of its bucket goes; unsigned keys pass what longs hold."""
    outer, inner = (spark.createDataFrame([(Decimal(k), k % 7) for k in keys], "key decimal(20,0), value long") for keys in ([1, 5, 9, 2**64 - 2, 2**64 - 1], [5, 2**64 - 2]))
    cuts = [Decimal(3), Decimal(6), Decimal(2**63)]
    got = learned.within_buckets(outer, inner, learned.Buckets(cuts, [1] * 4), "key")
    assert sorted(int(r["key"]) for r in got.collect()) == [5, 2**64 - 2]
    assert learned.within_buckets(outer, inner.where("false"), learned.Buckets(cuts, [1] * 4), "key").count() == 0


@pytest.mark.parametrize("name", ("run_unsorted_lsj", "join_unsorted_lsj"))
def test_plans_of_bucketed_semi_joins_do_not_grow_with_the_buckets(spark, name):
    from kvloom.plans import catalog

    before, sizes = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (10, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            sizes.append(plan_of(catalog.queries()[name](spark, "/root/testdata/sf0.001")).count("CASE WHEN"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sizes[0] == sizes[1]


def test_bucket_is_the_number_of_cut_points_at_or_below_the_key(spark):
    for kind, cuts in (("long", [-(2**40), -3, 0, 7, 8, 2**62]), ("decimal(20,0)", [Decimal(0), Decimal(5), Decimal(2**63), Decimal(2**64 - 1)]), ("double", [0.5]), ("long", list(range(0, 3000, 3)))):
        keys = sorted({type(cuts[0])(int(c) + d) for c in cuts for d in (-1, 0, 1)})
        got = spark.createDataFrame([(k,) for k in [*keys, None]], f"key {kind}").select("key", learned.cdf_bucket(F.col("key"), cuts).alias("b")).collect()
        assert [r["b"] for r in got] == [sum(c <= r["key"] for c in cuts) if r["key"] is not None else 0 for r in got]


@pytest.mark.parametrize("name", ("join_unsorted_lsj", "run_unsorted_lsj", "join_unsorted_lsj_sorted_output"))
def test_bucketed_joins_meet_in_one_exchange_and_without_python_workers(spark, name):
    from kvloom.plans import catalog

    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Python" not in plan and plan.count("shufflepartitionidpassthrough") == 1 and "Window" in plan
