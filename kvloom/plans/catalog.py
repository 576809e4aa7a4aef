"""The registered queries over the key/value tables, with SQL for each.

Sides: `orders F` (orders with status F, key o_orderkey, value o_custkey) as inner and `lines` (lineitem, key l_orderkey,
value l_partkey, many rows a key, unsorted) as outer; `events` by distinct microseconds for keys with gaps.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.functions.search import from_ordered, key_point, ordered_long
from kvloom.materialize import shared_folder
from kvloom.operators import indexes, inputs, joins, learned, merge, report, verify
from kvloom.operators.positions import lower_bound, rows_at, window_slice, with_position
from kvloom.operators.spec import IndexSpec, OpSpec, expand
from kvloom.plans import runner
from kvloom.shipping import ship
from kvloom.sources.views import pairs, read_table, write_table

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None, name: str | None = None):
    def put(f):
        _queries[name or f.__name__] = f
        if sql:
            _sql[name or f.__name__] = sql.strip()
        return f

    return put


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Sides:
    """The tables of a folder as pairs."""

    def __init__(self, spark: SparkSession, d: str):
        ship(spark)
        read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
        self.read = read
        self.spark = spark

    @property
    def orders(self):
        return pairs(self.read("orders"), "o_orderkey", "o_custkey")

    @property
    def orders_f(self):
        return pairs(self.read("orders").where("o_orderstatus = 'F'"), "o_orderkey", "o_custkey")

    @property
    def lines(self):
        return pairs(self.read("lineitem"), "l_orderkey", "l_partkey")

    @property
    def micros(self):
        """Distinct event times, as microseconds since 1970 in UTC."""
        return self.read("events").select(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("key")).where("key is not null").distinct()


INNER = "(SELECT o_orderkey AS key, o_custkey AS value FROM orders WHERE o_orderstatus = 'F')"
ORDERS = "(SELECT o_orderkey AS key, o_custkey AS value FROM orders)"
LINES = "(SELECT l_orderkey AS key, l_partkey AS value FROM lineitem)"
MICROS = "(SELECT DISTINCT epoch_us(ts) AS key FROM events WHERE ts IS NOT NULL)"
SEMI = f"SELECT key, value FROM {LINES} WHERE key IN (SELECT key FROM {INNER})"
FIRST = f"SELECT o.key, i.value FROM {ORDERS} o JOIN (SELECT key, min(value) AS value FROM {LINES} GROUP BY key) i ON o.key = i.key"


# joins


@_query(SEMI)
def join_lsj(spark, d):
    s = Sides(spark, d)
    return joins.semi_outer(s.lines, s.orders_f, hint="merge")


@_query(SEMI)
def join_inlj(spark, d):
    s = Sides(spark, d)
    return joins.semi_outer(s.lines, s.orders_f)


@_query(SEMI)
def join_unsorted_lsj(spark, d):
    s = Sides(spark, d)
    return learned.bucketed_semi(s.lines, s.orders_f, learned.Buckets.of(s.lines, _parts(spark)))


@_query(SEMI)
def join_alex(spark, d):
    s = Sides(spark, d)
    return joins.semi_outer(s.lines, s.orders_f)


@_query(f"SELECT key, value FROM {INNER} WHERE key IN (SELECT key FROM {LINES})")
def join_unsorted_inlj(spark, d):
    s = Sides(spark, d)
    return joins.semi_inner(s.lines, s.orders_f)


@_query(FIRST)
def join_sort(spark, d):
    s = Sides(spark, d)
    return joins.first_match_sort(s.orders, s.lines)


@_query(f"SELECT o.key, i.value FROM {LINES} o JOIN {INNER} i ON o.key = i.key")
def join_sort_outer_repeats(spark, d):
    s = Sides(spark, d)
    return joins.first_match_sort(s.lines, s.orders_f, unique=True)


@_query(f"SELECT o.key, i.value FROM {LINES} o JOIN {INNER} i ON o.key = i.key")
def join_hash(spark, d):
    s = Sides(spark, d)
    return joins.first_match_hash(s.lines, s.orders_f)


@_query(FIRST + " ORDER BY 1, 2")
def join_unsorted_lsj_sorted_output(spark, d):
    s = Sides(spark, d)
    return learned.bucketed_first_match(s.orders, s.lines, learned.Buckets.of(s.orders, _parts(spark), spread=False))


@_query(FIRST + " ORDER BY 1, 2")
def join_unsorted_inlj_sorted_output(spark, d):
    s = Sides(spark, d)
    return joins.sorted_output(joins.first_match_hash(s.orders, s.lines))


@_query(f"SELECT key, value FROM {LINES} WHERE key NOT IN (SELECT key FROM {INNER})")
def join_anti(spark, d):
    s = Sides(spark, d)
    return joins.anti_outer(s.lines, s.orders_f)


def _ratio(r):
    def q(spark, d):
        s = Sides(spark, d)
        return joins.semi_outer(inputs.sample_rows(s.orders, r, seed=None), s.orders)

    return q


for _r in (10, 100):
    _query(f"SELECT key, value FROM {ORDERS} WHERE key % {_r} = 0", f"join_ratio_{_r}")(_ratio(_r))


# merges and sets


@_query(f"SELECT key, value, 0 AS src FROM {INNER} UNION ALL SELECT key, value, 1 FROM {LINES} ORDER BY 1, 3, 2")
def merge_standard(spark, d):
    s = Sides(spark, d)
    return merge.merge(s.orders_f, s.lines)


@_query(f"SELECT key, value, src, row_number() OVER (ORDER BY key, src DESC, value) - 1 AS pos FROM (SELECT key, value, 0 AS src FROM {INNER} UNION ALL SELECT key, value, 1 FROM {LINES})")
def merge_learned(spark, d):
    s = Sides(spark, d)
    return merge.merge_by_position(s.orders_f, s.lines)


MERGED = f"SELECT key, value, src, row_number() OVER (ORDER BY key, src DESC, value) - 1 AS pos FROM (SELECT key, value, 0 AS src FROM {INNER} UNION ALL SELECT key, value, 1 FROM {LINES})"


def _merge_by(name: str):
    def q(spark, d):
        s = Sides(spark, d)
        return merge.merge_by_index(s.orders_f, s.lines, IndexSpec.named(name))

    return q


for _name in ("flatpgm256", "sampledflatpgm256", "btree4096"):
    _query(MERGED, f"merge_learned_{_name}")(_merge_by(_name))


@_query(f"SELECT DISTINCT key FROM {LINES}")
def dedup_keys(spark, d):
    return merge.drop_repeats(Sides(spark, d).lines).select("key")


@_query(f"SELECT key FROM {INNER} UNION SELECT key FROM {LINES}")
def key_set_union(spark, d):
    s = Sides(spark, d)
    return merge.key_union(s.orders_f, s.lines)


@_query(f"WITH p AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos FROM {MICROS}) SELECT p.key, p.pos FROM p JOIN lineitem ON l_orderkey = pos")
def rows_by_position(spark, d):
    """Rows of the sorted event times at the positions that lines name, as often as they name them."""
    s = Sides(spark, d)
    return rows_at(with_position(s.micros, "key"), s.lines.select(F.col("key").alias("pos")))


# positions, blocks, search


@_query(f"SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos FROM {MICROS}")
def positions(spark, d):
    return with_position(Sides(spark, d).micros, "key")


@_query(f"SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos FROM {MICROS} QUALIFY pos >= 1000 AND pos < 1256")
def position_window(spark, d):
    return window_slice(with_position(Sides(spark, d).micros, "key"), 1000, 1256)


@_query(f"SELECT pos // 256 AS block_id, max(key) AS max_key, count(*) AS n FROM (SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos FROM {MICROS}) GROUP BY 1")
def index_block(spark, d):
    return indexes.block_index(with_position(Sides(spark, d).micros, "key"), 256)


@_query(f"WITH p AS (SELECT DISTINCT key FROM {LINES}), k AS (SELECT key FROM {INNER}) SELECT key, (SELECT count(*) FROM k WHERE k.key < p.key) AS pos FROM p")
def search_lower_bound(spark, d):
    s = Sides(spark, d)
    return lower_bound(s.orders_f.select("key"), s.lines.select("key").distinct())


PROBES = f"(SELECT key + d AS key FROM {MICROS}, (VALUES (0), (1), (86400000000)) t(d))"
FOUND = f"WITH m AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos FROM {MICROS}), p AS (SELECT DISTINCT key FROM {PROBES}) SELECT p.key, coalesce(m.pos, (SELECT count(*) FROM m)) AS pos, coalesce(m.key = p.key, false) AS found FROM p ASOF LEFT JOIN m ON p.key <= m.key"


def _lookup(name: str, search: str):
    def q(spark, d):
        keys = Sides(spark, d).micros
        positioned = with_position(keys, "key")
        probes = keys.select(F.explode(F.array("key", F.col("key") + 1, F.col("key") + 86400000000)).alias("key"))
        return indexes.find(positioned, probes, indexes.build(positioned, IndexSpec.named(name)), search)

    return q


for _name, _search in (("pgm256", "binary"), ("flatpgm256", "exponential"), ("sampledpgm256", "linear"), ("sampledflatpgm256", "binary"), ("sampledflatpgm1024", "exponential"), ("btree256", "binary"), ("radixspline256", "exponential"), ("rmi", "binary"), ("pgm1024", "exponential"), ("pgm4096", "binary"), ("flatpgm1024", "binary"), ("flatpgm4096", "linear"), ("sampledpgm1024", "binary"), ("sampledpgm4096", "exponential"), ("sampledflatpgm4096", "binary"), ("radixspline1024", "binary"), ("radixspline4096", "exponential"), ("btree4096", "linear")):
    _query(FOUND, f"lookup_{_name}_{_search}")(_lookup(_name, _search))


@_query(f"WITH m AS (SELECT key FROM {MICROS}), p AS (SELECT DISTINCT key FROM {PROBES}) SELECT p.key, m.key IS NOT NULL AS found FROM p LEFT JOIN m ON p.key = m.key")
def lookup_alex(spark, d):
    return _lookup("alex", "binary")(spark, d).select("key", "found")


_BOUNDED = ("pgm256", "flatpgm1024", "sampledflatpgm256", "sampledpgm1024", "radixspline256", "rmi", "btree256")


@_query(f"SELECT name AS index_name, count(*) AS inside, CAST(sum(pos) AS BIGINT) AS places FROM (SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos FROM {MICROS}), (VALUES {', '.join(f"('{x}')" for x in _BOUNDED)}) t(name) GROUP BY 1")
def index_bounds_hold(spark, d):
    """For each index, how many members have their position inside its bounds, and the sum of these positions."""
    positioned = with_position(Sides(spark, d).micros, "key")
    found = None
    for name in _BOUNDED:
        inside = indexes.with_bounds(positioned, indexes.build(positioned, IndexSpec.named(name))).where("pos >= lower and pos < upper")
        one = inside.agg(F.lit(name).alias("index_name"), F.count("*").alias("inside"), F.sum("pos").alias("places"))
        found = one if found is None else found.union(one)
    return found


@_query(f"WITH m AS (SELECT CAST(l_orderkey AS HUGEINT) + 9223372036854775000 AS key FROM lineitem GROUP BY 1), r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos FROM m), p AS (SELECT CAST(o_orderkey AS HUGEINT) + 9223372036854775000 AS key FROM orders) SELECT CAST(p.key AS VARCHAR) AS key, coalesce(r.pos, (SELECT count(*) FROM m)) AS pos, coalesce(r.key = p.key, false) AS found FROM p ASOF LEFT JOIN r ON p.key <= r.key")
def lookup_unsigned_keys(spark, d):
    """Keys on both sides of 2**63 through an index, as longs in their order."""
    s = Sides(spark, d)
    big = lambda t: t.select((F.col("key").cast("decimal(20,0)") + F.lit("9223372036854775000").cast("decimal(20,0)")).cast("decimal(20,0)").alias("key"))
    keys, probes = (big(t).select(ordered_long(F.col("key")).alias("key")) for t in (s.lines.select("key").distinct(), s.orders))
    positioned = with_position(keys, "key")
    got = indexes.find(positioned, probes, indexes.build(positioned, IndexSpec.named("pgm256")))
    return got.select(from_ordered(F.col("key")).cast("string").alias("key"), "pos", "found")


# learned joins and buckets


@_query(SEMI)
def join_learned_index(spark, d):
    s = Sides(spark, d)
    positioned = with_position(s.orders_f, "key", "value")
    return indexes.learned_semi(s.lines, positioned, indexes.build(positioned, IndexSpec.named("sampledflatpgm256")))


@_query(SEMI)
def join_block_index(spark, d):
    s = Sides(spark, d)
    positioned = with_position(s.orders_f, "key", "value")
    return indexes.learned_semi(s.lines, positioned, indexes.build(positioned, IndexSpec.named("btree256")))


_BUCKET = f"(SELECT least(greatest(floor((key - lo) * 64 / (hi - lo + 1)), 0), 63)::BIGINT AS bucket, key FROM {LINES}, (SELECT min(key) AS lo, max(key) AS hi FROM {LINES}))"


@_query(f"""
WITH per AS (SELECT bucket, count(*) AS n, max(key) AS max_key FROM {_BUCKET} GROUP BY 1)
SELECT bucket, n, max_key, CAST(sum(n) OVER (ORDER BY bucket) - n AS BIGINT) AS before, max(max_key) OVER (ORDER BY bucket) AS running_max, max(n) OVER () AS largest FROM per
""")
def bucket_histogram(spark, d):
    lines = Sides(spark, d).lines
    at = lines.agg(F.min("key"), F.max("key")).first()
    return learned.bucket_stats(lines, learned.even_bucket(F.col("key"), 64, at[0], at[1]))


@_query(f"""
WITH c AS (SELECT floor((max(key) + 1) / 4)::BIGINT AS w FROM {ORDERS}),
o AS (SELECT (key >= w)::INT + (key >= 2 * w)::INT + (key >= 3 * w)::INT AS part, count(*) AS n FROM {LINES}, c GROUP BY 1),
i AS (SELECT (key >= w)::INT + (key >= 2 * w)::INT + (key >= 3 * w)::INT AS part, count(*) AS n FROM {INNER}, c GROUP BY 1)
SELECT part, coalesce(o.n, 0) AS n_outer, coalesce(i.n, 0) AS n_inner FROM o FULL JOIN i USING (part)
""")
def range_parts(spark, d):
    s = Sides(spark, d)
    w = (s.orders.agg(F.max("key")).first()[0] + 1) // 4
    return learned.co_ranges(s.lines, s.orders_f, [w, 2 * w, 3 * w])


# inputs


@_query("SELECT DISTINCT l_orderkey AS key, l_orderkey AS value FROM lineitem")
def input_sorted(spark, d):
    return inputs.sorted_keys(Sides(spark, d).lines).orderBy("key")


@_query("SELECT DISTINCT l_orderkey AS key, l_orderkey AS value FROM lineitem WHERE l_orderkey % 10 = 0")
def input_sample(spark, d):
    return inputs.sorted_keys(Sides(spark, d).lines, 10)


@_query(f"""
WITH k AS (SELECT key, row_number() OVER (ORDER BY key DESC) AS last FROM {LINES}),
m AS (SELECT key, row_number() OVER (ORDER BY md5('1|' || key), key) - 1 AS place FROM k WHERE last > 1)
SELECT key, key AS value FROM m WHERE place < (SELECT count(*) // 10 FROM k)
""")
def input_unsorted(spark, d):
    """A tenth of the lines' keys in a random order, repeated keys with them, without the last key."""
    return inputs.shuffled_keys(Sides(spark, d).lines, 10)


@_query("SELECT upper(md5(CAST(i AS VARCHAR))) AS key, upper(md5(CAST(i AS VARCHAR))) AS value FROM range(1000) t(i)")
def input_strings(spark, d):
    ship(spark)
    return inputs.random_strings(spark, 1000).select(F.hex("key").alias("key"), F.hex("value").alias("value"))


@_query("SELECT upper(md5(CAST(o_orderkey AS VARCHAR))) AS key, o_custkey AS value FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def join_string_keys(spark, d):
    s = Sides(spark, d)
    byte_key = F.unhex(F.md5(F.col("key").cast("string")))
    outer, inner = (t.select(byte_key.alias("key"), "value") for t in (s.orders, s.lines))
    return joins.semi_outer(outer, inner).select(F.hex("key").alias("key"), "value")


@_query("SELECT o_orderkey AS key, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 14) AS BIGINT) AS point FROM orders")
def key_points(spark, d):
    return Sides(spark, d).orders.select("key", key_point(F.unhex(F.md5(F.col("key").cast("string")))).alias("point"))


@_query("SELECT CAST(CAST(o_orderkey AS HUGEINT) + 9223372036854775808 AS VARCHAR) AS key, o_custkey AS value FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def join_unsigned_keys(spark, d):
    s = Sides(spark, d)
    big = (F.col("key").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)")
    outer, inner = (t.select(big.alias("key"), "value") for t in (s.orders, s.lines))
    return joins.semi_outer(outer, inner).select(F.col("key").cast("string").alias("key"), "value")


# digests, counts, ranges


_DIGEST = "CAST(bit_xor(h) AS VARCHAR) || ':' || CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS digest, count(*) AS n"
_HASHED = f"(SELECT CAST('0x' || substr(md5(key::VARCHAR || '|' || value::VARCHAR), 1, 15) AS BIGINT) AS h FROM ({SEMI}))"


@_query(f"SELECT {_DIGEST} FROM {_HASHED}")
def result_digest(spark, d):
    return verify.folded_digest(join_lsj(spark, d), "key", "value")


_FORMS = ("join_lsj", "join_inlj", "join_unsorted_lsj", "join_alex", "join_learned_index", "join_block_index")


@_query(f"SELECT form, digest, n FROM (SELECT {_DIGEST} FROM {_HASHED}), (VALUES {', '.join(f"('{x}')" for x in _FORMS)}) t(form)")
def join_forms_agree(spark, d):
    """The digest that each way to the outer rows has."""
    found = None
    for form in _FORMS:
        one = verify.folded_digest(_queries[form](spark, d).select("key", "value")).select(F.lit(form).alias("form"), "digest", "n")
        found = one if found is None else found.union(one)
    return found


@_query("SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1")
def counts_by_key(spark, d):
    return verify.key_counts(Sides(spark, d).lines)


@_query(f"SELECT min(key) AS min_key, max(key) AS max_key, count(*) AS n, count(DISTINCT key) AS n_keys FROM {LINES}")
def key_statistics(spark, d):
    return verify.key_range(Sides(spark, d).lines)


# reports


@_query("SELECT o_orderpriority, o_orderstatus, median(o_totalprice) AS median_o_totalprice FROM orders GROUP BY ALL ORDER BY 1, 2")
def report_median(spark, d):
    return report.medians(Sides(spark, d).read("orders"), "o_totalprice", "o_orderpriority", "o_orderstatus").orderBy("o_orderpriority", "o_orderstatus")


@_query("SELECT event_type, round(avg(value), 6) AS avg_value FROM events GROUP BY 1")
def report_average(spark, d):
    return report.means(Sides(spark, d).read("events"), "value", "event_type").select("event_type", F.round("avg_value", 6).alias("avg_value"))


@_query("SELECT o_orderpriority, median(o_totalprice) FILTER (o_orderstatus = 'F') AS \"F\", median(o_totalprice) FILTER (o_orderstatus = 'O') AS \"O\", median(o_totalprice) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def report_pivot(spark, d):
    return report.wide(Sides(spark, d).read("orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "o_totalprice")


@_query("SELECT o_orderkey, CASE WHEN contains(o_orderpriority, 'URGENT') THEN 'URGENT' WHEN contains(o_orderpriority, 'HIGH') THEN 'HIGH' ELSE 'rest' END AS class, split_part(o_orderpriority, '-', 1) AS head, split_part(o_orderpriority, '-', -1) AS tail, substr(o_orderpriority, 1, 3) AS part FROM orders")
def report_strings(spark, d):
    p = F.col("o_orderpriority")
    return Sides(spark, d).read("orders").select("o_orderkey", report.by_substring(p, ["URGENT", "HIGH"], "rest").alias("class"), report.head(p, "-").alias("head"), report.tail(p, "-").alias("tail"), F.substring(p, 1, 3).alias("part"))


@_query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def report_distinct(spark, d):
    return Sides(spark, d).read("orders").select("o_orderstatus", "o_orderpriority").distinct()


@_query("SELECT o_orderkey, o_totalprice / 1e9 AS scaled FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_totalprice > 100000")
def report_filter(spark, d):
    return Sides(spark, d).read("orders").where(F.col("o_orderstatus").isin("F", "P") & (F.col("o_totalprice") > 100000)).select("o_orderkey", (F.col("o_totalprice") / 1e9).alias("scaled"))


@_query("SELECT o_orderkey, i.name, i.size FROM (SELECT o_orderkey, unnest([{'name': o_orderstatus, 'size': 1}, {'name': o_orderpriority, 'size': 2}]) AS i FROM orders)")
def report_unnest(spark, d):
    part = lambda c, n: F.struct(F.col(c).alias("name"), F.lit(n).alias("size"))
    runs = Sides(spark, d).read("orders").select("o_orderkey", F.array(part("o_orderstatus", 1), part("o_orderpriority", 2)).alias("index_stats"))
    return report.unnest(runs, "index_stats", "o_orderkey")


@_query("SELECT o_orderkey AS \"spec.key\", o_orderstatus AS \"spec.index.type\", o_totalprice AS \"result.price\" FROM orders")
def report_flatten(spark, d):
    runs = Sides(spark, d).read("orders").select(F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_orderstatus").alias("type")).alias("index")).alias("spec"), F.struct(F.col("o_totalprice").alias("price")).alias("result"))
    return report.flatten(runs)


@_query("SELECT r_name AS name, r_regionkey::BIGINT AS size FROM region UNION ALL SELECT 'rmi', 402653")
def report_append(spark, d):
    return report.append_rows(Sides(spark, d).read("region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("size")), [("rmi", 402653)])


@_query("""
SELECT algo, idx AS "index", ratio, threads, rep AS "repeat" FROM (VALUES ('sort_join', ''), ('hash_join', ''), ('lsj', 'pgm'), ('lsj', 'btree')) a(algo, idx), (VALUES (1), (10), (100)) r(ratio), (VALUES (1), (8)) t(threads), (VALUES (0), (1), (2)) p(rep)
""")
def spec_expansion(spark, d):
    ship(spark)
    found = expand("inner", {1: "o1", 10: "o10", 100: "o100"}, ["sort_join", "hash_join", "lsj"], ["pgm256", "btree256"], [1, 8], 2)
    rows = [(s.algo, s.index.type if s.index else "", s.ratio, s.num_threads, s.extra["repeat"]) for s in found]
    return spark.createDataFrame(rows, "algo string, index string, ratio int, threads int, repeat int")




@_query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '1-NOW' WHEN '5-LOW' THEN '5-LATER' ELSE o_orderpriority END AS priority FROM orders")
def report_fixed_up(spark, d):
    return Sides(spark, d).read("orders").select("o_orderkey", report.fixed_up(F.col("o_orderpriority"), {"1-URGENT": "1-NOW", "5-LOW": "5-LATER"}).alias("priority"))


@_query("WITH m AS (SELECT l_returnflag AS algo, l_linenumber AS num_threads, median(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2) SELECT algo, num_threads, m.m AS median_price, round(o.m / m.m, 9) AS speedup FROM m LEFT JOIN (SELECT algo, m FROM m WHERE num_threads = 1) o USING (algo)")
def report_by_threads(spark, d):
    """Lines as if they were runs: ship modes as operators, line numbers as thread counts."""
    runs = Sides(spark, d).read("lineitem").select(F.col("l_returnflag").alias("algo"), F.col("l_linenumber").alias("num_threads"), F.col("l_extendedprice").alias("price"))
    return report.by_threads(runs, "price").withColumn("speedup", F.round("speedup", 9))


@_query("SELECT l_returnflag AS \"index\", l_linenumber AS epsilon, median(l_extendedprice) AS median_price FROM lineitem GROUP BY 1, 2")
def report_by_epsilon(spark, d):
    runs = Sides(spark, d).read("lineitem").select(F.col("l_returnflag").alias("index"), F.col("l_linenumber").alias("epsilon"), F.col("l_extendedprice").alias("price"))
    return report.by_epsilon(runs, "price")


@_query("SELECT l_returnflag AS algo, (l_partkey * 4096) // 1048576 AS memory_mb, median(l_extendedprice) AS median_price FROM lineitem GROUP BY 1, 2")
def report_by_memory(spark, d):
    runs = Sides(spark, d).read("lineitem").select(F.col("l_returnflag").alias("algo"), (F.col("l_partkey") * 4096).alias("memory"), F.col("l_extendedprice").alias("price"))
    return report.by_memory(runs, "price")


# tables on disk, and descriptions that are run on them


def _folder(spark: SparkSession) -> str:
    """A new folder that all machines share, for tables that a query writes and reads again."""
    return f"{shared_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) for c in df.columns])


@_query(f"SELECT key, value FROM {ORDERS}")
def table_parts_scan(spark, d):
    """A binary table, written by all tasks as parts of unknown sizes and read again."""
    s, path = Sides(spark, d), f"{_folder(spark)}/orders.kv"
    write_table(s.orders, path)
    return _longs(read_table(spark, path))


@_query(f"SELECT key, value FROM {ORDERS}")
def table_single_file_scan(spark, d):
    """A binary table, written by one task as one file and read again in parts."""
    s, path = Sides(spark, d), f"{_folder(spark)}/orders.kv"
    write_table(s.orders, path, single=True)
    return _longs(read_table(spark, path))


@_query("SELECT upper(md5(CAST(o_orderkey AS VARCHAR))) AS key, o_custkey AS value FROM orders")
def table_of_byte_keys_scan(spark, d):
    """A binary table of 16-byte keys and 8-byte values."""
    s, path = Sides(spark, d), f"{_folder(spark)}/orders.kv"
    number = F.unhex(F.lpad(F.hex("value"), 16, "0"))
    write_table(s.orders.select(F.unhex(F.md5(F.col("key").cast("string"))).alias("key"), number.alias("value")), path, 16, 8)
    return read_table(spark, path, "str").select(F.hex("key").alias("key"), F.conv(F.hex("value"), 16, 10).cast("long").alias("value"))


@_query(f"SELECT key FROM {LINES}")
def key_file_scan(spark, d):
    s, path = Sides(spark, d), f"{_folder(spark)}/lines.keys"
    write_table(s.lines, path)
    return _longs(read_table(spark, path).select("key"))


@_query("SELECT DISTINCT l_orderkey AS key, l_orderkey AS value FROM lineitem")
def create_input_from_key_file(spark, d):
    """A described input: the distinct keys of a key file that ends in the all-ones key, as pairs."""
    s, path = Sides(spark, d), f"{_folder(spark)}/lines.keys"
    last = spark.createDataFrame([(Decimal(inputs.SENTINEL),)], "key decimal(20,0)")
    write_table(s.lines.select(F.col("key").cast("decimal(20,0)").alias("key")).union(last), path)
    return _longs(runner.result(spark, OpSpec("create_input", source=path)))


@_query(f"SELECT count(*) AS num_output_keys FROM ({SEMI})")
def run_counts(spark, d):
    """The rows that a run counts while it is timed."""
    return spark.createDataFrame([(verify.timed(join_lsj(spark, d))["num_output_keys"],)], "num_output_keys long")


def _described(**fields):
    def q(spark, d):
        s, at = Sides(spark, d), _folder(spark)
        outer_first = fields["algo"] in ("sort_join", "hash_join", "unsorted_lsj_sorted_output", "unsorted_inlj_sorted_output")
        write_table(s.lines if outer_first else s.orders_f, f"{at}/inner")
        write_table(s.orders if outer_first else s.lines, f"{at}/outer")
        return runner.result(spark, OpSpec.from_dict({"inner_table": f"{at}/inner", "outer_table": f"{at}/outer", **fields}))

    return q


_INDEX = {"type": "sampledflatpgm256", "search": "exponential"}
for _algo, _rows, _more in (
    ("lsj", SEMI, {}), ("lsj", SEMI, {"index": _INDEX, "num_threads": 4}), ("inlj", SEMI, {"index": {"type": "btree", "leaf_size_in_pages": 16, "search": "linear"}}), ("inlj", SEMI, {}),
    ("alex_inlj", SEMI, {"index": {"type": "alex"}}), ("unsorted_lsj", SEMI, {"num_threads": 6}), ("unsorted_inlj", _sql["join_unsorted_inlj"], {}), ("sort_join", FIRST, {}), ("hash_join", FIRST, {}),
    ("unsorted_lsj_sorted_output", FIRST, {"outer_index_file": "o", "inner_index_file": "i"}), ("unsorted_inlj_sorted_output", FIRST, {}),
    ("standard_merge", _sql["merge_standard"], {}), ("learned_merge", f"SELECT key, value, src FROM ({MERGED})", {}), ("learned_merge", f"SELECT key, value, src FROM ({MERGED})", {"index": _INDEX}),
):
    _query(_rows, f"run_{_algo}" + ("_by_" + _more["index"]["type"] if "index" in _more else ""))(_described(algo=_algo, **_more))


@_query(FOUND)
def lookup_by_loaded_index(spark, d):
    """Lookups by an index that was saved and loaded by its path."""
    keys, path = Sides(spark, d).micros, f"{_folder(spark)}/index"
    positioned = with_position(keys, "key")
    indexes.build(positioned, IndexSpec.named("radixspline256")).save(path)
    probes = keys.select(F.explode(F.array("key", F.col("key") + 1, F.col("key") + 86400000000)).alias("key"))
    return indexes.find(positioned, probes, indexes.load(spark, path))


@_query(f"""
WITH b AS (SELECT key, value, (key >= 1000)::INT + (key >= 5000)::INT + (key >= 9000)::INT AS bucket FROM {LINES}),
i AS (SELECT (key >= 1000)::INT + (key >= 5000)::INT + (key >= 9000)::INT AS bucket, min(key) AS lo, max(key) AS hi FROM {INNER} GROUP BY 1)
SELECT key, value FROM b JOIN i USING (bucket) WHERE key BETWEEN lo AND hi
""")
def bucket_skip(spark, d):
    """Outer rows that the least and greatest key of their bucket don't rule out."""
    s = Sides(spark, d)
    return learned.within_buckets(s.lines, s.orders_f, learned.Buckets([1000, 5000, 9000], [1] * 4), "key").select("key", "value")


@_query("SELECT * FROM (SELECT 0 AS line, '| r_regionkey | r_name |' AS text UNION ALL SELECT 1, '| --- | --- |' UNION ALL SELECT 2 + row_number() OVER (ORDER BY r_regionkey) - 1, '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region)")
def report_markdown(spark, d):
    shown = report.to_markdown(Sides(spark, d).read("region").select("r_regionkey", "r_name").orderBy("r_regionkey"))
    return spark.createDataFrame(list(enumerate(shown.splitlines())), "line long, text string")


@_query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def report_csv(spark, d):
    path = f"{_folder(spark)}/nation"
    report.to_csv(Sides(spark, d).read("nation").select("n_nationkey", "n_name"), path)
    return spark.read.option("header", True).csv(path)
