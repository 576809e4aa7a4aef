"""KD-tree and one-bit searches against brute force."""

import math

import duckdb
import numpy as np
import pytest

from kvloom.llm import kdtree, onebit
from kvloom.llm.vectors import Best, usable

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd_rows(spark):
    """A hot vector, ties, repeated ids, and rows that take no part; an extra column by a name that is used inside."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(150)] + [(i, [0.5] * 8) for i in range(150, 260)] + [(7, [0.25] * 8)]
    rows += [(300, None), (301, [0.0] * 8), (302, [math.nan] + [1.0] * 7), (303, [math.inf] + [1.0] * 7), (304, [None] + [1.0] * 7), (305, []), (306, [1.0]), (None, [1.0] * 8)]
    return spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<float>, shard int")


def brute(rows, every, k, score, descending):
    out = {}
    for q, v in rows:
        if q % every == 0:
            found = sorted(((-score(v, w) if descending else score(v, w)), i) for i, w in rows if i != q)
            out.setdefault(q, []).append(found[:k])
    return out


def test_inner_products_are_exact(spark, odd_rows):
    rows = kdtree.quantised(odd_rows)
    local = [(r.id, np.array(r.v)) for r in rows.collect()]
    assert len(local) == 262  # the zero vector takes part here
    got = kdtree.inner_top(rows, rows.where("id % 50 = 0"), 5, shard_rows=60, leaf=8, block=3).collect()
    want = brute(local, 50, 5, lambda a, b: float(a @ b), True)
    for q, lists in want.items():
        mine = sorted((r.rank, -float(r.score), r.vec_id) for r in got if r.query_id == q)
        assert [(s, i) for _, s, i in mine] == lists[0]


def test_inner_products_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = sorted(map(tuple, kdtree.op3_kdtree(spark, SF).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == sorted(con.sql(kdtree.OP3_SQL).fetchall())


@pytest.mark.parametrize("large", [1e5, 3e6, 1e9, 1e300])
def test_inner_products_of_large_values(spark, large):
    """Whole numbers beyond doubles are exact, and scores beyond longs are their ends."""
    rng = np.random.default_rng(8)
    given = [(i, (rng.normal(size=6) * (large if i % 7 == 0 else 1)).tolist()) for i in range(80)]
    rows = kdtree.quantised(spark.createDataFrame(given, "vec_id long, embedding array<double>"))
    whole = {i: [int(min(max(256 * x, -1.7976931348623157e308), 1.7976931348623157e308) // 1) for x in v] for i, v in given}
    got = sorted(map(tuple, kdtree.inner_top(rows, rows.where("id % 7 = 0"), 5, shard_rows=30, leaf=4).collect()))
    want, ends = [], (1 << 63) - 1
    for q in (i for i in whole if i % 7 == 0):
        found = sorted((-max(min(sum(a * b for a, b in zip(whole[q], whole[i])), ends), -ends), i) for i in whole if i != q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(found[:5], 1)]
    assert got == sorted(want)


@pytest.mark.parametrize("search", ["inner", "near"])
def test_each_row_of_an_id_is_a_query(spark, search):
    """Two queries of one id have a list each; neither holds rows of that id, and nothing comes twice."""
    rng = np.random.default_rng(3)
    given = [(i, rng.normal(size=4).tolist()) for i in range(1, 40)] + [(0, [9.0, 0.0, 0.0, 0.0]), (0, [0.0, 0.0, 0.0, -9.0])]
    table = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    rows = kdtree.quantised(table) if search == "inner" else usable(table, "vec_id", "embedding", zero=False)
    find = kdtree.inner_top if search == "inner" else onebit.nearest
    got = find(rows, rows.where("id = 0"), 5).collect()
    assert sorted(r["rank"] for r in got) == sorted(list(range(1, 6)) * 2) and all(r.vec_id != 0 for r in got)
    local = [(r.id, np.array(r.v)) for r in rows.collect()]
    score = (lambda a, b: float(a @ b)) if search == "inner" else (lambda a, b: float(np.sqrt(((a - b) ** 2).sum())))
    lists = brute(local, 1000, 5, score, search == "inner")[0]
    want = sorted((r, i) for found in lists for r, (_, i) in enumerate(found, 1))
    assert sorted((r["rank"], r.vec_id) for r in got) == want


def test_search_visits_few_leaves_of_clustered_vectors():
    """Best-first with a first k-th best: far fewer leaves are measured than there are, and fewer than without it."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8)) * 400
    points = np.floor(np.concatenate([c + rng.normal(size=(200, 8)) * 10 for c in centres]))
    ids = np.arange(len(points))
    queries = points[::100]
    measured = []
    for known in (False, True):
        shard = kdtree.Shard(ids, points, kdtree.Products(8 * float(abs(points).max()) ** 2), leaf=50)
        best = Best(len(queries), 5, -1)
        if known:
            s = np.sort(queries @ points[rng.permutation(len(points))[:2000]].T, axis=1)
            best.kth[:] = -s[:, -5]
        shard.search(ids[::100], queries, best)
        measured.append(shard.measured)
        for q in range(0, len(queries), 9):
            s = queries[q] @ points.T
            s[q * 100] = -np.inf
            assert sorted(best.id[best.q == q]) == sorted(np.lexsort((ids, -s))[:5])
    everything = len(queries) * 160
    assert measured[1] <= measured[0] < everything / 5


def test_nearest_recall_and_measure(spark, odd_rows):
    rows = usable(odd_rows, "vec_id", "embedding", zero=False)
    local = [(r.id, np.array(r.v)) for r in rows.collect()]
    got = onebit.nearest(rows, rows.where("id % 10 = 0"), 10, block=7).collect()
    by = dict(local)
    hits = total = 0
    for q, lists in brute(local, 10, 10, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), False).items():
        mine = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 11)) and [(s, i) for _, s, i in mine] == sorted((s, i) for _, s, i in mine)
        hits += len({(round(s, 9)) for s, _ in lists[0]} & {round(s, 9) for _, s, _ in mine})
        total += len({round(s, 9) for s, _ in lists[0]})
        for _, s, i in mine:
            if i != 7:
                assert math.isclose(s, float(np.sqrt(((by[q] - by[i]) ** 2).sum())), rel_tol=1e-12, abs_tol=1e-12) or q == 7
    assert hits / total >= 0.97


def test_recall_on_the_given_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    v = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    got = {}
    for r in onebit.op10_onebit(spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(axis=1))
        want = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        hits += len(got[q] & set(want))
    assert hits / (10 * len(got)) >= 0.97


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (100, [2.0, 1.0])], "vec_id long, embedding array<double>")
    rows = usable(few, "vec_id", "embedding", zero=False)
    assert onebit.nearest(rows, rows, 10).count() == 2
    assert kdtree.inner_top(kdtree.quantised(few), kdtree.quantised(few), 5).count() == 2
    none = few.limit(0)
    assert kdtree.inner_top(kdtree.quantised(none), kdtree.quantised(none), 5).count() == 0
    assert kdtree.inner_top(kdtree.quantised(few), kdtree.quantised(none), 5).count() == 0
    rows = usable(none, "vec_id", "embedding", zero=False)
    assert onebit.nearest(rows, rows, 10).count() == 0


def test_tree_bounds_hold():
    rng = np.random.default_rng(0)
    points = rng.integers(-50, 50, (400, 5)).astype(float)
    tree = kdtree.KdTree(points, 16)
    q = rng.integers(-50, 50, (20, 5)).astype(float)
    for node, (a, b) in enumerate(tree.span):
        top = (q @ points[tree.order[a:b]].T).max(axis=1)
        assert (tree.bounds(np.maximum(q, 0), np.minimum(q, 0), np.full(20, node)) >= top - 1e-9).all()
