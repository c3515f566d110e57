import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import ranking as R
from corpusgraph.functions.scratch import Scratch
from corpusgraph.operators.search import sparse_top_k
from tests.conftest import rows


@pytest.mark.parametrize("ranges,few", [("1", R.BROADCAST_BYTES), ("7", 0), ("64", R.BROADCAST_BYTES)])
def test_numbers_over_any_number_of_ranges(spark, monkeypatch, ranges, few):
    monkeypatch.setattr(R, "BROADCAST_BYTES", few)
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        rng = np.random.default_rng(int(ranges))
        data = [(None if i % 17 == 0 else f"f{int(rng.integers(0, 40)):02d}", int(rng.integers(0, 3)), i) for i in range(500)]
        df = spark.createDataFrame(data, "f string, m int, n int").repartition(5)
        got = {r.n: r.i for r in R.dense_index(df, ["m", "f"], ["n"], "i").collect()}
        order = sorted(data, key=lambda r: (r[1], r[0] is not None, r[0] or "", r[2]))
        assert got == {r[2]: i for i, r in enumerate(order)}
        assert R.dense_index(df.limit(0), ["m", "f"], ["n"], "i").count() == 0
        within = {r.n: (r.i, r.all) for r in R.number_rows(df, ["f"], ["m", "n"], "i", count_col="all").collect()}
        own = {}
        for f, m, n in sorted(data, key=lambda r: (r[1], r[2])):
            own.setdefault(f, []).append(n)
        assert within == {n: (i, len(ns)) for ns in own.values() for i, n in enumerate(ns)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_task_numbers_more_rows_as_keys_grow(spark):
    """One key with nearly all rows, or a key for each row: ranges stay of like size, and only their counts meet."""
    # Ranges this small would else be put together.
    together = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(together, "false")
    for key in ("0", "id"):
        df = spark.range(20_000).selectExpr(f"{key} AS k", "id AS n").repartition(4)
        scratch = Scratch(spark, "numbers")
        got = R.number_rows(df, [], ["k", "n"], "i", scratch)
        assert got.filter("i <> n").count() == 0
        parts = [r["count"] for r in scratch.read("i-sorted").groupBy("_part").count().collect()]
        assert max(parts) < 2 * 20_000 / 4 and scratch.read("i-starts").count() == len(parts)
    spark.conf.unset(together)


def test_packs_of_queries_are_told_apart(spark):
    """Packs that begin alike are packs of their own; rows that share an id are one query."""
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, dense array<double>").coalesce(1)
    q = q.unionByName(spark.createDataFrame([(1, [1.0, 0.0]), (3, [1.0, 1.0])], "query_id long, dense array<double>").coalesce(1))
    v = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 3.0])], "row_id long, dense array<double>").coalesce(1)
    got = [tuple(r) for r in R.top_k_inner_product(q, v, 2).orderBy("query_id", "rank").select("query_id", "row_id", "score").collect()]
    assert got == [(1, 7, 2.0), (1, 8, 0.0), (2, 8, 3.0), (2, 7, 0.0), (3, 8, 3.0), (3, 7, 2.0)]


@pytest.mark.parametrize("few", [R.BROADCAST_BYTES, 0])
def test_inner_products_by_broadcast_and_by_shuffle(spark, monkeypatch, few):
    monkeypatch.setattr(R, "BROADCAST_BYTES", few)
    monkeypatch.setattr(R, "PACK_ROWS", 20)
    monkeypatch.setattr(R, "HELD_BYTES", 2000)
    rng = np.random.default_rng(2)
    q, v = rng.integers(-2, 3, (50, 6)).astype(float), rng.integers(-2, 3, (170, 6)).astype(float)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(90, None), (91, [1.0])], "query_id long, dense array<double>").repartition(3)
    vectors = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(v)] + [(1, [2.0]), (None, [1.0]), (4, [None])], "row_id long, dense array<double>").repartition(4)
    got = {}
    for r in R.top_k_inner_product(queries, vectors, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.row_id, r.score))
    want = {n: [(i * 3, s) for s, i in sorted((-(x @ y), i) for i, y in enumerate(v))[:7]] for n, x in enumerate(q)}
    want = {n: [(i, -s) for i, s in own] for n, own in want.items()} | {91: [(1, 2.0)]}
    assert got == want


@pytest.mark.parametrize("few", [500_000, 0])
def test_sparse_scores_by_broadcast_and_by_token(spark, monkeypatch, few):
    monkeypatch.setattr("corpusgraph.operators.search.BROADCAST_POSTINGS", few)
    q = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "z", 1.0), (3, "a", -1.0)], "query_id long, token string, weight double")
    p = spark.createDataFrame([(i, t, float(i % 5)) for i in range(30) for t in ("a", "b", "c")], "row_id long, token string, weight double")
    got = sorted(rows(sparse_top_k(q, p, 4), "query_id", "row_id", "score", "rank"), key=lambda r: r[3])
    assert got == [(1, 4, 12.0, 1), (1, 9, 12.0, 2), (1, 14, 12.0, 3), (1, 19, 12.0, 4)]
