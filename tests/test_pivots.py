import numpy as np
import pytest

from corpusgraph.functions.scratch import Scratch
from corpusgraph.operators import pivots as P

Q, V = "query_id long, dense array<double>", "row_id long, dense array<double>"


def brute(queries, vectors, n):
    out = []
    for q, x in queries:
        scored = sorted((-float(np.dot(x, y)), i) for i, y in vectors if len(y) == len(x))[:n]
        out += [(q, i, -s, k + 1) for k, (s, i) in enumerate(scored)]
    return out


def ours(spark, queries, vectors, n, **more):
    scratch = Scratch(spark, "pivots-test")
    index = P.group_vectors(spark.createDataFrame([(i, list(map(float, v))) for i, v in vectors], V).repartition(3), scratch, **more)
    found = P.search_groups(spark.createDataFrame([(i, list(map(float, v))) for i, v in queries], Q).repartition(2), index, n, scratch)
    return [(r.query_id, r.row_id, r.score, r.rank) for r in found.hits.orderBy("query_id", "rank").collect()], found.read_share()


@pytest.mark.parametrize("pack,part,questions", [(4096, 32 << 20, 4096), (7, 500, 3)])
def test_clusters_are_searched_exactly_and_mostly_unread(spark, monkeypatch, pack, part, questions):
    monkeypatch.setattr(P, "PACK_ROWS", pack)
    monkeypatch.setattr(P, "PART_BYTES", part)
    monkeypatch.setattr(P, "QUESTIONS", questions)
    rng = np.random.default_rng(pack)
    centres = rng.integers(-400, 401, (12, 16))
    vectors = [(i * 3, centres[i % 12] + rng.integers(-3, 4, 16)) for i in range(900 if pack > 7 else 200)]
    queries = [(q, centres[q % 12] + rng.integers(-3, 4, 16)) for q in range(20 if pack > 7 else 7)]
    got, share = ours(spark, queries, vectors, 4)
    assert got == brute(queries, vectors, 4)
    assert share < 0.6


def test_even_vectors_lengths_and_ties(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.integers(-2, 3, 6)) for i in range(150)] + [(500 + i, np.ones(3)) for i in range(5)] + [(700, np.array([2.0])), (701, np.array([-1.0]))]
    queries = [(i, rng.integers(-2, 3, 6)) for i in range(9)] + [(90, np.ones(3)), (91, np.array([-3.0])), (92, np.zeros(6)), (93, np.ones(7))]
    assert ours(spark, queries, vectors, 7)[0] == brute(queries, vectors, 7)
    assert ours(spark, queries, vectors, 200, most_pivots=1)[0] == brute(queries, vectors, 200)


def test_odd_vectors(spark):
    scratch = Scratch(spark, "pivots-test")
    rows = [(1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (4, [None, 1.0]), (5, []), (6, [float("nan"), 0.0]), (7, [1e308, 1e308]), (8, [5e-324, 0.0])]
    index = P.group_vectors(spark.createDataFrame(rows, V), scratch)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1e-308])], Q)
    got = [(r.query_id, r.row_id) for r in P.search_groups(q, index, 2, scratch).hits.orderBy("query_id", "rank").collect()]
    assert got == [(1, 7), (1, 1), (3, 7), (3, 1)]
    none = P.group_vectors(spark.createDataFrame(rows, V).limit(0), Scratch(spark, "none"))
    assert P.search_groups(q, none, 2, Scratch(spark, "none")).hits.count() == 0
    assert P.search_groups(q.limit(0), index, 2, Scratch(spark, "none")).hits.count() == 0
