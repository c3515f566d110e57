import numpy as np
import pytest

from corpusgraph.functions.scratch import Scratch
from corpusgraph.operators import postings as P

Q, D = "query_id long, token string, weight double", "row_id long, token string, weight double"


def brute(queries, rows, n):
    out, weights = [], {}
    for d, t, w in rows:
        weights.setdefault(d, {})[t] = w
    for q in sorted({x[0] for x in queries}):
        scored = [(-sum(w * own.get(t, 0.0) for i, t, w in queries if i == q), d) for d, own in weights.items()]
        out += [(q, d, -s, i + 1) for i, (s, d) in enumerate(sorted(x for x in scored if x[0] < 0)[:n])]
    return out


def corpus(seed, n_rows=400):
    """Few heavy rows, many light ones; whole weights, some below 0."""
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(n_rows):
        for t in set(rng.zipf(1.3, int(rng.integers(1, 12))) % 60):
            rows.append((d * 5 - 300, f"t{t}", float(rng.integers(1, 200) if d % 40 == 0 else rng.integers(1, 4))))
    queries = [(q, f"t{t}", float(rng.integers(1, 5)) * (-1 if t % 7 == 3 else 1)) for q in range(30) for t in set(rng.zipf(1.3, 6) % 60)]
    return queries, rows


@pytest.mark.parametrize("size,questions", [(1 << 15, 4096), (60, 4096), (25, 7)])
def test_blocks_give_what_all_rows_give(spark, monkeypatch, size, questions):
    monkeypatch.setattr(P, "BLOCK_POSTINGS", size)
    monkeypatch.setattr(P, "QUESTIONS", questions)
    queries, rows = corpus(size)
    q, scratch = spark.createDataFrame(queries, Q), Scratch(spark, "postings-test")
    index = P.block_postings(spark.createDataFrame(rows, D).repartition(3), scratch)
    found = P.search_blocks(q, index, 5, scratch)
    assert [tuple(r) for r in found.hits.orderBy("query_id", "rank").collect()] == brute(queries, rows, 5)
    share = P.read_share(found, index, q)
    assert share < 0.5 if size == 25 else share <= 1


def test_no_row_of_a_question_and_a_document_is_shuffled(spark, monkeypatch):
    """A token in every row: questions meet blocks, and each block hands on its n best."""
    monkeypatch.setattr(P, "BLOCK_POSTINGS", 500)
    rows = [(d, "all", 1.0 + (d % 3 == 0)) for d in range(5_000)]
    queries = [(q, "all", 1.0) for q in range(40)]
    scratch = Scratch(spark, "postings-test")
    index = P.block_postings(spark.createDataFrame(rows, D), scratch)
    found = P.search_blocks(spark.createDataFrame(queries, Q), index, 3, scratch)
    assert [(r.query_id, r.row_id, r.rank) for r in found.hits.orderBy("query_id", "rank").collect()] == [(q, 3 * i, i + 1) for q in range(40) for i in range(3)]
    blocks = index.select("block").distinct().count()
    assert scratch.read("bounds").count() == 40 * blocks
    assert scratch.read("first").count() + scratch.read("rest").count() <= 40 * blocks * 3


def test_odd_postings(spark):
    scratch = Scratch(spark, "postings-test")
    rows = spark.createDataFrame([(None, "a", 1.0), (1, None, 1.0), (2, "a", None), (3, "a", 0.0), (4, "a", -1.0), (5, "a", 1e-300), (6, "a", 1e300)], D)
    index = P.block_postings(rows, scratch)
    q = spark.createDataFrame([(1, "a", 1.0), (None, "a", 1.0), (2, "none", 1.0), (3, None, 1.0)], Q)
    assert [(r.query_id, r.row_id) for r in P.search_blocks(q, index, 5, scratch).hits.orderBy("rank").collect()] == [(1, 6), (1, 5)]
    assert P.search_blocks(q.limit(0), index, 5, Scratch(spark, "none")).hits.count() == 0
    assert P.search_blocks(q, P.block_postings(rows.limit(0), Scratch(spark, "empty")), 5, Scratch(spark, "none")).hits.count() == 0
