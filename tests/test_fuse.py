from corpusgraph.operators import fuse, search
from tests.conftest import rows


def ranked(spark, *cells):
    return spark.createDataFrame([(1, c, r) for r, c in enumerate(cells, 1)], "query_id long, chunk_index long, rank int")


def test_rrf_ranks_nulls_and_ties(spark):
    got = fuse.rrf({"graph": ranked(spark, 5, None, 6), "hype": ranked(spark, 7, 5, 8)}, 4).orderBy("rank").collect()
    assert [(r.chunk_index, r.graph_rank, r.hype_rank) for r in got] == [(5, 1, 2), (7, None, 1), (6, 3, None), (8, None, 3)]
    assert abs(got[0].rrf_score - (1 / 101 + 1 / 102)) < 1e-12


def test_hybrid_scores_missing_candidates_zero(spark):
    schema = "query_id long, row_id long, score double"
    dense = spark.createDataFrame([(1, 1, 0.5), (1, 2, -0.2)], schema)
    sparse = spark.createDataFrame([(1, 1, 1.0), (1, 3, 2.0)], schema)
    got = search.hybrid_search(dense, sparse, 3).orderBy("rank").collect()
    assert [(r.chunk_index, round(r.score, 6)) for r in got] == [(1, 0.65), (3, 0.6), (2, -0.14)]


def test_sparse_keeps_positive_scores_only(spark):
    p = spark.createDataFrame([(1, "a", 1.0), (2, "a", -1.0), (3, "b", 1.0)], "row_id long, token string, weight double")
    q = spark.createDataFrame([(9, "a", 2.0)], "query_id long, token string, weight double")
    assert rows(search.sparse_top_k(q, p, 5), "row_id", "score") == [(1, 2.0)]


def test_rerank_and_context(spark):
    c = spark.createDataFrame([(1, "q", "bb", 1), (1, "q", "aa", 2), (1, "q", "cccc", 3)], "query_id long, query string, text string, rank int")
    got = fuse.rerank(c, lambda: lambda q, t: [len(x) for x in t], 2)
    assert rows(got, "rank", "text") == [(1, "cccc"), (2, "bb")]
    q = spark.createDataFrame([(1, "q"), (2, "z")], "query_id long, query string")
    made = dict(rows(fuse.answer_prompts(fuse.build_context(got), q)))
    assert "cccc\n\nbb" in made[1] and made[2].startswith("Answer the question: z")
    assert fuse.rerank(c.limit(0), lambda: lambda q, t: [], 2).count() == 0
