"""Exact top-k search by columnar branch-and-bound.

Vectors lie dimension by dimension. Scores grow one block of dimensions at a
time; what the remaining dimensions can still add is at most the product of the
two remaining norms (Cauchy-Schwarz). A candidate whose upper bound is below the
k-th best lower bound is dropped, and the survivors are compacted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import every_nth, rank_hits, search_grid, table_of, usable_vectors

#: Dimensions that are added before candidates are dropped.
DIMENSION_BLOCK = 16
#: Survivors are compacted to a list once at most this share of pairs is left.
COMPACT_SHARE = 0.3
#: Whole numbers of 64-bit floats are exact below this; larger ones are added as integers, and above LARGEST as Python's.
EXACT = 2.0**52
LARGEST = 2.0**62
#: Queries whose scores with a block are worked out at once.
STEP = 256


def quantize(col):
    """floor(256 * x) of each component, x as a double; a whole number in a double. Beyond the largest double it is that."""
    most = 1.7976931348623157e308

    def one(x):
        y = x.cast("double") * F.lit(256.0)
        return F.when(F.abs(y) < F.lit(EXACT), F.floor(y).cast("double")).otherwise(F.greatest(F.lit(-most), F.least(F.lit(most), y)))

    return F.transform(col, one)


def _beyond(k: int, qids, q, ids, c):
    """The same where scores do not fit 64 bits, one query at a time in whole numbers of any size, cut to 64 bits in the end."""
    most = (1 << 63) - 1
    whole = [[int(x) for x in row] for row in c.tolist()]
    qi, ci, scores = [], [], []
    for i, row in enumerate(q.tolist()):
        own = [int(x) for x in row]
        made = sorted((-sum(a * b for a, b in zip(own, other, strict=True)), int(ids[j]), j) for j, other in enumerate(whole) if ids[j] != qids[i])[:k]
        qi += [i] * len(made)
        ci += [j for _, _, j in made]
        scores += [max(-most, min(most, -s)) for s, _, _ in made]
    return np.array(qi, np.int64), np.array(ci, np.int64), np.array(scores, np.int64)


def _branch_and_bound(k: int):
    def kernel(qids, q, ids, c, q_table, c_table):
        size = float(np.abs(c).max(initial=1)) * float(np.abs(q).max(initial=1)) * c.shape[1]
        if not size < LARGEST:
            return _beyond(k, qids, q, ids, c)
        kind = np.float64 if size < EXACT else np.int64
        given = np.asarray(q_table.column("floor"), dtype=np.float64) if "floor" in q_table.schema.names else np.full(len(q), -np.inf)
        order = np.argsort(-(np.square(q).sum(0) * np.square(c).sum(0)), kind="stable")
        q, down = q[:, order].astype(kind), np.ascontiguousarray(c[:, order].T.astype(kind))
        c_rest = _rest(down, 0)
        parts = [_search(k, qids[a : a + STEP], q[a : a + STEP], ids, down, c_rest, given[a : a + STEP]) for a in range(0, len(q), STEP)]
        qi, ci, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        return qi + np.repeat(np.arange(0, len(q), STEP), [len(p[0]) for p in parts]), ci, score

    return kernel


def _rest(m: np.ndarray, axis: int) -> np.ndarray:
    """Norms of what lies from each dimension on."""
    return np.sqrt(np.flip(np.cumsum(np.flip(np.square(m, dtype=np.float64), axis), axis=axis), axis))


def _search(k, qids, q, ids, down, c_rest, given):
    """Positions and scores of the k best candidates (columns of ``down``) of each query.

    ``given`` holds for each query a score that k candidates are known to reach.
    """
    k_here = k + 1  # a query's own row may be among them
    q_rest = _rest(q, 1)
    n_q, n_c, dims = len(q), down.shape[1], len(down)
    score, qi, ci = np.zeros((n_q, n_c), q.dtype), None, None
    for start in range(0, dims, DIMENSION_BLOCK):
        stop = min(start + DIMENSION_BLOCK, dims)
        if qi is None:
            score += q[:, start:stop] @ down[start:stop]
        else:
            for d in range(start, stop):
                score += q[qi, d] * down[d, ci]
        if stop == dims:
            continue
        bound = (np.outer(q_rest[:, stop], c_rest[stop]) if qi is None else q_rest[qi, stop] * c_rest[stop, ci]) * (1 + 1e-9) + 1e-6
        if qi is None:
            floor = np.partition(score - bound, n_c - k_here, axis=1)[:, n_c - k_here] if n_c > k_here else np.full(n_q, -np.inf)
            alive = score + bound >= np.maximum(floor, given)[:, None]
            if alive.mean() <= COMPACT_SHARE:
                qi, ci = np.nonzero(alive)
                score = score[qi, ci]
        else:
            low, ends = score - bound, np.searchsorted(qi, np.arange(n_q + 1))
            floor = np.array([np.partition(low[a:b], b - a - k_here)[b - a - k_here] if b - a > k_here else -np.inf for a, b in zip(ends[:-1], ends[1:], strict=True)])
            alive = score + bound >= np.maximum(floor, given)[qi]
            qi, ci, score = qi[alive], ci[alive], score[alive]
    if qi is None:
        floor = np.partition(score, n_c - k_here, axis=1)[:, n_c - k_here] if n_c > k_here else np.full(n_q, -np.inf)
        qi, ci = np.nonzero(score >= np.maximum(floor, given)[:, None])
        score = score[qi, ci]
    keep = (qids[qi] != ids[ci]) & (score >= given[qi])
    qi, ci, score = qi[keep], ci[keep], score[keep]
    order = np.lexsort((ids[ci], -score, qi))
    qi, ci, score = qi[order], ci[order], score[order]
    rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
    return qi[rank < k], ci[rank < k], score[rank < k].astype(np.int64)


#: Candidates that first meet all queries, to give each a score that k candidates reach.
FIRST = 4096


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k candidates of largest integer inner product for each query.

    vectors: vec_id, v (whole numbers); queries: query_id, v. A query's own id is
    no candidate; only vectors of equal length meet; ties go to the smaller vec_id; a
    query with fewer candidates returns all of them; empty tables give no rows.
    Scores beyond 64 bits rank as they are and are returned as the largest (or least)
    number.

    About FIRST candidates meet all queries first: their k-th best score is a lower
    bound that prunes in the blocks of all others. Nothing is lost by it, since k
    candidates are known to reach it.
    """
    vectors, queries = vectors.select("vec_id", "v"), queries.select("query_id", "v")
    n = vectors.count()
    if n > 4 * FIRST:
        # As doubles the bounds may be off by rounding, so scores that large give none.
        few = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n // FIRST)) == 0)
        first = rank_hits(search_grid(few, queries, [], _branch_and_bound(k), "long"), k)
        floors = first.filter((F.col("rank") == k) & (F.abs("score") < F.lit(int(EXACT)))).select("query_id", F.col("score").cast("double").alias("floor"))
        queries = queries.join(Scratch(vectors.sparkSession, "topk").save(floors, "floors"), "query_id", "left").fillna(float("-inf"), ["floor"])
    return rank_hits(search_grid(vectors, queries, [], _branch_and_bound(k), "long"), k)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable_vectors(table_of(spark, sf_dir)).withColumn("v", quantize("v"))
    queries = vectors.filter(every_nth(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "v")
    return exact_top_k(vectors, queries, 5)


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
