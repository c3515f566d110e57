"""Dense, sparse and hybrid search for batches of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import top_k, top_k_inner_product
from ..functions.scratch import Scratch
from .postings import block_postings, search_blocks

DENSE_WEIGHT = 0.7
#: Postings of questions that are broadcast at most.
BROADCAST_POSTINGS = 500_000


def dense_top_k(queries: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """query_id, row_id, score, rank of the n largest inner products."""
    return top_k_inner_product(queries, vectors, n)


def sparse_top_k(query_postings: DataFrame, postings: DataFrame, n: int) -> DataFrame:
    """query_id, row_id, score, rank: sums of weight products over shared tokens; n best, positive ones only.

    query_postings: query_id, token, weight; postings: row_id, token, weight. Only
    shared tokens meet. While the questions' postings are few they are broadcast:
    a row's postings lie in one partition, its scores are summed and the best of each
    question chosen there, so that a token in all rows sends no pairs about. Beyond
    BROADCAST_POSTINGS the postings are put in blocks and questions meet blocks (see
    postings.py); an index of blocks that is there already is searched by search_blocks.
    """
    if query_postings.count() > BROADCAST_POSTINGS:
        scratch = Scratch(postings.sparkSession, "postings")
        return search_blocks(query_postings, block_postings(postings, scratch), n, scratch).hits
    q = query_postings.select("query_id", "token", F.col("weight").alias("q_weight"))
    met = postings.join(F.broadcast(q.select("token").distinct()), "token", "left_semi").repartition("row_id").join(F.broadcast(q), "token")
    scored = met.groupBy("query_id", "row_id").agg(F.sum(F.col("weight") * F.col("q_weight")).alias("score"))
    return top_k(scored, ["query_id"], [F.desc("score"), F.col("row_id")], n).filter("score > 0")


def hybrid_search(dense_hits: DataFrame, sparse_hits: DataFrame, k: int, dense_weight: float = DENSE_WEIGHT) -> DataFrame:
    """query_id, chunk_index, score, dense_score, sparse_score, rank; a candidate of one list only scores 0 in the other."""
    d = dense_hits.select("query_id", "row_id", F.col("score").alias("dense_score"))
    s = sparse_hits.select("query_id", "row_id", F.col("score").alias("sparse_score"))
    both = d.join(s, ["query_id", "row_id"], "full_outer").fillna(0.0, ["dense_score", "sparse_score"])
    scored = both.withColumn("score", dense_weight * F.col("dense_score") + (1 - dense_weight) * F.col("sparse_score")).withColumnRenamed("row_id", "chunk_index")
    return top_k(scored, ["query_id"], [F.desc("score"), F.col("chunk_index")], k)
