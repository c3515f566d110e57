"""Fusion, reranking and the answer context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import top_k

RANK_CONSTANT = 100


def rrf(lists: dict[str, DataFrame], k: int, rank_constant: int = RANK_CONSTANT) -> DataFrame:
    """Reciprocal rank fusion of any number of ranked lists (query_id, chunk_index, rank).

    Returns query_id, chunk_index, rrf_score, a ``<list>_rank`` for each list and
    rank. Rows without chunk_index are skipped though they took up a rank; an index
    twice in one list adds twice and keeps its first rank. Ties stand in the order
    of the lists, then of rank.
    """
    tagged = None
    for order, (name, hits) in enumerate(lists.items()):
        part = hits.filter(F.col("chunk_index").isNotNull()).select("query_id", "chunk_index", F.col("rank").cast("int").alias("rank"), F.lit(name).alias("list"), F.lit(order).alias("order"))
        tagged = part if tagged is None else tagged.unionByName(part)
    ranks = [F.min(F.when(F.col("list") == name, F.col("rank"))).alias(f"{name}_rank") for name in lists]
    fused = tagged.groupBy("query_id", "chunk_index").agg(F.sum(1.0 / (rank_constant + F.col("rank"))).alias("rrf_score"), F.min(F.struct("order", "rank")).alias("_first"), *ranks)
    return top_k(fused, ["query_id"], [F.desc("rrf_score"), F.col("_first"), F.col("chunk_index")], k).drop("_first")


def rerank(candidates: DataFrame, make_scorer: Callable[[], Callable[[list[str], list[str]], list[float]]], k: int, batch_size: int = 16) -> DataFrame:
    """Scores (query, text) pairs and keeps the k best of each query_id; ties by the rank before.

    candidates: query_id, query, text, rank and any other columns. make_scorer runs
    once in each worker and gives a function of queries and texts.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            scores: list[float] = []
            for a in range(0, len(batch), batch_size):
                part = batch.iloc[a : a + batch_size]
                scores += [float(x) for x in scorer(part["query"].tolist(), part["text"].tolist())]
            yield batch.assign(rerank_score=scores)

    scored = candidates.mapInPandas(score, f"{schema}, rerank_score double").withColumnRenamed("rank", "_before")
    return top_k(scored, ["query_id"], [F.desc("rerank_score"), F.col("_before")], k).drop("_before")


def build_context(reranked: DataFrame) -> DataFrame:
    """query_id, context: the texts in rank order with an empty line between; at most k texts a query."""
    texts = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return reranked.filter(F.col("text").isNotNull()).groupBy("query_id").agg(F.array_join(F.transform(texts, lambda r: r["text"]), "\n\n").alias("context"))


def answer_prompts(contexts: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, prompt: the question, the context (empty without hits) and the wanted format."""
    joined = queries.select("query_id", "query").join(contexts, "query_id", "left")
    # The wording of the question.
    prompt = F.concat(F.lit("Answer the question: "), "query", F.lit("\nHere the retrived chunks:\n"), F.coalesce("context", F.lit("")), F.lit("\nOutput in markdown format\n"))
    return joined.select("query_id", prompt.alias("prompt"))
