"""Sparse search over postings in blocks that know their tokens' largest weights.

Rows of like length (the root of their squared weights' sum) share a block. A question's
bound for a block is the sum of its tokens' largest weights there, or the product of its
own and the longest row's length, if that is less; so a block of short rows has a low
bound for every question. The best blocks give a floor, the n-th best score so far, and
only blocks whose bound reaches it are scored. Questions meet blocks, never rows, in a
shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import BROADCAST_BYTES, top_k
from ..functions.scratch import Scratch

#: Postings of a block, about, and questions that meet a block at once.
BLOCK_POSTINGS, QUESTIONS = 1 << 15, 4096
#: Blocks of the best bounds that give a question its floor: as many as hold twice the rows wanted, but no more than this.
FIRST_BLOCKS = 64
#: What rounding may take from a sum of bounds, as a part of it.
SLACK = 1e-9


def block_postings(postings: DataFrame, scratch: Scratch) -> DataFrame:
    """The stored index: block, token, least, most, longest, n, rows (row_id, weight) from postings (row_id, token, weight).

    Rows are classed by the power of two of their squared length, and a class is dealt
    into as many blocks as its postings fill; no sort of all rows is needed. longest is
    the length of the longest row that has the token.
    """
    weight = F.col("weight").cast("double")
    known = postings.filter("row_id is not null and token is not null and weight is not null").select("row_id", "token", weight.alias("weight"))
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")))
    rows = known.groupBy("row_id").agg(length.alias("length"), F.count("*").alias("n"), F.collect_list(F.struct("token", "weight")).alias("cells"))
    # Squares beyond a double's range give no bound; such rows are a class of their own.
    power = F.when(F.col("length") < float("inf"), F.floor(2 * F.log2(F.greatest("length", F.lit(2.0**-500)))).cast("long")).otherwise(F.lit(2000))
    classed = scratch.save(rows.withColumn("class", power), "rows")
    # At most one row for each power of two that a double has.
    parts = classed.groupBy("class").agg(F.ceil(F.sum("n") / BLOCK_POSTINGS).alias("parts"))
    block = F.shiftleft(F.col("class") + 2048, 32) + F.pmod(F.xxhash64("row_id"), F.col("parts"))
    # Whole rows move to their block, where its tokens are gathered without a further shuffle.
    dealt = classed.join(F.broadcast(parts), "class").select(block.alias("block"), "row_id", "length", "cells").repartition("block")
    each = dealt.select("block", "row_id", "length", F.inline("cells"))
    lists = each.groupBy("block", "token").agg(F.min("weight").alias("least"), F.max("weight").alias("most"), F.max("length").alias("longest"), F.count("*").alias("n"), F.collect_list(F.struct("row_id", "weight")).alias("rows"))
    return scratch.save(lists.sortWithinPartitions("block", "token"), "blocks")


def _best_rows(n: int):
    """Scores one block's rows for the questions that want it."""

    def meet(block: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(block) and len(asked):
            lists = block.column("rows").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            flat, ends = lists.flatten(), np.cumsum([0, *lists.value_lengths().to_pylist()])
            ids, at = np.unique(flat.field("row_id").to_numpy(), return_inverse=True)
            weights = flat.field("weight").to_numpy()
            span = {t: (a, b) for t, a, b in zip(block.column("token").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)}
            for query, floor, words in zip(asked.column("query_id").to_pylist(), asked.column("floor").to_pylist(), asked.column("words").to_pylist(), strict=True):
                scores = np.zeros(len(ids))
                for w in words:
                    if w["token"] in span:
                        a, b = span[w["token"]]
                        scores[at[a:b]] += weights[a:b] * w["q_weight"]
                some = np.flatnonzero((scores > 0) & (scores >= floor * (1 - SLACK)))
                some = some[np.lexsort((ids[some], -scores[some]))[:n]]
                found.append((np.full(len(some), query), ids[some], scores[some]))
        columns = [np.concatenate([f[i] for f in found]) if found else [] for i in range(3)]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "row_id", "score"])

    return meet


@dataclass(frozen=True)
class BlockSearch:
    """hits: query_id, row_id, score, rank; blocks: query_id, block, bound, read (whether it was scored)."""

    hits: DataFrame
    blocks: DataFrame


def search_blocks(query_postings: DataFrame, index: DataFrame, n: int, scratch: Scratch) -> BlockSearch:
    """The n best rows with a positive score of each question, exactly, from the blocks that can hold them.

    query_postings: query_id, token, weight (whole numbers as ids); index: that of
    block_postings. Ties go to the smaller row_id.
    """
    asked = scratch.save(query_postings.filter("query_id is not null and token is not null and weight is not null").select(F.col("query_id").cast("long").alias("query_id"), "token", F.col("weight").cast("double").alias("q_weight")), "asked")
    lists = asked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("token", "q_weight"))).alias("words"))
    size = asked.select(F.coalesce(F.sum(F.octet_length("token") + 8), F.lit(0)), F.count_distinct("query_id")).first()
    chunks = max(1, -(-size[1] // QUESTIONS))
    words = asked.select("token").distinct()
    used = index.join(F.broadcast(words), "token", "left_semi") if size[0] <= BROADCAST_BYTES else index
    most = F.greatest(F.lit(0.0), F.col("most") * F.col("q_weight"), F.col("least") * F.col("q_weight"))
    # A question's length over the tokens that a block has is enough.
    product = F.sqrt(F.sum(F.col("q_weight") * F.col("q_weight"))) * F.greatest(F.max("longest"), F.lit(1e-150))
    bounds = index.select("block", "token", "least", "most", "longest", "n").join(asked, "token").groupBy("query_id", "block").agg((F.least(F.sum(most), product) * (1 + SLACK)).alias("bound"), F.sum(most).alias("any"), F.max(F.when(most > 0, F.col("n"))).alias("held")).filter(F.col("any") > 0).drop("any")
    bounds = scratch.save(bounds, "bounds")
    upper = top_k(bounds, ["query_id"], [F.desc("bound"), F.col("block")], FIRST_BLOCKS, "turn")
    before = F.sum("held").over(Window.partitionBy("query_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    best = scratch.save(upper.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < 2 * n).select("query_id", "block", "turn"), "best")

    def score(pairs: DataFrame, name: str) -> DataFrame:
        chunk: Column = F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")
        wanted = pairs.join(lists, "query_id").withColumn("chunk", chunk).groupBy("block", "chunk")
        held = used.select("block", "token", "rows").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).groupBy("block", "chunk")
        return scratch.save(held.cogroup(wanted).applyInArrow(_best_rows(n), "query_id long, row_id long, score double"), name)

    first = score(best.select("query_id", "block", F.lit(0.0).alias("floor")), "first")
    floors = top_k(first, ["query_id"], [F.desc("score"), F.col("row_id")], n).filter(F.col("rank") == n).select("query_id", F.col("score").alias("floor"))
    met = bounds.join(floors, "query_id", "left").fillna(0.0, ["floor"]).join(best, ["query_id", "block"], "left")
    judged = scratch.save(met.withColumn("read", F.col("turn").isNotNull() | (F.col("bound") >= F.col("floor"))), "judged")
    rest = score(judged.filter(F.col("read") & F.col("turn").isNull()).select("query_id", "block", "floor"), "rest")
    hits = top_k(first.unionByName(rest), ["query_id"], [F.desc("score"), F.col("row_id")], n)
    return BlockSearch(hits, judged.select("query_id", "block", "bound", "read"))


def read_share(found: BlockSearch, index: DataFrame, query_postings: DataFrame) -> float:
    """The part of all postings of the questions' tokens, counted for each question, that was scored."""
    sizes = index.select("block", "token", "n").join(query_postings.select("query_id", "token"), "token").groupBy("query_id", "block").agg(F.sum("n").alias("n"))
    total = sizes.join(found.blocks, ["query_id", "block"], "left").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("read"), F.col("n"))).alias("read")).first()
    return (total.read or 0) / max(1, total["all"] or 0)
