"""Nearest-vector search in a grid of blocks.

Candidates and queries that share a key are dealt into blocks of bounded size;
every candidate block meets every query block of its key in a task of its own,
which hands on its k best for each query. A key with a third of all rows only
makes more blocks. Only vectors of equal length meet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions

#: Numbers in a block of candidates and of queries, about: as many rows as have so many components.
CANDIDATE_NUMBERS = 1 << 20
QUERY_NUMBERS = 1 << 18
#: Candidates below which a block is not cut further to make more tasks.
CANDIDATE_BLOCK = 1024

Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table, pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]


def usable_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): one row per id, without vectors that take no part.

    Left out: null ids, null or empty vectors, and vectors with a null or non-finite
    component. Of rows that share an id the smallest vector stands for all. Vectors
    of single precision stay so, all others become doubles.
    """
    kind = table.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col).cast("array<float>" if kind == "array<float>" else "array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """(rows, length) doubles of lists of equal length."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks]
    return np.concatenate(flat).astype(np.float64, copy=False).reshape(len(column), -1)


def search_grid(candidates: DataFrame, queries: DataFrame, keys: list[str], kernel: Kernel, score_type: str, dims: int | None = None) -> DataFrame:
    """(query_id, vec_id, score) of every block pair.

    candidates: keys, vec_id, v; queries: keys, query_id, v; both may have columns of
    their own for the kernel. The number of keys must be bounded by parameters.
    kernel(query ids, query rows, candidate ids, candidate rows, query table,
    candidate table) gives positions of queries and candidates and their scores.

    Blocks are as large as memory allows, as a candidate travels once for each block
    of queries and a query once for each block of candidates; without keys and while
    there are fewer pairs of blocks than tasks, candidates are dealt into more.
    ``dims`` is the length of the vectors, if known (the largest of several).
    """
    left = candidates.withColumn("dims", F.size("v"))
    right = queries.withColumn("dims", F.size("v"))
    want = partitions(candidates.sparkSession)
    size = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.max("dims"), F.lit(1)).alias("d")).first()
    if not keys:
        c, q = size(left), size(right)
        dims = max(c.d, q.d)
    dims = dims or size(left).d
    c_rows, q_rows = max(1, CANDIDATE_NUMBERS // dims), max(1, QUERY_NUMBERS // dims)
    blocks = lambda n, rows: F.greatest(F.lit(1), F.ceil(n / rows)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = lambda col, n: F.pmod(F.xxhash64(col), n).cast("int")
    if keys:
        sizes = F.broadcast(left.groupBy(*keys).agg(F.count("*").alias("n_c")).join(right.groupBy(*keys).agg(F.count("*").alias("n_q")), keys))
        left, right = left.join(sizes, keys), right.join(sizes, keys)
        qbs = blocks(F.col("n_q"), q_rows)
        cbs = blocks(F.col("n_c"), c_rows)
    else:
        n_q = max(1, -(-q.n // q_rows))
        qbs, cbs = F.lit(n_q), F.lit(max(1, -(-c.n // c_rows), min(-(-c.n // CANDIDATE_BLOCK), -(-want // n_q))))
    left = left.select(*[x for x in left.columns if x not in ("n_c", "n_q")], mine("vec_id", cbs).alias("cb"), each(qbs).alias("qb"))
    right = right.select(*[x for x in right.columns if x not in ("n_c", "n_q", "v")], F.col("v").alias("qv"), each(cbs).alias("cb"), mine("query_id", qbs).alias("qb"))
    cell = ["dims", *keys, "cb", "qb"]
    kind = pa.int64() if score_type == "long" else pa.float64()

    def meet(c: pa.Table, q: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not len(c) or not len(q):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], kind)], names=names)
        ids, qids = c.column("vec_id").to_numpy(), q.column("query_id").to_numpy()
        qi, ci, scores = kernel(qids, matrix(q.column("qv")), ids, matrix(c.column("v")), q, c)
        return pa.table([pa.array(qids[qi], pa.int64()), pa.array(ids[ci], pa.int64()), pa.array(scores, kind)], names=names)

    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(meet, f"query_id long, vec_id long, score {score_type}")


def rank_hits(hits: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best different vectors of each query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    distinct = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return distinct.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_nth(col: Column, n: int = 50) -> Column:
    """The queries' stated choice: ids divisible by n."""
    return F.pmod(col, F.lit(n)) == 0


def table_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")
