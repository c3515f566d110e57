"""Rankings, dense numbering and exact inner-product search without one task for all rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Vectors in a pack, and bytes of packs that are broadcast at most; beyond that both sides are shuffled.
PACK_ROWS = 4096
BROADCAST_BYTES = 64 << 20
#: Bytes of a matrix of scores, and of the best scores a task holds before it hands them on.
SCORE_BYTES = 16 << 20
HELD_BYTES = 64 << 20
#: Parts in which a pack of queries meets its vectors when both sides are shuffled.
SALTS = 32


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def number_rows(df: DataFrame, key: list[str], order: list[str], index_col: str, scratch: Scratch | None = None, count_col: str | None = None) -> DataFrame:
    """Numbers rows from 0 in the order of ``order`` within their key (no key: all rows); nulls come first.

    Rows are sorted into ranges of (key, order), which are sampled to be of like size
    whatever the keys are, and written once. Only the ranges' counts of each key are
    added up, so no task's rows grow with a key. ``count_col`` gets the key's rows.
    """
    scratch = scratch or Scratch(df.sparkSession, "numbered")
    ranged = df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    held = scratch.save(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), f"{index_col}-sorted")
    counts = held.groupBy(*key, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    whole = Window.partitionBy(*key)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_key{i}" for i in range(len(key))]
    starts = scratch.save(
        counts.select(*[F.col(c).alias(n) for c, n in zip(key, names, strict=True)], F.col("_part").alias("_of"), (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("_count")),
        f"{index_col}-starts",
    )
    size = starts.agg(F.coalesce(F.sum(sum((F.coalesce(F.octet_length(F.col(n).cast("string")), F.lit(0)) for n in names), F.lit(48))), F.lit(0))).first()[0]
    on = F.col("_part") == F.col("_of")
    for c, n in zip(key, names, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(n))
    placed = held.join(F.broadcast(starts) if size <= BROADCAST_BYTES else starts, on)
    numbered = placed.withColumn(index_col, (F.col("_row") + F.col("_shift")).cast("long"))
    if count_col:
        numbered = numbered.withColumn(count_col, F.col("_count"))
    return numbered.select(*[c for c in df.columns if c != index_col], index_col, *([count_col] if count_col else []))


def dense_index(df: DataFrame, coarse: list[str], fine: list[str], index_col: str) -> DataFrame:
    """Numbers all rows from 0 in the order of coarse, then fine columns."""
    return number_rows(df, [], [*coarse, *fine], index_col)


def vector_matrix(column: pa.Array) -> np.ndarray:
    """(rows, dims) of an Arrow list column without nulls whose lists are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(len(column), -1)


def pack_vectors(df: DataFrame, id_col: str, vector_col: str, prefix: str) -> DataFrame:
    """dims and the number, the ids and the row-major doubles of packs of up to PACK_ROWS vectors of equal length; null and empty vectors are left out."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        numbers = count(TaskContext.get().partitionId() << 32)

        def pack(dims: int) -> pa.RecordBatch:
            ids = pa.concat_arrays([x for x, _ in held[dims]])
            flat = np.concatenate([m for _, m in held.pop(dims)])
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([next(numbers)], pa.int64()), lists, pa.array([flat.tobytes()], pa.binary())], names=["dims", f"{prefix}_no", f"{prefix}_ids", f"{prefix}_rows"])

        for batch in batches:
            ids, v = batch.column(0), batch.column(1)
            sizes = np.diff(v.offsets.to_numpy())
            for dims in np.unique(sizes).tolist():
                some = pa.array(np.flatnonzero(sizes == dims))
                own, m = ids.take(some), vector_matrix(v.take(some))
                for a in range(0, len(own), PACK_ROWS):
                    held.setdefault(dims, []).append((own.slice(a, PACK_ROWS), m[a : a + PACK_ROWS]))
                    if sum(len(x) for x, _ in held[dims]) >= PACK_ROWS:
                        yield pack(dims)
        for dims in list(held):
            yield pack(dims)

    return rows.mapInArrow(run, f"dims int, {prefix}_no long, {prefix}_ids array<{kind}>, {prefix}_rows binary")


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n best of each row: largest score, ties to the smaller id; both sorted."""
    if n == 1:
        # Columns in the order of their ids: the first largest is that of the smallest id.
        order = np.argsort(ids, axis=1, kind="stable")
        ranked = np.take_along_axis(scores, order, 1)
        at = ranked.argmax(axis=1)[:, None]
        return np.take_along_axis(ranked, at, 1), np.take_along_axis(ids, np.take_along_axis(order, at, 1), 1)
    order = np.lexsort((ids, -scores))[:, :n] if scores.shape[1] <= 4 * n else None
    if order is None:
        least = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
        out_s, out_i = np.empty((len(scores), n)), np.empty((len(scores), n), dtype=ids.dtype)
        for i, row in enumerate(scores):
            some = np.flatnonzero(row >= least[i])
            some = some[np.lexsort((ids[i, some], -row[some]))[:n]]
            out_s[i], out_i[i] = row[some], ids[i, some]
        return out_s, out_i
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _search(n: int):
    """Keeps each query's n best over all packs that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        held = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            for q_ids, scores, ids in best.values():
                at = np.repeat(np.arange(len(q_ids)), scores.shape[1])
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(at)), pa.array(ids.ravel()), pa.array(scores.ravel())], names=["query_id", "id", "score"])
            best.clear()

        for batch in batches:
            for i in range(len(batch)):
                cell = {c: batch.column(c)[i] for c in batch.schema.names}
                dims = cell["dims"].as_py()
                q_ids, v_ids = cell["q_ids"].values, cell["v_ids"].values.to_numpy()
                q, v = (np.frombuffer(cell[c].as_buffer(), dtype=np.float64).reshape(-1, dims) for c in ("q_rows", "v_rows"))
                name = cell["q_no"].as_py()
                parts = []
                step = max(1, SCORE_BYTES // 8 // len(v))
                for a in range(0, len(q), step):
                    s = q[a : a + step] @ v.T
                    parts.append(_best(s, np.broadcast_to(v_ids, s.shape), n))
                scores, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
                if name in best:
                    _, was, was_ids = best[name]
                    held -= was.size
                    scores, ids = _best(np.concatenate([was, scores], axis=1), np.concatenate([was_ids, ids], axis=1), n)
                best[name] = [q_ids, scores, ids]
                held += scores.size
                if 16 * held > HELD_BYTES:
                    yield from hand_on()
                    held = 0
        yield from hand_on()

    return run


def _once(hits: DataFrame, query_id: str, id_col: str) -> DataFrame:
    """Each pair of ids once, with its best score; the rows of a query then lie together, as a ranking of them wants."""
    best = Window.partitionBy(query_id, id_col).orderBy(F.desc("score"))
    return hits.repartition(query_id).withColumn("_turn", F.row_number().over(best)).filter("_turn = 1").drop("_turn")


def top_k_inner_product(queries: DataFrame, vectors: DataFrame, n: int, id_col: str = "row_id", vector_col: str = "dense", query_id: str = "query_id") -> DataFrame:
    """query_id, id_col, score, rank: the n largest inner products in double precision, ties to the smaller id.

    queries: query_id and vector_col; vectors: id_col (a whole number) and
    vector_col. Both are packed where they lie; the packs of the smaller side are
    broadcast if they fit BROADCAST_BYTES, else packs of both sides meet by a
    shuffle. A task keeps the n best of each query over all it meets, so only those
    are ranked in the end. Vectors of different length do not meet; rows with a null
    id, a null vector or a null component have no part. The vectors' ids differ; rows that
    share a query's id are one query and count by the best of their vectors.
    """
    size = lambda df: df.agg(F.coalesce(F.sum(8 * F.greatest(F.lit(1), F.size(vector_col))), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    q_size, v_size = size(queries), size(vectors)
    q = pack_vectors(queries, query_id, vector_col, "q")
    v = pack_vectors(vectors.withColumn(id_col, F.col(id_col).cast("long")), id_col, vector_col, "v")
    if min(q_size.b, v_size.b) <= BROADCAST_BYTES:
        met = v.join(F.broadcast(q), "dims") if q_size.b <= v_size.b else q.join(F.broadcast(v), "dims")
    else:
        # Every pack of vectors goes to each block of queries, in one of SALTS parts.
        blocks = max(1, -(-q_size.n // PACK_ROWS))
        each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        dealt = lambda rows, k: F.pmod(F.xxhash64(rows), F.lit(k)).cast("int")
        met = v.withColumn("salt", dealt("v_ids", SALTS)).withColumn("block", each(blocks)).join(q.withColumn("block", dealt("q_ids", blocks)).withColumn("salt", each(SALTS)), ["dims", "block", "salt"])
    kind = queries.schema[query_id].dataType.simpleString()
    hits = met.select("dims", "q_no", "q_ids", "q_rows", "v_ids", "v_rows").mapInArrow(_search(n), f"{query_id} {kind}, {id_col} long, score double")
    return top_k(_once(hits, query_id, id_col), [query_id], [F.desc("score"), F.col(id_col)], n)
