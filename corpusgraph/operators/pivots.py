"""Exact inner-product search over vectors stored in groups around pivots.

Every vector is stored with its nearest pivot; a group knows its radius, the distance of
its farthest vector. By Cauchy-Schwarz no vector of a group scores above the question's
score with the pivot plus the question's length times the radius. The groups of the best
bounds give a question its floor, the n-th best score so far; groups whose bound is
below it are not read. How many that are depends on the vectors: tight clusters leave
most groups unread, vectors spread evenly over a sphere of many dimensions hardly any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import top_k, vector_matrix
from ..functions.scratch import Scratch

#: Pivots at most, and their bytes at most: they are sent to all tasks.
MOST_PIVOTS, PIVOT_BYTES = 1024, 32 << 20
#: Vectors of the sample for each pivot.
SAMPLE = 4
#: Vectors of a pack, bytes of vectors that one task holds of a group (about, for a group of a third of all), questions that meet a group at once.
PACK_ROWS, PART_BYTES, QUESTIONS = 4096, 32 << 20, 4096
#: What rounding may take from a bound, as a part of the lengths in it.
SLACK = 1e-9

_PACKS = "grp int, salt int, dims int, n int, radius double, ids binary, rows binary"


@dataclass(frozen=True)
class PivotIndex:
    """packs: stored vectors by group (-1: of a length that no pivot has); pivots: of each length (first group, matrix); radius and vectors of each group."""

    packs: DataFrame
    pivots: dict[int, tuple[int, np.ndarray]]
    radius: np.ndarray
    count: np.ndarray
    salts: int


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))


def _far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of a sample, each the farthest from all chosen before, so that every cluster in it gets one."""
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if not far.max() > 0:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def group_vectors(vectors: DataFrame, scratch: Scratch, id_col: str = "row_id", vector_col: str = "dense", most_pivots: int = MOST_PIVOTS) -> PivotIndex:
    """Stores vectors (whole-number ids) by group. Pivots, about the root of all vectors, are chosen far apart from a sample of SAMPLE times as many, taken by hash of the id.

    Rows with a null id, a null or empty vector or a null or missing component have no part.
    """
    rows = _usable(vectors.withColumn(id_col, F.col(id_col).cast("long")), id_col, vector_col)
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("d")).first()
    n_pivots = max(1, min(most_pivots, int(size.n**0.5), PIVOT_BYTES // (8 * size.d)))
    salts = max(1, -(-size.n * size.d * 8 // (3 * PART_BYTES)))
    chosen: dict[int, list] = {}
    for r in rows.filter(~F.exists("v", lambda x: F.abs(x) == float("inf"))).orderBy(F.xxhash64("id"), "id").limit(SAMPLE * n_pivots).collect():
        chosen.setdefault(len(r.v), []).append(r.v)
    pivots, first, sampled = {}, 0, max(1, sum(map(len, chosen.values())))
    for dims, own in sorted(chosen.items()):
        with np.errstate(over="ignore", invalid="ignore"):
            pivots[dims] = first, _far_apart(np.array(own), max(1, n_pivots * len(own) // sampled))
        first += len(pivots[dims][1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for dims in np.unique(sizes).tolist():
                some = pa.array(np.flatnonzero(sizes == dims))
                ids, lists = batch.column(0).take(some), batch.column(1).take(some)
                m = vector_matrix(lists)
                group, far = np.full(len(m), -1), np.full(len(m), np.inf)
                if dims in pivots:
                    base, p = pivots[dims]
                    with np.errstate(invalid="ignore", over="ignore"):
                        nearest = (m @ p.T - (p * p).sum(axis=1) / 2).argmax(axis=1)
                        far = np.sqrt(((m - p[nearest]) ** 2).sum(axis=1))
                    group = base + nearest
                    # Beyond a double's range there is no distance, so such vectors are always read.
                    odd = ~np.isfinite(far)
                    group[odd], far[odd] = -1, np.inf
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(m), dims, np.int32)), pa.array(group.astype(np.int32)), pa.array(far), lists], names=["id", "dims", "grp", "far", "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            grp, salt, dims = (t.column(c)[0].as_py() for c in ("grp", "salt", "dims"))
            rows = vector_matrix(t.column("v")).tobytes()
            cells = [grp, salt, dims, len(t), float(np.max(t.column("far").to_numpy())), t.column("id").to_numpy().tobytes(), rows]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=["grp", "salt", "dims", "n", "radius", "ids", "rows"])

        at = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("grp", "salt", "dims")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)] if len(batch) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and tuple(keys[a]) != at:
                    yield from close()
                    held = []
                at = tuple(keys[a])
                while a < b:
                    step = min(b - a, PACK_ROWS - sum(map(len, held)))
                    held.append(batch.slice(a, step))
                    a += step
                    if sum(map(len, held)) == PACK_ROWS:
                        yield from close()
                        held = []
        if held:
            yield from close()

    dealt = rows.mapInArrow(assign, "id long, dims int, grp int, far double, v array<double>").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    ordered = dealt.repartition("grp", "salt").sortWithinPartitions("grp", "salt", "dims", "far").select("id", "dims", "grp", "salt", "far", "v")
    packs = scratch.save(ordered.mapInArrow(pack, _PACKS), "packs")
    radius, count = np.zeros(max(1, first)), np.zeros(max(1, first), np.int64)
    for r in packs.filter("grp >= 0").groupBy("grp").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect():
        radius[r.grp], count[r.grp] = r.radius, r.n
    return PivotIndex(packs, pivots, radius, count, salts)


def _meet(kind: str, n: int):
    """The n best of one part of a group for the questions that read it."""

    def run(packs: pa.Table, asked: pa.Table) -> pa.Table:
        found = [pa.table([pa.array([], asked.schema.field("id").type), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "row_id", "score"])]
        if len(packs) and len(asked):
            lists = asked.column("v").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            sizes = lists.value_lengths().to_numpy()
            near, floor = asked.column("near").to_numpy(), asked.column("floor").to_numpy().copy()
            for dims in sorted(set(packs.column("dims").to_pylist())):
                own = np.flatnonzero(sizes == dims)
                if not len(own):
                    continue
                q = vector_matrix(lists.take(pa.array(own)))
                length = np.sqrt((q * q).sum(axis=1))
                scores, ids = np.full((len(own), n), -np.inf), np.full((len(own), n), np.iinfo(np.int64).max)
                for i in sorted(np.flatnonzero(np.array(packs.column("dims").to_pylist()) == dims).tolist(), key=lambda i: packs.column("radius")[i].as_py()):
                    radius = packs.column("radius")[i].as_py()
                    bound = near[own] + length * radius if np.isfinite(radius) else np.full(len(own), np.inf)
                    some = np.flatnonzero(~(bound + SLACK * np.abs(bound) < floor[own]))
                    if not len(some):
                        continue
                    rows = np.frombuffer(packs.column("rows")[i].as_py()).reshape(-1, dims)
                    row_ids = np.frombuffer(packs.column("ids")[i].as_py(), np.int64)
                    s = np.concatenate([scores[some], q[some] @ rows.T], axis=1)
                    d = np.concatenate([ids[some], np.broadcast_to(row_ids, (len(some), len(row_ids)))], axis=1)
                    order = np.lexsort((d, -s))[:, :n]
                    scores[some], ids[some] = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)
                    floor[own[some]] = np.maximum(floor[own[some]], scores[some][:, n - 1])
                at, k = np.nonzero(ids < np.iinfo(np.int64).max)
                found.append(pa.table([asked.column("id").take(pa.array(own[at])), pa.array(ids[at, k]), pa.array(scores[at, k])], names=["query_id", "row_id", "score"]))
        return pa.concat_tables(found)

    return run


@dataclass(frozen=True)
class PivotSearch:
    """hits: query_id, row_id, score, rank; groups: id, grp, n, read (whether the group was read for the question)."""

    hits: DataFrame
    groups: DataFrame

    def read_share(self) -> float:
        """The part of all pairs of a question and a stored vector whose groups were read."""
        r = self.groups.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("read"), F.col("n"))).alias("read")).first()
        return (r.read or 0) / max(1, r["all"] or 0)


def search_groups(queries: DataFrame, index: PivotIndex, n: int, scratch: Scratch, query_id: str = "query_id", vector_col: str = "dense") -> PivotSearch:
    """The n largest inner products of every query in double precision, exactly; ties to the smaller id. Queries' ids differ."""
    q = scratch.save(_usable(queries, query_id, vector_col), "questions")
    kind = q.schema["id"].dataType.simpleString()
    pivots, radius, count = index.pivots, index.radius, index.count

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each question and group: score with the pivot, bound, vectors, and whether it is one of the first to read."""
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for dims in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == dims)
                m = vector_matrix(batch.column(1).take(pa.array(some)))
                base, p = pivots.get(dims, (0, np.zeros((0, dims))))
                own = np.concatenate([np.arange(base, base + len(p)), [-1]])
                with np.errstate(invalid="ignore", over="ignore"):
                    near = np.concatenate([m @ p.T, np.full((len(m), 1), np.inf)], axis=1)
                    reach = np.sqrt((m * m).sum(axis=1))[:, None] * np.append(radius[base : base + len(p)], 0.0)
                    bound = near + reach + SLACK * (np.abs(near) + reach)
                bound[np.isnan(bound)] = np.inf
                sizes_of = np.append(count[base : base + len(p)], 0)
                order = np.argsort(-bound, axis=1, kind="stable")
                before = np.cumsum(sizes_of[order], axis=1) - sizes_of[order]
                first = np.zeros(bound.shape, dtype=bool)
                np.put_along_axis(first, order, before < 2 * n, axis=1)
                ids = batch.column(0).take(pa.array(np.repeat(some, len(own))))
                cells = [pa.array(np.tile(own, len(m)).astype(np.int32)), pa.array(near.ravel()), pa.array(bound.ravel()), pa.array(np.tile(sizes_of, len(m))), pa.array((first | (own == -1)).ravel())]
                yield pa.RecordBatch.from_arrays([ids, *cells], names=["id", "grp", "near", "bound", "n", "first"])

    pairs = scratch.save(q.mapInArrow(judge, f"id {kind}, grp int, near double, bound double, n long, first boolean"), "pairs")
    chunks = max(1, -(-q.count() // QUESTIONS))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))

    def score(some: DataFrame, name: str) -> DataFrame:
        wanted = some.select("id", "grp", "near", "floor").join(q, "id").withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn("salt", each(index.salts))
        held = index.packs.withColumn("chunk", each(chunks))
        met = held.groupBy("grp", "salt", "chunk").cogroup(wanted.groupBy("grp", "salt", "chunk"))
        return scratch.save(met.applyInArrow(_meet(kind, n), f"query_id {kind}, row_id long, score double"), name)

    order = [F.desc("score"), F.col("row_id")]
    first = score(pairs.filter("first").withColumn("floor", F.lit(float("-inf"))), "first")
    floors = top_k(first, ["query_id"], order, n).filter(F.col("rank") == n).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    judged = scratch.save(pairs.join(floors, "id", "left").fillna(float("-inf"), ["floor"]).withColumn("read", F.col("first") | (F.col("bound") >= F.col("floor"))), "judged")
    rest = score(judged.filter(F.col("read") & ~F.col("first")), "rest")
    return PivotSearch(top_k(first.unionByName(rest), ["query_id"], order, n), judged.select("id", "grp", "n", "read"))
