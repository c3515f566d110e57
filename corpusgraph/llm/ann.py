"""Approximate nearest neighbours by cross-polytope hashing.

A hash turns unit vectors by a pseudo-rotation (three rounds of random signs and a
fast Hadamard transform) and takes the nearest signed axis. A table concatenates
as many such hashes at every size; the share of its buckets that a query probes
falls as the corpus grows. A query probes the buckets whose axes are nearest to it
together in several tables; all vectors found there are ranked by their exact
cosine. Queries that find too few are compared with all vectors.

All hashes of a table but the last name the shuffled bucket, in blocks; the last
one is looked up inside the task, where a query only meets candidates whose axis it
probes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import every_nth, matrix, rank_hits, search_grid, table_of, usable_vectors

#: Tables, and hashes in each, for any number of vectors.
TABLES = 8
HASHES = 2
#: Share of a table's buckets that a query probes at REFERENCE vectors; it falls with their number to the power of FALL.
PROBED = 1 / 18
REFERENCE = 2000
FALL = 0.3
#: Buckets with so many vectors, on average, are probed beyond that share, which makes small tables nearly exact.
FEW = 80
ROUNDS = 3
SEED = 20240229


def hadamard_rotate(rows: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows (padded with zeros to a power of two) after each round's signs and a fast Hadamard transform."""
    y = np.zeros((len(rows), signs.shape[1]))
    y[:, : rows.shape[1]] = rows
    for s in signs:
        y *= s
        step = 1
        while step < y.shape[1]:
            pairs = y.reshape(len(y), -1, 2, step)
            y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(y), -1)
            step *= 2
        y /= np.sqrt(y.shape[1])
    return y


def table_signs(dims: int, tables: int, seed: int = SEED) -> np.ndarray:
    padded = 1 << max(0, int(dims - 1).bit_length())
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, ROUNDS, padded))


def scaled(rows: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component to between 1/2 and 1: exact, and safe from over- and underflow."""
    most = np.abs(rows).max(axis=1, initial=0.0)
    return np.ldexp(rows, -np.frexp(most)[1][:, None])


def units(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.sqrt(np.square(rows).sum(axis=1, keepdims=True))


def probed_buckets(sides: list[np.ndarray], probes: int) -> np.ndarray:
    """(rows, probes) numbers of the nearest buckets, in no order.

    sides: for each hash the rows' inner products with all signed axes (axis i is i,
    its opposite i + d). A bucket's nearness is the sum of its axes'; far axes of a
    hash are left out.
    """
    axes = sides[0].shape[1]
    if probes == 1:
        code = np.zeros(len(sides[0]), dtype=np.int64)
        for side in sides:
            code = code * axes + side.argmax(axis=1)
        return code[:, None]
    total, code = np.zeros((len(sides[0]), 1)), np.zeros((len(sides[0]), 1), dtype=np.int64)
    few = min(axes, int(np.ceil(4 * probes ** (1 / len(sides)))))
    for left, side in zip(range(len(sides) - 1, -1, -1), sides, strict=True):
        near = np.argpartition(-side, few - 1, axis=1)[:, :few]
        total = (total[:, :, None] + np.take_along_axis(side, near, 1)[:, None, :]).reshape(len(total), -1)
        code = (code[:, :, None] * axes + near[:, None, :]).reshape(len(total), -1)
        # Before the last hash more are kept than will be probed.
        most = min(total.shape[1], probes * (4 if left else 1))
        best = np.argpartition(-total, most - 1, axis=1)[:, :most]
        total, code = np.take_along_axis(total, best, 1), np.take_along_axis(code, best, 1)
    return code


def plan(n: int, dims: int) -> tuple[int, int]:
    """(hashes, probes) for n vectors: one law for all sizes, whose probed share falls steadily, so that no size is a turning point for recall."""
    axes = 2 << max(0, int(dims - 1).bit_length())
    share = PROBED * (REFERENCE / max(n, 1)) ** FALL + FEW / max(n, 1)
    return HASHES, int(min(max(np.ceil(share * axes**HASHES), axes // 2), axes**HASHES))


def hashed(rows: DataFrame, id_col: str, tables: int, hashes: int, probes: int, seed: int = SEED) -> DataFrame:
    """id_col, v, codes: for each table and bucket of the first hashes the axes ``fine`` of the last hash (one of each for probes = 1)."""
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for dims in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dims))
                for a in range(0, len(part), 256):
                    yield some(part.slice(a, 256), dims)

    def some(part: pa.RecordBatch, dims: int) -> pa.RecordBatch:
        v, signs = units(matrix(part.column(1))), table_signs(dims, tables * hashes, seed)
        codes = []
        for n in range(tables):
            sides = []
            for s in signs[n * hashes : (n + 1) * hashes]:
                turned = hadamard_rotate(v, s)
                sides.append(np.concatenate([turned, -turned], axis=1))
            codes.append(np.sort(probed_buckets(sides, probes), axis=1))
        axes, code = sides[0].shape[1], np.stack(codes, axis=1)  # rows, tables, probes in order
        new = np.ones(code.shape, dtype=bool)
        new[:, :, 1:] = code[:, :, 1:] // axes != code[:, :, :-1] // axes
        first = np.flatnonzero(new)
        tab = first // code.shape[2] % tables
        per_row = new.reshape(len(v), -1).sum(axis=1)
        fine = pa.ListArray.from_arrays(pa.array(np.append(first, code.size), pa.int32()), pa.array((code % axes).ravel(), pa.int32()))
        cells = pa.StructArray.from_arrays([pa.array(tab, pa.int32()), pa.array((code // axes).ravel()[first], pa.int64()), fine], ["tab", "bucket", "fine"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_row)), pa.int32()), cells)
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=[id_col, "v", "codes"])

    return rows.select(F.col(id_col).cast("long").alias(id_col), "v").mapInArrow(run, f"{id_col} long, v {kind}, codes array<struct<tab:int,bucket:bigint,fine:array<int>>>")


#: Pairs whose cosines are worked out at once.
PAIRS = 1 << 15


def _cosines(k: int):
    """Exact cosines of each query's candidates, where it has a list ``fine`` only those of these axes; the k best."""

    def kernel(qids, q, ids, c, q_table, c_table):
        q, c = scaled(q), scaled(c)
        q_len, c_len = np.sqrt(np.square(q).sum(1)), np.sqrt(np.square(c).sum(1))
        if "fine" in q_table.schema.names:
            axis = matrix(c_table.column("fine"))[:, 0].astype(np.int64)
            order = np.argsort(axis, kind="stable")
            lists = q_table.column("fine").combine_chunks()
            probed = lists.flatten().to_numpy()
            # Of the candidates in the order of their axes, those of each probed axis of each query.
            start, stop = np.searchsorted(axis[order], probed), np.searchsorted(axis[order], probed, side="right")
            n = stop - start
            qi = np.repeat(np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy())), n)
            ci = order[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        else:
            pairs = []
            for a in range(0, len(q), 256):
                near = (q[a : a + 256] / q_len[a : a + 256, None]) @ (c / c_len[:, None]).T
                near[qids[a : a + 256, None] == ids[None, :]] = -2
                few = min(k, near.shape[1])
                least = np.partition(near, near.shape[1] - few, axis=1)[:, near.shape[1] - few] - 1e-9
                pairs.append(np.nonzero(near >= least[:, None]) + (a,))
            qi, ci = np.concatenate([i + a for i, _, a in pairs]), np.concatenate([j for _, j, _ in pairs])
        other = qids[qi] != ids[ci]
        qi, ci = qi[other], ci[other]
        # The sum of a pair does not depend on its block, so equal vectors tie exactly.
        score = np.concatenate([np.zeros(0), *((q[qi[a : a + PAIRS]] * c[ci[a : a + PAIRS]]).sum(axis=1) for a in range(0, len(qi), PAIRS))]) / (q_len[qi] * c_len[ci])
        order = np.lexsort((ids[ci], -score, qi))
        qi, ci, score = qi[order], ci[order], score[order]
        best = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
        return qi[best], ci[best], score[best]

    return kernel


def nearest_cosine(vectors: DataFrame, queries: DataFrame, k: int, tables: int = TABLES, probes: int | None = None, hashes: int | None = None) -> DataFrame:
    """Approximate k nearest by cosine: query_id, rank, vec_id, score.

    vectors: vec_id, v; queries: query_id, v. Vectors of length zero take no part,
    and only vectors of equal length meet; very large and very small components are
    fine. A query's own id is no candidate; ties go to the smaller vec_id. Every
    vector is in every table. A query whose probes hold fewer than k candidates
    meets all vectors instead, so it has k rows, or all candidates if there are
    fewer. ``probes`` and ``hashes`` are planned from the number of vectors where
    they are not given.
    """
    nonzero = F.exists("v", lambda x: x != 0.0)
    vectors, queries = vectors.filter(nonzero), queries.filter(nonzero)
    size = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("d")).first()
    own = plan(size.n, size.d)
    hashes, probes = hashes or own[0], probes or own[1]
    scratch = Scratch(vectors.sparkSession, "ann")
    # Codes are worked out once: they are read for the sizes of buckets and for the search.
    c = scratch.save(hashed(vectors, "vec_id", tables, hashes, 1), "codes").select("vec_id", "v", F.inline("codes"))
    q = scratch.save(hashed(queries, "query_id", tables, hashes, probes), "probes").select("query_id", "v", F.inline("codes"))
    probed = scratch.save(rank_hits(search_grid(c, q, ["tab", "bucket"], _cosines(k), "double", size.d), k), "probed")
    full = probed.filter(F.col("rank") == k).select("query_id")
    short = scratch.save(queries.join(full, "query_id", "left_anti"), "short")
    if short.isEmpty():
        return probed
    whole = rank_hits(search_grid(vectors, short, [], _cosines(k), "double"), k)
    return probed.join(full, "query_id", "left_semi").select(whole.columns).unionByName(whole)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable_vectors(table_of(spark, sf_dir))
    queries = vectors.filter(every_nth(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "v")
    return nearest_cosine(vectors, queries, 5)
