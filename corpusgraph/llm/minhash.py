"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has one coordinate for each of T bins. In a round every shingle falls
into a hashed bin with a hashed value, and empty bins take the least value that
fell into them; after T such rounds, round T + i sends all shingles to bin i, so
every coordinate fills. Documents that agree on a whole band of coordinates are
candidates, and candidates are links only if their full shingle sets say so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, spread_join
from .components import components
from .shingles import mix, shingle_sets

#: Coordinates of a sketch, and of a band of it: 32 bands of 4. A pair at similarity 0.75 shares none with probability 5e-6.
BINS = 128
ROWS = 4
#: Sets on either side of a cell in which the members of a group meet.
BLOCK = 256
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
SEED = 10

_M1 = np.uint64(0x9E3779B97F4A7C15)


def _times(a: int, b: int) -> np.uint64:
    return np.uint64(a * b & 0xFFFFFFFFFFFFFFFF)


def sketches(elements: np.ndarray, begins: np.ndarray, bins: int = BINS) -> np.ndarray:
    """(sets, bins) coordinates; sets must not be empty."""
    most = (1 << 24) // bins  # sets whose cells' numbers fit beside a value of 40 bits
    parts = [_sketches(elements[begins[a] : begins[min(a + most, len(begins) - 1)]], begins[a : a + most + 1] - begins[a], bins) for a in range(0, len(begins) - 1, most)]
    return np.concatenate(parts) if parts else np.zeros((0, bins), dtype=np.uint64)


def _sketches(elements: np.ndarray, begins: np.ndarray, bins: int) -> np.ndarray:
    n = len(begins) - 1
    out = np.zeros((n, bins), dtype=np.uint64)
    filled = np.zeros((n, bins), dtype=bool)
    owner, item, low = np.repeat(np.arange(n), np.diff(begins)), elements, np.uint64(40)
    for turn in range(2 * bins):
        if not len(item):
            break
        h = mix(item + _times(turn + 1, 0x9E3779B97F4A7C15))
        at = (h % np.uint64(bins)).astype(np.int64) if turn < bins else np.full(len(h), turn - bins)
        order = np.sort((owner * bins + at).astype(np.uint64) << low | h >> np.uint64(24))
        cell = (order >> low).astype(np.int64)
        least = np.concatenate([[True], cell[1:] != cell[:-1]])
        cell, value = cell[least], order[least]
        new = ~filled.ravel()[cell]
        # Only the value counts, not whose cell it is.
        value = value[new] & np.uint64((1 << 40) - 1)
        out.ravel()[cell[new]] = mix(value + _times(turn + 1, 0xA0761D6478BD642F))
        filled.ravel()[cell] = True
        open_ = ~filled.all(axis=1)
        if not open_.all():
            stay = open_[owner]
            owner, item = owner[stay], item[stay]
    return out


def sketch_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (hash of the whole set) and bands (one key per band; null without shingles) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for a, s, begins in shingle_sets(b.column(1)):
                sizes = np.diff(begins)
                some = np.flatnonzero(sizes)
                h1, h2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
                bands = np.zeros((len(some), BINS // ROWS), dtype=np.uint64)
                if len(some):
                    h1[some], h2[some] = np.add.reduceat(mix(s), begins[some]), np.add.reduceat(mix(s ^ _M1), begins[some])
                    c = sketches(s, np.concatenate([begins[some], begins[-1:]]))
                    for r in range(ROWS):
                        bands = mix(bands * _M1 + c[:, r::ROWS])
                    bands = mix(bands + np.arange(bands.shape[1], dtype=np.uint64))
                valid = np.zeros(len(sizes), dtype=bool)
                valid[some] = True
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(valid)]) * bands.shape[1], pa.int32()), pa.array(bands.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(a, len(sizes)), pa.array(sizes, pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists], names=["doc_id", "n_shingles", "h1", "h2", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>")


def packed_sets(docs: DataFrame) -> DataFrame:
    """doc_id, s: the sorted shingles of each whole text as 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, s, begins in shingle_sets(b.column(1)):
                rows = [s[i:j].tobytes() for i, j in zip(begins[:-1], begins[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, len(rows)), pa.array(rows, pa.binary())], names=["doc_id", "s"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, s binary")


def verify_pairs(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("u"), F.col("s").alias("p"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("s").alias("q"))
    # A leader may be the v of very many pairs.
    met = spread_join(pairs.select("u", "v"), right, ["v"]).join(left, "u")
    return met.select("u", "v", "p", "q").mapInArrow(run, "u long, v long")


def link_cells(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (u, v) between members of different components within a group.

    members: lead (the group), rep, c (its component), out (whether it is outside
    the group's largest component). What is outside meets all members in cells of
    BLOCK x BLOCK sets, each in a task of its own that hands on links only; pairs
    are never rows.
    """
    sizes = members.groupBy("lead").agg(F.ceil(F.sum(F.col("out").cast("int")) / BLOCK).cast("int").alias("obs"), F.ceil(F.count("*") / BLOCK).cast("int").alias("mbs"))
    mine = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_out = F.transform(F.when(F.col("out"), each("mbs")).otherwise(F.array().cast("array<int>")), lambda i: F.struct(mine("obs").alias("ob"), i.alias("mb"), F.lit(True).alias("outer")))
    as_member = F.transform(each("obs"), lambda i: F.struct(i.alias("ob"), mine("mbs").alias("mb"), F.lit(False).alias("outer")))
    placed = spread_join(members, sizes, ["lead"]).join(sets.select(F.col("doc_id").alias("rep"), "s"), "rep").select("lead", "rep", "c", "s", F.explode(F.concat(as_out, as_member)).alias("cell"))
    rows = placed.select("lead", "cell.ob", "cell.mb", "cell.outer", "rep", "c", "s")

    def meet(t: pa.Table) -> pa.Table:
        outer = np.asarray(t.column("outer"))
        rep, c = np.asarray(t.column("rep")), np.asarray(t.column("c"))
        own = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t.column("s")]
        size = np.array([len(x) for x in own])
        inner, pairs = np.flatnonzero(~outer), []
        if len(inner) and outer.any():
            flat = np.concatenate([own[i] for i in inner])
            order = np.argsort(flat, kind="stable")
            flat, whose = flat[order], np.repeat(np.arange(len(inner)), size[inner])[order]
            for i in np.flatnonzero(outer):
                a, b = np.searchsorted(flat, own[i]), np.searchsorted(flat, own[i], side="right")
                n = b - a
                at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both = np.bincount(whose[at], minlength=len(inner))
                linked = (100 * both >= percent * (size[i] + size[inner] - both)) & (c[inner] != c[i])
                pairs += [(max(rep[i], y), min(rep[i], y)) for y in rep[inner[linked]]]
        u, v = zip(*set(pairs), strict=True) if pairs else ((), ())
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return rows.groupBy("lead", "ob", "mb").applyInArrow(meet, "u long, v long")


def _alike(n, m):
    """Sizes that a link can have."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Equal sets are one class and need no pairs. Classes that share a band are first
    compared with the least id of their bucket only, its leader. Where the members of
    a leader's buckets are then still in several components, everything outside the
    largest is compared with all members; no pair is capped or dropped. Rows
    without words are linked with nothing and kept; rows without id have no
    component and are not kept; rows that share an id count as one document.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = scratch.save(sketch_documents(docs), "rows")
    worded = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = worded.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    members = classes.select("rep", "n", F.explode("bands").alias("key"))
    leaders = members.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("lead"), F.count("*").alias("many")).filter("many > 1").select("key", "lead")
    shared = scratch.save(spread_join(members, leaders, ["key"]).select("rep", "n", F.col("lead.rep").alias("lead"), F.col("lead.n").alias("lead_n")).distinct(), "shared")
    star = shared.filter((F.col("rep") != F.col("lead")) & _alike(F.col("n"), F.col("lead_n"))).select(F.col("rep").alias("u"), F.col("lead").alias("v"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(shared.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = scratch.save(packed_sets(texts), "sets")
    links = scratch.save(verify_pairs(star, sets), "star")
    known = components(links, scratch, "first")
    # What the stars left apart: members of one leader's buckets in several components. Pairs with the leader itself are done.
    now = shared.join(known, F.col("rep") == F.col("node"), "left").select("lead", "rep", F.coalesce("component", "rep").alias("c"))
    parts = now.groupBy("lead", "c").agg(F.count("*").alias("many")).groupBy("lead").agg(F.max(F.struct("many", "c")).alias("top"), F.count("*").alias("parts"), F.sum("many").alias("all")).filter("parts > 1 and all > 2")
    left = scratch.save(spread_join(now, parts.select("lead", F.col("top.c").alias("largest")), ["lead"]).select("lead", "rep", "c", (F.col("c") != F.col("largest")).alias("out")), "left")
    more = scratch.save(link_cells(left, sets).distinct(), "cells")
    tree = known.select(F.col("node").alias("u"), F.col("component").alias("v"))
    found = components(tree.unionByName(more), scratch, "second")
    reps = classes.select("h1", "h2", "rep").join(found, F.col("rep") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "rep").alias("c"))
    linked = spread_join(worded.select("doc_id", "n_shingles", "h1", "h2"), reps, ["h1", "h2"]).select("doc_id", "n_shingles", F.col("c").alias("component_id"))
    alone = rows.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
