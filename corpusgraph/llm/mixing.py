"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents (long ones in slices) are permuted by hash and dealt into
numbered blocks. A tree splits the exact block quotas of all sources among the
output shards, drawing the left half's share without replacement at every node.
Each shard draws a range of every source's permuted blocks, disjoint from all other
shards' and as long as its quota, and shuffles what it drew; the words that a
document gives are those that the shards drew of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .words import count_words, text_bytes, word_spans

# Fixed values of the contract: weights in turn, share of all words, most copies.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2
#: Words of a block; a document of more words is cut into slices of so many.
BLOCK_WORDS = 2048
#: Output shards at least, and words of a shard beyond which there are more.
SHARDS = 32
SHARD_WORDS = 4_000_000
#: Shards times sources at most: the size of the tree that the driver draws. Beyond it shards grow.
MOST_CELLS = 1_000_000
#: Slices whose order one task works out.
BUCKET_SLICES = 1_000
#: Sources are a dimension table that the driver holds; more than this is refused.
MOST_SOURCES = 100_000
SEED = 5


def fill_targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST_COPIES) -> list[float]:
    """Words per source: by weight, none above ``most`` times its size, the excess reshared by weight."""
    caps = [float(most * n) for n in sizes]
    targets, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    budget = min(share * sum(sizes), sum(caps))
    while open_:
        each = (budget - sum(targets[i] for i in range(len(sizes)) if i not in open_)) / sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * each > caps[i]}
        if not over:
            for i in open_:
                targets[i] = weights[i] * each
            break
        for i in over:
            targets[i] = caps[i]
        open_ -= over
    return targets


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources) block counts: columns add up to the quotas, rows differ by one at most."""
    rng, out = np.random.default_rng(seed), np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(colors: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            out[first] = colors
            return
        half, total = n // 2, int(colors.sum())
        left = rng.multivariate_hypergeometric(colors, total * half // n) if total else colors
        split(left, first, half)
        split(colors - left, first + half, n - half)

    split(np.array(quotas, dtype=np.int64), 0, shards)
    return out


def columns_hash(df: DataFrame, salt: int):
    """A 64-bit hash of all columns of a row; columns with maps go in as JSON."""
    return F.xxhash64(F.lit(salt), *[F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields])


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, k1, k2 (hashes of the whole row), size: words of each whole text (null: 0)."""
    names = ["doc_id", "source", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(count_words(b.column(4)), pa.int64())], names=[*names, "size"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), columns_hash(docs, 1).alias("k1"), columns_hash(docs, 2).alias("k2"), "text")
    return keyed.mapInArrow(run, "doc_id long, source string, k1 long, k2 long, size long")


class Mix:
    """The plan of one mix over ``docs`` (doc_id, source, text and any other columns).

    sizes: row, doc_id, source, k1, k2, size. sources: source, its number, target,
    source_size, full passes and words of the last. block_list: the sources' numbered
    blocks. bounds: the tree's split of each source's drawn blocks among the shards.
    Null sources are a source of their own, last in order. Null ids and texts, empty tables and repeated
    rows are fine: each row is a document. Texts without words are in no mix.
    """

    def __init__(self, docs: DataFrame, shards: int | None = None, seed: int = SEED) -> None:
        spark = docs.sparkSession
        self.scratch, self.seed = Scratch(spark, "mixing"), seed
        self.sizes = self.scratch.save(document_sizes(docs).withColumn("row", F.monotonically_increasing_id()), "sizes")
        totals = self.sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).limit(MOST_SOURCES + 1).collect()
        if len(totals) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        totals.sort(key=lambda r: (r.source is None, r.source or ""))
        words = [r.words for r in totals]
        targets = fill_targets(words, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(words))])
        self.total = sum(words)
        # Above 1e9 blocks numpy's draw ends, so a very large corpus has larger blocks.
        self.block = max(BLOCK_WORDS, -(-2 * self.total // 500_000_000))
        self.shards = shards or min(max(SHARDS, -(-self.total // SHARD_WORDS)), max(1, MOST_CELLS // max(1, len(words))))
        # Slices at most: every document may end in a short one.
        self.slices = sum(r.docs for r in totals) + self.total // self.block
        rows = []
        for i, (r, target) in enumerate(zip(totals, targets, strict=True)):
            passes, rest = divmod(round(target), r.words) if r.words else (0, 0)
            rows.append((r.source, i, float(target), r.words, passes, rest))
        self.sources = spark.createDataFrame(rows, "source string, src int, target double, source_size long, passes long, rest long")
        self.block_list = self.scratch.save(self._block_list(), "blocks")
        # Blocks of each source, and those of them that begin within the last pass.
        upto = F.max(F.when(F.col("start") < F.col("rest"), F.col("block") + 1))
        counts = self.block_list.join(F.broadcast(self.sources), "src").groupBy("src").agg((F.max("block") + 1).alias("blocks"), F.coalesce(upto, F.lit(0)).alias("rest_blocks"), F.first("passes").alias("passes")).orderBy("src").collect()
        quotas = [r.passes * r.blocks + r.rest_blocks for r in counts]
        bounds = np.concatenate([np.zeros((1, len(quotas)), np.int64), np.cumsum(split_quotas(quotas, self.shards, seed), axis=0)])
        self.bounds = spark.createDataFrame([(r.src, r.blocks, bounds[:, i].tolist()) for i, r in enumerate(counts)], "src int, blocks long, bounds array<long>")

    def with_sources(self, df: DataFrame) -> DataFrame:
        s = self.sources.withColumnRenamed("source", "of")
        return df.join(F.broadcast(s), F.col("source").eqNullSafe(F.col("of"))).drop("of")

    def _block_list(self) -> DataFrame:
        """Every source's numbered blocks: src, block, and the slices in it (row, k1, k2, size, slice, words, h, start).

        Slices are permuted by hash and laid end to end; a block holds those that start
        in its ``self.block`` words, so no document is cut but a longer one. Buckets of
        hashes keep the running sums in tasks of bounded size.
        """
        bits = max(1, int(np.ceil(np.log2(max(2, self.slices / BUCKET_SLICES)))))
        pieces = (
            self.sizes.filter("size > 0")
            .select("row", "source", "k1", "k2", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / self.block))).alias("slice"))
            .withColumn("words", F.least(F.lit(self.block).cast("long"), F.col("size") - F.col("slice") * self.block))
            .withColumn("h", F.xxhash64(F.lit(self.seed), "k1", "k2", "slice"))
            .withColumn("bucket", F.shiftright("h", 64 - bits))
        )
        pieces = self.with_sources(pieces).select("src", "row", "k1", "k2", "size", "slice", "words", "h", "bucket")
        by_source = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = pieces.groupBy("src", "bucket").agg(F.sum("words").alias("n")).select("src", "bucket", F.coalesce(F.sum("n").over(by_source), F.lit(0)).alias("offset"))
        in_bucket = Window.partitionBy("src", "bucket").orderBy("h", "k1", "k2", "slice", "row").rowsBetween(Window.unboundedPreceding, -1)
        placed = pieces.join(offsets, ["src", "bucket"]).withColumn("start", F.col("offset") + F.coalesce(F.sum("words").over(in_bucket), F.lit(0)))
        return placed.withColumn("block", F.floor(F.col("start") / self.block)).drop("bucket", "offset")

    def shard_quotas(self) -> DataFrame:
        """What the tree gives each shard of each source: shard, src, first, last: its range of the source's drawn blocks, last excluded."""
        ranges = F.transform(F.sequence(F.lit(1), F.size("bounds") - 1), lambda i: F.struct(F.element_at("bounds", i).alias("first"), F.element_at("bounds", i + 1).alias("last")))
        return self.bounds.join(F.broadcast(self.sources), "src").select("src", "blocks", "passes", "rest", F.posexplode(ranges).alias("shard", "range")).select("shard", "src", "blocks", "passes", "rest", "range.first", "range.last").filter("last > first")

    def draws(self) -> DataFrame:
        """What the shards draw, a row for each slice: shard, src, row, k1, k2, size, pass, block, slice, words (taken of it), turn (its place in the shard's shuffle).

        A source's drawn blocks are numbered pass after pass, and every shard takes the
        range that the tree gave it, as many blocks as its quota. In the last pass a
        slice gives only as many words as the target leaves.
        """
        quotas = self.shard_quotas().repartition("src", "shard")
        numbers = quotas.select("shard", "src", "passes", "rest", "blocks", F.explode(F.sequence("first", F.col("last") - 1)).alias("number"))
        drawn = numbers.select("shard", "src", "passes", "rest", F.floor(F.col("number") / F.col("blocks")).alias("pass"), (F.col("number") % F.col("blocks")).alias("block"))
        taken = F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(F.least("words", F.col("rest") - F.col("start")))
        met = self.block_list.join(drawn, ["src", "block"]).withColumn("words", taken).filter("words > 0")
        return met.select("shard", "src", "row", "k1", "k2", "size", "pass", "block", "slice", "words", F.xxhash64(F.lit(self.seed + 1), "h", "pass").alias("turn"))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken (words that the shards drew) and shards (which, in order) of every row."""
        per_row = self.draws().groupBy("row").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_set("shard")).alias("shards"))
        rows = self.with_sources(self.sizes)
        none = F.array().cast("array<int>")
        return rows.join(per_row, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", none).alias("shards"))

    def documents(self, docs: DataFrame) -> DataFrame:
        """The mix itself: the columns of ``docs``, a row for each document, pass and shard that drew of it; a shard's rows lie in one partition, shuffled.

        The text is the taken words' text (all of it, unchanged, where all words are
        taken); a column n_chars is counted anew. ``docs`` must be the rows the plan was
        made from; other columns may have any names.
        """
        names = docs.columns
        lists = (
            self.draws()
            .groupBy("k1", "k2", "row", "size", "pass", "shard")
            .agg(F.array_sort(F.collect_list(F.struct("slice", "words"))).alias("taken"), F.sum("words").alias("words"), F.min("turn").alias("turn"))
        )
        # What is drawn of equal rows is the text of any of them, so one stands for all.
        rows = docs.select(columns_hash(docs, 1).alias("k1"), columns_hash(docs, 2).alias("k2"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("d"))
        rows = rows.withColumn("own", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))).filter("own = 1")
        met = rows.join(lists, ["k1", "k2"])
        chosen = met.select("d", F.when(F.col("words") < F.col("size"), F.col("taken")).alias("taken"), "shard", "turn")
        block, text_at = self.block, names.index("text")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d, taken = b.column(0), b.column(1)
                some = np.flatnonzero(taken.is_valid().to_numpy(zero_copy_only=False))
                if len(some):
                    columns = d.flatten()
                    texts = []
                    for i in some.tolist():
                        raw, ends = text_bytes(columns[text_at].slice(i, 1))
                        starts, stops, _ = word_spans(raw, ends)
                        spans = [(x["slice"] * block, x["slice"] * block + x["words"] - 1) for x in taken[i].as_py()]
                        texts.append(" ".join(raw[starts[p] : stops[q]].tobytes().decode() for p, q in spans))
                    mask = np.zeros(len(b), dtype=bool)
                    mask[some] = True
                    columns[text_at] = pc.replace_with_mask(columns[text_at], pa.array(mask), pa.array(texts, columns[text_at].type))
                    d = pa.StructArray.from_arrays(columns, fields=list(d.type))
                yield pa.RecordBatch.from_arrays([d, b.column(2), b.column(3)], names=["d", "shard", "turn"])

        made = chosen.mapInArrow(cut, T.StructType([chosen.schema["d"], chosen.schema["shard"], chosen.schema["turn"]]))
        dealt = made.repartitionById(self.shards, F.col("shard")).sortWithinPartitions("turn").select("d.*")
        return dealt.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else dealt


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).taken()
