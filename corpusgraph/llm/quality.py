"""Quality classifier: naive Bayes support vectors over hashed n-grams.

A text's features are indicators of its word n-grams (one and two words), of its
word-shape n-grams (one to three words) and of the byte n-grams of long words, so
that text without spaces has as many as any. Each indicator is scaled by the log
ratio of its class counts; a linear hinge-loss model on the scaled, length-
normalised indicators is fitted by dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches
from .words import byte_steps, hash_words, text_bytes, word_spans

#: Hashed features.
BITS = 18
#: Labelled rows that the model is fitted on, at most, of each class, and their features in all; the sample is chosen by hash of the id.
MOST_TRAINING = 3000
MOST_FEATURES = 30_000_000
#: A word of more bytes also gives all its strings of GRAM_BYTES bytes (two letters of most scripts without spaces).
LONG_WORD = 24
GRAM_BYTES = 6
#: Added to every class count.
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 30
#: Texts whose features are told apart at once.
STEP = 32
#: Bytes of text whose words are worked out at once.
STEP_BYTES = 1_000_000
SEED = 8

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = ord("a"), ord("A"), ord("0"), 0x80


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _shapes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """First and last three character classes of each word, and whether it repeats the word before it."""
    kind = _CLASS[raw]
    again = np.zeros(len(words), dtype=np.uint64)
    again[1:] = words[1:] == words[:-1]
    again[first[:-1][first[:-1] < len(words)]] = 0
    shape = kind[starts] | again << np.uint64(40)
    for back in (1, 2, 3):
        shape |= kind[np.maximum(stops - back, starts)] << np.uint64(8 * back)
    return _mix(shape * _M1)


def _byte_grams(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings of GRAM_BYTES bytes of the long words, and their texts."""
    long = np.flatnonzero(stops - starts > LONG_WORD)
    n = stops[long] - starts[long] - GRAM_BYTES + 1
    at = np.repeat(starts[long] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))
    cut = np.uint64(64 - 8 * GRAM_BYTES)
    return _mix((eight[at] << cut >> cut) * _M1 + np.uint64(4)), np.repeat(text_of[long], n)


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each STEP texts: their number within the column and feature, both sorted, without repeats."""
    raw_all, ends_all = text_bytes(column)
    for begin, end in byte_steps(ends_all, STEP_BYTES):
        for at, f in _features(raw_all[ends_all[begin] : ends_all[end]], ends_all[begin : end + 1] - ends_all[begin]):
            yield at + begin, f


def _features(raw: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    starts, stops, first = word_spans(raw, ends)
    n, width = len(first) - 1, np.uint64(64 - BITS)
    words = hash_words(raw, starts, stops)
    shapes = _shapes(raw, starts, stops, words, first)
    text_of = np.repeat(np.arange(n), np.diff(first))
    grams = [(words, 0), (_mix(words[:-1] * _M1 + words[1:]), 1), (shapes + np.uint64(1), 0), (_mix(shapes[:-1] * _M1 + shapes[1:] + np.uint64(2)), 1), (_mix(_mix(shapes[:-2] * _M1 + shapes[1:-1]) * _M1 + shapes[2:] + np.uint64(3)), 2)]
    hashed = [((g * _M2) >> width).astype(np.int64) for g, _ in grams]
    inner, inner_of = _byte_grams(raw, starts, stops, text_of)
    inner = ((inner * _M2) >> width).astype(np.int64)
    for a in range(0, n, STEP):
        b = min(a + STEP, n)
        seen = np.zeros((b - a) << BITS, dtype=bool)
        for h, (_, more) in zip(hashed, grams, strict=True):
            i, j = first[a], max(first[a], first[b] - more)
            t = text_of[i:j]
            one_text = t == text_of[i + more : j + more]
            seen[((t - a)[one_text] << BITS) + h[i:j][one_text]] = True
        i, j = np.searchsorted(inner_of, [a, b])
        seen[(inner_of[i:j] - a << BITS) + inner[i:j]] = True
        at = np.flatnonzero(seen)
        yield (at >> BITS) + a, at & ((1 << BITS) - 1)


def fit(texts: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight of every feature (class ratio included) and the bias; zeros if a class is missing."""
    n_features = 1 << BITS
    y = np.where(np.asarray(labels) == 1, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        return np.zeros(n_features), 0.0
    count = {s: np.bincount(np.concatenate([t for t, c in zip(texts, y, strict=True) if c == s]), minlength=n_features) + SMOOTHING for s in (1.0, -1.0)}
    ratio = np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())
    # All rows in one array, which is given back whole; thousands of small ones would stay with the driver.
    sizes = np.array([len(t) for t in texts])
    flat = ratio[np.concatenate(texts)]
    flat /= np.repeat(np.sqrt(np.maximum(1, sizes)), sizes)
    rows = np.split(flat, np.cumsum(sizes)[:-1])
    square = np.array([(r * r).sum() + 1.0 for r in rows])
    # Both classes weigh alike.
    most = COST * len(y) / (2.0 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    alpha, w, bias, rng = np.zeros(len(y)), np.zeros(n_features), 0.0, np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(y)):
            slack = y[i] * (w[texts[i]] @ rows[i] + bias) - 1.0
            new = min(max(alpha[i] - slack / square[i], 0.0), most[i])
            if step := (new - alpha[i]) * y[i]:
                alpha[i] = new
                w[texts[i]] += step * rows[i]
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w * ratio, bias


def held_out(doc_id):
    """Ids whose crc32, as text, leaves 1 when divided by 3; they are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING, most_features: int = MOST_FEATURES) -> tuple[np.ndarray, float]:
    """Fits on at most ``most`` labelled ids of each class that are not held out, and on at most ``most_features`` features in all (the bounded sample of this operator).

    The sample is taken in the order of the ids' hashes. Rows of ``labels`` without
    id or quality are left out; an id with both labels counts as both; of an id's
    several texts the one of least hash counts. No label or only one class: every
    score is 0.5.
    """
    bound_batches(docs.sparkSession)
    usable = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_quality")).filter(F.col("_id").isNotNull() & F.col("_quality").isin(0, 1) & ~held_out(F.col("_id")))
    sample = None
    for quality in (0, 1):
        part = usable.filter(F.col("_quality") == quality).distinct().orderBy(F.xxhash64("_id"), "_id").limit(most)
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select(F.col("doc_id").alias("_doc"), "text").join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select("_doc", "_quality", "text")
    schema = "_doc long, _quality int, _hash long, f array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, f in features(b.column(3)):
                rows = np.unique(at)
                edges = np.searchsorted(at, [*rows, at[-1] + 1 if len(at) else 0])
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(f, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(rows)) for i in range(3)), lists], names=["_doc", "_quality", "_hash", "f"])

    found = texts.select("_doc", "_quality", F.xxhash64("text").alias("_hash"), "text").mapInArrow(run, schema)
    one = found.groupBy("_doc", "_quality").agg(F.min_by("f", F.struct("_hash", F.size("f"))).alias("f"))
    # At most 2 * most rows are left, so one task can add up their sizes.
    upto = F.sum(F.size("f")).over(Window.orderBy(F.xxhash64("_doc"), "_doc", "_quality").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    got = one.withColumn("_upto", upto).filter(F.col("_upto") <= most_features).drop("_upto").toArrow().sort_by([("_doc", "ascending"), ("_quality", "ascending")])
    lists = got.column("f").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    values, ends = np.asarray(lists.values), np.asarray(lists.offsets)
    model = fit([values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], got.column("_quality").to_numpy())
    del values, lists, got
    pa.default_memory_pool().release_unused()
    return model


def score_texts(docs: DataFrame, model: tuple[np.ndarray, float], score_col: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of each whole text; null and empty texts get that of a text without features."""
    spark, docs = docs.sparkSession, docs.drop(score_col)
    bound_batches(spark)
    shared = spark.sparkContext.broadcast((model[0].astype(np.float32), float(model[1])))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for b in batches:
            total, n = np.zeros(len(b)), np.zeros(len(b))
            for at, f in features(b.column(names.index("text"))):
                total += np.bincount(at, weights=weights[f], minlength=len(b))
                n += np.bincount(at, minlength=len(b))
            margin = total / np.sqrt(np.maximum(n, 1)) + bias
            score = 1.0 / (1.0 + np.exp(-np.clip(2.0 * margin, -60, 60)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*names, score_col])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, `{score_col}` double")


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels, lang, source and ids are no inputs of a score."""
    scored = score_texts(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
