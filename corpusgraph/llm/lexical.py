"""Ranked lexical search: inverted index in shards, document-at-a-time merge.

Each task cuts its documents into shards and writes, for every term of a shard, the
postings in the order of doc_id, as gaps and counts of seven bits a byte. A search
reads the postings of the questions' terms only. For each question and shard, the
cursors over its terms' postings stand in a heap by their next document; the merge
takes them window by window, so that the scores of a window's documents are whole
before the next window begins, and the best go into a bounded heap by score, then
doc_id. A task keeps these heaps over all its shards; their rows meet in a last ranking.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import top_k
from .common import ASCII_LOWER, ASCII_UPPER, Scratch, ascii_lower, table
from .words import LOWER, text_bytes, word_spans

#: Bytes of texts in a shard, about; a longer text is a shard of its own.
SHARD_BYTES = 16 << 20
#: Documents whose scores one step of the merge completes.
WINDOW = 4096
#: Bytes of questions' terms that are searched for at once; more are dealt into parts that are searched one after another.
ASKED_BYTES = 32 << 20

#: Bytes between terms: ASCII other than digits and letters.
GAPS = np.ones(256, dtype=bool)
GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

INDEX = "shard long, term string, df long, total long, postings binary"


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, lowest first, the high bit set in all but a number's last; and where each ends."""
    rest = values.astype(np.uint64)
    size = np.ones(len(rest), np.int64)
    for bits in range(7, 64, 7):
        size += rest >= np.uint64(1 << bits)
    ends = np.cumsum(size)
    out, at = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8), ends - size
    for i in range(int(size.max(initial=0))):
        some = size > i
        out[at[some] + i] = (rest[some] & np.uint64(127)) | ((size[some] > i + 1).astype(np.uint64) << np.uint64(7))
        rest >>= np.uint64(7)
    return out, ends


def unpack_numbers(raw: np.ndarray) -> np.ndarray:
    stops = np.flatnonzero(raw < 128)
    if not len(stops):
        return np.zeros(0, np.uint64)
    starts = np.concatenate([[0], stops[:-1] + 1])
    shift = 7 * (np.arange(len(raw)) - np.repeat(starts, stops - starts + 1))
    return np.add.reduceat((raw & 127).astype(np.uint64) << shift.astype(np.uint64), starts)


def index_shard(shard: int, ids: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
    """The rows of one shard: its documents (null term; first id, then gaps of ids and numbers of terms), then each term's postings (gaps of places among the documents, occurrences)."""
    raw, ends = text_bytes(texts)
    starts, stops, first = word_spans(raw, ends, GAPS)
    sizes = np.diff(first)
    has = sizes > 0
    order = np.argsort(ids[has], kind="stable")
    own, lengths = ids[has][order], sizes[has][order]
    place = np.zeros(len(ids), np.int64)
    place[np.flatnonzero(has)[order]] = np.arange(len(own))
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    letters = np.ascontiguousarray(LOWER[raw][~GAPS[raw]])
    terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    keys = np.sort(terms.indices.to_numpy().astype(np.int64) * max(1, len(own)) + np.repeat(place, sizes))
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    tf = np.diff(np.append(new, len(keys)))
    code, doc = np.divmod(keys[new], max(1, len(own)))
    heads = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    gaps = np.diff(doc, prepend=0)
    gaps[heads] = doc[heads]
    packed, at = pack_numbers(np.stack([gaps, tf], axis=1).ravel())
    cuts = np.concatenate([[0], at[2 * np.append(heads[1:], len(code)) - 1]]).astype(np.int64) if len(heads) else np.zeros(1, np.int64)
    id_gaps = (own[1:].astype(np.uint64) - own[:-1].astype(np.uint64)) if len(own) else np.zeros(0, np.uint64)
    about, _ = pack_numbers(np.stack([np.concatenate([np.zeros(min(1, len(own)), np.uint64), id_gaps]), lengths.astype(np.uint64)], axis=1).ravel())
    described = (own[:1].astype("<i8").tobytes() + about.tobytes()) if len(own) else b""
    lists = pa.Array.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(cuts), pa.py_buffer(packed)]).cast(pa.binary())
    n = len(heads) + 1
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, shard, np.int64)),
            pa.concat_arrays([pa.nulls(1, pa.string()), terms.dictionary.take(pa.array(code[heads])).cast(pa.string())]),
            pa.array(np.concatenate([[len(own)], np.diff(np.append(heads, len(code)))]).astype(np.int64)),
            pa.array(np.concatenate([[len(keys)], np.add.reduceat(tf, heads) if len(heads) else []]).astype(np.int64)),
            pa.concat_arrays([pa.array([described], pa.binary()), lists]),
        ],
        names=["shard", "term", "df", "total", "postings"],
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """shard, term, df, total, postings; rows of a null term describe the documents of a shard. Save it before searching.

    Rows with a null id or text, or without terms, are no documents; rows that share
    an id are documents of their own.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).filter("id is not null and t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, shards = [], 0, 0

        def shard() -> Iterator[pa.RecordBatch]:
            made = index_shard(TaskContext.get().partitionId() << 24 | shards, np.concatenate([x.column(0).to_numpy() for x in held]), pa.concat_arrays([x.column(1).cast(pa.large_string()) for x in held]))
            for a in range(0, len(made), 20_000):
                yield made.slice(a, 20_000)

        for batch in batches:
            ends = np.cumsum([0, *np.diff(text_bytes(batch.column(1))[1]).tolist()])
            a = 0
            while a < len(batch):
                # As many rows as the shard has room for, one at least.
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + SHARD_BYTES - size, side="right")) - 1)
                held.append(batch.slice(a, b - a))
                size += int(ends[b] - ends[a])
                if size >= SHARD_BYTES or b < len(batch):
                    yield from shard()
                    held, size, shards = [], 0, shards + 1
                a = b
        if held:
            yield from shard()

    return rows.mapInArrow(run, INDEX)


def merge_documents(cursors: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
    """Brings a shard's documents into ``best``, a heap of at most k (score, ~doc_id). cursors: ascending places and score parts of each term."""
    heap = [(int(docs[0]), i, 0) for i, (docs, _) in enumerate(cursors) if len(docs)]
    heapq.heapify(heap)
    while heap:
        low = heap[0][0]
        scores = np.zeros(min(WINDOW, len(ids) - low), np.int64)
        while heap and heap[0][0] < low + WINDOW:
            _, i, a = heap[0]
            docs, parts = cursors[i]
            b = a + int(np.searchsorted(docs[a:], low + WINDOW))
            scores[docs[a:b] - low] += parts[a:b]
            if b < len(docs):
                heapq.heapreplace(heap, (int(docs[b]), i, b))
            else:
                heapq.heappop(heap)
        at = np.flatnonzero(scores >= max(1, best[0][0] if len(best) == k else 1))
        if len(at) > k:
            at = at[np.lexsort((at, -scores[at]))[:k]]
        for found in zip(scores[at].tolist(), (~ids[low + at]).tolist(), strict=True):
            if len(best) < k:
                heapq.heappush(best, found)
            elif found > best[0]:
                heapq.heapreplace(best, found)


def _search(asked, n_docs: int, n_terms: int, k: int):
    """asked: broadcast (weight of each term, terms of each question)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, questions = asked.value
        best: dict[int, list] = {q: [] for q in questions}

        def search(ids: np.ndarray, lengths: np.ndarray, lists: dict[str, pa.Buffer]) -> None:
            norm = 8 * (100 - 90 + (90 * lengths * n_docs) // n_terms)
            parts = {}
            for term, held in lists.items():
                numbers = unpack_numbers(np.frombuffer(held, np.uint8)).astype(np.int64).reshape(-1, 2)
                docs, tf = np.cumsum(numbers[:, 0]), numbers[:, 1]
                parts[term] = docs, weights[term] * ((1_000_000_000 * tf) // (1000 * tf + norm[docs]))
            for q, terms in questions.items():
                if met := [parts[t] for t in terms if t in parts]:
                    merge_documents(met, ids, best[q], k)

        shard, about, lists = None, None, {}

        def close() -> None:
            if lists:
                numbers = unpack_numbers(np.frombuffer(about[8:], np.uint8)).reshape(-1, 2)
                ids = (np.cumsum(numbers[:, 0]) + np.frombuffer(about[:8], "<i8").astype(np.uint64)).astype(np.int64)
                search(ids, numbers[:, 1].astype(np.int64), lists)

        for batch in batches:
            shards, terms, held = batch.column("shard").to_pylist(), batch.column("term").to_pylist(), batch.column("postings")
            for i, (s, term) in enumerate(zip(shards, terms, strict=True)):
                if s != shard:
                    close()
                    shard, about, lists = s, None, {}
                if term is None:
                    about = held[i].as_py()
                else:
                    lists[term] = held[i].as_py()
        close()
        rows = [(q, ~doc, score) for q, own in best.items() for score, doc in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["query_id", "doc_id", "score"])

    return run


def question_terms(questions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """query_id, term: each different term of a question once; rows that share an id are one question."""
    found = F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(TERM), F.lit(0)))
    return questions.select(F.col(id_col).cast("long").alias("query_id"), found.alias("term")).filter("query_id is not null").distinct()


def search_index(index: DataFrame, asked: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents with a score above 0 of each question, equal scores by doc_id.

    index: that of build_index, saved; asked: query_id, term. The questions' terms are
    sent to all tasks while they take ASKED_BYTES at most; more questions are dealt
    into parts, each of which reads the index.
    """
    spark = index.sparkSession
    whole = index.filter("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("l")).first()
    asked = scratch.save(asked, "asked")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    parts = max(1, -(-size // ASKED_BYTES))
    hits = None
    for part in range(parts):
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        counts = index.filter("term is not null").join(F.broadcast(own.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * whole.n + 2) / (2 * F.col("df") + 1)))
        weighed = own.join(counts.select("term", weight.alias("weight")).filter("weight > 0"), "term").collect()
        weights, questions = {r.term: r.weight for r in weighed}, {}
        for r in weighed:
            questions.setdefault(r.query_id, []).append(r.term)
        words = spark.createDataFrame([(t,) for t in weights], "term string").withColumn("asked", F.lit(True))
        needed = index.select("shard", "term", "postings").join(F.broadcast(words), "term", "left").filter("asked or term is null").drop("asked")
        by_shard = needed.repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
        found = by_shard.mapInArrow(_search(spark.sparkContext.broadcast((weights, questions)), whole.n, whole.l, k), "query_id long, doc_id long, score long")
        hits = found if hits is None else hits.unionByName(found)
    return top_k(hits, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 10 best documents for each benchmark item.

    Items without terms, or whose terms are in no document, have no rows.
    """
    scratch = Scratch(spark, "lexical")
    index = scratch.save(build_index(table(spark, sf_dir, "documents")), "index")
    asked = question_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return search_index(index, asked, 10, scratch).select(F.col("query_id").alias("item_id"), "rank", "doc_id", "score")


OP11_SQL = rf"""
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}'), '{TERM}')) AS term FROM documents WHERE doc_id IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
docs AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY ALL),
whole AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM docs),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}'), '{TERM}')) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, sum(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // l))))::BIGINT AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN docs USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""
