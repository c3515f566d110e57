"""Removal of repeated 100-byte strings by difference-cover blockwise suffix sorting.

Suffixes are compared on their first WINDOW bytes. Three steps, each over blocks of
texts laid end to end:

1. A difference cover samples suffixes so that any two positions have a common short
   shift at which both are sampled. The sample is ranked first: a sampled suffix
   whose first COVER_DEPTH bytes occur nowhere else settles all windows that could
   only be equal through it, and they leave the sort. (Ranks compare hashes: equal
   bytes never get different ones, so nothing is missed; a chance equality only
   leaves a window in the sort.)
2. What is left is dealt into suffix buckets: two equal windows have the same least
   (hashed) ANCHOR-byte string at the same shift, so that string names the bucket.
   Neighbouring windows mostly share it and travel as one run of text. Each bucket is
   sorted by the bytes of its anchored suffixes, which gives these their ranks. Windows
   of one shift then tie where the bytes before the anchor are the same; such ties are
   resolved by the ranks of the anchored suffixes and the lengths of their common
   prefixes. All of this compares bytes, never hashes.
3. In each set of equal windows all but the first (document, then start) are repeats,
   and the bytes that repeats cover are cut out.

Memory is bounded by a block and by one bucket's different runs; a bucket that
outgrows CROWDED runs is dealt anew, window by window.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_store, partitions
from .words import text_bytes

#: Bytes of a string whose repeats go.
WINDOW = 100
# A perfect difference set; every difference modulo 57 occurs once.
COVER_PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
#: A sampled suffix within the period of a window's start still lies in the window with so many bytes.
COVER_DEPTH = WINDOW - COVER_PERIOD + 1
#: Bytes of the strings that name suffix buckets, and the shifts at which a window can hold one.
ANCHOR = 24
SHIFTS = WINDOW - ANCHOR + 1
#: Bytes of text that one row of the block table holds (more only for a single longer text).
BLOCK_BYTES = 4 << 20
#: Bytes of text for each bucket of the cover sample, and for each partition of suffix buckets, about.
SAMPLE_BYTES = 48 << 20
BUCKET_BYTES = 12 << 20
#: Open windows whose runs are found at once; each takes about 80 bytes then.
STEP_WINDOWS = 1 << 18
#: What keeps the row groups and pages of the block table small: Parquet's writer else looks at its size after 100 rows of BLOCK_BYTES.
SMALL_GROUPS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
#: Runs that are worked on at once, and different runs of one bucket beyond which it is dealt anew.
STEP_RUNS = 60_000
CROWDED = 300_000
#: Rows of a bucket that are compared with their neighbours at once.
COMPARED = 20_000
#: Columns that are made here.
MADE = ("n_bytes", "n_removed", "n_spans", "kept")

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _hash(words: np.ndarray, at: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
    """64-bit hashes of the 8-byte words at ``steps`` after each position."""
    h = np.zeros(len(at), dtype=np.uint64)
    for step in steps:
        h = (h ^ words[at + step]) * _M1
        h ^= h >> np.uint64(32)
        h *= _M2
        h ^= h >> np.uint64(29)
    return h * _M3


_SAMPLE_STEPS = (*range(0, COVER_DEPTH - 7, 8), COVER_DEPTH - 8)
_ANCHOR_STEPS = tuple(range(0, ANCHOR, 8))


def _rows(batch: pa.RecordBatch) -> Iterator[list]:
    """Row by row, so that one block's bytes are copied at a time."""
    for i in range(len(batch)):
        yield [column[i].as_py() for column in batch.columns]


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of ranges, one range after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class _Block:
    """One row of the block table; texts lie end to end in the order of their ids."""

    def __init__(self, raw: bytes, ends: bytes) -> None:
        padded = np.frombuffer(raw + bytes(16), dtype=np.uint8)
        self.raw, self.ends = padded[:-16], np.frombuffer(ends, dtype=np.int64)
        self.begins = np.concatenate([np.zeros(1, np.int64), self.ends[:-1]])
        self.words = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))

    def inside(self, at: np.ndarray, n: int) -> np.ndarray:
        """Positions whose n bytes lie within one text."""
        at = at[at + n <= len(self.raw)]
        return at[at + n <= self.ends[np.searchsorted(self.ends, at, side="right")]]

    def sample(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The cover's positions and their keys (the bucket's bits and 32 more)."""
        periods = np.arange(0, len(self.raw), COVER_PERIOD)
        at = self.inside((periods[:, None] + np.array(COVER)).ravel(), COVER_DEPTH)
        return at, _hash(self.words, at, _SAMPLE_STEPS) >> np.uint64(32 - bits)

    def unsettled(self, equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and sizes of the stretches of windows that hold, within a period of their start, one of these sampled suffixes (ascending)."""
        low, high = np.maximum(equal - COVER_PERIOD + 1, 0), equal + 1
        new = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]])) if len(equal) else np.zeros(0, np.int64)
        low, high = low[new], high[np.append(new[1:], len(equal)) - 1] if len(equal) else high
        # A window lies in one text.
        long = self.ends - self.begins >= WINDOW
        least, most = self.begins[long], self.ends[long] - WINDOW + 1
        first = np.searchsorted(most, low, side="right")
        n = np.maximum(np.searchsorted(least, high, side="left") - first, 0)
        of, text = np.repeat(np.arange(len(low)), n), _runs(first, n)
        low, high = np.maximum(low[of], least[text]), np.minimum(high[of], most[text])
        return low[high > low], (high - low)[high > low]

    def covered(self, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether a byte lies in one of these ranges."""
        change = np.zeros(len(self.raw) + 1, dtype=np.int32)
        np.add.at(change, begin, 1)
        np.add.at(change, begin + sizes, -1)
        return np.cumsum(change[:-1], dtype=np.int32) > 0

    def runs(self, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, windows, anchor and the anchor's hash of each run: neighbouring windows of a stretch with the same anchor.

        The anchor is the window's string of ANCHOR bytes of least hash, the first of several.
        """
        if not len(begin):
            return begin, begin, begin, np.zeros(0, np.uint64)
        at, head = _runs(begin, sizes), np.cumsum(sizes) - sizes
        place = _runs(begin, sizes + SHIFTS - 1)
        h = _hash(self.words, place, _ANCHOR_STEPS)
        low = np.uint64(max(1, int(len(place) - 1).bit_length()))
        least, span = (h >> low << low) | np.arange(len(place), dtype=np.uint64), 1
        while span * 2 <= SHIFTS:
            least[: len(least) - span] = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        if rest := SHIFTS - span:
            least[: len(least) - rest] = np.minimum(least[: len(least) - rest], least[rest:])
        # Window i of a stretch of neighbours stands at place i of the stretch.
        own = np.repeat((SHIFTS - 1) * np.arange(len(head)), sizes) + np.arange(len(at))
        anchor = (least[own] & np.uint64((1 << int(low)) - 1)).astype(np.int64)
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new[head] = True
        first = np.flatnonzero(new)
        return at[first], np.diff(np.concatenate([first, [len(at)]])), place[anchor[first]], h[anchor[first]]


def _steps(begin: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ranges, long ones cut, in steps of ``most`` positions or fewer."""
    n = -(-sizes // most)
    of, turn = np.repeat(np.arange(len(sizes)), n), _runs(np.zeros(len(n), np.int64), n)
    begin, sizes = begin[of] + turn * most, np.minimum(sizes[of] - turn * most, most)
    upto, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, side="right"))
        yield begin[start:stop], sizes[start:stop]
        start = stop


def block_table(docs: DataFrame) -> DataFrame:
    """block, raw (texts end to end), ends, ids, rest (all other columns as an Arrow stream), n_bytes.

    A block's number is its partition's number, then its own within it.
    """
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row(parts: list[pa.Table], number: int) -> pa.RecordBatch:
            t = pa.concat_tables(parts)
            ids = t.column("doc_id").cast(pa.int64())
            order = np.lexsort((np.arange(len(t)), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy()))
            t = t.take(pa.array(order))
            raw, ends = text_bytes(t.column("text"))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.select(names).schema) as out:
                out.write_table(t.select(names))
            ids = t.column("doc_id").cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()
            cells = [[number], [raw.tobytes()], [ends[1:].astype(np.int64).tobytes()], [ids.astype(np.int64).tobytes()], [sink.getvalue().to_pybytes()], [len(raw)]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["block", "raw", "ends", "ids", "rest", "n_bytes"])

        for batch in batches:
            lengths = np.diff(text_bytes(batch.column(batch.schema.get_field_index("text")))[1])
            start = 0
            for i, n in enumerate(lengths.tolist()):
                if size and size + n > BLOCK_BYTES:
                    held.append(pa.Table.from_batches([batch.slice(start, i - start)]))
                    yield row(held, number)
                    number, held, size, start = number + 1, [], 0, i
                size += n
            held.append(pa.Table.from_batches([batch.slice(start)]))
        if held and sum(map(len, held)):
            yield row(held, number)

    return docs.mapInArrow(run, "block long, raw binary, ends binary, ids binary, rest binary, n_bytes long")


def _blobs(block: int, buckets: np.ndarray, n_buckets: int, keys: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket with keys: these in their order."""
    keys = keys[np.argsort(buckets, kind="stable")]
    edges = np.concatenate([[0], np.cumsum(np.bincount(buckets, minlength=n_buckets))])
    some = np.flatnonzero(np.diff(edges)).tolist()
    cells = [keys[edges[b] : edges[b + 1]].tobytes() for b in some]
    return pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(cells, pa.binary())], names=["block", "bucket", "keys"])


def rank_sample(table: pa.Table) -> pa.Table:
    """Of one bucket of the cover sample: a bit for each of a block's keys, whether it occurs more than once."""
    parts = [np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in table.column("keys")]
    ordered = np.concatenate(parts)
    ordered.sort()
    equal = ordered[1:][ordered[1:] == ordered[:-1]]
    del ordered
    equal = equal[np.concatenate([[True], equal[1:] != equal[:-1]])] if len(equal) else equal

    def flags(keys: np.ndarray) -> np.ndarray:
        return equal[np.minimum(np.searchsorted(equal, keys), len(equal) - 1)] == keys if len(equal) else np.zeros(len(keys), bool)

    # Part by part: places of all keys at once would take more room than these.
    bits, sizes = [np.packbits(flags(p)).tobytes() for p in parts], [len(p) for p in parts]
    return pa.table([table.column("block"), table.column("bucket"), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], names=["block", "bucket", "n", "bits"])


def _file_by_part(replies: DataFrame, root: str) -> None:
    """One folder for each partition of the block table, whose tasks read it back."""
    replies.withColumn("of", F.shiftright("block", 32)).repartition("of").write.mode("overwrite").partitionBy("of").parquet(root)


class _Replies:
    """Replies to the blocks of one part after another.

    ``every``: each part has replies, so a part without a folder is an error, not
    "none". A root that cannot be seen always is one.
    """

    def __init__(self, root: str, every: bool = False) -> None:
        self.root, self.every, self.part, self.rows = root, every, None, None

    def of(self, block: int) -> pa.Table | None:
        if self.part != block >> 32:
            store, where = arrow_store(self.root)
            self.part = block >> 32
            if store.get_file_info(f"{where}/of={self.part}" if self.every else where).type == fs.FileType.NotFound:
                raise FileNotFoundError(f"replies to part {self.part} in {self.root}")
            found = store.get_file_info(fs.FileSelector(f"{where}/of={self.part}", allow_not_found=True))
            files = sorted(f.path for f in found if f.path.endswith(".parquet"))
            self.rows = pa.concat_tables([pq.ParquetFile(store.open_input_file(f)).read() for f in files]) if files else None
        return None if self.rows is None else self.rows.filter(pc.equal(self.rows.column("block"), block))


def _matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, width) bytes, padded with zeros behind, and the lengths."""
    raw, ends = text_bytes(column)
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), width), dtype=np.uint8)
    out[np.arange(width) < sizes[:, None]] = raw
    return out, sizes


def _common(rows: np.ndarray, sizes: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Bytes that each row shares with the row before it (in ``order``), from the start; 0 for the first."""
    out, order = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows)) if order is None else order
    for a in range(1, len(rows), COMPARED):
        now, before = order[a : a + COMPARED], order[a - 1 : a - 1 + COMPARED][: len(order) - a]
        differ = rows[now] != rows[before]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[a : a + COMPARED] = np.minimum(same, np.minimum(sizes[now], sizes[before]))
    return out


class _Bucket:
    """Runs in the order of their anchor's hash, right and left side, without those that are the same text."""

    def __init__(self, t: pa.Table) -> None:
        key = t.column("mkey").to_numpy()
        right, n_right = _matrix(t.column("rhs"), WINDOW)
        left, n_left = _matrix(t.column("lhs"), SHIFTS)
        shared = _common(right, n_right)
        same_key = np.concatenate([[False], key[1:] == key[:-1]])
        again = np.zeros(len(key), dtype=bool)
        again[1:] = same_key[1:] & (n_right[1:] == n_right[:-1]) & (shared[1:] == n_right[1:]) & (n_left[1:] == n_left[:-1]) & (_common(left, n_left)[1:] == n_left[1:])
        keep = np.flatnonzero(~again)
        self.t, self.key, self.right, self.left, self.n_right, self.n_left = t.take(pa.array(keep)), key[keep], right[keep], left[keep], n_right[keep], n_left[keep]

    def firsts(self) -> np.ndarray:
        """(runs, SHIFTS) whether the window at this place of the run is the first of its equals."""
        n = len(self.key)
        out = np.zeros((n, SHIFTS), dtype=bool)
        if not n:
            return out
        new_key = np.concatenate([[True], self.key[1:] != self.key[:-1]])
        # Ranks of the anchored suffixes are their places; what neighbours share tells which are equal up to a depth.
        shared = np.where(new_key, 0, _common(self.right, self.n_right))
        group = np.cumsum(new_key)
        words = np.ascontiguousarray(np.pad(self.left, ((0, 0), (0, -SHIFTS % 8)))).view(">u8").astype(np.uint64)
        order = np.lexsort((self.n_left, *words.T[::-1], group))
        before = np.where(np.concatenate([[True], group[order][1:] != group[order][:-1]]), 0, _common(self.left, self.n_left, order))
        head = np.concatenate([[True], group[order][1:] != group[order][:-1]])
        block, at, ids = (self.t.column(c).to_numpy() for c in ("block", "a", "id"))
        turn = np.lexsort((at + self.n_left, block, ids))
        left_name = np.empty(n, dtype=np.int64)
        n_left, n_right = self.n_left[turn], self.n_right[turn]
        for shift in range(SHIFTS):
            rows = turn[(shift <= n_left) & (WINDOW - shift <= n_right)]
            if not len(rows):
                continue
            right_name = np.cumsum(new_key | (shared < WINDOW - shift))
            left_name[order] = np.cumsum(head | (before < shift))
            _, first = np.unique(right_name[rows] * (n + 1) + left_name[rows], return_index=True)
            out[rows[first], self.n_left[rows[first]] - shift] = True
        return out


_FOUND = "block long, a int, mask binary, id long, w binary"


def _found(block, a, mask=None, ids=None, w=None) -> pa.RecordBatch:
    n = len(block)
    empty = lambda v, kind: pa.nulls(n, kind) if v is None else v
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(a, pa.int32()), empty(mask, pa.binary()), empty(ids, pa.int64()), empty(w, pa.binary())], names=["block", "a", "mask", "id", "w"])


def _fixed(rows: np.ndarray) -> pa.Array:
    """A binary column of rows of equal width."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _sorted_bucket(bucket: _Bucket) -> Iterator[pa.RecordBatch]:
    """For each run with windows that are the first of their equals: which."""
    firsts = bucket.firsts()
    some = np.flatnonzero(firsts.any(axis=1))
    yield _found(bucket.t.column("block").to_numpy()[some], bucket.t.column("a").to_numpy()[some], _fixed(np.packbits(firsts[some], axis=1)))


def _windows(bucket: _Bucket) -> Iterator[pa.RecordBatch]:
    """Every window of the runs as a row of its own."""
    for i in range(0, len(bucket.key), 2000):
        part = slice(i, i + 2000)
        n_left, n = bucket.n_left[part], bucket.n_left[part] + bucket.n_right[part] - WINDOW + 1
        text = np.concatenate([bucket.left[part][:, ::-1], bucket.right[part]], axis=1)
        run, j = np.repeat(np.arange(len(n)), n), _runs(np.zeros(len(n), np.int64), n)
        start = SHIFTS - n_left[run] + j
        w = text[run[:, None], start[:, None] + np.arange(WINDOW)]
        block, a, ids = (bucket.t.column(c).to_numpy()[part][run] for c in ("block", "a", "id"))
        yield _found(block, a + j, None, pa.array(ids), _fixed(w))


def _release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished plans now rather than at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_repeats(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``docs`` without text, and with n_bytes, n_removed, n_spans and kept (the bytes left) of every row.

    Texts are UTF-8 bytes; a byte goes if a WINDOW-byte string over it also starts
    earlier: in a document of smaller id (null ids come last; rows of equal id in
    order of their blocks), or earlier in its own. Null, empty and short texts lose
    nothing. Repeated rows count as later documents. Other columns stay, but those
    named as one that is made here are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*MADE)
    names = [c for c in docs.columns if c != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    scratch = Scratch(spark, "suffixes")
    blocks = scratch.save(block_table(docs), "blocks", SMALL_GROUPS)
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    bits = max(3, int(np.ceil(np.log2(max(1, total / SAMPLE_BYTES)))))
    n_buckets, small = 1 << bits, np.int16 if bits < 15 else np.int32
    n_parts = max(partitions(spark), -(-total // BUCKET_BYTES))
    sample_root, first_root = (f"{scratch.root}/{x}" for x in ("sample", "first"))
    low = np.uint64((1 << 32) - 1)

    def ask_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw, ends in _rows(batch):
                _, keys = _Block(raw, ends).sample(bits)
                yield _blobs(number, (keys >> np.uint64(32)).astype(small), n_buckets, (keys & low).astype(np.uint32))

    def open_windows(block: _Block, number: int, replies: _Replies) -> tuple[np.ndarray, np.ndarray]:
        """Stretches of the windows that the cover sample leaves open; replies come bucket by bucket."""
        at, keys = block.sample(bits)
        rows = replies.of(number) if len(at) else None
        if rows is None:
            return block.unsettled(at[:0])
        rows = rows.sort_by("bucket")
        got = [np.unpackbits(np.frombuffer(b.as_buffer(), dtype=np.uint8), count=n.as_py()) for b, n in zip(rows.column("bits"), rows.column("n"), strict=True)]
        if sum(map(len, got)) != len(at):
            raise ValueError("the replies do not fit their block")
        equal = np.empty(len(at), dtype=bool)
        equal[np.argsort((keys >> np.uint64(32)).astype(small), kind="stable")] = np.concatenate(got)
        return block.unsettled(at[equal])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of open windows; of runs of the same text only the block's first, as the others are repeats as a whole."""
        replies = _Replies(sample_root, every=True)
        for batch in batches:
            for number, raw, ends, ids in _rows(batch):
                block, owners, seen = _Block(raw, ends), np.frombuffer(ids, dtype=np.int64), set()
                for begin, sizes in _steps(*open_windows(block, number, replies), STEP_WINDOWS):
                    yield from deal_runs(block, number, raw, owners, seen, *block.runs(begin, sizes))

    def deal_runs(block: _Block, number: int, raw: bytes, owners: np.ndarray, seen: set, start: np.ndarray, n: np.ndarray, anchor: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        stop, own = start + n + WINDOW - 1, []
        for i, (a, b) in enumerate(zip(start.tolist(), stop.tolist(), strict=True)):
            text = raw[a:b]
            if text not in seen:
                seen.add(text)
                own.append(i)
        for i in range(0, len(own), 20_000):
            some = own[i : i + 20_000]
            a, b, c = start[some], stop[some], anchor[some]
            offsets = lambda sizes: pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            right = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, offsets(b - c), pa.py_buffer(block.raw[_runs(c, b - c)])])
            back = np.repeat(c - 1, c - a) - _runs(np.zeros(len(some), np.int64), c - a)
            left = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, offsets(c - a), pa.py_buffer(block.raw[back])])
            of = owners[np.searchsorted(block.ends, a, side="right")]
            yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), right, left, pa.array(of), pa.array(np.full(len(some), number)), pa.array(a.astype(np.int32))], names=["mkey", "rhs", "lhs", "id", "block", "a"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted runs come bucket by bucket; whole buckets are worked on, some at a time."""
        held, n, outgrown = [], 0, None
        for batch in batches:
            if outgrown is not None:
                own = np.asarray(batch.column(0)) == outgrown
                yield from _windows(_Bucket(pa.Table.from_batches([batch.filter(pa.array(own))])))
                batch = batch.filter(pa.array(~own))
                if not len(batch):
                    continue
                outgrown = None
            held.append(batch)
            n += len(batch)
            if n < STEP_RUNS:
                continue
            bucket = _Bucket(pa.Table.from_batches(held))
            last = int(np.searchsorted(bucket.key, bucket.key[-1]))
            if last:
                yield from _sorted_bucket(_Bucket(bucket.t.slice(0, last)))
            rest = bucket.t.slice(last)
            if len(rest) > crowded:
                yield from _windows(_Bucket(rest))
                outgrown, rest = int(bucket.key[-1]), rest.slice(0, 0)
            # What is held of a bucket that goes on counts again only as it grows.
            held, n = rest.to_batches(), min(len(rest), STEP_RUNS // 2)
        if held:
            yield from _sorted_bucket(_Bucket(pa.Table.from_batches(held)))

    def first_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted single windows: the first of each."""
        before = None
        mask = np.packbits(np.arange(SHIFTS) == 0)
        for batch in batches:
            w = batch.column(0).to_pylist()
            new = np.array([x != y for x, y in zip(w, [before, *w[:-1]], strict=True)], dtype=bool)
            before = w[-1] if w else before
            some = batch.filter(pa.array(new))
            yield _found(some.column(2).to_numpy(), some.column(3).to_numpy(), _fixed(np.tile(mask, (len(some), 1))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, firsts = _Replies(sample_root, every=True), _Replies(first_root)
        for batch in batches:
            for number, raw, ends, rest in _rows(batch):
                block = _Block(raw, ends)
                gone = block.covered(*open_windows(block, number, samples))
                rows = firsts.of(number)
                if rows is not None and len(rows):
                    mask = np.frombuffer(b"".join(rows.column("mask").to_pylist()), dtype=np.uint8).reshape(len(rows), -1)
                    run, j = np.nonzero(np.unpackbits(mask, axis=1))
                    gone[rows.column("a").to_numpy()[run] + j] = False
                edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
                on, off = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
                removed = block.covered(on, off + WINDOW - 1 - on)
                begins = block.begins[block.begins < len(removed)]
                edge = removed.copy()
                edge[1:] &= ~removed[:-1]
                edge[begins] = removed[begins]
                bounds = np.concatenate([[0], block.ends])
                upto = lambda m: np.concatenate([[0], np.cumsum(m, dtype=np.int32)])[bounds].astype(np.int64)
                sizes, n_removed, n_spans, left = np.diff(bounds), np.diff(upto(removed)), np.diff(upto(edge)), block.raw[~removed].tobytes()
                stops = np.cumsum(sizes - n_removed)
                kept = [left[b - n : b] for b, n in zip(stops.tolist(), (sizes - n_removed).tolist(), strict=True)]
                t = pa.ipc.open_stream(rest).read_all()
                for name, column in zip(MADE, (pa.array(sizes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())), strict=True):
                    t = t.append_column(name, column)
                yield from t.combine_chunks().to_batches()

    asked = blocks.select("block", "raw", "ends").mapInArrow(ask_sample, "block long, bucket int, keys binary")
    _file_by_part(asked.groupBy("bucket").applyInArrow(rank_sample, "block long, bucket int, n long, bits binary"), sample_root)
    _release(spark)
    runs = blocks.select("block", "raw", "ends", "ids").mapInArrow(deal, "mkey long, rhs binary, lhs binary, id long, block long, a int")
    ordered = runs.repartition(n_parts, "mkey").sortWithinPartitions("mkey", "rhs", "lhs", "id", "block", "a")
    found = scratch.save(ordered.mapInArrow(resolve, _FOUND), "found")
    _release(spark)
    firsts = found.filter("w is null").select("block", "a", "mask")
    single = found.filter("w is not null").select("w", "id", "block", "a")
    if not single.isEmpty():
        alone = single.repartition(n_parts, "w").sortWithinPartitions("w", "id", "block", "a").mapInArrow(first_windows, _FOUND)
        firsts = firsts.unionByName(alone.select("block", "a", "mask"))
    _file_by_part(firsts, first_root)
    scratch.drop("found")
    _release(spark)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", n_bytes long, n_removed long, n_spans long, kept binary"
    return blocks.select("block", "raw", "ends", "rest").mapInArrow(cut, schema)


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
