"""Words of a text as byte ranges: runs of bytes other than U+0020 and U+0009 to U+000D."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Words of more bytes are hashed one by one.
LONG_WORD = 64

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (null: none), and where each begins (one more than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, ends - ends[0] if len(column) else np.zeros(1, np.int64)


def byte_steps(ends: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes; a longer text is a range of its own."""
    step = ends[1:] // size
    edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(ends) - 1] if len(ends) > 1 else [0]
    return list(zip(edges[:-1], edges[1:], strict=True))


def word_spans(raw: np.ndarray, ends: np.ndarray, gaps: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of each text (one more than texts); a text's end ends its word. ``gaps`` tells the bytes that are in no word."""
    space = gaps[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[ends] = True
    solid = ~space
    before = np.concatenate([[True], space]) | edge
    starts = np.flatnonzero(solid & before[:-1])
    after = np.concatenate([space, [True]])[1:] | edge[1:]
    stops = np.flatnonzero(solid & after) + 1
    return starts, stops, np.searchsorted(starts, ends)


def count_words(column: pa.Array) -> np.ndarray:
    raw, ends = text_bytes(column)
    parts = [np.diff(word_spans(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a])[2]) for a, b in byte_steps(ends, 4_000_000)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def hash_words(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of all bytes of each word: eight at a time, in turn with the mixing of what came before."""
    size = stops - starts
    h = mix(size.astype(np.uint64) * _M1)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))
    some = np.arange(len(starts))
    for step in range(0, LONG_WORD, 8):
        some = some[size[some] > step]
        if not len(some):
            return h
        cut = (8 - np.minimum(size[some] - step, 8)).astype(np.uint64) * np.uint64(8)
        h[some] = mix((h[some] ^ (eight[starts[some] + step] << cut >> cut)) * _M2)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(blake2b(raw[starts[i] : stops[i]].tobytes(), digest_size=8).digest(), "little")
    return h
