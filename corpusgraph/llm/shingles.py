"""Word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import LOWER, byte_steps, hash_words, mix, text_bytes, word_spans

#: Words in a shingle.
WORDS = 5
#: Bytes of text whose shingles are worked out at once.
STEP_BYTES = 1_000_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, A-Z lower-cased."""
    return hash_words(LOWER[raw], starts, stops)


def shingle_sets(column: pa.Array, words: int = WORDS):
    """For runs of texts: number of the first text, all their distinct shingles (sorted within a text), where each text begins.

    A text of fewer words is one shingle; a text without words has none.
    """
    raw_all, ends_all = text_bytes(column)
    for a, b in byte_steps(ends_all, STEP_BYTES):
        raw, ends = raw_all[ends_all[a] : ends_all[b]], ends_all[a : b + 1] - ends_all[a]
        starts, stops, first = word_spans(raw, ends)
        w = word_hashes(raw, starts, stops)
        s = w.copy()
        for j in range(1, words):
            if len(w) > j:
                s[: len(w) - j] = mix(s[: len(w) - j] * _M1 + w[j:])
        sets, lengths = [], [0]
        for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if j - i >= words:
                own = np.sort(s[i : j - words + 1])
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif j > i:
                own = np.array([j - i], dtype=np.uint64)
                for x in range(i, j):
                    own = mix(own * _M2 + w[x : x + 1])
            else:
                own = s[:0]
            sets.append(own)
            lengths.append(len(own))
        yield a, np.concatenate(sets) if sets else s[:0], np.cumsum(lengths)
