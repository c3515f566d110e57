"""Byte-level BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that no vocabulary token contains can never be
merged over, so it marks a certain cut. Words are cut there, the fragments are
encoded one by one (and remembered), and the results are concatenated; a long run
without spaces so costs as much as its short fragments.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches

#: Bytes that one worker's remembered words and fragments may take; beyond it they are forgotten.
REMEMBERED_BYTES = 96 << 20
#: Bytes of a remembered entry besides its key's and value's own.
_ENTRY_BYTES = 190
#: Characters of text that one step of a worker encodes before it hands rows on.
STEP_CHARS = 1_000_000

_ID_BITS = 20
_ID_MASK = (1 << _ID_BITS) - 1
_NEVER = 1 << 62

# The white space and the splitting pattern of this family of vocabularies.
_SPACE = r"\t-\r \x85\xa0  -     　"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable, else one of those from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, spare = [], 0
    for b in range(256):
        letters.append(chr(b if b in own else 256 + spare))
        spare += b not in own
    return letters


def token_bytes(spec: dict) -> dict[int, bytes]:
    """The bytes of every token of a parsed vocabulary, added tokens included."""
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    out = {i: bytes(map(byte_of.__getitem__, t)) for t, i in spec["model"]["vocab"].items() if all(c in byte_of for c in t)}
    return out | {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}


def join_tokens(bytes_of: dict[int, bytes], ids) -> str:
    """The tokens' bytes as UTF-8; what is not valid becomes U+FFFD, unknown ids nothing."""
    get = bytes_of.get
    return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


class _Known(dict):
    """What make(key) gives, kept for short keys; held counts the bytes that takes."""

    def __init__(self, make) -> None:
        self.make, self.held = make, 0

    def __missing__(self, key):
        made = self.make(key)
        if len(key) <= 64:
            self.keep(key, made)
        return made

    def keep(self, key, made) -> None:
        self[key] = made
        self.held += len(key) + len(made) + _ENTRY_BYTES

    def clear(self) -> None:
        super().clear()
        self.held = 0


class _PairTable:
    """A hash table of merges for many pairs at once: open addressing, the next slot for whoever finds one taken."""

    def __init__(self, merged: dict[tuple[int, int], int]) -> None:
        keys = np.array([a << _ID_BITS | b for a, b in merged], dtype=np.int64)
        values = np.array(list(merged.values()), dtype=np.int64)
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, _NEVER, dtype=np.int64)
        slot, self.steps = self._slot(keys), 0
        while len(keys):
            self.steps += 1
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The merge of each pair, _NEVER where there is none."""
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], _NEVER)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        for _ in range(1, self.steps):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            found = held == keys[open_]
            out[open_[found]] = self.values[slot[open_[found]]]
            open_ = open_[~found & (held >= 0)]
        return out


class ForcedBoundaryBpe:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library.

    Supported: model BPE without dropout, byte fallback or unknown token; no
    normalizer; pre-tokenizer ByteLevel with its pattern, no prefix space; added
    tokens without stripping or word limits. Anything else raises ValueError.
    """

    def __init__(self, spec: str) -> None:
        spec = json.loads(spec)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only byte-level BPE with its own splitting pattern is supported")
        vocab, self.bytes_of = model["vocab"], token_bytes(spec)
        self.single = [vocab[c] for c in byte_letters()]
        self.merged = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            # Rank and result in one number, so that the least of several is the next merge.
            self.merged[vocab[a], vocab[b]] = rank << _ID_BITS | vocab[a + b]
        self.inside = np.zeros((256, 256), dtype=bool)
        for i in set(vocab.values()) & self.bytes_of.keys():
            t = np.frombuffer(self.bytes_of[i], dtype=np.uint8)
            self.inside[t[:-1], t[1:]] = True
        self.inside_pairs = {bytes(pair) for pair in np.argwhere(self.inside).tolist()}
        self.added = {}
        for token in spec.get("added_tokens", []):
            if token["lstrip"] or token["rstrip"] or token["single_word"]:
                raise ValueError("added tokens that strip or need whole words are not supported")
            self.added[token["content"]] = token["id"]
        ordered = sorted(self.added, key=len, reverse=True)
        self.between = regex.compile("(" + "|".join(map(regex.escape, ordered)) + ")") if ordered else None
        self.words = regex.compile(_PATTERN)
        self.table = _PairTable(self.merged)
        self.single_ids = np.array(self.single, dtype=np.int64)
        # Rounds over many fragments merge all of a fragment's lowest pairs at once, which is the same as one by one where no pair ranks before those that made its halves.
        made = {m & _ID_MASK: m >> _ID_BITS for m in self.merged.values()}
        self.in_order = len(made) == len(self.merged) and all(max(made.get(a, -1), made.get(b, -1)) < m >> _ID_BITS for (a, b), m in self.merged.items())
        self.known_words = _Known(self.word_ids)
        self.known = _Known(self.merge)

    def fragments(self, word: bytes) -> list[bytes]:
        """The word cut wherever its two neighbouring bytes occur in no token."""
        if len(word) <= 64:
            pairs = self.inside_pairs
            cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in pairs]
        else:
            b = np.frombuffer(word, dtype=np.uint8)
            cuts = (np.flatnonzero(~self.inside[b[:-1], b[1:]]) + 1).tolist()
        return [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)], strict=True)] if cuts else [word]

    def merge(self, fragment: bytes) -> tuple[int, ...]:
        """Merges the lowest-ranked, leftmost pair until none is left."""
        ids = [self.single[b] for b in fragment]
        return tuple(ids) if len(ids) < 2 else self._merge_short(ids) if len(ids) <= 32 else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> tuple[int, ...]:
        get = self.merged.get
        ranks = [get(pair, _NEVER) for pair in zip(ids[:-1], ids[1:], strict=True)]
        while ranks and (best := min(ranks)) != _NEVER:
            i = ranks.index(best)
            ids[i : i + 2] = [best & _ID_MASK]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), _NEVER)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), _NEVER)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a queue: n log n in the fragment's length."""
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merged.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            best, i, a, b = heapq.heappop(queue)
            new = best & _ID_MASK
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (m := self.merged.get((new, ids[after[i]]))) is not None:
                    heapq.heappush(queue, (m, i, new, ids[after[i]]))
            if before[i] >= 0 and (m := self.merged.get((ids[before[i]], new))) is not None:
                heapq.heappush(queue, (m, before[i], ids[before[i]], new))
        return tuple(x for x, kept in zip(ids, alive, strict=True) if kept)

    def word_ids(self, word: str) -> bytes:
        """The word's ids as 32-bit numbers, one after another."""
        parts = self.fragments(word.encode())
        if len(parts) == 1:
            return array("i", self.merge(parts[0])).tobytes()
        out: list[int] = []
        for part in parts:
            out += self.known[part]
        return array("i", out).tobytes()

    def many_words(self, words: list[str]) -> list[bytes]:
        """word_ids of many words at once: their fragments lie end to end and are merged in rounds."""
        raw = [w.encode() for w in words]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        begins = np.cumsum([0, *map(len, raw)])[:-1]
        first = np.zeros(len(data), dtype=bool)
        first[1:] = ~self.inside[data[:-1], data[1:]]
        first[begins] = True
        fragment = np.cumsum(first) - 1
        of_word = fragment[begins]
        n_fragments = int(fragment[-1]) + 1
        ids, done = self.single_ids[data], []
        while len(ids):
            m = np.full(len(ids), _NEVER, dtype=np.int64)
            same = np.flatnonzero(fragment[1:] == fragment[:-1])
            m[same] = self.table.find(ids[same] << _ID_BITS | ids[same + 1])
            starts = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
            least = np.repeat(np.minimum.reduceat(m, starts), np.diff(np.append(starts, len(ids))))
            whole = least == _NEVER
            done.append((fragment[whole], ids[whole]))
            hit = (m == least) & ~whole
            # A letter twice over and more: every other pair from the left.
            at = np.arange(len(ids))
            head = hit & ~np.concatenate([[False], hit[:-1]])
            hit &= (at - np.maximum.accumulate(np.where(head, at, 0))) % 2 == 0
            ids[hit] = m[hit] & _ID_MASK
            stay = ~whole
            stay[np.flatnonzero(hit) + 1] = False
            ids, fragment = ids[stay], fragment[stay]
        fragment, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(fragment, kind="stable")
        packed = ids[order].astype(np.int32).tobytes()
        before = np.concatenate([[0], np.cumsum(np.bincount(fragment, minlength=n_fragments))])
        edges = (4 * np.append(before[of_word], len(ids))).tolist()
        return [packed[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def learn(self, words: set[str]) -> None:
        """Remembers the ids of new short words."""
        new = [w for w in words - self.known_words.keys() if len(w) <= 64] if self.in_order else []
        for a in range(0, len(new), 50_000):
            some = new[a : a + 50_000]
            for w, ids in zip(some, self.many_words(some), strict=True):
                self.known_words.keep(w, ids)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers, one after another."""
        if self.known_words.held + self.known.held > REMEMBERED_BYTES:
            self.known_words.clear()
            self.known.clear()
        find, split = self.words.findall, self.between.split if self.between else lambda t: [t]
        parts = [split(t) for t in texts]
        # A very long part's words are not listed beforehand.
        lists = [[part if i % 2 or len(part) > STEP_CHARS else find(part) for i, part in enumerate(own)] for own in parts]
        self.learn(set().union(*(words for own in lists for words in own if isinstance(words, list))))
        get, out = self.known_words.__getitem__, []
        for own in lists:
            made: list[bytes] = []
            for i, words in enumerate(own):
                if i % 2:
                    made.append(np.int32(self.added[words]).tobytes())
                elif isinstance(words, list):
                    made += map(get, words)
                else:
                    made += (get(match[0]) for match in self.words.finditer(words))
            out.append(b"".join(made))
        return out

    def encode_packed(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype=np.int32).tolist()

    def decode(self, ids) -> str:
        return join_tokens(self.bytes_of, ids)


class _Shared:
    """The vocabulary file's text as a broadcast; its size is that of the file."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            self.broadcast = spark.sparkContext.broadcast(f.read())

    @property
    def value(self) -> str:
        return self.broadcast.value


def _steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about STEP_CHARS bytes of text, so that no result holds a whole large batch."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)) // STEP_CHARS
    edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1), len(texts)] if len(texts) else []
    yield from zip(edges[:-1], edges[1:], strict=True)


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the token ids of each whole text in ``ids_col`` (array<int>).

    ``path`` is the vocabulary's JSON file on the driver. Null and empty texts have
    no ids. With ``decoded_col`` the ids are decoded again in the same pass, as
    decode_ids does. Columns already called so are replaced; all others, their order
    and repeated rows stay. Nothing is shuffled.
    """
    bound_batches(docs.sparkSession)
    shared = _Shared(docs.sparkSession, path)
    made_cols = [ids_col] if decoded_col is None else [ids_col, decoded_col]
    text_at = docs.columns.index(text_col)
    kept = [c for c in docs.columns if c not in made_cols]
    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded_col or "", T.StringType())][: len(made_cols)]
    schema = T.StructType([*[docs.schema[c] for c in kept], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Made for each task: a worker that goes on to other work keeps none of it.
        bpe = ForcedBoundaryBpe(shared.value)
        for batch in batches:
            column = batch.column(text_at)
            for a, b in _steps(column):
                ids = bpe.encode_many([text or "" for text in column.slice(a, b - a).to_pylist()])
                ends = np.cumsum([0, *map(len, ids)]) // 4
                values = np.frombuffer(b"".join(ids), dtype=np.int32)
                made = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))]
                if decoded_col is not None:
                    made.append(pa.array([bpe.decode(values[i:j].tolist()) for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.string()))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], names=[*kept, *made_cols])

    return docs.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in ``text_col``, special tokens included; null ids give ""."""
    shared = _Shared(encoded.sparkSession, path)
    encoded = encoded.drop(text_col)
    schema = T.StructType([*encoded.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = token_bytes(json.loads(shared.value))
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            texts = pa.array([join_tokens(bytes_of, values[a:b].tolist()) if ok else "" for a, b, ok in zip(ends[:-1], ends[1:], valid, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, text_col])

    return encoded.mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text."""
    there_and_back = encode_texts(docs.select("doc_id", "text"), path, "text", "ids", "text")
    return there_and_back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
