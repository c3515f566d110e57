import glob
import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import suffixes as S


def brute(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(gone[p] and (p == 0 or not gone[p - 1]) for p in range(len(b))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def ours(df):
    got = S.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_cover_has_every_difference():
    assert {(a - b) % S.COVER_PERIOD for a in S.COVER for b in S.COVER} == set(range(S.COVER_PERIOD))


@pytest.mark.parametrize("seed", range(3))
def test_random_repeats_over_several_blocks(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    long = lambda n: " ".join(word() for _ in range(n))
    shared = [long(n) for n in (14, 18, 22, 26, 60, 200)]
    docs = []
    for i in range(60):
        parts = [long(rng.randint(0, 30)) for _ in range(3)]
        for s in rng.sample(shared, rng.randint(0, 3)):
            cut = rng.randint(0, 3)
            parts.insert(rng.randint(0, len(parts)), s[cut : len(s) - rng.randint(0, 3)])
        docs.append((rng.randint(0, 10_000), " ".join(parts)))
    docs = list({i: (i, t) for i, t in docs}.values())
    docs += [(20_000, docs[0][1]), (20_001, docs[5][1][:-1]), (20_002, "z" * 350), (20_003, "z" * 120), (20_004, "é" * 60), (20_005, None), (20_006, ""), (20_007, "ab" * 2000), (None, docs[3][1])]
    assert ours(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)) == brute(docs)


def test_repeated_rows_other_columns_and_empty_table(spark):
    text = "the quick brown fox " * 20
    df = spark.createDataFrame([(1, text, "en"), (1, text, "en"), (2, "short", None)], "doc_id long, text string, lang string").repartition(3)
    got = sorted((r.doc_id, r.n_removed, r.lang) for r in S.remove_repeats(df).collect() if r.doc_id == 1)
    assert [x[2] for x in got] == ["en", "en"] and got[1][1] == len(text) and 0 < got[0][1] < len(text)
    assert S.remove_repeats(df.limit(0)).count() == 0
    clash = df.select("*", *[F.lit("x").alias(c) for c in ("kept", "_order", "block", "n_bytes")])
    made = S.remove_repeats(clash)
    assert {"_order", "block", *S.MADE} <= set(made.columns) and sorted((r.doc_id, r.n_removed, r.block) for r in made.collect() if r.doc_id == 1) == [(*x[:2], "x") for x in got]


def thue_morse(n, flip):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_structured_texts_without_common_strings(spark):
    """Letters of a Thue-Morse word and of its complement, with equal filler between: weak hashes take them for equal."""
    filler = "".join(random.Random(4).choices("cdefgh", k=1024))
    docs = [(i, "".join(x + y for x, y in zip(thue_morse(1024, i), filler, strict=True))) for i in (0, 1)]
    assert [r[2] for r in ours(spark.createDataFrame(docs, "doc_id long, text string"))] == [0, 0]


def test_structured_corpus(spark):
    """A million bytes of a few periodic and nested patterns, where many different windows share long strings."""
    rng = random.Random(6)
    words = [thue_morse(64, 0), thue_morse(64, 1), "ab" * 30, "aab" * 25, "x" * 70, "the same line of boilerplate in many places, word for word;"]
    docs = [(i, " ".join(rng.choice(words) + (str(rng.randint(0, 50)) if rng.random() < 0.5 else "") for _ in range(rng.randint(5, 40)))) for i in range(620)]
    assert sum(len(t) for _, t in docs) > 900_000
    assert ours(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)) == brute(docs)


def test_crowded_bucket(spark):
    """One line in all texts, each time in other surroundings: its bucket is dealt anew, window by window."""
    rng = random.Random(3)
    line = "one very common line that stands in every single document of this corpus"
    noise = lambda: "".join(rng.choice("abcdefghijklmnop \0") for _ in range(rng.choice([3, 12, 60])))
    docs = [(i, noise() + line + noise() + line * (i % 3) + noise()) for i in range(400)] + [(1000 + i, line + line) for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = brute(docs)
    for crowded in (1, 40, S.CROWDED):
        got = S.remove_repeats(df, crowded).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted((tuple(r) for r in S.op9_suffixes(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert got == brute(docs)


def test_a_missing_reply_is_an_error(tmp_path):
    (tmp_path / "of=0").mkdir()
    with pytest.raises(FileNotFoundError):
        S._Replies(f"file://{tmp_path}", every=True).of(1 << 32)
    with pytest.raises(FileNotFoundError):
        S._Replies(f"file://{tmp_path}/none").of(0)
    assert S._Replies(f"file://{tmp_path}").of(1 << 32) is None


def test_memory_of_a_block_whose_windows_are_all_open():
    """Open windows are stretches, and their runs are found step by step: no arrays as long as the block (112 MB before)."""
    raw = random.Random(2).randbytes(2 << 20)
    block = S._Block(raw, np.array([1 << 20, 2 << 20], np.int64).tobytes())
    at, _ = block.sample(3)
    tracemalloc.start()
    begin, sizes = block.unsettled(at)
    runs = [block.runs(b, n)[1] for b, n in S._steps(begin, sizes, S.STEP_WINDOWS)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(int(n.sum()) for n in runs) == int(sizes.sum()) == 2 * ((1 << 20) - 99)
    assert peak < 48 << 20, peak


def test_small_row_groups_of_the_block_table(spark):
    """A task reads a few blocks at a time, however many a file has."""
    scratch = S.Scratch(spark, "groups")
    texts = [(i, random.Random(i).randbytes(1 << 19).hex()) for i in range(28)]
    scratch.save(S.block_table(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)), "blocks", S.SMALL_GROUPS)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(scratch.root.removeprefix("file://") + "/blocks/*.parquet")]
    rows = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(rows) >= 7 and max(rows) <= 5, rows
