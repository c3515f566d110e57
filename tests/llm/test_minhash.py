import random
import re

import numpy as np
import pytest

from corpusgraph.llm import minhash as H
from corpusgraph.llm.common import Scratch
from corpusgraph.llm.components import components


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def ours(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in H.near_duplicates(df).collect())


@pytest.mark.parametrize("block", [256, 3])
def test_families_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(H, "BLOCK", block)
    rng = random.Random(7)
    docs, n = [], 0
    for _ in range(8):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 999)}"
            docs.append((n := n + rng.randint(1, 4), " ".join(copy) if rng.random() < 0.7 else "\n".join(copy).upper()))
    docs += [(n + 10, None), (n + 11, ""), (n + 12, " \t"), (n + 13, "a b"), (n + 14, "A  B"), (n + 15, "a b c")]
    assert ours(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 1 << 62, n, dtype=np.uint64) for n in (300, 50, 50))
    s = [np.unique(np.concatenate([common, x])) for x in (a, b)] + [common[:3]]
    c = H.sketches(np.concatenate(s), np.cumsum([0, *map(len, s)]))
    assert abs((c[0] == c[1]).mean() - 0.75) < 0.15 and (c != 0).all()


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in H.near_duplicates(df).collect()), key=repr)
    assert got == [(5, 5, True), (5, 5, True), (7, 5, False), (None, None, False)]
    assert H.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(139, 60), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "t"), "x").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 60 for i in [60, *range(100, 140)]}


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in H.op10_minhash(spark, d).collect())
    assert got == brute(docs)


def test_clashing_columns_long_texts_and_repeats(spark):
    from pyspark.sql import functions as F

    long = " ".join(f"w{i % 5000}x{i}" for i in range(30_000))
    docs = [(1, long), (2, long + " more words at the end"), (3, "z" * 300_000), (4, "z" * 300_000), (5, "Z" * 299_999), (5, "Z" * 299_999)]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit(9).alias(c) for c in ("n_shingles", "h1", "lead", "rep", "s", "_part", "bands", "kept")])
    got = sorted(set(ours(df)))
    assert got == [(1, 29_996, 1, True), (2, 30_001, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True)]
    assert H.near_duplicates(df.limit(0)).count() == 0


def test_words_that_differ_anywhere_have_different_hashes():
    import pyarrow as pa

    def thue_morse(n, flip):
        return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))

    texts = [thue_morse(4096, 0), thue_morse(4096, 1), "x" * 63 + "y", "x" * 64, "x" * 65, "x" * 64 + "y", "abcdefgh", "abcdefg", "abcdefg\0"]
    (_, s, begins), = H.shingle_sets(pa.array(texts, pa.string()))
    assert begins.tolist() == list(range(len(texts) + 1)) and len(set(s.tolist())) == len(texts)


def test_more_sets_than_one_round_of_sketches_holds():
    n = (1 << 24) // H.BINS + 5
    one = H.sketches(np.arange(n, dtype=np.uint64), np.arange(n + 1))
    assert one.shape == (n, H.BINS)
    for i in (0, n - 6, n - 5, n - 1):
        assert (one[i] == H.sketches(np.array([i], dtype=np.uint64), np.array([0, 1]))[0]).all()


def test_hot_keys_are_spread(spark):
    from pyspark.sql import functions as F

    from corpusgraph.llm.common import spread_join

    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"), "id")
    facts = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("fact"))
    got = spread_join(rows, facts, ["k"])
    assert got.count() == 5000 and got.filter("fact = 2 * k").count() == 5000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in spread_join(rows, facts, ["k"]).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 2500
