import re
import time

import numpy as np
from pyspark.sql import functions as F

from corpusgraph.llm import mixing as M
from tests.conftest import rows


def iterate(sizes, weights, share=1.5, most=2.0):
    """Hands out the budget by weight and reshares what is above a cap until nothing is."""
    caps = [most * n for n in sizes]
    targets, left = [0.0] * len(sizes), share * sum(sizes)
    while left > 1e-9:
        open_ = [i for i in range(len(sizes)) if targets[i] < caps[i] - 1e-12]
        if not open_:
            break
        total = sum(weights[i] for i in open_)
        extra = 0.0
        for i in open_:
            targets[i] += left * weights[i] / total
            extra += max(0.0, targets[i] - caps[i])
            targets[i] = min(targets[i], caps[i])
        left = extra
    return targets


def test_targets():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(0, 1000, rng.integers(1, 9)).tolist()
        weights = [M.WEIGHTS[i % 3] for i in range(len(sizes))]
        assert np.allclose(M.fill_targets(sizes, weights), iterate(sizes, weights), atol=1e-6)
    assert M.fill_targets([], []) == []


def test_tree_splits_exactly_and_evenly():
    got = M.split_quotas([100, 0, 37, 1], 8)
    assert got.sum(axis=0).tolist() == [100, 0, 37, 1] and np.ptp(got.sum(axis=1)) <= 1
    assert (got == M.split_quotas([100, 0, 37, 1], 8)).all()


ROWS = [(i, f"s{i % 4}", f"{i} " + "word " * (i * 13 % 90)) for i in range(120)] + [(200, None, "a\x0bb\x1cc é"), (201, "s1", None), (202, "s2", ""), (203, "s3", "x " * 9000), (203, "s3", "x " * 9000), (None, "s0", "no id")]


def test_mix_against_its_contract_at_any_partitioning(spark):
    schema = "doc_id long, source string, text string"
    want = None
    for n in (1, 5):
        got = M.Mix(spark.createDataFrame(ROWS, schema).repartition(n)).taken()
        assert got.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
        now = rows(got)
        want = want or now
        assert now == want
    size = {(i, t): len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in ROWS}
    assert sorted(r[1] for r in want) == sorted(size[i, t] for i, _, t in ROWS)
    assert all(r[4] <= 2 * r[1] for r in want)
    by = {}
    for r in want:
        by.setdefault((r[2], r[3]), []).append(r[4])
    assert all(abs(sum(v) - target) <= 1 for (_, target), v in by.items())


def test_documents_of_the_mix(spark):
    docs = spark.createDataFrame([(i, f"t{i} " + "w " * 20, "en", "a" if i % 2 else "b", 5) for i in range(40)] + [(90, "x " * 5000, "en", "a", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    mix = M.Mix(docs)
    got = mix.documents(docs)
    assert got.columns == docs.columns
    words = {r.doc_id: 0 for r in docs.collect()}
    for r in got.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words == {r.doc_id: r.taken for r in mix.taken().collect()}
    shards = [r[0] for r in mix.draws().select("shard").distinct().collect()]
    assert len(shards) >= 2 and set(shards) <= set(range(M.SHARDS))


def mixed(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"s{i % 5}", f"{i} " + "word " * int(rng.integers(0, 900))) for i in range(600)]
    return spark.createDataFrame([*rows, (900, "s1", "long " * 30_000), (901, None, "long " * 9_000)], "doc_id long, source string, text string").repartition(5)


def test_every_shard_draws_its_quota_and_sources_meet_their_targets(spark):
    mix = M.Mix(mixed(spark), shards=7)
    quota = {(r.shard, r.src): r["last"] - r["first"] for r in mix.shard_quotas().collect()}
    drawn = mix.draws().collect()
    blocks = {}
    for r in drawn:
        blocks.setdefault((r.shard, r.src), set()).add((r["pass"], r.block))
    assert {k: len(v) for k, v in blocks.items()} == quota
    everything = [(src, b) for (_, src), own in blocks.items() for b in own]
    assert len(everything) == len(set(everything)), "a block is drawn by two shards"
    totals = [sum(n for (s, _), n in quota.items() if s == shard) for shard in range(7)]
    assert max(totals) - min(totals) <= 1
    target = {r.src: r.target for r in mix.sources.collect()}
    words = {}
    for r in drawn:
        words[r.src] = words.get(r.src, 0) + r.words
    assert all(abs(words[src] - t) <= 1 for src, t in target.items() if t)


def test_the_result_comes_through_the_tree(spark, monkeypatch):
    docs = mixed(spark)
    first = rows(M.Mix(docs, shards=7).taken())
    assert rows(M.Mix(docs, shards=7).taken()) == first
    other = rows(M.Mix(docs, shards=7, seed=6).taken())
    assert [r[:4] for r in other] == [r[:4] for r in first] and other != first
    tree = M.split_quotas

    def half(quotas, shards, seed):
        out = tree(quotas, shards, seed)
        out[shards // 2 :] = 0
        return out

    monkeypatch.setattr(M, "split_quotas", half)
    fewer = rows(M.Mix(docs, shards=7).taken())
    assert 0.2 < sum(r[4] for r in fewer) / sum(r[4] for r in first) < 0.8 and all(set(r[5]) <= {0, 1, 2} for r in fewer)
    monkeypatch.setattr(M, "split_quotas", lambda quotas, shards, seed: 0 * tree(quotas, shards, seed))
    assert not any(r[4] for r in rows(M.Mix(docs, shards=7).taken()))


def test_documents_with_clashing_columns_repeated_rows_and_shards(spark):
    docs = mixed(spark)
    docs = docs.unionByName(docs.filter("doc_id < 5")).select("*", *[F.col("doc_id").cast("string").alias(c) for c in ("shard", "turn", "row", "d", "k1", "taken", "words", "slice", "_taken", "size")], F.create_map(F.lit("a"), "doc_id").alias("m"))
    mix = M.Mix(docs, shards=6)
    got = mix.documents(docs)
    assert got.columns == docs.columns
    parts = got.withColumn("_p", F.spark_partition_id()).collect()
    taken, kept = {}, {r.doc_id: r.text for r in docs.collect()}
    for r in parts:
        assert r.shard == str(r.doc_id) and r.m == {"a": r.doc_id}
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
        assert r.text in kept[r.doc_id] or len(kept[r.doc_id].split()) > M.BLOCK_WORDS
    want = {}
    for r in mix.taken().collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert taken == {k: v for k, v in want.items() if v}
    per_shard = {r.shard: r.words for r in mix.draws().groupBy("shard").agg(F.sum("words").alias("words")).collect()}
    by_part = {}
    for r in parts:
        by_part[r._p] = by_part.get(r._p, 0) + len(r.text.split())
    assert by_part == per_shard


def test_many_equal_rows_are_no_square(spark):
    """Rows that all repeat one another take about the time of different ones, not that of all their pairs."""
    took = []
    for same in (False, True):
        docs = spark.range(60_000).selectExpr("0L AS doc_id" if same else "id AS doc_id", "'a b c d' AS text", "'s' AS source")
        mix, began = M.Mix(docs), time.time()
        got = mix.documents(docs).agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", " "))).alias("words")).first()
        took.append(time.time() - began)
        assert got.words == mix.taken().agg(F.sum("taken")).first()[0] == 360_000 and got.n >= 90_000
    assert took[1] < 10 * took[0] + 10


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert M.Mix(none).taken().count() == 0


def test_query(spark):
    got = M.op5_mixing(spark, "/root/testdata/sf0.001").toPandas()
    assert (got.taken <= 2 * got["size"]).all() and abs(got.taken.sum() - 1.5 * got["size"].sum()) < 30
