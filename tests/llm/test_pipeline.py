import corpus_pipeline as P
from corpusgraph.llm.common import Scratch
from tests.llm.test_minhash import brute as near
from tests.llm.test_suffixes import brute as repeats

DIR = "/root/testdata/sf0.001"


def test_each_stage_works_on_what_the_one_before_kept(spark):
    scratch, docs, kept = Scratch(spark, "stages"), spark.read.parquet(f"{DIR}/documents.parquet"), {}
    for name, stage in P.STAGES:
        docs = scratch.save(stage(spark, docs, DIR), name)
        kept[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == P.COLUMNS
    quality = {r.doc_id for r in spark.read.parquet(f"{DIR}/labels.parquet").collect() if r.quality == 1}
    all_ids = {r.doc_id for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    one = {r.doc_id for r in kept["quality"]}
    assert len(quality & all_ids - one) <= 1
    groups = near([(r.doc_id, r.text) for r in kept["quality"]])
    assert {r.doc_id for r in kept["near_duplicates"]} == {g[0] for g in groups if g[3]}
    removed = {r[0]: r[2] for r in repeats([(r.doc_id, r.text) for r in kept["near_duplicates"]])}
    before = {r.doc_id: len(r.text.encode()) for r in kept["near_duplicates"]}
    exact = [r for r in kept["repeated_passages"] if "�" not in r.text]
    assert exact and all(len(r.text.encode()) == before[r.doc_id] - removed[r.doc_id] for r in exact)
    words = lambda rs: sum(len(r.text.split()) for r in rs)
    assert abs(words(kept["mixing"]) - 1.5 * words(kept["repeated_passages"])) < 40
    assert sorted(r.doc_id for r in kept["tokens"]) == sorted(r.doc_id for r in kept["mixing"])


def odd_tables(spark, folder, rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("score", "_score", "kept", "n_removed", "shard", "ids", "row", "component_id")])
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], i % 2) for i, r in enumerate(rows) if r[0] is not None] + [(None, 1), (10**9, 0), (7, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")


def test_odd_rows_pass_every_stage(spark, tmp_path):
    long = " ".join(f"word{i % 977} and{i}" for i in range(40_000))
    rows = [(i, f"some ordinary text number {i} with a few more words in it", "en", "s1", 5) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "s2", 0), (None, "no id at all here", "de", "s1", None), (None, None, None, None, None), (102, long, "en", "s2", 1), (103, long, "en", "s3", 1), (3, rows[3][1], "en", "s1", 5), (104, " \t\n", "en", None, 3), (105, "é" * 300, None, "s1", 2), (106, "\x00 a b c d e f", "en", "s1", 2)]
    odd_tables(spark, f"{tmp_path}/odd", rows)
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    scratch = Scratch(spark, "odd")
    for name, stage in P.STAGES:
        docs = scratch.save(stage(spark, docs, f"{tmp_path}/odd"), name)
        if name != "tokens":
            assert docs.columns == P.COLUMNS
            # Stages work on whatever reaches them: these rows are put back for the next one.
            if name == "quality":
                docs = scratch.save(spark.read.parquet(f"{tmp_path}/odd/documents.parquet").select(*P.COLUMNS), "all")
    got = docs.collect()
    assert got and all(r.n_tokens >= 0 and len(r.ids_sha256) == len(r.decoded_sha256) == 64 for r in got)
    kept = {r.doc_id for r in scratch.read("near_duplicates").collect()}
    assert {None, 100, 101, 104, 102} <= kept and 103 not in kept
    assert scratch.read("near_duplicates").filter("doc_id is null").count() == 2
    odd_tables(spark, f"{tmp_path}/none", [])
    assert P.run(spark, f"{tmp_path}/none").count() == 0
