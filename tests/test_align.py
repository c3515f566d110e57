from pyspark.sql import functions as F

from corpusgraph.operators import align
from tests.conftest import rows


def test_threshold_ties_and_first_phrase(spark):
    vocab = spark.createDataFrame([(0, "A", [1.0, 0.0]), (1, "B", [1.0, 0.0]), (2, "C", [0.0, 1.0])], "ord int, name string, vec array<double>")
    mentions = spark.createDataFrame([("tie", [0.525, 0.0]), ("low", [0.52, 0.1]), ("c", [0.1, 0.9])], "mention string, vec array<double>")
    assert rows(align.align_entities(mentions, vocab), "mention", "aligned", "ord") == [("c", "C", 2), ("low", "low", 0), ("tie", "A", 0)]
    relations = spark.sql("SELECT map('R1', array('p', 'q'), 'R2', array('q', 'r')) AS relations")
    assert rows(align.relation_vocabulary(relations)) == [(0, "p", "R1"), (1, "q", "R1"), (2, "r", "R2")]


def test_alignment_keeps_padded_text_and_drops_new_loops(spark):
    raw = spark.createDataFrame([(0, 5, "a", "is", "b", "t"), (1, 5, " a", "is", "c", "t"), (2, 6, "x", "", "y", "t"), (3, 6, "z", "is", "z", "t")], "triple_no long, index long, head string, relation string, tail string, text string")
    clean = align.drop_empty_and_loops(raw)
    entities, relations = align.distinct_mentions(clean)
    assert rows(entities) == [("a",), ("b",), ("c",)] and rows(relations) == [("is",)]
    e = spark.createDataFrame([("a", "B"), ("b", "B"), ("c", "C")], "mention string, aligned string")
    r = spark.createDataFrame([("is", "IS")], "mention string, aligned string")
    assert rows(align.drop_empty_and_loops(align.apply_alignment(clean, e, r)), "triple_no", "head", "relation", "tail") == [(1, " a", "IS", "C")]


def test_evaluation_classes(spark):
    cases = spark.createDataFrame([(0, "A", "A"), (1, "B", "B"), (2, "a", "A"), (3, "b", "B"), (4, "c", "B"), (5, "n", "n"), (6, "m", "m")], "ord int, raw string, expected string")
    aligned = spark.createDataFrame([("A", "A"), ("B", "A"), ("a", "A"), ("b", "b"), ("c", "A"), ("n", "n"), ("m", "A")], "mention string, aligned string")
    canon = spark.createDataFrame([("A",), ("B",)], "name string")
    got = align.evaluate_alignment(cases, aligned, canon)
    assert [r[0] for r in got.orderBy("ord").select("status").collect()] == ["canonical_hit", "canonical_drift", "aligned_hit", "missed", "mismatched", "rejection_hit", "false_positive"]
    total = align.alignment_report(got).filter("kind is null").first()
    assert total.cases == 7 and abs(total.percent - 300 / 7) < 1e-9


def test_gaps_empty_vocabularies_and_missing_vectors(spark):
    mentions = spark.createDataFrame([("near", [1.0, 0.0]), ("none", None), ("hole", [None, 1.0]), ("other length", [1.0])], "mention string, vec array<double>")
    gaps = spark.createDataFrame([(10_000, "A", [0.9, 0.1]), (5, "B", None), (70_000, "C", [0.9, 0.1])], "ord int, name string, vec array<double>")
    stays = [("hole", "hole", None), ("none", "none", None), ("other length", "other length", None)]
    assert rows(align.align_entities(mentions, gaps), "mention", "aligned", "ord") == sorted([("near", "A", 10_000), *stays], key=repr)
    assert rows(align.align_entities(mentions, gaps.limit(0)), "mention", "aligned") == [(m, m) for m in ("hole", "near", "none", "other length")]
    phrases = gaps.withColumnRenamed("name", "canonical").withColumn("phrase", F.lit("p"))
    assert rows(align.align_relations(mentions, phrases, 0.95), "mention", "aligned", "ord") == sorted([("near", "near", 10_000), *stays], key=repr)
