"""Alignment of mentions to a canonical vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import encode
from ..functions.ranking import dense_index, top_k_inner_product
from ..functions.text import strip

ENTITY_THRESHOLD, RELATION_THRESHOLD = 0.525, 0.55


def entity_vocabulary(names: DataFrame) -> DataFrame:
    """(ord, name) from one array column ``names``."""
    return names.select(F.posexplode("names").alias("ord", "name"))


def relation_vocabulary(relations: DataFrame) -> DataFrame:
    """(ord, phrase, canonical) from a map canonical -> phrases in ``relations``; the first owner of a phrase wins."""
    owners = relations.select(F.posexplode(F.map_entries("relations")).alias("c", "e")).select("c", F.col("e.key").alias("canonical"), F.posexplode("e.value").alias("p", "phrase"))
    first = owners.groupBy("phrase").agg(F.min(F.struct("c", "p", "canonical")).alias("f")).select(F.col("f.c").alias("c"), F.col("f.p").alias("p"), "phrase", F.col("f.canonical").alias("canonical"))
    return dense_index(first, ["c"], ["p"], "ord").select(F.col("ord").cast("int").alias("ord"), "phrase", "canonical")


def encoded_vocabulary(vocabulary: DataFrame, text_col: str, make_encoder, max_length: int = 32) -> DataFrame:
    """``vocabulary`` with vec, the vector of each entry's text: what the alignments match against."""
    return encode(vocabulary, text_col, make_encoder, max_length).withColumn("vec", F.col("dense")).drop("dense", "sparse")


def distinct_mentions(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different stripped entities (heads and tails) and relations that are not empty."""
    entities = triples.select(F.explode(F.array("head", "tail")).alias("mention"))
    clean = lambda df: df.select(strip(F.col("mention")).alias("mention")).filter("mention <> ''").distinct()
    return clean(entities), clean(triples.select(F.col("relation").alias("mention")))


def align_entities(mentions: DataFrame, vocabulary: DataFrame, threshold: float = ENTITY_THRESHOLD, name_col: str = "name") -> DataFrame:
    """mention, aligned, score, ord: the nearest name if its inner product reaches the threshold, else the mention.

    mentions: mention, vec; vocabulary: ord, name_col, vec. Ties go to the lowest
    ord, which may have gaps. A mention without a vector, or without any name of its
    vector's length, stays as it is with null score and ord.
    """
    return _nearest(mentions, vocabulary.withColumnRenamed(name_col, "name"), threshold)


def align_relations(mentions: DataFrame, vocabulary: DataFrame, threshold: float = RELATION_THRESHOLD) -> DataFrame:
    """The same over phrases (ord, phrase, canonical, vec): the nearest phrase's canonical relation."""
    return _nearest(mentions, vocabulary.withColumnRenamed("canonical", "name"), threshold)


def _nearest(mentions: DataFrame, vocabulary: DataFrame, threshold: float) -> DataFrame:
    best = best_match(mentions, vocabulary).select(F.col("mention").alias("_m"), "ord", "score")
    named = best.join(vocabulary.select("ord", "name"), "ord")
    aligned = F.when(F.col("score") >= threshold, F.col("name")).otherwise(F.col("mention"))
    return mentions.select("mention").distinct().join(named, F.col("mention") == F.col("_m"), "left").select("mention", aligned.alias("aligned"), "score", "ord")


def best_match(mentions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """mention, ord, score of the largest inner product; mentions and vocabulary meet in packs of vectors."""
    vocab = vocabulary.select("ord", "vec")
    return top_k_inner_product(mentions.select("mention", "vec"), vocab, 1, "ord", "vec", "mention").select("mention", F.col("ord").cast("int").alias("ord"), "score")


def apply_alignment(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Head, tail and relation replaced by their aligned form; raw text that is no stripped mention stays."""
    of = lambda df, at: df.select(F.col("mention").alias(f"_m{at}"), F.col("aligned").alias(f"_{at}"))
    out = triples
    for col, table in (("head", entities), ("tail", entities), ("relation", relations)):
        out = out.join(of(table, col), F.col(col) == F.col(f"_m{col}"), "left").withColumn(col, F.coalesce(f"_{col}", col)).drop(f"_m{col}", f"_{col}")
    return out.select(*triples.columns)


def drop_empty_and_loops(triples: DataFrame) -> DataFrame:
    """Before and after alignment: no empty field, head differs from tail."""
    filled = F.lit(True)
    for c in ("head", "relation", "tail"):
        filled = filled & (F.coalesce(F.col(c), F.lit("")) != "")
    return triples.filter(filled & (F.col("head") != F.col("tail")))


def evaluate_alignment(cases: DataFrame, aligned: DataFrame, canonicals: DataFrame) -> DataFrame:
    """ord, raw, expected, actual, kind (canonical, variant, negative), status for each case.

    cases: ord, raw, expected; aligned: mention, aligned; canonicals: name.
    """
    known = canonicals.select(F.col("name").alias("_name")).distinct()
    maps = aligned.select(F.col("mention").alias("_mention"), F.col("aligned").alias("_aligned"))
    joined = cases.join(known, F.col("raw") == F.col("_name"), "left").join(maps, F.col("raw") == F.col("_mention"), "left").withColumn("actual", F.coalesce("_aligned", "raw"))
    kind = F.when(F.col("_name").isNotNull(), "canonical").when(F.col("raw") == F.col("expected"), "negative").otherwise("variant")
    right = F.col("actual") == F.col("expected")
    status = (
        F.when(right, F.when(kind == "canonical", "canonical_hit").when(kind == "negative", "rejection_hit").otherwise("aligned_hit"))
        .when(kind == "canonical", "canonical_drift")
        .when(kind == "negative", "false_positive")
        .when(F.col("actual") == F.col("raw"), "missed")
        .otherwise("mismatched")
    )
    return joined.select("ord", "raw", "expected", "actual", kind.alias("kind"), status.alias("status"))


def alignment_report(evaluated: DataFrame) -> DataFrame:
    """kind, status, cases, percent of the kind; the row of null kind and status holds all cases and the accuracy."""
    rows = evaluated.rollup("kind", "status").agg(F.count("*").alias("cases"), F.sum(F.col("status").endswith("_hit").cast("int")).alias("hits"))
    kinds = rows.filter("status is null and kind is not null").select(F.col("kind").alias("_kind"), F.col("cases").alias("_of"))
    single = rows.filter("status is not null").join(kinds, F.col("kind") == F.col("_kind")).select("kind", "status", "cases", (100.0 * F.col("cases") / F.col("_of")).alias("percent"))
    total = rows.filter("kind is null").select("kind", "status", "cases", (100.0 * F.col("hits") / F.col("cases")).alias("percent"))
    return single.unionByName(total)
