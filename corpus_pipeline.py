"""A corpus pipeline: quality, near-duplicates, repeated passages, mixing, tokens.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which run() writes as Parquet and reads again for the next.
All stages but the last return the columns of documents: doc_id, text, lang,
source, n_chars; other columns, whatever they are called, go in the first stage.

Every stage takes rows as they come: null ids, texts, sources or languages, empty
and very long texts, rows that repeat and tables without rows. What becomes of them
stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm.bpe import token_digests, vocabulary_path
from corpusgraph.llm.common import Scratch
from corpusgraph.llm.minhash import near_duplicates
from corpusgraph.llm.mixing import Mix
from corpusgraph.llm.quality import score_texts, train
from corpusgraph.llm.suffixes import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of 0.5 or more).

    Null and empty texts have the score of a text without features and stay or go by
    that; equal texts fare alike; a score of just 0.5 stays. Without usable labels all
    scores are 0.5 and all documents stay.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_texts(docs.select(*COLUMNS), model, "_score").filter("_score >= 0.5").select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest id.

    Rows without id or without words are in no group and stay; rows that share an id
    are one document and stay or go together.
    """
    gone = near_duplicates(docs).filter("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings that also start earlier; what is left of a letter that was cut through becomes U+FFFD.

    Null texts become empty, short ones stay; rows without id count as the last, a row
    that repeats another as a later one. A text may lose all its bytes; its row stays.
    """
    left = remove_repeats(docs.select(*COLUMNS)).withColumn("text", F.make_valid_utf8(F.col("kept").cast("string")))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; a document taken twice is two rows.

    Null sources are a source of their own; texts without words are in no mix. The
    last document of a source's share may be cut behind a word.
    """
    return Mix(docs.select(*COLUMNS)).documents(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of the mix; null texts count as empty, null ids stay null."""
    return token_digests(docs, vocabulary_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicate),
    ("repeated_passages", repeated_passages),
    ("mixing", mixture),
    ("tokens", tokens),
]

#: SQL cannot express these stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
