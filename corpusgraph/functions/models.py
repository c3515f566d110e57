"""Batch model steps with the model as a parameter.

A generator factory is called once in each worker and gives a function from a
prompt (str, or dict of columns) to a reply; a failing row becomes a null reply
and an error text, never a failed job. Save a reply table before reading it twice:
a model need not repeat itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip

Generator = Callable[[dict], str]
TABLE_PROMPT = "Describe this table in plain sentences, with all its figures:\n"
FIGURE_PROMPT = "Describe what this figure shows. Its caption: "
TRIPLES = "struct<triples:array<struct<head:string,relation:string,tail:string>>>"
QUESTIONS = "struct<questions:array<string>>"


def map_with_fallback(df: DataFrame, inputs: list[str], make_generator: Callable[[], Generator], out_col: str = "reply", tasks: int | None = None, store: str | None = None) -> DataFrame:
    """``df`` with out_col and error: one call a row with the named input columns; ``tasks`` spreads slow calls.

    ``store`` names a folder of replies: see stored_replies.
    """
    if store:
        return stored_replies(df, inputs, make_generator, store, out_col, tasks)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType()), T.StructField("error", T.StringType())])

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = make_generator()
        for batch in batches:
            replies, errors = [], []
            for row in batch[inputs].to_dict("records"):
                try:
                    replies.append(generate(row))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a row's failure is data
                    replies.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield batch.assign(**{out_col: pd.Series(replies, index=batch.index, dtype=object), "error": pd.Series(errors, index=batch.index, dtype=object)})

    return (df.repartition(tasks) if tasks else df).mapInPandas(call, schema)


def stored_replies(df: DataFrame, inputs: list[str], make_generator: Callable[[], Generator], store: str, out_col: str = "reply", tasks: int | None = None) -> DataFrame:
    """``df`` with out_col and error, where equal inputs are asked once and answered inputs never again.

    Replies are kept in the folder ``store`` by a hash of their inputs; only inputs
    without a reply there are asked, each once however many rows have them, and their
    replies are added before anything reads them. Failures are kept for this run's rows
    but asked again by the next run. A store serves one kind of generator.
    """
    spark = df.sparkSession
    key = F.sha2(F.to_json(F.array(*[F.coalesce(F.base64(F.col(c).cast("string").cast("binary")), F.lit("-")) for c in inputs])), 256)
    keyed = df.withColumn("_key", key)
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    kept = lambda: spark.read.schema("_key string, _told string, _error string").parquet(store)
    asked = keyed.select("_key", *inputs).dropDuplicates(["_key"])
    if there:
        asked = asked.join(kept().filter("_error is null").select("_key"), "_key", "left_anti")
    told = map_with_fallback(asked, inputs, make_generator, "_told", tasks).select("_key", "_told", F.col("error").alias("_error"))
    told.write.mode("append").parquet(store)
    # Of several replies to the same inputs a good one counts, and the same in each run.
    best = kept().groupBy("_key").agg(F.min(F.struct(F.col("_error").isNotNull().alias("failed"), "_told", "_error")).alias("r"))
    replies = best.select("_key", F.col("r._told").alias(out_col), F.col("r._error").alias("error"))
    return keyed.drop(out_col, "error").join(replies, "_key", "left").select(*[c for c in df.columns if c not in (out_col, "error")], out_col, "error")


def _described(rows: DataFrame, inputs: list[str], make_generator, tasks: int | None, store: str | None) -> DataFrame:
    told = map_with_fallback(rows, inputs, make_generator, "_reply", tasks, store)
    answer = strip(F.col("_reply"))
    return told.withColumn("text", F.coalesce(F.when(answer != "", answer), F.col("text"))).drop("_reply", "error", *[c for c in inputs if c.startswith("_")])


def describe_tables(chunks: DataFrame, make_generator, tasks: int | None = None, store: str | None = None) -> DataFrame:
    """Table chunks with the reply as text; a blank or failed reply keeps the markdown."""
    prompt = F.concat(F.lit(TABLE_PROMPT), "text")
    return _described(chunks.withColumn("_prompt", prompt), ["_prompt"], make_generator, tasks, store)


def figure_uri(image: Column, ext: Column) -> Column:
    """data: URI of an image; jpg is called jpeg."""
    kind = F.when(F.lower(ext) == "jpg", "jpeg").otherwise(F.lower(ext))
    return F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(image), r"\s", ""))


def describe_figures(chunks: DataFrame, make_generator, tasks: int | None = None, store: str | None = None) -> DataFrame:
    """Figure chunks (with bytes, ext) with the reply as text; a blank or failed reply keeps the caption."""
    prompt = F.concat(F.lit(FIGURE_PROMPT), "text")
    ready = chunks.withColumn("_prompt", prompt).withColumn("_image", figure_uri(F.col("bytes"), F.col("ext")))
    return _described(ready, ["_prompt", "_image"], make_generator, tasks, store)


def route_by_modality(chunks: DataFrame, make_table_generator, make_figure_generator, tasks: int | None = None, store: str | None = None) -> DataFrame:
    """Tables and figures get rewritten texts, all else passes unchanged; ``store`` is a folder of replies for each of both."""
    of = lambda name: store and f"{store}/{name}"
    kind = F.coalesce(F.col("modality"), F.lit("text"))
    text = chunks.filter(~kind.isin("table", "figure"))
    tables = describe_tables(chunks.filter(kind == "table"), make_table_generator, tasks, of("tables"))
    describe = describe_figures if "bytes" in chunks.columns else describe_tables
    figures = describe(chunks.filter(kind == "figure"), make_figure_generator, tasks, of("figures"))
    return text.unionByName(tables).unionByName(figures)


def parse_triples(replies: DataFrame, reply_col: str = "reply") -> DataFrame:
    """index, pos, head, relation, tail, text; unreadable replies give none, missing fields are empty."""
    parsed = replies.select("index", "text", F.posexplode(F.from_json(reply_col, TRIPLES)["triples"]).alias("pos", "t"))
    return parsed.select("index", "pos", *[F.coalesce(F.col(f"t.{c}"), F.lit("")).alias(c) for c in ("head", "relation", "tail")], "text")


def extract_triples(chunks: DataFrame, make_generator, tasks: int | None = None, store: str | None = None) -> DataFrame:
    prompt = F.concat(F.lit('List the facts of this text as JSON {"triples": [{"head", "relation", "tail"}]}:\n'), "text")
    return parse_triples(map_with_fallback(chunks.select("index", "text", prompt.alias("prompt")), ["prompt"], make_generator, tasks=tasks, store=store))


def parse_questions(reply: Column) -> Column:
    """The reply's questions; an unreadable one gives an empty list."""
    return F.coalesce(F.from_json(reply, QUESTIONS)["questions"], F.array().cast("array<string>"))


def questions_prompt(n: int) -> str:
    return f'Write {n} questions that this text answers as JSON {{"questions": [...]}}:\n'


def generate_questions(chunks: DataFrame, make_generator, n: int = 2, tasks: int | None = None, store: str | None = None) -> DataFrame:
    """``chunks`` with questions: what a reader could ask that the text answers."""
    prompt = F.concat(F.lit(questions_prompt(n)), "text")
    told = map_with_fallback(chunks.withColumn("_prompt", prompt), ["_prompt"], make_generator, "_reply", tasks, store)
    return told.withColumn("questions", parse_questions(F.col("_reply"))).drop("_prompt", "_reply", "error")


def index_text(text: Column, questions: Column) -> Column:
    """The text that is encoded for a chunk: its numbered questions, then itself."""
    numbered = F.transform(F.coalesce(questions, F.array().cast("array<string>")), lambda q, i: F.concat((i + 1).cast("string"), F.lit("."), q, F.lit("\n")))
    asked = F.when(F.size(numbered) > 0, F.concat(F.lit("[prompt question]:\n"), F.array_join(numbered, ""))).otherwise("")
    return F.concat(asked, F.lit("[text]:"), text, F.lit("\n"))


def triple_text(head: Column, relation: Column, tail: Column) -> Column:
    return F.concat(F.lit("("), head, F.lit(") --["), relation, F.lit("]--> ("), tail, F.lit(")"))


def encode(df: DataFrame, text_col: str, make_encoder: Callable[[], Callable[[list[str], int | None], list[tuple[list[float], dict[str, float]]]]], max_length: int | None, batch_size: int = 16) -> DataFrame:
    """``df`` with dense and sparse: the encoder is made once in each task and called in batches; max_length None means whole texts.

    Columns already called so are replaced; save the result before reading it twice.
    """
    df = df.drop(*[c for c in ("dense", "sparse") if c != text_col])
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField("dense", T.ArrayType(T.FloatType())), T.StructField("sparse", T.MapType(T.StringType(), T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        for batch in batches:
            # A batch's maps take many times the room of its texts, so they go on in steps.
            for start in range(0, len(batch), 16 * batch_size):
                part = batch.slice(start, 16 * batch_size)
                texts, rows = part.column(at).fill_null("").to_pylist(), []
                for a in range(0, len(texts), batch_size):
                    rows += encoder(texts[a : a + batch_size], max_length)
                ends = lambda which: pa.array(np.cumsum([0, *(len(r[which]) for r in rows)]), pa.int32())
                dense = pa.ListArray.from_arrays(ends(0), pa.array(np.fromiter(chain.from_iterable(d for d, _ in rows), np.float32)))
                keys = pa.array(chain.from_iterable(s for _, s in rows), pa.string())
                weights = pa.array(np.fromiter(chain.from_iterable(s.values() for _, s in rows), np.float32))
                yield pa.RecordBatch.from_arrays([*part.columns, dense, pa.MapArray.from_arrays(ends(1), keys, weights)], names=[*part.schema.names, "dense", "sparse"])

    return df.mapInArrow(run, schema)


def encode_steps(df: DataFrame, id_col: str, text_col: str, make_encoder, step: float) -> DataFrame:
    """id_col, dense: the same vectors alone, of whole texts, as doubles in steps of ``step``; an encoder's dense_matrix is used where it has one."""
    schema = T.StructType([df.schema[id_col], T.StructField("dense", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        matrix = getattr(encoder, "dense_matrix", None) or (lambda texts: np.array([d for d, _ in encoder(texts, None)]))
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                fine = np.floor(matrix(part.column(1).fill_null("").to_pylist()).astype(np.float32).astype(np.float64) / step + 0.5) * step
                ends = pa.array(np.arange(len(part) + 1) * fine.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(fine.reshape(-1)))], names=[id_col, "dense"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def postings(encoded: DataFrame, id_col: str = "row_id") -> DataFrame:
    """row_id, token, weight from the sparse maps."""
    return encoded.select(F.col(id_col), F.explode("sparse").alias("token", "weight")).withColumn("weight", F.col("weight").cast("double"))


#: What stands between words, as the SQL's regular expressions see it; Python's split() also parts at U+00A0, U+2028 and others.
_WORDS = re.compile(r"[^\t\n\f\r ]+")


#: Words whose axis an encoder remembers.
KNOWN_WORDS = 200_000


class HashingEncoder:
    """A stand-in model: term counts as sparse weights, a signed hash projection of them as the dense unit vector.

    Words of opposite sign may cancel out to a zero vector, which scores 0 with every
    other. With ``unit`` such a text gets the axis of its first word, so that every
    text with words has a vector of length 1, as models' embeddings have.
    """

    def __init__(self, dims: int = 64, unit: bool = False) -> None:
        self.dims, self.unit, self.axes = dims, unit, {}

    def dense_matrix(self, texts: list[str]) -> np.ndarray:
        """The vectors of whole texts, row by row."""
        axes, places, sizes = self.axes, [], []
        for text in texts:
            words = _WORDS.findall(text.lower())
            for word in words:
                place = axes.get(word)
                if place is None:
                    h = crc32(word.encode())
                    place = h % self.dims * 2 + (h >> 16 & 1)
                    if len(axes) < KNOWN_WORDS:
                        axes[word] = place
                places.append(place)
            sizes.append(len(words))
        place, row = np.array(places, np.int64), np.repeat(np.arange(len(texts)), sizes)
        dense = np.bincount(row * self.dims + place // 2, weights=place % 2 * 2.0 - 1.0, minlength=len(texts) * self.dims).reshape(len(texts), self.dims)
        if self.unit:
            first = np.cumsum(sizes) - sizes
            zero = np.flatnonzero((np.array(sizes) > 0) & ~dense.any(axis=1))
            dense[zero, place[first[zero]] // 2] = 1.0
        norm = np.sqrt((dense * dense).sum(axis=1, keepdims=True))
        return dense / np.where(norm > 0, norm, 1.0)

    def __call__(self, texts: list[str], max_length: int | None) -> list[tuple[list[float], dict[str, float]]]:
        out = []
        for text in texts:
            counts: dict[str, float] = {}
            for word in _WORDS.findall(text.lower())[:max_length]:
                counts[word] = counts.get(word, 0.0) + 1.0
            dense = [0.0] * self.dims
            for word, n in counts.items():
                h = crc32(word.encode())
                dense[h % self.dims] += n if h >> 16 & 1 else -n
            norm = sum(x * x for x in dense) ** 0.5
            if not norm:
                if self.unit and counts:
                    dense[crc32(next(iter(counts)).encode()) % self.dims] = 1.0
                norm = 1.0
            out.append(([x / norm for x in dense], counts))
        return out
