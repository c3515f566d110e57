"""Registered queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import models as M
from .functions import text as X
from .functions.ranking import top_k_inner_product
from .functions.scratch import Scratch
from .jobs import answer
from .jobs import inputs as I
from .jobs import reports as D
from .operators import align, fuse, graph, layout, pivots, postings, search
from .sources import tables

TOP = 40

# --- blocks and chunks ------------------------------------------------------------------------


def block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return I.blocks(spark, sf_dir).select("doc_id", "block_no", X.keep_text_block(t).alias("keep"), X.is_patent_claim(t).alias("claim"), X.noise_reason(t).alias("reason"))


_STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_COUNT_CN = r"len(regexp_extract_all(t, 'CN\s*\d+'))"
# The patterns and phrases of the block rules and of captions.
RULES_SQL = rf"""
ruled AS (SELECT *, {_STRIPPED} AS t FROM blocks),
judged AS (SELECT *, length(t) >= 50 AND NOT regexp_matches(t, '^\d+$') AS keep,
  regexp_matches(t, '^\s*(\d+[\.、]\s*)?根据权利要求') OR {_COUNT_CN} >= 2 OR contains(substr(t, 1, 30), '权利要求书') AS claim,
  CASE WHEN length(t) < 100 AND contains(lower(t), 'keywords:') THEN 'keywords'
       WHEN length(t) < 100 AND regexp_matches(t, '^\d+(\.\d+)*\s+[A-Za-z一-龥]') THEN 'heading'
       WHEN length(t) < 100 AND starts_with(t, 'Defect band formation in high pressure die casting') THEN 'title'
       WHEN regexp_matches(t, '\[\d+\]\s*[A-Z][a-z]+') THEN 'author'
       WHEN regexp_matches(t, '\d{{4}},\s*\d+(\(\d+\))?:\s*\d+[-–]\s*\d+') THEN 'pages'
       WHEN regexp_matches(t, '《.+?》\s*\.\s*\d{{4}}') THEN 'book'
       WHEN contains(t, '学位论文全文数据库') THEN 'thesis'
       WHEN contains(t, '特种铸造及有色合金') AND contains(t, '期') THEN 'journal'
       WHEN {_COUNT_CN} >= 2 THEN 'patents'
       WHEN regexp_matches(t, '^\s*(\[\d+\]\s*)?(\d+[\.、]\s*)?根据权利要求') THEN 'claim'
       WHEN contains(t, '所述期望缺陷类型包括无缺陷') THEN 'no_defect' END AS reason FROM ruled)"""
CHUNKS_SQL = rf"""
good AS (SELECT j.* FROM judged j WHERE keep AND NOT claim AND reason IS NULL AND NOT EXISTS (
  SELECT 1 FROM page_tables p WHERE p.source_file = j.source_file AND p.page = j.page AND length(regexp_replace(markdown, '^\s+|\s+$', '', 'g')) > 20
  AND least(j.x1, p.x1) > greatest(j.x0, p.x0) AND least(j.y1, p.y1) > greatest(j.y0, p.y0)
  AND (least(j.x1, p.x1) - greatest(j.x0, p.x0)) * (least(j.y1, p.y1) - greatest(j.y0, p.y0)) / ((j.x1 - j.x0) * (j.y1 - j.y0) + 1e-6) > 0.5)),
flat AS (SELECT source_file, page, block_no, trim(regexp_replace(t, '\s+', ' ', 'g')) AS c FROM good),
cut AS (SELECT source_file, page, block_no, c, unnest(range(0, CAST(greatest(0, ceil((length(c) - 400) / 350.0)) AS BIGINT) + 1)) AS piece FROM flat WHERE length(c) > 0),
text_chunks AS (SELECT * FROM (SELECT source_file, page, block_no, CAST(piece AS INTEGER) AS piece, regexp_replace(substr(c, piece * 350 + 1, 400), '^\s+|\s+$', '', 'g') AS text FROM cut) WHERE text <> '')"""


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = layout.text_chunks(I.blocks(spark, sf_dir), I.page_tables(spark, sf_dir))
    return got.select("source_file", "page", F.col("no").alias("block_no"), "piece", "text")


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract_captions(I.page_text(spark, sf_dir))


CAPTIONS_SQL = r"""
found AS (SELECT source_file, page, regexp_extract_all(raw_text, '((?:Fig(?:ure)?\.?|图)\s*\d+[\.:\s][^\n\r]+(?:\n[^\n\r]+)?)', 1, 'i') AS f FROM page_text),
captions AS (SELECT source_file, page, CAST(i AS INTEGER) AS ordinal, trim(regexp_replace(f[i], '\s+', ' ', 'g')) AS caption FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM found)),
figures AS (SELECT 'figure' AS modality, coalesce(caption, 'illustration on the page' || i.page) AS text, i.source_file, i.page, regexp_replace(i.source_file, '\.[^.]+$', '') AS fileid,
  regexp_replace(i.source_file, '\.[^.]+$', '') || '_page' || i.page || '_fig' || (figure_index + 1) || '.' || ext AS figure_save_path, figure_index
  FROM page_images i LEFT JOIN captions c ON c.source_file = i.source_file AND c.page = i.page AND ordinal = figure_index + 1 WHERE width >= 150 AND height >= 150 AND n_bytes >= 5000)"""


def figure_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.figure_chunks(I.page_images(spark, sf_dir), I.page_text(spark, sf_dir)).drop("no", "piece")


def layout_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = I.page_tables(spark, sf_dir)
    figures = layout.figure_chunks(I.page_images(spark, sf_dir), I.page_text(spark, sf_dir))
    return layout.assemble_chunks(layout.table_chunks(tables), figures, layout.text_chunks(I.blocks(spark, sf_dir), tables))


ASSEMBLE_SQL = r"""
parts AS (
  SELECT 1 AS media, 1 AS kind, 'table' AS modality, markdown AS text, source_file, page, regexp_replace(source_file, '\.[^.]+$', '') AS fileid, NULL AS figure_save_path, 0 AS no, 0 AS piece FROM page_tables WHERE length(regexp_replace(markdown, '^\s+|\s+$', '', 'g')) > 20
  UNION ALL SELECT 1, 2, modality, text, source_file, page, fileid, figure_save_path, figure_index, 0 FROM figures
  UNION ALL SELECT 0, 3, 'text', text, source_file, page, regexp_replace(source_file, '\.[^.]+$', ''), NULL, block_no, piece FROM text_chunks)
SELECT modality, text, source_file, page, fileid, figure_save_path, row_number() OVER (ORDER BY media, source_file, page, kind, no, piece, text) - 1 AS "index" FROM parts"""

# --- model steps with stand-in models ----------------------------------------------------------


def _stub_table():
    return lambda row: f"  table of {len(row['_prompt'])} letters " if len(row["_prompt"]) % 3 else " "


def _stub_figure():
    def reply(row):
        if len(row["_prompt"]) % 2:
            raise ValueError("no answer")
        return f"figure {len(row['_prompt'])}"

    return reply


def _media(spark, sf_dir):
    media = layout.table_chunks(I.page_tables(spark, sf_dir)).unionByName(layout.figure_chunks(I.page_images(spark, sf_dir), I.page_text(spark, sf_dir))).drop("piece")
    return media.withColumn("bytes", F.encode("text", "UTF-8")).withColumn("ext", F.lit("jpg"))


def described_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.route_by_modality(_media(spark, sf_dir), _stub_table, _stub_figure).select("modality", "source_file", "page", "no", "text")


def figure_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a figure's image is sent as; the page's html stands for the image, in three formats."""
    p = I.table(spark, sf_dir, "pages")
    ext = F.when(F.col("page_id") % 3 == 0, "jpg").when(F.col("page_id") % 3 == 1, "PNG").otherwise("webp")
    uri = M.figure_uri(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), ext)
    return p.select("page_id", F.md5(uri).alias("uri"), F.length(uri).cast("long").alias("letters"))


def _no_model():
    def reply(row):
        raise ConnectionError("no model")

    return reply


def described_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The descriptions of a second run that has no model: every reply comes from the first run's store."""
    scratch = Scratch(spark, "replies")
    store = f"{scratch.root}/replies"
    M.route_by_modality(_media(spark, sf_dir), _stub_table, _stub_figure, store=store)
    return M.route_by_modality(_media(spark, sf_dir), _no_model, _no_model, store=store).select("modality", "source_file", "page", "no", "text")


_T, _F = len(M.TABLE_PROMPT), len(M.FIGURE_PROMPT)
DESCRIBED_SQL = rf"""
SELECT 'table' AS modality, source_file, page, 0 AS no, CASE WHEN (length(markdown) + {_T}) % 3 > 0 THEN 'table of ' || (length(markdown) + {_T}) || ' letters' ELSE markdown END AS text FROM page_tables WHERE length(regexp_replace(markdown, '^\s+|\s+$', '', 'g')) > 20
UNION ALL SELECT 'figure', source_file, page, figure_index, CASE WHEN (length(text) + {_F}) % 2 = 0 THEN 'figure ' || (length(text) + {_F}) ELSE text END FROM figures"""


def parsed_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made of the events' JSON; one in five is broken, one in seven lacks a field."""
    e = I.table(spark, sf_dir, "events")
    n, kind, user = F.col("event_id"), F.col("event_type"), F.col("user_id").cast("string")
    whole = F.concat(F.lit('{"triples":[{"head":"'), kind, F.lit('","relation":"by","tail":"'), user, F.lit('"},{"head":"'), user, F.lit('","relation":"has","tail":"'), F.when(n % 3 == 0, user).otherwise("key"), F.lit('"}]}'))
    reply = F.when(n % 5 == 0, '{"triples":').when(n % 7 == 0, F.concat(F.lit('{"triples":[{"head":"'), kind, F.lit('","tail":"x"}]}'))).otherwise(whole)
    found = M.parse_triples(e.select(n.alias("index"), F.lit("t").alias("text"), reply.alias("reply")))
    return align.drop_empty_and_loops(found).select("index", "pos", "head", "relation", "tail")


PARSED_SQL = """
SELECT event_id AS "index", pos::INTEGER AS pos, CASE pos WHEN 0 THEN event_type ELSE user_id::VARCHAR END AS head, CASE pos WHEN 0 THEN 'by' ELSE 'has' END AS relation, CASE pos WHEN 0 THEN user_id::VARCHAR ELSE 'key' END AS tail
FROM events, range(2) t(pos) WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND (pos = 0 OR event_id % 3 <> 0)"""


def index_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text to encode for every conversation turn, with none, one or two questions."""
    c = I.table(spark, sf_dir, "conversations")
    reply = F.when(F.col("turn") % 3 == 0, "broken").when(F.col("turn") % 3 == 1, '{"questions":["who"]}').otherwise('{"questions":["who","why"]}')
    return c.select("conv_id", "turn", M.index_text(F.col("text"), M.parse_questions(reply)).alias("t"))


INDEX_TEXT_SQL = r"""
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN '[prompt question]:' || chr(10) || '1.who' || chr(10) ELSE '[prompt question]:' || chr(10) || '1.who' || chr(10) || '2.why' || chr(10) END || '[text]:' || text || chr(10) AS t FROM conversations"""


def _encoder():
    return M.HashingEncoder()


def _unit_encoder():
    return M.HashingEncoder(unit=True)


def encoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    e = M.encode(rows, "text", _unit_encoder, None)
    total = F.aggregate(F.map_values("sparse"), F.lit(0.0), lambda a, x: a + x)
    norm = F.aggregate("dense", F.lit(0.0), lambda a, x: a + x * x)
    return e.select("conv_id", "turn", F.size("sparse").alias("tokens"), total.cast("long").alias("words"), F.round(norm, 3).alias("norm"))


# --- alignment ---------------------------------------------------------------------------------

_VOCAB = "vec_id < 48"


def aligned_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = I.table(spark, sf_dir, "embeddings")
    vocab = v.filter(_VOCAB).select(F.col("vec_id").cast("int").alias("ord"), F.concat(F.lit("name"), F.col("vec_id").cast("string")).alias("name"), F.col("embedding").alias("vec"))
    mentions = v.select(F.concat(F.lit("mention"), F.col("vec_id").cast("string")).alias("mention"), F.col("embedding").alias("vec"))
    got = align.align_entities(mentions, vocab, 0.3)
    return got.select("mention", "aligned", F.round("score", 6).alias("score"), "ord")


ALIGNED_SQL = """
aligned AS (SELECT mention, CASE WHEN score >= 0.3 THEN 'name' || ord ELSE mention END AS aligned, round(score, 6) AS score, ord FROM (
  SELECT 'mention' || m.vec_id AS mention, v.vec_id::INTEGER AS ord, list_inner_product(m.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY m.vec_id ORDER BY list_inner_product(m.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS r
  FROM embeddings m, embeddings v WHERE v.vec_id < 48) WHERE r = 1)"""


def alignment_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases: every vector is expected to fall to the first vocabulary vector of its label.

    The vocabulary is the first 48 vectors, as many as the vocabulary of entities has names.
    """
    v = I.table(spark, sf_dir, "embeddings")
    first = v.filter(_VOCAB).groupBy("label").agg(F.min("vec_id").alias("f"))
    name = F.when(F.col("vec_id") % 10 == 3, F.concat(F.lit("mention"), F.col("vec_id").cast("string"))).otherwise(F.concat(F.lit("name"), F.col("f").cast("string")))
    cases = v.join(F.broadcast(first), "label").select(F.col("vec_id").alias("ord"), F.concat(F.lit("mention"), F.col("vec_id").cast("string")).alias("raw"), name.alias("expected"))
    canon = cases.filter("ord < 20").select(F.col("raw").alias("name"))
    return align.evaluate_alignment(cases, aligned_vectors(spark, sf_dir), canon)


def alignment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = align.alignment_report(alignment_cases(spark, sf_dir))
    return got.select("kind", "status", "cases", F.round("percent", 6).alias("percent"))


CASES_SQL = """
cases AS (SELECT vec_id AS ord, 'mention' || vec_id AS raw, CASE WHEN vec_id % 10 = 3 THEN 'mention' || vec_id ELSE 'name' || f END AS expected FROM embeddings JOIN (SELECT label, min(vec_id) AS f FROM embeddings WHERE vec_id < 48 GROUP BY label) USING (label)),
kinds AS (SELECT c.*, a.aligned AS actual, CASE WHEN c.ord < 20 THEN 'canonical' WHEN raw = expected THEN 'negative' ELSE 'variant' END AS kind FROM cases c JOIN aligned a ON a.mention = raw),
evaluated AS (SELECT ord, raw, expected, actual, kind, CASE WHEN actual = expected THEN CASE kind WHEN 'canonical' THEN 'canonical_hit' WHEN 'negative' THEN 'rejection_hit' ELSE 'aligned_hit' END
  WHEN kind = 'canonical' THEN 'canonical_drift' WHEN kind = 'negative' THEN 'false_positive' WHEN actual = raw THEN 'missed' ELSE 'mismatched' END AS status FROM kinds)"""


def mapped_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples with entities and relations of even length cut to three letters: the effect of an alignment on whole tables."""
    raw = I.raw_triples(spark, sf_dir)
    heads, rels = align.distinct_mentions(raw)
    mapped = lambda m: m.select("mention", F.when(F.length("mention") % 2 == 0, F.substring("mention", 1, 3)).otherwise(F.col("mention")).alias("aligned"))
    out = align.drop_empty_and_loops(align.apply_alignment(raw, mapped(heads), mapped(rels)))
    return graph.build_edges(out).select("edge_id", "head", "tail", "relation", "chunk_index")


MAPPED_SQL = """
up AS (SELECT triple_no AS edge_id, CASE WHEN length(head) % 2 = 0 THEN substr(head, 1, 3) ELSE head END AS head, CASE WHEN length(tail) % 2 = 0 THEN substr(tail, 1, 3) ELSE tail END AS tail, CASE WHEN length(relation) % 2 = 0 THEN substr(relation, 1, 3) ELSE relation END AS relation, "index" AS chunk_index FROM raw_triples)
SELECT * FROM up WHERE head <> tail"""


def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads, rels = align.distinct_mentions(I.raw_triples(spark, sf_dir))
    return heads.withColumn("kind", F.lit("entity")).unionByName(rels.withColumn("kind", F.lit("relation")))


def triple_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triple_table(I.raw_triples(spark, sf_dir))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_nodes(graph.build_edges(I.raw_triples(spark, sf_dir)))


# --- retrieval ---------------------------------------------------------------------------------


def _dense(spark, sf_dir):
    """The dense hits of every question over all documents, encoded whole."""
    scratch = Scratch(spark, "vectors")
    docs = I.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id")
    vectors = scratch.save(I.encoded(docs, "row_id", "text", _encoder), "documents")
    return search.dense_top_k(scratch.save(I.encoded(I.questions(spark, sf_dir), "query_id", "query", _encoder), "questions"), vectors, 2 * TOP)


def dense_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _dense(spark, sf_dir)
    return hits.select("query_id", "row_id", F.round("score", 6).alias("score"), "rank")


def pivot_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense hits once more, from vectors stored in groups around pivots, of which only those are read whose bound reaches the floor."""
    scratch = Scratch(spark, "pivot-hits")
    docs = I.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id")
    index = pivots.group_vectors(scratch.save(I.encoded(docs, "row_id", "text", _encoder), "documents"), scratch)
    hits = pivots.search_groups(I.encoded(I.questions(spark, sf_dir), "query_id", "query", _encoder), index, 2 * TOP, scratch).hits
    return hits.select("query_id", "row_id", F.round("score", 6).alias("score"), "rank")


def _sparse(spark, sf_dir):
    words = I.term_counts(I.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id"), "row_id", "text")
    return search.sparse_top_k(I.term_counts(I.questions(spark, sf_dir), "query_id", "query"), words, 2 * TOP)


def sparse_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir).select("query_id", "row_id", "score", "rank")


def block_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse hits once more, from postings in blocks, of which only those are scored whose bound reaches the floor."""
    scratch = Scratch(spark, "block-hits")
    docs = I.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id")
    index = postings.block_postings(I.term_counts(docs, "row_id", "text"), scratch)
    return postings.search_blocks(I.term_counts(I.questions(spark, sf_dir), "query_id", "query"), index, 2 * TOP, scratch).hits.select("query_id", "row_id", "score", "rank")


def _hybrid(spark, sf_dir):
    return search.hybrid_search(_dense(spark, sf_dir), _sparse(spark, sf_dir), TOP)


def hybrid_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).select("query_id", "chunk_index", *[F.round(c, 6).alias(c) for c in ("score", "dense_score", "sparse_score")], "rank")


def _graph_parts(spark, sf_dir):
    """Triples, edges and the triples nearest to each question, and where to save tables: triples are made and encoded once."""
    scratch = Scratch(spark, "graph")
    triples, vectors = encoded_triples(spark, sf_dir, scratch, text=False)
    hits = top_k_inner_product(I.encoded(I.questions(spark, sf_dir), "query_id", "query", _encoder), vectors, 20)
    return triples, graph.build_edges(scratch.read("raw")), scratch.save(hits, "hits"), scratch


def named_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.build_edges(I.raw_triples(spark, sf_dir))
    return graph.match_nodes(I.questions(spark, sf_dir), graph.graph_nodes(edges))


def expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels of expansion from the dense seeds: per question and chunk, contributions and their sum."""
    triples, edges, hits, scratch = _graph_parts(spark, sf_dir)
    seeds = graph.seed_nodes_dense(graph.seed_edges(hits, triples)).select("query_id", "node", "score", F.array(F.lit(0).cast("long"), F.col("seen")).alias("path"))
    stored = graph.store_adjacency(edges, scratch)
    return graph.level_sums(graph.expansion_levels(seeds, stored, scratch=scratch), stored).withColumn("w", F.round("w", 4))


def graph_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples, edges, hits, scratch = _graph_parts(spark, sf_dir)
    got = graph.graph_search(hits, I.questions(spark, sf_dir), triples, edges, TOP, chains=False, scratch=scratch)
    return got.select("query_id", "chunk_index", F.round("score", 6).alias("score"), "rank")


def fused_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of the dense and the sparse list."""
    lists = {"dense": _dense(spark, sf_dir).withColumnRenamed("row_id", "chunk_index"), "sparse": _sparse(spark, sf_dir).withColumnRenamed("row_id", "chunk_index")}
    got = fuse.rrf(lists, TOP)
    return got.select("query_id", "chunk_index", F.round("rrf_score", 8).alias("rrf_score"), "dense_rank", "sparse_rank", "rank")


def _length_scorer():
    return lambda queries, texts: [-abs(len(t) - 1000.0) for t in texts]


def _reranked(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), "text")
    pairs = graph.attach_chunk(_hybrid(spark, sf_dir).select("query_id", "chunk_index", "rank"), docs).join(I.questions(spark, sf_dir), "query_id").filter("text is not null")
    return fuse.rerank(pairs, _length_scorer, TOP // 2)


def reranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select("query_id", "chunk_index", "rerank_score", "rank")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fuse.answer_prompts(fuse.build_context(_reranked(spark, sf_dir)), I.questions(spark, sf_dir))
    return made.select("query_id", F.md5("prompt").alias("prompt"), F.length("prompt").alias("letters"))


def chain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many reasoning chains each of the best chunks has."""
    triples, edges, hits, scratch = _graph_parts(spark, sf_dir)
    found = graph.search_graph(hits, I.questions(spark, sf_dir), triples, edges, TOP, scratch=scratch)
    told = found.told.join(found.hits, ["query_id", "chunk_index"], "left_semi")
    return told.groupBy("query_id", "chunk_index").agg(F.count("*").cast("int").alias("chains"))


def encoded_triples(spark: SparkSession, sf_dir: str, scratch: Scratch | None = None, text: bool = True) -> tuple[DataFrame, DataFrame]:
    """The triple table, and a vector of every triple; without ``text`` the triples go without their lines, which no search reads."""
    raw = I.raw_triples(spark, sf_dir) if text else I.raw_triples(spark, sf_dir).drop("text")
    triples = graph.triple_table(scratch.save(raw, "raw") if scratch else raw)
    told = triples.select("row_id", M.triple_text(F.col("head"), F.col("relation"), F.col("tail")).alias("t"))
    vectors = I.encoded(told, "row_id", "t", _encoder)
    return triples, scratch.save(vectors, "triple_vectors") if scratch else vectors


def _indexes(spark: SparkSession, sf_dir: str, scratch: Scratch, text: bool = True) -> tuple[DataFrame, dict[str, DataFrame], dict[str, DataFrame]]:
    """Encoded questions and the tables of both indexes, so that every document and every triple is a dense candidate."""
    asked, docs = I.questions(spark, sf_dir), I.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id")
    words = I.term_counts(asked, "query_id", "query").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias("sparse"))
    asked = asked.join(I.encoded(asked, "query_id", "query", _encoder), "query_id").join(words, "query_id", "left")
    hype = {"vectors": scratch.save(I.encoded(docs, "row_id", "text", _encoder), "document_vectors"), "postings": I.term_counts(docs, "row_id", "text"), "chunks": docs.select(F.col("row_id").alias("index"), "text")}
    triples, vectors = encoded_triples(spark, sf_dir, scratch, text)
    return asked, hype, {"triples": triples, "edges": graph.build_edges(scratch.read("raw")), "vectors": vectors}


def _found(asked: DataFrame, hype: dict, triples: dict, scratch: Scratch) -> DataFrame:
    found = answer.retrieve(asked, hype, triples, _length_scorer, scratch=scratch)
    return found.select("query_id", "chunk_index", F.round("rrf_score", 8).alias("rrf_score"), "graph_rank", "hype_rank", "rerank_score", "rank")


def encoded_retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both searches, fusion and reranking for every question."""
    scratch = Scratch(spark, "encoded-retrieved")
    return _found(*_indexes(spark, sf_dir, scratch, text=False), scratch)


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from stored indexes: both are written, read back by their folder alone, and searched."""
    scratch = Scratch(spark, "retrieved")
    asked, hype, triples = _indexes(spark, sf_dir, scratch)
    folder = f"{scratch.root}/index"
    tables.write_index(hype, folder, "hype")
    tables.write_index(triples, folder, "graph")
    return _found(asked, tables.read_index(spark, folder, "hype"), tables.read_index(spark, folder, "graph"), scratch)


NODES_SQL = "nodes AS (SELECT node, min(first_seen) AS first_seen FROM (SELECT head AS node, 2 * edge_id AS first_seen FROM edges UNION ALL SELECT tail, 2 * edge_id + 1 FROM edges) GROUP BY node)"
NAMED_SQL = r"""
cand AS (SELECT DISTINCT query_id, query, substr(lower(query), i, n) AS piece FROM q, (SELECT DISTINCT length(trim(node)) AS n FROM nodes WHERE length(trim(node)) >= 2) l, range(1, 1000) t(i) WHERE i + n - 1 <= length(query)),
named AS (SELECT DISTINCT query_id, node, first_seen FROM cand JOIN nodes ON piece = lower(node) WHERE length(node) >= 2 AND CASE WHEN regexp_matches(node, '[a-zA-Z]')
  THEN regexp_matches(query, '(?i)(^|[^\p{L}\p{M}\p{N}_])' || regexp_replace(node, '([^\p{L}\p{N}_])', '\\\1', 'g') || '($|[^\p{L}\p{M}\p{N}_])') AND regexp_matches(node, '^[\p{L}\p{N}_](.*[\p{L}\p{N}_])?$') ELSE contains(query, node) END)"""
SEEDS_SQL = """
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM dense_all) WHERE rank <= 20),
seed_e AS (SELECT query_id, head, tail, relation, "index" AS chunk_index, score, min(rank) AS rank FROM hits JOIN triples USING (row_id) GROUP BY ALL),
seed_d AS (SELECT query_id, node, greatest(0.0, max(score)) AS score, min(seen) AS seen FROM (SELECT query_id, head AS node, score, 2 * rank AS seen FROM seed_e UNION ALL SELECT query_id, tail, score, 2 * rank + 1 FROM seed_e) GROUP BY ALL)"""
EXPAND_SQL = """
pair AS (SELECT *, min(edge_id) OVER (PARTITION BY head, tail) AS grp FROM edges),
adj AS (SELECT head AS node, tail AS nbr, 0::BIGINT AS dir, grp, edge_id, chunk_index, relation FROM pair UNION ALL SELECT tail, head, 1, grp, edge_id, chunk_index, relation FROM pair),
c1 AS (SELECT s.query_id, s.node, a.nbr, a.dir, a.relation, a.chunk_index, 1 AS hop, s.score * 0.82::DOUBLE AS w, list_concat(s.path, [a.dir, a.grp, a.edge_id]) AS path FROM seeds s JOIN adj a ON a.node = s.node),
b1 AS (SELECT c1.*, greatest(coalesce(s.score, 0.0), coalesce(max(w) OVER (PARTITION BY c1.query_id, nbr ORDER BY c1.path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS before FROM c1 LEFT JOIN seeds s ON s.query_id = c1.query_id AND s.node = nbr),
c2 AS (SELECT b.query_id, a.node, a.nbr, a.dir, a.relation, a.chunk_index, 2 AS hop, b.w * 0.82::DOUBLE AS w, list_concat(b.path, [a.dir, a.grp, a.edge_id]) AS path FROM b1 b JOIN adj a ON a.node = b.nbr WHERE b.w > b.before),
contrib AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2)"""
CHAINS_SQL = """
told AS (SELECT query_id, chunk_index, [-1::BIGINT, rank::BIGINT] AS o, 'SeedTriple: (' || head || ') -[' || relation || ']-> (' || tail || ') [score=' || printf('%.3f', score) || ']' AS chain FROM seed_e
  UNION ALL SELECT query_id, chunk_index, list_concat([hop::BIGINT], path), CASE WHEN dir = 0 THEN 'Out: (' || node || ') -[' || relation || ']-> (' || nbr ELSE 'In: (' || nbr || ') -[' || relation || ']-> (' || node END || ') [hop=' || hop || ', score=' || printf('%.3f', w) || ']' FROM contrib)
SELECT query_id, chunk_index, (row_number() OVER (PARTITION BY query_id, chunk_index ORDER BY o, chain) - 1)::INTEGER AS pos, chain FROM told JOIN by_graph USING (query_id, chunk_index)"""


# --- reports -----------------------------------------------------------------------------------


def report_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = D.run_header(I.reports(spark, sf_dir))
    return h.select("run_key", "run_information.run_id", "material_information.polymer_type", "mesh_information.element_count", "process_settings.packing_time_s", "process_settings.mold_temperature_C", "process_settings.cycle_time_s")


def report_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.stage_stats(I.reports(spark, sf_dir)).select("run_key", "stage", "field", F.round("max", 6).alias("max"), "min", "unit")


def _runs(spark, sf_dir):
    r = Scratch(spark, "reports").save(I.reports(spark, sf_dir), "made")
    return D.run_summary(D.run_header(r), D.stage_stats(r))


def report_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _runs(spark, sf_dir)
    stats = ("actual_filling_time_s", "warpage_mm", "mold_temp_diff", "packing_gate_freeze", "max_sprue_pressure_MPa", "max_clamping_force_ton", "residual_stress")
    return s.select("run_key", *[F.round(c, 6).alias(c) for c in stats], "packing_time_s", "gate_freeze_time_s", "part_weight_g", "runner_weight_g", "volume_filled_percent")


def report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.stats_pivot(D.stage_stats(I.reports(spark, sf_dir)))
    return p.select("run_key", *[F.coalesce(F.size(s), F.lit(0)).alias(s) for s in D.STAGES], F.round(F.try_element_at("warpage", F.lit("TotalDisplacement"))["max"], 6).alias("warpage_max"))


def report_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every stage of the nested view."""
    p = D.stats_pivot(D.stage_stats(I.reports(spark, sf_dir)))
    cells = F.flatten(F.array(*[F.coalesce(F.transform(F.map_entries(stage), lambda e: F.struct(F.lit(stage).alias("stage"), e["key"].alias("field"), e["value"].alias("v"))), F.array()) for stage in D.STAGES]))
    return p.select("run_key", F.inline(cells)).select("run_key", "stage", "field", F.round("v.max", 6).alias("max"), "v.min", "v.avg", "v.unit")


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.diagnose(_runs(spark, sf_dir))
    c = "hard_constraints"
    return d.select(
        "run_key", "is_converged", F.round("current_warpage_mm", 6).alias("current_warpage_mm"), F.col(f"{c}.packing_time_s_min").isNotNull().alias("has_min"), F.col(f"{c}.packing_time_s_max").isNotNull().alias("has_max"),
        F.coalesce(f"{c}.packing_time_s_min", f"{c}.packing_time_s_max").alias("bound"), F.col(f"{c}.mold_temperature_action").alias("action"), F.col("active_causal_paths")[0].substr(2, 4).alias("gate"), F.size(f"{c}.target_mold_temp_range_C").alias("n_interval"),
    )


def diagnosis_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and report text of every run, word for word."""
    d = D.diagnose(_runs(spark, sf_dir))
    return d.select("run_key", F.col("active_causal_paths")[0].alias("gate"), F.col("active_causal_paths")[1].alias("heat"), F.col("llm_prompt_context").alias("context"))


def undiagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.undiagnosed(_runs(spark, sf_dir))


DIAGNOSES_SQL = """
f AS (SELECT *, coalesce(nullif(header_freeze, 0), nullif(freeze_s, 0)) AS fz, coalesce(stress, 0) > 10 AND coalesce(dt, 0) > 20 AS hot FROM runs WHERE warpage IS NOT NULL),
b AS (SELECT *, fz IS NOT NULL AND packing_time_s < fz AS blocked FROM f),
judged AS (SELECT *, warpage <= 0.3::DOUBLE AS is_converged, round(CASE WHEN blocked THEN fz * 1.05::DOUBLE ELSE fz * 1.2::DOUBLE END, 1) AS bound FROM b)"""
DIAGNOSED_SQL = """
SELECT run_key, is_converged, round(warpage, 6) AS current_warpage_mm, blocked AS has_min, NOT blocked AND fz IS NOT NULL AS has_max, bound,
  CASE WHEN hot THEN 'INCREASE' ELSE 'MAINTAIN' END AS action, CASE WHEN blocked THEN '因果阻断' ELSE '保压有效' END AS gate, CASE WHEN hot THEN 2 END AS n_interval FROM judged"""
# The wording of the findings, as in the reports.
DIAGNOSIS_TEXT_SQL = """
said AS (SELECT *, CASE WHEN blocked THEN '【因果阻断】保压时间(' || n(packing_time_s) || 's) < 浇口冻结时间(' || n(fz) || 's)。浇口未封闭即撤压，引发熔体倒流，导致型腔严重失压与体积收缩不均！' ELSE '【保压有效】保压时间已覆盖浇口冻结，补缩通道正常。' END AS gate,
  CASE WHEN hot THEN '【热应力主导】动定模温差达 ' || n(dt) || '℃，诱发了高达 ' || n(stress) || ' MPa 的热残余应力，为翘曲的第一致因！优先消除温差而非盲目加大压力。' ELSE '【比容收缩主导】模温场基本平衡，翘曲主要受体积收缩各向异性控制。' END AS heat FROM judged)
SELECT run_key, gate, heat, chr(10) || '=== CAUSAL DIAGNOSIS & ACTION BOUNDS ===' || chr(10) || '- 状态判定: ' || CASE WHEN is_converged THEN '【已收敛 / PASS】' ELSE '【未达标 / NEED OPTIMIZATION】' END || chr(10) || '- 当前实际翘曲量: ' || n(warpage) || ' mm (设计目标: <= 0.3 mm)' || chr(10) || '- 物理瓶颈因果链:' || chr(10) || '  * ' || gate || ' ' || heat || chr(10) || chr(10)
  || '[PHYSICAL HARD CONSTRAINTS] (大模型严禁违背的可行域边界):' || chr(10) || '1. 保压时间 (Packing Time): 必须设定为 >= ' || CASE WHEN blocked THEN bound::DOUBLE::VARCHAR ELSE n(packing_time_s) END || ' 秒' || chr(10) || '2. 模具温度 (Mold Temperature): 策略为 ' || CASE WHEN hot THEN 'INCREASE' ELSE 'MAINTAIN' END || ' (建议设定区间: ' || CASE WHEN hot THEN '[70.0, 75.0]' ELSE '[60]' END || ' ℃)' || chr(10) || '========================================' || chr(10) AS context FROM said"""


def _spelled(sql: str) -> str:
    """n(x) in the SQL: a number without its decimal point where it is whole."""
    return re.sub(r"\bn\((\w+)\)", r"(CASE WHEN \1 = floor(\1) THEN \1::BIGINT::VARCHAR ELSE \1::DOUBLE::VARCHAR END)", sql)


# --- stored tables -----------------------------------------------------------------------------


def stored_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all suppliers written as files, one each, and read back: every field of their headers."""
    folder = f"{Scratch(spark, 'reports').root}/files"
    I.supplier_reports(spark, sf_dir).repartition("key").write.partitionBy("key").text(folder)
    found = tables.read_reports(spark, f"{folder}/*/*").withColumn("path", F.regexp_extract("path", r"key=(\d+)/", 1))
    header = D.run_header(found)
    names = [name for name, _, _ in I.HEADER_FIELDS] + [f"{name}_raw" for name, _, number in I.HEADER_FIELDS if number]
    return header.select("run_key", *[F.col(n).alias(n.split(".")[1]) for n in names])


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout tables written and read back, then cut into chunks."""
    folder = f"{Scratch(spark, 'layout').root}/tables"
    made = {"page_text": I.page_text, "blocks": I.blocks, "page_tables": I.page_tables, "page_images": I.page_images}
    for name, table in made.items():
        table(spark, sf_dir).write.parquet(f"{folder}/{name}")
    read = tables.read_layout(spark, folder)
    text = layout.text_chunks(read["blocks"], read["page_tables"]).select("modality", "source_file", "page", "no", "piece", "text")
    return text.unionByName(layout.figure_chunks(read["page_images"], read["page_text"]).select(text.columns))


def stored_vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and relations written as JSON files and read back; of relations the map of regions to nations, each with a phrase that several own."""
    folder = Scratch(spark, "vocabularies").root
    n, r = I.table(spark, sf_dir, "nation"), I.table(spark, sf_dir, "region")
    names = n.agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    names.select(F.to_json(F.transform("ns", lambda x: x["n_name"]))).write.text(f"{folder}/entities")
    owned = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    phrases = F.concat(F.transform("ns", lambda x: F.lower(x["n_name"])), F.array(F.lit("shared phrase")))
    ordered = owned.agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name", phrases.alias("p")))).alias("all"))
    vocabulary = align.relation_vocabulary(ordered.select(F.map_from_entries(F.transform("all", lambda x: F.struct(x["r_name"].alias("key"), x["p"].alias("value")))).alias("relations")))
    pairs = vocabulary.agg(F.array_sort(F.collect_list(F.struct("ord", "phrase", "canonical"))).alias("all"))
    pairs.select(F.to_json(F.map_from_entries(F.transform("all", lambda x: F.struct(x["phrase"].alias("key"), x["canonical"].alias("value")))))).write.text(f"{folder}/relations")
    entities = tables.read_entities(spark, f"{folder}/entities/*.txt").select(F.lit("entity").alias("kind"), "ord", "name", F.lit(None).cast("string").alias("canonical"))
    return entities.unionByName(tables.read_relations(spark, f"{folder}/relations/*.txt").select(F.lit("relation").alias("kind"), "ord", F.col("phrase").alias("name"), "canonical"))


VOCABULARIES_SQL = """
owned AS (SELECT r_regionkey AS c, r_name AS canonical, lower(n_name) AS phrase, n_nationkey AS p FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey, r_name, 'shared phrase', 1000 FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY c, p) AS r FROM owned)
SELECT 'entity' AS kind, (row_number() OVER (ORDER BY n_nationkey, n_name) - 1)::INTEGER AS ord, n_name AS name, NULL AS canonical FROM nation
UNION ALL SELECT 'relation', (row_number() OVER (ORDER BY c, p) - 1)::INTEGER, phrase, canonical FROM firsts WHERE r = 1"""


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents written and read back: per document its text, its tokens and the length of its vector."""
    folder = Scratch(spark, "index").root
    docs = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), "text")
    encoded = M.encode(docs.select(F.col("index").alias("row_id"), "text"), "text", _unit_encoder, None).drop("text")
    tables.write_index({"chunks": docs, "vectors": encoded.select("row_id", "dense"), "postings": M.postings(encoded)}, folder, "hype")
    read = tables.read_index(spark, folder, "hype")
    words = read["postings"].groupBy("row_id").agg(F.count("*").alias("tokens"), F.sum("weight").cast("long").alias("words"))
    norm = F.round(F.aggregate("dense", F.lit(0.0), lambda a, x: a + x * x), 3)
    joined = read["chunks"].join(read["vectors"], F.col("index") == F.col("row_id")).drop("row_id").join(words, F.col("index") == F.col("row_id"), "left")
    return joined.select("index", F.md5("text").alias("text"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("words", F.lit(0)).alias("words"), norm.alias("norm"))


STORED_INDEX_SQL = r"""
SELECT doc_id AS "index", md5(text) AS text, len(list_distinct(w)) AS tokens, len(w) AS words, CASE WHEN len(w) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm
FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents)"""


# Mentions are single words, so each has one dimension; phrases have up to two.
NEAREST_SQL = rf"""
items AS (SELECT * FROM (SELECT item_id::INTEGER AS ord, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) >= 2),
vocab AS (SELECT 'entity' AS kind, ord, w[1] AS name, [lower(w[1])] AS tokens FROM items UNION ALL SELECT 'relation', ord, w[1], [lower(w[1]), lower(w[2])] FROM items),
vtok AS (SELECT kind, ord, unnest(tokens) AS token FROM vocab),
ments AS (SELECT head AS mention, 'entity' AS kind FROM facts UNION SELECT tail, 'entity' FROM facts UNION SELECT relation, 'relation' FROM facts),
word_hash AS (SELECT token, {I._CRC} AS h FROM (SELECT token FROM vtok UNION SELECT lower(mention) FROM ments)),
signs AS (SELECT token, (h % 64)::INTEGER AS d, CASE WHEN (h >> 16) & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM word_hash),
v_dense AS (SELECT kind, ord, d, (s / sqrt(sum(s * s) OVER (PARTITION BY kind, ord)))::FLOAT::DOUBLE AS x FROM (SELECT kind, ord, d, sum(s) AS s FROM vtok JOIN signs USING (token) GROUP BY ALL) WHERE s <> 0),
scored_names AS (SELECT m.kind, m.mention, v.ord, v.name, coalesce(e.x * g.s, 0.0::DOUBLE) AS score FROM ments m JOIN signs g ON g.token = lower(m.mention) JOIN vocab v ON v.kind = m.kind LEFT JOIN v_dense e ON e.kind = v.kind AND e.ord = v.ord AND e.d = g.d),
nearest AS (SELECT kind, mention, CASE WHEN score >= CASE kind WHEN 'entity' THEN 0.525 ELSE 0.55 END THEN name ELSE mention END AS aligned, ord, score FROM (SELECT *, row_number() OVER (PARTITION BY kind, mention ORDER BY score DESC, ord) AS r FROM scored_names) WHERE r = 1)"""
BUILT_SQL = """
asked AS (SELECT doc_id, text, (length(text) + {extra}) % 3 AS questions FROM documents WHERE text IS NOT NULL),
facts AS (SELECT r.*, row_number() OVER (ORDER BY "index", triple_no) - 1 AS no FROM raw_triples r JOIN asked ON doc_id = "index" WHERE length(asked.text) % 9 <> 0)"""
BUILT_GRAPH_SQL = """
mapped AS (SELECT no, "index", h.aligned AS head, l.aligned AS relation, t.aligned AS tail FROM facts f JOIN nearest h ON h.kind = 'entity' AND h.mention = head JOIN nearest t ON t.kind = 'entity' AND t.mention = tail JOIN nearest l ON l.kind = 'relation' AND l.mention = relation WHERE h.aligned <> t.aligned)
SELECT row_number() OVER (ORDER BY "index", no) - 1 AS row_id, "index", head, relation, tail, md5(text) AS text, questions::INTEGER AS questions, count(*) OVER (PARTITION BY "index") AS edges FROM mapped JOIN asked ON mapped."index" = doc_id"""


# --- whole jobs --------------------------------------------------------------------------------


def _fact_generator():
    """A stand-in model: a document's facts are its lines' first, middle and last words; every ninth reply is broken."""

    def reply(row):
        text = row["prompt"].split("\n", 1)[1]
        if len(text) % 9 == 0:
            return '{"triples": ['
        words = [re.findall(r"\S+", line, re.ASCII) for line in text.split("\n")]
        facts = [{"head": w[0], "relation": w[(len(w) - 1) // 2], "tail": w[-1]} for w in words if len(w) >= 3]
        return json.dumps({"triples": facts})

    return reply


def _question_generator():
    return lambda row: json.dumps({"questions": [f"what is in {len(row['_prompt'])} letters", "why"][: len(row["_prompt"]) % 3]})


def _one_generator():
    facts, questions = _fact_generator(), _question_generator()
    return lambda row: facts(row) if "prompt" in row else questions(row)


def _vocabularies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entity names: the first words of the benchmark's items; relation phrases: their first two words, which mean the first."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    items = I.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("ord"), words.alias("w")).filter(F.size("w") >= 2)
    entities = items.select("ord", F.col("w")[0].alias("name"))
    relations = items.select("ord", F.concat_ws(" ", F.col("w")[0], F.col("w")[1]).alias("phrase"), F.col("w")[0].alias("canonical"))
    return align.encoded_vocabulary(entities, "name", _encoder, None), align.encoded_vocabulary(relations, "phrase", _encoder, None)


def aligned_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities and relations of the lines, encoded and aligned to the vocabularies."""
    scratch = Scratch(spark, "mentions")
    entities, relations = (scratch.save(v, n) for v, n in zip(_vocabularies(spark, sf_dir), ("entities", "relations"), strict=True))
    heads, rels = align.distinct_mentions(I.raw_triples(spark, sf_dir))
    vec = lambda m, name: scratch.save(I.encoded(m, "mention", "mention", _encoder).withColumnRenamed("dense", "vec"), name)
    e = align.align_entities(vec(heads, "heads"), entities).withColumn("kind", F.lit("entity"))
    r = align.align_relations(vec(rels, "rels"), relations).withColumn("kind", F.lit("relation"))
    return e.unionByName(r).select("kind", "mention", "aligned", "ord", F.round("score", 4).alias("score"))


def built_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index built over all documents with stand-in models: the triples of its graph."""
    scratch = Scratch(spark, "built")
    entities, relations = _vocabularies(spark, sf_dir)
    chunks = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), "text").filter("text is not null")
    made = answer.build_index(chunks, _one_generator, _encoder, scratch.save(entities, "entities"), scratch.save(relations, "relations"), scratch.save)
    edges = made["graph"]["edges"].select("edge_id", F.col("chunk_index").alias("index"))
    # A text becomes its digest where it meets its triples, so that no later join moves it.
    triples = made["graph"]["triples"].withColumn("text", F.md5("text")).join(made["graph"]["vectors"], "row_id")
    asked = made["hype"]["chunks"].select("index", F.size("questions").alias("questions"))
    per_chunk = edges.groupBy("index").agg(F.count("*").alias("edges"))
    return triples.join(asked, "index").join(per_chunk, "index").select("row_id", "index", "head", "relation", "tail", "text", "questions", "edges")


def _answer_generator():
    def reply(row):
        if len(row["prompt"]) % 5 == 0:
            raise ValueError("no answer")
        return f"{len(row['prompt'])} letters"

    return reply


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from the reranked chunks of every question; null where the generator failed."""
    return answer.answer(I.questions(spark, sf_dir), _reranked(spark, sf_dir), _answer_generator)


def chain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reasoning chains of the best chunks in their order, each spelled out."""
    triples, edges, hits, scratch = _graph_parts(spark, sf_dir)
    found = graph.search_graph(hits, I.questions(spark, sf_dir), triples, edges, TOP, scratch=scratch)
    return graph.chain_rows(found.told, found.hits, scratch)


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def queries() -> dict:
    return {
        "block_rules": block_rules,
        "text_chunks": text_chunks,
        "captions": captions,
        "figure_chunks": figure_chunks,
        "layout_chunks": layout_chunks,
        "described_chunks": described_chunks,
        "described_again": described_again,
        "figure_uris": figure_uris,
        "parsed_triples": parsed_triples,
        "index_texts": index_texts,
        "encoded_texts": encoded_pages,
        "aligned_vectors": aligned_vectors,
        "alignment_cases": alignment_cases,
        "alignment_report": alignment_report,
        "mention_counts": mention_counts,
        "mapped_triples": mapped_triples,
        "triple_rows": triple_rows,
        "graph_nodes": graph_nodes,
        "dense_hits": dense_hits,
        "pivot_hits": pivot_hits,
        "sparse_hits": sparse_hits,
        "block_hits": block_hits,
        "hybrid_hits": hybrid_hits,
        "named_nodes": named_nodes,
        "expansion": expansion,
        "graph_hits": graph_hits,
        "chain_counts": chain_counts,
        "fused_hits": fused_hits,
        "retrieved": retrieved,
        "encoded_retrieved": encoded_retrieved,
        "reranked_hits": reranked_hits,
        "prompts": prompts,
        "report_headers": report_headers,
        "report_stats": report_stats,
        "report_summaries": report_summaries,
        "report_pivot": report_pivot,
        "report_values": report_values,
        "diagnoses": diagnoses,
        "undiagnosed": undiagnosed,
        "diagnosis_texts": diagnosis_texts,
        "stored_reports": stored_reports,
        "stored_chunks": stored_chunks,
        "stored_vocabularies": stored_vocabularies,
        "stored_index": stored_index,
        "aligned_mentions": aligned_mentions,
        "built_graph": built_graph,
        "answers": answers,
        "chain_texts": chain_texts,
    }


# The wording of the question.
_PROMPTS_SQL = "p AS (SELECT query_id, 'Answer the question: ' || query || chr(10) || 'Here the retrived chunks:' || chr(10) || coalesce(c, '') || chr(10) || 'Output in markdown format' || chr(10) AS prompt FROM q LEFT JOIN (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY r) AS c FROM rr GROUP BY query_id) USING (query_id))"
_RERANK_SQL = "rr AS (SELECT * FROM (SELECT query_id, chunk_index, text, -abs(length(text) - 1000.0::DOUBLE) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY -abs(length(text) - 1000.0::DOUBLE) DESC, rank) AS r FROM hybrid JOIN documents ON doc_id = chunk_index WHERE text IS NOT NULL) WHERE r <= 20)"


def _graph_sql(n: int) -> list[str]:
    """Graph search with n dense seeds a question."""
    return [
        I.TRIPLES_SQL,
        NODES_SQL,
        I.SEARCH_SQL,
        SEEDS_SQL.replace("rank <= 20", f"rank <= {n}"),
        NAMED_SQL,
        "seeds AS (SELECT coalesce(d.query_id, n.query_id) AS query_id, coalesce(d.node, n.node) AS node, CASE WHEN n.node IS NULL THEN score ELSE greatest(coalesce(score, 0.0), 0.8::DOUBLE) + 0.2::DOUBLE END AS score, CASE WHEN d.node IS NULL THEN [1::BIGINT, first_seen::BIGINT] ELSE [0::BIGINT, seen::BIGINT] END AS path FROM seed_d d FULL JOIN named n ON n.query_id = d.query_id AND n.node = d.node)",
        EXPAND_SQL,
        "given AS (SELECT query_id, chunk_index, w FROM contrib UNION ALL SELECT query_id, chunk_index, score FROM seed_e), scored AS (SELECT query_id, chunk_index, round(max(w) + 0.1::DOUBLE * (sum(w) - max(w)), 9) AS score FROM given GROUP BY ALL)",
        "by_graph AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index) AS rank FROM scored) WHERE rank <= 40)",
    ]


def _encoded(parts: list[str]) -> list[str]:
    """The same over encoded documents and triples."""
    return [{I.SEARCH_SQL: I.ENCODED_SQL}.get(part, part.replace("FROM dense_all", "FROM triple_all")) for part in parts]


def _encoded_graph_sql(n: int) -> list[str]:
    return _encoded(_graph_sql(n))


def oracle_sql() -> dict:
    blocks = [I.LINES_SQL, RULES_SQL]
    chunks = [*blocks, CHUNKS_SQL]
    pages = [I.PAGES_SQL, CAPTIONS_SQL]
    found = [I.TRIPLES_SQL, NODES_SQL, I.SPARSE_SQL]
    seeds = _encoded([I.TRIPLES_SQL, NODES_SQL, I.SEARCH_SQL, SEEDS_SQL])
    sql = {
        "block_rules": _with(*blocks) + " SELECT doc_id, block_no, keep, claim, reason FROM judged",
        "text_chunks": _with(*chunks) + " SELECT * FROM text_chunks",
        "captions": _with(*pages) + " SELECT * FROM captions",
        "figure_chunks": _with(*pages) + " SELECT modality, text, source_file, page, fileid, figure_save_path FROM figures",
        "layout_chunks": _with(*chunks, *pages, ASSEMBLE_SQL),
        "described_chunks": _with(I.LINES_SQL, *pages) + DESCRIBED_SQL,
        "parsed_triples": PARSED_SQL,
        "index_texts": INDEX_TEXT_SQL,
        "encoded_texts": r"SELECT conv_id, turn, len(list_distinct(w))::INTEGER AS tokens, len(w) AS words, CASE WHEN len(w) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM conversations)",
        "aligned_vectors": _with(ALIGNED_SQL) + " SELECT * FROM aligned",
        "alignment_cases": _with(ALIGNED_SQL, CASES_SQL) + " SELECT * FROM evaluated",
        "alignment_report": _with(ALIGNED_SQL, CASES_SQL) + " SELECT kind, status, count(*) AS cases, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY kind), 6) AS percent FROM evaluated GROUP BY kind, status UNION ALL SELECT NULL, NULL, count(*), round(100.0 * count(*) FILTER (status LIKE '%\\_hit' ESCAPE '\\') / count(*), 6) FROM evaluated",
        "mention_counts": _with(I.TRIPLES_SQL) + " SELECT head AS mention, 'entity' AS kind FROM raw_triples UNION SELECT tail, 'entity' FROM raw_triples UNION SELECT relation, 'relation' FROM raw_triples",
        "mapped_triples": _with(I.TRIPLES_SQL, MAPPED_SQL),
        "triple_rows": _with(I.TRIPLES_SQL) + " SELECT * FROM triples",
        "graph_nodes": _with(I.TRIPLES_SQL, NODES_SQL) + " SELECT * FROM nodes",
        "dense_hits": _with(I.ENCODED_DOCUMENTS_SQL) + " SELECT query_id, row_id, round(score, 6) AS score, rank::INTEGER AS rank FROM dense",
        "sparse_hits": _with(I.SPARSE_SQL) + " SELECT query_id, row_id, score, rank::INTEGER AS rank FROM sparse",
        "block_hits": _with(I.SPARSE_SQL) + " SELECT query_id, row_id, score, rank::INTEGER AS rank FROM sparse",
        "hybrid_hits": _with(I.ENCODED_DOCUMENTS_SQL) + " SELECT query_id, chunk_index, round(score, 6) AS score, round(dense_score, 6) AS dense_score, round(sparse_score, 6) AS sparse_score, rank::INTEGER AS rank FROM hybrid",
        "named_nodes": _with(*found, NAMED_SQL) + " SELECT * FROM named",
        "expansion": _with(*seeds, "seeds AS (SELECT query_id, node, score, [0::BIGINT, seen::BIGINT] AS path FROM seed_d)", EXPAND_SQL) + " SELECT query_id, chunk_index, hop, count(*) AS n, round(sum(w), 4) AS w FROM contrib GROUP BY ALL",
        "graph_hits": _with(*_encoded_graph_sql(20)) + " SELECT query_id, chunk_index, round(score, 6) AS score, rank::INTEGER AS rank FROM by_graph",
        "chain_counts": _with(*_encoded_graph_sql(20)) + " SELECT query_id, chunk_index, count(*)::INTEGER AS chains FROM given JOIN by_graph USING (query_id, chunk_index) GROUP BY ALL",
        "encoded_retrieved": _with(
            *_encoded_graph_sql(80),
            "ranked AS (SELECT query_id, chunk_index, rank, 0 AS o FROM by_graph UNION ALL SELECT query_id, chunk_index, rank, 1 FROM hybrid), fused AS (SELECT query_id, chunk_index, sum(1.0::DOUBLE / (100 + rank)) AS rrf_score, min(rank) FILTER (o = 0)::INTEGER AS graph_rank, min(rank) FILTER (o = 1)::INTEGER AS hype_rank, min(o * 1000 + rank) AS f FROM ranked GROUP BY ALL)",
            "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, f, chunk_index) AS r FROM fused) WHERE r <= 40)",
            "again AS (SELECT b.*, -abs(length(coalesce(text, '')) - 1000.0::DOUBLE) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY -abs(length(coalesce(text, '')) - 1000.0::DOUBLE) DESC, r) AS rank FROM best b LEFT JOIN documents ON doc_id = chunk_index)",
        )
        + " SELECT query_id, chunk_index, round(rrf_score, 8) AS rrf_score, graph_rank, hype_rank, rerank_score, rank::INTEGER AS rank FROM again WHERE rank <= 20",
        "fused_hits": _with(
            I.ENCODED_DOCUMENTS_SQL,
            "ranked AS (SELECT query_id, row_id AS chunk_index, rank, 0 AS o FROM dense UNION ALL SELECT query_id, row_id, rank, 1 FROM sparse), fused AS (SELECT query_id, chunk_index, sum(1.0::DOUBLE / (100 + rank)) AS rrf_score, min(rank) FILTER (o = 0)::INTEGER AS dense_rank, min(rank) FILTER (o = 1)::INTEGER AS sparse_rank, min(o * 1000 + rank) AS f FROM ranked GROUP BY ALL)",
        )
        + " SELECT query_id, chunk_index, round(rrf_score, 8) AS rrf_score, dense_rank, sparse_rank, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, f, chunk_index) AS rank FROM fused) WHERE rank <= 40",
        "reranked_hits": _with(I.ENCODED_DOCUMENTS_SQL, _RERANK_SQL) + " SELECT query_id, chunk_index, rerank_score, r::INTEGER AS rank FROM rr",
        "prompts": _with(I.ENCODED_DOCUMENTS_SQL, _RERANK_SQL, _PROMPTS_SQL) + " SELECT query_id, md5(prompt) AS prompt, length(prompt)::INTEGER AS letters FROM p",
        "report_headers": "SELECT o_orderkey::VARCHAR AS run_key, 'Run' || o_orderkey AS run_id, o_orderstatus AS polymer_type, 1000.0::DOUBLE AS element_count, o_orderkey % 9 / 2 AS packing_time_s, 60.0::DOUBLE AS \"mold_temperature_C\", NULL::DOUBLE AS cycle_time_s FROM orders",
        "report_stats": _with(I.REPORTS_SQL) + " SELECT k::VARCHAR AS run_key, stage, field, round(m, 6) AS max, least AS min, 'mm' AS unit FROM last_nodes",
        "report_summaries": _with(I.REPORTS_SQL) + ' SELECT run_key, round(fill_s, 6) AS actual_filling_time_s, round(warpage, 6) AS warpage_mm, round(dt, 6) AS mold_temp_diff, round(freeze_s, 6) AS packing_gate_freeze, round(sprue, 6) AS "max_sprue_pressure_MPa", round(clamp, 6) AS max_clamping_force_ton, round(stress, 6) AS residual_stress, packing_time_s, header_freeze AS gate_freeze_time_s, part_weight AS part_weight_g, runner_weight AS runner_weight_g, 100.0::DOUBLE AS volume_filled_percent FROM runs',
        "report_pivot": _with(I.REPORTS_SQL) + " SELECT k::VARCHAR AS run_key, (count(*) FILTER (stage = 'filling'))::INTEGER AS filling, (count(*) FILTER (stage = 'packing'))::INTEGER AS packing, (count(*) FILTER (stage = 'cooling'))::INTEGER AS cooling, (count(*) FILTER (stage = 'warpage'))::INTEGER AS warpage, round(max(m) FILTER (field = 'TotalDisplacement'), 6) AS warpage_max FROM last_nodes GROUP BY k",
        "report_values": _with(I.REPORTS_SQL) + " SELECT k::VARCHAR AS run_key, stage, field, round(m, 6) AS max, least AS min, NULL::DOUBLE AS avg, 'mm' AS unit FROM last_nodes",
        "figure_uris": "SELECT page_id, md5(uri) AS uri, length(uri) AS letters FROM (SELECT page_id, 'data:image/' || CASE page_id % 3 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' ELSE 'webp' END || ';base64,' || to_base64(encode(coalesce(html, ''))) AS uri FROM pages)",
        "diagnoses": _with(I.REPORTS_SQL, DIAGNOSES_SQL) + DIAGNOSED_SQL,
        "diagnosis_texts": _with(I.REPORTS_SQL, DIAGNOSES_SQL, _spelled(DIAGNOSIS_TEXT_SQL)),
        "stored_reports": I.HEADERS_SQL,
        "stored_chunks": _with(*chunks, *pages) + " SELECT 'text' AS modality, source_file, page, block_no AS no, piece, text FROM text_chunks UNION ALL SELECT modality, source_file, page, figure_index, 0, text FROM figures",
        "stored_vocabularies": _with(VOCABULARIES_SQL),
        "stored_index": STORED_INDEX_SQL,
        "aligned_mentions": _with(I.TRIPLES_SQL, "facts AS (SELECT * FROM raw_triples)", NEAREST_SQL) + " SELECT kind, mention, aligned, ord, round(score, 4) AS score FROM nearest",
        "built_graph": _with(I.TRIPLES_SQL, BUILT_SQL.format(extra=len(M.questions_prompt(2))), NEAREST_SQL, BUILT_GRAPH_SQL),
        "answers": _with(I.ENCODED_DOCUMENTS_SQL, _RERANK_SQL, _PROMPTS_SQL) + " SELECT query_id, CASE WHEN length(prompt) % 5 > 0 THEN chr(10) || 'ANWSER:' || chr(10) || length(prompt) || ' letters' END AS answer, CASE WHEN length(prompt) % 5 = 0 THEN 'ValueError: no answer' END AS error FROM p",
        "chain_texts": _with(*_encoded_graph_sql(20), CHAINS_SQL),
        "undiagnosed": _with(I.REPORTS_SQL) + " SELECT run_key, 'no warpage' AS reason FROM runs WHERE warpage IS NULL",
    }
    return sql | {"retrieved": sql["encoded_retrieved"], "pivot_hits": sql["dense_hits"], "described_again": sql["described_chunks"]}
