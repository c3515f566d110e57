"""Layout, triple, vector and report tables derived from the driver's tables.

The driver's texts hold no captions, citations or tables, so these are set in
front of the lines by arithmetic on ids; the SQL of the queries does the same.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import encode_steps
from .reports import HEADER

DECORATIONS = {
    0: "concat('[12] Smith ', line)",
    1: "concat('2009, 60(3): 1432-1441 ', line)",
    2: "concat('CN 1234 CN 5678 ', line)",
    3: "concat('1. 根据权利要求 ', line)",
    4: "concat('Keywords: ', substr(line, 1, 60))",
    5: "concat('3.1 Results ', substr(line, 1, 50))",
    6: "concat('《书》. 2019 ', line)",
    7: "concat('学位论文全文数据库 ', line)",
    8: "concat('特种铸造及有色合金 第3期 ', line)",
    9: "concat('所述期望缺陷类型包括无缺陷', line)",
    10: "repeat('1', 60)",
    11: "concat('权利要求书 ', line)",
}
DECORATE = "CASE (doc_id * 7 + block_no) % 32 " + " ".join(f"WHEN {k} THEN {v}" for k, v in DECORATIONS.items()) + " ELSE line END"

LINES_SQL = f"""
lines AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS block_no, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
blocks AS (SELECT 'doc' || doc_id || '.pdf' AS source_file, CAST(block_no // 20 + 1 AS INTEGER) AS page, CAST(block_no AS INTEGER) AS block_no, doc_id,
  CAST(block_no * 10 % 50 AS DOUBLE) AS x0, CAST(block_no % 20 * 20 AS DOUBLE) AS y0, CAST(block_no * 10 % 50 + 100 + block_no % 7 * 10 AS DOUBLE) AS x1, CAST(block_no % 20 * 20 + 15 AS DOUBLE) AS y1, {DECORATE} AS text FROM lines),
page_tables AS (SELECT 'doc' || doc_id || '.pdf' AS source_file, 1 AS page, 0 AS table_no, 0.0::DOUBLE AS x0, 30.0::DOUBLE AS y0, 120.0::DOUBLE AS x1, CAST(30 + doc_id % 5 * 20 AS DOUBLE) AS y1, CASE WHEN doc_id % 8 = 0 THEN '| a | b |' ELSE '| a | b |' || chr(10) || text END AS markdown FROM documents WHERE text IS NOT NULL)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file() -> Column:
    return F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, block_no, line of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "line"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("block_no")
    x0, y0 = (n * 10 % 50).cast("double"), (n % 20 * 20).cast("double")
    return lines(spark, sf_dir).select(_file().alias("source_file"), (F.floor(n / 20) + 1).cast("int").alias("page"), "block_no", "doc_id", x0.alias("x0"), y0.alias("y0"), (x0 + 100 + n % 7 * 10).alias("x1"), (y0 + 15).alias("y1"), F.expr(DECORATE).alias("text"))


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    markdown = F.when(F.col("doc_id") % 8 == 0, "| a | b |").otherwise(F.concat(F.lit("| a | b |\n"), "text"))
    box = [F.lit(0.0).alias("x0"), F.lit(30.0).alias("y0"), F.lit(120.0).alias("x1"), (30 + F.col("doc_id") % 5 * 20).cast("double").alias("y1")]
    return docs.select(_file().alias("source_file"), F.lit(1).alias("page"), F.lit(0).alias("table_no"), *box, markdown.alias("markdown"))


PAGES_SQL = r"""
page_text AS (SELECT 'p' || page_id || '.pdf' AS source_file, 1 AS page, 'intro ' || page_id || chr(10) || 'Figure 7. first ' || chr(9) || ' caption ' || coalesce(url, '') || chr(10) || 'second line' || chr(10) || chr(10) || coalesce(html, '') || chr(10) || chr(10) || 'fig 2: small' || chr(10) || chr(10) || '图 3 说明' || (page_id % 5) AS raw_text FROM pages),
page_images AS (SELECT 'p' || page_id || '.pdf' AS source_file, 1 AS page, CAST(i AS INTEGER) AS figure_index, CAST(100 + page_id % 3 * 60 + i * 10 AS INTEGER) AS width, CAST(140 + i * 20 AS INTEGER) AS height, 4000 + length(coalesce(html, '')) % 3000 AS n_bytes, 'png' AS ext FROM pages, range(4) t(i))"""


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id").cast("string")
    given = lambda c: F.coalesce(F.col(c), F.lit(""))
    raw = F.concat(F.lit("intro "), p, F.lit("\nFigure 7. first \t caption "), given("url"), F.lit("\nsecond line\n\n"), given("html"), F.lit("\n\nfig 2: small\n\n图 3 说明"), (F.col("page_id") % 5).cast("string"))
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), p, F.lit(".pdf")).alias("source_file"), F.lit(1).alias("page"), raw.alias("raw_text"))


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, p = F.col("figure_index"), F.col("page_id")
    rows = table(spark, sf_dir, "pages").select("page_id", F.length(F.coalesce("html", F.lit(""))).alias("size"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("figure_index"))
    return rows.select(F.concat(F.lit("p"), p.cast("string"), F.lit(".pdf")).alias("source_file"), F.lit(1).alias("page"), "figure_index", (100 + p % 3 * 60 + i * 10).cast("int").alias("width"), (140 + i * 20).cast("int").alias("height"), (4000 + F.col("size") % 3000).cast("long").alias("n_bytes"), F.lit("png").alias("ext"))


TRIPLES_SQL = r"""
words AS (SELECT doc_id, i - 1 AS block_no, list_filter(regexp_split_to_array(parts[i], '\s+'), lambda w: w <> '') AS w, parts[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
raw_triples AS (SELECT doc_id * 16777216 + block_no AS triple_no, doc_id AS "index", w[1] AS head, w[(len(w) + 1) // 2] AS relation, w[-1] AS tail, line AS text FROM words WHERE len(w) >= 3 AND w[1] <> w[-1]),
edges AS (SELECT triple_no AS edge_id, head, tail, relation, "index" AS chunk_index, text FROM raw_triples),
triples AS (SELECT CAST(row_number() OVER (ORDER BY "index", triple_no) - 1 AS BIGINT) AS row_id, "index", head, relation, tail, text FROM raw_triples)"""


#: A document's lines are numbered from its id times this, so that numbers of lines differ.
LINES = 1 << 24


def raw_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first, middle and last word of every line of three words or more whose ends differ, with the whole line."""
    words = F.filter(F.split("line", r"\s+"), lambda w: w != "")
    rows = lines(spark, sf_dir).select("doc_id", "block_no", "line", words.alias("w")).filter(F.size("w") >= 3)
    middle = F.floor((F.size("w") + 1) / 2).cast("int")
    cells = [F.try_element_at("w", i).alias(c) for i, c in ((F.lit(1), "head"), (middle, "relation"), (F.lit(-1), "tail"))]
    return rows.select((F.col("doc_id") * LINES + F.col("block_no")).alias("triple_no"), F.col("doc_id").alias("index"), *cells, F.col("line").alias("text")).filter("head <> tail")


#: Parts of a search; dense_all (query_id, row_id, score) is what encoded texts give.
SEARCH_SQL = r"""
q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM dense_all) WHERE rank <= 80),
post AS (SELECT doc_id AS row_id, token, count(*)::DOUBLE AS weight FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS token FROM documents) WHERE token <> '' GROUP BY ALL),
qpost AS (SELECT query_id, token, count(*)::DOUBLE AS weight FROM (SELECT query_id, unnest(regexp_split_to_array(lower(query), '\s+')) AS token FROM q) WHERE token <> '' GROUP BY ALL),
sparse_all AS (SELECT query_id, row_id, sum(post.weight * qpost.weight) AS score FROM post JOIN qpost USING (token) GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM sparse_all) WHERE rank <= 80 AND score > 0),
hybrid_all AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.row_id, s.row_id) AS chunk_index, coalesce(d.score, 0) AS dense_score, coalesce(s.score, 0) AS sparse_score, 0.7::DOUBLE * coalesce(d.score, 0) + (1::DOUBLE - 0.7::DOUBLE) * coalesce(s.score, 0) AS score FROM dense d FULL JOIN sparse s ON d.query_id = s.query_id AND d.row_id = s.row_id),
hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index) AS rank FROM hybrid_all) WHERE rank <= 40)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.col("text").alias("query"))


def encoded(rows: DataFrame, id_col: str, text_col: str, make_encoder) -> DataFrame:
    """id_col, dense: every text encoded whole, in steps of 2^-20: inner products are then exact, so equal ones tie in any order of adding."""
    return encode_steps(rows.select(F.col(id_col), F.col(text_col).alias("_text")), id_col, "_text", make_encoder, 1 / 1048576)


# CRC-32 of a word's UTF-8 bytes, as the stand-in encoder takes it.
_CRC_TABLE = [reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(8), i) for i in range(256)]
_BYTES = "list_transform(range(1, length(hex(token)) // 2 + 1), lambda i: ('0x' || substr(hex(token), 2 * i - 1, 2))::UBIGINT)"
_CRC = f"xor(list_reduce(list_concat([4294967295::UBIGINT], {_BYTES}), lambda c, b: xor(c >> 8, ({_CRC_TABLE}::UBIGINT[])[(xor(c, b) & 255)::INTEGER + 1])), 4294967295::UBIGINT)"


def _dense_sql(name: str, id_col: str, counts: str) -> str:
    """name: id_col, d, x of the encoded texts whose word counts (id_col, token, weight) are in ``counts``."""
    sums = f"SELECT {id_col}, (h % 64)::INTEGER AS d, sum(CASE WHEN (h >> 16) & 1 = 1 THEN weight ELSE -weight END) AS s FROM {counts} JOIN word_hash USING (token) GROUP BY ALL"
    return f"{name} AS (SELECT {id_col}, d, floor((s / sqrt(sum(s * s) OVER (PARTITION BY {id_col})))::FLOAT::DOUBLE * 1048576.0::DOUBLE + 0.5::DOUBLE) / 1048576.0::DOUBLE AS x FROM ({sums}) WHERE s <> 0)"


def _scores_sql(name: str, ids: str, vectors: str) -> str:
    """Every question with every row of ``ids``; a pair without a common dimension scores 0."""
    return f"{name} AS (SELECT query_id, row_id, coalesce(score, 0.0::DOUBLE) AS score FROM (SELECT query_id, row_id FROM q, {ids}) LEFT JOIN (SELECT query_id, row_id, sum(a.x * b.x) AS score FROM q_dense a JOIN {vectors} b USING (d) GROUP BY ALL) USING (query_id, row_id))"


def _search_sql(*names: str) -> list[str]:
    return [part for name in names for part in re.findall(rf"^({name} AS .*?),?$", SEARCH_SQL, re.M)]


SPARSE_SQL = ",".join(_search_sql("q", "post", "qpost", "sparse_all", "sparse"))


def _encoded_sql(triples: bool) -> str:
    """Questions, documents and, where wanted, triples encoded; the counts, the sparse and the hybrid search are those of SEARCH_SQL."""
    more, words = [], "SELECT token FROM post UNION SELECT token FROM qpost"
    if triples:
        more = ["tpost AS (SELECT row_id, token, count(*)::DOUBLE AS weight FROM (SELECT row_id, unnest(regexp_split_to_array(lower('(' || head || ') --[' || relation || ']--> (' || tail || ')'), '\\s+')) AS token FROM triples) WHERE token <> '' GROUP BY ALL)"]
        words += " UNION SELECT token FROM tpost"
    dense = [_dense_sql("q_dense", "query_id", "qpost"), _dense_sql("d_dense", "row_id", "post"), _scores_sql("dense_all", "(SELECT doc_id AS row_id FROM documents)", "d_dense")]
    if triples:
        dense += [_dense_sql("t_dense", "row_id", "tpost"), _scores_sql("triple_all", "(SELECT row_id FROM triples)", "t_dense")]
    return ",".join([*_search_sql("q", "post", "qpost"), *more, f"word_hash AS (SELECT token, {_CRC} AS h FROM ({words}))", *dense, *_search_sql("dense", "sparse_all", "sparse", "hybrid_all", "hybrid")])


ENCODED_SQL, ENCODED_DOCUMENTS_SQL = _encoded_sql(True), _encoded_sql(False)


def term_counts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, token, weight: how often each lower-cased word occurs.

    Texts move once, whole; their words are then counted where they lie.
    """
    tokens = texts.select(id_col, text_col).repartition(id_col).select(F.col(id_col), F.explode(F.split(F.lower(text_col), r"\s+")).alias("token")).filter("token <> ''")
    return tokens.groupBy(id_col, "token").agg(F.count("*").cast("double").alias("weight"))


REPORTS_SQL = r"""
li AS (SELECT l_orderkey AS k, l_linenumber AS ln, l_linenumber % 4 AS n, l_suppkey % 3 AS sup, l_quantity AS qty, l_discount AS disc, l_tax AS tax, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord FROM lineitem),
nodes AS (SELECT k, ord, CASE n WHEN 0 THEN 'cooling' WHEN 1 THEN 'warpage' WHEN 2 THEN 'packing' ELSE 'filling' END AS stage,
  CASE n WHEN 0 THEN 'MoldTemperatureDifference' WHEN 1 THEN CASE WHEN ln = 5 THEN 'ThermallyInducedResidualVonMisesStress' ELSE 'TotalDisplacement' END WHEN 2 THEN 'GateFreezeTime' ELSE CASE sup WHEN 0 THEN 'MeltFrontTime' WHEN 1 THEN 'XY_ClampingForce' ELSE 'XY_SpruePressure' END END AS field,
  CASE n WHEN 0 THEN qty WHEN 1 THEN CASE WHEN ln = 5 THEN qty ELSE disc * 10 END WHEN 2 THEN qty * 0.13::DOUBLE ELSE tax END AS m, CASE WHEN ln % 2 = 1 THEN -1.5::DOUBLE END AS least FROM li),
last_nodes AS (SELECT k, stage, field, m, least FROM (SELECT *, row_number() OVER (PARTITION BY k, stage, field ORDER BY ord DESC) AS back FROM nodes JOIN orders ON o_orderkey = k) WHERE back = 1),
runs AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_key, o_orderkey % 9 / 2 AS packing_time_s, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 11 * 0.37::DOUBLE END AS header_freeze, nullif(o_orderkey % 6, 0)::DOUBLE AS part_weight, (o_orderkey % 7)::DOUBLE AS runner_weight, max(m) FILTER (field = 'TotalDisplacement') AS warpage, max(m) FILTER (field = 'MoldTemperatureDifference') AS dt,
  max(m) FILTER (field = 'GateFreezeTime') AS freeze_s, max(m) FILTER (field = 'MeltFrontTime') AS fill_s, max(m) FILTER (field = 'XY_ClampingForce') AS clamp, max(m) FILTER (field = 'XY_SpruePressure') AS sprue, max(m) FILTER (field = 'ThermallyInducedResidualVonMisesStress') AS stress FROM orders LEFT JOIN last_nodes ON k = o_orderkey GROUP BY o_orderkey)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, raw): a JSON report of every order; its line items are the statistic nodes, in line order.

    By line number a node's largest value stands where a reader looks first, second or
    third, behind values that count as missing.
    """
    ln, n = F.col("l_linenumber"), F.col("l_linenumber") % 4
    filling = F.when(F.col("l_suppkey") % 3 == 0, "Filling_MeltFrontTime").when(F.col("l_suppkey") % 3 == 1, "Filling_XY_ClampingForce").otherwise("Filling_XY_SpruePressure")
    tag = F.when(n == 0, "Cooling_MoldTemperatureDifference").when(ln == 5, "Warpage_ThermallyInducedResidualVonMisesStress").when(n == 1, "Warpage_TotalDisplacement").when(n == 2, "Packing_GateFreezeTime").otherwise(filling)
    quantity = F.col("l_quantity").cast("double")
    most = F.when((n == 0) | (ln == 5), quantity).when(n == 1, F.col("l_discount").cast("double") * 10).when(n == 2, quantity * 0.13).otherwise(F.col("l_tax").cast("double")).cast("string")
    quoted = F.concat(F.lit('"'), most, F.lit('"'))
    value = F.when(ln % 3 == 0, F.concat(F.lit('"Statistics_Max":'), quoted)).when(ln % 3 == 1, F.concat(F.lit('"Statistics_Max":0,"History_Y_YMax":'), quoted)).otherwise(F.concat(F.lit('"Statistics_Max":"","History_Y_YMax":null,"Y_SpecificTime":'), quoted))
    least = F.when(ln % 2 == 1, ',"Statistics_Min":0,"History_Y_YMin":"-1.5"').otherwise("")
    node = F.concat(F.lit('{"Tag":"'), tag, F.lit('",'), value, least, F.lit(',"Unit":" mm "}'))
    nodes = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", node.alias("node")).alias("n")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("n")).alias("ns"))
    orders = table(spark, sf_dir, "orders").join(nodes, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key = F.col("o_orderkey")
    base = F.struct(
        F.concat(F.lit("Run"), key.cast("string")).alias("Value_Run_ID"),
        (key % 9 / 2).cast("string").alias("Value_Process_PackingTime"),
        F.lit("60").alias("Value_Process_MoldTemperature"),
        F.lit(" 1_000 ").alias("Value_Mesh_ElementNumber"),
        F.col("o_orderstatus").alias("Value_Material_PartType"),
        F.when(key % 4 > 0, (key % 11 * 0.37).cast("string")).alias("Value_GateFreezeTime"),
        F.when(key % 6 > 0, (key % 6).cast("string")).otherwise("").alias("Value_Result_TotalPartWeight"),
        (key % 7).cast("string").alias("Value_Result_TotalRunnerWeight"),
    )
    items = F.array_join(F.coalesce(F.transform("ns", lambda x: x["node"]), F.array().cast("array<string>")), ",")
    raw = F.concat(F.lit('{"CBASE":'), F.to_json(base), F.lit(',"Parts":[{"Items":['), items, F.lit("]}]}"))
    return orders.select(key.cast("string").alias("path"), raw.alias("raw"))


#: Header fields in order; what a supplier's report says of field i, by (7 * key + i) % 5: nothing, "", a number, a text, a number in digit groups.
HEADER_FIELDS = [(f"{section}.{field}", key, number) for section, fields in HEADER.items() for field, key, number in fields]


def supplier_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, raw): a JSON report of every supplier with all header fields."""
    k = F.col("s_suppkey")

    def told(i: int) -> Column:
        kind = (7 * k + i) % 5
        return F.when(kind == 1, "").when(kind == 2, (k * i).cast("string")).when(kind == 3, f"text {i}").when(kind == 4, f" 1_{i:03d}.5 ")

    base = F.struct(*[told(i).alias(key) for i, (_, key, _) in enumerate(HEADER_FIELDS)])
    return table(spark, sf_dir, "supplier").select(k.alias("key"), F.to_json(F.struct(base.alias("CBASE"))).alias("raw"))


def _header_sql() -> str:
    cells = ["s_suppkey::VARCHAR AS run_key"]
    for i, (name, _, number) in enumerate(HEADER_FIELDS):
        kind, field = f"(7 * s_suppkey + {i}) % 5", name.split(".")[1]
        text = f"CASE {kind} WHEN 1 THEN '' WHEN 2 THEN (s_suppkey * {i})::VARCHAR WHEN 3 THEN 'text {i}' WHEN 4 THEN ' 1_{i:03d}.5 ' END"
        cells += [f"CASE {kind} WHEN 2 THEN (s_suppkey * {i})::DOUBLE WHEN 4 THEN {1000 + i}.5::DOUBLE END AS \"{field}\"", f"nullif({text}, '') AS \"{field}_raw\""] if number else [f"{text} AS \"{field}\""]
    return "SELECT " + ", ".join(cells) + " FROM supplier"


HEADERS_SQL = _header_sql()
