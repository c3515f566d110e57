import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpusgraph import queries as Q
from corpusgraph.sources import tables as T
from tests.compare import assert_same
from tests.conftest import rows


def graph(spark, n, first=0):
    ids = range(first, first + n)
    triples = spark.createDataFrame([(i, i, f"h{i}", "r", f"t{i}", "") for i in ids], "row_id long, index long, head string, relation string, tail string, text string")
    return {
        "triples": triples,
        "edges": triples.selectExpr("row_id AS edge_id", "head", "tail", "relation", "index AS chunk_index", "text"),
        "vectors": triples.selectExpr("row_id", "array(1.0f) AS dense"),
        "postings": triples.selectExpr("row_id", "head AS token", "1.0D AS weight"),
    }


def test_graph_index_comes_back_and_grows_by_parts(spark, tmp_path):
    folder = f"file://{tmp_path}"
    T.write_index(graph(spark, 3), folder, "graph")
    assert {n: t.count() for n, t in T.read_index(spark, folder, "graph").items()} == {"triples": 3, "edges": 3, "vectors": 3, "postings": 3}
    T.write_index(graph(spark, 2, 3), folder, "graph", add=True)
    assert rows(T.read_index(spark, folder, "graph", ["edges"])["edges"], "edge_id", "head") == [(i, f"h{i}") for i in range(5)]
    T.write_index(graph(spark, 1, 9), folder, "graph")
    assert rows(T.read_index(spark, folder, "graph")["triples"], "row_id") == [(9,)]
    T.write_index(graph(spark, 0), folder, "graph")
    assert T.read_index(spark, folder, "graph")["triples"].count() == 1, "no triples, no new version"


def test_a_broken_write_leaves_the_version_before(spark, tmp_path):
    folder = f"file://{tmp_path}"
    with pytest.raises(FileNotFoundError):
        T.read_index(spark, folder, "hype")
    hype = {"chunks": spark.range(4).selectExpr("id AS index", "'t' AS text"), "vectors": spark.range(4).selectExpr("id AS row_id"), "postings": spark.range(4).selectExpr("id AS row_id", "'a' AS token")}
    T.write_index(hype, folder, "hype")
    before = T.read_index(spark, folder, "hype")
    broken = hype | {"vectors": spark.range(2).selectExpr("raise_error('gone') AS row_id"), "chunks": spark.range(9).selectExpr("id AS index", "'u' AS text")}
    with pytest.raises(Exception, match="gone"):
        T.write_index(broken, folder, "hype")
    assert T.read_index(spark, folder, "hype")["chunks"].count() == before["chunks"].count() == 4


def test_two_writers_take_two_numbers(spark, tmp_path):
    versions = T._Versions(spark, f"file://{tmp_path}", "hype")
    assert versions.put(1, {"chunks": ["a"]}) and not versions.put(1, {"chunks": ["b"]})
    assert versions.last() == (1, {"chunks": ["a"]})


def test_stored_vectors_of_words_that_cancel_out(spark, tmp_path):
    """Two words of opposite sign on one axis, and words that only Unicode's spaces part, are stored as the SQL has them."""
    texts = ["w0 w179", "w0 w179 w179", "a\u00a0b c\u2003d a\x1cb", " \n", "", None]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), f"{tmp_path}/documents.parquet")
    pq.write_table(pa.table({"conv_id": pa.array([1, 1], pa.int64()), "turn": pa.array([0, 1], pa.int64()), "text": texts[:2]}), f"{tmp_path}/conversations.parquet")
    for name in ("stored_index", "encoded_texts"):
        assert_same(Q.queries()[name](spark, str(tmp_path)), str(tmp_path), Q.oracle_sql()[name])
