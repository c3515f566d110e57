import math
import uuid

from pyspark.sql import functions as F

from corpusgraph import queries as Q
from corpusgraph.functions import models as M
from corpusgraph.jobs import answer
from corpusgraph.operators.align import entity_vocabulary
from corpusgraph.sources import tables
from tests.conftest import rows


def test_one_bad_row_does_not_fail_the_job(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id int, prompt string")

    def make():
        def reply(row):
            if row["prompt"] == "bad":
                raise ValueError("no")
            return None if row["prompt"] is None else row["prompt"] * 2

        return reply

    assert rows(M.map_with_fallback(df, ["prompt"], make), "id", "reply", "error") == [(1, "aa", None), (2, None, "ValueError: no"), (3, None, None)]


def test_replies(spark):
    r = spark.createDataFrame([(1, "t", '{"triples":[{"head":"a","relation":"r","tail":"b"},{"head":"c"}]}'), (2, "t", "{broken"), (3, "t", "{}"), (4, "t", None)], "index long, text string, reply string")
    assert rows(M.parse_triples(r), "index", "pos", "head", "relation", "tail") == [(1, 0, "a", "r", "b"), (1, 1, "c", "", "")]
    q = spark.createDataFrame([(1, '{"questions":["x","y"]}'), (2, "?")], "id int, reply string").select("id", M.parse_questions(F.col("reply")).alias("q"))
    assert rows(q) == [(1, ["x", "y"]), (2, [])]
    t = q.select("id", M.index_text(F.lit("T"), F.col("q")).alias("t"))
    assert rows(t) == [(1, "[prompt question]:\n1.x\n2.y\n[text]:T\n"), (2, "[text]:T\n")]


def test_index_and_answers_end_to_end(spark, tmp_path):
    chunks = spark.createDataFrame([(0, "text", "Mold temperature raises shrinkage"), (1, "text", "Pressure lowers warpage")], "index long, modality string, text string")

    def generator():
        def reply(row):
            prompt = row.get("_prompt") or row["prompt"]
            if "JSON" not in prompt:
                return "fine"
            words = prompt.rsplit("\n", 1)[1].lower().split()
            return '{"questions":["what of %s"],"triples":[{"head":"%s","relation":"%s","tail":"%s"}]}' % (words[-1], words[0], words[-2], words[-1])

        return reply

    def encoder():
        return M.HashingEncoder(1024)

    def save(df, name):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    names = entity_vocabulary(spark.createDataFrame([(["mold", "warpage"],)], "names array<string>"))
    entities = M.encode(names, "name", encoder, 32).select("ord", "name", F.col("dense").alias("vec"))
    relations = M.encode(spark.createDataFrame([(0, "raises", "UP")], "ord int, phrase string, canonical string"), "phrase", encoder, 32).select("ord", "phrase", "canonical", F.col("dense").alias("vec"))
    index = answer.build_index(chunks, generator, encoder, entities, relations, save)
    for kind, part in index.items():
        tables.write_index(part, str(tmp_path / "index"), kind)
    hype, graph = (tables.read_index(spark, str(tmp_path / "index"), k) for k in ("hype", "graph"))
    assert rows(graph["edges"], "head", "relation", "tail", "chunk_index") == [("mold", "UP", "shrinkage", 0), ("pressure", "lowers", "warpage", 1)]
    queries = M.encode(spark.createDataFrame([(1, "why mold shrinkage")], "query_id long, query string"), "query", encoder, 64)
    found = answer.retrieve(queries, hype, graph, lambda: lambda q, t: [float("Mold" in x) for x in t], 2)
    top = found.orderBy("rank").collect()
    assert top[0].chunk_index == 0 and top[0].graph_rank == 1
    assert rows(answer.answer(queries, found, generator), "query_id", "answer") == [(1, "\nANWSER:\nfine")]


def test_vocabulary_files_keep_their_order(spark, tmp_path):
    (tmp_path / "e.json").write_text('["B", "A"]')
    (tmp_path / "r.json").write_text('{"z": "R1", "a": "R2"}')
    assert rows(tables.read_entities(spark, str(tmp_path / "e.json"))) == [(0, "B"), (1, "A")]
    assert rows(tables.read_relations(spark, str(tmp_path / "r.json"))) == [(0, "z", "R1"), (1, "a", "R2")]


def test_long_turns_are_encoded_whole(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(3000)) + " w0"
    spark.createDataFrame([(1, 0, "a b a"), (1, 1, long)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows(Q.encoded_pages(spark, str(tmp_path))) == [(1, 0, 2, 3, 1.0), (1, 1, 3000, 3001, 1.0)]


def test_stored_replies_are_asked_once(spark, tmp_path):
    """Equal inputs cost one call, a second run only those that failed or are new; nulls and other columns stay."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def model(run):
        def make():
            def reply(row):
                open(calls / f"{run}-{uuid.uuid4().hex}", "w").close()
                if row["p"] == "bad" and run == 1:
                    raise ValueError("not now")
                return f"{row['p']}/{row['q']}"

            return reply

        return make

    data = [(1, "a", None, "x"), (2, "a", None, "y"), (3, "bad", "q", None), (4, None, "a", "z"), (5, "a", "-", "w")] + [(10 + i, "hot", "q", "x") for i in range(50)]
    df = spark.createDataFrame(data, "n int, p string, q string, error string").repartition(3)
    store = f"file://{tmp_path}/store"
    first = {r.n: (r.reply, r.error) for r in M.map_with_fallback(df, ["p", "q"], model(1), store=store).collect()}
    assert len(first) == len(data) and first[1] == first[2] == ("a/None", None) and first[3] == (None, "ValueError: not now")
    assert first[4] == ("None/a", None) and first[5] == ("a/-", None) and first[59] == ("hot/q", None)
    assert len(list(calls.glob("1-*"))) == 5
    more = df.unionByName(spark.createDataFrame([(99, "new", "q", None)], df.schema))
    second = {r.n: (r.reply, r.error) for r in M.map_with_fallback(more, ["p", "q"], model(2), store=store).collect()}
    assert len(list(calls.glob("2-*"))) == 2
    assert second == first | {3: ("bad/q", None), 99: ("new/q", None)}


def test_triples_are_kept_without_their_chunks_text(spark, tmp_path):
    """A chunk of many triples is written once, not once for each of them, and every triple and edge still has its text."""
    chunks = spark.createDataFrame([(i, f"{i} " + "long text " * 50) for i in range(3)], "index long, text string")
    facts = '{"questions":["q"],"triples":[%s]}' % ",".join('{"head":"h%d","relation":"r","tail":"t"}' % i for i in range(20))
    kept = {}

    def save(df, name):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
        return kept[name]

    entities = M.encode(spark.createDataFrame([(0, "h1")], "ord int, name string"), "name", M.HashingEncoder, 32).select("ord", "name", F.col("dense").alias("vec"))
    relations = M.encode(spark.createDataFrame([(0, "r", "R")], "ord int, phrase string, canonical string"), "phrase", M.HashingEncoder, 32).select("ord", "phrase", "canonical", F.col("dense").alias("vec"))
    index = answer.build_index(chunks, lambda: lambda row: facts, M.HashingEncoder, entities, relations, save)
    assert [name for name, t in kept.items() if "text" in t.columns] == ["asked"]
    for table, key in (("triples", "index"), ("edges", "chunk_index")):
        assert rows(index["graph"][table].groupBy(key, "text").count()) == sorted((r[0], r[1], 20) for r in chunks.collect())


def test_vectors_alone_are_those_of_the_encoder(spark):
    """Encoded by matrix they equal the encoder's lists in steps of 2^-20, bit by bit, empty and cancelling texts too."""
    texts = ["w0 w179", "A b\tc  a", "", None, "é ß x", "one two three four five " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id int, text string")
    for unit in (False, True):
        made = lambda: M.HashingEncoder(unit=unit)  # noqa: E731, B023
        want = {r.row_id: [math.floor(x * 1048576.0 + 0.5) / 1048576.0 for x in r.dense] for r in M.encode(df, "text", made, None).collect()}
        assert {r.row_id: r.dense for r in M.encode_steps(df, "row_id", "text", made, 1 / 1048576).collect()} == want
        assert {r.row_id: r.dense for r in M.encode_steps(df, "row_id", "text", lambda: made().__call__, 1 / 1048576).collect()} == want
