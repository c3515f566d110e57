import random

import pytest

from corpusgraph import queries as Q
from corpusgraph.operators import graph
from tests.conftest import rows

EDGE = "edge_id long, head string, tail string, relation string, chunk_index long, text string"


def walk(edges, seeds, decay, depth):
    """Sequential first-in-first-out expansion."""
    out, best, queue = [], {}, []
    for node, score in seeds:
        best[node] = score
        queue.append((node, score, 0))
    for node, score, d in queue:
        if d >= depth:
            continue
        for side in (0, 1):
            mine = [e for e in edges if e[1 + side] == node]
            first = {}
            for e in sorted(edges):
                first.setdefault((e[1], e[2]), e[0])
            for e in sorted(mine, key=lambda e: (first[e[1], e[2]], e[0])):
                other, w = e[2 - side], score * decay
                out.append((e[4], d + 1, w))
                if w > best.get(other, 0.0):
                    best[other] = w
                    queue.append((other, w, d + 1))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_expansion_equals_a_sequential_walk(spark, seed):
    rng = random.Random(seed)
    nodes = "abcdefg"
    edges = []
    for i in range(16):
        h, t = rng.sample(nodes, 2)
        edges.append((i, h, t, "r", rng.choice([1, 2, 3, None]), ""))
    seeds = [(n, rng.choice([0.5, 0.9, 1.0])) for n in rng.sample(nodes, 3)]
    s = spark.createDataFrame([(1, n, w, [0, i]) for i, (n, w) in enumerate(seeds)], "query_id long, node string, score double, path array<long>")
    got = graph.expand_graph(s, spark.createDataFrame(edges, EDGE), 0.82, 3)
    assert rows(got, "chunk_index", "hop", "w") == sorted(walk(edges, seeds, 0.82, 3), key=repr)


def test_named_nodes(spark):
    names = ["PC", "PC (x)", "a", "模温", "Mold Temp", "olde"]
    nodes = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "node string, first_seen int")
    q = spark.createDataFrame([(1, "does pc (x) raise mold temp? 高模温a"), (2, "nothing")], "query_id long, query string")
    assert [r[1] for r in rows(graph.match_nodes(q, nodes), "query_id", "node")] == ["Mold Temp", "PC", "模温"]


def test_hubs_in_parts_and_no_exchange_over_edges(spark, monkeypatch):
    """A hub's rows are cut into parts, parallel edges each count, and no join moves the stored edges."""
    monkeypatch.setattr(graph, "HUB_EDGES", 3)
    edges = [(i, "hub", f"n{i % 7}", "r", i % 4, "") for i in range(40)] + [(100 + i, f"n{i}", f"n{i + 1}", "r", 9, "") for i in range(6)]
    stored = graph.store_adjacency(spark.createDataFrame(edges, EDGE))
    assert {r.node: r.parts for r in stored.hubs.collect()}["hub"] == 14
    seeds = [("n0", 0.9), ("hub", 0.5)]
    s = spark.createDataFrame([(1, n, w, [0, i]) for i, (n, w) in enumerate(seeds)], "query_id long, node string, score double, path array<long>")
    levels = graph.expansion_levels(s, stored, 0.82, 3)
    told = graph.expanded_edges(levels, stored)
    want = walk(edges, seeds, 0.82, 3)
    assert rows(told, "chunk_index", "hop", "w") == sorted(want, key=repr)
    none = spark.createDataFrame([], "query_id long, chunk_index long, score double")
    totals = {}
    for c, _, w in want:
        totals.setdefault(c, []).append(w)
    assert rows(graph.chunk_scores(none, levels, stored), "chunk_index", "score") == [(c, round(max(w) + 0.1 * (sum(w) - max(w)), 9)) for c, w in sorted(totals.items())]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = graph._meet(levels[0], stored.neighbours, stored)._jdf.queryExecution().executedPlan().toString()
        scan = [line for line in plan.splitlines() if "neighbours" in line or "Bucketed: true" in line]
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(node") == 1, scan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_chains_are_numbered_without_lists(spark):
    told = spark.createDataFrame([(1, 7, 1.0, [1, i], f"c{i}") for i in (5, 1, 3)] + [(1, 8, 1.0, [0], "x"), (2, 7, 1.0, [0], "y")], "query_id long, chunk_index long, w double, path array<long>, chain string")
    hits = spark.createDataFrame([(1, 7), (2, 7)], "query_id long, chunk_index long")
    assert rows(graph.chain_rows(told, hits)) == [(1, 7, 0, "c1"), (1, 7, 1, "c3"), (1, 7, 2, "c5"), (2, 7, 0, "y")]


def test_names_in_several_automata(spark, monkeypatch):
    monkeypatch.setattr(graph, "AUTOMATON_NODES", 2)
    monkeypatch.setattr(graph, "AUTOMATON_QUESTIONS", 1)
    names = ["PC", "pc", "Mold", "old", "模温", "b", "a.b", None]
    nodes = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "node string, first_seen int")
    q = spark.createDataFrame([(1, "PC, mold; 高模温 a.b"), (2, "bold"), (3, None), (4, "")], "query_id long, query string")
    assert rows(graph.match_nodes(q, nodes), "query_id", "node") == [(1, "Mold"), (1, "PC"), (1, "a.b"), (1, "pc"), (1, "模温")]


def test_search_scores_chains_and_stub_chunks(spark):
    edges = spark.createDataFrame([(0, "x", "y", "r", 7, ""), (1, "y", "z", "s", 9, "")], EDGE)
    triples = spark.createDataFrame([(0, 7, "x", "r", "y", ""), (1, 9, "y", "s", "z", "")], "row_id long, index long, head string, relation string, tail string, text string")
    hits = spark.createDataFrame([(1, 0, 0.5, 1)], "query_id long, row_id long, score double, rank int")
    q = spark.createDataFrame([(1, "?")], "query_id long, query string")
    got = graph.graph_search(hits, q, triples, edges, 5)
    top = {r.chunk_index: r for r in got.collect()}
    d1 = 0.5 * 0.82
    assert abs(top[7].score - (0.5 + 0.1 * 2 * d1)) < 1e-8 and abs(top[9].score - (d1 + 0.1 * d1 * 0.82)) < 1e-8
    assert top[7].reasoning_chains[0] == "SeedTriple: (x) -[r]-> (y) [score=0.500]"
    assert top[9].reasoning_chains[0] == "Out: (y) -[s]-> (z) [hop=1, score=0.410]"
    chunks = spark.createDataFrame([(7, "seven")], "index long, text string")
    assert rows(graph.attach_chunk(got, chunks), "chunk_index", "text") == [(7, "seven"), (9, "Out: (y) -[s]-> (z) [hop=1, score=0.410]")]
    assert graph.graph_search(hits.limit(0), q, triples, edges, 5).count() == 0


def test_every_triple_and_document_is_a_dense_candidate(spark, tmp_path):
    tables = {
        "documents": ([(5000, "alpha beta gamma"), (5001, "delta epsilon zeta")], "doc_id long, text string"),
        "benchmark": ([(7000, "an unrelated question")], "item_id long, text string"),
        "embeddings": ([(0, [1.0] * 64)], "vec_id long, embedding array<float>"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    triples, vectors = Q.encoded_triples(spark, str(tmp_path))
    assert rows(vectors, "row_id") == rows(triples, "row_id") == [(0,), (1,)]
    found = Q.encoded_retrieved(spark, str(tmp_path))
    assert rows(found.filter("graph_rank is not null and hype_rank is not null"), "query_id", "chunk_index") == [(7000, 5000), (7000, 5001)]


@pytest.mark.parametrize("k", [None, 3])
def test_sums_in_small_cells_equal_a_sequential_walk(spark, monkeypatch, k):
    """Chunks in several groups, questions in several blocks, pairs in several steps, hubs in parts, equal scores and seed edges of their own."""
    for name, n in (("CELL_CHUNKS", 4), ("CELL_QUESTIONS", 2), ("CELL_PAIRS", 3), ("HUB_EDGES", 5)):
        monkeypatch.setattr(graph, name, n)
    rng = random.Random(5)
    nodes = "abcdefgh"
    edges = [(i, *rng.sample(nodes, 2), "r", rng.choice([*range(100, 120), None]), "") for i in range(60)]
    asked = {q: [(n, rng.choice([0.0, 0.5, 0.9, 1.0])) for n in rng.sample(nodes, 3)] for q in range(7)}
    stored = graph.store_adjacency(spark.createDataFrame(edges, EDGE))
    s = spark.createDataFrame([(q, n, w, [0, i]) for q, seeds in asked.items() for i, (n, w) in enumerate(seeds)], "query_id long, node string, score double, path array<long>")
    own = [(q, c, 0.7) for q in range(0, 7, 2) for c in (100, 999)]
    levels = graph.expansion_levels(s, stored, 0.82, 2)
    scored = graph.chunk_scores(spark.createDataFrame(own, "query_id long, chunk_index long, score double"), levels, stored, 0.82, k)
    want, sums = {}, {}
    for q, seeds in asked.items():
        totals = {c: [w] for p, c, w in own if p == q}
        for c, hop, w in walk(edges, seeds, 0.82, 2):
            sums.setdefault((q, c, hop), []).append(w)
            if c is not None:
                totals.setdefault(c, []).append(w)
        want[q] = sorted((-round(max(w) + 0.1 * (sum(w) - max(w)), 9), c) for c, w in totals.items())[:k]
    got = {q: [] for q in asked}
    for r in scored.collect():
        got[r.query_id].append((-r.score, r.chunk_index))
    assert {q: sorted(x)[:k] for q, x in got.items()} == want
    if k:
        # Of each cell a question has its best and their equals, not all that it reaches.
        assert scored.count() < len(sums) / 2
    else:
        assert {(r.query_id, r.chunk_index, r.hop): (r.n, round(r.w, 9)) for r in graph.level_sums(levels, stored).collect()} == {key: (len(w), round(sum(w), 9)) for key, w in sums.items()}


def test_only_edges_of_hits_are_told(spark):
    """What a question reaches besides its hits has no row in what told them."""
    edges = spark.createDataFrame([(i, "hub", f"n{i}", "r", i, "") for i in range(50)], EDGE)
    triples = spark.createDataFrame([(0, 7, "hub", "r", "n7", "")], "row_id long, index long, head string, relation string, tail string, text string")
    hits = spark.createDataFrame([(1, 0, 0.5, 1)], "query_id long, row_id long, score double, rank int")
    found = graph.search_graph(hits, spark.createDataFrame([(1, "?")], "query_id long, query string"), triples, edges, 2)
    assert rows(found.hits, "chunk_index") == [(0,), (7,)]
    assert rows(found.told.groupBy("chunk_index").count()) == [(0, 2), (7, 3)]
