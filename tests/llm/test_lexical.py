import math
import re

import numpy as np
import pyarrow as pa
import pytest

from corpusgraph.llm import lexical
from corpusgraph.llm.common import Scratch
from tests.compare import assert_same

DIR = "/root/testdata/sf0.001"


def terms_of(text):
    return re.findall(lexical.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, questions, k):
    own = [(d, t) for d, text in docs if d is not None and (t := terms_of(text))]
    n, total = len(own), sum(len(t) for _, t in own)
    asked = {}
    for q, text in questions:
        asked.setdefault(q, set()).update(terms_of(text))
    out = []
    for q, terms in asked.items():
        scored = []
        for d, t in own:
            m = 100 - 90 + (90 * len(t) * n) // total
            score = 0
            for term in terms & set(t):
                df, tf = sum(term in x for _, x in own), t.count(term)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, d))
        out += [(q, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def ours(spark, docs, questions, k, parts=3):
    d = spark.createDataFrame([(*r, "x", 7) for r in docs], "doc_id long, text string, term string, shard long").repartition(parts)
    q = spark.createDataFrame(questions, "item_id long, text string")
    scratch = Scratch(spark, "lexical-test")
    index = scratch.save(lexical.build_index(d), "index")
    got = lexical.search_index(index, lexical.question_terms(q, "item_id", "text"), k, scratch)
    return sorted((r.query_id, r.rank, r.doc_id, r.score) for r in got.collect())


def test_query_equals_its_sql(spark):
    assert_same(lexical.op11_lexical(spark, DIR), DIR, lexical.OP11_SQL)


@pytest.mark.parametrize("shard,window,asked", [(16 << 20, 4096, 32 << 20), (200, 3, 40), (1, 1, 150)])
def test_any_cut_into_shards_windows_and_parts(spark, monkeypatch, shard, window, asked):
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
    monkeypatch.setattr(lexical, "ASKED_BYTES", asked)
    monkeypatch.setattr(lexical, "WINDOW", window)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)] + ["Ärger", "a_b", "x-y", "naïve"]
    text = lambda n: " ".join(words[int(i)] for i in rng.zipf(1.4, n) % len(words))
    docs = [(int(i) * 3 - 90, text(int(rng.integers(1, 40)))) for i in rng.permutation(80)]
    questions = [(i, text(5)) for i in range(12)]
    assert ours(spark, docs, questions, 4) == brute(docs, questions, 4)


def test_odd_rows(spark):
    """Null ids and texts, texts without terms, repeated rows, ties, very long texts and terms; no documents, no questions."""
    docs = [(None, "alpha"), (1, None), (2, ""), (3, " ,.;"), (4, "Alpha beta"), (4, "Alpha beta"), (9, "alpha beta"), (-(2**63), "beta gamma"), (2**63 - 1, "beta gamma"), (5, "long " * 200_000 + "alpha"), (6, "z" * 100_000), (7, "ÀB àb 東京 é1")]
    questions = [(1, "ALPHA, alpha! beta"), (2, None), (3, "..."), (4, "nowhere"), (5, "z" * 100_000), (6, "Àb 東京 É1"), (7, "beta"), (7, "gamma"), (None, "alpha")]
    want = brute(docs, [q for q in questions if q[0] is not None], 3)
    assert ours(spark, docs, questions, 3) == want and {r[0] for r in want} == {1, 5, 6, 7}
    assert ours(spark, docs, [], 3) == [] and ours(spark, [], questions, 3) == []


def test_numbers_and_postings_come_back():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**35, 2**63, 2**64 - 1], np.uint64)
    packed, ends = lexical.pack_numbers(values)
    assert (lexical.unpack_numbers(packed) == values).all() and ends[-1] == len(packed) and ends[2] == 3
    rows = lexical.index_shard(5, np.array([9, 2, 4]), pa.array(["a b a", "", "b"])).to_pylist()
    assert [(r["term"], r["df"], r["total"]) for r in rows] == [(None, 2, 4), ("a", 1, 2), ("b", 2, 2)]
    assert lexical.unpack_numbers(np.frombuffer(rows[2]["postings"], np.uint8)).tolist() == [0, 1, 1, 1]
