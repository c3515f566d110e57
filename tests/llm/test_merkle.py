from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import merkle
from corpusgraph.llm.common import ascii_lower
from tests.compare import assert_same

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int, key string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(r):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])


def lower(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def way(levels, at):
    for nodes in levels[:-1]:
        first = at - at % 8
        yield "".join(nodes[first:at]), "".join(nodes[at + 1 : first + 8])
        at //= 8


def brute(rows):
    """doc_id, leaf, subroot, root, proof, folded, verified of (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for d, t, lang, s, n in rows:
        shown = lower(t) if d is not None and crc32(str(d).encode()) % 3 == 0 else t
        groups.setdefault(lang, []).append((d, leaf_of((d, s, lang, n, t)), leaf_of((d, s, lang, n, shown))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[1] for x in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for g in names}
    upper = levels_of([trees[g][-1][0] for g in names])
    out = []
    for j, g in enumerate(names):
        for i, (d, leaf, shown) in enumerate(sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            steps = [*way(trees[g], i), *way(upper, j)]
            folded = shown
            for a, b in steps:
                folded = h(a, folded, b)
            out.append((d, leaf, trees[g][-1][0], upper[-1][0], h(*[a + b for a, b in steps]), folded, folded == upper[-1][0]))
    return sorted(out, key=repr)


def ours(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1, "k") for r in rows], SCHEMA).repartition(parts)
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    low = merkle.leaf_digest(*[ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS])
    told = merkle.manifest(df, "lang", ["doc_id"], merkle.leaf_digest(*[F.col(c) for c in merkle.FIELDS]), {"doc_id": F.col("doc_id"), "shown": F.when(struck, low)})
    got = told.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")), merkle.fold(F.coalesce("shown", "leaf"), F.col("steps"))).collect()
    return sorted([(*r, r[5] == r[3]) for r in got], key=repr)


def test_query_equals_its_sql(spark):
    assert_same(merkle.op12_merkle(spark, DIR), DIR, merkle.OP12_SQL)


@pytest.mark.parametrize("levels", [1, 3])
@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8, "b": 1}, {"a": 9, None: 65, "Z": 64, "": 3, "ä": 7}, {f"g{i}": 1 + i % 3 for i in range(70)}])
def test_trees_of_every_shape(spark, monkeypatch, levels, sizes):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 8**levels)
    rows, n = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            rows.append((n * 7 % 1009, f"Text {n} ÄB\n" if n % 5 else None, lang, None if n % 4 else "s", n if n % 3 else None))
            n += 1
    assert ours(spark, rows) == brute(rows)


def test_odd_rows(spark, monkeypatch):
    """Null ids and texts, rows that repeat, empty and very long texts; no rows, no manifest."""
    monkeypatch.setattr("corpusgraph.functions.ranking.BROADCAST_BYTES", 0)
    rows = [(None, "A", "en", "s", 1), (None, None, "en", "s", 1), (3, "Same", "en", None, None), (3, "Same", "en", None, None), (3, "", "en", "s", 0), (5, "LONG " * 300_000, None, "s", 9), (6, None, None, None, None)]
    assert ours(spark, rows, 1) == brute(rows) == ours(spark, rows, 5)
    assert ours(spark, []) == []


def test_a_changed_text_is_told(spark):
    rows = [(i, f"text {i}" if i % 2 else f"Text {i}", "en", "s", 1) for i in range(40)]
    got = {r[0]: r[6] for r in ours(spark, rows)}
    assert got == {i: not (i % 2 == 0 and crc32(str(i).encode()) % 3 == 0) for i in range(40)}
