"""Merkle manifest of a dataset, folded up in blocks by higher-order functions.

Rows are leaves, in order within their group. Every FANOUT consecutive nodes (the last
run may be shorter, even one) become the hash of their hex digests in a row, until a
group has one node, its subroot; the subroots, ordered by group, become the root alike.

A block is an array of at most BLOCK nodes in order, which sequence, transform, slice
and aggregate collapse by LEVELS levels inside its row; the blocks' roots are the nodes
of the next round. A group with a third of all rows only has more blocks. Proofs are
worked out the other way round: each block hands its nodes the siblings above them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import number_rows
from .common import Scratch, ascii_lower, table

FANOUT_BITS = 3
FANOUT = 1 << FANOUT_BITS
#: Levels that a block collapses, and so the nodes that it holds at most.
LEVELS = 3
BLOCK = FANOUT**LEVELS

STEPS = "array<struct<left:string,right:string>>"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of texts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: Column) -> Column:
    """Hash of a row: each value as its number of UTF-8 bytes, ``:`` and itself; ``-`` for null."""
    told = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in told])


def fold(node: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings on its way up give."""
    return F.aggregate(steps, node, lambda at, s: digest(s["left"], at, s["right"]))


def proof_digest(steps: Column) -> Column:
    """Hash of all siblings on the way up, from left to right in each level."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _one_up(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.aggregate(F.slice(nodes, i * FANOUT + 1, FANOUT), F.lit(""), lambda a, x: F.concat(a, x)), 256))


def _levels(nodes: Column, only: Column) -> Column:
    """The nodes of a block and of each level above: LEVELS of them, or as many as leave one node where it is its group's only block."""
    top = lambda held: F.element_at(held, -1)
    up = lambda held: F.concat(held, F.array(_one_up(top(held))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.array(nodes).cast("array<array<string>>"), lambda held, _: F.when(only & (F.size(top(held)) <= 1), held).otherwise(up(held)))


def _steps(levels: Column, at: Column) -> Column:
    """The siblings of a block's node ``at`` (from 0) in each level that was collapsed."""

    def step(nodes: Column, level: Column) -> Column:
        here = F.call_function("shiftright", at, level * FANOUT_BITS)
        first = here - here % FANOUT
        left = F.array_join(F.slice(nodes, first + 1, here - first), "")
        right = F.array_join(F.slice(nodes, here + 2, first + (FANOUT - 1) - here), "")
        return F.struct(left.alias("left"), right.alias("right"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), step)


def _rounds(nodes: DataFrame, scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of blocks (key, block, nodes, levels) up to one node of each key, and that node (key, node).

    nodes: key, pos, n, node, and further columns that stay in the first round's nodes.
    """
    rounds = []
    while True:
        rest = [c for c in nodes.columns if c not in ("key", "n", "pos")]
        grouped = nodes.groupBy("key", "n", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct((F.col("pos") % BLOCK).cast("int").alias("at"), *rest))).alias("nodes"))
        blocks = grouped.withColumn("levels", _levels(F.transform("nodes", lambda x: x["node"]), F.col("n") <= BLOCK))
        rounds.append(scratch.save(blocks, f"{name}-{len(rounds)}"))
        top = rounds[-1].select("key", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("pos"), F.element_at(F.element_at("levels", -1), 1).alias("node"))
        if rounds[-1].filter(F.col("n") > BLOCK).isEmpty():
            return rounds, top.select("key", "node")
        # Keys of one block have their root already; it stays what it is.
        nodes = top


def _ways(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Every node of the first round with ``steps``, all siblings up to the root. above: key, above (the steps of a key's own root), and columns to carry."""
    carried = [c for c in above.columns if c not in ("key", "above")]
    for i in range(len(rounds) - 1, -1, -1):
        last = i == len(rounds) - 1
        met = rounds[i].join(above, ["key"] if last else ["key", "block"])
        steps = lambda x: F.concat(_steps(F.col("levels"), x["at"]), F.col("above"))
        if i:
            each = met.select("key", *carried, F.inline(F.transform("nodes", lambda x: F.struct((F.col("block") * BLOCK + x["at"]).alias("block"), steps(x).alias("above")))))
            above = each
        else:
            rest = [f for f in rounds[0].schema["nodes"].dataType.elementType.fieldNames() if f != "at"]
            return met.select("key", *carried, F.inline(F.transform("nodes", lambda x: F.struct(*[x[c].alias(c) for c in rest], steps(x).alias("steps")))))
    raise AssertionError("no round")


def manifest(rows: DataFrame, group: str, order: list[str], leaf: Column, keep: dict[str, Column] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Each row's ``keep`` columns, leaf, subroot, root and steps (its inclusion proof: siblings left and right, level by level).

    Leaves ascend by ``order`` (nulls first), equal ones by their hash, so rows that
    repeat are leaves of their own; groups ascend bytewise, null first. A table
    without rows has no manifest rows. Other columns of ``rows`` play no part.
    """
    scratch = scratch or Scratch(rows.sparkSession, "merkle")
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    by = [F.col(c).alias(f"_by{i}") for i, c in enumerate(order)]
    leaves = rows.select(key.alias("key"), *by, leaf.alias("node"), *[c.alias(f"_keep{i}") for i, c in enumerate((keep or {}).values())])
    # Sorting into ranges reads its rows twice: digests, not texts.
    names = [f"_by{i}" for i in range(len(by))]
    placed = number_rows(scratch.save(leaves, "leaves"), ["key"], [*names, "node"], "pos", count_col="n").drop(*names)
    rounds, subroots = _rounds(placed, scratch, "round")
    groups = number_rows(subroots.select(F.lit("").alias("key"), F.col("key").alias("_group"), "node"), ["key"], ["_group"], "pos", count_col="n")
    upper, root = _rounds(groups, scratch, "upper")
    none = F.array().cast(STEPS)
    tops = _ways(upper, root.select("key", none.alias("above"), F.col("node").alias("root")))
    tops = scratch.save(tops.select(F.col("_group").alias("key"), F.col("node").alias("subroot"), "root", F.col("steps").alias("above")), "tops")
    ways = _ways(rounds, tops)
    return ways.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep or {})], F.col("node").alias("leaf"), "subroot", "root", "steps")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    Rows may have nulls in any column: null languages are a group of their own, null
    ids come first and are never tampered with, null texts stay null.
    """
    lower = leaf_digest(*[ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in FIELDS])
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    whole = leaf_digest(*[F.col(c) for c in FIELDS])
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    told = manifest(docs, "lang", ["doc_id"], whole, {"doc_id": F.col("doc_id"), "shown": F.when(struck, lower)})
    return told.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), fold(F.coalesce("shown", "leaf"), F.col("steps")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC = "xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, length(d::VARCHAR) + 1), lambda i: ascii(substr(d::VARCHAR, i, 1))::UBIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0 END))), 4294967295::UBIGINT)"


def _hash_sql(text: str) -> str:
    told = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    return "sha256(" + " || ".join(told(text if c == "text" else c) for c in FIELDS) + ")"


OP12_SQL = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS i, doc_id AS d, lang, {_hash_sql("text")} AS leaf, {_hash_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low FROM documents),
leaves AS (SELECT i, d, lang, leaf, CASE WHEN ({_CRC}) % 3 = 0 THEN low ELSE leaf END AS shown, row_number() OVER (PARTITION BY lang ORDER BY d NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM docs),
tree AS (SELECT 0 AS lev, lang, pos, n, leaf AS h FROM leaves
  UNION ALL SELECT lev + 1, lang, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lev, lang, pos // 8, n),
subroots AS (SELECT lang, max(lev) AS depth, arg_max(h, lev) AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree GROUP BY lang),
upper_tree AS (SELECT 0 AS lev, pos, n, subroot AS h FROM subroots
  UNION ALL SELECT lev + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM upper_tree WHERE n > 1 GROUP BY lev, pos // 8, n),
top AS (SELECT max(lev) AS height, arg_max(h, lev) AS root FROM upper_tree),
side AS (
  SELECT l.i, t.lev, string_agg(h, '' ORDER BY t.pos) FILTER (t.pos < l.pos // (8 ** t.lev)::BIGINT) AS le, string_agg(h, '' ORDER BY t.pos) FILTER (t.pos > l.pos // (8 ** t.lev)::BIGINT) AS ri
  FROM leaves l JOIN tree t ON t.lang IS NOT DISTINCT FROM l.lang AND t.n > 1 AND t.pos // 8 = l.pos // (8 ** (t.lev + 1))::BIGINT GROUP BY l.i, t.lev
  UNION ALL SELECT l.i, s.depth + t.lev, string_agg(h, '' ORDER BY t.pos) FILTER (t.pos < s.pos // (8 ** t.lev)::BIGINT), string_agg(h, '' ORDER BY t.pos) FILTER (t.pos > s.pos // (8 ** t.lev)::BIGINT)
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN upper_tree t ON t.n > 1 AND t.pos // 8 = s.pos // (8 ** (t.lev + 1))::BIGINT GROUP BY l.i, s.depth, t.lev),
proofs AS (SELECT i, string_agg(coalesce(le, '') || coalesce(ri, ''), '' ORDER BY lev) AS p FROM side GROUP BY i),
folds AS (SELECT i, 0 AS lev, shown AS h FROM leaves UNION ALL SELECT f.i, f.lev + 1, sha256(coalesce(le, '') || f.h || coalesce(ri, '')) FROM folds f JOIN side s ON s.i = f.i AND s.lev = f.lev),
folded AS (SELECT i, arg_max(h, lev) AS h FROM folds GROUP BY i)
SELECT d AS doc_id, leaf, subroot, root, sha256(coalesce(p, '')) AS proof_sha256, h AS folded_root, h = root AS verified
FROM leaves JOIN subroots s ON s.lang IS NOT DISTINCT FROM leaves.lang JOIN folded USING (i) LEFT JOIN proofs USING (i), top"""
