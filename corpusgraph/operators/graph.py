"""The knowledge graph as an edge table, and search over it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import BROADCAST_BYTES, dense_index, number_rows, top_k
from ..functions.scratch import Scratch
from ..functions.text import strip

DECAY, MAX_DEPTH, SEED_BONUS, LEXICAL_SCORE, REST_SHARE = 0.82, 2, 0.2, 0.8, 0.1
#: Rows of a node beyond which it is cut into parts, and rows of a bucket, about.
HUB_EDGES, BUCKET_EDGES = 10_000, 2_000_000
#: Names in an automaton, about, and questions that it reads at once.
AUTOMATON_NODES, AUTOMATON_QUESTIONS = 20_000, 100_000
#: Chunks and questions of a cell, about, and pairs of both that are added up at once.
CELL_CHUNKS, CELL_QUESTIONS, CELL_PAIRS = 32_768, 32, 1 << 18


def build_edges(aligned: DataFrame) -> DataFrame:
    """Every surviving triple is an edge of its own; edge_id is its raw number. Triples without text give edges without."""
    return aligned.select(F.col("triple_no").alias("edge_id"), "head", "tail", "relation", F.col("index").alias("chunk_index"), *_text_of(aligned))


def _text_of(triples: DataFrame) -> list[str]:
    return [c for c in triples.columns if c == "text"]


def triple_table(aligned: DataFrame) -> DataFrame:
    """row_id (dense, in the order of chunk index and triple_no), index, head, relation, tail and, if the triples have it, text."""
    return dense_index(aligned, ["index"], ["triple_no"], "row_id").select("row_id", "index", "head", "relation", "tail", *_text_of(aligned))


def graph_nodes(edges: DataFrame) -> DataFrame:
    """node, first_seen: nodes in the order of their first edge, head before tail."""
    ends = edges.select(F.posexplode(F.array("head", "tail")).alias("side", "node"), "edge_id")
    return ends.groupBy("node").agg(F.min(2 * F.col("edge_id") + F.col("side")).alias("first_seen"))


def seed_edges(hits: DataFrame, triples: DataFrame) -> DataFrame:
    """query_id, rank, score, head, tail, relation, chunk_index: hits over triples, each different one once."""
    found = hits.join(triples.withColumnRenamed("index", "chunk_index"), "row_id").select("query_id", "rank", "score", "head", "tail", "relation", "chunk_index")
    return found.groupBy("query_id", "head", "tail", "relation", "chunk_index", "score").agg(F.min("rank").alias("rank"))


def seed_nodes_dense(seeds: DataFrame) -> DataFrame:
    """query_id, node, score (not below 0), seen (order of its first hit, head before tail)."""
    ends = seeds.select("query_id", "score", "rank", F.posexplode(F.array("head", "tail")).alias("side", "node"))
    return ends.groupBy("query_id", "node").agg(F.greatest(F.lit(0.0), F.max("score")).alias("score"), F.min(2 * F.col("rank") + F.col("side")).cast("long").alias("seen"))


def _names_in(names: pa.Table, asked: pa.Table) -> pa.Table:
    """Which names of one part occur in which questions: an automaton over the names reads each question once."""
    automaton, rows_of = ahocorasick.Automaton(), {}
    for i, low in enumerate(names.column("low").to_pylist()):
        rows_of.setdefault(low, []).append(i)
    for low, rows in rows_of.items():
        automaton.add_word(low, rows)
    who, which = [], []
    if rows_of and len(asked):
        automaton.make_automaton()
        for q, text in enumerate(asked.column("low").to_pylist()):
            found = {i for _, rows in automaton.iter(text) for i in rows}
            who += [q] * len(found)
            which += sorted(found)
    ids = asked.column("query_id").take(pa.array(who, pa.int64()))
    some = names.select(["node", "first_seen"]).take(pa.array(which, pa.int64()))
    return pa.table([ids, some.column(0), some.column(1)], names=["query_id", "node", "first_seen"])


def match_nodes(queries: DataFrame, nodes: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """query_id, node, first_seen of the nodes that a question names.

    Nodes of two characters or more: those with a Latin letter as whole words in any
    case, the others as substrings. The nodes are dealt into parts of AUTOMATON_NODES,
    each an automaton that reads all questions once; what it finds is checked exactly.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "names")
    asked = queries.select("query_id", "query").filter("query_id is not null and query is not null")
    named = scratch.save(nodes.withColumn("low", F.lower(strip(F.col("node")))).filter(F.length("low") >= 2).select("low", "node", "first_seen"), "names")
    parts, blocks = max(1, -(-named.count() // AUTOMATON_NODES)), max(1, -(-asked.count() // AUTOMATON_QUESTIONS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda col, n: F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
    left = named.withColumn("part", dealt("low", parts)).withColumn("block", each(blocks)).groupBy("part", "block")
    right = asked.select("query_id", F.lower("query").alias("low"), dealt("query_id", blocks).alias("block")).withColumn("part", each(parts)).groupBy("part", "block")
    kinds = {f.name: f.dataType.simpleString() for f in [*asked.schema, *named.schema]}
    met = left.cogroup(right).applyInArrow(_names_in, ", ".join(f"{c} {kinds[c]}" for c in ("query_id", "node", "first_seen"))).join(asked, "query_id")
    name = strip(F.col("node"))
    escaped = F.regexp_replace(name, r"([^\p{L}\p{N}_\s])", r"\\$1")
    whole_word = F.call_function("regexp_like", F.col("query"), F.concat(F.lit(r"(?iuU)\b"), escaped, F.lit(r"\b")))
    exact = F.when(name.rlike("[a-zA-Z]"), whole_word).otherwise(F.col("query").contains(name))
    return met.filter(exact).select("query_id", "node", "first_seen").distinct()


def seed_nodes(dense: DataFrame, lexical: DataFrame, bonus: float = SEED_BONUS) -> DataFrame:
    """query_id, node, score, path: named nodes count at least LEXICAL_SCORE and get the bonus; path is the seed order, dense seeds first."""
    both = dense.join(lexical, ["query_id", "node"], "full_outer")
    score = F.when(F.col("first_seen").isNotNull(), F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(LEXICAL_SCORE)) + bonus).otherwise(F.col("score"))
    order = F.when(F.col("seen").isNotNull(), F.array(F.lit(0).cast("long"), F.col("seen"))).otherwise(F.array(F.lit(1).cast("long"), F.col("first_seen")))
    return both.select("query_id", "node", score.alias("score"), order.alias("path"))


@dataclass
class Adjacency:
    """A graph's edges from both ends, stored in buckets of (node, part).

    ends: every edge from either end; neighbours: each different neighbour once, by its
    first edge; chunks: a node's different chunks with the numbers of their edges, as
    lists for each group of chunks. A node with more than HUB_EDGES rows is cut into
    parts; ``hubs`` (node, parts) names such nodes.
    """

    ends: DataFrame
    neighbours: DataFrame
    chunks: DataFrame
    hubs: DataFrame
    few_hubs: bool
    buckets: int
    groups: int
    scratch: Scratch

    @cached_property
    def links(self) -> DataFrame:
        """Every edge in buckets; only a search that lists all contributions reads them, so they are written then."""
        return _bucketed(_parted(self.ends, "edge_id", self.hubs, self.few_hubs, self.buckets), self.buckets, "links", self.scratch)


def _bucketed(rows: DataFrame, buckets: int, name: str, scratch: Scratch) -> DataFrame:
    """Rows that lie by (node, part) written in buckets of these, one file each, so that joins on these need no exchange of them."""
    table = f"{name}_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "node", "part").sortBy("node", "part").option("path", f"{scratch.root}/{name}").option("compression", "zstd").format("parquet").saveAsTable(table)
    stored = rows.sparkSession.table(table)
    # The frame knows the files and their buckets; the catalog need not keep the name.
    rows.sparkSession.sql(f"DROP TABLE {table}")
    return stored


def _parted(rows: DataFrame, col: str, hubs: DataFrame, few: bool, buckets: int) -> DataFrame:
    """``rows`` with their part of their node, by a hash of ``col``, dealt by (node, part)."""
    parted = _with_parts(rows, hubs, few).withColumn("part", F.pmod(F.xxhash64(col), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return parted.repartition(buckets, "node", "part")


def _group_of(chunk: str, groups: int) -> Column:
    """A chunk's group; -1 where there is no chunk."""
    return F.when(F.col(chunk).isNull(), F.lit(-1)).otherwise(F.pmod(F.hash(chunk), F.lit(groups)))


def store_adjacency(edges: DataFrame, scratch: Scratch | None = None) -> Adjacency:
    """The adjacency of an edge table; worked out once, then read by every level of every search."""
    scratch = scratch or Scratch(edges.sparkSession, "adjacency")
    first = edges.groupBy("head", "tail").agg(F.min("edge_id").alias("grp"))
    pair = edges.select("head", "tail", "edge_id", "chunk_index", "relation").join(first, ["head", "tail"])
    rest = ["grp", "edge_id", "chunk_index", "relation"]
    ends = [F.struct(F.col(a).alias("node"), F.col(b).alias("nbr"), F.lit(d).cast("long").alias("dir")) for d, a, b in ((0, "head", "tail"), (1, "tail", "head"))]
    both = scratch.save(pair.select(F.explode(F.array(*ends)).alias("e"), *rest).select("e.*", *rest), "ends")
    degrees = both.groupBy("node").count()
    hubs = scratch.save(degrees.filter(F.col("count") > HUB_EDGES).select("node", F.ceil(F.col("count") / HUB_EDGES).cast("int").alias("parts")), "hubs")
    few = hubs.agg(F.coalesce(F.sum(F.octet_length("node") + 16), F.lit(0))).first()[0] <= BROADCAST_BYTES
    size = both.agg(F.count("*").alias("rows"), F.approx_count_distinct("chunk_index").alias("chunks")).first()
    buckets, groups = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size.rows // BUCKET_EDGES)), max(1, -(-size.chunks // CELL_CHUNKS))
    # All of a node's rows of a part lie together, so that nothing below moves them again.
    near = _parted(both.select("node", "nbr", "dir", "grp", "edge_id"), "nbr", hubs, few, buckets).groupBy("node", "part", "nbr").agg(F.min(F.struct("dir", "grp", "edge_id")).alias("f")).select("node", "part", "nbr", "f.*")
    told = _parted(both.select("node", "chunk_index"), "chunk_index", hubs, few, buckets).groupBy("node", "part", "chunk_index").agg(F.count("*").alias("n")).withColumn("chunks", _group_of("chunk_index", groups))
    listed = told.groupBy("node", "part", "chunks").agg(F.collect_list(F.struct(F.coalesce("chunk_index", F.lit(0)).alias("c"), "n")).alias("l")).select("node", "part", "chunks", F.col("l.c").alias("cs"), F.col("l.n").alias("ns"))
    return Adjacency(both, _bucketed(near, buckets, "neighbours", scratch), _bucketed(listed, buckets, "chunks", scratch), hubs, few, buckets, groups, scratch)


def _with_parts(rows: DataFrame, hubs: DataFrame, few: bool) -> DataFrame:
    """``rows`` with the parts of their node, null where it is no hub; a long list of hubs is joined, not sent to all."""
    return rows.join(F.broadcast(hubs) if few else hubs, "node", "left")


def _meet(frontier: DataFrame, table: DataFrame, stored: Adjacency) -> DataFrame:
    """A frontier and a stored table by node: the frontier moves to the table's buckets, a hub's rows to each of its parts."""
    return _in_parts(frontier, stored).join(table, ["node", "part"]).drop("part")


def _in_parts(frontier: DataFrame, stored: Adjacency) -> DataFrame:
    return _with_parts(frontier, stored.hubs, stored.few_hubs).withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def _above_before(met: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``met`` whose w is above all that their neighbour had before, in the order of turn.

    A neighbour has at most one row for each of the question's rows in the level, so
    no group grows with the graph.
    """
    before = F.max("w").over(Window.partitionBy("query_id", "nbr").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    rising = met.withColumn("_before", F.coalesce(before, F.lit(0.0))).filter(F.col("w") > F.col("_before"))
    return rising.join(known, ["query_id", "nbr"], "left").filter(F.col("w") > F.coalesce("best", F.lit(0.0))).drop("_before", "best")


def expansion_levels(seeds: DataFrame, stored: Adjacency, decay: float = DECAY, max_depth: int = MAX_DEPTH, scratch: Scratch | None = None) -> list[DataFrame]:
    """What each level of a first-in-first-out expansion by best score goes through: query_id, node, score, path.

    A neighbour goes on if its score is above its best so far, in the order of
    ``path``. Of parallel edges only the first can raise a neighbour's score, so the
    levels read each neighbour once, not each edge. The last level is by far the
    largest and is not written: what adds it up by node needs no further shuffle.
    """
    scratch = scratch or Scratch(seeds.sparkSession, "expansion")
    levels = [scratch.save(seeds.select("query_id", "node", "score", "path"), "level-0")] if max_depth > 0 else []
    best = levels[0].groupBy("query_id", "node").agg(F.max("score").alias("best")) if levels else None
    for hop in range(1, max_depth):
        # A row of the level meets a neighbour once, so the rows' own order is that of the paths; paths are spelled out afterwards, where they are read.
        turns = levels[-1].withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy("path")))
        met = _meet(turns, stored.neighbours, stored).withColumn("w", F.col("score") * decay)
        onward = _above_before(met, best.withColumnRenamed("node", "nbr"))
        reached = onward.select("query_id", F.col("nbr").alias("node"), F.col("w").alias("score"), F.concat("path", F.array("dir", "grp", "edge_id")).alias("path"))
        levels.append(reached if hop + 1 == max_depth else scratch.save(reached, f"level-{hop}"))
        if hop + 1 < max_depth:
            best = best.unionByName(levels[-1].select("query_id", "node", F.col("score").alias("best"))).groupBy("query_id", "node").agg(F.max("best").alias("best"))
    return levels


def expanded_edges(levels: list[DataFrame], stored: Adjacency, decay: float = DECAY) -> DataFrame:
    """The contributions of all levels, one for each edge: query_id, node, nbr, dir, relation, chunk_index, hop, w, path."""
    columns = ["query_id", "node", "nbr", "dir", "relation", "chunk_index"]
    out = stored.links.select(F.lit(0).cast("long").alias("query_id"), *columns[1:], F.lit(0).alias("hop"), F.lit(0.0).alias("w"), F.array("dir").alias("path")).limit(0)
    for hop, frontier in enumerate(levels, 1):
        met = _meet(frontier, stored.links, stored)
        part = met.select(*columns, F.lit(hop).alias("hop"), (F.col("score") * decay).alias("w"), F.concat("path", F.array("dir", "grp", "edge_id")).alias("path"))
        out = part if hop == 1 else out.unionByName(part)
    return out


def hit_edges(levels: list[DataFrame], stored: Adjacency, hits: DataFrame, scratch: Scratch, decay: float = DECAY) -> DataFrame:
    """Those contributions of expanded_edges that go to a question's hits (query_id, chunk_index).

    The hits' edges are found first, and the levels meet only these: what a question
    reaches besides has no rows here.
    """
    if not levels:
        return expanded_edges(levels, stored, decay)
    wanted = hits.select("query_id", "chunk_index").filter("chunk_index is not null").distinct()
    few = 16 * wanted.count() <= BROADCAST_BYTES
    edges = scratch.save(stored.ends.join(F.broadcast(wanted) if few else wanted, "chunk_index"), "hit-ends")
    at = edges.select("query_id", "node").distinct()
    columns = ["query_id", "node", "nbr", "dir", "relation", "chunk_index"]
    parts = []
    for hop, frontier in enumerate(levels, 1):
        met = frontier.join(at, ["query_id", "node"], "left_semi").join(edges, ["query_id", "node"])
        parts.append(met.select(*columns, F.lit(hop).alias("hop"), (F.col("score") * decay).alias("w"), F.concat("path", F.array("dir", "grp", "edge_id")).alias("path")))
    return reduce(DataFrame.unionByName, parts)


def expand_graph(seeds: DataFrame, edges: DataFrame, decay: float = DECAY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Contributions of a first-in-first-out expansion by best score; parallel edges each contribute. See expanded_edges."""
    stored = store_adjacency(edges)
    return expanded_edges(expansion_levels(seeds, stored, decay, max_depth), stored, decay)


def contributions(seeds: DataFrame, expanded: DataFrame) -> DataFrame:
    """Seed edges and expansion edges as query_id, chunk_index, w, path, chain."""
    three = lambda c: F.format_string("%.3f", F.col(c))
    # The wording of chains.
    first = F.concat(F.lit("SeedTriple: ("), "head", F.lit(") -["), "relation", F.lit("]-> ("), "tail", F.lit(") [score="), three("score"), F.lit("]"))
    source, target = (F.when(F.col("dir") == 0, F.col(a)).otherwise(F.col(b)) for a, b in (("node", "nbr"), ("nbr", "node")))
    later = F.concat(F.when(F.col("dir") == 0, "Out: (").otherwise("In: ("), source, F.lit(") -["), F.coalesce("relation", F.lit("")), F.lit("]-> ("), target, F.lit(") [hop="), F.col("hop").cast("string"), F.lit(", score="), three("w"), F.lit("]"))
    s = seeds.select("query_id", "chunk_index", F.col("score").alias("w"), F.array(F.lit(-1).cast("long"), F.col("rank").cast("long")).alias("path"), first.alias("chain"))
    e = expanded.filter(F.col("chunk_index").isNotNull()).select("query_id", "chunk_index", "w", F.concat(F.array(F.col("hop").cast("long")), "path").alias("path"), later.alias("chain"))
    return s.unionByName(e)


def _raw_score(most, total):
    """The best contribution plus a tenth of the others' sum."""
    return most + REST_SHARE * (total - most)


def _score(most, total):
    """The same to nine decimals, as sums differ beyond that by their order."""
    return F.round(_raw_score(most, total), 9)


def score_chunks(contributed: DataFrame) -> DataFrame:
    """query_id, chunk_index, score from single contributions (query_id, chunk_index, w)."""
    return contributed.groupBy("query_id", "chunk_index").agg(_score(F.max("w"), F.sum("w")).alias("score"))


class _Codes:
    """Whole numbers as places in the order in which they come."""

    def __init__(self) -> None:
        self.values = self.sorted = np.zeros(0, np.int64)
        self.place = np.zeros(0, np.int64)

    def of(self, values: np.ndarray) -> np.ndarray:
        some, inverse = np.unique(values, return_inverse=True)
        new = some[~np.isin(some, self.sorted, assume_unique=True)]
        if len(new):
            self.values = np.concatenate([self.values, new])
            self.place = np.argsort(self.values, kind="stable")
            self.sorted = self.values[self.place]
        return self.place[np.searchsorted(self.sorted, some)][inverse]


class _Cell:
    """Sums of the chunks of a group (rows) for the questions of a block (columns)."""

    def __init__(self, most: bool) -> None:
        self.most, self.chunks, self.questions = most, _Codes(), _Codes()
        self.x, self.total = (np.zeros((0, 0)) for _ in range(2))

    def _grow(self) -> None:
        have, want = self.x.shape, (len(self.chunks.values), len(self.questions.values))
        if want[0] > have[0] or want[1] > have[1]:
            room = tuple(max(h, 1 << (w - 1).bit_length()) if w > h else h for h, w in zip(have, want, strict=True))
            for name, empty in (("x", -np.inf if self.most else 0.0), ("total", 0.0)):
                wide = np.full(room, empty)
                wide[: have[0], : have[1]] = getattr(self, name)
                setattr(self, name, wide)

    def add(self, rows: pa.RecordBatch) -> None:
        """Every chunk of a row's list meets every question of its other list."""
        flat = {c: rows.column(c).flatten().to_numpy() for c in ("cs", "ns", "qs", "ws")}
        n_c, n_q = (np.diff(rows.column(c).offsets.to_numpy()) for c in ("cs", "qs"))
        c, q = self.chunks.of(flat["cs"]), self.questions.of(flat["qs"])
        self._grow()
        # A question with several scores at a node counts once there, with their largest and their sum.
        key = np.repeat(np.arange(len(rows)), n_q) * len(self.questions.values) + q
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        w = flat["ws"][order]
        best, total, times = np.maximum.reduceat(w, first), np.add.reduceat(w, first), np.diff(np.append(first, len(w))).astype(np.float64)
        row, q = np.divmod(key[order][first], len(self.questions.values))
        n_q = np.bincount(row, minlength=len(rows))
        begin = np.cumsum(n_q) - n_q
        of = np.repeat(np.arange(len(rows)), n_c)
        width, x, y = self.x.shape[1], self.x.reshape(-1), self.total.reshape(-1)
        upto = np.cumsum(n_q[of])
        start = 0
        while start < len(of):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + CELL_PAIRS, side="right")))
            sizes = n_q[of[start:stop]]
            entry = np.repeat(np.arange(start, stop), sizes)
            asked = np.arange(len(entry)) - np.repeat(np.cumsum(sizes) - sizes - begin[of[start:stop]], sizes)
            at = c[entry] * width + q[asked]
            edges = flat["ns"][entry]
            np.add.at(y, at, total[asked] * edges)
            if self.most:
                np.maximum.at(x, at, best[asked])
            else:
                np.add.at(x, at, times[asked] * edges)
            start = stop

    def rows(self, k: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each question its chunks, x and total; with ``k`` only those that can be among its k best.

        Scores are rounded to nine decimals later and tie by chunk then, so all within
        the rounding of the k-th score stay, but of equal ones no more than k.
        """
        for i, question in enumerate(self.questions.values.tolist()):
            x, total = (m[: len(self.chunks.values), i] for m in (self.x, self.total))
            some = np.flatnonzero(x > (-np.inf if self.most else 0.0))
            if k is not None and len(some) > k:
                raw = _raw_score(x[some], total[some])
                near = raw >= np.partition(raw, len(raw) - k)[len(raw) - k] - 4e-9
                some, raw = some[near], raw[near]
                order = np.lexsort((self.chunks.values[some], -raw))
                head = np.flatnonzero(np.concatenate([[True], raw[order][1:] != raw[order][:-1]]))
                turn = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
                some = some[order[turn < k]]
            yield question, self.chunks.values[some], x[some], total[some]


def _cells(most: bool, k: int | None):
    """Adds up cell by cell; the rows of a cell come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell = None, None

        def done() -> Iterator[pa.RecordBatch]:
            for question, chunks, x, total in cell.rows(k):
                n = len(chunks)
                ids = pa.nulls(n, pa.int64()) if key[1] < 0 else pa.array(chunks, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, question), pa.int64()), ids, pa.array(np.full(n, key[0]), pa.int32()), pa.array(x), pa.array(total)], names=["query_id", "chunk_index", "hop", "x", "total"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("hop", "chunks", "block")], axis=1)
            heads = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else []
            for a, b in zip(heads, [*heads[1:], len(keys)], strict=True):
                now = tuple(keys[a].tolist())
                if now != key:
                    if cell:
                        yield from done()
                    key, cell = now, _Cell(most)
                cell.add(batch.slice(a, b - a))
        if cell:
            yield from done()

    return run


def _chunk_sums(levels: list[DataFrame], frontier: DataFrame, stored: Adjacency, most: bool, k: int | None = None, told: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_index, hop, x, total: what a frontier's scores add up to at the chunks of its nodes.

    frontier: query_id, node, hop, w of the levels, the first of which has all their
    questions; ``told`` (query_id, chunk_index, hop, w) counts besides. x is the largest score (``most``) or the number of contributions, total
    their sum. A node's list of chunks and its list of questions move to the cells of
    both, groups of chunks by blocks of questions, and are multiplied out and added up
    there: no row stands for a (question, chunk) before it is whole.
    """
    questions = levels[0].agg(F.approx_count_distinct("query_id")).first()[0]
    block = F.pmod(F.hash("query_id"), F.lit(max(1, -(-questions // CELL_QUESTIONS))))
    asked = _in_parts(frontier, stored).repartition(stored.buckets, "node", "part").withColumn("block", block).groupBy("node", "part", "hop", "block").agg(F.collect_list(F.struct("query_id", "w")).alias("a"))
    cells = ["hop", "chunks", "block"]
    met = asked.join(stored.chunks, ["node", "part"]).select(*cells, "cs", "ns", F.col("a.query_id").alias("qs"), F.col("a.w").alias("ws"))
    if told is not None:
        one = told.withColumn("chunks", _group_of("chunk_index", stored.groups)).withColumn("block", block)
        met = met.filter("chunks >= 0").unionByName(one.select(*cells, F.array(F.coalesce("chunk_index", F.lit(0))).alias("cs"), F.array(F.lit(1).cast("long")).alias("ns"), F.array("query_id").alias("qs"), F.array("w").alias("ws")))
    return met.repartition(*cells).sortWithinPartitions(*cells).mapInArrow(_cells(most, k), "query_id long, chunk_index long, hop int, x double, total double")


def chunk_scores(seeds: DataFrame, levels: list[DataFrame], stored: Adjacency, decay: float = DECAY, k: int | None = None) -> DataFrame:
    """The same from seed edges and levels, without a row for each edge; with ``k`` at least the k best of each question."""
    if not levels:
        return score_chunks(seeds.withColumnRenamed("score", "w"))
    frontier = reduce(DataFrame.unionByName, [f.select("query_id", "node", F.lit(0).alias("hop"), (F.col("score") * decay).alias("w")) for f in levels])
    sums = _chunk_sums(levels, frontier, stored, True, k, seeds.select("query_id", "chunk_index", F.lit(0).alias("hop"), F.col("score").alias("w")))
    return sums.select("query_id", "chunk_index", _score(F.col("x"), F.col("total")).alias("score"))


def level_sums(levels: list[DataFrame], stored: Adjacency, decay: float = DECAY) -> DataFrame:
    """query_id, chunk_index, hop, n, w: how many contributions of a level a chunk gets, and their sum."""
    frontier = reduce(DataFrame.unionByName, [f.select("query_id", "node", F.lit(hop).alias("hop"), (F.col("score") * decay).alias("w")) for hop, f in enumerate(levels, 1)])
    return _chunk_sums(levels, frontier, stored, False).select("query_id", "chunk_index", "hop", F.col("x").cast("long").alias("n"), F.col("total").alias("w"))


def chain_rows(contributed: DataFrame, hits: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """query_id, chunk_index, pos, chain: the hits' reasoning chains, numbered from 0 in the order of contribution.

    Chains are sorted in ranges and numbered by the ranges' counts, so a chunk at a hub
    takes no list and no task of its own.
    """
    told = contributed.join(hits.select("query_id", "chunk_index"), ["query_id", "chunk_index"], "left_semi")
    numbered = number_rows(told.select("query_id", "chunk_index", "path", "chain"), ["query_id", "chunk_index"], ["path", "chain"], "pos", scratch)
    return numbered.select("query_id", "chunk_index", F.col("pos").cast("int").alias("pos"), "chain")


def reasoning_chains(contributed: DataFrame, hits: DataFrame) -> DataFrame:
    """``hits`` with reasoning_chains as lists in the order of contribution, for hits whose chains fit a row; chain_rows has no such bound."""
    wanted = hits.select("query_id", "chunk_index")
    lists = contributed.join(wanted, ["query_id", "chunk_index"], "left_semi").groupBy("query_id", "chunk_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "chain"))), lambda x: x["chain"]).alias("reasoning_chains"))
    return hits.join(lists, ["query_id", "chunk_index"], "left")


def attach_chunk(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds the chunk's text; a chunk beyond the table shows its first chain instead."""
    texts = chunks.select(F.col("index").alias("chunk_index"), "text")
    joined = hits.join(texts, "chunk_index", "left")
    if "reasoning_chains" in hits.columns:
        return joined.withColumn("text", F.coalesce("text", F.try_element_at("reasoning_chains", F.lit(1)), F.lit("")))
    return joined


@dataclass
class GraphHits:
    """The best chunks (query_id, chunk_index, score, rank) and what told them (that of ``contributions`` for these chunks)."""

    hits: DataFrame
    tell: Callable[[], DataFrame]

    @cached_property
    def told(self) -> DataFrame:
        """Worked out when first asked for."""
        return self.tell()


def search_graph(dense_hits: DataFrame, queries: DataFrame, triples: DataFrame, edges: DataFrame, k: int, decay: float = DECAY, max_depth: int = MAX_DEPTH, bonus: float = SEED_BONUS, scratch: Scratch | None = None, stored: Adjacency | None = None) -> GraphHits:
    """The k best chunks of every question by graph expansion.

    dense_hits: hits over the triples' vectors (query_id, row_id, score, rank);
    queries: query_id, query. A question without seeds has no rows. ``stored`` is the
    edges' adjacency, if there is one already.
    """
    scratch = scratch or Scratch(edges.sparkSession, "graph-search")
    stored = stored or store_adjacency(edges, scratch)
    seeds = scratch.save(seed_edges(dense_hits, triples), "seed-edges")
    named = match_nodes(queries, graph_nodes(edges))
    levels = expansion_levels(seed_nodes(seed_nodes_dense(seeds), named, bonus), stored, decay, max_depth, scratch)
    scored = chunk_scores(seeds, levels, stored, decay, k)
    hits = scratch.save(top_k(scored, ["query_id"], [F.desc("score"), F.col("chunk_index")], k), "graph-hits")
    of_hits = lambda: seeds.join(hits.select("query_id", "chunk_index"), ["query_id", "chunk_index"], "left_semi")
    return GraphHits(hits, lambda: contributions(of_hits(), hit_edges(levels, stored, hits, scratch, decay)))


def graph_search(dense_hits: DataFrame, queries: DataFrame, triples: DataFrame, edges: DataFrame, k: int, chains: bool = True, decay: float = DECAY, max_depth: int = MAX_DEPTH, bonus: float = SEED_BONUS, scratch: Scratch | None = None, stored: Adjacency | None = None) -> DataFrame:
    """query_id, chunk_index, score, rank (and reasoning_chains) of the k best chunks; see search_graph."""
    found = search_graph(dense_hits, queries, triples, edges, k, decay, max_depth, bonus, scratch, stored)
    return reasoning_chains(found.told, found.hits) if chains else found.hits
