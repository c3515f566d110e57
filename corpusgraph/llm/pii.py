"""Personal data by bootstrapped contextual extraction (DataFrame functions only).

Patterns of form find the seeds: e-mail and IP addresses, card and phone numbers. The
words around a seed are its lexical patterns ("l2 l1 _", "l1 _", "l1 _ r1",
"_ r1 r2"), and so are those around every other word that could be an identifier. In
each round a pattern's confidence for a kind is worked out from the different
identifiers that it surrounds, and an identifier's score for a kind from its confident
patterns; those that score enough count as known in the next round, until no round
finds more. All their places are added to the seeds'.

All expressions on texts run in linear time: runs are taken whole and from their start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, Scratch, ascii_lower, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# A match may begin where a run does, or where the match before ended (\G).
FORMS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a form to be looked for.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Other words that could be identifiers: a number with an area in brackets, or a run that holds a digit or an @.
_RUN, _PLAIN = "[A-Za-z0-9@._%+:#/-]", "[A-Za-z._%+:#/-]"
OTHER = rf"\([0-9]{{2,5}}\)\x20[0-9][0-9.-]*+|(?:(?<!{_RUN})|\G){_PLAIN}*+[0-9@]{_RUN}*+"
_EDGE = "[._%:#/-]"
LEAST_LETTERS, MOST_LETTERS = 6, 64
#: Letters before and after an identifier in which its neighbouring words are looked for.
CONTEXT = 64

#: Different identifiers of a kind that a pattern must surround, the confidence it must reach, the score an identifier must reach, and rounds at most.
SUPPORT, CONFIDENCE, SCORE, ROUNDS = 5, 0.8, 0.9, 3
#: What an identifier of no known kind counts against a pattern, and what counts against each.
UNKNOWN, DOUBT = 0.1, 0.5


def luhn(digits: Column) -> Column:
    """Whether the check digit of a text of digits is right."""
    n = F.length(digits)
    at = lambda i: F.substr(digits, n - i + 1, F.lit(1)).cast("int")
    worth = lambda i: F.when(i % 2 == 0, 2 * at(i) - F.when(at(i) > 4, 9).otherwise(0)).otherwise(at(i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def is_valid(kind: Column, value: Column) -> Column:
    """Whether what has a kind's form is one: parts up to 255, 12 to 19 digits with a right check digit, 9 to 15 digits."""
    bare, digits = F.regexp_replace(value, r"[\x20-]", ""), F.regexp_replace(value, "[^0-9]", "")
    card = F.when(F.length(bare).between(12, 19), luhn(bare)).otherwise(False)
    return F.when(kind == "email", True).when(kind == "ip", value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")).when(kind == "card", card).otherwise(F.length(digits).between(9, 15))


def fits(kind: Column, value: Column) -> Column:
    """Whether an identifier of another form could be of a kind at all."""
    digits, letter = F.length(F.regexp_replace(value, "[^0-9]", "")), value.rlike("[A-Za-z@]")
    ip = value.rlike("^[0-9a-fA-F:.]+$") & (F.regexp_count(value, F.lit("[:.]")) >= 2)
    return F.when(kind == "email", value.contains("@")).when(kind == "ip", ip).when(kind == "card", ~letter & digits.between(12, 19)).otherwise(~letter & digits.between(7, 15))


def _found(kind: str, form: str, text: Column) -> Column:
    """Every match of a form with what stands before it; a last entry has what stands behind the last match."""
    matches = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    pieces = F.arrays_zip(matches.alias("value"), F.split(text, form, -1).alias("gap"))
    told = F.transform(pieces, lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(p["gap"]).alias("gap"), p["value"].alias("value"), F.left(p["gap"], F.lit(CONTEXT)).alias("head"), F.right(p["gap"], F.lit(CONTEXT)).alias("tail")))
    hint = text.contains(HINTS[kind]) if kind in HINTS else text.rlike("[0-9@]")
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,value:string,head:string,tail:string>>")
    return F.when(hint & (F.size(F.when(hint, matches)) > 0), told).otherwise(none)


def mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row_no, id and found (all forms' matches, valid or not) of every row; save it, as the numbers of rows hold for one reading only."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.select("row_no", "id", F.concat(*[_found(k, form, F.col("t")) for k, form in {**FORMS, "other": OTHER}.items()]).alias("found"))


def _words(context: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(context), F.lit(r"\p{L}+"), F.lit(0))


def place(found: DataFrame) -> DataFrame:
    """row_no, kind, start, end, value, head, tail of valid seeds and of other words that touch none of them (kind ``other``)."""
    each = found.select("row_no", F.inline("found")).repartition("row_no")
    w = Window.partitionBy("row_no", "kind").orderBy("i")
    before = F.sum(F.col("gap") + F.coalesce(F.length("value"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    at = each.withColumn("start", (F.coalesce(before, F.lit(0)) + F.col("gap")).cast("long")).withColumn("head", F.lead("head").over(w)).filter("value is not null")
    other = F.col("kind") == "other"
    # Other words lose the marks at their edges.
    bare = F.when(other, F.regexp_replace("value", rf"^{_EDGE}++|{_EDGE}++$", "")).otherwise(F.col("value"))
    led = F.when(other, F.length(F.regexp_extract("value", rf"^{_EDGE}*+", 0))).otherwise(0)
    cut = at.select("row_no", "kind", (F.col("start") + led).alias("start"), bare.alias("value"), "head", "tail").withColumn("end", F.col("start") + F.length("value"))
    kept = cut.filter(F.when(F.col("kind") == "other", F.length("value").between(LEAST_LETTERS, MOST_LETTERS)).otherwise(is_valid(F.col("kind"), F.col("value"))))
    # Both windows grow from their start, so many matches in a text cost no square.
    own = Window.partitionBy("row_no").orderBy("start", F.col("kind") == "other", "end").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row_no").orderBy(F.desc("start"), F.col("kind") == "other", "end").rowsBetween(Window.unboundedPreceding, -1)
    seed = lambda c: F.when(F.col("kind") != "other", F.col(c))
    reached, next_one = F.max(seed("end")).over(own), F.min(seed("start")).over(back)
    apart = (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (F.coalesce(next_one, F.col("end")) >= F.col("end"))
    return kept.withColumn("_apart", apart).filter((F.col("kind") != "other") | F.col("_apart")).select("row_no", "kind", "start", "end", "value", "head", "tail")


def surroundings(placed: DataFrame) -> DataFrame:
    """kind, value (small letters), pattern: the different lexical patterns of each different identifier."""
    left, right = _words(F.col("tail")), _words(F.col("head"))
    at = lambda c, i: F.try_element_at(c, F.lit(i))
    near = placed.select("kind", ascii_lower(F.col("value")).alias("value"), at(left, -1).alias("l1"), at(left, -2).alias("l2"), at(right, 1).alias("r1"), at(right, 2).alias("r2"))
    told = F.array(F.concat("l2", F.lit(" "), "l1", F.lit(" _")), F.concat("l1", F.lit(" _")), F.concat("l1", F.lit(" _ "), "r1"), F.concat(F.lit("_ "), "r1", F.lit(" "), "r2"))
    return near.select("kind", "value", F.explode(told).alias("pattern")).filter("pattern is not null").distinct()


def confident_patterns(edges: DataFrame) -> DataFrame:
    """pattern, kind, confidence. edges: pattern, value, kind (null: not known), each once."""
    of = edges.groupBy("pattern").agg(*[F.count(F.when(F.col("kind") == k, True)).alias(k) for k in KINDS], F.count(F.when(F.col("kind").isNull(), True)).alias("unknown"))
    each = of.select("pattern", sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0])).alias("known"), "unknown", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in KINDS])).alias("k"))
    confidence = F.col("k.n") / (F.col("known") + UNKNOWN * F.col("unknown") + DOUBT)
    return each.select("pattern", "k.kind", F.col("k.n").alias("n"), confidence.alias("confidence")).filter((F.col("n") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).drop("n")


def discover(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """value, kind, score, round of the identifiers that confident patterns tell. edges: kind, value, pattern (kind ``other``: to be told)."""
    seeds, others = edges.filter("kind <> 'other'").select("pattern", "value", "kind"), edges.filter("kind = 'other'").select("pattern", "value")
    known = None
    for turn in range(1, ROUNDS + 1):
        told = others.join(known.select("value", "kind"), "value", "left") if known is not None else others.withColumn("kind", F.lit(None).cast("string"))
        patterns = scratch.save(confident_patterns(seeds.unionByName(told)), f"patterns-{turn}")
        met = told.filter("kind is null").drop("kind").join(patterns, "pattern").filter(fits(F.col("kind"), F.col("value")))
        # Of several patterns each is a chance of its own; sums are kept to nine decimals, as their order is not fixed.
        scored = met.groupBy("value", "kind").agg(F.round(1 - F.exp(F.sum(F.log(1 - F.col("confidence")))), 9).alias("score")).filter(F.col("score") >= SCORE)
        first = F.max_by("kind", F.struct("score", *[(F.col("kind") == k).alias(k) for k in KINDS]))
        new = scratch.save(scored.groupBy("value").agg(first.alias("kind"), F.max("score").alias("score"), F.lit(turn).alias("round")), f"told-{turn}")
        known = new if known is None else known.unionByName(new)
        if new.isEmpty():
            break
    return known


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, spans) of whole texts; rows: row_no, id; spans: row_no, kind, start, end (code points, end exclusive), value, round (0: by form).

    Null texts are empty; rows that repeat have spans of their own; null ids stay null.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    found = scratch.save(mentions(docs, id_col, text_col), "mentions")
    placed = scratch.save(place(found), "placed")
    known = discover(scratch.save(surroundings(placed), "edges"), scratch)
    cells = ["row_no", "kind", "start", "end", "value"]
    seeds = placed.filter("kind <> 'other'").select(*cells, F.lit(0).alias("round"))
    more = placed.filter("kind = 'other'").drop("kind").withColumn("_value", ascii_lower(F.col("value"))).join(known.select(F.col("value").alias("_value"), "kind", "round"), "_value").select(*cells, "round")
    return found.select("row_no", "id"), seeds.unionByName(more)


def _joined(spans: Column) -> Column:
    """kind:start:end of spans (start, place of the kind, end), comma-joined in order."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (spans by form), base_sha256, spans (all), n_told (spans that patterns told) of every document."""
    rows, spans = personal_data(table(spark, sf_dir, "documents"))
    base = F.col("round") == 0
    k = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    cell = F.struct("start", k.alias("k"), "end")
    counts = [F.count(F.when(base & (F.col("kind") == x), True)).alias(f"n_{x}") for x in KINDS]
    told = spans.groupBy("row_no").agg(*counts, F.count(F.when(~base, True)).alias("n_told"), _joined(F.collect_list(F.when(base, cell))).alias("base"), _joined(F.collect_list(cell)).alias("spans"))
    numbers = [F.coalesce(f"n_{x}", F.lit(0)).cast("long").alias(f"n_{x}") for x in KINDS]
    return rows.join(told, "row_no", "left").select(F.col("id").alias("doc_id"), *numbers, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_told", F.lit(0)).cast("long").alias("n_told"))


# The contract's expressions and those of other words, as a linear engine takes them.
_SQL_FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "other": rf"\([0-9]{{2,5}}\)\x20[0-9][0-9.-]*|{_PLAIN}*[0-9@]{_RUN}*",
}
_SQL_LOWER = f"translate(value, '{ASCII_UPPER}', '{ASCII_LOWER}')"
_SQL_WORDS = f"regexp_extract_all(translate({{}}, '{ASCII_UPPER}', '{ASCII_LOWER}'), '\\p{{{{L}}}}+')"
_SQL_DIGITS = "length(regexp_replace(value, '[^0-9]', '', 'g'))"
_SQL_ORDER = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"


def _rounds_sql() -> str:
    parts, known = [], "SELECT NULL::VARCHAR AS value, NULL::VARCHAR AS kind WHERE false"
    for n in range(1, ROUNDS + 1):
        counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in KINDS)
        each = " UNION ALL ".join(f"SELECT pattern, '{k}' AS kind, {k} AS n, {' + '.join(KINDS)} AS known, unknown FROM of_{n}" for k in KINDS)
        parts += [
            f"known_{n} AS ({known})",
            f"of_{n} AS (SELECT pattern, {counts}, count(*) FILTER (kind IS NULL) AS unknown FROM (SELECT pattern, value, kind FROM edges WHERE kind <> 'other' UNION ALL SELECT pattern, e.value, k.kind FROM edges e LEFT JOIN known_{n} k ON k.value = e.value WHERE e.kind = 'other') GROUP BY pattern)",
            f"sure_{n} AS (SELECT pattern, kind, n / (known + {UNKNOWN}::DOUBLE * unknown + {DOUBT}::DOUBLE) AS c FROM ({each}) WHERE n >= {SUPPORT} AND n / (known + {UNKNOWN}::DOUBLE * unknown + {DOUBT}::DOUBLE) >= {CONFIDENCE})",
            f"met_{n} AS (SELECT e.value, s.kind, c FROM edges e JOIN sure_{n} s USING (pattern) WHERE e.kind = 'other' AND e.value NOT IN (SELECT value FROM known_{n}))",
            f"scored_{n} AS (SELECT value, kind, round(1 - exp(sum(ln(1 - c))), 9) AS score FROM met_{n} WHERE CASE kind WHEN 'email' THEN contains(value, '@') WHEN 'ip' THEN regexp_matches(value, '^[0-9a-fA-F:.]+$') AND len(regexp_extract_all(value, '[:.]')) >= 2 WHEN 'card' THEN NOT regexp_matches(value, '[A-Za-z@]') AND {_SQL_DIGITS} BETWEEN 12 AND 19 ELSE NOT regexp_matches(value, '[A-Za-z@]') AND {_SQL_DIGITS} BETWEEN 7 AND 15 END GROUP BY ALL)",
            f"new_{n} AS (SELECT value, kind FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC, {_SQL_ORDER}) AS r FROM scored_{n} WHERE score >= {SCORE}) WHERE r = 1)",
        ]
        known = f"SELECT * FROM known_{n} UNION ALL SELECT * FROM new_{n}"
    return ", ".join([*parts, f"known AS ({known})"])


OP13_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t FROM documents),
forms AS ({" UNION ALL ".join(f"SELECT row_no, '{k}' AS kind, regexp_extract_all(t, '{f}') AS m, regexp_split_to_array(t, '{f}') AS s FROM docs" for k, f in _SQL_FORMS.items())}),
each AS (SELECT row_no, kind, i, s[i] AS gap, m[i] AS value FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM forms WHERE len(m) > 0)),
located AS (SELECT row_no, kind, value, right(gap, {CONTEXT}) AS tail, left(lead(gap) OVER w, {CONTEXT}) AS head, length(gap) + coalesce(sum(length(gap) + coalesce(length(value), 0)) OVER (PARTITION BY row_no, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM each WINDOW w AS (PARTITION BY row_no, kind ORDER BY i)),
cut AS (SELECT row_no, kind, tail, head, CASE kind WHEN 'other' THEN regexp_replace(value, '^{_EDGE}+|{_EDGE}+$', '', 'g') ELSE value END AS value, start + CASE kind WHEN 'other' THEN length(regexp_extract(value, '^{_EDGE}*')) ELSE 0 END AS start FROM located WHERE value IS NOT NULL),
kept AS (SELECT *, start + length(value) AS "end", regexp_replace(value, '[^0-9]', '', 'g') AS g FROM cut WHERE CASE kind WHEN 'other' THEN length(value) BETWEEN {LEAST_LETTERS} AND {MOST_LETTERS} WHEN 'ip' THEN regexp_matches(value, '^{_BYTE}(\.{_BYTE}){{3}}$') WHEN 'phone' THEN {_SQL_DIGITS} BETWEEN 9 AND 15 WHEN 'card' THEN {_SQL_DIGITS} BETWEEN 12 AND 19 ELSE true END),
good AS (SELECT * FROM kept WHERE kind <> 'card' OR list_sum(list_transform(range(1, length(g) + 1), lambda j: CASE WHEN j % 2 = 1 THEN g[-j]::INTEGER ELSE g[-j]::INTEGER * 2 - CASE WHEN g[-j]::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0),
placed AS (SELECT * FROM good o WHERE kind <> 'other' OR NOT EXISTS (SELECT 1 FROM good b WHERE b.row_no = o.row_no AND b.kind <> 'other' AND b.start < o."end" AND b."end" > o.start)),
near AS (SELECT kind, {_SQL_LOWER} AS value, {_SQL_WORDS.format("tail")} AS l, {_SQL_WORDS.format("head")} AS r FROM placed),
edges AS (SELECT DISTINCT kind, value, unnest([CASE WHEN len(l) >= 2 THEN l[-2] || ' ' || l[-1] || ' _' END, CASE WHEN len(l) >= 1 THEN l[-1] || ' _' END, CASE WHEN len(l) >= 1 AND len(r) >= 1 THEN l[-1] || ' _ ' || r[1] END, CASE WHEN len(r) >= 2 THEN '_ ' || r[1] || ' ' || r[2] END]) AS pattern FROM near),
{_rounds_sql().replace("FROM edges", "FROM (SELECT * FROM edges WHERE pattern IS NOT NULL)")},
spans AS (SELECT row_no, kind, start, "end", true AS base FROM placed WHERE kind <> 'other' UNION ALL SELECT row_no, k.kind, start, "end", false FROM placed p JOIN known k ON k.value = {_SQL_LOWER.replace("value", "p.value")} WHERE p.kind = 'other'),
told AS (SELECT row_no, {", ".join(f"count(*) FILTER (base AND kind = '{k}') AS n_{k}" for k in KINDS)}, count(*) FILTER (NOT base) AS n_told,
  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, {_SQL_ORDER}, "end") FILTER (base) AS b, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, {_SQL_ORDER}, "end") AS s FROM spans GROUP BY row_no)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans, coalesce(n_told, 0) AS n_told FROM docs LEFT JOIN told USING (row_no)"""
