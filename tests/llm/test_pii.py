import math
import random
import re

import duckdb
import pandas as pd
import regex
from pyspark.sql import functions as F

from corpusgraph.llm import pii
from corpusgraph.llm.common import Scratch
from tests.compare import assert_same

DIR = "/root/testdata/sf0.001"
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        worth = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(worth) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def fits(kind, value):
    n, letter = len(re.findall("[0-9]", value)), re.search("[A-Za-z@]", value)
    return {"email": "@" in value, "ip": bool(re.fullmatch("[0-9a-fA-F:.]+", value)) and len(re.findall("[:.]", value)) >= 2, "card": not letter and 12 <= n <= 19, "phone": not letter and 7 <= n <= 15}[kind]


def matches(text):
    """kind, start, end, value, text before and after (up to the neighbouring matches) of seeds and of other words."""
    out = []
    for kind, form in {**PLAIN, "other": r"\([0-9]{2,5}\)\x20[0-9][0-9.-]*|[A-Za-z._%+:#/-]*[0-9@][A-Za-z0-9@._%+:#/-]*"}.items():
        spans = [m.span() for m in re.finditer(form, text)]
        for (a, b), last, nxt in zip(spans, [0, *(b for _, b in spans)], [*(a for a, _ in spans[1:]), len(text)]):
            tail, head = text[max(last, a - 64) : a], text[b : min(nxt, b + 64)]
            if kind == "other":
                while a < b and text[a] in "._%:#/-":
                    a += 1
                while a < b and text[b - 1] in "._%:#/-":
                    b -= 1
            if 6 <= b - a <= 64 if kind == "other" else valid(kind, text[a:b]):
                out.append((kind, a, b, text[a:b], tail, head))
    seeds = [x for x in out if x[0] != "other"]
    return [x for x in out if x[0] != "other" or not any(s[1] < x[2] and s[2] > x[1] for s in seeds)]


def brute(texts):
    """Spans (kind, start, end, round) of each text."""
    found = [matches(t or "") for t in texts]
    edges = set()
    for kind, _, _, value, tail, head in (x for own in found for x in own):
        left, right = (regex.findall(r"\p{L}+", lower(c)) for c in (tail, head))
        near = [f"{left[-2]} {left[-1]} _" if len(left) > 1 else None, f"{left[-1]} _" if left else None, f"{left[-1]} _ {right[0]}" if left and right else None, f"_ {right[0]} {right[1]}" if len(right) > 1 else None]
        edges |= {(kind, lower(value), p) for p in near if p}
    known = {}
    for turn in range(1, pii.ROUNDS + 1):
        sure = {}
        for pattern in {p for _, _, p in edges}:
            kinds = [k if k != "other" else known.get(v, (None,))[0] for k, v, p in edges if p == pattern]
            for kind in pii.KINDS:
                n = kinds.count(kind)
                c = n / (sum(k is not None for k in kinds) + 0.1 * kinds.count(None) + 0.5)
                if n >= 5 and c >= 0.8:
                    sure.setdefault(pattern, []).append((kind, c))
        scores = {}
        for kind, value, pattern in edges:
            if kind == "other" and value not in known:
                for k, c in sure.get(pattern, []):
                    if fits(k, value):
                        scores[value, k] = scores.get((value, k), 0.0) + math.log(1 - c)
        best = {}
        for (value, k), s in scores.items():
            score = round(1 - math.exp(s), 9)
            if score >= 0.9:
                best[value] = max(best.get(value, ()), (score, -pii.KINDS.index(k)))
        if not best:
            break
        known |= {v: (pii.KINDS[-i], turn) for v, (_, i) in best.items()}
    out = []
    for own in found:
        out.append(sorted([(x[0], x[1], x[2], 0) for x in own if x[0] != "other"] + [(known[lower(x[3])][0], x[1], x[2], known[lower(x[3])][1]) for x in own if x[0] == "other" and lower(x[3]) in known]))
    return out


def ours(spark, texts, parts=3):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, kind string, row_no int").repartition(parts)
    rows, spans = pii.personal_data(df)
    got = {i: [] for i in range(len(texts))}
    for r in rows.join(spans, "row_no").collect():
        got[r.id].append((r.kind, r.start, r.end, r.round))
    return [sorted(got[i]) for i in range(len(texts))]


def test_query_equals_its_sql(spark):
    assert_same(pii.op13_pii(spark, DIR), DIR, pii.OP13_SQL)


def taught():
    """Phones and addresses in telling contexts, then other forms in these contexts, then in contexts that only they have."""
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = [f"Well Ä {'so ' * (i % 3)}please call me at +1 (2{digits(2)}) 555-{digits(4)} today folks" for i in range(9)]
    texts += [f"the server lives at host 10.{i}.3.{i} in rack nine" for i in range(7)]
    local = [f"03{i}-555-{digits(4)}" for i in range(8)]
    texts += [f"Please call me at {n}, today folks" for n in local]
    texts += [f"our hotline ring {n} nonstop always" for n in local]
    texts += [f"Our hotline ring (04{i}) 777{digits(3)} nonstop always" for i in range(3)]
    texts += ["the server lives at host 10.300.3.4 in rack nine", "please call me at 17 today folks", "please call me at room12 today folks", "order 12345678 shipped to dock", "order 1234567 went out", "", None, f"copy of {local[0]} elsewhere"]
    return texts


def test_patterns_tell_other_identifiers_in_rounds(spark):
    texts = taught()
    want = brute(texts)
    assert {r for own in want for *_, r in own} == {0, 1, 2}
    assert ours(spark, texts) == want == ours(spark, texts * 1, 1)
    assert [own for own in want[-8:] if own] == [[("ip", 25, 35, 1)], [("phone", 8, 20, 1)]]


def test_the_sql_tells_them_too(spark, tmp_path):
    texts = taught()
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    assert_same(pii.op13_pii(spark, str(tmp_path)), str(tmp_path), pii.OP13_SQL)
    assert duckdb.sql(pii.OP13_SQL.replace("FROM documents", f"FROM '{tmp_path}/documents.parquet'")).df()["n_told"].sum() > 15


def test_forms_in_linear_time_are_those_of_the_contract(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for letters in ("ab1.@-", "12. -", "+1 (2)-.", "a_@.1+%Ä ", "4 -", "0125.") for _ in range(60)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "x@y-.z@k.l", "4539 1488 0343 6467", "4539-1488-0343-6467 1", "+12345678 90", "256.1.1.1", "000.00255.1.1"]
    assert ours(spark, texts) == brute(texts)


def test_odd_rows(spark):
    """Null, empty and very long texts, runs without end, many matches in one text, repeated rows; no rows."""
    many = " ".join(f"u{i}@x.org 1.2.3.{i % 256}" for i in range(20_000))
    long = ["a" * 3_000_000, "1" * 1_000_000, "1." * 500_000, "a@b" + ".c" * 300_000, "+1" + " " * 500_000, "x_" * 500_000 + "@"]
    got = ours(spark, [None, "", "no data", "mail u@x.org", "mail u@x.org", many, *long])
    assert got[:5] == [[], [], [], [("email", 5, 12, 0)], [("email", 5, 12, 0)]]
    assert len(got[5]) == 40_000 and max(x[2] for x in got[5]) == len(many)
    assert got[6:] == [[], [], [("ip", 8 * i, 8 * i + 7, 0) for i in range(125_000)], [("email", 0, 600_003, 0)], [], []]
    assert ours(spark, []) == []


def test_scores_are_those_of_the_patterns(spark):
    edges = [("phone", f"+1{i}", "ring _") for i in range(9)] + [("ip", "1.1.1.1", "ring _"), ("other", "5550123", "ring _"), ("phone", "+9", "at _"), ("other", "5550123", "at _")]
    df = spark.createDataFrame(edges, "kind string, value string, pattern string")
    sure = pii.confident_patterns(df.withColumn("kind", F.when(F.col("kind") != "other", F.col("kind")))).collect()
    assert [(r.pattern, r.kind, round(r.confidence, 6)) for r in sure] == [("ring _", "phone", round(9 / 10.6, 6))]
    assert pii.discover(df, Scratch(spark, "pii-test")).count() == 0
