import time

from pyspark.sql import functions as F

from corpusgraph.llm import url_filter as U
from tests.compare import assert_same
from tests.conftest import rows

DIR = "/root/testdata/sf0.001"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def brute(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


URLS = ["http://a.example.NET/en/x?y#z", "http://example.net/EN/", "https://x.net", "http://net/", "http://xnet/", "http://u:p@a.b.net:80/q", "ftp://EXAMPLE.com/de/1", "http://example.com/DE/", "http://a.org/fr/x", "http://É.net/", "", None, "nothing", "://net/", "http://a//b://c", "http://x.net/\n/en/", "http://" + "a." * 300 + "net/" + "x" * 5000]


def test_rules_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(0, URLS[0], "again"), (None, URLS[3], None)], "page_id long, url string, rule string")
    want = sorted([(i, *brute(u, RULES)) for i, u in enumerate(URLS)] + [(0, *brute(URLS[0], RULES)), (None, *brute(URLS[3], RULES))], key=repr)
    assert rows(U.judge_urls(pages, U.rules_table(spark))) == want


def test_long_lists_take_the_salted_join_and_the_filter_as_a_table(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_RULES", 2)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    for most in (U.MOST_WORDS, 1):
        assert rows(U.judge_urls(pages, U.rules_table(spark), most_words=most)) == sorted([(i, *brute(u, RULES)) for i, u in enumerate(URLS)], key=repr)


def test_urls_without_a_possible_hit_do_not_move(spark):
    pages = spark.createDataFrame([(i, f"http://host{i}.dev/x") for i in range(3000)], "page_id long, url string")
    possible = U._possible(pages.select("page_id", F.array(F.struct(F.regexp_extract("url", "//([^/]*)", 1).alias("rule_host"), F.lit("/").alias("rule_path"))).alias("keys")), U.canonical_rules(U.rules_table(spark)), 64)
    assert possible.filter(F.size("hits") > 0).count() < 300


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    rules = [("block", f"h{i}.x", "/p/") for i in range(2000)]
    listed = U.canonical_rules(U.rules_table(spark, rules[:1])).limit(0)
    listed = U.canonical_rules(spark.createDataFrame(rules, "action string, host string, path string"))
    words = U.bloom_words(2000)
    assert words == 512 and U.bloom_words(10**7) * U.WORD_KEYS > 10**7
    bloom = U.blocked_bloom(listed, words)
    keys = spark.range(4000).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".x/p/")).alias("key"), "id")
    hit = keys.withColumn("word", U._word(F.col("key"), words)).join(bloom, "word").filter(F.col("bits").bitwiseAND(U._mask(F.col("key"))) == U._mask(F.col("key")))
    assert hit.filter("id < 2000").count() == 2000
    assert hit.filter("id >= 2000").count() < 40


def test_filter_is_laid_out_in_proportion_to_the_list(spark):
    """Each word stands in its place, and 16 times the rules take less than 24 times the time of the larger start."""
    took = []
    for n in (65_536, 1_048_576):
        listed = spark.range(n).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".x/")).alias("rule"))
        words, began = U.bloom_words(n), time.time()
        row = U.filter_array(listed, words).first()
        took.append(time.time() - began)
        assert len(row["filter"]) == words
    assert took[1] < 24 * max(took[0], 1)
    some = spark.range(50).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("rule"))
    words = U.bloom_words(50)
    want = {r.word: r.bits for r in U.blocked_bloom(some, words).collect()}
    assert U.filter_array(some, words).first()["filter"] == [want.get(i, 0) for i in range(words)]


def test_empty_list_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    none = U.rules_table(spark).limit(0)
    assert rows(U.judge_urls(pages, none), "rule", "verdict") == [(None, "allow")]
    assert U.judge_urls(pages.limit(0), U.rules_table(spark)).count() == 0


def test_query(spark):
    assert_same(U.op2_url_filter(spark, DIR), DIR, U.OP2_SQL)
