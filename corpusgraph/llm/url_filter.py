"""URL filtering against a list of canonical URLs (DataFrame functions only).

Every url is cut into host and path; its candidate keys are all host suffixes
times all path prefixes that a listed rule could have. A blocked Bloom filter of
the listed keys, sized from their number, throws out almost all candidates inside
the row; only urls with a possible hit move on to an exact hash join with the list,
which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: Listed keys for a word of 64 bits of the filter: 16 bits a key, of which it sets BLOOM_BITS; about 1 in 300 strangers passes.
WORD_KEYS = 4
BLOOM_BITS = 4
#: Words of a filter that goes to every task (8 MB) at most; a longer list's filter is a table that candidates meet by word.
MOST_WORDS = 1 << 20
#: A list of at most so many rules, and so many characters, is broadcast; a longer one is shuffled.
BROADCAST_RULES = 100_000
BROADCAST_CHARS = 8_000_000
#: Copies of a rule, and parts of a popular key, in the shuffled join.
SALTS = 16


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; "" without "://" or for null."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to "?", "#" or the end; "" without "://" or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_rules(rules: DataFrame) -> DataFrame:
    """(host, path, action) rows -> one row per key: rule = host + path.

    Null hosts or actions are dropped, a null path is empty. A key listed with
    several actions is blocked if any of them blocks.
    """
    host, path = ascii_lower(F.col("host")), F.coalesce(F.col("path"), F.lit(""))
    return (
        rules.filter(F.col("host").isNotNull() & F.col("action").isNotNull())
        .select(host.alias("rule_host"), path.alias("rule_path"), "action")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("action").alias("action"))
        .withColumn("rule", F.concat("rule_host", "rule_path"))
    )


def bloom_words(n_rules: int) -> int:
    """Words of the filter of so many keys: a power of two, so that about WORD_KEYS keys share a word."""
    return 1 << max(6, (max(1, n_rules) // WORD_KEYS).bit_length())


#: Words of the filter that are laid out at once.
RUN_WORDS = 64


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("int")


def _mask(key: Column) -> Column:
    hashed = F.xxhash64(key, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(hashed, 6 * i), F.lit(64)).cast("int")) for i in range(BLOOM_BITS)]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return mask


def blocked_bloom(rules: DataFrame, words: int) -> DataFrame:
    """The filter's words that are not empty: (word, bits)."""
    return rules.groupBy(_word(F.col("rule"), words).alias("word")).agg(F.bit_or(_mask(F.col("rule"))).alias("bits"))


def filter_array(listed: DataFrame, words: int) -> DataFrame:
    """(filter): one row with all words of the filter, empty ones too.

    Runs of RUN_WORDS words are laid out side by side, each from a map of its own, as
    a map is searched from its start; so the work grows with the words.
    """
    runs = listed.sparkSession.range(-(-words // RUN_WORDS)).withColumnRenamed("id", "run")
    filled = blocked_bloom(listed, words).groupBy(F.floor(F.col("word") / RUN_WORDS).alias("run")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("word") % RUN_WORDS, "bits"))).alias("m"))
    laid = F.transform(F.sequence(F.lit(0), F.lit(RUN_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    whole = runs.join(filled, "run", "left").select("run", laid.alias("bits")).agg(F.array_sort(F.collect_list(F.struct("run", "bits"))).alias("all"))
    return whole.select(F.flatten(F.transform("all", lambda r: r["bits"])).alias("filter"))


def _possible(urls: DataFrame, listed: DataFrame, words: int) -> DataFrame:
    """``urls`` with hits: the candidate keys (struct of host and path) that the filter lets pass.

    The filter is one array, worked out once and sent with the plan.
    """
    array = filter_array(listed, words).scalar()

    def passes(key: Column) -> Column:
        whole = F.concat(key["rule_host"], key["rule_path"])
        return F.get("filter", _word(whole, words)).bitwiseAND(_mask(whole)) == _mask(whole)

    return urls.withColumn("filter", array).withColumn("hits", F.filter("keys", passes)).drop("keys", "filter")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", most_words: int = MOST_WORDS) -> DataFrame:
    """Judges every url: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's
    path; the longest fitting rule wins (ties: the longer host). Urls that the
    list does not name get ``default``. Null urls, urls without "://" and empty
    ones have empty host and path. Equal rows each come back; ids may be null;
    other columns of ``pages`` are not read. An empty list or table is fine.
    """
    listed = canonical_rules(rules)
    size = listed.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.length("rule")), F.lit(0)).alias("chars"),
        F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(1)).alias("most_labels"),
        F.array_sort(F.collect_set(F.length("rule_path"))).alias("path_lengths"),
    ).first()
    small = size.n <= BROADCAST_RULES and size.chars <= BROADCAST_CHARS
    urls = (
        pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
        .select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    )
    labels = F.split("host", r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - size.most_labels + 1)
    suffixes = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # Lengths that listed paths have: no more of them than a path has letters.
    lengths = F.filter(F.array(*[F.lit(n) for n in size.path_lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(lengths, lambda n: F.col("path").substr(F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("rule_host"), p.alias("rule_path")))))
    words = bloom_words(size.n)
    if words <= most_words:
        judged = _possible(urls.withColumn("keys", keys), listed, words)
        clear = judged.filter(F.size("hits") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
        open_ = judged.filter(F.size("hits") > 0)
        hits = open_.select("page_id", "host", "path", F.inline("hits"))
    else:
        clear, open_ = None, urls
        each = urls.withColumn("keys", keys).select("page_id", "host", "path", F.inline("keys"))
        key = F.concat("rule_host", "rule_path")
        met = each.withColumn("word", _word(key, words)).join(blocked_bloom(listed, words), "word")
        hits = met.filter(F.col("bits").bitwiseAND(_mask(key)) == _mask(key)).select("page_id", "host", "path", "rule_host", "rule_path")
    exact = listed.select("rule_host", "rule_path", "rule", "action")
    if small:
        found = hits.join(F.broadcast(exact), ["rule_host", "rule_path"])
    else:
        salted = exact.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = hits.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(salted.hint("shuffle_hash"), ["rule_host", "rule_path", "salt"])
    best = F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "rule", "action")
    rows = open_.select("page_id", "host", "path", F.lit(1).alias("rows"), F.lit(None).cast("struct<n:int,h:int,rule:string,action:string>").alias("best"))
    won = (
        rows.unionByName(found.select("page_id", "host", "path", F.lit(0).alias("rows"), best.alias("best")))
        .groupBy("page_id", "host", "path")
        .agg(F.sum("rows").alias("rows"), F.max("best").alias("best"))
    )
    copies = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))
    out = won.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"), copies.alias("copy")).drop("copy")
    return clear.unionByName(out) if clear is not None else out


#: The rules of the query: action, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_table(spark))


OP2_SQL = r"""
WITH u AS (
  SELECT page_id,
         CASE WHEN contains(coalesce(url, ''), '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
SELECT page_id, host, path,
       (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
       coalesce((SELECT arg_max(action, length(rhost || rpath)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM u
"""
