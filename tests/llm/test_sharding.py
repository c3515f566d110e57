from collections import Counter

import pytest

from corpusgraph.llm import sharding as S
from tests.compare import assert_same

DIR = "/root/testdata/sf0.001"


def test_table_is_full_even_and_stable():
    names = S.shard_names(20)
    full = S.fill_table(names, 2003)
    assert set(Counter(full).values()) <= {100, 101}
    less = S.fill_table(names[:-1], 2003)
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != 19)
    assert moved < 0.2 * 2003


@pytest.mark.parametrize(("names", "slots"), [([], 7), (["a", "a"], 7), (["a", "b"], 8), (["a", "b"], 2)])
def test_bad_tables_are_refused(names, slots):
    with pytest.raises(ValueError):
        S.fill_table(names, slots)


def test_query_and_odd_rows(spark):
    assert_same(S.op3_sharding(spark, DIR), DIR, S.OP3_SQL)
    odd = spark.createDataFrame([(None, "x"), ("", "y"), ("k", "z"), ("k", "z")], "key string, slot string")
    got = S.place_rows(odd, "key", S.shard_names()).collect()
    assert len(got) == 4 and len({r.shard for r in got if not r.key}) == 1 and len({r.shard for r in got if r.key}) == 1
    assert S.place_rows(odd.limit(0), "key", S.shard_names()).count() == 0


def test_more_shards_than_two_bytes_hold(spark):
    names = [f"s{i}" for i in range(70_000)]
    table = S.lookup_table(spark, names, 140_009)
    got = table.agg({"shard": "max", "slot": "count"}).first()
    assert got[0] == 69_999 and got[1] == 140_009
