import hashlib

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusgraph.llm import bpe

PATH = bpe.vocabulary_path()
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.ForcedBoundaryBpe(open(PATH, encoding="utf-8").read())


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.sampled_from([*"ab 'strdlmve\n\t\r\u2028\u3000\x1f12!?éß日", "<|endoftext|>", "  "]), st.characters(exclude_categories=["Cs"])), max_size=60).map("".join))
def test_same_ids_and_text_as_the_library(text):
    ids = library(text)
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_all_code_points():
    """Each code point behind a letter, a space and itself, a thousand to a text."""
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for a in range(0, len(points), 1000):
        text = "".join(f"a{c} {c}{c}1" for c in points[a : a + 1000])
        ids = library(text)
        assert OWN.encode(text) == ids
        assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_memory_is_bounded_by_bytes(monkeypatch):
    own = bpe.ForcedBoundaryBpe(open(PATH, encoding="utf-8").read())
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 10_000)
    for i in range(300):
        text = f" word{i} next{i * 7}é"
        assert own.encode(text) == library(text)
        assert own.known_words.held + own.known.held < 20_000


@settings(max_examples=100, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from([*"aaaeotinshr ", "é", "日", "\U0001f600"]), min_size=1, max_size=30), min_size=1, max_size=40))
def test_many_words_at_once_as_one_by_one(words):
    assert OWN.in_order and OWN.many_words(words) == [OWN.word_ids(w) for w in words]


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["a", "it's", " ", "  ", "\n", " \n", "\t ", "12", "!", "'s", "é", "日本", "\u3000", "\x1f", "<|endoftext|>", "x" * 70]), max_size=25).map("".join))
def test_pieces_between_single_spaces(text):
    assert OWN.encode(text) == library(text)


def test_pair_table_finds_what_is_there_and_nothing_else():
    keys = np.array([a << 20 | b for a, b in OWN.merged], dtype=np.int64)
    assert (OWN.table.find(keys) == np.array(list(OWN.merged.values()))).all()
    none = np.array([k for k in range(10**6, 10**6 + 5000) if (k >> 20, k & 0xFFFFF) not in OWN.merged], dtype=np.int64)
    assert (OWN.table.find(none) == bpe._NEVER).all()


def test_cuts_lie_on_token_boundaries():
    word = "supercalifragilistic§日本xq"
    ends, at = set(), 0
    for i in OWN.encode(word):
        at += len(OWN.bytes_of[i])
        ends.add(at)
    cuts, at = set(), 0
    for part in OWN.fragments(word.encode()):
        at += len(part)
        cuts.add(at)
    assert cuts <= ends and len(cuts) > 1


def test_long_runs_and_both_merges():
    text = "ab" * 20_000 + "é" * 20_000 + "zq" * 50
    assert OWN.encode(text) == library(text)
    ids = [OWN.single[b] for b in b"internationalization"]
    assert OWN._merge_short(list(ids)) == OWN._merge_long(list(ids))


def test_query_equals_the_library(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in bpe.op6_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = library(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False)))


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "hi there", 7), (3, "hi there", 7), (None, "x" * 10_000, 8)], "doc_id long, text string, ids int")
    got = bpe.decode_ids(bpe.encode_texts(df, PATH), PATH).collect()
    assert sorted((r.text or "") == r.decoded for r in got) == [True] * 5
    assert bpe.token_digests(df.limit(0), PATH).count() == 0
