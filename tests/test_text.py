import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import text as X
from tests.conftest import rows


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def chunks(text, size, overlap):
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if piece := text[start:end].strip():
            out.append(piece)
        if end == len(text):
            break
        start += max(1, size - overlap)
    return out


@pytest.mark.parametrize("length", [0, 1, 399, 400, 401, 750, 751, 1100, 1101])
def test_sliding_chunks_follow_the_sequential_rule(spark, length):
    text = ("aé日 b" * 400)[:length]
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = [r.text for r in X.sliding_chunks(df, "text").orderBy("piece").collect()]
    assert got == chunks(text, 400, 50)


def test_step_is_at_least_one(spark):
    df = spark.createDataFrame([(1, "abcdef")], "id int, text string")
    assert [r.text for r in X.sliding_chunks(df, "text", 3, 9).orderBy("piece").collect()] == ["abc", "bcd", "cde", "def"]


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("KeyWords: a", "keywords"),
        ("x" * 95 + "keywords:", None),
        ("3.1 Results", "heading"),
        ("3.1 结果", "heading"),
        ("Defect band formation in high pressure die casting of x", "title"),
        ("see [12] Smith", "author"),
        ("see [12] smith", None),
        ("2009, 60: 1432–1441", "pages"),
        ("2009, 60(3): 1-2", "pages"),
        ("《书》 . 2019", "book"),
        ("《书\n》. 2019", None),
        ("学位论文全文数据库", "thesis"),
        ("特种铸造及有色合金", None),
        ("特种铸造及有色合金 3期", "journal"),
        ("CN 1", None),
        ("CN 1, CN2", "patents"),
        ("[3] 1、根据权利要求", "claim"),
        ("所述期望缺陷类型包括无缺陷", "no_defect"),
    ],
)
def test_noise_rules(spark, text, reason):
    assert one(spark, text, X.noise_reason) == reason


def test_blocks(spark):
    assert one(spark, " " + "a" * 49 + " ", X.keep_text_block) is False
    assert one(spark, "a" * 50, X.keep_text_block) is True
    assert one(spark, "1" * 60, X.keep_text_block) is False
    assert one(spark, "x" * 25 + "权利要求书", X.is_patent_claim) is True
    assert one(spark, "x" * 30 + "权利要求书", X.is_patent_claim) is False
    assert one(spark, "\x1c a \x1f　b ", X.normalize_whitespace) == "a b"


def test_captions_are_numbered_by_place(spark):
    text = "Figure 7. first \t one\nnext line\n\nfig 2: two\n\n图 5：none\n图5 three"
    df = spark.createDataFrame([("f", 1, text)], "source_file string, page int, raw_text string")
    assert rows(X.extract_captions(df), "ordinal", "caption") == [(1, "Figure 7. first one next line"), (2, "fig 2: two"), (3, "图5 three")]
