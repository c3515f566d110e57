"""Column functions on block and page text.

Spark's regex engine is told to treat letters, digits and white space as Unicode
does; U+001C to U+001F count as white space too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and phrases that decide what is noise.
PATENT_CLAIM = r"^\s*(\d+[\.、]\s*)?根据权利要求"
NUMBERED_CLAIM = r"^\s*(\[\d+\]\s*)?(\d+[\.、]\s*)?根据权利要求"
PATENT_NUMBER = r"CN\s*\d+"
CLAIMS_TITLE = "权利要求书"
HEADING = r"^\d+(\.\d+)*\s+[A-Za-z一-龥]"
TITLE_PREFIX = "Defect band formation in high pressure die casting"
CITED_AUTHOR = r"\[\d+\]\s*[A-Z][a-z]+"
CITED_PAGES = r"\d{4},\s*\d+(\(\d+\))?:\s*\d+[-–]\s*\d+"
CITED_TITLE = r"《.+?》\s*\.\s*\d{4}"
THESIS_DATABASE = "学位论文全文数据库"
JOURNAL, ISSUE = "特种铸造及有色合金", "期"
NO_DEFECT_CLAIM = "所述期望缺陷类型包括无缺陷"
CAPTION = r"((?:Fig(?:ure)?\.?|图)\s*\d+[\.:\s][^\n\r]+(?:\n[^\n\r]+)?)"
SHORTEST_BLOCK, SHORT_TEXT = 50, 100

_SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def normalize_whitespace(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(text, rf"(?U){_SPACE}+", " "))


def _once(text: Column, rule) -> Column:
    """rule(stripped text) with the stripping done once."""
    return F.element_at(F.transform(F.array(strip(text)), rule), 1)


def _long_enough(t: Column) -> Column:
    return (F.length(t) >= SHORTEST_BLOCK) & ~t.rlike(r"(?U)^\d+$")


def _claims(t: Column) -> Column:
    return t.rlike("(?U)" + PATENT_CLAIM) | (F.regexp_count(t, F.lit("(?U)" + PATENT_NUMBER)) >= 2) | F.substring(t, 1, 30).contains(CLAIMS_TITLE)


def _reason(t: Column) -> Column:
    short = F.length(t) < SHORT_TEXT
    return (
        F.when(short & F.lower(t).contains("keywords:"), "keywords")
        .when(short & t.rlike("(?U)" + HEADING), "heading")
        .when(short & t.startswith(TITLE_PREFIX), "title")
        .when(t.rlike("(?U)" + CITED_AUTHOR), "author")
        .when(t.rlike("(?U)" + CITED_PAGES), "pages")
        .when(t.rlike("(?Ud)" + CITED_TITLE), "book")
        .when(t.contains(THESIS_DATABASE), "thesis")
        .when(t.contains(JOURNAL) & t.contains(ISSUE), "journal")
        .when(F.regexp_count(t, F.lit("(?U)" + PATENT_NUMBER)) >= 2, "patents")
        .when(t.rlike("(?U)" + NUMBERED_CLAIM), "claim")
        .when(t.contains(NO_DEFECT_CLAIM), "no_defect")
    )


def keep_text_block(text: Column) -> Column:
    return _once(text, _long_enough)


def is_patent_claim(text: Column) -> Column:
    return _once(text, _claims)


def noise_reason(text: Column) -> Column:
    """Name of the first rule that calls the text noise, else null."""
    return _once(text, _reason)


def is_noise(text: Column) -> Column:
    return noise_reason(text).isNotNull()


def is_clean_block(text: Column) -> Column:
    """Long enough, and neither a patent claim nor noise."""
    return _once(text, lambda t: _long_enough(t) & ~_claims(t) & _reason(t).isNull())


def sliding_chunks(df: DataFrame, text_col: str, size: int = 400, overlap: int = 50, piece_col: str = "piece") -> DataFrame:
    """A row for each piece of ``size`` code points, ``overlap`` of them shared with the piece before.

    The step is at least 1. Pieces are stripped, empty ones dropped, and the first
    piece that reaches the end is the last. ``piece_col`` is the piece's number.
    """
    step = max(1, size - overlap)
    length = F.length(text_col)
    last = F.greatest(F.lit(0), F.ceil((length - size) / F.lit(step))).cast("int") * step
    starts = F.when(length > 0, F.sequence(F.lit(0), last, F.lit(step)))
    others = [c for c in df.columns if c != text_col]
    pieces = df.select(*others, text_col, F.posexplode(starts).alias(piece_col, "_start"))
    return pieces.select(*others, piece_col, strip(F.substring(F.col(text_col), F.col("_start") + 1, F.lit(size))).alias(text_col)).filter(F.length(text_col) > 0)


def extract_captions(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """A row for each caption: ``ordinal`` counts matches on the page from 1, ``caption`` has its white space collapsed."""
    found = F.regexp_extract_all(F.col(text_col), F.lit("(?iuU)" + CAPTION), F.lit(1))
    others = [c for c in df.columns if c != text_col]
    return df.select(*others, F.posexplode(found).alias("_n", "_caption")).select(*others, (F.col("_n") + 1).alias("ordinal"), normalize_whitespace(F.col("_caption")).alias("caption"))
