"""From page layout tables to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import dense_index
from ..functions.text import extract_captions, is_clean_block, normalize_whitespace, sliding_chunks, strip

PAGE = ["source_file", "page"]
#: A page's tables, figures and texts come in this order.
KINDS = ("table", "figure", "text")


def file_id(col):
    return F.regexp_replace(col, r"\.[^.]+$", "")


def table_chunks(page_tables: DataFrame) -> DataFrame:
    """Tables whose stripped markdown has more than 20 characters."""
    return page_tables.filter(F.length(strip(F.col("markdown"))) > 20).select(
        F.lit("table").alias("modality"), F.col("markdown").alias("text"), *PAGE, file_id(F.col("source_file")).alias("fileid"), F.lit(None).cast("string").alias("figure_save_path"), F.col("table_no").alias("no"), F.lit(0).alias("piece")
    )


def figure_chunks(page_images: DataFrame, page_text: DataFrame, folder: str = "") -> DataFrame:
    """Images of at least 150 x 150 and 5000 bytes with the caption of their ordinal among all images of the page."""
    captions = extract_captions(page_text.select(*PAGE, "raw_text"))
    large = page_images.filter((F.col("width") >= 150) & (F.col("height") >= 150) & (F.col("n_bytes") >= 5000)).withColumn("ordinal", F.col("figure_index") + 1)
    fallback = F.format_string("illustration on the page%d", F.col("page"))
    path = F.format_string(f"{folder.replace('%', '%%')}%s_page%d_fig%d.%s", file_id(F.col("source_file")), F.col("page"), F.col("ordinal"), F.col("ext"))
    return large.join(captions, [*PAGE, "ordinal"], "left").select(
        F.lit("figure").alias("modality"), F.coalesce("caption", fallback).alias("text"), *PAGE, file_id(F.col("source_file")).alias("fileid"), path.alias("figure_save_path"), F.col("figure_index").alias("no"), F.lit(0).alias("piece")
    )


def drop_blocks_inside_tables(blocks: DataFrame, page_tables: DataFrame) -> DataFrame:
    """Blocks more than half of whose area lies in one kept table of their page go."""
    t = page_tables.filter(F.length(strip(F.col("markdown"))) > 20).select(*PAGE, *[F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")])
    width = F.least("x1", "tx1") - F.greatest("x0", "tx0")
    height = F.least("y1", "ty1") - F.greatest("y0", "ty0")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    inside = (width > 0) & (height > 0) & (width * height / (area + 1e-6) > 0.5)
    on_page = (blocks["source_file"] == t["source_file"]) & (blocks["page"] == t["page"])
    return blocks.join(t, on_page & inside, "left_anti")


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that are long enough and neither patent claims nor noise."""
    return blocks.filter(is_clean_block(F.col("text")))


def text_chunks(blocks: DataFrame, page_tables: DataFrame | None = None, size: int = 400, overlap: int = 50) -> DataFrame:
    kept = clean_blocks(blocks)
    if page_tables is not None:
        kept = drop_blocks_inside_tables(kept, page_tables)
    pieces = sliding_chunks(kept.select(*PAGE, "block_no", normalize_whitespace(F.col("text")).alias("text")), "text", size, overlap)
    return pieces.select(F.lit("text").alias("modality"), "text", *PAGE, file_id(F.col("source_file")).alias("fileid"), F.lit(None).cast("string").alias("figure_save_path"), F.col("block_no").alias("no"), "piece")


def assemble_chunks(*parts: DataFrame) -> DataFrame:
    """All chunks numbered from 0: texts before tables and figures, each by file, page, kind, number and piece."""
    chunks = parts[0]
    for more in parts[1:]:
        chunks = chunks.unionByName(more)
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("modality"))
    ordered = chunks.withColumn("_media", (F.col("modality") != "text").cast("int")).withColumn("_kind", kind)
    return dense_index(ordered, ["_media", "source_file"], ["page", "_kind", "no", "piece", "text"], "index").drop("_media", "_kind", "no", "piece")
