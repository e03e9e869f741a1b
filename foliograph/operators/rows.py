"""Rows of a layout put right: markers handed on, numbers, and what was decided written back to lines and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

KEY = "upload_id"
GLYPH = r"^\s*[•▪●○◦·*–—-]\s*$"


def _order(*by: str):
    return Window.partitionBy(KEY, *by).orderBy("reading_order", "block_id")


def handed_markers(blocks: DataFrame) -> DataFrame:
    """block_id, next_id, marker: a row that is nothing but a bullet gives it to the next row of its section that is no bullet."""
    rows = blocks.where("text is not null and trim(text) <> ''").select(KEY, "section_id", "block_id", "reading_order", "text", F.col("text").rlike(GLYPH).alias("glyph"))
    order = _order("section_id")
    rows = rows.withColumn("next_id", F.lead("block_id").over(order)).withColumn("next_glyph", F.lead("glyph").over(order))
    return rows.where("glyph and next_id is not null and not next_glyph").select("block_id", "next_id", F.trim("text").alias("marker"))


def numbered(blocks: DataFrame) -> DataFrame:
    """upload_id, block_id, number (from 1), normalized, label, is_page_marker of rows with text."""
    rows = blocks.where("text is not null").withColumn("number", F.row_number().over(_order()))
    return rows.select(KEY, "block_id", "number", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("normalized"), F.coalesce("block_type", F.lit("UNKNOWN")).alias("label"), F.col("text").rlike(text.PAGE_NUMBER).alias("is_page_marker"))


def written_back(sentences: DataFrame, blocks: DataFrame) -> DataFrame:
    """upload_id, sentence_index, line_index, section, sentence: sections as the rows have them, sentences of artifacts left out, numbered anew."""
    decided = blocks.where("line_index is not null").groupBy(KEY, "line_index").agg(F.max("section").alias("new_section"), F.bool_or(F.col("block_type") == "PAGE_ARTIFACT").alias("artifact"))
    kept = sentences.join(decided, [KEY, "line_index"], "left").where(~F.coalesce("artifact", F.lit(False)))
    number = F.row_number().over(Window.partitionBy(KEY).orderBy("sentence_index")) - 1
    return kept.withColumn("sentence_index", number).select(KEY, "sentence_index", "line_index", F.coalesce("new_section", "section").alias("section"), "sentence")


def detached_education(blocks: DataFrame) -> DataFrame:
    """block_id, section_id of rows with a bare year and a score next to it that stand among personal details: they go back to the last section of education before them."""
    score = r"(?i)^\s*(?:(?:c?gpa|score|percentage|grade)\s*[:\-]?\s*)?\d{1,3}(?:\.\d+)?\s*(?:%|/\s*\d+(?:\.\d+)?)?\s*$"
    year = r"^\s*(?:19|20)\d{2}\s*$"
    rows = blocks.where("text is not null").select(KEY, "block_id", "reading_order", "section", "section_id", "text")
    upto = _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("school", F.last(F.when(F.col("section") == "Education", F.col("section_id")), ignorenulls=True).over(upto))
    pair = lambda other: F.coalesce(other("section") == F.col("section"), F.lit(False))
    before, after = (lambda c: F.lag(c).over(_order())), (lambda c: F.lead(c).over(_order()))
    is_year, is_score = F.col("text").rlike(year), F.col("text").rlike(score) & ~F.col("text").rlike(year)
    rows = rows.withColumn("y", is_year).withColumn("s", is_score)
    one = F.col("y") & ((after("s") & pair(after)) | (before("s") & pair(before))) | F.col("s") & ((after("y") & pair(after)) | (before("y") & pair(before)))
    return rows.withColumn("one", F.coalesce(one, F.lit(False))).where(F.col("section").isin("Personal Details", "Personal Information", "Languages") & F.col("one") & F.col("school").isNotNull()).select("block_id", F.col("school").alias("section_id"))


def implicit_employment(classed: DataFrame, order: str = "line_index") -> DataFrame:
    """upload_id, line_index, section_id of documents without a heading of employments: from a row shaped like an employment on, to the end of its section.

    ``classed`` has section, section_id, heading, and employer: whether the row reads like the head of an employment.
    """
    known = classed.groupBy(KEY).agg(F.bool_or(F.col("heading") == "Experience").alias("has"))
    rows = classed.join(known.where(~F.coalesce("has", F.lit(False))).select(KEY), KEY, "left_semi")
    upto = Window.partitionBy(KEY, "section_id").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.last(F.when(F.col("employer"), F.col(order)), ignorenulls=True).over(upto)
    return rows.withColumn("opened", opened).where("opened is not null and heading is null").select(KEY, order, F.concat(F.lit("semantic:"), F.col("opened").cast("string"), F.lit(":Experience")).alias("section_id"))


def timeline_lanes(blocks: DataFrame, gap: float = 18.0, least: int = 4) -> DataFrame:
    """block_id, new_type of pages of employments set in two lanes, dates on the left and titles on the right: the first other left row after a date is the employer, further ones are places.

    Lanes are told by the widest gap between the left edges of a section's rows; each lane needs ``least`` rows, the left two dates and the right two titles.
    """
    from . import classify
    from .layout import box

    rows = box(blocks).where("section = 'Experience' and text is not null and block_type <> 'PAGE_ARTIFACT'").select(KEY, "section_id", "page", "block_id", "reading_order", "text", "x0", "y0", "block_type")
    edges = rows.select(KEY, "section_id", "x0").distinct().withColumn("next", F.lead("x0").over(Window.partitionBy(KEY, "section_id").orderBy("x0")))
    cuts = edges.where(F.col("next") - F.col("x0") >= gap).groupBy(KEY, "section_id").agg(F.max_by((F.col("next") + F.col("x0")) / 2, F.struct(F.col("next") - F.col("x0"), -F.col("x0"))).alias("cut"))
    rows = rows.join(cuts, [KEY, "section_id"]).withColumn("left", F.col("x0") < F.col("cut")).withColumn("date", F.col("block_type") == "DATE_RANGE").withColumn("title", classify.role_title(F.col("text")))
    n = lambda c: F.count_if(c)
    two = rows.groupBy(KEY, "section_id").agg(n(F.col("left")).alias("l"), n(~F.col("left")).alias("r"), n(F.col("left") & F.col("date")).alias("d"), n(~F.col("left") & F.col("title")).alias("t")).where(f"l >= {least} and r >= {least} and d >= 2 and t >= 2")
    lane = rows.where("left").join(two.select(KEY, "section_id"), [KEY, "section_id"], "left_semi")
    order = Window.partitionBy(KEY, "section_id").orderBy("page", "y0", "block_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lane = lane.withColumn("dates", F.sum(F.col("date").cast("int")).over(order)).where("dates > 0 and not date")
    nth = F.row_number().over(Window.partitionBy(KEY, "section_id", "dates").orderBy("page", "y0", "block_id"))
    return lane.withColumn("nth", nth).select("block_id", F.when(F.col("nth") == 1, "COMPANY").otherwise("LOCATION").alias("new_type"))
