"""Audit: what became of every line, and summaries of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lines import KEY


def assignments(sectioned: DataFrame, line_blocks: DataFrame) -> DataFrame:
    """upload_id, line_index, section_id, assignment, assigned, block of every line with text.

    A line that is nothing but a bullet takes the block of the next line of its section that has one.
    """
    rows = sectioned.where("trim(line) <> ''").join(line_blocks, [KEY, "line_index"], "left")
    following = Window.partitionBy(KEY, "section_id").orderBy("line_index").rowsBetween(1, Window.unboundedFollowing)
    glyph = F.col("line").rlike(r"^\s*[•▪●○◦·*\-–—]\s*$")
    rows = rows.withColumn("next_block", F.first("block", ignorenulls=True).over(following))
    assignment = (
        F.when(F.col("is_page_number"), "page_number_marker")
        .when(glyph & F.col("next_block").isNotNull(), "bullet_marker_for_following_content")
        .when(glyph, "decorative_bullet_marker")
        .when(F.col("heading").isNotNull() & F.col("block").isNotNull(), "section_heading_and_block_content")
        .when(F.col("heading").isNotNull(), "section_heading")
        .when(F.col("block").isNotNull(), "context_block")
        .otherwise("unassigned_content")
    )
    return rows.select(KEY, "line_index", "section_id", assignment.alias("assignment"), (assignment != "unassigned_content").alias("assigned"), F.when(glyph & ~F.col("is_page_number"), F.col("next_block")).otherwise(F.col("block")).alias("block"))


def from_blocks(grouped: DataFrame) -> DataFrame:
    """upload_id, line_index, block, section_id, section: what blocks by themselves tell of each line, where no audit was kept."""
    return grouped.select(KEY, F.explode("line_indices").alias("line_index"), "block", "section_id", "section")


def section_rollup(assigned: DataFrame) -> DataFrame:
    """upload_id, section_id, lines, headings, blocks, first_line."""
    return assigned.groupBy(KEY, "section_id").agg(
        F.count("*").alias("lines"), F.count_if(F.col("assignment").isin("section_heading", "section_heading_and_block_content")).alias("headings"), F.count_distinct("block").alias("blocks"), F.min("line_index").alias("first_line")
    )


def summary(assigned: DataFrame) -> DataFrame:
    """Per upload: lines, assigned, page numbers, headings, block lines, unassigned, blocks, sections, complete."""
    a = F.col("assignment")
    return assigned.groupBy(KEY).agg(
        F.count("*").alias("lines"), F.count_if("assigned").alias("assigned"), F.count_if(a == "page_number_marker").alias("page_numbers"), F.count_if(a == "section_heading").alias("headings"), F.count_if(a == "context_block").alias("block_lines"),
        F.count_if(~F.col("assigned")).alias("unassigned"), F.count_distinct("block").alias("blocks"), F.count_distinct("section_id").alias("sections"), F.bool_and("assigned").alias("complete"),
    )
