"""Context blocks: which lines of a section belong together.

Every rule links a line to an earlier line of its section, so blocks are runs
of lines and a running count of the lines that start anew numbers them; no
general graph search is needed. All rules share one partitioning by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headings
from .lines import KEY

# --- Fixed values: cues of titles, actions, degrees, institutions and details of education. ---
JOB_CUE = r"(?i)\b(?:analyst|engineer|developer|consultant|manager|director|designer|architect|scientist|officer|specialist|associate|executive|lead|intern|accountant|administrator|coordinator|technician|teacher|nurse)\b"
YEAR_CUE = r"\b(?:19|20)\d{2}\b"
ACTION_CUE = r"(?i)\b(?:built|build|developed|created|implemented|designed|using|powered\s+by|based\s+on)\b"
PROJECT_CUE = r"(?i)\b(?:project|app|platform|system|dashboard|portal|tool)\b"
DEGREE_CUE = r"(?i)\b(?:bachelor|master|b\.?\s?tech|m\.?\s?tech|b\.?\s?sc|m\.?\s?sc|b\.?\s?a|m\.?\s?a|b\.?\s?com|mba|ph\.?\s?d|diploma|ll\.?\s?b|abitur)\b"
INSTITUTION_CUE = r"(?i)\b(?:university|universidad|institute|college|school|polytechnic|hochschule|academy)\b"
EDUCATION_DETAIL = r"(?i)\b(?:cgpa|gpa|grade|percentage|score|(?:19|20)\d{2})\b"


def section_kind(section: Column) -> Column:
    """The structural kind of a section name; a name without one is its own kind."""
    key = F.trim(F.regexp_replace(F.lower(section), r"[^a-z0-9]+", " "))
    kinds = F.create_map(*[F.lit(x) for pair in sorted(headings.by_section().items()) for x in pair])
    return F.coalesce(F.element_at(kinds, key), key)


def sentence_lines(sentences: DataFrame) -> DataFrame:
    """One row for each line with sentences: their indices in order, text, indent, marker, kind of section."""
    rows = sentences.groupBy(KEY, "section_id", "line_index").agg(
        F.first("section").alias("section"), F.first("line").alias("line"), F.first("indent").alias("indent"), F.first("is_bullet").alias("is_bullet"), F.sort_array(F.collect_list("sentence_index")).alias("sentence_indices")
    )
    return rows.withColumn("kind", section_kind(F.col("section")))


def joins(lines: DataFrame) -> DataFrame:
    """lines with ``joined`` (belongs with the line before it in its section) and the ``reason``."""
    order = Window.partitionBy(KEY, "section_id").orderBy("line_index")
    before = lambda c: F.lag(c).over(order)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    item_before = F.sum(F.col("is_bullet").cast("int")).over(earlier) > 0
    open_before = ~before("line").rlike(r"[.!?;]\s*$")
    deeper = F.col("indent") > before("indent")
    # a chain of continuations holds as long as every line of it continues
    continues = ~F.col("is_bullet") & item_before & (open_before | deeper)
    job_header = F.col("line").rlike(JOB_CUE) & F.col("line").rlike(YEAR_CUE) | F.col("line").rlike(r"\s[–—]\s") & F.col("line").rlike(JOB_CUE)
    title = F.col("line").rlike(PROJECT_CUE) & ~F.col("line").rlike(ACTION_CUE)
    degree, institution, detail = F.col("line").rlike(DEGREE_CUE), F.col("line").rlike(INSTITUTION_CUE), F.col("line").rlike(EDUCATION_DETAIL)
    rows = lines.withColumn("_continues", F.coalesce(continues, F.lit(False))).withColumn("_header", F.coalesce(job_header, F.lit(False)))
    rows = rows.withColumn("_broken", F.sum((~F.col("_continues") & ~F.col("is_bullet")).cast("int")).over(upto)).withColumn("_items", F.sum(F.col("is_bullet").cast("int")).over(upto))
    item = Window.partitionBy(KEY, "section_id", "_items").orderBy("line_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    unbroken = F.sum((~F.col("_continues") & ~F.col("is_bullet")).cast("int")).over(item) == 0
    next_line = F.col("line_index") == before("line_index") + 1
    wrapped = F.col("_continues") & unbroken
    experience = (F.col("kind") == "experience") & ~F.col("_header") & (F.sum(F.col("_header").cast("int")).over(earlier) > 0)
    project = (F.col("kind") == "projects") & ~title & (F.col("line").rlike(ACTION_CUE) | deeper) & (before("line").rlike(PROJECT_CUE) | before("line").rlike(ACTION_CUE))
    skill = (F.col("kind") == "skills") & ~F.col("is_bullet") & (before("line").rlike(r",\s*$") | deeper)
    plain = F.col("kind").isin("summary", "personal information") & next_line & ~F.col("is_bullet") & ~before("is_bullet")
    eligible = degree | institution | detail
    education = (F.col("kind") == "education") & eligible & ~F.col("is_bullet") & ~degree & next_line & (before("line").rlike(DEGREE_CUE) | before("line").rlike(INSTITUTION_CUE) | before("line").rlike(EDUCATION_DETAIL))
    reason = (
        F.when(before("line_index").isNull(), F.lit(None))
        .when(wrapped, "wrapped list item")
        .when(experience, "under the same employment")
        .when(project, "description of the project before")
        .when(skill, "wrapped list of skills")
        .when(plain, "plain lines of one section")
        .when(education, "detail of the education entry before")
    )
    return rows.withColumn("reason", reason).withColumn("joined", F.col("reason").isNotNull()).drop("_continues", "_header", "_broken", "_items")


def blocks(joined: DataFrame) -> DataFrame:
    """upload_id, block (from 0), section_id, section, entry_type, lines, sentences, text: the runs of joined lines."""
    order = Window.partitionBy(KEY).orderBy("line_index")
    run = F.sum((~F.col("joined")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    rows = joined.withColumn("block", run)
    grouped = rows.groupBy(KEY, "block", "section_id", "section", "kind").agg(
        F.sort_array(F.collect_list("line_index")).alias("line_indices"),
        F.sort_array(F.flatten(F.collect_list("sentence_indices"))).alias("sentence_indices"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_index", "line"))), lambda x: F.trim(x["line"])), " ").alias("text"),
        F.array_sort(F.collect_set("reason")).alias("reasons"),
    )
    header = F.col("text").rlike(JOB_CUE) & F.col("text").rlike(YEAR_CUE)
    entry = (
        F.when(F.col("kind") == "education", "education_entry")
        .when((F.col("kind") == "experience") & header, "experience_entry")
        .when(F.col("kind") == "experience", "experience_responsibility")
        .when(F.col("kind") == "projects", "project_entry")
        .when(F.col("kind") == "summary", "summary_context")
        .when(F.col("kind") == "personal information", "personal_information_entry")
        .when((F.col("kind") == "skills") | F.lower("section").isin("tools", "technologies"), "skill_list_entry")
        .otherwise("source_line_context")
    )
    return grouped.withColumn("entry_type", entry).drop("kind")


def decisions(joined: DataFrame) -> DataFrame:
    """upload_id, line_index, next_line, merged, reason of every pair of neighbouring lines."""
    order = Window.partitionBy(KEY).orderBy("line_index")
    pairs = joined.select(KEY, F.lag("line_index").over(order).alias("line_index"), F.col("line_index").alias("next_line"), F.col("joined").alias("merged"), "reason", (F.lag("section_id").over(order) != F.col("section_id")).alias("apart"))
    reason = F.when(F.col("merged"), F.col("reason")).when(F.col("apart"), "different sections").otherwise("separate lines")
    return pairs.where("line_index is not null").select(KEY, "line_index", "next_line", "merged", reason.alias("reason"))


def uncovered_lines(sectioned: DataFrame, lines: DataFrame) -> DataFrame:
    """Body lines with text that no sentence covers; each becomes a block of its own."""
    body = sectioned.where("heading is null and not is_page_number and trim(line) <> ''")
    return body.join(lines.select(KEY, "line_index"), [KEY, "line_index"], "left_anti").select(KEY, "line_index", "section_id", "line")


def line_blocks(grouped: DataFrame) -> DataFrame:
    """upload_id, line_index, block."""
    return grouped.select(KEY, F.explode("line_indices").alias("line_index"), "block")


def coverage(sectioned: DataFrame, grouped: DataFrame) -> DataFrame:
    """Per upload: body lines, lines in blocks, blocks, and whether every body line is in a block."""
    body = sectioned.where("heading is null and not is_page_number and trim(line) <> ''").select(KEY, "line_index").distinct()
    covered = line_blocks(grouped).select(KEY, "line_index", "block")
    both = body.join(covered, [KEY, "line_index"], "left")
    return both.groupBy(KEY).agg(F.count_distinct("line_index").alias("body_lines"), F.count_distinct(F.when(F.col("block").isNotNull(), F.col("line_index"))).alias("covered_lines"), F.count_distinct("block").alias("blocks")).withColumn("complete", F.col("body_lines") == F.col("covered_lines"))
