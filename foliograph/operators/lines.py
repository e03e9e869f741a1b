"""From texts to lines, sections and sentences.

Every table is keyed by ``upload_id``; windows run over one document, so a
document of any length sorts with spilling and documents spread over all tasks.
Null and empty texts give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headings, text

KEY = "upload_id"


def documents(raw_text: DataFrame) -> DataFrame:
    """The latest upload of every document: by loading time, then by id. A repeated key keeps its last write."""
    # only keys and times meet, with partial maxima first, so a document with very many uploads is no burden
    last = raw_text.groupBy("doc_id").agg(F.max_by(KEY, F.struct(F.col("loaded_at").isNotNull(), "loaded_at", KEY)).alias(KEY)).select(KEY)
    return raw_text.join(last, KEY, "left_semi")


def split_lines(raw_text: DataFrame) -> DataFrame:
    """upload_id, line_index, line, indent, marker, is_bullet, is_page_number, of every line."""
    unified = F.regexp_replace(F.col("raw_text"), r"\r\n?", "\n")
    lines = raw_text.where("raw_text is not null and raw_text <> ''").select(KEY, F.posexplode(F.split(unified, "\n", -1)).alias("line_index", "source"))
    line = F.regexp_replace("source", r"[ \t]+$", "")
    return lines.select(KEY, "line_index", line.alias("line")).select(
        KEY, "line_index", "line",
        text.indent(F.col("line")).alias("indent"),
        text.list_marker(F.col("line")).alias("marker"),
        F.col("line").rlike(text.LIST_PREFIX).alias("is_bullet"),
        text.is_page_number(F.col("line")).alias("is_page_number"),
    )


def heading_key(line: Column) -> Column:
    """What a line is looked up by among headings: letter-spaced capitals closed up, no decoration, & as and."""
    closed = F.when(line.rlike(r"^\s*(?:[A-Za-z]\s+){2,}[A-Za-z]\s*$"), F.regexp_replace(line, r"\s+", "")).otherwise(line)
    bare = F.regexp_replace(F.regexp_replace(closed, r"^\s*(?:\d+[.)]|[•▪●*#])\s*", ""), r"^[|–—_\-:\s]+|[|–—_\-:\s.]+$", "")
    return F.regexp_replace(F.replace(F.lower(bare), F.lit("&"), F.lit("and")), r"\s+", " ")


def _heading_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(headings.by_heading().items()) for x in pair])


def with_sections(lines: DataFrame, fuzzy: bool = False) -> DataFrame:
    """lines with heading (null in body lines), section and section_id carried forward from the last heading.

    ``fuzzy`` also takes misspelt headings, by a lookup over the distinct short lines only.
    """
    key = heading_key(F.col("line"))
    keyed = lines.withColumn("heading_key", F.when(F.length(key).between(1, 60), key))
    keyed = keyed.withColumn("heading", F.element_at(_heading_map(), F.col("heading_key")))
    if fuzzy:
        known = list(headings.by_heading())
        open_keys = keyed.where("heading is null and heading_key is not null and length(heading_key) <= 60").where(~F.col("line").rlike(r"[.!?]")).select("heading_key").distinct()
        close = open_keys.withColumn("close", text.close_heading(F.col("heading_key"), known)).where("close is not null and heading_key not in ('achievement', 'accomplishment')")
        keyed = keyed.join(close, "heading_key", "left").withColumn("heading", F.coalesce("heading", F.element_at(_heading_map(), F.col("close")))).drop("close")
    so_far = Window.partitionBy(KEY).orderBy("line_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.count("heading").over(so_far)
    section = F.coalesce(F.last("heading", ignorenulls=True).over(so_far), F.lit("Header"))
    return keyed.withColumn("section", section).withColumn("section_id", F.concat(F.lit("s"), number.cast("string"), F.lit(":"), section)).drop("heading_key")


def section_list(sectioned: DataFrame) -> DataFrame:
    """upload_id, section_id, section, first_line, lines, position (from 0, in the order of first appearance)."""
    body = sectioned.groupBy(KEY, "section_id", "section").agg(F.min("line_index").alias("first_line"), F.count_if(F.col("heading").isNull() & (F.trim("line") != "")).alias("lines"))
    return body.withColumn("position", F.row_number().over(Window.partitionBy(KEY).orderBy("first_line")) - 1)


def split_sentences(sectioned: DataFrame) -> DataFrame:
    """upload_id, sentence_index (from 0 through the document), line_index, section, section_id, sentence of body lines."""
    body = sectioned.where("heading is null and not is_page_number and trim(line) <> ''")
    exploded = body.select(KEY, "line_index", "section", "section_id", "indent", "is_bullet", "line", F.posexplode(text.sentences(F.col("line"))).alias("at", "sentence"))
    return exploded.withColumn("sentence_index", F.row_number().over(Window.partitionBy(KEY).orderBy("line_index", "at")) - 1).drop("at")


def sentence_counts(sentences: DataFrame) -> DataFrame:
    return sentences.groupBy(KEY, "section_id").agg(F.count("*").alias("sentences"))


def contact_fields(sectioned: DataFrame) -> DataFrame:
    """upload_id, email, phone, linkedin, github: the first of each among the lines before the first heading."""
    head = sectioned.where("section = 'Header'")
    found = head.select(KEY, "line_index", text.email(F.col("line")).alias("email"), text.phone(F.col("line")).alias("phone"), text.link(F.col("line"), r"linkedin\.com/in/").alias("linkedin"), text.link(F.col("line"), r"github\.com/").alias("github"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_index"))).alias(c)
    return found.groupBy(KEY).agg(*[first(c) for c in ("email", "phone", "linkedin", "github")])


def labelled_fields(sectioned: DataFrame) -> DataFrame:
    """upload_id, line_index, label, value of every labelled part of a body line."""
    return sectioned.where("heading is null").select(KEY, "line_index", F.explode(text.labelled(F.col("line"))).alias("f")).select(KEY, "line_index", "f.label", "f.value")


def reflowed_bullets(sectioned: DataFrame) -> DataFrame:
    """upload_id, section_id, item (from 1), text: list items with the lines that wrap from them.

    A line without marker goes to the open item of its section; a heading or an empty line closes it.
    """
    body = sectioned.where("heading is null and not is_page_number")
    order = Window.partitionBy(KEY, "section_id").orderBy("line_index")
    item = F.sum(F.col("is_bullet").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blank = F.sum((F.trim("line") == "").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = body.withColumn("item", item).withColumn("blanks", blank).where("item > 0 and trim(line) <> ''")
    opened = marked.withColumn("opened", F.min("blanks").over(Window.partitionBy(KEY, "section_id", "item"))).where("blanks = opened")
    pieces = opened.groupBy(KEY, "section_id", "item").agg(F.sort_array(F.collect_list(F.struct("line_index", text.without_marker(F.col("line")).alias("t")))).alias("p"))
    return pieces.select(KEY, "section_id", "item", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"))


def skill_items(sectioned: DataFrame) -> DataFrame:
    """upload_id, category, skill of lists in skill sections; a category carries on to lines without one."""
    body = sectioned.where("heading is null and trim(line) <> '' and not is_page_number").where(F.col("section").isin("Skills", "Technical Skills", "Tools and Technology"))
    pattern = r"^\s*([A-Za-z][A-Za-z &/]{1,30}):\s*(.*)$"
    label = F.nullif(F.trim(F.regexp_extract("line", pattern, 1)), F.lit(""))
    order = Window.partitionBy(KEY, "section_id").orderBy("line_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = body.withColumn("label", label).withColumn("category", F.last("label", ignorenulls=True).over(order))
    listed = F.when(F.col("label").isNotNull(), F.regexp_extract("line", pattern, 2)).otherwise(text.without_marker(F.col("line")))
    return rows.select(KEY, "line_index", "category", F.explode(F.split(listed, r"\s*[,;]\s*")).alias("skill")).withColumn("skill", F.trim("skill")).where("skill <> ''")
