"""Records of sections other than employments, out of rows: projects, certifications, strengths, domains and simple lists.

Rows are those of ``semantic_blocks``. Where a record begins is a test of a row
and its neighbours; a running count of beginnings numbers the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import classify

KEY = "upload_id"
# --- Fixed values: labels of fields within projects. ---
PROJECT_FIELD = r"(?i)^\W*(technolog(?:y|ies)|tools?|tech stack|role|client|duration|period|description|project description)\s*:\s*(.+)$"
NAMED = r"(?i)^\s*(?:\d+[.)]\s*)?project\s*(?:name|title)?\s*[:\-]\s*(.+)$"
OVERVIEW = r"(?i)(?:^|[^\p{L}\p{N}_])(?:experience|professional|skilled|expertise|speciali[sz]e|career)(?:[^\p{L}\p{N}_]|$)"


def _order(*by: str):
    return Window.partitionBy(KEY, *by).orderBy("reading_order", "block_id")


def _rows(blocks: DataFrame, *sections: str) -> DataFrame:
    kind = F.coalesce(F.col("block_type"), F.lit("UNKNOWN"))
    return blocks.where(F.lower("section").isin(*sections) & F.col("text").isNotNull() & (F.trim("text") != "") & ~kind.isin("PAGE_ARTIFACT", "SECTION_HEADING")).withColumn("t", F.trim(text.without_marker(F.col("text"))))


def _joined(items: DataFrame, *by: str, sep: str = " ") -> DataFrame:
    """by..., text of rows with reading_order, block_id and t, in order."""
    return items.groupBy(KEY, *by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("reading_order", "block_id", "t"))), lambda x: x["t"]), sep).alias("text"))


def projects(blocks: DataFrame) -> DataFrame:
    """upload_id, project (from 1), name, technologies, client, start_date, end_date, lines, source_blocks.

    A row begins a project if it is the first, is numbered, names one ("Project: x"), is "title | technologies", is a title with its dates, or is a short bold line
    before others. Labelled rows give its fields, and the first of each counts; other rows are its lines.
    """
    rows = _rows(blocks, "projects", "project experience", "personal projects", "academic projects", "project highlights", "key projects")
    t, action = F.col("t"), F.col("t").rlike(classify.ACTION)
    field = t.rlike(PROJECT_FIELD)
    beside = t.rlike(r"^[^|]{1,100}\|[^|.!?]{1,70}$") & ~action
    dated = t.rlike(classify.PERIOD) & (F.length(t) < 100) & ~action
    only_date = dated & (classify.without_period(t) == "")
    short = F.coalesce(F.col("bold"), F.lit(False)) & (F.length(t) < 100) & ~t.rlike(r"[.!?]$") & F.lead("t").over(_order()).isNotNull() & ~action
    opens = ~field & ~only_date & (F.col("text").rlike(r"^\s*\d+[.)]\s*\S") | t.rlike(NAMED) | beside | dated | short)
    rows = rows.withColumn("opens", F.coalesce(opens, F.lit(False)) | (F.row_number().over(_order()) == 1)).withColumn("field", F.lower(F.regexp_extract("t", PROJECT_FIELD, 1))).withColumn("value", F.trim(F.regexp_extract("t", PROJECT_FIELD, 2)))
    rows = rows.withColumn("project", F.sum(F.col("opens").cast("int")).over(_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    name = F.coalesce(F.nullif(F.regexp_extract("t", NAMED, 1), F.lit("")), F.nullif(classify.bare(F.regexp_replace(classify.without_period(F.regexp_extract("t", r"^([^|]*)", 1)), r"^\d+[.)]\s*", "")), F.lit("")))
    first = lambda c, kept: F.min_by(c, F.when(kept, F.struct("reading_order", "block_id")))
    tools = F.col("field").rlike("^(?:tech|tool)")
    return rows.groupBy(KEY, "project").agg(
        first(name, F.col("opens")).alias("name"),
        F.split(F.coalesce(first("value", tools), first(F.trim(F.regexp_extract("t", r"\|(.*)$", 1)), F.col("opens") & t.contains("|"))), r"\s*[,;]\s*").alias("technologies"), first("value", F.col("field") == "client").alias("client"),
        first(F.regexp_extract("t", classify.PERIOD, 1), t.rlike(classify.PERIOD)).alias("start_date"), first(F.regexp_extract("t", classify.PERIOD, 2), t.rlike(classify.PERIOD)).alias("end_date"),
        F.transform(F.sort_array(F.collect_list(F.when(~F.col("opens") & (F.col("field") == "") & ~only_date, F.struct("reading_order", "block_id", "t")))), lambda x: x["t"]).alias("lines"),
        F.transform(F.sort_array(F.collect_list(F.struct("reading_order", "row_id"))), lambda x: x["row_id"]).alias("source_blocks"),
    )


def project_dates(blocks: DataFrame) -> DataFrame:
    """block_id, heading_id: each row of a project section that is only a date, with the bold row to its left on the page that it overlaps most in height (by -1 at least)."""
    from .layout import PAGE, box

    rows = box(blocks).where(F.lower("section").isin("projects", "project experience") & F.col("text").isNotNull())
    dates = rows.where(F.col("text").rlike(classify.PERIOD) & (classify.without_period(F.trim("text")) == "")).select(*PAGE, "block_id", F.col("x0").alias("dx"), F.col("y0").alias("d0"), F.col("y1").alias("d1"))
    heads = rows.where("bold").select(*PAGE, F.col("block_id").alias("heading_id"), F.col("x0").alias("hx"), F.col("y0").alias("h0"), F.col("y1").alias("h1"))
    overlap = F.least("d1", "h1") - F.greatest("d0", "h0")
    met = dates.join(heads, PAGE).withColumn("overlap", overlap).where("overlap >= -1 and hx < dx")
    return met.groupBy("block_id").agg(F.max_by("heading_id", F.struct("overlap", -F.abs(F.col("d0") - F.col("h0")), -F.col("heading_id"))).alias("heading_id"))


def certifications(blocks: DataFrame, gap: float = 4.0, indent: float = 8.0) -> DataFrame:
    """upload_id, item (from 1), text: one for each row; a row without marker that stands close under the one before and is set in by ``indent`` goes on with it."""
    rows = _rows(blocks, "certifications", "certification", "licenses", "certificates")
    side = lambda k: F.get("bbox", F.lit(k))
    rows = rows.select(KEY, "reading_order", "block_id", "page", "is_bullet", "t", side(0).alias("x0"), side(1).alias("y0"), side(3).alias("y1"))
    before = lambda c: F.lag(c).over(_order())
    goes_on = (before("page") == F.col("page")) & (F.col("y0") - before("y1")).between(-1, gap) & (F.col("x0") - before("x0") >= indent) & ~F.coalesce("is_bullet", F.lit(False))
    rows = rows.withColumn("item", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return _joined(rows, "item")


def strengths(blocks: DataFrame) -> DataFrame:
    """upload_id, block_id, category of rows of awards that are strengths: a bold line before a line of duties opens a category, which holds to the next bold line; null for awards proper."""
    rows = _rows(blocks, "awards", "achievements", "key strengths")
    bold = F.coalesce(F.col("bold"), F.lit(False))
    rows = rows.withColumn("opens", bold & F.coalesce(F.lead("t").over(_order()).rlike(classify.ACTION), F.lit(False))).withColumn("run", F.sum(bold.cast("int")).over(_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    head = F.first(F.when(F.col("opens"), F.col("t")), ignorenulls=True).over(Window.partitionBy(KEY, "run").orderBy("reading_order", "block_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select(KEY, "block_id", head.alias("category"))


def domains(blocks: DataFrame) -> DataFrame:
    """upload_id, category, domain of rows "Category: a, b"; a row without category has that of the row before."""
    rows = _rows(blocks, "domain experience", "domain expertise")
    pattern = r"^([^:]{2,60}):\s*(.*)$"
    rows = rows.withColumn("label", F.nullif(F.trim(F.regexp_extract("t", pattern, 1)), F.lit("")))
    rows = rows.withColumn("category", F.last("label", ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    listed = F.when(F.col("label").isNotNull(), F.regexp_extract("t", pattern, 2)).otherwise(F.col("t"))
    return rows.select(KEY, "category", F.explode(F.split(listed, r"\s*[,;]\s*")).alias("domain")).where("trim(domain) <> ''").select(KEY, "category", F.trim("domain").alias("domain")).distinct()


def simple_items(blocks: DataFrame) -> DataFrame:
    """upload_id, section, item, text of rows of lists: a row that begins with a small letter goes on with the one before; a section of one row is cut at commas."""
    rows = blocks.where("text is not null and trim(text) <> '' and coalesce(block_type, 'UNKNOWN') not in ('PAGE_ARTIFACT', 'SECTION_HEADING') and section is not null").withColumn("t", F.trim(text.without_marker(F.col("text"))))
    goes_on = F.col("t").rlike(r"^\p{Ll}") & F.lag("t").over(_order("section")).isNotNull() & ~F.coalesce("is_bullet", F.lit(False))
    rows = rows.withColumn("item", F.sum((~goes_on).cast("int")).over(_order("section").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("n", F.count("*").over(Window.partitionBy(KEY, "section")))
    many = _joined(rows.where("n > 1"), "section", "item")
    one = rows.where("n = 1").select(KEY, "section", F.posexplode(F.split("t", r"\s*,\s*")).alias("item", "text")).where("text <> ''").select(KEY, "section", (F.col("item") + 1).alias("item"), "text")
    return many.unionByName(one)


def preamble(blocks: DataFrame) -> DataFrame:
    """upload_id, block_id, text of prose about a career among employments before the first employer: part of the profile."""
    rows = blocks.where("section = 'Experience' and text is not null and coalesce(block_type, 'UNKNOWN') not in ('PAGE_ARTIFACT', 'SECTION_HEADING')")
    jobs = F.sum(F.col("block_type").isin("COMPANY", "COMPANY_ROLE").cast("int")).over(_order().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    prose = (F.length("text") > 45) & (F.col("text").rlike(OVERVIEW) | F.col("text").rlike(r"[.!?]\s*$"))
    return rows.withColumn("jobs", jobs).where(F.coalesce("jobs", F.lit(0)) == 0).where(prose).select(KEY, "block_id", "text")


def employer_context(blocks: DataFrame) -> DataFrame:
    """upload_id, block_id, job: prose of project sections that names an employer of the same document belongs to that employment."""
    from .records import employments

    firms = employments(blocks).where("company is not null").select(KEY, "job", text.word_key(F.col("company")).alias("firm")).where("firm <> ''")
    prose = _rows(blocks, "projects", "project experience").select(KEY, "block_id", F.concat(F.lit(" "), text.word_key(F.col("t")), F.lit(" ")).alias("k"))
    met = prose.join(firms, KEY).where(F.contains("k", F.concat(F.lit(" "), F.col("firm"), F.lit(" "))))
    return met.groupBy(KEY, "block_id").agg(F.max_by("job", F.struct(F.length("firm"), -F.col("job"))).alias("job"))


def destinations(blocks: DataFrame) -> DataFrame:
    """upload_id, block_id, key: the part of the canonical record that a row goes to by its section; rows of unknown type go to the default of their section."""
    from .records import canonical_key

    kind: Column = F.coalesce(F.col("block_type"), F.lit("UNKNOWN"))
    rows = blocks.where(F.col("text").isNotNull() & (F.trim("text") != "") & ~kind.isin("PAGE_ARTIFACT", "SECTION_HEADING"))
    return rows.select(KEY, "block_id", canonical_key(F.col("section")).alias("key"))
