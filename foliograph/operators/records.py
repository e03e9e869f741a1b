"""Records out of rows: employments, education, skills, and the canonical record of a document.

Rows come classified (block_type, entities). Nesting is by running counts over
the rows of one upload: an employer row opens a job, a title row a role, and
what follows belongs to the open one. The record is built by grouping, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

KEY = "upload_id"
# --- Fixed values: keys of the canonical record and the names that sections go by in outputs. ---
CANONICAL_KEYS = {
    "summary": "profile_snapshot", "profile": "profile_snapshot", "experience": "work_history", "work experience": "work_history", "employment": "work_history", "education": "education", "projects": "projects",
    "skills": "skills", "technical skills": "technical_skills", "certifications": "certifications", "awards": "awards", "achievements": "achievements", "publications": "publications", "domain experience": "domain_experience",
    "header": "personal_information", "personal information": "personal_information", "personal details": "personal_details", "languages": "personal_details", "references": "source_sections",
}

#: The category of skills that stand under none.
NO_CATEGORY = "Skills"
#: Keys whose rows come as lists of items.
LISTED = ("projects", "certifications", "awards", "achievements", "publications", "domain_experience")


def _upto(*by: str):
    return Window.partitionBy(KEY).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def numbered_rows(blocks: DataFrame) -> DataFrame:
    """Rows of employments with job (from 1) and role (from 1 within the job); rows before the first employer have job 0."""
    rows = blocks.where("section = 'Experience' and text is not null and block_type <> 'PAGE_ARTIFACT'")
    opens_job = F.col("block_type").isin("COMPANY", "COMPANY_ROLE")
    opens_role = F.col("block_type").isin("ROLE", "COMPANY_ROLE")
    order = ("reading_order", "block_id")
    rows = rows.withColumn("job", F.sum(F.coalesce(opens_job, F.lit(False)).cast("int")).over(_upto(*order)))
    in_job = Window.partitionBy(KEY, "job").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("role", F.sum(F.coalesce(opens_role, F.lit(False)).cast("int")).over(in_job))


def employments(blocks: DataFrame) -> DataFrame:
    """upload_id, job, company, location, roles: ARRAY of (role, designation, start_date, end_date, location, duties, clients, achievements, source_blocks)."""
    rows = numbered_rows(blocks).where("job > 0")
    e = lambda c: F.nullif(F.trim(F.col(f"entities.{c}")), F.lit(""))
    by_place = lambda c, kept: F.min_by(c, F.when(kept, F.struct("reading_order", "block_id")))
    # duties: a row without marker goes on with the row before it
    duty = F.col("block_type") == "RESPONSIBILITY"
    starts = (duty & (F.col("is_bullet") | ~F.coalesce(F.lag("block_type").over(Window.partitionBy(KEY, "job", "role").orderBy("reading_order", "block_id")) == "RESPONSIBILITY", F.lit(False)))).cast("int")
    rows = rows.withColumn("item", F.sum(starts).over(Window.partitionBy(KEY, "job", "role").orderBy("reading_order", "block_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    duties = rows.where(duty).groupBy(KEY, "job", "role", "item").agg(F.sort_array(F.collect_list(F.struct("reading_order", "block_id", text.without_marker(F.col("text")).alias("t")))).alias("p"))
    duties = duties.select(KEY, "job", "role", "item", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("duty"))
    duties = duties.groupBy(KEY, "job", "role").agg(F.transform(F.sort_array(F.collect_list(F.struct("item", "duty"))), lambda x: x["duty"]).alias("duties"))
    roles = rows.groupBy(KEY, "job", "role").agg(
        by_place(e("designation"), e("designation").isNotNull()).alias("designation"),
        by_place(e("start_date"), e("start_date").isNotNull()).alias("start_date"),
        by_place(e("end_date"), e("start_date").isNotNull()).alias("end_date"),
        by_place(e("location"), e("location").isNotNull()).alias("location"),
        by_place(e("company"), e("company").isNotNull()).alias("company"),
        F.transform(F.sort_array(F.collect_list(F.struct("reading_order", "row_id"))), lambda x: x["row_id"]).alias("source_blocks"),
    )
    listed = lambda kind, pattern, name: (
        rows.where(F.col("block_type") == kind).select(KEY, "job", "role", "reading_order", F.posexplode(F.split(F.regexp_replace(text.without_marker(F.col("text")), pattern, ""), r"\s*[;|]\s*" if kind == "CLIENT" else "\u0001")).alias("at", "v"))
        .where("trim(v) <> ''").groupBy(KEY, "job", "role").agg(F.transform(F.sort_array(F.collect_list(F.struct("reading_order", "at", F.trim("v").alias("v")))), lambda x: x["v"]).alias(name))
    )
    clients = listed("CLIENT", r"(?i)^\s*clients?\s*[:–—-]?\s*", "clients")
    achieved = listed("ACHIEVEMENT", r"(?i)^\s*(?:key\s+)?(?:achievement|accomplishment)s?\s*[:–—-]\s*", "achievements")
    roles = roles.join(duties, [KEY, "job", "role"], "left").join(clients, [KEY, "job", "role"], "left").join(achieved, [KEY, "job", "role"], "left")
    # an employer's own rows have role 0: they give company and place, and a role only if there is no other
    job = roles.groupBy(KEY, "job").agg(
        F.min_by("company", F.when(F.col("company").isNotNull(), F.col("role"))).alias("company"),
        F.min_by("location", F.when(F.col("location").isNotNull(), F.col("role"))).alias("location"),
        F.sort_array(F.collect_list(F.when((F.col("role") > 0) | F.col("designation").isNotNull(), F.struct("role", "designation", "start_date", "end_date", "location", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("duties", "clients", "achievements")], "source_blocks")))).alias("roles"),
    )
    return job


def _entries(blocks: DataFrame) -> DataFrame:
    """Rows of education with entry (from 1); rows before the first degree have entry 0."""
    from .context import DEGREE_CUE

    rows = blocks.where("block_type = 'EDUCATION' and text is not null")
    return rows.withColumn("entry", F.sum(F.col("text").rlike(DEGREE_CUE).cast("int")).over(_upto("reading_order", "block_id")))


def education(blocks: DataFrame) -> DataFrame:
    """upload_id, entry (from 1), degree, institution, year, source_blocks: a row with a degree opens an entry."""
    from .context import DEGREE_CUE, INSTITUTION_CUE

    cells = F.split("text", r"\s*[,|]\s*")
    parts = _entries(blocks).withColumn("degree", F.get(F.filter(cells, lambda c: c.rlike(DEGREE_CUE) & ~c.rlike(INSTITUTION_CUE)), F.lit(0)))
    parts = parts.withColumn("institution", F.get(F.filter(cells, lambda c: c.rlike(INSTITUTION_CUE)), F.lit(0))).withColumn("year", F.nullif(F.regexp_extract("text", r"\b((?:19|20)\d{2})\b", 1), F.lit("")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("reading_order", "block_id"))).alias(c)
    return parts.where("entry > 0").groupBy(KEY, "entry").agg(first("degree"), first("institution"), first("year"), F.transform(F.sort_array(F.collect_list(F.struct("reading_order", "row_id"))), lambda x: x["row_id"]).alias("source_blocks"))


def skills(blocks: DataFrame) -> DataFrame:
    """upload_id, skills: ARRAY of (name, category) of sections of general skills that stand under no category, once each; those with one are technical."""
    items = technical_skills(blocks.where(canonical_key(F.col("section")) == "skills")).where(F.col("category") == NO_CATEGORY).select(KEY, "category", F.posexplode("items").alias("at", "name"))
    return items.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("category", "at", "name"))), lambda x: F.struct(x["name"].alias("name"), x["category"].alias("category"))).alias("skills"))


def technical_skills(blocks: DataFrame) -> DataFrame:
    """upload_id, category, items: skills by category in order; separators within brackets do not count."""
    pattern = r"^\s*([A-Za-z][A-Za-z &/]{1,30}):\s*(.*)$"
    rows = blocks.where("block_type in ('SKILL', 'TECHNOLOGY') and text is not null").select(KEY, "reading_order", "block_id", F.nullif(F.trim(F.regexp_extract("text", pattern, 1)), F.lit("")).alias("label"), "text")
    rows = rows.withColumn("category", F.coalesce(F.last("label", ignorenulls=True).over(_upto("reading_order", "block_id")), F.lit(NO_CATEGORY)))
    listed = F.when(F.col("label").isNotNull(), F.regexp_extract("text", pattern, 2)).otherwise(F.col("text"))
    items = rows.select(KEY, "category", "reading_order", F.posexplode(F.split(listed, r"\s*[|;,]\s*(?![^()]*\))")).alias("at", "item")).where("trim(item) <> ''")
    return items.groupBy(KEY, "category").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("reading_order", "at", F.trim("item").alias("item")))), lambda x: x["item"])).alias("items"))


def profile(blocks: DataFrame) -> DataFrame:
    """upload_id, profile: the summary's lines as one text."""
    rows = blocks.where("block_type = 'PROFILE_SUMMARY' and text is not null")
    pieces = rows.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("reading_order", "block_id", F.trim("text").alias("t")))).alias("p"))
    return pieces.select(KEY, F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("profile"))


def languages(blocks: DataFrame) -> DataFrame:
    """upload_id, language: listed languages, once each whatever their case, without notes in brackets."""
    rows = blocks.where("block_type = 'PERSONAL_DETAIL' and text is not null").where(F.col("text").rlike(r"^\s*(?:Languages|Idiomas|Sprachen|Langues)\s*:"))
    items = rows.select(KEY, "reading_order", F.posexplode(F.split(F.regexp_replace("text", r"^[^:]*:\s*", ""), r"\s*,\s*")).alias("at", "language"))
    items = items.withColumn("language", F.trim(F.regexp_replace("language", r"\s*\([^)]*\)|[.·%\d]+$", ""))).where("language <> ''")
    order = Window.partitionBy(KEY, F.lower("language")).orderBy("reading_order", "at")
    return items.withColumn("n", F.row_number().over(order)).where("n = 1").select(KEY, "language")


def canonical_key(section: Column) -> Column:
    """The canonical key of a section name; sections without one go to source_sections."""
    keys = F.create_map(*[F.lit(x) for pair in sorted(CANONICAL_KEYS.items()) for x in pair])
    return F.coalesce(F.element_at(keys, F.lower(F.trim(section))), F.lit("source_sections"))


def _real(blocks: DataFrame) -> DataFrame:
    """Rows with text that are no artifact and no heading, with key: the canonical key of their section."""
    kind = F.coalesce(F.col("block_type"), F.lit("UNKNOWN"))
    return blocks.where(F.col("text").isNotNull() & (F.trim("text") != "") & ~kind.isin("PAGE_ARTIFACT", "SECTION_HEADING")).withColumn("key", canonical_key(F.col("section"))).withColumn("kind", kind)


def personal(blocks: DataFrame) -> DataFrame:
    """upload_id, personal_information (title, email, phone, location, lines) and personal_details (date_of_birth, nationality, languages, lines).

    Fields are the first that a row gives; lines are all rows, so that nothing gets lost that is no field.
    """
    rows, t = _real(blocks).where(F.col("key").isin("personal_information", "personal_details")), F.col("text")
    information = F.col("key") == "personal_information"
    labelled = lambda names: F.nullif(F.trim(F.regexp_extract("text", rf"(?i)^\s*(?:{names})\s*:\s*(.+)", 1)), F.lit(""))
    title = F.coalesce(labelled("title|position|job title"), F.when(information & text.role_title(t) & ~t.rlike(r"[@\d:]"), F.trim("text")))
    fields = {
        "title": title, "email": F.when(information, text.email(t)), "phone": F.when(information, text.phone(t)), "location": labelled("location|city|place of residence|wohnort|lugar de residencia|domicile"),
        "date_of_birth": labelled("date of birth|dob|born|geburtsdatum|fecha de nacimiento|date de naissance"), "nationality": labelled("nationality|citizenship|staatsangehörigkeit|nacionalidad|nationalité"),
    }
    rows = rows.select(KEY, "key", "reading_order", "block_id", "text", *[c.alias(n) for n, c in fields.items()])
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("reading_order", "block_id"))).alias(c)
    texts = lambda k: F.transform(F.sort_array(F.collect_list(F.when(F.col("key") == k, F.struct("reading_order", "block_id", "text")))), lambda x: x["text"])
    one = rows.groupBy(KEY).agg(*[first(c) for c in fields], texts("personal_information").alias("lines"), texts("personal_details").alias("detail_lines"))
    spoken = languages(blocks).groupBy(KEY).agg(F.sort_array(F.collect_list("language")).alias("languages"))
    one = one.join(spoken, KEY, "full")
    return one.select(KEY, F.struct("title", "email", "phone", "location", "lines").alias("personal_information"), F.struct("date_of_birth", "nationality", "languages", F.col("detail_lines").alias("lines")).alias("personal_details"))


def listed(blocks: DataFrame) -> DataFrame:
    """upload_id and for each key of LISTED its items (name, technologies): a marker opens an item, rows without go on with it; where none has a marker, each row is one.

    Technologies are only those of a row that names them, as in 'Tools: a, b'.
    """
    rows = _real(blocks).where(F.col("key").isin(*LISTED))
    upto = Window.partitionBy(KEY, "key").orderBy("reading_order", "block_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tools = F.nullif(F.regexp_extract("text", r"(?i)^\W*(?:technolog(?:y|ies)|tools|tech stack)\s*:\s*(.+)", 1), F.lit(""))
    rows = rows.withColumn("tools", F.when(F.col("key") == "projects", tools)).withColumn("marked", F.coalesce("is_bullet", F.lit(False)) & F.col("tools").isNull())
    rows = rows.withColumn("any", F.max("marked").over(upto)).withColumn("item", F.sum((F.col("tools").isNull() & (F.col("marked") | ~F.col("any"))).cast("int")).over(upto))
    parts = rows.groupBy(KEY, "key", "item").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("tools").isNull(), F.struct("reading_order", "block_id", F.trim(text.without_marker(F.col("text"))).alias("t"))))), lambda x: x["t"]), " ").alias("name"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("tools").isNotNull(), F.struct("reading_order", "block_id", "tools")))), lambda x: F.split(x["tools"], r"\s*[,;|]\s*"))).alias("technologies"),
    )
    return parts.groupBy(KEY).agg(*[F.transform(F.sort_array(F.collect_list(F.when(F.col("key") == k, F.struct("item", "name", "technologies")))), lambda x: F.struct(x["name"].alias("name"), x["technologies"].alias("technologies"))).alias(k) for k in LISTED])


def unplaced(blocks: DataFrame) -> DataFrame:
    """The rows that no other part of the canonical record takes: those of sections without key, and those of no use within the others."""
    rows = _real(blocks)
    named = F.max(F.nullif(F.trim("entities.company"), F.lit(""))).over(Window.partitionBy(KEY, "job"))
    of_jobs = F.col("block_type").isin("COMPANY", "COMPANY_ROLE", "ROLE", "DATE_RANGE", "LOCATION") | ((F.col("block_type") == "RESPONSIBILITY") & (F.col("role") > 0)) | F.col("block_type").isin("CLIENT", "ACHIEVEMENT")
    taken = numbered_rows(blocks).withColumn("named", named).where((F.col("job") > 0) & F.col("named").isNotNull() & of_jobs).select("block_id").unionByName(_entries(blocks).where("entry > 0").select("block_id"))
    left = rows.where(~F.col("key").isin("source_sections", "personal_information", "personal_details", *LISTED) & ~F.col("kind").isin("PROFILE_SUMMARY", "SKILL", "TECHNOLOGY")).drop("key", "kind").join(taken, "block_id", "left_anti")
    return left.unionByName(blocks.where("text is not null").where(canonical_key(F.col("section")) == "source_sections"))


def canonical(blocks: DataFrame) -> DataFrame:
    """One record for each upload: upload_id, schema_version, profile_snapshot, work_history, education, skills, technical_skills, personal_information, personal_details, the keys of LISTED, source_sections.

    Every row with text that is no artifact and no heading is in one of them.
    """
    jobs = employments(blocks).where("company is not null").groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("job", "company", "location", "roles"))).alias("work_history"))
    schools = education(blocks).groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("entry", "degree", "institution", "year", "source_blocks"))).alias("education"))
    general, own = technical_skills(blocks.where(canonical_key(F.col("section")) == "skills")).where(F.col("category") != NO_CATEGORY), technical_skills(blocks.where(canonical_key(F.col("section")) != "skills"))
    technical = general.unionByName(own).groupBy(KEY, "category").agg(F.flatten(F.collect_list("items")).alias("items")).groupBy(KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "items")))).alias("technical_skills"))
    other = unplaced(blocks).groupBy(KEY, F.coalesce("section", F.lit("")).alias("section")).agg(F.transform(F.sort_array(F.collect_list(F.struct("reading_order", "block_id", "text"))), lambda x: x["text"]).alias("lines"))
    other = other.groupBy(KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", "lines")))).alias("source_sections"))
    base = blocks.select(KEY).distinct()
    for part in (profile(blocks).withColumnRenamed("profile", "profile_snapshot"), jobs, schools, skills(blocks), technical, personal(blocks), listed(blocks), other):
        base = base.join(part, KEY, "left")
    return base.select(KEY, F.lit("canonical-resume/v1").alias("schema_version"), "profile_snapshot", "work_history", "education", "skills", "technical_skills", "personal_information", "personal_details", *LISTED, "source_sections")


def readable(record: DataFrame) -> DataFrame:
    """One row for each job and role of the canonical records; jobs without role stay."""
    jobs = record.select(KEY, F.explode_outer("work_history").alias("j")).select(KEY, "j.job", "j.company", F.explode_outer("j.roles").alias("r"))
    return jobs.where("company is not null").select(KEY, "job", "company", "r.designation", "r.start_date", "r.end_date", F.size(F.coalesce(F.col("r.duties"), F.array().cast("array<string>"))).alias("duties"))


def coverage(blocks: DataFrame) -> DataFrame:
    """Per upload: rows, artifacts, headings, rows with a known type, unresolved rows, complete."""
    kind = F.coalesce(F.col("block_type"), F.lit("UNKNOWN"))
    real = blocks.where("text is not null and trim(text) <> ''")
    return real.groupBy(KEY).agg(
        F.count("*").alias("rows"), F.count_if(kind == "PAGE_ARTIFACT").alias("artifacts"), F.count_if(kind.isin("SECTION_HEADING", "SUBSECTION_HEADING")).alias("headings"), F.count_if(kind != "UNKNOWN").alias("resolved"), F.count_if(kind == "UNKNOWN").alias("unresolved"),
        (F.count_if(kind == "UNKNOWN") == 0).alias("complete"),
    )


def violations(blocks: DataFrame) -> DataFrame:
    """upload_id, rule, row_id: rows that break the nesting of employments; none for a good upload."""
    rows = numbered_rows(blocks)
    orphan = rows.where("job = 0 and block_type in ('ROLE', 'RESPONSIBILITY', 'DATE_RANGE', 'CLIENT')").select(KEY, F.lit("row before any employer").alias("rule"), "row_id")
    unnamed = rows.where("block_type in ('COMPANY', 'COMPANY_ROLE') and (entities.company is null or trim(entities.company) = '')").select(KEY, F.lit("employer without name").alias("rule"), "row_id")
    duty = rows.where("block_type = 'RESPONSIBILITY' and job > 0 and role = 0").select(KEY, F.lit("duty without role").alias("rule"), "row_id")
    return orphan.unionByName(unnamed).unionByName(duty)
