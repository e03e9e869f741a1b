"""Sections where headings are missing or share a line with their text, and who a document is about.

All rules look at one line; what they depend on besides - what came before in
the document - comes from windows over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headings, text
from . import classify
from .lines import KEY, heading_key

# --- Fixed values: labels of records that open no section, sections that end a document's head, tools, degrees and other cues of records without headings. ---
RECORD_LABELS = ["technologies", "technology", "tools", "tool", "tech stack", "description", "project description", "project title", "project name", "role", "job title", "designation", "client", "duration", "period"]
MAJOR = ["Experience", "Projects", "Education", "Skills", "Technical Skills", "Certifications"]
CONTACT_EVIDENCE = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}|(?:^|[^\p{L}\p{N}_])\+?\d[\d().\s-]{6,}\d(?:[^\p{L}\p{N}_]|$)|linkedin\.com|github\.com|https?://|^[\x{e000}-\x{f8ff}]\s*(?:[^\s]+@|\+?\d|[A-Za-z][A-Za-z .,'-]{1,60}$)"
_END = r"(?:[^\p{L}\p{N}_]|$)"
_BEGIN = r"(?:^|[^\p{L}\p{N}_])"
_DEGREES = r"(?:bachelor|master|ph\.?d|mba|b\.?tech|m\.?tech|b\.?e\.?|m\.?e\.?|b\.?s\.?|m\.?s\.?|b\.?a\.?|m\.?a\.?|b\.?com\.?|m\.?com\.?|diploma|associate degree|high school|secondary school|ssc|hsc|ged)"
DEGREE = rf"(?i){_BEGIN}{_DEGREES}{_END}"
DEGREE_FIRST = rf"(?i)^{_DEGREES}{_END}"
PLACE_OF_STUDY = rf"(?i){_BEGIN}(?:from|university|college|institute|school){_END}"
DATES = r"(?i)(?:^|[^\p{L}\p{N}_])(?:(?:19|20)\d{2}\s*[-–—/]|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4}.*[-–—])"
ROLE = rf"(?i){_BEGIN}(?:analyst|engineer|developer|consultant|manager|director|designer|architect|scientist|officer|specialist|associate|executive|intern|underwriter|administrator|technician|nurse|teacher|coordinator|accountant|researcher|president|lead){_END}"
CERTIFIED = rf"(?i){_BEGIN}(?:certified|certification|certificate){_END}"
TOOLS = r"(?i)(?:python|java|sql|aws|azure|docker|react|excel|tensorflow|machine learning|git|postgresql|kubernetes|pandas|tableau)"
OVERVIEW = rf"(?i){_BEGIN}(?:experience|professional|skilled|expertise|speciali[sz]e|career objective){_END}"
CONTACT_ROW = r"(?i)\||@|https?://|linkedin|github|\+?\d[\d ()-]{6,}"
CUED = [(r"(?i)^(?:key\s+)?projects?\s*[:\-]", "Projects"), (r"(?i)^(?:education|academic qualifications?)\s*[:\-]", "Education"), (r"(?i)^(?:certifications?|certificates?|licenses?|licences?)\s*[:\-]", "Certifications"), (r"(?i)^(?:technical\s+)?skills?\s*[:\-]", "Skills")]
# --- Fixed values: labels of personal details, by the field they stand for. ---
DETAIL_LABELS = {
    "dob": "date_of_birth", "date of birth": "date_of_birth", "language": "languages", "languages": "languages", "language known": "languages", "languages known": "languages", "nationality": "nationality", "citizenship": "nationality", "father's name": "father_name", "fathers name": "father_name",
    "father name": "father_name", "marital status": "marital_status", "gender": "gender", "sex": "gender", "passport": "passport_number",
}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(pairs.items()) for x in pair])


def inline_headings(sectioned: DataFrame) -> DataFrame:
    """upload_id, line_index, section, body of body lines that begin with a heading: "Heading: text", or a heading in capitals and two words or more."""
    rows = sectioned.where("heading is null and trim(line) <> ''").withColumn("t", F.trim("line"))
    label = F.regexp_replace(F.lower(F.trim(F.regexp_extract("t", r"^([^:]*):", 1))), r"\s+", " ")
    by_colon = F.element_at(_map(headings.by_heading()), F.nullif(heading_key(F.regexp_extract("t", r"^([^:]*):", 1)), F.lit("")))
    after = F.trim(F.regexp_extract("t", r"^[^:]*:(.*)$", 1))
    rows = rows.withColumn("label", label).withColumn("by_colon", F.when(F.col("t").contains(":") & (after != ""), by_colon)).withColumn("after", after)
    # capitals run together with the text: the longest heading that fits
    folded = F.regexp_replace(F.replace(F.lower("t"), F.lit("&"), F.lit("and")), r"\s+", " ")
    known = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(section).alias("section")) for name, section in sorted(headings.by_heading().items(), key=lambda x: (-len(x[0]), x[0]))])
    capitals = lambda n: (F.substring("t", F.lit(1), F.length(n)) == F.upper(F.substring("t", F.lit(1), F.length(n)))) & F.substring("t", F.lit(1), F.length(n)).rlike(r"[A-Z]")
    fits = F.filter(known, lambda k: F.startswith(folded, F.concat(k["name"], F.lit(" "))) & capitals(k["name"]) & (F.size(F.split(F.trim(F.substring(folded, F.length(k["name"]) + 1, F.length(folded))), " ")) >= 2))
    rows = rows.withColumn("fit", F.when(F.col("t").rlike("^[A-Z]{2}"), F.get(fits, F.lit(0))))
    rest = F.regexp_replace(F.substring(F.col("t"), F.length("fit.name") + 1, F.length("t")), r"^[ :–—|\t-]+|[ :–—|\t-]+$", "")
    out = rows.withColumn("section", F.coalesce("by_colon", "fit.section")).withColumn("body", F.when(F.col("by_colon").isNotNull(), F.col("after")).otherwise(rest))
    return out.where(~F.coalesce(F.col("label").isin(RECORD_LABELS), F.lit(False)) & F.col("section").isNotNull() & (F.col("body") != "")).select(KEY, "line_index", "section", "body")


def inferred_sections(sectioned: DataFrame) -> DataFrame:
    """upload_id, line_index, cue, section of the lines with text before a document's first heading.

    ``cue`` is the section that the line by itself opens; ``section`` is the last one opened so far, Header before any. A list of tools opens Skills only where no
    employment is open; a Summary opens only before everything else and not with the document's first line.
    """
    v, i = F.trim("line"), F.col("line_index")
    rows = sectioned.where("section_id = 's0:Header' and heading is null and not is_page_number and trim(line) <> ''").select(KEY, "line_index", v.alias("v"))
    v, dated = F.col("v"), F.col("v").rlike(DATES)
    no_sentence = ~v.rlike(r"[.!?]")
    cue = F.when(F.lit(False), "")
    for pattern, section in CUED:
        cue = cue.when(v.rlike(pattern), section)
    cue = (
        cue.when(v.rlike(DEGREE) & (v.rlike(PLACE_OF_STUDY) | dated), "Education").when(v.rlike(DEGREE_FIRST) & (F.length(v) < 140) & no_sentence, "Education").when(dated & v.rlike(ROLE) & (F.length(v) < 260), "Experience")
        .when(v.rlike(ROLE) & (F.length(v) < 180) & ((i > 4) | dated) & v.rlike(r"(?i)\s(?:at|@)\s|\s[–—]\s") & no_sentence, "Experience").when(v.rlike(CERTIFIED), "Certifications")
    )
    tools = (F.length(v) - F.length(F.replace(v, F.lit(","), F.lit(""))) >= 2) & (F.size(F.regexp_extract_all(v, F.lit(rf"(?i){_BEGIN}({TOOLS[4:]})(?:[^\p{{L}}\p{{N}}_]|$)"), 1)) >= 2)
    overview = ~((i <= 4) & v.rlike(CONTACT_ROW)) & (F.length(v) > 45) & (v.rlike(OVERVIEW) | v.rlike(r"[.!?]$"))
    before = Window.partitionBy(KEY).orderBy("line_index").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(KEY).orderBy("line_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("sure", cue).withColumn("tools", tools).withColumn("overview", overview)
    open_job = F.coalesce(F.last("sure", ignorenulls=True).over(before) == "Experience", F.lit(False))
    rows = rows.withColumn("cue", F.coalesce("sure", F.when(F.col("tools") & ~open_job, "Skills")))
    first = (F.coalesce(F.count("cue").over(upto), F.lit(0)) == 0) & (F.count("v").over(before) > 0) & F.col("overview")
    rows = rows.withColumn("first", first)
    rows = rows.withColumn("cue", F.coalesce("cue", F.when(F.col("first") & (F.coalesce(F.sum(F.col("first").cast("int")).over(before), F.lit(0)) == 0), "Summary")))
    return rows.select(KEY, "line_index", "cue", F.coalesce(F.last("cue", ignorenulls=True).over(upto), F.lit("Header")).alias("section"))


def contact_rows(sectioned: DataFrame) -> DataFrame:
    """upload_id, line_index of lines with a contact before the first heading of a main section: they belong to the document's head, whatever stands above them."""
    major = F.when(F.col("heading").isin(MAJOR), F.col("line_index"))
    rows = sectioned.withColumn("first_major", F.min(major).over(Window.partitionBy(KEY)))
    return rows.where("first_major is null or line_index < first_major").where(F.trim("line").rlike(CONTACT_EVIDENCE)).select(KEY, "line_index", "section")


def identity(sectioned: DataFrame) -> DataFrame:
    """upload_id, name, title, email, phone, linkedin, github, location of the lines before the first heading.

    The title is the first short line with a noun of titles; the name the first of two to six words without digit, sign of contacts or title, up to the title's line;
    without one it is made of the e-mail address. The location is a labelled one, or the longest line that is none of the others.
    """
    rows = sectioned.where("section_id = 's0:Header' and heading is null and trim(line) <> ''").select(KEY, "line_index", F.trim(text.without_marker(F.col("line"))).alias("t"))
    t = F.col("t")
    label = r"(?i)^(?:name|title|email|e-mail|phone|mobile|contact|contact number|location|address|based in|city|linkedin|github|website|portfolio)\s*[:：–—-]\s*(.+)$"
    place = F.nullif(F.trim(F.regexp_extract(t, r"(?i)^(?:location|address|based in|city)\s*[:：–—-]\s*(.+)$", 1)), F.lit(""))
    rows = rows.withColumns({
        "email": text.email(t), "phone": text.phone(t), "linkedin": text.link(t, r"linkedin\.com/in/"), "github": text.link(t, r"github\.com/"), "labelled": t.rlike(label), "place": place,
        "is_title": t.rlike(classify.ROLE) & (classify.words(t) <= 8) & ~t.rlike(r"[@\d:]"),
    })
    rows = rows.withColumn("contact", F.col("email").isNotNull() | F.col("phone").isNotNull() | F.col("linkedin").isNotNull() | F.col("github").isNotNull() | t.rlike(r"(?i)https?://|www\."))
    rows = rows.withColumn("title_at", F.min(F.when(F.col("is_title"), F.col("line_index"))).over(Window.partitionBy(KEY)))
    is_name = ~F.col("is_title") & ~F.col("contact") & ~F.col("labelled") & classify.words(t).between(2, 6) & ~t.rlike(r"\d") & (F.col("title_at").isNull() | (F.col("line_index") <= F.col("title_at")))
    rows = rows.withColumn("is_name", is_name).withColumn("name_at", F.min(F.when(is_name, F.col("line_index"))).over(Window.partitionBy(KEY)))
    other = ~F.col("is_title") & ~F.col("contact") & ~F.col("labelled") & (F.col("name_at").isNull() | (F.col("line_index") != F.col("name_at"))) & t.rlike(r"\p{L}{3}")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_index")))
    out = rows.groupBy(KEY).agg(
        F.min_by("t", F.when(F.col("line_index") == F.col("name_at"), F.col("line_index"))).alias("n"), F.min_by("t", F.when(F.col("is_title"), F.col("line_index"))).alias("title"),
        *[first(c).alias(c) for c in ("email", "phone", "linkedin", "github")], first("place").alias("place"), F.max_by("t", F.when(other, F.struct(F.length("t"), -F.col("line_index")))).alias("rest"),
    )
    made = F.initcap(F.regexp_replace(F.regexp_extract("email", r"^([^@]*)@", 1), r"[._+\d-]+", " "))
    return out.select(KEY, F.coalesce("n", F.nullif(F.trim(made), F.lit(""))).alias("name"), "title", "email", "phone", "linkedin", "github", F.coalesce("place", "rest").alias("location"))


def personal_details(sectioned: DataFrame) -> DataFrame:
    """upload_id, line_index, field, value of personal details: labels with their value, and labels that stand before their values, first come first served.

    A value is taken by a label if more labels than values came before; counted down to nothing, a further value is no field (field null).
    """
    bare = F.trim(F.regexp_replace("line", r"^[\s•▪●*-]+", ""))
    rows = sectioned.where("section = 'Personal Information' and heading is null and not is_page_number").select(KEY, "line_index", bare.alias("t")).where("t <> ''")
    fields = _map(DETAIL_LABELS)
    with_colon, edges = r"^([^:]{2,50})\s*:\s*(.*)$", r"^[ :–—-]+|[ :–—-]+$"
    label = F.element_at(fields, F.nullif(F.lower(F.trim(F.regexp_extract("t", with_colon, 1))), F.lit("")))
    alone = F.element_at(fields, F.lower(F.regexp_replace("t", edges, "")))
    value = F.regexp_replace(F.regexp_extract("t", with_colon, 2), edges, "")
    rows = rows.withColumns({"label": F.coalesce(label, alone), "value": F.when(label.isNotNull(), F.nullif(value, F.lit("")))})
    given = rows.where("label is not null and value is not null").select(KEY, "line_index", F.col("label").alias("field"), "value")
    # labels without value and lines without label, in order: a queue, told by running sums
    queue = rows.where("label is null or value is null").withColumn("step", F.when(F.col("label").isNotNull(), 1).otherwise(-1))
    upto = Window.partitionBy(KEY).orderBy("line_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(KEY).orderBy("line_index").rowsBetween(Window.unboundedPreceding, -1)
    queue = queue.withColumn("s", F.sum("step").over(upto)).withColumn("least", F.least(F.lit(0), F.coalesce(F.min("s").over(earlier), F.lit(0))))
    queue = queue.withColumn("taken", (F.col("step") == -1) & (F.col("s") >= F.col("least")))
    kth = F.row_number().over(Window.partitionBy(KEY).orderBy("line_index"))
    labels = queue.where("step = 1").select(KEY, F.col("label").alias("field"), kth.alias("k"))
    text_of = F.trim(F.regexp_replace("t", r"^[:–—-]+\s*", ""))
    values = queue.where("taken").select(KEY, "line_index", text_of.alias("value"), kth.alias("k")).join(labels, [KEY, "k"]).select(KEY, "line_index", "field", "value")
    more = queue.where("step = -1 and not taken").select(KEY, "line_index", F.lit(None).cast("string").alias("field"), F.col("t").alias("value"))
    return given.unionByName(values).unionByName(more)
