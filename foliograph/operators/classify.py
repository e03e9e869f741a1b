"""What each line of a document is: the row classifier and the tests it is made of.

Rules stand in order and the first that fits decides, as one CASE over columns
that are computed once; the next row's tests come from a window over the
document. Nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.lineage import cut
from .lines import KEY

# --- Fixed values: how lines of duties begin, nouns of titles, words of firms, contact labels, labels of fields, and types by section. ---
ACTION = (
    r"(?i)^(?:i\s+have\s+worked|responsible|led|leading|liaise|gather|define|document|manag|collaborat|work(?:ed|ing)?(?:[^\p{L}\p{N}_]|$)|support|ensure|prepar|implement|develop|creat|built|design|deliver|conduct|perform|review|provid|coordinat|interact|"
    r"handl|driv|translat|involved|deployed|integrat|improv|mentor|achiev|verif|complet|download|authored|architect|establish|maintain|autom|facilitat|spearhead|orchestrat|own(?:ed)?|play(?:ed)?|act(?:ed)?|lead|configure|migrat|enhanc|reduc|optimi[sz]|analy[sz]|test|deploy|build)"
)
ROLE = (
    r"(?i)(?:^|[^\p{L}\p{N}_])(?:analyst|engineer|developer|consultant|manager|director|designer|architect|scientist|officer|specialist|associate|executive|lead|intern|owner|president|chief|researcher|accountant|administrator|coordinator|technician|teacher|nurse|professor|"
    r"fellow|transitions? executive|underwriter|functional analyst)(?:[^\p{L}\p{N}_]|$)"
)
ORGANISATION = r"(?i)(?:^|[^\p{L}\p{N}_])(?:ltd|limited|inc|llc|corp|corporation|systems|services|technologies|infotech|bank|university|laboratories)(?:[^\p{L}\p{N}_]|$)"
CONTACT_LABELS = ["email", "e-mail", "phone", "mobile", "contact number", "location", "address", "date of birth", "dob", "nationality", "languages"]
FIELD_LABEL = r"(?i)^(?:clients?|role|designation|job title|title|dates?|duration|period)(?:[^\p{L}\p{N}_]|$)"
TYPES_OF_SECTIONS = {
    "summary": "PROFILE_SUMMARY", "business objective": "UNKNOWN", "skills": "SKILL", "core competencies": "SKILL", "business analysis and product management": "SKILL", "technical skills": "TECHNOLOGY", "technical expertise": "TECHNOLOGY", "key strengths": "SKILL",
    "projects": "PROJECT", "education": "EDUCATION", "certifications": "CERTIFICATION", "certifications & training": "CERTIFICATION", "awards": "AWARD", "achievements": "ACHIEVEMENT", "publications": "PUBLICATION", "domain experience": "DOMAIN",
    "header": "CONTACT", "personal information": "PERSONAL_DETAIL", "languages": "PERSONAL_DETAIL", "tools and technology": "TECHNOLOGY",
}
# Patterns of the rules; group 1 is the value, if there is one.
PERIOD = rf"(?i)({text.DATE_ATOM})\s*(?:[-–—]|\bto\b)\s*({text.DATE_ATOM}|present|current|now|till\s+date|to\s+date)"
SINGLE_DATE = rf"(?i)^(?:{text.DATE_ATOM}|present|current|till\s+date)\.?$"
ARTIFACT = r"(?i)^(?:page\s+\d+(?:\s*(?:of|/)\s*\d+)?|[\s•▪●○◦*|_–—-]+)$"
CLIENTS = r"(?i)^clients?\s*[:–—-]\s*(.+)$"
CLIENT = r"(?i)^client\s*[:–—-]?\s*(.+)$"
CLIENT_ROLE = r"(?i)^client\s+(.+?)\s+[–—-]\s+(.+)$"
DUTY_AFTER_COMMA = r"(?i),\s*(?:designed|developed|implemented|managed|created|led|built|provided)(?:[^\p{L}\p{N}_]|$)"
PLACE = r"^[A-Z][\w .'-]{1,50},\s*[A-Z][\w .'-]{1,50}$"
ACHIEVEMENT = r"(?i)^(?:key\s+)?(?:achievement|accomplishment)s?\s*[:–—-]\s*(.+)$"
WORKED_AT = r"(?i)^worked\s+at\s+(.+)$"
WORKING_AS = r"(?i)^(?:i\s+am\s+currently\s+working\s+as|i\s+currently\s+work\s+as|i\s+worked\s+as|currently\s+working\s+as|working\s+as)\s+(?:an?\s+|the\s+)?(.+?)\s+at\s+(.+)$"
COMPANY_LABEL = r"(?i)^(?:company|employer|organization)\s*[:–—-]\s*(.+)$"
AT = r"(?i)^(.+?)\s+at\s+(.+)$"
DASH = r"^(.+?)\s+[–—|\-]\s+(.+)$"
TITLE_LABEL = r"(?i)^(?:role|designation|job title|title)\s*[:–—-]\s*(.+)$"
NEXT_LABEL = r"(?i)^(?:role|client|designation)\s*[:–—-]"
SUBHEADING = r"(?i)^(?:(?:role\s*(?:&|and)\s*)?responsibilities|key achievements|achievements|accomplishments)\s*:?$"
EDGES = r"^[ ()|,–—-]+|[ ()|,–—-]+$"


def words(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))


def bare(x: Column) -> Column:
    """Without signs that only set a value off."""
    return F.regexp_replace(x, EDGES, "")


def without_period(x: Column) -> Column:
    return bare(F.regexp_replace(x, PERIOD, ""))


def name_like(x: Column) -> Column:
    """Up to 14 words, no duty and no sentence, of which three in five begin with a capital, or with a word of firms."""
    capital = F.size(F.filter(F.split(x, r"\s+"), lambda w: w.rlike(r"^\p{Lu}")))
    return words(x).between(1, 14) & (F.length(x) < 140) & ~x.rlike(ACTION) & ~x.rlike(r"[!?;:]|https?://|@") & ((capital * 5 >= words(x) * 3) | x.rlike(ORGANISATION))


def _short_title(x: Column) -> Column:
    return x.rlike(ROLE) & (words(x) <= 4) & ~x.rlike(r"[.!?;,@]")


def role_title(x: Column) -> Column:
    """A title of up to eight words, or one beside a dash or bar in up to twelve."""
    body, cut = without_period(x), r"^(.*?)\s+[–—|]\s+(.*)$"
    left, right = F.trim(F.regexp_extract(body, cut, 1)), F.trim(F.regexp_extract(body, cut, 2))
    beside = body.rlike(cut) & (words(body) <= 12) & (_short_title(left) | _short_title(right))
    return beside | (body.rlike(ROLE) & (F.length(body) < 110) & (words(body) <= 8) & ~body.rlike(ACTION) & ~body.rlike(r"[.!?;,@]"))


def title_like(x: Column) -> Column:
    body = without_period(x)
    return ~body.rlike(FIELD_LABEL) & (role_title(x) | (name_like(body) & (words(body) <= 8) & ~body.rlike(r"[.!?@]")))


def doubled_letters(x: Column) -> Column:
    """Is a text nothing but letters that all stand twice, three or more of them?"""
    c = F.regexp_replace(x, r"[|\s]", "")
    return c.rlike(r"^[A-Za-z]{6,}$") & (F.length(c) % 2 == 0) & F.forall(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1)), F.lit(2)), lambda i: F.substring(c, i, F.lit(1)) == F.substring(c, i + 1, F.lit(1)))


def classified(rows: DataFrame, order: str = "line_index") -> DataFrame:
    """rows (upload_id, ``order``, line, section, heading, is_bullet, is_page_number) with block_type, company, designation, start_date, end_date, location, client.

    A null or blank line is a PAGE_ARTIFACT.
    """
    t = F.trim(text.without_marker(F.coalesce("line", F.lit(""))))
    base = rows.withColumn("t", t).withColumn("role", role_title(F.col("t"))).withColumn("name", name_like(F.col("t"))).withColumn("titled", title_like(F.col("t"))).withColumn("dated", F.col("t").rlike(PERIOD))
    after = Window.partitionBy(KEY).orderBy(order)
    base = base.withColumn("leads_on", F.coalesce(F.lead("titled").over(after) | F.lead("dated").over(after) | F.lead(F.col("t").rlike(NEXT_LABEL)).over(after), F.lit(False)))
    # both sides of an employment written in one line
    base = base.withColumn("left", F.trim(F.regexp_extract("t", DASH, 1))).withColumn("right", F.trim(F.regexp_extract("t", DASH, 2))).withColumn("before_at", F.trim(F.regexp_extract("t", AT, 1)))
    base = base.withColumn("left_role", role_title(F.col("left"))).withColumn("right_role", role_title(F.col("right")))
    t, left, right = F.col("t"), F.col("left"), F.col("right")
    dash = t.rlike(DASH) & ~left.rlike(FIELD_LABEL)
    role_first = dash & F.col("left_role") & ~F.col("right_role") & name_like(right)
    firm_first = dash & F.col("right_role") & ~F.col("left_role") & name_like(left)
    worked, working, label, at = t.rlike(WORKED_AT), t.rlike(WORKING_AS), t.rlike(COMPANY_LABEL) & ~F.regexp_extract(t, COMPANY_LABEL, 1).rlike(FIELD_LABEL), t.rlike(AT) & title_like(F.col("before_at"))
    plain = lambda x: bare(F.regexp_replace(without_period(x), r"(?i)\s+(?:from|during|between)\s*$", ""))
    place_worked, as_worked = r"(?i)^(.+?)\s+as\s+(?:an?|the)\s+(.+)$", plain(F.regexp_extract(t, WORKED_AT, 1))
    base = base.withColumn("worked_at", as_worked)
    w = F.col("worked_at")
    company = (
        F.when(worked, F.when(w.rlike(place_worked), F.regexp_extract(w, place_worked, 1)).otherwise(w)).when(working, plain(F.regexp_extract(t, WORKING_AS, 2))).when(label, F.trim(F.regexp_extract(t, COMPANY_LABEL, 1)))
        .when(at, plain(F.regexp_extract(t, AT, 2))).when(role_first, without_period(right)).when(firm_first, without_period(left))
    )
    designation = F.when(worked, F.nullif(F.regexp_extract(w, place_worked, 2), F.lit(""))).when(working, F.trim(F.regexp_extract(t, WORKING_AS, 1))).when(at & ~label, F.col("before_at")).when(role_first, bare(without_period(left))).when(firm_first, bare(without_period(right)))
    base = base.withColumn("h_company", F.nullif(company, F.lit(""))).withColumn("h_title", F.when(F.col("h_company").isNotNull() & ~label, F.nullif(designation, F.lit(""))))
    section, job = F.lower(F.coalesce("section", F.lit("Header"))), F.lower(F.coalesce("section", F.lit(""))) == "experience"
    head = F.trim(F.lower(F.regexp_extract(t, r"^([^:]*):", 1)))
    action, dated = t.rlike(ACTION), F.col("dated")
    trailing, rest = bare(F.regexp_replace(t, r"(?i)^.*?" + PERIOD[4:], "")), bare(F.regexp_replace(t, PERIOD + r".*$", ""))
    base = base.withColumn("rest", F.when(dated, rest)).withColumn("trailing", F.when(dated, trailing))
    title_of = F.coalesce(F.nullif(F.regexp_extract(t, TITLE_LABEL, 1), F.lit("")), t)
    types = F.create_map(*[F.lit(x) for pair in sorted(TYPES_OF_SECTIONS.items()) for x in pair])
    no = F.lit(False)
    rule = (
        F.when((t == "") | F.coalesce("is_page_number", no) | t.rlike(ARTIFACT) | doubled_letters(t), "artifact")
        .when(F.col("heading").isNotNull(), "heading")
        .when(job & t.rlike(CLIENTS), "clients")
        .when(section.isin("header", "personal information") & head.isin(CONTACT_LABELS), "contact")
        .when(job & t.rlike(DUTY_AFTER_COMMA), "duty")
        .when(job & t.rlike(PLACE) & ~F.coalesce("is_bullet", no) & ~action & ~t.rlike(r"[.!?]"), "place")
        .when(job & t.rlike(ACHIEVEMENT), "achievement")
        .when(job & t.rlike(CLIENT_ROLE) & role_title(F.regexp_extract(t, CLIENT_ROLE, 2)), "client_role")
        .when(job & t.rlike(CLIENT) & (words(F.regexp_extract(t, CLIENT, 1)) <= 8), "client")
        .when(job & F.col("h_title").isNotNull(), "company_role")
        .when(job & F.col("h_company").isNotNull(), "company")
        .when(job & (t.rlike(TITLE_LABEL) | F.col("role")), "role")
        .when(job & dated & ~action & (F.col("trailing") != "") & title_like(F.col("trailing")), "date_role")
        .when(job & dated & ~action & (F.col("rest") != "") & name_like(F.col("rest")) & ~F.col("rest").rlike(FIELD_LABEL), "company_date")
        .when(job & dated & ~action, "date")
        .when(job & t.rlike(SINGLE_DATE), "single_date")
        .when(job & ~F.coalesce("is_bullet", no) & F.col("name") & F.col("leads_on"), "company_next")
        .when(job & t.rlike(SUBHEADING), "subheading")
        .when(job, "duty")
        .otherwise("section")
    )
    base = base.withColumn("rule", rule)
    r, of = F.col("rule"), lambda *names: F.col("rule").isin(*names)
    kind = (
        F.when(r == "artifact", "PAGE_ARTIFACT").when(r == "heading", "SECTION_HEADING").when(of("clients", "client_role", "client"), "CLIENT").when(r == "contact", "PERSONAL_DETAIL").when(r == "duty", "RESPONSIBILITY").when(r == "place", "LOCATION").when(r == "achievement", "ACHIEVEMENT")
        .when(r == "company_role", "COMPANY_ROLE").when(of("company", "company_date", "company_next"), "COMPANY").when(r == "role", "ROLE").when(of("date_role", "date", "single_date"), "DATE_RANGE").when(r == "subheading", "SUBSECTION_HEADING").otherwise(F.coalesce(F.element_at(types, section), F.lit("UNKNOWN")))
    )
    with_dates = dated & of("company_role", "company", "role", "date_role", "company_date", "date")
    out = base.withColumns({
        "block_type": kind,
        "company": F.when(of("company_role", "company"), F.col("h_company")).when(r == "company_date", F.col("rest")).when(r == "company_next", t),
        "designation": F.when(r == "company_role", F.col("h_title")).when(r == "role", F.nullif(without_period(title_of), F.lit(""))).when(r == "date_role", F.col("trailing")).when(r == "client_role", F.regexp_extract(t, CLIENT_ROLE, 2)),
        "start_date": F.when(with_dates, F.regexp_extract(t, PERIOD, 1)).when(r == "single_date", t),
        "end_date": F.when(with_dates, F.regexp_extract(t, PERIOD, 2)),
        "location": F.when(r == "place", t),
        "client": F.when(r == "clients", F.trim(F.regexp_extract(t, CLIENTS, 1))).when(r == "client_role", F.trim(F.regexp_extract(t, CLIENT_ROLE, 1))).when(r == "client", F.trim(F.regexp_extract(t, CLIENT, 1))),
    })
    return out.drop("t", "role", "name", "titled", "dated", "leads_on", "left", "right", "before_at", "left_role", "right_role", "worked_at", "h_company", "h_title", "rest", "trailing", "rule")


def as_blocks(sectioned: DataFrame) -> DataFrame:
    """Classified lines in the form of layout rows: what records are built from; cut, as those read them many times."""
    rows = classified(sectioned)
    e = F.struct("company", "designation", "start_date", "end_date", "location")
    blocks = rows.select(
        F.xxhash64(KEY, "line_index").alias("block_id"), KEY, F.concat(F.lit("d"), "line_index").alias("row_id"), "line_index", F.col("line_index").alias("reading_order"), F.col("line").alias("text"), "section", "section_id", "is_bullet", "block_type",
        F.when(F.col("block_type") == "UNKNOWN", 0.0).otherwise(0.7).alias("confidence"), e.alias("entities"),
    )
    return cut(blocks)
