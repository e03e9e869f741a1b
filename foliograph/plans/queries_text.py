"""Queries on text, lines, sections, blocks and mentions, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headings, text
from ..operators import audit, context, lines, mentions
from ..sources.tables import table
from .lineage import cut

Query = Callable[[SparkSession, str], DataFrame]
KEY = lines.KEY
_Q: dict[str, Query] = {}
_S: dict[str, str] = {}


def _blanks_only(sql: str) -> str:
    """trim() of the blank alone, which is what Spark's does; DuckDB's takes every Unicode space."""
    out: list[str] = []
    open_trims: list[bool] = []  # for every open bracket: does trim stand before it?
    quoted = False
    for k, ch in enumerate(sql):
        quoted ^= ch == "'"
        if ch == "(" and not quoted:
            open_trims.append(sql[max(0, k - 5) : k].endswith("trim") and not sql[max(0, k - 5) : k].endswith(("ltrim", "rtrim")))
        if ch == ")" and not quoted and open_trims.pop():
            out.append(", ' '")
        out.append(ch)
    return "".join(out)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql:
            _S[f.__name__] = _blanks_only(sql)
        return f

    return add


def _raw(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_text")


def _lines(s: SparkSession, d: str) -> DataFrame:
    return lines.split_lines(_raw(s, d))


def _sections(s: SparkSession, d: str) -> DataFrame:
    return lines.with_sections(_lines(s, d))


def _sentences(s: SparkSession, d: str) -> DataFrame:
    return lines.split_sentences(_sections(s, d))


# ---- the same steps in SQL ----
_B = r"[•▪●○◦·–—>*\-]"
_PREFIX = rf"^\s*(?:({_B})\s*|(\d+[.)])\s*)"
_PAGE = r"(?i)^\s*(?:page\s+)?\d{1,3}(?:\s*(?:of|/)\s*\d{1,3})?\s*$"
_LINES = rf"""lined as (
  select upload_id, unnest(l) as source, generate_subscripts(l, 1) - 1 as line_index
  from (select upload_id, string_split(regexp_replace(raw_text, '\r\n?', chr(10), 'g'), chr(10)) as l from raw_text where raw_text is not null and raw_text <> '')),
trimmed as (select upload_id, line_index, regexp_replace(source, '[ \t]+$', '') as line from lined),
lines as materialized (select upload_id, line_index, line, length(line) - length(regexp_replace(line, '^\s+', '')) as indent,
  regexp_extract(line, '{_PREFIX}', 1) || regexp_extract(line, '{_PREFIX}', 2) as marker, regexp_matches(line, '{_PREFIX}') as is_bullet, regexp_matches(line, '{_PAGE}') as is_page_number from trimmed)"""
_HEADS = ", ".join(f"('{h}', '{s}')" for h, s in sorted(headings.by_heading().items()))
_SECTIONS = rf"""{_LINES},
closed as (select *, case when regexp_matches(line, '^\s*(?:[A-Za-z]\s+){{2,}}[A-Za-z]\s*$') then regexp_replace(line, '\s+', '', 'g') else line end as c from lines),
bare as (select *, regexp_replace(regexp_replace(c, '^\s*(?:\d+[.)]|[•▪●*#])\s*', ''), '^[|–—_\-:\s]+|[|–—_\-:\s.]+$', '', 'g') as b from closed),
keyed as (select *, regexp_replace(replace(lower(b), '&', 'and'), '\s+', ' ', 'g') as k from bare),
headed as (select k.*, h.section as heading from keyed k left join (values {_HEADS}) as h(name, section) on h.name = k.k and length(k.k) between 1 and 60),
sectioned as materialized (select *, coalesce(last_value(heading ignore nulls) over w, 'Header') as section, 's' || count(heading) over w || ':' || coalesce(last_value(heading ignore nulls) over w, 'Header') as section_id
  from headed window w as (partition by upload_id order by line_index rows unbounded preceding))"""
_WITHOUT = rf"trim(regexp_replace(regexp_replace(line, '[\x{{e000}}-\x{{f8ff}}]', '', 'g'), '{_PREFIX}', ''))"
_SENTENCES = rf"""{_SECTIONS},
split as (select upload_id, line_index, section, section_id, indent, is_bullet, line, list_filter(string_split(regexp_replace({_WITHOUT}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') as l
  from sectioned where heading is null and not is_page_number and trim(line) <> ''),
exploded as (select * exclude (l), unnest(l) as sentence, generate_subscripts(l, 1) as pos from split),
sentences as materialized (select *, row_number() over (partition by upload_id order by line_index, pos) - 1 as sentence_index from exploded)"""


# ---- scalar functions ----
@query(r"select upload_id, regexp_replace(regexp_replace(regexp_replace(raw_text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '^\s+|\s+$', '', 'g') as text from raw_text")
def n1_unified_lines(s, d):
    return _raw(s, d).select(KEY, text.unified_lines(F.col("raw_text")).alias("text"))


@query()
def n1_compatibility_form(s, d):
    return _raw(s, d).select(KEY, text.unified_lines(text.compatibility_form(F.col("raw_text"))).alias("text"))


@query(f"with {_LINES} select upload_id, line_index, line, indent, marker, is_bullet, is_page_number from lines")
def n2_lines(s, d):
    return _lines(s, d)


@query(f"with {_LINES} select upload_id, line_index, {_WITHOUT} as text from lines")
def n3_without_markers(s, d):
    return _lines(s, d).select(KEY, "line_index", text.without_marker(F.col("line")).alias("text"))


@query(f"with {_LINES} select marker, count(*) as lines, sum(cast(is_page_number as int)) as page_numbers from lines group by marker")
def n4_markers(s, d):
    return _lines(s, d).groupBy("marker").agg(F.count("*").alias("lines"), F.sum(F.col("is_page_number").cast("int")).alias("page_numbers"))


@query(r"select distinct target_label as label, array_to_string(regexp_extract_all(lower(replace(target_label, '&', ' and ')), '[\p{L}\p{N}_+#.]+'), ' ') as key from relationships where target_label is not null")
def n7_word_keys(s, d):
    return table(s, d, "relationships").select(F.col("target_label").alias("label"), text.word_key(F.col("target_label")).alias("key")).where("label is not null").distinct()


@query(
    r"""select distinct target_label as label, regexp_replace(regexp_replace(lower(target_label), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug,
    coalesce(nullif(regexp_replace(regexp_replace(coalesce(target_label, ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'resume') as stem from relationships"""
)
def n8_slugs_and_stems(s, d):
    label = F.col("target_label")
    return table(s, d, "relationships").select(label.alias("label"), text.slug(label).alias("slug"), text.safe_stem(label).alias("stem")).distinct()


@query("select block_id, case when is_bullet then 'Yes' when not is_bullet then 'No' else '' end as bullet from semantic_blocks")
def n10_yes_no(s, d):
    return table(s, d, "semantic_blocks").select("block_id", text.yes_no(F.col("is_bullet")).alias("bullet"))


_PERIOD = text.PERIOD.replace("'", "''")
_STRICT = text.STRICT_PERIOD.replace("'", "''")


@query(f"select block_id, regexp_extract(text, '{_PERIOD}', 1) as start_date, regexp_extract(text, '{_PERIOD}', 2) as end_date from semantic_blocks where regexp_extract(text, '{_PERIOD}', 1) <> ''")
def n11_periods(s, d):
    p = text.period(F.col("text"))
    return table(s, d, "semantic_blocks").select("block_id", p["start"].alias("start_date"), p["end"].alias("end_date")).where("start_date is not null")


@query(
    rf"""select block_id, regexp_extract(text, '{_STRICT}', 1) as start_date, case when regexp_matches(regexp_extract(text, '{_STRICT}', 2), '(?i)^(?:till|to)\s+date$') then 'Present' else regexp_extract(text, '{_STRICT}', 2) end as end_date
    from semantic_blocks where regexp_extract(text, '{_STRICT}', 1) <> ''"""
)
def n12_strict_periods(s, d):
    p = text.strict_period(F.col("text"))
    return table(s, d, "semantic_blocks").select("block_id", p["start"].alias("start_date"), p["end"].alias("end_date")).where("start_date is not null")


@query(
    rf"""select distinct start_date as typed, case when regexp_extract(start_date, '(?i)\b({text.MONTH})\.?\s+(\d{{2}})(?:\D|$)', 2) = '' then start_date
    else regexp_replace(start_date, '(?i)\b({text.MONTH})\.?\s+(\d{{2}})(\D|$)', '\1 ' || case when cast(regexp_extract(start_date, '(?i)\b({text.MONTH})\.?\s+(\d{{2}})(?:\D|$)', 2) as int) <= 39 then '20' else '19' end || '\2\3') end as written
    from (select start_date from canonical_resume union all select end_date from canonical_resume) where start_date is not null"""
)
def n13_written_years(s, d):
    dates = table(s, d, "canonical_resume").select(F.explode(F.array("start_date", "end_date")).alias("typed"))
    return dates.select("typed", text.four_digit_year(F.col("typed")).alias("written")).where("typed is not null").distinct()


@query(f"with {_SENTENCES} select upload_id, sentence_index, line_index, section_id, sentence from sentences")
def n14_sentences(s, d):
    return _sentences(s, d).select(KEY, "sentence_index", "line_index", "section_id", "sentence")


_EMAIL_SQL = text.EMAIL
_first = lambda expr: f"min_by({expr}, line_index) filter ({expr} is not null)"
_PHONES_SQL = rf"list_filter(regexp_extract_all(line, '{text.PHONE}'), lambda p: length(regexp_replace(p, '\D', '', 'g')) between 7 and 15)[1]"


@query(
    f"with {_SECTIONS} select upload_id, "
    + _first(rf"nullif(regexp_extract(line, '{_EMAIL_SQL}', 0), '')")
    + " as email, "
    + _first(_PHONES_SQL)
    + " as phone, "
    + _first(r"nullif(regexp_extract(line, '(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[\w\-./%]+', 0), '')")
    + " as linkedin, "
    + _first(r"nullif(regexp_extract(line, '(?i)(?:https?://)?(?:www\.)?github\.com/[\w\-./%]+', 0), '')")
    + " as github from sectioned where section = 'Header' group by upload_id"
)
def n15_contacts(s, d):
    return lines.contact_fields(_sections(s, d))


_NAME_LIKE = rf"(regexp_matches(text, '{text.LEGAL_SUFFIX}') or (len(string_split_regex(trim(text), '\s+')) between 2 and 6 and not regexp_matches(text, '\d') and len(list_filter(string_split_regex(trim(text), '\s+'), lambda w: regexp_matches(w, '^\p{{Lu}}'))) * 5 >= len(string_split_regex(trim(text), '\s+')) * 3))"
_ROLE_LIKE = rf"(regexp_matches(text, '{text.ROLE_NOUN}') and len(string_split_regex(trim(text), '\s+')) <= 8 and not regexp_matches(text, '[.!?]$'))"


@query(f"select block_id, {_NAME_LIKE} as name_like, {_ROLE_LIKE} as role_title from semantic_blocks where text is not null")
def n17_name_and_title_tests(s, d):
    return table(s, d, "semantic_blocks").where("text is not null").select("block_id", text.name_like(F.col("text")).alias("name_like"), text.role_title(F.col("text")).alias("role_title"))


_COMPANY = r"(?i)^(.*?\b(?:ltd|limited|inc|llc|corp|corporation|gmbh|ag|co)\b\.?)\s*,\s*(.+)$"


@query(
    rf"""select distinct target_label as typed, coalesce(nullif(regexp_extract(target_label, '{_COMPANY}', 1), ''), trim(target_label)) as company,
    case when regexp_extract(target_label, '{_COMPANY}', 1) <> '' then trim(regexp_extract(target_label, '{_COMPANY}', 2)) end as place from relationships where target_label is not null"""
)
def n18_company_and_place(s, d):
    parts = text.company_and_place(F.col("target_label"))
    return table(s, d, "relationships").where("target_label is not null").select(F.col("target_label").alias("typed"), parts["company"].alias("company"), parts["place"].alias("place")).distinct()


_AT = r"^\s*(.{3,60}?)\s+at\s+(\p{Lu}[^(|]{1,80}?)\s*(?:\(([^()]*)\))?\s*$"
_DASH = r"^\s*(\p{L}[^–—|]{1,80}?)\s+[–—]\s+([^|–—]{3,60}?)\s*(?:\|\s*(.+))?$"
_LABEL = r"(?i)^\s*(?:company|employer|organi[sz]ation)\s*:\s*(.+)$"


@query(
    rf"""with c as (select block_id, text, case when regexp_matches(text, '{_LABEL}') then 1 when regexp_matches(text, '{_AT}') and regexp_matches(regexp_extract(text, '{_AT}', 1), '{text.ROLE_NOUN}') then 2
      when regexp_matches(text, '{_DASH}') and regexp_matches(regexp_extract(text, '{_DASH}', 2), '{text.ROLE_NOUN}') then 3 end as form from semantic_blocks)
    select block_id, trim(case form when 1 then regexp_extract(text, '{_LABEL}', 1) when 2 then regexp_extract(text, '{_AT}', 2) else regexp_extract(text, '{_DASH}', 1) end) as company,
      nullif(trim(case form when 2 then regexp_extract(text, '{_AT}', 1) when 3 then regexp_extract(text, '{_DASH}', 2) end), '') as title,
      nullif(trim(case form when 2 then regexp_extract(text, '{_AT}', 3) when 3 then regexp_extract(text, '{_DASH}', 3) end), '') as period from c where form is not null"""
)
def n19_employment_headers(s, d):
    h = text.employment_header(F.col("text"))
    return table(s, d, "semantic_blocks").select("block_id", h.alias("h")).where("h is not null").select("block_id", "h.company", "h.title", "h.period")


@query(
    rf"""with {_SECTIONS}, parts as (select upload_id, line_index, unnest(list_filter(string_split_regex(line, '\s*\|\s*'), lambda p: regexp_matches(p, '^\s*[A-Za-z][A-Za-z /-]{{1,30}}:\s*\S'))) as p from sectioned where heading is null)
    select upload_id, line_index, lower(trim(regexp_extract(p, '^\s*([A-Za-z][A-Za-z /-]{{1,30}}):', 1))) as label, trim(regexp_extract(p, '^[^:]+:\s*(.*)$', 1)) as value from parts"""
)
def n20_labelled_fields(s, d):
    return lines.labelled_fields(_sections(s, d))


@query(
    rf"""with {_SECTIONS}, body as (select *, sum(cast(is_bullet as int)) over w as item, sum(cast(trim(line) = '' as int)) over w as blanks from sectioned where heading is null and not is_page_number
      window w as (partition by upload_id, section_id order by line_index rows unbounded preceding)),
    marked as (select *, min(blanks) over (partition by upload_id, section_id, item) as opened from body where item > 0 and trim(line) <> '')
    select upload_id, section_id, item, string_agg({_WITHOUT}, ' ' order by line_index) as text from marked where blanks = opened group by upload_id, section_id, item"""
)
def n22_reflowed_bullets(s, d):
    return lines.reflowed_bullets(_sections(s, d))


_CATEGORY = r"^\s*([A-Za-z][A-Za-z &/]{1,30}):\s*(.*)$"


@query(
    rf"""with {_SECTIONS}, body as (select *, nullif(trim(regexp_extract(line, '{_CATEGORY}', 1)), '') as label from sectioned where heading is null and trim(line) <> '' and not is_page_number and section in ('Skills', 'Technical Skills', 'Tools and Technology')),
    carried as (select *, last_value(label ignore nulls) over (partition by upload_id, section_id order by line_index rows unbounded preceding) as category from body),
    items as (select upload_id, line_index, category, trim(unnest(string_split_regex(case when label is not null then regexp_extract(line, '{_CATEGORY}', 2) else {_WITHOUT} end, '\s*[,;]\s*'))) as skill from carried)
    select * from items where skill <> ''"""
)
def n23_skill_items(s, d):
    return lines.skill_items(_sections(s, d))


@query()
def n24_fuzzy_headings(s, d):
    """Headings by exact or close match, with how many lines each heads."""
    return lines.with_sections(_lines(s, d), fuzzy=True).where("heading is not null").groupBy("heading").agg(F.count("*").alias("lines"))


# ---- sections ----
@query(f"with {_SECTIONS} select upload_id, line_index, heading, section, section_id from sectioned")
def sec_p3_sections(s, d):
    return _sections(s, d).select(KEY, "line_index", "heading", "section", "section_id")


@query(
    f"with {_SECTIONS}, g as (select upload_id, section_id, section, min(line_index) as first_line, count(*) filter (heading is null and trim(line) <> '') as lines from sectioned group by all) select *, row_number() over (partition by upload_id order by first_line) - 1 as position from g"
)
def sec_p6_section_list(s, d):
    return lines.section_list(_sections(s, d))


@query(f"with {_SENTENCES} select upload_id, section_id, count(*) as sentences from sentences group by all")
def sec_p8_sentence_counts(s, d):
    return lines.sentence_counts(_sentences(s, d))


# ---- context blocks and audit ----
def _joined(s: SparkSession, d: str) -> DataFrame:
    return context.joins(context.sentence_lines(_sentences(s, d)))


def _sentence_blocks(s: SparkSession, d: str) -> DataFrame:
    return context.blocks(_joined(s, d)).select(KEY, F.explode("sentence_indices").alias("sentence_index"), "block")


_KINDS = ", ".join(f"('{n}', '{k}')" for n, k in sorted(headings.by_section().items()))
_SLINES = rf"""{_SENTENCES},
kinds as (select distinct section, coalesce(k.kind, trim(regexp_replace(lower(section), '[^a-z0-9]+', ' ', 'g'))) as kind from (select distinct section from sectioned) s left join (values {_KINDS}) as k(name, kind) on k.name = trim(regexp_replace(lower(s.section), '[^a-z0-9]+', ' ', 'g'))),
slines as (select upload_id, section_id, line_index, any_value(section) as section, any_value(line) as line, any_value(indent) as indent, bool_or(is_bullet) as is_bullet, list(sentence_index order by sentence_index) as sentence_indices from sentences group by upload_id, section_id, line_index),
l0 as (select s.*, k.kind from slines s join kinds k using (section)),
l1 as (select *, lag(line) over o as b_line, lag(indent) over o as b_indent, lag(line_index) over o as b_index, lag(is_bullet) over o as b_bullet, coalesce(sum(cast(is_bullet as int)) over (partition by upload_id, section_id order by line_index rows between unbounded preceding and 1 preceding), 0) as items_before,
  coalesce((regexp_matches(line, '{context.JOB_CUE}') and regexp_matches(line, '{context.YEAR_CUE}')) or (regexp_matches(line, '\s[–—]\s') and regexp_matches(line, '{context.JOB_CUE}')), false) as header
  from l0 window o as (partition by upload_id, section_id order by line_index)),
l2 as (select *, coalesce(not is_bullet and items_before > 0 and (not regexp_matches(b_line, '[.!?;]\s*$') or indent > b_indent), false) as continues, sum(cast(is_bullet as int)) over (partition by upload_id, section_id order by line_index rows unbounded preceding) as item,
  coalesce(sum(cast(header as int)) over (partition by upload_id, section_id order by line_index rows between unbounded preceding and 1 preceding), 0) as headers_before from l1),
l3 as (select *, sum(cast(not continues and not is_bullet as int)) over (partition by upload_id, section_id, item order by line_index rows unbounded preceding) as broken from l2),
joined as materialized (select *, case when b_index is null then null
  when continues and broken = 0 then 'wrapped list item'
  when kind = 'experience' and not header and headers_before > 0 then 'under the same employment'
  when kind = 'projects' and not (regexp_matches(line, '{context.PROJECT_CUE}') and not regexp_matches(line, '{context.ACTION_CUE}')) and (regexp_matches(line, '{context.ACTION_CUE}') or indent > b_indent) and (regexp_matches(b_line, '{context.PROJECT_CUE}') or regexp_matches(b_line, '{context.ACTION_CUE}')) then 'description of the project before'
  when kind = 'skills' and not is_bullet and (regexp_matches(b_line, ',\s*$') or indent > b_indent) then 'wrapped list of skills'
  when kind in ('summary', 'personal information') and line_index = b_index + 1 and not is_bullet and not b_bullet then 'plain lines of one section'
  when kind = 'education' and (regexp_matches(line, '{context.INSTITUTION_CUE}') or regexp_matches(line, '{context.EDUCATION_DETAIL}')) and not is_bullet and not regexp_matches(line, '{context.DEGREE_CUE}') and line_index = b_index + 1
    and (regexp_matches(b_line, '{context.DEGREE_CUE}') or regexp_matches(b_line, '{context.INSTITUTION_CUE}') or regexp_matches(b_line, '{context.EDUCATION_DETAIL}')) then 'detail of the education entry before' end as reason from l3)"""
_BLOCKS = rf"""{_SLINES},
numbered as (select *, sum(cast(reason is null as int)) over (partition by upload_id order by line_index rows unbounded preceding) - 1 as block from joined),
grouped as (select upload_id, block, section_id, section, kind, list(line_index order by line_index) as line_indices, string_agg(trim(line), ' ' order by line_index) as text, flatten(list(sentence_indices order by line_index)) as sentence_indices from numbered group by all),
blocks as materialized (select * exclude (kind), case when kind = 'education' then 'education_entry' when kind = 'experience' and regexp_matches(text, '{context.JOB_CUE}') and regexp_matches(text, '{context.YEAR_CUE}') then 'experience_entry'
  when kind = 'experience' then 'experience_responsibility' when kind = 'projects' then 'project_entry' when kind = 'summary' then 'summary_context' when kind = 'personal information' then 'personal_information_entry'
  when kind = 'skills' or lower(section) in ('tools', 'technologies') then 'skill_list_entry' else 'source_line_context' end as entry_type from grouped)"""


@query(f"with {_SLINES} select kind, count(*) as lines, count(distinct upload_id) as uploads from joined group by kind")
def b1_section_kinds(s, d):
    return _joined(s, d).groupBy("kind").agg(F.count("*").alias("lines"), F.count_distinct(KEY).alias("uploads"))


@query(f"with {_SLINES} select upload_id, line_index, reason from joined where reason is not null")
def b3_joined_lines(s, d):
    return _joined(s, d).where("joined").select(KEY, "line_index", "reason")


@query(
    f"with {_SLINES}, pairs as (select upload_id, lag(line_index) over o as line_index, line_index as next_line, reason is not null as merged, reason, lag(section_id) over o <> section_id as apart from joined window o as (partition by upload_id order by line_index)) select upload_id, line_index, next_line, merged, case when merged then reason when apart then 'different sections' else 'separate lines' end as reason from pairs where line_index is not null"
)
def b11_decisions(s, d):
    return context.decisions(_joined(s, d))


@query(f"with {_BLOCKS} select upload_id, block, section_id, section, entry_type, len(line_indices) as lines, len(sentence_indices) as sentences, text from blocks")
def b12_blocks(s, d):
    return context.blocks(_joined(s, d)).select(KEY, "block", "section_id", "section", "entry_type", F.size("line_indices").alias("lines"), F.size("sentence_indices").alias("sentences"), "text")


@query(f"with {_SLINES} select s.upload_id, s.line_index, s.section_id, s.line from sectioned s where heading is null and not is_page_number and trim(line) <> '' and not exists (select 1 from joined j where j.upload_id = s.upload_id and j.line_index = s.line_index)")
def b13_uncovered_lines(s, d):
    return context.uncovered_lines(_sections(s, d), context.sentence_lines(_sentences(s, d)))


@query(
    f"with {_BLOCKS}, lb as (select upload_id, unnest(line_indices) as line_index, block from blocks), body as (select distinct upload_id, line_index from sectioned where heading is null and not is_page_number and trim(line) <> '') "
    "select upload_id, count(distinct line_index) as body_lines, count(distinct case when block is not null then line_index end) as covered_lines, count(distinct block) as blocks, count(distinct line_index) = count(distinct case when block is not null then line_index end) as complete from body left join lb using (upload_id, line_index) group by upload_id"
)
def b14_coverage(s, d):
    return context.coverage(_sections(s, d), context.blocks(_joined(s, d)))


_GLYPH = r"^\s*[•▪●○◦·*\-–—]\s*$"
_AUDIT = rf"""{_BLOCKS}, lb as (select upload_id, unnest(line_indices) as line_index, block from blocks),
a0 as (select s.*, lb.block as blk, first_value(lb.block ignore nulls) over (partition by s.upload_id, section_id order by s.line_index rows between 1 following and unbounded following) as nb, regexp_matches(line, '{_GLYPH}') as glyph from sectioned s left join lb using (upload_id, line_index) where trim(line) <> ''),
audited as (select upload_id, line_index, section_id, case when is_page_number then 'page_number_marker' when glyph and nb is not null then 'bullet_marker_for_following_content' when glyph then 'decorative_bullet_marker'
  when heading is not null and blk is not null then 'section_heading_and_block_content' when heading is not null then 'section_heading' when blk is not null then 'context_block' else 'unassigned_content' end as assignment,
  case when glyph and not is_page_number then nb else blk end as block from a0)"""


def _audited(s: SparkSession, d: str) -> DataFrame:
    return audit.assignments(_sections(s, d), context.line_blocks(context.blocks(_joined(s, d))))


@query(f"with {_AUDIT} select upload_id, line_index, section_id, assignment, assignment <> 'unassigned_content' as assigned, block from audited")
def a3_assignments(s, d):
    return _audited(s, d)


@query(f"with {_AUDIT} select upload_id, section_id, count(*) as lines, count(*) filter (assignment in ('section_heading', 'section_heading_and_block_content')) as headings, count(distinct block) as blocks, min(line_index) as first_line from audited group by upload_id, section_id")
def a4_section_rollup(s, d):
    return audit.section_rollup(_audited(s, d))


@query(
    f"with {_AUDIT} select upload_id, count(*) as lines, count(*) filter (assignment <> 'unassigned_content') as assigned, count(*) filter (assignment = 'page_number_marker') as page_numbers, count(*) filter (assignment = 'section_heading') as headings, count(*) filter (assignment = 'context_block') as block_lines, count(*) filter (assignment = 'unassigned_content') as unassigned, count(distinct block) as blocks, count(distinct section_id) as sections, bool_and(assignment <> 'unassigned_content') as complete from audited group by upload_id"
)
def a5_audit_summary(s, d):
    return audit.summary(_audited(s, d))


# ---- mentions and relations ----
def _mentions(s: SparkSession, d: str) -> DataFrame:
    return mentions.all_mentions(_sentences(s, d))


_esc = lambda p: "".join("\\" + c if c in r".+*?^$()[]{}|\/" else c for c in p)
_HITS = ", ".join(
    f"case when contains(low, '{p}') and regexp_matches(low, '(?:^|\\W)({_esc(p)})(?:\\W|$)') then {{'text': "
    + ("upper" if p in mentions.CAPITALS else "")
    + f"(regexp_extract(sentence, '(?i)(?:^|\\W)({_esc(p)})(?:\\W|$)', 1)), 'type': '{t}'}} end"
    for p, t in mentions.phrases()
    if p != "ai"
)
_q = lambda p: p.replace("'", "''")
_PLIST = ", ".join(f"'{p}'" for p, _ in mentions.phrases())
_NORM = r"trim(regexp_replace(x, '\s+', ' ', 'g'))"
_MENTIONS = rf"""{_SENTENCES},
hits as (select upload_id, sentence_index, unnest(list_filter([{_HITS}], lambda h: h is not null)) as h from (select *, lower(sentence) as low from sentences)),
gaz as (select upload_id, sentence_index, h.text as text, h.type as type, 0.9 as confidence from hits
  union all select upload_id, sentence_index, 'AI', 'SKILL', 0.9 from sentences where regexp_matches(lower(sentence), '\bai\b') and regexp_extract(lower(sentence), '^.*?\bai\b(\s*/\s*ml\b)?', 1) = ''),
pat as (select upload_id, sentence_index, {_NORM} as text, type, confidence from (
    select upload_id, sentence_index, unnest(regexp_extract_all(sentence, '{_q(mentions.DEGREE)}', 1)) as x, 'DEGREE' as type, 0.88 as confidence from sentences
    union all select upload_id, sentence_index, unnest(regexp_extract_all(sentence, '{_q(mentions.INSTITUTION)}')), 'UNIVERSITY', 0.88 from sentences
    union all select upload_id, sentence_index, unnest(list_transform(regexp_extract_all(sentence, '{_q(mentions.EMPLOYER)}', 1), lambda e: regexp_replace(e, '[.,]+$', ''))), 'COMPANY', 0.9 from sentences
    union all select upload_id, sentence_index, unnest(regexp_extract_all(sentence, '{_q(mentions.PROJECT)}', 1)), 'PROJECT', 0.65 from sentences)),
kept as (select * from pat where type in ('DEGREE', 'UNIVERSITY') or (lower(text) not in ({_PLIST}) and (type = 'PROJECT' or not regexp_matches(text, '{_q(mentions.EMPLOYER_NOISE)}')))),
mentions as materialized (select * from (select * from gaz union all select * from kept) where length(text) >= 2)"""


@query(f"with {_MENTIONS} select upload_id, sentence_index, text, type, confidence from mentions where type not in ('DEGREE', 'UNIVERSITY', 'COMPANY', 'PROJECT')")
def e1_gazetteer(s, d):
    return mentions.gazetteer(_sentences(s, d))


@query(f"with {_MENTIONS} select upload_id, sentence_index, text, type, confidence from mentions where type in ('DEGREE', 'UNIVERSITY', 'COMPANY', 'PROJECT')")
def e4_patterns(s, d):
    return mentions.patterns(_sentences(s, d)).where("length(text) >= 2")


@query(
    rf"""with {_BLOCKS}, sb as (select upload_id, unnest(sentence_indices) as sentence_index, block from blocks), {_MENTIONS[len(_SENTENCES) + 2 :]},
    g as (select m.upload_id, lower(text) as key, type, block, min_by(text, (sentence_index, text)) as text, max(confidence) as confidence, count(*) as frequency from mentions m join sb using (upload_id, sentence_index) group by m.upload_id, lower(text), type, block)
    select upload_id, row_number() over (partition by upload_id order by type, frequency desc, text, block) - 1 as entity, text, type, block, confidence, frequency from g"""
)
def e8_entities(s, d):
    sentences = cut(_sentences(s, d))  # read by both kinds of mention and by the blocks
    blocks = context.blocks(context.joins(context.sentence_lines(sentences))).select(KEY, F.explode("sentence_indices").alias("sentence_index"), "block")
    return mentions.entities(mentions.all_mentions(sentences), blocks).select(KEY, "entity", "text", "type", "block", "confidence", "frequency")


_SKILLISH = ", ".join(f"'{t}'" for t in mentions.SKILL_TYPES)
_RELATIONS = rf"""{_MENTIONS},
ms as (select distinct m.*, lower(section) as section, regexp_matches(sentence, '{mentions.ACTION}') as action from mentions m join sentences using (upload_id, sentence_index)),
rel as (
  select upload_id, 'PERSON' as source, text as target, 'HAS_SKILL' as relationship, 0.86 as confidence, sentence_index from ms where type in ({_SKILLISH}) and section in ('skills', 'technical skills', 'tech stack', 'technologies')
  union all select upload_id, 'PERSON', text, 'EARNED', 0.9, sentence_index from ms where type = 'CERTIFICATION' and section = 'certifications'
  union all select a.upload_id, a.text, b.text, 'USES_TECHNOLOGY', 0.88, a.sentence_index from ms a join ms b on a.upload_id = b.upload_id and a.sentence_index = b.sentence_index and a.type = 'PROJECT' and b.type in ({_SKILLISH}) and a.action
  union all select upload_id, 'PERSON', text, 'WORKED_ON', 0.86, sentence_index from ms a where type = 'PROJECT' and action and exists (select 1 from ms b where b.upload_id = a.upload_id and b.sentence_index = a.sentence_index and b.type in ({_SKILLISH}))
  union all select upload_id, 'PERSON', text, 'USED_OR_APPLIED', 0.78, sentence_index from ms a where type in ({_SKILLISH}) and action and not exists (select 1 from ms b where b.upload_id = a.upload_id and b.sentence_index = a.sentence_index and b.type = 'PROJECT')
  union all select a.upload_id, a.text, b.text, 'AT_COMPANY', 0.9, a.sentence_index from ms a join ms b on a.upload_id = b.upload_id and a.sentence_index = b.sentence_index and a.type = 'JOB_ROLE' and b.type = 'COMPANY' and a.section = 'experience'
  union all select a.upload_id, 'PERSON', a.text, case a.type when 'JOB_ROLE' then 'HAS_ROLE' else 'WORKED_AT' end, 0.88, a.sentence_index from ms a where a.type in ('JOB_ROLE', 'COMPANY') and a.section = 'experience'
    and exists (select 1 from ms b where b.upload_id = a.upload_id and b.sentence_index = a.sentence_index and b.type = case a.type when 'JOB_ROLE' then 'COMPANY' else 'JOB_ROLE' end)
  union all select upload_id, 'PERSON', text, 'HOLDS_DEGREE', 0.9, sentence_index from ms where type = 'DEGREE')"""


@query(f"with {_RELATIONS} select upload_id, source, target, relationship, confidence, sentence_index from rel where source <> target qualify row_number() over (partition by upload_id, source, target, relationship order by confidence desc, sentence_index) = 1")
def l3_sentence_relations(s, d):
    sentences = cut(_sentences(s, d))  # read once for each kind of relation, as are the mentions
    return mentions.relations(cut(mentions.all_mentions(sentences)), sentences)


@query()
def l8_block_relations(s, d):
    sentences = cut(_sentences(s, d))
    return mentions.block_relations(cut(mentions.entities(mentions.all_mentions(sentences), _sentence_blocks(s, d))), sentences)


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)
