"""Queries on what rows are, on sections without headings and on identities, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headings, text
from ..operators import audit, classify, context, groups, json_records, lines, mentions, records, rows, sectioning
from ..sources.tables import table
from .lineage import cut
from .queries_text import _BLOCKS, _MENTIONS, _RELATIONS, _SECTIONS, _SENTENCES, _blanks_only, _sections

Query = Callable[[SparkSession, str], DataFrame]
KEY = lines.KEY
_Q: dict[str, Query] = {}
_S: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql:
            _S[f.__name__] = _blanks_only(sql)
        return f

    return add


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "semantic_blocks")


def _s(pattern: str) -> str:
    """A pattern as a string in SQL."""
    return "'" + pattern.replace("'", "''") + "'"


def _is(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_s(pattern)})"


def _part(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {_s(pattern)}, {group})"


def _words(x: str) -> str:
    return rf"len(list_filter(string_split_regex({x}, '\s+'), lambda w: w <> ''))"


def _bare(x: str) -> str:
    return f"regexp_replace({x}, {_s(classify.EDGES)}, '', 'g')"


def _without_period(x: str) -> str:
    return _bare(f"regexp_replace({x}, {_s(classify.PERIOD)}, '', 'g')")


def _name_like(x: str) -> str:
    capital = rf"len(list_filter(string_split_regex({x}, '\s+'), lambda w: regexp_matches(w, '^\p{{Lu}}')))"
    return f"({_words(x)} between 1 and 14 and length({x}) < 140 and not {_is(x, classify.ACTION)} and not {_is(x, '[!?;:]|https?://|@')} and ({capital} * 5 >= {_words(x)} * 3 or {_is(x, classify.ORGANISATION)}))"


def _short(x: str) -> str:
    return f"({_is(x, classify.ROLE)} and {_words(x)} <= 4 and not {_is(x, '[.!?;,@]')})"


def _role_title(b: str) -> str:
    """Of a text without its period."""
    cut_ = r"^(.*?)\s+[–—|]\s+(.*)$"
    left, right = f"trim({_part(b, cut_, 1)})", f"trim({_part(b, cut_, 2)})"
    return f"(({_is(b, cut_)} and {_words(b)} <= 12 and ({_short(left)} or {_short(right)})) or ({_is(b, classify.ROLE)} and length({b}) < 110 and {_words(b)} <= 8 and not {_is(b, classify.ACTION)} and not {_is(b, '[.!?;,@]')}))"


def _title_like(b: str) -> str:
    return f"(not {_is(b, classify.FIELD_LABEL)} and ({_role_title(b)} or ({_name_like(b)} and {_words(b)} <= 8 and not {_is(b, '[.!?@]')})))"


_C = classify
_BARE_LINE = r"trim(regexp_replace(regexp_replace(line, '[\x{e000}-\x{f8ff}]', '', 'g'), '^\s*(?:([•▪●○◦·–—>*\-])\s*|(\d+[.)])\s*)', ''))"
_AFTER_FROM = r"(?i)\s+(?:from|during|between)\s*$"
_plain = lambda x: _bare(f"regexp_replace({_without_period(x)}, {_s(_AFTER_FROM)}, '')")
_AS = r"(?i)^(.+?)\s+as\s+(?:an?|the)\s+(.+)$"
_TYPES = "case section_key " + " ".join(f"when '{k}' then '{v}'" for k, v in sorted(_C.TYPES_OF_SECTIONS.items())) + " else 'UNKNOWN' end"
_LABELS = ", ".join(f"'{x}'" for x in _C.CONTACT_LABELS)
_CLASSIFIED = rf"""{_SECTIONS},
k0 as (select upload_id, line_index, heading, is_bullet, is_page_number, lower(section) as section_key, lower(section) = 'experience' as job, {_BARE_LINE} as t from sectioned),
k1 as (select *, {_without_period('t')} as b, {_is('t', _C.PERIOD)} as dated, trim({_part('t', _C.DASH, 1)}) as l, trim({_part('t', _C.DASH, 2)}) as r, trim({_part('t', _C.AT, 1)}) as before_at, {_plain(_part('t', _C.WORKED_AT))} as w,
  trim(lower(regexp_extract(t, '^([^:]*):', 1))) as head, {_bare(f"regexp_replace(t, {_s('(?i)^.*?' + _C.PERIOD[4:])}, '')")} as tail_text, {_bare(f"regexp_replace(t, {_s(_C.PERIOD + '.*$')}, '')")} as rest from k0),
k2 as (select *, {_without_period('l')} as lb, {_without_period('r')} as rb, {_without_period('before_at')} as ab, {_without_period('tail_text')} as tb from k1),
k3 as materialized (select *, {_role_title('b')} as role, {_name_like('t')} as name, {_title_like('b')} as titled, {_role_title('lb')} as l_role, {_role_title('rb')} as r_role from k2),
k4 as (select *, coalesce(lead(titled) over o or lead(dated) over o or lead({_is('t', _C.NEXT_LABEL)}) over o, false) as leads_on, {_is('t', _C.DASH)} and not {_is('l', _C.FIELD_LABEL)} as dash,
  {_is('t', _C.COMPANY_LABEL)} and not {_is(_part('t', _C.COMPANY_LABEL), _C.FIELD_LABEL)} as labelled, {_is('t', _C.AT)} and {_title_like('ab')} as is_at from k3 window o as (partition by upload_id order by line_index)),
k5 as (select *, nullif(case when {_is('t', _C.WORKED_AT)} then (case when {_is('w', _AS)} then {_part('w', _AS, 1)} else w end) when {_is('t', _C.WORKING_AS)} then {_plain(_part('t', _C.WORKING_AS, 2))} when labelled then trim({_part('t', _C.COMPANY_LABEL)})
  when is_at then {_plain(_part('t', _C.AT, 2))} when dash and l_role and not r_role and {_name_like('r')} then rb when dash and r_role and not l_role and {_name_like('l')} then lb end, '') as h_company,
  nullif(case when {_is('t', _C.WORKED_AT)} then {_part('w', _AS, 2)} when {_is('t', _C.WORKING_AS)} then trim({_part('t', _C.WORKING_AS, 1)}) when is_at and not labelled then before_at when dash and l_role and not r_role and {_name_like('r')} then {_bare('lb')}
  when dash and r_role and not l_role and {_name_like('l')} then {_bare('rb')} end, '') as h_title0 from k4),
k6 as (select *, case when h_company is not null and not labelled then h_title0 end as h_title from k5),
k7 as (select *, case when t = '' or is_page_number or {_is('t', _C.ARTIFACT)} or (regexp_matches(regexp_replace(t, '[|\s]', '', 'g'), '^[A-Za-z]{{6,}}$') and length(regexp_replace(t, '[|\s]', '', 'g')) % 2 = 0
    and len(list_filter(range(1, length(regexp_replace(t, '[|\s]', '', 'g')) + 1, 2), lambda i: regexp_replace(t, '[|\s]', '', 'g')[i] <> regexp_replace(t, '[|\s]', '', 'g')[i + 1])) = 0) then 'artifact'
  when heading is not null then 'heading' when job and {_is('t', _C.CLIENTS)} then 'clients' when section_key in ('header', 'personal information') and head in ({_LABELS}) then 'contact' when job and {_is('t', _C.DUTY_AFTER_COMMA)} then 'duty'
  when job and {_is('t', _C.PLACE)} and not is_bullet and not {_is('t', _C.ACTION)} and not {_is('t', '[.!?]')} then 'place' when job and {_is('t', _C.ACHIEVEMENT)} then 'achievement'
  when job and {_is('t', _C.CLIENT_ROLE)} and {_role_title(_without_period(_part('t', _C.CLIENT_ROLE, 2)))} then 'client_role' when job and {_is('t', _C.CLIENT)} and {_words(_part('t', _C.CLIENT))} <= 8 then 'client'
  when job and h_title is not null then 'company_role' when job and h_company is not null then 'company' when job and ({_is('t', _C.TITLE_LABEL)} or role) then 'role'
  when job and dated and not {_is('t', _C.ACTION)} and tail_text <> '' and {_title_like('tb')} then 'date_role' when job and dated and not {_is('t', _C.ACTION)} and rest <> '' and {_name_like('rest')} and not {_is('rest', _C.FIELD_LABEL)} then 'company_date'
  when job and dated and not {_is('t', _C.ACTION)} then 'date' when job and {_is('t', _C.SINGLE_DATE)} then 'single_date' when job and not is_bullet and name and leads_on then 'company_next' when job and {_is('t', _C.SUBHEADING)} then 'subheading'
  when job then 'duty' else 'section' end as rule from k6),
classified as (select upload_id, line_index, case when rule = 'artifact' then 'PAGE_ARTIFACT' when rule = 'heading' then 'SECTION_HEADING' when rule in ('clients', 'client_role', 'client') then 'CLIENT' when rule = 'contact' then 'PERSONAL_DETAIL' when rule = 'duty' then 'RESPONSIBILITY'
  when rule = 'place' then 'LOCATION' when rule = 'achievement' then 'ACHIEVEMENT' when rule = 'company_role' then 'COMPANY_ROLE' when rule in ('company', 'company_date', 'company_next') then 'COMPANY' when rule = 'role' then 'ROLE'
  when rule in ('date_role', 'date', 'single_date') then 'DATE_RANGE' when rule = 'subheading' then 'SUBSECTION_HEADING' else {_TYPES} end as block_type,
  case when rule in ('company_role', 'company') then h_company when rule = 'company_date' then rest when rule = 'company_next' then t end as company,
  case when rule = 'company_role' then h_title when rule = 'role' then nullif({_without_period(f"coalesce(nullif({_part('t', _C.TITLE_LABEL)}, ''), t)")}, '') when rule = 'date_role' then tail_text when rule = 'client_role' then {_part('t', _C.CLIENT_ROLE, 2)} end as designation,
  case when dated and rule in ('company_role', 'company', 'role', 'date_role', 'company_date', 'date') then {_part('t', _C.PERIOD, 1)} when rule = 'single_date' then t end as start_date,
  case when dated and rule in ('company_role', 'company', 'role', 'date_role', 'company_date', 'date') then {_part('t', _C.PERIOD, 2)} end as end_date from k7)"""


@query(f"with {_CLASSIFIED} select * from classified")
def c1_classified_lines(s, d):
    return classify.classified(_sections(s, d)).select(KEY, "line_index", "block_type", "company", "designation", "start_date", "end_date")


# ---- sections without headings ----
_HEADS = ", ".join(f"('{h}', '{x}')" for h, x in sorted(headings.by_heading().items()))
_RECORDS = ", ".join(f"'{x}'" for x in sectioning.RECORD_LABELS)
_KEY_OF = lambda x: rf"""regexp_replace(replace(lower(regexp_replace(regexp_replace(case when regexp_matches({x}, '^\s*(?:[A-Za-z]\s+){{2,}}[A-Za-z]\s*$') then regexp_replace({x}, '\s+', '', 'g') else {x} end, '^\s*(?:\d+[.)]|[•▪●*#])\s*', ''), '^[|–—_\-:\s]+|[|–—_\-:\s.]+$', '', 'g')), '&', 'and'), '\s+', ' ', 'g')"""


@query(
    rf"""with {_SECTIONS}, heads as (select * from (values {_HEADS}) as h(name, section)),
    i0 as (select upload_id, line_index, trim(line) as t from sectioned where heading is null and trim(line) <> ''),
    i1 as (select *, regexp_replace(lower(trim(regexp_extract(t, '^([^:]*):', 1))), '\s+', ' ', 'g') as label, {_KEY_OF("regexp_extract(t, '^([^:]*):', 1)")} as k, trim(regexp_extract(t, '^[^:]*:(.*)$', 1)) as after, regexp_replace(replace(lower(t), '&', 'and'), '\s+', ' ', 'g') as folded from i0),
    i2 as (select i1.*, h.section as by_colon from i1 left join heads h on h.name = i1.k and i1.k <> '' and contains(t, ':') and after <> ''),
    i3 as (select i2.*, f.name, f.section as fit from i2 left join heads f on regexp_matches(t, '^[A-Z]{{2}}') and starts_with(folded, f.name || ' ') and substring(t, 1, length(f.name)) = upper(substring(t, 1, length(f.name))) and regexp_matches(substring(t, 1, length(f.name)), '[A-Z]')
      and len(string_split(trim(substring(folded, length(f.name) + 1)), ' ')) >= 2 qualify row_number() over (partition by upload_id, line_index order by length(f.name) desc nulls last, f.name) = 1),
    i4 as (select upload_id, line_index, label, coalesce(by_colon, fit) as section, case when by_colon is not null then after else regexp_replace(substring(t, length(name) + 1), '^[ :–—|\t-]+|[ :–—|\t-]+$', '', 'g') end as body from i3)
    select upload_id, line_index, section, body from i4 where label not in ({_RECORDS}) and section is not null and body <> ''"""
)
def sec_p2_inline_headings(s, d):
    return sectioning.inline_headings(_sections(s, d))


_P = sectioning
_TOOLS = rf"len(regexp_extract_all(v, {_s('(?i)' + _P._BEGIN + '(' + _P.TOOLS[4:] + ')' + r'(?:[^\p{L}\p{N}_]|$)')}, 1)) >= 2"
_CUE = " ".join(f"when {_is('v', p)} then '{x}'" for p, x in _P.CUED)


@query(
    rf"""with {_SECTIONS}, h0 as (select upload_id, line_index, trim(line) as v from sectioned where section_id = 's0:Header' and heading is null and not is_page_number and trim(line) <> ''),
    h1 as (select *, case {_CUE} when {_is('v', _P.DEGREE)} and ({_is('v', _P.PLACE_OF_STUDY)} or {_is('v', _P.DATES)}) then 'Education' when {_is('v', _P.DEGREE_FIRST)} and length(v) < 140 and not {_is('v', '[.!?]')} then 'Education'
      when {_is('v', _P.DATES)} and {_is('v', _P.ROLE)} and length(v) < 260 then 'Experience' when {_is('v', _P.ROLE)} and length(v) < 180 and (line_index > 4 or {_is('v', _P.DATES)}) and {_is('v', r'(?i)' + chr(92) + 's(?:at|@)' + chr(92) + 's|' + chr(92) + 's[–—]' + chr(92) + 's')} and not {_is('v', '[.!?]')} then 'Experience'
      when {_is('v', _P.CERTIFIED)} then 'Certifications' end as sure, length(v) - length(replace(v, ',', '')) >= 2 and {_TOOLS} as tools,
      not (line_index <= 4 and {_is('v', _P.CONTACT_ROW)}) and length(v) > 45 and ({_is('v', _P.OVERVIEW)} or {_is('v', '[.!?]$')}) as overview from h0),
    h2 as (select *, coalesce(sure, case when tools and not coalesce(last_value(sure ignore nulls) over b = 'Experience', false) then 'Skills' end) as c, count(*) over b as earlier from h1 window b as (partition by upload_id order by line_index rows between unbounded preceding and 1 preceding)),
    h3 as (select *, count(c) over (partition by upload_id order by line_index rows unbounded preceding) = 0 and earlier > 0 and overview as first from h2),
    h4 as (select *, coalesce(c, case when first and coalesce(sum(cast(first as int)) over (partition by upload_id order by line_index rows between unbounded preceding and 1 preceding), 0) = 0 then 'Summary' end) as cue from h3)
    select upload_id, line_index, cue, coalesce(last_value(cue ignore nulls) over (partition by upload_id order by line_index rows unbounded preceding), 'Header') as section from h4"""
)
def sec_p4_inferred_sections(s, d):
    return sectioning.inferred_sections(_sections(s, d))


_MAJOR = ", ".join(f"'{x}'" for x in _P.MAJOR)


@query(
    f"with {_SECTIONS}, m as (select *, min(line_index) filter (heading in ({_MAJOR})) over (partition by upload_id) as first_major from sectioned) select upload_id, line_index, section from m where (first_major is null or line_index < first_major) and {_is('trim(line)', _P.CONTACT_EVIDENCE)}"
)
def sec_p5_contact_rows(s, d):
    return sectioning.contact_rows(_sections(s, d))


_FIRST = lambda c: f"min_by({c}, line_index) filter ({c} is not null)"
_LABELLED = r"(?i)^(?:name|title|email|e-mail|phone|mobile|contact|contact number|location|address|based in|city|linkedin|github|website|portfolio)\s*[:：–—-]\s*(.+)$"


@query(
    rf"""with {_SECTIONS}, d0 as (select upload_id, line_index, {_BARE_LINE} as t from sectioned where section_id = 's0:Header' and heading is null and trim(line) <> ''),
    d1 as (select *, nullif(regexp_extract(t, {_s(text.EMAIL)}, 0), '') as email, list_filter(regexp_extract_all(t, {_s(text.PHONE)}), lambda p: length(regexp_replace(p, '\D', '', 'g')) between 7 and 15)[1] as phone,
      nullif(regexp_extract(t, '(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[\w\-./%]+', 0), '') as linkedin, nullif(regexp_extract(t, '(?i)(?:https?://)?(?:www\.)?github\.com/[\w\-./%]+', 0), '') as github, {_is('t', _LABELLED)} as labelled,
      nullif(trim({_part('t', r'(?i)^(?:location|address|based in|city)' + chr(92) + 's*[:：–—-]' + chr(92) + 's*(.+)$')}), '') as place, {_is('t', _C.ROLE)} and {_words('t')} <= 8 and not {_is('t', r'[@' + chr(92) + 'd:]')} as is_title from d0),
    d2 as (select *, email is not null or phone is not null or linkedin is not null or github is not null or regexp_matches(t, '(?i)https?://|www\.') as contact, min(line_index) filter (is_title) over (partition by upload_id) as title_at from d1),
    d3 as (select *, not is_title and not contact and not labelled and {_words('t')} between 2 and 6 and not regexp_matches(t, '\d') and (title_at is null or line_index <= title_at) as is_name from d2),
    d4 as (select *, min(line_index) filter (is_name) over (partition by upload_id) as name_at from d3),
    d5 as (select *, not is_title and not contact and not labelled and (name_at is null or line_index <> name_at) and regexp_matches(t, '\p{{L}}{{3}}') as other from d4),
    d6 as (select upload_id, min_by(t, line_index) filter (line_index = name_at) as n, min_by(t, line_index) filter (is_title) as title, {_FIRST('email')} as email, {_FIRST('phone')} as phone, {_FIRST('linkedin')} as linkedin, {_FIRST('github')} as github, {_FIRST('place')} as place,
      max_by(t, (length(t), -line_index)) filter (other) as rest from d5 group by upload_id)
    select upload_id, coalesce(n, nullif(array_to_string(list_transform(string_split(trim(regexp_replace(regexp_extract(email, '^([^@]*)@', 1), '[._+\d-]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), '')) as name, title, email, phone, linkedin, github, coalesce(place, rest) as location from d6"""
)
def n16_identities(s, d):
    return sectioning.identity(_sections(s, d))


_DETAILS = "case {0} " + " ".join(f"when '{k.replace(chr(39), chr(39) * 2)}' then '{v}'" for k, v in sorted(_P.DETAIL_LABELS.items())) + " end"
_COLON = r"^([^:]{2,50})\s*:\s*(.*)$"
_SIDES = r"^[ :–—-]+|[ :–—-]+$"


@query(
    rf"""with {_SECTIONS}, p0 as (select upload_id, line_index, trim(regexp_replace(line, '^[\s•▪●*-]+', '')) as t from sectioned where section = 'Personal Information' and heading is null and not is_page_number),
    p1 as (select *, {_DETAILS.format(f"lower(trim({_part('t', _COLON)}))")} as by_colon, {_DETAILS.format(f"lower(regexp_replace(t, {_s(_SIDES)}, '', 'g'))")} as alone, nullif(regexp_replace({_part('t', _COLON, 2)}, {_s(_SIDES)}, '', 'g'), '') as v from p0 where t <> ''),
    p2 as (select upload_id, line_index, t, coalesce(by_colon, alone) as label, case when by_colon is not null then v end as value from p1),
    q0 as (select *, case when label is not null then 1 else -1 end as step from p2 where label is null or value is null),
    q1 as (select *, sum(step) over (partition by upload_id order by line_index rows unbounded preceding) as s from q0),
    q2 as (select *, step = -1 and s >= least(0, coalesce(min(s) over (partition by upload_id order by line_index rows between unbounded preceding and 1 preceding), 0)) as taken from q1),
    ls as (select upload_id, label as field, row_number() over (partition by upload_id order by line_index) as k from q2 where step = 1), vs as (select upload_id, line_index, trim(regexp_replace(t, '^[:–—-]+\s*', '')) as value, row_number() over (partition by upload_id order by line_index) as k from q2 where taken)
    select upload_id, line_index, label as field, value from p2 where label is not null and value is not null union all select vs.upload_id, line_index, field, value from vs join ls on ls.upload_id = vs.upload_id and ls.k = vs.k
    union all select upload_id, line_index, null, t from q2 where step = -1 and not taken"""
)
def n21_personal_details(s, d):
    return sectioning.personal_details(_sections(s, d))


# ---- rows and mentions ----
@query(
    r"""with c as (select block_id, upload_id, section_id, reading_order, text, regexp_matches(text, '^\s*[•▪●○◦·*–—-]\s*$') as glyph from semantic_blocks where text is not null and trim(text) <> ''),
    n as (select *, lead(block_id) over o as next_id, lead(glyph) over o as next_glyph from c window o as (partition by upload_id, section_id order by reading_order, block_id)) select block_id, next_id, trim(text) as marker from n where glyph and next_id is not null and not next_glyph"""
)
def c11_marker_of_next_row(s, d):
    return rows.handed_markers(_blocks(s, d))


@query(
    r"""with r as (select *, row_number() over (partition by upload_id order by reading_order, block_id) as n from semantic_blocks where text is not null)
    select upload_id, block_id, n as number, trim(regexp_replace(text, '\s+', ' ', 'g')) as normalized, coalesce(block_type, 'UNKNOWN') as label, regexp_matches(text, '(?i)^\s*(?:page\s+)?\d{1,3}(?:\s*(?:of|/)\s*\d{1,3})?\s*$') as is_page_marker from r"""
)
def c16_numbered_rows(s, d):
    return rows.numbered(_blocks(s, d))


@query(
    """with a as (select upload_id, line_index, max(section) as new_section, bool_or(block_type = 'PAGE_ARTIFACT') as artifact from semantic_blocks where line_index is not null group by all),
    x as (select s.*, a.new_section, coalesce(a.artifact, false) as artifact from """
    + f"(with {_SENTENCES} select upload_id, sentence_index, line_index, section, sentence from sentences)"
    + " s left join a on a.upload_id = s.upload_id and a.line_index = s.line_index) select upload_id, row_number() over (partition by upload_id order by sentence_index) - 1 as sentence_index, line_index, coalesce(new_section, section) as section, sentence from x where not artifact"
)
def c15_rewritten_sentences(s, d):
    return rows.written_back(lines.split_sentences(_sections(s, d)), _blocks(s, d))


@query(f"with {_MENTIONS} select m.upload_id, m.text, m.type, list_sort(list_distinct(list(section))) as sections from mentions m join sentences using (upload_id, sentence_index) group by m.upload_id, m.text, m.type")
def e9_sections_of_mentions(s, d):
    sentences = cut(lines.split_sentences(_sections(s, d)))
    return mentions.sections_of(mentions.all_mentions(sentences), sentences)


_GUARDED = f"""{_BLOCKS}, sb as (select upload_id, unnest(sentence_indices) as sentence_index, block from blocks), {_RELATIONS[len(_SENTENCES) + 2 :]},
best as (select upload_id, source, target, relationship, confidence, sentence_index from rel where source <> target qualify row_number() over (partition by upload_id, source, target, relationship order by confidence desc, sentence_index) = 1),
guarded as (select b.*, s.section, sb.block from best b join sentences s using (upload_id, sentence_index) join sb using (upload_id, sentence_index) where (source = 'PERSON' or contains(lower(sentence), lower(source))) and (target = 'PERSON' or contains(lower(sentence), lower(target)))
  qualify row_number() over (partition by b.upload_id, source, target, relationship, block order by sentence_index) = 1)"""


def _guarded(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sentences = cut(lines.split_sentences(_sections(s, d)))
    found = cut(mentions.all_mentions(sentences))
    blocks = context.blocks(context.joins(context.sentence_lines(sentences))).select(KEY, F.explode("sentence_indices").alias("sentence_index"), "block")
    return sentences, found, mentions.guarded(mentions.relations(found, sentences), sentences, blocks)


@query(f"with {_GUARDED} select upload_id, source, target, relationship, confidence, sentence_index, section, block from guarded")
def l2_guarded_relations(s, d):
    return _guarded(s, d)[2]


@query(
    f"with {_GUARDED}, n as (select *, row_number() over (partition by upload_id order by sentence_index, source, target, relationship, block) - 1 as number from guarded) select upload_id, block, section, list('r' || number order by number) as relations from n group by upload_id, block, section"
)
def l11_relations_of_blocks(s, d):
    return mentions.fanned_out(_guarded(s, d)[2])


@query(
    f"with {_GUARDED}, m as (select distinct upload_id, sentence_index, 1 as m from mentions), k as (select distinct upload_id, sentence_index, 1 as r from guarded) select s.upload_id, count(*) as sentences, count(m) as with_mentions, count(r) as with_relations from sentences s left join m using (upload_id, sentence_index) left join k using (upload_id, sentence_index) group by s.upload_id"
)
def l12_relation_coverage(s, d):
    return mentions.relation_coverage(*_guarded(s, d))


@query(f"with {_BLOCKS} select upload_id, unnest(line_indices) as line_index, block, section_id, section from blocks")
def a6_audit_from_blocks(s, d):
    sentences = lines.split_sentences(_sections(s, d))
    return audit.from_blocks(context.blocks(context.joins(context.sentence_lines(sentences))))


# ---- records of other sections ----
_KEYS = "case lower(trim(section)) " + " ".join(f"when '{k}' then '{v}'" for k, v in sorted(records.CANONICAL_KEYS.items())) + " else 'source_sections' end"
_REAL = "select * from semantic_blocks where text is not null and trim(text) <> '' and coalesce(block_type, 'UNKNOWN') not in ('PAGE_ARTIFACT', 'SECTION_HEADING')"


@query(f"select upload_id, block_id, {_KEYS} as key from ({_REAL})")
def r1_destinations(s, d):
    return groups.destinations(_blocks(s, d))


@query(
    rf"""with r as (select *, sum(case when block_type in ('COMPANY', 'COMPANY_ROLE') then 1 else 0 end) over (partition by upload_id order by reading_order, block_id rows unbounded preceding) as jobs from semantic_blocks where section = 'Experience' and text is not null and coalesce(block_type, 'UNKNOWN') not in ('PAGE_ARTIFACT', 'SECTION_HEADING'))
    select upload_id, block_id, text from r where jobs = 0 and length(text) > 45 and ({_is('text', groups.OVERVIEW)} or regexp_matches(text, '[.!?]\s*$'))"""
)
def r4_preambles(s, d):
    return groups.preamble(_blocks(s, d))


@query(
    rf"""with r as (select *, {_BARE_LINE.replace('line', 'text')} as t from ({_REAL}) where section is not null),
    g as (select *, coalesce(regexp_matches(t, '^\p{{Ll}}') and lag(t) over (partition by upload_id, section order by reading_order, block_id) is not null and not coalesce(is_bullet, false), false) as goes_on, count(*) over (partition by upload_id, section) as n from r),
    i as (select *, sum(cast(not goes_on as int)) over (partition by upload_id, section order by reading_order, block_id rows unbounded preceding) as item from g), one as (select upload_id, section, unnest(x) as text, generate_subscripts(x, 1) as item from (select upload_id, section, string_split_regex(t, '\s*,\s*') as x from g where n = 1))
    select upload_id, section, item, string_agg(t, ' ' order by reading_order, block_id) as text from i where n > 1 group by all union all select upload_id, section, item, text from one where text <> ''"""
)
def r12_simple_items(s, d):
    return groups.simple_items(_blocks(s, d))


@query()
def r7_projects(s, d):
    return groups.projects(_blocks(s, d))


@query()
def r8_project_dates(s, d):
    return groups.project_dates(_blocks(s, d))


@query()
def r9_certifications(s, d):
    return groups.certifications(_blocks(s, d))


@query()
def r10_strengths(s, d):
    return groups.strengths(_blocks(s, d))


@query()
def r11_domains(s, d):
    return groups.domains(_blocks(s, d))


@query()
def r15_employer_context(s, d):
    return groups.employer_context(_blocks(s, d))


@query()
def c4_detached_education(s, d):
    return rows.detached_education(_blocks(s, d))


@query()
def c5_implicit_employment(s, d):
    classed = classify.classified(_sections(s, d).withColumn("was", F.col("section")).withColumn("section", F.lit("Experience")))
    return rows.implicit_employment(classed.withColumn("employer", F.col("block_type").isin("COMPANY", "COMPANY_ROLE")))


@query()
def c12_timeline_lanes(s, d):
    return rows.timeline_lanes(_blocks(s, d))


# ---- records as JSON ----
def _as_json(s: SparkSession, d: str) -> DataFrame:
    """Each upload's rows as a JSON object by section name, employments as objects: what an outside extractor would hand over."""
    jobs = records.employments(_blocks(s, d)).select(KEY, F.struct(F.col("company").alias("employer"), "location", F.transform("roles", lambda r: F.struct(r["designation"].alias("title"), F.concat_ws(" - ", r["start_date"], r["end_date"]).alias("dates"), r["duties"].alias("duties"))).alias("roles")).alias("job"))
    jobs = jobs.groupBy(KEY).agg(F.sort_array(F.collect_list("job")).alias("Experience"))
    other = _blocks(s, d).where("text is not null and section is not null and section <> 'Experience' and coalesce(block_type, '') not in ('PAGE_ARTIFACT', 'SECTION_HEADING')")
    other = other.groupBy(KEY, "section").agg(F.transform(F.sort_array(F.collect_list(F.struct("reading_order", "block_id", "text"))), lambda x: x["text"]).alias("lines"))
    other = other.groupBy(KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", "lines")))).alias("sections"))
    sections, experience = F.to_json("sections"), F.to_json(F.struct("Experience"))
    return other.join(jobs, KEY, "full").select(KEY, F.coalesce(json_records.merged_json(sections, experience), F.lit("{}")).alias("json"))


@query()
def k11_canonical_documents(s, d):
    """Each upload's record in canonical form."""
    return _as_json(s, d).select(KEY, json_records.canonical_json(F.col("json")).alias("record"))


@query()
def x2_canonical_violations(s, d):
    """The rules that each upload's canonical record breaks."""
    checked = k11_canonical_documents(s, d).select(KEY, F.explode(json_records.wrong_in_json(F.col("record"))).alias("v"))
    return checked.select(KEY, "v.rule", "v.at")


@query(f"select upload_id, key, list(text order by reading_order, block_id) as lines from (select *, {_KEYS} as key from ({_REAL})) group by upload_id, key")
def k6_section_keyed(s, d):
    """The source lines of each part of the canonical record."""
    placed = _blocks(s, d).join(groups.destinations(_blocks(s, d)).select("block_id", "key"), "block_id")
    return placed.groupBy(KEY, "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("reading_order", "block_id", "text"))), lambda x: x["text"]).alias("lines"))


@query("select distinct section, array_to_string(list_transform(string_split(lower(trim(regexp_replace(section, '[_\\-]+', ' ', 'g'))), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as label from semantic_blocks where section is not null")
def n10_labels(s, d):
    return _blocks(s, d).where("section is not null").select("section", text.label_case(F.col("section")).alias("label")).distinct()


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)
