"""Queries on layout, records, graphs, vectors and evaluation, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import context, evaluation, graph, layout, lines, records, vectors
from ..sources.tables import table
from .lineage import cut

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_S: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql:
            _S[f.__name__] = sql
        return f

    return add


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "semantic_blocks")


def _edges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "relationships")


# ---- sources ----
@query("select * exclude (r) from (select *, row_number() over (partition by doc_id order by loaded_at desc nulls last, upload_id desc) as r from raw_text) where r = 1")
def s15_last_upload(s, d):
    return lines.documents(table(s, d, "raw_text"))


_BOX = "select *, bbox[1] as x0, bbox[2] as y0, bbox[3] as x1, bbox[4] as y1 from semantic_blocks where bbox is not null and len(bbox) = 4"


@query(
    f"""with rows as ({_BOX}), side as (select upload_id, page, cast(round(y0 / 4) as int) as band, count(*) as cells, string_agg(text, ' | ' order by x0, block_id) as text from rows where text is not null group by all) select * from side where cells > 1"""
)
def s2_table_rows(s, d):
    return layout.table_rows(_blocks(s, d)).select("upload_id", "page", "band", "cells", "text")


@query()
def s3_reading_order(s, d):
    return layout.reading_order(_blocks(s, d))


@query(
    rf"""with r as (select *, bbox[2] as y0, bbox[4] as y1 from semantic_blocks where text is not null),
    m as (select *, coalesce(y0 < 55 or y1 > page_height - 45, false) as margin from r), n as (select *, regexp_matches(text, '{text.PAGE_NUMBER}') and (margin or bbox is null) as number from m),
    w as (select *, dense_rank() over (partition by upload_id, text order by page) as nth_page from n where margin)
    select block_id, 'page_number' as artifact from n where number union all select block_id, 'repeated_margin' from w where nth_page > 1 and not number"""
)
def s4_margin_artifacts(s, d):
    return layout.margin_artifacts(_blocks(s, d))


# ---- rows and their repair ----
@query(
    r"""with l as (select upload_id, unnest(x) as line, generate_subscripts(x, 1) - 1 as line_index from (select upload_id, string_split(regexp_replace(raw_text, '\r\n?', chr(10), 'g'), chr(10)) as x from raw_text where raw_text is not null and raw_text <> ''))
    select b.block_id, l.line_index from semantic_blocks b join l on l.upload_id = b.upload_id and l.line_index = b.line_index and regexp_replace(l.line, '[ \t]+$', '') = b.text"""
)
def c2_layout_join(s, d):
    """Blocks whose text stands in the line of the same number of their upload."""
    typed = lines.split_lines(table(s, d, "raw_text")).select("upload_id", "line_index", F.col("line").alias("text"))
    return _blocks(s, d).join(typed, ["upload_id", "line_index", "text"]).select("block_id", "line_index")


@query(
    """with m as (select upload_id, font_size as middle from (select *, row_number() over (partition by upload_id order by font_size, block_id) as k, count(*) over (partition by upload_id) as n from semantic_blocks where font_size is not null) where k = n // 2 + 1)
    select block_id from semantic_blocks left join m using (upload_id) where (coalesce(bold, false) or coalesce(font_size >= 1.25 * middle, false)) and length(text) between 2 and 60 and not regexp_matches(text, '[.!?]$') and not regexp_matches(text, '\\d')"""
)
def c3_styled_headings(s, d):
    return layout.styled_headings(_blocks(s, d))


@query(
    r"""with r as (select block_id, text, lead(text) over (partition by upload_id order by reading_order, block_id) as nxt from semantic_blocks where text is not null)
    select block_id, trim(text, ' ') || ' ' || trim(nxt, ' ') as text from r where regexp_matches(text, '\d{4}\s*[–—-]\s*[A-Za-z]{3,9}\.?\s*$') and regexp_matches(nxt, '^\s*(?:19|20)\d{2}\s*$')"""
)
def c6_wrapped_dates(s, d):
    return layout.wrapped_dates(_blocks(s, d))


@query(
    """with r as (select upload_id, block_id, reading_order, block_type, lag(block_type) over o as before from semantic_blocks where text is not null and coalesce(block_type, '') <> 'PAGE_ARTIFACT' window o as (partition by upload_id order by reading_order, block_id)),
    g as (select *, sum(case when block_type = 'COMPANY_ROLE' and coalesce(before = 'COMPANY_ROLE', false) then 0 else 1 end) over (partition by upload_id order by reading_order, block_id rows unbounded preceding) as run from r),
    n as (select *, row_number() over (partition by upload_id, run order by reading_order, block_id) as k from g) select block_id, 'ROLE' as new_type from n where block_type = 'COMPANY_ROLE' and k % 2 = 0"""
)
def c7_stacked_roles(s, d):
    return layout.stacked_roles(_blocks(s, d))


@query(
    """select block_id, case when block_type in ('SECTION_HEADING','COMPANY','COMPANY_ROLE','ROLE','DATE_RANGE','LOCATION','CLIENT','PAGE_ARTIFACT') then 0.95 when block_type is null or block_type = 'UNKNOWN' then 0.0 else 0.7 end as confidence from semantic_blocks"""
)
def c8_label_confidence(s, d):
    return _blocks(s, d).select("block_id", layout.label_classes(F.col("block_type"))["confidence"].alias("confidence"))


@query(
    f"""with rows as ({_BOX}), l as (select block_id, greatest(abs(x0 - lag(x0) over o), abs(y0 - lag(y0) over o), abs(x1 - lag(x1) over o), abs(y1 - lag(y1) over o)) as far from rows where text is not null window o as (partition by upload_id, page, text order by y0, x0, block_id)) select block_id from l where far <= 1"""
)
def c9_doubled_layers(s, d):
    return layout.doubled_layers(_blocks(s, d))


@query(
    rf"""with rows as ({_BOX}), r as (select * from rows where text is not null and y0 <= 180), a as (select upload_id, page, x0 as ax from r where regexp_matches(text, '{text.EMAIL}') or regexp_matches(text, '(?i)\b(?:tel|phone|mobile)\b'))
    select distinct block_id from r join a on r.upload_id = a.upload_id and r.page = a.page and x0 >= ax - 300 and x0 <= ax + 80"""
)
def c10_contact_cards(s, d):
    return layout.contact_cards(_blocks(s, d))


@query(
    """with r as (select block_id, text, block_type, lag(block_type) over o as before, lead(block_type) over o as after from semantic_blocks where text is not null window o as (partition by upload_id order by reading_order, block_id))
    select block_id from r where block_type in ('COMPANY', 'LOCATION', 'UNKNOWN') and before = 'COMPANY' and after in ('ROLE', 'DATE_RANGE') and length(text) <= 40"""
)
def c13_location_triples(s, d):
    return layout.location_triples(_blocks(s, d))


@query(
    f"""with rows as (select *, (y0 + y1) / 2 as mid from ({_BOX})), j as (select a.block_id, b.block_id as role_id, abs(a.mid - b.mid) as off from rows a join rows b on a.upload_id = b.upload_id and a.page = b.page and a.block_type = 'DATE_RANGE' and b.block_type in ('ROLE', 'COMPANY_ROLE') and abs(a.mid - b.mid) <= 2.5 and a.x0 >= b.x0 - 20)
    select block_id, role_id from (select *, row_number() over (partition by block_id order by off, role_id) as r from j) where r = 1"""
)
def c14_aligned_dates(s, d):
    return layout.aligned_dates(_blocks(s, d))


# ---- records ----
_ROWS = """rows as (select *, sum(case when coalesce(block_type in ('COMPANY', 'COMPANY_ROLE'), false) then 1 else 0 end) over (partition by upload_id order by reading_order, block_id rows unbounded preceding) as job
  from semantic_blocks where section = 'Experience' and text is not null and block_type <> 'PAGE_ARTIFACT'),
nested as materialized (select *, sum(case when coalesce(block_type in ('ROLE', 'COMPANY_ROLE'), false) then 1 else 0 end) over (partition by upload_id, job order by reading_order, block_id rows unbounded preceding) as role from rows)"""


@query(f"with {_ROWS} select block_id, job, role from nested")
def r3_job_and_role_numbers(s, d):
    return records.numbered_rows(_blocks(s, d)).select("block_id", "job", "role")


_E = lambda c: f"nullif(trim(entities.{c}, ' '), '')"
_FIRST = lambda c: f"min_by({_E(c)}, (reading_order, block_id)) filter ({_E(c)} is not null)"
_WITHOUT = r"trim(regexp_replace(regexp_replace(text, '[\x{e000}-\x{f8ff}]', '', 'g'), '^\s*(?:([•▪●○◦·–—>*\-])\s*|(\d+[.)])\s*)', ''), ' ')"
_ROLES = f"""{_ROWS},
items as (select *, sum(case when block_type = 'RESPONSIBILITY' and (is_bullet or not before_is_duty) then 1 else 0 end) over (partition by upload_id, job, role order by reading_order, block_id rows unbounded preceding) as item
  from (select *, coalesce(lag(block_type) over (partition by upload_id, job, role order by reading_order, block_id) = 'RESPONSIBILITY', false) as before_is_duty from nested where job > 0)),
duties as (select upload_id, job, role, count(distinct item) as duties from items where block_type = 'RESPONSIBILITY' group by all),
roles as materialized (select upload_id, job, role, {_FIRST("designation")} as designation, {_FIRST("start_date")} as start_date, min_by({_E("end_date")}, (reading_order, block_id)) filter ({_E("start_date")} is not null) as end_date, {_FIRST("company")} as company from nested where job > 0 group by upload_id, job, role),
jobs as (select upload_id, job, min_by(company, role) filter (company is not null) as company, bool_or(role > 0 or designation is not null) as has_role from roles group by upload_id, job)"""


@query(
    f"""with {_ROLES} select j.upload_id, j.job, j.company, r.designation, r.start_date, r.end_date, case when r.role is null then 0 else coalesce(d.duties, 0) end as duties from jobs j left join roles r on r.upload_id = j.upload_id and r.job = j.job and (r.role > 0 or r.designation is not null)
    left join duties d on d.upload_id = r.upload_id and d.job = r.job and d.role = r.role where j.company is not null"""
)
def k18_readable_employments(s, d):
    return records.readable(records.canonical(_blocks(s, d)))


_EDU = rf"""edu as (select *, sum(cast(regexp_matches(text, '{context.DEGREE_CUE}') as int)) over (partition by upload_id order by reading_order, block_id rows unbounded preceding) as entry, string_split_regex(text, '\s*[,|]\s*') as cells from semantic_blocks where block_type = 'EDUCATION' and text is not null),
parts as (select *, list_filter(cells, lambda c: regexp_matches(c, '{context.DEGREE_CUE}') and not regexp_matches(c, '{context.INSTITUTION_CUE}'))[1] as degree, list_filter(cells, lambda c: regexp_matches(c, '{context.INSTITUTION_CUE}'))[1] as institution, nullif(regexp_extract(text, '\b((?:19|20)\d{{2}})\b', 1), '') as year from edu where entry > 0)"""


@query(
    f"with {_EDU} select upload_id, entry, min_by(degree, (reading_order, block_id)) filter (degree is not null) as degree, min_by(institution, (reading_order, block_id)) filter (institution is not null) as institution, min_by(year, (reading_order, block_id)) filter (year is not null) as year, count(*) as rows from parts group by upload_id, entry"
)
def r6_education(s, d):
    return records.education(_blocks(s, d)).select("upload_id", "entry", "degree", "institution", "year", F.size("source_blocks").alias("rows"))


@query("with p as (select upload_id, reading_order, block_id, text from semantic_blocks where block_type = 'PROFILE_SUMMARY' and text is not null) select upload_id, string_agg(trim(text, ' '), ' ' order by reading_order, block_id) as profile from p group by upload_id")
def r14_profiles(s, d):
    return records.profile(_blocks(s, d))


@query(
    r"""with l as (select upload_id, reading_order, unnest(x) as v, generate_subscripts(x, 1) as pos from (select upload_id, reading_order, string_split_regex(regexp_replace(text, '^[^:]*:\s*', ''), '\s*,\s*') as x from semantic_blocks where block_type = 'PERSONAL_DETAIL' and regexp_matches(text, '^\s*(?:Languages|Idiomas|Sprachen|Langues)\s*:'))),
    c as (select *, trim(regexp_replace(v, '\s*\([^)]*\)|[.·%\d]+$', '', 'g'), ' ') as language from l) select upload_id, language from c where language <> '' qualify row_number() over (partition by upload_id, lower(language) order by reading_order, pos) = 1"""
)
def r14_languages(s, d):
    return records.languages(_blocks(s, d))


@query()
def r13_technical_skills(s, d):
    return records.technical_skills(_blocks(s, d)).select("upload_id", "category", F.size("items").alias("items"))


@query(
    """select upload_id, count(*) as rows, count(*) filter (coalesce(block_type, 'UNKNOWN') = 'PAGE_ARTIFACT') as artifacts, count(*) filter (coalesce(block_type, 'UNKNOWN') in ('SECTION_HEADING', 'SUBSECTION_HEADING')) as headings,
    count(*) filter (coalesce(block_type, 'UNKNOWN') <> 'UNKNOWN') as resolved, count(*) filter (coalesce(block_type, 'UNKNOWN') = 'UNKNOWN') as unresolved, count(*) filter (coalesce(block_type, 'UNKNOWN') = 'UNKNOWN') = 0 as complete from semantic_blocks where text is not null and trim(text, ' ') <> '' group by upload_id"""
)
def r16_coverage(s, d):
    return records.coverage(_blocks(s, d))


@query()
def k13_canonical_records(s, d):
    """Of each upload's canonical record the sizes of its parts."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return records.canonical(_blocks(s, d)).select("upload_id", "schema_version", F.length("profile_snapshot").alias("profile_chars"), size("work_history").alias("jobs"), size("education").alias("entries"), F.coalesce(F.cardinality("technical_skills"), F.lit(0)).alias("categories"))


@query(
    f"""with {_ROWS} select upload_id, 'row before any employer' as rule, row_id from nested where job = 0 and block_type in ('ROLE', 'RESPONSIBILITY', 'DATE_RANGE', 'CLIENT')
    union all select upload_id, 'employer without name', row_id from nested where block_type in ('COMPANY', 'COMPANY_ROLE') and (entities.company is null or trim(entities.company, ' ') = '')
    union all select upload_id, 'duty without role', row_id from nested where block_type = 'RESPONSIBILITY' and job > 0 and role = 0"""
)
def x1_employment_violations(s, d):
    return records.violations(_blocks(s, d))


# ---- graph ----
_ENDS = "ends as (select upload_id, source as id, source_label as label from relationships union all select upload_id, target, target_label from relationships)"


@query(
    f"""with {_ENDS}, l as (select upload_id, id, label, count(*) as n from ends where id is not null group by all)
    select upload_id, id, (first(label order by label is not null desc, n desc, label desc)) as label, sum(n) as edges from l group by upload_id, id"""
)
def g1_nodes(s, d):
    return graph.nodes(_edges(s, d))


@query("select relationship, count(*) as edges, count(distinct upload_id) as uploads, count(distinct target_label) as targets, round(avg(confidence), 6) as confidence from relationships group by relationship")
def g12_statistics(s, d):
    return graph.statistics(_edges(s, d))


@query("select upload_id, source, target, relationship, count(*) as copies, min(edge_id) as first_edge from relationships group by all having count(*) > 1")
def g2_duplicate_edges(s, d):
    return graph.duplicate_edges(_edges(s, d))


@query("select edge_id, upload_id, relationship from relationships qualify row_number() over (partition by upload_id, source, target, relationship order by edge_id) = 1")
def g2_distinct_edges(s, d):
    return graph.distinct_edges(_edges(s, d)).select("edge_id", "upload_id", "relationship")


@query()
def g5_edges_of_records(s, d):
    """Edges that the canonical records give, counted by triple of types."""
    return graph.edges_of_records(records.canonical(_blocks(s, d)), table(s, d, "raw_text")).groupBy("source_type", "relationship", "target_type").agg(F.count("*").alias("edges"), F.count_distinct("upload_id").alias("uploads"))


_SCOPES = {"WORKED_AT": r"^\$\.work_history\[\d+\]$", "HAS_ROLE": r"^\$\.work_history\[\d+\]$", "HAS_EMPLOYMENT_PERIOD": r"^\$\.work_history\[\d+\]\.roles\[\d+\]$", "COMPLETED_DEGREE": r"^\$\.education\[\d+\]$", "AWARDED_BY": r"^\$\.education\[\d+\]$", "HAS_SKILL": r"^\$\.skills$"}
_WRONG = " or ".join(f"relationship = '{r}' and not regexp_matches(scope_path, '{x}')" for r, x in sorted(_SCOPES.items()))


@query(
    f"""with v as (select upload_id, edge_id, unnest(list_filter([case when scope_path is null or evidence_path is null then 'no source context' end, case when {_WRONG} then 'scope of another kind' end,
      case when not (evidence_path = scope_path or starts_with(evidence_path, scope_path || '.') or starts_with(evidence_path, scope_path || '[')) then 'evidence outside of the scope' end], lambda x: x is not null)) as rule from relationships) select * from v"""
)
def x3_scope_violations(s, d):
    return graph.scope_violations(_edges(s, d))


@query(
    """with r as (select upload_id, target as id, source = 'person' as of_person from relationships where relationship = 'HAS_ROLE' union all select upload_id, source, null from relationships where relationship = 'HAS_EMPLOYMENT_PERIOD'),
    g as (select upload_id, id, count(*) filter (of_person) as person, count(*) filter (not of_person) as employer from r where id is not null group by all),
    f as (select distinct upload_id, source as id from relationships where relationship = 'HAS_ROLE' and source <> 'person')
    select upload_id, id, 'role of no person' as rule from g where person = 0 union all select upload_id, id, 'role of no employer' from g where employer = 0
    union all select upload_id, id, 'employer of no person' from f where not exists (select 1 from relationships w where w.relationship = 'WORKED_AT' and w.upload_id = f.upload_id and w.target = f.id)"""
)
def x3_unconnected(s, d):
    return graph.unconnected(_edges(s, d))


@query()
def x3_typed_violations(s, d):
    """Edges of canonical records that are no allowed triple of types: none of ours."""
    return graph.typed_violations(graph.edges_of_records(records.canonical(_blocks(s, d)), table(s, d, "raw_text")))


@query()
def g13_evidence_of_edges(s, d):
    """The text of the canonical record that each edge's evidence path leads to."""
    leaves = cut(graph.evidence_text(records.canonical(_blocks(s, d))))
    return graph.at_path(leaves, _edges(s, d).where("evidence_path is not null").select("upload_id", F.col("evidence_path").alias("path")).distinct())


_ALLOWED = ", ".join(f"'{r}'" for r in sorted({r for _, r, _ in graph.TRIPLES}))
_WORDS = lambda c: f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"
_BLANK = lambda c: f"coalesce(trim({c}, ' ') = '', true)"


@query(
    f"""with r as (select *, row_number() over (partition by upload_id, source, target, relationship order by edge_id) as nth from relationships),
    v as (select upload_id, edge_id, unnest(list_filter([case when {_BLANK('source')} or {_BLANK('target')} then 'missing endpoint' end, case when {_BLANK('source_label')} or {_BLANK('target_label')} then 'missing label' end,
      case when not coalesce(relationship in ({_ALLOWED}), false) then 'unknown relationship' end, case when nth > 1 then 'duplicate edge' end, case when {_BLANK('source_sentence')} then 'missing evidence' end,
      case when not {_BLANK('source_sentence')} and not {_BLANK('target_label')} and len(list_filter({_WORDS('target_label')}, lambda w: not list_contains({_WORDS('source_sentence')}, w))) > 0 then 'target not in evidence' end,
      case when source = target then 'loop' end], lambda x: x is not null)) as rule from r) select * from v"""
)
def x3_edge_violations(s, d):
    return graph.edge_violations(_edges(s, d))


@query(
    f"with {_ENDS}, n as (select distinct upload_id, id from ends where id is not null), e as (select upload_id, source as id from relationships where not {_BLANK('source_label')} and not {_BLANK('target_label')} union select upload_id, target from relationships where not {_BLANK('source_label')} and not {_BLANK('target_label')}) select n.* from n where id <> 'person' and not exists (select 1 from e where e.upload_id = n.upload_id and e.id = n.id)"
)
def g11_isolated_nodes(s, d):
    """Nodes of which every edge lacks a label, so that none of them can be emitted."""
    edges = _edges(s, d)
    labelled = edges.where("trim(coalesce(source_label, '')) <> '' and trim(coalesce(target_label, '')) <> ''")
    return graph.isolated(graph.nodes(edges).where("id <> 'person'").select("upload_id", "id"), labelled)


@query(
    f"""with recursive {_ENDS}, n as (select distinct upload_id, id from ends where id <> 'person'), links as (select distinct upload_id, source as a, target as b from relationships where source <> 'person' and target <> 'person'), both_ways as (select * from links union select upload_id, b, a from links),
    reach as (select upload_id, id as a, id as b from n union select r.upload_id, r.a, l.b from reach r join both_ways l on l.upload_id = r.upload_id and l.a = r.b), c as (select upload_id, a as id, min(b) as component from reach group by all)
    select upload_id, id, dense_rank() over (partition by upload_id order by component) - 1 as "group" from c"""
)
def g15_relation_groups(s, d):
    return graph.groups(_edges(s, d))


@query(
    f"""with {_ENDS}, n as (select distinct upload_id, id from ends where id is not null), r as (select *, row_number() over (partition by upload_id order by id) - 1 as i, count(*) over (partition by upload_id) as n from n where id <> 'person')
    select upload_id, id, round(400 + 260 * cos(2 * pi() * i / n), 3) as x, round(250 + 260 * sin(2 * pi() * i / n), 3) as y from r union all select upload_id, id, 400, 250 from n where id = 'person'"""
)
def g16_radial_layout(s, d):
    return graph.radial_layout(graph.nodes(_edges(s, d)).select("upload_id", "id"))


# ---- vectors ----
def _labels(s: SparkSession, d: str) -> DataFrame:
    return _edges(s, d).where("target_label is not null").groupBy("upload_id", "target_label").agg(F.min("edge_id").alias("i"))


_TFIDF = r"""labels as (select upload_id, target_label, min(edge_id) as i from relationships where target_label is not null group by all),
terms as (select upload_id, i, unnest(regexp_extract_all(lower(target_label), '[\p{L}\p{N}_]{2,}')) as term from labels), tf as (select upload_id, i, term, count(*) as tf from terms group by all), n as (select upload_id, count(distinct i) as n from labels group by all),
df as (select upload_id, term, count(*) as df from tf group by all), w as (select tf.upload_id, i, term, tf * (1 + ln((1.0 + n) / (1.0 + df))) as w from tf join df using (upload_id, term) join n using (upload_id)),
weights as materialized (select upload_id, i, term, w / sqrt(sum(w * w) over (partition by upload_id, i)) as weight from w),
pairs as materialized (select a.upload_id, a.i, b.i as j, sum(a.weight * b.weight) as similarity from weights a join weights b on a.upload_id = b.upload_id and a.term = b.term and a.i < b.i group by all)"""


@query(f"with {_TFIDF} select upload_id, i, term, round(weight, 8) as weight from weights")
def v2_tf_idf(s, d):
    return vectors.tf_idf(_labels(s, d), "upload_id", "i", "target_label").withColumn("weight", F.round("weight", 8))


@query(f"with {_TFIDF} select upload_id, count(*) as pairs, max(round(similarity, 4)) as most from pairs group by upload_id")
def v3_pair_counts(s, d):
    pairs = vectors.sparse_cosine(vectors.tf_idf(_labels(s, d), "upload_id", "i", "target_label"), "upload_id", "i")
    return pairs.groupBy("upload_id").agg(F.count("*").alias("pairs"), F.max(F.round("similarity", 4)).alias("most"))


@query(f"with {_TFIDF} select upload_id, i, j, round(round(similarity, 9), 4) as similarity from pairs qualify row_number() over (partition by upload_id order by round(round(similarity, 9), 4) desc, i, j) <= 25")
def v4_top_pairs(s, d):
    pairs = vectors.sparse_cosine(vectors.tf_idf(_labels(s, d), "upload_id", "i", "target_label"), "upload_id", "i").withColumn("similarity", F.round("similarity", 9))
    return vectors.top_pairs(pairs, "upload_id").drop("rank")


_PARTS = """links as (select i, j from pairs where similarity >= 0.5 union select j, i from pairs where similarity >= 0.5),
reach as (select i as a, i as b from links union select reach.a, links.j from reach join links on links.i = reach.b), parts as (select a as node, min(b) as component from reach group by a)"""


def _labels_and_pairs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    labels = _labels(s, d)
    return labels.select("upload_id", F.col("i").alias("node"), F.col("target_label").alias("text")), cut(vectors.sparse_cosine(vectors.tf_idf(labels, "upload_id", "i", "target_label"), "upload_id", "i"))


@query(
    f"with recursive {_TFIDF}, {_PARTS} select labels.upload_id, labels.i as node, case when component is null then -1 else dense_rank() over (partition by labels.upload_id order by component is null, component) - 1 end as label from labels left join parts on parts.node = labels.i"
)
def v6_density_clusters(s, d):
    nodes, pairs = _labels_and_pairs(s, d)
    return vectors.density_clusters(pairs, nodes.select("upload_id", "node"), "upload_id")


@query("select upload_id, count(*) as items, cast(count(*) * (count(*) - 1) / 2 as bigint) as pairs from (select upload_id, target_label from relationships where target_label is not null group by all) group by upload_id")
def v5_pair_counts(s, d):
    return vectors.pair_counts(_labels(s, d), "upload_id")


@query(
    f"with recursive {_TFIDF}, {_PARTS}, c as (select labels.upload_id, labels.i, target_label, dense_rank() over (partition by labels.upload_id order by component) - 1 as label from labels join parts on parts.node = labels.i) select upload_id, label, list(target_label order by i) as members from c group by upload_id, label"
)
def v9_cluster_members(s, d):
    nodes, pairs = _labels_and_pairs(s, d)
    return vectors.members(vectors.density_clusters(pairs, nodes.select("upload_id", "node"), "upload_id"), nodes, "upload_id")


@query(
    f"with {_TFIDF}, t as (select upload_id, i, j, round(round(similarity, 9), 4) as similarity from pairs qualify row_number() over (partition by upload_id order by round(round(similarity, 9), 4) desc, i, j) <= 25) select t.*, a.target_label as text_i, b.target_label as text_j from t join labels a on a.i = t.i join labels b on b.i = t.j"
)
def v11_labelled_pairs(s, d):
    nodes, pairs = _labels_and_pairs(s, d)
    return vectors.labelled_pairs(vectors.top_pairs(pairs.withColumn("similarity", F.round("similarity", 9)), "upload_id").drop("rank"), nodes, "upload_id")


@query(
    """with q as (select vec_id as query, embedding as e from embeddings where vec_id % 20 = 0), s as (select query, vec_id as neighbour, round(list_sum(list_transform(list_zip(embedding, e), lambda p: cast(p[1] as double) * cast(p[2] as double))), 6) as similarity from embeddings, q where vec_id <> query)
    select query, neighbour, greatest(-1.0, least(1.0, similarity)) as similarity, row_number() over (partition by query order by similarity desc, neighbour) as rank from s qualify rank <= 10"""
)
def v3_nearest_vectors(s, d):
    return vectors.nearest(table(s, d, "embeddings"), 10)


@query()
def v7_k_means(s, d):
    return vectors.k_means(table(s, d, "embeddings"), 4).groupBy("cluster").agg(F.count("*").alias("vectors"))


@query(
    """with v as (select vec_id, label, cast(embedding as double[]) as embedding from embeddings), m as (select a.vec_id, a.label, b.label as other, avg(list_distance(a.embedding, b.embedding)) as d from v a join v b on a.vec_id <> b.vec_id group by all),
    o as (select vec_id, d as a from m where label = other), r as (select vec_id, min(d) as b from m where label <> other group by vec_id) select round(avg(case when a is null then 0 else (b - a) / greatest(a, b) end), 4) as silhouette from r left join o using (vec_id)"""
)
def v8_silhouette(s, d):
    """Of all vectors, by their labels."""
    return vectors.silhouette(table(s, d, "embeddings"))


@query(_S["v8_silhouette"])
def v8_silhouette_all(s, d):
    """The same by its earlier name."""
    return v8_silhouette(s, d)


@query("select vec_id, embedding[1:8] as preview from embeddings")
def v10_previews(s, d):
    return table(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("preview"))


# ---- evaluation: periods of records against the periods of the next upload of a document ----
def _leaves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Predicted: what blocks say of employments; reference: what the canonical table says, of each upload."""
    e = lambda c: F.col(f"entities.{c}")
    predicted = evaluation.leaves(_blocks(s, d).where("entities.company is not null"), "upload_id", "experience", e("company"), company=e("company"), location=e("location"))
    truth = evaluation.leaves(table(s, d, "canonical_resume").where("company is not null"), "upload_id", "experience", F.col("company"), company=F.col("company"), location=F.col("location"))
    return predicted, truth


_KEY = lambda c: f"array_to_string(regexp_extract_all(lower(replace({c}, '&', ' and ')), '[\\p{{L}}\\p{{N}}_+#.]+'), ' ')"
_LEAVES = f"""p as (select upload_id as doc, v.path as path, v.value as value, {_KEY('v.value')} as norm, {_KEY('company')} as anchor from (select upload_id, entities.company as company, unnest([{{'path': 'company', 'value': entities.company}}, {{'path': 'location', 'value': entities.location}}]) as v from semantic_blocks where entities.company is not null)),
t as (select upload_id as doc, v.path as path, v.value as value, {_KEY('v.value')} as norm, {_KEY('company')} as anchor from (select upload_id, company, unnest([{{'path': 'company', 'value': company}}, {{'path': 'location', 'value': location}}]) as v from canonical_resume where company is not null)),
pc as (select doc, norm, anchor, count(*) as p from p where norm <> '' group by all), tc as (select doc, norm, anchor, count(*) as t from t where norm <> '' group by all),
both_sides as materialized (select coalesce(pc.doc, tc.doc) as doc, coalesce(p, 0) as p, coalesce(t, 0) as t from pc full join tc on pc.doc = tc.doc and pc.norm = tc.norm and pc.anchor = tc.anchor)"""
_COUNTED = "sum(least(p, t)) as true_positive, sum(greatest(p - t, 0)) as false_positive, sum(greatest(t - p, 0)) as false_negative"


@query(f"with {_LEAVES} select doc, {_COUNTED} from both_sides group by doc")
def q4_counts(s, d):
    return evaluation.counts(*_leaves(s, d), "doc")


@query(
    f"""with {_LEAVES}, c as (select doc, sum(p) as predicted_items, sum(t) as reference_items, sum(least(p, t)) as true_positive, case when sum(t) = 0 then 0 else sum(greatest(p - t, 0)) end as false_positive, sum(greatest(t - p, 0)) as false_negative from both_sides group by doc)
    select *, round(true_positive / nullif(true_positive + false_positive, 0), 4) as precision, round(true_positive / nullif(true_positive + false_negative, 0), 4) as recall, round(2 * true_positive / nullif(2 * true_positive + false_positive + false_negative, 0), 4) as f1, case when reference_items = 0 then 'no_reference_items' else 'scored' end as state from c"""
)
def q5_scores_of_uploads(s, d):
    """Of every upload, the intake folder's too; those without reference have their state and no scores."""
    return evaluation.by_document(*_leaves(s, d))


@query(
    f"""with {_LEAVES}, r as (select * from both_sides where doc in (select doc from tc)), c as (select 'experience' as section, {_COUNTED} from r union all select 'Overall', {_COUNTED} from r)
    select *, round(true_positive / nullif(true_positive + false_positive, 0), 4) as precision, round(true_positive / nullif(true_positive + false_negative, 0), 4) as recall, round(2 * true_positive / nullif(2 * true_positive + false_positive + false_negative, 0), 4) as f1, case when true_positive + false_negative = 0 then 'no_reference_items' else 'scored' end as state from c"""
)
def q5_scores(s, d):
    return evaluation.with_overall(*_leaves(s, d))


@query(
    f"""with {_LEAVES}, n as (select *, row_number() over (partition by doc, norm, anchor order by path, value) as nth from t where norm <> '') select n.doc, 'experience' as section, path, value, n.anchor from n left join pc on pc.doc = n.doc and pc.norm = n.norm and pc.anchor = n.anchor where nth > coalesce(p, 0)"""
)
def q9_missing(s, d):
    return evaluation.missing(*_leaves(s, d))


@query(
    f"""with {_LEAVES}, a as (select doc, norm from p where norm <> '' except all select doc, norm from t where norm <> ''), b as (select doc, norm from t where norm <> '' except all select doc, norm from p where norm <> '') select 'only_predicted' as side, doc, norm from a union all select 'only_reference', doc, norm from b"""
)
def q10_value_differences(s, d):
    return evaluation.value_differences(*_leaves(s, d))


@query()
def q8_error_kinds(s, d):
    return evaluation.match_errors(*_leaves(s, d)).groupBy("kind").agg(F.count("*").alias("values"))


@query()
def q11_structure(s, d):
    return evaluation.structure_differences(*_leaves(s, d))


@query(
    r"""with w as (select period_id, unnest(regexp_extract_all(lower(source_text), '[\p{L}\p{N}_+#.]+')) as term from canonical_resume), tf as (select period_id, term, count(*) as tf from w group by all), df as (select term, count(*) as df from tf group by all), n as (select count(distinct period_id) as n from canonical_resume)
    select period_id, term, round((1 + ln(tf)) * (1 + ln((n + 1.0) / (df + 1.0))), 9) as weight from tf join df using (term), n"""
)
def q6_evaluator_weights(s, d):
    return vectors.log_tf_idf(table(s, d, "canonical_resume"), "period_id", "source_text").withColumn("weight", F.round("weight", 9))


@query(
    rf"""with p as (select upload_id as doc, v.k as kind, {_KEY('v.v')} as norm, count(*) as p from (select upload_id, unnest([{{'k': 'company', 'v': entities.company}}, {{'k': 'designation', 'v': entities.designation}}]) as v from semantic_blocks) where v.v is not null group by all),
    t as (select upload_id as doc, v.k as kind, {_KEY('v.v')} as norm, count(*) as t from (select upload_id, unnest([{{'k': 'company', 'v': company}}, {{'k': 'designation', 'v': designation}}]) as v from canonical_resume) where v.v is not null group by all),
    b as (select coalesce(p.doc, t.doc) as doc, coalesce(p.kind, t.kind) as kind, coalesce(p, 0) as p, coalesce(t, 0) as t from p full join t on p.doc = t.doc and p.kind = t.kind and p.norm = t.norm),
    c as (select doc, kind, sum(t) as reference_items, sum(least(p, t)) as true_positive, case when sum(t) = 0 then 0 else sum(greatest(p - t, 0)) end as false_positive, sum(greatest(t - p, 0)) as false_negative from b group by all)
    select *, round(true_positive / nullif(true_positive + false_positive, 0), 4) as precision, round(true_positive / nullif(true_positive + false_negative, 0), 4) as recall, round(2 * true_positive / nullif(2 * true_positive + false_positive + false_negative, 0), 4) as f1,
    case when true_positive + false_negative = 0 then 'no_reference_items' else 'scored' end as state from c"""
)
def q12_entity_scores(s, d):
    """Employers and titles of blocks against those of the canonical table, list by list."""
    lists = lambda f, e: f.select(F.col("upload_id").alias("doc"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), e(k).alias("value")) for k in ("company", "designation")])).alias("v")).select("doc", "v.kind", "v.value")
    return evaluation.entity_scores(lists(_blocks(s, d), lambda k: F.col(f"entities.{k}")), lists(table(s, d, "canonical_resume"), F.col))


@query("select case when raw_text is null or trim(raw_text, ' ') = '' then 'failed' else 'read' end as status, source as method, count(*) as documents from raw_text group by rollup (case when raw_text is null or trim(raw_text, ' ') = '' then 'failed' else 'read' end, source)")
def q15_corpus_rollup(s, d):
    status = F.when(F.col("raw_text").isNull() | (F.trim("raw_text") == ""), "failed").otherwise("read")
    return evaluation.corpus_rollup(table(s, d, "raw_text").select(status.alias("status"), F.col("source").alias("method")))


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)
