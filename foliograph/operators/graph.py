"""The graph of records: nodes, edges, validation, groups and layout.

``relationships`` is the edge table: doc_id, upload_id, source, target (ids
within the upload), their labels and the relationship. Everything joins on
(upload_id, id), so a hot document spreads over its uploads.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import connected

KEY = "upload_id"
# --- Fixed values: the allowed triples of types. ---
TRIPLES: list[tuple[str, str, str]] = [
    ("PERSON", "HAS_ROLE", "JOB_ROLE"), ("PERSON", "WORKED_AT", "COMPANY"), ("COMPANY", "HAS_ROLE", "JOB_ROLE"), ("JOB_ROLE", "HAS_EMPLOYMENT_PERIOD", "EMPLOYMENT_PERIOD"), ("JOB_ROLE", "WORKED_FOR_CLIENT", "CLIENT"),
    ("JOB_ROLE", "HAS_RESPONSIBILITY", "RESPONSIBILITY"), ("JOB_ROLE", "USED_TECHNOLOGY", "TECHNOLOGY"), ("JOB_ROLE", "USED_TECHNOLOGY", "SKILL"), ("PERSON", "COMPLETED_DEGREE", "DEGREE"), ("DEGREE", "AWARDED_BY", "INSTITUTION"),
    ("DEGREE", "COMPLETED_IN", "DATE"), ("DEGREE", "HAS_RESULT", "RESULT"), ("PERSON", "COMPLETED_PROJECT", "PROJECT"), ("PROJECT", "USED_TECHNOLOGY", "TECHNOLOGY"), ("PROJECT", "USED_TECHNOLOGY", "SKILL"), ("PERSON", "HAS_SKILL", "SKILL"),
    ("PERSON", "HAS_TECHNOLOGY_SKILL", "TECHNOLOGY"), ("PERSON", "HAS_CERTIFICATION", "CERTIFICATION"), ("PERSON", "HAS_DOMAIN_EXPERIENCE", "DOMAIN"), ("PERSON", "HAS_AWARD", "AWARD"), ("PERSON", "AUTHORED_PUBLICATION", "PUBLICATION"),
    ("PERSON", "HAS_ACHIEVEMENT", "ACHIEVEMENT"), ("PERSON", "SPEAKS", "LANGUAGE"), ("PERSON", "LOCATED_IN", "LOCATION"), ("PERSON", "HAS_DATE_OF_BIRTH", "DATE"), ("PERSON", "HAS_NATIONALITY", "NATIONALITY"),
    ("PERSON", "HAS_PROFESSIONAL_TITLE", "JOB_TITLE"), ("PERSON", "HAS_SUMMARY", "SUMMARY"),
]


def edges_of_records(record: DataFrame, names: DataFrame) -> DataFrame:
    """upload_id, source_type, source_label, relationship, target_type, target_label, path of every edge that canonical records give.

    ``record`` is what ``records.canonical`` gives, ``names`` has upload_id and candidate_name. Edges without an endpoint's label are left out.
    A record's edges are one array, so records are read once.
    """
    person = record.join(names.groupBy(KEY).agg(F.max("candidate_name").alias("candidate_name")), KEY, "left").withColumn("person", F.coalesce(F.nullif(F.trim("candidate_name"), F.lit("")), F.lit("Resume subject")))
    at = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    p = F.col("person")

    def edge(a: str, source: Column, relationship: str, b: str, target: Column, path: Column) -> Column:
        return F.struct(F.lit(a).alias("source_type"), source.alias("source_label"), F.lit(relationship).alias("relationship"), F.lit(b).alias("target_type"), target.cast("string").alias("target_label"), path.alias("path"))

    def of_role(job: Column, j: Column, role: Column, r: Column) -> Column:
        title, here = role["designation"], at("$.work_history[", j, "].roles[", r, "]")
        period = F.nullif(F.concat_ws(" - ", role["start_date"], role["end_date"]), F.lit(""))
        own = F.array(edge("PERSON", p, "HAS_ROLE", "JOB_ROLE", title, here), edge("COMPANY", job["company"], "HAS_ROLE", "JOB_ROLE", title, here), edge("JOB_ROLE", title, "HAS_EMPLOYMENT_PERIOD", "EMPLOYMENT_PERIOD", period, here))
        clients = F.transform(role["clients"], lambda x, i: edge("JOB_ROLE", title, "WORKED_FOR_CLIENT", "CLIENT", x, F.concat(here, F.lit(".clients["), i.cast("string"), F.lit("]"))))
        duties = F.transform(role["duties"], lambda x, i: edge("JOB_ROLE", title, "HAS_RESPONSIBILITY", "RESPONSIBILITY", x, F.concat(here, F.lit(".duties["), i.cast("string"), F.lit("]"))))
        return F.concat(own, clients, duties)

    def of_school(e: Column, i: Column) -> Column:
        here = at("$.education[", i, "]")
        return F.array(edge("PERSON", p, "COMPLETED_DEGREE", "DEGREE", e["degree"], here), edge("DEGREE", e["degree"], "AWARDED_BY", "INSTITUTION", e["institution"], here), edge("DEGREE", e["degree"], "COMPLETED_IN", "DATE", e["year"], here))

    field = lambda name, relationship, kind: edge("PERSON", p, relationship, kind, F.col(name), F.lit(f"$.{name}"))
    listed = lambda key, relationship, kind: F.transform(key, lambda x, i: edge("PERSON", p, relationship, kind, x["name"], at(f"$.{key}[", i, "]")))
    parts = [
        F.array(
            field("profile_snapshot", "HAS_SUMMARY", "SUMMARY"), field("personal_information.title", "HAS_PROFESSIONAL_TITLE", "JOB_TITLE"), field("personal_information.location", "LOCATED_IN", "LOCATION"),
            field("personal_details.date_of_birth", "HAS_DATE_OF_BIRTH", "DATE"), field("personal_details.nationality", "HAS_NATIONALITY", "NATIONALITY"),
        ),
        F.transform("personal_details.languages", lambda x, i: edge("PERSON", p, "SPEAKS", "LANGUAGE", x, at("$.personal_details.languages[", i, "]"))),
        F.transform("work_history", lambda job, j: edge("PERSON", p, "WORKED_AT", "COMPANY", job["company"], at("$.work_history[", j, "]"))),
        F.flatten(F.transform("work_history", lambda job, j: F.flatten(F.transform(job["roles"], lambda role, r: of_role(job, j, role, r))))),
        F.flatten(F.transform("education", of_school)),
        listed("skills", "HAS_SKILL", "SKILL"),
        F.flatten(F.transform(F.map_entries("technical_skills"), lambda c: F.transform(c["value"], lambda x, i: edge("PERSON", p, "HAS_TECHNOLOGY_SKILL", "TECHNOLOGY", x, at("$.technical_skills.", c["key"], "[", i, "]"))))),
        listed("projects", "COMPLETED_PROJECT", "PROJECT"), listed("certifications", "HAS_CERTIFICATION", "CERTIFICATION"), listed("awards", "HAS_AWARD", "AWARD"), listed("achievements", "HAS_ACHIEVEMENT", "ACHIEVEMENT"),
        listed("publications", "AUTHORED_PUBLICATION", "PUBLICATION"), listed("domain_experience", "HAS_DOMAIN_EXPERIENCE", "DOMAIN"),
        F.flatten(F.transform("projects", lambda x, i: F.transform(x["technologies"], lambda t, k: edge("PROJECT", x["name"], "USED_TECHNOLOGY", "TECHNOLOGY", t, at("$.projects[", i, "].technologies[", k, "]"))))),
    ]
    none = F.array().cast("array<struct<source_type:string,source_label:string,relationship:string,target_type:string,target_label:string,path:string>>")
    every = person.select(KEY, F.explode(F.concat(*[F.coalesce(x, none) for x in parts])).alias("e")).select(KEY, "e.*")
    return every.where("trim(source_label) <> '' and trim(target_label) <> ''")


def evidence_text(record: DataFrame) -> DataFrame:
    """upload_id, path, value: the leaves of the parts that edges come from, by the path of their record; what a path's evidence is made of."""
    jobs = record.select(KEY, F.posexplode("work_history").alias("j", "job"))
    roles = jobs.select(KEY, "j", F.posexplode("job.roles").alias("r", "role"))
    path = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    out = [
        record.select(KEY, F.lit("$.profile_snapshot").alias("path"), F.col("profile_snapshot").alias("value")),
        jobs.select(KEY, path("$.work_history[", F.col("j"), "]").alias("path"), F.concat_ws(" ", "job.company", "job.location", F.transform("job.roles", lambda r: r["designation"])).alias("value")),
        roles.select(KEY, path("$.work_history[", F.col("j"), "].roles[", F.col("r"), "]").alias("path"), F.concat_ws(" ", "role.designation", "role.start_date", "role.end_date", "role.location", "role.duties", "role.clients", "role.achievements").alias("value")),
        record.select(KEY, F.posexplode("education").alias("i", "e")).select(KEY, path("$.education[", F.col("i"), "]").alias("path"), F.concat_ws(" ", "e.degree", "e.institution", "e.year").alias("value")),
    ]
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every.where("trim(value) <> ''")


def at_path(leaves: DataFrame, wanted: DataFrame) -> DataFrame:
    """upload_id, path, value of the wanted (upload_id, path); of a path that is no leaf, of the nearest record above it."""
    parts = F.split("path", r"(?=[.\[])")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ""))
    above = wanted.select(KEY, "path", F.explode(prefixes).alias("above"))
    met = above.join(leaves.select(KEY, F.col("path").alias("above"), "value"), [KEY, "above"])
    return met.groupBy(KEY, "path").agg(F.max_by("value", F.length("above")).alias("value"))


def nodes(edges: DataFrame) -> DataFrame:
    """upload_id, id, label, edges: the endpoints of edges with the label most edges give them."""
    ends = edges.select(KEY, F.col("source").alias("id"), F.col("source_label").alias("label")).unionByName(edges.select(KEY, F.col("target").alias("id"), F.col("target_label").alias("label")))
    labels = ends.where("id is not null").groupBy(KEY, "id", "label").agg(F.count("*").alias("n"))
    return labels.groupBy(KEY, "id").agg(F.max_by("label", F.struct(F.col("label").isNotNull(), "n", "label")).alias("label"), F.sum("n").alias("edges"))


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """upload_id, source, target, relationship, copies, first_edge of edges written more than once."""
    return edges.groupBy(KEY, "source", "target", "relationship").agg(F.count("*").alias("copies"), F.min("edge_id").alias("first_edge")).where("copies > 1")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """The first of equal edges; nulls count as equal."""
    first = Window.partitionBy(KEY, "source", "target", "relationship").orderBy("edge_id")
    return edges.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def edge_violations(edges: DataFrame) -> DataFrame:
    """upload_id, edge_id, rule of every edge that breaks a rule of the graph; an edge may break several."""
    allowed = sorted({r for _, r, _ in TRIPLES})
    # evidence must hold the words of the target
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0)
    later = Window.partitionBy(KEY, "source", "target", "relationship").orderBy("edge_id")
    rows = edges.withColumn("nth", F.row_number().over(later))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    rules = F.array(
        F.when(blank(F.col("source")) | blank(F.col("target")), "missing endpoint"),
        F.when(blank(F.col("source_label")) | blank(F.col("target_label")), "missing label"),
        F.when(~F.coalesce(F.col("relationship").isin(allowed), F.lit(False)), "unknown relationship"),
        F.when(F.col("nth") > 1, "duplicate edge"),
        F.when(blank(F.col("source_sentence")), "missing evidence"),
        F.when(~blank(F.col("source_sentence")) & ~blank(F.col("target_label")) & (F.size(F.array_except(words("target_label"), words("source_sentence"))) > 0), "target not in evidence"),
        F.when((F.col("source") == F.col("target")), "loop"),
    )
    return rows.select(KEY, "edge_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def scope_violations(edges: DataFrame) -> DataFrame:
    """upload_id, edge_id, rule: edges whose evidence lies outside of their scope, or whose scope is not that of their kind."""
    base = {"WORKED_AT": r"^\$\.work_history\[\d+\]$", "HAS_ROLE": r"^\$\.work_history\[\d+\]$", "HAS_EMPLOYMENT_PERIOD": r"^\$\.work_history\[\d+\]\.roles\[\d+\]$", "COMPLETED_DEGREE": r"^\$\.education\[\d+\]$", "AWARDED_BY": r"^\$\.education\[\d+\]$", "HAS_SKILL": r"^\$\.skills$"}
    scope, evidence = F.col("scope_path"), F.col("evidence_path")
    wrong = F.lit(False)
    for relationship, pattern in sorted(base.items()):
        wrong = wrong | ((F.col("relationship") == relationship) & ~scope.rlike(pattern))
    inside = (evidence == scope) | F.startswith(evidence, F.concat(scope, F.lit("."))) | F.startswith(evidence, F.concat(scope, F.lit("[")))
    rules = F.array(F.when(scope.isNull() | evidence.isNull(), "no source context"), F.when(wrong, "scope of another kind"), F.when(~inside, "evidence outside of the scope"))
    return edges.select(KEY, "edge_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def typed_violations(edges: DataFrame) -> DataFrame:
    """rows of typed edges (source_type, relationship, target_type) that are no allowed triple."""
    allowed = F.array(*[F.lit("|".join(t)) for t in TRIPLES])
    return edges.where(~F.array_contains(allowed, F.concat_ws("|", "source_type", "relationship", "target_type")))


def unconnected(edges: DataFrame) -> DataFrame:
    """upload_id, id, rule: roles that no person or employer has, and employers of no person, by ids of the edges."""
    roles = edges.where("relationship = 'HAS_ROLE'").select(KEY, F.col("target").alias("id"), (F.col("source") == "person").alias("of_person"))
    held = edges.where("relationship = 'HAS_EMPLOYMENT_PERIOD'").select(KEY, F.col("source").alias("id"), F.lit(None).cast("boolean").alias("of_person"))
    by_role = roles.unionByName(held).where("id is not null").groupBy(KEY, "id").agg(F.count_if(F.col("of_person")).alias("person"), F.count_if(~F.col("of_person")).alias("employer"))
    lone = by_role.select(KEY, "id", F.explode(F.filter(F.array(F.when(F.col("person") == 0, "role of no person"), F.when(F.col("employer") == 0, "role of no employer")), lambda r: r.isNotNull())).alias("rule"))
    firms = edges.where("relationship = 'HAS_ROLE' and source <> 'person'").select(KEY, F.col("source").alias("id")).distinct()
    known = edges.where("relationship = 'WORKED_AT'").select(KEY, F.col("target").alias("id"))
    return lone.unionByName(firms.join(known, [KEY, "id"], "left_anti").select(KEY, "id", F.lit("employer of no person").alias("rule")))


def isolated(nodes_of: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (upload_id, id) of no edge."""
    ends = edges.select(KEY, F.col("source").alias("id")).unionByName(edges.select(KEY, F.col("target").alias("id"))).distinct()
    return nodes_of.join(ends, [KEY, "id"], "left_anti")


def groups(edges: DataFrame) -> DataFrame:
    """upload_id, id, group: connected parts of each upload's graph without its person; numbered from 0 by smallest id."""
    name = lambda c: F.concat_ws("#", F.col(KEY).cast("string"), F.col(c))
    inner = edges.where("source <> 'person' and target <> 'person' and source is not null and target is not null")
    pairs = inner.select(name("source").alias("a"), name("target").alias("b")).distinct()
    ends = edges.where("target <> 'person'").select(KEY, F.col("target").alias("id")).unionByName(edges.where("source <> 'person'").select(KEY, F.col("source").alias("id"))).where("id is not null").distinct()
    ends = ends.withColumn("node", F.concat_ws("#", F.col(KEY).cast("string"), "id"))
    parts = connected(pairs, ends.select("node"))
    rank = Window.partitionBy(KEY).orderBy("component")
    return ends.join(parts, "node").withColumn("group", F.dense_rank().over(rank) - 1).select(KEY, "id", "group")


def radial_layout(nodes_of: DataFrame, centre: tuple[float, float] = (400.0, 250.0), radius: tuple[float, float] = (260.0, 260.0)) -> DataFrame:
    """upload_id, id, x, y: nodes of an upload evenly on a circle in the order of their ids; the person in the middle."""
    order = Window.partitionBy(KEY).orderBy("id")
    whole = Window.partitionBy(KEY)
    others = nodes_of.where("id <> 'person'").withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(whole))
    angle = F.lit(2 * math.pi) * F.col("i") / F.col("n")
    ring = others.select(KEY, "id", F.round(centre[0] + radius[0] * F.cos(angle), 3).alias("x"), F.round(centre[1] + radius[1] * F.sin(angle), 3).alias("y"))
    return ring.unionByName(nodes_of.where("id = 'person'").select(KEY, "id", F.lit(centre[0]).alias("x"), F.lit(centre[1]).alias("y")))


def statistics(edges: DataFrame) -> DataFrame:
    """relationship, edges, uploads, distinct targets, mean confidence."""
    return edges.groupBy("relationship").agg(F.count("*").alias("edges"), F.count_distinct(KEY).alias("uploads"), F.count_distinct("target_label").alias("targets"), F.round(F.avg("confidence"), 6).alias("confidence"))
