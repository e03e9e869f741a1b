"""Row classifier, sections without headings, records of all kinds, and JSON records, on invented cases with stated results."""

import json

import pytest
from pyspark.sql import functions as F

from foliograph.functions import text
from foliograph.operators import classify, evaluation, graph, groups, json_records, layout, lines, records, rows, sectioning, vectors
from foliograph.plans import engine, lineage
from foliograph.sources import samples


def sectioned(spark, document, upload=1):
    return lines.with_sections(lines.split_lines(spark.createDataFrame([(upload, document)], "upload_id bigint, raw_text string")))


JOBS = """Experience
Korvane Software Ltd - Senior Data Analyst | Jan 2015 - Mar 2018
Client: Belmira; Tessaly
Key achievement: halved the cost of storage
- Built reports for the board.
which were read
Worked at Orinday Laboratories as a Technician from 2010 - 2012
Software Engineer at Pellworth Bank
Project Manager
Lindfurt, Germany
2001 - 2003
Responsibilities:
aabbccdd
Page 2 of 3"""


def test_classifier(spark):
    out = {r.line_index: r for r in classify.classified(sectioned(spark, JOBS)).collect()}
    kinds = ["SECTION_HEADING", "COMPANY_ROLE", "CLIENT", "ACHIEVEMENT", "RESPONSIBILITY", "RESPONSIBILITY", "COMPANY_ROLE", "COMPANY_ROLE", "ROLE", "LOCATION", "DATE_RANGE", "SUBSECTION_HEADING", "PAGE_ARTIFACT", "PAGE_ARTIFACT"]
    assert [out[k].block_type for k in range(len(kinds))] == kinds
    assert (out[1].company, out[1].designation, out[1].start_date, out[1].end_date) == ("Korvane Software Ltd", "Senior Data Analyst", "Jan 2015", "Mar 2018")
    assert out[2].client == "Belmira; Tessaly" and out[6].company == "Orinday Laboratories" and out[6].designation == "Technician" and out[7].company == "Pellworth Bank"
    assert classify.classified(sectioned(spark, "")).isEmpty()


def test_from_text_to_graph(spark):
    stages = []
    out = engine.Engine(spark).run(spark.createDataFrame([(1, "Mira Talvest", JOBS), (2, None, None)], "upload_id bigint, candidate_name string, raw_text string"), stage=stages.append)
    edges = {(e.relationship, e.target_label) for e in out.edges.collect()}
    assert {("WORKED_AT", "Korvane Software Ltd"), ("WORKED_FOR_CLIENT", "Belmira"), ("WORKED_FOR_CLIENT", "Tessaly"), ("HAS_RESPONSIBILITY", "Built reports for the board. which were read")} <= edges
    assert stages[0] == "lines" and "graph" in stages and graph.typed_violations(out.edges).isEmpty()
    assert {r.source_label for r in out.edges.where("source_type = 'PERSON'").collect()} == {"Mira Talvest"}


def test_samples_run(spark):
    out = engine.Engine(spark).run(samples.samples(spark, 2))
    found = {r.relationship for r in out.edges.collect()}
    assert {"WORKED_AT", "HAS_ROLE", "COMPLETED_DEGREE", "HAS_SKILL", "HAS_SUMMARY"} <= found and out.records.count() == 2
    assert samples.sample_text(3) == samples.sample_text(3) != samples.sample_text(4)


def test_inline_headings(spark):
    doc = "Skills: Python, SQL\nTechnologies: Java\nSKILLS EC2 S3 Lambda\nSkills matter to me\nWORK EXPERIENCE Korvane Software Ltd"
    out = {r.line_index: (r.section, r.body) for r in sectioning.inline_headings(sectioned(spark, doc)).collect()}
    assert out == {0: ("Skills", "Python, SQL"), 2: ("Skills", "EC2 S3 Lambda"), 4: ("Experience", "Korvane Software Ltd")}


def test_sections_without_headings(spark):
    doc = "Mira Talvest\nmira@mail.example | 020 7946 0123\nProfessional with long experience of teams and of reports.\nAnalyst, Korvane, 2015 - 2018\nPython, SQL, Docker\nBachelor of Science, University of Tremont\nPython, SQL, Git\nAWS certified"
    out = {r.line_index: (r.cue, r.section) for r in sectioning.inferred_sections(sectioned(spark, doc)).collect()}
    assert out == {0: (None, "Header"), 1: (None, "Header"), 2: ("Summary", "Summary"), 3: ("Experience", "Experience"), 4: (None, "Experience"), 5: ("Education", "Education"), 6: ("Skills", "Skills"), 7: ("Certifications", "Certifications")}


def test_contact_rows_and_identity(spark):
    doc = "Mira Talvest\nData Analyst\nLindfurt\nSummary\nI like data.\nmira.talvest@mail.example\nExperience\nother@mail.example"
    table = sectioned(spark, doc)
    assert [r.line_index for r in sectioning.contact_rows(table).collect()] == [5]
    one = sectioning.identity(table).first()
    assert (one.name, one.title, one.location, one.email) == ("Mira Talvest", "Data Analyst", "Lindfurt", None)
    assert sectioning.identity(sectioned(spark, "jo.sample@mail.example")).first().name == "Jo Sample"


def test_labels_before_values(spark):
    doc = "Personal Details\nDate of Birth\nNationality\n: 1 May 1990\nItalian\nreads a lot\nLanguages: English, German"
    out = {(r.field, r.value) for r in sectioning.personal_details(sectioned(spark, doc)).collect()}
    assert out == {("date_of_birth", "1 May 1990"), ("nationality", "Italian"), (None, "reads a lot"), ("languages", "English, German")}


ROW = "block_id bigint, upload_id bigint, row_id string, reading_order int, page int, bbox array<double>, text string, section string, section_id string, is_bullet boolean, bold boolean, block_type string, entities struct<company:string,designation:string,start_date:string,end_date:string,location:string>"


def row(k, t, section, kind="UNKNOWN", bullet=False, bold=False, box=None, company=None):
    return (k, 1, f"d{k}", k, 1, box, t, section, f"s:{section}", bullet, bold, kind, (company, None, None, None, None))


def test_projects(spark):
    texts = [("1. Ledger rewrite", False), ("Tools: Python, SQL", False), ("Moved the books to a new store.", True), ("Portal | React, Node", False), ("Client: Belmira", False), ("Jan 2019 - Mar 2020", False), ("Served all customers.", True)]
    frame = spark.createDataFrame([row(k, t, "Projects", bullet=b) for k, (t, b) in enumerate(texts)], ROW)
    a, b = groups.projects(frame).orderBy("project").collect()
    assert (a.name, a.technologies, a.lines) == ("Ledger rewrite", ["Python", "SQL"], ["Moved the books to a new store."])
    assert (b.name, b.technologies, b.client, b.start_date, b.lines) == ("Portal", ["React", "Node"], "Belmira", "Jan 2019", ["Served all customers."])


def test_project_dates_and_certifications(spark):
    frame = spark.createDataFrame([row(1, "Ledger", "Projects", bold=True, box=[50.0, 100.0, 150.0, 112.0]), row(2, "Portal", "Projects", bold=True, box=[50.0, 130.0, 150.0, 142.0]), row(3, "2019 - 2020", "Projects", box=[400.0, 131.0, 480.0, 141.0])], ROW)
    assert [tuple(r) for r in groups.project_dates(frame).collect()] == [(3, 2)]
    frame = spark.createDataFrame([row(1, "Cloud architect", "Certifications", box=[50.0, 100.0, 200.0, 110.0]), row(2, "of the second level", "Certifications", box=[60.0, 112.0, 200.0, 122.0]), row(3, "Scrum master", "Certifications", box=[50.0, 126.0, 200.0, 136.0])], ROW)
    assert [r.text for r in groups.certifications(frame).orderBy("item").collect()] == ["Cloud architect of the second level", "Scrum master"]


def test_strengths_domains_and_lists(spark):
    frame = spark.createDataFrame([row(1, "Employee of the year", "Awards"), row(2, "Leadership", "Awards", bold=True), row(3, "Led three teams", "Awards")], ROW)
    assert {r.block_id: r.category for r in groups.strengths(frame).collect()} == {1: None, 2: "Leadership", 3: "Leadership"}
    frame = spark.createDataFrame([row(1, "Banking: loans, cards", "Domain Experience"), row(2, "payments", "Domain Experience")], ROW)
    assert {tuple(r)[1:] for r in groups.domains(frame).collect()} == {("Banking", "loans"), ("Banking", "cards"), ("Banking", "payments")}
    frame = spark.createDataFrame([row(1, "chess, running", "Interests"), row(2, "Reading of", "Awards"), row(3, "old books", "Awards")], ROW)
    assert {(r.section, r.text) for r in groups.simple_items(frame).collect()} == {("Interests", "chess"), ("Interests", "running"), ("Awards", "Reading of old books")}


def test_preamble_and_employers_of_projects(spark):
    frame = spark.createDataFrame([row(1, "Ten years of experience with reports and with the people who read them.", "Experience", "RESPONSIBILITY"), row(2, "Korvane Software", "Experience", "COMPANY", company="Korvane Software"), row(3, "At Korvane Software the ledger was moved.", "Projects")], ROW)
    assert [r.block_id for r in groups.preamble(frame).collect()] == [1]
    assert [(r.block_id, r.job) for r in groups.employer_context(frame).collect()] == [(3, 1)]


def test_rows_put_right(spark):
    frame = spark.createDataFrame([row(1, "Bachelor", "Education"), row(2, "1999", "Personal Details"), row(3, "8.1 / 10", "Personal Details"), row(4, "Married", "Personal Details"), row(5, "•", "Skills"), row(6, "Python", "Skills")], ROW)
    assert {r.block_id: r.section_id for r in rows.detached_education(frame).collect()} == {2: "s:Education", 3: "s:Education"}
    assert [tuple(r) for r in rows.handed_markers(frame).collect()] == [(5, 6, "•")]
    left, right = [("2019 - 2020", "DATE_RANGE"), ("Korvane", "UNKNOWN"), ("Lindfurt", "UNKNOWN"), ("2015 - 2018", "DATE_RANGE"), ("Belmira", "UNKNOWN")], ["Data Analyst", "Built reports.", "Software Engineer", "Built stores."]
    lanes = [row(10 + k, t, "Experience", kind, box=[50.0, 100.0 + 20 * k, 120.0, 110.0 + 20 * k]) for k, (t, kind) in enumerate(left)] + [row(20 + k, t, "Experience", box=[200.0, 100.0 + 20 * k, 400.0, 110.0 + 20 * k]) for k, t in enumerate(right)]
    assert {r.block_id: r.new_type for r in rows.timeline_lanes(spark.createDataFrame(lanes, ROW)).collect()} == {11: "COMPANY", 12: "LOCATION", 14: "COMPANY"}


def test_wrapped_and_aligned_dates(spark):
    frame = spark.createDataFrame([row(1, "May 2019 - Jun", "Experience", "DATE_RANGE", box=[400.0, 100.0, 480.0, 110.0]), row(2, "2021", "Experience", "DATE_RANGE", box=[400.0, 130.0, 480.0, 140.0]), row(3, "Data Analyst", "Experience", "ROLE", box=[50.0, 101.0, 200.0, 111.0])], ROW)
    assert [tuple(r) for r in layout.wrapped_dates(frame).collect()] == [(1, "May 2019 - Jun 2021")]
    assert [tuple(r) for r in layout.aligned_dates(frame).collect()] == [(1, 3)]


def test_reading_order_of_columns_and_timelines():
    columns = [(50.0, 100.0 + 30 * k, 150.0, 110.0 + 30 * k, k) for k in range(3)] + [(300.0, 115.0 + 30 * k, 500.0, 123.0 + 30 * k, 10 + k) for k in range(3)]
    assert [r[4] for r in layout.read_in_order(columns)] == [0, 1, 2, 10, 11, 12]
    timeline = [(50.0, 100.0 + 30 * k, 130.0, 110.0 + 30 * k, k) for k in range(3)] + [(150.0, 100.0 + 30 * k, 520.0, 110.0 + 30 * k, 10 + k) for k in range(3)]
    assert [r[4] for r in layout.read_in_order(timeline)] == [0, 10, 1, 11, 2, 12]
    assert layout.read_in_order([]) == []


@pytest.mark.parametrize(
    "source, plain",
    [
        (r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\f0 Caf\'e9 \u%d?x\par line{\b two}\tab end}" % 0x2013, "Café –x\nlinetwo\tend"), (r"{\rtf1\uc2 \u%d??b}" % 0x3B1, "αb"), (r"{\rtf1 a\{b\}\\c {\*\generator hidden;}d}", "a{b}\\c d"), ("", ""),
    ],
)
def test_rtf(source, plain):
    assert text.read_rtf(source) == plain


RESUME = {
    "Contact": {"0": "Mira Talvest", "email": "mira@mail.example, 020 7946 0123", "dob": "x"}, "employment_history": [{"employer": {"name": "Korvane", "location": "Lindfurt"}, "job_title": "Analyst", "dates": "Jan 2015 - till date", "client": "Belmira", "duties": ["Built", ["", "Ran"]]}, "freelance"],
    "Education": ["BSc"], "skills": {"tools": ["Git", "SQL"]}, "Technical Skill": {"Languages": "Python"}, "languages": "English; German", "Hobbies": ["chess"], "certificates": ["Scrum"], "licences": ["Driving"],
}


def test_canonical_form():
    r = json_records.canonical(RESUME)
    assert json_records.wrong(r) == [] and json_records.canonical(r)["work_history"] == r["work_history"]
    job = r["work_history"][0]
    assert (job["company"], job["location"], job["roles"][0]["designation"], job["roles"][0]["role_and_responsibilities"], job["roles"][0]["clients"]) == ("Korvane", "Lindfurt", "Analyst", ["Built", "Ran"], ["Belmira"])
    assert (job["roles"][0]["start_date"], job["roles"][0]["end_date"]) == ("Jan 2015", "Present")
    assert r["personal_information"]["name"] == "Mira Talvest" and r["personal_information"]["email"] == "mira@mail.example" and r["personal_information"]["phone"] == "020 7946 0123" and r["personal_details"]["languages"] == ["English", "German"]
    assert r["skills"] == [{"name": "Git", "category": "tools"}, {"name": "SQL", "category": "tools"}] and [c["name"] for c in r["certifications"]] == ["Scrum", "Driving"]
    assert r["source_sections"] == {"hobbies": ["chess"], "unreadable_employments": ["freelance"]} and r["technical_skills"] == {"Languages": ["Python"]}


def test_rules_of_canonical_records():
    good = json_records.canonical(RESUME)
    rules = lambda **change: {rule for rule, _ in json_records.wrong(good | change)}
    assert rules(work_history=[{"company": "", "roles": []}]) == {"employment without employer"} and rules(work_history=[{"company": "a"}]) == {"employment without roles"}
    assert rules(education=[{"languages": "x"}]) == {"personal detail in education"} and rules(projects="x") == {"not a list"} and rules(schema_version="0") == {"unknown version"}
    blocks = {"d1": {"text": "Page 2", "is_page_number": True, "block_type": "PAGE_ARTIFACT"}, "d2": {"section": "Languages"}, "d3": {"section": "Projects", "block_type": "PROJECT"}, "d4": {"section": "Experience", "destination": "$.skills[0]"}}
    audited = rules(source_audit={"semantic_block_map": blocks}, profile_snapshot=["page 2"], education=[{"degree": "x", "source_blocks": ["d2"]}])
    assert audited == {"page marker in the content", "personal detail in education", "projects lost", "employment assigned to another field"}
    assert "missing field" in {rule for rule, _ in json_records.wrong({})}


def test_merging():
    assert json_records.merged({"a": {"b": [1], "c": 1}}, {"a": {"b": [1, 2], "c": None}, "d": 3}) == {"a": {"b": [1, 2], "c": 1}, "d": 3}
    record = {"projects": [{"name": "x"}]}
    assert json_records.merge_section(record, "projects", [{"name": "y"}]) == 1 and len(record["projects"]) == 2
    json_records.merge_section(record, "hobbies", "chess")
    json_records.merge_section(record, "hobbies", {"sports": ["golf"]})
    assert record["hobbies"] == {"general": ["chess"], "sports": ["golf"]} and json_records.flat([None, "", ["a", ["b"]]]) == ["a", "b"]


def test_json_columns(spark):
    frame = spark.createDataFrame([(1, json.dumps(RESUME)), (2, None), (3, "no json"), (4, "[1]")], "id int, j string")
    out = {r.id: r.c for r in frame.select("id", json_records.canonical_json(F.col("j")).alias("c")).collect()}
    assert json.loads(out[1])["schema_version"] == json_records.VERSION and out[2] is out[3] is out[4] is None


def test_error_kinds_and_truth_lookup(spark):
    leaf = "doc string, section string, path string, value string, norm string, anchor string"
    p = spark.createDataFrame([("1", "experience", "x", v, v, "") for v in ("built the reports for boards", "german")], leaf)
    t = spark.createDataFrame([("1", "experience", "x", "built the reports for board", "built the reports for board", ""), ("1", "languages", "x", "german", "german", "")], leaf)
    kinds = {(r.kind, r.predicted) for r in evaluation.match_errors(p, t, 0.5).collect()}
    assert ("wrongly_associated_section", "german") in kinds and ("corrupted_or_incorrect_value", "built the reports for boards") in kinds
    files = spark.createDataFrame([("a/x.pdf",), ("b/y.pdf",), ("z.pdf",)], "path string")
    truth = spark.createDataFrame([("a/x.json",), ("y.json",)], "path string")
    assert {r.path: r.truth_path for r in evaluation.with_truth(files, truth).collect()} == {"a/x.pdf": "a/x.json", "b/y.pdf": "y.json", "z.pdf": None}
    assert {(r.status, r.documents) for r in evaluation.corpus_rollup(spark.createDataFrame([("read", "text"), ("failed", "pdf")], "status string, method string")).where("method is null").collect()} == {("read", 1), ("failed", 1), (None, 2)}


def test_long_chains_are_one_part(spark):
    n = 70  # more than the rounds that were once the end
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)], "a bigint, b bigint")
    parts = vectors.connected(edges, spark.range(n + 1).withColumnRenamed("id", "node"))
    assert {r.component for r in parts.collect()} == {0}


def test_cut_tables_are_released(spark):
    frame = lineage.cut(spark.range(5))
    assert frame.count() == 5 and lineage._written
    path = lineage._written[-1]
    lineage.release(spark)
    fs, there = lineage._path(spark, path)
    assert not fs.exists(there) and not lineage._written


def test_evidence_at_paths(spark):
    leaves = spark.createDataFrame([(1, "$.work_history[0]", "Korvane"), (1, "$.work_history[0].roles[1]", "Analyst")], "upload_id bigint, path string, value string")
    wanted = spark.createDataFrame([(1, "$.work_history[0].roles[1].clients[2]"), (1, "$.work_history[0].company"), (1, "$.skills[0]")], "upload_id bigint, path string")
    assert {r.path: r.value for r in graph.at_path(leaves, wanted).collect()} == {"$.work_history[0].roles[1].clients[2]": "Analyst", "$.work_history[0].company": "Korvane"}


def test_records_keep_every_row(spark):
    frame = sectioned(spark, JOBS)
    record = records.canonical(classify.as_blocks(frame)).first()
    assert record.work_history[0].roles[0].clients == ["Belmira", "Tessaly"] and record.work_history[0].roles[0].achievements == ["halved the cost of storage"]
