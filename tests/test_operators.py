"""Small cases of the core operators: nulls, empty tables, ties, extra columns, invented documents."""

import pytest

from foliograph.functions import text
from foliograph.operators import context, evaluation, graph, layout, lines, mentions, records, vectors
from pyspark.sql import functions as F

RESUME = """Mira Tolvan
mira.tolvan@mail.example | +44 20 7946 0000

PROFESSIONAL SUMMARY
Builds pipelines. Likes tests!

WORK EXPERIENCE
Data Engineer at Borvan Analytics (2015 - 2018)
• Built a pipeline using Python and
Apache Spark for reports.
• Led two people

EDUCATION
Bachelor of Science, Norvik University, 2014

TECHNICAL SKILLS
Languages: Python, SQL
Tools: Git, Kafka
2"""


def sectioned(spark, *texts):
    raw = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "upload_id bigint, raw_text string, line string")
    return lines.with_sections(lines.split_lines(raw))


def test_sections_sentences_and_blocks(spark):
    s = sectioned(spark, RESUME, None, "", "\n\n", "EDUCATION", "one line only")
    heads = {(r.upload_id, r.heading) for r in s.where("heading is not null").collect()}
    assert {h for u, h in heads if u == 0} == {"Summary", "Experience", "Education", "Technical Skills"}
    assert {u for u, _ in heads} == {0, 4}
    sentences = lines.split_sentences(s)
    texts = [r.sentence for r in sentences.where("upload_id = 0").orderBy("sentence_index").collect()]
    assert "Builds pipelines." in texts and "Likes tests!" in texts and "2" not in texts
    joined = context.joins(context.sentence_lines(sentences))
    blocks = context.blocks(joined)
    assert context.coverage(s, blocks).where("not complete").isEmpty()
    bullets = {r.text for r in lines.reflowed_bullets(s).collect()}
    assert "Built a pipeline using Python and Apache Spark for reports." in bullets
    assert {(r.category, r.skill) for r in lines.skill_items(s).collect()} == {("Languages", "Python"), ("Languages", "SQL"), ("Tools", "Git"), ("Tools", "Kafka")}
    contact = lines.contact_fields(s).where("upload_id = 0").first()
    assert contact.email == "mira.tolvan@mail.example" and contact.phone == "+44 20 7946 0000"


def test_fuzzy_headings(spark):
    raw = spark.createDataFrame([(1, "Educaton\nBachelor\nSkils\nPython")], "upload_id bigint, raw_text string")
    rows = lines.with_sections(lines.split_lines(raw), fuzzy=True).where("heading is not null").collect()
    assert {r.heading for r in rows} == {"Education", "Skills"}


def test_mentions(spark):
    s = spark.createDataFrame([(1, 0, "Used Python, ci/cd and Spring Boot at Borvan Works", "Experience"), (1, 1, "AI and AI/ML", "Skills"), (1, 2, "said AI/ML", "Skills"), (1, 3, "email", "Skills")], "upload_id bigint, sentence_index int, sentence string, section string")
    found = {(r.sentence_index, r.text, r.type) for r in mentions.all_mentions(s).collect()}
    assert {(0, "Python", "PROGRAMMING_LANGUAGE"), (0, "CI/CD", "CLOUD"), (0, "Spring Boot", "FRAMEWORK"), (0, "Spring", "FRAMEWORK"), (0, "Borvan Works", "COMPANY"), (1, "AI", "SKILL"), (1, "AI/ML", "SKILL")} <= found
    assert (2, "AI", "SKILL") not in found and not any(i == 3 for i, *_ in found)
    relations = {(r.source, r.target, r.relationship) for r in mentions.relations(mentions.all_mentions(s), s).collect()}
    assert ("PERSON", "Python", "USED_OR_APPLIED") in relations and ("PERSON", "AI", "HAS_SKILL") in relations


def test_scalars_keep_nulls(spark):
    row = spark.createDataFrame([(None,)], "t string").select(
        text.unified_lines(F.col("t")), text.word_key(F.col("t")), text.period(F.col("t")), text.strict_period(F.col("t")), text.four_digit_year(F.col("t")), text.email(F.col("t")), text.employment_header(F.col("t")), text.compatibility_form(F.col("t"))
    ).first()
    assert all(v is None for v in row)
    assert spark.range(1).select(text.safe_stem(F.lit(None).cast("string"))).first()[0] == "resume"


BLOCK = "block_id bigint, upload_id bigint, doc_id string, row_id string, line_index int, text string, page int, bbox array<double>, page_height double, font_size double, bold boolean, reading_order int, section string, is_bullet boolean, block_type string, entities struct<company:string,designation:string,start_date:string,end_date:string,location:string>"


def block(i, text_, kind, section="Experience", company=None, title=None, bullet=False, box=None, page=1, upload=1):
    return (i, upload, "d", f"d{i}", i, text_, page, box, 842.0, None, None, i, section, bullet, kind, (company, title, "2010" if title else None, "2012" if title else None, None))


def test_records_and_their_edges(spark):
    rows = [
        block(0, "Borvan Ltd", "COMPANY", company="Borvan Ltd"), block(1, "Engineer", "ROLE", title="Engineer"), block(2, "- built things", "RESPONSIBILITY", bullet=True), block(3, "over two lines", "RESPONSIBILITY"), block(4, "- led", "RESPONSIBILITY", bullet=True),
        block(5, "Bachelor of Arts, Norvik University, 2009", "EDUCATION", "Education"), block(6, "Tools: Git, Jira", "SKILL", "Skills"), block(7, None, "UNKNOWN"),
    ]
    frame = spark.createDataFrame(rows, BLOCK)
    record = records.canonical(frame).first()
    job = record.work_history[0]
    assert job.company == "Borvan Ltd" and job.roles[0].designation == "Engineer" and job.roles[0].duties == ["built things over two lines", "led"]
    assert record.education[0].institution == "Norvik University" and record.technical_skills == {"Tools": ["Git", "Jira"]}
    names = spark.createDataFrame([(1, None)], "upload_id bigint, candidate_name string")
    edges = {(r.source_label, r.relationship, r.target_label) for r in graph.edges_of_records(records.canonical(frame), names).collect()}
    assert {("Resume subject", "WORKED_AT", "Borvan Ltd"), ("Engineer", "HAS_RESPONSIBILITY", "led"), ("Bachelor of Arts", "AWARDED_BY", "Norvik University")} <= edges
    assert records.violations(frame).isEmpty()
    assert records.canonical(frame.limit(0)).isEmpty()
    orphan = spark.createDataFrame([block(0, "- lost", "RESPONSIBILITY", bullet=True)], BLOCK)
    assert records.violations(orphan).first().rule == "row before any employer"


def test_records_keep_every_row(spark):
    rows = [
        block(0, "Mira Tolvan", "CONTACT", "Header"), block(1, "mira.tolvan@mail.example", "CONTACT", "Header"), block(2, "Location: Norvik", "CONTACT", "Header"), block(3, "- too early", "RESPONSIBILITY", bullet=True),
        block(4, "Borvan Ltd", "COMPANY", company="Borvan Ltd"), block(5, "of no known kind", "UNKNOWN"), block(6, "Norvik University", "EDUCATION", "Education"), block(7, "Date of birth: 3.4.1990", "PERSONAL_DETAIL", "Personal Details"),
        block(8, "Languages: English, Deutsch", "PERSONAL_DETAIL", "Personal Details"), block(9, "- Crane planner", "UNKNOWN", "Projects", bullet=True), block(10, "with live maps", "UNKNOWN", "Projects"), block(11, "Tools: Kafka, Spark", "UNKNOWN", "Projects"),
        block(12, "Welding licence", "UNKNOWN", "Certifications"), block(13, "First aid", "UNKNOWN", "Certifications"), block(14, "Rowing", None, "Hobbies"), block(15, "no section", None, None), block(16, "loose skill", None, "Skills"), block(17, "loose job", None),
    ]
    frame = spark.createDataFrame(rows, BLOCK)
    record = records.canonical(frame).first()
    assert record.personal_information.email == "mira.tolvan@mail.example" and record.personal_information.lines == [r[5] for r in rows[:3]]
    assert [i.name for i in record.certifications] == ["Welding licence", "First aid"] and record.projects[0].technologies == ["Kafka", "Spark"]
    assert record.source_sections == {"Experience": ["- too early", "of no known kind", "loose job"], "Education": ["Norvik University"], "Hobbies": ["Rowing"], "": ["no section"], "Skills": ["loose skill"]}
    names = spark.createDataFrame([(1, "Mira")], "upload_id bigint, candidate_name string")
    edges = {(r.source_label, r.relationship, r.target_label) for r in graph.edges_of_records(records.canonical(frame), names).collect()}
    assert edges == {
        ("Mira", "WORKED_AT", "Borvan Ltd"), ("Mira", "LOCATED_IN", "Norvik"), ("Mira", "HAS_DATE_OF_BIRTH", "3.4.1990"), ("Mira", "SPEAKS", "English"), ("Mira", "SPEAKS", "Deutsch"), ("Mira", "COMPLETED_PROJECT", "Crane planner with live maps"),
        ("Crane planner with live maps", "USED_TECHNOLOGY", "Kafka"), ("Crane planner with live maps", "USED_TECHNOLOGY", "Spark"), ("Mira", "HAS_CERTIFICATION", "Welding licence"), ("Mira", "HAS_CERTIFICATION", "First aid"),
    }


def test_layout(spark):
    left, right = [50.0, 100.0, 200.0, 110.0], [300.0, 90.0, 500.0, 100.0]
    rows = [block(0, "right", "UNKNOWN", box=right), block(1, "left", "UNKNOWN", box=left), block(2, "left", "UNKNOWN", box=[x + 0.4 for x in left]), block(3, "7", "UNKNOWN", box=[50.0, 820.0, 60.0, 830.0]), block(4, "none", "UNKNOWN")]
    frame = spark.createDataFrame(rows, BLOCK)
    assert [r.block_id for r in layout.doubled_layers(frame).collect()] == [2]
    order = [r.block_id for r in layout.reading_order(frame).orderBy("position").collect()]
    assert order.index(1) < order.index(0)
    assert {(r.block_id, r.artifact) for r in layout.margin_artifacts(frame).collect()} == {(3, "page_number")}


def test_edge_rules(spark):
    schema = "edge_id bigint, upload_id bigint, source string, target string, source_label string, target_label string, relationship string, source_sentence string, confidence double"
    good = (1, 1, "person", "n1", "Mira", "Borvan Ltd", "WORKED_AT", "Worked at Borvan Ltd", 1.0)
    rows = [good, (2, *good[1:]), (3, 1, "person", None, "Mira", None, "WORKED_AT", "x", 1.0), (4, 1, "a", "a", "A", "A", "LIKES", "A", 1.0), (5, 1, "person", "n2", "Mira", "Norvik", "WORKED_AT", "nothing", 1.0)]
    frame = spark.createDataFrame(rows, schema)
    broken = {(r.edge_id, r.rule) for r in graph.edge_violations(frame).collect()}
    assert broken == {(2, "duplicate edge"), (3, "missing endpoint"), (3, "missing label"), (4, "unknown relationship"), (4, "loop"), (5, "target not in evidence")}
    assert graph.edge_violations(frame.limit(0)).isEmpty() and graph.nodes(frame.limit(0)).isEmpty()


def test_connected_parts_of_a_long_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n) if i != 30], "a bigint, b bigint")
    nodes = spark.range(n + 2).withColumnRenamed("id", "node")
    parts = {r.node: r.component for r in vectors.connected(edges, nodes).collect()}
    assert parts == {i: 0 if i <= 30 else 31 if i <= n else i for i in range(n + 2)}


def test_silhouette_of_all_vectors(spark):
    import numpy as np

    from foliograph.plans import catalog

    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = frame.select("vec_id", "label", "embedding").collect()
    x, of = np.array([r.embedding for r in rows], dtype=float), np.array([r.label for r in rows])

    def brute(x, of):
        out = []
        for k in range(len(x)):
            far = np.sqrt(((x - x[k]) ** 2).sum(1))
            same = (of == of[k]) & (np.arange(len(x)) != k)
            a, b = far[same].mean() if same.any() else None, min(far[of == c].mean() for c in set(of.tolist()) - {of[k]})
            out.append(0.0 if a is None else (b - a) / max(a, b))
        return round(float(np.mean(out)), 4)

    assert catalog.queries()["v8_silhouette_all"](spark, "/root/testdata/sf0.001").first()[0] == brute(x, of)
    assert vectors.silhouette(frame, block=70).first()[0] == brute(x, of)
    lone = np.where(np.arange(len(of)) == 3, 99, of)
    assert vectors.silhouette(frame.withColumn("label", F.when(F.col("vec_id") == rows[3].vec_id, 99).otherwise(F.col("label")))).first()[0] == brute(x, lone)
    gaps = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 0, [0.0, 0.0]), (3, 1, [0.0, 0.0]), (4, None, [1.0, 0.0]), (5, 1, None)], "vec_id bigint, label int, embedding array<float>")
    assert vectors.silhouette(gaps).first()[0] == 0.0
    assert vectors.silhouette(gaps.limit(0)).first()[0] is None


def test_scores(spark):
    schema = "doc bigint, section string, path string, value string, norm string, anchor string"
    p = spark.createDataFrame([(1, "s", "p", "a", "a", ""), (1, "s", "p", "a", "a", ""), (1, "s", "p", "b", "b", "x")], schema)
    t = spark.createDataFrame([(1, "s", "p", "a", "a", ""), (1, "s", "p", "b", "b", "y"), (1, "s", "p", "c", "c", "")], schema)
    overall = evaluation.with_overall(p, t).where("section = 'Overall'").first()
    assert (overall.true_positive, overall.false_positive, overall.false_negative, overall.f1) == (1, 2, 2, 0.3333)
    kinds = sorted(r.kind for r in evaluation.match_errors(p, t).collect())
    assert kinds == ["extra_content", "missing_content", "wrongly_associated_block"]
    empty = evaluation.with_overall(p.limit(0), t.limit(0)).collect()
    assert all(r.state == "no_reference_items" for r in empty)


def test_uploads_without_reference_are_reported(spark):
    from foliograph.plans import catalog

    schema = "doc bigint, section string, path string, value string, norm string, anchor string"
    p = spark.createDataFrame([(1, "s", "p", "a", "a", ""), (1, "s", "p", "b", "b", ""), (2, "s", "p", "a", "a", ""), (2, "s", "p", "a", "a", "")], schema)
    t = spark.createDataFrame([(1, "s", "p", "a", "a", ""), (3, "s", "p", "c", "c", "")], schema)
    rows = {r.doc: tuple(r)[1:] for r in evaluation.by_document(p, t).collect()}
    assert rows == {1: (2, 1, 1, 1, 0, 0.5, 1.0, 0.6667, "scored"), 2: (2, 0, 0, 0, 0, None, None, None, "no_reference_items"), 3: (0, 1, 0, 0, 1, None, 0.0, 0.0, "scored")}
    folder = "/root/testdata/sf0.001"
    unsorted = spark.read.parquet(f"{folder}/semantic_blocks.parquet").where("doc_id = 'cv-unsorted' and entities.company is not null")
    states = {r.doc: r.state for r in catalog.queries()["q5_scores_of_uploads"](spark, folder).collect()}
    ids = {r.upload_id for r in unsorted.collect()}
    assert ids and all(states[i] == "no_reference_items" for i in ids)


@pytest.mark.parametrize("value", ["{", "[1]", "plain"])
def test_only_json_objects_are_rendered(spark, value):
    from foliograph.sources.documents import json_rows

    frame = spark.createDataFrame([(value,)], "t string")
    assert frame.select(json_rows(F.col("t"))).first()[0] is None
