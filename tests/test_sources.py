"""Files of several formats, the engine, artifacts and the stream."""

import datetime as dt
import zipfile

from foliograph.plans.engine import Engine
from foliograph.sources import documents
from foliograph.streaming import ingest
from pyspark.sql import functions as F

DOCX = """<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
<w:p><w:r><w:t>Mira Tolvan</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>2014</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>Bachelor</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""


def test_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Zoë\nSKILLS\nPython".encode())
    (tmp_path / "b.TXT").write_bytes("Zoë".encode("cp1252"))
    (tmp_path / "u.txt").write_bytes("Zoë".encode("utf-16"))
    (tmp_path / "c.rtf").write_text(r"{\rtf1\ansi One\par Two}")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", DOCX)
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    (tmp_path / "~$a.txt").write_text("lock")
    (tmp_path / "g.xyz").write_text("no")
    (tmp_path / "h.json").write_text('{"work_history": [{"company": "Borvan"}], "open": true}')
    read = {r.path.rsplit("/", 1)[1]: r for r in documents.read_documents(documents.list_files(spark, str(tmp_path))).collect()}
    assert set(read) == {"a.txt", "b.TXT", "u.txt", "c.rtf", "d.docx", "e.docx", "f.pdf", "h.json"}
    assert read["b.TXT"].text == read["u.txt"].text == "Zoë" and read["c.rtf"].text.splitlines() == ["One", "Two"]
    assert read["d.docx"].text == "Mira Tolvan\n2014 | Bachelor"
    assert read["e.docx"].status == read["f.pdf"].status == "failed" and read["f.pdf"].error
    rows = spark.createDataFrame([(read["h.json"].text,)], "t string").select(documents.json_rows(F.col("t")).alias("r")).first().r
    assert [(r.path, r.text) for r in rows] == [("$.work_history[0].company", "Company: Borvan"), ("$.open", "Open: Yes")]
    texts, failed = Engine(spark).ingest(str(tmp_path), limit=5)
    assert texts.count() + failed.count() == 5


def test_engine_and_artifacts(spark, tmp_path):
    artifacts = Engine(spark).process_text("Mira\nSKILLS\nPython, SQL\nEXPERIENCE\nBuilt things using Kafka.")
    assert {r.text for r in artifacts.entities.collect()} == {"Python", "SQL", "Kafka"}
    documents.write_artifacts(artifacts.as_dict(), str(tmp_path / "out"), as_json=True)
    assert "entities" in documents.list_artifacts(spark, str(tmp_path / "out")) and documents.list_artifacts(spark, str(tmp_path / "none")) == []
    assert documents.read_artifact(spark, str(tmp_path / "out"), "entities").count() == 3


def test_stream(spark, tmp_path):
    schema = "upload_id bigint, source string, raw_text string, loaded_at timestamp"
    day = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, "a", "SKILLS\nPython", day), (2, "a", "x", day)], schema).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(1, "a", "SKILLS\nPython", day), (3, "b", None, day)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    kind = spark.read.parquet(str(tmp_path / "in")).schema
    stream = ingest.uploads(spark, str(tmp_path / "in"), kind, files_at_once=1)
    query = ingest.run_batches(stream, lambda f: {"rows": f}, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert query.awaitTermination(90)
    assert sorted(r.upload_id for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()) == [1, 2, 3]
    counted = ingest.counts_by_time(spark.read.parquet(str(tmp_path / "out/rows")))
    assert {(r.source, r.uploads) for r in counted.collect()} == {("a", 2), ("b", 1)}
