"""Reading documents of several formats from a folder, and writing artifacts.

Files come as binaryFile rows, so reading is spread over tasks and one bad file
only gives a row with status 'failed' and the reason. Formats that need outside
programs (pdf, doc, images) give such a row, too; their layout rows can be read
as a table instead.
"""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

# --- Fixed values: suffixes by the way they are read. ---
TEXT_SUFFIXES, RTF_SUFFIXES, DOCX_SUFFIXES, JSON_SUFFIXES = [".txt", ".md", ".text"], [".rtf"], [".docx"], [".json"]
OUTSIDE_SUFFIXES = [".pdf", ".doc", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp"]
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def list_files(spark: SparkSession, folder: str, limit: int | None = None, below: str | None = None) -> DataFrame:
    """path, content, length of files below a folder with a known suffix, in the order of their paths whatever their case.

    Lock files (~$...) and what lies under ``below``, the output folder, are left out. ``limit`` is the wanted number of files.
    """
    known = [*TEXT_SUFFIXES, *RTF_SUFFIXES, *DOCX_SUFFIXES, *JSON_SUFFIXES, *OUTSIDE_SUFFIXES]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    files = files.where(suffix.isin(known) & ~F.col("path").rlike(r"/~\$[^/]*$"))
    if below:
        files = files.where(~F.contains("path", F.lit(below.rstrip("/") + "/")))
    files = files.select("path", "content", "length")
    return files if limit is None else files.orderBy(F.lower("path"), "path").limit(limit)


def _docx(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")

    def words(node) -> str:
        return "".join({"t": n.text or "", "tab": "\t", "br": "\n"}.get(n.tag.removeprefix(_WORD), "") for n in node.iter())

    out = []
    for part in body if body is not None else []:
        if part.tag == f"{_WORD}p":
            out.append(words(part))
        elif part.tag == f"{_WORD}tbl":
            for row in part.iter(f"{_WORD}tr"):
                cells = [" ".join(words(cell).split()) for cell in row.iter(f"{_WORD}tc")]
                if any(cells):
                    out.append(" | ".join(cells))
    return "\n".join(out)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def _read_docx(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for raw in part:
            try:
                rows.append((None if raw is None else _docx(bytes(raw)), None))
            except Exception as ex:  # noqa: BLE001 - any broken file is a row of its own
                rows.append((None, f"{type(ex).__name__}: {ex}"))
        yield pd.DataFrame(rows, columns=["text", "error"])


def read_documents(files: DataFrame) -> DataFrame:
    """path, method, text, status, error of files (path, content); what cannot be read is failed with a reason, never an exception."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    method = F.when(suffix.isin(TEXT_SUFFIXES), "text").when(suffix.isin(RTF_SUFFIXES), "rtf").when(suffix.isin(DOCX_SUFFIXES), "docx").when(suffix.isin(JSON_SUFFIXES), "json").when(suffix.isin(OUTSIDE_SUFFIXES), "outside").otherwise("unsupported")
    rows = files.withColumn("method", method)
    plain = rows.where("method in ('text', 'json', 'rtf')").withColumn("text", text.decoded("content"))
    plain = plain.select("path", "method", F.when(F.col("method") == "rtf", text.rtf_text(F.col("text"))).otherwise(F.col("text")).alias("text"), F.lit(None).cast("string").alias("error"))
    word = rows.where("method = 'docx'").withColumn("r", _read_docx("content")).select("path", "method", "r.text", "r.error")
    other = rows.where("method in ('outside', 'unsupported')").select("path", "method", F.lit(None).cast("string").alias("text"), F.when(F.col("method") == "outside", "needs an outside program").otherwise("unsupported format").alias("error"))
    every = plain.unionByName(word).unionByName(other)
    return every.withColumn("status", F.when(F.col("error").isNull() & F.col("text").isNotNull(), "read").otherwise("failed"))


def json_rows(value: Column) -> Column:
    """array<struct(path, text)> of a text that is wholly a JSON object, in the order of its leaves; null for any other text."""
    kind = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType())]))

    @F.pandas_udf(kind)
    def rows(part: pd.Series) -> pd.Series:
        def label(key: str) -> str:
            return re.sub(r"[_-]+", " ", key).strip().title()

        def walk(node, path: str, name: str) -> list[tuple[str, str]]:
            if isinstance(node, dict):
                return [x for k, v in node.items() for x in walk(v, f"{path}.{k}", label(str(k)))]
            if isinstance(node, list):
                return [x for k, v in enumerate(node) for x in walk(v, f"{path}[{k}]", name)]
            shown = "" if node is None else ("Yes" if node else "No") if isinstance(node, bool) else str(node)
            return [(path, f"{name}: {shown}" if name else shown)] if shown else []

        def read(t):
            try:
                top = json.loads(t)
            except (TypeError, ValueError):
                return None
            return walk(top, "$", "") if isinstance(top, dict) else None

        return pd.Series([read(t) for t in part], dtype=object)

    return rows(value)


def write_artifacts(artifacts: dict[str, DataFrame], folder: str, as_json: bool = False) -> None:
    """Every artifact as a Parquet table under its name, and as JSON lines if wanted."""
    for name, frame in artifacts.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        if as_json:
            frame.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{folder}/{name}.json")


def list_artifacts(spark: SparkSession, folder: str) -> list[str]:
    """The names of the artifacts in a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName().removesuffix(".parquet") for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet")) if fs.exists(path) else []


def read_artifact(spark: SparkSession, folder: str, name: str, without: tuple[str, ...] = ("embedding", "features")) -> DataFrame:
    """An artifact without its long vectors."""
    return spark.read.parquet(f"{folder}/{name}.parquet").drop(*without)


def write_report(scores: DataFrame, folder: str) -> str:
    """Scores as CSV with a header; returns them as a Markdown table (scores has one row for each section)."""
    scores.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{folder}/scores.csv")
    rows = [scores.columns, ["---"] * len(scores.columns), *[["" if v is None else str(v) for v in r] for r in scores.orderBy(scores.columns[0]).limit(1_000).collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
