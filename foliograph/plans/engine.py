"""From raw texts to all artifacts: a library entry, folders, evaluation.

Tables that are read more than once are cut while the artifacts are built, so building them runs jobs; the rest runs with an action.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, classify, context, evaluation, graph, lines, mentions, records, sectioning, vectors
from ..sources import documents
from .lineage import cut


@dataclass(frozen=True)
class Artifacts:
    """The artifacts of a corpus of texts, each keyed by upload_id."""

    lines: DataFrame
    sentences: DataFrame
    blocks: DataFrame
    decisions: DataFrame
    entities: DataFrame
    relations: DataFrame
    similar_pairs: DataFrame
    clusters: DataFrame
    rows: DataFrame
    records: DataFrame
    edges: DataFrame
    violations: DataFrame
    assignments: DataFrame
    summary: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


class Engine:
    """Pipelines over one session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def run(self, raw_text: DataFrame, fuzzy_headings: bool = True, stage: Callable[[str], None] | None = None) -> Artifacts:
        """Artifacts of ``raw_text`` (upload_id, raw_text, and candidate_name if known). Edges of graphs come from records only, never from candidates of relations.

        ``stage`` is called with the name of each stage as it begins.
        """
        say = stage or (lambda name: None)
        say("lines")
        sectioned = cut(lines.with_sections(lines.split_lines(raw_text), fuzzy=fuzzy_headings))
        say("sentences")
        sentences = cut(lines.split_sentences(sectioned))
        say("blocks")
        joined = context.joins(context.sentence_lines(sentences))
        blocks = cut(context.blocks(joined))
        sentence_blocks = blocks.select(lines.KEY, F.explode("sentence_indices").alias("sentence_index"), "block")
        say("mentions")
        found = cut(mentions.all_mentions(sentences))
        entities = cut(mentions.entities(found, sentence_blocks))
        weights = vectors.tf_idf(entities.select(lines.KEY, "entity", F.concat_ws(" ", "text", "type").alias("t")), lines.KEY, "entity", "t")
        say("similarity")
        pairs = cut(vectors.sparse_cosine(weights, lines.KEY, "entity"))
        name = lambda c: F.concat_ws("#", F.col(lines.KEY).cast("string"), F.col(c).cast("string"))
        nodes = entities.select(lines.KEY, name("entity").alias("node"))
        clusters = vectors.density_clusters(pairs.select(name("i").alias("i"), name("j").alias("j"), "similarity"), nodes, lines.KEY)
        clusters = clusters.select(lines.KEY, F.substring_index("node", "#", -1).cast("int").alias("entity"), "label")
        say("records")
        rows = classify.as_blocks(sectioned)
        record = cut(records.canonical(rows))
        stated = raw_text.select(lines.KEY, "candidate_name") if "candidate_name" in raw_text.columns else sectioning.identity(sectioned).select(lines.KEY, F.col("name").alias("candidate_name"))
        say("graph")
        edges = graph.edges_of_records(record, stated)
        say("audit")
        assigned = audit.assignments(sectioned, context.line_blocks(blocks))
        return Artifacts(
            sectioned, sentences, blocks, context.decisions(joined), entities, mentions.relations(found, sentences), vectors.top_pairs(pairs, lines.KEY),
            clusters, rows, record, edges, records.violations(rows), assigned, audit.summary(assigned),
        )

    def process_text(self, text: str, upload_id: int = 0) -> Artifacts:
        """Artifacts of one text."""
        return self.run(self.spark.createDataFrame([(upload_id, text)], "upload_id bigint, raw_text string"))

    def ingest(self, folder: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Documents read from a folder as (upload_id, path, raw_text), and the files that failed with their reasons."""
        read = cut(documents.read_documents(documents.list_files(self.spark, folder, limit)))
        return read.where("status = 'read'").select(F.xxhash64("path").alias("upload_id"), "path", F.col("text").alias("raw_text")), read.where("status = 'failed'").select("path", "method", "error")

    def graph(self, blocks: DataFrame, raw_text: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
        """Edges of the canonical records of classified rows, and what is wrong with the records; ``strict`` raises if anything is."""
        wrong = records.violations(blocks)
        if strict and not wrong.isEmpty():
            raise ValueError(f"records break the rules: {wrong.groupBy('rule').count().limit(20).collect()}")
        return graph.edges_of_records(records.canonical(blocks), raw_text), wrong

    def evaluate(self, predicted: DataFrame, truth: DataFrame, report: str | None = None) -> DataFrame:
        """Scores by section with an overall row; written to ``report`` if given."""
        scored = evaluation.with_overall(predicted, truth)
        if report:
            documents.write_report(scored, report)
        return scored
