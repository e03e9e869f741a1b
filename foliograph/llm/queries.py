"""The queries of the problems on text, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import encode, mixture, pieces, private, same_looks, scans, spellings, titles


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return same_looks.all_texts(table(spark, folder, "raw_text"), table(spark, folder, "semantic_blocks"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_looks.found(_texts(spark, folder)).distinct()


def p1_one_form(spark: SparkSession, folder: str) -> DataFrame:
    return same_looks.with_one_form(_texts(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.found(table(spark, folder, "semantic_blocks"))


def p3_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return scans.Scans(table(spark, folder, "semantic_blocks")).paragraphs()


def p3_raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The raw texts of scanned uploads as repaired paragraphs, without margins."""
    return scans.raw_repaired(table(spark, folder, "raw_text"), table(spark, folder, "semantic_blocks"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return spellings.found(table(spark, folder, "semantic_blocks"), table(spark, folder, "relationships"))


def p4_organisations(spark: SparkSession, folder: str) -> DataFrame:
    """Each name with the key of its organisation and how often it was typed."""
    return spellings.organisations(spellings.spelled_names(table(spark, folder, "semantic_blocks"), table(spark, folder, "relationships")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return titles.found(table(spark, folder, "semantic_blocks"), table(spark, folder, "job_titles"))


def p5_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    return titles.unmatched(table(spark, folder, "semantic_blocks"), table(spark, folder, "job_titles"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    raw, blocks = table(spark, folder, "raw_text"), table(spark, folder, "semantic_blocks")
    return private.found(_texts(spark, folder), private.learned_names(raw, blocks))


def p6_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with a typed placeholder for each piece of personal information."""
    raw, blocks = table(spark, folder, "raw_text"), table(spark, folder, "semantic_blocks")
    return private.replaced(_texts(spark, folder), private.learned_names(raw, blocks))


def p6_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """The surrogate of every distinct piece of personal information; no two of one kind are equal."""
    raw, blocks = table(spark, folder, "raw_text"), table(spark, folder, "semantic_blocks")
    return private.surrogates(private.mentions(_texts(spark, folder), private.learned_names(raw, blocks)))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encoded(table(spark, folder, "documents"))


def p7_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that the ids of all documents stand for; null and empty texts come back empty."""
    return encode.decoded(p7_ids(spark, folder))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(mixture.sized(table(spark, folder, "documents")), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    sizes, targets = mixture.sized(table(spark, folder, "documents")), table(spark, folder, "mix_targets")
    return mixture.shares(sizes, targets, mixture.mix(sizes, targets))


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split_all(table(spark, folder, "documents"), table(spark, folder, "split_limits"))


def p9_summary(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.summary(p9_pieces(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_one_form, p3_found, p3_paragraphs, p3_raw_lines, p4_found, p4_organisations, p5_found, p5_unmatched, p6_found, p6_text, p6_surrogates, p7_ids, p7_texts, p8_mix, p8_shares, p9_pieces, p9_summary)}


def oracle_sql() -> dict[str, str]:
    return {}
