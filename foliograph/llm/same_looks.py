"""Problem 1: texts that look the same, in one form.

Stable texts never leave the JVM: a quick check against the spans of stable
characters (``forms.JAVA_NOT_SURELY_STABLE``), which follow from Unicode's
quick-check and decomposition properties, tells them from the few that may
hold an unstable character. Only those go to Python, where
the unstable segments are normalized with their boundary context and spliced
into the otherwise unchanged text. No row is shuffled.

Nulls: a null text stays null and is no case. An empty text stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import forms


@F.pandas_udf(T.StringType())
def _unify(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(forms.canonical, na_action="ignore") if part.notna().any() else part


@F.pandas_udf(T.BooleanType())
def _differs(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(lambda t: bool(forms.segments(t)), na_action="ignore").astype("boolean")


def unstable(text: Column) -> Column:
    """Whether a text may hold a character that has another usual spelling."""
    return text.rlike(forms.JAVA_NOT_SURELY_STABLE)


def one_form(text: Column) -> Column:
    """The one form of a text column. Python sees only the unstable texts; for the others it gets a null."""
    rough = unstable(text)
    return F.when(rough, _unify(F.when(rough, text))).otherwise(text)


def with_one_form(frame: DataFrame, column: str = "text", to: str = "text") -> DataFrame:
    """``frame`` with ``column`` in its one form as ``to``; other columns, whatever their names, stay as they are."""
    return frame.withColumn(to, one_form(F.col(f"`{column}`")))


def in_one_form(frame: DataFrame, column: str = "text") -> DataFrame:
    """As ``with_one_form``, but rows with a stable text are not even handed through Python: two branches of one scan."""
    rough = F.coalesce(unstable(F.col(f"`{column}`")), F.lit(False))
    return frame.where(~rough).unionByName(frame.where(rough).withColumn(column, _unify(F.col(f"`{column}`"))))


def found(texts: DataFrame) -> DataFrame:
    """Of ``texts`` (src, id, text): src and id of each text that its one form differs from."""
    rough = texts.where(unstable(F.col("text")))
    return rough.where(_differs("text")).select("src", "id")


def all_texts(raw_text: DataFrame, blocks: DataFrame) -> DataFrame:
    """src, id, text of both tables that hold texts of résumés."""
    return raw_text.select(F.lit("raw_text").alias("src"), F.col("upload_id").alias("id"), F.col("raw_text").alias("text")).unionByName(
        blocks.select(F.lit("semantic_blocks").alias("src"), F.col("block_id").alias("id"), "text")
    )
