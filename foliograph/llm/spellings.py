"""Problem 4: spellings of one organisation, linked.

Distinct names are read once (``names.read``: first name, name proper, line).
A symmetric-delete index on the words of the name proper - equal keys, never a
cross join - finds readings within one edit; the best assignment of their words
confirms them, and a rarer reading goes to its most widespread neighbour. Then
initials, nicknames and missing parts are settled within the readings of one
name, and a name without line of business goes to the only organisation it
fits. What is left of a name is a key; names of one key are one organisation.

Only distinct names and readings are shuffled, never rows of the tables, and
the number of rows that share a name is of no matter. Null and blank names and
names without a word are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut
from . import names

#: Names of one organisation beyond this number are paired in parts, so that a hot organisation is spread over tasks.
PART = 5_000


# types as objects: workers import this module and have no JVM to parse them
_READING = T.StructType([T.StructField(c, T.StringType()) for c in ("core", "line", "first")])
_MEANS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("first", "means")]))


@F.pandas_udf(_READING)
def _read(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = [names.read(v) for v in part]
        yield pd.DataFrame([(" ".join(r.core), r.line, r.first) if r else (None, None, None) for r in rows], columns=["core", "line", "first"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _deletes(words: pd.Series) -> pd.Series:
    return words.map(lambda w: sorted(names.deletes(w)) if len(w) > 3 else [w])


@F.pandas_udf(T.IntegerType())
def _align(core_a: pd.Series, line_a: pd.Series, first_a: pd.Series, core_b: pd.Series, line_b: pd.Series, first_b: pd.Series) -> pd.Series:
    out = [names.align(names.Reading(tuple(a.split()), b, c), names.Reading(tuple(d.split()), e, f)) for a, b, c, d, e, f in zip(core_a, line_a, first_a, core_b, line_b, first_b)]
    return pd.Series(out, dtype="Int32")


def settle_firsts(firsts: list[str]) -> list[str]:
    """Of the first names that stand before one name: for each the one it means, itself if that is open."""
    unique = sorted(set(firsts))
    whole = [f for f in unique if len(f) > 1 and f not in names.NICKNAMES]
    means: dict[str, str] = {f: f for f in whole}
    for f in unique:
        if f in names.NICKNAMES:
            fits = [w for w in whole if names.same_first(f, w)]
            means[f] = fits[0] if len(fits) == 1 else f if fits else names.NICKNAMES[f].split()[0]
    known = sorted(set(means.values()))
    for f in unique:
        if len(f) == 1:
            fits = [w for w in known if names.same_first(f, w)]
            means[f] = fits[0] if len(fits) == 1 else f
    if "" in unique:
        known = sorted({means[f] for f in unique if f})
        means[""] = known[0] if len(known) == 1 else ""
    return [means[f] for f in firsts]


@F.pandas_udf(_MEANS)
def _settle(groups: pd.Series) -> pd.Series:
    return groups.map(lambda fs: [{"first": a, "means": b} for a, b in zip(fs, settle_firsts(list(fs)))])


def _near(a: DataFrame, b: DataFrame, with_line: bool) -> DataFrame:
    """Pairs of readings of a and b that share a key of the symmetric-delete index and that the assignment confirms."""

    def keyed(frame: DataFrame, name: str) -> DataFrame:
        words = frame.withColumn("word", F.explode(F.split("core", " ")))
        keys = words.withColumn("key", F.explode(_deletes("word")))
        if with_line:
            keys = keys.withColumn("key", F.concat_ws("#", "line", "key"))
        return keys.select("key", *[F.col(c).alias(f"{c}_{name}") for c in ("core", "line", "first", "spellings", "n")]).distinct()

    pairs = keyed(a, "a").join(keyed(b, "b").hint("merge"), "key").drop("key").where("core_a <> core_b").distinct()
    return pairs.withColumn("edits", _align("core_a", "line_a", "first_a", "core_b", "line_b", "first_b")).where("edits is not null")


def _last(to: DataFrame) -> DataFrame:
    """core, line, to: a misspelling may be of a misspelling, so steps are followed to their end, twice as far in each round.

    Each step leads to a more widespread name, so there is an end.
    """
    while True:
        further = to.select(F.col("core").alias("to"), "line", F.col("to").alias("further"))
        jumped = cut(to.join(further.hint("merge"), ["to", "line"], "left"))
        to = jumped.select("core", "line", F.coalesce("further", "to").alias("to"))
        if jumped.where("further is not null").isEmpty():
            return to


def organisations(spelled: DataFrame) -> DataFrame:
    """name, organisation of each distinct ``name`` (columns name, n) that has a word; the key tells organisations apart."""
    read = spelled.withColumn("r", _read("name")).where("r.core is not null").select("name", "n", "r.core", "r.line", "r.first")
    read = cut(read)  # read by several joins below
    readings = cut(read.groupBy("core", "line", "first").agg(F.count("*").alias("spellings"), F.sum("n").alias("n")))

    # misspellings: to the most widespread reading within one edit of each word, and on to that one's
    named = readings.where("line <> ''")
    rank = lambda x: F.struct(F.col(f"spellings_{x}"), F.col(f"n_{x}"), F.col(f"core_{x}"))
    # how widespread a name proper is counts over all its readings: so steps between names always lead upwards and can't go round
    of_name = Window.partitionBy("core", "line")
    ranked = cut(named.withColumns({"spellings": F.sum("spellings").over(of_name), "n": F.sum("n").over(of_name)}))
    better = _near(ranked, ranked, True).where(rank("b") > rank("a"))
    to = cut(better.groupBy(F.col("core_a").alias("core"), F.col("line_a").alias("line")).agg(F.max_by("core_b", rank("b")).alias("to")))
    usual = named.join(_last(to).hint("merge"), ["core", "line"], "left").withColumn("usual", F.coalesce("to", "core")).drop("to")

    # first names, initials and nicknames before one name of one line
    firsts = usual.groupBy("usual", "line").agg(F.collect_set("first").alias("firsts"))
    means = firsts.select("usual", "line", F.explode(_settle("firsts")).alias("m")).select("usual", "line", "m.first", "m.means")
    placed = cut(usual.join(means.hint("merge"), ["usual", "line", "first"]).select("core", "line", "first", "usual", "means", "spellings", "n"))
    key = F.concat_ws("|", "usual", "line", "means")

    # names without line of business: to the only organisation they fit, by the same word or else by one within an edit
    bare = readings.where("line = ''")
    there = placed.groupBy("usual", "line", "means").agg(F.sum("spellings").alias("spellings"), F.sum("n").alias("n")).select(F.col("usual").alias("core"), "line", F.col("means").alias("first"), "spellings", "n")
    alike = bare.alias("x").join(placed.alias("y"), "core").select("core", F.col("x.first").alias("first"), F.concat_ws("|", "y.usual", "y.line", "y.means").alias("fit"), F.lit(0).alias("edits"))
    close = _near(bare, there, False).select(F.col("core_a").alias("core"), F.col("first_a").alias("first"), F.concat_ws("|", "core_b", "line_b", "first_b").alias("fit"), "edits")
    fits = alike.unionByName(close).distinct()
    least = Window.partitionBy("core", "first")
    fits = fits.withColumn("least", F.min("edits").over(least)).where("edits = least")
    only = fits.groupBy("core", "first").agg(F.count_distinct("fit").alias("fits"), F.min("fit").alias("fit"))
    own = F.concat_ws("|", "core", F.lit(""), "first")
    bare_keys = bare.join(only, ["core", "first"], "left").select("core", "line", "first", F.when(F.col("fits") == 1, F.col("fit")).when(F.col("fits").isNull(), own).alias("organisation")).where("organisation is not null")

    keys = placed.select("core", "line", "first", key.alias("organisation")).unionByName(bare_keys)
    return read.join(keys.hint("merge"), ["core", "line", "first"]).select("name", "organisation", "n")


def spelled_names(blocks: DataFrame, relationships: DataFrame) -> DataFrame:
    """name, n of every distinct value of both tables that names an organisation."""
    typed = blocks.select(F.col("entities.company").alias("name")).unionByName(
        relationships.where(F.col("relationship").isin("WORKED_AT", "AWARDED_BY")).select(F.col("target_label").alias("name"))
    )
    return typed.where("name is not null").groupBy("name").agg(F.count("*").alias("n"))


def found(blocks: DataFrame, relationships: DataFrame) -> DataFrame:
    """Each pair of different values for the same organisation."""
    return pairs(organisations(spelled_names(blocks, relationships)))


def pairs(named: DataFrame, part: int = PART) -> DataFrame:
    """name_a, name_b of each pair of names (columns name, organisation) of one organisation.

    A hot organisation's names fall into parts: each pair is made in the part of its first name, so no task holds all of them.
    """
    named = cut(named.select("name", "organisation").distinct())
    parts = named.groupBy("organisation").agg((1 + F.floor(F.count("*") / part)).cast("int").alias("parts"))
    split = named.join(parts.hint("merge"), "organisation")
    a = split.select("organisation", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"), F.col("name").alias("name_a"))
    b = split.select("organisation", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("name").alias("name_b"))
    # strings compare by their bytes, which in UTF-8 is by code points
    return a.join(b.hint("merge"), ["organisation", "part"]).where("name_a < name_b").select("name_a", "name_b")
