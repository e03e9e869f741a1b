"""Problem 6: personal information in free text, found and replaced.

Texts are searched where they lie, without a shuffle (``personal.entities``).
The model for family names is fitted on all candidates' names, all values of
the columns with other words and the words of all lines, which are counted in
Spark: the driver gets 8 bytes of each labelled word and the counts of
beginnings and endings.

For replacing, each distinct piece gets a keyed surrogate of its kind, format,
gender and script, so mentions of one person or number agree everywhere.
Surrogates that collide are made anew with another salt, round by round, until
all of a kind are distinct. Of names not the whole but each part has its
surrogate, so a family name keeps it whatever stands beside it. Texts without personal information come out
unchanged; a null or empty text has none.
"""

from __future__ import annotations

import os
import re
import secrets
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut
from . import forms, personal, same_looks

#: A word in so many lines at least, and in SHARE of all, is a common word and no family name, unless a candidate has it.
COMMON = 8
#: What so many distinct candidates' names begin with at least, and SHARE of all, is a given name.
GIVEN = 2
SHARE = 0.0004
KEY_SETTING = "spark.foliograph.surrogate.key"
#: After so many rounds of making colliding surrogates anew it is an error that some are left.
ROUNDS = 50
#: Every text with personal information matches: a capital, a digit, '@', a sign outside of ASCII, or an 'at' in brackets.
ROUGH = r"[\p{Lu}\d@]|[^\x00-\x7f]|[(\[{][\x00-\x20\x7f]*at[\x00-\x20\x7f]*[)\]}]"
#: Personal information stands within one line.
LINE_ENDS = r"[\n\r\f]"
_PIECES = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType())]))


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", forms.canonical(text) or "")


def _bare_words(text: str) -> list[str]:
    return list({personal.bare(w) for w in _words(text)})


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words_of(texts: pd.Series) -> pd.Series:
    return pd.Series([_bare_words(t) for t in texts], dtype=object)


#: For Java: what _words finds in stable text after ``personal.bare``.
JAVA_WORD = r"[\p{L}\p{Nl}\p{No}]++(?:['-][\p{L}\p{Nl}\p{No}]++)*+"


def words_of_lines(lines: DataFrame) -> DataFrame:
    """word of each line (text), once for each line that has it, in its one form without case and accents.

    Stable texts never leave the JVM, but for those with a capital that small letters write with two characters.
    """
    # in small letters first, as that is quicker and leaves the ends of words where they are
    plain = F.translate(F.replace(F.lower("text"), F.lit("ß"), F.lit("ss")), "’" + "".join(map(chr, personal.names._ACCENTS)), "'" + "".join(personal.names._ACCENTS.values()))
    rough = same_looks.unstable(F.col("text")) | F.col("text").contains("İ")
    of_stable = lines.where(~rough).select(F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(JAVA_WORD), F.lit(0)))).alias("word"))
    return of_stable.unionByName(lines.where(rough).select(F.explode(_words_of("text")).alias("word")))


@F.pandas_udf(T.StructType([T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), T.StructField("long", T.BooleanType())]))
def _person(named: pd.Series) -> pd.DataFrame:
    """Given and family name of each name of two words, and whether the family name has more than two letters; nulls for others."""
    out = []
    for name in named:
        parts = _words(name)
        if len(parts) == 2 and min(map(len, parts)) > 1:
            first, last = parts[::-1] if "," in name else parts
            out.append((personal.bare(first), personal.bare(last), len(last) > 2))
        else:
            out.append((None, None, None))
    return pd.DataFrame(out, columns=["first", "last", "long"])


@F.pandas_udf(T.StructType([T.StructField("hash", T.LongType()), T.StructField("parts", T.ArrayType(T.StringType()))]))
def _features(words: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"hash": [personal.word_hash(w) for w in words], "parts": [personal.FamilyNames.parts(w) for w in words]})


def labelled_words(raw_text: DataFrame, blocks: DataFrame) -> tuple[DataFrame, list[str]]:
    """word, family of each distinct word with a label, and the given names of candidates, from all rows: family names are those of candidates, others are words of firms, titles and places and common words."""
    named = raw_text.where("candidate_name is not null").select("candidate_name").distinct()
    people = named.select(_person("candidate_name").alias("p")).select("p.*").where("last is not null")
    firsts = people.groupBy("first").agg(F.count("*").alias("n"))
    given = sorted(r["first"] for r in firsts.where(F.col("n") >= max(GIVEN, SHARE * people.count())).collect())

    families = people.groupBy(F.col("last").alias("word")).agg(F.max("long").alias("long"))
    lines = blocks.where("text is not null").select("text")
    common = words_of_lines(lines).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= max(COMMON, SHARE * lines.count()))
    values = blocks.select(F.explode(F.array("entities.company", "entities.designation", "entities.location")).alias("v")).where("v is not null").distinct()
    other = values.select(F.explode(_words_of("v")).alias("word")).union(common.select("word")).distinct()
    other = other.where((F.length("word") > 2) & ~F.col("word").isin(sorted(personal.names.GIVEN | set(personal.names.NICKNAMES) | set(given))))
    other = other.join(families, "word", "left_anti")
    return families.where("long").select("word", F.lit(True).alias("family")).unionByName(other.select("word", F.lit(False).alias("family"))), given


def learned_names(raw_text: DataFrame, blocks: DataFrame) -> personal.FamilyNames:
    """The model for family names, fitted on all rows of both tables."""
    words, given = labelled_words(raw_text, blocks)
    labelled = cut(words.select("family", _features("word").alias("f")).select("family", "f.*"))
    hashes = {family: personal.Words(labelled.where(F.col("family") == family).select("hash").toArrow()["hash"].to_numpy()) for family in (True, False)}
    parts = labelled.select("family", F.explode("parts").alias("part")).groupBy("part").agg(F.count_if("family").alias("yes"), F.count_if(~F.col("family")).alias("no"))
    return personal.FamilyNames.counted(hashes[True], hashes[False], map(tuple, parts.collect()), given)


def _pieces_of(model: personal.FamilyNames):
    @F.pandas_udf(_PIECES)
    def pieces(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([[tuple(f) for f in found] if t and (found := personal.entities(t, model)) else None for t in part], dtype=object)

    return pieces


def _lines(texts: DataFrame) -> DataFrame:
    """src, id, nth, line, and k1, k2 (128 bits of hash of the line) of each line that may hold personal information."""
    rough = texts.where("text is not null").select("src", "id", F.posexplode(F.split("text", LINE_ENDS)).alias("nth", "line"))
    # other lines never leave the JVM
    return rough.where(F.col("line").rlike(ROUGH)).withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(1), "line")})


def _of_distinct_lines(lines: DataFrame, model: personal.FamilyNames) -> DataFrame:
    """k1, k2, pieces of the distinct lines with personal information: what stands in many texts is searched once."""
    pieces = lines.groupBy("k1", "k2").agg(F.first("line").alias("line")).select("k1", "k2", _pieces_of(model)("line").alias("pieces"))
    return pieces.where(F.size("pieces") > 0)


def mentions(texts: DataFrame, model: personal.FamilyNames) -> DataFrame:
    """src, id, nth, kind, start, end, value of each piece of personal information: nth is its line, start and end count within it; value is in its one form."""
    lines = _lines(texts)
    there = lines.select("src", "id", "nth", "k1", "k2").join(_of_distinct_lines(lines, model), ["k1", "k2"])
    return there.select("src", "id", "nth", F.explode("pieces").alias("p")).select("src", "id", "nth", "p.kind", "p.start", "p.end", "p.value")


def found(texts: DataFrame, model: personal.FamilyNames) -> DataFrame:
    """src, id, kind of each kind of personal information in a text."""
    lines = _lines(texts)
    kinds = _of_distinct_lines(lines, model).select("k1", "k2", F.array_distinct(F.transform("pieces", lambda p: p["kind"])).alias("kinds"))
    there = lines.select("src", "id", "k1", "k2").join(kinds, ["k1", "k2"])
    return there.select("src", "id", F.explode("kinds").alias("kind")).distinct()


def _apart(values: DataFrame, make, by: list[str], same: str) -> DataFrame:
    """values with a column surrogate: made with a salt, and anew with another where values with another ``same`` have an equal one."""
    values = cut(values.withColumn("salt", F.lit(0)).withColumn("surrogate", make(F.col("salt"))))
    clash = Window.partitionBy(*by, F.lower("surrogate")).orderBy(same)
    for _ in range(ROUNDS):
        if values.groupBy(*by, F.lower("surrogate")).agg(F.count_distinct(same).alias("n")).where("n > 1").isEmpty():
            return values.drop("salt")
        ranked = values.withColumn("rank", F.dense_rank().over(clash))
        again = ranked.withColumn("salt", F.when(F.col("rank") > 1, F.col("salt") + F.col("rank") - 1).otherwise(F.col("salt")))
        values = cut(again.withColumn("surrogate", F.when(F.col("rank") > 1, make(F.col("salt"))).otherwise(F.col("surrogate"))).drop("rank"))
    raise RuntimeError(f"after {ROUNDS} rounds there are still equal surrogates")


def secret_key(spark: SparkSession, key: str | None = None) -> str:
    """The key of surrogates: the one given, or the setting ``spark.foliograph.surrogate.key``, or FOLIOGRAPH_SURROGATE_KEY.

    Where none is set, one is drawn for the session: then nobody can rebuild the mapping, and another session has other surrogates.
    """
    key = key or spark.conf.get(KEY_SETTING, None) or os.environ.get("FOLIOGRAPH_SURROGATE_KEY")
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def surrogates(mentioned: DataFrame, key: str | None = None) -> DataFrame:
    """kind, value, surrogate of each distinct value; within a kind distinct values have distinct surrogates.

    Values that are the same but for case, accents and signs between letters and digits count as one. Names are only found in Latin
    letters, so surrogates have these. For ``key`` see ``secret_key``.
    """
    key = secret_key(mentioned.sparkSession, key)

    @F.pandas_udf("string")
    def make(kind: pd.Series, value: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([personal.surrogate(k, v, key.encode(), int(s)) for k, v, s in zip(kind, value, salt)], dtype=object)

    @F.pandas_udf("string")
    def coin(part: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([personal.coined(p, key.encode(), int(s)) for p, s in zip(part, salt)], dtype=object)

    @F.pandas_udf("array<string>")
    def parts_of(value: pd.Series) -> pd.Series:
        return pd.Series([personal.coined_parts(v) for v in value], dtype=object)

    @F.pandas_udf("string")
    def put(value: pd.Series, parts: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([personal.name_surrogate(v, key.encode(), dict(zip(p, w))) for v, p, w in zip(value, parts, words)], dtype=object)

    @F.pandas_udf("string")
    def reference(kind: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([personal.reference_form(k, v) for k, v in zip(kind, value)], dtype=object)

    values = cut(mentioned.select("kind", "value").distinct())
    others = _apart(values.where("kind <> 'name'").withColumn("same", reference("kind", "value")), lambda salt: make("kind", "value", salt), ["kind"], "same")
    # names by their parts: parts have distinct surrogates, so names have
    names = values.where("kind = 'name'").withColumn("parts", parts_of("value"))
    words = _apart(names.select(F.explode("parts").alias("part")).distinct(), lambda salt: coin("part", salt), [], "part")
    pairs = names.select("value", F.explode_outer("parts").alias("part")).join(words, "part", "left")
    of_name = pairs.groupBy("value").agg(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("part", "surrogate"))).alias("p"))
    named = of_name.select(F.lit("name").alias("kind"), "value", put("value", F.col("p.part"), F.col("p.surrogate")).alias("surrogate"))
    return others.select("kind", "value", "surrogate").unionByName(named)


def _spliced(text: str, pieces: list) -> str:
    """The text with each piece, given by its line and its place in it, replaced by its placeholder."""
    starts = [0, *(m.end() for m in re.finditer(LINE_ENDS, text))]
    return forms.splice(text, [(starts[x["nth"]] + x["start"], starts[x["nth"]] + x["end"], f"[{x['kind'].upper()} {x['surrogate']}]") for x in pieces])


def replaced(texts: DataFrame, model: personal.FamilyNames, key: str | None = None) -> DataFrame:
    """src, id, text of every text, with ``[KIND surrogate]`` in the place of each piece of personal information."""
    mentioned = cut(mentions(texts, model))
    there = mentioned.join(surrogates(mentioned, key), ["kind", "value"])
    of_text = there.groupBy("src", "id").agg(F.sort_array(F.collect_list(F.struct("nth", "start", "end", "kind", "surrogate"))).alias("pieces"))

    @F.pandas_udf("string")
    def splice(text: pd.Series, pieces: pd.Series) -> pd.Series:
        return pd.Series([t if p is None else _spliced(t, p) for t, p in zip(text, pieces)], dtype=object)

    whole = texts.join(of_text, ["src", "id"], "left")
    return whole.select("src", "id", F.when(F.col("pieces").isNull(), F.col("text")).otherwise(splice(F.when(F.col("pieces").isNotNull(), F.col("text")), "pieces")).alias("text"))
