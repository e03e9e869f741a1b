"""Scoring extracted records against reference records.

Both sides are leaves: doc, section, path, value, anchor (the record a value
belongs to). Scores are multiset counts by one full join on the normalised
value; nothing is matched across documents.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def leaves(frame: DataFrame, doc: str, section: str, anchor: Column, **values: Column) -> DataFrame:
    """doc, section, path, value, norm, anchor: one row for each non-empty value; ``values`` by path."""
    listed = F.array(*[F.struct(F.lit(path).alias("path"), column.cast("string").alias("value")) for path, column in sorted(values.items())])
    rows = frame.select(F.col(doc).alias("doc"), F.lit(section).alias("section"), F.coalesce(anchor, F.lit("")).alias("anchor"), F.explode(listed).alias("v"))
    return rows.select("doc", "section", "v.path", "v.value", text.word_key(F.col("v.value")).alias("norm"), text.word_key(F.col("anchor")).alias("anchor")).where("norm <> ''")


def counts(predicted: DataFrame, truth: DataFrame, *by: str) -> DataFrame:
    """by..., true_positive, false_positive, false_negative over equal (doc, section, norm, anchor) with multiplicity."""
    key = ["doc", "section", "norm", "anchor"]
    p = predicted.groupBy(*key).agg(F.count("*").alias("p"))
    t = truth.groupBy(*key).agg(F.count("*").alias("t"))
    both = p.join(t, key, "full").fillna(0, ["p", "t"])
    return both.groupBy(*by).agg(
        F.sum(F.least("p", "t")).alias("true_positive"), F.sum(F.greatest(F.col("p") - F.col("t"), F.lit(0))).alias("false_positive"), F.sum(F.greatest(F.col("t") - F.col("p"), F.lit(0))).alias("false_negative")
    )


def scores(counted: DataFrame) -> DataFrame:
    """counted with precision, recall and f1 to four places, and a state where there is no reference."""
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    f1 = F.try_divide(2 * tp, 2 * tp + fp + fn)
    state = F.when(tp + fn == 0, "no_reference_items").otherwise("scored")
    return counted.withColumns({"precision": F.round(precision, 4), "recall": F.round(recall, 4), "f1": F.round(f1, 4), "state": state})


def with_overall(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """section (Overall for all of them together) with counts and scores: micro averages."""
    key = ["doc", "section", "norm", "anchor"]
    p = predicted.groupBy(*key).agg(F.count("*").alias("p"))
    t = truth.groupBy(*key).agg(F.count("*").alias("t"))
    both = p.join(t, key, "full").fillna(0, ["p", "t"])
    # a document without reference says nothing of quality, so it has no part in the totals
    rolled = both.join(truth.select("doc").distinct(), "doc", "left_semi").rollup("section").agg(
        F.sum(F.least("p", "t")).alias("true_positive"), F.sum(F.greatest(F.col("p") - F.col("t"), F.lit(0))).alias("false_positive"), F.sum(F.greatest(F.col("t") - F.col("p"), F.lit(0))).alias("false_negative")
    )
    return scores(rolled.fillna("Overall", ["section"]))


def by_document(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """doc, predicted_items, reference_items with counts, scores and state of every document that has leaves on either side.

    A document without reference is no wrong one: its predicted leaves are counted, but nothing is scored.
    """
    key = ["doc", "section", "norm", "anchor"]
    p = predicted.groupBy(*key).agg(F.count("*").alias("p"))
    t = truth.groupBy(*key).agg(F.count("*").alias("t"))
    both = p.join(t, key, "full").fillna(0, ["p", "t"])
    counted = both.groupBy("doc").agg(
        F.sum("p").alias("predicted_items"), F.sum("t").alias("reference_items"), F.sum(F.least("p", "t")).alias("true_positive"), F.sum(F.greatest(F.col("p") - F.col("t"), F.lit(0))).alias("false_positive"), F.sum(F.greatest(F.col("t") - F.col("p"), F.lit(0))).alias("false_negative")
    )
    counted = counted.withColumn("false_positive", F.when(F.col("reference_items") == 0, 0).otherwise(F.col("false_positive")))
    return scores(counted)


def missing(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Leaves of the reference that the prediction lacks, with multiplicity: the k-th of equal ones is missing if fewer are predicted."""
    key = ["doc", "section", "norm", "anchor"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("path", "value"))
    p = predicted.groupBy(*key).agg(F.count("*").alias("p"))
    return truth.withColumn("nth", nth).join(p, key, "left").where(F.col("nth") > F.coalesce("p", F.lit(0))).select("doc", "section", "path", "value", "anchor")


def value_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, doc, norm: the multiset difference of values both ways."""
    left, right = a.select("doc", "norm"), b.select("doc", "norm")
    return left.exceptAll(right).select(F.lit("only_predicted").alias("side"), "doc", "norm").unionByName(right.exceptAll(left).select(F.lit("only_reference").alias("side"), "doc", "norm"))


def structure_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc, path, difference: paths that one side lacks or that hold another type of value (number, date or text)."""
    kind = F.when(F.col("value").rlike(r"^\s*-?\d+(?:\.\d+)?\s*$"), "number").when(F.col("value").rlike(r"^\s*\d{1,4}[-/.]\d{1,4}(?:[-/.]\d{1,4})?\s*$"), "date").otherwise("text")
    shape = lambda f, n: f.groupBy("doc", "path").agg(F.max(kind).alias(n))
    both = shape(a, "a").join(shape(b, "b"), ["doc", "path"], "full")
    return both.select("doc", "path", F.when(F.col("b").isNull(), "extra").when(F.col("a").isNull(), "missing").when(F.col("a") != F.col("b"), "mismatch").alias("difference")).where("difference is not null")


def match_errors(predicted: DataFrame, truth: DataFrame, threshold: float = 0.72) -> DataFrame:
    """doc, section, kind, predicted, expected: what kind of error each unmatched value is.

    Exact matches are taken away by rank first. What is left of one document's section, which is small, is matched greedily:
    the same value of another record is a wrongly associated block, a similar one (cosine of the evaluator's weights over the values left) a corrupted value,
    and what stays is extra or missing content; extra content that another section of the document lacks is a wrongly associated section.
    """
    key = ["doc", "section", "norm", "anchor"]
    nth = lambda f: f.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("path", "value")))
    p, t = nth(predicted), nth(truth)
    rest_p = p.join(t.select(*key, "nth"), [*key, "nth"], "left_anti").select("doc", "section", F.lit("p").alias("side"), "norm", "anchor", "value")
    rest_t = t.join(p.select(*key, "nth"), [*key, "nth"], "left_anti").select("doc", "section", F.lit("t").alias("side"), "norm", "anchor", "value")

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["norm", "anchor", "value"])
        left = list(rows[rows["side"] == "p"][["norm", "value"]].itertuples(index=False, name=None))
        right = list(rows[rows["side"] == "t"][["norm", "value"]].itertuples(index=False, name=None))
        weights = evaluator_weights([norm for norm, _ in left + right])
        similar = lambda a, b: sparse_cosine(weights[a], weights[b])
        out = []
        for norm, value in left:
            same = next((k for k, r in enumerate(right) if r[0] == norm), None)
            if same is not None:
                out.append(("wrongly_associated_block", value, right.pop(same)[1]))
                continue
            best = max(range(len(right)), key=lambda k: similar(norm, right[k][0]), default=None)
            if best is not None and similar(norm, right[best][0]) >= threshold:
                out.append(("corrupted_or_incorrect_value", value, right.pop(best)[1]))
            else:
                out.append(("extra_content", value, None))
        out += [("missing_content", None, value) for _, value in right]
        frame = pd.DataFrame(out, columns=["kind", "predicted", "expected"])
        frame.insert(0, "section", rows["section"].iloc[0])
        frame.insert(0, "doc", rows["doc"].iloc[0])
        return frame

    both = rest_p.unionByName(rest_t).withColumn("doc", F.col("doc").cast("string"))
    found = both.groupBy("doc", "section").applyInPandas(match, "doc string, section string, kind string, predicted string, expected string")
    elsewhere = rest_t.select(F.col("doc").cast("string").alias("doc"), F.col("section").alias("other"), F.col("value").alias("predicted")).distinct()
    moved = found.where("kind = 'extra_content'").join(elsewhere, ["doc", "predicted"]).where("section <> other").select("doc", "section", "predicted", F.lit(True).alias("moved")).distinct()
    found = found.join(moved, ["doc", "section", "predicted"], "left")
    return found.select("doc", "section", F.when(F.col("moved") & (F.col("kind") == "extra_content"), "wrongly_associated_section").otherwise(F.col("kind")).alias("kind"), "predicted", "expected")


def evaluator_weights(values: list[str]) -> dict[str, dict[str, float]]:
    """Of each value its words' weights: (1 + ln tf) (1 + ln((n + 1) / (df + 1)))."""
    words = [Counter(v.split()) for v in values]
    df = Counter(w for c in words for w in c)
    return {v: {w: (1 + math.log(k)) * (1 + math.log((len(values) + 1) / (df[w] + 1))) for w, k in c.items()} for v, c in zip(values, words)}


def sparse_cosine(a: dict[str, float], b: dict[str, float]) -> float:
    """The cosine of two sparse vectors; 0 if one is empty."""
    norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    return sum(x * b[w] for w, x in a.items() if w in b) / norm if norm else 0.0


def entity_scores(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """doc, kind with counts, scores and state of lists of entities (doc, kind, value); a kind without reference is no error."""
    side = lambda f, n: f.where("value is not null").groupBy("doc", "kind", text.word_key(F.col("value")).alias("norm")).agg(F.count("*").alias(n))
    both = side(predicted, "p").join(side(truth, "t"), ["doc", "kind", "norm"], "full").fillna(0, ["p", "t"])
    counted = both.groupBy("doc", "kind").agg(
        F.sum("t").alias("reference_items"), F.sum(F.least("p", "t")).alias("true_positive"), F.sum(F.greatest(F.col("p") - F.col("t"), F.lit(0))).alias("false_positive"), F.sum(F.greatest(F.col("t") - F.col("p"), F.lit(0))).alias("false_negative")
    )
    return scores(counted.withColumn("false_positive", F.when(F.col("reference_items") == 0, 0).otherwise(F.col("false_positive"))))


def with_truth(files: DataFrame, truth: DataFrame) -> DataFrame:
    """files (path below the input folder) with truth_path: the reference of the same path, else of the same name in the reference folder itself."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    known = truth.select(F.col("path").alias("truth_path"), stem(F.col("path")).alias("stem"))
    rows = files.withColumn("stem", stem(F.col("path"))).withColumn("name", F.regexp_extract(stem(F.col("path")), r"([^/]*)$", 1))
    mirrored, flat = known.select("stem", F.col("truth_path").alias("mirrored")), known.where(~F.contains("stem", F.lit("/"))).select(F.col("stem").alias("name"), F.col("truth_path").alias("flat"))
    return rows.join(mirrored, "stem", "left").join(flat, "name", "left").select(*files.columns, F.coalesce("mirrored", "flat").alias("truth_path"))


def corpus_rollup(results: DataFrame) -> DataFrame:
    """status, method, documents, with totals of each status and of all (null): rows of documents that were read or failed."""
    return results.rollup("status", "method").agg(F.count("*").alias("documents"))
