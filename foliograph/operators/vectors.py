"""Vectors: term weights, cosine, top pairs, density and k-means clusters.

Pairs are only ever formed within a group (a document, or a label) or between a
stated query set and blocks of all rows; grouping keys are hashed into the
shuffle, and the pair join is an equi-join that AQE may split when skewed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

TOKEN = r"[\p{L}\p{N}_]{2,}"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors, clipped to -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def tf_idf(texts: DataFrame, group: str, item: str, column: str) -> DataFrame:
    """group, item, term, weight: raw counts times 1 + ln((1 + n) / (1 + df)), scaled to length one; n and df within the group."""
    terms = texts.select(group, item, F.explode(F.regexp_extract_all(F.lower(column), F.lit(TOKEN), 0)).alias("term"))
    tf = terms.groupBy(group, item, "term").agg(F.count("*").alias("tf"))
    n = texts.groupBy(group).agg(F.count_distinct(item).alias("n"))
    df = tf.groupBy(group, "term").agg(F.count("*").alias("df"))
    weighted = tf.join(df, [group, "term"]).join(n, group).withColumn("w", F.col("tf") * (1 + F.log((1 + F.col("n")) / (1 + F.col("df")))))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(group, item)))
    return weighted.select(group, item, "term", (F.col("w") / norm).alias("weight"))


def log_tf_idf(texts: DataFrame, item: str, column: str) -> DataFrame:
    """item, term, weight with the evaluator's weights: (1 + ln tf) (1 + ln((n + 1) / (df + 1))), not scaled."""
    terms = texts.select(item, F.explode(F.regexp_extract_all(F.lower(column), F.lit(r"[\p{L}\p{N}_+#.]+"), 0)).alias("term"))
    tf = terms.groupBy(item, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = texts.agg(F.count_distinct(item).alias("n"))  # one row
    weighted = tf.join(df, "term").join(F.broadcast(n))
    return weighted.select(item, "term", ((1 + F.log("tf")) * (1 + F.log((F.col("n") + 1) / (F.col("df") + 1)))).alias("weight"))


def sparse_cosine(weights: DataFrame, group: str, item: str) -> DataFrame:
    """group, i, j, similarity (over 0) of items of one group that share a term; weights of length one."""
    a = weights.select(group, F.col(item).alias("i"), "term", F.col("weight").alias("wa"))
    b = weights.select(group, F.col(item).alias("j"), "term", F.col("weight").alias("wb"))
    return a.join(b, [group, "term"]).where("i < j").groupBy(group, "i", "j").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))


def top_pairs(pairs: DataFrame, group: str, k: int = 25) -> DataFrame:
    """The k most similar pairs of each group; similarity rounded to four places first, ties by i and j."""
    rounded = pairs.withColumn("similarity", F.round("similarity", 4))
    order = Window.partitionBy(group).orderBy(F.desc("similarity"), "i", "j")
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, k: int, every: int = 20) -> DataFrame:
    """query, neighbour, similarity, rank: of each row whose id is divisible by ``every`` the k most similar other rows.

    Queries are broadcast in one block if they are few, which is checked by their number, and else joined by blocks.
    """
    queries = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    blocks = 1 + queries.count() // 5_000
    queries = queries.withColumn("block", (F.xxhash64("query") % blocks).cast("int"))
    out = None
    for b in range(blocks):
        mine = F.broadcast(queries.where(F.abs("block") == b).drop("block"))
        scored = vectors.join(mine, F.col("vec_id") != F.col("query")).select("query", F.col("vec_id").alias("neighbour"), F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
        out = scored if out is None else out.unionByName(scored)
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component (its smallest node): minimum labels spread over edges (a, b), with pointer jumping, to a fixed point."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = nodes.select(F.col("node"), F.col("node").alias("component"))
    while True:  # labels only fall, and jumps halve what is left of a chain
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("least"))
        spread = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("component", F.coalesce("least", "component")).alias("next"), "component")
        # jump: a label's own label
        jumped = spread.join(spread.select(F.col("node").alias("next"), F.col("next").alias("further")), "next", "left").select("node", F.least("next", F.coalesce("further", "next")).alias("component"), F.col("component").alias("before"))
        jumped = cut(jumped)
        labels = jumped.select("node", "component")
        if jumped.where("component <> before").isEmpty():
            return labels


def density_clusters(pairs: DataFrame, nodes: DataFrame, group: str, threshold: float = 0.5) -> DataFrame:
    """group, node, label: clusters of points of one group linked by a similarity of at least ``threshold``; -1 for points without link.

    With two points to a core this is exactly density clustering; labels count from 0 by smallest member within the group.
    """
    edges = pairs.where(F.col("similarity") >= threshold).select(F.col("i").alias("a"), F.col("j").alias("b"))
    linked = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    parts = connected(edges, linked)
    placed = nodes.join(parts, "node", "left")
    number = F.dense_rank().over(Window.partitionBy(group).orderBy(F.col("component").isNull(), "component")) - 1
    return placed.select(group, "node", F.when(F.col("component").isNull(), -1).otherwise(number).alias("label"))


def members(labels: DataFrame, texts: DataFrame, group: str) -> DataFrame:
    """group, label, members: the texts (node, text) of each cluster; points without cluster are left out."""
    return labels.where("label >= 0").join(texts, [group, "node"]).groupBy(group, "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]).alias("members"))


def labelled_pairs(pairs: DataFrame, texts: DataFrame, group: str) -> DataFrame:
    """pairs (group, i, j, similarity) with the texts of both ends."""
    side = lambda name: texts.select(group, F.col("node").alias(name), F.col("text").alias(f"text_{name}"))
    return pairs.join(side("i"), [group, "i"]).join(side("j"), [group, "j"])


def pair_counts(nodes: DataFrame, group: str) -> DataFrame:
    """group, items, pairs: of n items there are n (n - 1) / 2 pairs."""
    n = F.count("*")
    return nodes.groupBy(group).agg(n.alias("items"), (n * (n - 1) / 2).cast("long").alias("pairs"))


def k_means(vectors: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """vec_id, cluster by k-means over the embeddings."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(features)
    return model.transform(features).select("vec_id", "cluster")


def silhouette(vectors: DataFrame, label: str = "label", block: int = 1_000) -> DataFrame:
    """One row: the mean silhouette by Euclidean distance, to four places, computed exactly over all given rows that have a vector and a label.

    Every row meets every other: blocks of at most about ``block`` rows are paired, and a pair of blocks gives for each row the sum
    of its distances to each label. The work grows with the square of the rows; what is held at once does not grow.
    """
    rows = vectors.where(F.col("embedding").isNotNull() & F.col(label).isNotNull()).select("vec_id", F.col(label).alias("label"), "embedding")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    blocks = 1 + rows.count() // block
    in_blocks = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("block")
    in_blocks = cut(in_blocks.agg(F.collect_list(F.struct("vec_id", "label", "embedding")).alias("p")).select(*[F.col(f"p.{c}").alias(c) for c in ("vec_id", "label", "embedding")]))
    kind = rows.schema["label"].dataType.simpleString()

    @F.pandas_udf(f"array<struct<vec_id:bigint,label:{kind},other:{kind},total:double>>")
    def sums(ids: pd.Series, labels: pd.Series, a: pd.Series, other_ids: pd.Series, others: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for i, of, x, j, other, y in zip(ids, labels, a, other_ids, others, b):
            x, y, other = np.array(list(x), dtype=float), np.array(list(y), dtype=float), np.asarray(other)
            far = np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T))
            far[np.asarray(i)[:, None] == np.asarray(j)[None, :]] = 0.0
            out.append([(v, l, c, t) for c in sorted(set(other.tolist())) for v, l, t in zip(i, of, far[:, other == c].sum(1).tolist())])
        return pd.Series(out, dtype=object)

    right = in_blocks.select(*[F.col(c).alias(f"b_{c}") for c in ("vec_id", "label", "embedding")])
    pairs = in_blocks.repartition(min(blocks, 64)).crossJoin(right)
    met = pairs.select(F.explode(sums("vec_id", "label", "embedding", "b_vec_id", "b_label", "b_embedding")).alias("s")).select("s.*")
    totals = met.groupBy("vec_id", "label", "other").agg(F.sum("total").alias("total")).join(sizes.withColumnRenamed("label", "other"), "other")
    own = F.col("label") == F.col("other")
    means = totals.groupBy("vec_id").agg(F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    # a row alone in its label counts 0, as do rows with no distance to anything
    s = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return means.where("b is not null").agg(F.round(F.avg(s), 4).alias("silhouette"))
