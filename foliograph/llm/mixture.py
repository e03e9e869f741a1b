"""Problem 8: mixing sources to target weights.

Sizes are tokens. The records of a source fall into blocks by a keyed hash, at
least ``BLOCKS`` and more the larger the source, and only the blocks' sizes go to
the driver: at most ``MAX_BLOCKS`` for each source of the target table, whatever
the corpus holds. From them come
exact quotas: the total is the largest at which every source that has text
reaches its share within its repeats; shares of sources without text go to the
others in proportion. A quota is whole copies of a source plus a part of it,
which is whole blocks in a keyed order and, of one last block, records in a
keyed order. The blocks are then divided among the output shards by a splitting
tree: at every node the blocks of each source that go left are a draw from the
multivariate hypergeometric distribution, so that every shard is a fair sample
and the counts are exact. Within a shard records are put in a keyed order.

Left out: records without text or tokens, and those of a source without target
(also a null source); the shares report them. An empty input gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import encode

#: Blocks of a source at least and at most, and the tokens of a block between both.
BLOCKS, MAX_BLOCKS, BLOCK_TOKENS = 256, 65_536, 1_000_000
#: Output shards at least, and the tokens of a shard beyond that.
SHARDS, SHARD_TOKENS = 16, 50_000_000
SEED = 42
#: Copies of a record beyond this number are no mixture any more.
MAX_REPEATS = 1_000
#: Drawn blocks up to this number are broadcast; more are joined by a shuffle.
FEW_UNITS = 100_000
#: More sources than this are no parameter table any more.
MAX_SOURCES = 10_000


@dataclass(frozen=True)
class Source:
    name: str
    share: float
    repeats: int
    blocks: dict[int, int]  # tokens of each block


def quotas(sources: list[Source], total: float | None = None) -> dict[str, float]:
    """Tokens to draw from each source. ``total``: at most so many in all."""
    there = [s for s in sources if sum(s.blocks.values()) > 0 and s.share > 0 and s.repeats > 0]
    weight = sum(s.share for s in there)
    if not there:
        return {}
    most = min(s.repeats * sum(s.blocks.values()) * weight / s.share for s in there)
    size = most if total is None else min(most, total)
    return {s.name: size * s.share / weight for s in there}


def split_tree(counts: np.ndarray, shards: int, random: np.random.Generator) -> np.ndarray:
    """Counts of each source for every shard: rows are shards, and the columns add up to ``counts``."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    drawn = random.multivariate_hypergeometric(counts, int(round(counts.sum() * left / shards)), method="marginals") if counts.sum() else counts
    return np.concatenate([split_tree(drawn, left, random), split_tree(counts - drawn, shards - left, random)])


def plan(sources: list[Source], shards: int, seed: int, total: float | None = None) -> list[tuple[str, int, int, int, int | None]]:
    """(source, block, copy, shard, tokens to take at most or None for all) of every drawn block."""
    random = np.random.default_rng(seed)
    units: dict[str, list[tuple[int, int, int | None]]] = {}
    for s in sorted(sources, key=lambda s: s.name):
        quota = quotas(sources, total).get(s.name)
        if not quota:
            continue
        have = sum(s.blocks.values())
        copies = min(s.repeats, int(quota / have + 1e-9))
        rest = quota - copies * have if copies < s.repeats else 0.0
        mine: list[tuple[int, int, int | None]] = [(b, c, None) for c in range(copies) for b in s.blocks]
        for b in random.permutation(sorted(s.blocks)):
            if rest < 1:
                break
            size = s.blocks[int(b)]
            mine.append((int(b), copies, None if size <= rest else int(rest)))
            rest -= size
        units[s.name] = [mine[i] for i in random.permutation(len(mine))]
    names = list(units)
    by_shard = split_tree(np.array([len(units[n]) for n in names], dtype=np.int64), shards, random) if names else np.zeros((0, 0), int)
    out, at = [], dict.fromkeys(names, 0)
    for shard, row in enumerate(by_shard):
        for name, n in zip(names, row):
            out += [(name, b, c, shard, most) for b, c, most in units[name][at[name] : at[name] + int(n)]]
            at[name] += int(n)
    return out


def sized(documents: DataFrame, path: str = encode.BYTE_BPE) -> DataFrame:
    """doc_id, source, tokens of every record; cut off from the encoding, as it is read several times."""
    return cut(documents.select("doc_id", "source", encode.size(F.col("text"), path).alias("tokens")))


def mix(sizes: DataFrame, targets: DataFrame, shards: int | None = None, seed: int = SEED, blocks: int | None = None, total: float | None = None) -> DataFrame:
    """The drawn records: doc_id, source, tokens, copy (from 0), shard, place (order within the shard).

    Where ``shards`` or ``blocks`` is not given it follows from the tokens there are.
    """
    spark = sizes.sparkSession
    wanted = targets.where("source is not null and target_share is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError("too many sources for a parameter table")
    if any((r[2] or 0) > MAX_REPEATS for r in wanted):
        raise ValueError(f"a record can't be repeated more than {MAX_REPEATS} times")
    usable = sizes.where("tokens > 0 and doc_id is not null").where(F.col("source").isin([r[0] for r in wanted]))
    tokens = {r[0]: r[1] for r in usable.groupBy("source").agg(F.sum("tokens")).collect()}  # at most as many rows as targets
    blocks_of = {s: blocks or min(MAX_BLOCKS, max(BLOCKS, n // BLOCK_TOKENS)) for s, n in tokens.items()}
    if not blocks_of:
        blocks_of = {"": 1}
    of_source = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(blocks_of.items()) for x in pair]), F.col("source"))
    blocked = usable.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), of_source).cast("int"))
    found: dict[str, dict[int, int]] = {}
    for r in blocked.groupBy("source", "block").agg(F.sum("tokens").alias("n")).collect():  # at most sources x MAX_BLOCKS rows
        found.setdefault(r[0], {})[r[1]] = r[2]
    sources = [Source(r[0], r[1], r[2] if r[2] is not None else 1, found.get(r[0], {})) for r in wanted]
    shards = shards or max(SHARDS, int(sum(quotas(sources, total).values()) // SHARD_TOKENS))
    units = plan(sources, shards, seed, total)
    drawn = spark.createDataFrame(units, "source string, block int, copy int, shard int, most bigint")
    rows = blocked.join(F.broadcast(drawn) if len(units) <= FEW_UNITS else drawn, ["source", "block"])
    key = F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("copy"))
    part = Window.partitionBy("source", "block", "copy").orderBy(key, "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = rows.where("most is null")
    some = rows.where("most is not null").withColumn("so_far", F.sum("tokens").over(part)).where("so_far - tokens / 2 <= most").drop("so_far")  # the record nearest to the quota is the last
    out = whole.unionByName(some).select("doc_id", "source", "tokens", "copy", "shard", key.alias("place"))
    return out.repartition(shards, "shard").sortWithinPartitions("shard", "place")


def shares(sizes: DataFrame, targets: DataFrame, drawn: DataFrame) -> DataFrame:
    """Per source: target share, tokens there, tokens drawn, share reached, repeats allowed and used."""
    there = sizes.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.count("*").alias("records"))
    taken = drawn.groupBy("source").agg(F.sum("tokens").alias("drawn_tokens"), (F.max("copy") + 1).alias("repeats_used"))
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    total = taken.agg(F.sum("drawn_tokens")).first()[0]  # one number
    return (
        there.join(wanted, there["source"].eqNullSafe(wanted["source"]), "full")
        .select(F.coalesce(wanted["source"], there["source"]).alias("source"), "available_tokens", "records", "target_share", "max_repeats")
        .join(taken, "source", "left")
        .select(
            "source",
            F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
            F.try_divide(F.coalesce("drawn_tokens", F.lit(0)), F.lit(total)).alias("actual_share"),
            F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"),
            F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"),
            F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
            F.coalesce("repeats_used", F.lit(0)).alias("repeats_used"),
        )
    )
