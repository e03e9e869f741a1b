"""Problem 2: overlapping, nested, touching and gapped intervals.

Integer intervals are decomposed into canonical dyadic blocks (block (level, k)
covers the 2**level integers from k * 2**level). Equal blocks of a key collapse
before the one shuffle, so that a key with any number of rows sends at most as
many rows as its range has blocks. A block covered by an ancestor is dropped:
blocks are nested or disjoint, so in the order of their starts that is a
running maximum of ends. Sibling pairs then merge upward level by level, and
adjacent blocks coalesce into maximal periods; between two of them lies a gap.
All of it after the shuffle runs on one sort order, with built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import months

#: Largest block: 2**MAX_LEVEL integers. Longer intervals are made of several such blocks, which still coalesce.
MAX_LEVEL = 9


def _blocks(first: Column, after: Column, max_level: int) -> Column:
    """The canonical blocks (start, size) of the integers from ``first`` to before ``after``."""
    parts = []
    for level in range(max_level):
        size, twice = 1 << level, 1 << (level + 1)
        # what lies between the bounds rounded to blocks of this level and those of the next one
        low, high = F.ceil(first / size) * size, F.floor(after / size) * size
        low_up, high_down = F.ceil(first / twice) * twice, F.floor(after / twice) * twice
        inner = low < high
        parts.append(F.when(inner & (low < low_up), F.struct(low.cast("long").alias("start"), F.lit(size).cast("long").alias("size"))))
        parts.append(F.when(inner & (high_down < high) & ((high_down >= low_up)), F.struct(high_down.cast("long").alias("start"), F.lit(size).cast("long").alias("size"))))
    top = 1 << max_level
    low, high = F.ceil(first / top).cast("long"), F.floor(after / top).cast("long")
    whole = F.when(low < high, F.transform(F.sequence(low, high - 1), lambda k: F.struct((k * top).alias("start"), F.lit(top).cast("long").alias("size"))))
    small = F.filter(F.array(*parts), lambda b: b.isNotNull())
    return F.concat(small, F.coalesce(whole, F.array().cast("array<struct<start:bigint,size:bigint>>")))


def continuous(intervals: DataFrame, key: str, first: str, last: str, max_level: int = MAX_LEVEL) -> DataFrame:
    """Maximal continuous periods per key: (key, first, last), both ends inclusive.

    Rows with a null key, a null bound or an end before its start are left out; an empty input gives no rows.
    Intervals that share an integer or follow each other without a hole are continuous.
    """
    rows = intervals.select(F.col(f"`{key}`").alias("key"), F.col(f"`{first}`").cast("long").alias("a"), F.col(f"`{last}`").cast("long").alias("b")).where("key is not null and a <= b")
    bound = F.array(F.struct("a", (F.col("b") + 1).alias("after")))  # bound once for the many branches
    blocks = rows.select("key", F.explode(F.flatten(F.transform(bound, lambda i: _blocks(i["a"], i["after"], max_level)))).alias("block")).select("key", "block.start", "block.size").distinct()

    # one exchange by key alone serves every step from here on
    order = Window.partitionBy("key").orderBy("start", F.desc("size"))
    blocks = blocks.repartition("key")
    reach = F.max(F.col("start") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("reach", reach).where("reach is null or reach < start + size").drop("reach")

    line = Window.partitionBy("key").orderBy("start")
    for level in range(max_level):
        size = 1 << level
        left = (F.col("size") == size) & (F.pmod(F.col("start"), F.lit(2 * size)) == 0)
        right = (F.col("size") == size) & (F.pmod(F.col("start"), F.lit(2 * size)) == size)
        pairs_next = left & (F.lead("start").over(line) == F.col("start") + size) & (F.lead("size").over(line) == size)
        pairs_before = right & (F.lag("start").over(line) == F.col("start") - size) & (F.lag("size").over(line) == size)
        blocks = (
            blocks.withColumn("grows", F.coalesce(pairs_next, F.lit(False))).withColumn("goes", F.coalesce(pairs_before, F.lit(False)))
            .where(~F.col("goes"))
            .select("key", "start", F.when(F.col("grows"), F.lit(2 * size).cast("long")).otherwise(F.col("size")).alias("size"))
        )

    opens = F.coalesce(F.lag(F.col("start") + F.col("size")).over(line) < F.col("start"), F.lit(True))
    runs = blocks.withColumn("opens", opens).withColumn("run", F.sum(F.col("opens").cast("long")).over(line))
    return runs.groupBy("key", "run").agg(F.min("start").alias(first), (F.max(F.col("start") + F.col("size")) - 1).alias(last)).select(F.col("key").alias(key), first, last)


def with_gaps(periods: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """(key, kind, first, last) of each continuous period and of each gap between two of one key."""
    line = Window.partitionBy(key).orderBy(first)
    before = F.lag(last).over(line)
    both = periods.withColumn("before", before).select(
        key,
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("period").alias("kind"), F.col(first).alias("lo"), F.col(last).alias("hi")),
                    F.when(F.col("before").isNotNull(), F.struct(F.lit("gap").alias("kind"), (F.col("before") + 1).alias("lo"), (F.col(first) - 1).alias("hi"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("x"),
    )
    return both.select(key, F.col("x.kind").alias("kind"), F.col("x.lo").alias(first), F.col("x.hi").alias(last))


def employment_months(resume: DataFrame) -> DataFrame:
    """doc_id, first, last of each row of canonical_resume whose dates are valid and in order, as month numbers."""
    today = months.month_of(F.col("created_at"))
    both = F.struct(
        months.month_number(F.col("start_date"), 1, today).alias("first"),
        months.month_number(F.col("end_date"), 12, today).alias("last"),
    )
    # filtered within the array: a filter above would compute the dates a second time
    good = F.filter(F.array(both), lambda x: x["first"] <= x["last"])
    return resume.where("doc_id is not null").select("doc_id", F.explode(good).alias("x")).select("doc_id", "x.first", "x.last")


def employment_periods(resume: DataFrame) -> DataFrame:
    """doc_id, kind, first_month, last_month of the continuous employment periods and the gaps between them."""
    out = with_gaps(continuous(employment_months(resume), "doc_id", "first", "last"), "doc_id", "first", "last")
    return out.select("doc_id", "kind", months.as_text(F.col("first")).alias("first_month"), months.as_text(F.col("last")).alias("last_month"))
