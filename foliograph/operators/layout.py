"""Layout rows: margins, doubled layers, reading order, and joins by place on the page.

Rows are those of ``semantic_blocks``: upload_id, page, bbox (x0, y0, x1, y1),
reading_order. Joins by place are band joins on equal upload and page; windows
run over one page.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

PAGE = ["upload_id", "page"]
TOP, BOTTOM = 55.0, 45.0


def box(frame: DataFrame) -> DataFrame:
    """Rows with a bbox, with its sides as columns x0, y0, x1, y1."""
    return frame.where("bbox is not null and size(bbox) = 4").select("*", *[F.element_at("bbox", k + 1).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])


def margin_artifacts(blocks: DataFrame) -> DataFrame:
    """block_id, artifact: 'page_number' in a margin or without bbox, 'repeated_margin' from the second page of a margin's text on."""
    rows = blocks.where("text is not null").withColumn("y0", F.get("bbox", F.lit(1))).withColumn("y1", F.get("bbox", F.lit(3)))
    margin = F.coalesce((F.col("y0") < TOP) | (F.col("y1") > F.col("page_height") - BOTTOM), F.lit(False))
    number = F.col("text").rlike(text.PAGE_NUMBER) & (margin | F.col("bbox").isNull())
    same = Window.partitionBy("upload_id", "text").orderBy("page", "reading_order", "block_id")
    pages = F.dense_rank().over(Window.partitionBy("upload_id", "text").orderBy("page"))
    rows = rows.withColumn("margin", margin).withColumn("number", number)
    inside = rows.where("margin").withColumn("nth_page", pages).withColumn("nth", F.row_number().over(same))
    repeated = inside.where("nth_page > 1 and not number").select("block_id", F.lit("repeated_margin").alias("artifact"))
    return rows.where("number").select("block_id", F.lit("page_number").alias("artifact")).unionByName(repeated)


def doubled_layers(blocks: DataFrame, within: float = 1.0) -> DataFrame:
    """block_id of rows that repeat an earlier row of the page with the same text and every side within one unit."""
    rows = box(blocks).where("text is not null")
    order = Window.partitionBy(*PAGE, "text").orderBy("y0", "x0", "block_id")
    far = [F.abs(F.col(c) - F.lag(c).over(order)) for c in ("x0", "y0", "x1", "y1")]
    return rows.withColumn("far", F.greatest(*far)).where(F.col("far") <= within).select("block_id")


def read_in_order(items: list[tuple], gap: float = 18.0, row_gap: float = 3.0, gutter: float = 0.22, shared: float = 0.2) -> list[tuple]:
    """Items (x0, y0, x1, y1, id) of a page in the order they are read.

    The widest gap between columns cuts a page in two, or the widest step between places where lines begin, if that is a share ``gutter`` of the page.
    Columns of which a share ``shared`` stands beside lines of the other, as dates beside titles, are read row by row; others one after the other.
    Without columns the widest gap between rows cuts.
    """

    def widest(rows: list[tuple], axis: int) -> tuple[float, float]:
        best, reach = (0.0, 0.0), None
        for r in sorted(rows, key=lambda r: r[axis]):
            if reach is not None and r[axis] - reach > best[0]:
                best = (r[axis] - reach, (r[axis] + reach) / 2)
            reach = r[axis + 2] if reach is None else max(reach, r[axis + 2])
        return best

    def beside(one: list[tuple], other: list[tuple]) -> int:
        spans = sorted((r[1], r[3]) for r in other)
        return sum(any(min(r[3], bottom) - max(r[1], top) >= -2 for top, bottom in spans) for r in one)

    done: list[tuple] = []
    todo = [items]  # a stack instead of recursion, as a page may be cut as often as it has lines
    while todo:
        rows = todo.pop()
        if len(rows) < 2:
            done += rows
            continue
        width = max(r[2] for r in rows)
        space, cut = real, at_gap = widest(rows, 0)
        by_start = False
        if space < width * gutter:
            starts = sorted({r[0] for r in rows})
            step, at = max(((b - a, (a + b) / 2) for a, b in zip(starts, starts[1:])), default=(0.0, 0.0))
            if step >= width * gutter:
                space, cut, by_start = step, at, True
        left, right = [r for r in rows if r[0] < cut], [r for r in rows if r[0] >= cut]
        if by_start and min(len(left), len(right)) < 2:  # one line set off is no column, unless nothing else reaches over to it
            space, cut, by_start = real, at_gap, False
            left, right = [r for r in rows if r[0] < cut], [r for r in rows if r[0] >= cut]
        if space >= gap and left and right:
            a, b = (0, 0) if by_start else (beside(left, right), beside(right, left))
            if min(a, b) >= 2 and a >= shared * len(left) and b >= shared * len(right):
                done += sorted(rows, key=lambda r: (round(r[1] / 4), r[0], r[1], r[4]))
            else:
                todo += [right, left]
            continue
        space, cut = widest(rows, 1)
        if space > row_gap:
            todo += [[r for r in rows if r[1] >= cut], [r for r in rows if r[3] <= cut]]
        else:
            done += sorted(rows, key=lambda r: (round(r[1], 1), r[0], r[4]))
    return done


def reading_order(blocks: DataFrame) -> DataFrame:
    """upload_id, page, block_id, position: see ``read_in_order``. A page is one group; it is bounded by what a page can hold."""

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        items = list(rows[["x0", "y0", "x1", "y1", "block_id"]].itertuples(index=False, name=None))
        ids = [r[4] for r in read_in_order(items)]
        return pd.DataFrame({"upload_id": rows["upload_id"].iloc[0], "page": rows["page"].iloc[0], "block_id": ids, "position": range(len(ids))})

    rows = box(blocks).where("page is not null").select(*PAGE, "block_id", "x0", "y0", "x1", "y1")
    return rows.groupBy(*PAGE).applyInPandas(page, "upload_id bigint, page int, block_id bigint, position int")


def table_rows(blocks: DataFrame) -> DataFrame:
    """upload_id, page, band, text, cells: rows of pages whose blocks stand side by side, cells joined by ' | '."""
    rows = box(blocks).where("text is not null")
    band = F.round(F.col("y0") / 4).cast("int")
    side = rows.groupBy(*PAGE, band.alias("band")).agg(F.count("*").alias("cells"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "block_id", "text"))), lambda c: c["text"]), " | ").alias("text"))
    return side.where("cells > 1")


def contact_cards(blocks: DataFrame) -> DataFrame:
    """block_id of rows near a contact at the top of a page: same page, beginning 300 left to 80 right of it, at most 180 down."""
    rows = box(blocks).where("text is not null and y0 <= 180")
    anchors = rows.where(F.col("text").rlike(text.EMAIL) | F.col("text").rlike(r"(?i)\b(?:tel|phone|mobile)\b")).select(*PAGE, F.col("x0").alias("ax"), F.col("block_id").alias("anchor"))
    near = rows.join(anchors, PAGE).where((F.col("x0") >= F.col("ax") - 300) & (F.col("x0") <= F.col("ax") + 80))
    return near.select("block_id").distinct()


def aligned_dates(blocks: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """block_id of each date row with the role row of its page nearest in height, at most ``tolerance`` off and not far left of it."""
    rows = box(blocks).withColumn("mid", (F.col("y0") + F.col("y1")) / 2)
    dates = rows.where("block_type = 'DATE_RANGE'").select(*PAGE, "block_id", F.col("mid").alias("dm"), F.col("x0").alias("dx"))
    roles = rows.where("block_type in ('ROLE', 'COMPANY_ROLE')").select(*PAGE, F.col("block_id").alias("role_id"), F.col("mid").alias("rm"), F.col("x0").alias("rx"))
    near = dates.join(roles, PAGE).where((F.abs(F.col("dm") - F.col("rm")) <= tolerance) & (F.col("dx") >= F.col("rx") - 20))
    return near.groupBy("block_id").agg(F.min_by("role_id", F.struct(F.abs(F.col("dm") - F.col("rm")), "role_id")).alias("role_id"))


def upper_median_font(blocks: DataFrame) -> DataFrame:
    """upload_id, font_size: the element in the middle of the sorted sizes, the upper one of two."""
    order = Window.partitionBy("upload_id").orderBy("font_size", "block_id")
    whole = Window.partitionBy("upload_id")
    rows = blocks.where("font_size is not null").withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(whole))
    return rows.where("k = floor(n / 2) + 1").select("upload_id", "font_size")


def styled_headings(blocks: DataFrame) -> DataFrame:
    """block_id of rows set as headings: bold or a quarter larger than the document's middle size, 2 to 60 characters, no sentence."""
    sized = blocks.join(upper_median_font(blocks).withColumnRenamed("font_size", "middle"), "upload_id", "left")
    styled = F.coalesce(F.col("bold"), F.lit(False)) | F.coalesce(F.col("font_size") >= 1.25 * F.col("middle"), F.lit(False))
    return sized.where(styled & F.length("text").between(2, 60) & ~F.col("text").rlike(r"[.!?]$") & ~F.col("text").rlike(r"\d")).select("block_id")


def location_triples(blocks: DataFrame) -> DataFrame:
    """block_id of a short row between an employer and a role or date: a place."""
    order = Window.partitionBy("upload_id").orderBy("reading_order", "block_id")
    rows = blocks.where("text is not null").select("block_id", "text", "block_type", F.lag("block_type").over(order).alias("before"), F.lead("block_type").over(order).alias("after"))
    return rows.where("block_type in ('COMPANY', 'LOCATION', 'UNKNOWN') and before = 'COMPANY' and after in ('ROLE', 'DATE_RANGE') and length(text) <= 40").select("block_id")


def stacked_roles(blocks: DataFrame) -> DataFrame:
    """block_id, new_type of employer-and-role rows in a run: the second, fourth and so on are roles."""
    order = Window.partitionBy("upload_id").orderBy("reading_order", "block_id")
    rows = blocks.where("text is not null and coalesce(block_type, '') <> 'PAGE_ARTIFACT'").select("upload_id", "block_id", "reading_order", "block_type", F.lag("block_type").over(order).alias("before"))
    starts = (~((F.col("block_type") == "COMPANY_ROLE") & F.coalesce(F.col("before").isin("COMPANY_ROLE"), F.lit(False)))).cast("int")
    run = F.sum(starts).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = rows.withColumn("run", run).withColumn("k", F.row_number().over(Window.partitionBy("upload_id", "run").orderBy("reading_order", "block_id")))
    return numbered.where("block_type = 'COMPANY_ROLE' and k % 2 = 0").select("block_id", F.lit("ROLE").alias("new_type"))


def wrapped_dates(blocks: DataFrame) -> DataFrame:
    """block_id, text of date rows that end in a dash and go on with a bare year in the next row."""
    order = Window.partitionBy("upload_id").orderBy("reading_order", "block_id")
    rows = blocks.where("text is not null").select("block_id", "text", F.lead("text").over(order).alias("next"))
    return rows.where(F.col("text").rlike(r"\d{4}\s*[–—-]\s*[A-Za-z]{3,9}\.?\s*$") & F.col("next").rlike(r"^\s*(?:19|20)\d{2}\s*$")).select("block_id", F.concat_ws(" ", F.trim("text"), F.trim("next")).alias("text"))


def label_classes(block_type: Column) -> Column:
    """struct(semantic, confidence) of a block type; no type or UNKNOWN has confidence 0."""
    sure = ["SECTION_HEADING", "COMPANY", "COMPANY_ROLE", "ROLE", "DATE_RANGE", "LOCATION", "CLIENT", "PAGE_ARTIFACT"]
    return F.struct(F.initcap(F.replace(F.coalesce(block_type, F.lit("UNKNOWN")), F.lit("_"), F.lit(" "))).alias("semantic"), F.when(block_type.isin(sure), 0.95).when(block_type.isNull() | (block_type == "UNKNOWN"), 0.0).otherwise(0.7).alias("confidence"))
