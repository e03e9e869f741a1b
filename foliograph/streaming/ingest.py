"""New uploads as a stream.

Every document is independent, so the batch pipelines run unchanged on each
micro-batch; only repeats of an upload within the watermark are dropped first,
and counts by time come from windowed aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans import lineage

LATE = "7 days"


def uploads(spark: SparkSession, folder: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    """The rows of Parquet files that arrive in a folder, each upload once within the watermark of its loading time."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    return rows.withWatermark("loaded_at", LATE).dropDuplicatesWithinWatermark(["upload_id"])


def counts_by_time(rows: DataFrame, width: str = "1 day") -> DataFrame:
    """start, source, uploads, chars of windows over the loading time."""
    window = F.window("loaded_at", width)
    return rows.groupBy(window.alias("w"), "source").agg(F.count("*").alias("uploads"), F.sum(F.length("raw_text")).alias("chars")).select(F.col("w.start").alias("start"), "source", "uploads", "chars")


def run_batches(rows: DataFrame, pipeline: Callable[[DataFrame], dict[str, DataFrame]], out: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch pipeline on every micro-batch; a batch that is run again after a failure replaces what it wrote."""

    def batch(frame: DataFrame, batch_id: int) -> None:
        for name, artifact in pipeline(frame).items():
            artifact.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        lineage.release(frame.sparkSession)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
