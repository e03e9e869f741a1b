"""Cutting lineage in a way that survives the loss of executors: by a table written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names. Where none is named a session on one machine gets a temporary one; on a cluster that is an error."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="foliograph-checkpoint-")
        context.setCheckpointDir(named)
    return named


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, read back from a compressed table in the shared folder, so that only needed columns are read.

    This runs the frame. The tables lie under ``foliograph-...`` in that folder; ``release`` or the end of the session's JVM deletes them.
    """
    spark = frame.sparkSession
    name = f"{checkpoint_folder(spark).rstrip('/')}/foliograph-{uuid.uuid4().hex}"
    frame.write.parquet(name)
    fs, path = _path(spark, name)
    fs.deleteOnExit(path)
    _written.append(name)
    return spark.read.schema(frame.schema).parquet(name)


def release(spark: SparkSession) -> None:
    """Deletes the tables of all cuts so far: for when what was built on them has been written."""
    while _written:
        fs, path = _path(spark, _written.pop())
        fs.delete(path, True)
