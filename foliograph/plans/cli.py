"""Command line, as ``python -m foliograph.plans.cli``:

run FOLDER OUT          artifacts of the documents in a folder; exit code 1 if a file failed
sample OUT              artifacts of invented documents
query NAME TABLES OUT   the rows of a named query
evaluate FOLDER TRUTH OUT   scores of the employments read from a folder's documents against a Parquet table (doc, section, path, value, anchor; doc is
                        a file's name without suffix), with a roll-up of what was read; exit code 1 if a file failed
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation, records
from ..sources import documents, samples
from . import catalog, lineage
from .engine import Engine
from .lineage import cut


def _say(stage: str) -> None:
    print(stage, file=sys.stderr)


def main(args: list[str]) -> int:
    spark = SparkSession.builder.getOrCreate()
    if len(args) == 3 and args[0] == "run":
        engine = Engine(spark)
        texts, failed = engine.ingest(args[1])
        documents.write_artifacts(engine.run(texts, stage=_say).as_dict(), args[2])
        failed.write.mode("overwrite").json(f"{args[2]}/failed.json")
        broken = not failed.isEmpty()
        lineage.release(spark)
        return int(broken)
    if len(args) == 2 and args[0] == "sample":
        documents.write_artifacts(Engine(spark).run(samples.samples(spark), stage=_say).as_dict(), args[1])
        lineage.release(spark)
        return 0
    if len(args) == 4 and args[0] == "evaluate":
        engine = Engine(spark)
        texts, failed = engine.ingest(args[1])
        jobs = records.readable(engine.run(texts, stage=_say).records).join(texts.select("upload_id", F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("doc")), "upload_id")
        predicted = evaluation.leaves(jobs, "doc", "experience", F.col("company"), company=F.col("company"), designation=F.col("designation"), start_date=F.col("start_date"), end_date=F.col("end_date"))
        truth = spark.read.parquet(args[2])
        truth = truth.select("doc", "section", "path", "value", text.word_key(F.col("value")).alias("norm"), text.word_key(F.coalesce("anchor", F.lit(""))).alias("anchor"))
        engine.evaluate(cut(predicted), cut(truth), args[3])
        states = texts.select(F.lit("read").alias("status"), F.lit("text").alias("method")).unionByName(failed.select(F.lit("failed").alias("status"), "method"))
        evaluation.corpus_rollup(states).write.mode("overwrite").json(f"{args[3]}/documents.json")
        broken = not failed.isEmpty()
        lineage.release(spark)
        return int(broken)
    if len(args) == 4 and args[0] == "query":
        catalog.queries()[args[1]](spark, args[2]).write.mode("overwrite").parquet(args[3])
        return 0
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
