"""Answers of models: logs of attempts by any callable, and their replay, which is the same however often tasks ran."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.functions import constants as C

LOG = "model string, question string, attempt int, at timestamp, raw string"
KIND = pa.schema([("model", pa.string()), ("question", pa.string()), ("attempt", pa.int32()), ("at", pa.timestamp("us", "UTC")), ("raw", pa.string())])


def read_answer_log(spark: SparkSession, path: str) -> DataFrame:
    """Attempts of LOG from JSON lines, all files below a folder; lines that aren't JSON are left out."""
    return spark.read.schema(LOG).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)


def attempts(asked: DataFrame, call: Callable[[str, str], str], tries: int = 3) -> DataFrame:
    """The log (LOG) of asking models: call(model, question) on the executors, again up to `tries` times while it fails or says nothing.

    A failure is an attempt without a reply. Write the log before it is read: a task that is run again asks again, and `replayed` takes what it wrote last.
    """
    rows = asked.select("model", "question").distinct()

    def run(batches):
        for batch in batches:
            out = []
            for model, question in zip(batch.column("model").to_pylist(), batch.column("question").to_pylist(), strict=True):
                for attempt in range(1, tries + 1):
                    try:
                        raw = call(model, question) or None
                    except Exception:  # whatever a model's client raises
                        raw = None
                    out.append({"model": model, "question": question, "attempt": attempt, "at": datetime.now(UTC), "raw": raw})
                    if raw is not None:
                        break
            yield pa.RecordBatch.from_pylist(out, KIND)

    return rows.mapInArrow(run, LOG)


def replayed(log: DataFrame, asked: DataFrame, tries: int = 3) -> DataFrame:
    """One answer (model, question, raw) for each distinct (model, question) asked.

    An attempt may be in the log several times, as a task that is run again logs it again: the last by `at` counts (ties: the greatest text). The first of the attempts
    1 to `tries` that has a reply gives the answer; a null reply or an error is none. Without any, the answer is the error reply.
    """
    once = log.where(F.col("attempt").between(1, tries)).groupBy("model", "question", "attempt").agg(F.max(F.struct("at", F.coalesce("raw", F.lit(C.ERROR_REPLY)).alias("raw"))).alias("x"))
    good = once.select("model", "question", "attempt", "x.raw").where(F.col("raw") != C.ERROR_REPLY)
    first = good.groupBy("model", "question").agg(F.min_by("raw", "attempt").alias("raw"))
    return asked.select("model", "question").distinct().join(first, ["model", "question"], "left").withColumn("raw", F.coalesce("raw", F.lit(C.ERROR_REPLY)))
