"""Running totals of a stream of evaluation records, kept as state in the checkpoint, so that a restart goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimforge.operators.metrics import _share


def totals_stream(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes, for each batch of streamed records (run_key, is_correct, graph_covered), the totals so far of the runs that it touched.

    A batch's folder is replaced if the batch is run again after a failure. State has a row for each run.
    """
    counts = records.groupBy("run_key").agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct"), F.count_if("graph_covered").alias("covered"))

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, path: str) -> DataFrame:
    """(run_key, total, correct, covered, accuracy_strict, coverage_rate) after the last batch that is written."""
    last = spark.read.parquet(path).groupBy("run_key").agg(F.max_by(F.struct("total", "correct", "covered"), "batch").alias("x")).select("run_key", "x.*")
    return last.select("*", _share(F.col("correct"), F.col("total")).alias("accuracy_strict"), _share(F.col("covered"), F.col("total"), 2).alias("coverage_rate"))
