"""Validation of a stream of questions. It keeps no state: each micro-batch meets the knowledge base like a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from claimforge.operators.validate import validate
from claimforge.sources.kb import KnowledgeBase


def validate_stream(questions: DataFrame, kb: KnowledgeBase, closed: DataFrame, path: str, checkpoint: str, loose: bool = False) -> StreamingQuery:
    """Writes verdicts of streamed questions (idx, question, type) as Parquet, a folder for each batch.

    A batch that is run again after a failure replaces its own folder, so each question's verdict is there once.
    """

    def batch(df: DataFrame, number: int) -> None:
        validate(df, kb, closed, loose).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
