"""Answers of models against verdicts: override resolution, correctness, evaluation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.functions import text as T

RECORD = ("idx", "run_key", "question", "type", "source", "ground_truth", "llm_raw", "llm_parsed", "graph_answer", "graph_covered", "final_answer", "is_correct", "method", "caught", "epistemic_state", "proof", "model", "guarded")


def base_model(run_key: Column) -> Column:
    """A run's model: the key without its ending."""
    return F.regexp_replace(run_key, "_(baseline|guarded)$", "")


def select_runs(df: DataFrame, keys, column: str = "run_key") -> DataFrame:
    """Rows of the named runs or models; None: all."""
    return df if keys is None else df.where(F.col(column).isin(*keys))


def unknown_keys(df: DataFrame, keys, column: str = "run_key") -> DataFrame:
    """(ord, key) of the asked keys that have no row, in the order asked."""
    asked = df.sparkSession.createDataFrame(list(enumerate(keys)), "ord int, key string")
    return asked.join(df.select(F.col(column).alias("key")).distinct(), "key", "left_anti").select("ord", "key")


def override(guarded: Column, parsed: Column, answer: Column, covered: Column, truth: Column) -> list[Column]:
    """final_answer, method, caught: a covered verdict replaces a guarded answer; a missing answer counts as different."""
    used = guarded & covered & answer.isNotNull()
    differs = ~parsed.eqNullSafe(answer)
    return [
        F.when(used, answer).otherwise(parsed).alias("final_answer"),
        F.when(used & differs, "guard_override").when(used, "guard_agree").otherwise("llm_only").alias("method"),
        F.coalesce(used & differs & answer.eqNullSafe(truth), F.lit(False)).alias("caught"),
    ]


def correct(final: Column, truth: Column) -> Column:
    """A missing answer is wrong."""
    return F.coalesce(final == truth, F.lit(False))


def records(verdicts: DataFrame, answers: DataFrame, guards=(False, True)) -> DataFrame:
    """Evaluation records of every model with and without guard.

    verdicts: questions with verdicts; answers: (model, question, raw), one for each model and question. A question that a
    model has no answer to takes no part in its runs.
    """
    one = answers.select(F.col("model").alias("model_"), F.col("question"), F.col("raw"))
    df = verdicts.join(one, "question").withColumn("guarded", F.explode(F.array(*[F.lit(g) for g in guards])))
    df = df.withColumn("llm_raw", T.tidy_reply(F.col("raw"))).withColumn("llm_parsed", T.yes_no(F.col("llm_raw")))
    df = df.select("*", *override(F.col("guarded"), F.col("llm_parsed"), F.col("graph_answer"), F.col("covered"), F.col("ground_truth")))
    key = F.concat(F.col("model_"), F.when(F.col("guarded"), "_guarded").otherwise("_baseline"))
    df = df.withColumn("is_correct", correct(F.col("final_answer"), F.col("ground_truth"))).withColumn("run_key", key).withColumn("model", key)
    return df.withColumnRenamed("covered", "graph_covered").select(*RECORD)
