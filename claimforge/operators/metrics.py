"""Evaluation analytics on records: confusion, precision and recall, paired runs, coverage. One aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimforge.operators.running import FAN, before, running


def _share(a: Column, b: Column, digits: int = 1) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double") * 100, b), F.lit(0.0)), digits)  # a share on a half rounds up, as 5100 / 80 is exact


def cells(prediction: str = "final_answer", truth: str = "ground_truth") -> list[Column]:
    """TP, TN, FP, FN and total; a missing prediction counts as false."""
    p, t = F.coalesce(F.col(prediction), F.lit(False)), F.coalesce(F.col(truth), F.lit(False))
    return [F.count_if(p & t).alias("tp"), F.count_if(~p & ~t).alias("tn"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count("*").alias("total")]


def confusion(df: DataFrame, *by: str, prediction: str = "final_answer", truth: str = "ground_truth") -> DataFrame:
    return df.groupBy(*by).agg(*cells(prediction, truth))


def rates(cm: DataFrame) -> DataFrame:
    """Precision, recall, F1, accuracy and specificity in percent, one digit; zero where undefined."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    p, r = F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0))
    return cm.select(
        "*", F.round(p * 100, 1).alias("precision"), F.round(r * 100, 1).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)) * 100, 1).alias("f1"),
        _share(tp + tn, F.col("total")).alias("accuracy"), _share(tn, tn + fp).alias("specificity"),
    )


def overall_and_per_type(df: DataFrame, prediction: str = "final_answer", truth: str = "ground_truth") -> DataFrame:
    """Rates for each run and for each run and type (type null: the run), by grouping sets in one pass."""
    return rates(df.groupingSets([["run_key"], ["run_key", "type"]], "run_key", "type").agg(*cells(prediction, truth), F.grouping("type").alias("whole")))


def summary(df: DataFrame, *by: str) -> DataFrame:
    """Total, correct and accuracy_strict (a missing answer is wrong)."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct")).withColumn("accuracy_strict", _share(F.col("correct"), F.col("total")))


def caught_and_errors(df: DataFrame) -> DataFrame:
    """Caught answers and the model's errors on covered questions for each run; zeros for runs without guard."""
    wrong = F.col("graph_covered") & F.col("llm_parsed").isNotNull() & (F.col("llm_parsed") != F.col("ground_truth"))
    return df.groupBy("run_key").agg(F.count_if(F.col("guarded") & F.col("caught")).alias("caught"), F.count_if(F.col("guarded") & wrong).alias("llm_errors"))


def query_set_stats(questions: DataFrame) -> DataFrame:
    """(type, source, total, true_n, false_n) of each type (source null) and of each source (type null), in one pass; a missing truth is in neither count."""
    return questions.groupingSets([["type"], ["source"]], "type", "source").agg(F.count("*").alias("total"), F.count_if("ground_truth").alias("true_n"), F.count_if(~F.col("ground_truth")).alias("false_n"))


def last_of_each(df: DataFrame, *keys: str) -> DataFrame:
    """The row of greatest idx for each key."""
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("idx")))).where("rn_ = 1").drop("rn_")


def paired(baseline: DataFrame, guarded: DataFrame, *more: str) -> DataFrame:
    """Guarded records with the outcome against the baseline's last record of the same question (and of the columns more)."""
    last = last_of_each(baseline, *more, "question").select(*more, "question", F.col("is_correct").alias("base_correct"))
    b, g = F.col("base_correct"), F.col("is_correct")
    outcome = F.when(~b & g, "intercepted").when(b & ~g, "false_alarm").when(b & g, "both_correct").otherwise("both_wrong")
    return guarded.join(last, [*more, "question"]).withColumn("outcome", outcome)


def interception(pairs: DataFrame, *by: str) -> DataFrame:
    """Counts of outcomes and the rate of intercepted errors: 100 if there were none (rate_or_zero: 0)."""
    n = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    out = pairs.groupBy(*by).agg(n("intercepted"), n("false_alarm"), n("both_correct"), n("both_wrong"))
    out = out.withColumn("llm_errors", F.col("intercepted") + F.col("both_wrong"))
    share = _share(F.col("intercepted"), F.col("llm_errors"))
    return out.withColumn("interception_rate", F.when(F.col("llm_errors") > 0, share).otherwise(100.0)).withColumn("rate_or_zero", share)


def outcome_questions(pairs: DataFrame, outcome: str, most: int) -> DataFrame:
    """The first `most` questions of an outcome in the order of idx (a report's list)."""
    return pairs.where(F.col("outcome") == outcome).select("idx", "question").orderBy("idx").limit(most)


def covered_details(coverage: DataFrame) -> DataFrame:
    """The covered rows of coverage records."""
    return coverage.where("covered").select("idx", "epistemic_state", "pattern_type", "question", "category")


def coverage_rates(df: DataFrame, *by: str) -> DataFrame:
    """Total, covered, coverage rate and non-interference in percent, two digits; zero rows give zero."""
    n, c = F.count("*"), F.count_if("covered")
    out = df.groupBy(*by).agg(n.alias("total"), c.alias("covered")) if by else df.agg(n.alias("total"), c.alias("covered"))
    return out.withColumn("coverage_rate", _share(F.col("covered"), F.col("total"), 2)).withColumn("non_interference", _share(F.col("total") - F.col("covered"), F.col("total"), 2))


def running_coverage(df: DataFrame, every: int = 100, fan: int = FAN) -> DataFrame:
    """Covered so far and its rate at each `every`-th row in the order of idx (unique, from 1).

    Rows are counted by blocks first; what comes before a block is summed up over blocks of blocks, at as many levels as it takes.
    """
    blocks = df.groupBy(F.floor((F.col("idx") - 1) / every).alias("block")).agg(F.count_if("covered").alias("c"), F.count("*").alias("n"))
    out = before(blocks, "block", ("c", "n"), fan=fan).where(F.col("n") == every)
    covered, seen = F.col("c_before") + F.col("c"), F.col("n_before") + F.col("n")
    return out.select((F.col("block") * every + every).cast("long").alias("idx"), covered.alias("covered"), _share(covered, seen, 2).alias("rate"))


def running_accuracy(records: DataFrame, *by: str) -> DataFrame:
    """(by, idx, seen, correct, accuracy_strict): of each row in the order of idx, how many rows and right answers its run has so far."""
    out = running(records.select(*by, "idx", F.col("is_correct").cast("long").alias("one")), ["idx"], {"seen": F.lit(1), "correct": F.col("one")}, by)
    return out.select(*by, "idx", "seen", "correct", _share(F.col("correct"), F.col("seen")).alias("accuracy_strict"))


def fixed_rows(counts: DataFrame, key: str, order, values: tuple) -> DataFrame:
    """counts for each of a fixed list of keys in order, zero where missing."""
    rows = counts.sparkSession.createDataFrame([(i, k) for i, k in enumerate(order)], f"ord int, {key} string")
    return rows.join(counts, key, "left").na.fill(0, list(values))


def deltas(df: DataFrame) -> DataFrame:
    """Guarded minus baseline accuracy for each model and type, of rounded values; pairs with both runs only."""
    s = summary(df.withColumn("base_", F.regexp_replace("run_key", "_(baseline|guarded)$", "")), "base_", "type", "guarded")
    wide = s.groupBy("base_", "type").pivot("guarded", [False, True]).agg(F.first("accuracy_strict"))
    return wide.where("`false` is not null and `true` is not null").select(F.col("base_").alias("model"), "type", F.col("false").alias("baseline"), F.col("true").alias("guarded"), F.round(F.col("true") - F.col("false"), 1).alias("delta"))
