"""Report tables as data frames: rows in a fixed order with formatted columns, ready to be written as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimforge.functions import constants as C
from claimforge.operators import evaluate as E
from claimforge.operators import metrics as M
from claimforge.operators.tables import stored
from claimforge.sources.kb import KnowledgeBase, stats


def _pct(c: str) -> Column:
    return F.format_string("%5.1f%%", F.col(c))


def confusion_block(records: DataFrame) -> DataFrame:
    """(run_key, ord, line): the four cells of each run."""
    cm = M.confusion(records, "run_key")
    lines = [F.format_string("%-10s %6d  %-10s %6d", F.lit(a), F.col(x), F.lit(b), F.col(y)) for a, x, b, y in (("TP", "tp", "FN", "fn"), ("FP", "fp", "TN", "tn"))]
    return cm.select("run_key", F.posexplode(F.array(*lines)).alias("ord", "line"))


def rates_table(records: DataFrame) -> DataFrame:
    """(run_key, line): precision, recall, F1, accuracy and specificity."""
    r = M.rates(M.confusion(records, "run_key"))
    cols = ("precision", "recall", "f1", "accuracy", "specificity")
    return r.select("run_key", F.concat(F.rpad("run_key", 20, " "), *[F.concat(F.lit(" "), _pct(c)) for c in cols]).alias("line"))


def per_type_table(records: DataFrame, types, missing: str = "N/A") -> DataFrame:
    """run_key and a formatted accuracy for each of the types."""
    acc = M.rates(M.confusion(records, "run_key", "type"))
    wide = acc.groupBy("run_key").pivot("type", list(types)).agg(F.first(_pct("accuracy")))
    return wide.select("run_key", *[F.coalesce(F.col(f"`{t}`"), F.lit(missing)).alias(t) for t in types])


def cross_model_table(records: DataFrame, types) -> DataFrame:
    """Overall and per-type strict accuracy of each run, zero for a missing type."""
    whole = M.summary(records, "run_key").select("run_key", F.col("accuracy_strict").alias("overall"))
    wide = M.summary(records, "run_key", "type").groupBy("run_key").pivot("type", list(types)).agg(F.first("accuracy_strict"))
    return whole.join(wide, "run_key").na.fill(0.0)


def figures(records: DataFrame, types) -> DataFrame:
    """One row a run: accuracy of each type and overall, precision, recall, F1, and of a guarded run intercepted errors of all ("0/0 (none)" elsewhere)."""
    whole = M.rates(M.confusion(records, "run_key")).select("run_key", "precision", "recall", "f1", F.col("accuracy").alias("overall"))
    wide = M.rates(M.confusion(records, "run_key", "type")).groupBy("run_key").pivot("type", list(types)).agg(F.first("accuracy"))
    caught = interception_table(records).select(F.concat("base_model", F.lit("_guarded")).alias("run_key"), F.concat_ws("/", "intercepted", "llm_errors").alias("caught"))
    return whole.join(wide, "run_key").join(caught, "run_key", "left").na.fill(0.0, list(types)).na.fill("0/0 (none)", ["caught"])


def interception_table(records: DataFrame) -> DataFrame:
    """Outcomes of each model's guarded run against its baseline; false alarms are not the false positives of a confusion matrix."""
    df = records.withColumn("base_model", E.base_model(F.col("run_key")))
    pairs = M.paired(df.where("not guarded"), df.where("guarded"), "base_model")
    return M.interception(pairs, "base_model")


def interception_by_name(records: DataFrame, order) -> DataFrame:
    """(ord, label, llm_errors, caught, rate, false_alarms) of models with display labels in a given order; false alarms are the guarded run's false positives, zero without one."""
    names = records.sparkSession.createDataFrame([(i, k, label) for i, (k, label) in enumerate(order)], "ord int, base_model string, label string")
    fp = M.confusion(records.where("guarded").withColumn("base_model", E.base_model(F.col("run_key"))), "base_model").select("base_model", F.col("fp").alias("false_alarms"))
    out = names.join(interception_table(records), "base_model").join(fp, "base_model", "left").na.fill(0, ["false_alarms"])
    return out.select("ord", "label", "llm_errors", F.col("intercepted").alias("caught"), F.col("interception_rate").alias("rate"), "false_alarms")


def kb_table(kb: KnowledgeBase) -> DataFrame:
    return stats(kb)


def accuracy_table(records: DataFrame, order) -> DataFrame:
    """Strict accuracy with display labels, in a given order of (run_key, label)."""
    names = records.sparkSession.createDataFrame([(i, k, label) for i, (k, label) in enumerate(order)], "ord int, run_key string, label string")
    return names.join(M.summary(records, "run_key"), "run_key").select("ord", "label", "total", "correct", "accuracy_strict")


def coverage_table(records: DataFrame) -> DataFrame:
    """Coverage by pattern, all four patterns, with the share of questions."""
    counts = records.groupBy("pattern_type").agg(F.count("*").alias("total"), F.count_if("covered").alias("covered"))
    out = M.fixed_rows(counts, "pattern_type", C.PATTERNS, ("total", "covered"))
    whole = F.sum("total").over(Window.partitionBy())  # four rows
    return out.select("ord", "pattern_type", "total", "covered", M._share(F.col("total"), whole).alias("share"))


def coverage_report(coverage: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ord, line) of a coverage run: totals, the knowledge base's size, all four patterns, and every covered question.

    nodes: the distinct classes known, one row each. Lines sort by ord; idx has at most 19 digits. The records are written once, as three parts read them.
    """
    coverage = stored(coverage.select("idx", "question", "category", "pattern_type", "covered", "epistemic_state"))
    whole = M.coverage_rates(coverage).join(nodes.agg(F.count("*").alias("nodes")), F.lit(True))  # one row each
    text = lambda label, form, *c: F.format_string(f"%-24s: {form}", F.lit(label), *map(F.col, c))
    totals = F.array(
        text("Questions", "%d", "total"), text("Classes known", "%d", "nodes"), text("Covered", "%d (%.1f%%)", "covered", "coverage_rate"),
        F.format_string("%-24s: %d (%.1f%%)", F.lit("Not covered"), F.col("total") - F.col("covered"), F.col("non_interference")),
    )
    a = whole.select(F.posexplode(totals).alias("ord", "line")).select(F.format_string("1 %d", "ord").alias("ord"), "line")
    by = coverage_table(coverage).withColumn("rate", M._share(F.col("covered"), F.col("total")))
    b = by.select(F.format_string("2 %d", "ord").alias("ord"), F.format_string("%-16s total=%4d covered=%3d (%.1f%%)", "pattern_type", "total", "covered", "rate").alias("line"))
    d = M.covered_details(coverage).select(F.format_string("3 %019d", F.col("idx").cast("long")).alias("ord"), F.format_string("[%-6s] [%-12s] %s", "epistemic_state", "pattern_type", "question").alias("line"))
    return a.unionByName(b).unionByName(d)


def metrics_report(records: DataFrame) -> DataFrame:
    """(ord, line) of the whole report: rates, then confusion blocks, then outcomes."""
    a = rates_table(records).select(F.concat(F.lit("1 "), "run_key").alias("ord"), "line")
    b = confusion_block(records).select(F.concat(F.lit("2 "), "run_key", F.lit(" "), F.col("ord").cast("string")).alias("ord"), "line")
    t = interception_table(records)
    c = t.select(F.concat(F.lit("3 "), "base_model").alias("ord"), F.format_string("%-20s %d intercepted, %d false alarms, %5.1f%%", F.col("base_model"), F.col("intercepted"), F.col("false_alarm"), F.col("interception_rate")).alias("line"))
    return a.unionByName(b).unionByName(c)
