"""Steps of a whole evaluation from files: python -m claimforge.plans.run --steps kb,validate,metrics,coverage,report ..."""

from __future__ import annotations

import argparse
import json

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from claimforge.functions import constants as C
from claimforge.operators import evaluate as E
from claimforge.operators.closure import closure
from claimforge.operators.tables import stored
from claimforge.operators.validate import coverage, validate
from claimforge.plans import reports as R
from claimforge.sources import ingest as I
from claimforge.sources import kb as K
from claimforge.sources import theories as TH
from claimforge.sources.sharded import get_text, put_text

STEPS = ("kb", "validate", "metrics", "coverage", "report")


def missing(spark: SparkSession, out: str, steps, kb=None, theories=None, questions=None, answers=None) -> list[str]:
    """What the steps need and is not there: named inputs, and the records if no step makes them. A question table may be missing."""
    named = [p for p in (kb, theories if "kb" in steps else None, *((questions, answers) if "validate" in steps else ())) if p]
    gone = [p for p in named if not I.exists(spark, p)]
    if {"metrics", "report"} & set(steps) and "validate" not in steps and not I.exists(spark, f"{out}/records"):
        gone.append(f"{out}/records")
    return gone


def fingerprint(spark: SparkSession, path: str | None) -> list | None:
    """Names, sizes and times of change of the files at a path or below, in order; None if nothing is named or there."""
    if not path or not I.exists(spark, path):
        return None
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files, out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True), []
    while files.hasNext():
        f = files.next()
        out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(out)


class Ledger:
    """What each finished step has read: {out}/_steps/{step}.json is written once a step's outputs are there, and goes before it starts again."""

    def __init__(self, spark: SparkSession, out: str, reads: dict, says: dict):
        self.spark, self.out, self.reads, self.says = spark, out, reads, says

    def _path(self, step: str) -> str:
        return f"{self.out}/_steps/{step}.json"

    def now(self, step: str) -> dict:
        return {"reads": {p: fingerprint(self.spark, p) for p in self.reads[step] if p}, "says": self.says.get(step)}

    def state(self, step: str) -> str:
        """fresh: finished on what is there now; stale: finished on something else; open: not finished."""
        text = get_text(self.spark, self._path(step))
        return "open" if text is None else "fresh" if json.loads(text) == json.loads(json.dumps(self.now(step))) else "stale"

    def begin(self, step: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(step))
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, False)

    def end(self, step: str) -> None:
        put_text(self.spark, self._path(step), json.dumps(self.now(step)))


def run(spark: SparkSession, out: str, steps=STEPS, kb: str | None = None, theories: str | None = None, questions: str | None = None, answers: str | None = None, table: str | None = None, models=None, resume: bool = False) -> list[str]:
    """Runs the steps in their order and returns those that ran; a step whose input isn't named is left out.

    Nothing starts while a named input is missing, and a step that fails ends the run, but for coverage: it is only reported.
    kb writes {out}/kb, with facts of the theories merged in; validate writes {out}/records from questions (JSON) and answers
    (Parquet: model, question, raw), and {out}/results, a document of all and one of each model; metrics and report read the records;
    coverage writes {out}/coverage of a CSV of questions and its report. models: those of the answers to take; unknown ones are reported.

    Each step that ends leaves a manifest of what it has read. resume leaves out steps that ended on the same inputs. If a step that isn't among
    `steps` ended on inputs that have changed since, later ones would mix old and new: the run is refused.
    """
    if gone := missing(spark, out, steps, kb, theories, questions, answers):
        raise FileNotFoundError(", ".join(gone))
    made_kb, records_at = f"{out}/kb", f"{out}/records"
    reads = {"kb": [kb, theories], "validate": [kb, theories, questions, answers], "metrics": [records_at], "coverage": [kb, theories, table], "report": [records_at]}
    ledger = Ledger(spark, out, reads, {"validate": sorted(models) if models else None})
    named = {"kb": theories or kb, "validate": questions and answers, "coverage": table, "metrics": True, "report": True}
    if stale := [s for s in STEPS[: max((STEPS.index(s) for s in steps), default=0)] if s not in steps and named[s] and ledger.state(s) == "stale"]:
        raise ValueError(f"inputs have changed since: {', '.join(stale)}")
    done = []
    due = lambda step: step in steps and not (resume and ledger.state(step) == "fresh")

    def finished(step: str) -> None:
        ledger.end(step)
        done.append(step)

    known: list = []
    bases: list = []

    def base() -> K.KnowledgeBase:
        """The knowledge base of the steps after kb, read once."""
        if not bases:
            bases.append(K.read_json(spark, made_kb) if theories and I.exists(spark, made_kb) else K.read_json(spark, kb) if kb else K.builtin(spark))
        return bases[0]

    def closed():
        """The closure, for steps that need it."""
        if not known:
            known.append(closure(base().isa))
        return known[0]

    if due("kb"):
        ledger.begin("kb")
        merged = K.read_json(spark, kb) if kb else K.builtin(spark)
        if theories:
            entries = I.theory_entries(I.theory_documents(spark, theories))
            facts = TH.sentences(entries).select(TH.property_fact(F.col("sentence")).alias("f")).where("f is not null").select(F.col("f.a").alias("entity"), F.col("f.b").alias("prop"))
            merged = K.extend(merged, isa=I.isa_pairs(entries), has_prop=facts)
        K.write_json(merged, made_kb)
        finished("kb")
    if due("validate") and questions and answers:
        ledger.begin("validate")
        given = spark.read.parquet(answers)
        for r in E.unknown_keys(given, models, "model").orderBy("ord").collect() if models else ():  # as many as were asked for
            print(f"unknown model: {r.key}")
        given = E.select_runs(given, models, "model")
        if given.isEmpty():
            raise ValueError("no answers of the models asked for")
        E.records(validate(stored(I.read_questions(spark, questions)), base(), closed()), given).write.mode("overwrite").parquet(records_at)
        records = spark.read.parquet(records_at)
        summaries = stored(I.run_summaries(records))
        I.write_results(records, f"{out}/results/all", {"questions": questions}, summaries=summaries)
        for r in given.select("model").distinct().collect():  # one document a model
            I.write_results(records.where(E.base_model(F.col("run_key")) == r.model), f"{out}/results/{r.model}", {"model": r.model}, summaries=summaries)
        finished("validate")
    if due("metrics") and I.exists(spark, records_at):
        ledger.begin("metrics")
        R.interception_table(spark.read.parquet(records_at)).write.mode("overwrite").parquet(f"{out}/metrics")
        I.write_document(R.figures(spark.read.parquet(records_at), C.TYPES), f"{out}/metrics_document", "metrics")
        finished("metrics")
    if due("coverage") and table:
        ledger.begin("coverage")
        try:
            coverage(I.numbered_question_table(spark, table), base(), closed()).write.mode("overwrite").parquet(f"{out}/coverage")
            rows = spark.read.parquet(f"{out}/coverage")
            I.write_report(R.coverage_report(rows, closed().select("child").distinct()), f"{out}/coverage_report")
            finished("coverage")
        except PySparkException as e:
            print(f"coverage left out: {e}")
    if due("report") and I.exists(spark, records_at):
        ledger.begin("report")
        I.write_report(R.metrics_report(spark.read.parquet(records_at)), f"{out}/report")
        finished("report")
    return done


def main(argv=None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--out", required=True)
    p.add_argument("--steps", default=",".join(STEPS))
    p.add_argument("--start_from", choices=STEPS, default=STEPS[0])
    for name in ("kb", "theories", "questions", "answers", "table"):
        p.add_argument(f"--{name}")
    p.add_argument("--models", help="comma-separated; all of the answers if left out")
    p.add_argument("--resume", action="store_true", help="leave out steps that ended on the same inputs")
    a = p.parse_args(argv)
    chosen = a.steps.split(",")
    if unknown := [s for s in chosen if s not in STEPS]:
        p.error(f"unknown steps: {', '.join(unknown)}")
    steps = [s for s in STEPS[STEPS.index(a.start_from) :] if s in chosen]
    spark = SparkSession.builder.appName("evaluation").getOrCreate()
    print("ran:", ", ".join(run(spark, a.out, steps, a.kb, a.theories, a.questions, a.answers, a.table, a.models.split(",") if a.models else None, a.resume)))


if __name__ == "__main__":
    main()
