"""Golden verdicts, text functions, closure, evaluation."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimforge.functions import text as T
from claimforge.operators import evaluate as E
from claimforge.operators import metrics as M
from claimforge.operators.closure import closure
from claimforge.operators.validate import validate
from claimforge.plans.golden import questions
from claimforge.sources.kb import builtin, merge_pairs, stats

QUESTION = "idx int, question string, ground_truth boolean, type string, source string"


@pytest.fixture(scope="module")
def kb(spark):
    return builtin(spark)


@pytest.fixture(scope="module")
def closed(kb):
    return closure(kb.isa).cache()


def test_knowledge_base(kb, closed):
    assert {r.part: (r.n_keys, r.n_pairs) for r in stats(kb).collect()} == {"taxonomies": (115, 301), "properties": (24, 130), "conditionals": (31, 76)}
    assert closed.count() == 301


def test_golden_verdicts(spark, kb, closed):
    q = questions()
    assert (len(q), sum(x[2] for x in q), sum(x[4] == "original" for x in q)) == (175, 110, 100)
    df = spark.createDataFrame(q, QUESTION)
    strict = validate(df, kb, closed).collect()
    assert sum(not r.covered for r in strict) == 16
    assert {r.question for r in strict if r.covered and r.graph_answer != r.ground_truth} == {
        "Do all circles have a curved edge?", "If it is raining, do we need an umbrella?", "Do all mammals have warm blood?", "Do all reptiles have cold blood?",
    }
    by = {r.question: r for r in strict}
    assert by["Are all dogs mammals?"].proof == "BFS: dog → mammal = True"
    assert by["Are all horses mammals?"].proof == "Entity not in KB: hors"
    loose = {r.question: r for r in validate(df, kb, closed, loose=True).collect()}
    assert loose["If it is raining, do we need an umbrella?"].graph_answer
    assert loose["Are all horses mammals?"].epistemic_state == "SHAKK"


def test_odd_questions(spark, kb, closed):
    odd = [(0, None, "taxonomic"), (1, "", "categorical"), (2, "Are all dogs mammals?", "other"), (3, "Are all dogs mammals?", None), (4, "if", "hypothetical"), (5, "Are all dogs dogs?", "taxonomic")]
    out = {r.idx: r for r in validate(spark.createDataFrame(odd, "idx int, question string, type string"), kb, closed).collect()}
    assert [out[i].covered for i in range(6)] == [False] * 5 + [True]
    assert out[5].graph_answer and out[2].proof == "Unknown type"


def column(spark, f, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(f(F.col("v"))).collect()]


def test_text(spark):
    assert column(spark, T.clean_question, ["  X? ", "a ?", "b??\n", None]) == ["x", "a ", "b", None]
    got = column(spark, T.hypothetical, ["If X, is it not so?", "if a then b", "If water boils, does it need no oxygen?", "no such", "if , x"])
    assert [tuple(r) for r in got] == [("x", "so", True), ("a", "b", False), ("water boils", "need oxygen", True), (None, None, False), (None, None, False)]
    assert column(spark, T.yes_no, ["nothing", "is incorrect", "It is correct", "That is not so", "", None]) == [False, None, True, False, None, None]


def test_closure_on_cycles(spark):
    got = closure(spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), (None, "x")], "child string, parent string"))
    assert {tuple(r) for r in got.collect()} == {("a", "b"), ("a", "a"), ("a", "c"), ("b", "a"), ("b", "b"), ("b", "c")}
    assert closure(spark.createDataFrame([], "child string, parent string")).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=10))
def test_closure_is_the_fixpoint(spark, edges):
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    got = closure(spark.createDataFrame([(str(a), str(b)) for a, b in edges], "child string, parent string"))
    assert {(int(r.child), int(r.ancestor)) for r in got.collect()} == want


def test_merge(spark):
    isa = spark.createDataFrame([("a", "b")], "child string, parent string")
    new = spark.createDataFrame([("a", "b"), ("a", "a"), ("", "b"), ("c", "d"), ("c", "d")], "child string, parent string")
    both, added = merge_pairs(isa, new)
    assert {tuple(r) for r in added.collect()} == {("c", "d")} and both.count() == 2


def test_records_and_metrics(spark, kb, closed):
    q = spark.createDataFrame(questions(), QUESTION)
    answers = q.select(F.lit("m").alias("model"), "question", F.when(F.col("idx") % 4 == 0, "No.").when(F.col("idx") % 4 == 1, "hard to say").otherwise("Yes").alias("raw")).dropDuplicates(["question"])
    rec = E.records(validate(q, kb, closed), answers).cache()
    assert rec.count() == 350
    cm = {r.run_key: r for r in M.rates(M.confusion(rec, "run_key")).collect()}
    assert all(r.tp + r.tn + r.fp + r.fn == r.total == 175 for r in cm.values())
    pairs = M.paired(rec.where("not guarded"), rec.where("guarded"))
    x = M.interception(pairs).first()
    assert x.intercepted + x.false_alarm + x.both_correct + x.both_wrong == pairs.count() == 175
    assert M.confusion(rec.limit(0), "run_key").count() == 0
