"""Readers and writers on small files, and validation of a stream."""

import json

import pytest

from pyspark.sql import functions as F

from claimforge.operators.closure import closure
from claimforge.plans import reports as R
from claimforge.plans.catalog import records
from claimforge.sources import ingest as I
from claimforge.sources import kb as K
from claimforge.sources.answers import attempts, read_answer_log, replayed
from claimforge.sources.sharded import read_lines
from claimforge.streaming.totals import totals, totals_stream
from claimforge.streaming.validation import validate_stream


def test_theories(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.json").write_text(json.dumps({"triples": {"Rex is a dog.": 1, "x is a y.": 2, "Rex is big": 3}}))
    (tmp_path / "a/two.json").write_text(json.dumps({"meta": 1, "test": [{"triples": ["Tom is a cat.", "q is a z"]}, {"triples": []}]}))
    (tmp_path / "three.json").write_text(json.dumps([{"triples": {"Ada is an owl": 1}}]))
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "l.jsonl").write_text('{"triples": ["Cat is a cat."]}\nnot this\n{broken\n')
    entries = I.theory_entries(I.theory_documents(spark, str(tmp_path)))
    assert {tuple(r) for r in I.isa_pairs(entries).collect()} == {("rex", "dog"), ("tom", "cat"), ("q", "z"), ("ada", "owl"), ("cat", "cat")}
    first = sorted({r.path for r in entries.collect()})[:2]
    assert [(r.path, r.pos) for r in I.capped(entries, 2, 1).orderBy("path").collect()] == [(p, 0) for p in first]


def test_tables_and_documents(spark, tmp_path):
    csv = tmp_path / "t.csv"
    csv.write_text('Type,category,Question\nA,X," Are all dogs mammals? "\nB,,"say ""hi"", ok"\nC,Z,\n')
    assert {tuple(r) for r in I.read_question_table(spark, str(csv)).collect()} == {("Are all dogs mammals?", "X"), ('say "hi", ok', "Unknown")}
    q = tmp_path / "q.json"
    q.write_text(json.dumps({"metadata": {}, "queries": [{"question": "a", "ground_truth": True, "type": "t", "source": "s"}, {"question": "b"}]}))
    assert [r.idx for r in I.read_questions(spark, str(q)).orderBy("idx").collect()] == [0, 1]
    r = tmp_path / "r.json"
    r.write_text(json.dumps({"results": {"m_baseline": [{"question": "a"}], "m_guarded": []}}))
    assert I.read_results(spark, str(r), I.QUESTION).select("run_key", "question").collect()[0][:] == ("m_baseline", "a")
    assert I.optional_json(spark, str(tmp_path / "none.json"), I.QUESTION, required=False).count() == 0


def test_kb_round_trip(spark, tmp_path):
    kb = K.builtin(spark)
    K.write_json(kb, str(tmp_path / "kb"))
    back = K.read_json(spark, str(tmp_path / "kb"))
    for a, b in ((kb.isa, back.isa), (kb.has_prop, back.has_prop), (kb.rule, back.rule)):
        assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}


def test_report(spark, tmp_path):
    lines = R.metrics_report(records(spark, "/root/testdata/sf0.001"))
    I.write_report(lines, str(tmp_path / "report"))
    back = read_lines(spark, str(tmp_path / "report"))
    assert [r.line for r in back.orderBy("idx").collect()] == [r.line for r in lines.orderBy("ord").collect()] != []


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(0, "Are all dogs mammals?", "taxonomic"), (1, "If water boils, is it hot?", "hypothetical")], "idx int, question string, type string").write.parquet(str(src))
    kb = K.builtin(spark)
    stream = spark.readStream.schema("idx int, question string, type string").parquet(str(src))
    query = validate_stream(stream, kb, closure(kb.isa), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 2 and out.where(F.col("graph_answer")).count() == 2


def test_run(spark, tmp_path):
    from claimforge.plans.golden import questions
    from claimforge.plans.run import run

    q = tmp_path / "q.json"
    q.write_text(json.dumps({"queries": [{"question": t, "ground_truth": g, "type": k, "source": s} for _, t, g, k, s in questions()]}))
    (tmp_path / "theory").mkdir()
    (tmp_path / "theory/t.json").write_text(json.dumps({"triples": ["Rex is a dog."]}))
    spark.createDataFrame([("m", t, "yes") for t in {x[1] for x in questions()}], "model string, question string, raw string").write.parquet(str(tmp_path / "answers"))
    (tmp_path / "t.csv").write_text("Question,Category\nAre all dogs mammals?,X\nWhy?,Y\n")
    out = str(tmp_path / "out")
    assert run(spark, out, theories=str(tmp_path / "theory"), questions=str(q), answers=str(tmp_path / "answers"), table=str(tmp_path / "t.csv")) == ["kb", "validate", "metrics", "coverage", "report"]
    assert K.read_json(spark, f"{out}/kb").isa.where("child = 'rex'").count() == 1
    m = spark.read.parquet(f"{out}/metrics").first()
    assert (m.intercepted + m.both_wrong, m.false_alarm) == (65, 4)
    assert I.read_results(spark, f"{out}/results/m", I.QUESTION).groupBy("run_key").count().orderBy("run_key").collect()[0][:] == ("m_baseline", 175)
    lines = [r.line for r in read_lines(spark, f"{out}/coverage_report").orderBy("idx").collect()]
    assert lines[0].endswith(": 2") and lines[2].endswith(": 1 (50.0%)") and lines[-1].endswith("Are all dogs mammals?")
    assert spark.read.parquet(f"{out}/coverage").where("covered").count() == 1


def test_run_rules(spark, tmp_path, capsys):
    from claimforge.plans.run import run

    out, q = str(tmp_path / "out"), tmp_path / "q.json"
    with pytest.raises(FileNotFoundError):
        run(spark, out, ["validate"], questions=str(tmp_path / "none.json"), answers=str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        run(spark, out, ["metrics"])
    assert not I.exists(spark, out)
    q.write_text(json.dumps({"queries": [{"question": "Are all dogs mammals?", "ground_truth": True, "type": "taxonomic", "source": "s"}]}))
    spark.createDataFrame([("a", "Are all dogs mammals?", "no"), ("b", "Are all dogs mammals?", "yes")], "model string, question string, raw string").write.parquet(str(tmp_path / "answers"))
    files = {"questions": str(q), "answers": str(tmp_path / "answers"), "table": str(tmp_path / "none.csv")}
    assert run(spark, out, ["validate", "coverage"], models=["a", "x"], **files) == ["validate"]  # a missing table is only reported
    said = capsys.readouterr().out
    assert "unknown model: x" in said and "coverage left out" in said
    assert {r.run_key for r in spark.read.parquet(f"{out}/records").collect()} == {"a_baseline", "a_guarded"}
    with pytest.raises(ValueError):
        run(spark, out, ["validate"], models=["x"], **files)


def test_extend_keeps_order(spark):
    kb = K.builtin(spark)
    more = K.extend(kb, isa=spark.createDataFrame([("DOG", "Pet"), ("dog", "mammal"), ("dog", "dog"), ("", "x"), ("rex", "dog")], "child string, parent string"))
    of = lambda c: [r.parent for r in more.isa.where(F.col("child") == c).orderBy("pos").collect()]
    assert (of("dog"), of("rex"), of("")) == (["canine", "mammal", "animal", "living_thing", "pet"], ["dog"], [])
    assert more.rule is kb.rule


def test_closure_of_long_paths_and_cycles(spark):
    n = 300
    pairs = closure(spark.range(n).selectExpr("cast(id as string) as child", "cast(id + 1 as string) as parent"))
    assert pairs.count() == pairs.distinct().count() == n * (n + 1) // 2
    ring = closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "a"), ("x", "x")], "child string, parent string"))
    assert {tuple(r) for r in ring.collect()} == {(x, y) for x in "abc" for y in "abcd"} | {("x", "x")} and ring.count() == 13


def test_kb_in_blocks(spark, tmp_path):
    """Lists cut into several documents keep their order, with pos and by names without it."""
    kb = K.builtin(spark)
    K.write_json(kb, str(tmp_path / "kb"), block=2)
    back = K.read_json(spark, str(tmp_path / "kb"))
    for a, b in ((kb.isa, back.isa), (kb.has_prop, back.has_prop), (kb.rule, back.rule)):
        assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    plain = K.KnowledgeBase(spark.createDataFrame([("a", "z"), ("a", "b"), ("a", "m"), ("a", "b")], "child string, parent string"), kb.has_prop.drop("pos").limit(0), kb.rule.drop("pos").limit(0))
    K.write_json(plain, str(tmp_path / "plain"), block=2)
    back = K.read_json(spark, str(tmp_path / "plain"))
    assert [tuple(r) for r in back.isa.orderBy("pos").collect()] == [("a", 0, "b"), ("a", 1, "m"), ("a", 2, "z")] and back.rule.count() == 0


def test_lines_of_theories(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.jsonl").write_text('{"triples": ["Cat is a pet."]}\nnot this\n{broken\n\n  {"triples": {}} \n{"a": }\n')
    (tmp_path / "y.jsonl").write_text("{nothing}\n")
    lines = I.theory_lines(spark, str(tmp_path))
    assert [(r.idx, r.kind) for r in lines.where("path like '%x.jsonl'").orderBy("idx").collect()] == [(0, "entry"), (1, "skipped"), (2, "rejected"), (3, "skipped"), (4, "entry"), (5, "rejected")]
    assert sorted(tuple(r)[1:] for r in I.line_counts(lines).collect()) == [(0, 1, 0, 0), (2, 2, 2, 2)]


def test_answers_of_a_log(spark, tmp_path):
    """Retries, attempts logged twice, errors, late attempts, broken lines, and questions that nobody answered."""
    rows = [("m", "a", 1, 1, None), ("m", "a", 2, 2, "Yes"), ("m", "a", 3, 3, "No"), ("m", "b", 1, 1, "no"), ("m", "b", 1, 5, "yes"), ("m", "c", 4, 1, "yes"), ("m", "d", 1, 1, "[llm_error]"), ("n", "a", 1, 1, "yes"), ("n", "a", 1, 2, None)]
    text = "\n".join(json.dumps({"model": m, "question": q, "attempt": k, "at": f"2020-01-01T00:00:0{t}Z", "raw": x}) for m, q, k, t, x in rows) + "\n{broken\n"
    (tmp_path / "log.json").write_text(text)
    asked = spark.createDataFrame([(m, q) for m in "mn" for q in "abcd"] + [("m", "a")], "model string, question string")
    log = read_answer_log(spark, str(tmp_path))
    want = {(m, q): "[llm_error]" for m in "mn" for q in "abcd"} | {("m", "a"): "Yes", ("m", "b"): "yes"}
    for again in (log, log.unionByName(log).repartition(3)):
        got = replayed(again, asked).collect()
        assert {(r.model, r.question): r.raw for r in got} == want and len(got) == 8
    assert replayed(log, asked, tries=4).where("model = 'm' and question = 'c'").first().raw == "yes"


def test_totals_of_a_stream_after_a_restart(spark, tmp_path):
    rec = records(spark, "/root/testdata/sf0.001").select("run_key", "is_correct", "graph_covered", "idx")
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    stream = lambda: spark.readStream.schema(rec.schema).option("maxFilesPerTrigger", 1).parquet(src)
    for part in range(3):  # a new query each time, which finds its state in the checkpoint
        rec.where(f"idx % 3 = {part}").coalesce(2).write.mode("append").parquet(src)
        totals_stream(stream(), out, cp).awaitTermination(120)
    want = {r.run_key: (r.n, r.c, r.k) for r in rec.groupBy("run_key").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("c"), F.count_if("graph_covered").alias("k")).collect()}
    assert {r.run_key: (r.total, r.correct, r.covered) for r in totals(spark, out).collect()} == want


def test_run_again(spark, tmp_path, monkeypatch):
    """A run that stopped goes on with the step that wasn't finished; changed inputs are done again, or refused behind an earlier step."""
    from claimforge.plans import run as X

    q, out = tmp_path / "q.json", str(tmp_path / "out")
    ask = lambda t: q.write_text(json.dumps({"queries": [{"question": t, "ground_truth": True, "type": "taxonomic", "source": "s"}]}))
    ask("Are all dogs mammals?")
    (tmp_path / "t.csv").write_text("Question,Category\nAre all dogs mammals?,X\nAre all cats mammals?,X\nAre all bats mammals?,X\n")
    spark.createDataFrame([("a", "Are all dogs mammals?", "no"), ("a", "Are all cats mammals?", "no")], "model string, question string, raw string").write.parquet(str(tmp_path / "answers"))
    files = {"questions": str(q), "answers": str(tmp_path / "answers"), "table": str(tmp_path / "t.csv")}
    real = X.R.interception_table
    monkeypatch.setattr(X.R, "interception_table", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        X.run(spark, out, **files)
    monkeypatch.setattr(X.R, "interception_table", real)
    assert X.run(spark, out, resume=True, **files) == ["metrics", "coverage", "report"]
    assert X.run(spark, out, resume=True, **files) == []
    assert [r.question for r in spark.read.parquet(f"{out}/coverage").orderBy("idx").collect()] == [f"Are all {x} mammals?" for x in ("dogs", "cats", "bats")]
    ask("Are all cats mammals?")
    with pytest.raises(ValueError):
        X.run(spark, out, ["metrics", "report"], **files)
    assert X.run(spark, out, resume=True, **files) == ["validate", "metrics", "report"]


def test_asking_models(spark, tmp_path):
    """A model that fails at first, one that fails always and one that says nothing; the log is written once and replayed."""
    asked = spark.createDataFrame([(m, f"q{i}") for m in ("slow", "broken", "mute", "fine") for i in range(5)], "model string, question string").repartition(3)

    def call(model, question, seen={}):  # noqa: B006  what a worker remembers
        if model == "broken" or model == "slow" and seen.setdefault((model, question), 0) < 1:
            seen[model, question] = 1
            raise TimeoutError(question)
        return "" if model == "mute" else f"Yes, {question}"

    attempts(asked, call).write.json(str(tmp_path / "log"))
    log = read_answer_log(spark, str(tmp_path / "log"))
    assert {r.model: r["count"] for r in log.groupBy("model").count().collect()} == {"slow": 10, "broken": 15, "mute": 15, "fine": 5}
    got = {(r.model, r.question): r.raw for r in replayed(log, asked).collect()}
    assert got == {(m, f"q{i}"): f"Yes, q{i}" if m in ("slow", "fine") else "[llm_error]" for m in ("slow", "broken", "mute", "fine") for i in range(5)}


def test_a_knowledge_base_is_parsed_once(spark, tmp_path):
    """What is read stays as it was read, though the document goes: parts that are read later don't parse it again."""
    from claimforge.sources.kb import read_json

    at = tmp_path / "kb.json"
    at.write_text('{"taxonomies": {"a": ["b", "c", "b"]}, "properties": {"a": ["p"]}, "conditionals": null}')
    kb = read_json(spark, str(at))
    at.unlink()
    assert {tuple(r) for r in kb.isa.collect()} == {("a", 0, "b"), ("a", 1, "c")} and {tuple(r) for r in kb.has_prop.collect()} == {("a", 0, "p")} and kb.rule.isEmpty()
