"""Running sums, ordered outputs and large documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from claimforge.operators import metrics as M
from claimforge.operators.running import before, numbered_rows, running
from claimforge.sources import ingest as I
from claimforge.sources.large_json import list_entries
from claimforge.sources.sharded import MANIFEST, read_lines, write_lines


@pytest.mark.parametrize("fan", [2, 7, 1024])
def test_prefix_sums(spark, fan):
    rng = random.Random(fan)
    rows = [(k, i, rng.randrange(9)) for k in ("a", None) for i in range(0, 90, 2 if k else 1)]
    got = before(spark.createDataFrame(rows, "k string, pos long, v long"), "pos", ["v"], ["k"], fan).collect()
    assert {(r.k, r.pos): r.v_before for r in got} == {(k, p): sum(v for x, q, v in rows if x == k and q < p) for k, p, _ in rows}


@pytest.mark.parametrize("fan", [2, 1024])
def test_running_sums(spark, fan):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(-3, 9)) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(7)
    for keys in ((), ("k",)):
        got = running(df, ["i"], {"total": F.col("v")}, keys, fan).collect()
        assert {r.i: r.total for r in got} == {i: sum(w for x, j, w in rows if j <= i and (x == k or not keys)) for k, i, _ in rows}
    assert [r.idx for r in numbered_rows(df, ["i"], fan=fan).orderBy("i").collect()] == list(range(400))
    assert running(df.limit(0), ["i"], {"total": F.col("v")}).count() == 0


def test_no_window_over_all_rows(spark):
    df = spark.range(1, 5001).select(F.col("id").alias("idx"), (F.col("id") % 3 == 0).alias("covered"))
    for out in (M.running_coverage(df, fan=4), numbered_rows(df, ["idx"], "n")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan.replace("BroadcastExchange", "") or "Window" not in plan.split("SinglePartition")[0]
        assert "Window" in plan
    got = {r.idx: (r.covered, r.rate) for r in M.running_coverage(df, fan=4).collect()}
    assert {i: c for i, (c, _) in got.items()} == {i: i // 3 for i in range(100, 5001, 100)}
    assert all(abs(rate - 100 * c / i) < 0.0051 for i, (c, rate) in got.items())


def test_lines_in_order(spark, tmp_path):
    at = str(tmp_path / "out")
    df = spark.range(5000).select(F.format_string("%05d", "id").alias("ord"), F.concat(F.lit("line "), "id").alias("line")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_lines(df, at, ["ord"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = read_lines(spark, at).orderBy("idx").collect()
    assert [r.idx for r in back] == list(range(5000)) and [r.line for r in back] == [f"line {i}" for i in range(5000)]
    assert len(list((tmp_path / "out/parts").glob("part-*"))) > 1
    write_lines(df.limit(0), str(tmp_path / "none"), ["ord"])
    assert read_lines(spark, str(tmp_path / "none")).count() == 0
    next((tmp_path / "out/parts").glob("part-*")).unlink()
    with pytest.raises(ValueError):
        read_lines(spark, at)
    (tmp_path / "out" / MANIFEST).unlink()
    with pytest.raises(FileNotFoundError):
        read_lines(spark, at)


def test_large_lists(spark, tmp_path):
    """Entries with braces, brackets, quotes and escapes in strings, nested lists, several tasks a file."""
    rng = random.Random(3)
    bits = ["}", "{", "]", "[", '"', "\\", "\\\\", '\\"', ",", "x is a y.", "é", "\n", "a: 1"]
    entry = lambda i: {"id": i, "triples": ["".join(rng.choice(bits) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 4))], "more": {"deep": [{"k": [1, {"z": "}"}]}, {}]}}
    (tmp_path / "a").mkdir()
    for name, n, indent in (("a/one.json", 300, None), ("two.json", 40, 2), ("empty.json", 0, None)):
        (tmp_path / name).write_text(json.dumps([entry(i) for i in range(n)], indent=indent, ensure_ascii=rng.random() < 0.5))
    (tmp_path / "wrapped.json").write_text(json.dumps({"train": [entry(0)]}))
    (tmp_path / "scalars.json").write_text("[1, 2]")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        shape = lambda df: sorted((r.path.rsplit("/", 1)[1], r.pos, json.dumps(json.loads(r.e), sort_keys=True)) for r in df.select("path", "pos", F.to_json("entry").alias("e")).collect())
        cut = shape(list_entries(spark, str(tmp_path), fan=8))
        tasks = spark.read.option("lineSep", "}").text(f"{tmp_path}/a/one.json").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = shape(I.theory_entries(I.theory_documents(spark, str(tmp_path))).where("path not like '%wrapped%' and path not like '%scalars%'"))
    assert cut == whole and len(cut) == 340 and tasks > 3


def test_shared_folder(spark, tmp_path):
    """The checkpoint folder, else the warehouse; a local warehouse is refused where executors run elsewhere. Tables go when they are dropped."""
    from types import SimpleNamespace

    from claimforge.operators import tables

    assert tables.shared_folder(spark) == spark.sparkContext.getCheckpointDir()
    table = tables.stored(spark.range(3))
    assert table.count() == 3 and I.exists(spark, table.stored_at)
    tables.dropped(table)
    assert not I.exists(spark, table.stored_at)
    sc = spark.sparkContext
    on = lambda master, **conf: SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master=master, _jvm=sc._jvm, _jsc=sc._jsc), conf={"spark.sql.warehouse.dir": str(tmp_path), **conf})
    assert tables.shared_folder(on("local[2]")) == f"{tmp_path}/_shared"
    assert tables.shared_folder(on("yarn", **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    with pytest.raises(ValueError):
        tables.shared_folder(on("yarn"))


def test_report_counts_what_it_lists(spark):
    """The records of a coverage report are made once: totals, patterns and lines agree even where a record comes out otherwise each time."""
    from claimforge.plans.reports import coverage_report

    coin = F.udf(lambda: random.random() < 0.5, "boolean").asNondeterministic()
    rows = spark.range(2000).select(F.col("id").alias("idx"), F.lit("q?").alias("question"), F.lit("c").alias("category"), F.lit("taxonomic").alias("pattern_type"), coin().alias("covered"), F.lit("YAQEEN").alias("epistemic_state"))
    lines = {r.ord: r.line for r in coverage_report(rows, spark.createDataFrame([("n",)], "child string")).collect()}
    said, listed = int(lines["1 2"].split(":")[1].split("(")[0]), sum(o.startswith("3 ") for o in lines)
    assert said == listed and f"covered={listed:3d} " in lines["2 0"]
