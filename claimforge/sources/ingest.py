"""Readers of theories, questions, results and tables of questions, and writers of documents and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimforge.functions.text import isa_fact, strip
from claimforge.operators import metrics as M
from claimforge.operators.running import numbered_rows
from claimforge.sources.sharded import numbered_lines, write_lines

QUESTION = T.StructType([T.StructField("question", T.StringType()), T.StructField("ground_truth", T.BooleanType()), T.StructField("type", T.StringType()), T.StructField("source", T.StringType())])
WRAPPERS = ("train", "dev", "test", "data", "examples")  # fixed values: names of a document's list of entries, in order


def theory_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): all .json and .jsonl files below a folder, whole documents or, of .jsonl, single lines that start with '{'."""
    read = lambda glob: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    whole = read("*.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    lines = read("*.jsonl").text(path).select(F.col("_metadata.file_path").alias("path"), strip(F.col("value")).alias("text")).where(F.col("text").startswith("{"))
    return whole.unionByName(lines)


def theory_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, kind, text) of every line of the .jsonl files below a folder, idx from 0 in each file; nothing is dropped silently.

    kind: entry (a JSON object), rejected (begins like one and doesn't parse), or skipped (anything else, blank lines too).
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
    text = strip(F.col("value"))
    kind = F.when(~text.startswith("{"), "skipped").when(F.try_parse_json(text).isNull(), "rejected").otherwise("entry")
    return numbered_lines(lines, ("path",)).select("path", "idx", kind.alias("kind"), text.alias("text"))


def line_counts(lines: DataFrame) -> DataFrame:
    """(path, n_entries, n_rejected, n_skipped, first_rejected) of theory_lines: counts of each file and the place of its first rejected line."""
    n = lambda k: F.count_if(F.col("kind") == k)
    return lines.groupBy("path").agg(n("entry").alias("n_entries"), n("rejected").alias("n_rejected"), n("skipped").alias("n_skipped"), F.min(F.when(F.col("kind") == "rejected", F.col("idx"))).alias("first_rejected"))


def theory_entries(documents: DataFrame) -> DataFrame:
    """(path, pos, entry): entries as variants. A list gives its items, a document with triples or questions itself, another the first
    of its lists under a known name; what doesn't parse gives nothing."""
    v = documents.withColumn("v", F.try_parse_json("text")).where("v is not null")
    items = lambda at: F.try_variant_get("v", at, "array<variant>")
    single = F.try_variant_get("v", "$.triples", "variant").isNotNull() | F.try_variant_get("v", "$.questions", "variant").isNotNull()
    found = F.coalesce(items("$"), F.when(single, F.array("v")), *[items(f"$.{k}") for k in WRAPPERS])
    return v.select("path", F.posexplode(found).alias("pos", "entry"))


def isa_pairs(entries: DataFrame) -> DataFrame:
    """Distinct (child, parent) of 'X is a Y' sentences: keys of a triples object (two letters at least), or items of a list."""
    keys = F.map_keys(F.try_variant_get("entry", "$.triples", "map<string,variant>"))
    listed = F.try_variant_get("entry", "$.triples", "array<string>")
    a = entries.select(F.explode(keys).alias("s")).select(isa_fact(F.col("s"), 2).alias("f"))
    b = entries.select(F.explode(listed).alias("s")).select(isa_fact(F.col("s"), 1).alias("f"))
    return a.unionByName(b).where("f.child is not null").select("f.*").distinct()


def capped(entries: DataFrame, files: int, per_file: int) -> DataFrame:
    """The first entries of the first files by path, for those who want a limit."""
    first = entries.select("path").distinct().orderBy("path").limit(files)
    return entries.join(F.broadcast(first), "path", "left_semi").where(F.col("pos") < per_file)  # `files` rows at most


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(idx, question, ground_truth, type, source) of documents with a list of queries; idx is a question's own or its place in the list."""
    schema = T.StructType([T.StructField("queries", T.ArrayType(T.StructType([T.StructField("idx", T.LongType()), *QUESTION.fields])))])
    placed = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("queries").alias("place", "q"))
    return placed.select(F.coalesce("q.idx", F.col("place").cast("long")).alias("idx"), *[f"q.{n}" for n in QUESTION.names])


def read_results(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """(run_key, idx, record...) of a document whose results map runs to lists of records; idx is the record's own or its place in the list. No run, no rows."""
    schema = T.StructType([T.StructField("results", T.MapType(T.StringType(), T.ArrayType(record)))])
    runs = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("results").alias("run_key", "records"))
    placed = runs.select("run_key", F.posexplode("records").alias("place", "r"))
    own = F.coalesce("r.idx", "place") if "idx" in record.names else F.col("place")
    return placed.select("run_key", own.cast("long").alias("idx"), *[f"r.{n}" for n in record.names if n != "idx"])


def read_question_table(spark: SparkSession, path: str) -> DataFrame:
    """(question, category) of a CSV with a header in either capitalisation; no blank questions; category Unknown if missing."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return question_rows(_question_columns(raw, raw.columns))


def _question_columns(raw: DataFrame, columns, *more: str) -> DataFrame:
    names = {c.strip().lower(): c for c in columns}
    pick = lambda n: strip(F.col(f"`{names[n]}`")) if n in names else F.lit(None).cast("string")
    return raw.select(pick("question").alias("question"), pick("category").alias("category"), *more)


def numbered_question_table(spark: SparkSession, path: str) -> DataFrame:
    """read_question_table with idx, a row's place by name of file and place in it, from 0: the same whatever tasks read the files."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    rows = _question_columns(raw.withColumns({"path": F.col("_metadata.file_path"), "id_": F.monotonically_increasing_id()}), raw.columns, "path", "id_")
    return numbered_rows(question_rows(rows), ["path", "id_"]).drop("path", "id_")


def question_rows(df: DataFrame) -> DataFrame:
    """Rows whose question is not blank, null included; a missing category is Unknown."""
    return df.where(strip(F.col("question")) != "").withColumn("category", F.coalesce("category", F.lit("Unknown")))


def numbered(df: DataFrame, group: str, order: str) -> DataFrame:
    """df with pos, the place in its group from 0; groups are documents, whose entries fit a task."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def optional_json(spark: SparkSession, path: str, schema: T.StructType, required: bool = True) -> DataFrame:
    """A JSON document, an empty frame if it is missing and not required."""
    if exists(spark, path):
        return spark.read.schema(schema).option("multiLine", True).json(path)
    if required:
        raise FileNotFoundError(path)
    return spark.createDataFrame([], schema)


def write_document(df: DataFrame, path: str, name: str = "rows") -> None:
    """One JSON document with all rows as a list, for reports of bounded size."""
    df.agg(F.collect_list(F.struct("*")).alias(name)).coalesce(1).write.mode("overwrite").json(path)


def write_questions(questions: DataFrame, path: str, block: int = 100_000) -> None:
    """Documents that read_questions reads, one for each `block` of idx (not null), so that no row holds a large table."""
    rows = F.struct("idx", *QUESTION.names)
    documents = questions.groupBy(F.floor(F.col("idx") / block).alias("block")).agg(F.array_sort(F.collect_list(rows)).alias("queries"))
    documents.write.partitionBy("block").mode("overwrite").json(path)


def run_summaries(records: DataFrame) -> DataFrame:
    """(run_key, summary) of each run."""
    return M.summary(records, "run_key").select("run_key", F.struct("total", "correct", "accuracy_strict").alias("summary"))


def write_results(records: DataFrame, path: str, metadata: dict | None = None, block: int = 100_000, summaries: DataFrame | None = None) -> None:
    """Documents that read_results reads: metadata, summaries of each run, and each run's records in the order of idx.

    There is one document for each `block` of idx (not null), so that no row holds a large table; all have the whole runs' summaries
    (run_summaries, if they are at hand: of these runs at least).
    """
    summaries = run_summaries(records) if summaries is None else summaries
    rows = [c for c in records.columns if c not in ("run_key", "idx")]
    runs = records.groupBy(F.floor(F.col("idx") / block).alias("block"), "run_key").agg(F.array_sort(F.collect_list(F.struct("idx", *rows))).alias("rows")).join(summaries, "run_key")
    table = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("run_key", c))))
    notes = F.create_map(*[F.lit(str(x)) for kv in metadata.items() for x in kv]) if metadata else F.lit(None).cast("map<string,string>")
    documents = runs.groupBy("block").agg(table("summary").alias("summaries"), table("rows").alias("results")).withColumn("metadata", notes)
    documents.write.partitionBy("block").mode("overwrite").json(path)


def write_report(lines: DataFrame, path: str) -> None:
    """(ord, line) as text in order, in parts with a manifest; `sharded.read_lines` reads them."""
    write_lines(lines, path, ["ord"])
