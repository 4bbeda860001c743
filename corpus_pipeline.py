"""The corpus pipeline: quality, near-duplicates, repeated substrings, mixing, tokens.

Each stage is a function of (spark, docs, sf_dir) that works on all rows its predecessor kept. All but the last return the
columns of documents. ``run`` applies them to the documents table, written between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.llm.common import cut, read_table
from claimforge.llm.mixing import label_weights, repeats
from claimforge.llm.prefix_bpe import bpe_round_trip
from claimforge.llm.quality import classify_rows, grades_of, train
from claimforge.llm.similar import one_of_each, similar_components
from claimforge.llm.suffix_dedup import suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is at least one half."""
    model = train(grades_of(read_table(spark, sf_dir, "labels")), docs)
    return classify_rows(_documents(docs), model).where("keep").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of pairs with 0.8 or more of their five-word shingles in common, repeated rows included.

    It is the one of least doc_id, null ids last, then of the least hash of its columns.
    """
    docs = _documents(docs).withColumn("row", F.xxhash64(*COLUMNS))  # repeated rows share it
    member = similar_components(docs.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row").distinct()
    ids = docs.select("row", F.struct(F.isnull("doc_id").alias("null"), "doc_id", "row").alias("rank")).distinct()
    first = cut(member.join(ids, "row").groupBy("root").agg(F.min("rank")["row"].alias("row")).select("row"))
    kept = docs.join(first, "row", "left_semi")
    return one_of_each(kept, docs.select("row"), "row").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that an earlier string of 100 bytes covers; parts of cut characters go too, empty documents too."""
    docs = _documents(docs)
    return suffix_dedup(docs, more=("lang", "source"), text=True).select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars")).where("n_chars > 0")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents labelled as good come first."""
    return repeats(_documents(docs), quality=label_weights(read_table(spark, sf_dir, "labels")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    import public_tokenizers

    with open(public_tokenizers.path(TOKENIZER), "rb") as f:
        out = bpe_round_trip(docs, f.read(), public_tokenizers.PATTERN)
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: SQL expresses neither the classifier nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
