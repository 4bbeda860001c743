"""Outputs of any size in order: ranges as parts whose names sort, and a manifest that is written last.

A folder without a manifest, or whose parts are not those that it lists, is the work of a run that did not end, and is refused.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.operators.running import numbered_rows

MANIFEST = "_manifest.json"


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def listed(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, time of change) of the files of a folder, or of the file itself, in the order of names; hidden ones are left out."""
    fs, where = _fs(spark, path)
    found = [(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(where) if s.isFile()]
    return sorted(x for x in found if x[0][0] not in "_.")


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there as a whole or not at all: it is written beside its name and then renamed."""
    fs, where = _fs(spark, path)
    _, draft = _fs(spark, f"{path}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(where, False)
    if not fs.rename(draft, where):
        raise OSError(f"can't write {path}")


def get_text(spark: SparkSession, path: str) -> str | None:
    """What put_text wrote; None if it isn't there."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_lines(df: DataFrame, path: str, order, line: str = "line") -> None:
    """The lines of df as text in an order, in as many parts as the data need. A manifest that was there goes first."""
    spark = df.sparkSession
    fs, old = _fs(spark, f"{path}/{MANIFEST}")
    fs.delete(old, False)
    df.orderBy(*order).select(F.col(line).alias("value")).write.mode("overwrite").text(f"{path}/parts")
    put_text(spark, f"{path}/{MANIFEST}", json.dumps({"parts": [[name, size] for name, size, _ in listed(spark, f"{path}/parts")]}))


def parts_of(spark: SparkSession, path: str) -> list[str]:
    """The parts of a folder that write_lines has finished, in order."""
    text = get_text(spark, f"{path}/{MANIFEST}")
    if text is None:
        raise FileNotFoundError(f"{path} has no manifest")
    want = [tuple(x) for x in json.loads(text)["parts"]]
    if want != [(name, size) for name, size, _ in listed(spark, f"{path}/parts")]:
        raise ValueError(f"the parts of {path} are not those of its manifest")
    return [f"{path}/parts/{name}" for name, _ in want]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(idx, line) of what write_lines wrote, idx from 0 in its order."""
    files = parts_of(spark, path)
    if not files:
        return spark.createDataFrame([], "idx long, line string")
    return numbered_lines(spark.read.text(files)).select("idx", F.col("value").alias("line"))


def numbered_lines(lines: DataFrame, keys=()) -> DataFrame:
    """Lines of text files with path and idx, their place by name of file and place in it (keys=('path',): in each file), whatever tasks read them."""
    at = lines.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start_"), F.monotonically_increasing_id().alias("id_"))
    return numbered_rows(at, ["path", "start_", "id_"] if "path" not in keys else ["start_", "id_"], "idx", keys).drop("start_", "id_")
