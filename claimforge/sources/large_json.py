"""Entries of JSON lists too large for one task: a document is cut after every closing brace, and prefix sums put the pieces together again.

Text readers cut files into byte ranges at any separator, so pieces come from many tasks. In a piece, escapes aside, quotes change
between text and structure; the parity of quotes so far says how a piece begins, and with it which of its brackets count. The sum of
brackets so far is the depth; a piece at whose end the depth is that of the list ends an entry, and the number of ends so far numbers them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.operators.running import FAN, running
from claimforge.operators.tables import stored
from claimforge.sources.sharded import numbered_lines


def _brackets(c, opening: str, closing: str):
    return F.regexp_count(c, F.lit(opening)) - F.regexp_count(c, F.lit(closing))


def list_entries(spark: SparkSession, path: str, fan: int = FAN, glob: str = "*.json") -> DataFrame:
    """(path, pos, entry) of the objects of JSON documents that are lists of objects, as `ingest.theory_entries` gives them, a document read by many tasks.

    path: a file or a folder, of which files with names like glob are read. Only objects of the outermost list are entries; documents that are no list give nothing here. An
    entry that doesn't parse is left out, and a document with unbalanced brackets may lose all that follows.
    """
    raw = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    pieces = stored(numbered_lines(raw, ("path",)).select("path", F.col("idx").alias("n"), F.col("value").alias("piece")))
    plain = F.regexp_replace("piece", r"(?s)\\.", "")  # escapes stand in strings only
    parts = F.split(plain, '"', -1)
    side = lambda odd: F.array_join(F.filter(parts, lambda x, i: i % 2 == odd), " ")
    marked = pieces.select("path", "n", (F.size(parts) - 1).alias("quotes"), *[(_brackets(side(k), r"[\[{]", r"[\]}]")).alias(f"delta{k}") for k in (0, 1)])
    quoted = running(marked, ["n"], {"all_quotes": F.col("quotes")}, ("path",), fan)
    inside = (F.col("all_quotes") - F.col("quotes")) % 2  # 1: the piece begins within a string
    closes = (F.col("all_quotes") % 2 == 0).cast("int")  # the brace behind the piece is one of the structure
    depth = quoted.select("path", "n", (F.when(inside == 1, F.col("delta1")).otherwise(F.col("delta0")) - closes).alias("delta"), closes.alias("closes"))
    deep = running(depth, ["n"], {"depth": F.col("delta")}, ("path",), fan)
    ended = running(deep.withColumn("end", ((F.col("depth") == 1) & (F.col("closes") == 1)).cast("long")), ["n"], {"ends": F.col("end")}, ("path",), fan)
    owner = ended.select("path", "n", (F.col("ends") - F.col("end")).alias("pos"))
    whole = pieces.join(owner, ["path", "n"]).groupBy("path", "pos").agg(F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("pieces"))
    lists = pieces.where(F.col("n") == 0).where(F.col("piece").rlike(r"^\s*\[")).select("path")
    text = F.concat(F.regexp_replace(F.array_join(F.transform("pieces", lambda p: p["piece"]), "}"), r"^\s*[\[,]\s*", ""), F.lit("}"))
    out = whole.join(lists, "path", "left_semi").select("path", F.col("pos").cast("int").alias("pos"), F.try_parse_json(text).alias("entry"))
    return out.where("entry is not null and schema_of_variant(entry) like 'OBJECT%'")
