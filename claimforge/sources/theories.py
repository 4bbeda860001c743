"""Facts and labelled questions of theory entries (variants, see ingest.theory_entries)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.functions.text import U, let, strip

CONTEXT = ("theory", "triples", "context")  # fixed values: names of an entry's theory, in order

# --- fixed values: patterns of sentences and questions, in the order in which they are tried
CLASS_PATTERNS = (r"^all\s+(\w+)\s+are\s+(\w+)", r"^(\w+)s?\s+are\s+(\w+)", r"^(\w+)\s+is\s+a\s+(\w+)", r"^(\w+)\s+is\s+an\s+(\w+)")
PROPERTY_PATTERNS = (r"^(\w+)\s+(?:are|is)\s+(cold[_-]blooded|warm[_-]blooded|nocturnal|diurnal)", r"^(\w+)\s+(?:have|has)\s+(\w[\w\s]+)", r"^(\w+)\s+can\s+(\w[\w\s]+)")
KIND_PATTERNS = (
    ("taxonomic", r"^are all"), ("taxonomic", r"^is\s+\w+\s+an?\s+"), ("categorical", r"^do all\s+\w+\s+have"), ("categorical", r"^can all\s+"), ("hypothetical", r"^if\s+"),
)


def sentences(entries: DataFrame) -> DataFrame:
    """(path, pos, sentence): a text's sentences, a list's texts (plain or under 'text'), or those of a 'triples' object; over 3 characters."""
    get = lambda at, kind: F.try_variant_get("entry", at, kind)
    theory = F.coalesce(*[get(f"$.{k}", "variant") for k in CONTEXT])
    x = entries.select("path", "pos", theory.alias("t"))
    t = lambda at, kind: F.try_variant_get("t", at, kind)
    split = F.transform(F.filter(F.transform(F.split(F.variant_get("t", "$", "string"), r"\."), strip), lambda s: s != ""), lambda s: F.concat(s, F.lit(".")))
    items = lambda a: F.transform(a, lambda v: strip(F.coalesce(F.try_variant_get(v, "$.text", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))))
    kind = F.schema_of_variant("t")
    listed = F.coalesce(t("$", "array<variant>"), t("$.triples", "array<variant>"))
    found = F.when(kind == "STRING", split).otherwise(items(listed))
    return x.select("path", "pos", F.explode(found).alias("sentence")).where(F.length("sentence") > 3)


def _first(s: Column, patterns) -> Column:
    """struct(a, b) of the two groups of the first pattern that matches."""
    out = F.lit(None).cast("struct<a:string,b:string>")
    for p in reversed(patterns):
        out = F.when(s.rlike(p), F.struct(F.regexp_extract(s, p, 1).alias("a"), F.regexp_extract(s, p, 2).alias("b"))).otherwise(out)
    return out


def _fact(sentence: Column, patterns, tidy) -> Column:
    bare = F.regexp_replace(strip(F.lower(sentence)), r"\.+$", "")
    ok = lambda x: F.when((F.length(x["a"]) > 1) & (F.length(x["b"]) > 1), F.struct(strip(x["a"]).alias("a"), tidy(strip(x["b"])).alias("b")))
    return let(let(bare, lambda s: _first(s, patterns)), ok)


def class_fact(sentence: Column) -> Column:
    """struct(a, b) of 'all X are Y', 'X are Y' or 'X is a Y'; null if none fits."""
    return _fact(sentence, [U + p for p in CLASS_PATTERNS], lambda b: b)


def property_fact(sentence: Column) -> Column:
    """struct(a, b) of 'X is cold-blooded' and the like, 'X has Y' or 'X can Y', the property joined by underscores; null if none fits."""
    return _fact(sentence, [U + p for p in PROPERTY_PATTERNS], lambda b: F.translate(b, " -", "__"))


def question_kind(q: Column) -> Column:
    """taxonomic, categorical or hypothetical by a question's opening, else null."""
    t = strip(F.lower(q))
    out = F.lit(None).cast("string")
    for kind, p in reversed(KIND_PATTERNS):
        out = F.when(t.rlike(U + p), kind).otherwise(out)
    return out


def questions(entries: DataFrame, context: int = 500) -> DataFrame:
    """(question, ground_truth, type, source, theory): questions with a true or false answer and a known kind, with their theory's beginning."""
    raw = F.coalesce(F.try_variant_get("entry", "$.questions", "variant"), F.try_variant_get("entry", "$.QA", "variant"))
    x = entries.select("path", "pos", raw.alias("q"))
    items = F.coalesce(F.try_variant_get("q", "$", "array<variant>"), F.map_values(F.try_variant_get("q", "$", "map<string,variant>")))
    x = x.select("path", "pos", F.explode(items).alias("q"))
    get = lambda *names: F.coalesce(*[F.try_variant_get("q", f"$.{n}", "string") for n in names])
    x = x.select("path", "pos", strip(get("question", "text")).alias("question"), strip(F.lower(get("answer", "label"))).alias("answer")).where("question != '' and answer in ('true', 'false')")
    x = x.withColumn("type", question_kind(F.col("question"))).where("type is not null")
    theory = sentences(entries).groupBy("path", "pos").agg(F.substring(F.array_join(F.array_agg("sentence"), " "), 1, context).alias("theory"))
    return x.join(theory, ["path", "pos"], "left").select("question", (F.col("answer") == "true").alias("ground_truth"), "type", F.lit("theory").alias("source"), F.coalesce("theory", F.lit("")).alias("theory"))
