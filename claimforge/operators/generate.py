"""Questions from a knowledge base, and selection of questions against what is there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.functions.text import strip
from claimforge.operators.tables import stored
from claimforge.sources.kb import KnowledgeBase


def _asked(text):
    """A question as it is asked: endings -ss and -ys tidied, a capital first and nothing but small letters after it."""
    tidy = F.replace(F.replace(text, F.lit("ss?"), F.lit("s?")), F.lit("ys?"), F.lit("ies?"))
    return F.concat(F.upper(F.substring(tidy, 1, 1)), F.lower(F.substr(tidy, F.lit(2))))


def questions_from_kb(kb: KnowledgeBase, per_key: int = 2) -> DataFrame:
    """(question, ground_truth, type, source): true questions from the first parents and properties of each key and its first consequence.

    First by the column pos where there is one, else by name. Keys and parents of one or two letters give no question; no question comes twice.
    """

    def take(df, k, v, n):
        first = F.array_sort(F.collect_set(F.struct(*(["pos"] if "pos" in df.columns else []), v)))
        return df.groupBy(k).agg(F.slice(first, 1, n).alias("v")).select(k, F.explode("v").alias("v")).select(k, F.col("v")[v].alias("v"))

    asked = lambda df, kind, *parts: df.select(_asked(F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])).alias("question"), F.lit(kind).alias("type"))
    long = lambda c: F.length(c) > 2
    child, said = F.col("child"), F.replace("v", F.lit("_"), F.lit(" "))
    a = asked(take(kb.isa, "child", "parent", per_key).where(long("child") & long("v")), "taxonomic", "Are all ", F.when(child.endswith("s"), child).otherwise(F.concat(child, F.lit("s"))), " ", F.col("v"), "s?")
    b = asked(take(kb.has_prop, "entity", "prop", per_key).where(long("entity")), "categorical", "Do all ", F.col("entity"), "s have ", said, "?")
    c = asked(take(kb.rule, "condition", "consequence", 1), "hypothetical", "If ", F.col("condition"), ", does ", said, " occur?")
    return a.unionByName(b).unionByName(c).distinct().select("question", F.lit(True).alias("ground_truth"), "type", F.lit("kb_generated").alias("source"))


def combined(*frames: DataFrame) -> DataFrame:
    """All questions of several frames, by name; repeats stay."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def not_yet(candidates: DataFrame, existing: DataFrame, least: int = 10, most: int | None = None, order: str = "question") -> DataFrame:
    """Candidates whose question, in any case, is not among the existing ones; one of each; `least` characters at least.

    most: only so many, the first in the order of a column (200 taken over and 100 generated ones are usual caps); None: all. Of questions that
    differ in case only the first by `order` is taken.
    """
    low = F.lower("question")
    out = candidates.where(F.length("question") >= least).groupBy(low.alias("low_")).agg(F.min_by(F.struct(*candidates.columns), F.struct(order, "question")).alias("x_"))
    out = out.join(existing.select(low.alias("low_")).distinct(), "low_", "left_anti").select("x_.*")
    return out if most is None else out.orderBy(order, "question").limit(most)


GRAM = 3


def _grams(text, n: int):
    """Distinct n-grams of a text, as an array; none if it is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def gram_index(keys: DataFrame) -> DataFrame:
    """(gram, key): each distinct key, not empty, under that of its three-letter pieces that fewest keys have (ties: the first by name); a shorter key under itself."""
    short = keys.where(F.length("key").between(1, GRAM - 1)).select(F.col("key").alias("gram"), "key").distinct()
    pieces = keys.where(F.length("key") >= GRAM).select("key").distinct().select("key", F.explode(_grams(F.col("key"), GRAM)).alias("gram"))
    counts = pieces.groupBy("gram").count()
    rare = pieces.join(counts, "gram").groupBy("key").agg(F.min(F.struct("count", "gram")).alias("x")).select("x.gram", "key")
    return rare.unionByName(short)


def text_pieces(whole: DataFrame, sizes) -> DataFrame:
    """(id, gram, at): the pieces of each size of texts (text, id) in lower case, at the places where they begin, from 1."""
    low = F.lower("text")
    pieces = lambda n: whole.where(F.length(low) >= n).select("id", F.posexplode(F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substr(low, i, F.lit(n)))).alias("at", "gram")).select("id", "gram", (F.col("at") + 1).alias("at"))
    return reduce(DataFrame.unionByName, map(pieces, sizes))


def gram_shapes(index: DataFrame) -> DataFrame:
    """(gram, ahead, size): how many letters of a key come before its piece and how many the key has, once for all keys of a piece that are alike in both."""
    return index.select("gram", (F.position("gram", "key") - 1).alias("ahead"), F.length("key").alias("size")).distinct()


def stretches(whole: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct (id, key): the stretches of texts (text, id) in lower case that stand around a piece as some key does, whatever else they hold."""
    sizes = sorted(r.n for r in index.select(F.length("gram").alias("n")).distinct().collect())  # of 1, 2 and 3
    if not sizes:
        return whole.select("id", F.col("text").alias("key")).limit(0)
    met = text_pieces(whole, sizes).join(gram_shapes(index), "gram").select("id", (F.col("at") - F.col("ahead")).alias("start"), "size").where("start > 0").distinct()
    low = F.lower("text")
    return whole.join(met, "id").where(F.col("start") + F.col("size") - 1 <= F.length(low)).select("id", F.substr(low, F.col("start"), F.col("size")).alias("key")).distinct()


def containing(texts: DataFrame, keys: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (text, key): texts, in lower case, that hold a key as it stands.

    A substring join by an index: a text gives its pieces of three letters (of one or two too, if there are such keys), as many as it has
    letters, whatever lengths keys have. A piece that keys are listed under gives a stretch of the text for each place in a key and length of key that
    are listed, not for each key, and stretches meet keys as wholes. So rows follow the texts, not how many keys share a piece. Texts are known by
    a hash and don't travel with their pieces; each is compared with its keys in the end.
    """
    index = stored(gram_index(keys))
    whole = texts.select(F.col(text).alias("text")).where("text is not null").distinct().select("text", F.xxhash64("text").alias("id"))
    met = stretches(whole, index).join(index.select("key"), "key", "left_semi")
    return whole.join(met, "id").where(F.contains(F.lower("text"), F.col("key"))).select("text", "key")


def mentions(questions: DataFrame, kb: KnowledgeBase, least: int = 10) -> DataFrame:
    """Distinct questions of `least` characters at least in which a key of isa or of the properties occurs, in any case and place."""
    keys = kb.isa.select(F.col("child").alias("key")).unionByName(kb.has_prop.select(F.col("entity").alias("key")))
    asked = questions.select(strip(F.col("question")).alias("question")).where(F.length("question") >= least)
    return containing(asked, keys, "question").select(F.col("text").alias("question")).distinct()
