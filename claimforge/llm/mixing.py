"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame expressions only.

Every document gets the key -ln(u) / weight, with u in (0, 1) from a hash of its id (null: of its text). A source whose target is e times its size
and a rest is taken e times whole, and the rest is filled with its documents in the order of their keys. The place where
the budget ends is found without sorting a source in one task: sizes are summed by (source, bucket of the key), the bucket in
which the budget ends is cut into finer buckets, and only the last bucket's documents are put in order, repeated rows as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimforge.llm.common import cut, read_table

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
PLACE = ["key_", "doc_id", "size_"]


def targets(sizes: dict, weights=(5.0, 2.0, 1.0), most: float = 3.0) -> dict:
    """Words that each source should give: the total shared by weight, no more than `most` times a source's size.

    Sources in order of code points, null last, weigh weights[0], weights[1], ... in turn; what a source can't give is shared
    again by weight. sizes has one entry for each source, so its size does not follow the number of documents.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    out, open_, left = dict.fromkeys(order, 0.0), [s for s in order if sizes[s] > 0], float(sum(sizes.values()))
    while open_:
        whole = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / whole > most * sizes[s]]
        if not above:
            out |= {s: left * weight[s] / whole for s in open_}
            break
        for s in above:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in above)
        open_ = [s for s in open_ if s not in above]
    return out


def sized(docs: DataFrame) -> DataFrame:
    """docs with size_, the number of words in the text, and content_, a hash of the text."""
    return docs.withColumn("size_", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")).withColumn("content_", F.xxhash64("text"))


def placed(rows: DataFrame, quality: DataFrame | None, seed: int) -> DataFrame:
    """rows with key_ (exponential, divided by the quality weight) and its two buckets."""
    if quality is None:
        rows = rows.withColumn("weight_", F.lit(1.0))
    else:
        q = quality.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("weight").cast("double").alias("w_")).where("doc_id is not null")
        rows = rows.join(q.groupBy("doc_id").agg(F.avg("w_").alias("weight_")), "doc_id", "left")
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("content_").cast("string")), F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    key = -F.log(u) / F.greatest(F.coalesce(F.col("weight_"), F.lit(1.0)), F.lit(1e-9))
    fine = F.least(F.floor((1 - F.exp(-F.col("key_"))) * (BUCKETS * BUCKETS)), F.lit(BUCKETS * BUCKETS - 1)).cast("long")
    return rows.withColumn("key_", key).withColumn("fine_", fine).withColumn("coarse_", F.floor(F.col("fine_") / BUCKETS).cast("long")).drop("weight_", "content_")


def _end_in(rows: DataFrame, plan: DataFrame, bucket: str, begun: str) -> DataFrame:
    """plan with the first bucket at which the sizes so far reach the rest of the budget, and the sizes before it."""
    sums = rows.groupBy("source", bucket).agg(F.sum("size_").alias("s"))
    w = Window.partitionBy("source").orderBy(bucket)  # one row for each bucket, BUCKETS at most
    joined = sums.withColumn("to", F.sum("s").over(w)).join(plan, sums.source.eqNullSafe(plan.source_), "inner")
    found = joined.where(F.col(begun) + F.col("to") >= F.col("rest")).groupBy("source_").agg(F.min_by(F.struct(bucket, (F.col("to") - F.col("s")).alias("before")), bucket).alias("x"))
    found = found.select(F.col("source_").alias("source__"), F.col(f"x.{bucket}").alias(f"end{bucket}"), (F.col("x.before")).alias(f"before{bucket}"))
    return plan.join(found, plan.source_.eqNullSafe(found.source__), "left").drop("source__")


def _edge(joined: DataFrame) -> DataFrame:
    """The rows of the buckets in which budgets end, equal ones as one: n_ of them, of which the budget takes the first m_."""
    inside = (F.col("coarse_") == F.col("endcoarse_")) & (F.col("fine_") == F.col("endfine_"))
    alike = joined.where(inside).groupBy("source", *PLACE, "source_size", "target", "epochs", "rest", "beforecoarse_", "beforefine_").agg(F.count("*").alias("n_"))
    w = Window.partitionBy("source").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0)  # a BUCKETS * BUCKETS-th of a source
    words = F.col("size_") * F.col("n_")
    left = F.col("rest") - F.col("beforecoarse_") - F.col("beforefine_") - F.col("to_") + words
    fit = F.when(F.col("size_") > 0, F.floor(left / F.col("size_") + 0.5)).when(left >= 0, F.col("n_")).otherwise(F.lit(0))
    return alike.withColumn("to_", F.sum(words).over(w)).withColumn("m_", F.greatest(F.least(fit, F.col("n_")), F.lit(0)).cast("long"))


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), most: float = 3.0, seed: int = 42, quality: DataFrame | None = None) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target and taken, the words that the mix takes of it, repeats counted.

    quality has the quality weights (doc_id, weight) of some documents; the mean of repeats, at least 1e-9, counts; others weigh 1, as
    all do without it. Weights should be around 1, as the buckets of keys are cut for that. Size is the number of
    words in the text, 0 for null. A null source is a source of its own, last in order. A document is taken if more than half
    of it fits its source's budget, so each source misses its target by half a document at most. Rows of equal key are put in
    order of doc_id and size. Rows of one source, key, doc_id and size are alike: as many of them are taken as fit. Extra columns are ignored, an empty table gives an empty result.
    """
    rows, plan = _plan(docs, weights, most, seed, quality)
    joined = rows.join(plan, rows.source.eqNullSafe(plan.source_), "inner")
    inside = (F.col("coarse_") == F.col("endcoarse_")) & (F.col("fine_") == F.col("endfine_"))
    before = F.coalesce((F.col("coarse_") < F.col("endcoarse_")) | ((F.col("coarse_") == F.col("endcoarse_")) & (F.col("fine_") < F.col("endfine_"))), F.lit(False))
    own = ["doc_id", "size_", "source_size", "target", "epochs", "more"]
    rest = joined.where(~F.coalesce(inside, F.lit(False))).withColumn("more", before).select(*own)
    part = _edge(joined).withColumn("i_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_")))).withColumn("more", F.col("i_") <= F.col("m_")).select(*own)
    out = rest.unionByName(part)
    taken = F.col("size_") * (F.col("epochs") + F.col("more").cast("long"))
    return out.select("doc_id", F.col("size_").alias("size"), "source_size", "target", taken.alias("taken"))


def _plan(docs: DataFrame, weights, most: float, seed: int, quality: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"]
    rows = cut(placed(sized(docs.select(*columns)).drop("text"), quality, seed))
    sizes = {r["source"]: int(r["s"]) for r in rows.groupBy("source").agg(F.sum("size_").alias("s")).collect()}  # one row for each source
    goal = targets(sizes, weights, most)
    data = []
    for s, size in sizes.items():
        epochs = min(int(most), int(goal[s] // size)) if size else 0
        data.append((s, size, goal[s], epochs, goal[s] - epochs * size))
    plan = spark.createDataFrame(data, "source_ string, source_size long, target double, epochs long, rest double")
    plan = plan.withColumn("zero", F.lit(0).cast("long"))
    plan = cut(_end_in(rows, plan, "coarse_", "zero"))
    edge = rows.join(plan.select(F.col("source_").alias("s__"), F.col("endcoarse_").alias("c__")), F.col("source").eqNullSafe(F.col("s__")) & (F.col("coarse_") == F.col("c__")), "left_semi")
    return rows, cut(_end_in(edge, plan, "fine_", "beforecoarse_"))


def repeats(docs: DataFrame, weights=(5.0, 2.0, 1.0), most: float = 3.0, seed: int = 42, quality: DataFrame | None = None) -> DataFrame:
    """docs with its own columns, each row as often as the mix takes it (not at all, once, ...). Takes what `mix` takes.

    Rows are decided where they are, against one row for each source: the last (key, doc_id, size) that the budget takes. Only
    if it takes a part of the rows that share this place, those are counted out, in order of a hash of all their columns.
    """
    rows, plan = _plan(docs, weights, most, seed, quality)
    place = F.struct(*PLACE)
    last = _edge(rows.join(plan, rows.source.eqNullSafe(plan.source_))).where("m_ > 0").groupBy("source").agg(F.max(F.struct(place.alias("place"), "m_", "n_")).alias("x"))
    last = last.select(F.col("source").alias("s__"), F.col("x.place").alias("last_"), "x.m_", "x.n_")
    plan = cut(plan.join(last, F.col("source_").eqNullSafe(F.col("s__")), "left").select("source_", "epochs", "endcoarse_", "endfine_", "last_", "m_", "n_"))
    names = docs.columns
    own = docs.select(F.struct(*names).alias("row_"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    all_rows = placed(sized(own).drop("text"), quality, seed)
    x = all_rows.join(plan, all_rows.source.eqNullSafe(plan.source_))
    fine = (F.col("coarse_") < F.col("endcoarse_")) | ((F.col("coarse_") == F.col("endcoarse_")) & ((F.col("fine_") < F.col("endfine_")) | ((F.col("fine_") == F.col("endfine_")) & (place <= F.col("last_")))))
    times = lambda df, n: df.withColumn("times_", n).where("times_ > 0").withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times_")))).select("row_.*")
    n = F.col("epochs") + F.coalesce(fine, F.lit(False)).cast("long")
    if plan.where("m_ < n_").isEmpty():
        return times(x, n)
    split = F.coalesce((place == F.col("last_")) & (F.col("m_") < F.col("n_")), F.lit(False))
    alike = x.where(split).withColumn("hash_", F.xxhash64(F.to_json("row_"))).groupBy("source", "hash_").agg(F.first("row_").alias("row_"), F.count("*").alias("c_"), F.first("epochs").alias("epochs"), F.first("m_").alias("m_"))
    w = Window.partitionBy("source").orderBy("hash_").rowsBetween(Window.unboundedPreceding, 0)
    taken = F.greatest(F.least(F.col("m_") - F.col("to_") + F.col("c_"), F.col("c_")), F.lit(0))
    return times(x.where(~split), n).unionByName(times(alike.withColumn("to_", F.sum("c_").over(w)), F.col("epochs") * F.col("c_") + taken))


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from labels: 2 for good quality, 1/2 for bad; documents without a label weigh 1."""
    return labels.where("quality in (0, 1)").select("doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight"))


def op8_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"), quality=label_weights(read_table(spark, sf_dir, "labels")))
