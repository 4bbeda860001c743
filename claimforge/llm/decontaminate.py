"""Benchmark decontamination by a prefix-filtered set join of word windows.

A window of an item is a set of placed shingles (three words, or the whole window if it is shorter), and a document holds it if it
holds all of them at their places. As all are needed, the necessary prefix of a window in the order of rarity is its rarest shingle
alone: it is joined with the documents' shingles, the windows that would begin before or end behind what is there are ruled out by
place and length, and the words themselves decide.

One pass over the documents does the work that grows with the corpus, without a shuffle of texts: it counts the words, counts the shingles
that a bit map of all item shingles lets through, and keeps stretches of such shingles that are as long as some window. The bit
map has a fixed size (2 MB); where it errs, longer stretches come through, and nothing is lost. Equal stretches meet the windows once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimforge.llm import grams
from claimforge.llm.common import cut, discard, parts, read_table, release, ship, utf8

SHINGLE = 3
BITS = 24  # of the bit map's index
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
OTHER = np.ones(256, bool)  # bytes that are in no word: all of ASCII but digits and small letters
OTHER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
WINDOWS = "item string, m int, k int, words array<string>, grams array<long>"
SCAN = "k int, doc_id long, row long, n long, start int, gram long, words array<string>, grams array<long>"
COUNTS = -1  # k of rows with counts of shingles; documents have 0, stretches the number of words in a shingle


def _tokens(column: pa.Array):
    """Lower-cased bytes, starts and ends of words, first word of each text, and the words' hashes."""
    raw, off = utf8(column)
    low, off = LOWER[raw[off[0] : off[-1]]], off - off[0]
    s, e, bounds = grams.words(low, off, OTHER)
    return low, s, e, bounds, grams.word_hashes(low, s, e)


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row."""
    n = max(len(h) - k + 1, 0)
    x = h[:n] + np.uint64(k)
    for j in range(1, k):
        x = grams.mix(x) + h[j : n + j]
    return grams.mix(x)


def _item_windows(window: int, shingle: int):
    def run(batches):
        for batch in parts(batches):
            low, s, e, bounds, h = _tokens(batch.column("text"))
            for i in range(batch.num_rows):
                a, b = int(bounds[i]), int(bounds[i + 1])
                m = min(window, b - a)
                if not m:
                    continue
                k = min(shingle, m)
                words, g = [low[s[j] : e[j]].tobytes() for j in range(a, b)], _shingles(h[a:b], k).view(np.int64)
                for lo in range(0, b - a - m + 1, 4096):
                    at = range(lo, min(lo + 4096, b - a - m + 1))
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column("item")[i].as_py()] * n, pa.string()), pa.array([m] * n, pa.int32()), pa.array([k] * n, pa.int32()),
                         pa.array([words[j : j + m] for j in at], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array([g[j : j + m - k + 1] for j in at], pa.list_(pa.int64()))],
                        names=["item", "m", "k", "words", "grams"],
                    )

    return run


def _bit_map(spark, item_grams: DataFrame) -> np.ndarray:
    """Bits of the upper BITS bits of all shingles, summed up in Spark; 2^(BITS-6) rows of 64 bits at most come to the driver."""
    at = F.shiftrightunsigned("gram", 64 - BITS)
    rows = item_grams.select((at / 64).cast("int").alias("i"), (at % 64).cast("int").alias("j")).groupBy("i").agg(F.expr("bit_or(shiftleft(1L, j))").alias("bits")).collect()
    out = np.zeros(1 << (BITS - 6), np.int64)
    for r in rows:
        out[r.i] = r.bits
    return out.view(np.uint8)


def _scan(shared, least: dict[int, int]):
    """Rows of SCAN of documents: one each, counts of shingles in the bit map, and stretches of at least least[k] words with all shingles in it."""

    def run(batches):
        for batch in parts(batches):
            low, s, e, bounds, h = _tokens(batch.column("text"))
            n, ids, rows = batch.num_rows, batch.column("doc_id"), batch.column("row")
            blank = lambda size, kind: pa.nulls(size, kind)
            strings, longs = pa.list_(pa.string()), pa.list_(pa.int64())
            names = ["k", "doc_id", "row", "n", "start", "gram", "words", "grams"]
            of = lambda *columns: pa.RecordBatch.from_arrays(list(columns), names=names)
            yield of(pa.array(np.zeros(n, np.int32)), ids, rows, pa.array(np.diff(bounds).astype(np.int64)), blank(n, pa.int32()), blank(n, pa.int64()), blank(n, strings), blank(n, longs))
            doc = np.repeat(np.arange(n), np.diff(bounds))
            bits = shared.value
            for k in least:
                g = _shingles(h, k)
                at = (g >> np.uint64(64 - BITS)).astype(np.int64)
                found = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                found = found[doc[found] == doc[found + k - 1]]
                if not len(found):
                    continue
                kind, times = np.unique(g[found], return_counts=True)
                c = len(kind)
                yield of(pa.array(np.full(c, COUNTS, np.int32)), blank(c, pa.int64()), blank(c, pa.int64()), pa.array(times.astype(np.int64)), blank(c, pa.int32()), pa.array(kind.view(np.int64)), blank(c, strings), blank(c, longs))
                edge = np.flatnonzero((np.diff(found) != 1) | (doc[found[1:]] != doc[found[:-1]])) + 1
                first, last = found[np.r_[0, edge]], found[np.r_[edge - 1, len(found) - 1]]
                long = last - first + k >= least[k]
                first, last = first[long], last[long]
                for lo in range(0, len(first), 4096):
                    a, b = first[lo : lo + 4096], last[lo : lo + 4096]
                    words = [[low[s[j] : e[j]].tobytes() for j in range(x, y + k)] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                    own = pa.array(doc[a])
                    yield of(pa.array(np.full(len(a), k, np.int32)), ids.take(own), rows.take(own), blank(len(a), pa.int64()), pa.array((a - bounds[doc[a]]).astype(np.int32)), blank(len(a), pa.int64()),
                             pa.array(words, pa.list_(pa.binary())).cast(strings), pa.array([g[x : y + 1].view(np.int64) for x, y in zip(a, b, strict=True)], longs))
            release()

    return run


def _merged(spans: DataFrame, *key: str) -> DataFrame:
    """Spans (key, a, b) whose union is the same and that neither overlap nor touch; the spans of a key are those of one document or stretch."""
    w = Window.partitionBy(*key).orderBy("a", "b")
    new = F.coalesce(F.col("a") > F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    return spans.select(*key, "a", "b", new.alias("new")).withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*key, "part").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("part")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = SHINGLE) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, spans (maximal runs of words that windows of items cover, as [a, b)), items (ids as sorted strings).

    Words are runs of digits, letters and all that isn't ASCII, with A-Z in lower case. A window is `window` words in a row of an item
    (item_id, text); an item of fewer words, but not none, is one window. Only doc_id, item_id and the texts are used; other columns,
    whatever their names, play no part. A null text has no words. Rows with a null doc_id are judged like others. An item with a null id
    covers words but isn't listed; several rows with one item_id count as one item. Rows that share a doc_id are judged each by its own
    text, and repeated rows come back as often. Empty tables: no rows, or no spans.
    """
    spark = docs.sparkSession
    ship(spark)
    given = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    pairs = cut(given.mapInArrow(_item_windows(window, shingle), WINDOWS).withColumn("window", F.sha2(F.concat_ws(" ", "words"), 256)))
    windows = cut(pairs.groupBy("window").agg(F.first("m").alias("m"), F.first("k").alias("k"), F.first("words").alias("words"), F.first("grams").alias("grams")))
    placed = windows.select("window", F.posexplode("grams").alias("offset", "gram"))
    least = {r.k: r.m for r in windows.groupBy("k").agg(F.min("m").alias("m")).collect()}  # as many as a shingle has words
    shared = spark.sparkContext.broadcast(_bit_map(spark, placed))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))
    scan = cut(texts.mapInArrow(_scan(shared, least), SCAN))
    run = F.sha2(F.concat_ws(" ", F.col("k").cast("string"), "words"), 256).alias("run")
    runs = scan.where("k > 0").select("doc_id", "row", run, "start", "k", "words", "grams")

    # the rarest shingle of each window; one that the corpus doesn't have rules its window out
    counts = scan.where(F.col("k") == COUNTS).groupBy("gram").agg(F.sum("n").alias("n"))
    rare = placed.join(counts, "gram", "left").groupBy("window").agg(F.min(F.struct("n", "gram", "offset")).alias("rare"), F.bool_or(F.isnull("n")).alias("absent")).where("not absent")
    prefix = cut(rare.join(windows, "window").select("window", "m", F.concat_ws(" ", "words").alias("want"), "rare.gram", "rare.offset"))

    distinct = runs.groupBy("run").agg(F.first("k").alias("k"), F.first("words").alias("words"), F.first("grams").alias("grams"))
    left = lambda i: F.greatest(i - window + F.col("k"), F.lit(0))
    near = F.transform("grams", lambda g, i: F.struct(i.alias("pos"), g.alias("gram"), left(i).alias("left"), F.slice("words", left(i) + 1, F.lit(2 * window)).alias("near")))
    places = distinct.select("run", F.size("words").alias("size"), F.explode(near).alias("x")).select("run", "size", "x.*")
    met = places.join(prefix, "gram").withColumn("a", F.col("pos") - F.col("offset")).where("a >= 0 and a + m <= size")
    same = F.concat_ws(" ", F.slice("near", F.greatest(F.col("a") - F.col("left") + 1, F.lit(1)), F.col("m"))) == F.col("want")
    hits = cut(met.where(same).select("run", "window", "a", (F.col("a") + F.col("m")).alias("b")))

    covered = _merged(hits.select("run", "a", "b").distinct(), "run")
    named = hits.select("run", "window").distinct().join(pairs.select("window", "item").where("item is not null").distinct(), "window").select("run", "item").distinct()
    own = runs.select("doc_id", "row", "run", "start")
    spans = own.join(covered, "run").select("doc_id", "row", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b")).distinct()
    spans = _merged(spans, "doc_id", "row").groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    ids = own.select("doc_id", "row", "run").distinct().join(named, "run").groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = cut(spans.join(ids, spans.doc_id.eqNullSafe(ids.doc_id) & (spans.row == ids.row), "left").select(spans.doc_id.alias("d"), spans.row.alias("r"), "spans", "items"))
    discard(pairs, windows, prefix, hits)
    each = scan.where("k = 0").select("doc_id", "row", F.col("n").alias("n_words"))
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    return each.join(both, each.doc_id.eqNullSafe(both.d) & (each.row == both.r), "left").select("doc_id", "n_words", none("spans", "array<struct<a:int,b:int>>"), none("items", "array<string>"))


def op13_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
