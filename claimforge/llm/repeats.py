"""Occurrences of content-selected anchors that the corpus shares, and the spans cut from documents.

Used by both substring deduplicators. A row of documents is known by its doc_id and the hash of its text, so rows that share a
doc_id keep their own spans. Hashes only propose: what lies behind equal hashes is compared byte by byte, in the buckets that
are parsed or sorted, or against the source's own bytes in the end. A bucket of many blocks is split by more of its content
until its parts are small enough for the same solver, as a radix sort splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimforge.llm import grams
from claimforge.llm.common import cut, discard, parts, release, ship, utf8

KEY = ["doc_id", "row"]
OCC = "anchor long, block long, doc_id long, row long, pos int, first int"
BLOCK = "anchor long, doc_id long, row long, pos int, before binary, after binary"
SPLIT = 1 << 13  # blocks that one solver call takes at most


def texts(docs: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, row, text) and the named columns only, so that extra columns with clashing names never meet in a join."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text")).alias("row"), F.col("text"), *[F.col(c) for c in columns])


def once(docs: DataFrame) -> DataFrame:
    """One row of each (doc_id, row) of documents with an id."""
    rows = texts(docs).where("doc_id is not null")
    again = cut(rows.groupBy(*KEY).count().where("count > 1").select(*KEY))
    if again.isEmpty():
        return rows
    return rows.join(again, KEY, "left_anti").unionByName(rows.join(again, KEY, "left_semi").dropDuplicates(KEY))


def _units(unit: str, raw: np.ndarray, off: np.ndarray):
    """Hashes of a range of units, and the first unit of each text; for words also their first and last bytes."""
    if unit == "byte":
        return (lambda a, b: grams.BYTE[raw[a:b]]), off, None, None
    s, e, bounds = grams.words(raw, off)
    h = grams.word_hashes(raw, s, e)
    return (lambda a, b: h[a:b]), bounds, s, e


def _occurrences(unit: str, window: int, k: int):
    def run(batches):
        for batch in parts(batches):
            raw, off = utf8(batch.column("text"))
            if not batch.num_rows or off[-1] == off[0]:
                continue
            units, bounds, s, e = _units(unit, raw, off)
            doc, pos, anchor, block = grams.anchors(units, bounds, window, k)
            if not len(doc):
                continue
            tag = grams.mix(anchor.view(np.uint64) ^ grams.mix(block.view(np.uint64)) ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            _, index, inverse = np.unique(tag, return_index=True, return_inverse=True)
            out = dict(zip(KEY, (batch.column(c).to_numpy()[doc] for c in KEY), strict=True))
            out = {"anchor": anchor, "block": block} | out | {"pos": pos.astype(np.int32), "first": pos[index[inverse]].astype(np.int32)}
            if unit == "word":
                left, right = np.maximum(pos - (window - k), 0) + bounds[doc], np.minimum(pos + bounds[doc] + window, bounds[doc + 1])
                out |= {"ba": (s[left] - off[doc]).astype(np.int32), "bb": (e[right - 1] - off[doc]).astype(np.int32)}
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out.values()], names=list(out))
            release()

    return run


def shared_occurrences(docs: DataFrame, unit: str, window: int, k: int) -> DataFrame:
    """A table of the occurrences of anchors that occur more than once.

    Columns: those of OCC (first: the place of the document's first occurrence of this anchor and block), contested (the anchor
    stands in different blocks), and o, the least document with the anchor and block, its row, first place there, and (of
    words) the bytes of the block there.

    The shared anchors and the owners are tables of their own, so that the joins have plain exchanges and a hot key's side can be split.
    """
    occ = texts(docs).where("doc_id is not null").mapInArrow(_occurrences(unit, window, k), OCC + (", ba int, bb int" if unit == "word" else ""))
    shared = cut(
        occ.select("anchor", F.col("block").alias("b"))
        .groupBy("anchor")
        .agg(F.count("*").alias("n"), F.min("b").alias("b0"), F.max("b").alias("b1"))
        .where("n > 1")
        .select("anchor", (F.col("b0") != F.col("b1")).alias("contested"))
    )
    out = cut(occ.join(shared, "anchor"))
    owner = cut(out.groupBy("anchor", "block").agg(F.min(F.struct(*KEY, "pos", *[c for c in out.columns if c in ("ba", "bb")])).alias("o")))
    owned = cut(out.drop("ba", "bb").join(owner, ["anchor", "block"]).where("contested or doc_id > o.doc_id or pos > first").drop("block"))
    discard(shared, out, owner)
    return owned


def wanted_bytes(docs: DataFrame, copies: DataFrame, reach: int, window: int) -> DataFrame:
    """(doc_id, row, spans) of copies of blocks of other rows, each with the bytes of the source; see `listed`.

    Blocks that overlap at the same distance from one source become one span first, and a source is fetched once for all spans that a row has of it.
    """
    ends = (F.col("o.ba"), F.col("o.bb")) if "ba" in copies.schema["o"].dataType.names else (F.greatest(F.col("o.pos") - reach, F.lit(0)), F.col("o.pos") + window)
    one = copies.select(*KEY, (F.col("pos") - reach).alias("a"), F.col("o.doc_id").alias("s_doc"), F.col("o.row").alias("s_row"), (F.col("o.pos") - F.col("pos")).alias("away"), ends[0].alias("ba"), ends[1].alias("bb"))
    line = [*KEY, "s_doc", "s_row", "away"]
    w = Window.partitionBy(*line).orderBy("a")  # the places of one document
    head = F.coalesce(F.col("a") - F.lag("a").over(w) > reach + window, F.lit(True)).cast("int")
    runs = one.withColumn("head", head).withColumn("run", F.sum("head").over(w)).groupBy(*line, "run")
    runs = runs.agg(F.min("a").alias("a"), (F.max("a") + reach + window).alias("b"), F.min("ba").alias("ba"), F.max("bb").alias("bb"))
    runs = cut(runs.groupBy(*KEY, "s_doc", "s_row").agg(F.collect_list(F.struct("a", "b", "ba", "bb")).alias("runs")))
    source = once(docs).select(F.col("doc_id").alias("s_doc"), F.col("row").alias("s_row"), F.col("text").cast("binary").alias("bytes"))
    found = runs.join(source, ["s_doc", "s_row"])
    return found.select(*KEY, F.expr("transform(runs, s -> struct(s.a as a, s.b as b, cast(null as int) as shift, substring(bytes, s.ba + 1, s.bb - s.ba) as want))").alias("spans"))


def listed(spans: DataFrame) -> DataFrame:
    """(doc_id, row, spans) of spans (doc_id, row, a, b) that hold, or with shift: if the text is the same so many units on; spans is a list of a, b, shift and want."""
    shift = F.col("shift") if "shift" in spans.columns else F.lit(None).cast("int")
    return spans.select(*KEY, F.array(F.struct(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), shift.cast("int").alias("shift"), F.lit(None).cast("binary").alias("want"))).alias("spans"))


def blocks_of(docs: DataFrame, wanted: DataFrame, unit: str, window: int, k: int) -> DataFrame:
    """BLOCK: the content around each wanted (anchor, doc_id, row, pos), left and right part as bytes (words joined by a space)."""

    def run(batches):
        for batch in parts(batches):
            raw, off = utf8(batch.column("text"))
            ids, rows = (batch.column(c).to_numpy() for c in KEY)
            sizes, anchor, pos = batch.column("anchor").value_lengths().to_numpy(), batch.column("anchor").flatten().to_numpy(), batch.column("pos").flatten().to_numpy()
            s, e, bounds = (None, None, off) if unit == "byte" else grams.words(raw, off)
            doc = np.repeat(np.arange(len(ids)), sizes)
            view = memoryview(raw)
            if unit == "byte":
                join = lambda x, y: bytes(view[x:y])
            else:
                join = lambda x, y: b" ".join(view[s[i] : e[i]] for i in range(x, y))
            for i in range(0, len(doc), 8192):  # a long document's blocks are several times its size
                d = doc[i : i + 8192]
                p = pos[i : i + 8192].astype(np.int64) + bounds[d]
                left, right = np.maximum(p - (window - k), bounds[d]), np.minimum(p + window, bounds[d + 1])
                before, after = ([join(x, y) for x, y in zip(u.tolist(), v.tolist(), strict=True)] for u, v in ((left, p), (p, right)))
                columns = [pa.array(anchor[i : i + 8192]), pa.array(ids[d]), pa.array(rows[d]), pa.array(pos[i : i + 8192]), pa.array(before, pa.binary()), pa.array(after, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", *KEY, "pos", "before", "after"])
            del view
            release()

    lists = wanted.groupBy(*KEY).agg(*[F.collect_list(c).alias(c) for c in ("anchor", "pos")])
    return once(docs).join(lists, KEY).mapInArrow(run, BLOCK)


def _split(unit: str, window: int, step: int):
    """Deals blocks out by what all windows share that begin lo ... hi units left of the anchor, `step` such places at a time."""

    def run(batches):
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            at, keys, los, his = [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("key", "lo", "hi", "before", "after")]
            for i, (key, lo, hi, before, after) in enumerate(zip(*columns, strict=True)):
                x, y = (before, after) if unit == "byte" else (before.split(), after.split())
                for g in range(lo, hi + 1, step):
                    top = min(g + step - 1, hi)
                    if len(x) >= g and len(y) >= window - top:
                        core = x[len(x) - g :] + y[: window - top]
                        at.append(i)
                        keys.append(xxhash.xxh64_intdigest(core if unit == "byte" else b" ".join(core), (key + g) & 0xFFFFFFFFFFFFFFFF))
                        los.append(g)
                        his.append(top)
            rest = batch.select(["anchor", *KEY, "pos", "before", "after"]).take(pa.array(at, pa.int64()))
            own = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(los, pa.int32()), pa.array(his, pa.int32())]
            yield pa.RecordBatch.from_arrays([*own, *rest.columns], names=["key", "lo", "hi", *rest.schema.names])

    return run


def solved(blocks: DataFrame, unit: str, window: int, k: int, solver, schema: str, split: int = SPLIT) -> DataFrame:
    """What a solver finds in the buckets of blocks (rows sorted by key; windows that begin lo ... hi units left of the anchor).

    A bucket of more than `split` blocks is split by the content that its windows share, first 1/5, then 1/20 of the places at
    a time, then one by one; only blocks that agree there can have a window in common. What is still larger then holds the
    same window in each row: it is dealt out by rows, and its earliest row goes to each part.
    """
    reach = window - k
    run = lambda df: df.repartition("key").sortWithinPartitions("key").mapInArrow(solver, schema)
    todo = blocks.withColumn("key", F.col("anchor")).withColumn("lo", F.lit(0)).withColumn("hi", F.lit(reach))
    out = []
    for step in (max(2, reach // 5), max(2, reach // 20), 1, 0):
        large = cut(todo.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > split))
        if large.isEmpty():
            out.append(run(todo))
            break
        out.append(run(todo.join(large, "key", "left_anti")))
        hot = todo.join(large, "key")
        if step:
            todo = cut(hot.drop("n").mapInArrow(_split(unit, window, step), "key long, lo int, hi int, " + BLOCK))
            continue
        shares = F.ceil(F.col("n") / split).cast("long")
        earliest = cut(hot.groupBy("key").agg(F.min(F.struct(*KEY, "pos", "lo", "hi", "anchor", "before", "after")).alias("e"), F.max(shares).alias("shares")))
        guide = earliest.select("key", "e.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
        dealt = hot.withColumn("share", F.pmod(F.xxhash64(*KEY), shares)).drop("n")
        out.append(run(dealt.unionByName(guide).withColumn("key", F.xxhash64("key", "share")).drop("share")))
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result


def with_spans(docs: DataFrame, spans: DataFrame, worker, schema: str, more: tuple = ()) -> DataFrame:
    """Applies a worker to (doc_id, text, spans_, further columns), spans gathered per row; rows without spans too."""
    per_row = spans.groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans_"))
    own = [f"more_{i}" for i in range(len(more))]
    text = texts(docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in zip(more, own, strict=True)]), *own)
    types = "".join(f", {c} {text.schema[c].dataType.simpleString()}" for c in own)
    joined = text.join(per_row, KEY, "left").select("doc_id", "text", "spans_", *own)
    return joined.mapInArrow(worker, schema + types).withColumnsRenamed(dict(zip(own, more, strict=True)))


def holding(column: pa.Array, row: int, units, read) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the spans of a row that hold: found in a bucket, equal to the place `shift` units on, or to the wanted bytes."""
    a, b = [], []
    for s in column[row].as_py() or ():
        x, y = max(s["a"], 0), min(s["b"], len(units))
        if s["want"] is not None:
            want = read(s["want"])
            y = x + len(want)
            if units[x:y] != want:
                continue
        elif s["shift"] is not None and units[x:y] != units[x + s["shift"] : y + s["shift"]]:
            continue
        a.append(x)
        b.append(y)
    return merged(np.array(a, np.int64), np.array(b, np.int64), len(units))


def merged(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open intervals, clipped to [0, n)."""
    a, b = np.clip(a, 0, n), np.clip(b, 0, n)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    head = np.ones(len(a), bool)
    head[1:] = a[1:] > b[:-1]
    tail = np.append(head[1:], True)[: len(a)]
    a, b = a[head], b[tail]
    keep = b > a
    return a[keep], b[keep]


def buckets(batches, key: str, rows: int):
    """Regroups Arrow batches sorted by key into tables of about `rows` rows that never split a key."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        at = int(np.flatnonzero(keys == keys[-1])[0])
        if at:
            yield table.slice(0, at)
        rest = table.slice(at)
        held, n = rest.to_batches(), rest.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()
