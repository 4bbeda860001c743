"""Whole near-duplicate components: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash fingerprints with Golay keys and, as fingerprints of such pairs often differ in more bits than the
keys reach, from prefixes: two sets of that similarity share one of the least n - ceil(0.8 n) + 1 shingles of each, in any
order that is the same for all; shingles of many texts come last in it. Every candidate is verified on the sets, unless sketches show
a difference that is too large: bits of parity, which differ in no more places than the sets have different shingles. First each text meets one
of its bucket. Then those of a bucket that are not yet connected are compared, by their sketches within the bucket, and the nearest pair of each two
groups is verified; at last all pairs of groups that are still apart. So neither groups of near copies nor texts that share some passage make all their pairs.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.llm.common import cut, discard, keyed, parts, release, ship, utf8
from claimforge.llm.simhash_golay import components, links

SHINGLE = 5
#: buckets of more texts than HOT put their shingle last in the order; at most HELD such shingles go to the workers
HOT, HELD, ROUNDS = 64, 1 << 17, 2
BITS = 1024
ROOM, TURNS = 8, 4


def least_overlap(n):
    """ceil(0.8 n): what a set of n shares at least with any set of that similarity."""
    return (4 * n + 4) // 5


def _nodes(seed: int):
    """(doc_id, node): a hash of the words of each text."""

    def run(batches):
        for batch in parts(batches):
            raw, off = utf8(batch.column("text"))
            view = memoryview(raw)
            node = np.fromiter((xxhash.xxh64_intdigest(b" ".join(bytes(view[a:b]).lower().split()), seed + 1) for a, b in zip(off[:-1], off[1:], strict=True)), np.uint64, batch.num_rows)
            del view
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(node.view(np.int64))], names=["doc_id", "node"])

    return run


def _sets(shingle: int, seed: int):
    """(node, fp, n, sketch, hi, lo): fingerprint, size, bits of parity and sorted hashes of the shingles of each text, the
    upper and the lower halves of the hashes apart, as most comparisons need the upper ones only."""
    digest = xxhash.xxh64_intdigest

    def run(batches):
        for batch in parts(batches, size=1 << 20):
            raw, off = utf8(batch.column("text"))
            view = memoryview(raw)
            fp, sets, sketches = np.zeros(batch.num_rows, np.uint64), [], []
            for i in range(batch.num_rows):
                words = bytes(view[off[i] : off[i + 1]]).lower().split()
                line = b" ".join(words)
                n = max(1, len(words) - shingle + 1) if words else 0
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.append(0, ends[: max(n - 1, 0)] + 1)[:n].tolist()
                h = np.unique(np.fromiter((digest(line[x:y], seed) for x, y in zip(starts, ends[len(ends) - n :].tolist(), strict=True)), np.uint64, n))
                count = np.zeros(64, np.int64)
                for a in range(0, len(h), 1 << 14):
                    count += np.unpackbits(h[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                fp[i] = np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0]
                sets.append(h)
                sketches.append(np.packbits(np.bincount((h % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1 == 1).tobytes())
            del view
            halves = [pa.array([(h >> np.uint64(shift)).astype("<u4").tobytes() for h in sets], pa.binary()) for shift in (32, 0)]
            n = pa.array([len(h) for h in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(fp.view(np.int64)), n, pa.array(sketches, pa.binary()), *halves], names=["node", "fp", "n", "sketch", "hi", "lo"])
            del halves, sets
            release()

    return run


def _prefixes(hot):
    """(key, node, n) for the prefix of each set; the shingles of `hot` come last in the order."""

    def run(batches):
        late = np.sort(np.array(hot.value, np.int64))
        for batch in batches:
            nodes, halves = batch.column("node").to_numpy(), [batch.column(c) for c in ("hi", "lo")]
            for first in range(0, len(nodes), 1024):
                keys, owner, sizes = [], [], []
                for i in range(first, min(first + 1024, len(nodes))):
                    hi, lo = (np.frombuffer(x[i].as_buffer(), "<u4").astype(np.uint64) for x in halves)
                    h = (hi << np.uint64(32) | lo).view(np.int64)
                    n = len(h)
                    if not n:
                        continue
                    if len(late):
                        at = np.minimum(np.searchsorted(late, h), len(late) - 1)
                        h = h[np.argsort(late[at] == h, kind="stable")]
                    keys.append(h[: n - least_overlap(n) + 1])
                    owner.append(i)
                    sizes.append(n)
                if keys:
                    k = [len(x) for x in keys]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(nodes[owner], k)), pa.array(np.repeat(np.array(sizes, np.int64), k))], names=["key", "node", "n"])

    return run


def prefix_keys(sets: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, node, n): prefixes of the sets. Which shingles count as hot changes the number of candidates, never the pairs."""
    spark, late = sets.sparkSession, []
    sets = sets.select("node", "hi", "lo")
    for _ in range(ROUNDS):
        keys = sets.mapInArrow(_prefixes(spark.sparkContext.broadcast(late)), "key long, node long, n long")
        found = keys.groupBy("key").count().where(F.col("count") > hot).orderBy(F.desc("count"), "key").limit(HELD)
        new = sorted(set(late) | {r.key for r in found.select("key").collect()})[:HELD]
        if new == late:
            break
        late = new
    return sets.mapInArrow(_prefixes(spark.sparkContext.broadcast(late)), "key long, node long, n long")


def _bits(column: pa.Array) -> np.ndarray:
    """Sketches as a matrix of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), BITS // 64)


def _groups(batches, columns):
    """Runs of whole buckets of rows sorted by key, as arrays of the columns (key first)."""
    held = None
    for batch in batches:
        got = [_bits(batch.column(c)) if c == "sketch" else batch.column(c).to_numpy() for c in columns]
        held = got if held is None else [np.concatenate(x) for x in zip(held, got, strict=True)]
        at = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if at > 20_000:
            yield [h[:at] for h in held]
            held = [h[at:].copy() for h in held]
    if held is not None and len(held[0]):
        yield held


def _meet(batches):
    """Members of buckets of two and more, each with the smallest one whose size allows the similarity (itself: null)."""
    for key, n, node in _groups(batches, ("key", "n", "node")):
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        bucket = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
        size = np.diff(np.append(start, len(key)))[bucket]
        order = bucket.astype(np.int64) << 32
        to = np.searchsorted(order + n, order + least_overlap(n))
        keep = size > 1
        own = (to == np.arange(len(key)))[keep]
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(n[keep]), pa.array(node[keep]), pa.array(node[to][keep], mask=own)], names=["key", "n", "u", "v"])


def _several(batches):
    """The rows of buckets with more than one root."""
    for key, n, node, root in _groups(batches, ("key", "n", "node", "root")):
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        keep = np.repeat(np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start), size)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, n, node, root)], names=["key", "n", "node", "root"])


def _nearest(bucket, apart, u, v, ru, rv) -> list[np.ndarray]:
    """Of pairs, the nearest of each two roots of a bucket (ties: the least nodes)."""
    a, b = np.minimum(ru, rv), np.maximum(ru, rv)
    order = np.lexsort((v, u, apart, b, a, bucket))
    a, b, k = a[order], b[order], bucket[order]
    first = order[np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (k[1:] != k[:-1]))[: len(order)]]
    return [x[first] for x in (bucket, apart, u, v, ru, rv)]


def _apart(nearest: bool):
    """Pairs of a bucket of different roots whose sizes and sketches allow the similarity, of each two roots the nearest one only or all; rows come sorted by key and n."""

    def batch(u, v):
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    def run(batches):
        for key, n, node, root, sketch in _groups(batches, ("key", "n", "node", "root", "sketch")):
            bucket = np.cumsum(np.append(True, key[1:] != key[:-1]))
            at, step, held = np.arange(len(key)), 1, None
            while True:
                at = at[at + step < len(key)]
                at = at[(key[at] == key[at + step]) & (n[at] >= least_overlap(n[at + step]))]
                if not len(at):
                    break
                for i in range(0, len(at), 1 << 16):
                    one = at[i : i + (1 << 16)]
                    one = one[root[one] != root[one + step]]
                    apart = 9 * np.bitwise_count(sketch[one] ^ sketch[one + step]).sum(1, dtype=np.int64)
                    ok = apart <= n[one] + n[one + step]
                    one, apart = one[ok], apart[ok]
                    if not nearest:
                        if len(one):
                            yield batch(node[one], node[one + step])
                        continue
                    new = [bucket[one], apart, node[one], node[one + step], root[one], root[one + step]]
                    held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
                    if len(held[0]) > 1 << 18:
                        held = _nearest(*held)
                step += 1
            if held is not None and len(held[0]):
                _, _, u, v, _, _ = _nearest(*held)
                yield batch(u, v)

    return run


def _common(p: np.ndarray, q: np.ndarray) -> int:
    """How many of p are in q, which is sorted."""
    return int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(q) else 0


def _verify(batches):
    """Pairs by the upper halves of the hashes. Equal halves of different shingles only add to what is common, so a pair below
    the similarity is settled, and one above it by more than ROOM shingles too; `sure` says which."""
    for batch in batches:
        like, sure = [], []
        for u, v in zip(batch.column("hu"), batch.column("hv"), strict=True):
            p, q = (np.frombuffer(x.as_buffer(), "<u4") for x in (u, v))
            both = _common(p, q)
            like.append(9 * both >= 4 * (len(p) + len(q)))
            sure.append(9 * (both - ROOM) >= 4 * (len(p) + len(q)) or not len(p) and not len(q))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(sure, pa.bool_())], names=["u", "v", "sure"]).filter(pa.array(like, pa.bool_()))


def _settle(batches):
    """Pairs by whole hashes."""
    for batch in batches:
        ok = []
        for row in zip(*(batch.column(c) for c in ("hu", "lu", "hv", "lv")), strict=True):
            hu, lu, hv, lv = (np.frombuffer(x.as_buffer(), "<u4").astype(np.uint64) for x in row)
            p, q = hu << np.uint64(32) | lu, hv << np.uint64(32) | lv
            ok.append(9 * _common(p, q) >= 4 * (len(p) + len(q)))
        yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))


def _near(batches):
    """Pairs whose sketches leave room for the similarity."""
    for batch in batches:
        a, b = (_bits(batch.column(c)) for c in ("su", "sv"))
        apart = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
        yield batch.select(["u", "v"]).filter(pa.array(9 * apart <= batch.column("nu").to_numpy() + batch.column("nv").to_numpy()))


def verified(pairs: DataFrame, sets: DataFrame, sketched: bool = False) -> DataFrame:
    """The pairs (u, v) of nodes whose sets have a Jaccard similarity of at least 0.8, as a table. sketched: sketches have ruled out what they can."""

    def ends(df, **columns):
        for c in "uv":
            df = df.join(sets.select(F.col("node").alias(c), *[F.col(k).alias(v + c) for k, v in columns.items()]), c)
        return df

    near = pairs if sketched else cut(ends(pairs, n="n", sketch="s").select("u", "v", "nu", "nv", "su", "sv").mapInArrow(_near, "u long, v long"))
    tables = []
    for i in range(TURNS):  # the sets of some pairs at a time, which bounds the shuffles
        some = near.where(F.pmod(F.xxhash64("u", "v"), F.lit(TURNS)) == i)
        tables.append(cut(ends(some, hi="h").select("u", "v", "hu", "hv").mapInArrow(_verify, "u long, v long, sure boolean")))
    like = reduce(DataFrame.unionByName, tables)
    open_ = ends(like.where("not sure").select("u", "v"), hi="h", lo="l").select("u", "v", "hu", "lu", "hv", "lv").mapInArrow(_settle, "u long, v long")
    found = cut(like.where("sure").select("u", "v").unionByName(open_))
    discard(*tables, *([] if sketched else [near]))
    return found


def _pairs(df: DataFrame) -> DataFrame:
    return df.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def one_of_each(docs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """docs with repeated rows of one key (as `rows`, which has the keys of docs, shows them) once."""
    again = cut(rows.groupBy(key).count().where("count > 1").select(key))
    if again.isEmpty():
        return docs
    return docs.join(again, key, "left_anti").unionByName(docs.join(again, key, "left_semi").dropDuplicates([key]))


def similar_components(docs: DataFrame, seed: int = 42, hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id and root, the same for rows that links of similarity 0.8 or more connect.

    Ids are not null; rows of one id have one text. Words are lower-case ASCII letters and other bytes between white space; a
    text of fewer than five words is one shingle, and texts without words are alike. Shingles and texts are told apart by
    hashes of 64 bits.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = keyed(docs, "doc_id", "text")
    rows = cut(docs.mapInArrow(_nodes(seed), "doc_id long, node long"))
    once = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    sets = cut(one_of_each(docs, rows, "doc_id").join(once, "doc_id").select("node", "text").mapInArrow(_sets(SHINGLE, seed), "node long, fp long, n long, sketch binary, hi binary, lo binary"))
    nodes = sets.select("node", "fp")
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(first, "fp").select(F.col("node").alias("u"), F.col("first").alias("v"))
    edges = links(first.select("fp"))
    ends = edges.join(first.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    met = cut(prefix_keys(sets, hot).repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(_meet, "key long, n long, u long, v long"))
    # of all that a text meets, first the one that it meets most often; what that leaves open comes later
    most = met.where("v is not null").groupBy("u", "v").count().groupBy("u").agg(F.max_by("v", F.struct("count", "v")).alias("v"))
    tried = cut(_pairs(same.unionByName(ends.select(F.col("a").alias("u"), F.col("b").alias("v"))).unionByName(most)))
    found = verified(tried, sets)
    roots = components(found)
    of = lambda df, roots: df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    dealt = lambda df: df.repartition("key").sortWithinPartitions("key", "n", "node")
    several = lambda df, roots: dealt(of(df, roots).select("key", "n", "node", "root")).mapInArrow(_several, "key long, n long, node long, root long")
    left = cut(several(met.select("key", "n", F.col("u").alias("node")), roots))
    discard(met, first)
    made = [tried, found]
    # of roots that meet in a bucket first the nearest pair, which mostly joins them; then all pairs of those that are still apart
    for nearest in (True, False):
        rows_ = left if nearest else several(left.drop("root"), roots)
        pairs = dealt(rows_.join(sets.select("node", "sketch"), "node")).mapInArrow(_apart(nearest), "u long, v long").distinct()
        rest = cut(pairs.join(tried, ["u", "v"], "left_anti"))
        more = verified(rest, sets, sketched=True)
        made += [rest, more]
        found, tried = found.unionByName(more), tried.unionByName(rest)
        discard(roots)
        roots = components(found)
    discard(sets, left, *made)
    return rows.select("doc_id", "node").join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
