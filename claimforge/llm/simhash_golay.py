"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded to a word of the perfect binary Golay code
[23, 12, 7]. A word's fuzzy keys are the indices of the codewords nearest to it and to its one-bit neighbours (one key or
six). Words that differ in one bit have opposite parity and share the key of the odd one, so odd words need their own
codeword only. Three errors on three segments leave, by the pigeonhole principle, either an exact segment and another with
at most one error, or one error in each: the keys are (exact i, fuzzy j) for i != j and (fuzzy, fuzzy, fuzzy). Fingerprints
that share a key are compared; links within a bucket leave it as a spanning forest, and the components of all forests are
found by alternating star contraction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.llm import grams
from claimforge.llm.common import cut, discard, keyed, parts, read_table, release, ship, utf8

SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0xC75
RADIUS = 3


def _fingerprints(shingle: int, seed: int):
    digest = xxhash.xxh64_intdigest

    def run(batches):
        for batch in parts(batches):
            raw, off = utf8(batch.column("text"))
            view = memoryview(raw)
            out = np.zeros(batch.num_rows, np.uint64)
            for i in range(batch.num_rows):
                words = bytes(view[off[i] : off[i + 1]]).lower().split()
                if not words:
                    continue
                n = max(1, len(words) - shingle + 1)
                line = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.append(0, ends[: n - 1] + 1)
                stops = ends[-n:]
                count = np.zeros(64, np.int64)
                for a in range(0, n, 100_000):
                    h = np.array([digest(line[x:y], seed) for x, y in zip(starts[a : a + 100_000].tolist(), stops[a : a + 100_000].tolist(), strict=True)], np.uint64)
                    count += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                out[i] = np.packbits(2 * count > n, bitorder="little").view("<u8")[0]
            del view
            release()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): majority bits of the XXH64 of all word shingles, repeats included, as a signed 64-bit number."""
    return keyed(docs, "doc_id", "text").mapInArrow(_fingerprints(shingle, seed), "doc_id long, fp long")


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each 23-bit word's low and high part, and the error pattern of each syndrome."""

    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x

    single = [remainder(1 << i) for i in range(23)]
    low, high = np.zeros(1 << 12, np.uint32), np.zeros(1 << 11, np.uint32)
    for i in range(12):
        low[1 << i : 2 << i] = low[: 1 << i] ^ single[i]
    for i in range(11):
        high[1 << i : 2 << i] = high[: 1 << i] ^ single[12 + i]
    error = np.zeros(1 << 11, np.uint32)
    for a in range(23):
        error[single[a]] = 1 << a
        for b in range(a):
            error[single[a] ^ single[b]] = 1 << a | 1 << b
            for c in range(b):
                error[single[a] ^ single[b] ^ single[c]] = 1 << a | 1 << b | 1 << c
    return np.concatenate([low, high]), error


def fuzzy_keys(words: np.ndarray, bits: int) -> np.ndarray:
    """Six columns of codeword indices of words of so many bits; -1 where there are fewer."""
    syndromes, error = _golay()
    w = words.astype(np.uint32)

    def index(x: np.ndarray) -> np.ndarray:
        s = syndromes[x & 0xFFF] ^ syndromes[4096 + (x >> 12)]
        return ((x ^ error[s]) >> 11).astype(np.int64)

    own = index(w)
    near = np.sort(np.stack([own, *(index(w ^ np.uint32(1 << i)) for i in range(bits))], 1), 1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near = -np.sort(-near, 1)[:, :6]
    odd = np.bitwise_count(w) % 2 == 1
    near[odd] = -1
    near[odd, 0] = own[odd]
    return near


def _keys(batches):
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        for start in range(0, len(fp), 8192):
            x = fp[start : start + 8192].view(np.uint64)
            part = [(x >> np.uint64(s)) & np.uint64((1 << n) - 1) for s, n in SEGMENTS]
            fuzzy = [fuzzy_keys(p, n) for p, (_, n) in zip(part, SEGMENTS, strict=True)]
            keys, owners = [], []
            family = 0
            for i in range(3):
                for j in range(3):
                    if i != j:
                        row, col = np.nonzero(fuzzy[j] >= 0)
                        keys.append((family << 40) | (part[i].astype(np.int64)[row] << 12) | fuzzy[j][row, col])
                        owners.append(row)
                        family += 1
            n = [(f >= 0).sum(1) for f in fuzzy]
            row = np.repeat(np.arange(len(x)), n[0] * n[1] * n[2])
            k = np.arange(len(row)) - np.repeat(np.cumsum(n[0] * n[1] * n[2]) - n[0] * n[1] * n[2], n[0] * n[1] * n[2])
            a, b, c = k % n[0][row], k // n[0][row] % n[1][row], k // (n[0] * n[1])[row]
            keys.append((family << 40) | (fuzzy[0][row, a] << 24) | (fuzzy[1][row, b] << 12) | fuzzy[2][row, c])
            owners.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(x.view(np.int64)[np.concatenate(owners)])], names=["key", "fp"])


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, least member) of the components of some edges."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            break
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _links(radius: int):
    """Spanning forests of the links within each bucket; rows come sorted by key."""

    def solve(keys: np.ndarray, fps: np.ndarray):
        us, vs, size = [], [], 0
        at = np.arange(len(keys) - 1)
        step = 1
        while True:
            at = at[at + step < len(keys)]
            at = at[keys[at] == keys[at + step]]
            if not len(at):
                break
            near = at[np.bitwise_count((fps[at] ^ fps[at + step]).view(np.uint64)) <= radius]
            us.append(fps[near])
            vs.append(fps[near + step])
            size += len(near)
            if size > 1 << 20:
                u, v = forest(np.concatenate(us), np.concatenate(vs))
                us, vs, size = [u], [v], len(u)
            step += 1
        if size:
            return forest(np.concatenate(us), np.concatenate(vs))
        return None

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "fp"), strict=True)]
            at = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if at > 20_000 and (found := solve(held[0][:at], held[1][:at])):
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["u", "v"])
            if at > 20_000:
                held = [h[at:].copy() for h in held]
        if len(held[0]) and (found := solve(*held)):
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["u", "v"])

    return run


def _deal(level: int):
    """Four finer keys of each row: its key and the bits of the fingerprint whose number has 0, 1, 2 or 3 as a digit in base four.

    Of four disjoint sets of bits, three errors leave one alone; each level takes another digit.
    """
    masks = [np.uint64(sum(1 << b for b in range(64) if b >> (2 * level) & 3 == digit)) for digit in range(4)]

    def run(batches):
        for batch in batches:
            key, fp = batch.column("key").to_numpy().view(np.uint64), batch.column("fp").to_numpy().view(np.uint64)
            keys = [grams.mix(grams.mix(key + np.uint64(4 * level + digit)) ^ grams.mix((fp & mask) + np.uint64(digit))) for digit, mask in enumerate(masks)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(fp, 4).view(np.int64))], names=["key", "fp"])

    return run


def _tiles(rows: DataFrame, split: int) -> DataFrame:
    """(key, fp) of buckets of more than `split` rows, with a key for each two of their tiles of about so many rows, so that any two rows share one."""
    sizes = rows.groupBy("key").count().where(F.col("count") > split).select("key", F.ceil(F.col("count") / split).alias("tiles"))
    own = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(5)), F.col("tiles")))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    return met.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")


def links(fps: DataFrame, radius: int = RADIUS, split: int = 1 << 14) -> DataFrame:
    """Edges (u, v) of spanning forests that connect distinct fingerprints (column fp) at most `radius` bits apart.

    A bucket of more than `split` fingerprints is dealt out by four sets of sixteen further bits, of which one is equal, by the
    pigeonhole principle again, and its parts likewise up to three times; then 37 bits are equal. A part that is still larger is cut into tiles by a hash,
    and each two tiles meet in a bucket of their own.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError("the keys hold for 0 to 3 differing bits")
    ship(fps.sparkSession)
    todo = cut(fps.mapInArrow(_keys, "key long, fp long"))
    solve = lambda df: cut(df.repartition("key").sortWithinPartitions("key").mapInArrow(_links(radius), "u long, v long").distinct())
    out = []
    for level in range(4):
        large = cut(todo.groupBy("key").count().where(F.col("count") > split).select("key"))
        if large.isEmpty():
            out.append(solve(todo))
            discard(todo, large)
            break
        out.append(solve(todo.join(large, "key", "left_anti")))
        if level == 3:
            out.append(solve(_tiles(todo, split)))
            discard(todo, large)
            break
        dealt = cut(todo.join(large, "key", "left_semi").mapInArrow(_deal(level), "key long, fp long"))
        discard(todo, large)
        todo = dealt
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for every node of edges (u, v), by alternating large and small stars.

    Each round's tables are written; the least neighbour is aggregated before the shuffle and is a table of its own, so that a
    centre with many neighbours is a skewed key of a plain join, which can be split. No adjacency list is ever built.
    """
    edges = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = cut(small)
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges, low, large, least)
        edges = after
        if now == state:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            roots.table_path = edges.table_path
            return roots
        state = now


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, seed: int = 42, split: int = 1 << 14) -> DataFrame:
    """Per row of docs: doc_id, fp and component_id, the least doc_id reachable over links of at most `radius` bits.

    Uses doc_id and text only; other columns, whatever their names, play no part. Null and empty texts and those of white
    space have fingerprint zero and are linked like any other. Fewer words than a shingle: the whole sequence is one. Repeated
    rows come back as often. A row with a null doc_id has a component; its id is null if no member has a doc_id.
    """
    fp = cut(fingerprints(docs, shingle, seed))
    distinct = cut(fp.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    roots = components(links(distinct.select("fp"), radius, split))
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_fp = labelled.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fp.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
