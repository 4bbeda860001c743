"""Vector search over shards: exact top-k inner products by KD-trees, nearest neighbours by vantage-point trees.

Vectors are dealt to shards by the hash of their id, so many to a shard. Queries are packed in blocks of bounded size. A task
gets the vectors of a shard, builds its tree once, and then the query blocks that meet it, one after the other; trees never
travel. Each block first meets one shard; the k-th scores found there go with it to all other shards as bounds.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimforge.llm.common import cut, read_table, ship

SHARD_ROWS, BLOCK_ROWS, LEAF = 8192, 512, 64
#: factors that a vantage-point tree may take, the recall that it must show on as many of its own vectors
FACTORS, RECALL, TRIALS = (0.1, 0.14, 0.18, 0.22, 0.27, 0.33, 0.4, 0.5, 0.7, 1.0), 0.96, 64
BLOCKS = 64  # query blocks that one tree serves


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of rows with an id and a vector of finite components."""
    ship(df.sparkSession)
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def _dense(column, size: int = 0) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), max(size, int(n.max(initial=0)))))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def widen(m: np.ndarray, size: int) -> np.ndarray:
    return m if m.shape[1] >= size else np.concatenate([m, np.zeros((len(m), size - m.shape[1]), m.dtype)], 1)


class Best:
    """The k best (score, id) of one query: highest score, then smallest id. Scores below a known k-th one are left out."""

    __slots__ = ("k", "score", "ids", "kth")

    def __init__(self, k: int, kth=None):
        self.k, self.score, self.ids, self.kth = k, None, None, kth

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        if self.kth is not None:
            near = score >= self.kth
            if not near.any():
                return
            score, ids = score[near], ids[near]
        if self.score is not None:
            score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[order], ids[order]
        if len(order) == self.k:
            self.kth = self.score[-1]


class KDTree:
    """Median splits of the widest dimension, each node with its tight bounding box."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order, nodes, lo, hi = np.arange(len(ids)), [], [], []
        todo = [(0, len(ids), None)]
        while todo:
            a, b, parent = todo.pop()
            here, box = len(nodes), vectors[order[a:b]]
            lo.append(box.min(0))
            hi.append(box.max(0))
            nodes.append([a, b, -1, -1])
            if parent is not None:
                nodes[parent[0]][parent[1]] = here
            spread = hi[-1] - lo[-1]
            if b - a > leaf and len(spread) and spread.max() > 0:
                mid = (a + b) // 2
                order[a:b] = order[a:b][np.argpartition(box[:, int(spread.argmax())], mid - a)]
                todo += [(mid, b, (here, 3)), (a, mid, (here, 2))]
        self.ids, self.vectors, self.nodes = ids[order], vectors[order], nodes
        self.lo, self.hi = np.stack(lo), np.stack(hi)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each query can have in each node's box."""
        return np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T

    def search(self, query: np.ndarray, bound: list, own: int, best: Best) -> None:
        """Best first; ends at the first node whose bound is below the k-th score so far."""
        heap = [(-bound[0], 0)]
        while heap:
            most, at = heapq.heappop(heap)
            if best.kth is not None and -most < best.kth:
                return
            a, b, left, right = self.nodes[at]
            if left >= 0:
                heapq.heappush(heap, (-bound[left], left))
                heapq.heappush(heap, (-bound[right], right))
                continue
            ids = self.ids[a:b]
            score = self.vectors[a:b] @ query
            other = ids != own
            best.offer(score[other], ids[other])


def balanced(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring their largest components near one: same cosines, no over- or underflow."""
    _, exponent = np.frexp(np.abs(vectors).max(1, initial=0))
    return np.ldexp(vectors, -exponent[:, None])


class VPTree:
    """Vantage points with the median distance to them; each side knows the range of its distances.

    Distances are Euclidean between unit vectors, which order as cosines do.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        vectors = balanced(vectors)
        self.norm = np.sqrt((vectors * vectors).sum(1))
        unit = vectors / self.norm[:, None]
        order, nodes, points = np.arange(len(ids)), [], []
        rng = np.random.default_rng(len(ids))
        todo = [(0, len(ids), None)]
        while todo:
            a, b, parent = todo.pop()
            here = len(nodes)
            nodes.append([a, b, -1, -1, 0.0, 0.0, 0.0, 0.0])
            points.append(unit[order[a]])
            if parent is not None:
                nodes[parent[0]][parent[1]] = here
            if b - a <= leaf:
                continue
            at = order[a:b]
            points[-1] = unit[at[int(rng.integers(len(at)))]]
            d = np.sqrt(np.maximum(0, 2 - 2 * (unit[at] @ points[-1])))
            mid = (b - a) // 2
            part = np.argpartition(d, mid)
            order[a:b], d = at[part], d[part]
            nodes[here][4:] = [d[:mid].min(), d[:mid].max(), d[mid:].min(), d[mid:].max()]
            todo += [(a + mid, b, (here, 3)), (a, a + mid, (here, 2))]
        self.ids, self.vectors, self.norm, self.nodes = ids[order], vectors[order], self.norm[order], nodes
        self.points = np.stack(points)
        self.chosen: dict[tuple[int, float], float] = {}

    def tuned(self, k: int, recall: float = RECALL) -> float:
        """The least of FACTORS that finds `recall` of the k nearest of TRIALS of the tree's own vectors, all of which are compared with all."""
        if (k, recall) not in self.chosen:
            trial = np.unique(np.linspace(0, len(self.ids) - 1, TRIALS).astype(np.int64))
            bound, want = self.bounds(self.vectors[trial]).tolist(), []
            for i in trial:
                other = self.ids != self.ids[i]
                score = (self.vectors @ self.vectors[i]) / (self.norm * self.norm[i])
                want.append(np.sort(score[other])[::-1][:k])
            total = sum(map(len, want))
            for factor in FACTORS:
                found = 0
                for x, i in enumerate(trial):
                    best = Best(k)
                    self.search(self.vectors[i], bound[x], int(self.ids[i]), best, factor)
                    if best.score is not None and len(want[x]):
                        found += int((best.score >= want[x][-1] - 1e-12).sum())
                if found >= recall * total:
                    break
            self.chosen[k, recall] = factor
        return self.chosen[k, recall]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Distance of each query to each vantage point."""
        size = np.sqrt((queries * queries).sum(1))[:, None]
        return np.sqrt(np.maximum(0, 2 - 2 * (queries / size @ self.points.T)))

    def search(self, query: np.ndarray, distance: list, own: int, best: Best, factor: float = 1.0) -> None:
        """Nearest range first. A side is left out if its distances differ from the query's by over factor * the k-th distance."""
        size = math.sqrt(float((query * query).sum()))
        heap = [(0.0, 0)]
        slack = 1e-7  # rounding of distances, so that factor one loses nothing
        while heap:
            gap, at = heapq.heappop(heap)
            if best.kth is not None and gap > factor * math.sqrt(max(0.0, 2 - 2 * best.kth)) + slack:
                return
            a, b, inner, outer, lo_i, hi_i, lo_o, hi_o = self.nodes[at]
            if inner < 0:
                ids = self.ids[a:b]
                score = (self.vectors[a:b] * query).sum(1) / (self.norm[a:b] * size)
                other = ids != own
                best.offer(score[other], ids[other])
                continue
            d = distance[at]
            heapq.heappush(heap, (max(gap, d - hi_i, lo_i - d), inner))
            heapq.heappush(heap, (max(gap, d - hi_o, lo_o - d), outer))


def _search(rows: DataFrame, queries: DataFrame, k: int, build, probe, prepare, kind: str) -> DataFrame:
    """rows, queries: (vec_id, v). Returns query_id, rank, vec_id, score."""
    n, m = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-m // BLOCK_ROWS))
    found_schema = f"query_id long, vec_id long, score {kind}"

    def pack_block(table: pa.Table) -> pa.Table:
        ids, first = np.unique(table.column("vec_id").to_numpy(), return_index=True)
        kth = [table.column("kth")[int(i)].as_py() for i in first]
        return pa.table({"block": table.column("block").slice(0, 1), "queries": pa.array([pickle.dumps((ids, prepare(_dense(table.column("v")))[first], kth))], pa.binary())})

    def emit(best: dict[int, Best]) -> pa.RecordBatch:
        some = [(q, b) for q, b in best.items() if b.score is not None and len(b.ids)]
        number = int if kind == "long" else float
        columns = [pa.array(np.repeat([q for q, _ in some], [len(b.ids) for _, b in some]).astype(np.int64)), pa.array([int(i) for _, b in some for i in b.ids], pa.int64()), pa.array([number(x) for _, b in some for x in b.score], pa.int64() if kind == "long" else pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    def tree_of(ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((*vectors.T[::-1], ids))  # the same tree whatever the order in which rows come
        return build(ids[order], vectors[order])

    def run(batches):
        """Rows sorted by (shard, part, block): first the vectors of a shard, without a block, then its query blocks."""
        ids, vectors, tree, last = [], [], None, None
        for batch in batches:
            place = list(zip(batch.column("shard").to_pylist(), batch.column("part").to_pylist(), strict=True))
            is_query = batch.column("queries").is_valid().to_numpy(zero_copy_only=False)
            i = 0
            while i < batch.num_rows:
                if place[i] != last:
                    ids, vectors, tree, last = [], [], None, place[i]
                if not is_query[i]:
                    j = i + 1
                    while j < batch.num_rows and not is_query[j] and place[j] == last:
                        j += 1
                    ids.append(batch.column("vec_id").slice(i, j - i).to_numpy(zero_copy_only=False).astype(np.int64))
                    vectors.append(_dense(batch.column("v").slice(i, j - i)))
                    i = j
                    continue
                if vectors:
                    size = max(x.shape[1] for x in vectors)
                    tree = tree_of(np.concatenate(ids), prepare(np.concatenate([widen(x, size) for x in vectors])))
                    ids, vectors = [], []
                own, q, kth = pickle.loads(batch.column("queries")[i].as_py())
                i += 1
                if tree is None:  # a shard that the hash left without vectors
                    continue
                if q.shape[1] > tree.vectors.shape[1]:
                    tree = build(tree.ids, widen(tree.vectors, q.shape[1]))
                q = widen(q, tree.vectors.shape[1])
                bound = tree.bounds(q).tolist()
                best = {o: Best(k, x) for o, x in zip(own.tolist(), kth, strict=True)}
                for x, o in enumerate(best):
                    probe(tree, q[x], bound[x], o, best[o])
                yield emit(best)

    parts = -(-blocks // BLOCKS)
    spread = lambda df, name, count: df.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(count)))
    many = lambda name, count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias(name)
    vectors = spread(rows, "shard", shards).select("shard", many("part", parts), F.lit(-1).cast("long").alias("block"), "vec_id", "v", F.lit(None).cast("binary").alias("queries"))

    def meet(asked: DataFrame, home: bool) -> DataFrame:
        """Best of the query blocks (vec_id, v, kth) in the shard that each meets first, or in all others."""
        first = F.pmod("block", F.lit(shards))
        packed = spread(asked, "block", blocks).groupBy("block").applyInArrow(pack_block, "block long, queries binary")
        met = packed.select(first.alias("shard"), "block", "queries") if home else packed.select(many("shard", shards), "block", "queries").where(F.col("shard") != first)
        met = met.select("shard", F.floor(F.col("block") / BLOCKS).alias("part"), "block", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("v"), "queries")
        return vectors.unionByName(met).repartition("shard", "part").sortWithinPartitions("shard", "part", "block").mapInArrow(run, found_schema)

    found = meet(queries.withColumn("kth", F.lit(None).cast(kind)), True)
    if shards > 1:
        found = cut(found)
        kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "kth")
        found = found.unionByName(meet(queries.join(kth, "vec_id", "left"), False))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class IntegerKDTree(KDTree):
    """A KD-tree of integer vectors. Scores that a double may not hold exactly are made again from whole numbers."""

    def __init__(self, ids, vectors, leaf: int = LEAF):
        super().__init__(ids, vectors, leaf)
        self.most = float(np.abs(self.vectors).max(initial=0))

    def search(self, query, bound, own, best):
        plain = best.score is None or best.score.dtype != object
        if plain and self.most * float(np.abs(query).sum()) < 2.0**52:
            return super().search(query, bound, own, best)
        exact = self.vectors.astype(object) @ query.astype(object)
        rows = [(-max(-(1 << 63), min((1 << 63) - 1, int(x))), int(i)) for x, i in zip(exact, self.ids, strict=True) if i != own]
        rows += [] if best.score is None else [(-int(x), int(i)) for x, i in zip(best.score, best.ids, strict=True)]
        rows = sorted(rows)[: best.k]
        best.score, best.ids = np.array([-s for s, _ in rows], object), np.array([i for _, i in rows], np.int64)
        best.kth = best.score[-1] if len(rows) == best.k else None


def top_k_inner(vectors: DataFrame, queries: DataFrame, k: int, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Exact top k: query_id, rank, vec_id and score, the inner product of floor(scale * x).

    Candidates are all rows of vectors but those with the query's id; ties go to the smaller vec_id. Rows with a null id, a null
    vector, or a null or non-finite component take no part; a shorter vector counts as filled up with zeros; repeated rows are
    candidates as often, repeated queries are answered once. A score beyond a long is clipped to its range. Extra columns are
    ignored, empty inputs give an empty result.
    """
    whole = lambda m: np.floor(scale * m)

    def build(ids, m):
        return IntegerKDTree(ids, m)

    return _search(usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col), k, build, lambda t, q, b, own, best: t.search(q, b, own, best), whole, "long")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, factor: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Nearest found by cosine: query_id, rank, vec_id and score, the cosine of the original vectors in double precision.

    factor relaxes the triangle-inequality pruning: one is exact, less leaves out more; None: each shard's tree takes the least that shows a recall of RECALL
    on vectors of its own (see `VPTree.tuned`). Candidates are all rows of vectors but
    those with the query's id; ties go to the smaller vec_id. Rows with a null id, a null or zero vector, or a null or non-finite
    component take no part; a shorter vector counts as filled up with zeros; repeated rows are candidates as often, repeated
    queries are answered once. Extra columns are ignored, empty inputs give an empty result.
    """
    some = F.exists("v", lambda x: x != 0)
    rows, asked = usable(vectors, id_col, vec_col).where(some), usable(queries, id_col, vec_col).where(some)
    return _search(rows, asked, k, VPTree, lambda t, q, b, own, best: t.search(q, b, own, best, factor or t.tuned(k)), balanced, "double")


def op2_kdtree_top_k(spark, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "embeddings")
    return top_k_inner(df, df.where("vec_id % 100 = 0"), 10)


def op6_vptree_ann(spark, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "embeddings")
    return nearest(df, df.where("vec_id % 50 = 0"), 5)
