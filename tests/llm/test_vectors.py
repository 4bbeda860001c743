"""Exact search against brute force, recall of the approximate one, odd vectors."""

import numpy as np
import pytest

from claimforge.llm import vectors as V

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    return df, np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)


def by_query(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


def best(ids, score, own, k):
    order = np.lexsort((ids, -score))
    return order[ids[order] != own][:k]


@pytest.mark.parametrize("shard", [8192, 60])
def test_top_k(spark, table, shard, monkeypatch):
    monkeypatch.setattr(V, "SHARD_ROWS", shard)
    monkeypatch.setattr(V, "BLOCK_ROWS", 3)
    df, ids, m = table
    w = np.floor(1024 * m)
    got = by_query(V.top_k_inner(df, df.where("vec_id % 50 = 0"), 10).collect())
    want = {int(q): [(n + 1, int(ids[j]), int((w @ w[i])[j])) for n, j in enumerate(best(ids, w @ w[i], q, 10))] for i, q in enumerate(ids) if q % 50 == 0}
    assert got == want


@pytest.mark.parametrize(("factor", "least"), [(1.0, 1.0), (None, 0.9)])
def test_recall(spark, table, factor, least, monkeypatch):
    monkeypatch.setattr(V, "SHARD_ROWS", 200)
    df, ids, m = table
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = by_query(V.nearest(df, df.where("vec_id % 10 = 0"), 5, factor).collect())
    hit = n = 0
    for i, q in enumerate(ids):
        if q % 10 == 0:
            want = best(ids, u @ u[i], q, 5)
            hit += len({int(x) for x in ids[want]} & {v for _, v, _ in got[int(q)]})
            n += 5
            assert all(abs(s - u[list(ids).index(v)] @ u[i]) < 1e-12 for _, v, s in got[int(q)])
    assert hit / n >= least


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.0, 0.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [5.0]), (None, [1.0, 1.0]), (9, [1e17, -1e17]), (7, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, shard int, v string")
    got = by_query(V.top_k_inner(df, df.where("vec_id in (0, 3, 8)"), 10).collect())
    assert set(got) == {0, 8}
    assert [v for _, v, _ in got[0]] == [6, 7, 7, 8, 5, 9] and got[0][0][2] == 1024 * 1024 * 5
    near = by_query(V.nearest(df, df.where("vec_id in (0, 5)"), 3, 1.0).collect())
    assert set(near) == {0} and [v for _, v, _ in near[0]] == [6, 7, 7]
    none = df.where("vec_id = 77")
    assert V.top_k_inner(none, none, 3).count() == V.nearest(none, none, 3).count() == V.nearest(df, none, 3).count() == 0
    assert V.top_k_inner(df.where("vec_id = 0"), df.where("vec_id = 0"), 3).count() == 0


def test_extreme_and_repeated(spark):
    """Components near the ends of doubles keep their cosines; queries on many shards agree with one; reruns agree."""
    rows = [(0, [1e-200, 0.0]), (1, [1e200, 1e200]), (2, [3.0, 0.0]), (3, [0.0, -1e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_query(V.nearest(df, df.where("vec_id = 0"), 3, 1.0).collect())[0]
    assert [v for _, v, _ in got] == [2, 1, 3] and np.allclose([s for *_, s in got], [1.0, 0.5**0.5, 0.0])


def clustered(n, size=32, centres=40, noise=0.15, seed=4):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centres, size))[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, size))


SHAPES = [(16, 40, 0.15, 1), (16, 300, 0.3, 2), (32, 40, 0.15, 4), (48, 10, 0.6, 5), (64, 80, 0.2, 6), (96, 40, 0.4, 7), (8, 1, 1.0, 8)]


@pytest.mark.parametrize(("size", "centres", "noise", "seed"), SHAPES)
def test_recall_of_many_shapes(monkeypatch, size, centres, noise, seed):
    """The factor that a tree takes for itself keeps nine tenths of the neighbours of vectors that it was not tuned on, whatever the shape; one is exact."""
    both = clustered(6100, size, centres, noise, seed)
    m, asked = both[:6000], both[6000:]
    u, asked = m / np.linalg.norm(m, axis=1, keepdims=True), V.balanced(asked)
    tree = V.VPTree(np.arange(len(m)), m)
    factor = tree.tuned(5)
    scored, plain = [0], V.Best.offer
    monkeypatch.setattr(V.Best, "offer", lambda self, score, ids: (scored.__setitem__(0, scored[0] + len(ids)), plain(self, score, ids)) and None)
    for f, recall in ((1.0, 1.0), (factor, 0.9)):
        hit = scored[0] = 0
        bound = tree.bounds(asked).tolist()
        for x, q in enumerate(asked):
            best = V.Best(5)
            tree.search(q, bound[x], -1, best, f)
            hit += len(set(best.ids.tolist()) & set(np.argsort(-(u @ q))[:5].tolist()))
        print(f"SHAPE {size} {centres} {noise} factor {f} recall {hit / 500} scored {scored[0] / 600000:.3f}")
        assert hit / 500 >= recall, (f, hit / 500)


def test_pruning_of_clusters():
    """On clustered vectors most pairs are left out."""
    m = clustered(8000)
    assert V.VPTree(np.arange(len(m)), m).tuned(5) < 0.4
