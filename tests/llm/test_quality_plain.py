"""Features, likelihood and sample of the quality classifier against plain versions."""

import re

import numpy as np

from claimforge.llm import quality as Q


def plain_groups(text):
    """Words and shapes of a text, as sets."""
    words, shapes = set(), set()
    for token in (text or "").encode().split():
        s = token.decode()
        words.add("".join(c.lower() if ord(c) < 128 else c for c in s if ord(c) >= 128 or c.isalnum()))
        shapes.add(re.sub(r"(.)\1+", r"\1", re.sub(r"[a-z]|[^\x00-\x7f]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "0", s)))))
    return words - {""}, shapes


def test_features_of_texts():
    """As many features as different words, shapes and one for repetition; equal groups have equal features."""
    texts = ["The cat, the CAT!", "the cat the cat", "x-1 y22 Z", "", " \n", "é É ü1", "a.b a.b a.b c", "word " * 500]
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    row, f = Q.features(raw, off)
    for i, t in enumerate(texts):
        words, shapes = plain_groups(t)
        assert (row == i).sum() == len(words) + len(shapes) + bool(words), t
    for i, j in ((0, 1), (2, 6)):
        a, b = (plain_groups(texts[k]) for k in (i, j))
        common = len(np.intersect1d(f[row == i], f[row == j]))
        assert len(a[0] & b[0]) + len(a[1] & b[1]) <= common <= len(a[0] & b[0]) + len(a[1] & b[1]) + 1


def test_likelihood_and_gradients():
    """Against the product of probabilities in a loop and finite differences, on 200 texts of four grades."""
    rng = np.random.default_rng(0)
    n, k = 200, 30
    row, code = np.unique(rng.integers(0, n * k, 1500)) // k, np.unique(rng.integers(0, n * k, 1500))[: None] % k
    row, code = row[: min(len(row), len(code))], code[: min(len(row), len(code))]
    grades = rng.integers(0, 4, n)
    params = [rng.normal(size=k), np.array([-0.7]), rng.normal(size=2)]
    value, grad = Q.loss(*params, row, code, grades, 0.01)
    t = [params[1][0], params[1][0] + np.exp(params[2][0]), params[1][0] + np.exp(params[2][0]) + np.exp(params[2][1])]
    total = 0.0
    for i in range(n):
        eta = sum(params[0][c] for r, c in zip(row, code, strict=True) if r == i)
        above = [1.0, *(1 / (1 + np.exp(-(eta - x))) for x in t), 0.0]
        total -= np.log(above[grades[i]] - above[grades[i] + 1])
    assert abs(value - total / n - 0.005 * (params[0] ** 2).sum()) < 1e-9
    for p, g in zip(params, grad, strict=True):
        for i in range(len(p)):
            old, e = p[i], 1e-6
            p[i] = old + e
            up = Q.loss(*params, row, code, grades, 0.01)[0]
            p[i] = old - e
            down = Q.loss(*params, row, code, grades, 0.01)[0]
            p[i] = old
            assert abs((up - down) / (2 * e) - g[i]) < 1e-5


def test_sample_is_bounded(spark, monkeypatch):
    """Three thousand rows of one id are one row; long texts and the whole sample stay within their bounds; the order of rows plays no part."""
    rows = [(1, f"text {i}") for i in range(3000)] + [(2, None), (2, "b b"), (3, " ".join(f"w{i}" for i in range(500))), (4, "four"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rated = spark.createDataFrame([(1, 2), (1, 1), (2, 0), (3, 2), (9, 1), (None, 1), (4, None)], "doc_id long, grade int")
    got = {r.doc_id: (r.grade, len(r.f)) for r in Q.sample_features(rated, docs).collect()}
    assert set(got) == {1, 2, 3} and got[1][0] == 1 and got[2] == (0, 3) and got[3][1] > 500
    assert {r.doc_id: r.f for r in Q.sample_features(rated, docs.repartition(5)).collect()} == {r.doc_id: r.f for r in Q.sample_features(rated, docs).collect()}
    monkeypatch.setattr(Q, "LONGEST", 40)
    assert max(len(r.f) for r in Q.sample_features(rated, docs).collect()) == 40
    monkeypatch.setattr(Q, "FEATURES", 45)
    assert sum(len(r.f) for r in Q.sample_features(rated, docs).collect()) <= 45
    assert Q.sample_features(rated, docs, sample=1).count() <= 1
