"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import random

import pytest

import corpus_pipeline as P
from claimforge.llm import similar

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept(rows):
    """Least ids of the components of pairs with a Jaccard similarity of 0.8 or more."""
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if 9 * len(x & y) >= 4 * (len(x) + len(y)):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d for d in ids if find(d) == d}


def edited(rng):
    """Families of texts with 1 to 12 % of the words changed, which few fingerprints of 3 bits connect."""
    rows = []
    for _ in range(12):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([6, 30, 120, 500]))]
        for _ in range(8):
            copy = list(words)
            for i in rng.sample(range(len(copy)), max(1, len(copy) * rng.randint(0, 4) // 100)):
                copy[i] = f"x{rng.randint(0, 10**6)}"
            rows.append(" ".join(copy + ["the common line of very many texts"] * rng.randint(0, 1)))
    return rows + ["", " \n", "One two", "one  TWO", "one two three"]


@pytest.mark.parametrize("hot", [similar.HOT, 2])
def test_near_dedup_is_whole(spark, monkeypatch, hot):
    monkeypatch.setattr(similar.similar_components, "__defaults__", (42, hot))
    rows = list(enumerate(edited(random.Random(4)))) + [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows.append((5000, None))
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in P.near_dedup(spark, docs, SF).collect()} == kept(rows)
    assert P.near_dedup(spark, docs.limit(0), SF).count() == 0


def test_one_row_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (3, text), (2, text + " end"), (2, text), (None, text), (7, "other words only"), (7, "other words only"), (None, "no id here"), (None, "no id here"), (8, None), (None, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in P.near_dedup(spark, docs, SF).collect()]
    assert len(got) == 4 and {d for d, _ in got} == {2, 7, None, 8}
    assert sorted(P.near_dedup(spark, docs.orderBy("text"), SF).collect(), key=str) == sorted(P.near_dedup(spark, docs, SF).collect(), key=str)


def test_nearest_of_two_roots():
    """Of each two roots of a bucket the nearest pair, whatever order pairs come in."""
    import numpy as np

    from claimforge.llm.similar import _nearest

    rng = np.random.default_rng(2)
    bucket, apart, u, v = (rng.integers(0, n, 400) for n in (3, 50, 40, 40))
    ru, rv = u % 5, v % 5
    want = {}
    for x in zip(bucket, apart, u, v, ru, rv, strict=True):
        key = (x[0], min(x[4:]), max(x[4:]))
        want[key] = min(want.get(key, (99,)), tuple(x[1:4]))
    got = {(k, min(p, q), max(p, q)): (d, a, b) for k, d, a, b, p, q in zip(*_nearest(bucket, apart, u, v, ru, rv), strict=True)}
    assert got == want
