"""Both substring deduplicators and near-duplicates against brute force, with odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import fingerprint, linked, sha, substrings, word_windows
from pyspark.sql import functions as F

from claimforge.llm import grams, simhash_golay
from claimforge.llm.repeats import holding
from claimforge.llm.rlz_dedup import ReferenceIndex, rlz_dedup
from claimforge.llm.simhash_golay import _golay, components, fuzzy_keys, links, near_duplicates
from claimforge.llm.suffix_dedup import blind_trie_order, deep_shallow, suffix_dedup

SF = "/root/testdata/sf0.001"
# extra columns with names that the operators use themselves
SCHEMA = "doc_id long, text string, a int, anchor long, key string, fp long, block string, spans string"


def make(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, "k", 3, "b", "s") for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    vocab = ["é", "ab", "the", "x" * 30, "中文", "of", "q"] + [f"w{i}" for i in range(60)]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", "\n", "  ", "\u00a0 ", "\x0b"]) for _ in range(n))
    base = [text(150) for _ in range(4)]
    rows = [(100 - i, rng.choice(base)[rng.randint(0, 200) :] + text(rng.randint(0, 60)) + rng.choice(base)[: rng.randint(0, 400)]) for i in range(40)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, "same same " * 400), (204, "same same " * 300), (205, "short"), (206, text(9000) + base[0]), (207, "aaaa" * 200)]
    rows += [(300 + i, base[1]) for i in range(5)]
    return rows


def digest7(df):
    c = df.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("r"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h"))
    return {r.doc_id: (r.n_bytes, r.r, r.s, r.h) for r in c.collect()}


def digest1(df):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return {r.doc_id: (r.n_words, r.r, r.h) for r in df.select("doc_id", "n_words", removed.alias("r"), F.sha2("kept", 256).alias("h")).collect()}


@pytest.mark.parametrize("split", [1 << 13, 3])
def test_suffix_dedup(spark, odd, split):
    assert digest7(suffix_dedup(make(spark, odd), split=split)) == substrings(odd)


@pytest.mark.parametrize("split", [1 << 13, 3])
def test_rlz_dedup(spark, odd, split):
    assert digest1(rlz_dedup(make(spark, odd), split=split)) == word_windows(odd)


@pytest.mark.parametrize("dedup", [suffix_dedup, rlz_dedup])
def test_rows_that_share_an_id(spark, dedup):
    a, b = (" ".join(f"{c}{i}" for i in range(200)) for c in "ab")
    rows = {(r.doc_id, r.kept if isinstance(r.kept, str) else bytes(r.kept).decode()) for r in dedup(make(spark, [(1, a), (2, a), (2, b), (2, a), (3, b + " " + a)])).select("doc_id", "kept").collect()}
    assert rows == {(1, a), (2, ""), (2, b), (3, "" if dedup is rlz_dedup else " ")}


def test_bytes_behind_equal_hashes(spark, monkeypatch):
    """With hashes that tell nothing apart, nothing that occurs once is cut."""
    docs = [(1, " ".join(f"a{i}" for i in range(90))), (2, " ".join(f"b{i}" for i in range(90))), (3, " ".join(f"a{i}" for i in range(90)))]
    for dedup, digest, plain in ((rlz_dedup, digest1, word_windows), (suffix_dedup, digest7, substrings)):
        assert digest(dedup(make(spark, docs))) == plain(docs)
    spans = pa.array([[{"a": 0, "b": 3, "shift": None, "want": b"x y z"}, {"a": 1, "b": 2, "shift": None, "want": b"b"}, {"a": 2, "b": 3, "shift": -2, "want": None}]])
    x, y = holding(spans, 0, [b"a", b"b", b"c"], bytes.split)
    assert (x.tolist(), y.tolist()) == ([1], [2])


def test_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert digest7(suffix_dedup(docs)) == substrings(rows)
    assert digest1(rlz_dedup(docs)) == word_windows(rows)


def test_slices_of_long_texts(spark, odd, monkeypatch):
    monkeypatch.setattr(grams, "SLICE", 700)
    raw = np.frombuffer("".join(t or "" for _, t in odd).encode(), np.uint8)
    bounds = np.append(0, np.cumsum([len((t or "").encode()) for _, t in odd]))
    small = grams.anchors(lambda a, b: grams.BYTE[raw[a:b]], bounds, 100, 20)
    monkeypatch.setattr(grams, "SLICE", 1 << 20)
    whole = grams.anchors(lambda a, b: grams.BYTE[raw[a:b]], bounds, 100, 20)
    assert {tuple(x) for x in np.stack(small, 1).tolist()} == {tuple(x) for x in np.stack(whole, 1).tolist()}


@pytest.mark.parametrize("dedup", [suffix_dedup, rlz_dedup])
def test_no_rows_and_repeats(spark, dedup):
    assert dedup(make(spark, [])).count() == 0
    long = " ".join(f"w{i}" for i in range(200))
    rows = dedup(make(spark, [(1, long), (1, long), (None, long), (2, long)])).select("doc_id", F.size("spans").alias("n")).collect()
    assert sorted((r.doc_id or 0, r.n) for r in rows) == [(0, 0), (1, 0), (1, 0), (2, 1)]


def test_sorting():
    rng = np.random.default_rng(3)
    strings = [bytes(rng.integers(97, 99, 40, dtype=np.uint8)) for _ in range(400)]
    strings += [b"a" * 30 + bytes(rng.integers(97, 99, 10, dtype=np.uint8)) for _ in range(400)]
    once = list(dict.fromkeys(strings))
    assert [once[i] for i in blind_trie_order(once)] == sorted(once)
    bucket = np.sort(rng.integers(0, 3, len(strings)))
    order, lcp = deep_shallow(np.frombuffer(b"".join(strings), np.uint8).reshape(-1, 40), bucket)
    got = [(bucket[i], strings[i]) for i in order]
    assert got == sorted(got)
    for x, y, n in zip(got, got[1:], lcp[1:], strict=False):
        want = -1 if x[0] != y[0] else next((k for k in range(40) if x[1][k] != y[1][k]), 40)
        assert n == want


def test_factors():
    index = ReferenceIndex(50)
    words = [b"%d" % i for i in range(80)]
    index.add(words, 0, 30)
    assert index.factors(words[7:60] + [b"x"] + words[3:55], 0, 99) == [(0, 53), (54, 106)]
    assert index.factors(words[7:60], 1, 1) == [(1, 53)]


def test_golay_keys():
    _, error = _golay()
    assert len(set(error.tolist())) == 2048
    x = np.random.default_rng(1).integers(0, 1 << 22, 3000)
    own = [set(k[k >= 0].tolist()) for k in fuzzy_keys(x, 22)]
    for bit in range(22):
        for a, b in zip(own, fuzzy_keys(x ^ (1 << bit), 22), strict=True):
            assert a & set(b.tolist())


@pytest.mark.parametrize("split", [1 << 14, 2])
def test_links_between_clusters(spark, split):
    rng = np.random.default_rng(2)
    base, out = rng.integers(0, 1 << 63, 20), []
    for _ in range(300):
        x = np.uint64(base[rng.integers(20)])
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            x ^= np.uint64(1) << np.uint64(b)
        out.append(x)
    x = np.unique(np.array(out, np.uint64))
    signed = x.view(np.int64).tolist()
    root = {r.node: r.root for r in components(links(spark.createDataFrame([(v,) for v in signed], "fp long"), split=split)).collect()}
    want = linked(list(range(len(x))), x)
    groups = {}
    for i, v in enumerate(signed):
        groups.setdefault(want[i], set()).add(root.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_near_duplicates(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = docs + [(9001, None), (9000, ""), (9002, " "), (9003, "One two"), (9004, "one  TWO"), (9005, "x"), (9006, docs[0][1])]
    got = {r.doc_id: (r.fp, r.component_id) for r in near_duplicates(make(spark, rows)).collect()}
    fps = {d: fingerprint(t) for d, t in rows}
    assert {d: f & (2**64 - 1) for d, (f, _) in got.items()} == fps
    assert {d: c for d, (_, c) in got.items()} == linked(list(fps), list(fps.values()))
    assert got[9001][1] == got[9002][1] == 9000 and got[9004][1] == 9003 and got[9006][1] == min(docs[0][0], got[docs[0][0]][1])
    assert near_duplicates(make(spark, [])).count() == 0
    assert [r.component_id for r in near_duplicates(make(spark, [(None, "a b c"), (None, "a b c")])).collect()] == [None, None]


def test_sha_of_nothing():
    assert sha(b"") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_runs_of_rows(odd, monkeypatch):
    """Workers give the same rows whatever the size of the runs into which they cut a batch."""
    from claimforge.llm import common, repeats, rlz_dedup, simhash_golay, suffix_dedup

    n = len(odd)
    spans = [[(5, 20), (18, 30)] if i % 3 else None for i in range(n)]
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("shift", pa.int32()), ("want", pa.binary())]))
    rows = [s and [{"a": a, "b": b, "shift": None, "want": None} for a, b in s] for s in spans]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in odd], pa.int64()), "row": pa.array(range(len(odd)), pa.int64()), "text": pa.array([t for _, t in odd]), "spans_": pa.array(rows, kind)}).slice(1)
    batch = batch.select(["doc_id", "text", "spans_", "row"])
    workers = [repeats._occurrences("byte", 100, 20), repeats._occurrences("word", 50, 20), rlz_dedup._cut_words, lambda x: suffix_dedup._cut_bytes(b.select(["doc_id", "text", "spans_"]) for b in x), simhash_golay._fingerprints(3, 42)]
    whole = [pa.Table.from_batches(list(w([batch]))).to_pylist() for w in workers]
    monkeypatch.setattr(common.parts, "__defaults__", ("text", 3000))
    assert [pa.Table.from_batches(list(w([batch]))).to_pylist() for w in workers] == whole


def test_buckets_larger_than_the_last_level(spark, monkeypatch):
    """Fingerprints that differ in a few bits only stay together at every level; their last buckets are cut into tiles."""
    rng = random.Random(9)
    spread = [43, 44, 46, 47, 48, 50, 51, 56, 58, 59, 60, 62, 63]  # one segment, no digit 1 in base four
    fps = sorted({sum((x >> i & 1) << b for i, b in enumerate(spread)) for x in rng.sample(range(1 << 13), 300)} | {0, (1 << 64) - 1})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    want, cut = linked(range(len(fps)), fps), []
    monkeypatch.setattr(simhash_golay, "_tiles", lambda *a, plain=simhash_golay._tiles: cut.append(1) or plain(*a))
    for split in (40, 1 << 14):
        found = components(links(df, split=split))
        assert len(cut) == 1
        root = {r.node: r.root for r in found.collect()}
        signed = [x - (1 << 64) if x >> 63 else x for x in fps]
        groups = {}
        for i, x in enumerate(signed):
            groups.setdefault(root.get(x, x), []).append(i)
        assert sorted(map(tuple, groups.values())) == sorted(tuple(sorted(i for i in want if want[i] == r)) for r in set(want.values()))
