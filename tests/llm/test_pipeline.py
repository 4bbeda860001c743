"""The whole pipeline against brute force, stage by stage, on the small documents table with odd rows."""

import math
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import xxhash
from brute import sha, similar_firsts
from pyspark.sql import functions as F

import corpus_pipeline as P
from claimforge.llm import mixing as M
from claimforge.llm import quality as Q
from claimforge.llm.common import utf8
from claimforge.llm.prefix_bpe import read_ranks

SF = "/root/testdata/sf0.001"


def collect(df):
    return sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def cut_bytes(rows, window=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if b[i : i + window] in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(b[i : i + window])
        out[d] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def key(doc_id, weight, seed=42):
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), xxhash.xxh64_intdigest(str(doc_id).encode(), 42))
    return -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90001, None, None, None, None), (90002, "", "en", "src0", 0), (90003, " ", "en", None, 1), (90004, "one two three", "en", None, 13)], docs.schema)
    docs = docs.unionByName(extra)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = [f for _, f in P.STAGES]

    kept = stages[0](spark, docs, SF).cache()
    model = Q.train(Q.grades_of(labels), docs)
    rows = docs.collect()
    tail = model.score(*utf8(pa.array([r.text for r in rows], pa.large_string())))[1][:, -1]
    assert collect(kept) == sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r, p in zip(rows, tail, strict=True) if p >= 0.5)

    one = stages[1](spark, kept, SF).cache()
    before = kept.collect()
    assert {r.doc_id for r in one.collect()} == similar_firsts([(r.doc_id, r.text) for r in before])

    short = stages[2](spark, one, SF).cache()
    want = cut_bytes([(r.doc_id, r.text) for r in one.collect()])
    assert {r.doc_id: (r.text, r.n_chars) for r in short.collect()} == {d: (t, len(t)) for d, t in want.items() if t}

    mixed = stages[3](spark, short, SF).cache()
    weight = {r.doc_id: {1: 2.0, 0: 0.5}[r.quality] for r in labels.collect()}
    by = {}
    for r in short.collect():
        by.setdefault(r.source, []).append((key(r.doc_id, weight.get(r.doc_id, 1.0)), r.doc_id, len(r.text.encode().split())))
    size = {s: sum(n for *_, n in x) for s, x in by.items()}
    copies = {}
    for s, goal in M.targets(size).items():
        epochs = min(3, int(goal // size[s])) if size[s] else 0
        rest, so_far = goal - epochs * size[s], 0
        for _, d, n in sorted(by[s]):
            so_far += n
            copies[d] = epochs + (so_far - n / 2 <= rest)
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    words = {d: n for x in by.values() for _, d, n in x}
    assert all(got.get(d, 0) == c for d, c in copies.items() if words[d])

    out = stages[4](spark, mixed, SF).collect()
    with open(public_tokenizers.path(P.TOKENIZER), "rb") as f:
        ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(f.read()), special_tokens={})
    text = {r.doc_id: r.text for r in mixed.collect()}
    for r in out:
        ids = ref.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text[r.doc_id].encode()))
    assert len(out) == mixed.count()


def test_run(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.where(F.col("n_tokens") > 0).count() > 50
    assert P.ORACLE_SQL is None


def test_files_are_read_in_small_parts(spark):
    """Compressed tables between stages come in parts of 24 MB at most, so that stages have many tasks for each core; smaller parts that were asked for stay."""
    from claimforge.llm.common import SPLIT, tune

    before = spark.conf.get(SPLIT)
    try:
        for given, want in (("128MB", str(24 << 20)), ("1m", "1m")):
            spark.conf.set(SPLIT, given)
            tune(spark)
            assert spark.conf.get(SPLIT) == want
    finally:
        spark.conf.set(SPLIT, before)
