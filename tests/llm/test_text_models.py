"""URL filter, HTML extraction, mixing, tokenizer, classifier and the pipeline."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import substrings
from pyspark.sql import functions as F

import corpus_pipeline
from claimforge.llm import grams
from claimforge.llm import html_extract as H
from claimforge.llm import mixing as M
from claimforge.llm import prefix_bpe as B
from claimforge.llm import quality as Q
from claimforge.llm import url_filter as U
from claimforge.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14)) and set(oracle_sql()) <= set(queries())


def test_urls(spark):
    urls = [
        ("http://A.Example.ORG/en/12?x#y", "a.example.org", "/en/12", "example.org/en/1", "block"), ("http://example.org/es/", "example.org", "/es/", "example.org/es/", "block"), ("http://example.org/es", "example.org", "/es", "org/", "allow"),
        ("https://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"), ("x://com/de/", "com", "/de/", "com/de/", "block"), ("http://notexample.org", "notexample.org", "", None, None), ("http://É.org/", "É.org".replace("É", "É"), "/", "org/", "allow"),
        ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None), ("http://evilcom/de/", "evilcom", "/de/", None, None), ("http://h?q/org/", "h", "", None, None),
    ]
    df = spark.createDataFrame([(i, u[0], "x", 1.0) for i, u in enumerate(urls)], "page_id long, url string, host string, score double")
    got = {r.page_id: r for r in U.url_filter(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert U.url_filter(df.limit(0)).count() == 0


def plain_features(url):
    """The n-grams of host and path by a plain loop."""
    host, path = U.UrlModel.parts(url)
    return [t[i : i + n].encode() for t in (f"^{host}$", f"|{path}$") for n in (4, 5, 6) for i in range(len(t) - n + 1)]


def test_url_scores_are_those_of_plain_n_grams():
    model = U.UrlModel(U.labelled_urls())
    urls = [u for u, _ in U.labelled_urls()[::40]] + ["http://EXAMPLE.com/Ä?x", "no url", "https://" + "long" * 500 + "/p" * 3000]
    for url in urls:
        found = plain_features(url)
        buckets = [int(grams.mix(grams.Ranges(grams.BYTE[np.frombuffer(g, np.uint8)]).grams(len(g)) + np.uint64(len(g)))[0] >> np.uint64(64 - model.bits)) for g in map(bytes, (x for x in found)) if len(g)]
        want = model.bias + sum(model.weights[b] for b in buckets) / max(1, len(buckets)) ** 0.5
        host, path = model.parts(url)
        assert abs(model.score([host], [path])[0] - want) < 1e-9 or not url.isascii()


def test_url_model_on_held_out_hosts():
    """Hosts of the test are not in the labelled table, nor are their words in these forms."""
    known = {U.UrlModel.parts(u)[0] for u, _ in U.labelled_urls()}
    bad = ["m.casino-win.example.com", "free-bets.example.com", "www.cheap-pills.example.com", "blog.adult-x.example.net", "casino-night.example.io", "best-viagra-shop.example.biz"]
    good = ["www.citylibrary.example.edu", "museum-of-art.example.de", "blog.tionsh.example.com", "the-garden-book.example.fr", "tionble.example.org", "weather-report.example.io"]
    assert not known & set(bad + good)
    model = U.UrlModel(U.labelled_urls())
    score = dict(zip(bad + good, model.score(bad + good, ["/de/217"] * 12), strict=True))
    assert all(score[h] > 0 for h in bad) and all(score[h] < 0 for h in good), score


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><nav><a href=/>menu</a></nav><!-- <p>no</p> -->
<div class="ad">buy</div><article class="post-12"><h1>A &amp; B</h1><p>one <b>two
 three<br>four&nbsp;five<p>six <a href="x">link</a> {i}</p><form>name</form><div class="comments"><p>reader says</p></div><ul><li>i1<li>i2</ul></article>
<aside>side</aside><div id="cookie-notice">cookies</div><footer>&copy; end</footer></body></html>"""


def test_extraction(spark):
    want = "A & B\none two three four five\nsix link 1\ni1\ni2"
    rows = [(1, "http://h/1", PAGE.replace("{i}", "1")), (2, None, None), (3, "http://h/2", ""), (4, "http://h/3", "plain < text &lt;"), (5, "http://h/4", "<p>only"), (6, "http://g/", "<div><p>un<p>closed <b>bold" + "</p>" * 50), (7, "http://h/5", "<a href='" + "x" * 5000), (1, "http://h/1", PAGE.replace("{i}", "1"))]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, path string")
    got = [(r.page_id, r.text) for r in H.extract(df).collect()]
    assert sorted(got)[:2] == [(1, want)] * 2
    rest = dict(got)
    assert (rest[2], rest[3], rest[4], rest[5], rest[6]) == ("", "", "plain < text <", "only", "un\nclosed bold")
    assert H.extract(df.limit(0)).count() == 0


def test_consensus_wins(spark):
    good = "<body><div class='main7'><p>{}</p></div><div class=extra><p>{}</p></div></body>"
    rows = [(i, "http://h/", good.format("long text here " * 9, "short")) for i in range(5)] + [(9, "http://h/", good.format("few", "more words in the wrong place " * 9))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in H.extract(df).collect()}[9] == "few"
    assert H.consensus(df).first().winner == "body/div.main"


def test_targets():
    t = M.targets({"b": 100, "a": 10, None: 50, "c": 0})
    assert t["a"] == 30 and t["c"] == 0 and abs(sum(t.values()) - 160) < 1e-9
    assert M.targets({}) == {} and M.targets({"x": 0}) == {"x": 0.0} and M.targets({"x": 7}) == {"x": 7.0}


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(0, 40)), rng.choice(["s1", "s2", "s2", "s2", None]), rng.random(), 1) for i in range(600)] + [(700, None, "s3", None, 1), (701, "", None, 0.0, 1), (702, "a b", "only", -1.0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, w double, target int")
    for weight in (None, df.select("doc_id", F.col("w").alias("weight"))):
        out = M.mix(df, quality=weight).collect()
        assert len(out) == len(rows) and sorted(map(tuple, M.mix(df, quality=weight).collect())) == sorted(map(tuple, out))
        source = {r[0]: r[2] for r in rows}
        size = {}
        for r in rows:
            size[r[2]] = size.get(r[2], 0) + len((r[1] or "").split())
        goal = M.targets(size)
        for s in size:
            mine = [r for r in out if source[r.doc_id] == s]
            assert all(r.source_size == size[s] and r.target == goal[s] and r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in mine)
            assert abs(sum(r.taken for r in mine) - goal[s]) <= max(r.size for r in mine) / 2
        again = {r.doc_id: r["count"] for r in M.repeats(df, quality=weight).groupBy("doc_id").count().collect()}
        assert all(again.get(r.doc_id, 0) * r.size == r.taken for r in out)
    assert M.mix(df.limit(0)).count() == 0 and M.repeats(df.limit(0)).count() == 0
    assert M.repeats(df).columns == df.columns


def test_mixing_repeated_rows(spark):
    """Many equal rows, rows that share an id, and null ids: as many are taken as fit, by both forms."""
    rows = [(7, "a b c", "x", "p")] * 300 + [(None, f"n{i} " * 3, "x", "q") for i in range(300)] + [(8, f"m{i} " * 3, "y", "r") for i in range(300)] + [(9, "d e", "z", str(i % 3)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size_ string")
    for kind in (df, df.where("source = 'x' and doc_id = 7 or source = 'z'")):
        out = M.mix(kind, weights=(1.0, 2.0, 3.5)).collect()
        assert len(out) == kind.count()
        taken = {}
        for r in out:
            taken.setdefault((r.source_size, r.target), []).append(r.taken)
        assert all(abs(sum(t) - goal) <= 1.5 for (_, goal), t in taken.items())
        got = M.repeats(kind, weights=(1.0, 2.0, 3.5))
        assert got.columns == kind.columns
        count = lambda pairs: sorted(pairs, key=str)
        by_source = {r.source: r.n for r in got.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
        assert count(by_source.values()) == count(sum(t) for t in taken.values() if sum(t))


def test_weights_pull(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 2000, "x").otherwise("y").alias("source"), F.when(F.col("id") % 2 == 0, 8.0).otherwise(1.0).alias("q"))
    more = M.mix(df, weights=(1.0, 9.0), quality=df.select("doc_id", F.col("q").alias("weight"))).where("doc_id < 2000 and taken > 0")
    assert more.where("doc_id % 2 = 0").count() > 2 * more.where("doc_id % 2 = 1").count()


@pytest.fixture(scope="module")
def bpe():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        data = f.read()
    ranks = B.read_ranks(data)
    return data, B.PrefixBPE(ranks, memory=50), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = ["a", "b", "th", "ing", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u200b", "é", "ß", "中", "½", "1", "...", "'s", "😀", "\x00", "\ufeff", "ि", "tion", "zzzz", "<|endoftext|>"]


def test_bpe(spark, bpe):
    data, own, ref = bpe
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["", None, "a" * 3000, " " * 500, "x" * 70 + "é" * 200]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    for r in B.bpe_round_trip(df, data, public_tokenizers.PATTERN).collect():
        t = texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == ref.encode_ordinary(t) and bytes(r.decoded) == t.encode()
    assert B.bpe_round_trip(df.limit(0), data, public_tokenizers.PATTERN).count() == 0
    # each prefix's last token is that of the prefix's own encoding
    piece = b"internationalisation"
    last = own.extend(piece, [-1])
    for i in range(1, len(piece) + 1):
        parts = own.extend(piece[:i], [-1])
        assert parts == last[: i + 1]
    assert own.extend(piece, last[:8]) == last


def test_bpe_edits(bpe):
    _, own, ref = bpe
    rng, text = random.Random(2), B.EditableText(bpe[1], public_tokenizers.PATTERN, "The thing is, it was  there's 12 thonin.")
    for _ in range(300):
        i = rng.randint(0, len(text.text))
        text.edit(i, min(len(text.text), i + rng.randint(0, 6)), "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 4))))
        text.append(rng.choice(ALPHABET))
        assert text.ids() == ref.encode_ordinary(text.text)
    long = B.EditableText(bpe[1], public_tokenizers.PATTERN, "internationalis" * 50)
    before = long.fresh
    long.append("ation")
    assert long.fresh - before == 5 and long.ids() == ref.encode_ordinary(long.text)
    long.edit(0, 0, "A word. ")
    assert long.ids() == ref.encode_ordinary(long.text)


def test_classifier_held_out(spark):
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(300)]

    def doc(grade):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 90))]
        if grade == 0:
            words[3:3] = rng.sample(["awful", "vile", "nasty", "rotten"], 2)
        return "!! ".join(w.upper() for w in words) if grade == 1 else " ".join(words)

    grades = [rng.choice([0, 1, 2, 2, 2]) for _ in range(1600)]
    docs = spark.createDataFrame([(i, doc(g), "x") for i, g in enumerate(grades)] + [(5000, None, "x"), (5001, "", "x"), (None, "w1 w2", "x")], "doc_id long, text string, keep string").cache()
    rated = spark.createDataFrame([(i, g) for i, g in enumerate(grades) if i < 1000] + [(3, None), (9999, 2)], "doc_id long, grade int")
    model = Q.train(rated, docs)
    assert (np.diff(model.thresholds) > 0).all()
    out = {r.doc_id: r for r in Q.classify(docs, model).collect()}
    assert len(out) == 1603
    right = sum(out[i].keep == (grades[i] == 2) for i in range(1000, 1600))
    assert right >= 590
    mean = [np.mean([out[i].expected_grade for i in range(1000, 1600) if grades[i] == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert Q.classify(docs.limit(0), model).count() == 0
    assert Q.classify(docs, Q.train(rated.limit(0), docs)).where("keep").count() == 1603  # nothing to learn from: all stay
    assert Q.classify_rows(docs, model).columns == ["doc_id", "text", "expected_grade", "tail", "keep"]


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90001, None, None, None, None), (90002, "", "en", "src0", 0), (90003, " ", "en", None, 1)], docs.schema)
    docs = docs.unionByName(extra).withColumn("row_", F.lit(1))
    before = None
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        if name == "simhash_near_dedup":
            before = [(r.doc_id, r.text) for r in out.collect()]
        if name == "suffix_array_dedup":
            brute = substrings(before)
            left = {r.doc_id: len(r.text.encode()) for r in out.collect()}
            for d, (n, removed, spans, _) in brute.items():
                assert n - removed - 6 * spans <= left.get(d, 0) <= n - removed  # a cut may go through a character at either end
        assert out.count() > 0
        docs = out
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    kept = corpus_pipeline.quality_classifier(spark, docs, "/root/testdata/sf0.1").select("doc_id").withColumn("kept", F.lit(True))
    r = labels.join(kept, "doc_id", "left").groupBy((F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t")).agg(F.avg(F.coalesce("kept", F.lit(False)).cast("double")).alias("share")).collect()
    share = {(x.q, x.t): x.share for x in r}
    assert share[True, False] > 0.99 and share[False, False] < 0.05 and share[True, True] < 0.05
