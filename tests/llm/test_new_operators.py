"""Prefix trie, periodic runs and decontamination against plain versions, with odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from brute import sha
from pyspark.sql import functions as F

from claimforge.llm import decontaminate, oracles, trie
from claimforge.llm.decontaminate import contamination, op13_benchmark_decontamination
from claimforge.llm.periodic import op12_periodic_runs, periodic_runs, runs_of
from claimforge.llm.trie import op11_conversation_trie, ordered, prefix_trie

SF = "/root/testdata/sf0.001"


def against_sql(df, sql, table):
    con = duckdb.connect()
    for name in (table, "benchmark"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    columns = sorted(df.columns)
    norm = lambda rows: sorted(repr([None if x is None or x != x else x if isinstance(x, str) else int(x) for x in r]) for r in rows)
    return norm(df.select(*columns).collect()), norm(con.sql(sql).select(*map(duckdb.ColumnExpression, columns)).fetchall())


@pytest.mark.parametrize(("query", "sql", "table"), [(op11_conversation_trie, oracles.OP11, "conversations"), (op12_periodic_runs, oracles.OP12, "documents"), (op13_benchmark_decontamination, oracles.OP13, "documents")])
def test_sql(spark, query, sql, table):
    mine, theirs = against_sql(query(spark, SF), sql, table)
    assert mine == theirs and mine


# ---------------------------------------------------------------- prefix trie
def plain_trie(convs):
    """convs: id -> list of (role, text)."""
    nodes = {}
    for c, path in convs.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for k in nodes:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] = leaves.get(k[:d], 0) + (k not in kids)
            saved[k[:d]] = saved.get(k[:d], 0) + (len(members) - 1) * (len(k[-1][1]) if k else 0)
    ends = lambda k: ",".join(map(str, sorted(c for c in nodes[k] if len(convs[c]) == len(k))))
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), kids.get(k, 0), leaves[k], saved[k], sha(ends(k).encode())) for k, m in nodes.items())


def nodes_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations(spark, rows):
    """Shuffled rows with extra columns whose names the operator uses itself."""
    rows = list(rows)
    random.Random(3).shuffle(rows)
    return spark.createDataFrame([(c, t, r, x, 9, 9, "z", 9, 9, 9) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, depth int, p int, q string, pos int, part int, upto int")


@pytest.mark.parametrize("block", [1024, 2])
def test_trie(spark, monkeypatch, block):
    """Shared openings, equal and empty conversations, nulls, ties of turn, a long one; blocks of any size give the same."""
    monkeypatch.setattr(trie, "BLOCK", block)
    rng = random.Random(2)
    rows = []
    for c in range(60):
        n = rng.choice([1, 2, 3, 5])
        rows += [(3 * c, t, rng.choice(["user", "bot"]) if t else "user", rng.choice(["a", "bé", "", "long one"])) for t in range(n)]
    rows += [(501 + i, t, "user", "same") for i in range(30) for t in range(4)] + [(601, 5 * t, "u", f"x{t % 7}") for t in range(300)] + [(602, 5 * t, "u", f"x{t % 7}") for t in range(150)]
    rows += [(700, None, None, "first"), (700, 1, "u", None), (700, 1, "u", "tie"), (700, 1, "u", "tie"), (None, 1, "u", "lost"), (-5, 0, "user", "a")]
    convs = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    convs |= {800: [], 801: []}
    turnless = spark.createDataFrame([(800,), (801,), (601,), (None,)], "conv_id long")
    assert nodes_of(prefix_trie(ordered(conversations(spark, rows)), turnless)) == plain_trie(convs)


def test_trie_query_on_odd_rows(spark, tmp_path):
    """Rebuilding from the conversation of the hundred, which may be short or absent."""
    rng = random.Random(4)
    rows = [(c, t, "u", rng.choice("ab")) for c in [*range(95, 130), *range(200, 230), 300, 301, 302] for t in range(rng.randint(1, 8))] + [(400, 0, "u", "only")] + [(c, t, "u", "q") for c in range(401, 440) for t in range(3)]
    conversations(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    turns = {}
    for c, _, r, x in sorted(rows):
        turns.setdefault(c, []).append((r, x))
    rebuilt = {c: turns.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + own[h:] for c, own in turns.items()}
    assert nodes_of(op11_conversation_trie(spark, str(tmp_path))) == plain_trie(rebuilt)
    assert [] in rebuilt.values()


def test_empty_trie(spark):
    assert prefix_trie(ordered(conversations(spark, [])), spark.createDataFrame([], "conv_id long")).count() == 0


def test_trie_keeps_hot_prefixes_out_of_one_task(spark):
    """Before the exchange of a prefix's window each task keeps one row of the prefix."""
    marked = trie.owned_nodes(spark.range(10).selectExpr("id as conv_id", "id % 2 as depth", "id % 3 as p", "id % 5 as q"))
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


# ---------------------------------------------------------------- periodic runs
def plain_runs(w, shortest=6):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(shortest, 4 * q) and not any(all(w[t] == w[t + p] for t in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1 if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        v = rng.choice([1, 2, 2, 3, 5, 50])
        w = [rng.randrange(v) for _ in range(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 4)):
            p, a = rng.randint(1, 60), rng.randint(0, len(w))
            piece = [rng.randrange(v) for _ in range(p)]
            if rng.random() < 0.5:
                piece = piece[: rng.randint(1, 5)] * rng.randint(1, 9)
            w[a:a] = (piece * rng.randint(2, 8))[: rng.randint(1, 400)]
        assert runs_of(np.array(w, np.int64)) == plain_runs(w)


def test_runs_of_long_texts():
    """Work does not grow with the square of the words: a million words, alone, all alike, and with long periods."""
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 3000, 1_000_000)
    assert runs_of(noise) == []
    assert runs_of(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]
    tail = np.tile(rng.integers(5000, 9000, 70_001), 5)
    assert runs_of(np.r_[noise[:500_000], tail, noise[:1000]]) == [(500_000, 350_005, 70_001)]


def test_periodic_runs(spark):
    texts = ["", None, " \n", "a a a a a", "a a a a a a", "x y x y x y x y z z z z z z z", "é é\tb " * 9, "a b c " * 40 + "q " + "a b c " * 5, "w" * 100_000 + " " + "k l " * 5000]
    rows = [(i, t, 1, "k") for i, t in enumerate(texts)] + [(None, "n n n n n n n", 1, "k"), (4, texts[4], 1, "k"), (4, "other", 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string")
    want = []
    for d, t, *_ in rows:
        w = (t or "").encode().split()
        runs = plain_runs(w) if len(w) < 5000 else [(1, 10_000, 2)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((d, len(w), [(s, n, q) for s, n, q in runs], b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    found = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, want))
    assert periodic_runs(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- decontamination
def plain_hits(docs, items, window=10):
    tokens = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    windows = {}
    for i, t in items:
        w = tokens(t)
        for j in range(len(w) - min(window, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + window]), set()).add(None if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, ids = tokens(t), set(), set()
        for m in {len(x) for x in windows}:
            for j in range(len(w) - m + 1):
                if (k := tuple(w[j : j + m])) in windows:
                    hit |= set(range(j, j + m))
                    ids |= windows[k]
        out.append((d, len(w), len(hit), sorted(ids - {None})))
    return sorted(out, key=repr)


def found_hits(df):
    n = F.aggregate("spans", F.lit(0), lambda a, s: a + s["b"] - s["a"])
    return sorted(((r.doc_id, r.n_words, r.n, r.items) for r in df.select("doc_id", "n_words", n.alias("n"), "items").collect()), key=repr)


@pytest.mark.parametrize("bits", [24, 8])
def test_contamination(spark, monkeypatch, bits):
    """Short and long items, hot words, clashing columns, nulls, ties and repeats; with a tiny bit map almost every shingle comes through."""
    monkeypatch.setattr(decontaminate, "BITS", bits)
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "of", "É", "中文", "x1"] + [f"w{i}" for i in range(30)])
    text = lambda n: "".join(word() + rng.choice([" ", "\n", ", ", "-", "\u0000"]) for _ in range(n))
    long = [text(rng.randint(10, 40)) for _ in range(12)]
    items = [(i, t) for i, t in enumerate(long)] + [(50, "The of."), (51, "zebra"), (52, "x1 É w3 w4"), (53, None), (54, " ,. "), (None, long[0] + " tail"), (3, long[4]), (55, long[5]), (55, long[5]), (56, "w1 " * 30)]
    docs = [(100 + i, text(rng.randint(0, 60)) + rng.choice(long).upper() + text(rng.randint(0, 30))) for i in range(40)]
    docs += [(200, None), (201, ""), (202, "ZEBRA"), (202, "no"), (202, "no"), (None, long[2]), (203, "w1 " * 500), (204, text(4000) + long[1]), (205, "the " * 2000), (206, long[3][: len(long[3]) // 2])]
    d = spark.createDataFrame([(*r, 1, "k", 2) for r in docs], "doc_id long, text string, n int, run string, item_id int")
    i = spark.createDataFrame([(*r, 1, "k", 2) for r in items], "item_id long, text string, window int, item string, doc_id int")
    assert found_hits(contamination(d, i)) == plain_hits(docs, items)
    only = [r for r in items if r[0] == 51]
    assert found_hits(contamination(d, i.where("item_id = 51"))) == plain_hits(docs, only)


def test_contamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words here")], "item_id long, text string")
    assert found_hits(contamination(docs, items.limit(0))) == [(1, 3, 0, [])]
    assert found_hits(contamination(docs.limit(0), items)) == []
    assert found_hits(contamination(docs, items)) == [(1, 3, 3, ["1"])]


def test_repeated_tails_follow_the_contract(spark, tmp_path):
    """The query's changed texts, against the same in Python."""
    spark.createDataFrame([(d, f"a{d} b c d e f g h i j k l m n o p") for d in range(300)] + [(None, "x y"), (17, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op12_periodic_runs(spark, str(tmp_path)).collect() if r.doc_id != 17}
    changed = 0
    for d in range(300):
        if d == 17:
            continue
        w, h = f"a{d} b c d e f g h i j k l m n o p".split(), zlib.crc32(str(d).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w, changed = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))], changed + 1
        runs = plain_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert got[d].n_runs == len(runs) and got[d].runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert got[d].collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        assert (got[d].start, got[d].length, got[d].period, got[d].exponent_milli) == ((best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4)
    assert changed > 10 and got[None].n_runs == 0
