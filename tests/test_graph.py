"""Closures under change, reductions and labels against plain sets, on random graphs with cycles."""

import random

import pytest
from pyspark.sql import functions as F

from claimforge.operators.changes import changed, reduced
from claimforge.operators.closure import closure, reachable
from claimforge.operators.labels import labelled, reachable_by
from claimforge.sources.kb import builtin


def closed_set(edges):
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    return want


def graph(seed, nodes=14, n=18):
    rng = random.Random(seed)
    one = lambda: f"n{rng.randrange(nodes)}"
    return {(one(), one()) for _ in range(n)}


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges), "child string, parent string")


def pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", range(2))
def test_changes_equal_a_rebuild(spark, seed):
    edges, rng = graph(seed), random.Random(seed + 50)
    gone = set(rng.sample(sorted(edges), 5)) | {("none", "n1")}
    new = graph(seed + 9, n=6) | {("x", "n1"), ("n2", "x"), ("y", "x")}
    before, after = closed_set(edges), closed_set((edges - gone) | new)
    out = changed(frame(spark, edges), closure(frame(spark, edges)), frame(spark, new), frame(spark, gone))
    assert pairs(out.edges) == (edges - gone) | new
    assert pairs(out.closed) == after
    assert (pairs(out.lost), pairs(out.gained)) == (before - after, after - before)


def test_changes_of_one_kind_and_of_none(spark):
    edges = {("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "d")}
    closed = closure(frame(spark, edges))
    only = changed(frame(spark, edges), closed, removed=frame(spark, {("b", "c")}))
    assert pairs(only.closed) == closed_set(edges - {("b", "c")}) and not pairs(only.gained)
    none = changed(frame(spark, edges), closed, frame(spark, {("a", "b")}), frame(spark, {("q", "b")}))
    assert pairs(none.closed) == closed_set(edges) and not pairs(none.lost) and not pairs(none.gained)
    assert pairs(changed(frame(spark, edges), closed).closed) == closed_set(edges)
    everything = changed(frame(spark, edges), closed, removed=frame(spark, edges))
    assert not pairs(everything.closed) and pairs(everything.lost) == closed_set(edges)


def test_changes_touch_what_they_affect(spark):
    """Of a thousand separate chains, a change of one joins and writes pairs of this chain only."""
    chains = spark.range(1000).select(F.concat(F.lit("a"), "id").alias("child"), F.concat(F.lit("b"), "id").alias("parent"))
    edges = chains.unionByName(chains.select(F.col("parent").alias("child"), F.regexp_replace("parent", "b", "c").alias("parent")))
    out = changed(edges, closure(edges), frame(spark, {("c7", "top")}), frame(spark, {("a7", "b7")}))
    assert pairs(out.lost) == {("a7", "b7"), ("a7", "c7")}
    assert pairs(out.gained) == {("c7", "top"), ("b7", "top")}
    assert out.closed.count() == 3000


@pytest.mark.parametrize("seed", range(3))
def test_reduction(spark, seed):
    """The same closure from fewer pairs; of graphs without cycles, a part of them and none to spare."""
    edges = graph(seed, n=24)
    kept = pairs(reduced(frame(spark, edges)))
    assert closed_set(kept) == closed_set(edges)
    straight = {(a, b) for a, b in edges if a < b}
    kept = pairs(reduced(frame(spark, closed_set(straight))))
    assert kept == {(a, b) for a, b in closed_set(straight) if not any((a, c) in closed_set(straight) and (c, b) in closed_set(straight) for _, c in straight)}


def test_reduction_of_the_built_in_classes(spark):
    """116 of 301 pairs, whose closure a recursive query builds again."""
    isa = builtin(spark).isa
    few = reduced(isa)
    assert few.count() == 116 and few.join(isa, ["child", "parent"], "left_anti").isEmpty()
    few.createOrReplaceTempView("few_pairs")
    again = spark.sql("WITH RECURSIVE up AS (SELECT child, parent FROM few_pairs UNION ALL SELECT up.child, f.parent FROM up JOIN few_pairs f ON up.parent = f.child) SELECT DISTINCT child, parent FROM up")
    assert pairs(again) == pairs(isa.select("child", "parent"))


def test_reduction_of_rings(spark):
    edges = {("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "d"), ("a", "d"), ("d", "e"), ("a", "e"), ("z", "z"), ("z", "a")}
    kept = pairs(reduced(frame(spark, edges)))
    assert kept == {("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "e"), ("z", "z"), ("z", "a")}


@pytest.mark.parametrize("seed", range(3))
def test_labels(spark, seed):
    edges = graph(seed, n=20)
    names = sorted({x for e in edges for x in e} | {"other"})
    asked = spark.createDataFrame([(a, b, 1) for a in names for b in names] + [("n1", "n1", 2)], "child string, ancestor string, hub int")
    want = {(a, b, a == b or (a, b) in closed_set(edges)) for a in names for b in names}
    found = reachable_by(asked, labelled(frame(spark, edges)))
    assert {(r.child, r.ancestor, r.reached) for r in found.collect()} == want and found.count() == asked.count()


def test_labels_of_cliques_and_stars(spark):
    clique = {(f"c{i}", f"c{j}") for i in range(12) for j in range(12) if i != j}
    star = {(f"leaf{i}", "c3") for i in range(200)} | {("c5", "top")}
    labels = labelled(frame(spark, clique | star))
    asked = spark.createDataFrame([("leaf7", "top"), ("top", "leaf7"), ("leaf1", "leaf2"), ("c0", "c11"), ("c0", "top")], "child string, ancestor string")
    assert [r.reached for r in reachable_by(asked, labels).collect()] and {(r.child, r.ancestor) for r in reachable_by(asked, labels).where("reached").collect()} == {("leaf7", "top"), ("c0", "c11"), ("c0", "top")}
    assert labels.size() < 213 * 12
    assert reachable_by(asked, labelled(frame(spark, []))).where("reached").isEmpty()


def test_labels_come_from_the_last_round_back(spark):
    """Links of three rounds, both ways and with two ways round: each label once, and as many tables as there are rounds."""
    from claimforge.operators import labels

    rounds = [{("a", "b", True), ("a", "c", True), ("z", "a2", False)}, {("b", "d", True), ("c", "d", True), ("a2", "d", False)}, {("d", "top", True)}]
    frames = [spark.createDataFrame(sorted(r), "node string, hub string, up boolean") for r in rounds]
    want = {(a, b, up) for up in (True, False) for a, b in closed_set({(x, y) for r in rounds for x, y, u in r if u == up})}
    assert pairs(labels.labels_of(frames)) == want and labels.labels_of([]) is None
    assert not hasattr(labels, "closure")


def test_labels_of_a_chain(spark):
    """A chain of 1,000 pairs has half a million pairs in its closure; its labels hold some tens for each node."""
    n = 1000
    labels = labelled(spark.range(n).selectExpr("cast(id as string) as child", "cast(id + 1 as string) as parent"))
    asked = spark.range(n).selectExpr("cast(id as string) as child", "cast((id * 7919) % 1001 as string) as ancestor")
    wrong = reachable_by(asked, labels).where("reached != (cast(child as int) <= cast(ancestor as int))")
    assert wrong.isEmpty()
    assert labels.size() < 40 * n
    assert reachable(asked.limit(5), closure(spark.createDataFrame([("0", "1")], "child string, parent string"))).count() == 5


def test_substring_index(spark):
    """All pairs of texts and keys, with keys of one and two letters, of other scripts, empty and null ones."""
    from claimforge.operators.generate import containing, gram_index

    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdé中X ") for _ in range(rng.randint(0, 40))) for _ in range(120)] + [None, "", "abc", "ABC"]
    keys = ["".join(rng.choice("abcdé中 ") for _ in range(rng.randint(1, 6))) for _ in range(80)] + ["", None, "a", "bc", "abc", "abc"]
    want = {(t, k) for t in texts for k in keys if t is not None and k and k in t.lower()}
    t, k = spark.createDataFrame([(x, 1) for x in texts], "text string, id int"), spark.createDataFrame([(x, 2) for x in keys], "key string, id int")
    assert pairs(containing(t, k)) == want
    index = gram_index(k).collect()
    assert len(index) == len({x for x in keys if x}) and all(r.gram in r.key and len(r.gram) == min(3, len(r.key)) for r in index)
    assert containing(t, k.limit(0)).isEmpty() and containing(t.limit(0), k).isEmpty()


def test_pieces_follow_the_text_not_the_keys(spark):
    """A text of n letters gives at most n pieces, whatever keys there are."""
    from claimforge.operators.generate import gram_index, text_pieces

    texts = spark.createDataFrame([(str(j), "".join(chr(97 + (i * i + j) % 26) for i in range(500))) for j in range(3)], "id string, text string")
    keys = spark.createDataFrame([("q" * n,) for n in range(3, 103)], "key string")
    sizes = [r.n for r in gram_index(keys).select(F.length("gram").alias("n")).distinct().collect()]
    assert sizes == [3] and max(r["count"] for r in text_pieces(texts, sizes).groupBy("id").count().collect()) <= 500


def test_stretches_follow_the_text_not_keys_of_a_piece(spark):
    """Of 1,024 keys with eight pieces between them, a text meets as many stretches as it has, not as many as there are keys."""
    from claimforge.operators.generate import containing, gram_index, stretches

    rng = random.Random(3)
    keys = spark.range(1024).select(F.translate(F.lpad(F.bin("id"), 10, "0"), "01", "ab").alias("key"))
    texts = ["".join(rng.choice("ab") for _ in range(60)) for _ in range(20)]
    whole = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, id int")
    met = stretches(whole, gram_index(keys))
    assert met.count() <= 20 * 51
    assert pairs(containing(whole, keys)) == {(t, t[i : i + 10]) for t in texts for i in range(51)}


def test_first_spelling(spark):
    from claimforge.operators.validate import rule_verdicts, validate
    from claimforge.plans.golden import questions

    rule = spark.createDataFrame([("it is wet", "slip"), ("wet", "cold"), ("dry", "dust")], "condition string, consequence string")
    asked = spark.createDataFrame([("it is wet", "cold"), ("it is wet", "slip"), ("wet", "cold"), ("wet", "slip"), ("it is dry", "dust"), ("x", "y")], "lhs string, rhs string")
    of = lambda first: {(r.lhs, r.rhs): r.fired for r in rule_verdicts(asked, rule, first=first).collect()}
    any_, one = of(False), of(True)
    assert any_ == {("it is wet", "cold"): True, ("it is wet", "slip"): True, ("wet", "cold"): True, ("wet", "slip"): False, ("it is dry", "dust"): True}
    assert one == any_ | {("it is wet", "cold"): False}
    kb, q = builtin(spark), spark.createDataFrame(questions(), "idx int, question string, ground_truth boolean, type string, source string")
    verdict = lambda first: {r.idx: (r.covered, r.graph_answer, r.proof) for r in validate(q, kb, first=first).collect()}
    assert verdict(True) == verdict(False)  # spellings that meet the built-in rules together carry equal lists
