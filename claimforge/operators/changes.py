"""A closure that is kept up to date while pairs come and go, without building it again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.operators.closure import PAIR, closure
from claimforge.operators.tables import dropped, stored


@dataclass
class Changed:
    """edges (child, parent) and closed (child, ancestor) after a change, and the closed pairs that it took and gave."""

    edges: DataFrame
    closed: DataFrame
    lost: DataFrame
    gained: DataFrame


def _edges(df: DataFrame) -> DataFrame:
    return df.select("child", "parent").where("child is not null and parent is not null").distinct()


def _through(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """Distinct (child, ancestor) with a path over one of the edges, all else of the path in closed. Only pairs that meet an edge take part."""
    one = edges.select("child", F.col("parent").alias("ancestor"))
    into = closed.join(edges.select(F.col("child").alias("ancestor"), "parent"), "ancestor").select("child", F.col("parent").alias("ancestor")).unionByName(one).distinct()
    beyond = closed.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("top"))
    return into.join(beyond, "ancestor").select("child", F.col("top").alias("ancestor")).unionByName(into).distinct()


def without_pairs(edges: DataFrame, closed: DataFrame, removed: DataFrame) -> Changed:
    """Delete and derive again: pairs with some path over a removed edge are suspect, and those that edges and pairs still there yield come back.

    Each round extends what has come back by one edge below it, so rounds are as many as the longest detour has edges. Edges to remove that aren't
    there change nothing. closed is the closure of edges; cycles are allowed.
    """
    old = _edges(edges)
    gone = stored(old.join(_edges(removed), ["child", "parent"], "left_semi"))
    left = old.join(gone, ["child", "parent"], "left_anti")
    suspects = stored(_through(gone, closed))
    below = suspects.select("child").distinct()
    near = stored(left.join(below, "child", "left_semi").withColumnRenamed("parent", "ancestor"))  # edges of suspects only
    sure = closed.join(near.select(F.col("ancestor").alias("child")).distinct(), "child", "left_semi").join(suspects, PAIR, "left_anti")
    step = lambda pairs: near.join(pairs.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("top")), "ancestor").select("child", F.col("top").alias("ancestor"))
    found = stored(near.unionByName(step(sure)).distinct().join(suspects, PAIR, "left_semi"))
    back, fresh = found, found
    while True:
        fresh = stored(step(fresh).distinct().join(suspects, PAIR, "left_semi").join(back, PAIR, "left_anti"))
        if fresh.isEmpty():
            break
        back = back.unionByName(fresh)
    lost = stored(suspects.join(back, PAIR, "left_anti"))
    out = Changed(left, closed.select(*PAIR).join(lost, PAIR, "left_anti"), lost, lost.limit(0))
    dropped(suspects, near)
    return out


def with_pairs(edges: DataFrame, closed: DataFrame, added: DataFrame) -> Changed:
    """Adds pairs: what a new edge joins is its child with all below, and its parent with all above; several new edges on a path meet at their children.

    How the new edges' children reach each other is a small closure of its own, so rounds follow the logarithm of the new edges on a path. Only pairs that
    meet a new edge are joined. Edges that are there already, and empty or repeated ones, change nothing.
    """
    old = _edges(edges)
    fresh = stored(_edges(added).join(old, ["child", "parent"], "left_anti"))
    once = stored(_through(fresh, closed))
    starts = fresh.select(F.col("child").alias("ancestor")).distinct()
    to_start = once.join(starts, "ancestor", "left_semi").select(*PAIR)
    among = closure(to_start.join(starts.withColumnRenamed("ancestor", "child"), "child", "left_semi").withColumnRenamed("ancestor", "parent"))
    same = starts.select(F.col("ancestor").alias("child"), "ancestor")
    on = among.unionByName(same).distinct()
    link = lambda a, b: a.join(b.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("top")), "ancestor").select("child", F.col("top").alias("ancestor")).distinct()
    more = link(link(to_start, on), once)
    gained = stored(once.unionByName(more).distinct().join(closed, PAIR, "left_anti"))
    return Changed(old.unionByName(fresh), closed.select(*PAIR).unionByName(gained), gained.limit(0), gained)


def changed(edges: DataFrame, closed: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> Changed:
    """Removes pairs, then adds pairs; lost and gained are what the whole change took and gave."""
    a = without_pairs(edges, closed, removed) if removed is not None else Changed(_edges(edges), closed.select(*PAIR), closed.select(*PAIR).limit(0), closed.select(*PAIR).limit(0))
    if added is None:
        return a
    b = with_pairs(a.edges, a.closed, added)
    return Changed(b.edges, b.closed, a.lost.join(b.gained, PAIR, "left_anti"), b.gained.join(a.lost, PAIR, "left_anti"))


def reduced(pairs: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """Few (child, parent) pairs with the same closure: no pair that has a path of two or more beside it.

    Members of a cycle become one ring in the order of their names (one that is only its own parent keeps that pair), and of the pairs between two
    such groups, or single nodes, the least stays if no path leads round it. Without cycles that is the transitive reduction, a part of the pairs.
    """
    edges = _edges(pairs)
    closed = closure(edges) if closed is None else closed.select(*PAIR)
    both = closed.join(closed.select(F.col("ancestor").alias("child"), F.col("child").alias("ancestor")), PAIR, "left_semi")
    group = stored(both.groupBy("child").agg(F.min("ancestor").alias("group")))  # nodes on cycles
    name = lambda df, c: df.join(group.select(F.col("child").alias(c), F.col("group").alias(f"{c}_of")), c, "left").withColumn(f"{c}_of", F.coalesce(f"{c}_of", c))
    across = stored(name(name(edges, "child"), "parent").where("child_of != parent_of").groupBy("child_of", "parent_of").agg(F.min(F.struct("child", "parent")).alias("pair")))
    above = name(name(closed, "child"), "ancestor").where("child_of != ancestor_of").select(F.col("child_of").alias("parent_of"), F.col("ancestor_of").alias("top")).distinct()
    round_ = across.select("child_of", "parent_of").join(above, "parent_of").select("child_of", F.col("top").alias("parent_of")).distinct()
    kept = across.join(round_, ["child_of", "parent_of"], "left_anti").select("pair.*")
    after = group.alias("a").join(both.alias("b"), F.col("a.child") == F.col("b.child")).where(F.col("b.ancestor") > F.col("a.child")).groupBy(F.col("a.child").alias("child")).agg(F.min("b.ancestor").alias("parent"))
    ring = group.join(after, "child", "left").select("child", F.coalesce("parent", "group").alias("parent"))
    return kept.unionByName(ring)
