"""Transitive closure of IS-A pairs; safe on cycles, whose members become their own ancestors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.operators.tables import stored

PAIR = ["child", "ancestor"]
PLAIN = 3  # rounds of single steps before paths are doubled


def _beyond(known: DataFrame, step: DataFrame, onward: DataFrame) -> DataFrame:
    """A table (child, ancestor, far) of pairs that step and onward (child, ancestor, far) make together and that aren't known; far if some far one does."""
    on = onward.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("next"), "far")
    pairs = step.select(*PAIR).join(on, "ancestor").groupBy("child", F.col("next").alias("ancestor")).agg(F.bool_or("far").alias("far"))
    return stored(pairs.join(known, PAIR, "left_anti"))


def closure(edges: DataFrame) -> DataFrame:
    """All (child, ancestor) pairs of edges (child, parent): a few rounds of single steps, then as many as the logarithm of the longest shortest path.

    Before each round, known holds the pairs at a distance of at most m, and step has those at exactly m among its pairs. Single steps extend step by an edge,
    which is all that shallow hierarchies need. Then one join of step with all that is known gives all distances up to 2 m; the pairs
    that two of step make are the next step. Each round's pairs are written once.
    """
    step = edge = stored(edges.select("child", F.col("parent").alias("ancestor"), F.lit(True).alias("far")).where("child is not null and ancestor is not null").distinct())
    parts = [edge]
    known = lambda: reduce(DataFrame.unionByName, [x.select(*PAIR) for x in parts])
    for _ in range(PLAIN):
        step = _beyond(known(), step, edge)
        if step.isEmpty():
            return known()
        parts.append(step)
    while True:
        near = [x.select(*PAIR, F.lit(False).alias("far")) for x in parts[:-1]]
        more = _beyond(known(), step, reduce(DataFrame.unionByName, near, parts[-1]))
        if more.isEmpty():
            return known()
        parts.append(more)
        step = more.where("far")


def reachable(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """pairs (child, ancestor) with `reached`: equal, or a pair of the closure."""
    hit = closed.select("child", "ancestor", F.lit(True).alias("hit"))
    return pairs.join(hit, ["child", "ancestor"], "left").withColumn("reached", (F.col("child") == F.col("ancestor")) | F.coalesce("hit", F.lit(False))).drop("hit")


def inherited(has_prop: DataFrame, closed: DataFrame) -> DataFrame:
    """(entity, prop): own properties and those of all ancestors."""
    up = closed.join(has_prop.withColumnRenamed("entity", "ancestor"), "ancestor").select(F.col("child").alias("entity"), "prop")
    return has_prop.select("entity", "prop").unionByName(up).distinct()
