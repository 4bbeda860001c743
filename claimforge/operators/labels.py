"""Reachability without a closure: two-hop labels from taking nodes out of the graph one independent set after the other.

A node that is taken out leaves its pairs behind as its links to nodes that stay longer, and its children are joined to its parents, so what is
left reaches what it did. Of two neighbours the one with fewer such joins goes first, ties by hash, so leaves and links of chains go by thirds at least and
the rounds follow the logarithm of a chain's length. A node with a neighbour that it is on a two-cycle with is merged into it instead, its pairs
move there, so cycles shrink without filling up. What a node reaches by links upwards, and what reaches it by links downwards, are its
labels; x reaches y if some hub is in both. Links lead to nodes that were taken out later, so labels are made from the last round back to the first:
a node has its links and the labels of what they lead to. Each label is made once for each link that brings it, and what a round reads shrinks with the graph.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.operators.tables import dropped, stored


@dataclass
class Labels:
    """up (node, hub): hubs that a node reaches; down (node, hub): hubs that reach it. Every node is a hub of its own."""

    up: DataFrame
    down: DataFrame

    def size(self) -> int:
        return self.up.count() + self.down.count()


def _taken(left: DataFrame, number: int) -> DataFrame:
    """Nodes of which none neighbours another: those before all their neighbours in the order of joins needed, then of a hash."""
    side = lambda c, up: left.select(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    degree = side("child", 1).unionByName(side("parent", 0)).groupBy("node").agg((F.sum("up") * F.sum("down")).alias("joins"))
    rank = degree.select("node", F.struct("joins", F.xxhash64("node", F.lit(number)).alias("hash"), "node").alias("rank"))
    of = lambda c: rank.select(F.col("node").alias(c), F.col("rank").alias(f"{c}_rank"))
    both = left.join(of("child"), "child").join(of("parent"), "parent")
    first = F.col("child_rank") < F.col("parent_rank")
    marks = both.select(F.explode(F.array(F.struct(F.col("child").alias("node"), first.alias("first")), F.struct(F.col("parent").alias("node"), (~first).alias("first")))).alias("x")).select("x.*")
    return marks.groupBy("node").agg(F.bool_and("first").alias("first")).where("first").select("node")


def labelled(edges: DataFrame) -> Labels:
    """Labels of edges (child, parent). Nulls and pairs of one node with itself are left out; cycles are allowed."""
    given = stored(edges.select("child", "parent").where("child is not null and parent is not null and child != parent").distinct())
    left, rounds, number = given, [], 0
    while not left.isEmpty():
        number += 1
        taken = _taken(left, number)
        tag = lambda df, c: df.join(taken.select(F.col("node").alias(c), F.lit(True).alias(f"{c}_out")), c, "left")
        tagged = stored(tag(tag(left, "child"), "parent"))  # at most one of both ends is taken
        up = tagged.where("child_out").select(F.col("child").alias("node"), F.col("parent").alias("hub"))
        down = tagged.where("parent_out").select(F.col("parent").alias("node"), F.col("child").alias("hub"))
        mate = stored(up.join(down, ["node", "hub"]).groupBy("node").agg(F.min("hub").alias("mate")))
        moved = None
        if not mate.isEmpty():  # only graphs with cycles have mates
            moved = down.join(mate, "node").select(F.col("hub").alias("child"), F.col("mate").alias("parent")).unionByName(up.join(mate, "node").select(F.col("mate").alias("child"), F.col("hub").alias("parent")))
            merged = mate.select("node", F.col("mate").alias("hub"))
            up, down = (df.join(mate, "node", "left_anti") for df in (up, down))
        over = down.withColumnRenamed("hub", "child").join(up.withColumnRenamed("hub", "parent"), "node").select("child", "parent")
        both = [(up, True), (down, False)] if moved is None else [(up, True), (down, False), (merged, True), (merged, False)]
        rounds.append(reduce(DataFrame.unionByName, [df.select("node", "hub", F.lit(way).alias("up")) for df, way in both]))
        stay = tagged.where("child_out is null and parent_out is null").select("child", "parent")
        after = stored((stay.unionByName(over) if moved is None else stay.unionByName(over).unionByName(moved)).where("child != parent").distinct())
        if left is not given:
            dropped(left)
        left = after
    nodes = given.select(F.col("child").alias("node")).unionByName(given.select(F.col("parent").alias("node"))).distinct()
    own = nodes.select("node", F.col("node").alias("hub"))

    found = labels_of(rounds)
    return Labels(*(own if found is None else found.where(F.col("up") == way).select("node", "hub").unionByName(own) for way in (True, False)))


def labels_of(rounds: list[DataFrame]) -> DataFrame | None:
    """Distinct (node, hub, up) by links (node, hub, up) of each round, whose hubs were taken out in later rounds or never; None without rounds."""
    known = None
    for links in reversed(rounds):
        if known is not None:
            on = known.select(F.col("node").alias("hub"), F.col("hub").alias("next"), "up")
            links = links.unionByName(links.join(on, ["hub", "up"]).select("node", F.col("next").alias("hub"), "up")).distinct()
        new = stored(links)
        known = new if known is None else known.unionByName(new)
    return known


def reachable_by(pairs: DataFrame, labels: Labels) -> DataFrame:
    """pairs (child, ancestor) with `reached`: equal, or joined by a path; as `closure.reachable`, with rows by the size of labels."""
    asked = pairs.select("child", "ancestor").where("child != ancestor").distinct()
    hubs = asked.join(labels.up.select(F.col("node").alias("child"), "hub"), "child")
    hit = hubs.join(labels.down.select(F.col("node").alias("ancestor"), "hub"), ["ancestor", "hub"], "left_semi").select("child", "ancestor").distinct().withColumn("hit", F.lit(True))
    return pairs.join(hit, ["child", "ancestor"], "left").withColumn("reached", (F.col("child") == F.col("ancestor")) | F.coalesce("hit", F.lit(False))).drop("hit")
