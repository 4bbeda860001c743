"""Trie of conversation prefixes by smallest-member ownership.

Nodes are distinct prefixes, keyed by depth and two 64-bit hashes (XOR of the hashes of their placed turns). A node belongs to its member
of smallest conv_id; as the members of a deeper node are among those of a shallower one, what a conversation owns is a suffix of
its path. A window per prefix marks the owned nodes (Spark keeps one row of a prefix for each task before its shuffle). Sums over subtrees need no
recursion then: a node's occurrences at and below it are its members' path suffixes, and each node below it is owned by one member. So one group-by
of prefixes sums each member's tokens from there on, minus those that it owns, and flags of the members that own a leaf.

Conversations of any length are cut into blocks for running sums, and the ids that a node's hash is made of are joined in blocks, then
hashed as a stream, so no task holds a group whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimforge.llm.common import cut, discard, read_table, ship

NODE = ["depth", "p", "q"]
BLOCK = 1024  # turns of a conversation, or range of ids, that one window or list holds


def ordered(turns: DataFrame) -> DataFrame:
    """A table (conv_id, pos, role, text) of conversations' turns, pos from 0 in the order of turn, null first.

    Equal turns follow in the order of role and text. Null roles and texts become empty; rows with a null conv_id go. Rows are sorted in ranges,
    numbered in each range and moved on by what earlier ranges hold of the conversation, so a conversation may fill many tasks.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text")).where("conv_id is not null")
    order = ["conv_id", "turn", "role", "text"]
    ranges = ["conv_id", "turn", *[F.substring(c, 1, 64) for c in ("role", "text")]]  # bounds of ranges come to the driver: beginnings of texts tell rows apart as well
    ranged = cut(rows.repartitionByRange(*ranges).sortWithinPartitions(*order).select("conv_id", F.monotonically_increasing_id().alias("place"), F.spark_partition_id().alias("part"), "role", "text"))
    sizes = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    first = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = ranged.select("conv_id", "part", "place", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("place")).alias("i"))
    at = numbered.join(first, ["conv_id", "part"]).select("conv_id", "place", (F.col("before") + F.col("i") - 1).alias("pos"))
    out = cut(ranged.join(at, ["conv_id", "place"]).select("conv_id", "pos", "role", "text"))
    discard(ranged)
    return out


def rebuilt(turns: DataFrame, head: Column, most: int, base: Column) -> DataFrame:
    """(conv_id, pos, role, text) with the first `head` turns (at most `most`) of each conversation replaced by those of the conversation `base`.

    All of them if base has fewer, none if it is absent. head and base are columns of conv_id.
    """
    convs = turns.select("conv_id").distinct().select("conv_id", head.cast("long").alias("head"), base.alias("base"))
    heads = turns.where(F.col("pos") < most).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    plan = convs.join(heads, "base", "left").select("conv_id", "head", F.when(F.col("head") > 0, F.slice("turns", F.lit(1), F.greatest(F.col("head"), F.lit(1)).cast("int"))).alias("turns"))
    plan = cut(plan.withColumn("given", F.coalesce(F.size("turns"), F.lit(0)).cast("long")))
    given = plan.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.*")
    own = turns.join(plan.select("conv_id", "head", "given"), "conv_id").where("pos >= head").select("conv_id", (F.col("given") + F.col("pos") - F.col("head")).alias("pos"), "role", "text")
    return given.unionByName(own)


def _running(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """rows (conv_id, depth from 1, ...) with running aggregates up to each row, over blocks of depths: within a block, then over blocks."""
    rows = rows.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK))
    w = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    whole = rows.groupBy("conv_id", "block").agg(*[c.alias(f"{n}_all") for n, c in sums.items()])
    again = {"p": F.bit_xor, "q": F.bit_xor}
    start = whole.select("conv_id", "block", *[F.coalesce(again.get(n, F.sum)(f"{n}_all").over(before), F.lit(0).cast("long")).alias(f"{n}_start") for n in sums])
    local = rows.select("*", *[c.over(w).alias(f"{n}_in") for n, c in sums.items()]).join(start, ["conv_id", "block"])
    total = lambda n: F.col(f"{n}_in").bitwiseXOR(F.col(f"{n}_start")) if n in again else F.col(f"{n}_in") + F.col(f"{n}_start")
    return local.select("conv_id", "depth", "a", "b", "n", *[total(n).alias(n) for n in sums])


def owned_nodes(path: DataFrame) -> DataFrame:
    """One row of each node, its member of smallest conv_id. Before the exchange each task keeps one row of a node, so no node is hot behind it."""
    first = F.row_number().over(Window.partitionBy(*NODE).orderBy("conv_id"))
    return path.withColumn("rank", first).where("rank = 1").drop("rank")


def _hashed(batches):
    """sha256 of the comma-joined lists of each node; lists come in order, those of a node one behind the other."""
    now, state = None, None
    for batch in batches:
        keys, lists = list(zip(*(batch.column(c).to_pylist() for c in NODE), strict=True)), batch.column("ids").to_pylist()
        done = []
        for key, ids in zip(keys, lists, strict=True):
            if key != now:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _digests(done)
    if now is not None:
        yield _digests([(*now, state.hexdigest())])


def _digests(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*NODE, "ends"])


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """One row for each distinct prefix (role, text) of conversations, the empty one (the root) included.

    turns: (conv_id, pos, role, text), pos from 0 without gaps, no nulls, as `ordered` gives them; convs: (conv_id) of all conversations if some
    have no turn. Columns, all long but ends_sha256: conv_id, the smallest member; depth; parent_conv_id, the parent's conv_id (root: null);
    n_convs, members; n_children; n_leaves, childless nodes of the subtree; saved_tokens, summed over the subtree, each node's
    (n_convs - 1) times the code points in its last text; ends_sha256, of the comma-joined ids of members that end here, in order.
    Equal conversations share all their nodes. No conversation, no rows, not even the root.
    """
    ship(turns.sparkSession)
    depth = (F.col("pos") + 1).cast("long")
    a, b = F.xxhash64(depth, "role", "text"), F.xxhash64(F.lit(7), "text", "role", depth)
    steps = turns.select("conv_id", depth.alias("depth"), a.alias("a"), b.alias("b"), F.char_length("text").cast("long").alias("n"))
    steps = _running(steps, {"p": F.bit_xor("a"), "q": F.bit_xor("b"), "upto": F.sum("n")})
    ids = turns.select("conv_id") if convs is None else turns.select("conv_id").unionByName(convs.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id is not null"))
    zero = F.lit(0).cast("long")
    roots = ids.distinct().select("conv_id", *[zero.alias(c) for c in ("depth", "a", "b", "n", "p", "q", "upto")])
    path = cut(steps.unionByName(roots))

    # windows mark the owned nodes; a child counts for its parent, whose key is its own without its last turn
    owned = cut(owned_nodes(path))
    child = owned.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p").bitwiseXOR(F.col("a")).alias("p"), F.col("q").bitwiseXOR(F.col("b")).alias("q"))
    counts = owned.select(*NODE, "conv_id", "n", "upto", zero.alias("child")).unionByName(child.select("*", F.lit(None).cast("long").alias("conv_id"), zero.alias("n"), zero.alias("upto"), F.lit(1).cast("long").alias("child")))
    nodes = cut(counts.groupBy(*NODE).agg(F.max("conv_id").alias("conv_id"), F.sum("child").alias("n_children"), F.max("n").alias("n"), F.max("upto").alias("upto")))

    # of each conversation: tokens of all its turns, of those that it owns, the depth from which it owns, and whether it owns a leaf
    ends = path.groupBy("conv_id").agg(F.max("upto").alias("all"), F.max("depth").alias("last"))
    mine = nodes.groupBy("conv_id").agg(F.min("depth").alias("since"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"), F.min_by(F.col("upto") - F.col("n"), "depth").alias("outside"))
    each = cut(ends.join(mine, "conv_id", "left"))
    before = F.col("upto") - F.col("n")
    from_here = F.col("all") - before
    of_own = F.when(F.col("depth") >= F.col("since"), from_here).otherwise(F.coalesce(F.col("all") - F.col("outside"), zero))
    summed = path.join(each, "conv_id").groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.sum(from_here - of_own).alias("saved_tokens"), F.sum(F.coalesce("leaf", zero)).alias("n_leaves"))

    # owners of parents: the same conversation, but for the first node that a conversation owns
    heads = owned.join(each.select("conv_id", "since"), "conv_id").where("depth = since and depth > 0")
    above = heads.select(*NODE, (F.col("depth") - 1).alias("d"), F.col("p").bitwiseXOR(F.col("a")).alias("pp"), F.col("q").bitwiseXOR(F.col("b")).alias("qq"))
    owners = nodes.select(F.col("depth").alias("d"), F.col("p").alias("pp"), F.col("q").alias("qq"), F.col("conv_id").alias("parent"))
    above = above.join(owners, ["d", "pp", "qq"]).select(*NODE, "parent")

    # ids of the conversations that end at a node: lists of a range of ids each, put in order and hashed as a stream
    ending = path.join(each.select("conv_id", "last"), "conv_id").where("depth = last").groupBy(*NODE, F.floor(F.col("conv_id") / BLOCK).alias("range")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    hashes = ending.repartition(*NODE).sortWithinPartitions(*NODE, "range").select(*NODE, "ids").mapInArrow(_hashed, "depth long, p long, q long, ends string")

    blank = lambda df, *names: df.select(*NODE, *[F.col(c) if c in df.columns else F.lit(None).cast("string" if c == "ends" else "long").alias(c) for c in names])
    facts = ("conv_id", "n_children", "n_convs", "saved_tokens", "n_leaves", "parent", "ends")
    every = blank(nodes, *facts).unionByName(blank(summed, *facts)).unionByName(blank(above, *facts)).unionByName(blank(hashes, *facts))
    out = every.groupBy(*NODE).agg(*[F.max(c).alias(c) for c in facts])
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op11_conversation_trie(spark, sf_dir: str) -> DataFrame:
    turns = ordered(read_table(spark, sf_dir, "conversations"))
    c = F.col("conv_id")
    head = F.crc32(c.cast("string").cast("binary")) % 6
    return prefix_trie(cut(rebuilt(turns, head, 5, c - c % 100)), turns)
