"""Running sums and row numbers over a whole table without a window over all of it.

Rows are sorted in ranges; sums within a range come from a window of this range, sums of earlier ranges from prefix sums over the ranges' totals, and those
again from totals of blocks of ranges, for as many levels as there are ranges. Every window has a partition of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimforge.operators.tables import stored

FAN = 1024


def before(df: DataFrame, pos: str, names, keys=(), fan: int = FAN, top: int | None = None, level: int = 0) -> DataFrame:
    """df (keys, pos, names...), one row for each pos from 0, with {name}_before: the sum over all smaller pos of the same keys.

    top: the greatest pos, if it is known. level counts the recursion over blocks.
    """
    names, keys, block = list(names), list(keys), f"block{level}_"
    top = df.agg(F.max(pos)).first()[0] if top is None else top
    earlier = Window.partitionBy(*keys, block).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn(block, F.floor(F.col(pos) / fan)).withColumns({f"{n}_before": F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in names})
    if top is None or top < fan:
        return out.drop(block)
    blocks = before(df.groupBy(*keys, F.floor(F.col(pos) / fan).alias(block)).agg(*[F.sum(n).alias(n) for n in names]), block, names, keys, fan, top // fan, level + 1)
    blocks = blocks.select(*[F.col(k).alias(f"{k}_of") for k in keys], F.col(block).alias("b_"), *[F.col(f"{n}_before").alias(f"{n}_far") for n in names])
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys]
    joined = out.join(blocks, [*same, F.col(block) == F.col("b_")])
    return joined.withColumns({f"{n}_before": F.col(f"{n}_before") + F.col(f"{n}_far") for n in names}).select(*df.columns, *[f"{n}_before" for n in names])


def running(df: DataFrame, order, sums: dict[str, Column], keys=(), fan: int = FAN) -> DataFrame:
    """df with running sums in an order, each row's own included, for each combination of keys (none: over all rows).

    Ties of the order are taken in any order, so it should tell rows apart where sums must not change between runs. Sorted rows are written
    once, so ranges stay the same if a task is run again.
    """
    order, keys, names = list(order), list(keys), list(sums)
    own = df.columns
    ranged = stored(df.withColumns({f"{n}_own": c.cast("long") if n == "row_" else c for n, c in sums.items()}).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumns({"range_": F.spark_partition_id().cast("long"), "place_": F.monotonically_increasing_id()}))
    totals = ranged.groupBy(*keys, "range_").agg(*[F.sum(f"{n}_own").alias(n) for n in names])
    earlier = before(totals, "range_", names, keys, fan).select(*[F.col(k).alias(f"{k}_of") for k in keys], F.col("range_").alias("r_"), *[f"{n}_before" for n in names])
    w = Window.partitionBy(*keys, "range_").orderBy("place_").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"{n}_in": F.sum(f"{n}_own").over(w) for n in names})
    joined = local.join(earlier, [*[F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys], F.col("range_") == F.col("r_")])
    return joined.select(*[F.col(c) for c in own if c not in names], *[(F.col(f"{n}_in") + F.col(f"{n}_before")).alias(n) for n in names])


def numbered_rows(df: DataFrame, order, name: str = "idx", keys=(), fan: int = FAN) -> DataFrame:
    """df with the place of each row in an order, from 0, over all rows or for each combination of keys."""
    out = running(df, order, {"row_": F.lit(1)}, keys, fan)
    return out.select(*df.columns, (F.col("row_") - 1).cast("long").alias(name))
