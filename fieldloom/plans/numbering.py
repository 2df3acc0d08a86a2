"""Places in a total order, without a global window; and preorder numbers of trees that are given as shared variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .space import Space, roots
from .storage import stored


def running_total(df: DataFrame, value: str, *order: str) -> DataFrame:
    """df with before: the sum of value over all rows that come earlier. Rows are dealt to tasks by ranges and added up
    there; only one sum a task meets in a window."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = stored(dealt, "ordered").withColumn("__task", F.shiftright("__at", 33))
    sums = rows.groupBy("__task").agg(F.sum(value).alias("__sum"))
    earlier = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)  # over tasks, not rows
    starts = F.broadcast(sums.select("__task", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start")))
    own = F.sum(value).over(Window.partitionBy("__task").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("__own", F.coalesce(own, F.lit(0))).join(starts, "__task")
    return placed.withColumn("before", F.col("__start") + F.col("__own")).drop("__at", "__task", "__start", "__own")


def sized(variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, variant_id, nodes: of the tree that the variant stands for, expanded) and its edges (path, variant_id,
    place, child_path, child_id, nodes, offset: of the child's number from the variant's). One pass a level, deepest first."""
    deepest = variants.agg(F.max(F.size("path"))).first()[0] or 0
    sizes, edges, below = [], [], None
    by_place = Window.partitionBy("path", "variant_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    for depth in range(deepest, 0, -1):
        here = variants.where(F.size("path") == depth).select("path", "variant_id", F.array_sort("children").alias("children"))
        if below is None:
            level = here.select("path", "variant_id", F.lit(1).cast("long").alias("nodes"))
        else:
            each = here.select("path", "variant_id", F.posexplode("children").alias("place", "c")).select("path", "variant_id", "place", F.col("c.path").alias("child_path"), F.col("c.variant_id").alias("child_id"))
            child = below.select(F.col("path").alias("child_path"), F.col("variant_id").alias("child_id"), "nodes")
            linked = each.join(child, ["child_path", "child_id"]).withColumn("offset", 1 + F.coalesce(F.sum("nodes").over(by_place), F.lit(0)))
            edges.append(stored(linked, "variant-edges"))
            held = edges[-1].groupBy("path", "variant_id").agg(F.sum("nodes").alias("held"))
            level = here.join(held, ["path", "variant_id"], "left").select("path", "variant_id", (1 + F.coalesce("held", F.lit(0))).alias("nodes"))
        below = stored(level, "variant-sizes")
        sizes.append(below)
    none = variants.select("path", "variant_id", F.lit(0).alias("place"), F.col("path").alias("child_path"), F.col("variant_id").alias("child_id"), F.lit(1).cast("long").alias("nodes"), F.lit(1).cast("long").alias("offset")).limit(0)
    return reduce(DataFrame.unionByName, sizes or [variants.select("path", "variant_id", F.lit(1).cast("long").alias("nodes"))]), reduce(DataFrame.unionByName, edges or [none])


def numbered(space: Space) -> DataFrame:
    """The expanded trees of all root variants, numbered in preorder from 1, as if they were one list: number, last (of the subtree),
    depth, place (among its siblings), ends (how many trees around it end with its own), path, variant_id, root (number
    of its root), probability (of the root variant). Roots come by path, most frequent first; children by path."""
    variants = stored(space.variants.select("path", "variant_id", "children"), "variants")
    sizes, edges = sized(variants)
    tops = roots(space).select("path", "variant_id", "count", "probability").join(sizes, ["path", "variant_id"]).withColumn("after", -F.col("count"))
    tops = running_total(tops, "nodes", "path", "after", "variant_id")
    first = (F.col("before") + 1).alias("number")
    last = (F.col("before") + F.col("nodes")).alias("last")
    zero = F.lit(0)
    level = stored(tops.select(first, last, zero.alias("depth"), zero.alias("place"), zero.alias("ends"), "path", "variant_id", first.alias("root"), "probability"), "numbered")
    levels, depth = [level], 0
    while True:
        depth += 1
        up = level.select("path", "variant_id", "root", "probability", F.col("number").alias("above"), F.col("last").alias("above_last"), F.col("ends").alias("above_ends"))
        number = F.col("above") + F.col("offset")
        until = number + F.col("nodes") - 1
        ends = F.when(until == F.col("above_last"), F.col("above_ends") + 1).otherwise(0)
        below = up.join(edges, ["path", "variant_id"]).select(
            number.alias("number"), until.alias("last"), F.lit(depth).alias("depth"), "place", ends.alias("ends"), F.col("child_path").alias("path"), F.col("child_id").alias("variant_id"), "root", "probability"
        )
        level = stored(below, "numbered")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(level)
