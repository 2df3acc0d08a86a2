"""Global ranks: where each row stands in the order of its group, without a global window.

Rows are dealt to tasks by ranges of (group, order), sorted there and written; the few counts of (group, task) are
summed up over tasks and give each task the rank of its first row. A hot group is spread over many tasks. Rows that agree
in group and order are dealt to one task, so order should tell rows apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small


def ranked(df: DataFrame, group: str, order: list[str], label: str, group_bytes: int = 64) -> DataFrame:
    """df with rank (long, from 0 in each group, by order, then as Spark sorts) and total (rows of the group). group: a
    column without nulls. group_bytes: what one group value takes."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    rows = saved(dealt.withColumn("__at", F.monotonically_increasing_id()), label).withColumn("__task", F.shiftright("__at", 33))
    counts = rows.groupBy(group, "__task").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    by_task = Window.partitionBy(group).orderBy("__task")
    before = F.coalesce(F.sum("__n").over(by_task.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("__n").over(Window.partitionBy(group))
    starts = saved(counts.select(group, "__task", (before - F.col("__first")).alias("__shift"), total.alias("total")), f"{label}-starts")
    placed = rows.join(small(starts, 24 + group_bytes), [group, "__task"])
    return placed.withColumn("rank", F.col("__at") + F.col("__shift")).drop("__at", "__task", "__shift")
