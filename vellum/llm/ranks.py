"""Places of rows within a group, without a task that holds the group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import written


def ranked(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``pos``, the place from 0 in its ``group`` by ``order`` (ascending, nulls first), and ``total``, the group's rows.

    Rows are dealt by range of group and order, so a group of any size is spread over tasks; each task numbers its own, and
    the rows of the group in earlier tasks are added from counts by task. Rows that agree in all of ``order`` are dealt by their
    place in the files; which of them comes first is open. ``rows`` is read twice: it should be a written table. ``group`` is
    never null.
    """
    keys = [group, *order, "tie"]
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("mark", F.monotonically_increasing_id())
    marked = written(dealt.withColumn("task", F.shiftright("mark", 33)), f"{label}-marked")
    parts = marked.groupBy(group, "task").agg(F.min("mark").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = written(parts.select(group, "task", "first", before.alias("before"), F.sum("n").over(whole).alias("total")), f"{label}-parts")
    placed = marked.join(ahead, [group, "task"])
    return placed.withColumn("pos", F.col("mark") - F.col("first") + F.col("before")).drop("mark", "task", "first", "before")
