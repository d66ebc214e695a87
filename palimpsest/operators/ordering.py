"""Order-dependent values without one task per group.

Rows are range-partitioned by (group, order), so that a group is a contiguous run
of partitions and a hot one is spread.  Inside a partition a window does the
work; what crosses a partition's edge comes from one small row per (group,
partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def ranged(rows: DataFrame, by: list[str], name: str = "ranged") -> DataFrame:
    """The rows in partitions of ascending ranges of `by`, written once so that the
    ranges stay as they are; `__part` numbers them."""
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id())
    return materialize(placed, name)


def numbered(rows: DataFrame, group: list[str], order: list[str], column: str = "n", name: str = "numbered") -> DataFrame:
    """`column` counts the rows of each group from 1 in that order, which must be total."""
    placed = ranged(rows, [*group, *order], name)
    local = placed.withColumn("__local", F.row_number().over(Window.partitionBy("__part", *group).orderBy(*order)))
    spans = local.groupBy(*group, "__part").agg(F.count("*").alias("__here"))
    before = F.sum("__here").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = spans.select(*group, "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return _join_spans(local, offsets, group).withColumn(column, F.col("__local") + F.col("__before")).drop("__part", "__local", "__before")


def _join_spans(rows: DataFrame, spans: DataFrame, group: list[str]) -> DataFrame:
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "__part"]]
    extra = [c for c in spans.columns if c not in (*group, "__part")]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return rows.alias("l").join(spans.alias("r"), condition, "left").select("l.*", *(f"r.{c}" for c in extra))


def previous(rows: DataFrame, group: list[str], order: list[str], value: str, column: str, name: str = "previous") -> DataFrame:
    """`column` is `value` of the row before, in that order, within the group."""
    placed = ranged(rows, [*group, *order], name)
    w = Window.partitionBy("__part", *group).orderBy(*order)
    local = placed.withColumn("__inside", F.lag(value).over(w)).withColumn("__head", F.row_number().over(w) == 1)
    last = placed.groupBy(*group, "__part").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    carried = last.select(*group, "__part", F.lag("__last").over(Window.partitionBy(*group).orderBy("__part")).alias("__carried"))
    joined = _join_spans(local, carried, group)
    return joined.withColumn(column, F.when(F.col("__head"), F.col("__carried")).otherwise(F.col("__inside"))).drop("__part", "__inside", "__head", "__carried")


def running(rows: DataFrame, group: list[str], order: list[str], value: str, column: str = "before", name: str = "running") -> DataFrame:
    """`column` is the sum of `value` over the rows before, in that order, within the group."""
    placed = ranged(rows, [*group, *order], name)
    w = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("__inside", F.coalesce(F.sum(value).over(w), F.lit(0)))
    spans = placed.groupBy(*group, "__part").agg(F.sum(value).alias("__here"))
    earlier = F.sum("__here").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = spans.select(*group, "__part", F.coalesce(earlier, F.lit(0)).alias("__before"))
    return _join_spans(local, offsets, group).withColumn(column, F.col("__inside") + F.col("__before")).drop("__part", "__inside", "__before")


SLICE = 10_000  # steps of one group folded in one row


def affine_fold(steps: DataFrame, group: str, at: str, name: str = "steps") -> DataFrame:
    """(group, keep, add, n) of steps (group, at, keep, add), each v -> keep v + add, all
    of a group composed in order of `at`.

    Composing is associative: slices of a group are folded where they lie and their
    results folded again, so a group with a third of all steps fits into no one row."""
    placed = ranged(steps.select(group, at, "keep", "add"), [group, at], name)

    def fold(rows: DataFrame, by: list[str], order: str) -> DataFrame:
        listed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, "keep", "add", "n"))).alias("all"))
        start = F.struct(F.lit(1.0).alias("keep"), F.lit(0.0).alias("add"), F.lit(0).cast("long").alias("n"))
        one = F.aggregate(
            "all", start,
            lambda s, x: F.struct((s["keep"] * x["keep"]).alias("keep"), (s["add"] * x["keep"] + x["add"]).alias("add"), (s["n"] + x["n"]).alias("n")),
        )
        return listed.select(*by, one.alias("one")).select(*by, "one.keep", "one.add", "one.n")

    w = Window.partitionBy("__part", group).orderBy(at)
    sliced = placed.withColumn("slice", F.floor((F.row_number().over(w) - 1) / SLICE)).withColumn("n", F.lit(1).cast("long"))
    parts = fold(sliced, [group, "__part", "slice"], at).withColumn("order", F.struct("__part", "slice"))
    return fold(parts, [group], "order")


def positions(rows: DataFrame, key: str, name: str = "positions") -> DataFrame:
    """`pos` from 0 in order of the key over all rows, and `n`, their number."""
    placed = ranged(rows, [key], name)
    local = placed.withColumn("__local", F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1)
    counts = placed.groupBy("__part").agg(F.count("*").alias("__here"))  # a row per partition
    before = F.sum("__here").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    spans = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__here").over(Window.partitionBy()).alias("n"))
    return local.join(F.broadcast(spans), "__part").withColumn("pos", F.col("__local") + F.col("__before")).drop("__part", "__local", "__before")


def kept_last(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The last n rows: each task keeps its own n, the rest never moves."""
    return rows.orderBy(*(c.desc() for c in order)).limit(n)
