"""Exact places in an order, over any number of tasks.

Rows are cut into ranges of the whole order, group first; ties are cut too, by a
hash of the row and then by its position in the scan, so neither a large group
nor a value that fills the table ends up in one task. A row's place is its
place in its range plus what the ranges before hold of its group; those totals
are a row per group and range.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.plans.staged import stage_table

PER_RANGE = 1_000_000


def ranges_for(rows: DataFrame, per_range: int = PER_RANGE) -> int:
    """As many ranges as rows demand, at least the session's shuffle partitions."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / per_range))


def same_keys(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe equality of the keys of two aliased tables."""
    return reduce(Column.__and__, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys], F.lit(True))


def placed(rows: DataFrame, group: list[str], order: list[Column | str], name: str = "place", per_range: int = PER_RANGE) -> DataFrame:
    """``rows`` with their place (bigint, from 1) in ``order`` within their group (the whole table if none is named).

    Null keys are a group. Rows that tie in ``order`` get places of their own,
    in an order that depends on their values alone. ``rows`` is read three
    times (to count, to find the cuts, to deal): pass a scan or a stored table.
    An empty table stays empty.
    """
    return offset(in_ranges(rows, [*group, *order], per_range), group, name)


def in_ranges(rows: DataFrame, order: list[Column | str], per_range: int = PER_RANGE) -> DataFrame:
    """``rows``, stored, with ``_at``: ids that ascend in ``order``, the range in the upper bits, the place there (from 0) in the lower 33."""
    by = [*order, "_hash", "_seen"]
    keyed = rows.withColumn("_hash", F.xxhash64(*rows.columns)).withColumn("_seen", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(ranges_for(rows, per_range), *by).sortWithinPartitions(*by)
    return stage_table(dealt.drop("_hash", "_seen").withColumn("_at", F.monotonically_increasing_id()), "ordered")


def offset(done: DataFrame, group: list[str], name: str) -> DataFrame:
    """Places from rows that carry ``_at``, ascending in their order: range in the upper bits, place there in the lower ones."""
    cut = done.withColumn("_range", F.shiftright("_at", 33))
    totals = cut.groupBy(*group, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(*group, "_range", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    both = cut.alias("l").join(starts.alias("r"), same_keys("l", "r", ["_range", *group]))
    return both.select(*[F.col(f"l.`{c}`") for c in done.columns if c != "_at"], (F.col("l._at") + F.col("r._shift")).alias(name))


def running_total(placed_rows: DataFrame, group: list[str], value: Column, name: str, place: str = "place", piece: int = 100_000) -> DataFrame:
    """Rows of ``placed`` with the sum of ``value`` up to and with each row of its group, by place.

    Sums run within pieces of ``piece`` places; what stands before a piece comes
    from the pieces' totals, a row each.
    """
    cut = placed_rows.withColumn("_v", value).withColumn("_piece", F.expr(f"(`{place}` - 1) div {piece}"))
    totals = cut.groupBy(*group, "_piece").agg(F.sum("_v").alias("_t"))
    before = F.sum("_t").over(Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(*group, "_piece", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = cut.withColumn("_own", F.sum("_v").over(Window.partitionBy(*group, "_piece").orderBy(place)))
    both = inside.alias("l").join(starts.alias("r"), same_keys("l", "r", ["_piece", *group]))
    return both.select(*[F.col(f"l.`{c}`") for c in placed_rows.columns], (F.col("l._own") + F.col("r._before")).alias(name))
