"""Gates: one row of booleans or counts that an analysis must pass before it reads on. Aggregates and anti-joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identity_mismatch(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of identities that only one arm has."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    both = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), keys, "full_outer")
    out = both.agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))
    return out.withColumn("ok", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def unknown_values(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Values outside the list, with their counts; null counts as one."""
    c = F.col(column)
    return rows.where(~F.coalesce(c.isin(known), F.lit(False))).groupBy(column).agg(F.count("*").alias("n"))


def checks(rows: DataFrame, named: dict[str, Column]) -> DataFrame:
    """One row: for each named condition, the rows that break it (null breaks it), and whether there are none."""
    broken = [F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in named.items()]
    out = rows.agg(F.count("*").alias("rows"), *broken)
    ok = F.lit(True)
    for n in named:
        ok = ok & (F.col(n) == 0)
    return out.withColumn("ok", ok)


def one_value(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """Groups whose rows don't all have the same value: configuration drift within an arm."""
    return rows.groupBy(*by).agg(F.count_distinct(column).alias("values"), F.min(column).alias("least"), F.max(column).alias("most")).where("values > 1")


def prompt_invariance(left: DataFrame, right: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Identities of both arms whose prompts differ, null-safe."""
    b = right.select(*keys, F.col(column).alias("_other"))
    return left.join(b, keys).where(~F.col(column).eqNullSafe(F.col("_other"))).select(*keys)


def resolution(requested: DataFrame, stored: DataFrame, key: str, config: str, provenance: str) -> DataFrame:
    """For each requested execution: CREATE (not stored), LEGACY (stored without provenance), RESUME (same configuration) or MISMATCH."""
    s = stored.select(key, F.col(config).alias("_c"), F.col(provenance).alias("_p"), F.lit(True).alias("_there"))
    what = (
        F.when(F.col("_there").isNull(), "CREATE").when(F.col("_p").isNull(), "LEGACY")
        .when(F.col(config).eqNullSafe(F.col("_c")), "RESUME").otherwise("MISMATCH")
    )
    return requested.join(s, key, "left").select(key, what.alias("resolution"))
