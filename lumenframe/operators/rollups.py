"""Joins of arms and populations, counts, shares and set operations over any keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import stats


def flips(trials: DataFrame, by: list[str]) -> DataFrame:
    """Both kinds of flips: passing and failing attempts beside each other, and more than one verdict."""
    ok = F.col("verdict") == "PASS"
    lo, hi = F.min("verdict"), F.max("verdict")
    return trials.groupBy(*by).agg((F.bool_or(ok) != F.bool_and(ok)).alias("grader_flip"), (lo != hi).alias("verdict_flip"))


def arms(trials: DataFrame, names: dict[str, str], keys: list[str], value: str) -> DataFrame:
    """Identities that all arms have, with each arm's value: ``names`` is column -> model. One pass and one shuffle, however many arms."""
    own = trials.where(F.col("model_config_id").isin(list(names.values())))
    by = own.groupBy(*keys).agg(*[F.max(F.when(F.col("model_config_id") == m, F.col(value))).alias(c) for c, m in names.items()])
    for c in names:
        by = by.where(F.col(c).isNotNull())
    return by


def common_keys(rows: DataFrame, column: str, values: list[str], key: str) -> DataFrame:
    """Keys that each of the values has."""
    return rows.where(F.col(column).isin(values)).groupBy(key).agg(F.count_distinct(column).alias("_n")).where(F.col("_n") == len(values)).select(key)


def with_default(left: DataFrame, right: DataFrame, key: str, column: str, default) -> DataFrame:
    """Left rows with the right side's value, or the default where it has none."""
    return left.join(right.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def bijection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, and all keys: a bijection has none of the first."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full_outer").agg(F.count_if(F.col("_l").isNull()).alias("only_right"), F.count_if(F.col("_r").isNull()).alias("only_left"), F.count("*").alias("total"))


def enriched(base: DataFrame, *sides: tuple[DataFrame, list[str]]) -> DataFrame:
    """Left joins of a registry with its side tables, in turn; small ones are broadcast by their size."""
    for side, keys in sides:
        base = base.join(side, keys, "left")
    return base


def driven(drivers: DataFrame, rows: DataFrame, key: str, passed: Column) -> DataFrame:
    """Trials and passes of each driver, zero for one without rows."""
    by = rows.groupBy(key).agg(F.count("*").alias("trials"), F.count_if(passed).alias("passes"))
    return drivers.select(key).join(by, key, "left").select(key, F.coalesce("trials", F.lit(0)).alias("trials"), F.coalesce("passes", F.lit(0)).alias("passes"))


def missing_identities(observed: DataFrame, tasks: DataFrame, key: str, trials: int) -> DataFrame:
    """(key, trial) that are expected, each task with trials 1..n, and not there."""
    want = tasks.select(key, F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    return want.join(observed.select(key, "trial"), [key, "trial"], "left_anti")


def semi(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(wanted.select(*keys), keys, "left_semi")


def shares(rows: DataFrame, by: str, digits: int = 4) -> DataFrame:
    """Counts of values and their shares of all rows."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.join(total).select(by, "n", F.round(F.col("n") / F.col("_t"), digits).alias("share"))


def weighted(labels: DataFrame, rows: DataFrame, key: str, label: str) -> DataFrame:
    """Rows of each label, through the keys that it labels."""
    n = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return labels.select(key, label).join(n, key).groupBy(label).agg(F.sum("_n").alias("weight"))


def modes_of(rows: DataFrame, by: str, mode: str) -> DataFrame:
    """Distinct modes of each group, and whether there is more than one."""
    return rows.select(by, mode).distinct().groupBy(by).agg(F.count("*").alias("modes")).withColumn("multi_mode", F.col("modes") > 1)


def both_checks(rows: DataFrame, by: str, static: Column, functional: Column) -> DataFrame:
    """A pass needs both: rows, passes and static failures of each suite."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(static & functional).alias("passes"), F.count_if(~static).alias("static_failures"))


def with_total(rows: DataFrame, by: str) -> DataFrame:
    """Trials and passes of each model, and of all (null)."""
    return rows.rollup(by).agg(F.count("*").alias("trials"), F.count_if(F.col("verdict") == "PASS").alias("passes"))


def by_sets(rows: DataFrame, sets: list[list[str]], *columns: str) -> DataFrame:
    """Trials and passes by several groupings at once; a column that a grouping leaves out is null."""
    aggs = [F.count("*").alias("trials"), F.count_if(F.col("verdict") == "PASS").alias("passes")]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(*aggs)


def first_attempts(trials: DataFrame, by: list[str]) -> DataFrame:
    """The verdict of the first attempt: a minimum with map-side combine, no window."""
    return trials.groupBy(*by).agg(F.min_by("verdict", "trial").alias("verdict"))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Identities that stand more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def never_passed(trials: DataFrame, models: list[str]) -> DataFrame:
    """Tasks that each of the models tried and none passed."""
    own = trials.where(F.col("model_config_id").isin(models))
    by = own.groupBy("task_id").agg(F.bool_or(F.col("verdict") == "PASS").alias("_p"), F.count_distinct("model_config_id").alias("_m"))
    return by.where(~F.col("_p") & (F.col("_m") == len(models))).select("task_id")


def first_keys(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.select(key).distinct().orderBy(key).limit(n)


def union_of(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The distinct values of several columns."""
    return rows.select(F.explode(F.array(*columns)).alias(name)).distinct()


def minus(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def cohorts(parts: list[DataFrame], key: str) -> DataFrame:
    """Cohorts one after the other, numbered from 1."""
    out = None
    for i, p in enumerate(parts, 1):
        one = p.select(F.lit(i).alias("cohort"), key)
        out = one if out is None else out.unionByName(one)
    return out


def headroom(rows: DataFrame, key: str, size: str, room: int, reserve: int) -> DataFrame:
    """The longest input (of ties the smallest key), what is left beside it, and whether that is enough."""
    top = rows.agg(F.max(F.struct(F.col(size), -F.col(key))).alias("t")).select(F.col(f"t.{size}").alias("longest"), (-F.col("t.col2")).alias(key))
    left = F.lit(room) - F.col("longest") - F.lit(reserve)
    return top.select("longest", left.alias("headroom"), (left >= 0).alias("fits"), key)


def spread(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.round(stats.pstdev(value), 6).alias("sd"), F.round(stats.coefficient_of_variation(value), 6).alias("cv"))


def last_rows(rows: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """The last row of each key in an order: a maximum with map-side combine."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_r")).select(key, "_r.*")

