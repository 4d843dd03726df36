"""Capability, reliability and paired comparison over trials.

Every function is a plan of aggregations by (model, task), then by model: trials
shuffle once, map-side combined, and all later steps work on rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import stats
from lumenframe.functions.metrics import token_bucket
from lumenframe.operators.ordering import PER_RANGE, in_ranges, placed

READY = ("READY_DETERMINISTIC", "READY_JUDGE")
BUCKETS = ("1-4", "5-32", "33-128", "129+")


def ok():
    return F.col("verdict") == "PASS"


def deterministic(trials: DataFrame) -> DataFrame:
    """Population membership comes from the task's status, never from a verdict."""
    return trials.where(F.col("grading_status") == "READY_DETERMINISTIC")


def outcome_columns() -> list:
    """Trials, passes, any and all passed, the first attempt, both kinds of flips: all combine map-side."""
    return [
        F.count("*").alias("trials"), F.count_if(ok()).alias("passes"), F.bool_or(ok()).alias("any_pass"), F.bool_and(ok()).alias("all_pass"),
        F.min_by(ok(), "trial").alias("first_pass"), (F.bool_or(ok()) != F.bool_and(ok())).alias("grader_flip"),
        (F.min("verdict") != F.max("verdict")).alias("verdict_flip"),
    ]


def task_outcomes(trials: DataFrame, *more: str) -> DataFrame:
    """A row per (model, task) with ``outcome_columns``."""
    return trials.groupBy("model_config_id", "task_id", *more).agg(*outcome_columns())


def capability(trials: DataFrame) -> DataFrame:
    """Integers and rates of each model over deterministic tasks."""
    by = task_outcomes(deterministic(trials)).groupBy("model_config_id").agg(
        F.count("*").alias("tasks"),
        F.sum("trials").alias("trials"),
        F.sum("passes").alias("passes"),
        F.count_if("any_pass").alias("any_pass_tasks"),
        F.count_if("all_pass").alias("all_pass_tasks"),
    )
    return by.select(
        "*",
        F.round(stats.rate(F.col("passes"), F.col("trials")), 9).alias("trial_accuracy"),
        F.round(stats.rate(F.col("any_pass_tasks"), F.col("tasks")), 9).alias("any_pass_rate"),
        F.round(stats.rate(F.col("all_pass_tasks"), F.col("tasks")), 9).alias("all_pass_rate"),
    )


def reliability(trials: DataFrame) -> DataFrame:
    """Per deterministic task: success rate, first attempt, flips, spread of the decode rate; one aggregation."""
    own = deterministic(trials).groupBy("model_config_id", "task_id").agg(
        *outcome_columns(),
        F.round(stats.pstdev("decode_tok_s"), 6).alias("decode_stdev"),
        F.round(stats.coefficient_of_variation("decode_tok_s"), 6).alias("decode_cv"),
    )
    return own.withColumn("success_rate", F.round(stats.rate(F.col("passes"), F.col("trials")), 9))


def experiment_means(trials: DataFrame) -> DataFrame:
    """Means of task values, and how many tasks that failed first recovered later."""
    t = task_outcomes(deterministic(trials))
    missed = F.count_if(~F.col("first_pass"))
    back = F.count_if(~F.col("first_pass") & F.col("any_pass"))
    return t.groupBy("model_config_id").agg(
        F.round(F.avg(F.col("passes") / F.col("trials")), 9).alias("mean_success"),
        F.round(F.avg(F.col("first_pass").cast("double")), 9).alias("mean_first"),
        F.round(F.avg(F.col("any_pass").cast("double")), 9).alias("mean_any"),
        F.round(F.avg(F.col("all_pass").cast("double")), 9).alias("mean_all"),
        F.round(F.avg(F.col("grader_flip").cast("double")), 9).alias("flip_rate"),
        F.concat_ws("/", back.cast("string"), missed.cast("string")).alias("recovery"),
        F.round(stats.rate(back, missed), 9).alias("recovery_rate"),
    )


def performance(trials: DataFrame) -> DataFrame:
    """Count, median, exclusive quartiles, nearest-rank P95 and mean of the decode rate, for all and for each token bucket.

    Every bucket is there, with count zero if empty. Ranks come from ranges of
    the values and the counts of the ranges before; ties are cut too, so no task
    holds a group or a value, however large; the figures are exact. Groups are
    models and buckets: their counts are broadcast.
    """
    keys = ["model_config_id", "bucket"]
    values = trials.select("model_config_id", F.col("decode_tok_s").alias("v"), token_bucket(F.col("eval_count")).alias("bucket"))
    values = values.where("bucket is not null").unionByName(values.withColumn("bucket", F.lit("all")))
    counts = values.groupBy(*keys).agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    ranked = placed(values.where("v is not null"), keys, ["v"], "rank").join(F.broadcast(counts.select(*keys, "n")), keys)
    n, r = F.col("n"), F.col("rank")
    place = lambda i: F.greatest(F.lit(1), F.least(n - 1, F.floor(i * (n + 1) / 4)))
    share = lambda i: i * (n + 1) - 4 * place(i)
    quartile = lambda i: F.when(
        F.max("n") >= 4, F.sum(F.when(r == place(i), F.col("v") * (4 - share(i))).when(r == place(i) + 1, F.col("v") * share(i))) / 4
    )
    found = ranked.groupBy(*keys).agg(
        F.avg(F.when((r == F.floor((n + 1) / 2)) | (r == F.floor(n / 2) + 1), F.col("v"))).alias("median"),
        quartile(1).alias("p25"), quartile(3).alias("p75"), F.max(F.when(r == F.ceil(n * F.lit(95) / 100), F.col("v"))).alias("p95"),
    )
    dense = trials.select("model_config_id").distinct().select(
        "model_config_id", F.explode(F.array(*[F.lit(b) for b in ("all", *BUCKETS)])).alias("bucket")
    )
    out = dense.join(counts, keys, "left").join(found, keys, "left")
    return out.select(
        "model_config_id", "bucket", F.coalesce("n", F.lit(0)).alias("n"),
        *[F.round(c, 6).alias(c) for c in ("median", "p25", "p75", "p95", "mean")],
    )


def paired_tasks(trials: DataFrame, base: str, candidate: str) -> DataFrame:
    """Outcomes of the tasks that both models have."""
    t = task_outcomes(deterministic(trials), "primary_class", "difficulty")
    keep = ["task_id", "primary_class", "difficulty"]
    side = lambda m, p: t.where(F.col("model_config_id") == m).select(
        *keep, *[F.col(c).alias(f"{p}_{c}") for c in ("trials", "passes", "any_pass", "all_pass")]
    )
    return side(base, "base").join(side(candidate, "cand"), keep)


def transitions(pairs: DataFrame, kind: str = "all_pass") -> DataFrame:
    """The four cells of (base ok, candidate ok), also the empty ones, with their counts."""
    cells = pairs.sparkSession.createDataFrame([(a, b) for a in (True, False) for b in (True, False)], "base_ok boolean, cand_ok boolean")
    by = transition_ids(pairs, kind).groupBy("base_ok", "cand_ok").agg(F.count("*").alias("n"))
    return cells.join(by, ["base_ok", "cand_ok"], "left").select("base_ok", "cand_ok", F.coalesce("n", F.lit(0)).alias("n"))


def transition_ids(pairs: DataFrame, kind: str = "all_pass") -> DataFrame:
    """The cell of each task: the ids of a cell are rows, not one list."""
    return pairs.select("task_id", F.col(f"base_{kind}").alias("base_ok"), F.col(f"cand_{kind}").alias("cand_ok"))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """Discordant counts and exact p for strict and any-pass outcomes, with accuracy deltas."""
    b = lambda k: F.count_if(F.col(f"base_{k}") & ~F.col(f"cand_{k}"))
    c = lambda k: F.count_if(~F.col(f"base_{k}") & F.col(f"cand_{k}"))
    one = pairs.agg(
        b("all_pass").alias("strict_b"), c("all_pass").alias("strict_c"), b("any_pass").alias("any_b"), c("any_pass").alias("any_c"),
        F.round(F.sum("cand_passes") / F.sum("cand_trials") - F.sum("base_passes") / F.sum("base_trials"), 9).alias("accuracy_delta"),
        F.round(F.avg(F.col("cand_all_pass").cast("int")) - F.avg(F.col("base_all_pass").cast("int")), 9).alias("all_pass_delta"),
        F.round(F.avg(F.col("cand_any_pass").cast("int")) - F.avg(F.col("base_any_pass").cast("int")), 9).alias("any_pass_delta"),
        F.count_if(~F.col("base_any_pass") & ~F.col("cand_any_pass")).alias("failed_in_both"),
    )
    return one.select(
        "*",
        F.round(stats.exact_mcnemar(F.col("strict_b"), F.col("strict_c")), 9).alias("strict_p"),
        F.round(stats.exact_mcnemar(F.col("any_b"), F.col("any_c")), 9).alias("any_p"),
    )


def judge_rollup(trials: DataFrame) -> DataFrame:
    """Tasks that a judge decides: attempts, those that passed the check before, and their rate."""
    by = trials.where("grading_status = 'READY_JUDGE'").groupBy("task_id").agg(F.count("*").alias("trials"), F.count_if(ok()).alias("precheck_passes"))
    return by.withColumn("rate", F.round(stats.rate(F.col("precheck_passes"), F.col("trials")), 9))


def pair_counts(arms: DataFrame) -> DataFrame:
    """Identities (b, c: verdicts) that both arms pass, only one does, or none."""
    b, c = F.col("b") == "PASS", F.col("c") == "PASS"
    return arms.agg(F.count_if(b & c).alias("both_pass"), F.count_if(b & ~c).alias("b_only"), F.count_if(~b & c).alias("c_only"), F.count_if(~b & ~c).alias("neither"))


def sweep_counts(trials: DataFrame, least: int) -> DataFrame:
    """Models of a sweep, with at least so many attempts and with fewer."""
    by = trials.groupBy("model_config_id").agg(F.count("*").alias("n"))
    return by.agg(F.count("*").alias("models"), F.count_if(F.col("n") >= least).alias("large"), F.count_if(F.col("n") < least).alias("small"))


def comparisons(trials: DataFrame, base: str, candidates: list[str]) -> DataFrame:
    """A row per candidate: its paired comparison with the base."""
    out = None
    for c in candidates:  # a plan per pair; pairs are named, not found
        one = mcnemar(paired_tasks(trials, base, c)).withColumn("comparison", F.lit(f"{base}-vs-{c}"))
        out = one if out is None else out.unionByName(one)
    return out


def eligible(points: DataFrame, *values: str) -> DataFrame:
    """Points all of whose values are known, finite numbers."""
    for v in values:
        c = F.col(v)
        points = points.where(c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c) < float("inf")))
    return points


def strata(trials: DataFrame, base: str, candidate: str, by: str) -> DataFrame:
    """Rates of both sides by a stratum; a stratum that one side lacks has a null rate there."""
    t = deterministic(trials)
    side = lambda m, p: t.where(F.col("model_config_id") == m).groupBy(F.col(by).alias("stratum")).agg(
        F.count("*").alias(f"{p}_trials"), F.round(F.avg(ok().cast("int")), 9).alias(f"{p}_rate")
    )
    return side(base, "base").join(side(candidate, "cand"), "stratum", "full_outer")


def skyline(points: DataFrame, id_col: str, high: str, other: str, smaller_is_better: bool = False, per_range: int = PER_RANGE) -> DataFrame:
    """Points that no other point dominates (as good in both, better in one); nulls are not eligible.

    A sweep instead of a theta self-join: ordered by ``high``, a point stays if
    its other value is the best of its own ``high`` and strictly better than the
    best of all larger ones. The distinct values of ``high`` are cut into ranges;
    of the ranges above, one only needs the best value, a row a range. So the
    sweep stays in as many tasks as there are ranges, also where every point survives.
    """
    sign = -1 if smaller_is_better else 1
    own = points.where(F.col(high).isNotNull() & F.col(other).isNotNull()).withColumn("_o", F.col(other) * sign)
    top = own.groupBy(F.col(high).alias("_high")).agg(F.max("_o").alias("_best"))
    cut = in_ranges(top, [F.desc("_high")], per_range).withColumn("_range", F.shiftright("_at", 33))
    totals = cut.groupBy("_range").agg(F.max("_best").alias("_most"))
    before = totals.select("_range", F.max("_most").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # a row a range
    inside = cut.withColumn("_above", F.max("_best").over(Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)))
    edge = inside.join(F.broadcast(before), "_range").where(F.coalesce(F.col("_best") > F.greatest("_above", "_before"), F.lit(True))).select("_high", "_best")
    return own.join(edge, (F.col(high) == F.col("_high")) & (F.col("_o") == F.col("_best"))).select(id_col, high, other)
