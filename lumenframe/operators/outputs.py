"""What attempts at one task have in common: distinct outputs, failure codes, sub-passes, prefill by cache state; and rollups of re-graded and retried rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import failures, graders, stats
from lumenframe.functions import json_values as jv
from lumenframe.operators import verdicts
from lumenframe.operators.runs import measured


def distinct_outputs(runs: DataFrame, by: list[str]) -> DataFrame:
    """How many outputs differ as they are, after clean-up, and as JSON values."""
    t = F.col("raw_output")
    own = jv.last_key_wins(runs.sparkSession, lambda: runs.select(*by, F.sha2(t, 256).alias("raw"), F.sha2(graders.clean(t), 256).alias("clean"), F.sha2(jv.canonical(t), 256).alias("json")))
    # distinct in two steps: (task, kind, hash) first, so that no set of a large group is held in one row
    flat = own.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("hash")) for k in ("raw", "clean", "json")])).alias("x"))
    each = flat.select(*by, "x.*").distinct()
    return each.groupBy(*by).agg(*[F.count_if(F.col("kind") == k).alias(f"distinct_{k}") for k in ("raw", "clean", "json")])


def failure_codes(runs: DataFrame, by: list[str]) -> DataFrame:
    """A row per failure signature with its count."""
    failed = runs.select(*by, F.explode(F.filter("details", lambda d: ~F.coalesce(d["passed"], F.lit(True)))).alias("d"))
    code = verdicts.failure_signature(F.col("d.grader_type"), F.col("d.violations"), F.col("d.detail"))
    return failed.groupBy(*by, code.alias("code")).agg(F.count("*").alias("n"))


def sub_passes(runs: DataFrame, by: list[str]) -> DataFrame:
    """Rows with results other than a judge's, those whose results all passed, and rows left to a judge."""
    own = F.filter("details", lambda d: d["grader_type"] != "rubric_judge")
    passed = (F.size(own) > 0) & F.forall(own, lambda d: F.coalesce(d["passed"], F.lit(False)))
    return runs.groupBy(*by).agg(
        F.count_if(F.size(own) > 0).alias("det_total"), F.count_if(passed).alias("det_passes"), F.count_if(F.col("verdict") == "NEEDS_JUDGE").alias("deferrals")
    )


def prefill_by_state(runs: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean and spread of the prefill rate by cache state; below two values the status says so and the figures are null."""
    state = F.coalesce("prefill_cache_state", F.lit("UNKNOWN"))
    enough = F.count("prefill_tok_s") >= 2
    return runs.groupBy(*by, state.alias("state")).agg(
        F.count("*").alias("rows"), F.count("prefill_tok_s").alias("n"), F.when(enough, "ok").otherwise("insufficient_n").alias("status"),
        F.round(F.when(enough, F.avg("prefill_tok_s")), 6).alias("mean"), F.round(stats.pstdev("prefill_tok_s"), 6).alias("stdev"),
    )


def uncached_by_state(runs: DataFrame, by: list[str]) -> DataFrame:
    """A row per cache state and uncached count that is known, with how often it was met: the list, as a table."""
    state = F.coalesce("prefill_cache_state", F.lit("UNKNOWN"))
    return runs.where("uncached_count is not null").groupBy(*by, state.alias("state"), "uncached_count").agg(F.count("*").alias("n"))


def content_changes(retried: DataFrame, baseline: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """Retried rows against their baseline text ('' without one): recovered, still failing, buckets of the recovered, rates.

    ``bucket`` reads ``old`` and ``new``: contract_only, content_change or unknown.
    """
    old = baseline.select(*keys, F.col("raw_output").alias("old"))
    both = retried.withColumnRenamed("raw_output", "new").join(old, keys, "left").withColumn("old", F.coalesce("old", F.lit("")))
    won = F.col("verdict") == "PASS"
    b = both.withColumn("bucket", F.when(won, bucket))
    n, wins = F.count("*"), F.count_if(won)
    return b.agg(
        n.alias("total"), wins.alias("recovered"), (n - wins).alias("still_fail"), F.round(stats.rate(wins, n), 4).alias("recovery_rate"),
        *[F.count_if(F.col("bucket") == k).alias(k) for k in ("contract_only", "content_change", "unknown")],
    )


def uplift(baseline: DataFrame, retried: DataFrame, keys: list[str]) -> DataFrame:
    """The pass rate of a population before, and after its retried rows replace their verdicts."""
    new = retried.select(*keys, F.col("verdict").alias("new"))
    both = baseline.join(new, keys, "left")
    before, after = F.count_if(F.col("verdict") == "PASS"), F.count_if(F.coalesce("new", "verdict") == "PASS")
    rate = lambda x: F.round(stats.rate(x, F.count("*")), 4)
    return both.agg(before.alias("passes"), after.alias("passes_after"), rate(before).alias("rate"), rate(after).alias("rate_after"), rate(after - before).alias("uplift"))


def with_modes(failed: DataFrame) -> DataFrame:
    """Failed rows with the one failure mode of each."""
    return failed.withColumn("mode", verdicts.row_mode(failures.row_modes(F.col("details"), F.col("raw_output"))))


def mode_counts(failed: DataFrame) -> DataFrame:
    """Failed rows by status and mode."""
    return failed.groupBy("grading_status", "mode").agg(F.count("*").alias("n"))


def regraded(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per model, over re-graded verdicts: deterministic tasks, trials, passes, any and all passed; judge tasks and rows that were not deferred."""
    own = measured(runs).join(tasks.select("task_id", "grading_status"), "task_id").where(F.col("grading_status").isin("READY_DETERMINISTIC", "READY_JUDGE"))
    won, det = F.col("verdict") == "PASS", F.col("grading_status") == "READY_DETERMINISTIC"
    by = own.groupBy("model_config_id", "task_id", det.alias("det")).agg(
        F.count("*").alias("n"), F.count_if(won).alias("p"), F.bool_or(won).alias("any"), F.bool_and(won).alias("all"), F.count_if(F.col("verdict") != "NEEDS_JUDGE").alias("kept")
    )
    d = F.col("det")
    out = by.groupBy("model_config_id").agg(
        F.count_if(d).alias("det_tasks"), F.coalesce(F.sum(F.when(d, F.col("n"))), F.lit(0)).alias("det_trials"), F.coalesce(F.sum(F.when(d, F.col("p"))), F.lit(0)).alias("passes"),
        F.count_if(d & F.col("any")).alias("any_pass"), F.count_if(d & F.col("all")).alias("all_pass"), F.count_if(~d).alias("judge_tasks"),
        F.coalesce(F.sum(F.when(~d, F.col("kept"))), F.lit(0)).alias("non_deferrals"),
    )
    return out.withColumn("accuracy", F.round(stats.rate(F.col("passes"), F.col("det_trials")), 9))


def quant_pairs(comparisons: DataFrame) -> DataFrame:
    """Comparison rows (comparison, strict_b, strict_c, deltas, p) as pair summaries: the net gain of tasks beside what the comparison says."""
    return comparisons.withColumn("net_task_gain", F.col("strict_c") - F.col("strict_b"))


def rubric_results(results: DataFrame) -> DataFrame:
    """(call, criterion, observed, desired, confidence, abstain) -> per call: criteria passed, and whether a person must decide."""
    unsure = F.bool_or(F.col("abstain") | (F.col("confidence") == "low"))
    return results.groupBy("call_id").agg(
        F.count("*").alias("criteria"), F.count_if(F.col("observed") == F.col("desired")).alias("passed"),
        F.when(unsure, "ADJUDICATION_REQUIRED").otherwise("JUDGE_RESULT").alias("status"),
    )


def spec_audit(tasks: DataFrame, graders: DataFrame) -> DataFrame:
    """Tasks by class and status, and those with more than one grader."""
    n = graders.groupBy("task_id").agg(F.count("*").alias("graders"))
    return tasks.join(n, "task_id", "left").groupBy("primary_class", "grading_status").agg(
        F.count("*").alias("tasks"), F.count_if(F.col("graders") > 1).alias("multi_grader")
    )


def distribution_audit(rows: DataFrame, column: str, expected: dict[str, int]) -> DataFrame:
    """Counts by value against those expected, values that only one side has included."""
    spark = rows.sparkSession
    want = spark.createDataFrame(sorted(expected.items()), f"{column} string, expected bigint")
    got = rows.groupBy(F.col(column).cast("string").alias(column)).agg(F.count("*").alias("n"))
    out = want.join(got, column, "full_outer").select(column, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("ok", F.col("expected") == F.col("n"))
