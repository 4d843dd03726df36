"""The ``attempts`` and ``tasks`` tables: one row per generation with outputs and grader results, made from ``events``, the same on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.plans.trials import table

RESULTS = "array<struct<grader_type:string,passed:boolean,detail:string,violations:array<string>>>"

#: DuckDB forms. Written apart from the plans below.
ATTEMPTS_SQL = """ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
attempts AS (
  SELECT event_id AS run_id, 'spec__' || event_type AS experiment_id, event_type AS model_config_id, user_id AS task_id,
    CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS INT) AS trial,
    event_id % 17 = 0 AS is_warmup, CASE WHEN event_id % 17 = 0 THEN 'WARMUP' ELSE 'BASELINE' END AS run_kind,
    CASE WHEN value < 1 THEN 'ERROR' ELSE 'COMPLETE' END AS status,
    CASE WHEN user_id % 15 = 0 AND event_id % 2 = 0 THEN 'NEEDS_JUDGE' WHEN value >= 20 THEN 'PASS' WHEN value < 3 THEN 'ERROR' ELSE 'FAIL' END AS verdict,
    CASE event_id % 5 WHEN 0 THEN '{"k": ' || (k % 3) || ', "a": 1}' WHEN 1 THEN '{"a":1,"k":' || (k % 3) || '}' WHEN 2 THEN ' answer ' || (k % 4)
      WHEN 3 THEN 'answer ' || (k % 4) || chr(13) || chr(10) ELSE 'Answer: ' || (k % 4) END AS raw_output,
    [{'grader_type': 'exact', 'passed': value >= 20, 'detail': 'expected x', 'violations': []::VARCHAR[]},
     {'grader_type': 'constraints', 'passed': k % 4 <> 0, 'detail': 'violations', 'violations': CASE WHEN k % 4 = 0 THEN ['word_count: ' || (k % 7), 'more'] ELSE []::VARCHAR[] END}]
      || CASE WHEN user_id % 15 = 0 THEN [{'grader_type': 'rubric_judge', 'passed': true, 'detail': 'left to a judge', 'violations': []::VARCHAR[]}] ELSE [] END AS details,
    CASE event_id % 4 WHEN 0 THEN 'UNCACHED' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'FULLY_CACHED' END AS prefill_cache_state,
    CASE WHEN event_id % 7 <> 0 THEN value * 2 END AS prefill_tok_s, CASE WHEN event_id % 6 <> 0 THEN k END AS uncached_count,
    CASE WHEN event_id % 3 <> 0 THEN 'digest-' || event_type END AS model_digest, CASE WHEN event_id % 5 <> 0 THEN CAST(k AS DOUBLE) * 10 END AS peak_vram,
    CASE WHEN event_id % 1009 = 0 THEN 'other' ELSE 'config' END AS run_config_hash, CASE WHEN event_id % 2003 = 0 THEN 0.7 ELSE 0.0 END AS temperature, value, k
  FROM ev),
tasks AS (
  SELECT user_id AS task_id, CASE WHEN user_id % 15 = 0 THEN 'READY_JUDGE' WHEN user_id % 29 = 0 THEN 'PENDING_SPECIFICATION' ELSE 'READY_DETERMINISTIC' END AS grading_status,
    CASE user_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'numeric' WHEN 2 THEN 'structured' ELSE 'constraints' END AS primary_class,
    CASE user_id % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'stress' ELSE 'coding' END AS suite, CASE WHEN user_id % 2 = 0 THEN 'hard' ELSE 'easy' END AS difficulty,
    CAST(row_number() OVER (ORDER BY user_id) AS INT) AS ordinal
  FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 13 <> 0))"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per generation: identity, kind, status, verdict, output, grader results, cache state and evidence."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    at = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    n, task, value, k = F.col("event_id"), F.col("user_id"), F.col("value"), F.col("k")
    text = lambda c: c.cast("string")
    said = (
        F.when(n % 5 == 0, F.concat(F.lit('{"k": '), text(k % 3), F.lit(', "a": 1}')))
        .when(n % 5 == 1, F.concat(F.lit('{"a":1,"k":'), text(k % 3), F.lit("}")))
        .when(n % 5 == 2, F.concat(F.lit(" answer "), text(k % 4)))
        .when(n % 5 == 3, F.concat(F.lit("answer "), text(k % 4), F.lit("\r\n")))
        .otherwise(F.concat(F.lit("Answer: "), text(k % 4)))
    )
    none = F.array().cast("array<string>")
    result = lambda kind, ok, detail, broken: F.struct(F.lit(kind), ok, F.lit(detail), broken)
    graded = F.array(
        result("exact", value >= 20, "expected x", none),
        result("constraints", k % 4 != 0, "violations", F.when(k % 4 == 0, F.array(F.concat(F.lit("word_count: "), text(k % 7)), F.lit("more"))).otherwise(none)),
    ).cast(RESULTS)
    judge = F.array(result("rubric_judge", F.lit(True), "left to a judge", none)).cast(RESULTS)
    return e.select(
        n.alias("run_id"), F.concat_ws("__", F.lit("spec"), "event_type").alias("experiment_id"), F.col("event_type").alias("model_config_id"),
        task.alias("task_id"), F.row_number().over(at).alias("trial"), (n % 17 == 0).alias("is_warmup"),
        F.when(n % 17 == 0, "WARMUP").otherwise("BASELINE").alias("run_kind"), F.when(value < 1, "ERROR").otherwise("COMPLETE").alias("status"),
        F.when((task % 15 == 0) & (n % 2 == 0), "NEEDS_JUDGE").when(value >= 20, "PASS").when(value < 3, "ERROR").otherwise("FAIL").alias("verdict"),
        said.alias("raw_output"), F.when(task % 15 == 0, F.concat(graded, judge)).otherwise(graded).alias("details"),
        F.when(n % 4 == 0, "UNCACHED").when(n % 4 == 1, "PARTIAL").when(n % 4 == 2, "FULLY_CACHED").alias("prefill_cache_state"),
        F.when(n % 7 != 0, value * 2).alias("prefill_tok_s"), F.when(n % 6 != 0, k).alias("uncached_count"),
        F.when(n % 3 != 0, F.concat(F.lit("digest-"), "event_type")).alias("model_digest"), F.when(n % 5 != 0, k.cast("double") * 10).alias("peak_vram"),
        F.when(n % 1009 == 0, "other").otherwise("config").alias("run_config_hash"), F.when(n % 2003 == 0, 0.7).otherwise(0.0).alias("temperature"),
        "value", "k",
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per task of the specification; some tasks of the attempts are not in it."""
    t = table(spark, sf_dir, "events").where("user_id % 13 <> 0").select(F.col("user_id").alias("task_id")).distinct()
    x = F.col("task_id")
    order = Window.orderBy("task_id")  # the specification: a row per task
    return t.select(
        "task_id",
        F.when(x % 15 == 0, "READY_JUDGE").when(x % 29 == 0, "PENDING_SPECIFICATION").otherwise("READY_DETERMINISTIC").alias("grading_status"),
        F.when(x % 4 == 0, "exact").when(x % 4 == 1, "numeric").when(x % 4 == 2, "structured").otherwise("constraints").alias("primary_class"),
        F.when(x % 3 == 0, "core").when(x % 3 == 1, "stress").otherwise("coding").alias("suite"),
        F.when(x % 2 == 0, "hard").otherwise("easy").alias("difficulty"), F.row_number().over(order).alias("ordinal"),
    )
