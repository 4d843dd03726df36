"""The ``trials`` view: evaluation rows made from the ``events`` table, the same on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

#: DuckDB form of ``trials``.
TRIALS_SQL = """trials AS (
  SELECT event_type AS model_config_id, user_id AS task_id,
    CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS INT) AS trial,
    CASE WHEN value >= 20 THEN 'PASS' WHEN value < 3 THEN 'ERROR' ELSE 'FAIL' END AS verdict,
    value AS decode_tok_s,
    CAST(json_extract_string(props, '$.k') AS INT) AS eval_count,
    CASE WHEN user_id % 15 = 0 THEN 'READY_JUDGE' ELSE 'READY_DETERMINISTIC' END AS grading_status,
    CASE user_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'numeric' WHEN 2 THEN 'structured' ELSE 'constraints' END AS primary_class,
    CASE WHEN user_id % 3 = 0 THEN 'hard' ELSE 'easy' END AS difficulty
  FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per attempt: model, task, trial number, verdict, rate, token count, task metadata."""
    at = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    task = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model_config_id"),
        task.alias("task_id"),
        F.row_number().over(at).alias("trial"),
        F.when(F.col("value") >= 20, "PASS").when(F.col("value") < 3, "ERROR").otherwise("FAIL").alias("verdict"),
        F.col("value").alias("decode_tok_s"),
        F.get_json_object("props", "$.k").cast("int").alias("eval_count"),
        F.when(task % 15 == 0, "READY_JUDGE").otherwise("READY_DETERMINISTIC").alias("grading_status"),
        F.when(task % 4 == 0, "exact").when(task % 4 == 1, "numeric").when(task % 4 == 2, "structured").otherwise("constraints").alias("primary_class"),
        F.when(task % 3 == 0, "hard").otherwise("easy").alias("difficulty"),
    )


def views(spark: SparkSession, sf_dir: str) -> SparkSession:
    """Register the tables and ``trials`` as temporary views."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    trials(spark, sf_dir).createOrReplaceTempView("trials")
    return spark
