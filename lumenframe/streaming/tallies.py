"""Streaming tallies over append-only JSON event logs: each function takes a streaming (or batch) DataFrame.

State is bounded where the input allows it: a tally holds a row per key, and
``first_seen`` holds identities no longer than its watermark, if one is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RETRY_SCHEMA = (
    "timestamp timestamp, execution_id string, model_config_id string, stage string, task_id string, trial int, attempt int, "
    "error_type string, action string, backoff_seconds double"
)
RELOAD_MS = 1000.0


def event_log(spark: SparkSession, folder: str, schema: str = RETRY_SCHEMA, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the JSON lines files in a folder; lines that don't parse have null columns."""
    read = spark.readStream.schema(schema)
    if files_per_batch:
        read = read.option("maxFilesPerTrigger", files_per_batch)
    return read.json(folder)


def retries_by_error(events: DataFrame) -> DataFrame:
    """Events and waiting time by error type (complete or update mode)."""
    return events.groupBy("error_type").agg(F.count("*").alias("n"), F.coalesce(F.sum("backoff_seconds"), F.lit(0.0)).alias("backoff_seconds"))


def retries_by_window(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """The same by time window, for append mode: rows that come later than ``late`` are not counted."""
    by = events.withWatermark("timestamp", late).groupBy(F.window("timestamp", width).alias("w"), "error_type").agg(F.count("*").alias("n"))
    return by.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "error_type", "n")


def first_seen(rows: DataFrame, identity: list[str], time_col: str | None = None, late: str = "1 day") -> DataFrame:
    """The first row of each identity: with the query's checkpoint, a resumed run skips what is done.

    With ``time_col``, identities are forgotten after ``late``; without it, they are all kept.
    """
    if time_col:
        return rows.withWatermark(time_col, late).dropDuplicatesWithinWatermark(identity)
    return rows.dropDuplicates(identity)


def reloads(rows: DataFrame, load_ms: str = "server_load_duration_ms", limit: float = RELOAD_MS) -> DataFrame:
    """Rows whose model was loaded anew: it must be warmed again. Stateless."""
    return rows.where(F.col(load_ms) > limit)
