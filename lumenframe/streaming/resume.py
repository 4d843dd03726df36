"""Runs that stop and go on: identities that are done, reloads since the last warm-up, batches that are committed once.

Each stateful operator has a batch form that gives the same rows, whatever the
batches of the stream were.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from lumenframe.operators.ordering import placed, running_total, same_keys

RELOAD_MS = 1000.0
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SEGMENT = "segment long, rows long, reloads long, closed_by long"


class NotDone(StatefulProcessor):
    """Rows of one identity until one is complete; later ones are repeats of work that is done.

    State is one truth value an identity, forgotten ``ttl_ms`` after it was set.
    """

    def __init__(self, order: str, status: str, done: str, ttl_ms: int | None):
        self.order, self.status, self.done, self.ttl_ms = order, status, done, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("done", "done boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            return
        own = pd.concat(list(rows)).sort_values(self.order, kind="stable")  # one identity of one batch
        hit = (own[self.status] == self.done).to_numpy()
        if hit.any():
            self.seen.update((True,))
            own = own.iloc[: int(hit.argmax()) + 1]
        yield own

    def close(self) -> None:
        pass


class SinceWarmUp(StatefulProcessor):
    """Of each key, a row per warm-up that ends a stretch of runs: how many ran since the one before, and how many of them had to load the model.

    State is four numbers a key. A timer forgets a key that is idle for
    ``idle_ms``; its open stretch comes out then, closed by no run.
    """

    def __init__(self, order: str, warm: str, load: str, limit: float, idle_ms: int | None):
        self.order, self.warm, self.load, self.limit, self.idle_ms = order, warm, load, limit, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stretch = handle.getValueState("stretch", "segment long, rows long, reloads long")

    def _out(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=["_key", "segment", "rows", "reloads", "closed_by"]).astype({"closed_by": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat([b[[self.order, self.warm, self.load]] for b in rows]).sort_values(self.order, kind="stable")
        segment, n, reloads = self.stretch.get() if self.stretch.exists() else (0, 0, 0)
        out = []
        for at, warm, load in own.itertuples(index=False):
            if warm:
                out.append((segment, n, reloads, at))
                segment, n, reloads = segment + 1, 0, 0
            else:
                n, reloads = n + 1, reloads + int(load is not None and load == load and load > self.limit)
        self.stretch.update((segment, n, reloads))
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if out:
            yield self._out(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.stretch.exists():
            last = self.stretch.get()
            self.stretch.clear()
            yield self._out(key, [(*last, None)])

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: StructType | str, timers: str = "None") -> DataFrame:
    """State by the keys' JSON: null keys are keys like others."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)  # the store that this kind of state needs
    keyed = rows.withColumn("_key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    return keyed.groupBy("_key").transformWithStateInPandas(processor, outputStructType=schema, outputMode="append", timeMode=timers)


def not_done(rows: DataFrame, identity: list[str], order: str = "run_id", status: str = "status", done: str = "COMPLETE", ttl_ms: int | None = None) -> DataFrame:
    """A stream without repeats: rows of each identity in order, up to the first complete one. Rows of a batch count before those of later batches."""
    return _stateful(rows, identity, NotDone(order, status, done, ttl_ms), rows.schema, "ProcessingTime" if ttl_ms else "None")


def since_warm_up(
    rows: DataFrame, keys: list[str], order: str = "run_id", warm: str = "is_warmup", load: str = "server_load_duration_ms", limit: float = RELOAD_MS, idle_ms: int | None = None,
) -> DataFrame:
    """(keys, segment, rows, reloads, closed_by) of a stream: a row for each stretch between warm-ups, when it ends."""
    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    out = _stateful(rows, keys, SinceWarmUp(order, warm, load, limit, idle_ms), f"_key string, {SEGMENT}", "ProcessingTime" if idle_ms else "None")
    return out.select(*[F.from_json("_key", types)[k].alias(k) for k in keys], "segment", "rows", "reloads", "closed_by")


def not_done_batch(rows: DataFrame, identity: list[str], order: str = "run_id", status: str = "status", done: str = "COMPLETE") -> DataFrame:
    """What ``not_done`` gives of rows in order: none behind the first complete row of its identity."""
    first = rows.where(F.col(status) == done).groupBy(*identity).agg(F.min(order).alias("_first"))
    both = rows.alias("l").join(first.alias("r"), same_keys("l", "r", identity), "left")
    return both.where(F.col("r._first").isNull() | (F.col(f"l.{order}") <= F.col("r._first"))).select("l.*")


def since_warm_up_batch(
    rows: DataFrame, keys: list[str], order: str = "run_id", warm: str = "is_warmup", load: str = "server_load_duration_ms", limit: float = RELOAD_MS,
) -> DataFrame:
    """What ``since_warm_up`` gives of rows in order; a key's rows are dealt over many tasks."""
    own = rows.select(*keys, order, F.col(warm).alias("_warm"), F.coalesce(F.col(load) > limit, F.lit(False)).alias("_slow"))
    run = running_total(placed(own, keys, [order]), keys, F.col("_warm").cast("long"), "_warmed")
    segment = F.col("_warmed") - F.col("_warm").cast("long")
    by = run.groupBy(*keys, segment.alias("segment")).agg(
        F.count_if(~F.col("_warm")).alias("rows"), F.count_if(~F.col("_warm") & F.col("_slow")).alias("reloads"), F.max(F.when(F.col("_warm"), F.col(order))).alias("closed_by")
    )
    return by.where("closed_by is not null")


def commit(batch: DataFrame, batch_id: int, folder: str) -> None:
    """A batch's rows under its number: a batch that runs again after a failure replaces what it wrote, so each row is there once."""
    batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def committed_sink(stream: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a stream into a folder of committed batches; with the same checkpoint it goes on where it stopped."""
    return stream.writeStream.foreachBatch(lambda b, i: commit(b, i, folder)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def committed(spark, folder: str) -> DataFrame:
    """The rows of all committed batches."""
    return spark.read.parquet(folder).drop("batch")
