"""Mixing sources to target weights by Pfair scheduling of blocks.

Each source's rows, in a fixed hashed order, form blocks. In the ideal mix every
source that still has blocks is served at its exact weight over the weights of
those left, so source i with weight w and b blocks has got min(b, w * v) of them
when slot T(v) = sum of all min(b, w * v) is reached. Block k has the window
[floor(T(k / w)), ceil(T((k + 1) / w))): released at its start, due at its end.
Earliest deadline first among released blocks keeps every source within one
block of its ideal share at every slot of the whole schedule, sources that run
out included. Every row is in the result once.

A fold in SQL goes over the slots once and keeps the state of each period's
start only; the slots of the periods are then made from those side by side.
The one task of the first fold reads no rows: its steps are the blocks, at most
``MOST_BLOCKS`` of them (blocks grow with a table beyond that). Rows are
numbered within buckets of a bounded size, with offsets from bucket counts, so a
hot source is never one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import KEY, documents, let, light, numbered, stage_table

RESOLUTION, BLOCK_ROWS, BUCKET_ROWS, MOST_BLOCKS = 256, 4, 512, 1 << 22


#: Floats this near to a whole slot are that slot.
NEAR = 1e-6


def target_weights(counts: DataFrame, weights: dict[str, float] | None, power: float) -> DataFrame:
    """(source, n) -> (source, n, a): exact weights of sum 1.

    Given weights are used as they are; a source without one gets the mean of
    the given, and one of weight 0 comes after the others. Without ``weights``:
    proportional to n ** power.
    """
    w = F.pow(F.col("n").cast("double"), F.lit(power))
    if weights:
        given = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()])
        w = F.coalesce(given, F.lit(sum(weights.values()) / len(weights)))
    total = counts.agg(F.sum(w)).first()[0] or 1.0
    return counts.select("source", "n", F.greatest(F.lit(1e-12), w / F.lit(float(total))).alias("a"))


def slots(sources: DataFrame, block_rows: int, resolution: int) -> DataFrame:
    """(source, n, a) -> rows (period, slot, source, block): all of the schedule, in periods of ``resolution`` slots."""
    blocks = F.ceil(F.col("n") / block_rows).cast("bigint")
    one = sources.select(F.struct("source", F.col("a").alias("w"), blocks.alias("b"), (blocks / F.col("a")).alias("r")).alias("x"))
    one = one.agg(F.sort_array(F.collect_list("x")).alias("left")).where(F.size("left") > 0)
    one = one.withColumn("total", F.aggregate("left", F.lit(0).cast("bigint"), lambda acc, x: acc + x["b"]))
    left, total = F.col("left"), F.col("total")

    def slot_of(v: Column) -> Column:
        return F.aggregate(left, F.lit(0.0), lambda acc, s: acc + s["w"] * F.least(v, s["r"]))

    def waiting(i: Column, k: Column) -> Column:
        w = F.get(left, i)["w"]
        return F.struct(
            k.cast("bigint").alias("c"), F.floor(slot_of(k / w) + NEAR).cast("bigint").alias("from"),
            F.ceil(slot_of((k + 1) / w) - NEAR).cast("bigint").alias("due"),
        )

    def first(state: Column, t: Column) -> Column:
        def of(ok) -> Column:
            return F.array_min(
                F.transform(state, lambda s, i: F.when((s["c"] < F.get(left, i)["b"]) & ok(s), F.struct(s["due"].alias("d"), i.alias("i"))))
            )

        return F.coalesce(of(lambda s: s["from"] <= t), of(lambda s: F.lit(True)))

    def served(state: Column, x: Column) -> Column:
        return F.transform(state, lambda s, i: F.when(i == x["i"], waiting(i, s["c"] + 1)).otherwise(s))

    def times(period: Column) -> Column:
        return F.sequence(period * resolution, F.least((period + 1) * resolution, total) - 1)

    def go_on(acc: Column, period: Column) -> Column:
        end = F.aggregate(times(period), acc["now"], lambda state, t: let(first(state, t), lambda x: served(state, x)))
        return F.struct(end.alias("now"), F.concat(acc["starts"], F.array(acc["now"])).alias("starts"))

    zero = F.transform(left, lambda s, i: waiting(i, F.lit(0)))
    none = F.array().cast("array<array<struct<c:bigint,from:bigint,due:bigint>>>")
    periods = F.sequence(F.lit(0).cast("bigint"), F.floor((total - 1) / resolution).cast("bigint"))
    starts = F.aggregate(periods, F.struct(zero.alias("now"), none.alias("starts")), go_on, lambda s: s["starts"])
    starts = one.select("left", "total", F.posexplode(starts).alias("period", "state"))
    starts = stage_table(starts, "states").repartition("period").withColumn("period", F.col("period").cast("bigint"))

    def step(acc: Column, t: Column) -> Column:
        return let(
            first(acc["now"], t),
            lambda x: F.struct(
                served(acc["now"], x).alias("now"),
                F.concat(acc["out"], F.array(F.struct(x["i"].alias("i"), F.get(acc["now"], x["i"])["c"].alias("k")))).alias("out"),
            ),
        )

    begin = F.struct(F.col("state").alias("now"), F.array().cast("array<struct<i:int,k:bigint>>").alias("out"))
    table = F.aggregate(times(F.col("period")), begin, step, lambda s: s["out"])
    return starts.select("period", "left", F.posexplode(table).alias("slot", "x")).select(
        "period", "slot", F.get("left", F.col("x.i"))["source"].alias("source"), F.col("x.k").alias("block")
    )


def schedule(
    docs: DataFrame, source_col: str = "source", order_cols: tuple[str, ...] = ("doc_id",), weights: dict[str, float] | None = None,
    power: float = 0.5, resolution: int = RESOLUTION, block_rows: int | None = None, bucket_rows: int = BUCKET_ROWS, seed: int = 42,
) -> DataFrame:
    """A row per input row: (_f, _i, source, order columns, block, period, slot, in_block, a), the first two the key of ``numbered``.

    ``a`` is the source's exact weight, of sum 1; a period is ``resolution``
    slots; a block is ``block_rows`` rows (BLOCK_ROWS unless given, more in
    tables of over BLOCK_ROWS * MOST_BLOCKS rows). The mixed order is (period, slot, in_block). Within a source, rows are in
    the order of a seeded hash of the order columns, then of the columns, then
    the table's; repeated rows each have a place. A null source is a source. An empty table gives an empty one.
    """
    return _of_rows(numbered(docs), source_col, order_cols, weights, power, resolution, block_rows, bucket_rows, seed)


def _of_rows(
    rows: DataFrame, source_col: str = "source", order_cols: tuple[str, ...] = ("doc_id",), weights: dict[str, float] | None = None,
    power: float = 0.5, resolution: int = RESOLUTION, block_rows: int | None = None, bucket_rows: int = BUCKET_ROWS, seed: int = 42,
) -> DataFrame:
    base = rows.select(
        *KEY, F.coalesce(F.col("_all")[source_col].cast("string"), F.lit("")).alias("source"),
        *[F.col("_all")[c].alias(f"o{i}") for i, c in enumerate(order_cols)],
    ).withColumn("h", F.xxhash64(F.lit(seed), *[f"o{i}" for i in range(len(order_cols))]))
    base = stage_table(base, "mix")
    n = stage_table(base.groupBy("source").agg(F.count("*").alias("n")), "sizes")
    block_rows = block_rows or max(BLOCK_ROWS, -(-(n.agg(F.sum("n")).first()[0] or 0) // MOST_BLOCKS))
    sources = stage_table(target_weights(n, weights, power), "weights")
    table = stage_table(slots(sources, block_rows, resolution), "slots")
    # buckets in the order of the hash; their number follows the source's size
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(bucket_rows)))).cast("int")
    placed = base.join(sources, "source")
    # the top bits of the hash as an unsigned number
    top = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(2**63))), 32)
    placed = placed.withColumn("bucket", F.floor(top * F.pow(F.lit(2.0), bits) / F.lit(2.0**32)).cast("bigint"))
    counts = placed.groupBy("source", "bucket").agg(F.count("*").alias("c"))
    before = counts.withColumn(
        "before", F.sum("c").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    ).select("source", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", *[f"o{i}" for i in range(len(order_cols))], *KEY)
    at = placed.withColumn("rn", F.row_number().over(inside)).join(before, ["source", "bucket"])
    at = at.withColumn("at", F.col("before") + F.col("rn") - 1)
    at = at.withColumn("block", F.floor(F.col("at") / block_rows).cast("bigint")).withColumn("in_block", (F.col("at") % block_rows).cast("int"))
    out = at.join(table, ["source", "block"])
    return out.select(
        *KEY, "source", *[F.col(f"o{i}").alias(c) for i, c in enumerate(order_cols)], "block", "period", "slot", "in_block", "a"
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """``docs`` in the mixed order. Every row stays, repeated ones too; an empty table gives an empty one.

    Slots are dense, so a row's range of them is its partition: nothing is sampled to deal the rows out, and
    texts move once; they move twice in tables whose order is too long to broadcast.
    """
    rows = numbered(docs)
    own = stage_table(_of_rows(rows, **how).select(*KEY, "period", "slot", "in_block"), "order")
    place = F.col("period") * how.get("resolution", RESOLUTION) + F.col("slot")
    slots_used = (own.agg(F.max(place)).first()[0] or 0) + 1
    tasks = min(slots_used, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.floor(place * tasks / slots_used).cast("int")
    dealt = rows.join(light(own), KEY).withColumn("_at", at).repartitionById(tasks, "_at")
    return dealt.sortWithinPartitions("period", "slot", "in_block").select("_all.*")


def op10_pfair_mix(spark, sf_dir):
    return schedule(documents(spark, sf_dir)).select("doc_id", "source", "block", "period", "slot", "in_block", F.col("a").alias("weight"))
