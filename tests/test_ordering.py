"""Places, totals, hashes and skylines over ranges: exact, and spread where one value or one group fills the table."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import evaluation, hashing, ordering


def spread(ordered):
    """The largest share of rows in one range."""
    sizes = [r["count"] for r in ordered.groupBy(F.shiftright("_at", 33)).count().collect()]
    return max(sizes) / sum(sizes)


@pytest.mark.parametrize("kind", ["one value", "one group", "few values", "nulls"])
def test_places(spark, kind):
    pick = random.Random(4)
    value = {"one value": lambda: 7, "one group": lambda: pick.random(), "few values": lambda: pick.randint(0, 3), "nulls": lambda: pick.choice([None, None, 1])}[kind]
    rows = [(None if kind == "nulls" and i % 3 else "a" if kind != "few values" else pick.choice("abc"), value(), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v double, i int" if kind == "one group" else "g string, v int, i int")
    got = ordering.placed(df, ["g"], ["v"], per_range=100).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["g"]].append((r["place"], r["v"]))
    assert sum(map(len, by.values())) == len(rows)
    for own in by.values():
        assert sorted(p for p, _ in own) == list(range(1, len(own) + 1))
        values = [v for _, v in sorted(own)]
        assert values == sorted(values, key=lambda v: (v is not None, v or 0))
    if kind != "nulls":
        assert spread(ordering.in_ranges(df, ["g", "v"], 100)) <= 1 / 16


def test_places_of_nothing_and_of_repeated_rows(spark):
    none = spark.createDataFrame([], "g string, v int")
    assert ordering.placed(none, ["g"], ["v"]).collect() == [] and ordering.placed(none, [], ["v"]).collect() == []
    same = spark.createDataFrame([("a", 1)] * 50, "g string, v int")
    assert sorted(r["place"] for r in ordering.placed(same, [], [F.desc("v")], per_range=10).collect()) == list(range(1, 51))


def test_running_totals(spark):
    rows = [("a" if i % 7 else None, i, i % 5) for i in range(1000)]
    got = ordering.running_total(ordering.placed(spark.createDataFrame(rows, "g string, i int, x int"), ["g"], ["i"], per_range=50), ["g"], F.col("x"), "t", piece=64).collect()
    total, want = collections.Counter(), {}
    for g, i, x in rows:
        total[g] += x
        want[i] = total[g]
    assert {r["i"]: r["t"] for r in got} == want


def test_hash_streams_groups(spark):
    pick = random.Random(9)
    rows = [(pick.choice([1, 1, 1, 2, None]), pick.choice(["x", None, "é\n", "", "long " * 50]) if i % 5 else f"l{i}", i) for i in range(5000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r["g"]: (r["hash"], r["n"]) for r in hashing.streamed_sha256(spark.createDataFrame(rows, "g int, line string, i int"), ["g"], ["i"], "line").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for g in (1, 2, None):
        lines = [x for k, x, _ in rows if k == g and x is not None]
        want[g] = (hashlib.sha256("\n".join(lines).encode()).hexdigest(), len(lines))
    assert got == want
    none = hashing.streamed_sha256(spark.createDataFrame([], "g int, line string"), ["g"], ["line"], "line")
    assert none.collect() == []


def test_skyline_where_every_point_survives(spark):
    points = spark.range(3000).select(F.col("id"), F.col("id").cast("double").alias("x"), (-F.col("id")).cast("double").alias("y"))
    assert evaluation.skyline(points, "id", "x", "y", per_range=100).count() == 3000
    assert spread(ordering.in_ranges(points.select("x"), [F.desc("x")], 100)) <= 1 / 16
    pick = random.Random(1)
    rows = [(i, pick.choice([None, *range(12)]), pick.choice([None, *range(12)])) for i in range(400)]
    got = {r["id"] for r in evaluation.skyline(spark.createDataFrame(rows, "id int, x int, y int"), "id", "x", "y", smaller_is_better=True, per_range=3).collect()}
    known = [r for r in rows if None not in r]
    assert got == {i for i, x, y in known if not any(a >= x and b <= y and (a, b) != (x, y) for _, a, b in known)}


def test_quartiles_of_ties(spark):
    rows = [("m", 5.0, 3)] * 900 + [("m", 6.0, 3)] * 100 + [("n", float(i), 200) for i in range(7)]
    got = {(r["model_config_id"], r["bucket"]): r for r in evaluation.performance(spark.createDataFrame(rows, "model_config_id string, decode_tok_s double, eval_count int")).collect()}
    assert [got["m", "all"][k] for k in ("n", "median", "p25", "p75", "p95", "mean")] == [1000, 5.0, 5.0, 5.0, 6.0, 5.1]
    assert [got["n", "129+"][k] for k in ("n", "median", "p25", "p75", "p95")] == [7, 3.0, 1.0, 5.0, 6.0] and got["n", "1-4"]["n"] == 0
