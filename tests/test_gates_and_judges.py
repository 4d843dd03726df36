"""Gates and judge responses on small tables."""

import json

from pyspark.sql import functions as F

from lumenframe.functions import judge_responses as jr
from lumenframe.operators import gates


def test_gates(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(2, None), (3, "z")], "id int, v string")
    assert gates.identity_mismatch(a, b, ["id"]).first().asDict() == {"only_left": 1, "only_right": 1, "ok": False}
    assert gates.identity_mismatch(a, a, ["id"]).first()["ok"]
    assert sorted((r["v"] or "", r["n"]) for r in gates.unknown_values(a, "v", ["x"]).collect()) == [("", 1), ("y", 1)]
    assert gates.checks(a, {"named": F.col("v").isNotNull(), "small": F.col("id") < 9}).first().asDict() == {"rows": 3, "named": 1, "small": 0, "ok": False}
    assert gates.checks(a.where("false"), {"named": F.col("v").isNotNull()}).first()["ok"]
    assert [r["id"] for r in gates.one_value(a.fillna("q"), ["id"], "v").collect()] == [2]
    assert [r["id"] for r in gates.prompt_invariance(a, b, ["id"], "v").collect()] == [2]


def test_resolution(spark):
    asked = spark.createDataFrame([(i, "c") for i in range(4)], "e int, c string")
    stored = spark.createDataFrame([(1, "c", None), (2, "c", "p"), (3, "d", "p")], "e int, c string, p string")
    got = {r["e"]: r["resolution"] for r in gates.resolution(asked, stored, "e", "c", "p").collect()}
    assert got == {0: "CREATE", 1: "LEGACY", 2: "RESUME", 3: "MISMATCH"}


def test_rubric_responses(spark):
    good = {"schema_version": "judge-rubric-v1", "abstain": False, "criteria": {"c1": {"observed": True, "confidence": "low", "evidence": ["said", "not there"]}}}
    listed = good | {"criteria": [{"id": "c1", "observed": False, "confidence": "high", "evidence": {"odd": 1}}]}
    rows = [json.dumps(good), "```" + json.dumps(listed) + "```", json.dumps(good | {"criteria": {}}), json.dumps(good | {"abstain": "no"}), "nope", None]
    df = spark.createDataFrame([(i, r, ["c1"], "what was said") for i, r in enumerate(rows)], "i int, r string, c array<string>, t string")
    got = [r[0] for r in df.orderBy("i").select(jr.parse_rubric(F.col("r"), F.col("c"), F.col("t"))).collect()]
    assert got[0]["error"] is None and got[0]["pruned_evidence"] == 1 and got[0]["criteria"]["c1"]["evidence"] == ["said"]
    assert got[1]["criteria"]["c1"]["observed"] is False and got[1]["pruned_evidence"] == 1
    assert [g["error"] for g in got[2:]] == ["other criteria than the rubric's", "abstain is neither true nor false", "the response is no JSON", "the response is no JSON"]


def test_pair_responses(spark):
    base = {"schema_version": "judge-pair-v1", "decision": "A", "confidence": "high", "abstain": False}
    shapes = [[{"label": "A", "text": "left"}, {"candidate": "B", "quote": "left"}], {"candidate": "A", "quote": "left"}, {"A": "left", "B": {"quote": "right"}}, None]
    rows = [json.dumps(base | {"evidence": s}) for s in shapes] + [json.dumps(base | {"decision": "C"})]
    df = spark.createDataFrame([(i, r, "left", "right") for i, r in enumerate(rows)], "i int, r string, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(jr.parse_pair(F.col("r"), F.col("a"), F.col("b"))).collect()]
    assert [(len(g["evidence"]), g["pruned_evidence"]) for g in got[:4]] == [(1, 1), (1, 0), (2, 0), (0, 1)]
    assert got[4]["error"] == "no such decision" and got[0]["decision"] == "A"
