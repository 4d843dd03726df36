"""Graders by a table of specifications give what graders by constants give."""

import json
import time

from constraint_cases import CASES, PAGE
from pyspark.sql import functions as F

from lumenframe.functions import graders, spec_rows, text

FACTS = {"type": "fact_check", "required_facts": ["Tea", "zzz"], "required_fact_groups": [{"any_of": ["milk", "plan"]}, {"any_of": ["q1", "q2"]}], "forbidden_facts": ["stop", "coffee"], "word_limit": {"max": 5}, "bullet_word_limit": {"max": 3}, "sentence_count": {"value": 7}}
SPECS = {
    "e1": [{"type": "exact", "expected": "F", "accepted_alternates": ["café", 3], "case_sensitive": False, "numeric_alias_match": True}],
    "e2": [{"type": "exact", "expected": " x\r\n", "trim_outer_whitespace": False}, {"type": "exact", "expected": "7"}],
    "n": [{"type": "numeric", "expected": 100, "absolute_tolerance": 1, "relative_tolerance": 0.02}, {"type": "rubric_judge", "criteria": ["a"]}, {"type": "rubric_judge"}],
    "t1": [{"type": "time", "expected": "07:05", "precision": "minute"}, {"type": "time", "expected": "7:05 PM", "parsing": ["H:MM AM"]}, {"type": "time", "expected": "soon"}],
    "f": [FACTS, {"type": "refusal", "refusal_expected": True}, {"type": "refusal", "refusal_expected": False}],
    "s": [{"type": "structured", "required_fields": ["a"], "expected_output": {"a": [1, "x"]}}, {"type": "tool_call", "expected_output": {"function": "f", "arguments": {"x": 1}}}],
    "none": [],
}
EXTRA = [
    {"kind": "term_occurrence", "term": "Tea", "count": 1, "occurrence": "across_values", "match": "word"}, {"kind": "term_occurrence", "term": "a", "count": 1, "occurrence": "at_least"}, {"kind": "sentence_contains", "all_sentences": True, "term": "e"},
    {"kind": "sentence_contains", "terms": ["x"]}, {"kind": "item_sentence_count", "value": 2}, {"kind": "bullet_prefix", "index": -1, "prefix": "plain"}, {"kind": "what"}, {"kind": "item_prefix", "index": 0, "prefix": "First"}, {"kind": "line_contains", "lines": ["A", "Z"], "term": "STOP"},
]
OUTPUTS = [
    PAGE, PAGE + " \r\n", "", None, "f", " F ", "café", "it is 3.0", " x\r\n", "x", "7", "101.5", "97.9.", "about 100", "07:05", "07:05:30", "7:05 pm", "19:05", "25:99", "Unknown.", "cannot_determine", "UNABLE TO ANSWER __", "I know",
    '{"a": ["x", "1"]}', '```json\n{"function": "f", "arguments": {"x": "1"}}\n```', '{"b": "tea one", "c": "Tea", "d": 3}', "Tea plan milk q2", "1. One. Two!\n2. Three. Four?", "- **B** x\n* plain y", "a\x00b c",
]


def test_equal_to_constants(spark):
    cases = [dict(c, kind=k) for k, good, bad, _ in CASES for c in (good, bad) if c is not None] + EXTRA
    specs = SPECS | {f"c{i}": [{"type": "constraints", "constraints": cases[i : i + 3]}] for i in range(0, len(cases), 3)}
    rows = spark.createDataFrame([(k, i, o) for k in [*specs, "unknown"] for i, o in enumerate(OUTPUTS)], "task_id string, i int, said string").repartition(8).cache()
    table = spark.createDataFrame([(k, json.dumps(v)) for k, v in specs.items()], "task_id string, spec string")
    got = {(r["task_id"], r["i"]): r["results"] for r in spec_rows.grade(rows, spec_rows.compiled(table), "said").collect()}
    assert all(got["unknown", i] is None and got["none", i] == [] for i in range(len(OUTPUTS)))
    for task, own in specs.items():
        if own:
            want = rows.where(F.col("task_id") == task).select("i", graders.results(F.col("said"), own).alias("r")).collect()
            for r in want:
                assert got[task, r["i"]] == r["r"], (task, OUTPUTS[r["i"]], got[task, r["i"]], r["r"])


def test_each_kind(spark):
    """Both cases of every kind over the page, and what the violations say."""
    page = spark.range(1).select(text.normalised(F.concat(F.lit(PAGE), F.lit(" \r\n"))).alias("t"))
    asked = [(kind, case, found) for kind, good, bad, found in CASES for case, found in ((good, ""), (bad, found)) if case is not None]
    each = [F.struct(text.holds(F.col("t"), {"kind": k} | c).alias("h"), F.array_join(text.violations(F.col("t"), [{"kind": k} | c]), ";").alias("v")) for k, c, _ in asked]
    got = page.select(F.array(*each).alias("x")).first()["x"]
    assert [(r["h"], r["v"]) for r in got] == [(found == "", found) for _, _, found in asked]


def test_tabs_beside_bullet_marks_stay(spark):
    rows = spark.createDataFrame([("\t- Bold",), ("-\tBold",), (" -  * Bold",), ("- Bold",)], "t string")
    got = [r[0] for r in rows.select(text.holds(F.concat(F.lit("x\n"), F.col("t")), {"kind": "bullet_prefix", "index": 1, "prefix": "Bold"})).collect()]
    assert got == [False, False, True, True]


def plan_seconds(spark, n):
    """Seconds to plan the grading by n specifications, and the length of the plan."""
    made = [(f"k{i}", json.dumps([{"type": "numeric", "expected": i}, {"type": "constraints", "constraints": [{"kind": "word_limit", "max": i % 3}]}])) for i in range(n)]
    table = spark.createDataFrame(made, "task_id string, spec string")
    outputs = spark.range(2 * n).select(F.concat(F.lit("k"), (F.col("id") % n).cast("string")).alias("task_id"), F.col("id"), (F.col("id") % 7).cast("string").alias("said"))
    began = time.time()
    out = spec_rows.grade(outputs, spec_rows.compiled(table), "said")
    length = len(out._jdf.queryExecution().executedPlan().toString())
    return time.time() - began, length, out


def test_plan_does_not_grow(spark):
    few, short, _ = plan_seconds(spark, 10)
    many, length, out = plan_seconds(spark, 10_000)
    assert length < 1.1 * short and many < 1.5 * few + 2
    wrong = (F.col("results")[0]["passed"] != (F.col("id") % 10_000 == F.col("id") % 7)) | (F.col("results")[1]["passed"] != (F.col("id") % 10_000 % 3 >= 1))
    assert out.where(wrong).count() == 0
