"""Statistics, metrics and text predicates against values worked out by hand or by plain Python."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import failures, graders, metrics, stats, text
from lumenframe.operators import evaluation, judging, verdicts


@pytest.mark.parametrize("n", [3, 4, 5, 8, 17])
def test_exclusive_quartiles(spark, n):
    v = [float((i * 37) % 101) for i in range(n)]
    got = spark.createDataFrame([(v,)], "v array<double>").select(
        stats.exclusive_quartile(F.sort_array("v"), 1).alias("a"), stats.exclusive_quartile(F.sort_array("v"), 3).alias("b")
    ).first()
    if n < 4:
        assert got["a"] is None and got["b"] is None
    else:
        q = statistics.quantiles(v, n=4)
        assert got["a"] == pytest.approx(q[0]) and got["b"] == pytest.approx(q[2])


@pytest.mark.parametrize("b,c", [(0, 0), (4, 3), (4, 1), (0, 2), (27, 38), (900, 800)])
def test_mcnemar(spark, b, c):
    n = b + c
    want = 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)
    got = spark.createDataFrame([(b, c)], "b bigint, c bigint").select(stats.exact_mcnemar(F.col("b"), F.col("c"))).first()[0]
    assert got == pytest.approx(want, rel=1e-9)


def test_cache_metrics(spark):
    rows = [(10, None), (10, 0), (10, 10), (10, 4), (0, 0), (10, 11), (None, 3)]
    got = spark.createDataFrame(rows, "n int, c int").select(
        metrics.uncached(F.col("n"), F.col("c")).alias("u"), metrics.cache_state(F.col("n"), F.col("c")).alias("s")
    ).collect()
    assert [(r["u"], r["s"]) for r in got] == [
        (10, "UNCACHED"), (10, "UNCACHED"), (0, "FULLY_CACHED"), (6, "PARTIAL"), (0, "UNCACHED"), (None, "UNKNOWN"), (None, "UNKNOWN"),
    ]


TEXT = "1. One two.\n2. Three four!\n- first bullet\n* second one\nAlpha (beta) is it?"
CASES = [
    ({"kind": "word_count", "value": 16}, True), ({"kind": "bullet_count", "value": 2}, True), ({"kind": "numbered_list_count", "value": 2}, True),
    ({"kind": "item_contains", "index": 2, "term": "four"}, True), ({"kind": "item_prefix", "index": 1, "prefix": "Two"}, False),
    ({"kind": "item_excludes_chars", "index": 1, "chars": ["!"]}, True), ({"kind": "parenthetical_count", "value": 1}, True),
    ({"kind": "ends_with", "suffix": "it?"}, True), ({"kind": "required_prefix", "prefix": "1."}, True), ({"kind": "line_count", "value": 5}, True),
    ({"kind": "bullet_prefix", "index": -1, "prefix": "second"}, True), ({"kind": "bullet_word_limit", "max_words": 1}, False),
    ({"kind": "line_contains", "lines": ["E"], "term": "BETA"}, True), ({"kind": "line_word_limit", "max_words": 4}, True),
    ({"kind": "first_word", "word": "1"}, True), ({"kind": "last_word", "word": "it?"}, True), ({"kind": "term_occurrence", "term": "ONE", "count": 2}, True),
    ({"kind": "forbidden_terms", "terms": ["gamma"]}, True), ({"kind": "required_terms", "terms": ["ALPHA", "beta"]}, True),
    ({"kind": "item_sentence_count", "value": 1}, True), ({"kind": "sentence_is_question", "index": 9}, False),
    ({"kind": "line_prefix_sequence", "prefixes": ["1.", "2.", "-"]}, True), ({"kind": "no_such_kind"}, False),
    ({"kind": "sentence_contains", "index": 1, "term": "1"}, True), ({"kind": "sentence_contains", "index": 99, "terms": []}, False),
    ({"kind": "sentence_contains", "all_sentences": True, "term": "one"}, False), ({"kind": "item_sentence_count", "index": 3, "value": 1}, False),
    ({"kind": "trailing_literal", "literal": "?"}, True), ({"kind": "first_prefix", "prefix": "1."}, True), ({"kind": "line_contains", "lines": ["A", "Z"], "term": "one"}, False),
    ({"kind": "term_occurrence", "occurrence": "across_values", "term": "one", "count": 0}, False),
]


@pytest.mark.parametrize("case,want", CASES)
def test_constraint(spark, case, want):
    df = spark.createDataFrame([(TEXT,)], "t string")
    assert df.select(text.holds(text.normalised(F.col("t")), case)).first()[0] is want


def test_all_kinds_are_there():
    assert len(text.CONSTRAINTS) == 32


def test_skyline_ties_and_nulls(spark):
    rows = [("a", 1.0, 9.0), ("b", 1.0, 9.0), ("c", 2.0, 5.0), ("d", 2.0, 4.0), ("e", 3.0, None), ("f", 0.5, 9.0)]
    got = evaluation.skyline(spark.createDataFrame(rows, "id string, x double, y double"), "id", "x", "y")
    assert sorted(r["id"] for r in got.collect()) == ["a", "b", "c"]


def test_verdicts(spark):
    def reduce(results, status="READY_DETERMINISTIC"):
        df = spark.createDataFrame([([(t, p, "", []) for t, p in results],)], f"r {verdicts.RESULT}")
        return df.select(verdicts.reduce_verdict(F.col("r"), F.lit(status))).first()[0]

    assert reduce([("exact", True)]) == "PASS"
    assert reduce([("exact", True), ("rubric_judge", False)]) == "NEEDS_JUDGE"
    assert reduce([("exact", False), ("rubric_judge", False)]) == "FAIL"
    assert reduce([("exact", True)], "PENDING_SPECIFICATION") == "REFUSED_NOT_EXECUTABLE"
    with pytest.raises(Exception, match="no grader results"):
        reduce([])


def test_gate_refuses(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "id int"), spark.createDataFrame([(1,), (3,)], "id int")
    gate = judging.population_gate(a, b, ["id"])
    assert gate.first().asDict() == {"missing": 1, "extra": 1, "repeated": 1, "ok": False}
    with pytest.raises(ValueError):
        judging.require(gate)


def one(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int").orderBy("i").select(column(F.col("t"))).collect()]


TABLE = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |"


def test_table_and_values(spark):
    shape = lambda n: lambda t: text.holds(t, {"kind": "markdown_table_shape", "columns": ["a", "b"], "data_rows": n})
    assert one(spark, shape(2), TABLE, "| a | b |") == [True, False] and one(spark, shape(1), TABLE) == [False]
    across = lambda t: text.holds(t, {"kind": "term_occurrence", "occurrence": "across_values", "term": "X", "count": 2, "match": "word"})
    assert one(spark, across, '{"a": "x y", "b": "an x", "c": "xx", "d": 1}', "no json", None) == [True, False, False]


GRADED = [
    ({"type": "exact", "expected": "Yes", "accepted_alternates": ["Yep"], "case_sensitive": False}, ["yes ", "YEP", "no", None], [True, True, False, False]),
    ({"type": "exact", "expected": "é"}, ["é", "e"], [True, False]),
    ({"type": "exact", "expected": "42", "numeric_alias_match": True}, ["it is 42.0", "41", "none"], [True, False, False]),
    ({"type": "numeric", "expected": 10, "relative_tolerance": 0.1}, ["10.9.", "11.1", "about 10"], [True, False, False]),
    ({"type": "time", "expected": "14:30", "parsing": ["HH:MM", "H:MM AM"], "precision": "minute"}, ["2:30 PM", "14:30:59", "2:31 pm", "x"], [True, True, False, False]),
    ({"type": "time", "expected": "14:30"}, ["2:30 PM", "14:30"], [False, True]),
    ({"type": "fact_check", "required_facts": ["Rome"], "required_fact_groups": [{"any_of": ["b", "z"]}], "forbidden_facts": ["Paris"], "word_limit": {"max": 3}}, ["rome b", "rome b paris", "rome z and more", ""], [True, False, False, False]),
    ({"type": "refusal", "refusal_expected": True}, ["Unknown.", "cannot_determine", "I think unknown", "cannot answer __"], [True, True, False, True]),
    ({"type": "rubric_judge", "criteria": []}, ["x"], [False]),
    ({"type": "constraints", "constraints": [{"kind": "word_limit", "max": 2}]}, ["a b", "a b c"], [True, False]),
    ({"type": "structured", "required_fields": ["a"], "expected_output": {"a": [1, "x"], "b": {"c": True}}, "allow_extra_fields": True}, ['```json\n{"a": ["x", "1.0"], "b": {"c": true}}\n```', '{"a": ["x", 2], "b": {"c": true}}', '{"a": [1, "x"], "b": {"c": 1}}', "[]", "{", None], [True, False, False, False, False, False]),
    ({"type": "structured", "required_fields": ["a"], "allow_extra_fields": False, "numeric_fields": {"a": {"expected": 5, "absolute_tolerance": 1}}, "open_values": [{"field": "n", "word_range": {"min": 1, "max": 2}}]}, ['{"a": "about 5.5", "n": "one two"}', '{"a": 7}', '{"a": 5, "z": 1}', '{"a": 5, "n": "1 2 3"}'], [True, False, False, False]),
    ({"type": "tool_call", "expected_output": {"function": "f", "arguments": {"x": 1}}, "forbidden_functions": ["g"]}, ['{"function": "f", "arguments": {"x": "1"}}', '{"function": "g", "arguments": {"x": 1}}', '{"function": "f", "arguments": {"x": 1, "y": 2}}', '{"function": "f"}'], [True, False, False, False]),
]


@pytest.mark.parametrize("spec,texts,want", GRADED)
def test_graders(spark, spec, texts, want):
    assert [r["passed"] for r in one(spark, lambda t: graders.GRADERS[spec["type"]](t, spec), *texts)] == want


def test_graders_of_tasks(spark):
    specs = {"q1": [{"type": "exact", "expected": "a"}, {"type": "rubric_judge", "criteria": ["c"]}], "q2": [{"type": "numeric", "expected": 1}]}
    df = spark.createDataFrame([("q1", "a"), ("q2", "2"), ("q3", "x")], "task string, t string")
    got = df.select("task", verdicts.reduce_verdict(graders.by_task(F.col("t"), F.col("task"), specs), F.lit("READY_JUDGE")).alias("v")).where("task <> 'q3'").collect()
    assert {r["task"]: r["v"] for r in got} == {"q1": "NEEDS_JUDGE", "q2": "FAIL"}


def test_taxonomy(spark):
    rows = [
        ([("constraints", False, "violations", ["word_count: expected 3, got 4"]), ("numeric", False, "output is not a bare number", [])], "a b"),
        ([("exact", False, "expected 'x'", [])], "NO"), ([("exact", False, "expected 'x'", [])], "it is NO"),
        ([("structured", False, "violations", ["$.a: missing required field"]), ("exact", True, "", [])], "{}"),
    ]
    df = spark.createDataFrame([(r, o, i) for i, (r, o) in enumerate(rows)], f"r {verdicts.RESULT}, o string, i int").orderBy("i")
    got = [r[0] for r in df.select(failures.row_modes(F.col("r"), F.col("o"))).collect()]
    assert got == [["LEXICAL_CONSTRAINT", "OUTPUT_CONTRACT"], ["CONTENT_ERROR"], ["OUTPUT_CONTRACT"], ["UNKNOWN"]]
    assert df.select(failures.signature(F.get("r", F.lit(0)))).first()[0] == "constraints:word_count"


def test_asserted_values(spark):
    texts = ["1 + 2 = 3\nThe answer is 1,234.", "Final answer: 5\nAnswer is 6", "so 7 it was", "steps\n**42**", "", "answer: 5\n5"]
    assert one(spark, lambda t: failures.asserted(t, "numeric"), *texts) == [["1234"], ["5", "6"], [], ["42"], [], ["5"]]
    assert one(spark, lambda t: failures.asserted(t, "time"), "The answer is 14:30 or so", "x\n2:30 PM") == [["14:30"], ["2:30 PM"]]
    check = lambda t: failures.asserted_check(t, "numeric", {"expected": 42, "absolute_tolerance": 1})
    assert [(r["status"], r["mode"]) for r in one(spark, check, "x\n42", "answer is 50", "none", "answer is 1\n2")] == [
        ("ASSERTED_SINGLE", None), ("ASSERTED_SINGLE", "CONTENT_ERROR"), ("NO_ASSERTED_VALUE", None), ("ASSERTED_CONTRADICTION", "CONTENT_ERROR"),
    ]
    assert one(spark, failures.render_numeric, "Answer: 1.50e2\n150", "answer is 1\n2", "7.0", "about 7", None) == ["150", None, "7", None, None]
    df = spark.createDataFrame([("so it is x y", "x y"), ("a", "b")], "a string, b string")
    assert [r[0] for r in df.select(failures.content_change(F.col("a"), F.col("b"), "exact")).collect()] == ["recovered_contract_only", "recovered_with_content_change"]


def test_entry_is_imported_without_a_session():
    """In a process of its own: queries are listed before Spark starts."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True, timeout=120)


def test_a_fact_check_cleans_its_text_once(spark):
    """The cleaned text, its lower case and the violations each stand once in the plan, however often they are used."""
    spec = {"required_facts": ["The", "é"], "forbidden_facts": ["password"], "word_range": {"min": 2, "max": 5}}
    rows = spark.createDataFrame([("the é one",), ("THE É password",), ("the",), (None,)], "t string")
    graded = rows.select(graders.fact_check(F.col("t"), spec).alias("g"))
    plan = graded._jdf.queryExecution().analyzed().toString()
    assert plan.count("com.ibm.icu") == 1 and plan.lower().count("lower(") == 1
    assert [(r["g"]["passed"], len(r["g"]["violations"])) for r in graded.collect()] == [(True, 0), (False, 1), (False, 2), (False, 3)]
