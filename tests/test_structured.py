"""Graders of JSON outputs against a plain version, on outputs made to be hard."""

import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import json_values, structured


def tidy(s):
    return re.sub(r"\r\n?", "\n", unicodedata.normalize("NFC", s)).strip()


def loads(raw):
    text = tidy(raw or "")
    m = re.fullmatch(r"```(?:json)?\s*\n?(.*?)\n?```", text, re.DOTALL)
    return json.loads(m[1].strip() if m else text)


def num(v):
    if isinstance(v, str):
        m = re.search(structured.NUMBER, v)
        return float(m[0]) if m else None
    return None if isinstance(v, bool) or not isinstance(v, (int, float)) else float(v)


def same(a, b):
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, float)):
        return num(b) is not None and abs(num(b) - a) <= 1e-9
    if isinstance(a, str):
        return isinstance(b, str) and tidy(a) == tidy(b)
    return a == b


def inside(a, b):
    if isinstance(a, dict):
        return isinstance(b, dict) and all(k in b and inside(v, b[k]) for k, v in a.items())
    if isinstance(a, list):
        if not isinstance(b, list) or len(a) != len(b):
            return False
        free = list(b)
        for x in a:
            hit = [i for i, y in enumerate(free) if same(x, y)]
            if not hit:
                return False
            free.pop(hit[0])
        return True
    return same(a, b)


def plain_structured(raw, spec):
    try:
        got = loads(raw)
    except ValueError:
        return False
    if not isinstance(got, dict) or any(f not in got for f in spec["required_fields"]) or not inside(spec.get("expected_output") or {}, got):
        return False
    free = spec.get("open_values", [])
    if not spec.get("allow_extra_fields", True) and set(got) - set(spec["required_fields"]) - {o["field"] for o in free}:
        return False
    for f, r in spec.get("numeric_fields", {}).items():
        if f in got:
            a, b = num(got[f]), num(str(r.get("expected", got[f])))
            if a is None or b is None or abs(a - b) > r.get("absolute_tolerance", 0):
                return False
    for o in free:
        v = got.get(o["field"])
        if v is None:
            continue
        r = o.get("word_range")
        if not isinstance(v, str) or r and not r["min"] <= len(tidy(v).split()) <= r["max"] or any(t.lower() not in tidy(v).lower() for t in o.get("required_terms", [])):
            return False
    return True


def plain_call(raw, spec):
    try:
        got = loads(raw)
    except ValueError:
        return False
    want = spec["expected_output"]
    if not isinstance(got, dict) or got.get("function") != want["function"] or got["function"] in spec.get("forbidden_functions", []) or not isinstance(got.get("arguments"), dict):
        return False
    args = got["arguments"]
    return all(k in args and same(v, args[k]) for k, v in want["arguments"].items()) and not set(args) - set(spec.get("required_arguments", {}).get(want["function"], want["arguments"]))


SPECS = [
    {"required_fields": ["a", "b"], "expected_output": {"a": 3, "b": {"c": [1, "x", True, None], "d": {}}, "e": "café"}},
    {"required_fields": ["a"], "allow_extra_fields": False, "open_values": [{"field": "t", "word_range": {"min": 2, "max": 4}, "required_terms": ["Tea"]}], "expected_output": {"a": [[1, 2], {"k": 1.0}, "x"]}},
    {"required_fields": [], "numeric_fields": {"a": {"expected": "about 3", "absolute_tolerance": 0.5}, "n": {}}, "expected_output": {"z": True}},
    {"required_fields": ["e"], "expected_output": {"e": ["1", 1, "one 1"]}},
]
CALL = {"expected_output": {"function": "f", "arguments": {"x": 1, "y": ["a", 2], "z": "q"}}, "forbidden_functions": ["g"], "required_arguments": {"f": ["x", "y", "z", "w"]}}


def outputs(n):
    pick = random.Random(3)
    scalars = [1, 1.0, 3, 3.0000000001, 3.2, -0.0, "1", "3 apples", "x", " x\r\n", "café", "café", True, False, None, "true", "null", 'q"\\', '\\"1",', "s1", "", 10**25, 1e300, "one 1", "Tea for two", "tea", 2]
    def value(d):
        k = pick.random()
        if d and k < 0.25:
            return {pick.choice("abcdekxyznt"): value(d - 1) for _ in range(pick.randint(0, 4))}
        if d and k < 0.45:
            return [value(d - 1) for _ in range(pick.randint(0, 4))]
        return pick.choice(scalars)
    good = [
        {"a": "3", "b": {"c": [None, True, "x ", "1"], "d": {"z": 1}}, "e": "café"}, {"a": [{"k": 1}, [1.0, 2], "x"], "t": "tea is fine"}, {"z": True, "a": 3.4, "n": "7"}, {"e": ["one 1", "1", 1]}, {"e": [1, "1", "one 1"]},
        {"function": "f", "arguments": {"x": "1", "y": ["a", 2.0], "z": "q", "w": 0}},
    ]
    out = []
    for i in range(n):
        got = value(3) if i % 3 else json.loads(json.dumps(pick.choice(good)))
        if isinstance(got, dict) and pick.random() < 0.4:
            got[pick.choice("abetnz")] = value(2)
        if isinstance(got, dict) and isinstance(got.get("arguments"), dict) and pick.random() < 0.5:
            got["arguments"][pick.choice("xyzwv")] = value(1)
        s = json.dumps(got, ensure_ascii=pick.random() < 0.5, indent=pick.choice([None, None, 2]))
        kind = pick.random()
        out.append(f"```json\n{s}\n```" if kind < 0.1 else s + " x" if kind < 0.14 else s[:-1] if kind < 0.18 else f" \r\n{s}\r" if kind < 0.25 else s)
    return out + ["", None, "{}", "[]", "```", "01", '{"a": 1, "a": 3}', '{"a": .5}', '{"a": "\x01"}', "nul", '"x"', '{"function": 1, "arguments": {}}', '{"e": ["\\n' * 1 + '"]}']


@pytest.fixture(scope="module")
def made(spark):
    texts = outputs(10_000)
    return texts, spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4).cache()


def literal(spec):
    return F.from_json(F.lit(json.dumps(spec)), structured.SPEC)


@pytest.mark.parametrize("k", range(len(SPECS) + 1))
def test_equal_to_plain(spark, made, k):
    texts, rows = made
    spec, kind, plain = (structured.structured_spec(SPECS[k]), "structured", plain_structured) if k < len(SPECS) else (structured.call_spec(CALL), "tool_call", plain_call)
    given = SPECS[k] if k < len(SPECS) else CALL
    got = json_values.last_key_wins(spark, lambda: rows.select("i", structured.graded(F.col("t"), literal(spec), kind).alias("r"))).select("i", "r.passed", "r.violations").collect()
    want = [plain(t, given) for t in texts]
    assert [(texts[r["i"]], r["passed"], r["violations"]) for r in got if r["passed"] != want[r["i"]]][:3] == []
    assert 20 < sum(want) < len(want) - 20


def test_canonical_classes(spark, made):
    texts, rows = made

    def plain(raw):
        try:
            return json.dumps(json.loads(raw), sort_keys=True)
        except (ValueError, TypeError):
            return "UNPARSEABLE"

    got = json_values.last_key_wins(spark, lambda: rows.select("i", json_values.canonical(F.col("t")).alias("c"))).collect()
    classes = {}
    for r in got:
        classes.setdefault(plain(texts[r["i"]]), set()).add(r["c"])
    assert [k for k, v in classes.items() if len(v) > 1][:3] == []
    assert len(set.union(*classes.values())) == len(classes)


def test_violations_say_where(spark):
    spec = structured.structured_spec({"required_fields": ["q"], "allow_extra_fields": False, "expected_output": {"a": {"b": 1}, "l": [1, 2], "m": [1]}, "numeric_fields": {"n": {"expected": 2}}, "open_values": [{"field": "t", "word_range": {"min": 3, "max": 9}, "required_terms": ["tea"]}]})
    row = spark.createDataFrame([('{"a": [], "l": [2, 3], "m": 1, "n": 3, "t": "two words", "z": 0}',)], "t string")
    got = row.select(structured.graded(F.col("t"), literal(spec), "structured").alias("r")).first()["r"]["violations"]
    assert got == ["$.q is required", *[f"$.{k} is not allowed" for k in "almnz"], "$.a is no object", "$.l[0] is not among the elements", "$.m is no array", "$.n is out of its range", "$.t has 2 words", "$.t lacks tea"]


def test_very_long_values(spark):
    row = spark.createDataFrame([(json.dumps({"a": '\\n"x' * 200_000, "b": 1}),)], "t string")
    spec = structured.structured_spec({"required_fields": ["a"], "expected_output": {"b": 1}})
    assert row.select(structured.graded(F.col("t"), literal(spec), "structured").alias("r")).first()["r"]["passed"]
