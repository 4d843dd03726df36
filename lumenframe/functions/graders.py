"""Graders: what a specification asks of an output, as result structs (grader_type, passed, detail, violations).

A specification is a constant here, so each grader is an expression that Catalyst
folds. Specifications as rows: ``spec_rows``.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions import structured as sd
from lumenframe.functions import text as tx
from lumenframe.functions.json_values import cleaned
from lumenframe.functions.text import plain

RESULT = "struct<grader_type:string,passed:boolean,detail:string,violations:array<string>>"
#: Outputs that count as a refusal.
REFUSALS = ("cannot determine", "not established", "unknown", "insufficient information", "cannot answer", "unable to answer")
NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def clean(t: Column) -> Column:
    return cleaned(t)


def _any(parts: list[Column]) -> Column:
    return reduce(Column.__or__, parts, F.lit(False))


def _result(kind: str, broken: list[tuple[Column, str]] | Column, good: str, bad: str) -> Column:
    """``broken``: (whether, what) pairs, or an array of texts; it passes if none is left."""
    if isinstance(broken, list):
        marks = [F.when(F.coalesce(c, F.lit(True)), F.lit(what)) for c, what in broken] or [F.lit(None).cast("string")]
        broken = F.filter(F.array(*marks), lambda x: x.isNotNull())
    one = lambda b: F.struct(
        F.lit(kind).alias("grader_type"), (F.size(b) == 0).alias("passed"),
        F.when(F.size(b) == 0, F.lit(good)).otherwise(F.lit(bad)).alias("detail"), b.alias("violations"),
    )
    return tx.once(broken, one).cast(RESULT)


def _verdict(kind: str, passed: Column, good: str, bad: str) -> Column:
    ok = F.coalesce(passed, F.lit(False))
    return F.struct(
        F.lit(kind).alias("grader_type"), ok.alias("passed"), F.when(ok, F.lit(good)).otherwise(F.lit(bad)).alias("detail"),
        F.array().cast("array<string>").alias("violations"),
    ).cast(RESULT)


def first_number(t: Column) -> Column:
    """The first number inside a text; null if there is none."""
    return F.nullif(F.regexp_extract(t, f"({NUMBER})", 1), F.lit("")).try_cast("double")


def _number_in(value) -> float | None:
    """A JSON value as a number: numbers, and the first number inside a string; truth values are none."""
    if isinstance(value, str):
        found = re.search(NUMBER, value)
        return float(found[0]) if found else None
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def exact(t: Column, spec: dict) -> Column:
    """One of the accepted forms, after clean-up; by the first number too, if the specification says so."""
    wanted = [str(spec["expected"]), *map(str, spec.get("accepted_alternates", []))]
    trim = spec.get("trim_outer_whitespace", True)
    got = clean(t) if trim else F.coalesce(t, F.lit(""))
    forms = [plain(w) if trim else re.sub(r"\r\n?", "\n", unicodedata.normalize("NFC", w)) for w in wanted]
    if not spec.get("case_sensitive", True):
        got, forms = F.lower(got), [f.lower() for f in forms]
    same = got.isin(forms)
    if spec.get("numeric_alias_match"):
        numbers = [n for n in map(_number_in, wanted) if n is not None]
        if numbers:
            same = same | F.coalesce(first_number(t).isin(numbers), F.lit(False))
    return _verdict("exact", same, "exact match", f"expected {wanted[0]!r}")


def numeric(t: Column, spec: dict) -> Column:
    """A bare number within the wider of the two tolerances."""
    want = float(spec["expected"])
    room = max(float(spec.get("absolute_tolerance", 0)), float(spec.get("relative_tolerance", 0)) * abs(want))
    got = tx.bare_number(clean(t))
    bad = F.when(got.isNull(), F.lit("output is not a bare number")).otherwise(F.lit(f"expected {want}"))
    out = _verdict("numeric", F.abs(got - want) <= room, "within tolerance", "")
    return out.withField("detail", F.when(out["passed"], out["detail"]).otherwise(bad))


def _clock(t: Column, forms: list[str]) -> Column:
    spoken = any(f.upper().replace(" ", "").removeprefix("H:MM") in ("AM", "PM", "A.M.", "P.M.") for f in forms)
    return tx.time_parts(t, spoken, spoken)


def time(t: Column, spec: dict) -> Column:
    """The same clock time in one of the forms listed; ``minute`` precision leaves seconds out."""
    forms = spec.get("parsing") or ["HH:MM"]
    want, got = _clock(F.lit(plain(str(spec["expected"]))), forms), _clock(clean(t), forms)
    keep = ("h", "m") if spec.get("precision") == "minute" else ("h", "m", "s")
    same = reduce(Column.__and__, [got[p] == want[p] for p in keep])
    out = _verdict("time", same, "time matches", "")
    bad = F.when(want.isNull(), F.lit("bad expected time in spec")).when(got.isNull(), F.lit("could not parse time")).otherwise(F.lit("another time than expected"))
    return out.withField("detail", F.when(out["passed"], out["detail"]).otherwise(bad))


def constraints(t: Column, spec: dict) -> Column:
    return _result("constraints", tx.violations(clean(t), spec["constraints"]), "all constraints satisfied", "violations")


def fact_check(t: Column, spec: dict) -> Column:
    """Facts that must or must not stand in the text, in either case, and limits of form."""
    # the text and its lower case are each made once
    return tx.once(clean(t), lambda c: tx.once(F.lower(c), lambda low: _facts(c, low, spec)))


def _facts(c: Column, low: Column, spec: dict) -> Column:
    limits = []
    says = lambda fact: F.contains(low, F.lit(str(fact).lower()))
    limits += [(~says(f), f"missing fact: {f!r}") for f in spec.get("required_facts", [])]
    for group in spec.get("required_fact_groups", []):
        limits.append((~_any([says(f) for f in group.get("any_of", [])]), f"missing fact group: {group.get('any_of', [])}"))
    limits += [(says(f), f"forbidden fact present: {f!r}") for f in spec.get("forbidden_facts", [])]
    for kind, with_keys in (("word_limit", {}), ("word_range", {}), ("sentence_count", {}), ("bullet_count", {}), ("bullet_word_limit", {"max_words": "max"})):
        if kind in spec:
            asked = {"kind": kind, **spec[kind], **{k: spec[kind][v] for k, v in with_keys.items()}}
            limits.append((~tx.holds(c, asked), kind))
    return _result("fact_check", limits, "facts preserved", "violations")


def refusal(t: Column, spec: dict) -> Column:
    """Whether the whole output is a refusal, as expected or not."""
    said = F.regexp_replace(F.lower(clean(t)), r"[.!?]+$", "")
    is_one = F.regexp_replace(said, r"[\s_]+$", "").isin(*REFUSALS) | said.isin(*[m.replace(" ", "_") for m in REFUSALS])
    return _verdict("refusal", is_one == F.lit(bool(spec["refusal_expected"])), "as expected", "not as expected")


def rubric_judge(t: Column, spec: dict) -> Column:
    n = len(spec.get("criteria") or [])
    return _verdict("rubric_judge", F.lit(n > 0), f"left to a judge: {n} criteria", "rubric judge requires criteria")


def _json_grader(kind: str, compile_spec):
    def grader(t: Column, spec: dict) -> Column:
        return sd.graded(t, F.from_json(F.lit(json.dumps(compile_spec(spec))), sd.SPEC), kind)

    return grader


structured = _json_grader("structured", sd.structured_spec)
tool_call = _json_grader("tool_call", sd.call_spec)

GRADERS = {
    "exact": exact, "numeric": numeric, "time": time, "structured": structured, "tool_call": tool_call, "constraints": constraints,
    "fact_check": fact_check, "refusal": refusal, "rubric_judge": rubric_judge,
}


def results(t: Column, specs: list[dict]) -> Column:
    """The results of all graders of one task, in order."""
    return F.array(*[GRADERS[s["type"]](t, s) for s in specs]).cast(f"array<{RESULT}>")


def by_task(t: Column, task: Column, specs: dict[str, list[dict]]) -> Column:
    """Each row graded by its task's graders; null for a task without any. Specifications are few: they are in the plan."""
    out = F.lit(None).cast(f"array<{RESULT}>")
    for name, graders in sorted(specs.items()):
        out = F.when(task == F.lit(name), results(t, graders)).otherwise(out)
    return out
