"""Verdict reduction and failure taxonomy over arrays of grader results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT = "array<struct<grader_type:string,passed:boolean,detail:string,violations:array<string>>>"


def reduce_verdict(results: Column, grading_status: Column) -> Column:
    """Refused, then any failure, then a pending judge, then pass; no result at all is an error."""
    refused = ~grading_status.isin("READY_DETERMINISTIC", "READY_JUDGE")
    return (
        F.when(refused, "REFUSED_NOT_EXECUTABLE")
        .when(F.size(results) < 1, F.raise_error(F.lit("no grader results")))
        .when(F.exists(results, lambda r: ~r["passed"] & (r["grader_type"] != "rubric_judge")), "FAIL")
        .when(F.exists(results, lambda r: r["grader_type"] == "rubric_judge"), "NEEDS_JUDGE")
        .otherwise("PASS")
    )


def row_mode(modes: Column) -> Column:
    """UNKNOWN for none, the one mode, MIXED for more; UNKNOWN does not count beside others."""
    known = F.array_distinct(F.filter(modes, lambda m: m != "UNKNOWN"))
    return F.when(F.size(known) == 0, "UNKNOWN").when(F.size(known) == 1, F.get(known, F.lit(0))).otherwise("MIXED")


def truncation(done_reason: Column, eval_count: Column, num_predict: Column) -> Column:
    """Cut off: the generation ended for its length, and its budget is spent."""
    cut = F.coalesce((done_reason == "length") & (eval_count >= num_predict), F.lit(False))
    return F.when(cut, F.array(F.lit("TRUNCATED_AT_NUM_PREDICT"))).otherwise(F.array().cast("array<string>"))


def failure_signature(grader_type: Column, violations: Column, detail: Column) -> Column:
    first = F.coalesce(F.get(violations, F.lit(0)), detail, F.lit("fail"))
    return F.concat(grader_type, F.lit(":"), F.substring(first, 1, 120))
