"""Failure taxonomy and asserted values: what kind of failure a failed grader result is, and which final answer a text asserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions import text as tx

#: Violations that are named by their kind alone.
NAMED = (
    "term_occurrence(", "sentence_contains:", "sentence_numeric_tokens:", "word_count:", "word_range:", "word_limit:", "forbidden_terms:",
    "required_terms:", "item_contains:", "line_contains:", "bullet_prefix:", "line_prefix_sequence:", "first_word:", "sentence_count:",
)
#: Parts of a signature that tell the mode of a failed structured grader, in order.
STRUCTURED_MODES = (
    ("expected", "CONTENT_ERROR"), ("missing field", "STRUCTURE_ERROR"), ("extra field", "STRUCTURE_ERROR"),
    ("not valid JSON", "STRUCTURE_ERROR"), ("schema", "STRUCTURE_ERROR"),
)
#: What marks a line that asserts an answer, and the spelling of times and numbers there.
MARKERS = ("final answer", "answer is", "answer:", "boxed{", "✅")
CLOCK = r"\d{1,2}:\d{2}(?:\s?[APap]\.?[Mm]\.?)?"
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"


def signature(result: Column) -> Column:
    """A short name of a failed result: its kind for the named violations, else the head of the first violation or detail."""
    first = F.get(result["violations"], F.lit(0))
    head = F.substring(F.coalesce(first, result["detail"], F.lit("fail")), 1, 80)
    for prefix in reversed(NAMED):
        head = F.when(F.coalesce(first.startswith(prefix), F.lit(False)), F.lit(prefix.rstrip(":"))).otherwise(head)
    return F.concat(result["grader_type"], F.lit(":"), head)


def mode(grader_type: Column, sig: Column, bare_word: Column) -> Column:
    """The failure mode of a signature; ``bare_word``: the output is a single token, so a failed exact match is wrong content."""
    lexical = reduce(Column.__or__, [F.contains(sig, F.lit(k)) for k in tx.CONSTRAINTS if k != "markdown_table_shape"])
    of_constraint = F.when(lexical, "LEXICAL_CONSTRAINT").when(F.contains(sig, F.lit("markdown_table_shape")), "STRUCTURE_ERROR").otherwise("UNKNOWN")
    of_structure = F.lit("UNKNOWN")
    for part, name in reversed(STRUCTURED_MODES):
        of_structure = F.when(F.contains(sig, F.lit(part)), name).otherwise(of_structure)
    unread = F.contains(sig, F.lit("not a bare number")) & (grader_type == "numeric")
    unread = unread | ((F.contains(sig, F.lit("could not parse")) | F.contains(sig, F.lit("mismatch"))) & (grader_type == "time"))
    return (
        F.when((grader_type == "exact") & bare_word, "CONTENT_ERROR")
        .when((grader_type == "exact") | unread, "OUTPUT_CONTRACT")
        .when(grader_type == "constraints", of_constraint)
        .when(grader_type == "structured", of_structure)
        .when(grader_type == "fact_check", "CONTENT_ERROR")
        .when(grader_type == "tool_call", "STRUCTURE_ERROR")
        .otherwise("UNKNOWN")
    )


def row_modes(results: Column, output: Column) -> Column:
    """Distinct modes of a row's failed results."""
    t = tx.normalised(F.coalesce(output, F.lit("")))
    bare = (t != "") & ~t.rlike(tx.SPACE)
    failed = F.filter(results, lambda r: ~F.coalesce(r["passed"], F.lit(True)))
    return F.array_distinct(F.transform(failed, lambda r: mode(r["grader_type"], signature(r), bare)))


def _bare(t: Column) -> Column:
    """Without marks of emphasis around and full stops behind."""
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"^[\s*_`$]+|[\s*_`$]+$", ""), r"[.]+$", ""))


def asserted(t: Column, kind: str) -> Column:
    """Distinct final answers that a text asserts, in order: on lines with a marker, and on a last line that is nothing else.

    ``kind``: numeric or time. A number within a derivation is not asserted.
    """
    part = CLOCK if kind == "time" else NUMBER
    inside = rf"\b{part}\b" if kind == "time" else part
    said = lambda x: F.regexp_extract_all(x, F.lit(inside), F.lit(0))
    marked = F.filter(F.split(t, "\n"), lambda x: reduce(Column.__or__, [F.contains(F.lower(x), F.lit(m)) for m in MARKERS]))
    last = _bare(F.try_element_at(tx.lines(t), F.lit(-1)))
    final = F.when(last.rlike(f"^(?:{part})$"), said(last)).otherwise(F.array().cast("array<string>"))
    found = F.concat(F.flatten(F.transform(marked, said)), final)
    tidy = F.transform(found, (lambda x: F.replace(x, F.lit(","), F.lit(""))) if kind == "numeric" else _bare)
    return F.array_distinct(F.filter(tidy, lambda x: x != ""))


def asserted_status(values: Column) -> Column:
    return F.when(F.size(values) == 0, "NO_ASSERTED_VALUE").when(F.size(values) == 1, "ASSERTED_SINGLE").otherwise("ASSERTED_CONTRADICTION")


def asserted_check(t: Column, kind: str, spec: dict) -> Column:
    """struct<status, mode>: mode CONTENT_ERROR if the asserted answer is wrong or there are several, else null."""
    values, want = asserted(t, kind), str(spec["expected"]).strip()
    one = F.get(values, F.lit(0))
    if kind == "numeric":
        number = float(want)
        room = float(spec.get("absolute_tolerance") or 0) + float(spec.get("relative_tolerance") or 0) * abs(number)
        right = F.abs(one.try_cast("double") - number) <= room
    else:
        spoken = any("M" in f.upper().replace("MM", "") for f in spec.get("parsing") or [])
        right = (one == want) | F.coalesce(tx.time_parts(one, spoken, spoken) == tx.time_parts(F.lit(want), spoken, spoken), F.lit(False))
    wrong = (F.size(values) > 1) | ((F.size(values) == 1) & ~F.coalesce(right, F.lit(False)))
    return F.struct(asserted_status(values).alias("status"), F.when(wrong, F.lit("CONTENT_ERROR")).alias("mode"))


def content_change(before: Column, after: Column, kind: str) -> Column:
    """Whether a recovered answer changed its content or its form alone."""
    same, other = F.lit("recovered_contract_only"), F.lit("recovered_with_content_change")
    if kind in ("numeric", "time"):
        a, b = asserted(before, kind), asserted(after, kind)
        return F.when((F.size(a) == 0) | (F.size(b) == 0), "unknown").when(a == b, same).otherwise(other)
    return F.when(F.contains(before, tx.normalised(after)) | (tx.normalised(before) == tx.normalised(after)), same).otherwise(other)


#: How a line says its answer; the spelling of a number; the longest spelling and the digits that count.
JSON_NUMBER = r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?"
SAID = rf"(?i)^{tx.SPACE}*(?:final{tx.SPACE}+answer|answer)(?:{tx.SPACE}+is)?{tx.SPACE}*[:\-]?{tx.SPACE}*({JSON_NUMBER}){tx.SPACE}*$"
ALONE = rf"^{tx.SPACE}*({JSON_NUMBER}){tx.SPACE}*$"
LONGEST, DIGITS = 128, 28


def plain_decimal(n: Column) -> Column:
    """A JSON number without exponent and outer zeros, to ``DIGITS`` digits (half to even); null beyond ``LONGEST`` characters.

    Digits stay text: the value is 0.digits * 10**point, whatever its size.
    """
    part = lambda i: F.regexp_extract(n, r"^-?(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?$", i)
    power = F.when(part(3) == "", F.lit(0)).otherwise(part(3).try_cast("int"))

    def of(digits: Column) -> Column:
        own = F.ltrim(digits, F.lit("0"))
        point = F.length(part(1)) + power - (F.length(digits) - F.length(own))
        head, rest = F.left(own, F.lit(DIGITS)), F.substring(own, F.lit(DIGITS + 1), F.length(own))
        half = F.rpad(F.lit("5"), F.length(rest), F.lit("0"))
        up = (rest > half) | ((rest == half) & F.right(head, F.lit(1)).isin(*"13579"))
        rounded = F.when((F.length(own) > DIGITS) & up, (head.cast("decimal(38,0)") + 1).cast("decimal(38,0)").cast("string")).otherwise(head)
        return tx.once(
            F.struct(F.rtrim(rounded, F.lit("0")).alias("d"), (point + F.length(rounded) - F.length(head)).alias("p"), (own == "").alias("zero")),
            lambda x: F.when(x["zero"], "0").when(F.abs(x["p"]) <= 2 * LONGEST, F.concat(F.when(n.startswith("-"), "-").otherwise(""), spelled(x["d"], x["p"]))),
        )

    def spelled(d: Column, p: Column) -> Column:
        whole = F.rpad(d, p, F.lit("0"))
        inner = F.concat(F.left(d, p), F.lit("."), F.substring(d, p + 1, F.length(d)))
        return F.when(p >= F.length(d), whole).when(p > 0, inner).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -p), d))

    out = tx.once(F.concat(part(1), part(2)), of)
    return tx.once(out, lambda x: F.when(F.length(x) <= LONGEST, x))


def render_numeric(t: Column) -> Column:
    """The one number that a text asserts, spelled plainly; null if there is none or more than one."""
    lines = F.filter(F.split(F.coalesce(t, F.lit("")), r"\R|[\x1C-\x1E]"), lambda x: x.rlike(tx.NOT_SPACE))
    said = F.transform(lines, lambda x: F.regexp_extract(x, SAID, 1))
    last = F.regexp_extract(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")), ALONE, 1)
    found = F.array_distinct(F.filter(F.transform(F.filter(F.concat(said, F.array(last)), lambda x: x != ""), plain_decimal), lambda x: x.isNotNull()))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))
