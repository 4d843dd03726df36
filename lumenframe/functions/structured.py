"""Graders of JSON outputs by a specification that is data: its columns are arrays, so a plan is as long for a million tasks as for one.

A specification is a struct of ``SPEC``; ``structured_spec`` and ``call_spec``
make one of a dict. What is expected is a list of paths with the kind and the
text of the value there, in order; arrays keep their elements beside them.
"""

from __future__ import annotations

from datetime import date, datetime, time

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions import json_values as jv
from lumenframe.functions import text as tx

VALUE = "struct<kind:string,text:string>"
SPEC = (
    "struct<required:array<string>,closed:boolean,allowed:array<string>,"
    f"expected:array<struct<path:array<string>,kind:string,text:string,items:array<{VALUE}>>>,"
    "numbers:array<struct<field:string,expected:double,given:boolean,room:double>>,"
    "open:array<struct<field:string,least:int,most:int,terms:array<string>>>,"
    "function:string,forbidden:array<string>>"
)
NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


# specifications as data


def _value(x) -> dict:
    """A constant as (kind, text), the way outputs are read."""
    import json

    if isinstance(x, (date, datetime, time)):
        x = x.isoformat()
    if x is None:
        return {"kind": "null", "text": "null"}
    if isinstance(x, bool):
        return {"kind": "bool", "text": str(x).lower()}
    if isinstance(x, (int, float)):
        return {"kind": "number", "text": repr(x)}
    if isinstance(x, str):
        return {"kind": "string", "text": tx.plain(x)}
    return {"kind": "deep", "text": json.dumps(x)}


def _entries(x, path: list[str]) -> list[dict]:
    if isinstance(x, dict):
        own = [{"path": path, "kind": "object", "text": None, "items": None}]
        return own + [e for k, v in x.items() for e in _entries(v, [*path, str(k)])]
    if isinstance(x, (list, tuple)):
        return [{"path": path, "kind": "array", "text": None, "items": [_value(v) for v in x]}]
    return [{"path": path, **_value(x), "items": None}]


def _number(x) -> float | None:
    import re

    found = re.search(NUMBER, str(x))
    return float(found[0]) if found else None


def _empty() -> dict:
    return {"required": [], "closed": False, "allowed": [], "expected": [], "numbers": [], "open": [], "function": None, "forbidden": []}


def structured_spec(spec: dict) -> dict:
    free = spec.get("open_values", [])
    return _empty() | {
        "required": list(spec["required_fields"]), "closed": not spec.get("allow_extra_fields", True), "allowed": [*spec["required_fields"], *[o["field"] for o in free]],
        "expected": _entries(spec.get("expected_output") or {}, [])[1:],
        "numbers": [
            {"field": f, "given": "expected" in r, "expected": _number(r["expected"]) if "expected" in r else None, "room": float(r.get("absolute_tolerance", 0))}
            for f, r in spec.get("numeric_fields", {}).items()
        ],
        "open": [{"field": o["field"], "least": (o.get("word_range") or {}).get("min"), "most": (o.get("word_range") or {}).get("max"), "terms": [t.lower() for t in o.get("required_terms", [])]} for o in free],
    }


def call_spec(spec: dict) -> dict:
    want = spec["expected_output"]
    named = spec.get("required_arguments", {}).get(want["function"], list(want["arguments"]))
    entries = [{"path": ["arguments", k], **_value(v), "items": None} for k, v in want["arguments"].items()]
    return _empty() | {"allowed": list(named), "expected": entries, "closed": True, "function": want["function"], "forbidden": list(spec.get("forbidden_functions", []))}


# outputs against them


def first_number(t: Column) -> Column:
    return F.nullif(F.regexp_extract(t, f"({NUMBER})", 1), F.lit("")).try_cast("double")


def number_of(value: Column) -> Column:
    """A (kind, text) as a number: numbers, and the first number inside a string; nothing else."""
    return F.when(value["kind"] == "number", value["text"].try_cast("double")).when(value["kind"] == "string", first_number(value["text"]))


def deep_text(t: Column) -> Column:
    return jv.comparable(F.to_json(jv.tagged(t)))


def matches(want: Column, got: Column) -> Column:
    """Truth values only equal truth values; numbers within 1e-9, also inside a string; strings after clean-up; the rest by value."""
    flags = (want["kind"] == "bool") | (got["kind"] == "bool")
    near = F.abs(number_of(got) - want["text"].try_cast("double")) <= 1e-9
    text = (got["kind"] == "string") & (tx.normalised(jv.nfc(got["text"])) == want["text"])
    same = (
        F.when(flags, (want["kind"] == got["kind"]) & (want["text"] == got["text"])).when(want["kind"] == "number", near).when(want["kind"] == "string", text)
        .when(want["kind"] == "deep", (got["kind"] == "deep") & (deep_text(want["text"]) == got["text"])).otherwise(want["kind"] == got["kind"])
    )
    return F.coalesce(same, F.lit(False))


def unmatched(want: Column, got: Column) -> Column:
    """Places (from 0) of wanted elements left over when each, in order, takes the first free element that matches it: array<int>.

    Both are arrays of (kind, text); a fold whose state is the free elements.
    """
    start = F.struct(got.alias("free"), F.array().cast("array<int>").alias("left"), F.lit(0).alias("i"))

    def step(state: Column, w: Column) -> Column:
        hit = tx.once(F.transform(state["free"], lambda g: matches(w, g)), lambda found: F.array_position(found, F.lit(True)))
        return tx.once(
            hit,
            lambda p: F.struct(
                F.when(p == 0, state["free"]).otherwise(F.filter(state["free"], lambda _, k: k + 1 != p)).alias("free"),
                F.when(p == 0, F.concat(state["left"], F.array(state["i"]))).otherwise(state["left"]).alias("left"),
                (state["i"] + 1).alias("i"),
            ),
        )

    return F.aggregate(want, start, step, lambda s: s["left"])


def _known(texts: Column) -> Column:
    return F.filter(texts, lambda x: x.isNotNull())


def _expected_faults(root: Column, expected: Column) -> Column:
    """What does not stand where it is expected. Below a missing or wrong object nothing more is said."""
    none = F.array().cast("array<string>")

    def of(e: Column) -> Column:
        where = F.array_join(F.concat(F.array(F.lit("$")), e["path"]), ".")
        said = lambda *parts: F.array(F.concat(where, *parts))
        parent = jv.members(jv.at(root, F.slice(e["path"], 1, F.size(e["path"]) - 1)))

        def value(v: Column) -> Column:
            one = tx.once(jv.scalar(v), lambda got: F.when(matches(e, got), none).otherwise(said(F.lit(" differs: "), got["kind"], F.lit(" "), F.left(got["text"], F.lit(80)))))
            own = jv.elements(v)
            listed = F.when(own.isNull(), said(F.lit(" is no array"))).when(
                F.size(own) != F.size(e["items"]), said(F.lit(" has "), F.size(own).cast("string"), F.lit(" elements of "), F.size(e["items"]).cast("string"))
            ).otherwise(F.transform(unmatched(e["items"], F.transform(own, jv.scalar)), lambda i: F.concat(where, F.lit("["), i.cast("string"), F.lit("] is not among the elements"))))
            inner = F.when(jv.members(v).isNull(), said(F.lit(" is no object"))).otherwise(none)
            return F.when(e["kind"] == "object", inner).when(e["kind"] == "array", listed).otherwise(one)

        return F.when(parent.isNull(), none).otherwise(
            tx.once(F.try_element_at(parent, F.concat(F.lit("s"), F.element_at(e["path"], -1))), lambda v: F.when(F.to_json(v).isNull(), said(F.lit(" is absent"))).otherwise(value(v)))
        )

    return F.flatten(F.transform(expected, of))


def _names(object_map: Column) -> Column:
    return F.transform(F.map_keys(object_map), lambda k: F.substring(k, F.lit(2), F.length(k)))


def faults(root: Column, own: Column, spec: Column) -> Column:
    """Everything that keeps a JSON object from its specification, in order: the call (if one is asked for), absent and extra fields, values, numbers, free texts.

    ``own``: the object's members. Of a call, arguments are the fields that may be extra.
    """
    field = lambda name: F.try_element_at(own, F.concat(F.lit("s"), name))
    none = F.array().cast("array<string>")
    said = F.when(spec["function"].isNotNull(), tx.once(jv.scalar(field(F.lit("function"))), lambda x: F.when(x["kind"] == "string", x["text"])))
    other = F.when(~F.coalesce(said == spec["function"], F.lit(False)), F.concat(F.lit("another function than "), spec["function"]))
    barred = F.transform(F.filter(spec["forbidden"], lambda f: F.coalesce(f == said, F.lit(False))), lambda f: F.concat(f, F.lit(" must not be called")))
    args = F.when(spec["function"].isNotNull(), jv.members(field(F.lit("arguments"))))
    call = F.when(spec["function"].isNull(), none).otherwise(F.concat(_known(F.array(other)), barred, F.when(args.isNull(), F.array(F.lit("$.arguments is no object"))).otherwise(none)))
    names = F.coalesce(_names(F.when(spec["function"].isNotNull(), args).otherwise(own)), none)
    absent = F.transform(F.filter(spec["required"], lambda f: ~F.array_contains(_names(own), f)), lambda f: F.concat(F.lit("$."), f, F.lit(" is required")))
    extra = F.when(spec["closed"], F.array_sort(F.array_except(names, spec["allowed"]))).otherwise(none)
    where = F.when(spec["function"].isNotNull(), "$.arguments.").otherwise("$.")

    def number(rule: Column) -> Column:
        got = number_of(jv.scalar(field(rule["field"])))
        off = F.abs(got - F.when(rule["given"], rule["expected"]).otherwise(got)) > rule["room"]
        return F.when(F.to_json(field(rule["field"])).isNotNull() & F.coalesce(off, F.lit(True)), F.concat(F.lit("$."), rule["field"], F.lit(" is out of its range")))

    def free(rule: Column) -> Column:
        said = lambda *parts: F.concat(F.lit("$."), rule["field"], *parts)

        def of(got: Column) -> Column:
            plain = tx.normalised(jv.nfc(got["text"]))
            n = F.size(tx.words(plain))
            length = F.when(~n.between(rule["least"], rule["most"]), said(F.lit(" has "), n.cast("string"), F.lit(" words")))
            lacking = F.transform(F.filter(rule["terms"], lambda w: ~F.contains(F.lower(plain), w)), lambda w: said(F.lit(" lacks "), w))
            none = F.array().cast("array<string>")
            return F.when(got.isNull() | (got["kind"] == "null"), none).when(got["kind"] != "string", F.array(said(F.lit(" is no text")))).otherwise(F.concat(_known(F.array(length)), lacking))

        return tx.once(jv.scalar(field(rule["field"])), of)

    return F.concat(
        call, absent, F.transform(extra, lambda f: F.concat(where, f, F.lit(" is not allowed"))), _expected_faults(root, spec["expected"]),
        _known(F.transform(spec["numbers"], number)), F.flatten(F.transform(spec["open"], free)),
    )


RESULT = "struct<grader_type:string,passed:boolean,detail:string,violations:array<string>>"


def graded(t: Column, spec: Column, kind: Column | str) -> Column:
    """The result of ``structured`` or ``tool_call`` (a column may say which) for an output and a specification, both columns."""
    what = F.lit(kind) if isinstance(kind, str) else kind
    failed = lambda why: F.struct(what, F.lit(False), F.lit(why), F.array().cast("array<string>")).cast(RESULT)

    def of(root: Column, spec: Column) -> Column:
        judged = tx.once(tx.once(jv.members(root), lambda own: faults(root, own, spec)), lambda f: F.struct(what, F.size(f) == 0, F.when(F.size(f) == 0, "as specified").otherwise("violations"), f).cast(RESULT))
        return F.when(F.to_json(root).isNull(), failed("not valid JSON")).when(jv.members(root).isNull(), failed("no JSON object")).otherwise(judged)

    return tx.once(spec, lambda s: tx.once(jv.tagged(jv.body(t)), lambda root: of(root, s)))
