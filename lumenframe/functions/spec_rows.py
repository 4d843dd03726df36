"""Graders whose specifications are rows: one join and one dispatch by type, so a plan is as long for a million tasks as for one.

``compiled`` turns specifications (JSON texts) into structs of arrays; ``grade``
joins them with outputs and gives the results that ``graders.results`` gives.
Only the compilation runs Python, on specifications, never on outputs.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import json_values as jv
from lumenframe.functions import structured
from lumenframe.functions import text as tx

RESULT = structured.RESULT
#: A constraint: n, least, most: numbers asked for; one, many: texts or patterns; shown: how they are spelled in a violation; index: an item, from 1.
CONSTRAINT = "struct<kind:string,n:int,least:int,most:int,one:string,many:array<string>,shown:array<string>,index:int,whole:boolean,mode:string>"
#: A grader: forms: accepted texts; numbers: accepted numbers; x, room: a number and its tolerance; clock: h, m, s.
GRADER = (
    f"struct<type:string,good:string,bad:string,forms:array<string>,trim:boolean,fold:boolean,numbers:array<double>,x:double,room:double,clock:array<int>,spoken:boolean,"
    f"rules:array<{CONSTRAINT}>,groups:array<array<string>>,wanted:boolean,json:{structured.SPEC}>"
)


# compilation


def _words_pattern(term: str, how: str) -> str:
    q = f"(?iu){tx.quote(term)}"
    if how == "word":
        return rf"(?iu)(?<![\p{{L}}\p{{N}}_]){tx.quote(term)}(?![\p{{L}}\p{{N}}_])"
    if how == "substring":
        return q
    raise ValueError(f"no such way to match: {how}")


def constraint(c: dict) -> dict:
    """A constraint's struct from the names that specifications use."""
    kind, put = c["kind"], {"kind": c["kind"]}
    rename = {"value": "n", "count": "n", "data_rows": "n", "min": "least", "max": "most", "max_words": "most", "word": "one", "prefix": "one", "literal": "one", "suffix": "one", "term": "one", "terms": "many", "chars": "many", "columns": "many", "prefixes": "many", "lines": "many", "index": "index"}
    put |= {rename[k]: v for k, v in c.items() if k in rename}
    put["shown"] = [repr(x) for x in put.get("many", [])]
    if kind == "term_occurrence":
        put |= {"shown": [repr(c["term"])], "mode": c.get("occurrence", "exactly")}
        put["one"] = _words_pattern(c["term"], c.get("match", "substring") if put["mode"] == "across_values" else "substring")
    elif kind == "forbidden_terms":
        put["many"] = [_words_pattern(x, "substring") for x in c["terms"]]
    elif kind == "required_terms":
        put["many"] = [x.lower() for x in c["terms"]]
    elif kind == "sentence_contains":
        terms = [*(c.get("terms") or []), *([c["term"]] if "term" in c else [])]
        put |= {"many": [x.lower() for x in terms], "one": terms[0].lower() if terms else "", "whole": bool(c.get("all_sentences"))}
    elif kind == "line_contains":
        put["one"] = c["term"].lower()
    return put


def grader(spec: dict) -> dict:
    """A grader's struct from its specification."""
    from lumenframe.functions import graders

    kind = spec["type"]
    out = {"type": kind}
    if kind == "exact":
        wanted = [str(spec["expected"]), *map(str, spec.get("accepted_alternates", []))]
        trim, fold = spec.get("trim_outer_whitespace", True), not spec.get("case_sensitive", True)
        forms = [tx.plain(w) if trim else re.sub(r"\r\n?", "\n", unicodedata.normalize("NFC", w)) for w in wanted]
        numbers = [n for n in map(structured._number, wanted) if n is not None] if spec.get("numeric_alias_match") else []
        return out | {"good": "exact match", "bad": f"expected {wanted[0]!r}", "forms": [f.lower() for f in forms] if fold else forms, "trim": trim, "fold": fold, "numbers": numbers}
    if kind == "numeric":
        want = float(spec["expected"])
        return out | {"good": "within tolerance", "bad": f"expected {want}", "x": want, "room": max(float(spec.get("absolute_tolerance", 0)), float(spec.get("relative_tolerance", 0)) * abs(want))}
    if kind == "time":
        forms = spec.get("parsing") or ["HH:MM"]
        spoken = any(f.upper().replace(" ", "").removeprefix("H:MM") in ("AM", "PM", "A.M.", "P.M.") for f in forms)
        found = re.match(r"(?i)^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(am|pm|a\.m\.|p\.m\.)?\s*$", tx.plain(str(spec["expected"])))
        clock = None
        if found and (spoken or len(found[1]) == 2 and not found[4]):
            h, mark = int(found[1]), (found[4] or "").lower().replace(".", "")
            h = h + 12 if mark == "pm" and h != 12 else 0 if mark == "am" and h == 12 else h
            clock = [h, int(found[2]), int(found[3] or 0)]
        return out | {"good": "time matches", "bad": "another time than expected" if clock else "bad expected time in spec", "clock": clock, "spoken": spoken, "trim": spec.get("precision") == "minute"}
    if kind == "constraints":
        return out | {"good": "all constraints satisfied", "bad": "violations", "rules": [constraint(c) for c in spec["constraints"]]}
    if kind == "fact_check":
        facts = lambda k, names, shown: {"kind": k, "many": [str(f).lower() for f in names], "shown": [f"{shown}: {f!r}" for f in names]}
        groups = spec.get("required_fact_groups", [])
        limits = []
        for k, keys in (("word_limit", {}), ("word_range", {}), ("sentence_count", {}), ("bullet_count", {}), ("bullet_word_limit", {"max_words": "max"})):
            if k in spec:
                limits.append(constraint({"kind": k, **spec[k], **{a: spec[k][b] for a, b in keys.items()}}))
        rules = [facts("facts", spec.get("required_facts", []), "missing fact"), {"kind": "groups", "shown": [f"missing fact group: {g.get('any_of', [])}" for g in groups]}, facts("no_facts", spec.get("forbidden_facts", []), "forbidden fact present"), *limits]
        return out | {"good": "facts preserved", "bad": "violations", "rules": rules, "groups": [[str(f).lower() for f in g.get("any_of", [])] for g in groups]}
    if kind == "refusal":
        return out | {"good": "as expected", "bad": "not as expected", "wanted": bool(spec["refusal_expected"]), "forms": [*graders.REFUSALS, *[m.replace(" ", "_") for m in graders.REFUSALS]], "numbers": [float(len(graders.REFUSALS))]}
    if kind == "rubric_judge":
        n = len(spec.get("criteria") or [])
        return out | {"good": f"left to a judge: {n} criteria", "bad": "rubric judge requires criteria", "wanted": n > 0}
    if kind == "structured":
        return out | {"json": structured.structured_spec(spec)}
    if kind == "tool_call":
        return out | {"json": structured.call_spec(spec)}
    raise ValueError(f"no such grader: {kind}")


def compiled(specs: DataFrame, task: str = "task_id", spec: str = "spec") -> DataFrame:
    """(task, spec: JSON text of a list of graders) -> (task, graders). A task without graders has none; a null text is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"task": b["task"], "made": [json.dumps([grader(s) for s in json.loads(x or "[]")]) for x in b["spec"]]})

    kept = specs.select(F.col(task).cast("string").alias("task"), F.col(spec).cast("string").alias("spec"))
    made = kept.mapInPandas(run, "task string, made string")
    return made.select(F.col("task").cast(specs.schema[task].dataType).alias(task), F.from_json("made", f"array<{GRADER}>").alias("graders"))


# dispatch


def _item(values: Column, c: Column) -> Column:
    return F.when(c["index"] > 0, F.get(values, c["index"] - 1))


def _lacks(values: Column, bad) -> Column:
    return ~F.exists(values, bad)


def holds(t: Column, low: Column, c: Column) -> Column:
    """Whether a normalised text (``low``: in lower case) meets a constraint, by its kind."""
    items, bullet = tx.numbered_items(t), lambda: tx.bullet_text(F.when(c["index"] == -1, F.try_element_at(tx.bullets(t), F.lit(-1))).otherwise(_item(tx.bullets(t), c)))
    strings = F.filter(F.transform(F.map_values(jv.members(jv.tagged(jv.body(t)))), jv.scalar), lambda x: x["kind"] == "string")
    sentence = _item(tx.sentences(t), c)
    rows = F.filter(F.split(t, "\n"), lambda r: r.rlike(rf"^{tx.SPACE}*\|"))
    header = F.transform(F.split(F.regexp_replace(F.get(rows, F.lit(0)), r"^\|+|\|+$", ""), r"\|"), tx._stripped)
    data = F.filter(F.slice(rows, 3, F.greatest(F.size(rows), F.lit(1))), lambda r: ~r.rlike(rf"^{tx.SPACE}*\|?(?:{tx.SPACE}|[:|-])+\|?{tx.SPACE}*$"))
    kinds = {
        "word_count": F.size(tx.words(t)) == c["n"], "word_range": F.size(tx.words(t)).between(c["least"], c["most"]), "word_limit": F.size(tx.words(t)) <= c["most"],
        "first_word": tx._bare(F.get(tx.words(t), F.lit(0))) == c["one"], "last_word": tx._bare(F.try_element_at(tx.words(t), F.lit(-1))) == c["one"],
        "term_occurrence": F.when(c["mode"] == "across_values", F.size(F.filter(strings, lambda x: F.rlike(x["text"], c["one"]))) == c["n"]).when(c["mode"] == "exactly", F.regexp_count(t, c["one"]) == c["n"]).otherwise(F.lit(True)),
        "forbidden_terms": _lacks(c["many"], lambda x: F.rlike(t, x)), "forbidden_chars": _lacks(c["many"], lambda x: F.contains(t, x)), "required_terms": F.forall(c["many"], lambda x: F.contains(low, x)),
        "allowed_punctuation": tx.CONSTRAINTS["allowed_punctuation"](t, {}), "first_prefix": tx._stripped(F.get(F.split(t, "\n"), F.lit(0))).startswith(c["one"]),
        "parenthetical_count": (F.regexp_count(t, F.lit(r"\(")) == c["n"]) & (F.regexp_count(t, F.lit(r"\)")) == c["n"]), "bullet_count": F.size(tx.bullets(t)) == c["n"],
        "numbered_list_count": F.regexp_count(t, F.lit(rf"(?md)^{tx.SPACE}*\d+[.)]{tx.SPACE}+")) == c["n"], "item_prefix": _item(items, c).startswith(c["one"]), "item_contains": F.contains(_item(items, c), c["one"]),
        "item_excludes_chars": tx.once(_item(items, c), lambda x: x.isNotNull() & _lacks(c["many"], lambda y: F.contains(x, y))),
        "item_sentence_count": F.when(c["index"].isNotNull(), tx._endings(_item(items, c)) == c["n"]).otherwise((F.size(items) > 0) & F.forall(items, lambda x: tx._endings(x) == c["n"])),
        "sentence_count": F.size(tx.sentences(t)) == c["n"],
        "sentence_contains": F.when(c["whole"], F.forall(tx.sentences(t), lambda s: F.contains(F.lower(s), c["one"]))).when(F.coalesce(c["index"], F.lit(0)) != 0, sentence.isNotNull() & F.forall(c["many"], lambda x: F.contains(F.lower(sentence), x))).otherwise(F.lit(True)),
        "sentence_numeric_tokens": F.regexp_count(sentence, F.lit(r"\d+(?:\.\d+)?")).between(c["least"], c["most"]), "sentence_is_question": tx._stripped(sentence).endswith("?"),
        "markdown_table_shape": (F.size(rows) >= 3) & (header == c["many"]) & (F.size(data) == c["n"]), "trailing_literal": tx._stripped(t).endswith(c["one"]), "line_count": F.size(tx.lines(t)) == c["n"],
        "line_prefix_sequence": F.forall(F.transform(c["many"], lambda p, i: tx._stripped(F.get(tx.lines(t), i)).startswith(p)), lambda x: F.coalesce(x, F.lit(False))),
        "line_word_limit": F.forall(tx.lines(t), lambda x: F.size(tx.words(x)) <= c["most"]), "line_contains": F.forall(c["many"], lambda x: F.coalesce(F.contains(F.lower(F.get(tx.lines(t), F.ascii(x) - 65)), c["one"]), F.lit(False))),
        "bullet_prefix": bullet().startswith(c["one"]), "bullet_word_limit": F.forall(tx.bullets(t), lambda x: F.size(tx.words(tx.bullet_text(x))) <= c["most"]),
        "ends_with": tx._stripped(t).endswith(c["one"]), "required_prefix": t.startswith(c["one"]),
    }
    return F.coalesce(_by(c["kind"], kinds), F.lit(False))


def _by(kind: Column, branches: dict[str, Column]) -> Column:
    """The branch of a kind; null for any other. Only the branch that is meant is computed."""
    out = None
    for k, v in branches.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out


def _marks(values: Column, shown: Column, bad, before: Column | None = None) -> Column:
    """One text per element that breaks a rule."""
    said = lambda s: s if before is None else F.concat(before, s)
    return structured._known(F.zip_with(values, shown, lambda x, s: F.when(bad(x), said(s))))


def found(t: Column, low: Column, groups: Column, c: Column) -> Column:
    """What breaks a constraint: array<string>, each text with its kind first."""
    name = F.concat(c["kind"], F.lit(": "))
    count = lambda n: F.array(F.concat(name, n.cast("string"), F.lit(" found")))
    numbered = lambda values, bad, what: structured._known(F.transform(values, lambda x, i: F.when(bad(x, i), F.concat(name, F.lit(what), (i + 1).cast("string")))))
    line = lambda i: F.get(tx.lines(t), i)
    said = {
        **{k: count(F.size(tx.words(t))) for k in ("word_count", "word_range", "word_limit")}, "sentence_count": count(F.size(tx.sentences(t))), "bullet_count": count(F.size(tx.bullets(t))),
        "numbered_list_count": count(F.regexp_count(t, F.lit(rf"(?md)^{tx.SPACE}*\d+[.)]{tx.SPACE}+"))), "line_count": count(F.size(tx.lines(t))),
        "first_word": F.array(F.concat(name, F.coalesce(F.get(tx.words(t), F.lit(0)), F.lit("none")))), "last_word": F.array(F.concat(name, F.coalesce(F.try_element_at(tx.words(t), F.lit(-1)), F.lit("none")))),
        "term_occurrence": F.array(F.concat(F.lit("term_occurrence("), F.get(c["shown"], F.lit(0)), F.lit("): "), F.regexp_count(t, c["one"]).cast("string"), F.lit(" found"))),
        "forbidden_terms": _marks(c["many"], c["shown"], lambda x: F.rlike(t, x), name), "required_terms": _marks(c["many"], c["shown"], lambda x: ~F.contains(low, x), name),
        "forbidden_chars": _marks(c["many"], c["shown"], lambda x: F.contains(t, x), name),
        "line_contains": _marks(c["many"], c["shown"], lambda x: ~F.coalesce(F.contains(F.lower(line(F.ascii(x) - 65)), c["one"]), F.lit(False)), name),
        "line_word_limit": numbered(tx.lines(t), lambda x, i: F.size(tx.words(x)) > c["most"], "number "),
        "bullet_word_limit": numbered(tx.bullets(t), lambda x, i: F.size(tx.words(tx.bullet_text(x))) > c["most"], "number "),
        "line_prefix_sequence": numbered(c["many"], lambda p, i: ~F.coalesce(tx._stripped(line(i)).startswith(p), F.lit(False)), "line "),
        "facts": _marks(c["many"], c["shown"], lambda x: ~F.contains(low, x)), "no_facts": _marks(c["many"], c["shown"], lambda x: F.contains(low, x)),
        "groups": _marks(groups, c["shown"], lambda g: ~F.exists(g, lambda x: F.contains(low, x))),
    }
    return F.coalesce(_by(c["kind"], said), F.array(F.concat(name, F.lit("not met"))))


def result(t: Column, g: Column) -> Column:
    """The result of a grader (a struct of ``GRADER``) for an output."""
    none = F.array().cast("array<string>")
    verdict = lambda ok, bad=None: tx.once(F.coalesce(ok, F.lit(False)), lambda x: F.struct(g["type"], x, F.when(x, g["good"]).otherwise(g["bad"] if bad is None else bad), none).cast(RESULT))

    def of(c: Column) -> Column:
        form = F.when(g["trim"], c).otherwise(F.coalesce(t, F.lit("")))
        exact = F.array_contains(g["forms"], F.when(g["fold"], F.lower(form)).otherwise(form)) | F.coalesce(F.array_contains(g["numbers"], structured.first_number(t)), F.lit(False))
        number = tx.bare_number(c)
        clock = tx.once(F.when(g["spoken"], tx.time_parts(c, True, True)).otherwise(tx.time_parts(c)), lambda p: F.struct(p.isNotNull().alias("read"), ((p["h"] == F.get(g["clock"], F.lit(0))) & (p["m"] == F.get(g["clock"], F.lit(1))) & (g["trim"] | (p["s"] == F.get(g["clock"], F.lit(2))))).alias("same")))
        timed = tx.once(clock, lambda p: verdict(p["same"], F.when(g["clock"].isNull() | p["read"], g["bad"]).otherwise("could not parse time")))
        said = F.regexp_replace(F.lower(c), r"[.!?]+$", "")
        plain_forms = F.slice(g["forms"], 1, F.get(g["numbers"], F.lit(0)).cast("int"))
        refused = F.array_contains(plain_forms, F.regexp_replace(said, r"[\s_]+$", "")) | F.array_contains(g["forms"], said)
        own = ("facts", "no_facts", "groups")
        broken = tx.once(F.lower(c), lambda low: F.flatten(F.transform(g["rules"], lambda r: F.when(~r["kind"].isin(*own) & holds(c, low, r), none).when(
            r["kind"].isin(*own) | (g["type"] == "constraints"), found(c, low, g["groups"], r)).otherwise(F.array(r["kind"])))))
        ruled = tx.once(broken, lambda b: F.struct(g["type"], F.size(b) == 0, F.when(F.size(b) == 0, g["good"]).otherwise(g["bad"]), b).cast(RESULT))
        return _by(g["type"], {
            "exact": verdict(exact), "numeric": verdict(F.abs(number - g["x"]) <= g["room"], F.when(number.isNull(), "output is not a bare number").otherwise(g["bad"])), "time": timed,
            "constraints": ruled, "fact_check": ruled, "refusal": verdict(refused == g["wanted"]), "rubric_judge": verdict(g["wanted"]),
        }).otherwise(F.when(g["json"].isNotNull(), structured.graded(t, g["json"], g["type"])))

    return tx.once(jv.cleaned(t), of)


def grade(outputs: DataFrame, specs: DataFrame, text: str, task: str = "task_id", name: str = "results") -> DataFrame:
    """Outputs with the results of their task's graders, in order; null for a task without a specification. ``specs`` is ``compiled``."""

    def build() -> DataFrame:
        both = outputs.join(specs.withColumnRenamed("graders", "_graders"), task, "left")
        return both.withColumn(name, F.transform("_graders", lambda g: result(F.col(text), g))).drop("_graders")

    return jv.last_key_wins(outputs.sparkSession, build)
