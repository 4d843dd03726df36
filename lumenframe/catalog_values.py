"""Queries over outputs read as values: JSON graders, graders by specification rows, judge responses, decimals, resumed runs. Each has SQL written apart from its plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import failures, graders, judge_responses, spec_rows, structured
from lumenframe.functions import json_values as jv
from lumenframe.plans.attempts import ATTEMPTS_SQL, attempts
from lumenframe.plans.staged import shared_dir, stage_table
from lumenframe.plans.trials import table
from lumenframe.streaming import resume

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


# JSON values
_X18_SQL = """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'UNPARSEABLE' ELSE '{"a":"' || source || '","b":[' || n_chars || ',{"x":1.5,"y":' || coalesce('"' || lang || '"', 'null') || '}],"c":[[],{}]}' END AS class FROM documents"""


@query("x18_canonical_classes", _X18_SQL)
def canonical_classes(spark, sf_dir):
    """One class however keys are ordered, blanks set and fractions spelled; what is cut short is no JSON."""
    n, lang = F.col("n_chars").cast("string"), F.coalesce(F.concat(F.lit('"'), F.col("lang"), F.lit('"')), F.lit("null"))
    x = F.when(F.col("doc_id") % 3 == 0, "1.5").when(F.col("doc_id") % 3 == 1, "1.50").otherwise("15e-1")
    inner = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit('{"x" : '), x, F.lit(', "y":'), lang, F.lit("}"))).otherwise(F.concat(F.lit('{"y":'), lang, F.lit(',\n"x":'), x, F.lit("}")))
    a, b = F.concat(F.lit('"a": "'), F.col("source"), F.lit('"')), F.concat(F.lit('"b" :['), n, F.lit(" , "), inner, F.lit("]"))
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("{"), a, F.lit(","), b, F.lit(', "c": [[ ], { }]}'))).otherwise(F.concat(F.lit(' {"c":[[],{}] , '), b, F.lit(" ,"), a, F.lit("}\n")))
    said = F.when(F.col("doc_id") % 11 == 0, F.concat(said, F.lit("}"))).otherwise(said)
    return table(spark, sf_dir, "documents").select("doc_id", jv.canonical(said).alias("class"))


@query("j17_unordered_match", r"""WITH w AS (SELECT doc_id, lang, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')[1:8] AS got FROM documents),
  v AS (SELECT doc_id, got, list_reverse(got) || [lang] AS want FROM w),
  c AS (SELECT doc_id, x, count(*) FILTER (side = 'w') AS nw, count(*) FILTER (side = 'g') AS ng FROM
    (SELECT doc_id, unnest(want) AS x, 'w' AS side FROM v UNION ALL SELECT doc_id, unnest([x for x in got if length(x) <> 4] || [got[1]]), 'g' FROM v) GROUP BY 1, 2)
  SELECT d.doc_id, coalesce(n, 0)::INT AS unmatched FROM documents d LEFT JOIN (SELECT doc_id, sum(greatest(nw - ng, 0)) AS n FROM c WHERE x IS NOT NULL GROUP BY 1) USING (doc_id)""")
def unordered_match(spark, sf_dir):
    """Elements of one list that find no free element of the other, both JSON arrays read back: the words of a text, reversed, and its language against those words that have not four letters and the first once more."""
    d = table(spark, sf_dir, "documents")
    words = F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)), 1, 8)
    some = lambda c: F.filter(c, lambda x: x.isNotNull())
    want, got = some(F.concat(F.reverse(words), F.array("lang"))), some(F.concat(F.filter(words, lambda x: F.length(x) != 4), F.array(F.get(words, F.lit(0)))))
    read = lambda c: F.transform(jv.elements(jv.tagged(F.to_json(c))), jv.scalar)
    sides = d.select("doc_id", read(want).alias("w"), read(got).alias("g"))
    return sides.select("doc_id", F.size(structured.unmatched(F.col("w"), F.col("g"))).alias("unmatched"))


@query("r04_structured_grader", """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN false ELSE abs(CAST(json_extract_string(props, '$.k') AS DOUBLE) - 50) <= 25 AND value >= 20 AND event_type <> 'view'
    AND length(event_type) > 4 END AS passed FROM events""")
def structured_grader(spark, sf_dir):
    """Fields, a nested object, a list in any order, a number within a string and a free text; every ninth output is cut short."""
    spec = {
        "required_fields": ["k", "in", "note"], "allow_extra_fields": False, "numeric_fields": {"k": {"expected": 50, "absolute_tolerance": 25}},
        "expected_output": {"in": {"fast": True, "kinds": [1, "one", {"deep": [1.0, None]}]}}, "open_values": [{"field": "note", "word_range": {"min": 2, "max": 2}}],
    }
    kinds = F.when(F.col("event_type") == "view", '["one", {"deep": [1, null]}, 2]').otherwise('[{"deep": [1, null]}, "about 1", "one"]')
    note = F.when(F.length("event_type") > 4, "two words").otherwise("one")
    k = F.get_json_object("props", "$.k")
    said = F.concat(F.lit('```json\n{"note": "'), note, F.lit('", "k": "'), k, F.lit(' in all", "in": {"fast": '), (F.col("value") >= 20).cast("string"), F.lit(', "other": 0, "kinds": '), kinds, F.lit("}}\n```"))
    said = F.when(F.col("event_id") % 9 == 0, F.left(said, F.length(said) - 6)).otherwise(said)
    return table(spark, sf_dir, "events").select("event_id", graders.structured(said, spec)["passed"].alias("passed"))


@query("r05_tool_call_grader", """SELECT doc_id, doc_id % 4 <> 0 AND n_chars % 5 <> 0 AND n_chars % 2 = 0 AND doc_id % 7 <> 0 AS passed,
  (doc_id % 4 = 0)::INT + (n_chars % 5 = 0)::INT + (n_chars % 2 <> 0)::INT + (doc_id % 7 = 0)::INT + (doc_id % 4 = 0)::INT AS violations FROM documents WHERE lang IS NOT NULL""")
def tool_call_grader(spark, sf_dir):
    """Calls graded by a specification row per language: function, a forbidden one, arguments, one that is not taken."""
    d = table(spark, sf_dir, "documents").where("lang is not null")
    spec = F.concat(F.lit('[{"type": "tool_call", "forbidden_functions": ["close"], "required_arguments": {"open": ["lang", "even", "n"]}, "expected_output": {"function": "open", "arguments": {"even": true, "lang": "'), F.col("lang"), F.lit('"}}}]'))
    specs = d.select("lang").distinct().select("lang", spec.alias("spec"))
    said = F.concat(
        F.lit('{"arguments": {"n": '), F.col("n_chars").cast("string"), F.lit(', "even": '), (F.col("n_chars") % 2 == 0).cast("string"), F.when(F.col("doc_id") % 7 == 0, ', "z": null').otherwise(""),
        F.lit(', "lang": " '), F.when(F.col("n_chars") % 5 == 0, "xx").otherwise(F.col("lang")), F.lit('\\n"}, "function": "'), F.when(F.col("doc_id") % 4 == 0, "close").otherwise("open"), F.lit('"}'),
    )
    out = spec_rows.grade(d.select("doc_id", "lang", said.alias("said")), spec_rows.compiled(specs, "lang"), "said", "lang")
    return out.select("doc_id", F.col("results")[0]["passed"].alias("passed"), F.size(F.col("results")[0]["violations"]).alias("violations"))


@query("j07_graded_by_spec_rows", """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 6
    WHEN 0 THEN q = p_size WHEN 1 THEN abs(q - p_size) <= 5 WHEN 2 THEN q % 7 + 1 <= p_size % 7 + 1 AND l_linestatus = 'O' WHEN 3 THEN contains(lower(p_brand), lower(l_returnflag)) WHEN 4 THEN (q > 25) = (p_size % 2 = 0)
    ELSE q % 24 = p_size % 24 END AS passed
  FROM (SELECT *, l_quantity::INT AS q FROM lineitem) JOIN part ON p_partkey = l_partkey""")
def graded_by_spec_rows(spark, sf_dir):
    """Every line's output graded by its part's specification: exact, numeric, constraints, facts, refusals and times, made from the parts."""
    part, q = table(spark, sf_dir, "part"), F.col("l_quantity").cast("int")
    size, kind, text = F.col("p_size"), F.col("p_partkey") % 6, lambda c: c.cast("string")
    spec = F.when(kind == 0, F.concat(F.lit('[{"type": "exact", "expected": '), text(size), F.lit("}]"))).when(
        kind == 1, F.concat(F.lit('[{"type": "numeric", "absolute_tolerance": 5, "expected": '), text(size), F.lit("}]"))
    ).when(
        kind == 2, F.concat(F.lit('[{"type": "constraints", "constraints": [{"kind": "required_terms", "terms": ["o"]}, {"kind": "word_limit", "max": '), text(size % 7 + 1), F.lit("}]}]"))
    ).when(kind == 3, F.lit('[{"type": "fact_check", "required_facts": ["yes"]}]')).when(
        kind == 4, F.concat(F.lit('[{"type": "refusal", "refusal_expected": '), text(size % 2 == 0), F.lit("}]"))
    ).otherwise(F.concat(F.lit('[{"type": "time", "precision": "minute", "expected": "'), F.lpad(text(size % 24), 2, "0"), F.lit(':30"}]')))
    specs = spec_rows.compiled(part.select("p_partkey", spec.alias("spec")), "p_partkey").withColumnRenamed("p_partkey", "l_partkey")
    lines = table(spark, sf_dir, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    mine = F.col("l_partkey") % 6
    said = F.when(mine == 0, F.concat(F.lit(" "), text(q), F.lit("\r\n"))).when(mine == 1, F.concat(text(q), F.lit(".0."))).when(mine == 2, F.trim(F.repeat(F.concat(F.col("l_linestatus"), F.lit(" ")), q % 7 + 1))).when(
        mine == 3, F.when(F.contains(F.lower("p_brand"), F.lower("l_returnflag")), "Yes, it is.").otherwise("No.")
    ).when(mine == 4, F.when(q > 25, "Cannot determine.").otherwise("It is so.")).otherwise(F.concat(F.lpad(text(q % 24), 2, "0"), F.lit(":30:"), F.lpad(text(q), 2, "0")))
    out = spec_rows.grade(lines.select("l_orderkey", "l_linenumber", "l_partkey", said.alias("said")), specs, "said", "l_partkey")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("results")[0]["passed"].alias("passed"))


# judge responses
@query("x42_rubric_responses", """SELECT conv_id, turn, CASE WHEN conv_id % 5 = 2 THEN 'the response has another schema' WHEN conv_id % 5 = 3 THEN 'other criteria than the rubric''s' WHEN role = 'system' THEN 'c1: no such confidence' END AS error,
  CASE WHEN conv_id % 5 IN (2, 3) OR role = 'system' THEN NULL ELSE role = 'user' END AS observed,
  CASE WHEN conv_id % 5 IN (2, 3) OR role = 'system' THEN NULL WHEN conv_id % 5 = 4 THEN contains(text, 'en ')::INT ELSE 1 + contains(text, 'queai')::INT + contains(text, 'th')::INT END AS evidence,
  CASE WHEN conv_id % 5 IN (2, 3) OR role = 'system' THEN NULL WHEN conv_id % 5 = 4 THEN 3 - contains(text, 'en ')::INT ELSE 4 - contains(text, 'queai')::INT - contains(text, 'th')::INT END AS pruned FROM conversations""")
def rubric_responses(spark, sf_dir):
    """Responses about a turn's text, as objects, lists and with a single quote; evidence stays if it stands in the text."""
    c = F.col("conv_id") % 5
    rows = table(spark, sf_dir, "conversations")
    confidence = F.when(F.col("role") == "system", "sure").otherwise("medium")
    head = lambda v: F.concat(F.lit(f'{{"schema_version": "judge-rubric-v{v}", "abstain": false, "pruned_evidence": 2, "criteria": '))
    entry = lambda ident, evidence: F.concat(F.lit("{"), F.lit(ident), F.lit('"observed": '), (F.col("role") == "user").cast("string"), F.lit(', "confidence": "'), confidence, F.lit('", "evidence": '), evidence, F.lit("}"))
    written = F.expr("substring(to_json(array(left(text, 12))), 2, length(to_json(array(left(text, 12)))) - 2)")
    quotes = F.concat(F.lit('[{"quote": '), written, F.lit('}, "queai", {"text": "th"}]'))
    response = (
        F.when(c == 0, F.concat(head(1), F.lit('{"c1": '), entry("", quotes), F.lit("}}")))
        .when(c == 1, F.concat(F.lit("```"), head(1), F.lit("["), entry('"id": "c1", ', quotes), F.lit("]}\n```")))
        .when(c == 2, F.concat(head(0), F.lit('{"c1": '), entry("", quotes), F.lit("}}")))
        .when(c == 3, F.concat(head(1), F.lit('{"c2": '), entry("", quotes), F.lit("}}")))
        .otherwise(F.concat(head(1), F.lit('{"c1": '), entry("", F.lit('"en "')), F.lit("}}")))
    )
    parsed = rows.select("conv_id", "turn", judge_responses.parse_rubric(response, F.array(F.lit("c1")), F.col("text")).alias("r"))
    one = F.try_element_at(F.col("r.criteria"), F.lit("c1"))
    return parsed.select("conv_id", "turn", "r.error", one["observed"].alias("observed"), F.when(one.isNotNull(), F.size(one["evidence"])).alias("evidence"), F.col("r.pruned_evidence").alias("pruned"))


@query("x43_pair_responses", """SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'no such decision' END AS error, CASE role WHEN 'user' THEN 'A' WHEN 'assistant' THEN 'B' END AS decision,
  CASE WHEN role <> 'system' THEN CASE conv_id % 3 WHEN 0 THEN contains(text, 'th')::INT + contains(upper(text), 'EN')::INT WHEN 1 THEN contains(text, 'ou')::INT ELSE contains(upper(text), 'OU')::INT + 1 END END AS evidence,
  CASE WHEN role <> 'system' THEN CASE conv_id % 3 WHEN 0 THEN 2 - contains(text, 'th')::INT - contains(upper(text), 'EN')::INT WHEN 1 THEN 1 - contains(text, 'ou')::INT ELSE 2 - contains(upper(text), 'OU')::INT END END AS pruned FROM conversations""")
def pair_responses(spark, sf_dir):
    """Responses about a text and its capitals, with evidence as a map, one object and a list."""
    c, decision = F.col("conv_id") % 3, F.when(F.col("role") == "user", "A").when(F.col("role") == "assistant", "B").otherwise("C")
    evidence = F.when(c == 0, '{"A": "th", "B": {"quote": "EN"}}').when(c == 1, '{"label": "A", "text": "ou"}').otherwise('[{"candidate": "B", "quote": "OU"}, "A", {"candidate": "A", "text": ""}]')
    response = F.concat(F.lit('{"schema_version": "judge-pair-v1", "abstain": true, "confidence": "high", "decision": "'), decision, F.lit('", "evidence": '), evidence, F.lit("}"))
    parsed = table(spark, sf_dir, "conversations").select("conv_id", "turn", judge_responses.parse_pair(response, F.col("text"), F.upper("text")).alias("r"))
    return parsed.select("conv_id", "turn", "r.error", "r.decision", F.when(F.col("r.error").isNull(), F.size("r.evidence")).alias("evidence"), F.col("r.pruned_evidence").alias("pruned"))


# decimals
@query("x33_render_numeric", """WITH v AS (SELECT p_partkey, ltrim(p_size || lpad((p_partkey % 1000)::VARCHAR, 3, '0'), '0') AS d, length(p_size::VARCHAR) + p_partkey % 401 - 200 - (length(p_size || '000') - length(ltrim(p_size || lpad((p_partkey % 1000)::VARCHAR, 3, '0'), '0'))) AS p FROM part),
  t AS (SELECT p_partkey, rtrim(d, '0') AS d, p FROM v),
  s AS (SELECT p_partkey, CASE WHEN d = '' THEN '0' WHEN p >= length(d) THEN d || repeat('0', p - length(d)) WHEN p > 0 THEN d[1:p] || '.' || d[p + 1:] ELSE '0.' || repeat('0', -p) || d END AS s FROM t)
  SELECT p_partkey, CASE WHEN length(s) <= 128 - (p_partkey % 2) THEN CASE WHEN p_partkey % 2 = 1 AND s <> '0' THEN '-' ELSE '' END || s END AS rendered FROM s""")
def rendered(spark, sf_dir):
    """Answers with exponents from -200 to 200, spelled plainly."""
    n = F.col("p_partkey")
    said = F.concat(F.lit("so\nThe 7th\nFinal answer is: "), F.when(n % 2 == 1, "-").otherwise(""), F.col("p_size").cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"), F.lit("e"), (n % 401 - 200).cast("string"), F.lit(" \n\n"))
    return table(spark, sf_dir, "part").select("p_partkey", failures.render_numeric(said).alias("rendered"))


# runs that are resumed
def _attempts_query(name: str, sql: str, f) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(attempts(spark, sf_dir))
    SQL[name] = "WITH " + ATTEMPTS_SQL + "\n" + sql


_attempts_query("t02_rows_until_done", """SELECT run_id FROM (SELECT run_id, min(CASE WHEN status = 'COMPLETE' AND verdict = 'PASS' THEN run_id END) OVER (PARTITION BY model_config_id, task_id, k % 3) AS first FROM attempts) WHERE first IS NULL OR run_id <= first""",
    lambda a: resume.not_done_batch(a.select("run_id", "model_config_id", "task_id", (F.col("k") % 3).alias("slot"), F.when(F.col("verdict") == "PASS", F.col("status")).alias("status")), ["model_config_id", "task_id", "slot"]).select("run_id"))
_attempts_query("t03_reloads_since_warm_up", """SELECT model_config_id, segment, count(*) FILTER (NOT is_warmup) AS rows, count(*) FILTER (NOT is_warmup AND value > 25) AS reloads, max(run_id) FILTER (is_warmup) AS closed_by
  FROM (SELECT *, (sum(is_warmup::INT) OVER (PARTITION BY model_config_id ORDER BY run_id))::BIGINT - is_warmup::BIGINT AS segment FROM attempts) GROUP BY 1, 2 HAVING bool_or(is_warmup)""",
    lambda a: resume.since_warm_up_batch(a.select("run_id", "model_config_id", "is_warmup", "value"), ["model_config_id"], load="value", limit=25.0))


def _committed(a):
    """Attempts committed in four batches, two of them run again."""
    rows = stage_table(a.select("run_id", "model_config_id", "verdict"), "attempts")
    folder = f"{shared_dir(a.sparkSession)}/lumenframe/committed-{rows._lumen_path.rpartition('-')[2]}"
    for batch in (0, 1, 1, 2, 0, 3):
        resume.commit(rows.where(F.col("run_id") % 4 == batch), batch, folder)
    return resume.committed(a.sparkSession, folder).groupBy("model_config_id", "verdict").agg(F.count("*").alias("n"), F.sum("run_id").alias("ids"))


_attempts_query("k07_committed_batches", "SELECT model_config_id, verdict, count(*) AS n, sum(run_id)::BIGINT AS ids FROM attempts GROUP BY 1, 2", _committed)
