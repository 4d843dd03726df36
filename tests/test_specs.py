"""Overlays as tables over files; rules and truncation; decimals and judge responses against plain versions."""

import hashlib
import json
import random
from decimal import Decimal

from pyspark.sql import functions as F

from lumenframe.functions import failures, json_values, prompts
from lumenframe.functions import judge_responses as jr
from lumenframe.operators import audits, verdicts
from lumenframe.sources import specs


def put(folder, name, doc):
    raw = doc if isinstance(doc, str) else json.dumps(doc)
    (folder / name).write_text(raw)
    return hashlib.sha256(raw.encode()).hexdigest()


def test_overlays(spark, tmp_path):
    h = put(tmp_path, "v1-grading.json", {"tasks": {"a": {"x": 1}, "b": {"x": 2, "y": [1]}, "c": {}}})
    good = {"base_spec": "v1", "provenance": {"base_spec_sha256": h}}
    put(tmp_path, "v1.1-grading.json", good | {"overrides": {"b": {"x": 3}}})
    put(tmp_path, "stale.json", good | {"provenance": {"base_spec_sha256": "0"}, "overrides": {"a": {}}})
    put(tmp_path, "lost.json", good | {"overrides": {"z": {}, "a": {}}})
    put(tmp_path, "orphan.json", {"base_spec": "v9", "overrides": {"a": {}}})
    put(tmp_path, "nameless.json", {"overrides": {"a": {}}})
    put(tmp_path, "hollow.json", good | {"overrides": {}})
    put(tmp_path, "odd.json", good | {"overrides": {"a": 5}})
    put(tmp_path, "empty.json", {"other": 1})
    put(tmp_path, "broken.json", "{")
    table = specs.specifications(specs.documents(spark, str(tmp_path)))
    got = {(r["spec"], r["fault"], r["detail"]) for r in specs.faults(table).collect()}
    assert got == {
        ("stale", "another base", "v1"), ("lost", "task absent from base", "z"), ("orphan", "base absent", "v9"), ("nameless", "no base named", None), ("hollow", "no overrides", None),
        ("odd", "entry is no mapping", "a"), ("empty", "no tasks", None), ("broken", "no document", None),
    }
    rows = {(r["spec"], r["task_id"]): (json.loads(r["entry"]), r["changed"]) for r in specs.resolved(table).collect()}
    base = {"a": {"x": 1}, "b": {"x": 2, "y": [1]}, "c": {}}
    assert rows == {("v1", k): (v, False) for k, v in base.items()} | {("v1.1", k): (({"x": 3}, True) if k == "b" else (v, False)) for k, v in base.items()}


def test_bundled_specifications(spark, tmp_path, small):
    """Documents a line each resolve as files of one document do; the query's files do not grow with its specifications."""
    from lumenframe import catalog_gates

    base = json.dumps({"spec_id": "v1", "tasks": {"a": {"x": 1}, "b": {"x": 2}}})
    good = {"base_spec": "v1", "provenance": {"base_spec_sha256": hashlib.sha256(f"{base}\n".encode()).hexdigest()}}
    lines = [base, json.dumps(good | {"spec_id": "v2", "overrides": {"b": {"x": 3}}}), json.dumps(good | {"spec_id": "v3", "overrides": {"z": {}}})]
    put(tmp_path, "all.jsonl", "\n".join(lines))
    table = specs.specifications(specs.bundled(spark, str(tmp_path)))
    assert [tuple(r) for r in specs.faults(table).collect()] == [("v3", "task absent from base", "z")]
    got = {(r["spec"], r["task_id"], r["entry"], r["changed"]) for r in specs.resolved(table).collect()}
    assert got == {("v1", "a", '{"x":1}', False), ("v1", "b", '{"x":2}', False), ("v2", "a", '{"x":1}', False), ("v2", "b", '{"x":3}', True)}
    made = catalog_gates._spec_files(spark, small)
    assert made.select("file").distinct().count() < made.count() / 2


def test_model_overlays(spark, tmp_path):
    whole = {f: "1" for f in specs.MODEL_FIELDS} | {"config_id": "m", "template_text": "t", "template_sha256": hashlib.sha256(b"t").hexdigest(), "stop_tokens": [], "think": False}
    put(tmp_path, "a.json", whole)
    put(tmp_path, "b.json", whole | {"config_id": "p", "derivation_source": "human_pinned", "review_status": "APPROVED"})
    put(tmp_path, "c.json", whole | {"config_id": "q", "derivation_source": "human_pinned"})
    put(tmp_path, "d.json", {k: v for k, v in whole.items() if k != "mode"} | {"config_id": "r"})
    put(tmp_path, "e.json", whole | {"config_id": "s", "template_text": "u"})
    put(tmp_path, "f.json", [1])
    put(tmp_path, "g.json", whole)
    got = {r["file"][-6:-5]: r["fault"] for r in specs.model_overlays(specs.documents(spark, str(tmp_path))).collect()}
    assert got == {"a": "config_id repeated", "b": None, "c": "not approved", "d": "lacks mode", "e": "another template", "f": "no object", "g": "config_id repeated"}


def test_rule_hash_truncation_and_pair_prompt(spark):
    rules = [("exact", "", "OUTPUT_CONTRACT"), ("numeric", "x", "CONTENT_ERROR")]
    assert prompts.rule_hash(rules) == hashlib.sha256(b'[["exact","","OUTPUT_CONTRACT"],["numeric","x","CONTENT_ERROR"]]').hexdigest() != prompts.rule_hash(rules[::-1])
    rows = [("length", 5, 5, 1), ("length", 6, 5, 1), ("length", 4, 5, 0), ("stop", 9, 5, 0), (None, 9, 5, 0), ("length", None, 5, 0), ("length", 9, None, 0)]
    got = spark.createDataFrame(rows, "d string, e int, n int, want int").select(F.size(verdicts.truncation(F.col("d"), F.col("e"), F.col("n"))).alias("g"), "want").collect()
    assert all(r["g"] == r["want"] for r in got)
    p = spark.range(1).select(prompts.pair_prompt(F.lit("the task"), F.lit("p1"), F.lit("left text"), F.lit("right text"))).first()[0]
    assert p.index("the task") < p.index("left text") < p.index("right text") and "p1" in p
    entry = spark.createDataFrame([(1, "UNKNOWN", "CORRECT", "someone", None, None)], "task_id int, auto_mode string, assessment string, author string, mode_override string, override_reason string")
    assert audits.review_allowed(entry, "APPROVED").first()["ok"] and not audits.review_allowed(entry, "DRAFT").first()["ok"] and not audits.review_allowed(entry.where("false"), "APPROVED").first()["ok"]


def test_decimals(spark):
    pick = random.Random(6)
    digits = lambda n: "".join(pick.choices("0123456789", k=n))
    made = ["0", "-0", "0.000", "-0e5", "1e300", "1e-300", "12300e-2", "9" * 28 + "5", "9" * 29, "1" + "0" * 27 + "5", "1" + "0" * 26 + "15", "2" * 27 + "35" + "0" * 30 + "1", "0." + "0" * 100 + "1", "0." + "0" * 125 + "1", "1e127", "1e128", "-1e126", "-1e127", "0e99999999999"]
    for _ in range(400):
        made.append(pick.choice(["", "-"]) + str(int(digits(pick.randint(1, 60)))) + pick.choice(["", "." + digits(pick.randint(1, 60))]) + pick.choice(["", f"e{pick.randint(-160, 160)}", f"E+{pick.randint(0, 9)}"]))

    def plain(x):
        if not any(c in "123456789" for c in x.lower().partition("e")[0]):
            return "0"
        v = Decimal(x).normalize()
        out = f"{v:f}"
        return out if len(out) <= 128 else None

    got = spark.createDataFrame([(x,) for x in made], "x string").select("x", failures.plain_decimal(F.col("x")).alias("d")).collect()
    assert [(r["x"], r["d"], plain(r["x"])) for r in got if r["d"] != plain(r["x"])] == []


def plain_rubric(raw, names, text):
    body = (raw or "").strip()
    if len(body) >= 6 and body[:3] == body[-3:] == "```":
        body = body[3:-3].strip()
    got = json.loads(body)
    assert isinstance(got, dict) and got.get("schema_version") == jr.RUBRIC_SCHEMA and isinstance(got.get("abstain"), bool)
    seen = got["criteria"]
    if isinstance(seen, list):
        keys = [next(e[k] for k in jr.NAME_KEYS if k in e) for e in seen]
        assert all(isinstance(k, str) for k in keys) and len(set(keys)) == len(keys)
        seen = dict(zip(keys, seen))
    assert set(seen) == set(names)
    lost, out = int(got.get("pruned_evidence", 0)), {}
    for k, v in seen.items():
        assert isinstance(v, dict) and isinstance(v.get("observed"), bool) and v.get("confidence") in jr.CONFIDENCE
        e = v.get("evidence")
        e = [e] if isinstance(e, str) else e
        kept = []
        if isinstance(e, list):
            quotes = [next((q[x] for x in jr.QUOTE_KEYS if x in q), None) if isinstance(q, dict) else q for q in e]
            assert all(isinstance(q, str) for q in quotes)
            kept = [q for q in quotes if q in text]
            lost += len(quotes) - len(kept)
        else:
            lost += 1
        out[k] = (v["observed"], v["confidence"], kept)
    return got["abstain"], out, lost


def test_rubric_responses_against_plain(spark):
    pick = random.Random(8)
    text = 'What "was" said\nhere, été'
    evidence = lambda: pick.choice([[], ["was", 'said\nhere'], ['"was"', "not there", {"quote": "été"}], "said", "gone", None, {"quote": "said"}, 5, [None], [{"text": "What", "x": 1}, ""], [{"x": 1}]])
    entry = lambda: pick.choice([{"observed": pick.choice([True, False]), "confidence": pick.choice(["low", "high"]), "evidence": evidence()}] * 12 + [{"observed": 1, "confidence": "low"}, {"observed": True, "confidence": "sure"}, [], None, {"observed": True, "confidence": "medium"}])
    rows = []
    for _ in range(1000):
        criteria = pick.choice([lambda: {"c1": entry(), "c2": entry()}, lambda: [{"id": "c1"} | (entry() or {"a": 1}), {"criterion_id": "c2", "id": "zz", "observed": True, "confidence": "low", "evidence": evidence()}], lambda: {"c1": entry()}, lambda: [], lambda: 7]) if pick.random() < 0.9 else lambda: [{"key": "c1"}, {"key": "c1"}]
        try:
            made = criteria()
        except TypeError:
            continue
        doc = {"schema_version": pick.choice([jr.RUBRIC_SCHEMA] * 15 + ["v0", None]), "abstain": pick.choice([True, False, False, False, False, "no"]), "criteria": made} | pick.choice([{}, {"pruned_evidence": 2}])
        s = json.dumps(doc)
        rows.append(pick.choice([s, s, s, f"```{s}\n```", f" {s}\n", s + "x", f"```json\n{s}```"]))
    df = spark.createDataFrame([(i, r, ["c1", "c2"], text) for i, r in enumerate(rows)], "i int, r string, c array<string>, t string")
    got = json_values.last_key_wins(spark, lambda: df.select("i", jr.parse_rubric(F.col("r"), F.col("c"), F.col("t")).alias("g"))).collect()
    fine = 0
    for r in got:
        g = r["g"]
        try:
            want = plain_rubric(rows[r["i"]], ["c1", "c2"], text)
        except (ValueError, AssertionError, KeyError, TypeError, StopIteration, AttributeError):
            assert g["error"] is not None, rows[r["i"]]
            continue
        fine += 1
        assert (g["error"], g["abstain"], {k: (v["observed"], v["confidence"], v["evidence"]) for k, v in g["criteria"].items()}, g["pruned_evidence"]) == (None, *want), rows[r["i"]]
    assert 50 < fine < len(rows) - 50
