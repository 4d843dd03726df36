"""Queries over ``attempts`` and ``tasks``: scans, filters, joins, outputs, prompts, code checks and gates. Each has SQL written apart from its plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import metrics as m
from lumenframe.functions import prompts, text
from lumenframe.operators import audits, evaluation, gates, judging, outputs, runs
from lumenframe.plans.attempts import ATTEMPTS_SQL, attempts, tasks
from lumenframe.plans.trials import TRIALS_SQL, table, trials

QUERIES: dict = {}
SQL: dict[str, str] = {}


def on_attempts(name: str, sql: str, f) -> None:
    """A plan over (attempts, tasks); the SQL follows the WITH list that defines both."""
    QUERIES[name] = lambda spark, sf_dir: f(attempts(spark, sf_dir), tasks(spark, sf_dir))
    SQL[name] = "WITH " + ATTEMPTS_SQL + "\n" + sql


def on_trials(name: str, sql: str, f) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(trials(spark, sf_dir))
    SQL[name] = "WITH " + TRIALS_SQL + "\n" + sql


def on_table(name: str, source: str, sql: str, f) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(table(spark, sf_dir, source))
    SQL[name] = sql


MEASURED = "FROM attempts WHERE NOT is_warmup"
DET = "JOIN tasks USING (task_id) WHERE NOT is_warmup AND grading_status = 'READY_DETERMINISTIC'"

# scans and filters
on_attempts("s03_measured_rows", "SELECT run_id, task_id, trial, verdict FROM attempts WHERE experiment_id = 'spec__click' AND NOT is_warmup",
    lambda a, t: runs.measured(a, "spec__click").select("run_id", "task_id", "trial", "verdict"))
on_attempts("s04_decoded_details", """SELECT run_id, CASE WHEN run_id % 19 = 0 THEN 0 ELSE len(details) END::INT AS n,
  CASE WHEN run_id % 19 = 0 THEN 0 ELSE len(list_filter(details, lambda d: NOT d.passed)) END::INT AS failed FROM attempts""",
    lambda a, t: a.withColumn("d", runs.decoded_details(F.when(F.col("run_id") % 19 == 0, "no [json").otherwise(F.to_json("details")))).select(
        "run_id", F.size("d").alias("n"), F.size(F.filter("d", lambda d: ~d["passed"])).alias("failed")))
on_attempts("s05_comparison_trials", f"SELECT run_id, task_id, primary_class, suite, difficulty, verdict FROM attempts {DET}",
    lambda a, t: runs.comparison_trials(a, t).select("run_id", "task_id", "primary_class", "suite", "difficulty", "verdict"))
on_attempts("s06_execution_evidence", f"SELECT experiment_id, arg_min(model_digest, run_id) FILTER (WHERE model_digest IS NOT NULL) AS model_digest, count(peak_vram) AS peaks, max(peak_vram) AS peak_vram {MEASURED} GROUP BY 1",
    lambda a, t: runs.evidence(a))
on_attempts("s07_failed_rows", """SELECT model_config_id, task_id, trial, grading_status, raw_output[1:6] AS excerpt,
  array_to_string(list_transform(list_filter(details, lambda d: NOT d.passed), lambda d: d.grader_type), ',') AS failed_graders
  FROM attempts JOIN tasks USING (task_id) WHERE NOT is_warmup AND verdict = 'FAIL' AND grading_status LIKE 'READY%'""",
    lambda a, t: runs.failed_rows(a, t, 6))
on_attempts("s08_judge_population", "SELECT run_id, task_id FROM attempts WHERE task_id IN (1, 15, 30, 45)", lambda a, t: runs.population(a, "task_id", [1, 15, 30, 45]).select("run_id", "task_id"))
on_attempts("f01_warmups_excluded", f"SELECT experiment_id, count(*) AS n {MEASURED} GROUP BY 1", lambda a, t: runs.measured(a).groupBy("experiment_id").agg(F.count("*").alias("n")))
on_attempts("f02_execution_filter", f"SELECT task_id, count(*) AS n {MEASURED} AND experiment_id IN ('spec__view', 'spec__click') GROUP BY 1",
    lambda a, t: runs.measured(a, "spec__view", "spec__click").groupBy("task_id").agg(F.count("*").alias("n")))
on_attempts("f03_completed_identities", "SELECT DISTINCT model_config_id, task_id, run_config_hash FROM attempts WHERE status = 'COMPLETE'",
    lambda a, t: runs.completed_identities(a, ["model_config_id", "task_id", "run_config_hash"]))
on_attempts("f04_population_by_status", f"SELECT model_config_id, count(*) AS n FROM attempts {DET} GROUP BY 1", lambda a, t: runs.comparison_trials(a, t).groupBy("model_config_id").agg(F.count("*").alias("n")))
on_table("f07_eligible_points", "part", "SELECT p_partkey, p_size FROM part WHERE p_size % 5 <> 0 AND p_retailprice IS NOT NULL AND isfinite(p_retailprice)",
    lambda p: evaluation.eligible(p.withColumn("s", F.when(F.col("p_size") % 5 != 0, F.col("p_size"))), "s", "p_retailprice").select("p_partkey", "p_size"))
on_attempts("f08_prefix_exclusion", "SELECT DISTINCT model_config_id FROM attempts WHERE left(model_config_id, 1) NOT IN ('c', 'p')",
    lambda a, t: runs.without_prefixes(a.select("model_config_id").distinct(), "model_config_id", ["c", "p"]))
on_attempts("f09_numeric_guard", "SELECT run_id, CASE WHEN k % 4 IN (0, 1) THEN (k % 10)::DOUBLE + CASE WHEN k % 4 = 1 THEN 0.5 ELSE 0 END END AS x FROM attempts",
    lambda a, t: a.select("run_id", runs.json_number(F.concat(F.lit('{"v": '), F.when(F.col("k") % 4 == 0, (F.col("k") % 10).cast("string"))
        .when(F.col("k") % 4 == 1, F.concat((F.col("k") % 10).cast("string"), F.lit(".5"))).when(F.col("k") % 4 == 2, "true").otherwise('"7"'), F.lit("}")), "v").alias("x")))
on_attempts("f10_judge_pending", "SELECT run_id FROM attempts JOIN tasks USING (task_id) WHERE grading_status = 'READY_JUDGE' AND verdict = 'NEEDS_JUDGE'",
    lambda a, t: runs.population(runs.population(a.join(t.select("task_id", "grading_status"), "task_id"), "grading_status", ["READY_JUDGE"]), "verdict", ["NEEDS_JUDGE"]).select("run_id"))
on_attempts("f11_lineage_guard", "SELECT run_id FROM attempts WHERE k % 3 = 0",
    lambda a, t: runs.same_lineage(a.withColumn("x", F.concat(F.when(F.col("k") % 3 == 0, "spec").otherwise("special"), F.lit("__m"))), "x", "spec").select("run_id"))
on_attempts("f16_display_alias", "SELECT CASE model_config_id WHEN 'click' THEN 'Click' WHEN 'view' THEN 'View' ELSE model_config_id END AS name, count(*) AS n FROM attempts GROUP BY 1",
    lambda a, t: a.groupBy(runs.alias({"click": "Click", "view": "View"}, F.col("model_config_id")).alias("name")).agg(F.count("*").alias("n")))
# metrics
on_attempts("m04_rates_and_overheads", """SELECT run_id, CASE WHEN k > 0 AND value > 0 THEN k / (floor(value * 1e6) / 1e9) END AS prefill_compute_tok_s, round(floor(value * 1e6) / 1e6, 6) AS client_e2e_ms,
  round(floor(value * 1e6) / 1e6 - floor(value * 9e5) / 1e6, 6) AS client_overhead_ms FROM attempts""",
    lambda a, t: a.withColumn("ns", F.floor(F.col("value") * 1e6)).select("run_id", m.per_second(F.col("k"), F.col("ns")).alias("prefill_compute_tok_s"),
        F.round(m.span_ms(F.lit(0), F.col("ns")), 6).alias("client_e2e_ms"), F.round(m.overhead_ms(m.span_ms(F.lit(0), F.col("ns")), F.floor(F.col("value") * 9e5)), 6).alias("client_overhead_ms")))
on_attempts("m11_canary_verdict", "SELECT run_id, CASE WHEN k IS NULL OR k < 50 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM attempts", lambda a, t: a.select("run_id", m.canary(F.col("k"), 50).alias("verdict")))
on_table("m13_disk_reclaimed", "orders", "SELECT o_orderkey, o_totalprice >= o_custkey * 100 - 1000 AS reclaimed FROM orders",
    lambda o: o.select("o_orderkey", m.reclaimed(F.col("o_custkey") * 100, F.col("o_totalprice"), 1000).alias("reclaimed")))

# joins
on_attempts("j01_trials_with_status", "SELECT grading_status, count(*) AS n FROM attempts JOIN tasks USING (task_id) GROUP BY 1",
    lambda a, t: runs.with_status(a.join(t.select("task_id"), "task_id", "left_semi"), t).groupBy("grading_status").agg(F.count("*").alias("n")))
on_attempts("j02_trials_with_metadata", f"SELECT suite, difficulty, primary_class, count(*) AS n, count(*) FILTER (WHERE verdict = 'PASS') AS passes FROM attempts {DET} GROUP BY ALL",
    lambda a, t: runs.comparison_trials(a, t).groupBy("suite", "difficulty", "primary_class").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "PASS").alias("passes")))
on_attempts("j07_failed_types_with_graders", """, g AS (SELECT task_id, primary_class AS grader_type, 'p' || task_id AS params FROM tasks),
  f AS (SELECT run_id, task_id, unnest(list_filter(details, lambda d: NOT d.passed)).grader_type AS grader_type FROM attempts) SELECT run_id, task_id, grader_type, params FROM f JOIN g USING (task_id, grader_type)""",
    lambda a, t: runs.failed_with_graders(a, t.select("task_id", F.col("primary_class").alias("grader_type"), F.concat(F.lit("p"), F.col("task_id").cast("string")).alias("params"))))
on_attempts("j10_overlay_with_history", "SELECT model_config_id, o.n AS old_n, c.n AS new_n FROM (SELECT model_config_id, count(*) AS n FROM attempts WHERE is_warmup GROUP BY 1) o JOIN (SELECT model_config_id, count(*) AS n FROM attempts WHERE verdict = 'PASS' GROUP BY 1) c USING (model_config_id)",
    lambda a, t: runs.as_of_overlay(a.where("is_warmup").groupBy("model_config_id").agg(F.count("*").alias("old_n")), a.where("verdict = 'PASS'").groupBy("model_config_id").agg(F.count("*").alias("new_n")), ["model_config_id"]))
on_attempts("j14_controlled_variants", """, b AS (SELECT task_id, arg_min(run_id, run_id)::VARCHAR AS item, arg_min(raw_output, run_id) AS t FROM attempts WHERE task_id % 15 = 0 GROUP BY 1),
  v AS (SELECT task_id, item, unnest([{'k': 'identical', 'c': t}, {'k': 'whitespace', 'c': t || chr(10) || chr(10)}, {'k': 'style', 'c': 'Answer:' || chr(10) || t}, {'k': 'authority', 'c': 'Verified source answer:' || chr(10) || t},
    {'k': 'omission', 'c': CASE WHEN strpos(t, chr(10)) > 0 AND strpos(t, chr(10)) < length(t) THEN substr(t, strpos(t, chr(10)) + 1) ELSE t END}, {'k': 'incomplete', 'c': 'I am not sure.'},
    {'k': 'plain_copy', 'c': trim(t, ' ' || chr(10) || chr(13))}, {'k': 'short_copy', 'c': substr(t, 1, greatest(1, length(t) // 2))}]) AS x FROM b)
  SELECT task_id, item, x.k AS kind, x.c AS candidate, sha256('controlled|' || task_id || '|' || x.k || '|' || item) AS candidate_id FROM v""",
    lambda a, t: runs.controlled_variants(runs.base_items(a.where("task_id % 15 = 0").select("task_id", F.col("run_id").cast("string").alias("item"), "run_id", "raw_output"), "task_id", ["run_id"]),
        "raw_output", "item", "task_id").select("task_id", "item", "kind", "candidate", "candidate_id"))

# outputs
on_attempts("a13_distinct_outputs", """SELECT model_config_id, task_id, count(DISTINCT raw_output) AS distinct_raw, count(DISTINCT trim(replace(replace(raw_output, chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ' || chr(10))) AS distinct_clean,
  count(DISTINCT CASE WHEN raw_output LIKE '{%' THEN json_extract_string(raw_output, '$.k') ELSE 'UNPARSEABLE' END) AS distinct_json FROM attempts GROUP BY 1, 2""",
    lambda a, t: outputs.distinct_outputs(a, ["model_config_id", "task_id"]))
on_attempts("a15_failure_codes", """, f AS (SELECT model_config_id, unnest(list_filter(details, lambda d: NOT d.passed)) AS d FROM attempts)
  SELECT model_config_id, d.grader_type || ':' || CASE WHEN len(d.violations) > 0 THEN d.violations[1] ELSE d.detail END AS code, count(*) AS n FROM f GROUP BY 1, 2""",
    lambda a, t: outputs.failure_codes(a, ["model_config_id"]))
on_attempts("a16_sub_passes", "SELECT model_config_id, task_id, count(*) AS det_total, count(*) FILTER (WHERE value >= 20 AND k % 4 <> 0) AS det_passes, count(*) FILTER (WHERE verdict = 'NEEDS_JUDGE') AS deferrals FROM attempts GROUP BY 1, 2",
    lambda a, t: outputs.sub_passes(a, ["model_config_id", "task_id"]))
on_attempts("a18_prefill_by_state", """SELECT task_id, coalesce(prefill_cache_state, 'UNKNOWN') AS state, count(*) AS rows, count(prefill_tok_s) AS n, CASE WHEN count(prefill_tok_s) < 2 THEN 'insufficient_n' ELSE 'ok' END AS status,
  round(CASE WHEN count(prefill_tok_s) >= 2 THEN avg(prefill_tok_s) END, 6) AS mean, round(CASE WHEN count(prefill_tok_s) >= 2 THEN stddev_pop(prefill_tok_s) END, 6) AS stdev FROM attempts GROUP BY 1, 2""",
    lambda a, t: outputs.prefill_by_state(a, ["task_id"]))
on_attempts("a19_uncached_by_state", "SELECT task_id, coalesce(prefill_cache_state, 'UNKNOWN') AS state, uncached_count, count(*) AS n FROM attempts WHERE uncached_count IS NOT NULL GROUP BY ALL", lambda a, t: outputs.uncached_by_state(a, ["task_id"]))
_RETRY = ", r AS (SELECT task_id, trial, verdict, raw_output FROM attempts WHERE model_config_id = 'view'), b AS (SELECT task_id, trial, verdict, raw_output FROM attempts WHERE model_config_id = 'click')"
_arm = lambda a, x: a.where(F.col("model_config_id") == x).select("task_id", "trial", "verdict", "raw_output")
on_attempts("a34_recovery_uplift", _RETRY + """, u AS (SELECT b.verdict AS o, coalesce(x.verdict, b.verdict) AS n FROM b LEFT JOIN (SELECT * FROM r WHERE trial = 1) x USING (task_id, trial))
  SELECT count(*) FILTER (WHERE o = 'PASS') AS passes, count(*) FILTER (WHERE n = 'PASS') AS passes_after, round(count(*) FILTER (WHERE o = 'PASS') / count(*), 4) AS rate,
  round(count(*) FILTER (WHERE n = 'PASS') / count(*), 4) AS rate_after, round((count(*) FILTER (WHERE n = 'PASS') - count(*) FILTER (WHERE o = 'PASS')) / count(*), 4) AS uplift FROM u""",
    lambda a, t: outputs.uplift(_arm(a, "click"), _arm(a, "view").where("trial = 1"), ["task_id", "trial"]))
on_attempts("a40_failure_mode_counts", """SELECT grading_status, CASE WHEN len(f) = 2 THEN 'MIXED' WHEN f[1] = 'exact' THEN 'OUTPUT_CONTRACT' WHEN f[1] = 'constraints' THEN 'LEXICAL_CONSTRAINT' ELSE 'UNKNOWN' END AS mode, count(*) AS n
  FROM (SELECT grading_status, list_transform(list_filter(details, lambda d: NOT d.passed), lambda d: d.grader_type) AS f FROM attempts JOIN tasks USING (task_id)
    WHERE NOT is_warmup AND verdict = 'FAIL' AND grading_status LIKE 'READY%' AND run_id % 5 > 1) GROUP BY 1, 2""",
    lambda a, t: outputs.mode_counts(outputs.with_modes(runs.measured(a).where("verdict = 'FAIL' and run_id % 5 > 1").join(t.where("grading_status like 'READY%'").select("task_id", "grading_status"), "task_id"))))
on_attempts("a41_regraded_rollup", """, o AS (SELECT model_config_id, task_id, grading_status = 'READY_DETERMINISTIC' AS det, count(*) AS n, count(*) FILTER (WHERE verdict = 'PASS') AS p, count(*) FILTER (WHERE verdict <> 'NEEDS_JUDGE') AS kept
    FROM attempts JOIN tasks USING (task_id) WHERE NOT is_warmup AND grading_status LIKE 'READY%' GROUP BY ALL)
  SELECT model_config_id, count(*) FILTER (WHERE det) AS det_tasks, coalesce(sum(n) FILTER (WHERE det), 0)::BIGINT AS det_trials, coalesce(sum(p) FILTER (WHERE det), 0)::BIGINT AS passes, count(*) FILTER (WHERE det AND p > 0) AS any_pass,
  count(*) FILTER (WHERE det AND p = n) AS all_pass, count(*) FILTER (WHERE NOT det) AS judge_tasks, coalesce(sum(kept) FILTER (WHERE NOT det), 0)::BIGINT AS non_deferrals,
  round(sum(p) FILTER (WHERE det) / sum(n) FILTER (WHERE det), 9) AS accuracy FROM o GROUP BY 1""", outputs.regraded)  # fmt: skip
on_attempts("a46_least_confidence", """SELECT task_id, CASE least(min(r), 3) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT task_id, CASE WHEN k % 50 = 0 THEN 1 WHEN k % 3 = 0 THEN 2 ELSE 3 END AS r FROM attempts) GROUP BY 1""",
    lambda a, t: a.groupBy("task_id").agg(F.collect_set(F.when(F.col("k") % 50 == 0, "unheard of").when(F.col("k") % 3 == 0, "medium").otherwise("high")).alias("c")).select("task_id", judging.least_confidence(F.col("c")).alias("confidence")))
on_attempts("a47_rubric_results", """SELECT task_id AS call_id, count(*) AS criteria, count(*) FILTER (WHERE (k % 2 = 0) = (trial % 2 = 0)) AS passed, CASE WHEN bool_or(k % 40 = 0 OR value < 0.5) THEN 'ADJUDICATION_REQUIRED' ELSE 'JUDGE_RESULT' END AS status FROM attempts GROUP BY 1""",
    lambda a, t: outputs.rubric_results(a.select(F.col("task_id").alias("call_id"), (F.col("k") % 2 == 0).alias("observed"), (F.col("trial") % 2 == 0).alias("desired"), F.when(F.col("k") % 40 == 0, "low").otherwise("high").alias("confidence"), (F.col("value") < 0.5).alias("abstain"))))
_GRADERS = "g AS (SELECT DISTINCT task_id, d.grader_type FROM (SELECT task_id, unnest(details) AS d FROM attempts WHERE task_id % 5 <> 1))"
_graders = lambda a: a.where("task_id % 5 <> 1").select("task_id", F.explode("details.grader_type").alias("grader_type")).distinct()
on_attempts("a49_spec_audit", f", {_GRADERS}, n AS (SELECT task_id, count(*) AS c FROM g GROUP BY 1) SELECT primary_class, grading_status, count(*) AS tasks, count(*) FILTER (WHERE c > 1) AS multi_grader FROM tasks LEFT JOIN n USING (task_id) GROUP BY 1, 2",
    lambda a, t: outputs.spec_audit(t, _graders(a)))
on_attempts("a51_distribution_audit", """, n AS (SELECT suite, count(*) AS n FROM tasks GROUP BY 1) SELECT suite, coalesce(e, 0)::BIGINT AS expected, coalesce(n, 0) AS n, coalesce(e, 0) = coalesce(n, 0) AS ok
  FROM n FULL JOIN (VALUES ('core', 7), ('extra', 7)) x(suite, e) USING (suite)""", lambda a, t: outputs.distribution_audit(t, "suite", {"core": 7, "extra": 7}))  # fmt: skip
on_trials("a53_quant_pairs", """, det AS (SELECT * FROM trials WHERE grading_status = 'READY_DETERMINISTIC'), o AS (SELECT model_config_id AS m, task_id, bool_and(verdict = 'PASS') AS s, count(*) AS n, count(*) FILTER (WHERE verdict = 'PASS') AS p FROM det GROUP BY 1, 2),
  j AS (SELECT c.m, b.s AS bs, c.s AS cs, b.n AS bn, b.p AS bp, c.n AS cn, c.p AS cp FROM o b JOIN o c USING (task_id) WHERE b.m = 'click' AND c.m IN ('view', 'purchase'))
  SELECT 'click-vs-' || m AS comparison, count(*) FILTER (WHERE bs AND NOT cs) AS strict_b, count(*) FILTER (WHERE cs AND NOT bs) AS strict_c, count(*) FILTER (WHERE cs AND NOT bs) - count(*) FILTER (WHERE bs AND NOT cs) AS net_task_gain,
  round(sum(cp) / sum(cn) - sum(bp) / sum(bn), 9) AS accuracy_delta FROM j GROUP BY m""",
    lambda t: outputs.quant_pairs(evaluation.comparisons(t, "click", ["view", "purchase"])).select("comparison", "strict_b", "strict_c", "net_task_gain", "accuracy_delta"))

# windows and orders
on_attempts("w01_next_warmup", "SELECT experiment_id, count(*) FILTER (WHERE is_warmup) + 1 AS next_trial FROM attempts GROUP BY 1", lambda a, t: runs.next_warmup(a))
on_attempts("w04_base_items", "SELECT task_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY trial, model_config_id, sha256(raw_output), run_id) AS rn FROM attempts) WHERE rn = 1",
    lambda a, t: runs.base_items(a.withColumn("sha", F.sha2("raw_output", 256)).select("task_id", "trial", "model_config_id", "sha", "run_id"), "task_id", ["trial", "model_config_id", "sha", "run_id"]).select("task_id", "run_id"))
on_attempts("o01_by_task_and_trial", "SELECT run_id, CAST(row_number() OVER (PARTITION BY model_config_id ORDER BY task_id, trial) AS INT) AS place FROM attempts", lambda a, t: runs.placed(a, ["model_config_id"], "task_id", "trial").select("run_id", "place"))
on_attempts("o02_multi_key_order", "SELECT run_id, CAST(row_number() OVER (PARTITION BY task_id ORDER BY trial, model_config_id, sha256(raw_output), run_id) AS INT) AS place FROM attempts",
    lambda a, t: runs.placed(a, ["task_id"], "trial", "model_config_id", F.sha2("raw_output", 256), "run_id").select("run_id", "place"))
on_attempts("o03_descending_stable", "SELECT run_id, CAST(row_number() OVER (PARTITION BY model_config_id ORDER BY (k % 10) / 10.0 DESC, run_id) AS INT) AS place FROM attempts",
    lambda a, t: runs.placed(a, ["model_config_id"], F.desc(F.col("k") % 10 / 10), "run_id").select("run_id", "place"))
on_attempts("o05_first_three", "SELECT run_id FROM attempts ORDER BY value DESC, run_id LIMIT 3", lambda a, t: runs.first_of(a, 3, F.desc("value"), "run_id").select("run_id"))
on_attempts("o06_argmax", "SELECT model_config_id, k, min(task_id) AS task_id FROM (SELECT *, max(k) OVER (PARTITION BY model_config_id) AS top FROM attempts) WHERE k = top GROUP BY 1, 2", lambda a, t: runs.argmax(a, "model_config_id", "k", "task_id"))
on_attempts("o10_disjoint_cohorts", "SELECT count(*) AS shared, count(*) = 0 AS disjoint FROM (SELECT task_id FROM attempts WHERE verdict = 'PASS' INTERSECT SELECT task_id FROM attempts WHERE verdict = 'NEEDS_JUDGE')",
    lambda a, t: runs.overlap(a.where("verdict = 'PASS'"), a.where("verdict = 'NEEDS_JUDGE'"), ["task_id"]))
on_attempts("o12_registry_order", "SELECT t.ordinal, count(*) AS n FROM attempts a JOIN tasks t USING (task_id) GROUP BY 1", lambda a, t: a.join(t.select("task_id", "ordinal"), "task_id").groupBy("ordinal").agg(F.count("*").alias("n")).orderBy("ordinal"))

# prompts, identifiers, code
on_attempts("x17_execution_ids", "SELECT DISTINCT experiment_id AS id, 'spec' AS spec, model_config_id AS model FROM attempts",
    lambda a, t: a.select(runs.execution_id(F.lit("spec"), F.col("model_config_id")).alias("id")).distinct().select("id", runs.execution_parts(F.col("id")).alias("p")).select("id", "p.spec", "p.model"))
_S = {k: v.replace("'", "''") for k, v in prompts.SUFFIXES.items()}
on_attempts("x30_retry_prompts", f"""SELECT task_id, sha256('Task ' || task_id || chr(10) || chr(10) || s) AS rendered_sha256, sha256(s) AS suffix_sha256 FROM (SELECT task_id, CASE primary_class WHEN 'numeric' THEN '{_S["numeric"]}'
  WHEN 'structured' THEN '{_S["json"]}' || CASE WHEN task_id % 8 = 2 THEN chr(10) || 'Required keys: a, k.' ELSE '' END ELSE '{_S["exact"]}' END AS s FROM tasks)""",
    lambda a, t: t.select("task_id", prompts.retry_prompt(F.concat(F.lit("Task "), F.col("task_id").cast("string")), prompts.retry_suffix(F.col("primary_class"),
        F.when(F.col("task_id") % 8 == 2, F.array(F.lit("a"), F.lit("k"))).otherwise(F.array().cast("array<string>")))).alias("p")).select("task_id", "p.rendered_sha256", "p.suffix_sha256"))
on_attempts("x31_retry_text_rejected", "SELECT task_id, task_id % 3 = 0 AS found FROM tasks",
    lambda a, t: t.select("task_id", prompts.has_marker(F.concat(F.lit("Do it. "), F.when(F.col("task_id") % 3 == 0, prompts.SUFFIXES["json"]).otherwise("Give one JSON object."))).alias("found")))
on_attempts("x32_bare_json_numbers", "SELECT run_id, k % 6 IN (0, 1, 2) AS bare FROM attempts",
    lambda a, t: a.select("run_id", text.is_json_number(F.get(F.array(*[F.lit(x) for x in ("-12", " 0.50\n", "1e-7", "NaN", "true", "01")]), (F.col("k") % 6).cast("int"))).alias("bare")))
_FENCE = "chr(96) || chr(96) || chr(96)"
on_attempts("x34_extracted_code", f"""SELECT run_id, CASE k % 6 WHEN 0 THEN 'x = ' || k WHEN 1 THEN 'x = ' || k END AS source, CASE k % 6 WHEN 0 THEN 'fence' WHEN 1 THEN 'raw' END AS form,
  CASE k % 6 WHEN 2 THEN 'fence of another kind' WHEN 3 THEN 'several fences' WHEN 4 THEN 'truncated' WHEN 5 THEN 'too long' END AS error FROM attempts""",
    lambda a, t: a.select("run_id", prompts.code(F.when(F.col("k") % 6 == 0, F.concat(F.lit("```Python \n"), F.lit("x = "), F.col("k").cast("string"), F.lit("\n```\n")))
        .when(F.col("k") % 6 == 2, F.concat(F.lit("see ```python\nx = "), F.col("k").cast("string"), F.lit("\n```"))).when(F.col("k") % 6 == 3, "```py\na\n```\n```py\nb\n```")
        .when(F.col("k") % 6 == 5, F.repeat(F.lit("é"), 60)).otherwise(F.concat(F.lit(" x = "), F.col("k").cast("string"), F.lit("\n"))),
        F.lit("python"), F.when(F.col("k") % 6 == 4, "length").otherwise("stop"), 100).alias("c")).select("run_id", "c.source", "c.form", "c.error"))
on_attempts("x36_static_faults", """SELECT run_id, CASE k % 7 WHEN 1 THEN 'SYNTAX_ERROR' WHEN 2 THEN 'ENTRYPOINT_MISSING' WHEN 3 THEN 'FORBIDDEN_CONSTRUCT' WHEN 5 THEN 'SYNTAX_ERROR' WHEN 6 THEN 'UNSUPPORTED_LANGUAGE' END AS fault FROM attempts""",
    lambda a, t: a.withColumn("n", (F.col("k") % 7).cast("int")).select("run_id", prompts.static_fault(F.when(F.col("n") < 4, "python").when(F.col("n") < 6, "javascript").otherwise("perl"),
        F.get(F.array(*[F.lit(x) for x in ("def f(x):\n    return x", "def f(x:\n", "def g(x):\n    return x", "import re\ndef f(x):\n    return re.sub('a', 'b', x)", "const f = (x) => { return x }", "function f(x) { return x", "sub f {}")]), F.col("n")),
        F.lit("f"), F.array(F.lit("no_re_import"), F.lit("no_try_except"))).alias("fault")))
on_attempts("x38_rendered_prompts", "SELECT task_id, CASE WHEN task_id % 2 = 0 THEN 'Q' || task_id ELSE '<s>Q' || task_id || '</s>' END AS prompt FROM tasks",
    lambda a, t: t.select("task_id", prompts.rendered(F.lit("<s>{prompt}</s>"), F.concat(F.lit("Q"), F.col("task_id").cast("string")), F.when(F.col("task_id") % 2 == 0, "chat").otherwise("raw")).alias("prompt")))
on_attempts("x39_artifacts", "SELECT task_id, CASE WHEN task_id % 4 = 0 THEN 'org/m' || task_id END AS repo, CASE WHEN task_id % 4 = 0 THEN 'Q4_K' END AS quant FROM tasks",
    lambda a, t: t.select("task_id", prompts.artifact(F.concat(F.when(F.col("task_id") % 4 == 1, "hg.co/org/m").when(F.col("task_id") % 4 == 2, "hf.co/m").otherwise("hf.co/org/m"), F.col("task_id").cast("string"),
        F.when(F.col("task_id") % 4 == 3, ":<quant>").otherwise(":Q4_K"))).alias("p")).select("task_id", "p.repo", "p.quant"))
on_attempts("x40_stop_tokens", "SELECT task_id, 'a,b' || (task_id % 3) AS stops FROM tasks",
    lambda a, t: t.select("task_id", F.array_join(text.stop_tokens(F.concat(F.lit('x 1\n stop  "a"\nstop "b'), (F.col("task_id") % 3).cast("string"), F.lit('"\nstop "a"\nunstop "z"'))), ",").alias("stops")))
on_attempts("x44_judge_prompts", """SELECT task_id, contains('', '') AS blind, '- a: first (wanted: true)' || chr(10) || '- b: second (wanted: false)' AS criteria FROM tasks""",
    lambda a, t: t.withColumn("p", prompts.rubric_prompt(F.lit("Do"), F.col("task_id").cast("string"), F.array(F.struct(F.lit("b").alias("id"), F.lit("second").alias("definition"), F.lit(False).alias("desired")),
        F.struct(F.lit("a").alias("id"), F.lit("first").alias("definition"), F.lit(True).alias("desired"))), F.lit("said"))).select("task_id", (~F.contains("p", F.lit("model"))).alias("blind"),
        F.regexp_extract("p", r"(?s)Criteria:\n(.*)\nText:\n<text>\nsaid\n</text>", 1).alias("criteria")))
on_attempts("x46_error_kinds", "SELECT run_id, ['timeout', 'http_503', 'http_404', 'malformed_chunk'][k % 4 + 1] AS kind, k % 4 < 2 AS retryable FROM attempts",
    lambda a, t: a.withColumn("e", F.get(F.array(*[F.lit(x) for x in ("timeout", "http", "http", "malformed_chunk")]), (F.col("k") % 4).cast("int"))).withColumn("s", F.when(F.col("k") % 4 == 1, 503).otherwise(404)).select(
        "run_id", prompts.error_kind(F.col("e"), F.col("s")).alias("kind"), prompts.is_retryable(F.col("e"), F.col("s")).alias("retryable")))

# gates
_M = """m AS (SELECT count(*) AS measured, count(*) FILTER (WHERE grading_status = 'READY_DETERMINISTIC') AS deterministic, count(*) FILTER (WHERE grading_status = 'READY_JUDGE') AS judge, count(*) FILTER (WHERE grading_status IS NULL) AS "unknown",
  count(*) - count(DISTINCT (model_config_id, task_id, trial)) AS duplicates, count(*) FILTER (WHERE status = 'ERROR' OR verdict = 'ERROR') AS errors FROM attempts LEFT JOIN tasks USING (task_id) WHERE NOT is_warmup)"""
on_attempts("g04_validation_matrix", f", {_M} SELECT * FROM m", audits.matrix)
on_attempts("g12_reconciled_totals", """, p AS (SELECT model_config_id, count(*) AS s FROM attempts GROUP BY 1), w AS (SELECT model_config_id, count(*) + CASE WHEN model_config_id = 'view' THEN 1 ELSE 0 END AS total FROM attempts GROUP BY 1)
  SELECT model_config_id, s AS sum, total FROM p JOIN w USING (model_config_id) WHERE s <> total""",
    lambda a, t: audits.reconcile(a.groupBy("model_config_id", "task_id").agg(F.count("*").alias("n")), a.groupBy("model_config_id").agg((F.count("*") + F.when(F.col("model_config_id") == "view", 1).otherwise(0)).alias("n")), "model_config_id", "n"))
on_attempts("g14_spec_faults", f""", {_GRADERS}, h AS (SELECT DISTINCT task_id FROM g), d AS (SELECT DISTINCT task_id FROM attempts WHERE task_id % 7 <> 0), b AS (
  SELECT task_id, t.grading_status AS s, t.task_id IS NOT NULL AS in_s, d.task_id IS NOT NULL AS in_d, h.task_id IS NOT NULL AS has FROM tasks t FULL JOIN d USING (task_id) LEFT JOIN h USING (task_id))
  SELECT task_id, 'not in the specification' AS fault FROM b WHERE NOT in_s UNION ALL SELECT task_id, 'not in the dataset' FROM b WHERE NOT in_d
  UNION ALL SELECT task_id, 'ready without graders' FROM b WHERE in_s AND s LIKE 'READY%' AND NOT has UNION ALL SELECT task_id, 'pending with graders' FROM b WHERE in_s AND s LIKE 'PENDING%' AND has""",
    lambda a, t: audits.spec_faults(t, _graders(a), a.where("task_id % 7 <> 0")))
on_table("g15_document_faults", "documents", """, d AS (SELECT doc_id, n_chars, coalesce(text, '') AS t FROM documents) SELECT doc_id, unnest(list_filter([CASE WHEN n_chars % 10 = 1 THEN 'word count' END, CASE WHEN n_chars % 10 = 2 THEN 'document hash' END,
  CASE WHEN n_chars % 10 = 3 THEN 'not embedded' END], lambda x: x IS NOT NULL)) AS fault FROM d""".replace(", d AS", "WITH d AS", 1),
    lambda d: (lambda t, n: audits.document_faults(d, F.size(text.words(t)), F.sha2(t, 256), t, F.when(n == 3, F.lit("Read: nothing\u0001")).otherwise(F.concat(F.lit("Read: "), t)),
        F.size(text.words(t)) + F.when(n == 1, 1).otherwise(0), F.when(n == 2, F.sha2(F.concat(t, F.lit("x")), 256)).otherwise(F.sha2(t, 256))).where(~((n == 3) & (t == ""))).select("doc_id", "fault"))(F.coalesce("text", F.lit("")), F.col("n_chars") % 10))
on_attempts("g16_code_task_faults", """SELECT task_id, f AS fault FROM (SELECT task_id, unnest(list_filter([CASE WHEN task_id % 5 = 1 THEN 'language' END, CASE WHEN task_id % 5 = 2 THEN 'entrypoint' END, CASE WHEN task_id % 5 = 3 THEN 'tests' END,
  CASE WHEN task_id % 5 IN (2, 4) THEN 'not in source' END], lambda x: x IS NOT NULL)) AS f FROM tasks)""",
    lambda a, t: audits.code_task_faults(t.select("task_id", F.when(F.col("task_id") % 5 == 1, "perl").otherwise("python").alias("language"), F.when(F.col("task_id") % 5 == 2, "2bad").otherwise("solve").alias("entrypoint"),
        F.when(F.col("task_id") % 5 == 3, 0).otherwise(3).alias("n_tests"), F.when(F.col("task_id") % 5 == 4, "def other(): pass").otherwise("def solve(): pass").alias("source"))))
on_attempts("g17_source_fidelity", """SELECT task_id, CASE WHEN task_id % 11 = 1 THEN NULL WHEN task_id % 11 = 2 THEN 'suite' ELSE 'difficulty' END AS "column" FROM tasks WHERE task_id % 11 IN (1, 2, 3)""",
    lambda a, t: audits.source_fidelity(t.where("task_id % 11 <> 1"), t.withColumn("suite", F.when(F.col("task_id") % 11 == 2, "moved").otherwise(F.col("suite"))).withColumn("difficulty", F.when(F.col("task_id") % 11 != 3, F.col("difficulty"))), "task_id", ["suite", "difficulty"]))
_review = lambda t: t.select("task_id", F.when(F.col("task_id") % 6 != 0, "UNKNOWN").alias("auto_mode"), F.when(F.col("task_id") % 6 == 1, "FINE").otherwise("CORRECT").alias("assessment"), F.when(F.col("task_id") % 6 != 2, "someone").alias("author"),
    F.when(F.col("task_id") % 6 == 3, "ODD").when(F.col("task_id") % 6 == 4, "MIXED").alias("mode_override"), F.when(F.col("task_id") % 6 == 3, "because").alias("override_reason"))
on_attempts("g18_review_faults", "SELECT task_id, ['no automatic analysis', 'assessment', 'author', 'override', 'override without a reason'][task_id % 6 + 1] AS fault FROM tasks WHERE task_id % 6 < 5", lambda a, t: audits.review_faults(_review(t)))
on_attempts("g22_full_cohort", """, p AS (SELECT model_config_id, task_id, count(*) AS n FROM attempts WHERE NOT is_warmup GROUP BY 1, 2), b AS (SELECT model_config_id, count(*) FILTER (WHERE t.task_id IS NOT NULL AND n = 3) AS whole,
  count(*) FILTER (WHERE t.task_id IS NOT NULL AND n <> 3) AS partial, count(*) FILTER (WHERE t.task_id IS NULL) AS "unknown" FROM p LEFT JOIN tasks t USING (task_id) GROUP BY 1)
  SELECT *, (SELECT count(*) FROM tasks) - whole - partial AS missing, partial = 0 AND "unknown" = 0 AND (SELECT count(*) FROM tasks) - whole - partial = 0 AS ok FROM b""", lambda a, t: audits.cohort(a, t, 3))  # fmt: skip

# upserts and keys
on_table("k02_insert_experiment", "events", "SELECT DISTINCT 'spec__' || event_type AS experiment_id FROM events UNION SELECT 'spec__new'",
    lambda e: judging.first_write(e.select(F.concat(F.lit("spec__"), "event_type").alias("experiment_id")).distinct(), e.sparkSession.createDataFrame([("spec__new",), ("spec__view",)], "experiment_id string"), ["experiment_id"]))
on_table("k05_targeted_update", "labels", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 9 ELSE quality END AS quality FROM labels",
    lambda x: judging.updated(x.select("doc_id", "quality"), x.where("doc_id % 4 = 0").select("doc_id", F.lit(9).alias("quality")), ["doc_id"]))
