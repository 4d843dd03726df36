"""All queries of the evaluation-analytics part, by inventory id, with DuckDB SQL.

Plans are built by the operators; the SQL is written apart from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import metrics as m
from lumenframe.functions import failures, graders, stats, text
from lumenframe.operators import evaluation as ev
from lumenframe.operators import gates, judging, verdicts
from lumenframe.operators import rollups as ru
from lumenframe.plans.trials import TRIALS_SQL, table, trials, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BASE, CAND = "click", "view"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = "WITH " + TRIALS_SQL + sql if sql.startswith(",") else sql
        return f

    return add


def on_trials(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    """A plan over ``trials``; the SQL follows the WITH list that defines trials."""
    QUERIES[name] = lambda spark, sf_dir: f(trials(spark, sf_dir))
    SQL[name] = "WITH " + TRIALS_SQL + sql


def on_tables(name: str, sql: str, f) -> None:
    """A plan over tables by name (``trials`` is one); SQL that reads trials gets their definition."""

    def run(spark, sf_dir):
        def get(n: str) -> DataFrame:
            return trials(spark, sf_dir) if n == "trials" else table(spark, sf_dir, n)

        return f(get)

    QUERIES[name] = run
    SQL[name] = ("WITH " + TRIALS_SQL + (", " + sql[5:] if sql.startswith("WITH ") else "\n" + sql)) if "trials" in sql else sql


OUTCOMES = """, det AS (SELECT * FROM trials WHERE grading_status = 'READY_DETERMINISTIC'),
outcomes AS (
  SELECT model_config_id, task_id, primary_class, difficulty, count(*) AS trials, count(*) FILTER (WHERE verdict = 'PASS') AS passes,
    bool_or(verdict = 'PASS') AS any_pass, bool_and(verdict = 'PASS') AS all_pass, arg_min(verdict = 'PASS', trial) AS first_pass,
    bool_or(verdict = 'PASS') <> bool_and(verdict = 'PASS') AS grader_flip, count(DISTINCT verdict) > 1 AS verdict_flip
  FROM det GROUP BY ALL)"""
PAIRS = OUTCOMES + f""", pairs AS (
  SELECT b.task_id, b.primary_class, b.difficulty, b.trials AS bt, b.passes AS bp, b.any_pass AS ba, b.all_pass AS bs,
    c.trials AS ct, c.passes AS cp, c.any_pass AS ca, c.all_pass AS cs
  FROM outcomes b JOIN outcomes c USING (task_id) WHERE b.model_config_id = '{BASE}' AND c.model_config_id = '{CAND}')"""

# capability, reliability, performance
on_trials("a24_capability", OUTCOMES + """
SELECT *, round(passes / trials, 9) AS trial_accuracy, round(any_pass_tasks / tasks, 9) AS any_pass_rate, round(all_pass_tasks / tasks, 9) AS all_pass_rate
FROM (SELECT model_config_id, count(*) AS tasks, sum(trials)::BIGINT AS trials, sum(passes)::BIGINT AS passes,
  count(*) FILTER (WHERE any_pass) AS any_pass_tasks, count(*) FILTER (WHERE all_pass) AS all_pass_tasks FROM outcomes GROUP BY 1)""", ev.capability)  # fmt: skip
on_trials("a04_reliability", OUTCOMES + """
SELECT model_config_id, task_id, o.trials, passes, any_pass, all_pass, first_pass, grader_flip, verdict_flip, decode_stdev, decode_cv,
  round(passes / o.trials, 9) AS success_rate
FROM outcomes o JOIN (
  SELECT model_config_id, task_id, round(CASE WHEN count(*) >= 2 THEN stddev_pop(decode_tok_s) END, 6) AS decode_stdev,
    round(CASE WHEN count(*) >= 2 AND avg(decode_tok_s) > 0 THEN stddev_pop(decode_tok_s) / avg(decode_tok_s) END, 6) AS decode_cv
  FROM det GROUP BY 1, 2) USING (model_config_id, task_id)""", ev.reliability)  # fmt: skip
on_trials("a22_experiment_means", OUTCOMES + """
SELECT model_config_id, round(avg(passes / trials), 9) AS mean_success, round(avg(first_pass::INT), 9) AS mean_first,
  round(avg(any_pass::INT), 9) AS mean_any, round(avg(all_pass::INT), 9) AS mean_all, round(avg(grader_flip::INT), 9) AS flip_rate,
  concat(count(*) FILTER (WHERE NOT first_pass AND any_pass), '/', count(*) FILTER (WHERE NOT first_pass)) AS recovery,
  round(count(*) FILTER (WHERE NOT first_pass AND any_pass) / nullif(count(*) FILTER (WHERE NOT first_pass), 0), 9) AS recovery_rate
FROM outcomes GROUP BY 1""", ev.experiment_means)  # fmt: skip
on_trials("a12_performance_snapshot", """, v AS (
  SELECT model_config_id, decode_tok_s, CASE WHEN eval_count <= 4 THEN '1-4' WHEN eval_count <= 32 THEN '5-32' WHEN eval_count <= 128 THEN '33-128' ELSE '129+' END AS bucket
  FROM trials WHERE eval_count IS NOT NULL),
u AS (SELECT * FROM v UNION ALL SELECT model_config_id, decode_tok_s, 'all' FROM v),
l AS (SELECT model_config_id, bucket, list_sort(list(decode_tok_s)) AS a, median(decode_tok_s) AS med, quantile_disc(decode_tok_s, 0.95) AS p95, avg(decode_tok_s) AS mean FROM u GROUP BY 1, 2),
q AS (SELECT *, len(a) AS n, greatest(1, least(len(a) - 1, (len(a) + 1) // 4)) AS j1, greatest(1, least(len(a) - 1, 3 * (len(a) + 1) // 4)) AS j3 FROM l),
d AS (SELECT DISTINCT model_config_id, b AS bucket FROM trials, (VALUES ('all'), ('1-4'), ('5-32'), ('33-128'), ('129+')) x(b))
SELECT model_config_id, bucket, coalesce(n, 0)::INT AS n, round(med, 6) AS median,
  round(CASE WHEN n >= 4 THEN (a[j1] * (4 - (n + 1 - 4 * j1)) + a[j1 + 1] * (n + 1 - 4 * j1)) / 4 END, 6) AS p25,
  round(CASE WHEN n >= 4 THEN (a[j3] * (4 - (3 * (n + 1) - 4 * j3)) + a[j3 + 1] * (3 * (n + 1) - 4 * j3)) / 4 END, 6) AS p75,
  round(p95, 6) AS p95, round(mean, 6) AS mean
FROM d LEFT JOIN q USING (model_config_id, bucket)""", lambda t: ev.performance(t).withColumn("n", F.col("n").cast("int")))  # fmt: skip
# paired comparison
on_trials("a26_transition_matrix", PAIRS + """
SELECT base_ok, cand_ok, count(bs)::BIGINT AS n FROM (VALUES (true, true), (true, false), (false, true), (false, false)) c(base_ok, cand_ok)
LEFT JOIN pairs ON bs = base_ok AND cs = cand_ok GROUP BY 1, 2""", lambda t: ev.transitions(ev.paired_tasks(t, BASE, CAND)))  # fmt: skip
on_trials("a26_transition_ids", PAIRS + " SELECT task_id, bs AS base_ok, cs AS cand_ok FROM pairs", lambda t: ev.transition_ids(ev.paired_tasks(t, BASE, CAND)))
_P = "CASE WHEN {0} + {1} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({0}, {1}) + 1), lambda i: exp(lgamma({0} + {1} + 1.0) - lgamma(i + 1.0) - lgamma({0} + {1} - i + 1.0) + ({0} + {1}) * ln(0.5))))) END"
on_trials("a27_exact_mcnemar", PAIRS + f""", one AS (
  SELECT count(*) FILTER (WHERE bs AND NOT cs) AS strict_b, count(*) FILTER (WHERE cs AND NOT bs) AS strict_c,
    count(*) FILTER (WHERE ba AND NOT ca) AS any_b, count(*) FILTER (WHERE ca AND NOT ba) AS any_c,
    round(sum(cp) / sum(ct) - sum(bp) / sum(bt), 9) AS accuracy_delta, round(avg(cs::INT) - avg(bs::INT), 9) AS all_pass_delta,
    round(avg(ca::INT) - avg(ba::INT), 9) AS any_pass_delta, count(*) FILTER (WHERE NOT ba AND NOT ca) AS failed_in_both
  FROM pairs)
SELECT *, round({_P.format("strict_b", "strict_c")}, 9) AS strict_p, round({_P.format("any_b", "any_c")}, 9) AS any_p FROM one""",
    lambda t: ev.mcnemar(ev.paired_tasks(t, BASE, CAND)))
for _id, _by in (("a28_strata_by_class", "primary_class"), ("a29_strata_by_difficulty", "difficulty")):
    on_trials(_id, OUTCOMES + f""", s AS (SELECT model_config_id AS m, {_by} AS stratum, count(*) AS n, round(avg((verdict = 'PASS')::INT), 9) AS r FROM det GROUP BY 1, 2)
SELECT stratum, b.n AS base_trials, b.r AS base_rate, c.n AS cand_trials, c.r AS cand_rate
FROM (SELECT * FROM s WHERE m = '{BASE}') b FULL JOIN (SELECT * FROM s WHERE m = '{CAND}') c USING (stratum)""",
        lambda t, by=_by: ev.strata(t, BASE, CAND, by))
on_tables("a05_flips_two_definitions", """SELECT model_config_id, task_id, count(DISTINCT CASE WHEN verdict = 'PASS' THEN 1 ELSE 0 END) > 1 AS grader_flip,
  count(DISTINCT verdict) > 1 AS verdict_flip FROM trials GROUP BY model_config_id, task_id""",
    lambda t: ru.flips(t("trials"), ["model_config_id", "task_id"]))
on_tables("j03_common_tasks", f"""SELECT task_id FROM trials WHERE model_config_id = '{BASE}' INTERSECT SELECT task_id FROM trials WHERE model_config_id = '{CAND}'""",
    lambda t: ru.common_keys(t("trials"), "model_config_id", [BASE, CAND], "task_id"))
on_tables("j04_trial_pair_join", f"""SELECT b.task_id, b.trial, b.verdict AS base_verdict, c.verdict AS cand_verdict FROM trials b JOIN trials c
  ON b.task_id = c.task_id AND b.trial = c.trial WHERE b.model_config_id = '{BASE}' AND c.model_config_id = '{CAND}'""",
    lambda t: ru.arms(t("trials"), {"base_verdict": BASE, "cand_verdict": CAND}, ["task_id", "trial"], "verdict"))
on_tables("j05_three_arm_join", """SELECT a.task_id, a.trial, a.verdict AS a, b.verdict AS b, c.verdict AS c FROM trials a
  JOIN trials b ON a.task_id = b.task_id AND a.trial = b.trial JOIN trials c ON a.task_id = c.task_id AND a.trial = c.trial
  WHERE a.model_config_id = 'click' AND b.model_config_id = 'view' AND c.model_config_id = 'purchase'""",
    lambda t: ru.arms(t("trials"), {"a": "click", "b": "view", "c": "purchase"}, ["task_id", "trial"], "verdict"))
on_tables("j06_left_join_default_text", """SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(d.lang, '') AS lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    lambda t: ru.with_default(t("documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang")), t("labels"), "doc_id", "quality", -1))
on_tables("j08_bijection_full_outer", """SELECT count(CASE WHEN a.k IS NULL THEN 1 END) AS only_right, count(CASE WHEN b.k IS NULL THEN 1 END) AS only_left, count(*) AS total
  FROM (SELECT DISTINCT task_id AS k FROM trials WHERE model_config_id = 'click') a FULL OUTER JOIN (SELECT DISTINCT task_id AS k FROM trials WHERE verdict = 'FAIL') b ON a.k = b.k""",
    lambda t: ru.bijection(t("trials").where("model_config_id = 'click'"), t("trials").where("verdict = 'FAIL'"), "task_id"))
on_tables("j09_registry_star_join", """SELECT s.s_suppkey, s.s_name, n.n_name, r.r_name, coalesce(x.parts, 0) AS parts FROM supplier s
  LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN (SELECT l_suppkey, count(*) AS parts FROM lineitem GROUP BY l_suppkey) x ON s.s_suppkey = x.l_suppkey""",
    lambda t: ru.enriched(t("supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey")), (t("nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey")), ["n_nationkey"]),
        (t("region").select("r_regionkey", "r_name"), ["r_regionkey"]), (t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("parts")), ["s_suppkey"])).select("s_suppkey", "s_name", "n_name", "r_name", F.coalesce("parts", F.lit(0)).alias("parts")))
on_tables("j11_left_driven_groups", """SELECT p.p_partkey, count(l.l_orderkey) AS trials, coalesce(sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END), 0) AS passes
  FROM part p LEFT JOIN lineitem l ON p.p_partkey = l.l_partkey GROUP BY p.p_partkey""",
    lambda t: ru.driven(t("part").select("p_partkey"), t("lineitem").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", F.col("l_returnflag") == "R"))
on_tables("j16_expected_population", """SELECT task_id, r.trial FROM (SELECT DISTINCT task_id FROM trials) e, (SELECT unnest(range(1, 13))::INT AS trial) r
  WHERE NOT EXISTS (SELECT 1 FROM trials o WHERE o.model_config_id = 'purchase' AND o.task_id = e.task_id AND o.trial = r.trial)""",
    lambda t: ru.missing_identities(t("trials").where("model_config_id = 'purchase'"), t("trials").select("task_id").distinct(), "task_id", 12))
on_tables("f04_population_filter", "SELECT model_config_id, count(*) AS n FROM trials WHERE grading_status = 'READY_DETERMINISTIC' GROUP BY model_config_id",
    lambda t: ev.deterministic(t("trials")).groupBy("model_config_id").agg(F.count("*").alias("n")))
on_tables("f05_failed_rows", "SELECT model_config_id, task_id, trial FROM trials WHERE verdict = 'FAIL'",
    lambda t: t("trials").where(F.col("verdict") == "FAIL").select("model_config_id", "task_id", "trial"))
on_tables("f06_identity_semi_join", "SELECT t.task_id, t.trial, t.verdict FROM trials t WHERE t.model_config_id = 'click' AND EXISTS (SELECT 1 FROM trials u WHERE u.model_config_id = 'view' AND u.task_id = t.task_id AND u.trial = t.trial AND u.verdict = 'PASS')",
    lambda t: ru.semi(t("trials").where("model_config_id = 'click'").select("task_id", "trial", "verdict"), t("trials").where("model_config_id = 'view' and verdict = 'PASS'"), ["task_id", "trial"]))
on_tables("f12_token_bucket", """SELECT CASE WHEN eval_count <= 4 THEN '1-4' WHEN eval_count <= 32 THEN '5-32' WHEN eval_count <= 128 THEN '33-128' WHEN eval_count > 128 THEN '129+' END AS bucket, count(*) AS n FROM trials GROUP BY 1""",
    lambda t: t("trials").groupBy(m.token_bucket(F.col("eval_count")).alias("bucket")).agg(F.count("*").alias("n")))
on_tables("f15_excerpt", "SELECT doc_id, substring(text, 1, 300) AS excerpt FROM documents",
    lambda t: t("documents").select("doc_id", text.excerpt(F.col("text"), 300).alias("excerpt")))
on_tables("a07_pstdev_cv", """SELECT model_config_id, round(CASE WHEN count(decode_tok_s) >= 2 THEN stddev_pop(decode_tok_s) END, 6) AS sd,
  round(CASE WHEN count(decode_tok_s) >= 2 AND avg(decode_tok_s) > 0 THEN stddev_pop(decode_tok_s) / avg(decode_tok_s) END, 6) AS cv FROM trials GROUP BY model_config_id""",
    lambda t: ru.spread(t("trials"), "model_config_id", "decode_tok_s"))
on_tables("a11_max_non_null", "SELECT model_config_id, max(eval_count) AS peak FROM trials GROUP BY model_config_id",
    lambda t: t("trials").groupBy("model_config_id").agg(F.max("eval_count").alias("peak")))
on_tables("a17_deferrals", "SELECT model_config_id, count(CASE WHEN grading_status = 'READY_JUDGE' THEN 1 END) AS deferred FROM trials GROUP BY model_config_id",
    lambda t: t("trials").groupBy("model_config_id").agg(F.count_if(F.col("grading_status") == "READY_JUDGE").alias("deferred")))
on_tables("a20_state_distribution", "SELECT model_config_id, verdict, count(*) AS n FROM trials GROUP BY model_config_id, verdict",
    lambda t: t("trials").groupBy("model_config_id", "verdict").agg(F.count("*").alias("n")))
on_tables("a21_judge_rollup", """SELECT task_id, count(*) AS trials, sum(CASE WHEN verdict = 'PASS' THEN 1 ELSE 0 END) AS precheck_passes,
  round(sum(CASE WHEN verdict = 'PASS' THEN 1 ELSE 0 END) * 1.0 / count(*), 9) AS rate FROM trials WHERE grading_status = 'READY_JUDGE' GROUP BY task_id""",
    lambda t: ev.judge_rollup(t("trials")))
on_tables("a30_systematic_failures", f"""SELECT task_id FROM trials WHERE trial <= 2 AND model_config_id IN ('{BASE}', '{CAND}') GROUP BY task_id HAVING max(CASE WHEN verdict = 'PASS' THEN 1 ELSE 0 END) = 0 AND count(DISTINCT model_config_id) = 2""",
    lambda t: ru.never_passed(t("trials").where("trial <= 2"), [BASE, CAND]))
on_tables("a32_abc_pair_counts", """SELECT sum(CASE WHEN b = 'PASS' AND c = 'PASS' THEN 1 ELSE 0 END) AS both_pass, sum(CASE WHEN b = 'PASS' AND c <> 'PASS' THEN 1 ELSE 0 END) AS b_only,
  sum(CASE WHEN b <> 'PASS' AND c = 'PASS' THEN 1 ELSE 0 END) AS c_only, sum(CASE WHEN b <> 'PASS' AND c <> 'PASS' THEN 1 ELSE 0 END) AS neither
  FROM (SELECT x.verdict AS b, y.verdict AS c FROM trials x JOIN trials y ON x.task_id = y.task_id AND x.trial = y.trial WHERE x.model_config_id = 'view' AND y.model_config_id = 'purchase') z""",
    lambda t: ev.pair_counts(ru.arms(t("trials"), {"b": "view", "c": "purchase"}, ["task_id", "trial"], "verdict")))
on_tables("a35_grouping_sets", """SELECT primary_class, difficulty, count(*) AS trials, sum(CASE WHEN verdict = 'PASS' THEN 1 ELSE 0 END) AS passes FROM trials GROUP BY GROUPING SETS ((primary_class, difficulty), (primary_class), (difficulty), ())""",
    lambda t: ru.by_sets(t("trials"), [["primary_class", "difficulty"], ["primary_class"], ["difficulty"], []], "primary_class", "difficulty"))
on_tables("a36_mode_shares", """SELECT verdict, n, round(n * 1.0 / sum(n) OVER (), 4) AS share FROM (SELECT verdict, count(*) AS n FROM trials WHERE verdict <> 'PASS' GROUP BY verdict) x""",
    lambda t: ru.shares(t("trials").where("verdict <> 'PASS'"), "verdict"))
on_tables("a37_weighted_share", """SELECT l.quality, sum(x.failed_rows) AS weight FROM labels l JOIN (SELECT task_id, count(*) AS failed_rows FROM trials WHERE verdict = 'FAIL' GROUP BY task_id) x ON l.doc_id = x.task_id GROUP BY l.quality""",
    lambda t: ru.weighted(t("labels").select(F.col("doc_id").alias("task_id"), "quality"), t("trials").where("verdict = 'FAIL'"), "task_id", "quality"))
on_tables("a38_multi_mode_tasks", "SELECT task_id, count(DISTINCT verdict) AS modes, count(DISTINCT verdict) > 1 AS multi_mode FROM trials WHERE verdict <> 'PASS' GROUP BY task_id",
    lambda t: ru.modes_of(t("trials").where("verdict <> 'PASS'"), "task_id", "verdict"))
on_tables("a39_judge_failures", "SELECT model_config_id, task_id, trial, verdict FROM trials WHERE grading_status = 'READY_JUDGE' AND verdict = 'FAIL'",
    lambda t: t("trials").where((F.col("grading_status") == "READY_JUDGE") & (F.col("verdict") == "FAIL")).select("model_config_id", "task_id", "trial", "verdict"))
on_tables("a42_two_condition_pass", """SELECT l_returnflag AS suite, count(*) AS n, sum(CASE WHEN l_discount < 0.05 AND l_tax < 0.05 THEN 1 ELSE 0 END) AS passes, sum(CASE WHEN l_tax >= 0.05 THEN 1 ELSE 0 END) AS static_failures FROM lineitem GROUP BY l_returnflag""",
    lambda t: ru.both_checks(t("lineitem").withColumnRenamed("l_returnflag", "suite"), "suite", F.col("l_tax") < 0.05, F.col("l_discount") < 0.05))
on_tables("a43_cohort_rollup", "SELECT model_config_id, count(*) AS trials, sum(CASE WHEN verdict = 'PASS' THEN 1 ELSE 0 END) AS passes FROM trials GROUP BY ROLLUP (model_config_id)",
    lambda t: ru.with_total(t("trials"), "model_config_id"))
on_tables("a48_histogram", "SELECT verdict, count(*) AS n FROM trials GROUP BY verdict",
    lambda t: t("trials").groupBy("verdict").agg(F.count("*").alias("n")))
on_tables("a50_audit_matrix", "SELECT primary_class, difficulty, count(DISTINCT task_id) AS tasks FROM trials GROUP BY primary_class, difficulty",
    lambda t: t("trials").select("primary_class", "difficulty", "task_id").distinct().groupBy("primary_class", "difficulty").agg(F.count("*").alias("tasks")))
on_tables("a52_sweep_counts", "SELECT count(*) AS models, sum(CASE WHEN n >= 1000 THEN 1 ELSE 0 END) AS large, sum(CASE WHEN n < 1000 THEN 1 ELSE 0 END) AS small FROM (SELECT model_config_id, count(*) AS n FROM trials GROUP BY model_config_id) x",
    lambda t: ev.sweep_counts(t("trials"), 1000))
on_tables("a55_filtered_count", "SELECT count(*) AS n FROM trials WHERE trial = 1",
    lambda t: t("trials").where(F.col("trial") == 1).agg(F.count("*").alias("n")))
on_tables("w02_first_attempt", "SELECT model_config_id, task_id, verdict FROM (SELECT *, row_number() OVER (PARTITION BY model_config_id, task_id ORDER BY trial) AS rn FROM trials) x WHERE rn = 1",
    lambda t: ru.first_attempts(t("trials"), ["model_config_id", "task_id"]))
on_tables("w05_last_write", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn = 1",
    lambda t: ru.last_rows(t("events"), "user_id", ["ts", "event_id"], ["event_id", "value"]))
on_tables("w06_duplicate_identities", "SELECT o_custkey, o_orderstatus, n FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) WHERE n > 1",
    lambda t: ru.repeated(t("orders"), ["o_custkey", "o_orderstatus"]))
on_tables("o04_prefix_limit", "SELECT task_id FROM (SELECT task_id, row_number() OVER (ORDER BY task_id) AS rn FROM (SELECT DISTINCT task_id FROM trials) t) x WHERE rn <= 10",
    lambda t: ru.first_keys(t("trials"), "task_id", 10))
on_tables("o08_strata_union", "SELECT primary_class AS stratum FROM trials UNION SELECT difficulty FROM trials",
    lambda t: ru.union_of(t("trials"), ["primary_class", "difficulty"], "stratum"))
on_tables("o09_set_difference", "SELECT DISTINCT task_id FROM trials WHERE verdict = 'FAIL' AND trial = 1 EXCEPT SELECT DISTINCT task_id FROM trials WHERE verdict = 'PASS' AND model_config_id = 'click' AND trial = 1",
    lambda t: ru.minus(t("trials").where("verdict = 'FAIL' and trial = 1"), t("trials").where("verdict = 'PASS' and model_config_id = 'click' and trial = 1"), "task_id"))
on_tables("o11_ordered_concat", "SELECT 1 AS cohort, doc_id FROM labels WHERE quality = 0 UNION ALL SELECT 2 AS cohort, doc_id FROM labels WHERE toxic = 1",
    lambda t: ru.cohorts([t("labels").where("quality = 0"), t("labels").where("toxic = 1")], "doc_id"))
on_tables("m12_context_headroom", "SELECT max(n_chars) AS longest, 200000 - max(n_chars) - 1024 AS headroom, 200000 - max(n_chars) - 1024 >= 0 AS fits, min(CASE WHEN n_chars = top THEN doc_id END) AS doc_id FROM (SELECT doc_id, n_chars, max(n_chars) OVER () AS top FROM documents) x",
    lambda t: ru.headroom(t("documents"), "doc_id", "n_chars", 200000, 1024))
on_tables("x45_content_ids", "SELECT doc_id, sha256(concat(coalesce(cast(doc_id AS VARCHAR(20)), 'None'), '|', coalesce(lang, 'None'), '|', coalesce(source, 'None'))) AS id FROM documents",
    lambda t: t("documents").select("doc_id", text.content_id(F.col("doc_id"), F.col("lang"), F.col("source")).alias("id")))

# metrics over counters made from lineitem
_COUNTERS = """SELECT l_orderkey AS k, l_linenumber AS ln, CAST(floor(l_quantity) AS BIGINT) AS cnt,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(floor(l_quantity) AS BIGINT) - l_linenumber + 3 - (l_orderkey % 7) END AS cached,
  CASE WHEN l_linenumber = 5 THEN 0 ELSE CAST(floor(l_extendedprice) AS BIGINT) * 1000 END AS ns FROM lineitem"""


@query("m01_generation_metrics", f"""SELECT k, ln,
  CASE WHEN cached IS NULL THEN cnt WHEN cached >= 0 AND cached <= cnt THEN cnt - cached END AS uncached,
  round(CASE WHEN cached IS NULL THEN 0.0 WHEN cached < 0 OR cached > cnt THEN NULL WHEN cnt = 0 THEN 0.0 ELSE cached / cnt END, 9) AS cache_ratio,
  CASE WHEN cached < 0 OR cached > cnt THEN 'UNKNOWN' WHEN cnt = 0 OR cached IS NULL OR cached = 0 THEN 'UNCACHED' WHEN cached = cnt THEN 'FULLY_CACHED' ELSE 'PARTIAL' END AS cache_state,
  CASE WHEN cnt > 0 AND ns > 0 THEN cnt / (ns / 1e9) END AS decode_tok_s, CASE WHEN cnt > 0 AND ns > 0 THEN ns / 1e6 / cnt END AS decode_ms_per_token,
  round(ns / 1e6, 6) AS ttft_ms, coalesce(ns / 1e6 > 1000.0, false) AS reloaded FROM ({_COUNTERS})""")  # fmt: skip
def generation_metrics(spark, sf_dir):
    """M01-M03, M05-M07 and F13 over one row per generation: a projection, nothing else."""
    c = views(spark, sf_dir).sql(_COUNTERS)
    n, cached, ns = F.col("cnt"), F.col("cached"), F.col("ns")
    return c.select(
        "k", "ln", m.uncached(n, cached).alias("uncached"), F.round(m.cache_ratio(n, cached), 9).alias("cache_ratio"),
        m.cache_state(n, cached).alias("cache_state"), m.per_second(n, ns).alias("decode_tok_s"),
        m.ms_each(n, ns).alias("decode_ms_per_token"), F.round(m.span_ms(F.lit(0), ns), 6).alias("ttft_ms"),
        m.reloaded(ns / 1e6).alias("reloaded"),
    )


@query("m10_residency_verdict", """SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN 'INELIGIBLE_DIGEST' WHEN s_acctbal <= 0 THEN 'INELIGIBLE_UNMEASURABLE'
  WHEN s_nationkey % 5 = 1 THEN 'ELIGIBLE_GPU' ELSE 'INELIGIBLE_PARTIAL' END AS verdict FROM supplier""")
def residency(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    size = F.col("s_acctbal")
    held = F.when(F.col("s_nationkey") % 5 == 1, size).otherwise(size - 1)
    return s.select("s_suppkey", m.residency_verdict(held, size, F.col("s_nationkey") % 5 != 0).alias("verdict"))


@query("m14_call_cost", """SELECT o_orderkey, coalesce(CASE WHEN o_custkey % 3 = 0 AND o_totalprice >= 0 THEN o_totalprice END, o_totalprice / 1000 * 0.25) AS cost FROM orders""")
def call_cost(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    given = F.when(F.col("o_custkey") % 3 == 0, F.col("o_totalprice"))
    return o.select("o_orderkey", m.call_cost(given, F.col("o_totalprice"), F.lit(0.25)).alias("cost"))


# skyline
_POINTS = "SELECT p_partkey AS id, p_size AS score, p_retailprice AS cost FROM part"


@query("j12_skyline", f"""WITH p AS ({_POINTS}) SELECT id, score, cost FROM p WHERE NOT EXISTS (
  SELECT 1 FROM p q WHERE q.score >= p.score AND q.cost <= p.cost AND (q.score > p.score OR q.cost < p.cost))""")
def skyline(spark, sf_dir):
    return ev.skyline(views(spark, sf_dir).sql(_POINTS), "id", "score", "cost", smaller_is_better=True)


# judging
@query("j13_first_pairs", """WITH r AS (SELECT o_custkey AS g, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
  p AS (SELECT a.g, a.item AS left_item, b.item AS right_item, row_number() OVER (PARTITION BY a.g ORDER BY a.rn, b.rn) AS pair FROM r a JOIN r b ON a.g = b.g AND a.rn < b.rn)
  SELECT g, left_item, right_item, pair FROM p WHERE pair <= 3""")
def first_pairs(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("item"))
    return judging.first_pairs(items, "g", ["item"], "item", 3).select("g", "left_item", "right_item", "pair")


_JUDGED = """SELECT user_id AS pair_id, CASE WHEN event_id % 2 = 0 THEN 'forward' ELSE 'inverse' END AS orientation,
  CASE WHEN value < 5 THEN 'A' WHEN value < 15 THEN 'B' WHEN value < 25 THEN 'TIE' ELSE 'NEITHER' END AS shown, event_id AS seq FROM events"""


@query("a44_position_flips", f"""WITH j AS ({_JUDGED}), n AS (SELECT *, CASE shown WHEN 'A' THEN CASE orientation WHEN 'forward' THEN 'LEFT' ELSE 'RIGHT' END
  WHEN 'B' THEN CASE orientation WHEN 'forward' THEN 'RIGHT' ELSE 'LEFT' END ELSE shown END AS w FROM j),
  s AS (SELECT pair_id, arg_max(w, seq) FILTER (WHERE orientation = 'forward') AS f, arg_max(w, seq) FILTER (WHERE orientation = 'inverse') AS i FROM n GROUP BY 1)
  SELECT count(*) AS comparable, count(*) FILTER (WHERE f <> i) AS flips, round(count(*) FILTER (WHERE f <> i) / nullif(count(*), 0), 9) AS flip_rate FROM s WHERE f IS NOT NULL AND i IS NOT NULL""")
def position_flips(spark, sf_dir):
    j = views(spark, sf_dir).sql(_JUDGED)
    return judging.position_flips(j.withColumn("winner", judging.normalise_winner(F.col("shown"), F.col("orientation"))))


@query("a45_majority_vote", """SELECT o_orderkey, CASE WHEN v[1] = v[2] OR v[1] = v[3] THEN v[1] WHEN v[2] = v[3] THEN v[2] ELSE v[1] END AS decision
  FROM (SELECT o_orderkey, [o_orderstatus, CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'O' END, CASE WHEN o_totalprice > 150000 THEN 'F' ELSE 'P' END] AS v FROM orders)""")
def majority_vote(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    votes = F.array(
        F.col("o_orderstatus"), F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("O"), F.when(F.col("o_totalprice") > 150000, "F").otherwise("P")
    )
    return o.select("o_orderkey", judging.majority(votes).alias("decision"))


@query("a54_population_hash", """SELECT user_id, sha256(string_agg(concat(event_id, '|', event_type), chr(10) ORDER BY concat(event_id, '|', event_type))) AS hash, count(*) AS n FROM events GROUP BY 1""")
def population_hash(spark, sf_dir):
    line = F.concat_ws("|", F.col("event_id").cast("string"), "event_type")
    return judging.population_hash(table(spark, sf_dir, "events"), line, ["user_id"])


@query("k04_upsert_last_wins", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def upsert(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return judging.last_write(log, ["user_id", "event_type"], "event_id")


@query("k03_insert_or_ignore", "SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def insert_or_ignore(spark, sf_dir):
    return judging.first_write(table(spark, sf_dir, "labels").select("doc_id", "quality"), table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


@query("k06_delete_keys", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity < 5)")
def delete_keys(spark, sf_dir):
    gone = table(spark, sf_dir, "lineitem").where("l_quantity < 5").select(F.col("l_orderkey").alias("o_orderkey"))
    return judging.without_keys(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, ["o_orderkey"])


@query("g01_population_gate", """WITH e AS (SELECT DISTINCT doc_id FROM documents), o AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1), b AS (SELECT e.doc_id AS e, n FROM e FULL JOIN o USING (doc_id))
  SELECT count(*) FILTER (WHERE n IS NULL) AS missing, count(*) FILTER (WHERE e IS NULL) AS extra, count(*) FILTER (WHERE n > 1) AS repeated,
  count(*) FILTER (WHERE n IS NULL OR e IS NULL OR n > 1) = 0 AS ok FROM b""")
def population_gate(spark, sf_dir):
    return judging.population_gate(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), ["doc_id"])


# text and graders over documents
_LIMITS = [
    {"kind": "word_range", "min": 50, "max": 2000},
    {"kind": "forbidden_chars", "chars": ["#", "$"]},
    {"kind": "required_terms", "terms": ["the"]},
    {"kind": "line_count", "value": 5},
    {"kind": "parenthetical_count", "value": 0},
]


@query("r06_constraints", r"""SELECT doc_id, array_to_string(list_filter([
  CASE WHEN NOT len(regexp_extract_all(t, '\S+')) BETWEEN 50 AND 2000 THEN 'word_range' END, CASE WHEN contains(t, '#') OR contains(t, '$') THEN 'forbidden_chars' END,
  CASE WHEN NOT contains(lower(t), 'the') THEN 'required_terms' END, CASE WHEN len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) <> 5 THEN 'line_count' END,
  CASE WHEN contains(t, '(') OR contains(t, ')') THEN 'parenthetical_count' END], lambda x: x IS NOT NULL), ',') AS violations FROM (SELECT doc_id, trim(text) AS t FROM documents)""")
def constraints(spark, sf_dir):
    t = text.normalised(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.violated_kinds(t, _LIMITS), ",").alias("violations"))


@query("x02_word_and_line_counts", r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n_words, len(list_filter(string_split(trim(text), chr(10)), lambda x: trim(x) <> '')) AS n_lines, (length(text) - length(replace(lower(text), 'the', ''))) // 3 AS n_the FROM documents")
def counts(spark, sf_dir):
    found = text.once(text.normalised(F.col("text")), lambda t: F.struct(
        F.size(text.words(t)).cast("bigint").alias("n_words"), F.size(text.lines(t)).cast("bigint").alias("n_lines"), text.occurrences(t, "the").cast("bigint").alias("n_the"),
    ))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("x")).select("doc_id", "x.*")


#: Texts made of a turn's role and number: a page with a list, items and a table; and small ones that grow with the number.
_said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
_many = lambda x: F.repeat(F.lit(x), F.col("turn").cast("int"))
_PAGE = lambda: _said(
    "Plan ", F.col("role"), ". Is ", F.col("turn").cast("int").cast("string"), " of 12.5 fine?\n- ", F.col("role"), _many(" two"), "\n* plain\n1. ", F.col("role"), " item. Done.\n2. next\n| a | ", F.col("role"), " |\n|---|---|\n| 1 | 2 |", _many("\n| 3 | 4 |"), "\nends ", F.col("role"), " \r\n"
)
#: Each kind: parameters, the text it reads, and when it holds.
_KINDS = [
    ("word_count", {"value": 42}, _PAGE, "turn = 2"), ("word_range", {"min": 40, "max": 60}, _PAGE, "turn BETWEEN 2 AND 5"), ("word_limit", {"max": 48}, _PAGE, "turn <= 3"),
    ("first_word", {"word": "In"}, None, "rtrim(regexp_extract(trim(text), '^\\S+'), '.,;:') = 'In'"), ("last_word", {"word": "user"}, _PAGE, "role = 'user'"), ("term_occurrence", {"term": "TWO", "count": 3}, _PAGE, "turn = 3"),
    ("forbidden_terms", {"terms": ["ASS", "zzz"]}, _PAGE, "role <> 'assistant'"), ("allowed_punctuation", {}, lambda: _said("B. ", F.col("role"), F.when(F.col("turn").cast("int") % 2 == 0, " x").otherwise("!")), "turn % 2 = 0"),
    ("forbidden_chars", {"chars": ["\u00fc", "\u00e7"]}, None, "NOT contains(text, '\u00fc') AND NOT contains(text, '\u00e7')"), ("required_terms", {"terms": ["EN", "ou"]}, None, "contains(lower(text), 'en') AND contains(lower(text), 'ou')"),
    ("first_prefix", {"prefix": "Plan u"}, _PAGE, "role = 'user'"), ("parenthetical_count", {"value": 2}, lambda: _said("x ", _many("(y) ")), "turn = 2"), ("bullet_count", {"value": 3}, lambda: _said("x", _many("\n- b")), "turn = 3"),
    ("numbered_list_count", {"value": 2}, lambda: _said("x", _many("\n1) b")), "turn = 2"), ("item_prefix", {"index": 1, "prefix": "user"}, _PAGE, "role = 'user'"), ("item_contains", {"index": 1, "term": "sys"}, _PAGE, "role = 'system'"),
    ("item_excludes_chars", {"index": 1, "chars": ["y"]}, _PAGE, "role <> 'system'"), ("item_sentence_count", {"index": 1, "value": 3}, lambda: _said("1. a.", _many(" b!")), "turn = 2"), ("sentence_count", {"value": 3}, lambda: _said("a.", _many(" b?")), "turn = 2"),
    ("sentence_contains", {"index": 1, "terms": ["USER"]}, _PAGE, "role = 'user'"), ("sentence_numeric_tokens", {"index": 2, "min": 2, "max": 3}, lambda: _said("A. B", _many(" 7.5"), "."), "turn BETWEEN 2 AND 3"),
    ("sentence_is_question", {"index": 1}, lambda: _said(F.col("role"), F.when(F.col("turn").cast("int") % 2 == 0, "? b.").otherwise(". b?")), "turn % 2 = 0"), ("markdown_table_shape", {"columns": ["a", "user"], "data_rows": 3}, _PAGE, "turn = 2 AND role = 'user'"),
    ("trailing_literal", {"literal": "user"}, _PAGE, "role = 'user'"), ("line_count", {"value": 11}, _PAGE, "turn = 2"), ("line_prefix_sequence", {"prefixes": ["Plan", "- user"]}, _PAGE, "role = 'user'"),
    ("line_word_limit", {"max_words": 7}, _PAGE, "turn <= 5"), ("line_contains", {"lines": ["A", "B"], "term": "SYS"}, _PAGE, "role = 'system'"), ("bullet_prefix", {"index": 1, "prefix": "assist"}, _PAGE, "role = 'assistant'"),
    ("bullet_word_limit", {"max_words": 3}, _PAGE, "turn <= 2"), ("ends_with", {"suffix": "system"}, _PAGE, "role = 'system'"), ("required_prefix", {"prefix": "Plan a"}, _PAGE, "role = 'assistant'"),
]


def _kind_query(n: int, kind: str, asked: dict, said, when: str) -> None:
    """Whether every turn's text meets a constraint, and whether violations say so."""
    name = f"q{n:02d}_{kind}"
    SQL[name] = f"SELECT conv_id, turn, {when} AS holds, {when} AS clean FROM conversations"

    def run(spark, sf_dir):
        t = text.normalised(F.col("text") if said is None else said())
        rule = {"kind": kind} | asked
        return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.holds(t, rule).alias("holds"), (F.size(text.violations(t, [rule])) == 0).alias("clean"))

    QUERIES[name] = run


for _n, _case in enumerate(_KINDS, 1):
    _kind_query(_n, *_case)


@query("x37_slug", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("r02_numeric_grader", r"SELECT o_orderkey, abs(round(o_totalprice, 0) - o_totalprice) <= 0.25 AS passed FROM orders")
def numeric_grader(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    said = F.concat(F.round("o_totalprice", 0).cast("decimal(20,0)").cast("string"), F.lit("."))
    got = text.bare_number(said)
    return o.select("o_orderkey", F.coalesce(text.close_to(got, F.col("o_totalprice"), 0.25), F.lit(False)).alias("passed"))


@query("r03_time_grader", "SELECT event_id, hour(ts)::INT AS h, minute(ts)::INT AS m FROM events")
def time_grader(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    said = F.date_format("ts", "h:mm a")
    return e.select("event_id", text.time_parts(said, True, True).alias("t")).select("event_id", "t.h", "t.m")


@query("r10_verdicts", """SELECT user_id, event_type, CASE WHEN user_id % 11 = 0 THEN 'REFUSED_NOT_EXECUTABLE' WHEN min(value) < 2 THEN 'FAIL' WHEN user_id % 15 = 0 THEN 'NEEDS_JUDGE' ELSE 'PASS' END AS verdict FROM events GROUP BY 1, 2""")
def reduced(spark, sf_dir):
    judge = F.when(F.col("user_id") % 15 == 0, "rubric_judge").otherwise("exact")
    one = F.struct(judge.alias("grader_type"), F.lit(True).alias("passed"), F.lit("").alias("detail"), F.array().cast("array<string>").alias("violations"))
    two = F.struct(F.lit("numeric").alias("grader_type"), (F.col("value") >= 2).alias("passed"), F.lit("").alias("detail"), F.array().cast("array<string>").alias("violations"))
    by = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.flatten(F.collect_list(F.array(one, two))).alias("r"))
    status = F.when(F.col("user_id") % 11 == 0, "PENDING_SPECIFICATION").otherwise("READY_DETERMINISTIC")
    return by.select("user_id", "event_type", verdicts.reduce_verdict(F.col("r"), status).alias("verdict"))


@query("x23_row_modes", """SELECT user_id, CASE WHEN count(DISTINCT mode) FILTER (WHERE mode <> 'UNKNOWN') = 0 THEN 'UNKNOWN' WHEN count(DISTINCT mode) FILTER (WHERE mode <> 'UNKNOWN') = 1 THEN max(mode) FILTER (WHERE mode <> 'UNKNOWN') ELSE 'MIXED' END AS mode
  FROM (SELECT user_id, CASE WHEN value < 1 THEN 'CONTENT_ERROR' WHEN value > 60 THEN 'OUTPUT_CONTRACT' ELSE 'UNKNOWN' END AS mode FROM events) GROUP BY 1""")
def row_modes(spark, sf_dir):
    mode = F.when(F.col("value") < 1, "CONTENT_ERROR").when(F.col("value") > 60, "OUTPUT_CONTRACT").otherwise("UNKNOWN")
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(mode).alias("modes"))
    return by.select("user_id", verdicts.row_mode(F.col("modes")).alias("mode"))


@query("f17_config_drift", """WITH a AS (SELECT c_custkey AS key, c_acctbal::VARCHAR AS v FROM customer), b AS (SELECT s_suppkey AS key, s_acctbal::VARCHAR AS v FROM supplier) SELECT count(*) AS drifted FROM a FULL JOIN b USING (key) WHERE a.v IS DISTINCT FROM b.v""")
def config_drift(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_acctbal").cast("string").alias("value"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_acctbal").cast("string").alias("value"))
    return judging.drift(a, b).agg(F.count("*").alias("drifted"))


# graders, asserted values and gates
@query("r01_exact_grader", "SELECT o_orderkey, lower(o_orderstatus) IN ('f', 'o') AS passed FROM orders")
def exact_grader(spark, sf_dir):
    spec = {"expected": "f", "accepted_alternates": ["O"], "case_sensitive": False}
    said = F.concat(F.lit("\r\n "), F.col("o_orderstatus"), F.lit(" "))
    return table(spark, sf_dir, "orders").select("o_orderkey", graders.exact(said, spec)["passed"].alias("passed"))


@query("r07_fact_check", r"""SELECT doc_id, contains(lower(t), 'the') AND NOT contains(lower(t), 'password') AND len(regexp_extract_all(t, '\S+')) BETWEEN 50 AND 2000 AS passed
  FROM (SELECT doc_id, trim(text) AS t FROM documents)""")
def fact_check(spark, sf_dir):
    spec = {"required_facts": ["The"], "forbidden_facts": ["password"], "word_range": {"min": 50, "max": 2000}}
    return table(spark, sf_dir, "documents").select("doc_id", graders.fact_check(F.col("text"), spec)["passed"].alias("passed"))


@query("r08_refusal_grader", "SELECT p_partkey, p_size % 3 <> 2 AS passed FROM part")
def refusal_grader(spark, sf_dir):
    said = F.when(F.col("p_size") % 3 == 0, "Unknown.").when(F.col("p_size") % 3 == 1, "cannot_determine").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", graders.refusal(said, {"refusal_expected": True})["passed"].alias("passed"))


@query("x24_asserted_values", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey = o_custkey THEN 'ASSERTED_SINGLE' ELSE 'ASSERTED_CONTRADICTION' END AS status FROM orders""")
def asserted_values(spark, sf_dir):
    last = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.concat(F.lit("\n**"), F.col("o_orderkey").cast("string"), F.lit(".**")))
    said = F.concat(F.lit("3 of 4 steps\nThe answer is "), F.col("o_custkey").cast("string"), F.lit("."), last)
    return table(spark, sf_dir, "orders").select("o_orderkey", failures.asserted_status(failures.asserted(said, "numeric")).alias("status"))


@query("g02_identity_mismatch", f""", a AS (SELECT DISTINCT task_id, trial, 1 AS l FROM trials WHERE model_config_id = '{BASE}'),
  b AS (SELECT DISTINCT task_id, trial, 1 AS r FROM trials WHERE model_config_id = '{CAND}')
  SELECT count(*) FILTER (WHERE r IS NULL) AS only_left, count(*) FILTER (WHERE l IS NULL) AS only_right, count(*) FILTER (WHERE l IS NULL OR r IS NULL) = 0 AS ok
  FROM a FULL JOIN b USING (task_id, trial)""")  # fmt: skip
def identity_mismatch(spark, sf_dir):
    t = trials(spark, sf_dir)
    return gates.identity_mismatch(t.where(F.col("model_config_id") == BASE), t.where(F.col("model_config_id") == CAND), ["task_id", "trial"])


@query("g05_unknown_status", ", k AS (SELECT verdict, count(*) AS n FROM trials WHERE verdict NOT IN ('PASS', 'FAIL') GROUP BY 1) SELECT * FROM k")
def unknown_status(spark, sf_dir):
    return gates.unknown_values(trials(spark, sf_dir), "verdict", ["PASS", "FAIL"])


@query("g09_drift_within_arm", "SELECT o_orderpriority, count(DISTINCT o_orderstatus) AS values, min(o_orderstatus) AS least, max(o_orderstatus) AS most FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def drift_within_arm(spark, sf_dir):
    return gates.one_value(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus")


# queries over attempts and tasks
from lumenframe import catalog_gates, catalog_runs, catalog_values  # noqa: E402

for _more in (catalog_runs, catalog_values, catalog_gates):
    QUERIES |= _more.QUERIES
    SQL |= _more.SQL
