"""Named gates over runs, specifications, documents and reviews. Each gives rows or one row of counts; ``ok`` says whether analysis may go on.

``judging.require`` turns a gate into an error. Expected populations and values are tables or parameters; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.runs import measured

STATUSES = ("READY_DETERMINISTIC", "READY_JUDGE", "PENDING_SPECIFICATION")
#: What a reviewer may say of an answer, and the failure modes.
ASSESSMENTS = ("CORRECT", "LIKELY_CORRECT", "INCORRECT", "AMBIGUOUS", "NOT_REVIEWED")
MODES = ("OUTPUT_CONTRACT", "LEXICAL_CONSTRAINT", "CONTENT_ERROR", "STRUCTURE_ERROR", "MIXED", "UNKNOWN")


def _all_zero(rows: DataFrame, names: list[str]) -> DataFrame:
    ok = F.lit(True)
    for n in names:
        ok = ok & (F.col(n) == 0)
    return rows.withColumn("ok", ok)


def matrix(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Measured rows of an execution: all, deterministic, for a judge, of unknown tasks, repeated identities, errors."""
    own = measured(runs).join(tasks.select("task_id", "grading_status"), "task_id", "left")
    # repeats are counted over identities: one more aggregation, no set of a whole table
    by = own.groupBy("model_config_id", "task_id", "trial", "grading_status").agg(
        F.count("*").alias("n"), F.count_if((F.col("status") == "ERROR") | (F.col("verdict") == "ERROR")).alias("e")
    )
    of = lambda status: F.sum(F.when(F.col("grading_status") == status, F.col("n")).otherwise(0))
    return by.agg(
        F.sum("n").alias("measured"), of("READY_DETERMINISTIC").alias("deterministic"), of("READY_JUDGE").alias("judge"),
        F.sum(F.when(F.col("grading_status").isNull(), F.col("n")).otherwise(0)).alias("unknown"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum("e").alias("errors"),
    )


def persistence(runs: DataFrame, tasks: DataFrame, det_rows: int, judge_rows: int, files: dict[str, bool]) -> DataFrame:
    """Whether an execution is all there before its artifacts go: expected row counts, no unknown task, no repeat, no error, and the files."""
    m = matrix(runs, tasks)
    out = m.select(
        (F.col("deterministic") == det_rows).alias("det_rows"), (F.col("judge") == judge_rows).alias("judge_rows"), (F.col("unknown") == 0).alias("unknown_rows_zero"),
        (F.col("duplicates") == 0).alias("no_duplicate_identities"), (F.col("errors") == 0).alias("no_error_rows"),
        *[F.lit(ok).alias(f"file_{n}") for n, ok in sorted(files.items())],
    )
    ok = F.lit(True)
    for c in out.columns:
        ok = ok & F.col(c)
    return out.withColumn("ok", ok)


def files_there(spark: SparkSession, paths: dict[str, str]) -> dict[str, bool]:
    """Which files are there and not empty, in any store that Spark reads."""
    out = {}
    for name, path in paths.items():
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out[name] = bool(fs.exists(where)) and (fs.getContentSummary(where).getLength() > 0)
    return out


def resume(runs: DataFrame, expected: DataFrame, config_hash: str) -> DataFrame:
    """Rows that keep an execution from going on: identities not expected, another configuration, rows not complete."""
    want = expected.select("task_id", "trial").distinct().withColumn("_e", F.lit(True))
    own = measured(runs).join(want, ["task_id", "trial"], "left")
    out = own.agg(
        F.count_if(F.col("_e").isNull()).alias("unexpected"), F.count_if(~F.col("run_config_hash").eqNullSafe(F.lit(config_hash))).alias("other_config"),
        F.count_if(F.col("status") != "COMPLETE").alias("incomplete"), F.count_if(F.col("status") == "COMPLETE").alias("completed"),
    )
    return _all_zero(out, ["unexpected", "other_config", "incomplete"])


def arm(runs: DataFrame, by: str, temperature: float, warmups: int) -> DataFrame:
    """Per arm: warm-ups found, measured rows, repeated identities, rows of another temperature or not complete, and distinct configurations."""
    each = runs.groupBy(by, "task_id", "trial", "is_warmup").agg(
        F.count("*").alias("n"), F.count_if((F.col("temperature") != temperature) | (F.col("status") != "COMPLETE")).alias("off")
    )
    own = each.groupBy(by).agg(
        F.sum(F.when(F.col("is_warmup"), F.col("n")).otherwise(0)).alias("warmups"), F.sum(F.when(~F.col("is_warmup"), F.col("n")).otherwise(0)).alias("measured"),
        F.sum(F.col("n") - 1).alias("repeated"), F.sum("off").alias("off_identity"),
    )
    hashes = runs.groupBy(by).agg(F.count_distinct("run_config_hash").alias("configs"))
    ok = (F.col("warmups") == warmups) & (F.col("repeated") == 0) & (F.col("off_identity") == 0) & (F.col("configs") == 1)
    return own.join(hashes, by).withColumn("ok", ok)


def frozen_files(spark: SparkSession, folder: str, expected: dict[str, str]) -> DataFrame:
    """(name, state): same, changed, missing or extra, by sha256 of the files' bytes."""
    got = spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("sha"))
    want = spark.createDataFrame(sorted(expected.items()) or [("", "")], "name string, want string").where("name <> ''")
    state = F.when(F.col("want").isNull(), "extra").when(F.col("sha").isNull(), "missing").when(F.col("sha") == F.col("want"), "same").otherwise("changed")
    return want.join(got, "name", "full_outer").select("name", state.alias("state"))


def frozen_population(primary: DataFrame, control: DataFrame, keys: list[str], n_primary: int, n_control: int) -> DataFrame:
    """Counts of both cohorts, repeats, and identities in both; ok if they are as frozen and apart."""
    a = primary.groupBy(*keys).agg(F.count("*").alias("p"))
    b = control.groupBy(*keys).agg(F.count("*").alias("c"))
    out = a.join(b, keys, "full_outer").agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("primary"), F.coalesce(F.sum("c"), F.lit(0)).alias("control"),
        F.count_if(F.col("p").isNotNull() & F.col("c").isNotNull()).alias("shared"), F.count_if((F.col("p") > 1) | (F.col("c") > 1)).alias("repeated"),
    )
    return out.withColumn("ok", (F.col("primary") == n_primary) & (F.col("control") == n_control) & (F.col("shared") == 0) & (F.col("repeated") == 0))


def reconcile(parts: DataFrame, totals: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose parts don't add up to the total of another table."""
    s = parts.groupBy(key).agg(F.sum(value).alias("sum"))
    t = totals.select(key, F.col(value).alias("total"))
    return s.join(t, key, "full_outer").where(~F.col("sum").eqNullSafe(F.col("total")))


def contract(settings: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(key, value) rows against a contract: keys whose value is another, or that one side lacks."""
    want = settings.sparkSession.createDataFrame(sorted(expected.items()), "key string, want string")
    both = want.join(settings.select("key", "value"), "key", "full_outer")
    return both.where(~F.col("want").eqNullSafe(F.col("value"))).select("key", "want", "value")


def spec_faults(tasks: DataFrame, graders: DataFrame, dataset: DataFrame) -> DataFrame:
    """(task_id, fault): not in the dataset, not in the specification, a status that is none, ready without graders, pending with graders."""
    n = graders.groupBy("task_id").agg(F.count("*").alias("graders"))
    own = tasks.select("task_id", "grading_status").join(n, "task_id", "left").withColumn("_s", F.lit(True))
    both = own.join(dataset.select("task_id").distinct().withColumn("_d", F.lit(True)), "task_id", "full_outer")
    has, ready = F.coalesce(F.col("graders") > 0, F.lit(False)), F.col("grading_status").startswith("READY_")
    faults = F.array(
        F.when(F.col("_s").isNull(), "not in the specification"), F.when(F.col("_d").isNull(), "not in the dataset"),
        F.when(F.col("_s") & ~F.coalesce(F.col("grading_status").isin(list(STATUSES)), F.lit(False)), "unknown status"),
        F.when(ready & ~has, "ready without graders"), F.when((F.col("grading_status") == "PENDING_SPECIFICATION") & has, "pending with graders"),
    )
    return both.select("task_id", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("fault"))


def document_faults(docs: DataFrame, words: Column, sha: Column, document: Column, prompt: Column, n_words: Column, want_sha: Column) -> DataFrame:
    """Faults of long-context tasks: another word count, another hash, a document that its prompt does not hold."""
    checks = F.array(
        F.when(~(words == n_words), "word count"), F.when(~sha.eqNullSafe(want_sha), "document hash"), F.when(~F.contains(prompt, document), "not embedded")
    )
    return docs.withColumn("fault", F.explode(F.filter(checks, lambda x: x.isNotNull())))


def code_task_faults(tasks: DataFrame) -> DataFrame:
    """(task_id, fault) of coding tasks (task_id, language, entrypoint, n_tests, source): language, entry point, tests, and the entry point in the source."""
    ident = F.col("entrypoint").rlike(r"\A[A-Za-z_$][A-Za-z0-9_$]*\z")
    faults = F.array(
        F.when(~F.col("language").isin("python", "javascript"), "language"), F.when(~F.coalesce(ident, F.lit(False)), "entrypoint"),
        F.when(F.coalesce("n_tests", F.lit(0)) < 1, "tests"), F.when(~F.coalesce(F.contains("source", F.col("entrypoint")), F.lit(False)), "not in source"),
    )
    return tasks.select("task_id", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("fault"))


def source_fidelity(source: DataFrame, tasks: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column) wherever a converted task differs from its source row, or one side lacks the row (column null)."""
    s = source.select(key, *[F.col(c).alias(f"s_{c}") for c in columns], F.lit(True).alias("_s"))
    both = s.join(tasks.select(key, *columns, F.lit(True).alias("_t")), key, "full_outer")
    alone = F.col("_s").isNull() | F.col("_t").isNull()
    changed = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"s_{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return both.select(key, F.explode_outer(F.when(alone, F.array(F.lit(None).cast("string"))).otherwise(changed)).alias("column"), alone.alias("_a")).where("_a or column is not null").select(key, "column")


def review_faults(entries: DataFrame) -> DataFrame:
    """(task_id, fault) of review entries (task_id, auto_mode, assessment, author, mode_override, override_reason): what keeps a review from approval."""
    faults = F.array(
        F.when(F.col("auto_mode").isNull(), "no automatic analysis"), F.when(~F.coalesce(F.col("assessment").isin(list(ASSESSMENTS)), F.lit(False)), "assessment"),
        F.when(F.coalesce("author", F.lit("")) == "", "author"), F.when(~F.col("mode_override").isin(list(MODES)), "override"),
        F.when(F.col("mode_override").isNotNull() & (F.coalesce("override_reason", F.lit("")) == ""), "override without a reason"),
    )
    return entries.select("task_id", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("fault"))


def review_allowed(entries: DataFrame, review_status: str) -> DataFrame:
    """One row: entries, faults, and whether a report may be made of them."""
    n = entries.agg(F.count("*").alias("entries"))
    f = review_faults(entries).agg(F.count("*").alias("faults"))
    return n.join(f).withColumn("ok", (F.lit(review_status) == "APPROVED") & (F.col("faults") == 0) & (F.col("entries") > 0))


def registry(entries: DataFrame, expected: int, id_col: str, required: list[str]) -> DataFrame:
    """One row: entries, repeated ids, entries that lack a required value."""
    lacking = F.lit(False)
    for c in required:
        lacking = lacking | (F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    by = entries.groupBy(id_col).agg(F.count("*").alias("n"), F.count_if(lacking).alias("l"))
    out = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum("l"), F.lit(0)).alias("lacking"))
    return out.withColumn("ok", (F.col("entries") == expected) & (F.col("repeated") == 0) & (F.col("lacking") == 0))


def cohort(runs: DataFrame, tasks: DataFrame, trials: int) -> DataFrame:
    """Per model: tasks with exactly that many measured trials, with fewer or more, tasks without any, and attempts at unknown tasks."""
    per = measured(runs).groupBy("model_config_id", "task_id").agg(F.count("*").alias("n"))
    known = per.join(tasks.select("task_id", F.lit(True).alias("_k")), "task_id", "left")
    n_tasks = tasks.agg(F.count("*").alias("n_tasks"))
    by = known.groupBy("model_config_id").agg(
        F.count_if(F.col("_k") & (F.col("n") == trials)).alias("whole"), F.count_if(F.col("_k") & (F.col("n") != trials)).alias("partial"),
        F.count_if(F.col("_k").isNull()).alias("unknown"),
    )
    out = by.join(n_tasks).withColumn("missing", F.col("n_tasks") - F.col("whole") - F.col("partial")).drop("n_tasks")
    return out.withColumn("ok", (F.col("partial") == 0) & (F.col("unknown") == 0) & (F.col("missing") == 0))


def dirty_paths(status: DataFrame, allowed: list[str]) -> DataFrame:
    """Lines of a short work-tree status (line) that name a path outside the allowed prefixes: results of such a tree are refused."""
    path = F.regexp_replace(F.substring("line", 4, 1 << 20), r"\A.* -> ", "")
    fine = F.lit(False)
    for p in allowed:
        fine = fine | path.startswith(p)
    return status.where("line <> ''").select(path.alias("path")).where(~fine)
