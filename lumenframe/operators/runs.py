"""Scans, filters, joins and orders over attempts: which rows an analysis reads, and what they are joined with.

Specifications are dimension tables; Spark broadcasts them where they are small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators import ordering

RESULTS = "array<struct<grader_type:string,passed:boolean,detail:string,violations:array<string>>>"


def measured(runs: DataFrame, *experiments: str) -> DataFrame:
    """Rows that are no warm-up, of the experiments named (all if none is)."""
    out = runs.where(~F.col("is_warmup"))
    return out.where(F.col("experiment_id").isin(list(experiments))) if experiments else out


def completed_identities(runs: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run need not do again: distinct identities of complete rows."""
    return runs.where("status = 'COMPLETE'").select(*keys).distinct()


def decoded_details(raw: Column) -> Column:
    """Grader results from their JSON text; what is no such JSON is no result."""
    none = F.array().cast(RESULTS)
    return F.coalesce(F.filter(F.from_json(raw, RESULTS, {"mode": "PERMISSIVE"}), lambda r: r["grader_type"].isNotNull()), none)


def with_status(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Attempts with their task's status; a task that the specification lacks is an error."""
    status = tasks.select("task_id", "grading_status")
    out = runs.drop("grading_status").join(status, "task_id", "left")
    missing = F.raise_error(F.concat(F.lit("no status for task "), F.col("task_id").cast("string")))
    return out.withColumn("grading_status", F.coalesce("grading_status", missing.cast("string")))


def comparison_trials(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Measured attempts at deterministic tasks, with the tasks' metadata; attempts at other tasks are dropped."""
    return measured(runs).join(tasks.where("grading_status = 'READY_DETERMINISTIC'"), "task_id")


def evidence(runs: DataFrame, by: str = "experiment_id") -> DataFrame:
    """The first digest (by run) that is known, and the peaks that are: how many and the largest."""
    known = F.col("model_digest").isNotNull()
    return measured(runs).groupBy(by).agg(
        F.min_by(F.when(known, F.col("model_digest")), F.when(known, F.col("run_id"))).alias("model_digest"),
        F.count("peak_vram").alias("peaks"), F.max("peak_vram").alias("peak_vram"),
    )


def failed_rows(runs: DataFrame, tasks: DataFrame, excerpt: int = 300) -> DataFrame:
    """Measured failures of executable tasks with an excerpt of the output and the names of failed graders, in their order."""
    ready = tasks.where(F.col("grading_status").startswith("READY_")).select("task_id", "grading_status")
    names = F.transform(F.filter("details", lambda d: ~d["passed"]), lambda d: d["grader_type"])
    return measured(runs).where("verdict = 'FAIL'").join(ready, "task_id").select(
        "model_config_id", "task_id", "trial", "grading_status", F.substring("raw_output", 1, excerpt).alias("excerpt"), F.array_join(names, ",").alias("failed_graders")
    )


def population(runs: DataFrame, column: str, values: list) -> DataFrame:
    return runs.where(F.col(column).isin(values))


def without_prefixes(rows: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """Rows whose id starts with none of the prefixes."""
    return rows.where(~reduce(Column.__or__, [F.col(column).startswith(p) for p in prefixes], F.lit(False)))


def same_lineage(rows: DataFrame, column: str, lineage: str) -> DataFrame:
    """Rows whose identity belongs to one specification: ``<lineage>__<model>``."""
    return rows.where(F.split(column, "__", 2)[0] == lineage)


def json_number(doc: Column, key: str) -> Column:
    """A key's value if it is a JSON number; truth values and strings are none."""
    value = F.try_variant_get(F.try_parse_json(doc), f"$.{key}", "variant")
    kind = F.schema_of_variant(value)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(numeric, F.try_variant_get(F.try_parse_json(doc), f"$.{key}", "double"))


def alias(names: dict[str, str], c: Column) -> Column:
    """Display names; what has none keeps its own."""
    out = c
    for k, v in names.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def execution_id(spec: Column, model: Column) -> Column:
    return F.concat_ws("__", spec, model)


def execution_parts(c: Column) -> Column:
    """(spec, model) of an id; null unless there are two parts that are not empty."""
    spec, model = F.substring_index(c, "__", 1), F.regexp_replace(c, "^.*?__", "")
    return F.when(F.contains(c, F.lit("__")) & (spec != "") & (model != ""), F.struct(spec.alias("spec"), model.alias("model")))


def failed_with_graders(runs: DataFrame, graders: DataFrame) -> DataFrame:
    """Each failed result of an attempt with the parameters of its task's grader of that type (task_id, grader_type, params)."""
    failed = runs.select("run_id", "task_id", F.explode(F.filter("details", lambda d: ~d["passed"])).alias("d")).select("run_id", "task_id", "d.grader_type")
    return failed.join(graders, ["task_id", "grader_type"])


def next_warmup(runs: DataFrame, by: str = "experiment_id") -> DataFrame:
    """The number of the next warm-up of each experiment."""
    return runs.groupBy(by).agg((F.count_if("is_warmup") + 1).alias("next_trial"))


def base_items(items: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The first item of each group: a minimum with map-side combine, no sort of a group."""
    rest = [c for c in items.columns if c != group]
    return items.groupBy(group).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(group, "_r.*")


def placed(rows: DataFrame, group: list[str], *order: Column | str) -> DataFrame:
    """Rows with their place (int) in a fixed order of each group, from 1; a group is dealt over many tasks."""
    return ordering.placed(rows, group, list(order)).withColumn("place", F.col("place").cast("int"))


def first_of(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows: each partition keeps n of its own, then those are merged."""
    return rows.orderBy(*order).limit(n)


def argmax(rows: DataFrame, by: str, value: str, key: str) -> DataFrame:
    """Of each group, the key of the largest value; of ties the smallest key."""
    top = F.max(F.struct(F.col(value), -F.col(key)))
    return rows.groupBy(by).agg(top.alias("_t")).select(by, (-F.col(f"_t.col2")).alias(key), F.col(f"_t.{value}").alias(value))


def overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """How many identities both sides have; cohorts that must be disjoint have none."""
    both = left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_semi")
    return both.agg(F.count("*").alias("shared")).withColumn("disjoint", F.col("shared") == 0)


def controlled_variants(items: DataFrame, text: str, item_id: str, task: str) -> DataFrame:
    """Each base item beside eight changed copies of itself: (task, item, kind, candidate, candidate_id, pair_id)."""
    t = F.col(text)
    head = F.regexp_replace(t, r"\A[^\n]*\n", "")
    #: The kinds and the texts that they add.
    kinds = {
        "identical": t, "whitespace": F.concat(t, F.lit("\n\n")), "style": F.concat(F.lit("Answer:\n"), t),
        "authority": F.concat(F.lit("Verified source answer:\n"), t), "omission": F.when(head == "", t).otherwise(head), "incomplete": F.lit("I am not sure."),
        "plain_copy": F.regexp_replace(t, r"\A\s+|\s+\z", ""), "short_copy": F.substring(t, F.lit(1), F.greatest(F.lit(1), F.floor(F.length(t) / 2).cast("int"))),
    }
    rows = items.select(task, item_id, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("candidate")) for k, v in kinds.items()])).alias("x"))
    ident = lambda *parts: F.sha2(F.concat_ws("|", F.lit("controlled"), *[p.cast("string") for p in parts]), 256)
    rows = rows.select(task, item_id, "x.*").withColumn("candidate_id", ident(F.col(task), F.col("kind"), F.col(item_id)))
    return rows.withColumn("pair_id", ident(F.col(task), F.col(item_id), F.col("candidate_id")))


def as_of_overlay(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Historical rows with what an overlay says of the same key; others are dropped."""
    return old.join(new, keys)
