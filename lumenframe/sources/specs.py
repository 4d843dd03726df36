"""Grading specifications and model overlays as tables: many files are read at once, entries are rows, overlays are joins.

A specification file is a JSON (or, where a YAML package is installed, YAML)
document with ``tasks``; an overlay names its ``base_spec`` and that file's
sha256, and gives whole entries in ``overrides``. ``faults`` says which files
cannot be used and why; ``resolved`` has the entries of the others.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields that an overlay of a model's configuration must have.
MODEL_FIELDS = (
    "config_id", "ollama_identifier", "quantization", "mode", "template_id", "template_source", "template_text", "template_sha256", "ollama_model_digest",
    "num_ctx", "num_predict_default", "num_gpu", "temperature_default", "stop_tokens", "think", "thinking_support", "template_application",
)


def _as_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """YAML documents as JSON; what is neither stays as it is and is no document."""

    def of(raw: str) -> str:
        try:
            json.loads(raw)
            return raw
        except ValueError:
            try:
                import yaml
            except ImportError:
                return raw
            try:
                return json.dumps(yaml.safe_load(raw), default=lambda x: x.isoformat())
            except (yaml.YAMLError, TypeError, AttributeError):
                return raw

    for b in batches:
        yield b.assign(document=[of(x) for x in b["document"]])


def documents(spark: SparkSession, path: str, yaml: bool = False) -> DataFrame:
    """(file, sha256, doc): a row per file under a path, its bytes' hash, and the document as a variant, null if it is none."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    raw = read.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), F.col("content").cast("string").alias("document"))
    if yaml:
        raw = raw.mapInPandas(_as_json, raw.schema)
    return raw.select("file", "sha256", F.try_parse_json("document").alias("doc"))


def bundled(spark: SparkSession, path: str) -> DataFrame:
    """Like ``documents``, of files that hold a JSON document a line: their number follows the bytes, not the documents. The hash is that of a file with this line alone."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("document"))
    return read.select("file", F.sha2(F.concat("document", F.lit("\n")), 256).alias("sha256"), F.try_parse_json("document").alias("doc"))


def _text(path: str) -> Column:
    return F.try_variant_get("doc", f"$.{path}", "string")


def specifications(docs: DataFrame) -> DataFrame:
    """(spec, file, sha256, base, declared, version, entries: map<string, variant>) of ``documents``. A file's spec is its ``spec_id``, else its name up to ``-grading``."""
    name = F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"(-grading)?\.[A-Za-z]+$", "")
    has = lambda key: F.to_json(F.try_variant_get("doc", f"$.{key}", "variant")).isNotNull()
    entries = lambda key: F.try_variant_get("doc", f"$.{key}", "variant").try_cast("map<string,variant>")
    return docs.select(
        F.coalesce(_text("spec_id"), name).alias("spec"), "file", "sha256", F.to_json("doc").isNotNull().alias("read"), has("overrides").alias("overlay"), _text("base_spec").alias("base"),
        _text("provenance.base_spec_sha256").alias("declared"), _text("spec_version").alias("version"), F.when(has("overrides"), entries("overrides")).otherwise(entries("tasks")).alias("entries"),
    )


def _rows(specs: DataFrame) -> DataFrame:
    return specs.select("spec", F.explode("entries").alias("task_id", "v")).select("spec", "task_id", F.to_json("v").alias("entry"), F.to_json("v").startswith("{").alias("mapping"))


def _with_base(specs: DataFrame) -> DataFrame:
    """Overlays beside the file of their base."""
    base = specs.where(~F.col("overlay")).select(F.col("spec").alias("b"), F.col("sha256").alias("base_sha256"))
    return specs.where("overlay").join(base, F.col("base") == F.col("b"), "left")


def faults(specs: DataFrame) -> DataFrame:
    """(spec, fault, detail): documents that are none, specifications without tasks, overlays without or with another base, without entries, of tasks that the base lacks, entries that are no mappings."""
    over = _with_base(specs)
    whole = F.array(
        F.when(~F.col("read"), "no document"), F.when(F.col("read") & ~F.col("overlay") & F.col("entries").isNull(), "no tasks"),
        F.when(F.col("overlay") & (F.coalesce(F.col("base"), F.lit("")) == ""), "no base named"), F.when(F.col("overlay") & (F.coalesce(F.size("entries"), F.lit(0)) <= 0), "no overrides"),
    )
    one = specs.select("spec", F.explode(F.filter(whole, lambda x: x.isNotNull())).alias("fault"), F.lit(None).cast("string").alias("detail"))
    named = over.where("base <> ''").select("spec", F.when(F.col("b").isNull(), "base absent").when(~F.col("declared").eqNullSafe(F.col("base_sha256")), "another base").alias("fault"), F.col("base").alias("detail")).where("fault is not null")
    changed = _rows(over.where("b is not null")).join(over.select("spec", "base"), "spec")
    there = _rows(specs.where(~F.col("overlay"))).select(F.col("spec").alias("base"), "task_id")
    lost = changed.join(there, ["base", "task_id"], "left_anti").select("spec", F.lit("task absent from base").alias("fault"), F.col("task_id").alias("detail"))
    odd = changed.where(~F.col("mapping")).select("spec", F.lit("entry is no mapping").alias("fault"), F.col("task_id").alias("detail"))
    return one.unionByName(named).unionByName(lost).unionByName(odd)


def resolved(specs: DataFrame) -> DataFrame:
    """(spec, task_id, entry, changed) of specifications without faults: a full one's own entries, an overlay's base with whole entries replaced."""
    good = specs.join(faults(specs).select("spec").distinct(), "spec", "left_anti")
    full, over = good.where(~F.col("overlay")), good.where("overlay")
    own = _rows(full).select("spec", "task_id", "entry", F.lit(False).alias("changed"))
    base = _rows(specs.where(~F.col("overlay"))).select(F.col("spec").alias("base"), "task_id", F.col("entry").alias("old"))
    taken = over.select("spec", "base").join(base, "base")
    new = taken.join(_rows(over).select("spec", "task_id", F.col("entry").alias("new")), ["spec", "task_id"], "left")
    return own.unionByName(new.select("spec", "task_id", F.coalesce("new", "old").alias("entry"), F.col("new").isNotNull().alias("changed")))


def model_overlays(docs: DataFrame) -> DataFrame:
    """(file, config_id, fault, doc) of a folder of model overlays: what keeps a file from being used, null if nothing does."""
    absent = F.filter(F.array(*[F.when(F.to_json(F.try_variant_get("doc", f"$.{f}", "variant")).isNull(), F.lit(f)) for f in MODEL_FIELDS]), lambda x: x.isNotNull())
    fault = (
        F.when(~F.coalesce(F.to_json("doc").startswith("{"), F.lit(False)), "no object").when(F.size(absent) > 0, F.concat(F.lit("lacks "), F.array_join(absent, ", ")))
        .when(~F.coalesce(F.sha2(_text("template_text"), 256) == _text("template_sha256"), F.lit(False)), "another template")
        .when((_text("derivation_source") == "human_pinned") & ~F.coalesce(_text("review_status") == "APPROVED", F.lit(False)), "not approved")
    )
    own = docs.select("file", _text("config_id").alias("config_id"), fault.alias("fault"), "doc")
    twice = own.where("fault is null").groupBy("config_id").agg(F.count("*").alias("_n"))
    both = own.join(twice, "config_id", "left")
    return both.select("file", "config_id", F.coalesce("fault", F.when(F.col("_n") > 1, "config_id repeated")).alias("fault"), "doc")
