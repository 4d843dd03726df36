"""Helpers shared by the training-data operators.

Row identity: tables may hold repeated or null ids, so operators that take a
row apart and put it together again never key it by the caller's id column.
Within one scan the key is ``row_key``, the position of the row in that scan;
where two scans meet, it is that of ``numbered``, which no split changes.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def text_of(name: str) -> Column:
    """The text column by name; a null text is empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key() -> Column:
    """A key for each row within one scan. Two scans may be split unlike: rows of two scans meet by ``numbered``."""
    return F.monotonically_increasing_id()


#: The columns of a row's key.
KEY = ["_f", "_i"]


def numbered(docs: DataFrame) -> DataFrame:
    """(_f, _i, _all): a key of each row that holds in every scan, and the row itself.

    For a plain scan of Parquet files the key is a hash of the file's path and
    the place in the file, so it does not follow how the files are split. Any
    other plan is stored first, with its key beside it.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all")
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().head()
    if plan.nodeName() == "LogicalRelation":
        try:
            return docs.select(F.xxhash64("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"), whole)
        except AnalysisException:  # a format without row numbers
            pass
    return stage_table(docs.select(F.lit(0).cast("bigint").alias("_f"), row_key().alias("_i"), whole), "numbered")


#: Rows of short columns that a join may broadcast: some tens of MB.
MOST_LIGHT = 500_000


def light(rows: DataFrame, most: int | None = None) -> DataFrame:
    """A stored table of short rows for a join with texts: broadcast if it has at most ``most`` rows, so that no text moves; else as it is."""
    return F.broadcast(rows) if rows.count() <= (MOST_LIGHT if most is None else most) else rows


def join_hubs(rows: DataFrame, per_key: DataFrame, key: str, n: str, by: str, least: int = 256, salts: int = 64) -> DataFrame:
    """``rows`` inner-joined with ``per_key`` (unique ``key``, ``n`` rows of it), keys of many rows dealt over ``salts`` tasks by a hash of ``by``.

    Both are read more than once: pass stored tables.
    """
    hubs = stage_table(per_key.where(F.col(n) > least), "hubs")
    if hubs.isEmpty():
        return rows.join(per_key, key)
    salted = hubs.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    many = dealt.join(salted, [key, "_salt"]).drop("_salt")
    few = dealt.join(salted.select(key, "_salt"), [key, "_salt"], "left_anti").drop("_salt").join(per_key.where(F.col(n) <= least), key)
    return many.unionByName(few)


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that ``body`` may use it often and it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. Without one, a local session makes one; a cluster refuses."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        found = Path(tempfile.mkdtemp(prefix="lumenframe-")).as_uri()  # one machine: it is shared by definition
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def small_batches(spark: SparkSession, rows: int = 1000, mb: int = 16) -> None:
    """Bounds of an Arrow batch, by rows and by bytes: texts are long, and a worker holds a batch several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here and survives lost executors.

    The table goes with ``drop_table``, or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenframe/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumen_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete what ``stage_table`` wrote, when nothing will read it again."""
    path = getattr(df, "_lumen_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def prefix_sums(lengths: Column, block: int = 256) -> Column:
    """For an array of ints: at i, the sum of what stands before i. In blocks, so that long arrays stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + x)

    def of(a: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda b: total(F.slice(a, b * block + 1, F.lit(block)))
        )
        return let(
            blocks,
            lambda bs: let(
                F.transform(bs, lambda _, b: total(F.slice(bs, F.lit(1), b))),
                lambda before: F.transform(
                    a,
                    lambda _, i: F.get(before, F.floor(i / block).cast("int"))
                    + total(F.slice(a, (F.floor(i / block) * block + 1).cast("int"), (i % block).cast("int"))),
                ),
            ),
        )

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(let(lengths, of))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches, in order: array<struct<s, e, v, before, after>>.

    s, e: start and exclusive end in code points; v: the match; before, after:
    the texts up to the neighbouring matches. ``split`` and ``regexp_extract_all``
    walk the same matches, so their pieces alternate.
    """
    p = F.lit(pattern)
    pieces = F.struct(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit")
    )

    def of(x: Column) -> Column:
        steps = F.transform(x["hit"], lambda h, i: F.length(h) + F.length(F.get(x["gap"], i)))
        return let(
            prefix_sums(steps),
            lambda at: F.transform(
                x["hit"],
                lambda h, i: let(
                    F.get(at, i) + F.length(F.get(x["gap"], i)),
                    lambda s: F.struct(
                        s.alias("s"), (s + F.length(h)).alias("e"), h.alias("v"),
                        F.get(x["gap"], i).alias("before"), F.get(x["gap"], i + 1).alias("after"),
                    ),
                ),
            ),
        )

    none = F.array().cast("array<struct<s:int,e:int,v:string,before:string,after:string>>")
    return F.when(text.rlike(pattern), let(pieces, of)).otherwise(none)


#: start, order of the kind, kind, end.
SPAN = "array<struct<s:int,o:int,k:string,e:int>>"


def spans(found: Column, order: int, kind: str, good=None) -> Column:
    """Matches that pass ``good`` as spans of a kind."""
    if good is not None:
        found = F.filter(found, lambda m: good(m["v"]))
    return F.transform(
        found, lambda m: F.struct(m["s"].alias("s"), F.lit(order).alias("o"), F.lit(kind).alias("k"), m["e"].alias("e"))
    ).cast(SPAN)


def span_text(sorted_spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(sorted_spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_kind(all_spans: Column, kind: str) -> Column:
    return F.size(F.filter(all_spans, lambda x: x["k"] == kind)).cast("bigint")
