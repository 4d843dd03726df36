"""Secret scans: base patterns, and multipart credentials linked by an interval join within a scope.

Parts: identifiers (access keys; client, account or user ids and names), secrets
(assignments, long hex, 40-character keys, short or odd passwords) and endpoints
(URLs, database addresses). Base parts stand alone. A weak part (id, key40, pass,
endpoint) is reported only if its complement stands in the same scope: a block of
lines without a blank line between, and there within ``reach`` characters. An id
needs a secret, a key40 or pass needs an identifier, an endpoint needs both.

The interval join is a sweep: within a scope, ordered by start, the nearest
complement before and after decides whether any interval overlaps; linear in
the parts, no pair is built. Only parts travel, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import SPAN, count_kind, documents, let, lower_ascii, matches, row_key, span_text, spans, text_of

#: The base patterns, in the order of the kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: The method's own weak parts.
WEAK_ID = r"""(?i)(?:(?:client|account|user|tenant|app)_?(?:id|name)|username|login|user)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""
PASS = r"""(?i)(?:password|passwd|passphrase|pwd|secret|private_?key|auth_?key)["']?\x20*[:=]\x20*["']?[^\x00-\x20"'<>,;]{4,}"""
KEY40 = r"(?<![A-Za-z0-9/+=])(?=[A-Za-z0-9/+]*[0-9])(?=[A-Za-z0-9/+]*[A-Z])(?=[A-Za-z0-9/+]*[a-z])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"
ENDPOINT = r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20\"'<>]+"
#: What parts scopes: a blank line.
BLANK = r"\n[\x20\x09\x0D]*(?=\n)"
REACH = 500


def base_spans(t: Column, low: Column) -> Column:
    """``low``: the lower-cased text, which tells where a pattern is worth a try."""
    said = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    none = F.array().cast(SPAN)
    return F.concat(
        F.when(
            said, spans(matches(t, ASSIGN), 0, "assign", lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 8)
        ).otherwise(none),
        F.when(t.contains("AKIA"), spans(matches(t, ACCESS), 1, "access", lambda v: F.length(v) >= 16)).otherwise(none),
        # maximal runs are the matches of HEX: shorter ones are dropped either way
        F.when(t.rlike(r"[0-9a-f]{32}"), spans(matches(t, r"[0-9a-f]{32,}"), 2, "hex")).otherwise(none),
    )


def weak_spans(t: Column, low: Column) -> Column:
    none = F.array().cast(SPAN)
    set_to = t.rlike("[:=]")
    named = low.contains("id") | low.contains("name") | low.contains("login") | low.contains("user")
    hidden = low.contains("pass") | low.contains("pwd") | low.contains("secret") | low.contains("key")
    return F.concat(
        F.when(set_to & named, spans(matches(t, WEAK_ID), 3, "id")).otherwise(none),
        F.when(t.rlike(r"[A-Za-z0-9/+]{40}"), spans(matches(t, KEY40), 4, "key40")).otherwise(none),
        F.when(t.contains("://"), spans(matches(t, ENDPOINT), 5, "endpoint")).otherwise(none),
        F.when(set_to & hidden, spans(matches(t, PASS), 6, "pass")).otherwise(none),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """A row per input row: id, base and all spans (struct<s, o, k, e> by start, then kind).

    Null text is empty; ids may repeat or be null. Rows without parts have
    empty arrays; an empty table gives an empty one. A key40 or pass that
    overlaps a base span is no part of its own.
    """
    t = F.col("_t")
    src = docs.select(row_key().alias("_row"), F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    parts = let(lower_ascii(t), lambda low: F.concat(base_spans(t, low), weak_spans(t, low)))

    def scoped(found: Column) -> Column:
        """Parts, and blank lines among them as parts of no kind that count: only texts with parts have any."""
        return F.when(F.size(found) > 0, F.concat(found, spans(matches(t, BLANK), -1, "blank")))

    flat = src.select("_row", "_id", F.explode_outer(let(parts, scoped)).alias("x")).select("_row", "_id", "x.*")
    # a part's scope: the blank lines before it, as a running count
    flat = flat.withColumn("c", F.coalesce(F.sum(F.when(F.col("k") == "blank", 1)).over(Window.partitionBy("_row").orderBy("s", "o")), F.lit(0)))
    flat = flat.where("k is null or k <> 'blank'")
    # both frames grow with the rows: behind a part from the start, ahead of it from the end, each one pass
    back = Window.partitionBy("_row", "c").orderBy("s", "o").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("_row", "c").orderBy(F.desc("s"), F.desc("o")).rowsBetween(Window.unboundedPreceding, -1)
    is_id, is_secret = F.col("k").isin("access", "id"), F.col("k").isin("assign", "hex", "key40", "pass")

    def within(kind: Column, strong: Column | None = None) -> Column:
        what = kind if strong is None else kind & strong
        before = F.max(F.when(what, F.col("e"))).over(back)
        after = F.min(F.when(what, F.col("s"))).over(ahead)
        return F.coalesce(F.col("s") - before <= reach, F.lit(False)) | F.coalesce(after - F.col("e") <= reach, F.lit(False))

    covered = F.coalesce(F.max(F.when(F.col("o") < 3, F.col("e"))).over(back) > F.col("s"), F.lit(False)) | F.coalesce(
        F.min(F.when(F.col("o") < 3, F.col("s"))).over(ahead) < F.col("e"), F.lit(False)
    )
    keep = (
        F.when(F.col("o") < 3, True)
        .when(F.col("k") == "id", within(is_secret))
        .when(F.col("k").isin("key40", "pass"), within(is_id) & ~covered)
        .when(F.col("k") == "endpoint", within(is_id) & within(is_secret))
        .otherwise(False)
    )
    one = F.struct("s", "o", "k", "e")
    return (
        flat.withColumn("keep", keep)
        .groupBy("_row")
        .agg(F.first("_id").alias("id"), F.sort_array(F.collect_list(F.when(F.col("keep"), one))).cast(SPAN).alias("spans"))
        .select("id", F.filter("spans", lambda x: x["o"] < 3).alias("base"), "spans")
    )


def op4_secret_scan(spark, sf_dir):
    return scan(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
    )
