"""PII: base patterns, then bootstrapped contextual extraction.

Base entities are the seeds. Lexical patterns are contexts of identifier-like
tokens (tokens with a digit or an at sign): the word before or after, or the
two words before. Patterns and token instances form a bipartite graph with
occurrence counts: an instance scores 1 if it is a seed, else one minus the
product of its patterns' doubts; a pattern scores its scored occurrences over
all occurrences of its context in the corpus, before ordinary words too, so
clean text is left alone. Each round picks its patterns anew from the whole
graph, so instances that were discovered support patterns as seeds do. After
``rounds`` such rounds, patterns of at least ``least_conf`` with
``least_support`` distinct instances extract the tokens not seen as seeds.

Only occurrences, context counts and graph edges move; texts stay in the scan.
A context that holds a large share of the occurrences is dealt over ``SALTS``
tasks wherever occurrences meet patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import (
    SPAN,
    count_kind,
    documents,
    let,
    light,
    lower_ascii,
    matches,
    row_key,
    span_text,
    spans,
    stage_table,
    text_of,
)

#: The base patterns. Runs are taken whole at their first character (or where the last match ended) and possessively:
#: the same leftmost matches as the plain patterns, without quadratic time on long runs or deep stacks.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Identifier-like tokens: words with a digit or an at sign.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
ROUNDS, LEAST_CONF, LEAST_SUPPORT, SALTS, MOST_BROADCAST = 2, 0.6, 3, 16, 200_000
#: The kinds of contexts: the word before, the word after, the two words before.
SIDES = ("l", "r", "ll")


def _luhn(v: Column) -> Column:
    digits = F.reverse(F.regexp_replace(v, "[^0-9]", ""))
    values = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: let(
            F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
            lambda d: F.when(d > 9, d - 9).otherwise(d),
        ),
    )
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _n_digits(v: Column) -> Column:
    return F.length(F.regexp_replace(v, "[^0-9]", ""))


def base_spans(t: Column) -> Column:
    """Spans of the base kinds, by start, then kind as listed."""
    none = F.array().cast(SPAN)
    digit = t.rlike("[0-9]")
    # a part of any length: without leading zeros it has three digits at most, and so is an int
    ip_ok = lambda v: F.forall(F.split(v, r"\."), lambda p: F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")).rlike("^0(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])?$"))
    card_ok = lambda v: F.when(_n_digits(v).between(12, 19), _luhn(v)).otherwise(F.lit(False))
    return F.sort_array(
        F.concat(
            F.when(t.contains("@"), spans(matches(t, EMAIL), 0, "email")).otherwise(none),
            F.when(digit & t.contains("."), spans(matches(t, IP), 1, "ip", ip_ok)).otherwise(none),
            F.when(digit, spans(matches(t, CARD), 2, "card", card_ok)).otherwise(none),
            F.when(
                t.contains("+"), spans(matches(t, PHONE), 3, "phone", lambda v: _n_digits(v).between(9, 15))
            ).otherwise(none),
        )
    )


def _tokens(t: Column) -> Column:
    """Identifier-like tokens with their contexts: array<struct<s, e, v, l, r, ll>>; '' is no context."""
    near = lambda text, pattern: lower_ascii(F.regexp_extract(text, pattern, 1))
    word, gap = r"[^\x20\x09-\x0D]++", r"[\x20\x09-\x0D]++"
    first = r"(?<![^\x20\x09-\x0D])"
    return F.transform(
        F.when(t.rlike("[0-9@]"), matches(t, TOKEN)).otherwise(
            F.array().cast("array<struct<s:int,e:int,v:string,before:string,after:string>>")
        ),
        lambda m: F.struct(
            m["s"].alias("s"), m["e"].alias("e"), m["v"].alias("v"),
            near(m["before"], f"{first}({word}){gap}$").alias("l"), near(m["after"], f"^{gap}({word})(?:$|{gap})").alias("r"),
            # the gaps between tokens are cut at tokens, so two words before are both words without a digit
            F.regexp_replace(near(m["before"], f"{first}({word}{gap}{word}){gap}$"), gap, " ").alias("ll"),
        ),
    )


def _context_counts(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(w, f): how often each wanted context of one or two words stands in the corpus.

    Up to ``MOST_BROADCAST`` wanted contexts are broadcast and sift the words first; beyond that all are counted, then joined.
    """
    words = F.array_remove(F.split(lower_ascii(text_of(text_col)), r"[\x20\x09-\x0D]+", -1), "")
    pairs = lambda w: F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get(w, i), x))
    each = docs.select(F.explode(let(words, lambda w: F.concat(w, F.when(F.size(w) > 1, pairs(w)).otherwise(F.array().cast("array<string>"))))).alias("w"))
    if wanted.count() <= MOST_BROADCAST:
        return each.join(F.broadcast(wanted), "w", "left_semi").groupBy("w").agg(F.count("*").alias("f"))
    return each.groupBy("w").agg(F.count("*").alias("f")).join(wanted, "w", "left_semi")


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, least_conf: float = LEAST_CONF,
    least_support: int = LEAST_SUPPORT, whole: bool = False,
) -> DataFrame:
    """A row per input row: (id, base, spans): base spans, and those with the method's (kind ``context``).

    Null text is empty; ids may repeat or be null; rows without personal data
    have empty arrays; an empty table gives an empty one. With ``whole`` the
    row itself is in ``_all``.
    """
    all_of = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all")
    src = docs.select(row_key().alias("row"), F.col(id_col).alias("id"), text_of(text_col).alias("_t"), *[all_of] * whole)
    # scanned once: what follows is keyed by the stored row number
    own = stage_table(src.select("row", "id", *["_all"] * whole, base_spans(F.col("_t")).alias("base"), _tokens(F.col("_t")).alias("toks")), "entities")
    toks = own.select("row", "base", F.explode("toks").alias("m")).select(
        "row", "m.*", F.exists("base", lambda b: (b["s"] < F.col("m.e")) & (b["e"] > F.col("m.s"))).alias("seed")
    )
    sided = toks.select(
        "row", "s", "e", "v", "seed", F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(k).alias("w")) for k in SIDES])).alias("p"),
    ).select("row", "s", "e", "v", "seed", "p.side", "p.w").where("w <> ''")
    # the whole graph: a context without seeds may become a pattern by what other patterns discover
    graph = stage_table(sided.groupBy("side", "w", "v").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "graph")
    # a pattern has ``least_support`` instances, so contexts of fewer are none
    wanted = graph.groupBy("side", "w").agg(F.count("*").alias("kinds")).where(F.col("kinds") >= least_support).select("w").distinct()
    freq = stage_table(_context_counts(docs, stage_table(wanted, "wanted"), text_col), "contexts")
    salted = lambda rows, by: rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    spread = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("_salt")
    scored, conf = graph.withColumn("score", F.col("seed").cast("double")), None
    for _ in range(rounds):
        found = (
            scored.groupBy("side", "w")
            .agg(F.sum(F.col("n") * F.col("score")).alias("hit"), F.count_if(F.col("score") >= 0.5).alias("support"))
            .where(F.col("support") >= least_support)
            .join(freq, "w")
            .select("side", "w", F.least(F.lit(1.0), F.col("hit") / F.col("f")).alias("conf"))
            .where(F.col("conf") >= least_conf)
        )
        conf = stage_table(found, "patterns").select("*", spread)
        doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("conf"))))
        by_token = salted(graph, "v").join(conf, ["side", "w", "_salt"]).groupBy("v").agg((1 - F.exp(doubt)).alias("new"))
        scored = graph.join(by_token, "v", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("new", F.lit(0.0))))
    span = F.struct(F.col("s").alias("s"), F.lit(len(KINDS)).alias("o"), F.lit("context").alias("k"), F.col("e").alias("e"))
    more = (
        salted(sided.where(~F.col("seed") & (F.length("v") >= 5) & (F.length(F.regexp_replace("v", "[^0-9]", "")) >= 3)), "row")
        .join(conf, ["side", "w", "_salt"], "left_semi")
        .groupBy("row")
        .agg(F.collect_set(span).cast(SPAN).alias("more"))
    )
    joined = own.drop("toks").join(light(stage_table(more, "found")), "row", "left")
    all_spans = F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(SPAN))))
    return joined.select("id", *["_all"] * whole, "base", all_spans.alias("spans"))


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with each span's text replaced by its kind in brackets; all else as it was.

    Null texts stay null, repeated rows are masked alike, an empty table gives an empty one.
    """
    t = F.col("_all")[text_col].cast("string")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:  # an overlapping span adds its end only
        inside = x["s"] < a["at"]
        return F.struct(
            F.greatest(a["at"], x["e"]).alias("at"),
            F.when(inside, a["out"])
            .otherwise(F.concat(a["out"], F.substring(t, a["at"] + 1, x["s"] - a["at"]), F.lit("["), F.upper(x["k"]), F.lit("]")))
            .alias("out"),
        )

    masked = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    text = F.when(F.size("spans") == 0, t).otherwise(masked)
    found = find(docs, id_col, text_col, whole=True, **how)
    return found.select(*[text.alias(c) if c == text_col else F.col("_all")[c].alias(c) for c in docs.columns])


def op7_contextual_pii(spark, sf_dir):
    return find(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
    )
