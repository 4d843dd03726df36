"""Quality rules whose cutoffs carry a false-rejection guarantee on the verdict.

Statistics of each text are native column expressions. The rules' cutoffs form
steps, from loose to tight, that hold for all rules at once: step j rejects a
document if any rule's j-th cutoff does. For each stratum the tightest step is
taken at which rejecting clean documents more often than ``risk`` is refuted by
an exact binomial test on the labelled holdout, counting the rejections of the
whole step; the level is split over all strata and steps (Bonferroni), so with
probability 1 - level every stratum keeps its limit, for the verdict as a whole.
A stratum without enough labels has no step, and so rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import WORD, documents, let, stage_table, text_of

#: Rule -> (numerator, denominator, cutoffs by step, tight to loose): rejected if numerator * 100 > cutoff * denominator.
RULES: dict[str, tuple[str, str, tuple[int, ...]]] = {
    "symbols_per_word": ("n_symbols", "n_words", (5, 10, 20, 40, 80, 160)),
    "repeated_words": ("n_repeat_words", "n_words", (10, 15, 20, 25, 30, 40)),
    "repeated_lines": ("n_dup_lines", "n_lines", (20, 30, 40, 50, 60, 80)),
    "upper_letters": ("n_upper", "word_chars", (10, 20, 30, 40, 50, 70)),
    "word_length": ("word_chars", "n_words", (700, 800, 900, 1000, 1200, 1500)),
}
RISK, LEVEL, STEPS = 0.02, 0.05, 6
SYMBOLS = "#*$%&|<>"


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window that is found twice or more."""

    def covered(at: Column) -> Column:  # sorted starts of repeated windows
        steps = F.transform(
            at, lambda p, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(at, i - 1)))
        )
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    def repeated(keyed: Column) -> Column:  # sorted (window, start)
        own = F.filter(
            keyed,
            lambda x, i: F.coalesce(F.get(keyed, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(keyed, i + 1)["h"] == x["h"], F.lit(False)),
        )
        return F.when(F.size(own) == 0, F.lit(0)).otherwise(
            let(F.sort_array(F.transform(own, lambda x: x["p"])), covered)
        )

    def found(hashes: Column) -> Column:
        keyed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(keyed), repeated))

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(windows, found)

    return F.when(F.size(words) >= 4, of(words)).otherwise(F.lit(0)).cast("bigint")


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")


def text_statistics(docs: DataFrame, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """Columns ``keep``, then n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_upper, n_repeat_words.

    A null text is empty; an empty text has zeros. Upper letters are A-Z and
    letters whose lower case differs.
    """
    # words and lines are bound once each, so that no rewrite of the plan evaluates them for every element
    base = docs.select(*(keep or []), text_of(text_col).alias("_t"))
    words = let(
        F.array_remove(F.split("_t", r"[\x20\x09-\x0D]+", -1), ""),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n"), F.length(F.array_join(w, "")).cast("bigint").alias("chars"), _repeat_words(w).alias("again")
        ),
    )
    lines = let(
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD)),
        lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("own")),
    )
    base = base.select("*", words.alias("_w"), lines.alias("_l"))
    return base.select(
        *[c for c in base.columns if c not in ("_t", "_w", "_l")],
        F.col("_w.n").alias("n_words"),
        F.col("_w.chars").alias("word_chars"),
        # symbols are rare: what is left without the long runs of other characters
        F.length(F.regexp_replace("_t", f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
        (F.col("_l.n") - F.col("_l.own")).cast("bigint").alias("n_dup_lines"),
        F.col("_l.n").cast("bigint").alias("n_lines"),
        _count_of(F.col("_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ").alias("n_upper"),
        F.col("_w.again").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rejects(rule: str, cutoff) -> Column:
    top, below, _ = RULES[rule]
    return F.col(top) * 100 > cutoff * F.col(below)


def allowed(n: Column, risk: float, level: Column) -> Column:
    """The most false rejections k of n at which P(Bin(n, risk) <= k) <= level; -1 if there is none.

    Exact: the terms of the distribution are summed in turn, as logarithms.
    """
    import math

    odds = math.log(risk) - math.log1p(-risk)
    start = F.struct(
        (n.cast("double") * F.lit(math.log1p(-risk))).alias("term"), F.lit(float("-inf")).alias("cdf"), F.lit(-1).cast("bigint").alias("k")
    )

    def step(s: Column, j: Column) -> Column:
        top = F.greatest(s["cdf"], s["term"])
        cdf = top + F.log(F.exp(s["cdf"] - top) + F.exp(s["term"] - top))
        nxt = s["term"] + F.log((n - j).cast("double")) - F.log((j + 1).cast("double")) + F.lit(odds)
        return F.struct(
            F.coalesce(nxt, F.lit(float("-inf"))).alias("term"),
            cdf.alias("cdf"),
            F.when(cdf <= F.log(level), j.cast("bigint")).otherwise(s["k"]).alias("k"),
        )

    most = F.ceil(n * F.lit(risk)).cast("bigint")
    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), most), start, step, lambda s: s["k"])


def rejected_at(step: int) -> Column:
    """Whether any rule rejects at a step (0: the tightest)."""
    out = F.lit(False)
    for r, (_, _, grid) in RULES.items():
        out = out | rejects(r, grid[step])
    return out


def cutoffs(stats: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """``stats`` of the labelled clean rows (those that fail the base rules are left out) with a ``stratum`` -> a row per stratum: n_holdout and step (null: none)."""
    counts = [F.count_if(rejected_at(j)).alias(f"at_{j}") for j in range(STEPS)]
    by = stage_table(stats.where(~base_failed()).groupBy("stratum").agg(F.count("*").alias("n"), *counts), "holdout")
    k = allowed(F.col("n"), risk, F.lit(level / (STEPS * max(1, by.count()))))
    step = F.coalesce(*[F.when(F.col(f"at_{j}") <= F.col("k"), F.lit(j)) for j in range(STEPS)])
    return by.withColumn("k", k).select("stratum", F.col("n").alias("n_holdout"), step.alias("step"))


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    risk: float = RISK, level: float = LEVEL, whole: bool = False,
) -> DataFrame:
    """Each row of ``docs`` with its statistics, base_failed, failed_rules and kept.

    ``labels``: (id, quality); rows with quality 1 that pass the base rules are
    the clean holdout; a null quality is no label, repeated labels count once.
    A null stratum is a stratum. With ``whole`` the row itself is in ``_all``.
    An empty table gives an empty one; without labels only the base rules reject.
    """
    all_of = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all")
    keep = [F.col(id_col).alias("_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum")]
    clean = labels.where("quality = 1").select(F.col("doc_id").alias("_id")).distinct()
    # computed once; the holdout's join reads the statistics alone, so that no text is shuffled
    out = stage_table(text_statistics(docs, text_col, keep + [all_of] * whole), "statistics")
    cuts = stage_table(cutoffs(out.drop("_all").join(clean, "_id", "left_semi"), risk, level), "cutoffs")
    out = out.withColumn("base_failed", base_failed()).join(cuts, "stratum", "left")
    chosen = lambda grid: F.get(F.array(*[F.lit(c) for c in grid]), F.col("step"))
    failed = F.filter(
        F.array(*[F.when(rejects(r, chosen(grid)), F.lit(r)) for r, (_, _, grid) in RULES.items()]), lambda x: x.isNotNull()
    )
    out = out.withColumn("failed_rules", F.array_join(failed, ","))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def op9_quality_rules(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, labels).select(
        F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "failed_rules",
    )


def _oracle() -> str:
    words = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
    count = lambda chars: " + ".join(f"(length(t) - length(replace(t, '{c}', '')))" for c in chars)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
    rej = lambda r, c: f"{RULES[r][0]} * 100 > {c} * {RULES[r][1]}"
    counts = ",\n".join("count(*) FILTER (WHERE " + " OR ".join(rej(r, g[j]) for r, (_, _, g) in RULES.items()) + f") AS at_{j}" for j in range(STEPS))
    step = "CASE " + " ".join(f"WHEN at_{j} <= k THEN {j}" for j in range(STEPS)) + " END AS step"
    failed = ", ".join(f"CASE WHEN {rej(r, f'{list(g)}[step + 1]')} THEN '{r}' END" for r, (_, _, g) in RULES.items())
    return rf"""
WITH base AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents
), parts AS (
  SELECT *, {words} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base
), win AS (
  SELECT rid, i AS p, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM parts)
), cov AS (
  SELECT rid, count(DISTINCT p + d) AS n FROM win, (VALUES (0), (1), (2)) o(d) WHERE c > 1 GROUP BY rid
), stats AS (
  SELECT parts.rid, doc_id, stratum, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    ({count(SYMBOLS)})::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines,
    (length(t) - length(regexp_replace(t, '[{upper}]', '', 'g')))::BIGINT AS n_upper,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM parts LEFT JOIN cov USING (rid)
), judged AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM stats
), held AS (
  SELECT stratum, count(*) AS n, {counts}
  FROM judged WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY stratum
), lev AS (SELECT {LEVEL} / ({STEPS} * greatest(1, count(*))) AS a FROM held
), ks AS (
  SELECT held.*, coalesce((
    SELECT max(j) FROM (
      SELECT j, sum(exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({RISK}) + (n - j) * ln(1 - {RISK}))) OVER (ORDER BY j) AS cdf
      FROM (SELECT unnest(range(0, least(n, ceil(n * {RISK})::BIGINT) + 1)) AS j)) WHERE cdf <= lev.a), -1) AS k
  FROM held, lev
), cuts AS (SELECT stratum, {step} FROM ks)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND failed_rules = '') AS kept, failed_rules
FROM (
  SELECT judged.*, array_to_string(list_filter([{failed}], lambda x: x IS NOT NULL), ',') AS failed_rules
  FROM judged LEFT JOIN cuts USING (stratum))
"""


OP9_SQL = _oracle()
