"""Importance resampling towards a target distribution.

Features are runs of 1 to ``width`` consecutive words, hashed into buckets. A
bucket's gain is the logarithm of its share in the target over its share in the
corpus; a document's weight is the mean gain of its features. Gumbel noise by
document turns weights into a draw without replacement.

Identical texts are collapsed first: the table is grouped by the full text, with
sums on the map side, so features and weight are made once a text and counts are
multiplied by the number of its copies. Weights go back to the documents by the
text's sha256; a text with many copies is dealt over many tasks there. The order
of the draw comes from ranges of scores (``operators.ordering``), never from one
task. What reaches the driver: ``buckets`` gains and two totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import documents, drop_table, join_hubs, lower_ascii, stage_table, text_of
from lumenframe.operators.ordering import placed

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, WIDTH, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"


def words(text: Column) -> Column:
    """Words of a text after A-Z are lower-cased."""
    return F.array_remove(F.split(lower_ascii(text), NO_WORD, -1), "")


def hashed_runs(found: Column, width: int, buckets: int) -> Column:
    """Buckets of all runs of 1 to ``width`` words, repeats included: array<int>."""
    place = lambda run: F.pmod(F.crc32(run.cast("binary")), F.lit(buckets)).cast("int")
    out = F.transform(found, place)

    def of(n: int) -> Column:
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: place(F.array_join(F.slice(found, i, F.lit(n)), " ")))

    return F.concat(out, *[of(n) for n in range(2, width + 1)])


def histogram(runs: DataFrame, copies: Column) -> DataFrame:
    """(bucket, n): features of all rows, each row ``copies`` times."""
    return runs.select(F.explode("runs").alias("bucket"), copies.alias("c")).groupBy("bucket").agg(F.sum("c").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """Gains in thousandths by bucket: floor(1000 ln of the smoothed shares' ratio)."""
    own = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full_outer")
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(own, "bucket", "left")
    counts = every.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    totals = counts.agg(F.sum("s"), F.sum("t")).first()
    s_all, t_all = (F.lit(float(x)) for x in totals)
    ratio = (F.col("t") + 1) * (s_all + buckets) / ((F.col("s") + 1) * (t_all + buckets))
    got = counts.select("bucket", F.floor(F.log(ratio) * 1000).cast("bigint").alias("gain")).collect()  # a row a bucket
    return [g for _, g in sorted((r["bucket"], r["gain"]) for r in got)]


def floored_mean(total: Column, n: Column) -> Column:
    """Whole mean, rounded down; 0 of nothing."""
    return F.when(n == 0, F.lit(0)).otherwise(F.floor((total - F.pmod(total, n)) / n)).cast("bigint")


def noise(id_col: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, rounded down, from the document's id alone. A null id counts as the empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("bigint")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    width: int = WIDTH, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED,
) -> DataFrame:
    """A row per document: (id, n_features, weight, score, rank); rank is null for documents that are not drawn.

    Of the N documents of ``least_words`` words or more, floor(percent * N / 100)
    are drawn, by score, ties by the smaller id (a null id first). Null and empty
    texts have no features, weight 0, and are never drawn unless ``least_words``
    is 0. Repeated rows are documents of their own with equal scores and ranks
    that follow each other. An empty table gives no rows; an empty target has
    the smoothing alone.
    """
    spark = docs.sparkSession
    key = F.unhex(F.sha2(F.col("text"), 256))
    texts = docs.select(text_of(text_col).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    # many tasks hold few rows each: texts are long, so what is read next is the buckets alone
    split = texts.select(key.alias("key"), "copies", words(F.col("text")).alias("w"))
    per = stage_table(split.select("key", "copies", F.size("w").alias("n_words"), hashed_runs(F.col("w"), width, buckets).alias("runs")), "text-runs")
    aimed = target.select(hashed_runs(words(text_of(target_col)), width, buckets).alias("runs"))
    gains = bucket_gains(histogram(per, F.col("copies")), histogram(aimed, F.lit(1)), buckets)
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")  # folded to one literal
    total = F.aggregate("runs", F.lit(0).cast("bigint"), lambda acc, b: acc + F.get(table, b))
    n = F.size("runs").cast("bigint")
    weights = stage_table(per.select("key", "copies", (F.col("n_words") >= least_words).alias("able"), n.alias("n_features"), floored_mean(total, n).alias("weight")), "text-weights")
    rows = stage_table(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).select("id", key.alias("key"), F.monotonically_increasing_id().alias("row")), "document-keys")
    back = join_hubs(rows, weights, "key", "copies", "row")
    scored = stage_table(back.select("id", "able", "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score")), "scored")
    able = scored.agg(F.count_if("able")).first()[0]
    ranked = placed(scored, [], [F.col("able").desc(), F.col("score").desc(), F.col("id")], "rank")
    for done in (per, weights, rows):
        drop_table(done)
    drawn = F.col("able") & (F.col("rank") <= percent * able // 100)
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(drawn, F.col("rank")).alias("rank"))


def op11_importance_resampling(spark, sf_dir):
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The crc32 of a text's bytes: a table of 256 entries from its rule, then a fold over the bytes.
CRC_TABLE_SQL = """crc_table AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    """DuckDB form of crc32 of a text column, beside ``crc_table``."""
    digit = lambda at: f"(strpos('0123456789ABCDEF', substr(hex(encode({text})), {at}, 1)) - 1)"
    byte = f"(16 * {digit('2 * i + 1')} + {digit('2 * i + 2')})"
    steps = f"list_transform(range(strlen({text})), lambda i: CAST({byte} AS BIGINT))"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295)"


OP11_SQL = f"""WITH {CRC_TABLE_SQL},
split AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
  UNION ALL
  SELECT 't', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') FROM benchmark),
used AS (SELECT side, id, word, count(*) AS c FROM (SELECT side, id, unnest(w) AS word FROM split) GROUP BY ALL),
vocabulary AS (SELECT word, {crc_sql("word")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT word FROM used), crc_table),
counts AS (SELECT r.b AS bucket, coalesce(sum(c) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (side = 't'), 0)::DOUBLE AS t
  FROM range({BUCKETS}) r(b) LEFT JOIN (SELECT * FROM used JOIN vocabulary USING (word)) u ON u.bucket = r.b GROUP BY r.b),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + {BUCKETS}) / ((s + 1) * ((SELECT sum(t) FROM counts) + {BUCKETS}))))::BIGINT AS gain FROM counts),
weights AS (SELECT id, floor(sum(c * gain)::DOUBLE / sum(c))::BIGINT AS weight FROM used JOIN vocabulary USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM split LEFT JOIN weights USING (id) WHERE side = 'd'),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)"""
