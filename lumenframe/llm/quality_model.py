"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered
thresholds cut its score: P(grade <= j) = sigmoid(t_j - w.x). The result has the
expected grade and the tail probability P(grade = best), on which documents are
selected. Grades: 0 toxic, 1 of low quality, 2 good.

Features: the set of a text's lower-cased words (without outer punctuation),
hashed to ``2**bits``, and hashed marks of its shape (repetition, symbols,
capitals). An L1 penalty sets words that carry nothing to exactly zero, so that
long texts do not gather noise.

Training takes a bounded sample: the ``most_labelled`` labelled rows with the
smallest hash of the id; their features, and nothing else, reach the driver.
Scoring is one scan without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import documents, small_batches, text_of

BITS, MOST_LABELLED, SELECT_AT = 18, 12_000, 0.5
_STRIP = b".,;:!?\"'()[]{}*#$%&|<>-_=/\\"
_KNOWN: dict[bytes, int] = {}


def _slot(word: bytes, mask: int) -> int:
    got = _KNOWN.get(word)
    if got is None:
        got = zlib.crc32(word)
        if len(_KNOWN) < 500_000:
            _KNOWN[word] = got
    return got & mask


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct feature slots of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    mask, words = (1 << bits) - 1, raw.split()
    kinds = set(words)
    low = {w.lower().strip(_STRIP) for w in kinds}
    out = {_slot(w, mask) for w in low if w}
    n = max(len(words), 1)
    size = max(len(raw), 1)
    symbols = size - len(raw.translate(None, b"#*$%&|<>!"))
    capitals = size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again = 1 - len(set(lines)) / max(len(lines), 1)
    marks = (
        ("symbols", int(min(9, 10 * symbols / n))), ("capitals", int(min(9, 20 * capitals / size))), ("lines", int(5 * again)),
        ("kinds", int(10 * len(kinds) / n) if n > 30 else -1), ("length", min(12, n.bit_length())), ("wide", min(12, size // n)),
    )
    out.update(_slot(f"\x01{k}={v}".encode(), mask) for k, v in marks)
    return np.fromiter(sorted(out), np.int32, len(out))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, bits: int = BITS, l1: float = 2e-4, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by proximal steps scaled per coordinate; empty data gives zeros."""
    w, gaps = np.zeros(1 << bits), np.full(n_grades - 1, 1.0)
    gaps[0] = -1.0
    if len(rows):
        at = np.concatenate(rows)
        ends = np.cumsum([len(r) for r in rows])
        starts, n = np.concatenate(([0], ends[:-1])), len(rows)
        used, at = np.unique(at, return_inverse=True)
        v, who = np.zeros(len(used)), np.repeat(np.arange(n), np.diff(np.concatenate(([0], ends))))
        g2, t2 = np.full(len(used), 1e-6), np.full(n_grades - 1, 1e-6)
        for _ in range(rounds):
            t = gaps[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps[1:]))))
            score = np.add.reduceat(v[at], starts)
            edge = np.concatenate(([-40.0], t, [40.0]))
            hi, lo = _sigmoid(edge[grades + 1] - score), _sigmoid(edge[grades] - score)
            p = np.maximum(hi - lo, 1e-9)
            dh, dl = hi * (1 - hi) / p, lo * (1 - lo) / p
            # of the mean log loss
            d_score = (dh - dl) / n
            d_t = np.array([(dl[grades == j + 1].sum() - dh[grades == j].sum()) / n for j in range(n_grades - 1)])
            d_gap = np.concatenate(([d_t.sum()], [d_t[j:].sum() * np.exp(gaps[j]) for j in range(1, n_grades - 1)]))
            g = np.bincount(at, weights=d_score[who], minlength=len(used))
            g2 += g * g
            t2 += d_gap * d_gap
            rate = 0.3 / np.sqrt(g2)
            v = v - rate * g
            v = np.sign(v) * np.maximum(np.abs(v) - rate * l1, 0)
            gaps = gaps - 0.3 / np.sqrt(t2) * d_gap
        w[used] = v
    return w, gaps[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps[1:]))))


def grade_probabilities(score: np.ndarray, t: np.ndarray) -> np.ndarray:
    below = _sigmoid(t[None, :] - score[:, None])
    return np.diff(np.concatenate((np.zeros((len(score), 1)), below, np.ones((len(score), 1))), axis=1), axis=1)


def train(docs: DataFrame, rated: DataFrame, n_grades: int, id_col: str, text_col: str, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``rated``: (id, grade). Repeated labels count once (the lowest grade); null grades are no labels."""
    own = rated.where("grade is not null and id is not null").groupBy("id").agg(F.min("grade").alias("grade"))
    sample = own.orderBy(F.xxhash64("id"), "id").limit(most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"grade": b["grade"], "at": [features(t, bits).tobytes() for t in b["text"]]})

    # at most ``most`` short rows: broadcast
    picked = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(sample), "id")
    got = picked.select("grade", "text").mapInPandas(run, "grade int, at binary").toPandas()
    got = got.assign(key=[zlib.crc32(x) for x in got["at"]]).sort_values(["key", "grade"], kind="stable")
    return fit([np.frombuffer(x, np.int32) for x in got["at"]], got["grade"].to_numpy(np.int64), n_grades, bits)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """A row per input row: (id, expected_grade, p_best, kept). Null text is empty and scored by its shape alone."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # 2**bits weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, t = held.value
        for b in batches:
            s = np.array([float(w[features(x, bits)].sum(dtype=np.float64)) for x in b["text"]])
            p = grade_probabilities(s, t)
            yield pd.DataFrame({"id": b["id"], "expected_grade": p @ np.arange(p.shape[1]), "p_best": p[:, -1]})

    src = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    out = src.mapInPandas(run, "id bigint, expected_grade double, p_best double")
    return out.withColumn("kept", F.col("p_best") >= SELECT_AT)


def ratings(labels: DataFrame) -> DataFrame:
    """Grades from the labels: 0 toxic, 1 low quality, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col("doc_id").alias("id"), grade.alias("grade"))


def op1_ordinal_quality(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, ratings(labels), 3, "doc_id", "text", BITS, MOST_LABELLED)
    return score(docs, model).withColumnRenamed("id", "doc_id")
