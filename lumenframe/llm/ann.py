"""Nearest neighbours by a hash-prefix forest (LSH forest; Bawa, Condie, Ganesan, 2005).

Rows are dealt to shards by a hash of their id. In a shard, each tree is the
array of its rows' hash strings, sorted. A string's symbols are cross-polytope
hashes (Andoni et al., 2015): the vector is rotated at random, and the symbol is
the largest coordinate with its sign. A query descends to its longest prefix
match in each tree, then all trees ascend together, one symbol at a time, and
add the rows under the shorter prefix. It stops when a row at the angle of the
k-th best so far would be in none of the trees' ranges with a probability of at
most ``miss``. There is no cap on candidates: a query without close rows ascends
to the root, and so meets all rows of the shard.

Every row is indexed, once: a shard's rows stream ahead of the queries, which
follow in batches, so a task holds one shard and one batch.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES, SYMBOLS, WIDTH, MISS, SHARD_ROWS = 36, 3, 64, 0.15, 16384
#: Queries that are searched together.
AT_ONCE = 64


@functools.cache
def same_symbol(width: int) -> np.ndarray:
    """The chance that vectors of cosine 0, 1/64 .. 1 share a symbol, by simulation with a fixed seed."""
    rng, out = np.random.default_rng(7), []
    a, b = rng.standard_normal((2, 20000, width), dtype=np.float32)
    for c in np.arange(65) / 64:
        x = c * a + np.sqrt(1 - c * c) * b
        i, j = np.abs(a).argmax(1), np.abs(x).argmax(1)
        at = np.arange(len(a))
        out.append(((i == j) & ((a[at, i] > 0) == (x[at, j] > 0))).mean())
    return np.maximum.accumulate(out)


class Forest:
    """Trees over the rows of one shard. Vectors are of length one."""

    def __init__(self, unit: np.ndarray, trees: int, symbols: int, seed: int):
        self.x, self.trees, self.symbols = unit, trees, symbols
        dim = unit.shape[1]
        self.width = min(WIDTH, max(2, dim))
        rng = np.random.default_rng(seed)
        self.turns = rng.standard_normal((trees, symbols, dim, self.width), dtype=np.float32)
        self.digit = 2 * self.width
        keys = self.keys(unit)
        self.order = np.argsort(keys, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(keys.T, self.order, axis=1)
        self.met = 0

    def keys(self, v: np.ndarray) -> np.ndarray:
        """(n, trees) hash strings as numbers, the first symbol the highest digit."""
        v = v.astype(np.float32)
        out = np.zeros((len(v), self.trees), np.int64)
        for at in range(0, len(v), 4096):
            part = v[at : at + 4096]
            row = np.arange(len(part))
            for t in range(self.trees):
                for s in range(self.symbols):
                    y = part @ self.turns[t, s]
                    i = np.abs(y).argmax(axis=1)
                    out[at : at + 4096, t] = out[at : at + 4096, t] * self.digit + 2 * i + (y[row, i] > 0)
        return out

    def _pairs(self, lo: np.ndarray, hi: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Numbers query * rows + row of all rows in the ranges (trees, queries), once each."""
        size = hi - lo
        tree = np.broadcast_to(np.arange(self.trees)[:, None], size.shape)
        ask = np.broadcast_to(who[None, :], size.shape)
        n, first = size.ravel(), lo.ravel()
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(first, n)
        row = self.order[np.repeat(tree.ravel(), n), at]
        return np.repeat(ask.ravel(), n) * len(self.x) + row

    def search(self, q: np.ndarray, own: np.ndarray, k: int, miss: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, cosine) of the k best found for each query, ties to the smaller row; row ``own`` (-1: none) is not its candidate."""
        n, m = len(self.x), len(q)
        keys, chance = self.keys(q), same_symbol(self.width)
        seen = np.zeros((m, n), bool)
        seen[np.nonzero(own >= 0)[0], own[own >= 0]] = True
        got_q, got_r, got_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        active = np.arange(m)
        for level in range(self.symbols, -1, -1):
            if level:
                width = self.digit ** (self.symbols - level)
                first = keys[active].T // width * width
                lo = np.array([np.searchsorted(s, f, "left") for s, f in zip(self.sorted, first, strict=True)])
                hi = np.array([np.searchsorted(s, f + width, "left") for s, f in zip(self.sorted, first, strict=True)])
                hits = np.zeros((m, n), bool)
                hits.ravel()[self._pairs(lo, hi, active)] = True
            else:
                hits = np.zeros((m, n), bool)
                hits[active] = True
            hits &= ~seen
            seen |= hits
            ask, row = np.nonzero(hits)
            self.met += len(row)
            s = np.concatenate([np.einsum("ij,ij->i", self.x[row[a : a + 65536]], q[ask[a : a + 65536]]) for a in range(0, len(row), 65536)] or [np.zeros(0)])
            got_q, got_r, got_s = np.concatenate((got_q, ask)), np.concatenate((got_r, row)), np.concatenate((got_s, s))
            best = np.lexsort((got_r, -got_s, got_q))
            got_q, got_r, got_s = got_q[best], got_r[best], got_s[best]
            place = np.arange(len(got_q)) - np.searchsorted(got_q, got_q, "left")
            keep = place < k
            got_q, got_r, got_s, place = got_q[keep], got_r[keep], got_s[keep], place[keep]
            if level:
                kth = np.full(m, -1.0)
                kth[got_q[place == k - 1]] = got_s[place == k - 1]
                share = np.interp(np.clip(kth, 0, 1), np.arange(65) / 64, chance)
                done = (kth > 0) & ((1 - share**level) ** self.trees <= miss)
                active = active[~done[active]]
                if not len(active):
                    break
        return got_q, got_r, got_s


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, dim) of rows that take part: id and vector not null, all parts finite, not all zero."""
    v = F.col(vec_col).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    own = rows.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0)
    )
    return own.withColumn("dim", F.size("v"))


def _unit(v: pd.Series) -> np.ndarray:
    """Rows of length one; scaled first, so that no square runs over or under."""
    x = np.stack(v.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
    trees: int = TREES, symbols: int = SYMBOLS, miss: float = MISS, shard_rows: int = SHARD_ROWS, seed: int = 42,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its ``k`` nearest rows by cosine, found through the forest.

    A query that is a row of ``rows`` is no candidate of its own. Of rows that share an id and
    are queries, each is answered, under the id that they share; the others of that
    id are its candidates. Fewer candidates than k: all of them.
    Vectors of unlike lengths do not meet. Rows or queries that are null, zero
    or not finite take no part; empty tables give no rows.
    """
    # queries of one id are ranked apart: told by their place among them
    copy = Window.partitionBy("id").orderBy("dim", F.xxhash64("v"))
    own, asked = usable(rows, id_col, vec_col), usable(queries, id_col, vec_col).withColumn("copy", F.row_number().over(copy))
    shards = max(1, -(-own.count() // shard_rows))
    own = own.select("dim", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.lit(0).alias("copy"), "id", "v")
    asked = asked.select("dim", F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"), "copy", "id", "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, parts, forest = None, [], None
        for b in batches:
            marks = b["dim"].to_numpy(np.int64) * (1 << 40) + b["shard"].to_numpy()
            for mark in pd.unique(marks):
                now = b[marks == mark]
                if mark != group:
                    group, parts, forest = mark, [], None
                is_row = now["copy"].to_numpy() == 0
                parts += [now[is_row]] if is_row.any() else []
                ask = now[~is_row]
                if not len(ask) or not (parts or forest):
                    continue
                if forest is None:
                    held, parts = pd.concat(parts).sort_values("id"), []  # row numbers follow the ids
                    ids = held["id"].to_numpy(np.int64)
                    forest = Forest(_unit(held["v"]), trees, symbols, seed)
                unit, ask_id, ask_copy = _unit(ask["v"]), ask["id"].to_numpy(np.int64), ask["copy"].to_numpy(np.int64)
                own_row = np.full(len(ask), -1)
                for a, (lo, hi) in enumerate(zip(np.searchsorted(ids, ask_id, "left"), np.searchsorted(ids, ask_id, "right"), strict=True)):
                    same = np.nonzero((forest.x[lo:hi] == unit[a]).all(axis=1))[0]  # rows of the query's id: one, as a rule
                    own_row[a] = lo + same[0] if len(same) else -1
                for at in range(0, len(ask), AT_ONCE):
                    to = at + AT_ONCE
                    qq, rr, ss = forest.search(unit[at:to], own_row[at:to], k, miss)
                    yield pd.DataFrame({"query_id": ask_id[at:to][qq], "copy": ask_copy[at:to][qq], "vec_id": ids[rr], "score": np.clip(ss, -1.0, 1.0)})

    dealt = own.union(asked).repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "copy")
    found = dealt.mapInPandas(run, "query_id bigint, copy int, vec_id bigint, score double")
    order = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_prefix_forest(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where("vec_id % 50 = 0"))
