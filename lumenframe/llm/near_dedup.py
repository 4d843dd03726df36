"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64-bit SimHash over word shingles. Links: Hamming distance of at
most ``distance``. Candidates come from a partitioned index in the way of
Qin et al. (GPH, ICDE 2018): correlated bits share a partition; each
fingerprint spends a budget of ``distance - parts + 1`` unequally over its
partitions, picked by dynamic programming on the exact number of index entries
within each radius; it probes those radii, and every candidate is verified.

Scale: the statistics that reach the driver have a fixed size (64 x 64 bit
counts, ``parts`` histograms of 2**(64/parts) cells). Equal texts are one index
entry. A popular cell is cut into blocks of ``BLOCK`` entries, so no task holds
a whole cell, and a block returns a spanning forest, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import KEY, join_hubs, light, numbered, small_batches, stage_table
from lumenframe.llm.components import connected_components

#: Most index entries of one cell that one task compares against at once.
BLOCK = 2048
#: Most candidate pairs that are held at once.
CHUNK = 1 << 21
#: Cost of a probe in candidate comparisons, for the allocation.
PROBE_COST = 6


def _hashes(text: str | None, width: int) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def fingerprint_of(text: str | None, width: int = 4) -> int:
    """The signed 64-bit fingerprint of one text."""
    return int(_fold([np.array(_hashes(text, width), np.uint64)])[0])


def _fold(groups: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(groups), np.int64)
    for i, h in enumerate(groups):
        if len(h):
            ones = np.zeros(64, np.int64)
            for at in range(0, len(h), 65536):
                part = h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > len(h)).view(">u8")[0].astype(np.uint64).view(np.int64)
    return out


def keyed_texts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_f, _i, id, text) of numbered rows; a null text is empty."""
    all_of = F.col("_all")
    return rows.select(*KEY, all_of[id_col].cast("bigint").alias("id"), F.coalesce(all_of[text_col].cast("string"), F.lit("")).alias("text"))


def fingerprints(texts: DataFrame, width: int = 4) -> DataFrame:
    """One row per row of ``keyed_texts``: (_f, _i, id, fp). A text without words has fingerprint zero."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = _fold([np.array(_hashes(t, width), np.uint64) for t in b["text"]])
            yield b.drop(columns="text").assign(fp=fp)

    small_batches(texts.sparkSession)
    return texts.mapInPandas(run, "_f bigint, _i bigint, id bigint, fp bigint")


def _bits(fp: np.ndarray) -> np.ndarray:
    """(n, 64) 0/1; column b is bit b of the value."""
    u = fp.view(np.uint64)
    return ((u[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)


def bit_groups(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Group the most correlated bits. ``both[i, j]``: fingerprints with bits i and j set, of ``n``."""
    p = both / max(n, 1)
    one = np.diag(p)
    dev = np.sqrt(np.maximum(one * (1 - one), 1e-12))
    corr = np.abs((p - np.outer(one, one)) / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    left, out = set(range(64)), []
    for k in range(parts):
        room = 64 // parts + (k < 64 % parts)
        rest = sorted(left)
        first = rest[int(np.argmax(corr[np.ix_(rest, rest)].sum(axis=1)))]
        group = [first]
        left.discard(first)
        while len(group) < room:
            rest = sorted(left)
            best = rest[int(np.argmax(corr[np.ix_(rest, group)].sum(axis=1)))]
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def _value(fp: np.ndarray, group: list[int]) -> np.ndarray:
    u, v = fp.view(np.uint64), np.zeros(len(fp), np.int64)
    for k, b in enumerate(group):
        v |= ((u >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return v


def _within(hist: np.ndarray, bits: int, most: int) -> list[np.ndarray]:
    """For r = 0..most: entries at distance at most r of each cell."""
    exact = [hist.astype(np.int64)] + [np.zeros_like(hist, np.int64) for _ in range(most)]
    cell = np.arange(len(hist))
    for b in range(bits):
        flip = cell ^ (1 << b)
        exact = [exact[0]] + [exact[r] + exact[r - 1][flip] for r in range(1, most + 1)]
    return list(np.cumsum(exact, axis=0))


def _masks(bits: int, most: int) -> list[np.ndarray]:
    """For r = 0..most: all flips of at most r bits."""
    from itertools import combinations

    out, so_far = [], []
    for r in range(most + 1):
        so_far = so_far + [sum(1 << b for b in c) for c in combinations(range(bits), r)]
        out.append(np.array(so_far, np.int64))
    return out


def allocate(values: list[np.ndarray], near: list[list[np.ndarray]], probes: list[list[int]], distance: int) -> np.ndarray:
    """Thresholds (n, parts) in -1.., of sum distance - parts + 1, with the least estimated cost for each row."""
    n, parts = len(values[0]), len(values)
    cost = [
        [np.zeros(n)] + [near[i][r][values[i]] + float(PROBE_COST * probes[i][r]) for r in range(len(near[i]))]
        for i in range(parts)
    ]
    best = [np.zeros(n)] + [np.full(n, np.inf) for _ in range(distance + 1)]
    picked = []
    for i in range(parts):
        new, pick = [], []
        for s in range(distance + 2):
            opts = [best[s - e] + cost[i][e] for e in range(min(s, len(cost[i]) - 1) + 1)]
            which = np.argmin(opts, axis=0)
            pick.append(which)
            new.append(np.take_along_axis(np.array(opts), which[None], 0)[0])
        best = new
        picked.append(pick)
    out, s = np.zeros((n, parts), np.int64), np.full(n, distance + 1)
    for i in reversed(range(parts)):
        e = np.array(picked[i])[s, np.arange(n)]
        out[:, i] = e - 1
        s = s - e
    return out


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the pairs: at most one edge a node."""
    nodes, inv = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, lab = inv[: len(a)], inv[len(a) :], np.arange(len(nodes))
    while True:
        old = lab.copy()
        m = np.minimum(lab[x], lab[y])
        np.minimum.at(lab, x, m)
        np.minimum.at(lab, y, m)
        lab = lab[lab]
        if (lab == old).all():
            keep = lab != np.arange(len(nodes))
            return nodes[keep], nodes[lab[keep]]


def near_links(fps: DataFrame, distance: int = 4, parts: int = 4) -> DataFrame:
    """Edges (a, b) that connect what pairs of distinct fingerprints at 1..distance bits connect.

    ``fps``: one bigint column ``fp`` without repeats; read several times, so
    pass a stored table. Exact: every linked pair is found by at least one
    probe; blocks return spanning forests of the links that they verify.
    """
    spark = fps.sparkSession

    def pair_counts(batches):
        total = np.zeros((64, 64))
        for b in batches:
            x = _bits(b["fp"].to_numpy(np.int64)).astype(np.float32)
            total += x.T @ x
        at = np.nonzero(total)
        yield pd.DataFrame({"i": at[0], "j": at[1], "n": total[at].astype(np.int64)})

    found = fps.mapInPandas(pair_counts, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros((64, 64))
    both[found["i"], found["j"]] = found["n"]
    groups = bit_groups(both, fps.count(), parts)
    width = [len(g) for g in groups]

    def cells(batches):
        total = [np.zeros(1 << w, np.int64) for w in width]
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            for i, g in enumerate(groups):
                total[i] += np.bincount(_value(fp, g), minlength=1 << width[i])
        for i, t in enumerate(total):
            at = np.nonzero(t)[0]
            yield pd.DataFrame({"part": np.full(len(at), i), "cell": at, "n": t[at]})

    found = fps.mapInPandas(cells, "part int, cell int, n bigint").groupBy("part", "cell").agg(F.sum("n").alias("n")).toPandas()
    hist = [np.zeros(1 << w, np.int64) for w in width]
    for i in range(parts):
        own = found[found["part"] == i]
        hist[i][own["cell"]] = own["n"]
    del found
    held = spark.sparkContext.broadcast(hist)  # parts * 2**(64/parts) counts at most

    def entries(batches):
        counts = held.value
        near = [_within(h, w, distance - 1) for h, w in zip(counts, width, strict=True)]
        masks = [_masks(w, distance - 1) for w in width]
        probes = [[len(m) for m in ms] for ms in masks]
        for b in batches:
            for at in range(0, len(b), 4096):
                fp = b["fp"].to_numpy(np.int64)[at : at + 4096]
                values = [_value(fp, g) for g in groups]
                tau = allocate(values, near, probes, distance)
                rng = fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                for i in range(parts):
                    blocks = (counts[i] + BLOCK - 1) // BLOCK
                    sub = (rng.astype(np.int64) % blocks[values[i]]).astype(np.int64)
                    yield pd.DataFrame({"cell": (i << 32) + values[i], "sub": sub, "probe": np.zeros(len(fp), np.int8), "fp": fp})
                    for r in range(distance):
                        own = np.nonzero(tau[:, i] == r)[0]
                        if not len(own):
                            continue
                        cell = values[i][own][:, None] ^ masks[i][r][None, :]
                        who = np.broadcast_to(fp[own][:, None], cell.shape)
                        live = counts[i][cell] > 0
                        cell, who = cell[live], who[live]
                        times = blocks[cell]
                        cell, who = np.repeat(cell, times), np.repeat(who, times)
                        sub = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
                        yield pd.DataFrame({"cell": (i << 32) + cell, "sub": sub, "probe": np.ones(len(cell), np.int8), "fp": who})

    def verify(batches):
        kept_g, kept_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            if not len(b):
                continue
            # blocks of a cell are consecutive, and so one number orders (cell, sub)
            g = b["cell"].to_numpy(np.int64) * (1 << 20) + b["sub"].to_numpy(np.int64)
            f, probe = b["fp"].to_numpy(np.int64), b["probe"].to_numpy() == 1
            ig, xf = np.concatenate((kept_g, g[~probe])), np.concatenate((kept_f, f[~probe]))
            pg, pf = g[probe], f[probe]
            lo, hi = np.searchsorted(ig, pg, "left"), np.searchsorted(ig, pg, "right")
            size = hi - lo
            ends = np.cumsum(size)
            at = 0
            while at < len(pg):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
                n = size[at:to]
                who = np.repeat(pf[at:to], n)
                pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:to], n)
                x = who ^ xf[pos]
                ok = (np.bitwise_count(x.view(np.uint64)) <= distance) & (x != 0)
                if ok.any():
                    a, c = _stars(who[ok], xf[pos[ok]])
                    yield pd.DataFrame({"a": a, "b": c})
                at = to
            last = ig == g[-1]
            kept_g, kept_f = ig[last], xf[last]

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    dealt = (
        fps.repartition(n, "fp")
        .mapInPandas(entries, "cell bigint, sub bigint, probe byte, fp bigint")
        .repartition(n, "cell", "sub")
        .sortWithinPartitions("cell", "sub", "probe")
    )
    return dealt.mapInPandas(verify, "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, width: int = 4, parts: int = 4
) -> DataFrame:
    """One row per input row: (_f, _i, id, fp, component_id), the first two the key of ``numbered``.

    component_id: the smallest id reachable over links, the row's own included;
    null only if all ids there are null. Repeated rows and equal texts share a
    fingerprint and so a component. An empty table gives an empty table.
    """
    return _of_rows(numbered(docs), id_col, text_col, distance, width, parts)


def _of_rows(rows: DataFrame, id_col: str, text_col: str, distance: int = 4, width: int = 4, parts: int = 4) -> DataFrame:
    own = stage_table(fingerprints(keyed_texts(rows, id_col, text_col), width), "fingerprints")
    distinct = stage_table(own.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = connected_components(near_links(distinct.select("fp"), distance, parts))
    of = stage_table(
        distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")),
        "roots",
    )
    whole = stage_table(of.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "components")
    named = join_hubs(of, whole, "root", "size", "fp").select("fp", "component_id", "n")
    # a fingerprint of many copies is a hub too
    out = join_hubs(own, stage_table(named, "named"), "fp", "n", "_i")
    return out.select(*KEY, "id", "fp", "component_id")


def keep_first(rows: DataFrame, found: DataFrame, *group: Column) -> DataFrame:
    """Of numbered ``rows``, one of each group of ``found`` (_f, _i, id, ..): the one of the smallest id (nulls last), the first such row."""
    keys = [g.alias(f"g{i}") for i, g in enumerate(group)]
    first = found.groupBy(*keys).agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", *KEY)).alias("m"))
    # the rows that go are the fewer
    gone = found.select(*KEY).join(first.select(*[F.col(f"m.{k}").alias(k) for k in KEY]), KEY, "left_anti")
    return rows.join(light(stage_table(gone, "gone")), KEY, "left_anti").select("_all.*")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest id (nulls last), the first such row."""
    rows = numbered(docs)
    found = _of_rows(rows, id_col, text_col, **how)
    return keep_first(rows, found, F.coalesce(F.col("component_id"), F.col("fp")), F.col("component_id").isNull())


def op3_simhash_dedup(spark, sf_dir):
    from lumenframe.llm.common import documents

    out = near_duplicates(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
