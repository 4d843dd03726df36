"""SimHash near-duplicates at a Jaccard similarity of word shingles: the pipeline's dedup rule.

The index of op 3 comes first: SimHash fingerprints of the shingle sets, linked by
the generalised pigeonhole principle (``near_dedup.near_links``). Its links are
confirmed on the whole sets. Texts whose shingle sets have the similarity ``least``
differ in 9.7 of 64 bits on average (at 0.8), more where sets are small or odd, and
no radius that an index can probe holds them all. So what it cannot see follows by
prefixes (Xiao et al., PPJoin): in any fixed order of all shingles, two sets of
similarity ``least`` share one of their first n - ceil(least * n) + 1. The order puts
shingles that many texts hold last; it is read from a sketch of fixed size over one
row in ``EVERY``, which bears on speed alone.

Equal sets are one node. Nodes of a prefix shingle meet in the tasks, a block of them
at a time, and leave them as pairs only if they pass a length, a positional and a
parity filter. They meet twice: first each node leaves with its nearest by parities
alone, and up to ``FIRST`` of these pairs a node are verified with the index's links;
what they connect is one group by then and is not compared again.

Parity filter: a node's parities are 0/1 counts, modulo 2, of its shingles in a power
of two of cells. Two nodes' parities differ in at most as many cells as their sets
have shingles apart, so no pair of the similarity is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import KEY, drop_table, join_hubs, light, numbered, small_batches, stage_table
from lumenframe.llm.components import connected_components
from lumenframe.llm.near_dedup import _fold, _hashes, keep_first, keyed_texts, near_links

WIDTH, LEAST = 5, 0.8
#: Bits at which op 3's index links fingerprints.
DISTANCE = 4
#: Neighbours of a node that are verified first: those whose parities differ least.
FIRST = 8
#: Cells of the sketch (a power of two), rows of its pieces, and the rows that it reads: one in so many.
CELLS, PIECES, EVERY = 1 << 18, 64, 16
_SHIFT = np.uint64(64 - 18)
#: Words of 64 parities beside each prefix shingle; nodes of a shingle in one block; pairs compared at once.
WORDS, BLOCK, CHUNK = 8, 2048, 1 << 16


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(np.array(_hashes(text, width), np.uint64))


def _sketch(texts: DataFrame, width: int) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            own = [shingles(t, width) for t in b["text"].iloc[::EVERY]]
            total += np.bincount((np.concatenate(own) >> _SHIFT).astype(np.int64), minlength=CELLS) if own else 0
        yield pd.DataFrame({"piece": range(PIECES), "blob": [x.tobytes() for x in total.reshape(PIECES, -1)]})

    def add(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"piece": g["piece"].iloc[:1], "blob": [np.sum([np.frombuffer(x, np.int64) for x in g["blob"]], axis=0).tobytes()]})

    got = texts.select("text").mapInPandas(run, "piece int, blob binary").groupBy("piece").applyInPandas(add, "piece int, blob binary").toPandas()
    out = np.zeros((PIECES, CELLS // PIECES), np.int64)
    for p, x in zip(got["piece"], got["blob"], strict=True):
        out[p] = np.frombuffer(x, np.int64)
    return out.ravel()


def parities(s: np.ndarray) -> bytes:
    """Parities of a set's shingles in the power of two of cells that is next to twice their number, ``WORDS`` words at least."""
    cells = max(64 * WORDS, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(blob: bytes, words: int = WORDS) -> np.ndarray:
    """Parities in fewer cells."""
    x = np.frombuffer(blob, np.uint64)
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def apart(sizes, least: float):
    """At most so many shingles stand in one of two sets of the similarity alone. ``sizes``: of both together."""
    return sizes * ((1 - least) / (1 + least)) + 1e-6


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows in the order of (token, node): without repeats, those of tokens of two nodes or more. One row is held."""
    held, known = None, False
    for b in batches:
        if not len(b):
            continue
        b = b if held is None else pd.concat((held, b), ignore_index=True)
        t, node = b["token"].to_numpy(), b["node"].to_numpy()
        b = b[np.concatenate(([True], (t[1:] != t[:-1]) | (node[1:] != node[:-1])))]
        t = b["token"].to_numpy()
        same = t[1:] == t[:-1]
        before = np.concatenate(([known], same))
        yield b[:-1][before[:-1] | same]
        held, known = b[-1:], bool(before[-1])
    if known:
        yield held


def _met(batches: Iterator[pd.DataFrame], least: float, nearest: bool) -> Iterator[pd.DataFrame]:
    """Pairs of nodes that share a token and may have the similarity; ``nearest``: of each row the one nearest pair.

    Rows come by (token, sub, probe, n, node): each meets the block's rows before it that are no probes.
    """
    held = None
    for b in batches:
        if not len(b):
            continue
        start = 0 if held is None else len(held)
        b = b if held is None else pd.concat((held, b), ignore_index=True)
        t, sub, n, pos, node, root = (b[c].to_numpy(np.int64) for c in ("token", "sub", "n", "pos", "node", "root"))
        bits = np.frombuffer(b"".join(b["odd"]), np.uint64).reshape(-1, WORDS)
        group = np.concatenate(([0], np.cumsum((t[1:] != t[:-1]) | (sub[1:] != sub[:-1]))))
        index = np.nonzero(b["probe"].to_numpy() == 0)[0]
        who = np.arange(start, len(b))
        lo = np.searchsorted(group[index], group[who], "left")
        hi = np.minimum(np.searchsorted(group[index], group[who], "right"), np.searchsorted(index, who, "left"))
        ends, at = np.cumsum(hi - lo), 0
        while at < len(who):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
            k = (hi - lo)[at:to]
            y = np.repeat(who[at:to], k)
            x = index[np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[at:to], k)]
            after = np.minimum(n[x] - pos[x], n[y] - pos[y])
            need = np.ceil((n[x] + n[y]) * (least / (1 + least)) - 1e-9).astype(np.int64)
            ok = (root[x] != root[y]) & (np.minimum(n[x], n[y]) >= np.maximum(n[x], n[y]) * least - 1e-9) & (np.minimum(pos[x], pos[y]) + after >= need)
            x, y, after, need = x[ok], y[ok], after[ok], need[ok]
            far = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            ok = np.nonzero(far <= apart(n[x] + n[y], least))[0]
            if nearest and len(ok):
                ok = ok[np.lexsort((far[ok], y[ok]))]
                ok = ok[np.concatenate(([True], y[ok][1:] != y[ok][:-1]))]
            if len(ok):
                x, y = x[ok], y[ok]
                swap = (n[x] > n[y]) | (n[x] == n[y]) & (node[x] > node[y])
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                yield pd.DataFrame({"a": node[x], "b": node[y], "rest": after[ok] - 1, "need": need[ok], "far": far[ok]})
            at = to
        held = b[(group == group[-1]) & (b["probe"].to_numpy() == 0)]


def _verified(texts: DataFrame, unique: DataFrame, odds: DataFrame, pairs: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have the similarity: those that their parities leave are compared whole."""

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for x, y, both in zip(b["x"], b["y"], b["both"], strict=True):
                words = min(len(x), len(y)) // 8
                ok.append(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum() <= apart(both, least))
            yield b.loc[np.array(ok, bool), ["a", "b"]]

    end = lambda c, o: odds.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("parities").alias(o))
    beside = pairs.join(end("a", "x"), "a").join(end("b", "y"), "b").select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("both"))
    pairs = stage_table(beside.mapInPandas(likely, "a bigint, b bigint"), "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = stage_table(unique.join(ends, "node", "left_semi").select("node", "k.*"), "wanted")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "blob": [shingles(t, width).tobytes() for t in b["text"]]})

    held = stage_table(texts.join(light(wanted), KEY).select("node", "text").mapInPandas(sets, "node bigint, blob binary"), "sets")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for x, y in zip(b["x"], b["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield b.loc[np.array(ok, bool), ["a", "b"]]

    joined = pairs.join(held.select(F.col("node").alias("a"), F.col("blob").alias("x")), "a").join(
        held.select(F.col("node").alias("b"), F.col("blob").alias("y")), "b"
    )
    out = stage_table(joined.select("a", "b", "x", "y").mapInPandas(check, "a bigint, b bigint"), "links")
    drop_table(held)
    return out


def indexed(unique: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes by op 3's index: equal fingerprints, and one pair of nodes for each of its edges."""
    prints = stage_table(unique.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    first = lambda c, to: prints.select(F.col("fp").alias(c), F.col("first").alias(to))
    linked = near_links(prints.select("fp"), DISTANCE).join(first("a", "x"), "a").join(first("b", "y"), "b")
    equal = unique.select("node", "fp").join(prints, "fp").where("node <> first").select("first", "node")
    return linked.select("x", "y").union(equal).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """One row per input row: (_f, _i, id, group): rows of one group are connected by pairs of at least that similarity.

    Texts without words are equal. Null text is empty. An empty table gives an empty one.
    """
    return _of_rows(numbered(docs), id_col, text_col, width, least)


def _of_rows(rows: DataFrame, id_col: str, text_col: str, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    spark = rows.sparkSession
    small_batches(spark)
    texts = keyed_texts(rows, id_col, text_col)
    order = spark.sparkContext.broadcast(_sketch(texts, width))

    def node_of(s: np.ndarray) -> int:
        return xxhash.xxh64_intdigest(s.tobytes(), len(s))

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t, width) for t in b["text"]]
            yield b.drop(columns="text").assign(node=np.array(list(map(node_of, sets)), np.uint64).view(np.int64), fp=_fold(sets))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 100):
                tokens, node, size = [], [], []
                for t in b["text"].iloc[at : at + 100]:
                    s = shingles(t, width)
                    if len(s):
                        first = np.lexsort((s, order.value[(s >> _SHIFT).astype(np.int64)]))
                        tokens.append(s[first[: len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1]])
                        node.append(node_of(s))
                        size.append(len(s))
                if tokens:
                    n = [len(x) for x in tokens]
                    yield pd.DataFrame({
                        "token": np.concatenate(tokens).view(np.int64), "node": np.repeat(np.array(node, np.uint64).view(np.int64), n),
                        "n": np.repeat(np.array(size, np.int32), n), "pos": np.concatenate([np.arange(k, dtype=np.int32) for k in n]),
                    })

    def odd(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t, width) for t in b["text"]]
            blobs = [parities(s) for s in sets]
            yield pd.DataFrame({"node": b["node"], "n": [len(s) for s in sets], "parities": blobs, "odd": [folded(x).tobytes() for x in blobs]})

    own = stage_table(texts.mapInPandas(nodes, "_f bigint, _i bigint, id bigint, node bigint, fp bigint"), "nodes")
    # a row per node: copies are many rows of one
    unique = own.groupBy("node").agg(F.count("*").alias("rows"), F.min("fp").alias("fp"), F.min(F.struct(*KEY)).alias("k"))
    unique = stage_table(unique, "unique")
    schema = "token bigint, node bigint, n int, pos int"
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    dealt = texts.select("text").mapInPandas(prefixes, schema).repartition(spread, "token").sortWithinPartitions("token", "node")
    found = stage_table(dealt.mapInPandas(_shared, schema), "prefixes")
    some = stage_table(unique.join(found.select("node").distinct(), "node", "left_semi").select("node", "k.*"), "some")
    odds = stage_table(texts.join(light(some), KEY).select("node", "text").mapInPandas(odd, "node bigint, n int, parities binary, odd binary"), "odds")
    # a token of many nodes is cut into blocks; a node is in one of them and a probe in those after it
    hot = stage_table(found.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "hot")

    def met(root_of: DataFrame, nearest: bool) -> DataFrame:
        named = found.join(root_of, "node").join(light(hot), "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        named = named.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("sub", F.explode(F.sequence("block", F.col("blocks") - 1)))
        named = named.withColumn("probe", (F.col("sub") > F.col("block")).cast("int")).select("token", "sub", "probe", "n", "node", "pos", "root", "odd")
        named = named.repartition(spread, "token", "sub").sortWithinPartitions("token", "sub", "probe", "n", "node")
        return named.mapInPandas(lambda batches: _met(batches, least, nearest), "a bigint, b bigint, rest bigint, need bigint, far bigint")

    chain = met(odds.select("node", "odd", F.col("node").alias("root")), True).groupBy("a", "b").agg(F.min("far").alias("far"))
    chain = chain.withColumn("place", F.row_number().over(Window.partitionBy("b").orderBy("far", "a"))).where(F.col("place") <= FIRST).select("a", "b")
    first = _verified(texts, unique, odds, indexed(unique).union(chain).distinct(), width, least)
    roots = connected_components(first)
    rest = met(odds.select("node", "odd").join(roots, "node", "left").select("node", "odd", F.coalesce("root", "node").alias("root")), False)
    # all shared shingles up to the last of the prefixes are counted; after it, at most the shorter rest is shared
    rest = rest.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("rest").alias("left"), F.max("need").alias("need"), F.min("far").alias("far"))
    rest = stage_table(rest.where(F.col("c") + F.col("left") >= F.col("need")).select("a", "b", "c", "far"), "rest")
    best = rest.withColumn("place", F.row_number().over(Window.partitionBy("b").orderBy("far", F.desc("c"), "a"))).where(F.col("place") <= FIRST).select("a", "b")
    best = stage_table(best, "best")
    second = _verified(texts, unique, odds, best, width, least)
    # of the pairs that are left, those whose ends are not connected by now
    roots = stage_table(connected_components(first.union(second)), "roots")
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    left = rest.select("a", "b").join(best, ["a", "b"], "left_anti").join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    left = left.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    third = _verified(texts, unique, odds, left, width, least)
    roots = connected_components(first.union(second).union(third))
    # copies of a text share a node: a node of many rows is dealt over tasks
    of = unique.join(roots, "node", "left").select("node", F.col("rows").alias("n"), F.coalesce("root", "node").alias("group"))
    of = stage_table(of, "groups-of-nodes")
    return join_hubs(own, of, "node", "n", "_i").select(*KEY, "id", "group")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group: the one of the smallest id (nulls last), the first such row."""
    rows = numbered(docs)
    return keep_first(rows, stage_table(_of_rows(rows, id_col, text_col, **how), "groups"), F.col("group"))
