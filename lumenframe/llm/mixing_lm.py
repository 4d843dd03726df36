"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is a row of tokens: lower-cased words and an end. Frequent words (the
head, at most ``head`` of them), the end and an escape are leaves of a Huffman
tree; a token is coded by its path, one bit at a time. Each bit has predictors
from counts in hashed contexts: the tree node alone, with the last function
word, with the word before, and with the two words before. An escaped word
costs its share of the tail, or, if unseen, a novelty share and its spelling,
coded by the same machine with contexts of one to three bytes. The predictors'
log-odds are mixed with weights picked by a gate (how often the contexts were
seen), and an adaptive map refines the outcome. Each document starts from the
taught weights and map and goes on learning as it is coded: after every block of
its tokens (``edges``) both are updated from what was coded, so a block is coded
by what stood before it, and rows do not depend on each other. Every step is a
proper distribution, so ``score`` is a log10 probability of the text.

Gathered from the corpus: counts of all words (exact; one shuffle), and counts
of all context bits in tables whose size follows the number of learning tokens,
up to 2**``most_bits`` slots, which bounds a worker's memory. A slot has a check
byte, so contexts that meet in one do not mix: the more frequent stays, the other
has no prediction there. Seven eighths of the learning documents give the context
counts, one eighth, unseen by those, teaches the first weights and map; spelling
is learned in the same shares from all distinct words outside the head, in tables of its own. What is
broadcast is bounded: the head and the tables. Counts of tail words are joined,
never broadcast.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import documents, row_key, small_batches, stage_table, text_of

HEAD, LEAST_BITS, MOST_BITS, SPELLING_BITS, CHUNK_SLOTS, TOKENS_AT_ONCE = 1 << 16, 14, 22, 20, 1 << 14, 1 << 12
#: Learning tokens for each slot of a table, and learning tokens that one task counts (as a guide).
TOKENS_A_SLOT, TOKENS_A_TASK = 8, 8_000_000
#: Tokens whose pairs of context and symbol are made distinct together.
PAIRED_TOKENS = 1 << 21
END, ESC = 0, 1
CONTEXTS, GATES, RATE = 3, 32, 0.03
#: While coding: the rate, what a document's sums of squares start from, and the weight of the taught map.
OWN_RATE, OWN_START, MAP_WEIGHT = 0.05, 20.0, 60.0
CELLS = 32 * 33
#: The predictor that is always the same.
BIAS = 0.3
_M = np.uint32(0x9E3779B1)


@dataclass
class Head:
    """Frequent words by falling count, and the Huffman tree over them, the end (0) and the escape (1)."""

    words: list[bytes]
    counts: np.ndarray  # of end, escape, words
    n: int
    v: int
    novelty: float
    slot_bits: int = MOST_BITS  # of the tables that its paths are looked up in

    def __post_init__(self):
        size = len(self.counts)
        heap = [(max(int(c), 1), i) for i, c in enumerate(self.counts)]
        heapq.heapify(heap)
        child, weight = np.zeros((size - 1, 2), np.int64), np.zeros(2 * size - 1)
        weight[:size] = np.maximum(self.counts, 1)
        for k in range(size - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            child[k], weight[size + k] = (i, j), a + b
            heapq.heappush(heap, (a + b, size + k))
        paths: list = [None] * (2 * size - 1)
        paths[2 * size - 2] = ()
        nodes, bits, self.start, self.length = [], [], np.zeros(size, np.int64), np.zeros(size, np.int64)
        for k in range(size - 2, -1, -1):
            here = paths[size + k]
            for bit in (0, 1):
                paths[child[k, bit]] = (here, k, bit)
            paths[size + k] = None
        for s in range(size):
            own, p = [], paths[s]
            while p:
                own.append((p[1], p[2]))
                p = p[0]
            self.start[s] = len(nodes)
            self.length[s] = len(own)
            for node, bit in own[::-1]:
                nodes.append(node)
                bits.append(bit)
        self.nodes, self.bits = np.array(nodes, np.uint32), np.array(bits, np.uint8)
        share = weight[child[:, 1]] / np.maximum(weight[child].sum(axis=1), 1e-9)
        self.node_odds = np.log(share / (1 - share)).astype(np.float32)
        # leaves from left to right
        self.leaves, self.rank = np.zeros(size, np.int64), np.zeros(size, np.int64)
        below = [2 * size - 2]
        for k in range(size):
            while below[-1] >= size:
                below.extend(child[below.pop() - size][::-1].tolist())
            self.leaves[k] = below.pop()
        self.rank[self.leaves] = np.arange(size)
        self.lay_out()

    def lay_out(self) -> None:
        """What is looked up for each step of the paths. It follows from the rest and is not sent."""
        self.ids = {w: i + 2 for i, w in enumerate(self.words)} | {b"\n": END}
        odds = self.node_odds[self.nodes]
        # four steps of a path lie in one line of 16 slots: a key for the line, a place within it
        at, depth = np.arange(len(self.nodes)), np.arange(len(self.nodes)) - np.repeat(self.start, self.length)
        step, place = depth % 4, np.ones(len(self.nodes), np.int64)
        for k in range(3):
            later = np.nonzero(step > k)[0]
            place[later] = 2 * place[later] + self.bits[at[later] - step[later] + k]
        # what a step needs lies together: the line's key, the odds; then depth, bit and place
        self.steps = np.stack((self.nodes[at - step] * np.uint32(0xC2B2AE3D), odds.view(np.uint32)), axis=1).view(np.uint64).ravel()
        self.small = (np.minimum(depth, 15) << 8 | self.bits.astype(np.int64) << 4 | place).astype(np.uint16)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("ids", "steps", "small")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.lay_out()

    def tail(self) -> int:
        """Learning tokens outside the head."""
        return max(0, self.n - int(self.counts[END]) - int(self.counts[2:].sum()))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def coded_bytes(text: str) -> int:
    """Bytes that the code gives back: the lower-cased words with one blank between two."""
    words = words_of(text)
    return sum(map(len, words)) + max(0, len(words) - 1)


def _mix32(x: np.ndarray) -> np.ndarray:
    x = x * _M
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return x


def split_words(docs: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of ``words_of`` for some documents: (all words in order, how many each document has)."""
    return split_texts(pa.array([t.encode("utf-8", "surrogatepass") for t in docs], pa.binary()).view(pa.string()))


def split_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, n = lists.flatten(), np.diff(lists.offsets.to_numpy())
    real = pc.not_equal(words, "")  # white space at either end of a text gives empty ones
    kept = real.to_numpy(zero_copy_only=False)
    if not kept.all():
        ends = np.cumsum(n)
        words, n = words.filter(real), np.diff(np.concatenate(([0], np.cumsum(kept)))[np.concatenate(([0], ends))])
    return words, n


def word_bytes(words: pa.Array, n: np.ndarray) -> np.ndarray:
    """``coded_bytes`` of each document."""
    upto = np.concatenate(([0], np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64))))
    ends = np.cumsum(n)
    return upto[ends] - upto[ends - n] + np.maximum(n - 1, 0)


def encode(head: Head, docs: list[str]) -> tuple[list[bytes], list[str], np.ndarray]:
    """For each document: its symbols (bytes of uint32, the end last), its tail words in order, and its length."""
    return encode_words(head, *split_words(docs))


def encode_words(head: Head, words: pa.Array, n: np.ndarray) -> tuple[list[bytes], list[str], np.ndarray]:
    found = pc.index_in(words, value_set=pa.array(head.words, pa.binary()).view(pa.string()))
    ends = np.cumsum(n)
    sym = np.insert(pc.fill_null(found, ESC - 2).to_numpy().astype(np.int64) + 2, ends, END).astype(np.uint32)
    outside = found.is_null()
    cuts = np.concatenate(([0], np.cumsum(outside.to_numpy(zero_copy_only=False))))[np.concatenate(([0], ends))]
    tails = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words.filter(outside)), " ").to_pylist()
    n = n + 1
    ends = np.cumsum(n)
    return [sym[i:j].tobytes() for i, j in zip((ends - n).tolist(), ends.tolist(), strict=True)], tails, n


class Tokens:
    """Symbols of some encoded documents, and their contexts."""

    def __init__(self, syms: list[bytes], tails: list[str]):
        sym = np.frombuffer(b"".join(syms), np.uint32)
        self.sym, ctx = sym.astype(np.int64), sym.copy()
        self.tail = " ".join(t for t in tails if t).encode().split(b" ") if any(tails) else []
        ctx[sym == ESC] = np.array(list(map(zlib.crc32, self.tail)), np.uint32) | np.uint32(0x80000000)
        self.ends = np.cumsum([len(s) // 4 for s in syms])
        one = np.concatenate((np.zeros(1, np.uint32), ctx[:-1]))
        two = np.concatenate((np.zeros(2, np.uint32), ctx[:-2]))[: len(ctx)]
        two[one == END] = END
        # the last of the end and the 256 most frequent words
        common = (sym != ESC) & (sym < 258)
        last = np.maximum.accumulate(np.where(common, np.arange(len(ctx)), -1))
        last = np.concatenate((np.full(1, -1), last[:-1]))
        near = np.where(last >= 0, ctx[last], np.uint32(END))  # before the first of them: as after an end
        a = _mix32(one + np.uint32(1))
        self.hash = [_mix32(near + np.uint32(7919)) ^ np.uint32(0x1234567), a, _mix32(a ^ (two + np.uint32(104729)))]


def token_bits(head: Head, tok: Tokens, which: np.ndarray):
    """Bits of the tokens ``which``: (order-0 log-odds, hash of each context and node, bits, lengths, depth)."""
    own, pos, n = path_steps(head, tok.sym[which])
    steps, small = np.take(head.steps, pos).view(np.uint32), np.take(head.small, pos)
    key, place = steps[::2].copy(), line_place(head, small)
    hashes = [line_slots(np.take(h[which], own), key, place) for h in tok.hash]
    return steps[1::2].view(np.float32), hashes, step_bit(small), n, (small >> 8).astype(np.uint8)


def step_bit(small: np.ndarray) -> np.ndarray:
    return (small >> 4 & 1).astype(np.uint8)


def line_place(head: Head, small: np.ndarray) -> np.ndarray:
    return (small & np.uint16(15)).astype(np.uint32) << np.uint32(32 - head.slot_bits)


def line_slots(context: np.ndarray, key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hashes of contexts and tree nodes: those of one context and line differ in the lowest bits of their slots alone."""
    context ^= key
    x = _mix32(context)
    x ^= place
    return x


def path_steps(head: Head, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The paths of symbols: (which symbol, place among the head's steps, steps of each symbol)."""
    n = head.length[sym]
    own = np.repeat(np.arange(len(sym)), n)
    pos = np.arange(len(own))
    pos += (head.start[sym] - np.cumsum(n) + n)[own]
    return own, pos, n


def pair_bits(head: Head, hashes: np.ndarray, sym: np.ndarray, size: int = 1 << 13):
    """Path bits under one context, for distinct pairs of context and symbol: (hashes, bits, times).

    Pairs stand in the tree's order, so paths of one context that share their first steps follow each other.
    Where pairs are much fewer than tokens, such shared steps are one as well.
    """
    pairs, times = np.unique(hashes.astype(np.uint64) << np.uint64(32) | head.rank[sym].astype(np.uint64), return_counts=True)
    shared = 2 * len(pairs) < len(sym)
    for at in range(0, len(pairs), size):
        part, n = pairs[at : at + size], times[at : at + size]
        h, own = (part >> np.uint64(32)).astype(np.uint32), head.leaves[(part & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        if shared:
            h, pos, n = shared_steps(head, h, own, n)
        else:
            own, pos, _ = path_steps(head, own)
            h, n = np.take(h, own), np.take(n, own)
        small = np.take(head.small, pos)
        yield line_slots(h, np.take(head.steps, pos).view(np.uint32)[::2], line_place(head, small)), step_bit(small), n


def shared_steps(head: Head, h: np.ndarray, sym: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Step by step, neighbouring pairs of one context and the same steps so far are one: (context, step, times)."""
    pos, left = head.start[sym], head.length[sym]
    new, out = np.concatenate((np.ones(1, bool), h[1:] != h[:-1])), []
    while len(pos):
        bit = np.take(head.bits, pos)
        new[1:] |= bit[1:] != bit[:-1]
        first = np.nonzero(new)[0]
        out.append((h[first], pos[first], np.add.reduceat(n, first)))
        left = left - 1
        on = np.nonzero(left)[0]
        h, pos, left, n, new = h[on], pos[on] + 1, left[on], n[on], new[on]
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def spelling_bits(words: list[bytes]):
    """The same for the bytes of words and their end, with contexts of one to three bytes."""
    raw = np.frombuffer(b"".join(w + b" " for w in words), np.uint8).astype(np.uint32)
    n = np.array([len(w) + 1 for w in words], np.int64)
    first = np.repeat(np.cumsum(n) - n, n)
    place = np.arange(len(raw)) - first
    before = [np.where(place >= k, np.concatenate((np.zeros(k, np.uint32), raw[:-k] if k < len(raw) else raw[:0]))[: len(raw)], 0) for k in (1, 2, 3)]
    h, hashes = np.full(len(raw), 0x5EED, np.uint32), []
    node = (raw[:, None] | np.uint32(256)) >> np.arange(8, 0, -1, dtype=np.uint32)[None, :]
    bits = ((raw[:, None] >> np.arange(7, -1, -1, dtype=np.uint32)[None, :]) & 1).astype(np.uint8).ravel()
    key = (node * np.uint32(0xC2B2AE3D)).ravel()
    for b in before:
        h = _mix32(h ^ (b.astype(np.uint32) + np.uint32(1)))
        hashes.append(_mix32(np.repeat(h, 8) ^ key))
    return np.zeros(len(bits), np.float32), hashes, bits, n * 8, np.tile(np.arange(8), len(raw))


class Counts:
    """Bit counts by slot of one context's table; a slot belongs to one check byte.

    A slot is one number: the check byte above, then 28 bits each for ones and zeros. Contexts that
    come to a slot of another take it over while that has been seen less than twice.
    """

    def __init__(self, bits: int):
        self.shift = np.uint32(32 - bits)
        self.state = np.zeros(1 << bits, np.int64)

    def add(self, hashes: np.ndarray, bits: np.ndarray, times: np.ndarray | int = 1) -> None:
        slot, check = (hashes >> self.shift).astype(np.int64), hashes.astype(np.uint64)
        check <<= np.uint64(56)
        check = check.view(np.int64)
        got = np.take(self.state, slot)
        got ^= check  # the highest byte is zero in a slot of one's own
        own = got.view(np.uint64) < np.uint64(1 << 56)
        more = np.array([1, 1 << 28])[bits]
        more *= times
        if own.all():
            np.add.at(self.state, slot, more)
            return
        other = np.nonzero(~own)[0]
        less = got[other]
        less &= (1 << 56) - 1
        other = other[(less <= 1) | (less == 1 << 28)]
        theirs, mark = slot[other], check[other]
        self.state[theirs] = mark
        own[other] = self.state[theirs] == mark  # of several, the last has it
        own = np.nonzero(own)[0]
        np.add.at(self.state, slot[own], more[own])


def unpacked(state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(check, counts of zeros and ones) of slots."""
    low = (1 << 28) - 1
    return ((state >> 56) & 255).astype(np.uint8), np.stack((state & low, (state >> 28) & low), axis=1).astype(np.uint32)


def packed_counts(check: np.ndarray, n: np.ndarray) -> bytes:
    """Slots to send: a count over 16 bits is scaled down with its other."""
    most = n.max(axis=1)
    big = np.nonzero(most > 65535)[0]
    if len(big):
        n = n.copy()
        n[big] = (n[big].astype(np.float64) * (65535 / most[big])[:, None]).astype(n.dtype)
    low, high = (np.ascontiguousarray(x) for x in ((n.T & 255).astype(np.uint8), (n.T >> 8).astype(np.uint8)))
    counts = zlib.compress(low.tobytes() + high.tobytes(), 1)  # high bytes are mostly zeros
    return len(counts).to_bytes(4, "little") + counts + check[most > 0].tobytes()


def read_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Check bytes, of slots that were met, and counts."""
    at = 4 + int.from_bytes(blob[:4], "little")
    raw = np.frombuffer(zlib.decompress(blob[4:at]), np.uint8).reshape(2, 2, -1).astype(np.uint16)
    n = (raw[0] | raw[1] << 8).T
    check = np.zeros(len(n), np.uint8)
    check[n.any(axis=1)] = np.frombuffer(blob[at:], np.uint8)
    return check, n


def joined(checks: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tables of several tasks in one, in the order given: equal checks add up, of others the larger count stays."""
    check, n = checks[0].copy(), counts[0].astype(np.int64)
    for c, m in zip(checks[1:], counts[1:], strict=True):
        same = c == check
        n[same] += m[same]
        more = ~same & (m.sum(axis=1) > n.sum(axis=1))
        check[more], n[more] = c[more], m[more]
    return check, np.minimum(n, (1 << 31) - 1).astype(np.uint32)


def packed_odds(check: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each slot in 32 bits: log-odds in 4096ths, how often it was seen (0..3), the check byte."""
    m = n.astype(np.float64)
    total = m.sum(axis=1)
    odds = np.round(np.clip(np.log((m[:, 1] + 0.4) / (m[:, 0] + 0.4)), -7.9, 7.9) * 4096).astype(np.int32)
    seen = (total >= 2).astype(np.int32) + (total >= 16) + (total >= 256)
    return ((odds << 16) | (seen << 8) | check).astype(np.int32)


def edges(first: int, units: int) -> list[int]:
    """Where a document's blocks end: ``first`` units, as many again, twice as many, up to 16 times, then always so many."""
    out, size = [0, first], first
    while out[-1] < units:
        out.append(out[-1] + size)
        size = min(2 * size, 16 * first)
    return out


def log10_products(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 of the product of each unit's probabilities, which are 1e-9 at least: few at a time, so that none vanishes."""
    starts = np.cumsum(sizes) - sizes
    if sizes.max() <= 32:
        return np.log10(np.multiply.reduceat(p, starts))
    return np.add.reduceat(np.log10(p), starts)


class Mixer:
    """Gated weights over the predictors, and the refinement map: as taught, then learning on in each document."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables  # of words, then of spelling
        self.w = np.tile(np.array([0.4, 0.3, 0.3, 0.2, 0.0]), (GATES, 1))
        self.g2 = np.full((GATES, CONTEXTS + 2), 1.0)
        self.map_n, self.map_1 = np.zeros(CELLS), np.zeros(CELLS)

    def inputs(self, bits, spelled: bool):
        """(predictors by bit, gate, row of the map)."""
        first, hashes, _, _, depth = bits
        x, gate = np.empty((CONTEXTS + 2, len(first))), np.full(len(first), 16 * spelled)
        x[0], x[-1] = first, BIAS
        for k in range(CONTEXTS):
            table = self.tables[k + CONTEXTS * spelled]
            got = np.take(table, hashes[k] >> np.uint32(33 - len(table).bit_length()))
            got *= (got ^ hashes[k].view(np.int32)).astype(np.uint8) == 0  # another context's slot says nothing
            np.multiply(got >> 16, 1 / 4096, out=x[k + 1])
            if k:
                gate += (got >> (10 - 2 * k)) & (3 if k == 1 else 12)
        return x, gate, np.minimum(depth, 15).astype(np.int64) + 16 * spelled

    @staticmethod
    def mixed(x, w, spot):
        """Log-odds of each bit: its predictors under the weights (predictor, spot) of its spot."""
        z = np.take(w[-1], spot)
        z *= BIAS
        for k in range(CONTEXTS + 1):
            part = np.take(w[k], spot)
            part *= x[k]
            z += part
        return np.clip(z, -12, 12, out=z)

    @staticmethod
    def cell(z, row):
        at = z * 2
        at += 16.5
        np.clip(at, 0.5, 32.5, out=at)
        cell = at.astype(np.int64)
        cell += row * 33
        return cell

    def learn(self, bits, spelled: bool) -> None:
        """Teach the first weights and map, in small steps over many documents."""
        x, gate, row = self.inputs(bits, spelled)
        y = bits[2]
        for at in range(0, len(y), 16384):
            part = slice(at, at + 16384)
            z = self.mixed(x[:, part], self.w.T, gate[part])
            err = y[part] - 1 / (1 + np.exp(-z))
            cell = self.cell(z, row[part])
            self.map_n += np.bincount(cell, minlength=CELLS)
            self.map_1 += np.bincount(cell, weights=y[part], minlength=CELLS)
            for k in range(CONTEXTS + 2):
                g = np.bincount(gate[part], weights=err * x[k, part], minlength=GATES)
                self.g2[:, k] += g * g
                self.w[:, k] += RATE * g / np.sqrt(self.g2[:, k])

    def finish(self) -> None:
        centre = np.tile(1 / (1 + np.exp(-(np.arange(33) - 16) / 2)), 32)
        self.taught = (self.map_1 + 8 * centre) / (self.map_n + 8)

    def fresh(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The state that ``n`` documents start from: weights and sums of squares by predictor, then by document and gate; the map by document.

        Made here, not from arrays that were sent: of an unpickled type ``np.add.at`` takes 25 times as long.
        """
        w, map_1 = np.empty((CONTEXTS + 2, n, GATES)), np.empty((n, CELLS))
        w[:], map_1[:] = self.w.T[:, None, :], self.taught * MAP_WEIGHT
        return w.reshape(CONTEXTS + 2, -1), np.full((CONTEXTS + 2, n * GATES), OWN_START), np.full(n * CELLS, MAP_WEIGHT), map_1.ravel()

    def code(self, doc: np.ndarray, bits_of, spelled: bool, first: int = 32) -> np.ndarray:
        """log10 probability of each unit (token or word), learning on within its document.

        ``doc`` has each unit's document, in rising order; ``bits_of`` gives the bits of units by their numbers.
        """
        out = np.zeros(len(doc))
        if not len(doc):
            return out
        starts = np.concatenate(([0], np.nonzero(np.diff(doc))[0] + 1))
        length = np.diff(np.concatenate((starts, [len(doc)])))
        order = np.argsort(-length, kind="stable")  # the longest first: those still going are at the front
        starts, length = starts[order], length[order]
        w, g2, map_n, map_1 = self.fresh(len(starts))
        steps = edges(first, int(length[0]))
        for at, to in zip(steps[:-1], steps[1:], strict=True):
            going = int(np.searchsorted(-length, -at, "left"))
            if not going:
                break
            n = np.minimum(length[:going], to) - at
            own = np.repeat(np.arange(going), n)
            unit = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[:going] + at, n)
            for a in range(0, len(unit), TOKENS_AT_ONCE):
                # a part of the block: documents whole, so that no document is updated within its block
                lo = a if a == 0 else int(np.searchsorted(own, own[a], "left"))
                hi = len(unit) if a + TOKENS_AT_ONCE >= len(unit) else int(np.searchsorted(own, own[a + TOKENS_AT_ONCE], "left"))
                if hi <= lo:
                    continue
                which, docs = unit[lo:hi], own[lo:hi]
                bits = bits_of(which)
                x, gate, row = self.inputs(bits, spelled)
                y, sizes = bits[2], bits[3]
                y = y.astype(np.float64)
                of = np.repeat(docs, sizes)
                spot = of * GATES
                spot += gate
                z = self.mixed(x, w, spot)
                cell = self.cell(z, row)
                of *= CELLS
                cell += of
                np.negative(z, out=z)
                np.exp(z, out=z)
                z += 1
                mixed = np.divide(1, z, out=z)
                p = np.take(map_1, cell)
                p /= np.take(map_n, cell)
                p += mixed
                p *= 0.5
                p += y
                p -= 1
                out[which] = log10_products(np.maximum(np.abs(p, out=p), 1e-9, out=p), sizes)  # p or 1 - p, as the bit was
                # learn from what was coded
                np.add.at(map_n, cell, 1.0)
                np.add.at(map_1, cell, y)
                low, span = int(docs[0]) * GATES, (int(docs[-1]) - int(docs[0]) + 1) * GATES
                here = slice(low, low + span)
                err = np.subtract(y, mixed, out=mixed)
                x[-1] = BIAS
                x *= err
                # four sums a spot, taken in turn: bits that follow each other need not wait for one sum
                spot -= low
                spot *= 4
                spot += np.arange(len(spot)) & 3
                for k in range(CONTEXTS + 2):
                    g = np.bincount(spot, weights=x[k], minlength=4 * span).reshape(-1, 4).sum(axis=1)
                    g2[k, here] += g * g
                    w[k, here] += OWN_RATE * g / np.sqrt(g2[k, here])
        return out


def _groups(batches: Iterator[pd.DataFrame], size: int = 1 << 18) -> Iterator[pd.DataFrame]:
    """Rows in groups of about ``size`` symbols."""
    for b in batches:
        lengths = np.array([len(x) // 4 for x in b["syms"]], np.int64)
        for _, part in b.groupby(np.cumsum(lengths) // size, sort=False):
            yield part


def _slices(tok: Tokens) -> Iterator[np.ndarray]:
    for at in range(0, len(tok.sym), TOKENS_AT_ONCE):
        yield np.arange(at, min(at + TOKENS_AT_ONCE, len(tok.sym)))


def _tail_words(batches: Iterator[pd.DataFrame], head: Head, teach: bool) -> Iterator[list[bytes]]:
    """Words outside the head, in parts: the eighth that teaches, or the others."""
    for b in batches:
        words = [w for w in (x.encode() for x in b["word"]) if w not in head.ids and (zlib.crc32(w) % 8 == 0) == teach]
        for at in range(0, len(words), 8192):
            yield words[at : at + 8192]


def word_counts(learn: DataFrame) -> DataFrame:
    """(word, c) over (text); the end is the word of one line feed."""

    def total(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for b in batches:
            got = pc.value_counts(split_texts(b.column(0))[0])
            words, n = pa.concat_arrays([got.field("values"), pa.array(["\n"])]), pa.concat_arrays([got.field("counts"), pa.array([b.num_rows])])
            parts.append(pa.table({"word": words, "c": n}))
            rows += len(words)
            if rows > 1_000_000:
                parts = [total(parts)]
                rows = parts[0].num_rows
                if rows > 300_000:
                    yield from parts[0].to_batches(65536)
                    parts, rows = [], 0
        if parts:
            yield from total(parts).to_batches(65536)

    return learn.select("text").mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def read_head(counts: DataFrame, most: int) -> Head:
    """The words of the largest counts: all of those above a cut at which at most ``most`` are left."""
    real = counts.where("word <> '\n'")
    level = F.floor(F.log2("c") * 16).cast("int")
    rows = real.groupBy(level.alias("level")).agg(
        F.count("*").alias("v"), F.sum("c").alias("n"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("once")
    ).collect()
    rows = sorted(((r["level"], r["v"], r["n"], r["once"]) for r in rows), reverse=True)
    cut, held = 10**9, 0
    for lv, v, _, _ in rows:
        if held + v > most:
            break
        cut, held = lv, held + v
    top = real.where(level >= cut).toPandas().sort_values(["c", "word"], ascending=[False, True])  # at most ``most``
    end = (counts.where("word = '\n'").first() or [0, 0])[1]
    n, v = sum(r[2] for r in rows) + end, sum(r[1] for r in rows) + (end > 0)
    tail = n - end - int(top["c"].sum())
    once = sum(r[3] for r in rows if r[0] < cut)
    novelty = min(0.9, max(0.001, once / tail)) if tail else 0.9
    return Head([w.encode() for w in top["word"]], np.array([end, tail + 1, *top["c"]], np.int64), n, v, novelty)


def table_bits(tokens: int, most: int = MOST_BITS) -> int:
    """The tables' size: a slot for every TOKENS_A_SLOT learning tokens, within LEAST_BITS and ``most``."""
    return min(most, max(LEAST_BITS, (max(tokens, 1) // TOKENS_A_SLOT).bit_length()))


def bit_counts(learn: DataFrame, words: DataFrame, head, bits: tuple[int, int], tasks: int) -> list[np.ndarray]:
    """The tables of all contexts, packed: of words from (syms, tail), of spelling from the distinct (word)."""

    def blobs(tables: list[Counts], first: int) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        for k, t in enumerate(tables):
            for at in range(0, len(t.state), CHUNK_SLOTS):
                part = t.state[at : at + CHUNK_SLOTS]
                if part.any():
                    row = {"context": [first + k], "chunk": [at // CHUNK_SLOTS], "part": [task // 32], "task": [task]}
                    yield pd.DataFrame(row | {"blob": [packed_counts(*unpacked(part))]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, tables = head.value, [Counts(bits[0]) for _ in range(CONTEXTS)]
        held, size = [], 0

        def take() -> None:
            sym = np.concatenate([t.sym for t in held])
            for k in range(CONTEXTS):
                for got in pair_bits(h, np.concatenate([t.hash[k] for t in held]), sym):
                    tables[k].add(*got)
            held.clear()

        for b in _groups(batches, PAIRED_TOKENS // 2):
            held.append(Tokens(b["syms"].tolist(), b["tail"].tolist()))
            held[-1].tail, size = [], size + len(held[-1].sym)
            if size >= PAIRED_TOKENS:
                take()
                size = 0
        if held:
            take()
        yield from blobs(tables, 0)

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [Counts(bits[1]) for _ in range(CONTEXTS)]
        for ws in _tail_words(batches, head.value, False):
            got = spelling_bits(ws)
            for k in range(CONTEXTS):
                tables[k].add(got[1][k], got[2])
        yield from blobs(tables, CONTEXTS)

    def total(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        own = [read_counts(x) for x in g.sort_values("task")["blob"]]
        return joined([c for c, _ in own], [m for _, m in own])

    def join(g: pd.DataFrame) -> pd.DataFrame:
        return g.iloc[:1].assign(blob=[packed_counts(*total(g))])

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"context": g["context"].iloc[:1], "chunk": g["chunk"].iloc[:1], "blob": [packed_odds(*total(g)).tobytes()]})

    schema = "context int, chunk int, part int, task int, blob binary"
    rows = learn.select("syms", "tail").coalesce(tasks).mapInPandas(count, schema)
    rows = rows.union(words.select("word").coalesce(max(1, tasks // 8)).mapInPandas(spell, schema))
    if tasks > 64:  # in two steps, so that no group grows with the tasks
        rows = rows.groupBy("context", "chunk", "part").applyInPandas(join, schema)
    got = rows.groupBy("context", "chunk").applyInPandas(pack, "context int, chunk int, blob binary").toPandas()  # 4 bytes a slot
    tables = [np.zeros(1 << b, np.int32) for b in bits for _ in range(CONTEXTS)]
    for k, c, x in zip(got["context"], got["chunk"], got["blob"], strict=True):
        tables[k][c * CHUNK_SLOTS : (c + 1) * CHUNK_SLOTS] = np.frombuffer(x, np.int32)
    return tables


def learn_mixer(teach: DataFrame, words: DataFrame, head, tables) -> Mixer:
    """Each task learns online over its documents, or words; weights are averaged by bits, refinement counts added."""
    shapes = (GATES, CONTEXTS + 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, m = head.value, Mixer(tables.value)
        for b in _groups(batches):
            tok = Tokens(b["syms"].tolist(), b["tail"].tolist())
            for which in _slices(tok):
                m.learn(token_bits(h, tok, which), False)
        yield from blob_of(m)

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Mixer(tables.value)
        for ws in _tail_words(batches, head.value, True):
            m.learn(spelling_bits(ws), True)
        yield from blob_of(m)

    def blob_of(m: Mixer) -> Iterator[pd.DataFrame]:
        if m.map_n.any():
            used = np.sqrt(np.maximum(m.g2 - 1, 0)) + 1e-9  # a task weighs a gate by how much it met it
            blob = np.concatenate(((m.w * used).ravel(), used.ravel(), m.map_n, m.map_1)).astype(np.float64)
            yield pd.DataFrame({"part": [TaskContext.get().partitionId() % 32], "blob": [blob.tobytes()]})

    def add(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": g["part"].iloc[:1], "blob": [np.sum([np.frombuffer(x) for x in g["blob"]], axis=0).tobytes()]})

    rows = teach.select("syms", "tail").mapInPandas(run, "part int, blob binary").union(words.select("word").mapInPandas(spell, "part int, blob binary"))
    got = rows.groupBy("part").applyInPandas(add, "part int, blob binary").toPandas()
    m = Mixer(tables.value)
    if len(got):
        got = got.sort_values("part")
        total, k = np.sum([np.frombuffer(x) for x in got["blob"]], axis=0), GATES * (CONTEXTS + 2)
        m.w = (total[:k] / total[k : 2 * k]).reshape(shapes)
        m.map_n, m.map_1 = total[2 * k : 2 * k + CELLS], total[2 * k + CELLS :]
    m.finish()
    m.tables = None  # workers have them already
    return m


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD, most_bits: int = MOST_BITS) -> DataFrame:
    """A row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, outcome_score, bits_per_byte.

    Null text is empty (its end is a token); a null id is the text ''. Repeated
    rows are learned from as often as they stand. Without learning documents
    every count is zero. An empty table gives an empty one. bits_per_byte is
    null for a text without words.

    ``score`` is the log10 probability of the whole text, of its lower-cased words
    with one blank between two: unseen words take the novelty share and are spelled out, in the order
    of their bytes. ``bits_per_byte`` is the same in bits over the bytes of those words and blanks: letter
    case and the kinds and runs of white space are not coded, and so not among the bytes.
    ``outcome_score`` is over the outcomes that the base has: seen words, the
    end, and one outcome for all unseen words, with add-one shares in the tail.
    """
    spark = docs.sparkSession
    small_batches(spark)
    code = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    src = docs.select(
        row_key().alias("row"), F.col(id_col).alias("id"), text_of(text_col).alias("text"), (code % 7 == 2).alias("held_out"),
        (F.floor(code / 7) % 8).cast("int").alias("fold"),
    )
    counts = stage_table(word_counts(src.where("not held_out")), "words")
    top = read_head(counts, head_words)
    sizes = table_bits(top.n, most_bits), table_bits(64 * top.v, min(most_bits, SPELLING_BITS))
    top.slot_bits = sizes[0]
    head = spark.sparkContext.broadcast(top)
    id_type = dict(src.dtypes)["id"]

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                words = split_words(part["text"].tolist())
                syms, tails, n = encode_words(head.value, *words)
                size = word_bytes(*words)
                yield part.drop(columns="text").assign(
                    n_tokens=n, n_bytes=size, syms=syms, tail=pd.Series(tails, dtype=object, index=part.index)
                )

    given = f"row bigint, id {id_type}, held_out boolean, fold int, n_tokens bigint, n_bytes bigint"
    coded = src.select("row", "id", "held_out", "fold", "text").mapInPandas(tokens, given + ", syms binary, tail string")
    coded = stage_table(coded, "symbols")  # a tenth of the texts' size, read three times
    learn = coded.where("not held_out")
    tasks = max(8, -(-top.n // TOKENS_A_TASK))
    tables = spark.sparkContext.broadcast(bit_counts(learn.where("fold <> 0"), counts, head, sizes, tasks))
    model = spark.sparkContext.broadcast(learn_mixer(learn.where("fold = 0"), counts, head, tables))

    def ready() -> Mixer:
        if model.value.tables is None:
            model.value.tables = [np.array(t) for t in tables.value]  # numpy's own memory has large pages, what was sent has not
        return model.value

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, m = head.value, ready()
        log_c = np.log10(h.counts.astype(np.float64) + 1)
        for b in _groups(batches):
            tok = Tokens(b["syms"].tolist(), b["tail"].tolist())
            starts = np.concatenate(([0], tok.ends[:-1]))
            doc = np.repeat(np.arange(len(b)), np.diff(np.concatenate(([0], tok.ends))))
            said = m.code(doc, lambda which, tok=tok: token_bits(h, tok, which), False)
            base = np.where(tok.sym == ESC, 0.0, log_c[tok.sym])
            known = (tok.sym != ESC) & (h.counts[tok.sym] > 0)
            yield b.drop(columns="syms").assign(
                n_known=np.add.reduceat(known.astype(np.int64), starts),
                base=np.add.reduceat(base, starts),
                score=np.add.reduceat(said, starts),
            )

    cols = f"row bigint, id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, n_bytes bigint"
    scored = coded.select("row", "id", "held_out", "n_tokens", "n_bytes", "syms", "tail")
    first = scored.mapInPandas(run, cols + ", tail string")
    # a row without tail words has one key of its own, so that no key is hot
    keys = [c.split()[0] for c in cols.split(", ")]
    word = F.posexplode(F.when(F.col("tail") == "", F.array(F.concat(F.lit(" "), F.col("row").cast("string")))).otherwise(F.split("tail", " ")))
    flat = first.select(*keys, word.alias("pos", "word"))
    # the row's own columns travel with its first word only
    flat = flat.select("row", "word", *[F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in keys if c != "row"])
    is_word = ~F.col("word").startswith(" ")
    tail_types = max(0, top.v - len(top.words) - (int(top.counts[END]) > 0))
    plain = F.lit(float(-np.log10(top.tail() + tail_types + 1)))
    share = F.lit(float(np.log10(max(1e-9, 1 - top.novelty)) - np.log10(max(1, top.tail()))))
    joined = flat.join(counts.where("word <> '\n'"), "word", "left")
    seen = is_word & F.col("c").isNotNull()
    summed = joined.groupBy("row").agg(
        *[F.max(c).alias(c) for c in keys if c != "row"],
        F.count_if(seen).alias("more"),
        F.coalesce(F.sum(F.when(seen, F.log10(F.col("c") + 1))), F.lit(0.0)).alias("tail_base"),
        F.coalesce(F.sum(F.when(is_word, F.log10(F.coalesce("c", F.lit(0)) + 1) + plain)), F.lit(0.0)).alias("tail_score"),
        F.coalesce(F.sum(F.when(seen, F.log10("c") + share)), F.lit(0.0)).alias("tail_coded"),
        F.array_join(F.sort_array(F.collect_list(F.when(is_word & F.col("c").isNull(), F.col("word")))), " ").alias("novel"),
    )

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = ready()
        novelty = float(np.log10(head.value.novelty))
        for b in batches:
            words = [x.encode().split(b" ") if x else [] for x in b["novel"]]
            n = np.array([len(w) for w in words], np.int64)
            flat_words, own = [w for ws in words for w in ws], np.repeat(np.arange(len(b)), n)
            said = m.code(own, lambda which, ws=flat_words: spelling_bits([ws[i] for i in which.tolist()]), True, 8)
            yield b.drop(columns="novel").assign(novel=np.bincount(own, weights=said + novelty, minlength=len(b)) if len(own) else np.zeros(len(b)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in summed.schema if f.name != "novel") + ", novel double"
    out = summed.mapInPandas(spell, schema)
    total = F.lit(float(np.log10(top.n + top.v + 1)))
    coded_score = F.col("score") + F.col("tail_coded") + F.col("novel")
    return out.select(
        "id", "held_out", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(top.n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("tail_base") - F.col("n_tokens") * total).alias("base_score"), coded_score.alias("score"), (F.col("score") + F.col("tail_score")).alias("outcome_score"),
        F.when(F.col("n_bytes") > 0, -coded_score / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op2_context_mixing_lm(spark, sf_dir):
    return score(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
