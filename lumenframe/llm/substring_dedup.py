"""Removal of passages that repeat: every word of a window of words that also starts earlier, in its document or another.

Super-k-mers. A window's minimiser is the least hash among its runs of ``SEED``
words; ties go to the leftmost. Consecutive windows with the same minimiser (the
same place, not just the same hash) are one super-k-mer: it travels as one packed
string to the minimiser's bucket. Equal windows have equal minimisers at the same
distance, so they meet in one bucket, where rows are sorted and windows compared
whole: nothing rests on a hash.

Packing. Words are replaced by codes of one or two bytes if they are among the
corpus' most frequent (``CODED`` at most, counted over all texts), and are
spelled out with their length otherwise. The code only makes strings shorter.

Hot passages. A scan task keeps up to ``HELD`` super-k-mers; of equal ones the
later go no further, as their windows all repeat. In a bucket equal super-k-mers
stand next to each other, so a run of any length needs one row of memory. A
minimiser with over ``GROUP`` distinct super-k-mers hands its windows on, to be
grouped by their whole content with minima on the map side.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import documents, drop_table, let, numbered, small_batches, stage_table, text_of
from lumenframe.plans.staged import stored_bytes

WINDOW, SEED = 20, 3
#: Words with codes: ONE of one byte, the rest of two. 255 spells a word.
ONE, CODED = 100, 100 + 155 * 256
LONGEST_CODED, COUNTED = 40, 1 << 18
HELD, GROUP, GROUP_BYTES = 50_000, 4096, 16 << 20
#: Marks that a join with texts may broadcast, in bytes as stored.
LIGHT_BYTES = 4 << 20
LEAST_ID = -(1 << 63)
PLACE = ["d", "f", "i", "start"]


def local_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow step: short words with their counts. Of each ``COUNTED`` distinct words those met once are left out: the code is for frequent ones."""
    schema = pa.schema([("w", pa.binary()), ("n", pa.int64())])

    def out() -> pa.RecordBatch:
        rows = [(w, n) for w, n in counts.items() if n > 1 and len(w) <= LONGEST_CODED]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], schema=schema)

    counts = Counter()
    for b in batches:
        for t in b.column("text").cast(pa.binary()):
            counts.update(t.as_py().split())
        if len(counts) > COUNTED:
            yield out()
    yield out()


def frequent_words(docs: DataFrame) -> list[bytes]:
    """The most frequent short words of all texts, most frequent first: at most ``CODED`` reach the driver.

    They bear on the length of packed strings alone, never on the result.
    """
    counted = stage_table(docs.select("text").mapInArrow(local_counts, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n")), "word-counts")
    step = F.floor(F.log2("n") * 16)
    sizes = {r["k"]: r["c"] for r in counted.groupBy(step.alias("k")).agg(F.count("*").alias("c")).collect()}  # 16 steps a power of two
    least, room = None, CODED
    for k in sorted(sizes, reverse=True):
        room -= sizes[k]
        if room < 0:
            break
        least = k
    top = [] if least is None else counted.where(step >= least).collect()
    drop_table(counted)
    return [bytes(r["w"]) for r in sorted(top, key=lambda r: (-r["n"], bytes(r["w"])))]


class Vocabulary(dict):
    """Numbers of words as a task meets them, with their codes, code lengths and hashes."""

    def __init__(self, frequent: list[bytes]):
        self.short = {w: bytes([i]) if i < ONE else bytes([ONE + (i - ONE) // 256, (i - ONE) % 256]) for i, w in enumerate(frequent)}
        self.start()

    def start(self) -> None:
        self.clear()
        self.codes, self.hashes, self.lengths = [], np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self.codes)
        code = self.short.get(word)
        if code is None:
            n = len(word)
            code = (b"\xff" + bytes([n]) if n < 255 else b"\xff\xff" + n.to_bytes(4, "little")) + word
        self.codes.append(code)
        if at == len(self.hashes):
            self.hashes, self.lengths = np.concatenate([self.hashes, self.hashes]), np.concatenate([self.lengths, self.lengths])
        self.hashes[at], self.lengths[at] = xxhash.xxh64_intdigest(word), len(code)
        return at


def word_ends(packed: bytes) -> list[int]:
    """Ends of a packed string's words."""
    out, at, n = [], 0, len(packed)
    while at < n:
        c = packed[at]
        if c < ONE:
            at += 1
        elif c < 255:
            at += 2
        elif packed[at + 1] < 255:
            at += 2 + packed[at + 1]
        else:
            at += 6 + int.from_bytes(packed[at + 2 : at + 6], "little")
        out.append(at)
    return out


def leftmost_minima(g: np.ndarray, w: int) -> np.ndarray:
    """For each run of ``w`` values, the place of its least value, the leftmost of equal ones: by doubling."""
    value, place, width = g, np.arange(len(g)), 1
    while width < w:
        step = min(width, w - width)
        left = value[: len(value) - step] <= value[step:]
        value, place = np.where(left, value[: len(value) - step], value[step:]), np.where(left, place[: len(place) - step], place[step:])
        width += step
    return place


OUT = pa.schema([("mini", pa.int64()), ("packed", pa.binary()), ("d", pa.int64()), ("f", pa.int64()), ("i", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
OUT_DDL = "mini bigint, packed binary, d bigint, f bigint, i bigint, start int, n int"


def packer(frequent: list[bytes], window: int, seed: int, held_most: int = HELD):
    """mapInArrow step: documents (d, f, i, text) -> super-k-mers, and (without ``packed``) places whose windows all repeat earlier ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held = Vocabulary(frequent), {}
        seen = []

        def out() -> pa.RecordBatch:
            rows = [(place[4], packed, *place[:4], place[5]) for packed, place in held.items()] + [((p[2] * 0x9E3779B9 + p[3]) & 0xFFFFFFFF, None, *p[:4], p[5]) for p in seen]
            held.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), OUT.types)] if rows else [pa.array([], t) for t in OUT.types], schema=OUT)

        for b in batches:
            texts = b.column("text").cast(pa.binary())
            ds, fs, is_ = (b.column(c).to_pylist() for c in ("d", "f", "i"))
            found = [t.as_py().split() for t in texts]
            counts = np.array([len(w) for w in found], np.int64)
            if counts.sum() < window:
                continue
            ids = np.array([k for ws in found for k in map(vocabulary.__getitem__, ws)], np.int64)
            blob = b"".join(map(vocabulary.codes.__getitem__, ids.tolist()))
            ends = np.cumsum(vocabulary.lengths[ids])
            starts = ends - vocabulary.lengths[ids]
            doc, first = np.repeat(np.arange(len(counts)), counts), np.repeat(np.cumsum(counts) - counts, counts)
            h = vocabulary.hashes[ids]
            g = h[: len(h) - seed + 1].copy()
            for j in range(1, seed):
                g = g * np.uint64(6364136223846793005) + h[j : len(h) - seed + 1 + j]
            g = (g ^ (g >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            g ^= g >> np.uint64(32)
            mini = leftmost_minima(g, window - seed + 1)
            whole = doc[: len(mini)] == doc[window - 1 :]  # windows that do not cross documents
            key = np.where(whole, mini, -1)
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1 : len(key)] != doc[: len(key) - 1])]))
            n = np.diff(np.append(cut, len(key)))
            real = whole[cut]
            cut, n = cut[real], n[real]
            rows = zip(starts[cut].tolist(), ends[cut + n + window - 2].tolist(), doc[cut].tolist(), (cut - first[cut]).tolist(), n.tolist(), g[mini[cut]].view(np.int64).tolist())
            for a, z, k, at, windows, m in rows:
                packed, place = blob[a:z], (ds[k], fs[k], is_[k], at, m, windows)
                old = held.setdefault(packed, place)
                if old is not place:
                    if place < old:
                        held[packed], place = place, old
                    seen.append(place)
            if len(held) + len(seen) > held_most:
                yield out()
            if len(vocabulary.codes) > COUNTED:
                vocabulary.start()
        yield out()

    return run


MARK = pa.schema([("d", pa.int64()), ("f", pa.int64()), ("i", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("window", pa.binary())])
MARK_DDL = "d bigint, f bigint, i bigint, start int, stop int, window binary"


def compared(rows: list[tuple], window: int) -> Iterator[tuple]:
    """Distinct super-k-mers of a minimiser (packed, d, f, i, start, n) -> (d, f, i, start, stop): words of windows that are not the first of their kind."""
    split = []
    least: dict[bytes, tuple] = {}
    for packed, *place, n in rows:
        ends = word_ends(packed)
        begins = [0, *ends]
        windows = [packed[begins[o] : ends[o + window - 1]] for o in range(n)]
        split.append(windows)
        for o, w in enumerate(windows):
            at = (*place[:3], place[3] + o)
            if at < least.setdefault(w, at):
                least[w] = at
    for (_, *place, _), windows in zip(rows, split):
        since = None
        for o, w in enumerate([*windows, None]):
            again = w is not None and least[w] != (*place[:3], place[3] + o)
            if again and since is None:
                since = o
            elif not again and since is not None:
                yield (*place[:3], place[3] + since, place[3] + o - 1 + window)
                since = None


def bucket(window: int, group: int = GROUP, group_bytes: int = GROUP_BYTES):
    """mapInArrow step over rows sorted by (mini, packed, place): marks of repeated words, and single windows of minimisers with too many contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, size, last, many, marks = None, [], 0, None, False, []

        def close() -> None:
            if many:
                hand_on()
            elif len(own) > 1:
                marks.extend((*m, None) for m in compared(own, window))
            own.clear()

        def hand_on() -> None:
            for packed, d, f, i, start, n in own:
                ends = word_ends(packed)
                begins = [0, *ends]
                marks.extend((d, f, i, start + o, start + o + window, packed[begins[o] : ends[o + window - 1]]) for o in range(n))
            own.clear()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*marks), MARK.types)] if marks else [pa.array([], t) for t in MARK.types], schema=MARK)
            marks.clear()
            return got

        for b in batches:
            mini = b.column("mini").to_numpy()
            plain = b.column("packed").is_null().to_numpy(zero_copy_only=False)
            alone = np.ones(len(mini), bool)  # the only row of its minimiser in this batch
            alone[1:] &= mini[1:] != mini[:-1]
            alone[:-1] &= mini[:-1] != mini[1:]
            alone[[0, -1]] = False  # neighbours in other batches
            keep = np.flatnonzero(~alone | plain)
            rows = b.take(pa.array(keep)) if len(keep) < len(mini) else b
            for m, packed, d, f, i, start, n in zip(*(rows.column(c).to_pylist() for c in OUT.names)):
                if packed is None:
                    marks.append((d, f, i, start, start + n - 1 + window, None))
                    continue
                if m != now:
                    close()
                    now, size, last, many = m, 0, None, False
                if packed == last:
                    marks.append((d, f, i, start, start + n - 1 + window, None))
                    continue
                last = packed
                own.append((packed, d, f, i, start, n))
                size += len(packed)
                if len(own) > group or size > group_bytes:
                    many, size = True, 0
                    hand_on()
                if len(marks) > 50_000:
                    yield out()
            if marks:
                yield out()
        close()
        yield out()

    return run


def joined(ranges: Column) -> Column:
    """Ranges in order, of rising ends, with those that touch put together."""

    def of(own: Column) -> Column:
        n = F.size(own)
        heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(own, i)["start"] > F.get(own, i - 1)["stop"]))
        return let(heads, lambda h: F.transform(h, lambda i, k: F.struct(F.get(own, i)["start"].alias("start"), F.get(own, F.coalesce(F.get(h, k + 1), n) - 1)["stop"].alias("stop"))))

    return let(ranges, of)


def repeated_words(docs: DataFrame, id_col: str, text_col: str, window: int, seed: int, group: int, held: int) -> DataFrame:
    """(f, i, runs): of each document with repeated windows, the word ranges [start, stop) they cover, sorted. ``docs`` is ``numbered``."""
    small_batches(docs.sparkSession, 20_000, 4)
    source = docs.select(F.coalesce(F.col(f"_all.`{id_col}`").cast("bigint"), F.lit(LEAST_ID)).alias("d"), F.col("_f").alias("f"), F.col("_i").alias("i"), text_of(f"_all.{text_col}").alias("text"))
    frequent = frequent_words(source)
    sent = source.mapInArrow(packer(frequent, window, seed, held), OUT_DDL)
    sorted_rows = sent.repartition("mini").sortWithinPartitions("mini", "packed", *PLACE)
    marks = stage_table(sorted_rows.mapInArrow(bucket(window, group), MARK_DDL), "repeat-marks")
    place = F.struct(*PLACE)
    single = marks.where("window is not null")
    firsts = single.groupBy("window").agg(F.min(place).alias("p")).select("p.*")
    again = single.join(firsts, PLACE, "left_anti").drop("window")
    both = marks.where("window is null").drop("window").unionByName(again)
    runs = both.groupBy("f", "i").agg(joined(F.array_sort(F.collect_list(F.struct("start", "stop")))).alias("runs"))
    out = stage_table(runs, "repeat-runs")
    drop_table(marks)
    return out


def dedup_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, group: int = GROUP, held: int = HELD, light_bytes: int = LIGHT_BYTES,
) -> DataFrame:
    """(id, n_words, n_removed, kept): each document's words (runs without ASCII white space), and those kept, joined by one blank.

    A window of ``window`` words is a repeat if the same words also start
    earlier: in a document of a smaller id, or earlier in the same one. Of rows
    with the same id (or none; null ids come first) one is the earlier by its
    place in the files. All words of repeats go; windows are judged on the
    input. Null and empty texts have no words; texts of fewer words than a
    window lose none. An empty table gives no rows.
    """
    rows = numbered(docs)
    runs = repeated_words(rows, id_col, text_col, window, seed, group, held)
    side = F.broadcast(runs) if stored_bytes(runs) <= light_bytes else runs
    source = rows.select(F.col(f"_all.`{id_col}`").cast("bigint").alias("id"), F.col("_f").alias("f"), F.col("_i").alias("i"), text_of(f"_all.{text_col}").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for t, cut in zip(b.column("text").cast(pa.binary()), b.column("runs").to_pylist()):
                words = t.as_py().split()
                left = words
                if cut:
                    stay = np.ones(len(words), bool)
                    for r in cut:
                        stay[r["start"] : r["stop"]] = False
                    left = [words[k] for k in np.flatnonzero(stay).tolist()]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])

    joined = source.join(side, ["f", "i"], "left").select("id", "text", "runs")
    return joined.mapInArrow(run, "id bigint, n_words bigint, n_removed bigint, kept string").withColumnRenamed("id", id_col)


def op13_substring_dedup(spark, sf_dir):
    out = dedup_passages(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, s, array_to_string(ws[s : s + 19], ' ') AS said FROM split, unnest(range(1, len(ws) - 18)) u(s)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY said ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + k AS i, true AS gone FROM again, range(20) r(k)),
kept AS (SELECT doc_id, i, ws[i] AS word, gone FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM split) LEFT JOIN gone USING (doc_id, i))
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM split LEFT JOIN (SELECT doc_id, count(gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (gone IS NULL) AS said FROM kept GROUP BY doc_id) k USING (doc_id)"""
