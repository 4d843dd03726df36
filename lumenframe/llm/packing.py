"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each scan task packs its own documents: a level array counts the open windows
at each fill level, and a remainder goes to the level that leaves the least sum
of squared counts (Csirik et al., sum-of-squares bin packing). Whole windows'
worth of a document are cut off first. Windows still open at the end of a task
are joined by cutting, so a task pads at most one window. No shuffle. The ids of
open windows wait in an unnamed file of the task's own; memory holds their places.
"""

from __future__ import annotations

import tempfile
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import documents, small_batches, text_of

WINDOW, END = 1024, 0
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)
#: Most chunks that a worker keeps.
_PLAIN = 500_000


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


class WordIds(dict):
    """Ids of texts as the tokenizer file gives them, as bytes of uint32.

    A blank or line feed between two characters that are not white space always
    starts or forms a piece of its own in a byte-level vocabulary's split, so the
    chunks between them are encoded apart and kept (at most ``_PLAIN`` of them).
    Other texts are encoded whole by the tokenizer. Chunks are merged by rank,
    which gives the same ids where ids follow the order of merges; where they
    don't, the tokenizer encodes the chunks as well.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.chunk = self._by_rank(json.load(open(path, encoding="utf-8"))) or (
            lambda x: self.tok.encode(x, add_special_tokens=False).ids
        )

        self.marks = {c: array("I", self.chunk(c)).tobytes() for c in ",."}

    def _by_rank(self, spec: dict):
        import tiktoken

        model, byte = spec["model"], _bytes_of()
        vocab, merges = model["vocab"], model["merges"]
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        ids = [vocab.get(m, -1) for m in merged]
        plain = [t for t in vocab if t not in set(self.special)]
        if model["type"] != "BPE" or any(i >= j for i, j in zip(ids, ids[1:], strict=False)) or not all(c in byte for t in plain for c in t):
            return None
        ranks = {bytes(byte[c] for c in t): vocab[t] for t in plain}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        fast = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        probe = [" word", "\nÉté,", " 12.5%", "it's", " naïve-x_y", "ß", " ''", " a1b2"]
        same = all(fast(x) == self.tok.encode(x, add_special_tokens=False).ids for x in probe)
        return fast if same else None

    def __missing__(self, part: str) -> bytes:
        """A chunk carries the blank before it; one that starts with a line feed has none."""
        if part[-1] in ",." and part[-2:-1].isalpha():  # a mark after a letter is a piece of its own
            ids = self[part[:-1]] + self.marks[part[-1]]
        else:
            ids = array("I", self.chunk(part if part[0] == "\n" else " " + part)).tobytes()
        if len(self) >= _PLAIN:
            self.clear()
        self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        plain = (
            text
            and text[0] not in " \n"
            and text[-1] != " "
            and not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text)
            and text.replace("\n", "").isprintable()
            and not any(s in text for s in self.special)
        )
        if not plain:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.replace("\n", " \n").split(" ")
        return np.array(self.chunk(first), "<u4").tobytes() + b"".join(map(self.__getitem__, rest))

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


class Packer:
    """Open windows by fill level; rows of closed windows collect in ``rows``.

    A waiting piece is (document, start, ids, crc32, document's ids, place in the task's file).
    """

    def __init__(self, window: int, first_id: int):
        self.window, self.next_id = window, first_id
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}
        self.rows: list[tuple] = []
        self.file, self.size = tempfile.TemporaryFile(), 0  # without a name: it goes with the task, however that ends

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, n, crc, total, _ in pieces:
            self.rows.append((doc, start, n, crc, total, self.next_id, at))
            at += n
        self.next_id += 1

    def add(self, doc, ids: bytes) -> None:
        total, w = len(ids) // 4, self.window
        cut = total - total % w
        for at in range(0, cut, w):
            self._close([(doc, at, w, zlib.crc32(ids[4 * at : 4 * (at + w)]), total, 0)])
        if cut < total:
            rest = ids[4 * cut :]
            self.file.write(rest)
            self._place((doc, cut, total - cut, zlib.crc32(rest), total, self.size), total - cut)
            self.size += len(rest)

    def _place(self, piece: tuple, size: int) -> None:
        count, w = self.count, self.window
        # change of the sum of squares: a level loses a window, another gains one; full and empty do not count
        gain = 2 * count[size : w + 1] + 1  # by new level size..w
        gain[w - size] = 0
        delta = gain - np.where(count[: w + 1 - size] > 0, 2 * count[: w + 1 - size] - 1, -(1 << 40))
        delta[0] = gain[0]
        level = w - size - int(np.argmin(delta[::-1]))
        pieces = []
        if level:
            pieces = self.open[level].pop()
            count[level] -= 1
        pieces.append(piece)
        if level + size == w:
            self._close(pieces)
        else:
            self.open.setdefault(level + size, []).append(pieces)
            count[level + size] += 1

    def flush(self) -> None:
        """Join the open windows by cutting, the fullest first; at most one stays part full."""
        own, room = [], self.window
        for level in sorted(self.open, reverse=True):
            for doc, start, n, crc, total, at in (p for pieces in self.open[level] for p in pieces):
                if n > room:
                    self.file.seek(at)
                    ids = self.file.read(4 * n)
                    own.append((doc, start, room, zlib.crc32(ids[: 4 * room]), total, 0))
                    self._close(own)
                    own, start, n, crc, room = [], start + room, n - room, zlib.crc32(ids[4 * room :]), self.window
                own.append((doc, start, n, crc, total, 0))
                room -= n
                if not room:
                    self._close(own)
                    own, room = [], self.window
        if own:
            self._close(own)
        self.open, self.count[:] = {}, 0
        self.file.close()


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, end_id: int = END,
) -> DataFrame:
    """Pieces of all documents' ids (text, then ``end_id``) in windows of at most ``window`` ids.

    Null and empty texts are the end id alone. Each row is a document of its
    own, repeated and null ids too. An empty table gives no piece. sequence_id
    is unique over the result: task number * 2**40 + count.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, last = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def out() -> pd.DataFrame:
            rows, packer.rows = packer.rows, []
            got = pd.DataFrame(rows, columns=names)
            return got.astype({c: "int64" for c in names if c != "doc_id"}).astype({"doc_id": "Int64"})

        for b in batches:
            ids, texts = b["id"].tolist(), b["text"].tolist()
            for at in range(0, len(ids), 256):
                for doc, e in zip(ids[at : at + 256], enc(texts[at : at + 256]), strict=True):
                    packer.add(None if doc is None or doc != doc else int(doc), e + last)
                if len(packer.rows) > 5000:
                    yield out()
        packer.flush()
        yield out()

    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    return src.mapInPandas(run, SCHEMA)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_sum_of_squares_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir), tokenizer_path())
