"""Hashes of ordered groups in constant memory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streamed_sha256(rows: DataFrame, by: list[str], order: list[str], line: str, name: str = "hash") -> DataFrame:
    """(by.., name, n): sha256 of each group's lines in ``order``, joined by line feeds, and how many there are.

    A hash is sequential, so a group passes through one task; nothing of it is
    held there. Rows come sorted (the sort spills) in Arrow batches, and a batch
    goes into the running hash as one update a group. Null lines are left out, a
    group with none else has the hash of the empty text and n 0. Null keys are a
    group. An empty table has no groups.
    """
    kept = rows.select(*by, *[c for c in order if c not in (*by, line)], F.col(line).cast("string").alias(line))
    dealt = kept.repartition(*by).sortWithinPartitions(*by, *order)
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, n = None, hashlib.sha256(), 0
        for b in batches:
            keys, lines = b.column(0), b.column(1)
            out, starts = [], pa.compute.indices_nonzero(pa.compute.not_equal(keys[1:], keys[:-1])).to_pylist() if len(keys) > 1 else []
            cuts = [0, *[i + 1 for i in starts], len(keys)]
            for at, to in zip(cuts[:-1], cuts[1:]):
                if to == at:
                    continue
                k = keys[at].as_py()
                if k != now:
                    if now is not None:
                        out.append((now, h.hexdigest(), n))
                    now, h, n = k, hashlib.sha256(), 0
                own = [x for x in lines.slice(at, to - at).to_pylist() if x is not None]
                if own:
                    h.update(("\n" if n else "").encode() + "\n".join(own).encode())
                    n += len(own)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip("khn", x)) for x in out], schema=RESULT)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"k": now, "h": h.hexdigest(), "n": n}], schema=RESULT)

    hashed = dealt.select(key.alias("k"), F.col(line).alias("line")).mapInArrow(run, "k string, h string, n bigint")
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    return hashed.select(F.from_json("k", types).alias("k"), "h", "n").select(*[F.col(f"k.`{c}`").alias(c) for c in by], F.col("h").alias(name), "n")


RESULT = pa.schema([("k", pa.string()), ("h", pa.string()), ("n", pa.int64())])
