"""Streams that are stopped and started again give the rows of one batch run."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from lumenframe.streaming import resume

SCHEMA = "run_id long, model string, task int, status string, is_warmup boolean, server_load_duration_ms double"
KEYS = ["model", "task"]


def rows(n):
    pick = random.Random(2)
    return [(i, pick.choice(["a", "a", "a", "b", None]), pick.randint(0, 12), pick.choice(["COMPLETE", "ERROR", "ERROR"]), pick.random() < 0.1, pick.choice([None, 5.0, 1000.0, 1000.5, 9e9])) for i in range(n)]


@pytest.fixture
def split_files(spark, tmp_path):
    made = rows(400)
    for k in range(4):
        spark.createDataFrame(made[100 * k : 100 * k + 100], SCHEMA).coalesce(1).write.json(str(tmp_path / f"part{k}"))
    return made, tmp_path


def fed(spark, tmp, make, out_rows):
    """Files arrive in two halves; the stream is started, ends, and starts again; the last batch is then run once more."""
    source, folder, check = tmp / "in", str(tmp / "out"), str(tmp / "check")
    source.mkdir()
    for k in range(4):
        for f in (tmp / f"part{k}").glob("*.json"):
            os.utime(shutil.copy(f, source / f"{k}-{f.name}"), (1_000_000 + k, 1_000_000 + k))  # files are read by their time
        if k % 2:
            stream = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source)))
            q = resume.committed_sink(stream, folder, check)
            q.awaitTermination(120)
            assert q.exception() is None
    return sorted(map(tuple, resume.committed(spark, folder).collect()), key=repr)


def test_not_done(spark, split_files):
    made, tmp = split_files
    got = fed(spark, tmp, lambda s: resume.not_done(s, KEYS), made)
    want = sorted(map(tuple, resume.not_done_batch(spark.createDataFrame(made, SCHEMA), KEYS).collect()), key=repr)
    seen, plain = set(), []
    for r in made:
        if (r[1], r[2]) not in seen:
            plain.append(r)
            if r[3] == "COMPLETE":
                seen.add((r[1], r[2]))
    assert got == want == sorted(plain, key=repr) and 0 < len(plain) < 400


def test_since_warm_up(spark, split_files):
    made, tmp = split_files
    got = fed(spark, tmp, lambda s: resume.since_warm_up(s, ["model"]), made)
    want = sorted(map(tuple, resume.since_warm_up_batch(spark.createDataFrame(made, SCHEMA), ["model"]).collect()), key=repr)
    state, plain = {}, []
    for i, m, _, _, warm, load in made:
        seg, n, slow = state.get(m, (0, 0, 0))
        if warm:
            plain.append((m, seg, n, slow, i))
            state[m] = (seg + 1, 0, 0)
        else:
            state[m] = (seg, n + 1, slow + (load is not None and load > 1000))
    assert got == want == sorted(plain, key=repr)


def test_idle_keys_are_forgotten(spark, split_files):
    made, tmp = split_files
    stream = resume.since_warm_up(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp / "part*")), ["model"], idle_ms=1)
    q = resume.committed_sink(stream, str(tmp / "out"), str(tmp / "check"), processingTime="500 milliseconds")
    want, got = sum(not r[4] for r in made), []
    for _ in range(40):
        q.awaitTermination(1)
        got = resume.committed(spark, str(tmp / "out")).collect() if any((tmp / "out").glob("batch=*/_SUCCESS")) else []
        if sum(r["rows"] for r in got) == want:
            break
    q.stop()
    assert sum(r["rows"] for r in got) == want and any(r["closed_by"] is None for r in got)


def test_a_batch_is_committed_once(spark, tmp_path):
    one = spark.createDataFrame(rows(50), SCHEMA)
    for batch in (0, 1, 1, 0):
        resume.commit(one.where(F.col("run_id") % 2 == batch), batch, str(tmp_path / "x"))
    assert resume.committed(spark, str(tmp_path / "x")).count() == 50


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert resume.not_done_batch(none, KEYS).count() == 0 and resume.since_warm_up_batch(none, ["model"]).count() == 0
