"""Readers, writers and streaming tallies on small files."""

import io
import json
import zipfile

import pytest

from lumenframe.sources import files
from lumenframe.streaming import tallies

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(cells):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_workbook(spark, tmp_path):
    head = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="B1" t="inlineStr"><is><t>mid</t></is></c></row>'
    (tmp_path / "b.xlsx").write_bytes(book(head + '<row><c r="A2"><v>7</v></c><c r="C2" t="s"><v>1</v></c></row>'))
    got = files.workbook(spark, str(tmp_path / "b.xlsx"))
    assert got.columns == ["id", "mid", "name"] and [tuple(r) for r in got.collect()] == [("7", None, "name")]
    with pytest.raises(ValueError, match="formula"):
        files.workbook_rows(book('<row><c r="A1"><f>1+1</f><v>2</v></c></row>'))


def test_json_and_freeze(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert sorted(r["id"] for r in files.json_lines(spark, str(tmp_path / "a.jsonl"), "id int").collect()) == [1, 2]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/x.json").write_text('{\n "id": 3\n}')
    one = files.json_documents(spark, str(tmp_path / "docs/*.json"), "id int").first()
    assert one["id"] == 3 and one["file"].endswith("x.json")
    frozen = spark.createDataFrame(files.frozen_files(spark, str(tmp_path / "docs")).collect())
    assert files.changed_files(spark, str(tmp_path / "docs"), frozen).count() == 0
    (tmp_path / "docs/x.json").write_text("{}")
    assert files.changed_files(spark, str(tmp_path / "docs"), frozen).count() == 1


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), (None, 2)], "k string, n int")
    files.write_report(df, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == [{"k": "b", "n": 1}, {"n": 2}]
    assert files.markdown_table(df) == "| k | n |\n| --- | --- |\n| b | 1 |\n| – | 2 |\n"
    with pytest.raises(ValueError):
        files.write_report(df, str(tmp_path / "r.json"), most=1)
    files.write_new(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_new(df, str(tmp_path / "t"))


def test_overlay():
    base = {"q1": {"graders": []}, "q2": {}}
    over = {"overrides": {"q2": {"graders": [1]}}, "provenance": {"base_spec_sha256": files.config_hash(base)}}
    assert files.merge_overlay(base, over) == {"q1": {"graders": []}, "q2": {"graders": [1]}}
    with pytest.raises(ValueError, match="another base"):
        files.merge_overlay({"q1": {}}, over)
    with pytest.raises(ValueError, match="lacks"):
        files.merge_overlay(base, {"overrides": {"q9": {}}})


def run(df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    row = lambda i, e, m: json.dumps({"timestamp": f"2026-01-01T00:{m:02d}:00Z", "task_id": f"q{i % 3}", "trial": 1, "error_type": e, "backoff_seconds": 0.5})
    (log / "a.json").write_text("\n".join(row(i, "timeout" if i % 2 else "reset", i) for i in range(6)) + "\n")
    events = tallies.event_log(spark, str(log))
    got = {r["error_type"]: (r["n"], r["backoff_seconds"]) for r in run(tallies.retries_by_error(events), tmp_path, "tally", "complete").collect()}
    assert got == {"timeout": (3, 1.5), "reset": (3, 1.5)}
    assert run(tallies.first_seen(events, ["task_id", "trial"]), tmp_path, "seen", "append").count() == 3
    assert tallies.retries_by_window(spark.read.schema(tallies.RETRY_SCHEMA).json(str(log))).count() == 2
    loads = spark.createDataFrame([(999.0,), (1000.0,), (1000.5,), (None,)], "server_load_duration_ms double")
    assert tallies.reloads(loads).count() == 1


def test_sqlite_files_are_read_in_ranges(spark, tmp_path):
    """Rows of a file with gaps between its row ids; a column that the file lacks is null; the file cannot be written."""
    import sqlite3

    import pytest

    from lumenframe.sources import sqlite

    path = str(tmp_path / "r uns.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE runs (run_id INTEGER PRIMARY KEY, task TEXT, is_warmup INTEGER, ms REAL)")
    db.executemany("INSERT INTO runs VALUES (?, ?, ?, ?)", [(i * i, f"t{i}", i % 2, None if i == 3 else i / 2) for i in range(20)])
    db.execute("CREATE TABLE none (x INTEGER)")
    db.commit()
    db.close()
    schema = "run_id bigint, task string, is_warmup boolean, ms double, model_digest string"
    got = sqlite.sqlite_table(spark, path, "runs", schema, 3)
    assert sorted(map(tuple, got.collect())) == [(i * i, f"t{i}", i % 2 == 1, None if i == 3 else i / 2, None) for i in range(20)]
    assert sqlite.sqlite_table(spark, path, "none", "x bigint").count() == 0
    with pytest.raises(sqlite3.OperationalError):
        sqlite.open_readonly(path).execute("DELETE FROM runs")


def test_frozen_files_and_worktrees(spark, tmp_path):
    import hashlib

    from lumenframe.operators import audits

    for name, text in (("a", "1"), ("b", "2"), ("c", "3")):
        (tmp_path / name).write_text(text)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = audits.frozen_files(spark, str(tmp_path), {"a": sha("1"), "b": sha("x"), "d": sha("4")})
    assert {r["name"]: r["state"] for r in got.collect()} == {"a": "same", "b": "changed", "c": "extra", "d": "missing"}
    assert audits.files_there(spark, {"a": str(tmp_path / "a"), "z": str(tmp_path / "z")}) == {"a": True, "z": False}
    lines = spark.createDataFrame([(" M src/x.py",), ("?? results/new",), ("R  old -> src/new.py",), ("",)], "line string")
    assert sorted(r["path"] for r in audits.dirty_paths(lines, ["results/"]).collect()) == ["src/new.py", "src/x.py"]
