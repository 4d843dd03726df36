"""Readers and writers of specifications, task files and reports.

Data goes through Spark's readers and writers. Specifications and reports are
single small documents: they are read and written on the driver.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a schema: a scan without inference. Blank lines are no rows; a broken line stops the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row per JSON document, with the ``file`` that it came from. ``path`` may be a folder or a pattern."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table with columns added where older files lack them."""
    return spark.read.schema(schema).option("mergeSchema", True).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """Add to a JSON lines log."""
    events.write.mode("append").json(path)


def write_new(rows: DataFrame, path: str) -> None:
    """Write a table that must not be there yet."""
    rows.write.mode("errorifexists").parquet(path)


def canonical_json(value) -> str:
    """Keys sorted, two blanks of indent, one line feed at the end."""
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def config_hash(value, ascii_only: bool = True) -> str:
    """sha256 of the compact form with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only).encode()).hexdigest()


def write_report(rows: DataFrame, path: str, most: int = 10_000) -> None:
    """A report's rows as one canonical JSON document. A report has at most ``most`` rows: more is an error, not a cut."""
    got = rows.limit(most + 1).toJSON().collect()
    if len(got) > most:
        raise ValueError(f"a report has at most {most} rows")
    Path(path).write_text(canonical_json([json.loads(x) for x in got]), encoding="utf-8")


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """A report's rows as a Markdown table; nulls are dashes. More than ``most`` rows is an error."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a table has at most {most} rows")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    cell = lambda v: "–" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join([line(rows.columns), line(["---"] * len(rows.columns)), *[line([cell(v) for v in r]) for r in got]]) + "\n"


def frozen_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of the files under a path: what a freeze file lists. Files are hashed where they are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def changed_files(spark: SparkSession, path: str, frozen: DataFrame) -> DataFrame:
    """Paths whose hash is another than the frozen one, or that are only in one of the two."""
    now = frozen_files(spark, path).withColumnRenamed("sha256", "now")
    return frozen.join(now, "path", "full_outer").where(~F.col("sha256").eqNullSafe(F.col("now"))).select("path")


def merge_overlay(base: dict, overlay: dict) -> dict:
    """A grading specification with an overlay's entries in place of the base's; the overlay must name the base it was made for."""
    want = overlay.get("provenance", {}).get("base_spec_sha256")
    if want and want != config_hash(base):
        raise ValueError("the overlay was made for another base")
    unknown = sorted(set(overlay.get("overrides", {})) - set(base))
    if unknown:
        raise ValueError(f"the overlay changes tasks that the base lacks: {unknown}")
    return base | overlay.get("overrides", {})


def read_yaml(path: str) -> dict:
    """A YAML document, where a YAML package is installed; JSON is YAML too and needs none."""
    raw = Path(path).read_text(encoding="utf-8")
    try:
        return json.loads(raw)
    except ValueError:
        import yaml

        return yaml.safe_load(raw)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def workbook_rows(content: bytes, sheet: int = 1) -> list[list[str | None]]:
    """The cells of a sheet of an XLSX file, as texts; a formula is an error."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        root, out = ET.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")), []
    for row in root.iterfind("m:sheetData/m:row", _NS):
        cells: dict[int, str | None] = {}
        for c in row.findall("m:c", _NS):
            if c.find("m:f", _NS) is not None:
                raise ValueError(f"formula in cell {c.get('r')}")
            at = 0
            for letter in re.match(r"[A-Z]+", c.get("r", "A"))[0]:
                at = at * 26 + ord(letter) - 64
            value = c.find("m:v", _NS)
            if c.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            elif value is not None:
                cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
        out.append([cells.get(i) for i in range(1, max(cells, default=0) + 1)])
    return out


def workbook(spark: SparkSession, path: str, sheet: int = 1, header_row: int = 1) -> DataFrame:
    """A sheet as text columns named by its header row. Workbooks are small: read on the driver through Spark's reader."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    rows = workbook_rows(bytes(content), sheet)
    names = [str(n) for n in rows[header_row - 1]]
    body = [(r + [None] * len(names))[: len(names)] for r in rows[header_row:]]
    return spark.createDataFrame(body, ", ".join(f"`{n}` string" for n in names))
