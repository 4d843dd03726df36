"""A Spark data source over SQLite files, opened read-only: each task reads one range of row ids.

``spark.dataSource.register(SqliteSource)``, then ``spark.read.format("sqlite_file").schema(..)
.option("path", ..).option("table", ..).option("parts", n).load()``. Every
executor must see the file, as with any file source.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, StructType


def open_readonly(path: str) -> sqlite3.Connection:
    """A connection that cannot write; foreign keys are on."""
    db = sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)
    db.execute("PRAGMA foreign_keys = ON")
    return db


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.table, self.parts = schema, options["path"], options["table"], int(options.get("parts", 4))

    def partitions(self) -> list[InputPartition]:
        db = open_readonly(self.path)
        try:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        finally:
            db.close()
        if low is None:
            return [_Range(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, part: _Range) -> Iterator[tuple]:
        db = open_readonly(self.path)
        try:
            there = {r[1] for r in db.execute(f'PRAGMA table_info("{self.table}")')}
            # a column that an older file lacks is null
            columns = ", ".join(f'"{f.name}"' if f.name in there else "NULL" for f in self.schema)
            flags = [i for i, f in enumerate(self.schema) if isinstance(f.dataType, BooleanType)]
            for row in db.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (part.low, part.high)):
                row = list(row)
                for i in flags:
                    row[i] = None if row[i] is None else bool(row[i])
                yield tuple(row)
        finally:
            db.close()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self) -> str:
        raise ValueError("give the schema: nothing is inferred")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, parts: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_file").schema(schema).option("path", path).option("table", table).option("parts", parts).load()
