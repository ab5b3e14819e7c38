"""Rows of SQLite stores as a batch data source.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite").option("paths", "a.db,b.db").option("table", "messages").schema("id string, data string").load()
    spark.read.format("sqlite").option("paths", "a.db").option("query", "SELECT id FROM messages").schema("id string").load()

A table is read in partitions of ``rows`` row ids (100,000 unless given), a query in one for each file. Columns that
a store lacks are null, as stores of different age differ; a store without the table gives no rows. Columns named in ``zstd`` are
decompressed where they hold a zstd frame. With ``pushdown`` (``read_table`` sets it where
``spark.sql.python.filterPushdown.enabled`` is true) filters on columns whose declared type fits
are also put into SQLite's WHERE. The files are opened read-only and must lie where all executors can open them.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith,
)
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructType

ROWS = 100_000
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

KINDS = {StringType: str, IntegerType: int, LongType: int, DoubleType: float, BinaryType: bytes}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def declared(db: sqlite3.Connection, table: str) -> dict[str, str]:
    """Declared types of a table's columns; none if it isn't there."""
    return {r[1]: (r[2] or "").upper() for r in db.execute(f"PRAGMA table_info({quoted(table)})")}


class Piece(InputPartition):
    """Row ids ``low`` to ``high`` of one store, or all of it."""

    def __init__(self, path: str, low: int | None = None, high: int | None = None):
        super().__init__((path, low, high))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        """Of the first store's table; columns without a known type are strings."""
        with opened(self.options["paths"].split(",")[0]) as db:
            columns = declared(db, self.options["table"])
        out = StructType()
        for name, kind in columns.items():
            out = out.add(name, LongType() if "INT" in kind else DoubleType() if any(k in kind for k in ("REAL", "FLOA", "DOUB")) else BinaryType() if "BLOB" in kind else StringType())
        return out

    def reader(self, schema: StructType) -> "SqliteReader":
        kind = PushingReader if self.options.get("pushdown") == "true" else SqliteReader
        return kind(dict(self.options), schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.paths, self.query, self.table = options["paths"].split(","), options.get("query"), options.get("table")
        if (self.query is None) == (self.table is None):
            raise ValueError("give a table or a query")
        self.rows, self.zstd, self.schema = int(options.get("rows", ROWS)), set(filter(None, options.get("zstd", "").split(","))), schema
        self.pushed: list[Filter] = []

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            with opened(path) as db:
                if self.query is not None:
                    out.append(Piece(path))
                elif declared(db, self.table):
                    try:
                        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
                    except sqlite3.OperationalError:  # a table WITHOUT ROWID
                        out.append(Piece(path))
                        continue
                    if low is not None:
                        out += [Piece(path, at, min(at + self.rows - 1, high)) for at in range(low, high + 1, self.rows)]
        return out

    def statement(self, db: sqlite3.Connection, low: int | None, high: int | None) -> tuple[str, list]:
        types = declared(db, self.table)
        columns = ", ".join(quoted(f.name) if f.name in types else "NULL" for f in self.schema.fields)
        tests, given = [], []
        if low is not None:
            tests, given = ["rowid BETWEEN ? AND ?"], [low, high]
        for one in self.pushed:
            column = one.attribute[0]
            if len(one.attribute) != 1 or not self.fits(types.get(column, ""), column):
                continue
            if isinstance(one, IsNotNull):
                tests.append(f"{quoted(column)} IS NOT NULL")
            elif isinstance(one, In):
                tests.append(f"{quoted(column)} IN ({', '.join('?' * len(one.value))})")
                given += one.value
            elif isinstance(one, StringStartsWith):
                tests.append(f"{quoted(column)} >= ? AND substr({quoted(column)}, 1, length(?)) = ?")
                given += [one.value] * 3
            else:
                tests.append(f"{quoted(column)} {COMPARED[type(one)]} ?")
                given.append(one.value)
        return f"SELECT {columns} FROM {quoted(self.table)}" + (" WHERE " + " AND ".join(tests) if tests else ""), given

    def fits(self, kind: str, column: str) -> bool:
        """Whether SQLite compares a column of a declared type as Spark does."""
        asked = self.schema[column].dataType
        if isinstance(asked, StringType):
            return any(k in kind for k in ("CHAR", "TEXT", "CLOB"))
        return isinstance(asked, (IntegerType, LongType)) and "INT" in kind

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, low, high = partition.value
        kinds = [next((k for t, k in KINDS.items() if isinstance(f.dataType, t)), None) for f in self.schema.fields]
        packed = [f.name in self.zstd for f in self.schema.fields]
        with opened(path) as db:
            rows = db.execute(self.query) if self.query is not None else db.execute(*self.statement(db, low, high))
            for row in rows:
                yield tuple(self.shown(v, t, z) for v, t, z in zip(row, kinds, packed))

    @staticmethod
    def shown(value, kind: type | None, packed: bool):
        """A cell, which may hold a value of any type, as its column's type; null where it can't be."""
        if packed and isinstance(value, bytes) and value.startswith(ZSTD_FRAME):
            import zstandard

            try:
                value = zstandard.ZstdDecompressor().decompressobj().decompress(value)
            except zstandard.ZstdError:
                return None  # a broken frame is a null, as a broken line is elsewhere
        if value is None or kind is None or isinstance(value, kind):
            return value
        if kind is str and isinstance(value, bytes):
            return value.decode(errors="replace")
        try:
            return kind(value, "utf-8") if kind is bytes else kind(value)
        except (TypeError, ValueError):
            return None


class PushingReader(SqliteReader):
    """Filters are put to SQLite too; Spark keeps testing them, so a filter that doesn't fit a store costs time only."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        able = (*COMPARED, In, IsNotNull, StringStartsWith)
        self.pushed = [f for f in filters if isinstance(f, able)]
        return filters


def read_table(spark: SparkSession, paths: list[str], table: str, schema: str, **options: str) -> DataFrame:
    """Columns of ``schema`` from the table of that name in each store."""
    spark.dataSource.register(SqliteSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("sqlite").options(paths=",".join(paths), table=table, pushdown=push, **options).schema(schema).load()
