"""Tables of an SQLite file as a Spark data source, split by ranges of rowid.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite").option("table", "page_status").load("state.db")
"""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DataType, DoubleType, LongType, StringType, StructField, StructType


def _kind(declared: str) -> DataType:
    """By the affinity rules of the format; what has none is text."""
    d = (declared or "").upper()
    if "INT" in d:
        return LongType()
    if "BLOB" in d:
        return BinaryType()
    return DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else StringType()


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://').removeprefix('file:')}?mode=ro", uri=True)


class SqliteSource(DataSource):
    """Options: path, table, partitions (4 by default)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        con = _connect(self.options["path"])
        try:
            got = con.execute(f"pragma table_info({_quote(self.options['table'])})").fetchall()
        finally:
            con.close()
        if not got:
            raise ValueError(f"no table {self.options['table']!r}")
        return StructType([StructField(r[1], _kind(r[2])) for r in got])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"], int(self.options.get("partitions", "4")), schema)


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, parts: int, schema: StructType):
        self.path, self.table, self.parts, self.schema = path, table, parts, schema

    def partitions(self) -> list[InputPartition]:
        con = _connect(self.path)
        try:
            low, high = con.execute(f"select min(rowid), max(rowid) from {_quote(self.table)}").fetchone()
        except sqlite3.OperationalError:  # a table without rowid is read whole
            return [InputPartition(None)]
        finally:
            con.close()
        if low is None:
            return [InputPartition((0, -1))]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [InputPartition((a, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition):
        names = ", ".join(_quote(f.name) for f in self.schema.fields)
        where, args = ("", ()) if partition.value is None else (" where rowid between ? and ?", partition.value)
        con = _connect(self.path)
        con.text_factory = lambda b: b.decode("utf-8", "replace")
        try:
            for row in con.execute(f"select {names} from {_quote(self.table)}{where}", args):
                yield tuple(_fit(v, f.dataType) for v, f in zip(row, self.schema.fields))
        finally:
            con.close()


def _fit(value: object, kind: DataType) -> object:
    """The value in the column's type: columns of the format may hold any; what does not fit is null."""
    if value is None:
        return None
    try:
        if isinstance(kind, LongType):
            return int(value)
        if isinstance(kind, DoubleType):
            return float(value)
        if isinstance(kind, BinaryType):
            return value if isinstance(value, bytes) else str(value).encode()
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    except (TypeError, ValueError):
        return None


def read(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    """A table of an SQLite file."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("table", table).option("partitions", str(partitions)).load(path)
