"""Database tables: SQLite read-only through partitions of row ids, and credentials of other databases."""

from __future__ import annotations

import os
import re
import sqlite3
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS_OF_PARTITION = 100_000


def dsn(alias: str, env_var: str | None = None, argument: str | None = None, environ: dict | None = None) -> str | None:
    """The address of a database: the named variable, the alias's own, the general one, or the argument."""
    env = os.environ if environ is None else environ
    for name in (env_var, f"LUMENSCAN_DSN_{re.sub(r'[^A-Z0-9]+', '_', alias.upper())}", "DATABASE_URL"):
        if name and env.get(name):
            return env[name]
    return argument


def open_read_only(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _kind(declared: str) -> T.DataType:
    d = (declared or "").upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return T.DoubleType()
    return T.StringType()


@dataclass
class Range(InputPartition):
    low: int
    high: int


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema

    def partitions(self):
        with open_read_only(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [Range(0, -1)]
        return [Range(a, min(a + ROWS_OF_PARTITION - 1, high)) for a in range(low, high + 1, ROWS_OF_PARTITION)]

    def read(self, partition: Range):
        names = ", ".join(_quoted(f.name) for f in self.schema)
        cast = [{"bigint": int, "double": float, "string": str}[f.dataType.simpleString()] for f in self.schema]
        with open_read_only(self.path) as db:
            for row in db.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high)):
                yield tuple(None if v is None else f(v) for f, v in zip(cast, row, strict=True))


class SqliteSource(DataSource):
    """``spark.read.format("lumenscan_sqlite").option("path", ...).option("table", ...)``: the file must be in a shared folder."""

    @classmethod
    def name(cls) -> str:
        return "lumenscan_sqlite"

    def schema(self) -> T.StructType:
        with open_read_only(self.options["path"]) as db:
            rows = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        return T.StructType([T.StructField(r[1], _kind(r[2])) for r in rows])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(dict(self.options), schema)


class SqliteConnection:
    def __init__(self, path: str):
        self.path = path

    def tables(self) -> list[dict]:
        with open_read_only(self.path) as db:
            found = db.execute("SELECT name, type FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall()
        return [{"name": n, "type": t} for n, t in found]

    def describe(self, table: str) -> dict:
        with open_read_only(self.path) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
            keys = db.execute(f"PRAGMA foreign_key_list({_quoted(table)})").fetchall()
            indexes = db.execute(f"PRAGMA index_list({_quoted(table)})").fetchall()
            rows = db.execute(f"SELECT count(*) FROM {_quoted(table)}").fetchone()[0]
        return {
            "table": table, "rows": rows, "columns": [{"name": c[1], "type": c[2], "nullable": not c[3], "default": c[4]} for c in columns], "primary_key": [c[1] for c in sorted(columns, key=lambda c: c[5]) if c[5]],
            "foreign_keys": [{"column": k[3], "table": k[2], "to": k[4]} for k in keys], "indexes": [i[1] for i in indexes],
        }

    def table(self, spark: SparkSession, name: str, limit: int | None = None) -> DataFrame:
        known = {t["name"]: t["type"] for t in self.tables()}
        if name not in known:
            raise ValueError(f"no table {name}")
        if known[name] == "view":  # a view has no row ids: it is read as a query
            return self.rows(spark, f"SELECT * FROM {_quoted(name)}", limit)
        spark.dataSource.register(SqliteSource)
        df = spark.read.format("lumenscan_sqlite").option("path", self.path).option("table", name).load()
        return df.limit(limit) if limit is not None else df

    def query(self, spark: SparkSession, text: str, limit: int) -> DataFrame:
        """A query over the connection's tables, checked and run by Spark."""
        from ..plans import guard

        used = {t["name"]: self.table(spark, t["name"]) for t in self.tables() if re.search(rf"\b{re.escape(t['name'])}\b", text, re.I)}
        return guard.run(spark, text, used, limit)

    def rows(self, spark: SparkSession, text: str, limit: int | None) -> DataFrame:
        with open_read_only(self.path) as db:
            cursor = db.execute(text)
            names = [d[0] for d in cursor.description]
            rows = cursor.fetchmany(limit) if limit is not None else cursor.fetchall()
        kinds = [next((T.LongType() if isinstance(r[i], int) else T.DoubleType() if isinstance(r[i], float) else T.StringType() for r in rows if r[i] is not None), T.StringType()) for i in range(len(names))]
        return spark.createDataFrame(rows, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))
