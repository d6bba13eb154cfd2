"""Run history kept in SQLite files, as a Spark source.

    spark.dataSource.register(SqliteRuns)
    spark.read.format("sqlite_runs").option("path", "/shared/forecast_history.db").load()

Ranges of ids are partitions. Bounds of ids and tickers are options, which become SQLite's WHERE clause; Spark
decides all other filters. (It can push filters into a Python source, but keeps those of one query for the next one
on the same DataFrame, so this source takes none that way.) Stored forecasts are
pickled lists of floats. They are read opcode by opcode and never unpickled: only the few opcodes that lists of
numbers need are known, and any other is an error. The file must be at that path for the driver and all executors.
"""

from __future__ import annotations

import json
import math
import pickletools
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandline.operators.history import RUNS

# The table's name and columns.
TABLE = "forecast_runs"
COLUMNS = ("id", "timestamp", "ticker", "interval", "context_length", "horizon_length", "model_repo", "period", "forecast_data", "mae_score")
SCHEMA = T.StructType([RUNS[c] for c in COLUMNS])

# Opcodes of pickled lists of numbers.
NUMBERS = {"BINFLOAT", "FLOAT", "BININT", "BININT1", "BININT2", "INT", "LONG", "LONG1"}
SILENT = {"PROTO", "FRAME", "MEMOIZE", "PUT", "BINPUT", "LONG_BINPUT"}


def floats_of(blob: bytes | None) -> list[float] | None:
    """The numbers of a pickled list; anything else in the bytes is an error, and nothing of them is ever called."""
    if blob is None:
        return None
    found, pending, marked, ended = None, [], False, False
    try:
        for op, arg, _ in pickletools.genops(bytes(blob)):
            name = op.name
            if name in NUMBERS and found is not None and not isinstance(arg, bool):
                pending.append(float(arg))
            elif name == "EMPTY_LIST" and found is None:
                found = []
            elif name == "MARK" and not pending and not marked:
                marked = True
            elif name == "LIST" and marked and found is None:
                found, marked = [], False
            elif name == "APPENDS" and marked:
                found, pending, marked = found + pending, [], False
            elif name == "APPEND" and len(pending) == 1 and not marked:
                found, pending = found + pending, []
            elif name == "STOP" and found is not None and not pending and not marked:
                ended = True
            elif name not in SILENT:
                raise ValueError(f"a stored forecast is not a list of numbers: {name}")
    except (ValueError, OverflowError, IndexError, UnicodeDecodeError) as e:
        raise ValueError(str(e) if "stored forecast" in str(e) else f"a stored forecast can't be read: {e}") from None
    if not ended:
        raise ValueError("a stored forecast ends early")
    return found


@dataclass
class IdRange(InputPartition):
    low: int
    high: int

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str, partitions: int, where: dict[str, list]):
        self.path, self.table, self.n = path, table, partitions
        self.where, self.values = list(where), [v for values in where.values() for v in values]

    def connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def condition(self) -> str:
        return " AND ".join(["1", *(f"({w})" for w in self.where)])

    def partitions(self) -> list[IdRange]:
        con = self.connect()
        try:
            low, high = con.execute(f'SELECT min(id), max(id) FROM "{self.table}" WHERE {self.condition()}', self.values).fetchone()
        finally:
            con.close()
        if low is None:
            return [IdRange(0, 0)]
        step = math.ceil((high + 1 - low) / self.n)
        return [IdRange(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: IdRange) -> Iterator[tuple]:
        con = self.connect()
        try:
            sql = f'SELECT {", ".join(f"{chr(34)}{c}{chr(34)}" for c in COLUMNS)} FROM "{self.table}" WHERE id >= ? AND id < ? AND {self.condition()}'
            for row in con.execute(sql, [partition.low, partition.high, *self.values]):
                made = dict(zip(COLUMNS, row, strict=True))
                if made["timestamp"] is not None:
                    made["timestamp"] = datetime.fromisoformat(made["timestamp"]).replace(tzinfo=UTC)
                made["period"] = None if made["period"] is None else str(made["period"])
                made["forecast_data"] = floats_of(made["forecast_data"])
                yield tuple(made.values())
        finally:
            con.close()


class SqliteRuns(DataSource):
    """Options: path; table (forecast_runs); partitions (8), as many ranges of ids at most; min_id, max_id, tickers (a JSON list)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_runs"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> Reader:
        path, n = self.options.get("path"), int(self.options.get("partitions", "8"))
        table = self.options.get("table", TABLE)
        if not path:
            raise ValueError("sqlite_runs needs the option path")
        if n < 1 or '"' in table:
            raise ValueError("partitions must be at least 1, and a table's name has no quotes")
        where = {sql: [int(self.options[name])] for name, sql in (("min_id", "id >= ?"), ("max_id", "id <= ?")) if name in self.options}
        if "tickers" in self.options:
            names = json.loads(self.options["tickers"])
            where[f"ticker IN ({', '.join('?' * len(names))})"] = names
        return Reader(path, table, n, where)


def read_sqlite_runs(spark: SparkSession, path: str, partitions: int = 8, min_id: int | None = None, max_id: int | None = None, tickers: list[str] | None = None) -> DataFrame:
    """Runs of a SQLite file with all columns of the run history; those that the file lacks are null.

    min_id, max_id (both included) and tickers are decided by SQLite.
    """
    spark.dataSource.register(SqliteRuns)
    read = spark.read.format("sqlite_runs").option("path", path).option("partitions", str(partitions))
    for name, value in (("min_id", min_id), ("max_id", max_id), ("tickers", None if tickers is None else json.dumps(tickers))):
        read = read if value is None else read.option(name, str(value))
    rows = read.load()
    return rows.select(*[F.col(f.name) if f.name in COLUMNS else F.lit(None).cast(f.dataType).alias(f.name) for f in RUNS])
