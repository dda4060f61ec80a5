"""Single-file SQLite stores as a data source: ``spark.read.format("sqlite_store")`` and ``write.format("sqlite_store")``.

A store is read by ranges of its key, each task a range in batches; nothing passes through the driver. It is written in parts: each task
puts its rows into a part file beside the store, and the commit moves all parts into it in one transaction, row by row, in the order of
the partitions. A task that is lost or run twice leaves a part that no message names and that is deleted. The table and the columns that an
older store lacks are added, never replaced. The file must lie where the driver and all executors reach it, as SQLite needs a file system.
"""

from __future__ import annotations

import glob
import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .. import schema as S

TABLE, KEY = "emissions", "id"
#: Types of columns that aren't real numbers.
TYPES = {"pmr_channel": "INTEGER", "bin_index": "INTEGER", "calibrated": "INTEGER", "amp_enabled": "INTEGER", "classification": "TEXT", "attribution": "TEXT"}
_SPARK = {"INTEGER": T.LongType(), "TEXT": T.StringType(), "REAL": T.DoubleType()}
_ARROW = {"INTEGER": pa.int64(), "TEXT": pa.string(), "REAL": pa.float64()}
ROWS = 10_000
#: Memory for pages while a store is written, in KiB.
CACHE_KB = 131_072


def _kind(column: str) -> str:
    return "INTEGER" if column == KEY else TYPES.get(column, "REAL")


def _columns(db: sqlite3.Connection) -> list[str]:
    return [r[1] for r in db.execute(f"PRAGMA table_info({TABLE})")]


def _typed(column: str, value):
    """SQLite stores whole numbers of a real column as integers."""
    return value if value is None else {"INTEGER": int, "TEXT": str, "REAL": float}[_kind(column)](value)


def _array(column: str, values: tuple) -> pa.Array:
    try:
        return pa.array(values, _ARROW[_kind(column)])
    except (pa.ArrowInvalid, pa.ArrowTypeError):  # values of other types, which SQLite allows in any column
        return pa.array([_typed(column, v) for v in values], _ARROW[_kind(column)])


def count_rows(path: str) -> int:
    """Rows of a store, counted by SQLite; 0 without the file."""
    if not os.path.exists(path):
        return 0
    with sqlite3.connect(path) as db:
        return db.execute(f"SELECT count(*) FROM {TABLE}").fetchone()[0]


class _Keys(InputPartition):
    """Rows whose key lies between two numbers, both included."""

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], tasks: int):
        self.path, self.columns, self.tasks = path, columns, tasks

    def partitions(self) -> list[_Keys]:
        with sqlite3.connect(self.path) as db:
            first, last = db.execute(f"SELECT min({KEY}), max({KEY}) FROM {TABLE}").fetchone()
        if first is None:
            return [_Keys(0, -1)]
        step = -(-(last - first + 1) // self.tasks)
        return [_Keys(at, min(at + step - 1, last)) for at in range(first, last + 1, step)]

    def read(self, keys: _Keys) -> Iterator[pa.RecordBatch]:
        with sqlite3.connect(self.path) as db:
            rows = db.execute(f"SELECT {', '.join(self.columns)} FROM {TABLE} WHERE {KEY} BETWEEN ? AND ? ORDER BY {KEY}", (keys.first, keys.last))
            while some := rows.fetchmany(ROWS):
                yield pa.RecordBatch.from_arrays([_array(c, values) for c, values in zip(self.columns, zip(*some, strict=True), strict=True)], names=self.columns)


@dataclass
class Part(WriterCommitMessage):
    """A file of one task's rows."""

    path: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.job = path, columns, uuid.uuid4().hex

    def _made(self, db: sqlite3.Connection) -> None:
        """Add the table, and what an older one lacks."""
        db.execute(f"CREATE TABLE IF NOT EXISTS {TABLE} ({KEY} INTEGER PRIMARY KEY AUTOINCREMENT, {', '.join(f'{c} {_kind(c)}' for c in S.STORE_COLUMNS)})")
        for c in set(S.STORE_COLUMNS).difference(_columns(db)):
            db.execute(f"ALTER TABLE {TABLE} ADD COLUMN {c} {_kind(c)}")

    def _indexed(self, db: sqlite3.Connection) -> None:
        """Last, so that a new store's indexes are sorted once and not built row by row."""
        for c in ("timestamp", "pmr_channel"):
            db.execute(f"CREATE INDEX IF NOT EXISTS {TABLE}_{c} ON {TABLE} ({c})")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        part = Part(f"{self.path}.{self.job}.{uuid.uuid4().hex}.part", 0)

        def counted():
            for batch in batches:
                part.rows += len(batch)
                columns = [c.cast(pa.int64()) if pa.types.is_boolean(c.type) else c for c in batch.columns]
                yield from zip(*(c.to_pylist() for c in columns), strict=True)

        with sqlite3.connect(part.path) as db:
            db.execute("PRAGMA journal_mode = OFF")  # a part that isn't finished is thrown away
            db.execute("PRAGMA synchronous = OFF")
            db.execute(f"CREATE TABLE part ({', '.join(f'{c} {_kind(c)}' for c in self.columns)})")
            db.executemany(f"INSERT INTO part VALUES ({', '.join('?' * len(self.columns))})", counted())
        db.close()
        return part

    def commit(self, messages: list[Part | None]) -> None:
        with sqlite3.connect(self.path, timeout=60.0, isolation_level=None) as db:
            db.execute(f"PRAGMA cache_size = -{CACHE_KB}")
            db.execute("BEGIN IMMEDIATE")
            try:
                self._made(db)
                for m in messages:
                    if m is not None:
                        source = sqlite3.connect(m.path)
                        db.executemany(f"INSERT INTO {TABLE} ({', '.join(self.columns)}) VALUES ({', '.join('?' * len(self.columns))})", source.execute("SELECT * FROM part ORDER BY rowid"))
                        source.close()
                self._indexed(db)
                db.execute("COMMIT")
            except BaseException:
                db.execute("ROLLBACK")
                raise
        db.close()
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        for path in glob.glob(f"{glob.escape(self.path)}.{self.job}.*.part*"):
            os.remove(path)


class SqliteStore(DataSource):
    """Options: ``path``; ``tasks`` (16), into how many ranges of the key a store is cut. Only appending is possible."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_store"

    def _present(self) -> list[str]:
        path = self.options["path"]
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        with sqlite3.connect(path) as db:
            have = _columns(db)
        return [KEY, *(c for c in S.STORE_COLUMNS if c in have)]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, _SPARK[_kind(c)]) for c in self._present()])

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"], schema.fieldNames(), int(self.options.get("tasks", 16)))

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("a store is only appended to")
        unknown = set(schema.fieldNames()).difference(S.STORE_COLUMNS)
        if unknown:
            raise ValueError(f"no columns of the store: {', '.join(sorted(unknown))}")
        return _Writer(self.options["path"], schema.fieldNames())
