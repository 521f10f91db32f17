"""Tables as SQLite files that other programs look keys up in: a data source with commit and abort.

A task builds its rows into a database in memory and puts it into a staging
folder of the job; the commit moves the files to their names and writes one more
with the job's metadata; an abort deletes the staging folder.
"""

from __future__ import annotations

import json
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, Row, ShortType, StringType, StructType

#: SQLite's name of each type that an index can have.
TYPES = {StringType: "TEXT", LongType: "INTEGER", IntegerType: "INTEGER", ShortType: "INTEGER", BooleanType: "INTEGER", DoubleType: "REAL", FloatType: "REAL"}
METADATA = "metadata.sqlite"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class SqliteWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        unknown = [f.name for f in schema.fields if type(f.dataType) not in TYPES]
        if unknown:
            raise ValueError(f"columns that an index cannot hold: {unknown}")
        self.schema, self.path, self.overwrite = schema, options["path"].rstrip("/"), overwrite
        self.key, self.about = options.get("key", schema.names[0]), json.loads(options.get("metadata", "{}"))
        self.staging = f"_staging-{uuid.uuid4().hex}"
        store, at = _store(self.path)
        store.create_dir(f"{at}/{self.staging}", recursive=True)  # here and not in tasks: one that outlives an abort must not bring it back

    def write(self, iterator: Iterator[Row]) -> Written:
        db, n = sqlite3.connect(":memory:"), 0
        names = ", ".join(f"{_quoted(f.name)} {TYPES[type(f.dataType)]}" for f in self.schema.fields)
        db.execute(f"CREATE TABLE entries ({names})")

        def counted() -> Iterator[tuple]:
            nonlocal n
            for row in iterator:
                n += 1
                yield tuple(row)

        db.executemany(f"INSERT INTO entries VALUES ({', '.join('?' * len(self.schema.fields))})", counted())
        db.execute(f"CREATE INDEX by_key ON entries ({_quoted(self.key)})")
        db.commit()
        name = f"part-{uuid.uuid4().hex}.sqlite"
        store, at = _store(self.path)
        with store.open_output_stream(f"{at}/{self.staging}/{name}") as out:
            out.write(db.serialize())
        db.close()
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        done = [m for m in messages if m is not None]
        old = [f.path for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.base_name.endswith(".sqlite")] if self.overwrite else []
        held = {} if self.overwrite else read_metadata(self.path)
        store.create_dir(f"{at}/{self.staging}", recursive=True)
        for m in done:
            store.move(f"{at}/{self.staging}/{m.name}", f"{at}/{m.name}")
        files = json.loads(held.get("files", "[]")) + [m.name for m in done]
        db = sqlite3.connect(":memory:")
        db.execute("CREATE TABLE metadata (key TEXT PRIMARY KEY, value TEXT)")
        values = {"rows": str(int(held.get("rows", "0")) + sum(m.rows for m in done)), "files": json.dumps(files), "columns": json.dumps(self.schema.names), "key": self.key} | {k: str(v) for k, v in self.about.items()}
        db.executemany("INSERT INTO metadata VALUES (?, ?)", sorted(values.items()))
        db.commit()
        with store.open_output_stream(f"{at}/{self.staging}/{METADATA}") as out:
            out.write(db.serialize())
        store.move(f"{at}/{self.staging}/{METADATA}", f"{at}/{METADATA}")  # from here on readers see the new files
        for path in old:
            if not path.endswith(f"/{METADATA}"):
                store.delete_file(path)
        store.delete_dir(f"{at}/{self.staging}")

    def abort(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        if store.get_file_info(f"{at}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/{self.staging}")


def _opened(store: fs.FileSystem, path: str) -> sqlite3.Connection:
    db = sqlite3.connect(":memory:")
    with store.open_input_file(path) as source:
        db.deserialize(source.read())
    return db


def read_metadata(path: str) -> dict[str, str]:
    """What the newest commit says: rows, files, columns, key and what the writer was given; empty without a commit."""
    store, at = _store(path.rstrip("/"))
    if store.get_file_info(f"{at}/{METADATA}").type != fs.FileType.File:
        return {}
    db = _opened(store, f"{at}/{METADATA}")
    try:
        return dict(db.execute("SELECT key, value FROM metadata"))
    finally:
        db.close()


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"].rstrip("/")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(name) for name in json.loads(read_metadata(self.path).get("files", "[]"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        store, at = _store(self.path)
        db = _opened(store, f"{at}/{partition.value}")
        kinds = [bool if isinstance(f.dataType, BooleanType) else None for f in self.schema.fields]
        try:
            for row in db.execute(f"SELECT {', '.join(_quoted(n) for n in self.schema.names)} FROM entries"):
                yield tuple(k(v) if k and v is not None else v for k, v in zip(kinds, row, strict=True))
        finally:
            db.close()


class SqliteIndex(DataSource):
    """format("sqlite_index"), options path, key (the first column) and metadata (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_index"

    def writer(self, schema: StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(schema, dict(self.options), overwrite)

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))


def write_index(df: DataFrame, path: str, key: str | None = None, metadata: dict[str, str] | None = None, mode: str = "overwrite") -> None:
    """A table as SQLite files, one a partition, each with an index on key; rows stay in no order."""
    df.sparkSession.dataSource.register(SqliteIndex)
    df.write.format("sqlite_index").option("path", path).option("key", key or df.columns[0]).option("metadata", json.dumps(metadata or {})).mode(mode).save()


def read_index(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of the files that the newest commit names."""
    spark.dataSource.register(SqliteIndex)
    return spark.read.format("sqlite_index").schema(schema).option("path", path).load()


def lookup(path: str, key: object) -> list[tuple]:
    """Rows of a key, as another program would look them up."""
    about = read_metadata(path)
    store, at = _store(path.rstrip("/"))
    found: list[tuple] = []
    for name in json.loads(about.get("files", "[]")):
        db = _opened(store, f"{at}/{name}")
        found += db.execute(f"SELECT * FROM entries WHERE {_quoted(about['key'])} = ?", (key,)).fetchall()
        db.close()
    return found
