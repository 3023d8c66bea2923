"""Array archives (.npz) and SQLite files as Spark sources and sinks.

Both write one file per task, first under a name that starts with a point and then renamed, so a reader never sees half a
file; files of a failed write are removed. Paths are local ones or file: addresses that all executors share. Readers cut
files into ranges of rows, so a large file is no single task, and read only the columns asked for.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a file that a task reads.
RANGE = 1 << 20


def local(path: str) -> str:
    """A file: address as a path; other file systems can't be mapped into memory or opened by SQLite."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"not a file system that executors can open: {path}")
    return path


@dataclass
class Rows(InputPartition):
    file: str
    first: int
    last: int


@dataclass
class Written(WriterCommitMessage):
    file: str


class _Reader(DataSourceReader):
    ending = ""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.folder, self.arrow = options, local(options["path"]), to_arrow_schema(schema)

    def files(self) -> list[str]:
        if os.path.isfile(self.folder):
            return [self.folder]
        return sorted(os.path.join(self.folder, f) for f in os.listdir(self.folder) if f.endswith(self.ending) and not f.startswith("."))

    def extent(self, file: str) -> tuple[int, int]:
        raise NotImplementedError

    def partitions(self) -> list[Rows]:
        step, out = int(self.options.get("range", RANGE)), []
        for f in self.files():
            first, end = self.extent(f)
            out += [Rows(f, a, min(a + step, end)) for a in range(first, end, step)]
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from self.rows(partition)

    def rows(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


class _Writer(DataSourceArrowWriter):
    ending = ""

    def __init__(self, options: dict):
        self.options, self.folder = options, local(options["path"])
        if os.path.exists(self.folder):
            raise FileExistsError(f"{self.folder} exists already")

    def save(self, table: pa.Table, file: str) -> None:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        batches = [b for b in iterator if b.num_rows]
        if not batches:
            return Written("")
        os.makedirs(self.folder, exist_ok=True)
        name = f"part-{uuid.uuid4().hex}{self.ending}"
        waiting = os.path.join(self.folder, f".{name}")
        self.save(pa.Table.from_batches(batches), waiting)
        os.replace(waiting, os.path.join(self.folder, name))
        return Written(os.path.join(self.folder, name))

    def commit(self, messages) -> None:
        os.makedirs(self.folder, exist_ok=True)

    def abort(self, messages) -> None:
        for m in messages:
            if m and m.file and os.path.exists(m.file):
                os.remove(m.file)


def _values(column: pa.ChunkedArray) -> np.ndarray:
    if column.null_count:
        raise ValueError("arrays can't hold nulls")
    if pa.types.is_list(column.type):
        flat = column.combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
    if pa.types.is_string(column.type):
        return np.array(column.to_pylist(), dtype=np.str_)
    return column.to_numpy()


def _column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    if values.ndim == 2:
        flat = pa.array(np.ascontiguousarray(values).reshape(-1))
        return pa.FixedSizeListArray.from_arrays(flat, values.shape[1]).cast(kind)
    return pa.array(values.tolist() if values.dtype.kind == "U" else values).cast(kind)


class _ArrayReader(_Reader):
    ending = ".npz"

    def extent(self, file: str) -> tuple[int, int]:
        with np.load(file, allow_pickle=False) as held:
            sizes = {len(held[n]) for n in self.arrow.names}
        if len(sizes) > 1:
            raise ValueError(f"arrays of {file} differ in length")
        return 0, sizes.pop() if sizes else 0

    def rows(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with np.load(partition.file, allow_pickle=False) as held:
            columns = [_column(held[f.name][partition.first : partition.last], f.type) for f in self.arrow]
        yield pa.RecordBatch.from_arrays(columns, schema=self.arrow)


class _ArrayWriter(_Writer):
    ending = ".npz"

    def save(self, table: pa.Table, file: str) -> None:
        with open(file, "wb") as out:
            np.savez_compressed(out, **{n: _values(table.column(n)) for n in table.column_names})


class ArrayFiles(DataSource):
    """Archives of named arrays of equal length, a row for each index; two-dimensional arrays are array columns."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        raise ValueError("give a schema: archives don't state column types")

    def reader(self, schema: StructType) -> _ArrayReader:
        return _ArrayReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> _ArrayWriter:
        return _ArrayWriter(dict(self.options))


class _MappedReader(_Reader):
    """One two-dimensional .npy file, mapped into memory: a task touches the pages of its rows only."""

    ending = ".npy"

    def extent(self, file: str) -> tuple[int, int]:
        return 0, len(np.load(file, mmap_mode="r", allow_pickle=False))

    def rows(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        held = np.load(partition.file, mmap_mode="r", allow_pickle=False)[partition.first : partition.last]
        places = pa.array(np.arange(partition.first, partition.last))
        yield pa.RecordBatch.from_arrays([places.cast(self.arrow[0].type), _column(held, self.arrow[1].type)], schema=self.arrow)


class _MappedWriter(_Writer):
    ending = ".npy"

    def save(self, table: pa.Table, file: str) -> None:
        with open(file, "wb") as out:
            np.save(out, _values(table.column(1)))


class MappedFiles(DataSource):
    """Matrices in .npy files: (place, vector), place being the row's number in its file."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "place long, vector array<float>"

    def reader(self, schema: StructType) -> _MappedReader:
        return _MappedReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> _MappedWriter:
        return _MappedWriter(dict(self.options))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(file: str) -> sqlite3.Connection:
    """Read-only: a file that isn't there is an error, and nothing can change one that is."""
    return sqlite3.connect(f"file:{file}?mode=ro", uri=True)


class _SqliteReader(_Reader):
    ending = ".sqlite"

    def extent(self, file: str) -> tuple[int, int]:
        con = _open(file)
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.options['table'])}").fetchone()
        finally:
            con.close()
        return (0, 0) if low is None else (low, high + 1)

    def rows(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        columns = ", ".join(_quoted(n) for n in self.arrow.names)
        con = _open(partition.file)
        try:
            found = con.execute(f"SELECT {columns} FROM {_quoted(self.options['table'])} WHERE rowid >= ? AND rowid < ?", (partition.first, partition.last))
            while rows := found.fetchmany(16_384):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.arrow, strict=True)], schema=self.arrow)
        finally:
            con.close()


class _SqliteWriter(_Writer):
    ending = ".sqlite"

    def save(self, table: pa.Table, file: str) -> None:
        con = sqlite3.connect(file)
        try:
            name = _quoted(self.options["table"])
            con.execute(f"CREATE TABLE {name} ({', '.join(map(_quoted, table.column_names))})")
            holes = ", ".join("?" * table.num_columns)
            for b in table.to_batches(16_384):
                con.executemany(f"INSERT INTO {name} VALUES ({holes})", zip(*[c.to_pylist() for c in b.columns], strict=True))
            con.commit()
        finally:
            con.close()


class SqliteFiles(DataSource):
    """The table named by option `table` in one SQLite file or a folder of them."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        raise ValueError("give a schema: columns of SQLite have no types")

    def reader(self, schema: StructType) -> _SqliteReader:
        return _SqliteReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> _SqliteWriter:
        return _SqliteWriter(dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    """The session, knowing the formats npz, npy and sqlite."""
    for source in (ArrayFiles, MappedFiles, SqliteFiles):
        spark.dataSource.register(source)
    return spark
