"""A sink for one JSON array with a row a line, written whole or not at all.

A Python data source: every task writes its rows, as ``json.dumps`` gives them, to a file of its own beside the target; the
commit joins the files of the tasks that succeeded, in the order of their parts, to a file that then takes the target's name.
A failed run leaves what was there before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes that are copied at a time.
STEP = 1 << 20


def _at(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith(("/", "file:")) else f"file://{path}")


def exists(path: str) -> bool:
    system, at = _at(path)
    return system.get_file_info(at).type != pyarrow.fs.FileType.NotFound


def plain(value):
    """A value as JSON has it: rows and maps as objects in their order, nulls kept."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in zip(value.__fields__, value, strict=True)}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def line(row: Row, names: list[str]) -> str:
    return json.dumps({n: plain(v) for n, v in zip(names, row, strict=True)}, ensure_ascii=False, separators=(", ", ": "))


@dataclass
class _Part(WriterCommitMessage):
    part: int
    path: str
    rows: int


class JsonArrayWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names, self.run = path, names, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        task = TaskContext.get()
        system, at = _at(self.path)
        path = f"{at}.{self.run}.part-{task.partitionId():05d}-{task.taskAttemptId()}"
        n = 0
        with system.open_output_stream(path) as out:
            for row in rows:
                out.write(((",\n" if n else "") + line(row, self.names)).encode())
                n += 1
        return _Part(task.partitionId(), path, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, at = _at(self.path)
        parts = sorted((m for m in messages if m), key=lambda m: m.part)
        whole = f"{at}.{self.run}.tmp"
        with system.open_output_stream(whole) as out:
            out.write(b"[\n")
            begun = False
            for p in parts:
                if p.rows:
                    out.write(b",\n" if begun else b"")
                    begun = True
                    with system.open_input_stream(p.path) as held:
                        while chunk := held.read(STEP):
                            out.write(chunk)
            out.write(b"\n]\n")
        system.move(whole, at)
        self._clear(parts)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear([m for m in messages if m])

    def _clear(self, parts: list[_Part]) -> None:
        system, at = _at(self.path)
        for p in parts:
            system.delete_file(p.path)


class JsonArraySource(DataSource):
    """Format ``json_array``; option ``path``. Writing replaces the file."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        path = self.options["path"]
        if not overwrite and exists(path):
            raise FileExistsError(path)
        return JsonArrayWriter(path, schema.names)


def write(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes ``df`` in its order; an array of no rows is ``[``, an empty line and ``]``."""
    df.sparkSession.dataSource.register(JsonArraySource)
    system, at = _at(path)
    system.create_dir(at.rsplit("/", 1)[0])
    df.write.format("json_array").mode("overwrite" if overwrite else "append").option("path", path).save()
