"""A Python data source for run logs: lines of JSON, read in a batch or as a stream, written with commits.

`spark.read.format("run_log").load(folder)` gives each whole line as (file, line_at, value, torn): `line_at` is the byte where the
line begins, and a line that is no JSON object, or has no end yet, stands in `torn`, not in `value`. As a stream it goes on
from the byte where it stopped, per file, and takes no line before its end has come. A write puts every task's lines in a file of its own
under a hidden name; the commit gives it its name, an abort removes it.

Files lie in a folder that driver and executors share (a local or mounted path).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "file string, line_at long, value string, torn string"
#: Bytes of a file that one task reads, about.
SLICE = 32 << 20


def _whole(line: bytes) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def _files(folder: str) -> list[str]:
    return sorted(f for f in os.listdir(folder) if not f.startswith((".", "_")))


@dataclass
class Span(InputPartition):
    """Bytes of a file from `start` to `end`; the reader takes the lines that begin there."""

    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def _spans(folder: str, since: dict[str, int], until: dict[str, int]) -> list[Span]:
    return [
        Span(os.path.join(folder, f), low, min(low + SLICE, end)) for f, end in until.items() for low in range(since.get(f, 0), end, SLICE)
    ]


def _lines(span: Span, only_ended: bool) -> Iterator[tuple]:
    """Rows of the lines that begin within a span."""
    with open(span.path, "rb") as file:
        at = span.start
        if at:
            file.seek(at - 1)
            at += len(file.readline()) - 1  # the line that began before belongs to the span before
        file.seek(at)
        while at < span.end:
            line = file.readline()
            if not line:
                return
            ended = line.endswith(b"\n")
            if only_ended and not ended:
                return
            bare = line.rstrip(b"\r\n")
            text = bare.decode("utf-8", "replace")
            if text.strip():
                whole = _whole(bare)
                yield os.path.basename(span.path), at, text if whole else None, None if whole else text
            at += len(line)


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Span]:
        return _spans(self.folder, {}, {f: os.path.getsize(os.path.join(self.folder, f)) for f in _files(self.folder)})

    def read(self, partition: Span) -> Iterator[tuple]:
        return _lines(partition, False)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the ends of the last whole lines, by file."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        ends = {}
        for name in _files(self.folder):
            with open(os.path.join(self.folder, name), "rb") as file:
                at = file.seek(0, os.SEEK_END)
                while at:  # back to the last line end
                    low = max(0, at - 65536)
                    file.seek(low)
                    found = file.read(at - low).rfind(b"\n")
                    if found >= 0:
                        at = low + found + 1
                        break
                    at = low
            ends[name] = at
        return ends

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return _spans(self.folder, start, end)

    def read(self, partition: Span) -> Iterator[tuple]:
        return _lines(partition, True)


@dataclass
class _Written(WriterCommitMessage):
    name: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.run = folder, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> _Written:
        os.makedirs(self.folder, exist_ok=True)
        name, n = f"part-{self.run}-{uuid.uuid4().hex}.jsonl", 0
        with open(os.path.join(self.folder, f".{name}"), "w", encoding="utf-8") as file:
            for row in rows:
                file.write(json.dumps(row.asDict(True), ensure_ascii=False, default=str) + "\n")
                n += 1
        return _Written(name, n)

    def commit(self, messages: list) -> None:
        old = _files(self.folder) if self.overwrite else []
        kept = {m.name for m in messages if m is not None and m.rows}
        for name in kept:
            os.replace(os.path.join(self.folder, f".{name}"), os.path.join(self.folder, name))
        self._clear()
        for name in old:
            os.remove(os.path.join(self.folder, name))

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        """Remove this run's files that were not committed, those of tasks that died, too."""
        for name in os.listdir(self.folder) if os.path.isdir(self.folder) else []:
            if name.startswith(f".part-{self.run}-"):
                os.remove(os.path.join(self.folder, name))


class RunLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_log"

    def schema(self) -> str:
        return SCHEMA

    def _folder(self) -> str:
        return self.options["path"].removeprefix("file://")

    def reader(self, schema) -> _Reader:
        return _Reader(self._folder())

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self._folder())

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self._folder(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RunLog)
