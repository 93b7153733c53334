"""Queues as a data source of Spark: `spark.read`, `readStream` and `write` with format "record_queue".

A queue is a folder of files of JSON lines and a log. A write puts its rows into files, one for each task, and its commit adds one
entry to the log, which lists them with their numbers of rows; files without an entry are never read. An entry's name is its
number, so entries are in order. A stream's offset is a number of entries: a micro-batch reads the files of the entries between two
offsets, one partition each. Batch reads see all entries. Size and the last records come from the log, without
reading what they do not show. One writer commits at a time.

    spark.dataSource.register(RecordQueue)
    df.write.format("record_queue").mode("append").save(path)     # the rows' JSON in one column: value
    spark.readStream.format("record_queue").load(path)            # value
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "record_queue"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    for other in ("s3a://", "s3n://"):
        uri = "s3://" + uri[len(other) :] if uri.startswith(other) else uri
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class Log:
    """The log of a queue."""

    def __init__(self, path: str):
        self.fs, self.top = _open(path.rstrip("/"))

    def names(self) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.top}/log", allow_not_found=True))
        return sorted(f.base_name for f in found if f.base_name.endswith(".json"))

    def entries(self, first: int, end: int | None = None) -> list[dict]:
        """Entries by number, from first up to end: files and their rows."""
        out = []
        for name in self.names()[first:end]:
            with self.fs.open_input_stream(f"{self.top}/log/{name}") as f:
                out.append(json.loads(f.read()))
        return out

    def append(self, files: list[dict]) -> None:
        number = len(self.names())
        self.fs.create_dir(f"{self.top}/log", recursive=True)
        # written under another name first, so that an entry is there as a whole
        made = f"{self.top}/log/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(made) as f:
            f.write(json.dumps({"files": files}).encode())
        self.fs.move(made, f"{self.top}/log/{number:012d}.json")

    def records(self, name: str) -> Iterator[str]:
        with self.fs.open_input_stream(f"{self.top}/data/{name}") as f:
            text = f.read().decode()
        yield from (json.loads(line) for line in text.split("\n") if line)


def size(path: str, since: int = 0) -> int:
    """Records of a queue, or of its entries from a number on; 0 without one."""
    return sum(f["rows"] for e in Log(path).entries(since) for f in e["files"])


def peek(path: str, n: int) -> list[str]:
    """The n records that came last, the last first. Of the log and the files only the ends are read."""
    log, out = Log(path), []
    for at in range(len(log.names()) - 1, -1, -1):
        for f in reversed(log.entries(at, at + 1)[0]["files"]):
            out += list(log.records(f["name"]))[::-1]
            if len(out) >= n:
                return out[:n]
    return out


def clear(path: str) -> None:
    """All records and the log go. A stream that reads the queue needs a new checkpoint afterwards."""
    fs, top = _open(path.rstrip("/"))
    for part in ("log", "data"):
        if fs.get_file_info(f"{top}/{part}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{top}/{part}")


@dataclass
class Part(InputPartition):
    """One file of a queue."""

    name: str

    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class _Files:
    def __init__(self, path: str):
        self.path = path

    def read(self, partition: Part | None) -> Iterator[tuple]:
        # without files there is one partition that is none
        for value in Log(self.path).records(partition.name) if partition is not None else ():
            yield (value,)


class _Reader(_Files, DataSourceReader):
    def partitions(self) -> list[Part]:
        return [Part(f["name"]) for e in Log(self.path).entries(0) for f in e["files"]]


class _StreamReader(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"entries": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"entries": len(Log(self.path).names())}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(f["name"]) for e in Log(self.path).entries(start["entries"], end["entries"]) for f in e["files"]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, top = _open(self.path.rstrip("/"))
        name, rows = f"{uuid.uuid4().hex}.jsonl", 0
        fs.create_dir(f"{top}/data", recursive=True)
        with fs.open_output_stream(f"{top}/data/{name}") as f:
            for r in iterator:
                # a record is one line, whatever it holds
                f.write(json.dumps(r[0]).encode() + b"\n")
                rows += 1
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        Log(self.path).append([{"name": m.name, "rows": m.rows} for m in messages if m is not None and m.rows])

    def abort(self, messages: list[Written | None]) -> None:
        fs, top = _open(self.path.rstrip("/"))
        for m in messages:
            if m is not None:
                fs.delete_file(f"{top}/data/{m.name}")


class RecordQueue(DataSource):
    """One string column, value."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            clear(self.options["path"])
        return _Writer(self.options["path"])
