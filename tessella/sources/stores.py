"""Sources and a sink through Spark's Python Data Source interface, and stores that a setting selects.

`register(spark)` makes the formats known: "packed_vectors" (read, write), "kv_store" (read) and
"event_text" (read, readStream). Paths may be of any file system that pyarrow opens by URI; files are
listed by the driver and opened by the tasks only.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

#: Kinds of stores; "tessella.store.<kind>" names the format of each, "tessella.store.<kind>.<option>" its options.
KINDS = ("kv", "vectors", "graph", "status")
_HEAD = 8
_END = b"\n\n"


def register(spark: SparkSession) -> None:
    for source in (PackedVectors, KvStore, EventText):
        spark.dataSource.register(source)


def open_store(spark: SparkSession, kind: str, path: str | None = None) -> DataFrame:
    """The store of a kind, of the format that the session's settings name; Parquet if they don't."""
    if kind not in KINDS:
        raise ValueError(f"no such store: {kind}")
    register(spark)
    name = f"tessella.store.{kind}"
    options = {k.removeprefix(f"{name}."): v for k, v in spark.conf.getAll.items() if k.startswith(f"{name}.")}
    reader = spark.read.format(spark.conf.get(name, "parquet")).options(**options)
    return reader.load(path) if path else reader.load()


def _files(uri: str, ending: str) -> list[tuple[str, int]]:
    """(path, size) of the files below a folder or of one file, by name; none if there is nothing."""
    system, path = _system(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type != fs.FileType.Directory:
        return []
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(ending))


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub("^file:/(?!/)", "file:///", uri)
    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z][a-z0-9+.-]*:/", uri) else (fs.LocalFileSystem(), uri)


@dataclass
class Span(InputPartition):
    """Bytes of a file: [start, end) of `size`."""

    path: str
    start: int
    end: int
    size: int


def _spans(files: list[tuple[str, int]], most: int) -> list[Span]:
    return [Span(p, at, min(at + most, size), size) for p, size in files for at in range(0, size, most)]


# -- packed vectors ------------------------------------------------------------


class PackedVectors(DataSource):
    """int32 count, int32 dimension, float32 values, all little-endian. A file of another size than its head says gives no rows.

    Options: path, spanBytes (bytes for each task), rowsPerFile (of the writer).
    """

    @classmethod
    def name(cls) -> str:
        return "packed_vectors"

    def schema(self) -> str:
        return "path string, offset int, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _VectorReader(self.options["path"], int(self.options.get("spanBytes", 32 << 20)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _VectorWriter(self.options["path"], schema, int(self.options.get("rowsPerFile", 65_536)))


class _VectorReader(DataSourceReader):
    def __init__(self, uri: str, most: int):
        self.uri, self.most = uri, most

    def partitions(self) -> list[Span]:
        return _spans(_files(self.uri, ".bin"), self.most) or [Span("", 0, 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        """The vectors that begin in the span."""
        if span.size < _HEAD:
            return
        with _system(self.uri)[0].open_input_file(span.path) as f:
            n, dim = struct.unpack("<ii", f.read(_HEAD))
            if n <= 0 or dim <= 0 or span.size != _HEAD + 4 * n * dim:
                return
            first, last = (max(0, -(-(b - _HEAD) // (4 * dim))) for b in (span.start, span.end))
            last = min(last, n)
            step = max(1, (4 << 20) // (4 * dim))
            for a in range(first, last, step):
                b = min(a + step, last)
                f.seek(_HEAD + 4 * dim * a)
                flat = pa.array(np.frombuffer(f.read(4 * dim * (b - a)), "<f4"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, dim * (b - a) + 1, dim, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([pa.array([span.path] * (b - a)), pa.array(np.arange(a, b, dtype=np.int32)), lists], names=["path", "offset", "embedding"])


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _VectorWriter(DataSourceArrowWriter):
    """Rows with a column embedding, in their order; each task writes files of its own, which an aborted job takes back."""

    def __init__(self, uri: str, schema, rows: int):
        self.uri, self.rows, self.job = uri, rows, uuid.uuid4().hex[:8]
        self.at = [f.name for f in schema.fields].index("embedding")

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        system, folder = _system(self.uri)
        system.create_dir(folder, recursive=True)
        task = TaskContext.get()
        made: list[str] = []
        held: list[np.ndarray] = []

        def close() -> None:
            x = np.concatenate(held)
            path = f"{folder}/{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.bin"
            with system.open_output_stream(path) as f:
                f.write(struct.pack("<ii", *x.shape) + x.astype("<f4").tobytes())
            made.append(path)
            held.clear()

        for batch in batches:
            lists = batch.column(self.at)
            if lists.null_count or len(set(lists.value_lengths().to_pylist())) > 1:
                raise ValueError("vectors of a file have one dimension")
            if not len(lists):
                continue
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            if held and held[0].shape[1] != x.shape[1]:
                raise ValueError("vectors of a file have one dimension")
            while len(x):
                room = self.rows - sum(map(len, held))
                held.append(x[:room])
                x = x[room:]
                if sum(map(len, held)) == self.rows:
                    close()
        if held:
            close()
        return _Written(made)

    def abort(self, messages: list[_Written | None]) -> None:
        system, _ = _system(self.uri)
        for m in messages:
            for path in m.files if m else ():
                system.delete_file(path)


# -- key-value folders ---------------------------------------------------------


class KvStore(DataSource):
    """JSON files {name: {chunk_ids: [...]}} of a folder, a task each; a missing folder and a malformed file are empty.

    Options: path, ending (of the files' names).
    """

    @classmethod
    def name(cls) -> str:
        return "kv_store"

    def schema(self) -> str:
        return "path string, name string, chunk_ids array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _KvReader(self.options["path"], self.options.get("ending", ".json"))


class _KvReader(DataSourceReader):
    def __init__(self, uri: str, ending: str):
        self.uri, self.ending = uri, ending

    def partitions(self) -> list[Span]:
        return [Span(p, 0, n, n) for p, n in _files(self.uri, self.ending)] or [Span("", 0, 0, 0)]

    def read(self, span: Span) -> Iterator[tuple]:
        if not span.size:
            return
        with _system(self.uri)[0].open_input_file(span.path) as f:
            try:
                held = json.loads(f.read())
            except ValueError:
                return
        for name, value in held.items() if isinstance(held, dict) else ():
            ids = value.get("chunk_ids") if isinstance(value, dict) else None
            yield span.path, name, [x for x in ids if isinstance(x, str)] if isinstance(ids, list) else []


# -- event streams -------------------------------------------------------------


class EventText(DataSource):
    """Event-stream text: events are closed by an empty line; columns event ("message" if unnamed) and data (null if none).

    A task reads the events that end in its bytes. A batch takes a file's unclosed last event too; a
    stream waits until it is closed, and follows files that grow. Option: path, spanBytes.
    """

    @classmethod
    def name(cls) -> str:
        return "event_text"

    def schema(self) -> str:
        return "path string, event string, data string"

    def reader(self, schema) -> DataSourceReader:
        return _EventReader(self.options["path"], int(self.options.get("spanBytes", 16 << 20)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _EventStream(self.options["path"], int(self.options.get("spanBytes", 16 << 20)))


def _events(uri: str, span: Span, closed_only: bool) -> Iterator[tuple]:
    if span.end <= span.start:
        return
    with _system(uri)[0].open_input_file(span.path) as f:
        # Back to where the first event that ends in the span begins.
        begin, tail = span.start, b""
        while begin > 0:
            step = min(4096, begin)
            f.seek(begin - step)
            tail = f.read(step) + tail
            begin -= step
            if (at := tail.rfind(_END)) >= 0:
                tail = tail[at + len(_END) :]
                break
        f.seek(span.start)
        left = tail
        at = span.start
        while at < span.end:
            part = f.read(min(1 << 20, span.end - at))
            if not part:
                break
            at += len(part)
            *whole, left = (left + part).split(_END)
            for one in whole:
                yield from _event(span.path, one)
        if not closed_only and span.end == span.size:
            yield from _event(span.path, left)


def _event(path: str, raw: bytes) -> Iterator[tuple]:
    text = raw.decode("utf-8", "replace")
    if text.strip():
        name, data = (re.search(rf"(?m)^{k}: ?(.*)$", text) for k in ("event", "data"))
        yield path, name.group(1) if name and name.group(1) else "message", data.group(1) if data else None


class _EventReader(DataSourceReader):
    def __init__(self, uri: str, most: int):
        self.uri, self.most = uri, most

    def partitions(self) -> list[Span]:
        return _spans(_files(self.uri, ".txt"), self.most) or [Span("", 0, 0, 0)]

    def read(self, span: Span) -> Iterator[tuple]:
        return _events(self.uri, span, False)


class _EventStream(DataSourceStreamReader):
    """Offsets are the sizes of the files that were seen."""

    def __init__(self, uri: str, most: int):
        self.uri, self.most = uri, most

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return dict(_files(self.uri, ".txt"))

    def partitions(self, start: dict, end: dict) -> list[Span]:
        out = []
        for path, size in end.items():
            a = start.get(path, 0)
            # An end mark may lie across two offsets: its event ends in the later one.
            out += [Span(path, at, min(at + self.most, size), size) for at in range(a, size, self.most)]
        return out or [Span("", 0, 0, 0)]

    def read(self, span: Span) -> Iterator[tuple]:
        return _events(self.uri, span, True)

    def commit(self, end: dict) -> None:
        pass
