"""A capturer's log as a streaming source of its own: files that grow, read by file and position."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .changes import CAPTURED, captured_changes

_MAP = pa.map_(pa.string(), pa.string())
_BATCH = pa.schema(
    [("seq", pa.int64()), ("type", pa.string()), ("is_ddl", pa.bool_()), ("db", pa.string()), ("table", pa.string()), ("pk", pa.list_(pa.string())), ("es", pa.int64()), ("ts", pa.int64())]
    + [("before", _MAP), ("after", _MAP), ("updated", pa.list_(pa.string())), ("file", pa.string()), ("position", pa.int64())]
)
_DDL = f"{CAPTURED}, file string, position bigint"


@dataclass
class LogRange(InputPartition):
    """Lines of one file that begin in [start, end)."""

    file: str
    start: int
    end: int


#: About as many tasks read a batch at most, as long as none of them has more than TASK_BYTES.
MOST_TASKS, TASK_BYTES = 128, 32 << 20


class LostLog(RuntimeError):
    """The log no longer holds what a stream has still to read."""


class _Log:
    def __init__(self, options: dict):
        self.fs, self.root = pafs.FileSystem.from_uri(options["path"]) if "://" in options["path"] or options["path"].startswith("file:") else (pafs.LocalFileSystem(), options["path"])
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", 32 << 20)))
        self.per_batch = int(options.get("maxbytespertrigger", options.get("maxBytesPerTrigger", 0)))

    def files(self) -> list[tuple[str, int]]:
        """(name, size) in the order of names, which is that of the log."""
        found = self.fs.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))
        return sorted((f.base_name, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_")))

    def open(self, name: str) -> pa.NativeFile:
        return self.fs.open_input_file(f"{self.root}/{name}")

    def whole_lines(self, name: str, size: int) -> int:
        """The end of the last whole line within size bytes: what a capturer is still writing is left for later."""
        with self.open(name) as source:
            end = size
            while end > 0:
                start = max(0, end - (1 << 16))
                at = source.read_at(end - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def ranges(self, start: dict, end: dict) -> list[LogRange]:
        """Ranges of range_bytes, or larger ones where a batch holds so much that these would be very many tasks."""
        out, found = [], []
        for name, size in self.files():
            low = start["position"] if name == start["file"] else 0
            high = end["position"] if name == end["file"] else size
            if start["file"] <= name <= end["file"]:
                found.append((name, low, high))
        share = max(self.range_bytes, min(TASK_BYTES, -(-sum(high - low for _, low, high in found) // MOST_TASKS)))
        for name, low, high in found:
            out += [LogRange(name, at, min(high, at + share)) for at in range(low, high, share)]
        return out

    def read(self, part: LogRange) -> Iterator[pa.RecordBatch]:
        """The rows of the lines that begin inside a range; a line that began before it belongs to the range before."""
        rows: list[dict] = []
        with self.open(part.file) as source:
            at = part.start
            if at and source.read_at(1, at - 1) != b"\n":
                at = self._next_line(source, at)
            source.seek(at)
            rest, base = b"", at
            while base < part.end:
                data = source.read(min(1 << 20, max(1 << 16, part.end - base)))
                lines = (rest + data).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if base >= part.end:
                        break
                    if line.strip():
                        rows.append(json.loads(line) | {"file": part.file, "position": base})
                    base += len(line) + 1
                if rows:
                    yield self._batch(rows)
                    rows = []
                if not data:
                    break

    @staticmethod
    def _next_line(source: pa.NativeFile, at: int) -> int:
        while data := source.read_at(1 << 16, at):
            found = data.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(data)
        return at

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        def column(f: pa.Field) -> pa.Array:
            values = [r.get(f.name) for r in rows]
            if f.type == _MAP:
                values = [None if v is None else [(k, None if x is None else str(x)) for k, x in v.items()] for v in values]
            return pa.array(values, f.type)

        return pa.RecordBatch.from_arrays([column(f) for f in _BATCH], schema=_BATCH)


class _LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.log = _Log(options)

    def partitions(self) -> list[LogRange]:
        files = self.log.files()
        if not files:
            return [LogRange("", 0, 0)]
        name, size = files[-1]
        return self.log.ranges({"file": "", "position": 0}, {"file": name, "position": self.log.whole_lines(name, size)}) or [LogRange("", 0, 0)]

    def read(self, partition: LogRange) -> Iterator[pa.RecordBatch]:
        return self.log.read(partition) if partition.file else iter(())


class _LogStreamReader(DataSourceStreamReader):
    """Offsets are {"file", "position"}: all lines before that place are read. A stream begins at the start option: earliest or latest."""

    def __init__(self, options: dict):
        self.log, self.begin = _Log(options), options.get("start", "earliest")
        self.reached: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return self._end() if self.begin == "latest" else {"file": "", "position": 0}

    def _end(self) -> dict:
        for name, size in reversed(self.log.files()):
            if whole := self.log.whole_lines(name, size):
                return {"file": name, "position": whole}
        return {"file": "", "position": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        end = self._end()
        if not self.log.per_batch or self.reached is None:
            return end if not self.log.per_batch else self._limited({"file": "", "position": 0}, end)
        return self._limited(self.reached, end)

    def _limited(self, start: dict, end: dict) -> dict:
        """The place about per_batch bytes behind start, at a line's end, and not beyond end."""
        left = self.log.per_batch
        for part in self.log.ranges(start, end):
            if part.end - part.start >= left:
                size = next(s for n, s in self.log.files() if n == part.file)
                with self.log.open(part.file) as source:
                    at = self.log._next_line(source, part.start + left - 1)
                return {"file": part.file, "position": min(at, size if part.file != end["file"] else end["position"])}
            left -= part.end - part.start
        return end

    def partitions(self, start: dict, end: dict) -> list[LogRange]:
        """Fails with LostLog where the log has dropped or cut a file that is still to be read from."""
        files = dict(self.log.files())
        if start["file"] and start["file"] not in files and any(n > start["file"] for n in files) or files.get(start["file"], start["position"]) < start["position"]:
            raise LostLog(f"{start['file']} is gone or shorter than {start['position']}")
        if end["file"] and files.get(end["file"], -1) < end["position"]:
            raise LostLog(f"{end['file']} is gone or shorter than {end['position']}")
        self.reached = end
        return self.log.ranges(start, end)

    def read(self, partition: LogRange) -> Iterator[pa.RecordBatch]:
        return self.log.read(partition)

    def commit(self, end: dict) -> None:
        self.reached = end


class CaptureLog(DataSource):
    """Format docloom_capture: rows (CAPTURED, file, position) of a folder of log files, one JSON row image a line.

    Files follow one another by name; the last one may still grow, and a line without its end waits for it. Options: path (a
    folder that driver and executors share, or a URI that pyarrow opens), start (earliest or latest), rangeBytes (a task's
    share of a file; up to 32 MB where a batch would be more than 128 tasks) and maxBytesPerTrigger."""

    @classmethod
    def name(cls) -> str:
        return "docloom_capture"

    def schema(self) -> str:
        return _DDL

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _LogStreamReader(dict(self.options))


def capture_log(spark: SparkSession, path: str, *, stream: bool = True, **options) -> DataFrame:
    """Changes (CHANGE) from a capturer's growing log files. A stream keeps its place (file and position) in its checkpoint, goes on there
    after a restart, and fails if the log has lost what comes next (see streaming.supervise)."""
    spark.dataSource.register(CaptureLog)
    reader = (spark.readStream if stream else spark.read).format("docloom_capture").options(path=path, **options)
    return captured_changes(reader.load())


def retained(path: str) -> dict:
    """The first file that a capture log still holds, and its size: see streaming.supervise.gaps."""
    files = _Log({"path": path}).files()
    return {"file": files[0][0], "size": files[0][1]} if files else {"file": "", "size": 0}
