"""Messages between publisher and subscriber: a Python data source over an append-only log, for batch and for streams.

The log is a folder.  ``segments`` holds immutable Parquet files; ``index`` holds one numbered entry for each publication, which names its segments and
their row counts and is created only if its number is free.  So a publication is visible whole or not at all, several publishers can't take the same
place, and a micro-batch that is published again after a restart is recognised and not added twice.  The order of entries gives every message an offset.

``groups`` holds how far each group of subscribers was handed messages and how far it has acknowledged them.  A stream's offset is a number of messages, its
partitions are row ranges of segments, so any number of tasks read a micro-batch.  A new stream of a group begins after the last acknowledged message:
what was handed out and not acknowledged is delivered again, in its first micro-batch.  A stream that is restarted from its checkpoint goes on from there.

Options.  ``path``: the folder.  ``group``: needed for streams; one stream at a time.  ``max_messages``: the most a micro-batch takes.  ``rate``: messages a second at most, counted
from the stream's start.  ``ack``: "commit" acknowledges what Spark has committed, "sink" leaves it to what stores the messages.  ``rows_per_task``: the most rows of a segment that one task reads.

Workers read and write the folder through ``pyarrow.fs``, so it may be local, HDFS, S3 or GCS.  A store without a rename or an exclusive create leaves
it to the caller that one publisher writes at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamArrowWriter, DataSourceArrowWriter, InputPartition, WriterCommitMessage

FORMAT = "gridmill_messages"
SCHEMA = "id string, sent timestamp, topic string, payload string, offset long"
#: What a publisher gives; the log adds the offset.
GIVEN = ["id", "sent", "topic", "payload"]
ROW_GROUP, SEGMENT_ROWS = 8192, 200_000


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _written(store, path: str, told: dict) -> None:
    """Write a small file whole: readers see the old one or the new one."""
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(json.dumps(told).encode())
    store.move(part, path)


def _read(store, path: str) -> dict:
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


@dataclass
class Slice(InputPartition):
    """Rows ``low`` to ``high`` of a segment, the first of which has offset ``offset``."""

    file: str
    low: int
    high: int
    offset: int


class Log:
    """The folder of a log, as driver and tasks see it."""

    def __init__(self, path: str):
        self.store, self.path = _opened(path.rstrip("/"))
        self.entries: list[dict] = []  # each with the offset of its first message

    def entry(self, number: int) -> str:
        return f"{self.path}/index/{number:09d}.json"

    def refresh(self) -> int:
        """Learn of publications since the last call; returns the number of messages."""
        from pyarrow import fs

        while self.store.get_file_info(self.entry(len(self.entries))).type != fs.FileType.NotFound:
            told = _read(self.store, self.entry(len(self.entries)))
            self.entries.append(told | {"first": self.end})
        return self.end

    @property
    def end(self) -> int:
        return self.entries[-1]["first"] + sum(n for _, n in self.entries[-1]["segments"]) if self.entries else 0

    def slices(self, start: int, end: int, rows: int) -> list[Slice]:
        """The rows with offsets from ``start`` to ``end``, at most ``rows`` in each part."""
        found = []
        for told in self.entries:
            first = told["first"]
            for file, n in told["segments"]:
                low, high = max(start - first, 0), min(end - first, n)
                found += [Slice(file, a, min(a + rows, high), first + a) for a in range(low, high, rows)]
                first += n
        return found

    def publish(self, publisher: str, batch: int, segments: list[tuple[str, int]]) -> bool:
        """Make ``segments`` visible as the next publication; False if this publisher's batch is there already."""
        from pyarrow import fs

        self.store.create_dir(f"{self.path}/index")
        while True:
            self.refresh()
            if batch >= 0 and any(x["publisher"] == publisher and x["batch"] == batch for x in self.entries):
                return False
            told = {"publisher": publisher, "batch": batch, "segments": segments}
            if isinstance(self.store, fs.LocalFileSystem):
                import os

                part = f"{self.path}/index/{uuid.uuid4().hex}"
                with open(part, "w") as out:
                    json.dump(told, out)
                try:
                    os.link(part, self.entry(len(self.entries)))  # fails if another publisher has taken the number
                    return True
                except FileExistsError:
                    continue
                finally:
                    os.remove(part)
            _written(self.store, self.entry(len(self.entries)), told)
            return True

    def group(self, name: str) -> dict:
        """{"acked": n, "handed": n} of a group."""
        from pyarrow import fs

        path = f"{self.path}/groups/{name}.json"
        there = self.store.get_file_info(path).type != fs.FileType.NotFound
        return _read(self.store, path) if there else {"acked": 0, "handed": 0}

    def move(self, name: str, **to: int) -> None:
        """Move a group's ``acked`` or ``handed`` on; they never go back."""
        now = self.group(name)
        then = now | {k: max(v, now[k]) for k, v in to.items()}
        if then != now:
            self.store.create_dir(f"{self.path}/groups")
            _written(self.store, f"{self.path}/groups/{name}.json", then)

    def read(self, part: Slice) -> Iterator:
        """The slice's rows as Arrow batches; only its own row groups are read."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        file = pq.ParquetFile(self.store.open_input_file(f"{self.path}/segments/{part.file}"))
        at = 0
        for k in range(file.num_row_groups):
            n = file.metadata.row_group(k).num_rows
            low, high = max(part.low - at, 0), min(part.high - at, n)
            if low < high:
                for batch in file.read_row_group(k, columns=GIVEN).slice(low, high - low).to_batches():
                    first = part.offset + (at + low - part.low)
                    low += batch.num_rows
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(first, first + batch.num_rows), pa.int64())], names=[*GIVEN, "offset"])
            at += n


@dataclass
class Segments(WriterCommitMessage):
    files: list


def _segments(path: str, batches) -> Segments:
    """Write a task's messages as segments, which nothing names yet."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    log, files, writer = Log(path), [], None
    log.store.create_dir(f"{log.path}/segments")
    for batch in batches:
        table = pa.Table.from_batches([batch]).select(GIVEN)
        if writer is None:
            files.append([f"{uuid.uuid4().hex}.parquet", 0])
            writer = pq.ParquetWriter(log.store.open_output_stream(f"{log.path}/segments/{files[-1][0]}"), table.schema, compression="zstd", use_dictionary=["topic"])
        writer.write_table(table, row_group_size=ROW_GROUP)
        files[-1][1] += table.num_rows
        if files[-1][1] >= SEGMENT_ROWS:
            writer.close()
            writer = None
    if writer is not None:
        writer.close()
    return Segments(files)


def _published(path: str, publisher: str, batch: int, messages) -> None:
    segments = [tuple(x) for m in messages if m is not None for x in m.files if x[1]]
    if segments:
        Log(path).publish(publisher, batch, segments)


def _dropped(path: str, messages) -> None:
    log = Log(path)
    for file, _ in (x for m in messages if m is not None for x in m.files):
        log.store.delete_file(f"{log.path}/segments/{file}")


class Writer(DataSourceArrowWriter):
    """One publication of a batch's rows."""

    def __init__(self, path: str):
        self.path, self.publisher = path, uuid.uuid4().hex

    def write(self, iterator):
        return _segments(self.path, iterator)

    def commit(self, messages):
        _published(self.path, self.publisher, -1, messages)

    def abort(self, messages):
        _dropped(self.path, messages)


class StreamWriter(DataSourceStreamArrowWriter):
    """One publication for each micro-batch; one that is done again isn't added twice."""

    def __init__(self, path: str, publisher: str):
        self.path, self.publisher = path, publisher

    def write(self, iterator):
        return _segments(self.path, iterator)

    def commit(self, messages, batchId):  # noqa: N803
        _published(self.path, self.publisher, batchId, messages)

    def abort(self, messages, batchId):  # noqa: N803
        _dropped(self.path, messages)


class Reader(DataSourceReader):
    """All messages that are there."""

    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self):
        log = Log(self.path)
        return log.slices(0, log.refresh(), self.rows) or [Slice("", 0, 0, 0)]

    def read(self, partition):
        return Log(self.path).read(partition) if partition.file else iter(())


class StreamReader(DataSourceStreamReader):
    """Messages after the last acknowledged one, no faster than the options allow."""

    def __init__(self, path: str, group: str, most: int, rate: float, ack: str, rows: int):
        self.path, self.name, self.most, self.rate, self.ack, self.rows = path, group, most, rate, ack, rows
        self.log, self.begun = None, None

    def _log(self) -> Log:
        if self.log is None:
            self.log = Log(self.path)
            self.log.refresh()
        return self.log

    def initialOffset(self):  # noqa: N802
        return {"n": self._log().group(self.name)["acked"]}

    def latestOffset(self):  # noqa: N802
        log = self._log()
        there, now = log.refresh(), log.group(self.name)
        at = max(now["acked"], now["handed"])
        if self.begun is None:
            self.begun = (time.monotonic(), at)
        # Spark asks for this before it tells where it goes on from, so the least answer is the furthest place that any stream of the group was handed.
        end = min(there, at + self.most) if self.most else there
        if self.rate:
            end = min(end, self.begun[1] + int((time.monotonic() - self.begun[0]) * self.rate))
        return {"n": max(end, at)}

    def partitions(self, start, end):
        log = self._log()
        log.refresh()
        log.move(self.name, handed=end["n"])
        return log.slices(start["n"], end["n"], self.rows)

    def read(self, partition):
        return Log(self.path).read(partition)

    def commit(self, end):
        if self.ack == "commit":
            self._log().move(self.name, acked=end["n"])


class Messages(DataSource):
    """``spark.readStream.format("gridmill_messages")``, and the same for ``read``, ``write`` and ``writeStream``."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def _rows(self) -> int:
        return int(self.options.get("rows_per_task", "50000"))

    def reader(self, schema):
        return Reader(self.options["path"], self._rows())

    def streamReader(self, schema):  # noqa: N802
        return StreamReader(self.options["path"], self.options["group"], int(self.options.get("max_messages", "0")), float(self.options.get("rate", "0")), self.options.get("ack", "commit"), self._rows())

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("a log is only appended to")
        return Writer(self.options["path"])

    def streamWriter(self, schema, overwrite):  # noqa: N802
        return StreamWriter(self.options["path"], self.options["publisher"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session; doing it again changes nothing."""
    spark.dataSource.register(Messages)
