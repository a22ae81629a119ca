"""Collection in windows as a stream: each (operation, day) is a step of the offset, and a cursor moves when the sink has it."""

from __future__ import annotations

import datetime
import json
import os
import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

Fetch = Callable[[str, datetime.date], Iterable[tuple]]


class Cursor:
    """How many windows were planned, and how many the sink has, in a small file that a write replaces whole."""

    def __init__(self, path: str):
        self.fs, self.path = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)

    def read(self) -> dict:
        if self.fs.get_file_info(self.path).type == pafs.FileType.NotFound:
            return {"planned": 0, "committed": 0}
        with self.fs.open_input_stream(self.path) as f:
            return json.loads(f.read())

    def write(self, **marks: int) -> None:
        new = self.read()
        new |= {k: max(new[k], v) for k, v in marks.items()}
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        with self.fs.open_output_stream(self.path + ".new") as f:
            f.write(json.dumps(new).encode())
        self.fs.move(self.path + ".new", self.path)


class Window(InputPartition):
    def __init__(self, operation: str, day: datetime.date):
        self.operation, self.day = operation, day


class WindowReader(DataSourceStreamReader):
    """Offsets count the windows in the order of days, then operations, so they go on as days are added. A batch reads
    one partition a window; ``commit`` moves the cursor, after the batch's sink."""

    def __init__(self, operations: Sequence[str], first: datetime.date, last: datetime.date, fetch: Fetch, cursor: str, per_batch: int):
        self.operations, self.first, self.last, self.fetch, self.path, self.per_batch = list(operations), first, last, fetch, cursor, per_batch

    def _total(self) -> int:
        return max(0, (self.last - self.first).days + 1) * len(self.operations)

    def _window(self, n: int) -> Window:
        return Window(self.operations[n % len(self.operations)], self.first + datetime.timedelta(days=n // len(self.operations)))

    def _offset(self, n: int) -> dict:
        """The number of windows, and the last of them for those who read the log."""
        w = self._window(n - 1) if n else None
        return {"windows": n, "operation": w.operation if w else None, "day": w.day.isoformat() if w else None}

    def initialOffset(self) -> dict:
        return self._offset(0)

    def latestOffset(self) -> dict:
        return self._offset(min(self._total(), Cursor(self.path).read()["planned"] + self.per_batch))

    def partitions(self, start: dict, end: dict) -> list[Window]:
        Cursor(self.path).write(planned=end["windows"])
        return [self._window(n) for n in range(start["windows"], end["windows"])]

    def read(self, partition: Window) -> Iterator[tuple]:
        try:
            rows = list(self.fetch(partition.operation, partition.day))
        except Exception as e:  # one window that fails must not stop the others; the row tells
            yield partition.operation, partition.day, None, type(e).__name__
            return
        for row in rows:
            yield partition.operation, partition.day, json.dumps(row, default=str, ensure_ascii=False), None

    def commit(self, end: dict) -> None:
        Cursor(self.path).write(committed=end["windows"])


def window_source(name: str, operations: Sequence[str], first: datetime.date, last: datetime.date, fetch: Fetch, cursor: str, per_batch: int = 64) -> type[DataSource]:
    """A source to register: ``fetch(operation, day)`` runs in the tasks and gives a window's rows; the stream has
    (operation, day, item as JSON, error). A window that fails gives one row with the kind of error."""

    class WindowSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "operation string, day date, item string, error string"

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return WindowReader(operations, first, last, fetch, cursor, per_batch)

    return WindowSource


def collect_windows(stream: DataFrame, table: str, checkpoint: str, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Each batch replaces the windows it brings in ``table`` (Parquet by operation and day), so a batch that runs again
    after a failure gives the same table. ``after(batch)`` runs when the rows are written."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("operation", "day").parquet(table)
        if after:
            after(number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that driver and executors share; a local one where the session names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        return tempfile.mkdtemp(prefix=f"noticeflow-{name}-")
    return f"{shared.rstrip('/')}/noticeflow-{name}-{os.urandom(8).hex()}"
