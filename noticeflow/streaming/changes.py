"""Micro-batches: change detection and the outbox on a stream, and quotas as keyed state."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from noticeflow.operators.changes import archive_versions, detect_changes, merge_current
from noticeflow.operators.listing import last_wins


class SnapshotTable:
    """A table as numbered Parquet snapshots; the newest complete one is read, a batch written twice is one.

    With ``keys`` rows are dealt to ``buckets`` by a hash of them: a version then holds only the buckets that it changes,
    and each bucket's newest version counts, so neither reading for a batch nor writing it touches the rest.
    """

    def __init__(self, spark: SparkSession, root: str, schema, keys: Sequence[str] = (), buckets: int = 64):
        self.spark, self.root, self.schema, self.keys, self.buckets = spark, root.rstrip("/"), schema, list(keys), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets))

    def touched(self, df: DataFrame) -> set[int] | None:
        """The buckets of the rows' keys; None (all) without keys."""
        return {r[0] for r in df.select(self._bucket()).distinct().collect()} if self.keys else None

    def _names(self, path: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []

    def _versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names(self.root) if n.startswith("v") and "_SUCCESS" in self._names(f"{self.root}/{n}"))

    def _paths(self, before: int | None, buckets: set[int] | None) -> list[tuple[int, str]]:
        """(bucket, path) of all parts of the versions below one, the newest first; without keys the whole is bucket 0."""
        out = []
        for v in reversed([v for v in self._versions() if before is None or v < before]):
            parts = [(int(n.partition("=")[2]), f"{self.root}/v{v}/{n}") for n in self._names(f"{self.root}/v{v}") if n.startswith("__bucket=")] if self.keys else [(0, f"{self.root}/v{v}")]
            out += [(k, path) for k, path in sorted(parts) if buckets is None or k in buckets]
        return out

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, before: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The newest rows, or the newest below a version, of some buckets or all."""
        newest: dict[int, str] = {}
        for k, path in self._paths(before, buckets):
            newest.setdefault(k, path)
        return self._read(list(newest.values()))

    def read_all(self, before: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """All rows of the versions (below one) of a table to which each version only adds."""
        return self._read([path for _, path in self._paths(before, buckets)])

    def write(self, df: DataFrame, version: int) -> None:
        out = df.withColumn("__bucket", self._bucket()).write.partitionBy("__bucket") if self.keys else df.write
        out.mode("overwrite").parquet(f"{self.root}/v{version}")


def merge_batches(stream: DataFrame, current: SnapshotTable, archive: SnapshotTable, changes: SnapshotTable, keys: Sequence[str], digest: str, first_seen: str, last_seen: str, order: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Each micro-batch is merged into ``current``; replaced rows go to ``archive``, changes to ``changes``.

    ``archive`` and ``changes`` get only the batch's own rows (``read_all`` gives the whole); ``current`` is a full
    snapshot, or, dealt to buckets by its keys, those buckets that the batch touches, and only these and their archive
    are read. Snapshots carry the batch's number and start from the ones before it, so a batch that runs again after a
    failure gives the same tables: at-least-once delivery, exactly-once result. Of several rows of a key in one batch the
    last by ``order`` counts.
    """

    def run(batch: DataFrame, number: int) -> None:
        incoming = last_wins(batch, keys, order).persist()
        before = current.read(number, current.touched(incoming))
        archived = archive.read_all(number, archive.touched(incoming))
        changes.write(detect_changes(before, incoming, keys, digest).where("change in ('NEW', 'UPDATED')"), number)
        archive.write(archive_versions(before, incoming, archived, keys, digest), number)
        current.write(merge_current(before, incoming, keys, digest, first_seen, last_seen), number)
        incoming.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class DayQuota(StatefulProcessor):
    """Counts a source's calls by day. Days older than the newest ``days`` leave the state when a newer one comes, and a
    source that is not heard of for as long leaves it by its time to live, so the state does not grow with time."""

    def __init__(self, names: Sequence[str], limit: int, days: int):
        self.names, self.limit, self.days = names, limit, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getMapState("used", "day string", "used long", ttlDurationMs=self.days * 86_400_000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        source, day, call = self.names
        held = {d[0]: n[0] for d, n in self.used.iterator()}
        pdf = pd.concat(list(rows)).sort_values(["at", call])
        newest = max([*held, *pdf["day"]])
        first = (datetime.date.fromisoformat(newest) - datetime.timedelta(days=self.days - 1)).isoformat()
        place = pdf.groupby("day").cumcount() + 1 + pdf["day"].map(held).fillna(0).astype(int)
        late = pdf["day"] < first  # of a day that was counted and has left
        for d, n in pdf.loc[~late, "day"].value_counts().items():
            self.used.updateValue((d,), (held.get(d, 0) + int(n),))
        for d in held:
            if d < first:
                self.used.removeKey((d,))
        yield pd.DataFrame({source: key[0], day: pdf["day"], call: pdf[call], "accepted": (place <= self.limit) & ~late})

    def close(self) -> None:
        pass


def quota_stream(stream: DataFrame, source: str, at: str, key: str, limit: int, days: int = 2) -> DataFrame:
    """Rows of a stream with ``accepted``: within the first ``limit`` of their source and day, as keyed state.

    The state holds ``days`` days of a source, whatever the stream's length. Calls of an older day come too late to be
    counted and are not accepted. Needs the RocksDB state store, and batches without data switched off (``session``).
    """
    kinds = dict(stream.dtypes)
    keyed = stream.select(F.col(source), F.date_format(at, "yyyy-MM-dd").alias("day"), F.col(key), F.col(at).alias("at"))
    return keyed.groupBy(source).transformWithStateInPandas(
        DayQuota((source, "day", key), limit, days), f"{source} {kinds[source]}, day string, {key} {kinds[key]}, accepted boolean", "append", "processingTime")


def for_each(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand finished batches to a sink (mail, files) and stop when the input is used up."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
