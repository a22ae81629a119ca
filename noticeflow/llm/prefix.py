"""Running sums over a distributed order: each task scans its own range, and what the ranges before it leave is added."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.llm.staging import free_prefix, stage


def _scan(values: np.ndarray, starts: np.ndarray, xor: bool, carry: int) -> np.ndarray:
    """Running sums (or exclusive-ors) that begin anew at each of ``starts``; the first goes on from ``carry``."""
    through = np.bitwise_xor.accumulate(values) if xor else np.cumsum(values)
    before = np.repeat(np.concatenate([[0], through[starts - 1]]).astype(np.int64), np.diff(np.concatenate([[0], starts, [len(values)]])))
    out = through ^ before if xor else through - before
    first = starts[0] if len(starts) else len(values)
    out[:first] = out[:first] ^ carry if xor else out[:first] + carry
    return out


def running(df: DataFrame, key: str | None, order: Sequence[str | Column], sums: Sequence[str] = (), xors: Sequence[str] = (), keep: Sequence[str] | None = None, name: str = "running") -> DataFrame:
    """``keep`` (all columns by default) of ``df`` with ``<c>_run`` for each c of ``sums`` and ``xors``: the inclusive
    running sum or exclusive-or over ``order``, begun anew for each value of ``key``.

    ``order`` must begin with ``key`` where there is one; key and summed columns are non-null longs. The rows are
    dealt by ranges of the whole order, so a key with any share of the rows lies in many tasks; each task scans its
    range, the result is staged, and the sums that earlier ranges leave open (a row per task) are added by a broadcast.
    Rows that agree in the whole order may stand either way. An empty table gives no rows.
    """
    p = free_prefix(df, "_run_")
    values = [*sums, *xors]
    keep = list(keep or df.columns)
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*keep, (F.col(key) if key else F.lit(0)).cast("long").alias(f"{p}key"), *[F.col(c).cast("long").alias(f"{p}v{i}") for i, c in enumerate(values)])
    marks = [f"{p}task", f"{p}seq", f"{p}head"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, last, head, carry = TaskContext.get().partitionId(), 0, None, True, [0] * len(values)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(len(keep)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            if last is not None and keys[0] != last:
                head, carry = False, [0] * len(values)
            runs = [_scan(batch.column(len(keep) + 1 + i).to_numpy(zero_copy_only=False), starts, i >= len(sums), carry[i]) for i in range(len(values))]
            heads = np.zeros(n, bool)
            heads[: starts[0] if len(starts) else n] = head
            head, last, carry = head and not len(starts), keys[-1], [int(x[-1]) for x in runs]
            columns = [*batch.columns[: len(keep) + 1], *map(pa.array, runs), pa.array(np.full(n, task, np.int32)), pa.array(np.arange(seq, seq + n)), pa.array(heads)]
            seq += n
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    long = T.LongType()
    schema = T.StructType([*[dealt.schema[c] for c in keep], T.StructField(f"{p}key", long), *[T.StructField(f"{c}_run", long) for c in values], T.StructField(marks[0], T.IntegerType()), T.StructField(marks[1], long), T.StructField(marks[2], T.BooleanType())])
    scanned = stage(dealt.mapInArrow(run, schema), name)
    edges = scanned.groupBy(marks[0]).agg(F.min(f"{p}key").alias("first"), F.max_by(F.struct(F.col(f"{p}key").alias("key"), F.col(marks[2]).alias("head"), *[F.col(f"{c}_run") for c in values]), marks[1]).alias("last"))
    carries, open_key, left = [], None, [0] * len(values)
    for row in sorted(edges.collect(), key=lambda r: r[marks[0]]):  # one row per task
        if row["first"] != open_key:
            left = [0] * len(values)
        carries.append((row[marks[0]], *left))
        ends = [int(x) for x in row["last"][2:]]
        if row["last"]["head"]:
            ends = [a + b for a, b in zip(left[: len(sums)], ends)] + [a ^ b for a, b in zip(left[len(sums) :], ends[len(sums) :])]
        open_key, left = row["last"]["key"], ends
    given = T.StructType([T.StructField(marks[0], T.IntegerType()), *[T.StructField(f"{p}c{i}", long) for i in range(len(values))]])
    joined = scanned.join(F.broadcast(df.sparkSession.createDataFrame(carries, given)), marks[0], "left")
    added = []
    for i, c in enumerate(values):
        carry = F.when(F.col(marks[2]), F.col(f"{p}c{i}")).otherwise(F.lit(0))
        added.append((F.col(f"{c}_run") + carry if i < len(sums) else F.col(f"{c}_run").bitwiseXOR(carry)).alias(f"{c}_run"))
    return joined.select(*keep, *added)
