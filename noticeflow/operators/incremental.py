"""Cursors, quotas, schedules and the outbox, as whole-table computations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cursor_windows(operations: DataFrame, first: str, last: str, done: DataFrame) -> DataFrame:
    """(operation, day) windows to fetch, newest first in ``place``: those not completed, and the newest day again."""
    days = operations.withColumn("day", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))))
    complete = done.where("completed").select("operation", "day").where(F.col("day") < F.lit(last).cast("date"))
    open_ = days.join(complete, ["operation", "day"], "left_anti")
    return open_.withColumn("place", F.row_number().over(Window.partitionBy("operation").orderBy(F.desc("day"))))


def daily_quota(df: DataFrame, source: str, at: str, key: str, limit: int) -> DataFrame:
    """Calls within the first ``limit`` of their source and day."""
    w = Window.partitionBy(source, F.to_date(at)).orderBy(at, key)
    return df.withColumn("call", F.row_number().over(w)).where(F.col("call") <= limit)


def backoff_seconds(failures: Column, base: int = 300, most: int = 3600) -> Column:
    """min(most, base * 2**(failures - 1)); 0 without failures; large counts do not overflow."""
    power = F.pow(F.lit(2.0), F.least(failures - 1, F.lit(30)))
    return F.when(failures <= 0, 0).otherwise(F.least(F.lit(float(most)), F.lit(float(base)) * power)).cast("bigint")


def failure_runs(df: DataFrame, source: str, order: Sequence[str], failed: Column) -> DataFrame:
    """Each row's number of failures in a row up to it."""
    w = Window.partitionBy(source).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("__block", F.sum(F.when(failed, 0).otherwise(1)).over(w))
    inner = Window.partitionBy(source, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("failures", F.sum(F.when(failed, 1).otherwise(0)).over(inner)).drop("__block")


def due_sources(schedule: DataFrame, state: DataFrame, now: Column, lookback_days: Column) -> DataFrame:
    """Enabled scheduled sources whose next run is unset or past, with the window [today - lookback + 1, today]."""
    joined = schedule.where("enabled").join(state, "source", "left").where(F.col("next_run").isNull() | (F.col("next_run") <= now))
    return joined.select("source", F.date_add(F.to_date(now), 1 - lookback_days).alias("first"), F.to_date(now).alias("last"))


def recently_done(wanted: DataFrame, runs: DataFrame, keys: Sequence[str], now: Column, minutes: int = 30) -> DataFrame:
    """Wanted ranges without a success in the last minutes."""
    recent = runs.where((F.col("status") == "SUCCESS") & (F.col("finished_at") >= now - F.expr(f"interval {minutes} minutes")))
    return wanted.join(recent.select(*keys), list(keys), "left_anti")


def retry_queue(queue: DataFrame, failed: DataFrame, succeeded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The queue after a run: successes leave, failures count up or enter with one attempt."""
    left = queue.join(succeeded.select(*keys), list(keys), "left_anti")
    marks = failed.select(*keys).distinct().withColumn("__failed", F.lit(True))
    both = left.join(marks, list(keys), "full_outer")
    return both.select(*keys, (F.coalesce("attempts", F.lit(0)) + F.coalesce(F.col("__failed").cast("int"), F.lit(0))).alias("attempts"))


def stale_runs(runs: DataFrame, now: Column, lease_seconds: int = 3600) -> DataFrame:
    """Runs still marked RUNNING whose lease is over."""
    return runs.where((F.col("status") == "RUNNING") & (F.col("started_at") < now - F.expr(f"interval {lease_seconds} seconds")))


def outbox(events: DataFrame, existing: DataFrame, baselines: DataFrame, relevant: Column, key: Sequence[str], scope: Sequence[str]) -> DataFrame:
    """Events to send: relevant, new by key, and only in scopes that have a baseline (a scope's first run sends none)."""
    fresh = events.where(relevant).join(baselines.select(*scope).distinct(), list(scope), "left_semi")
    return fresh.dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti")


def fan_out(pending: DataFrame, subscribers: DataFrame, delivered: DataFrame, event_key: str, subscriber_key: str, scope: Sequence[str], salt: int = 8, few: int = 64, block: int = 256) -> DataFrame:
    """One row per pending event and subscriber of its scope (channel, type) that has none yet.

    All pairs of a scope are what is asked for. They are formed by an equi join on the scope and a salt: events of a
    scope go to ``salt`` buckets by a hash, its subscribers to each of them, so a scope with most events is many tasks.
    Subscribers come in blocks of up to ``block``, and a task takes one block after another through its events: pairs of
    an event stand together and the same few subscribers come again and again, so that the result takes little room
    wherever it is written in order (a columnar file has an event once for each block, and of its subscribers next to nothing).
    An event with at most ``few`` deliveries brings their subscribers along, so its pairs leave as they are formed and are
    never shuffled; only the pairs of other events meet the deliveries in a join.
    """
    mine = delivered.select(event_key, subscriber_key).where(F.col(subscriber_key).isNotNull()).join(pending.select(event_key), event_key, "left_semi")
    counted = mine.withColumn("__n", F.count("*").over(Window.partitionBy(event_key)))
    known = counted.groupBy(event_key).agg(F.max("__n").alias("__n"), F.collect_set(F.when(F.col("__n") <= few, F.col(subscriber_key))).alias("__done"))
    dealt = pending.withColumn("__salt", F.pmod(F.xxhash64(event_key), F.lit(salt)).cast("int")).join(known, event_key, "left")
    bucket = [*scope, F.pmod(F.xxhash64(subscriber_key), F.lit(salt))]
    placed = subscribers.withColumn("__block", F.floor((F.row_number().over(Window.partitionBy(*bucket).orderBy(subscriber_key)) - 1) / block))
    own = [c for c in subscribers.columns if c not in scope]
    blocks = placed.groupBy(*bucket, "__block").agg(F.collect_list(F.struct(*own)).alias("__subscribers")).select(*scope, "__subscribers")
    spread = blocks.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    on, many = [*scope, "__salt"], F.coalesce(F.col("__n") > few, F.lit(False))
    tasks = int(pending.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pairs(events: DataFrame) -> DataFrame:
        events = events.repartition(tasks, *on)  # a few MB make billions of pairs: no tasks are put together for their size
        met = spread.join(events.hint("merge"), on)  # a merge goes through the blocks, a broadcast of them through the events
        return met.withColumn("__one", F.explode("__subscribers")).select("*", *[F.col("__one")[c].alias(c) for c in own]).drop("__subscribers", "__one", "__salt")

    light = pairs(dealt.where(~many)).where(~F.coalesce(F.array_contains("__done", F.col(subscriber_key)), F.lit(False)))
    heavy = pairs(dealt.where(many)).join(delivered.select(event_key, subscriber_key), [event_key, subscriber_key], "left_anti")
    return light.drop("__n", "__done").unionByName(heavy.drop("__n", "__done"))


def delivery_status(children: DataFrame, key: Sequence[str], status: str, failed: str = "FAILED", sent: str = "SENT") -> DataFrame:
    """FAILED if any child failed, SENT if all were sent, else PENDING."""
    out = F.when(F.bool_or(F.col(status) == failed), failed).when(F.bool_and(F.col(status) == sent), sent).otherwise("PENDING")
    return children.groupBy(*key).agg(out.alias("delivery"))


def batch_status(items: DataFrame, key: Sequence[str], ok: Column, active: Column) -> DataFrame:
    """SUCCESS, PARTIAL_SUCCESS, FAILED, or NO_ACTIVE where no item was active."""
    n, good = F.count_if(active), F.count_if(active & ok)
    return items.groupBy(*key).agg(F.when(n == 0, "NO_ACTIVE").when(good == n, "SUCCESS").when(good == 0, "FAILED").otherwise("PARTIAL_SUCCESS").alias("batch"))
