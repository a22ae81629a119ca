"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a row group where rows are large: no batch of rows that a reader makes goes across groups.
GROUP = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the session names none, a local master (tests) gets a local folder, and
    anything else is an error: executors would write to their own disks."""
    found = spark.conf.get(_SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_SETTING} must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="noticeflow-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``new_dir`` or ``stage`` made."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM may be gone when Python ends
        pass


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/noticeflow-{uuid.uuid4().hex[:16]}-{name}"
    atexit.register(_remove_quietly, spark, path)
    return path


def stage_at(df: DataFrame, name: str, free: bool = False, arrow_rows: int | None = None, compression: str | None = None, large_rows: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder; the table read back, and its path. ``free``: the shuffle files that
    the write needed go when it ends, not when the driver's memory is next collected. ``arrow_rows``: rows that go to
    Python workers at a time, where rows are large. ``compression``: another than the session's. ``large_rows``: rows of
    megabytes; writers and readers then hold about ``GROUP`` bytes or one row at a time, where they would hold a hundred
    rows and whatever a file has, up to 4,096."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    wish = ({_FREE: "true"} if free else {}) | ({_ROWS: str(arrow_rows)} if arrow_rows else {})
    before = {k: spark.conf.get(k) for k in wish}
    for k, v in wish.items():
        spark.conf.set(k, v)
    try:
        out = df.write.options(**{"parquet.block.size": GROUP, "parquet.page.size.row.check.min": 1}) if large_rows else df.write
        out.parquet(path, compression=compression)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later plans start from the table,
    so an executor's loss costs at most the tasks that ran since."""
    return stage_at(df, name)[0]


def free_prefix(df: DataFrame, wish: str) -> str:
    """A prefix for working columns that no column of ``df`` begins with."""
    while any(c.lower().startswith(wish) for c in df.columns):
        wish = "_" + wish
    return wish
