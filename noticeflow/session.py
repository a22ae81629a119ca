"""Session settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",  # else state with a time to live keeps a run of availableNow alive
}


def session(app: str = "noticeflow", **settings: str) -> SparkSession:
    """A session with UTC, adaptive plans and ANSI arithmetic; ``settings`` come on top."""
    return SparkSession.builder.appName(app).config(map=SETTINGS | settings).getOrCreate()
