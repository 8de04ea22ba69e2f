"""Streaming forms of the batch operators: bars, alerts, duplicate suppression, upserts, freshness."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.operators.bars import bars_from_ticks, bucket_start, keep_last, tick_order
from barloom.plans import alerts as A
from barloom.sources.artifacts import parse_event_lines

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SPANS = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "4h": "4 hours", "1d": "1 day"}


def tick_bars(ticks: DataFrame, timeframe: str, delay: str = "10 minutes", tie: Sequence[str] = ()) -> DataFrame:
    """Tumbling bars of a tick stream, emitted once their bucket is past the watermark.

    `ticks` is the tick count of a bar: the repair job tells from it which bars missed late rows.
    """
    at = tick_order(ticks, tie)
    bars = (
        ticks.withWatermark("ts", delay)
        .groupBy("symbol", F.window("ts", SPANS[timeframe]).alias("w"))
        .agg(
            F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
            F.sum("volume").alias("volume"), F.count("*").alias("ticks"),
        )
    )
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "ticks")


def range_alerts(bars: DataFrame, threshold: float) -> DataFrame:
    """Alert rows of four-hour bars: a stateless projection behind the bar stream."""
    rows = bars.withColumn("range_pct", A.range_pct())
    return A.anomalies(rows, "price_range_spike_4h", "range_pct", threshold, ["range_pct"])


def without_repeats(alerts: DataFrame, delay: str = "4 hours", key: str = "event_id") -> DataFrame:
    """First alert per id within the watermark delay."""
    return alerts.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def append_versions(path: str):
    """`foreachBatch` writer: each micro-batch is its own version of the keys it carries.

    A replayed batch overwrites its own folder, so the sink is idempotent; no batch rewrites the
    table. `current_rows` resolves the last write per key at read time, `compact` keeps that cheap.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/versions/version={batch_id:012d}")

    return write


def _mark(spark: SparkSession, path: str) -> int:
    """Version up to which the newest finished base holds the table; -1 without one."""
    try:
        marks = spark.read.schema("mark long").parquet(f"{path}/marks")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1
    top = marks.agg(F.max("mark")).first()[0]
    return -1 if top is None else top


def current_rows(spark: SparkSession, path: str, key: Sequence[str], upto: int | None = None) -> DataFrame:
    """Last version of each key: the base of the newest mark and the versions after it, merged at read time."""
    mark = _mark(spark, path)
    rows = spark.read.option("basePath", f"{path}/versions").parquet(f"{path}/versions")
    rows = rows.where(F.col("version") > mark) if upto is None else rows.where((F.col("version") > mark) & (F.col("version") <= upto))
    if mark >= 0:
        rows = spark.read.parquet(f"{path}/base/{mark:012d}").select(*rows.columns).unionByName(rows)
    return keep_last(rows, list(key), ["version"]).drop("version")


def compact(spark: SparkSession, path: str, key: Sequence[str], upto: int) -> None:
    """Merge the base and the versions up to `upto` into a new base.

    The new base becomes the table with one write, that of its mark; readers see the old base and its
    versions until then. A compaction that failed before its mark is simply written anew. A batch at or
    below the mark that is replayed later rewrites its own folder, which nobody reads any more.
    """
    mark = _mark(spark, path)
    if upto <= mark:
        return
    rows = spark.read.option("basePath", f"{path}/versions").parquet(f"{path}/versions").where((F.col("version") > mark) & (F.col("version") <= upto))
    if mark >= 0:
        rows = spark.read.parquet(f"{path}/base/{mark:012d}").select(*rows.columns).unionByName(rows)
    keep_last(rows, list(key), ["version"]).write.mode("overwrite").parquet(f"{path}/base/{upto:012d}")
    spark.range(1).select(F.lit(upto).cast("long").alias("mark")).coalesce(1).write.mode("append").parquet(f"{path}/marks")


def progress_counts(lines: DataFrame, delay: str = "1 hour", every: str = "1 hour") -> DataFrame:
    """Log events per run and hour, for update mode."""
    events = parse_event_lines(lines)
    w = events.withWatermark("ts", delay).groupBy("run_id", F.window("ts", every).alias("w"), "event")
    return w.agg(F.count("*").alias("events"), F.max("ts").alias("latest_ts")).select("run_id", F.col("w.start").alias("hour"), "event", "events", "latest_ts")


def repair_bars(raw: DataFrame, emitted: DataFrame, timeframe: str, tie: Sequence[str] = ()) -> DataFrame:
    """Bars to backfill: buckets whose stored ticks outnumber those the stream saw (late rows)."""
    seen = emitted.select("symbol", F.col("ts").alias("_b"), F.col("ticks").alias("_seen"))
    counts = raw.groupBy("symbol", bucket_start(timeframe).alias("_b")).agg(F.count("*").alias("_n"))
    short = counts.join(seen, ["symbol", "_b"], "left").where(F.col("_n") > F.coalesce("_seen", F.lit(0))).select("symbol", "_b")
    late = raw.withColumn("_b", bucket_start(timeframe)).join(short, ["symbol", "_b"], "left_semi").drop("_b")
    return bars_from_ticks(late, timeframe, tie)


class FreshnessWatch(StatefulProcessor):
    """Emits one alert per key when no row arrived for `max_age_seconds` of event time."""

    def __init__(self, max_age_seconds: int):
        self.max_age_ms = max_age_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(pdf["ms"].max()) for pdf in rows)
        if self.latest.exists():
            newest = max(newest, self.latest.get()[0])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.latest.update((newest,))
        self.handle.registerTimer(newest + self.max_age_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"symbol": [str(key[0])], "latest_ms": [self.latest.get()[0]]})

    def close(self) -> None:
        pass


def freshness_alerts(rows: DataFrame, max_age_seconds: int, delay: str = "1 minute") -> DataFrame:
    """Stale keys of a stream (symbol, ts). Needs the RocksDB state store."""
    src = rows.select("symbol", "ts", F.unix_millis("ts").alias("ms")).withWatermark("ts", delay)
    out = src.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=FreshnessWatch(max_age_seconds), outputStructType="symbol string, latest_ms bigint", outputMode="Append", timeMode="EventTime")
    return out.select("symbol", F.timestamp_millis("latest_ms").alias("latest_ts"))


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Drain what is available now into a parquet table and read it back (backfills and tests)."""
    spark = stream.sparkSession
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/_offsets").option("path", f"{path}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
