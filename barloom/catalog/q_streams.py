"""Streams drained once over the event table and compared with their batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.catalog import query
from barloom.catalog.common import BARS_1H, event_bars_sql, r, show
from barloom.catalog.q_events import LIMIT, RANGE, sev_sql
from barloom.session import stage, staging_dir
from barloom.sources.tables import event_bars, event_ticks
from barloom.streaming import jobs as J


def tick_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    k = F.get_json_object("props", "$.k").cast("double")
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), k.alias("volume"), "event_id")


def drain(stream):
    return J.run_available(stream, f"{staging_dir(stream.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}")


CLOSED = "ts + INTERVAL {h} HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"
_OHLCV = ["open", "high", "low", "close", "volume"]


@query("stream_bars", f"WITH {BARS_1H} SELECT symbol, ts, {', '.join(r(c, c) for c in _OHLCV)} FROM bars WHERE {CLOSED.format(h=1)}")
def stream_bars(spark, sf):
    return show(drain(J.tick_bars(tick_stream(spark, sf), "1h", tie=["event_id"])), ["symbol", "ts"], _OHLCV)


@query("stream_alerts", f"""WITH {event_bars_sql('4 hours')}, rg AS (SELECT symbol, ts, {RANGE} AS x FROM bars WHERE {CLOSED.format(h=4)})
SELECT symbol, ts, {sev_sql('x', LIMIT)} AS severity, sha256(symbol || '|price_range_spike_4h|' || {sev_sql('x', LIMIT)} || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS event_id FROM rg WHERE x >= {LIMIT}""")
def stream_alerts(spark, sf):
    bars = J.tick_bars(tick_stream(spark, sf), "4h", tie=["event_id"])
    return drain(J.range_alerts(bars, LIMIT)).select("symbol", "ts", "severity", "event_id")


@query("stream_dedup", "SELECT event_type AS symbol, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
def stream_dedup(spark, sf):
    """Every tick twice in the stream, once after suppression."""
    ticks = tick_stream(spark, sf).withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    rows = drain(J.without_repeats(ticks, "10 minutes", "event_id"))
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("stream_repair", f"WITH {BARS_1H} SELECT symbol, ts, {', '.join(r(c, c) for c in _OHLCV)} FROM bars WHERE NOT ({CLOSED.format(h=1)})")
def stream_repair(spark, sf):
    """The bars the stream has not emitted yet, rebuilt from the raw ticks."""
    emitted = stage(drain(J.tick_bars(tick_stream(spark, sf), "1h", tie=["event_id"])), "emitted")
    return show(J.repair_bars(event_ticks(spark, sf), emitted, "1h", ["event_id"]), ["symbol", "ts"], _OHLCV)


@query("stream_compacted", """WITH v AS (SELECT user_id, event_type, value, ts, event_id, event_id % 4 AS version FROM events)
SELECT user_id, arg_max(event_type, (version, ts, event_id)) AS event_type, arg_max(event_id, (version, ts, event_id)) AS event_id FROM v GROUP BY 1""")
def stream_compacted(spark, sf):
    """Upserts in four batches: two, a compaction, one more, a replay of an old one, another compaction, the last."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    last = F.struct("ts", "event_id")
    batch = lambda v: events.where(F.col("event_id") % 4 == v).groupBy("user_id").agg(F.max_by("event_type", last).alias("event_type"), F.max_by("event_id", last).alias("event_id"))
    path = f"{staging_dir(spark).rstrip('/')}/upserts-{uuid.uuid4().hex}"
    write = J.append_versions(path)
    for step in (0, 1, "compact 1", 2, 0, "compact 2", 3, 1):
        if isinstance(step, int):
            write(batch(step), step)
        else:
            J.compact(spark, path, ["user_id"], int(step.split()[1]))
    return J.current_rows(spark, path, ["user_id"])
