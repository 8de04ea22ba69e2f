"""Streaming jobs against their batch form."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators.bars import bars_from_ticks
from barloom.streaming import jobs as J

SCHEMA = "symbol string, ts timestamp, price double, volume double"


def drop(spark, path, rows):
    spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "ts", "price", "volume"]).assign(ts=lambda d: pd.to_datetime(d["ts"])), SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_late_rows_go_to_the_repair_job(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    first = [("A", "2024-01-01 00:10", 1.0, 1.0), ("A", "2024-01-01 00:50", 3.0, 1.0), ("A", "2024-01-01 05:00", 2.0, 1.0)]
    drop(spark, src, first)
    stream = lambda: J.tick_bars(spark.readStream.schema(SCHEMA).parquet(src), "1h")
    emitted = J.run_available(stream(), out)
    assert emitted.count() == 1
    drop(spark, src, [("A", "2024-01-01 00:20", 9.0, 1.0)])  # far behind the watermark
    emitted = J.run_available(stream(), out)
    raw = spark.read.schema(SCHEMA).parquet(src)
    fixed = J.repair_bars(raw, emitted, "1h").orderBy("ts").toPandas()
    assert fixed["high"].tolist() == [9.0, 2.0]
    want = bars_from_ticks(raw, "1h").orderBy("ts").toPandas()
    pd.testing.assert_frame_equal(fixed[want.columns], want)


def test_append_versions_keep_the_last_write(spark, tmp_path):
    path = str(tmp_path / "t")
    write = J.append_versions(path)
    write(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), 0)
    write(spark.createDataFrame([("a", 2)], "k string, v int"), 1)
    write(spark.createDataFrame([("a", 2)], "k string, v int"), 1)  # replay
    assert {r.k: r.v for r in J.current_rows(spark, path, ["k"]).collect()} == {"a": 2, "b": 1}


def test_compaction_shows_with_its_mark_and_survives_replays(spark, tmp_path):
    path = str(tmp_path / "t")
    write = J.append_versions(path)
    rows = lambda *r: spark.createDataFrame([*r], "k string, v int")
    now = lambda: {r.k: r.v for r in J.current_rows(spark, path, ["k"]).collect()}
    for n, batch in enumerate([[("a", 1), ("b", 1)], [("a", 2), ("c", 2)], [("b", 3)]]):
        write(rows(*batch), n)
    want = {"a": 2, "b": 3, "c": 2}
    rows(("a", 99)).withColumn("version", F.lit(9)).write.parquet(f"{path}/base/{1:012d}")  # a compaction that ended before its mark
    assert now() == want
    J.compact(spark, path, ["k"], 1)
    assert now() == want and J._mark(spark, path) == 1
    write(rows(("a", 1), ("b", 1)), 0)  # a late replay of a version below the mark
    J.compact(spark, path, ["k"], 1)
    J.compact(spark, path, ["k"], 0)
    assert now() == want
    write(rows(("a", 4)), 3)
    J.compact(spark, path, ["k"], 3)
    assert now() == {**want, "a": 4} and J._mark(spark, path) == 3


def test_repeats_are_dropped(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("e1", "2024-01-01 00:00:00"), ("e1", "2024-01-01 00:01:00"), ("e2", "2024-01-01 00:02:00")], "event_id string, ts string").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts")).write.parquet(src)
    stream = spark.readStream.schema("event_id string, ts timestamp").parquet(src)
    assert J.run_available(J.without_repeats(stream), str(tmp_path / "out")).count() == 2


def test_freshness_timer(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    stream = lambda: J.freshness_alerts(spark.readStream.schema(SCHEMA).parquet(src), 3600)
    drop(spark, src, [("QUIET", "2024-01-01 00:00", 1.0, 1.0), ("LIVE", "2024-01-01 00:00", 1.0, 1.0)])
    J.run_available(stream(), out)
    drop(spark, src, [("LIVE", "2024-01-01 03:00", 1.0, 1.0)])
    got = J.run_available(stream(), out).toPandas()
    assert "QUIET" in got["symbol"].tolist()
    assert got.loc[got["symbol"] == "QUIET", "latest_ts"].dt.strftime("%H:%M").iloc[0] == "00:00"


def test_progress_counts(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.jsonl").write_text("\n".join('{"ts":"2024-01-01T00:0%d:00Z","event":"core_done","run_id":"r"}' % i for i in range(3)) + "\nbroken\n")
    q = J.progress_counts(spark.readStream.text(str(src))).writeStream.format("memory").queryName("progress").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT max(events) FROM progress").first()[0] == 3
