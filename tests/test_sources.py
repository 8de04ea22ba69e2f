"""Files: klines, the bar lake, JSON lines, sanitised output."""

import json

import pandas as pd
from pyspark.sql import functions as F

from barloom.sources import artifacts, klines, lake


def test_klines_units_bad_rows_and_overlap(spark, tmp_path):
    ms = 1_704_067_200_000
    line = lambda t, c: ",".join(str(v) for v in [t, 1, 2, 0.5, c, 10, t, 0, 0, 0, 0, 0])
    (tmp_path / "ABCUSDT-1m-2024-01.csv").write_text("\n".join([line(ms, 1.0), line(ms + 60_000, 1.1), "oops,1,2,3,4,5,6,7,8,9,10,11"]))
    (tmp_path / "ABCUSDT-1m-2024-02.csv").write_text("\n".join([line((ms + 60_000) * 1000, 9.9), line((ms + 120_000) * 1000, 1.2)]))
    bars = klines.read_klines(spark, str(tmp_path))
    ts = lambda s: F.lit(s).cast("timestamp")
    got = klines.merge_files(bars, ts("2024-01-01 00:00:00"), ts("2024-01-01 00:02:00")).orderBy("ts").toPandas()
    assert got["symbol"].unique().tolist() == ["ABCUSDT"]
    assert got["close"].tolist() == [1.0, 9.9, 1.2]
    assert got["ts"].dt.strftime("%H:%M").tolist() == ["00:00", "00:01", "00:02"]


def test_lake_reads_the_latest_run_of_each_day(spark, tmp_path):
    ts = pd.date_range("2024-01-01 23:58", periods=4, freq="min")
    bars = pd.DataFrame({"symbol": "A", "timeframe": "1m", "ts": ts, "open": 1.0, "high": 1.0, "low": 1.0, "close": [1.0, 2, 3, 4], "volume": 1.0})
    lake.write_bars(spark.createDataFrame(bars), str(tmp_path), "raw", "run1")
    lake.write_bars(spark.createDataFrame(bars.tail(1).assign(close=9.0)), str(tmp_path), "raw", "run2")
    df = lake.read_bars(spark, str(tmp_path), "raw", ["A"], "1m", "2024-01-01", "2024-01-03")
    assert df.orderBy("ts").toPandas()["close"].tolist() == [1.0, 2.0, 9.0]  # run2 hides the rest of its day
    plan = df._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "date" in plan


def test_upsert_and_last_bars(spark):
    a = spark.createDataFrame([("k1", 1, "old"), ("k2", 5, "keep")], "k string, v int, s string")
    b = spark.createDataFrame([("k1", 1, "new"), ("k2", 4, "late")], "k string, v int, s string")
    assert {r.k: r.s for r in lake.upsert(a, b, ["k"], "v").collect()} == {"k1": "new", "k2": "keep"}


def test_event_lines_and_sanitising(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join(['{"ts":"2024-01-01T00:00:00Z","event":"core_done","run_id":"r"}', '{"ts":"nope","event":"x"}', "garbage", '{"ts":"2024-01-01T00:00:00Z"}']))
    assert artifacts.read_event_log(spark, str(tmp_path)).count() == 1
    df = spark.createDataFrame([(float("nan"), "a\x01b"), (float("inf"), "c")], "x double, t string")
    artifacts.write_json(df, str(tmp_path / "out"))
    rows = [json.loads(l) for p in (tmp_path / "out").glob("*.json") for l in p.read_text().splitlines()]
    assert sorted((r["x"], r["t"]) for r in rows) == [(0.0, "a b"), (0.0, "c")]


def test_iteration_reports(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"iteration_{i}.json").write_text(json.dumps({"run_id": f"r{i}", "ts_utc": f"2024-01-0{i + 1}T00:00:00Z", "round_reports": [{"round_index": 1, "delta_vs_prev_round": 0.5, "validation_metrics": {"pass_rate": 0.1}}]}, indent=1))
    got = artifacts.read_iterations(spark, str(tmp_path), newest=2).toPandas()
    assert got["run_id"].tolist() == ["r2", "r1"]
