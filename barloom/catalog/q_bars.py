"""Bars: resampling, gaps, alignment, look-back windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import query
from barloom.catalog.common import BARS_1D, BARS_1H, BARS_1M, daily, event_bars_sql, hourly, r, show
from barloom.operators import bars as B
from barloom.operators.series import TIMEFRAME_SECONDS
from barloom.plans.features import higher_timeframe_features
from barloom.sources import lake
from barloom.sources.tables import event_bars, event_ticks, line_bars, table

OHLCV = ["open", "high", "low", "close", "volume"]
OHLCV_SQL = ", ".join(r(c, c) for c in OHLCV)
DAY = 86_400


@query("bars_1h", f"WITH {BARS_1H} SELECT symbol, ts, {OHLCV_SQL} FROM bars")
def bars_1h(spark, sf):
    return show(event_bars(spark, sf, "1h"), ["symbol", "ts"], OHLCV)


@query("bars_weekly", f"""WITH {BARS_1D}
SELECT symbol, date_trunc('week', ts)::TIMESTAMP AS ts, {r('arg_min(open, ts)', 'open')}, {r('max(high)', 'high')},
       {r('min(low)', 'low')}, {r('arg_max(close, ts)', 'close')}, {r('sum(volume)', 'volume')}
FROM bars GROUP BY symbol, date_trunc('week', ts)""")
def bars_weekly(spark, sf):
    return show(B.resample(line_bars(spark, sf), "1w"), ["symbol", "ts"], OHLCV)


_FRAMES = ["5m", "15m", "1h", "4h", "1d", "1w"]
_FRAMES_SQL = "\nUNION ALL ".join(
    f"""SELECT symbol, '{t}' AS timeframe, {b} AS ts, {r('arg_min(open, ts)', 'open')}, {r('max(high)', 'high')},
    {r('min(low)', 'low')}, {r('arg_max(close, ts)', 'close')}, {r('sum(volume)', 'volume')} FROM bars GROUP BY 1, 2, 3"""
    for t, b in [
        ("5m", "time_bucket(INTERVAL '5 minutes', ts)"), ("15m", "time_bucket(INTERVAL '15 minutes', ts)"),
        ("1h", "time_bucket(INTERVAL '1 hour', ts)"), ("4h", "time_bucket(INTERVAL '4 hours', ts)"),
        ("1d", "date_trunc('day', ts)::TIMESTAMP"), ("1w", "date_trunc('week', ts)::TIMESTAMP"),
    ]
)


@query("bars_all_timeframes", f"WITH {BARS_1M} {_FRAMES_SQL}")
def bars_all_timeframes(spark, sf):
    return show(B.resample_all(event_bars(spark, sf, "1m"), _FRAMES), ["symbol", "timeframe", "ts"], OHLCV)


@query("bar_gaps", f"""WITH {BARS_1H}, lim AS (SELECT TIMESTAMP '2023-12-31 20:00:00' AS a, TIMESTAMP '2024-02-01 05:00:00' AS b),
x AS (SELECT symbol, ts, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS nxt FROM bars),
g AS (SELECT symbol, ts + INTERVAL 1 HOUR AS lo, nxt - INTERVAL 1 HOUR AS hi FROM x WHERE nxt - ts > INTERVAL 1 HOUR
 UNION ALL SELECT symbol, a, min(ts) - INTERVAL 1 HOUR FROM bars, lim GROUP BY symbol, a HAVING min(ts) > a
 UNION ALL SELECT symbol, max(ts) + INTERVAL 1 HOUR, b FROM bars, lim GROUP BY symbol, b HAVING max(ts) < b)
SELECT symbol, lo AS gap_start, hi AS gap_end, CAST(epoch(hi - lo) / 3600 + 1 AS BIGINT) AS missing FROM g""")
def bar_gaps(spark, sf):
    return B.find_gaps(
        event_bars(spark, sf, "1h"), "1h",
        F.lit("2023-12-31 20:00:00").cast("timestamp"), F.lit("2024-02-01 05:00:00").cast("timestamp"),
    )


@query("gap_fill", f"""WITH {BARS_1H}, market AS (
 SELECT time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
        arg_max(value, (ts, event_id)) AS close, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS volume
 FROM events GROUP BY 1),
span AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY symbol),
al AS (SELECT *, 'archive' AS origin FROM bars
 UNION ALL SELECT s.symbol, m.*, 'backfill' FROM market m JOIN span s ON m.ts BETWEEN s.lo AND s.hi
 WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = s.symbol AND b.ts = m.ts))
SELECT symbol, origin, count(*) AS rows_used, {r('sum(close)', 'close_sum')}, {r('sum(volume)', 'volume_sum')}
FROM al GROUP BY 1, 2""")
def gap_fill(spark, sf):
    """The whole market's hourly bars stand in where a symbol has none."""
    ticks = event_ticks(spark, sf)
    own = event_bars(spark, sf, "1h")
    market = B.bars_from_ticks(ticks, "1h", ["event_id"], keys=[])
    names = own.select("symbol").distinct()
    filled = B.fill_gaps(own, names.join(market), "1h")
    return filled.groupBy("symbol", "origin").agg(
        F.count("*").alias("rows_used"), F.round(F.sum("close"), 6).alias("close_sum"),
        F.round(F.sum("volume"), 6).alias("volume_sum"),
    )


@query("first_seen", "SELECT event_type AS symbol, CAST(min(ts) AS DATE) AS first_seen_date FROM events GROUP BY 1")
def first_seen(spark, sf):
    return B.first_seen(event_ticks(spark, sf))


@query("resample_last", f"""WITH {BARS_1H}, x AS (SELECT symbol, ts, close, nullif(volume, 0) AS volume FROM bars)
SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS ts, {r("last(close ORDER BY ts) FILTER (close IS NOT NULL)", 'close')},
 {r("last(volume ORDER BY ts) FILTER (volume IS NOT NULL)", 'volume')} FROM x GROUP BY 1, 2""")
def resample_last(spark, sf):
    rows = event_bars(spark, sf, "1h").withColumn("volume", F.expr("nullif(volume, 0)"))
    return show(B.resample_last(rows, "4h", ["close", "volume"]), ["symbol", "ts"], ["close", "volume"])


HTF_COLS = ["logret", "range_ratio", "wick_ratio", "breakout_high_dist", "breakout_low_dist", "realized_vol_20"]


def htf_sql(source: str = "bars", out: str = "htf", hours: int = 1) -> str:
    return f"""{out}_0 AS (SELECT symbol, ts, ts + INTERVAL {hours} HOUR AS close_ts, open, high, low, nullif(close, 0) AS c,
   ln((nullif(close, 0) + 1e-12) / (nullif(open, 0) + 1e-12)) AS logret,
   CASE WHEN count(*) OVER f20l >= 5 THEN max(high) OVER f20l END AS hi20,
   CASE WHEN count(*) OVER f20l >= 5 THEN min(low) OVER f20l END AS lo20
   FROM {source} WINDOW f20l AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
{out} AS (SELECT symbol, ts, close_ts, logret, (high - low) / c AS range_ratio,
   ((high - greatest(open, c)) + (least(open, c) - low)) / nullif(high - low, 0) AS wick_ratio,
   (c - hi20) / nullif(hi20, 0) AS breakout_high_dist, (c - lo20) / nullif(lo20, 0) AS breakout_low_dist,
   CASE WHEN count(logret) OVER f20 >= 5 THEN stddev_samp(logret) OVER f20 END AS realized_vol_20
   FROM {out}_0 WINDOW f20 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


@query("htf_features", f"""WITH {BARS_1H}, {htf_sql()}
SELECT symbol, ts, close_ts, {', '.join(r(c, c) for c in HTF_COLS)} FROM htf""")
def htf_features(spark, sf):
    return show(higher_timeframe_features(event_bars(spark, sf, "1h"), "1h"), ["symbol", "ts", "close_ts"], HTF_COLS)


@query("asof_features", f"""WITH {event_bars_sql('1 minute', 'base')}, {BARS_1H}, {htf_sql()}
SELECT b.symbol, b.ts, {r('b.close', 'close')}, {', '.join(r('h.' + c, c) for c in HTF_COLS)}
FROM base b ASOF LEFT JOIN htf h ON b.symbol = h.symbol AND b.ts >= h.close_ts""")
def asof_features(spark, sf):
    base = event_bars(spark, sf, "1m").select("symbol", "ts", "close")
    htf = higher_timeframe_features(event_bars(spark, sf, "1h"), "1h")
    joined = B.asof_join(base, htf, "ts", "close_ts", HTF_COLS, segment_seconds=7 * DAY)
    return show(joined, ["symbol", "ts"], ["close", *HTF_COLS])


@query("align_to_index", f"""WITH {BARS_1H}, grid AS (SELECT DISTINCT time_bucket(INTERVAL '1 hour', ts) AS ts FROM events),
names AS (SELECT DISTINCT symbol FROM bars)
SELECT n.symbol, g.ts, {r('coalesce(b.close, 0)', 'close')}, {r('coalesce(b.volume, 0)', 'volume')}
FROM grid g CROSS JOIN names n ASOF LEFT JOIN bars b ON b.symbol = n.symbol AND g.ts >= b.ts""")
def align_to_index(spark, sf):
    bars = event_bars(spark, sf, "1h").select("symbol", "ts", "close", "volume")
    grid = event_ticks(spark, sf).select(B.bucket_start("1h").alias("ts")).distinct()
    index = bars.select("symbol").distinct().join(grid)
    return show(B.align_to_index(index, bars, ["close", "volume"], 7 * DAY), ["symbol", "ts"], ["close", "volume"])


@query("fill_both_ways", f"""WITH {BARS_1H}, x AS (SELECT symbol, ts, close, CASE WHEN volume > 100 THEN high END AS high,
 CASE WHEN volume > 300 THEN low END AS low FROM bars)
SELECT symbol, ts, {r('close', 'close')},
 {r("coalesce(last_value(high IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(high IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), close)", 'high')},
 {r("coalesce(last_value(low IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(low IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), close)", 'low')}
FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def fill_both_ways(spark, sf):
    rows = event_bars(spark, sf, "1h").select(
        "symbol", "ts", "close", F.expr("CASE WHEN volume > 100 THEN high END").alias("high"),
        F.expr("CASE WHEN volume > 300 THEN low END").alias("low"),
    )
    return show(B.fill_both_ways(rows, ["high", "low"], "close", 7 * DAY), ["symbol", "ts"], ["close", "high", "low"])


_CLOCK = {"5m": 5, "15m": 15, "1h": 60, "4h": 240, "1d": 1440, "1w": 10080}


@query("close_clock", f"WITH {BARS_1M} SELECT symbol, ts, " + ", ".join(
    f"CAST({n} - (epoch(ts)::BIGINT // 60) % {n} AS DOUBLE) AS ttc_min_{t}, "
    + r(f"ln(1 + {n} - (epoch(ts)::BIGINT // 60) % {n})", f"ttc_log_{t}") + ", "
    + r(f"({n} - (epoch(ts)::BIGINT // 60) % {n}) / {n}.0", f"ttc_phase_{t}")
    for t, n in _CLOCK.items()) + " FROM bars")
def close_clock(spark, sf):
    bars = event_bars(spark, sf, "1m")
    cols = [F.round(c, 6).alias(f"{k}_{t}") for t in _CLOCK for k, c in B.close_clock("ts", t).items()]
    return bars.select("symbol", "ts", *cols)


@query("lookback_windows", f"""WITH {BARS_1D}, m AS (SELECT symbol, max(ts) AS mx FROM bars GROUP BY 1),
wins(win, days) AS (VALUES ('all', 100000), ('360d', 360), ('90d', 90), ('30d', 30))
SELECT b.symbol, win AS "window", count(*) AS bars, min(ts) AS start_ts, max(ts) AS end_ts,
 {r('arg_max(close, ts) / arg_min(close, ts) - 1', 'hold_return')}
FROM bars b JOIN m USING (symbol) CROSS JOIN wins WHERE ts >= mx - to_days(days) GROUP BY 1, 2""")
def lookback_windows(spark, sf):
    from barloom.plans.backtest import hold_return

    sliced = B.lookback_slices(line_bars(spark, sf))
    return sliced.groupBy("symbol", "window").agg(
        F.count("*").alias("bars"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
        F.round(hold_return(), 6).alias("hold_return"),
    )


@query("every_nth_bar", f"""WITH {BARS_1H}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos,
 count(*) OVER (PARTITION BY symbol) AS n FROM bars)
SELECT symbol, ts, pos, {r('close', 'close')} FROM x WHERE pos % 5 = 0 OR pos = n - 1""")
def every_nth_bar(spark, sf):
    return show(B.every_nth(hourly(spark, sf), 5), ["symbol", "ts", "pos"], ["close"])


@query("warmup_drop", f"""WITH {BARS_1H}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn,
 count(*) OVER (PARTITION BY symbol) AS n FROM bars)
SELECT symbol, ts, {r('close', 'close')} FROM x WHERE n <= 200 OR rn > 200""")
def warmup_drop(spark, sf):
    return show(B.drop_warmup(hourly(spark, sf), 200), ["symbol", "ts"], ["close"])


@query("event_candles", f"""WITH {BARS_1H}, {event_bars_sql('1 minute', 'fine')},
t AS (SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) AS BIGINT) AS trade_id, ts AS s, ts + INTERVAL 3 HOUR AS e FROM bars WHERE high - low > 300),
x AS (SELECT t.symbol, trade_id, f.ts, f.close, row_number() OVER (PARTITION BY t.symbol, trade_id ORDER BY f.ts DESC) AS rn
 FROM t JOIN fine f ON f.symbol = t.symbol AND f.ts BETWEEN s - INTERVAL 120 MINUTE AND e + INTERVAL 120 MINUTE)
SELECT symbol, trade_id, ts, {r('close', 'close')} FROM x WHERE rn <= 500""")
def event_candles(spark, sf):
    wide = B.drop_warmup(hourly(spark, sf), 10**9).where("high - low > 300").drop("pos")
    trades = B.dense_position(wide, ["symbol"], ["ts"], B.time_segment(365 * DAY), "trade_id").select(
        "symbol", (F.col("trade_id") + 1).alias("trade_id"), F.col("ts").alias("start_ts"),
        (F.col("ts") + F.expr("INTERVAL 3 HOURS")).alias("end_ts"),
    )
    hits = B.bars_around(trades, event_bars(spark, sf, "1m"))
    return show(hits, ["symbol", "trade_id", "ts"], ["close"])


@query("last_bars", f"""WITH {BARS_1H}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars)
SELECT symbol, ts, {r('close', 'close')} FROM x WHERE rn <= 100""")
def last_bars(spark, sf):
    return show(lake.last_bars(event_bars(spark, sf, "1h"), 100), ["symbol", "ts"], ["close"])


@query("latest_run_bars", f"""WITH li AS (SELECT *, l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS date FROM lineitem),
x AS (SELECT *, max(l_linenumber) OVER (PARTITION BY symbol, date) AS mx FROM li),
k AS (SELECT symbol, date, l_suppkey, max(l_extendedprice) AS price, max(l_linenumber) AS run_tag FROM x WHERE l_linenumber = mx GROUP BY 1, 2, 3)
SELECT symbol, date, run_tag, l_suppkey AS slot, {r('price', 'price')} FROM k""")
def latest_run_bars(spark, sf):
    """Per day the rows of its newest run only (line number as run), then the last duplicate per slot."""
    li = table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.to_date("l_shipdate").alias("date"),
        F.col("l_linenumber").alias("run_tag"), F.col("l_suppkey").alias("slot"), F.col("l_extendedprice").alias("price"),
    )
    newest = lake.latest_runs(li, ["symbol", "date"])
    return show(B.keep_last(newest, ["symbol", "date", "slot"], ["price"]), ["symbol", "date", "run_tag", "slot"], ["price"])


@query("keyed_upsert", """WITH al AS (
 SELECT o_custkey AS k, o_orderkey AS v, o_orderpriority AS status, 0 AS src FROM orders WHERE o_orderstatus <> 'O'
 UNION ALL SELECT o_custkey, o_orderkey, o_orderpriority, 1 FROM orders WHERE o_orderstatus = 'O')
SELECT k AS custkey, arg_max(v, (v, src)) AS version, arg_max(status, (v, src)) AS status FROM al GROUP BY 1""")
def keyed_upsert(spark, sf):
    o = table(spark, sf, "orders")
    cols = [F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("status")]
    return lake.upsert(o.where("o_orderstatus <> 'O'").select(*cols), o.where("o_orderstatus = 'O'").select(*cols), ["custkey"], "version")
