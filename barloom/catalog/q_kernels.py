"""Rolling, exponential and expanding statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import query
from barloom.catalog.common import BARS_1D, BARS_1H, WINDOW, daily, hourly, r, show
from barloom.functions.expr import crossed_above, crossed_below, finite, log_ratio, min_max_scale, nonzero
from barloom.operators import kernels as K
from barloom.operators.series import by_blocks
from barloom.plans.features import winsor_apply, winsor_bounds

KEY = ["symbol", "ts"]


def part(df):
    return ["symbol", "_blk"]


@query("log_returns", f"""WITH {BARS_1H} SELECT symbol, ts,
 {r('close - lag(close) OVER w', 'diff')}, {r('close / lag(close) OVER w - 1', 'pct')},
 {r('ln((close + 1e-12) / (lag(close) OVER w + 1e-12))', 'logret')} FROM bars {WINDOW}""")
def log_returns(spark, sf):
    def fn(df, w):
        prev = F.lag("close").over(w)
        return df.select("*", (F.col("close") - prev).alias("diff"), (F.col("close") / prev - 1).alias("pct"),
                         log_ratio(F.col("close"), prev).alias("logret"))

    return show(by_blocks(hourly(spark, sf), ["symbol"], fn, 1), KEY, ["diff", "pct", "logret"])


_F20 = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("rolling_stats", f"""WITH {BARS_1H} SELECT symbol, ts,
 {r('CASE WHEN count(close) OVER f >= 5 THEN avg(close) OVER f END', 'mean20')},
 {r('CASE WHEN count(close) OVER f >= 5 THEN min(close) OVER f END', 'min20')},
 {r('CASE WHEN count(close) OVER f >= 5 THEN max(close) OVER f END', 'max20')},
 {r('CASE WHEN count(close) OVER f >= 20 THEN stddev_samp(close) OVER f END', 'std20')},
 {r('CASE WHEN count(close) OVER f >= 20 THEN stddev_pop(close) OVER f END', 'stdp20')}
FROM bars WINDOW f AS {_F20}""")
def rolling_stats(spark, sf):
    def fn(df, w):
        return df.select(
            "*", K.rolling_mean("close", w, 20, 5).alias("mean20"), K.rolling_min("close", w, 20, 5).alias("min20"),
            K.rolling_max("close", w, 20, 5).alias("max20"), K.rolling_std("close", w, 20, 20).alias("std20"),
            K.rolling_std("close", w, 20, 20, ddof=0).alias("stdp20"),
        )

    return show(by_blocks(hourly(spark, sf), ["symbol"], fn, 19), KEY, ["mean20", "min20", "max20", "std20", "stdp20"])


@query("rolling_quantiles", f"""WITH {BARS_1H} SELECT symbol, ts,
 {r('CASE WHEN count(close) OVER f >= 10 THEN quantile_cont(close, 0.5) OVER f END', 'med30')},
 {r('CASE WHEN count(close) OVER g >= 60 THEN quantile_cont(close, 0.95) OVER g END', 'q95_240')}
FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
 g AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 239 PRECEDING AND CURRENT ROW)""")
def rolling_quantiles(spark, sf):
    """Short frame on the JVM, long frame as an incremental rolling quantile."""
    long = K.rolling_order_stats(hourly(spark, sf), ["symbol"], [K.OrderStat("q95_240", "close", 240, 60, q=0.95)])
    out = by_blocks(long, ["symbol"], lambda df, w: df.select("*", K.rolling_quantile("close", w, 30, 10, 0.5).alias("med30")), 29)
    return show(out, KEY, ["med30", "q95_240"])


@query("robust_z", f"""WITH {BARS_1H},
x AS (SELECT symbol, ts, close, CASE WHEN count(*) OVER f >= 20 THEN quantile_cont(close, 0.5) OVER f END AS med FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
y AS (SELECT *, abs(close - med) AS dev FROM x),
z AS (SELECT *, CASE WHEN count(dev) OVER f >= 20 THEN quantile_cont(dev, 0.5) OVER f END AS mad FROM y WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT symbol, ts, {r('coalesce((close - med) / nullif(1.4826 * mad, 0), 0)', 'z')} FROM z""")
def robust_z(spark, sf):
    return show(K.rolling_order_stats(hourly(spark, sf), ["symbol"], [K.OrderStat("z", "close", 60, 20, "robust_z")]), KEY, ["z"])


@query("ewm_mean", f"""WITH RECURSIVE {BARS_1D}, x AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars),
e AS (SELECT symbol, ts, i, close AS s8, close AS s55, close AS w14 FROM x WHERE i = 1
 UNION ALL SELECT x.symbol, x.ts, x.i, e.s8 + 2.0::DOUBLE / 9 * (x.close - e.s8), e.s55 + 2.0::DOUBLE / 56 * (x.close - e.s55), e.w14 + (x.close - e.w14) / 14
 FROM e JOIN x ON x.symbol = e.symbol AND x.i = e.i + 1)
SELECT symbol, ts, {r('CASE WHEN i >= 8 THEN s8 END', 'ema8')}, {r('CASE WHEN i >= 55 THEN s55 END', 'ema55')}, {r('CASE WHEN i >= 14 THEN w14 END', 'wilder14')} FROM e""")
def ewm_mean(spark, sf):
    specs = [K.span("ema8", "close", 8), K.span("ema55", "close", 55), K.wilder("wilder14", "close", 14)]
    out = by_blocks(daily(spark, sf), ["symbol"], lambda df, w: K.ewm_in_block(df, w, part(df), specs), K.ewm_reach(specs))
    return show(out, KEY, [s.out for s in specs])


@query("ewm_mean_gaps", f"""WITH RECURSIVE {BARS_1H}, x AS (SELECT symbol, ts, CASE WHEN volume > 150 THEN volume END AS v, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars),
e AS (SELECT symbol, ts, i, v AS y, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS n, CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END AS k FROM x WHERE i = 1
 UNION ALL SELECT x.symbol, x.ts, x.i,
  CASE WHEN x.v IS NULL THEN e.y WHEN e.y IS NULL THEN x.v ELSE (pow(1 - 1.0::DOUBLE / 14, e.k) * e.y + x.v / 14) / (pow(1 - 1.0::DOUBLE / 14, e.k) + 1.0::DOUBLE / 14) END,
  e.n + CASE WHEN x.v IS NULL THEN 0 ELSE 1 END, CASE WHEN x.v IS NOT NULL THEN 1 WHEN e.k > 0 THEN e.k + 1 ELSE 0 END
 FROM e JOIN x ON x.symbol = e.symbol AND x.i = e.i + 1)
SELECT symbol, ts, {r('CASE WHEN n >= 14 THEN y END', 'mean14')} FROM e""")
def ewm_mean_gaps(spark, sf):
    rows = hourly(spark, sf).withColumn("v", F.expr("CASE WHEN volume > 150 THEN volume END"))
    return show(K.ewm_with_gaps(rows, ["symbol"], [K.wilder("mean14", "v", 14)]), KEY, ["mean14"])


@query("expanding_z", f"""WITH {BARS_1H}, x AS (SELECT *, count(close) OVER f AS n, avg(close) OVER f AS m, stddev_pop(close) OVER f AS s,
 avg(volume) OVER f AS mv, stddev_pop(volume) OVER f AS sv FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT symbol, ts, {r('CASE WHEN n >= 60 THEN coalesce((close - m) / nullif(s, 0), 0) ELSE 0 END', 'z_close')},
 {r('tanh(CASE WHEN n >= 60 THEN coalesce((volume - mv) / nullif(sv, 0), 0) ELSE 0 END)', 't_volume')} FROM x""")
def expanding_z(spark, sf):
    out = K.expanding_z(hourly(spark, sf), ["symbol"], ["close", "volume"], 60)
    return show(out.withColumn("t_volume", F.tanh("z_volume")), KEY, ["z_close", "t_volume"])


@query("ew_correlation", f"""WITH RECURSIVE {BARS_1H}, b AS (SELECT symbol, ts, row_number() OVER w AS i, coalesce(lag(volume) OVER w, 0) AS x,
  coalesce(ln((close + 1e-12) / (lag(close) OVER w + 1e-12)), 0) AS y FROM bars {WINDOW}),
m AS (SELECT symbol, ts, i, x, y, x AS mx, y AS my FROM b WHERE i = 1
 UNION ALL SELECT b.symbol, b.ts, b.i, b.x, b.y, 0.98::DOUBLE * m.mx + 0.02::DOUBLE * b.x, 0.98::DOUBLE * m.my + 0.02::DOUBLE * b.y FROM m JOIN b ON b.symbol = m.symbol AND b.i = m.i + 1),
d AS (SELECT symbol, ts, i, (x - mx) * (y - my) AS xy, (x - mx) * (x - mx) AS xx, (y - my) * (y - my) AS yy FROM m WHERE i >= 120),
v AS (SELECT symbol, ts, i, xy, xx, yy FROM d WHERE i = 120
 UNION ALL SELECT d.symbol, d.ts, d.i, 0.98::DOUBLE * v.xy + 0.02::DOUBLE * d.xy, 0.98::DOUBLE * v.xx + 0.02::DOUBLE * d.xx, 0.98::DOUBLE * v.yy + 0.02::DOUBLE * d.yy FROM v JOIN d ON d.symbol = v.symbol AND d.i = v.i + 1)
SELECT b.symbol, b.ts, {r('CASE WHEN v.i >= 239 THEN coalesce(v.xy / sqrt(v.xx * v.yy + 1e-12), 0) ELSE 0 END', 'corr')}
FROM b LEFT JOIN v ON v.symbol = b.symbol AND v.i = b.i""")
def ew_correlation(spark, sf):
    def fn(df, w):
        df = df.withColumn("ret", log_ratio(F.col("close"), F.lag("close").over(w)))
        return K.ew_correlation(df, w, part(df), [("corr", "volume", "ret")])

    return show(by_blocks(hourly(spark, sf), ["symbol"], fn, K.ew_correlation_reach() + 1), KEY, ["corr"])


@query("cross_signals", f"""WITH {BARS_1H} SELECT symbol, ts,
 coalesce(lag(close) OVER w <= 50 AND close > 50, false) AS above, coalesce(lag(close) OVER w >= 50 AND close < 50, false) AS below FROM bars {WINDOW}""")
def cross_signals(spark, sf):
    def fn(df, w):
        prev = F.lag("close").over(w)
        return df.select("*", crossed_above(prev, F.col("close"), 50.0).alias("above"), crossed_below(prev, F.col("close"), 50.0).alias("below"))

    return by_blocks(hourly(spark, sf), ["symbol"], fn, 1).select(*KEY, "above", "below")


@query("min_max_norm", f"""WITH {BARS_1H}, x AS (SELECT symbol, min(close) AS lo, max(close) AS hi FROM bars GROUP BY 1)
SELECT b.symbol, b.ts, {r('CASE WHEN abs(hi - lo) < 1e-12 THEN 0.5 ELSE (close - lo) / (hi - lo) END', 'norm')} FROM bars b JOIN x USING (symbol)""")
def min_max_norm(spark, sf):
    bars = hourly(spark, sf)
    lim = bars.groupBy("symbol").agg(F.min("close").alias("lo"), F.max("close").alias("hi"))
    out = bars.join(lim, "symbol").withColumn("norm", min_max_scale(F.col("close"), F.col("lo"), F.col("hi")))
    return show(out, KEY, ["norm"])


@query("atr_ratio", f"""WITH {BARS_1H}, x AS (SELECT symbol, ts, greatest(abs(high - low), abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) / (abs(nullif(lag(close) OVER w, 0)) + 1e-12::DOUBLE) AS tr FROM bars {WINDOW}),
y AS (SELECT symbol, ts, CASE WHEN count(tr) OVER f >= 7 THEN avg(tr) OVER f END AS a FROM x WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
SELECT symbol, ts, {r('lag(a) OVER w', 'atr_ratio', 5)} FROM y {WINDOW}""")
def atr_ratio(spark, sf):
    from barloom.plans.metalabel import lagged_atr_ratio

    return show(by_blocks(hourly(spark, sf), ["symbol"], lambda df, w: lagged_atr_ratio(df, w, 14), 16), KEY, ["atr_ratio"], 5)


@query("trendline", f"""WITH {BARS_1H}, x AS (SELECT *, row_number() OVER w - 1 AS pos FROM bars {WINDOW})
SELECT symbol, ts, {r('CASE WHEN count(*) OVER f >= 50 THEN regr_intercept(close, pos) OVER f + regr_slope(close, pos) OVER f * pos END', 'trend', 5)}
FROM x WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
def trendline(spark, sf):
    return show(by_blocks(hourly(spark, sf), ["symbol"], lambda df, w: df.select("*", K.trend_endpoint("close", "pos", w, 50).alias("trend")), 49), KEY, ["trend"], 5)


def _z(c):
    return r(f"coalesce(CASE WHEN count({c}) OVER f >= 20 THEN ({c} - avg({c}) OVER f) / nullif(stddev_samp({c}) OVER f, 0) END, 0)", f"z_{c}")


@query("return_volume_z", f"""WITH {BARS_1H}, x AS (SELECT symbol, ts, volume, close / lag(close) OVER w - 1 AS ret FROM bars {WINDOW})
SELECT symbol, ts, {_z('ret')}, {_z('volume')} FROM x WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def return_volume_z(spark, sf):
    def fn(df, w):
        df = df.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)
        cols = []
        for c in ("ret", "volume"):
            z = (F.col(c) - K.rolling_mean(c, w, 60, 20)) / nonzero(K.rolling_std(c, w, 60, 20))
            cols.append(F.coalesce(finite(z), F.lit(0.0)).alias(f"z_{c}"))
        return df.select("*", *cols)

    return show(by_blocks(hourly(spark, sf), ["symbol"], fn, 61), KEY, ["z_ret", "z_volume"])


@query("winsor_bounds", f"""WITH {BARS_1H}, m AS (SELECT symbol, max(ts) AS mx FROM bars GROUP BY 1)
SELECT symbol, {r('quantile_cont(close, 0.005)', 'close_lo')}, {r('quantile_cont(close, 0.995)', 'close_hi')},
 {r('quantile_cont(volume, 0.005)', 'volume_lo')}, {r('quantile_cont(volume, 0.995)', 'volume_hi')}
FROM bars JOIN m USING (symbol) WHERE ts < mx - to_days(10) GROUP BY 1""")
def winsor_bounds_query(spark, sf):
    b = winsor_bounds(_train(hourly(spark, sf)), ["symbol"], ["close", "volume"])
    return b.select("symbol", *[F.round(F.col(f"{c}.{s}"), 6).alias(f"{c}_{s}") for c in ("close", "volume") for s in ("lo", "hi")])


def _train(bars):
    newest = bars.groupBy("symbol").agg(F.max("ts").alias("_mx"))
    return bars.join(newest, "symbol").where(F.col("ts") < F.col("_mx") - F.expr("INTERVAL 10 DAYS")).drop("_mx")


@query("winsor_apply", f"""WITH {BARS_1H}, m AS (SELECT symbol, max(ts) AS mx FROM bars GROUP BY 1),
q AS (SELECT symbol, quantile_cont(close, 0.005) AS cl, quantile_cont(close, 0.995) AS ch, quantile_cont(volume, 0.005) AS vl, quantile_cont(volume, 0.995) AS vh
 FROM bars JOIN m USING (symbol) WHERE ts < mx - to_days(10) GROUP BY 1)
SELECT b.symbol, b.ts, {r('least(greatest(close, cl), ch)', 'close')}, {r('least(greatest(volume, vl), vh)', 'volume')} FROM bars b JOIN q USING (symbol)""")
def winsor_apply_query(spark, sf):
    bars = hourly(spark, sf)
    bounds = winsor_bounds(_train(bars), ["symbol"], ["close", "volume"])
    return show(winsor_apply(bars, bounds, ["symbol"], ["close", "volume"]), KEY, ["close", "volume"])
