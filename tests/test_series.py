"""Block operators against plain pandas, with blocks far smaller than the series."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import kernels as K
from barloom.operators import series as S

ROWS = 64


def numbered(spark, pdf):
    return S.number_bars(spark.createDataFrame(pdf), step="1m", rows=ROWS)


def sorted_pd(df):
    return df.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


def test_dense_position(spark, two_walks):
    holes = two_walks.drop(two_walks.index[[3, 4, 100, 700]])
    got = sorted_pd(numbered(spark, holes))
    assert (got.groupby("symbol").cumcount() == got["pos"]).all()


def test_rolling_frames_cross_blocks(spark, two_walks):
    def fn(df, w):
        return df.select("*", K.rolling_mean("close", w, 50, 10).alias("m"), K.rolling_std("close", w, 50, 50, 0).alias("s"), F.lag("close").over(w).alias("p"))

    got = sorted_pd(S.by_blocks(numbered(spark, two_walks), ["symbol"], fn, back=49, rows=ROWS))
    g = got.groupby("symbol")["close"]
    assert len(got) == len(two_walks)
    np.testing.assert_allclose(got["m"], g.rolling(50, min_periods=10).mean().reset_index(0, drop=True), rtol=1e-12)
    np.testing.assert_allclose(got["s"], g.rolling(50).std(ddof=0).reset_index(0, drop=True), rtol=1e-7)
    np.testing.assert_allclose(got["p"], g.shift(1))


def test_running_sum_and_carry(spark, two_walks):
    pdf = two_walks.assign(x=np.where(np.arange(len(two_walks)) % 97 == 5, np.arange(len(two_walks)), np.nan))
    df = numbered(spark, pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).withColumn("b", F.floor(F.col("pos") / ROWS))
    got = sorted_pd(S.running_sum(df, ["symbol"], "b", ["pos"], {"cum": F.col("volume")}))
    np.testing.assert_allclose(got["cum"], got.groupby("symbol")["volume"].cumsum(), rtol=1e-12)
    fwd = sorted_pd(S.carry_forward(df, ["symbol"], "b", ["pos"], ["x"]))
    np.testing.assert_allclose(fwd["x"], pdf.groupby("symbol")["x"].ffill().reindex(pdf.sort_values(["symbol", "ts"]).index))
    back = sorted_pd(S.carry_backward(df, ["symbol"], "b", ["pos"], ["x"]))
    np.testing.assert_allclose(back["x"], pdf.groupby("symbol")["x"].bfill().reindex(pdf.sort_values(["symbol", "ts"]).index))


def test_ewm_without_gaps(spark, two_walks):
    specs = [K.span("a", "close", 8), K.wilder("b", "close", 14), K.span("c", "close", 55)]
    rows = 128
    df = S.number_bars(spark.createDataFrame(two_walks), step="1m", rows=rows)
    got = sorted_pd(S.by_blocks(df, ["symbol"], lambda d, w: K.ewm_in_block(d, w, ["symbol", "_blk"], specs), K.ewm_reach(specs), rows=rows))
    for s in specs:
        want = got.groupby("symbol")["close"].transform(lambda x: x.ewm(alpha=s.alpha, adjust=False, min_periods=s.min_rows).mean())
        np.testing.assert_allclose(got[s.out], want, rtol=1e-11)


def test_ewm_with_gaps_is_exact(spark, two_walks):
    g = np.random.default_rng(1)
    pdf = two_walks.assign(v=np.where(g.random(len(two_walks)) < 0.7, np.nan, two_walks["volume"]))
    pdf.loc[200:420, "v"] = np.nan  # several empty blocks
    pdf.loc[:3, "v"] = np.nan
    df = numbered(spark, pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = sorted_pd(K.ewm_with_gaps(df, ["symbol"], [K.wilder("a", "v", 14), K.span("b", "v", 240, 60)], rows=ROWS))
    src = pdf.sort_values(["symbol", "ts"]).reset_index(drop=True)
    for out, alpha, m in (("a", 1 / 14, 14), ("b", 2 / 241, 60)):
        want = src.groupby("symbol")["v"].transform(lambda x: x.ewm(alpha=alpha, adjust=False, min_periods=m).mean())
        np.testing.assert_allclose(got[out], want, rtol=1e-9)


def test_ewm_small_case(spark):
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "pos": [0, 1, 2], "ts": pd.date_range("2024-01-01", periods=3), "x": [1.0, np.nan, 3.0]}))
    df = df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = sorted_pd(K.ewm_with_gaps(df, ["symbol"], [K.Ewm("y", "x", 0.5, 1)], rows=2))
    np.testing.assert_allclose(got["y"], [1.0, 1.0, 0.5 * 0.5 / 0.75 + 3 * 0.5 / 0.75], rtol=1e-12)


def test_order_stats(spark, two_walks):
    stats = [K.OrderStat("q", "close", 90, 20, q=0.95), K.OrderStat("z", "close", 60, 20, "robust_z")]
    got = sorted_pd(K.rolling_order_stats(numbered(spark, two_walks), ["symbol"], stats, rows=ROWS))
    g = got.groupby("symbol")["close"]
    np.testing.assert_allclose(got["q"], g.rolling(90, min_periods=20).quantile(0.95).reset_index(0, drop=True))
    med = g.rolling(60, min_periods=20).median().reset_index(0, drop=True)
    dev = (got["close"] - med).abs()
    mad = dev.groupby(got["symbol"]).rolling(60, min_periods=20).median().reset_index(0, drop=True)
    np.testing.assert_allclose(got["z"], ((got["close"] - med) / (1.4826 * mad)).fillna(0.0), atol=1e-9)


def test_expanding_forms_agree(spark, two_walks):
    df = numbered(spark, two_walks)
    a = sorted_pd(K.expanding_z(df, ["symbol"], ["close", "volume"], 60, rows=ROWS))
    b = sorted_pd(K.expanding_z_wide(df, ["symbol"], ["close", "volume"], 60, rows=ROWS))
    g = a.groupby("symbol")
    for c in ("close", "volume"):
        mean = g[c].transform(lambda x: x.expanding(60).mean().shift(1))
        std = g[c].transform(lambda x: x.expanding(60).std(ddof=0).shift(1))
        want = ((a[c] - mean) / std).fillna(0.0)
        np.testing.assert_allclose(a[f"z_{c}"], want, atol=1e-7)
        np.testing.assert_allclose(b[f"z_{c}"], want, atol=1e-7)


def test_asof_join_takes_last_row_at_or_before(spark, two_walks):
    right = two_walks[two_walks.index % 37 == 4][["symbol", "ts", "close"]].rename(columns={"ts": "at", "close": "c"})
    left = spark.createDataFrame(two_walks[["symbol", "ts"]])
    got = sorted_pd(B.asof_join(left, spark.createDataFrame(right), "ts", "at", ["c", "at"], segment_seconds=60 * ROWS))
    want = pd.merge_asof(two_walks[["symbol", "ts"]].sort_values("ts"), right.sort_values("at"), left_on="ts", right_on="at", by="symbol")
    want = want.sort_values(["symbol", "ts"]).reset_index(drop=True)
    np.testing.assert_allclose(got["c"], want["c"])


def test_gaps(spark):
    ts = pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:01", "2024-01-01 00:05", "2024-01-01 02:00"])
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": ts}))
    end = F.lit("2024-01-01 02:01:00").cast("timestamp")
    got = B.find_gaps(df, "1m", F.lit("2023-12-31 23:58:00").cast("timestamp"), end, rows=16).toPandas().sort_values("gap_start")
    assert got["missing"].tolist() == [2, 3, 114, 1]


def test_resample_weeks_start_on_monday(spark):
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": pd.to_datetime(["2024-01-07 23:59", "2024-01-08 00:00"]), "open": [1.0, 2.0], "high": [1.0, 2.0], "low": [1.0, 2.0], "close": [1.0, 2.0], "volume": [1.0, 1.0]}))
    got = sorted_pd(B.resample(df, "1w"))
    assert got["ts"].dt.strftime("%Y-%m-%d").tolist() == ["2024-01-01", "2024-01-08"]


def test_ordered_sums_over_ranges(spark):
    from barloom.operators import series

    g = np.random.default_rng(7)
    pdf = pd.DataFrame({"k": np.where(np.arange(3000) % 10 == 0, "few", "hot"), "x": g.integers(0, 4000, 3000), "i": np.arange(3000), "v": g.integers(0, 9, 3000)})
    df = spark.createDataFrame(pdf).repartition(5)
    got = series.ordered_number(df, ["k"], [F.desc("x"), "i"], "n", rows=200).toPandas().sort_values("i")
    want = pdf.sort_values(["x", "i"], ascending=[False, True]).groupby("k").cumcount().sort_index() + 1
    assert got["n"].tolist() == want.tolist()
    per = pdf.groupby(["k", "x"], as_index=False)["v"].sum()
    sums = series.ordered_sums(spark.createDataFrame(per), ["k"], ["x"], {"s": F.col("v")}, lagged=True, rows=150).toPandas().sort_values(["k", "x"])
    assert sums["s"].tolist() == (per.groupby("k")["v"].cumsum() - per["v"]).tolist()


def test_look_up_by_size(spark):
    from barloom.operators import series

    rows = spark.createDataFrame([("a", i) for i in range(500)] + [("b", i) for i in range(5)] + [("z", 1)], "k string, i long")
    table = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    for most in (10, 0):
        got = series.look_up(rows, table, ["k"], F.col("i"), "left", most)
        assert got.columns == ["k", "i", "v"] and got.count() == 506 and got.where("v IS NULL").count() == 1
        assert series.look_up(rows, table, ["k"], F.col("i"), most=most).agg(F.sum("v")).first()[0] == 510.0
