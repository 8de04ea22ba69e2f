"""Causality: features of a prefix equal the same rows of the whole series."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators.series import number_bars
from barloom.plans import features as FT
from barloom.plans import fusion as FU

from conftest import walk

FRAMES = ("5m", "1h")


def build(spark, pdf, rows):
    bars = number_bars(spark.createDataFrame(pdf), step="1m", rows=rows)
    return FT.feature_set(bars, {t: B.resample(bars, t) for t in FRAMES}, warmup=100, rows=rows)


def test_prefix_invariance_and_block_independence(spark):
    pdf = walk(1000)
    cols = FT.feature_columns(FRAMES)
    whole = build(spark, pdf, 100_000).toPandas().sort_values("ts").set_index("ts")
    prefix = build(spark, pdf.head(700), 256).toPandas().sort_values("ts").set_index("ts")
    assert len(prefix) == 600 and len(whole) == 900
    np.testing.assert_allclose(prefix[cols], whole.loc[prefix.index, cols], atol=1e-9)
    a = FU.family_scores(spark.createDataFrame(whole.reset_index()), cols, rows=128).toPandas().sort_values("ts").set_index("ts")
    b = FU.family_scores(spark.createDataFrame(prefix.reset_index()), cols, rows=100_000).toPandas().sort_values("ts").set_index("ts")
    raw = [f"raw_{f}" for f in FU.FAMILIES]
    np.testing.assert_allclose(b[raw], a.loc[b.index, raw], atol=1e-6)


def test_winsor_bounds_come_from_training_rows(spark):
    x = np.r_[np.linspace(-1, 1, 1500), np.linspace(-50, 50, 500)]
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "i": np.arange(2000), "x": x}))
    bounds = FT.winsor_bounds(df.where("i < 1500"), ["symbol"], ["x"])
    got = FT.winsor_apply(df.where("i >= 1500"), bounds, ["symbol"], ["x"]).agg(F.min("x"), F.max("x")).first()
    assert -1 < got[0] < -0.98 and 0.98 < got[1] < 1


def test_windows_are_clipped_by_what_came_before(spark):
    g = np.random.default_rng(6)
    frames, want = [], []
    starts = {"A": {"all": 0, "mid": 1500, "late": 1800}, "B": {"all": 0, "mid": 40}}
    for s, n in (("A", 2000), ("B", 60)):
        x = np.r_[np.linspace(-1, 1, n - n // 4), np.linspace(-50, 50, n // 4)]
        pdf = pd.DataFrame({"symbol": s, "ts": pd.date_range("2024-01-01", periods=n, freq="min"), "x": x, "y": g.normal(size=n), "other": 1.0})
        pdf.loc[::7, "y"] = None
        frames.append(pdf)
        for w, at in starts[s].items():
            part = pdf.iloc[at:].assign(window=w)
            if at:
                for c in ("x", "y"):
                    lo, hi = pdf[c].iloc[:at].quantile(FT.WINSOR[0]), pdf[c].iloc[:at].quantile(FT.WINSOR[1])
                    part[c] = part[c].clip(lo, hi)
            want.append(part)
    rows = pd.concat(frames)
    df = spark.createDataFrame(rows).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    first = spark.createDataFrame([(s, w, frames[k]["ts"].iloc[at].to_pydatetime()) for k, s in enumerate(starts) for w, at in starts[s].items()], "symbol string, window string, start_ts timestamp")
    got = FT.causal_windows(df, first, ["all", "mid", "late"], ["symbol"], ["x", "y"]).toPandas().sort_values(["symbol", "window", "ts"]).reset_index(drop=True)
    want = pd.concat(want).sort_values(["symbol", "window", "ts"]).reset_index(drop=True)
    assert got.columns.tolist() == ["symbol", "ts", "x", "y", "other", "window"] and (got["window"] == want["window"]).all()
    np.testing.assert_allclose(got[["x", "y"]], want[["x", "y"]], atol=1e-12)
    late = got[(got["symbol"] == "A") & (got["window"] == "mid")]["x"]
    assert late.max() < 1 and late.min() > -1  # the wild part of the series is clipped to what the calm part allows


def test_legacy_names(spark):
    df = spark.createDataFrame([(1.0,)], f"`{FT.RET}` double")
    assert FT.with_legacy_columns(df).columns == [FT.RET, "ret_1m"]
