"""Barrier events, weights, folds, thresholds and the logistic fit."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.plans import metalabel as M

CLOSES = [100.0, 100.5, 100.2, 100.8, 100.4, 100.0, 100.1, 100.2, 100.3, 100.6, 100.5, 100.4, 100.6, 100.5, 100.3, 101.0, 100.8, 100.6, 100.4, 100.2, 100.1, 100.0, 99.9, 99.8]


def bars(spark, close, entries, wide=1e-4):
    n = len(close)
    c = np.array(close)
    return spark.createDataFrame(pd.DataFrame({
        "symbol": "A", "pos": np.arange(n), "ts": pd.date_range("2024-01-01", periods=n, freq="15min"), "open": c, "high": c * (1 + wide), "low": c * (1 - wide),
        "close": c, "entry": [i in entries for i in range(n)]}))


def test_vertical_barrier_labels(spark):
    got = M.barrier_events(bars(spark, CLOSES, {5, 15}), 4, 50.0, 50.0, 3, rows=6).orderBy("entry_idx").toPandas()
    assert got["provenance"].tolist() == ["vertical_pos", "vertical_nonpos"]
    assert got["label"].tolist() == [1, 0]
    assert got["exit_idx"].tolist() == [9, 19]
    assert got["net_return"].iloc[0] == pytest.approx(100.6 / 100.0 - 1 - 0.002, abs=1e-9)


def test_stop_wins_ties_and_last_bars_are_skipped(spark):
    got = M.barrier_events(bars(spark, CLOSES, {5, 22, 23}, wide=0.05), 4, 0.05, 0.05, 3, rows=6).toPandas()
    assert got["entry_idx"].tolist() == [5]
    assert got["provenance"].tolist() == ["sl_first"] and got["exit_idx"].tolist() == [6]


def test_uniqueness_weights_match_a_loop(spark):
    n = 60
    ev = [(0, 5), (2, 9), (3, 4), (20, 21), (21, 40), (30, 35)]
    e = spark.createDataFrame([("A", a, b) for a, b in ev], "symbol string, entry_idx long, exit_idx long")
    b = spark.range(n).select(F.lit("A").alias("symbol"), F.col("id").alias("pos"))
    got = M.uniqueness_weights(e, b, rows=8).orderBy("entry_idx").toPandas()["weight"].to_numpy()
    c = np.zeros(n)
    for a, z in ev:
        c[a + 1 : z + 1] += 1
    w = np.array([np.mean(1 / c[a + 1 : z + 1]) for a, z in ev])
    np.testing.assert_allclose(got, w / w.mean(), rtol=1e-12)


def test_no_threshold_under_the_floor(spark):
    df = spark.createDataFrame([("A", y, p) for y, p in zip([0, 0, 0, 1], [0.9, 0.8, 0.7, 0.6])], "symbol string, label int, prob double")
    got = M.threshold_scan(df, ["symbol"], M.threshold_grid(), 0.6).toPandas().iloc[0]
    assert got["valid_count"] == 0 and bool(got["veto_all"]) and pd.isna(got["threshold"])


def test_average_precision(spark):
    g = np.random.default_rng(2)
    p, y = np.round(g.random(300), 2), (g.random(300) < 0.3).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "label": y, "prob": p}))
    area, tp, seen = 0.0, 0, 0
    for s in sorted(set(p), reverse=True):
        hit = y[p == s]
        tp, seen = tp + hit.sum(), seen + len(hit)
        area += hit.sum() / y.sum() * tp / seen
    assert M.average_precision(df, ["symbol"]).toPandas()["pr_auc"].iloc[0] == pytest.approx(area, abs=1e-12)


def test_folds_keep_the_band_out_of_training(spark):
    ev = spark.range(60).select(F.lit("A").alias("symbol"), (F.col("id") * 3).alias("entry_idx"), (F.col("id") % 2).cast("int").alias("label"))
    rows = M.cpcv_rows(ev, 6, 2, gap=5, rows=16).toPandas()
    assert rows["fold"].nunique() > 5
    for _, f in rows.groupby("fold"):
        test, train = f[f["role"] == "test"]["entry_idx"], f[f["role"] == "train"]["entry_idx"]
        assert len(test) == 20 and len(train) >= 10
        assert not train.between(test.min() - 5, test.max() + 5).any()


@pytest.mark.parametrize("penalty", ["l2", "l1"])
def test_logistic_fit_reaches_the_optimum(spark, penalty):
    g = np.random.default_rng(4)
    n = 400
    x = g.normal(size=(n, 2))
    y = (g.random(n) < 1 / (1 + np.exp(-(x @ [1.5, -0.7] + 0.3)))).astype(int)
    w = g.uniform(0.5, 1.5, n)
    role = np.where(np.arange(n) % 4 == 0, "test", "train")
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "fold": 0, "role": role, "a": x[:, 0], "b": x[:, 1], "label": y, "weight": w}))
    beta = np.array(M.fit_folds(df, ["a", "b"], ["symbol", "fold"], penalty=penalty, c=0.5).collect()[0]["beta"])
    t = role == "train"
    bal = np.where(y[t] == 1, t.sum() / (2 * y[t].sum()), t.sum() / (2 * (1 - y[t]).sum()))

    def loss(b):
        z = x[t] @ b[:2] + b[2]
        fit = 0.5 * (w[t] * bal * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y[t] * z)).sum()
        return fit + (0.5 * (b[:2] ** 2).sum() if penalty == "l2" else np.abs(b[:2]).sum())

    best = loss(beta)
    for _ in range(200):
        assert loss(beta + g.normal(scale=0.01, size=3)) >= best - 1e-9
