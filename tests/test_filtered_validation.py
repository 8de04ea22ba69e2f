"""The entry filter inside the validation row, end to end."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.plans import metalabel as M
from barloom.plans import validate as V

KEYS = ["symbol", "window"]


def rows_of(spark, frames):
    out = []
    for (symbol, window), close, entry, exit_, x in frames:
        n = len(close)
        out.append(pd.DataFrame({
            "symbol": symbol, "window": window, "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "seg": np.arange(n) // 97, "pos": np.arange(n), "n": n, "high": close * 1.001, "low": close * 0.999,
            "close": close, "ret": np.r_[0.0, close[1:] / close[:-1] - 1], "entry": entry, "exit": exit_, "x0": x, "x1": np.sin(np.arange(n)), "x2": 1.0}))
    return spark.createDataFrame(pd.concat(out, ignore_index=True))


def winners_of(spark, keys):
    return spark.createDataFrame([(*k, "ungated", "trend_cross", "f", "r", 3, 0.0, 15, 0.5, 0.1, -0.1, 0.5, 9, 0.4) for k in keys],
                                 "symbol string, window string, gate string, rule_key string, family string, rule_id string, n_params int, hold_return double, trade_floor int, total_return double, net_return double, max_drawdown double, win_rate double, trades int, alpha double")


def every(n, step, at=0):
    out = np.zeros(n, bool)
    out[at::step] = True
    return out


@pytest.fixture(scope="module")
def three(spark):
    g = np.random.default_rng(8)
    n = 420
    falling = np.linspace(100.0, 92.0, n)  # every entry loses: no threshold has the precision
    # entries pay off where x0 is high
    x = g.normal(size=n)
    entry = every(n, 4)
    step = np.where(entry, np.where(x > 0, 0.02, -0.02), 0.0)
    paying = 100.0 * np.exp(np.cumsum(np.r_[0.0, step[:-1]]))
    frames = [(("A", "all"), falling, every(n, 8), every(n, 8, 4), g.normal(size=n)), (("B", "all"), paying, entry, every(n, 4, 2), x), (("C", "30d"), paying[:60], every(60, 20), every(60, 20, 9), x[:60])]
    return frames, rows_of(spark, frames)


CFG = M.FilterConfig(horizon=2, take=1.0, stop=1.0, min_events=10, gap=2, cap=3, floor=0.6)


def test_filter_vetoes_all_some_and_for_lack_of_events(spark, three):
    frames, rows = three
    kept, report = M.entry_filter(rows, ["x0", "x1", "x2"], KEYS, CFG, 64)
    got = {r.symbol: r for r in report.collect()}
    assert [got[s].reason for s in "ABC"] == ["precision_floor_unmet_global", "ok", "insufficient_events"]
    assert [got[s].veto_all for s in "ABC"] == [True, False, True]
    assert got["A"].events > 40 and got["C"].events == 3
    picked = kept.toPandas()
    assert set(picked["symbol"]) == {"B"}
    x = frames[1][4]
    good = set(np.flatnonzero(frames[1][2] & (x > 0)))
    share = np.mean([p in good for p in picked["pos"]])
    assert share > 0.85 and len(picked) > 0.7 * len(good)  # the filter finds the entries that pay off
    # the same fits when no fold may be gathered in one task
    orig = M.fit_folds
    try:
        M.fit_folds = lambda *a, **k: orig(*a, **{**k, "small": 0})
        again, _ = M.entry_filter(rows, ["x0", "x1", "x2"], KEYS, CFG, 64)
    finally:
        M.fit_folds = orig
    assert sorted(again.toPandas()["pos"]) == sorted(picked["pos"])


def test_validation_sees_only_kept_entries(spark, three):
    _, rows = three
    won = winners_of(spark, [("A", "all"), ("B", "all"), ("C", "30d")])
    trials = spark.createDataFrame([("A", "all", 5), ("B", "all", 7), ("C", "30d", 5)], "symbol string, window string, trials int")
    args = dict(step=2, strictness="recovery", splits=3, folds=3, purge=5)
    out = V.filtered_validation(won, rows, ["x0", "x1", "x2"], KEYS, trials, CFG, **args).toPandas().set_index("symbol")
    assert out.loc["A", "trades"] == 0 and not out.loc["A", "passes"] and "meta_precision_floor" in out.loc["A", "failed_reasons"]
    assert out.loc["C", "trades"] == 0 and "meta_precision_floor" in out.loc["C", "failed_reasons"]
    assert "meta_precision_floor" not in out.loc["B", "failed_reasons"]
    assert 0 < out.loc["B", "entries_kept"] < out.loc["B", "entries_raw"] and out.loc["A", "entries_kept"] == 0
    # the same row from signals that were filtered by hand
    kept, _ = M.entry_filter(rows, ["x0", "x1", "x2"], KEYS, CFG)
    hand = rows.join(kept.withColumn("k", F.lit(True)), [*KEYS, "pos"], "left").withColumn("entry", F.col("entry") & F.coalesce("k", F.lit(False))).where("symbol = 'B'")
    from barloom.plans import backtest as BT

    m = BT.rule_metrics(hand, KEYS).toPandas().iloc[0]
    assert m["trades"] == out.loc["B", "trades"] and m["net_return"] == pytest.approx(out.loc["B", "alpha"]) and m["max_drawdown"] == pytest.approx(out.loc["B", "max_drawdown"])
    alphas = V.fold_alphas(V.sampled_rows(hand, KEYS, 2), KEYS, 3).toPandas()["alpha"]
    assert (alphas >= 0).mean() == pytest.approx(out.loc["B", "wf_pass_rate"]) and alphas.median() == pytest.approx(out.loc["B", "wf_alpha_median"])


def test_chosen_features():
    cols = ["a", "b", "c", "d"]
    assert M.chosen_features(cols) == ["a", "b", "c"]
    assert M.chosen_features(cols, ("d", "x", "d", "b")) == ["d", "b"]
    assert M.chosen_features(cols, ("d",), 3) == ["d", "a", "b"]
    assert M.chosen_features(cols, (), 9) == cols
    assert M.chosen_features(cols, ("d", "c"), 1) == ["d"]
