"""The block-wise sweep against the sweep over rule x bar rows, and against a straight loop."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators.series import number_bars
from barloom.plans import block_sweep as BS
from barloom.plans import rules as R
from barloom.plans import sweep as S
from tests.test_backtest import brute


def test_summaries_match_a_loop():
    g = np.random.default_rng(4)
    n = 400
    close = 100 * np.exp(np.cumsum(g.normal(0, 0.01, n)))
    ret = np.r_[0.0, close[1:] / close[:-1] - 1]
    entry, exit_ = g.random((30, n)) < 0.1, g.random((30, n)) < 0.09
    entry[0], exit_[1] = False, False
    out = BS.summaries(entry, exit_, ret, np.zeros(30, np.int64), 0.001)
    for k in range(30):
        want, trades, eq = brute(close, entry[k], exit_[k])
        assert out["growth"][k] == pytest.approx(eq[-1]) and out["worst"][k] == pytest.approx(want["max_drawdown"]) and out["gross_growth"][k] - 1 == pytest.approx(want["total_return"])
        assert out["trades"][k] + (~np.isnan(out["tail"][k])) == len(trades)
        assert np.isnan(out["head"][k])


@pytest.mark.parametrize("seg_rows", [100_000, 37])
def test_block_sweep_equals_rule_rows(spark, two_walks, monkeypatch, seg_rows):
    """All families and cores, both gates and sides, windows that differ, one segment and many."""
    monkeypatch.setattr(S, "SEGMENT_ROWS", seg_rows)
    monkeypatch.setattr(S, "LOOKBACKS", {"all": None})
    monkeypatch.setattr(BS, "CHUNK_RULES", 7)
    g = np.random.default_rng(3)
    rows = two_walks[["symbol", "ts", "open", "high", "low", "close", "volume"]].copy()
    rows["fusion_score"], rows["confidence"] = g.normal(0, 1, len(rows)), g.uniform(0, 1, len(rows))
    rows.loc[::11, "fusion_score"] = None
    for c in R.core_features():
        rows[c] = g.normal(0, 1, len(rows))
    df = number_bars(spark.createDataFrame(rows), step="1m").cache()
    bars, gate = df.select("symbol", "ts", "pos", "open", "high", "low", "close", "volume"), df.select("symbol", "ts", "fusion_score", "confidence")
    feats = df.withColumn("ret", F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("ts")) - 1)
    windows = S.window_table(bars)
    windows = windows.unionByName(windows.withColumns({"window": F.lit("late"), "start_ts": F.col("start_ts") + F.expr("INTERVAL 91 MINUTES")}))
    monkeypatch.setattr(S, "window_table", lambda *a, **k: windows)
    families = ["bollinger", "adx"] if seg_rows == 37 else ["macd", "cci", "ema_cross"]
    cores = sorted({c.core for c in R.CORE_RULES.values()})[:2]
    got = S.indicator_sweep(bars, families, "1m", gate=gate, inverse=True, features=feats, cores=cores).toPandas()
    sig = None
    for part in [R.indicator_signals(bars, f) for f in families] + [R.core_signals(feats, c) for c in cores]:
        sig = part if sig is None else sig.unionByName(part)
    want = S.candidates(S.gated_runs(S.signals_by_window(sig, windows, "1m"), gate, inverse=True), windows).toPandas()
    keys = [*S.SET_KEYS, "rule_id"]
    assert len(got) == len(want) == 2 * 2 * 2 * 2 * (sum(len(R.rule_grid(f)) for f in families) + sum(len(R.core_rule_grid(c)) for c in cores))
    a, b = got.sort_values(keys).reset_index(drop=True), want.sort_values(keys).reset_index(drop=True)
    pd.testing.assert_frame_equal(a[keys], b[keys])
    assert (a["trades"] == b["trades"]).all() and b["trades"].max() > 1
    for c in ("total_return", "net_return", "max_drawdown", "win_rate", "sharpe", "trade_sharpe", "credibility_penalty"):
        np.testing.assert_allclose(a[c], b[c], rtol=1e-7, atol=1e-9, err_msg=c)
