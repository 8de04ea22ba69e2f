"""Backtests cut into tiny segments against a straight loop, on a rule that holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.plans import backtest as BT
from barloom.plans import rules as R
from barloom.plans import sweep as S
from barloom.plans import validate as V


def brute(close, entry, exit_, bps=10.0):
    pos = (np.cumsum(entry) > np.cumsum(exit_)).astype(float)
    prev = np.r_[0.0, pos[:-1]]
    ret = np.r_[0.0, close[1:] / close[:-1] - 1]
    gross = prev * ret
    net = gross - np.abs(pos - prev) * bps / 1e4
    eq = np.cumprod(1 + net)
    trades, i = [], 0
    while i < len(pos):
        if pos[i]:
            j = i
            while j + 1 < len(pos) and pos[j + 1]:
                j += 1
            trades.append((eq[j] / (eq[i - 1] if i else 1.0) - 1, net[i : j + 1].sum(), j - i + 1))
            i = j
        i += 1
    r = np.array([t[0] for t in trades])
    return {
        "total_return": np.prod(1 + gross) - 1, "net_return": eq[-1] - 1, "max_drawdown": (eq / np.maximum.accumulate(eq) - 1).min(),
        "trades": len(trades), "win_rate": (r > 0).mean() if len(r) else 0.0,
        "sharpe": net.mean() / net.std() * 525600**0.5 if net.std() > 1e-12 else 0.0,
        "trade_sharpe": r.mean() / r.std() * len(r) ** 0.5 if len(r) and r.std() > 1e-12 else 0.0,
    }, trades, eq


@pytest.fixture(scope="module")
def signals(spark):
    g = np.random.default_rng(5)
    frames = []
    for rule, n, p in (("hot", 700, 0.1), ("cold", 90, 0.3), ("never", 60, 0.0)):
        close = 100 * np.exp(np.cumsum(g.normal(0, 0.01, n)))
        frames.append(pd.DataFrame({"rule_id": rule, "ts": pd.date_range("2024-01-01", periods=n, freq="min"), "close": close,
                                    "entry": g.random(n) < p, "exit": g.random(n) < p * 0.9}))
    pdf = pd.concat(frames, ignore_index=True)
    df = spark.createDataFrame(pdf.assign(ret=pdf.groupby("rule_id")["close"].pct_change().fillna(0.0)))
    return pdf, df.withColumn("seg", F.floor(F.unix_seconds("ts") / (60 * 37)))


def test_metrics_match_a_loop(signals):
    pdf, df = signals
    got = BT.rule_metrics(df, ["rule_id"]).toPandas().set_index("rule_id")
    assert len(got) == 3
    for rule, part in pdf.groupby("rule_id"):
        want, _, _ = brute(part["close"].to_numpy(), part["entry"].to_numpy(), part["exit"].to_numpy())
        for k, v in want.items():
            assert got.loc[rule, k] == pytest.approx(v, rel=1e-9, abs=1e-10), (rule, k)


def test_trades_and_curve_match_a_loop(signals):
    pdf, df = signals
    rows = BT.with_returns(BT.with_positions(df, ["rule_id"]))
    t = BT.trades(BT.pieces(rows, ["rule_id"]), ["rule_id"]).toPandas()
    curve = BT.equity_curve(rows, ["rule_id"]).toPandas().sort_values(["rule_id", "ts"])
    for rule, part in pdf.groupby("rule_id"):
        _, want, eq = brute(part["close"].to_numpy(), part["entry"].to_numpy(), part["exit"].to_numpy())
        mine = t[t["rule_id"] == rule].sort_values("start_ts")
        np.testing.assert_allclose(mine["trade_return"], [x[0] for x in want], rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(mine["pnl"], [x[1] for x in want], rtol=1e-9, atol=1e-12)
        assert mine["bars"].tolist() == [x[2] for x in want]
        np.testing.assert_allclose(curve.loc[curve["rule_id"] == rule, "equity"], eq, rtol=1e-9)


def test_grid_sizes():
    sizes = {f: len(R.rule_grid(f)) for f in R.GRIDS}
    assert sizes == {"rsi": 1728, "macd": 36, "ema_cross": 12, "bollinger": 18, "stoch_rsi": 32, "adx": 9, "cci": 36, "atr_regime": 18}
    assert len(R.core_rule_grid()) == 132
    with pytest.raises(ValueError):
        R.rule_grid("nope")


def test_signals_do_not_depend_on_the_block_size(spark, two_walks):
    from barloom.operators.series import number_bars

    df = number_bars(spark.createDataFrame(two_walks), step="1m")
    for family in ("bollinger", "macd", "adx"):
        out = []
        for rows in (100_000, 200):
            s = R.indicator_signals(df, family, rows=rows)
            out.append(s.groupBy("symbol", "rule_id").agg(F.sum(F.col("entry").cast("int") * F.col("pos")).alias("e"), F.sum(F.col("exit").cast("int") * F.col("pos")).alias("x")).toPandas().sort_values(["symbol", "rule_id"]).reset_index(drop=True))
        pd.testing.assert_frame_equal(out[0], out[1])


def test_lookahead_audit_is_clean(spark, two_walks):
    from barloom.operators.series import number_bars

    df = number_bars(spark.createDataFrame(two_walks), step="1m")
    got = S.lookahead_audit(df, "bollinger", rows=256).toPandas()
    assert (got["changed"] == 0).all() and (got["checked"] > 0).all()


def test_fold_bounds(spark):
    n, k, purge = 487, 4, 7
    df = spark.range(n).select(F.col("id").alias("idx"), F.lit(n).alias("n"))
    got = V.with_folds(df, k, purge).groupBy("fold").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).toPandas().sort_values("fold")
    assert got["lo"].tolist() == [i * n // k + purge for i in range(k)]
    assert got["hi"].tolist() == [(i + 1) * n // k - purge - 1 for i in range(k)]
    assert V.with_folds(df, k, 60).count() == 0  # too little is left of every fold


def test_deploy_pool_takes_distinct_cells_first(spark):
    rows = [
        ("A", "c1", "r1", "gated", "all", 0.9, 0.5), ("A", "c1", "r2", "gated", "all", 0.8, 0.5),
        ("A", "c2", "r3", "ungated", "30d", 0.1, 0.5), ("A", "c1", "r1", "gated", "30d", 0.2, 0.5),
    ]
    df = spark.createDataFrame(rows, "symbol string, family string, rule_id string, gate string, window string, final_score double, friction double")
    df = df.withColumns({"passes": F.lit(True), "alpha": F.lit(0.1)})
    got = V.deploy_pool(df).orderBy("deploy_rank").toPandas()
    assert got["rule_id"].tolist() == ["r1", "r3"]


def test_robustness_and_scores(spark):
    df = spark.createDataFrame([(0.0, 0.01), (0.0, -0.05), (0.2, 0.1), (-0.2, -0.5)], "f double, l double")
    got = [round(x[0], 6) for x in df.select(V.robustness(F.col("f"), F.col("l"))).collect()]
    assert got == [1.0, 0.5, 0.5, 0.0]
    with pytest.raises(ValueError):
        V.failed_reasons("nope")


def test_meta_veto_fails_a_row(spark):
    rows = spark.createDataFrame([("A", True, []), ("B", True, []), ("C", False, ["pbo"])], "symbol string, passes boolean, failed_reasons array<string>")
    meta = spark.createDataFrame([("A", True), ("B", False), ("C", True)], "symbol string, veto_all boolean")
    got = {r.symbol: (r.passes, list(r.failed_reasons)) for r in V.with_meta_veto(rows, meta, ["symbol"]).collect()}
    assert got == {"A": (False, ["meta_precision_floor"]), "B": (True, []), "C": (False, ["pbo", "meta_precision_floor"])}


def test_full_sweep_takes_all_families_cores_gates_and_timeframes(spark, monkeypatch):
    """What the registered sweep asks for, with the sweep itself replaced by a note of its arguments."""
    from barloom.catalog import q_backtest, q_features

    asked = []
    monkeypatch.setattr(q_features, "features_of", lambda spark, sf: (spark.range(1), None))
    monkeypatch.setattr(q_features, "sweep_inputs", lambda feats, minute, t: (f"bars-{t}", f"features-{t}", f"fusion-{t}"))
    names = [*S.SET_KEYS, "rule_id", "trades", "score", "rank"]
    empty = spark.createDataFrame([], ", ".join(f"{c} {'double' if c == 'score' else 'int' if c in ('trades', 'rank') else 'string'}" for c in names))
    monkeypatch.setattr(S, "indicator_sweep", lambda *a, **k: asked.append((a, k)) or empty)
    monkeypatch.setattr(S, "score", lambda cands, keys: cands)
    assert {"timeframe", "gate", "side"} <= set(q_backtest.full_sweep(spark, "none").columns)
    assert [a[2] for a, _ in asked] == ["15m", "1h"]
    for (bars, families, t), k in asked:
        assert sum(len(R.rule_grid(f)) for f in families) == 1889 and sum(len(R.core_rule_grid(c)) for c in k["cores"]) == 132
        assert (bars, k["features"], k["gate"], k["inverse"]) == (f"bars-{t}", f"features-{t}", f"fusion-{t}", True)


def test_cores_and_gates_in_one_sweep(spark):
    """Every rule of a family and of all cores is a candidate of every gate, side and window; gate levels from bars are those from signals."""
    n, g = 150, np.random.default_rng(3)
    rows = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=n, freq="h", tz="UTC"), "pos": np.arange(n), "close": 100 * np.exp(np.cumsum(g.normal(0, 0.01, n)))})
    rows["open"] = rows["high"] = rows["low"] = rows["close"]
    rows["volume"], rows["ret"] = 1.0, rows["close"].pct_change()
    for c in sorted({f for c in R.CORE_RULES.values() for f, _, _ in (*c.entry, *c.exit)}):
        rows[c] = g.normal(0, 1, n)
    rows["fusion_score"], rows["confidence"] = g.normal(0, 1, n), g.uniform(0, 1, n)
    df = spark.createDataFrame(rows)
    bars, gate = df.select("symbol", "ts", "pos", "open", "high", "low", "close", "volume"), df.select("symbol", "ts", "fusion_score", "confidence")
    cores = sorted({c.core for c in R.CORE_RULES.values()})
    got = S.indicator_sweep(bars, ["bollinger"], "1h", gate=gate, inverse=True, features=df, cores=cores).toPandas()
    sizes = got.groupby(["family", "gate", "side", "window"])["rule_id"].nunique()
    assert len(cores) == 6 and len(sizes) == 7 * 2 * 2 * 4 and len(got) == sizes.sum()
    for (family, *_), size in sizes.items():
        assert size == len(R.rule_grid(family) if family == "bollinger" else R.core_rule_grid(family))
    windows = S.window_table(bars)
    one = S.gated_runs(S.signals_by_window(R.core_signals(df, "mean_reclaim"), windows, "1h"), gate, inverse=True)
    want = S.candidates(one, windows).toPandas()
    both = want.merge(got, on=["family", "gate", "side", "window", "rule_id"], suffixes=("", "_got"))
    assert len(both) == len(want) and (both["trades"] == both["trades_got"]).all() and np.allclose(both["net_return"], both["net_return_got"])
