"""Bars whose price is 0: the bar after has no return."""

import numpy as np
import pandas as pd
import pytest

from barloom.catalog import q_features
from barloom.operators.series import number_bars
from barloom.plans import block_sweep as BS
from barloom.plans import rules as R
from barloom.plans import sweep as S
from tests.conftest import walk

ZEROS = [40, 41, 90]


def zero_bars(spark, n=150):
    """Minute bars with three closes of 0, the first two in a row."""
    rows = walk(n)
    rows.loc[ZEROS, ["low", "close"]] = 0.0
    return number_bars(spark.createDataFrame(rows), step="1m"), rows


def test_core_rows_take_prices_of_zero(spark, monkeypatch):
    bars, rows = zero_bars(spark)
    monkeypatch.setattr(q_features, "features_of", lambda spark, sf: (bars.select("symbol", "ts", "pos"), bars))
    got = q_features.core_rows(spark, "none").toPandas().sort_values("ts")
    want = rows["close"] / rows["close"].shift().where(lambda x: x != 0) - 1
    assert got["ret"].isna().sum() == 4 and got.loc[got["pos"].isin([41, 42, 91]), "ret"].isna().all()
    pd.testing.assert_series_equal(got["ret"].reset_index(drop=True), want, check_names=False)


def test_sweep_inputs_and_states_take_prices_of_zero(spark):
    bars, rows = zero_bars(spark)
    used = {f for c in R.CORE_RULES.values() for f, _, _ in (*c.entry, *c.exit)} | {c[0] for c in q_features.FU.FIXED_COLUMNS.values()}
    feats = bars.selectExpr("symbol", "ts", *[f"close AS `{f}`" for f in sorted(used)])
    want = rows["close"] / rows["close"].shift().where(lambda x: x != 0) - 1
    _, aligned, _ = q_features.sweep_inputs(feats, bars.drop("pos"), "1m")
    for got in (aligned, R.indicator_states(bars, "bollinger")):
        pd.testing.assert_series_equal(got.select("pos", "ret").toPandas().sort_values("pos", ignore_index=True)["ret"], want, check_names=False)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_falls_merge_where_equity_reaches_zero_or_less(spark, seed):
    """Bars that take all equity, or more with the cost: segments of many sizes against one straight pass."""
    g = np.random.default_rng(seed)
    rules, bars, cost = 60, 240, 0.05
    ret = np.where(g.random(bars) < 0.05, -1.0, g.normal(0.02, 0.3, bars).clip(-0.9))
    held = g.random((rules, bars)) < 0.6
    held[20:, ret == -1.0] = False  # most rules leave in those bars
    was = np.c_[np.zeros(rules, bool), held[:, :-1]]
    entry, exit_ = held & ~was, was & ~held
    count = np.cumsum(entry.astype(int) - exit_, axis=1)
    net = np.where(was, ret, 0.0) - np.where(held != was, cost, 0.0)
    equity = np.cumprod(1.0 + net, axis=1)
    want = (equity / np.maximum.accumulate(equity, axis=1) - 1.0).min(axis=1)
    assert (equity < 0).any(axis=1).sum() > 3 and (equity[:, -1] == 0).any()
    rows, edges = [], sorted({0, bars, *g.integers(1, bars, 12).tolist()})
    for seg, (a, b) in enumerate(zip(edges, edges[1:])):
        base = count[:, a - 1] if a else np.zeros(rules, np.int64)
        out = BS.summaries(entry[:, a:b], exit_[:, a:b], ret[a:b], base, cost)
        for k in range(rules):
            number = {c: None if np.isnan(out[c][k]) else float(out[c][k]) if t == "double" else int(out[c][k]) for c, t in BS.SUMMARY.items()}
            rows.append((k, seg, *number.values(), *[out[c][k] for c in BS.DEPTHS]))
    schema = "rule int, seg long, " + ", ".join([f"{c} {t}" for c, t in BS.SUMMARY.items()] + [f"{c} array<struct<peak:double,low:double>>" for c in BS.DEPTHS])
    got = BS.metrics(spark.createDataFrame(rows, schema), ["rule"]).toPandas().sort_values("rule")
    np.testing.assert_allclose(got["max_drawdown"], want, rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(got["net_return"], equity[:, -1] - 1.0, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("seg_rows", [100_000, 37])
def test_sweep_of_prices_of_zero(spark, monkeypatch, seg_rows):
    """Whole sweep over bars with prices of 0: drawdowns are those of the rule's own equity, in one segment and in many."""
    monkeypatch.setattr(S, "SEGMENT_ROWS", seg_rows)
    monkeypatch.setattr(S, "LOOKBACKS", {"all": None})
    bars, rows = zero_bars(spark)
    got = S.indicator_sweep(bars, ["bollinger"], "1m", inverse=True).toPandas()
    ret = (rows["close"] / rows["close"].shift().where(lambda x: x != 0) - 1).fillna(0.0).to_numpy()
    sig = R.indicator_signals(bars, "bollinger").toPandas().sort_values("pos")
    assert len(got) == 2 * len(R.rule_grid("bollinger")) and (got["net_return"] <= -1).any()
    for r in got.itertuples():
        mine = sig[sig["rule_id"] == r.rule_id]
        e, z = (mine[c].to_numpy(int) for c in (("entry", "exit") if r.side == "long" else ("exit", "entry")))
        held = np.cumsum(e - z) > 0
        was = np.r_[False, held[:-1]]
        equity = np.cumprod(1.0 + np.where(was, ret, 0.0) - np.where(held != was, 0.001, 0.0))
        assert r.net_return == pytest.approx(equity[-1] - 1.0) and r.max_drawdown == pytest.approx((equity / np.maximum.accumulate(equity) - 1.0).min())
