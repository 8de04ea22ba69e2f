"""Backtests, scoring and ranking."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from barloom.catalog import query
from barloom.catalog.common import BARS_1D, BARS_1H, daily, hourly, r, show
from barloom.catalog.q_rules import bollinger_rows_sql, ema_rows_sql, numbered_sql
from barloom.operators.series import by_blocks
from barloom.plans import backtest as BT
from barloom.plans import rules as R
from barloom.plans import sweep as S
from barloom.session import stage

RULE = ["symbol", "rule_id"]


def slog(c):
    """Signed log, for returns that compound over many orders of magnitude."""
    return F.signum(c) * F.log1p(F.abs(c))


def slog_sql(e: str) -> str:
    return f"sign({e}) * ln(1 + abs({e}))"


def backtest_sql(keys: str = "symbol, rule_id", src: str = "sig", bps: str = "10") -> str:
    """CTEs `rt` (bar returns), `cv` (equity), `tr` (trades) and `mt` (metrics) over `src`."""
    return f"""p0 AS (SELECT *, sum(entry::INT - exit::INT) OVER (PARTITION BY {keys} ORDER BY ts) > 0 AS held FROM {src}),
p1 AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY {keys} ORDER BY ts), false) AS was_held FROM p0),
rt AS (SELECT *, g AS gross, g - CASE WHEN held <> was_held THEN {bps}::DOUBLE / 10000 ELSE 0 END AS net,
  sum((held AND NOT was_held)::INT) OVER (PARTITION BY {keys} ORDER BY ts) AS trade_id
 FROM (SELECT *, CASE WHEN was_held THEN coalesce(ret, 0) ELSE 0 END AS g FROM p1)),
cv0 AS (SELECT *, product(1 + net) OVER (PARTITION BY {keys} ORDER BY ts) AS equity FROM rt),
cv AS (SELECT *, equity / max(equity) OVER (PARTITION BY {keys} ORDER BY ts) - 1 AS drawdown FROM cv0),
tr AS (SELECT {keys}, trade_id, product(1 + net) - 1 AS trade_return, sum(net) AS pnl, count(*) AS bars, min(ts) AS start_ts, max(ts) AS end_ts
 FROM rt WHERE held GROUP BY ALL),
m1 AS (SELECT {keys}, product(1 + gross) - 1 AS total_return, product(1 + net) - 1 AS net_return, avg(net) AS mean, stddev_pop(net) AS std FROM rt GROUP BY ALL),
m2 AS (SELECT {keys}, min(drawdown) AS max_drawdown FROM cv GROUP BY ALL),
m3 AS (SELECT {keys}, count(*) AS trades, avg((trade_return > 0)::INT) AS win_rate, avg(trade_return) AS tm, stddev_pop(trade_return) AS tstd FROM tr GROUP BY ALL),
mt AS (SELECT m1.*, max_drawdown, coalesce(trades, 0) AS trades, coalesce(win_rate, 0) AS win_rate,
  CASE WHEN std > 1e-12 THEN mean / std * sqrt(525600) ELSE 0 END AS sharpe,
  coalesce(CASE WHEN tstd > 1e-12 THEN tm / tstd * sqrt(trades) END, 0) AS trade_sharpe
 FROM m1 JOIN m2 USING ({keys}) LEFT JOIN m3 USING ({keys}))"""


BOLL_1H = f"WITH {numbered_sql(BARS_1H)}, {bollinger_rows_sql()}, {backtest_sql()}"


def signals_1h(spark, sf, family="bollinger"):
    return R.indicator_signals(hourly(spark, sf), family).withColumn("seg", R.segment_column("1h", S.SEGMENT_ROWS))


def positions_1h(spark, sf):
    return BT.with_returns(BT.with_positions(signals_1h(spark, sf), RULE))


@query("positions", f"""{BOLL_1H} SELECT symbol, rule_id, ts, held, {r('gross', 'gross')}, {r('net', 'net')} FROM rt""")
def positions(spark, sf):
    return show(positions_1h(spark, sf), [*RULE, "ts", "held"], ["gross", "net"])


@query("equity_curve", f"""{BOLL_1H} SELECT symbol, rule_id, ts, {r('ln(equity)', 'log_equity')}, {r('drawdown', 'drawdown')} FROM cv""")
def equity_curve(spark, sf):
    out = BT.equity_curve(positions_1h(spark, sf), RULE).withColumn("log_equity", F.ln("equity"))
    return show(out, [*RULE, "ts"], ["log_equity", "drawdown"])


@query("trades", f"""{BOLL_1H} SELECT symbol, rule_id, CAST(trade_id AS BIGINT) AS trade_id, {r('trade_return', 'trade_return')}, {r('pnl', 'pnl')}, bars, start_ts, end_ts FROM tr""")
def trades(spark, sf):
    t = BT.trades(BT.pieces(positions_1h(spark, sf), RULE), RULE)
    return show(t, [*RULE, "trade_id", "bars", "start_ts", "end_ts"], ["trade_return", "pnl"])


@query("trade_samples", f"""{BOLL_1H}, md AS (SELECT symbol, rule_id, quantile_cont(pnl, 0.5) AS mid FROM tr GROUP BY ALL),
x AS (SELECT tr.*, abs(pnl - mid) AS off FROM tr JOIN md USING (symbol, rule_id)),
y AS (SELECT *, row_number() OVER (PARTITION BY symbol, rule_id ORDER BY pnl, trade_id) AS a,
 row_number() OVER (PARTITION BY symbol, rule_id ORDER BY off, pnl, trade_id) AS b, row_number() OVER (PARTITION BY symbol, rule_id ORDER BY pnl DESC, trade_id DESC) AS c FROM x)
SELECT symbol, rule_id, type, CAST(trade_id AS BIGINT) AS trade_id, start_ts, end_ts, {r('pnl', 'pnl')}, bars FROM (
 SELECT *, 'worst_trade' AS type FROM y WHERE a = 1 UNION ALL SELECT *, 'median_trade' FROM y WHERE b = 1 UNION ALL SELECT *, 'best_trade' FROM y WHERE c = 1)""")
def trade_samples(spark, sf):
    t = BT.trades(BT.pieces(positions_1h(spark, sf), RULE), RULE)
    return show(BT.trade_samples(t, RULE), [*RULE, "type", "trade_id", "start_ts", "end_ts", "bars"], ["pnl"])


METRICS_SQL = f"""{r(slog_sql('total_return'), 'total_return_log')}, {r(slog_sql('net_return'), 'net_return_log')}, {r('max_drawdown', 'max_drawdown')},
 {r('win_rate', 'win_rate')}, trades, {r('sharpe', 'sharpe', 5)}, {r('trade_sharpe', 'trade_sharpe', 5)}"""


def metrics_out(m, keys):
    return m.select(
        *keys, F.round(slog(F.col("total_return")), 6).alias("total_return_log"), F.round(slog(F.col("net_return")), 6).alias("net_return_log"),
        F.round("max_drawdown", 6).alias("max_drawdown"), F.round("win_rate", 6).alias("win_rate"), "trades",
        F.round("sharpe", 5).alias("sharpe"), F.round("trade_sharpe", 5).alias("trade_sharpe"),
    )


@query("rule_metrics", f"{BOLL_1H} SELECT symbol, rule_id, {METRICS_SQL} FROM mt")
def rule_metrics(spark, sf):
    return metrics_out(BT.rule_metrics(signals_1h(spark, sf), RULE), RULE)


@query("inverse_metrics", f"""WITH {numbered_sql(BARS_1H)}, {bollinger_rows_sql()},
inv AS (SELECT symbol, ts, i, close, ret, rule_id, exit AS entry, entry AS exit FROM sig), {backtest_sql(src='inv')} SELECT symbol, rule_id, {METRICS_SQL} FROM mt""")
def inverse_metrics(spark, sf):
    return metrics_out(BT.rule_metrics(R.inverse(signals_1h(spark, sf)), RULE), RULE)


@query("signal_frequency", f"""WITH {numbered_sql(BARS_1H)}, {bollinger_rows_sql()}, e AS (SELECT *, hour(ts) AS h FROM sig WHERE entry)
SELECT symbol, rule_id, count(*) AS total_entries, count(*) FILTER (isodow(ts) < 6) AS weekday_entries, count(*) FILTER (isodow(ts) >= 6) AS weekend_entries,
 count(*) FILTER (h < 8) AS asia_00_08, count(*) FILTER (h BETWEEN 8 AND 15) AS europe_08_16, count(*) FILTER (h >= 16) AS us_16_24,
 [{', '.join(f'count(*) FILTER (h = {k})' for k in range(24))}] AS hourly_entries FROM e GROUP BY 1, 2""")
def signal_frequency(spark, sf):
    return BT.signal_frequency(signals_1h(spark, sf), RULE)


def _audit_sql() -> str:
    """Both price paths through the same rules, and a rule that reads the next bar."""
    moved = re.sub(r"\b(nb|bb0|bb1|bb2|sig)\b", r"m_\1", numbered_sql("@").removeprefix("@, ").replace("FROM bars", "FROM m_bars") + ", " + bollinger_rows_sql())
    cols = ", ".join(f"CASE WHEN late THEN {c} * 1.03::DOUBLE ELSE {c} END AS {c}" for c in ("open", "high", "low", "close"))
    leak = lambda src: f"SELECT symbol, i, coalesce(lead(close) OVER w > close, false) AS entry, coalesce(lead(close) OVER w < close, false) AS exit FROM {src} WINDOW w AS (PARTITION BY symbol ORDER BY i)"
    sums = "count(*) AS checked, count(*) FILTER (a.entry <> b.entry OR a.exit <> b.exit) AS changed"
    return f"""WITH {numbered_sql(BARS_1H)}, {bollinger_rows_sql()},
m_bars AS (SELECT symbol, ts, volume, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 >= floor(count(*) OVER (PARTITION BY symbol) * 0.7::DOUBLE) AS late FROM bars)),
{moved}, lim AS (SELECT symbol, floor(count(*) * 0.7::DOUBLE) AS cut FROM bars GROUP BY 1), l0 AS ({leak('nb')}), l1 AS ({leak('m_nb')})
SELECT symbol, 'bollinger' AS family, {sums} FROM sig a JOIN m_sig b USING (symbol, rule_id, i) JOIN lim USING (symbol) WHERE i - 1 < cut GROUP BY 1
UNION ALL SELECT symbol, 'next_bar', {sums} FROM l0 a JOIN l1 b USING (symbol, i) JOIN lim USING (symbol) WHERE i - 1 < cut GROUP BY 1"""


def next_bar_inputs(bars, family, keys, rows):
    """A state that leaks: close and the close of the bar after."""
    out = by_blocks(bars, keys, lambda df, w: df.withColumn("_x", F.array("close", F.coalesce(F.lead("close").over(w), F.lit(float("nan"))))), 0, 1, rows)
    return out.select(*keys, "ts", "pos", "_x")


def next_bar_signals(x, rules):
    yield [0], (x[:, 1] > x[:, 0])[None, :], (x[:, 1] < x[:, 0])[None, :]


@query("lookahead_audit", _audit_sql())
def lookahead_audit(spark, sf):
    """Signals before a change of later prices: of the Bollinger rules, and of a rule that looks ahead."""
    bars = stage(hourly(spark, sf), "audit-bars")
    good = S.lookahead_audit(bars, "bollinger").withColumn("family", F.lit("bollinger"))
    bad = S.lookahead_audit(bars, "", rules=[R.Rule("next_bar", "next_bar", ())], inputs=next_bar_inputs, signals=next_bar_signals).withColumn("family", F.lit("next_bar"))
    return good.unionByName(bad).select("symbol", "family", "checked", "changed")


# --- sweep over look-back windows -------------------------------------------------------------

WINDOWS_SQL = """win AS (SELECT * FROM (SELECT symbol, win AS "window", min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS window_bars,
  arg_max(close, ts) / arg_min(close, ts) - 1 AS hold_return,
  least(greatest(round_even(100::DOUBLE * greatest(1, floor(epoch(max(ts) - min(ts)) / 86400)) / 365.25::DOUBLE, 0), 15), 300)::INT AS trade_floor
 FROM bars JOIN (SELECT symbol, max(ts) AS mx FROM bars GROUP BY 1) USING (symbol) CROSS JOIN (VALUES ('all', 100000), ('360d', 360), ('90d', 90), ('30d', 30)) v(win, days)
 WHERE ts >= mx - to_days(days) GROUP BY 1, 2) WHERE window_bars >= 20)"""
SET = 'symbol, family, gate, "window", side'
# From window signals `ws` to scored candidates `sc`.
SCORING_SQL = f"""{backtest_sql(SET + ', rule_id, rule_key', 'ws')},
ca0 AS (SELECT mt.*, hold_return, trade_floor, net_return - hold_return AS alpha, net_return >= hold_return AS beats_hold, abs(least(max_drawdown, 0)) AS loss FROM mt JOIN win USING (symbol, "window")),
ca1 AS (SELECT *, least(1, 0.75::DOUBLE * least(1, len(regexp_extract_all(rule_id, '=')) / 8.0::DOUBLE) + 0.25::DOUBLE * least(1, greatest(0, (length(rule_key) - 8) / 24.0::DOUBLE))) AS complexity,
 least(1, greatest(0, 1 - (0.8::DOUBLE * least(1, trades / greatest(trade_floor, 1)) + 0.1::DOUBLE * least(1, greatest(0, (win_rate - 0.35::DOUBLE) / 0.35::DOUBLE))
  + 0.1::DOUBLE * least(1, greatest(0, 1 - loss / 0.45::DOUBLE))) + 0.15::DOUBLE * least(1, len(regexp_extract_all(rule_id, '=')) / 10.0::DOUBLE))) AS credibility_penalty FROM ca0),
ca AS (SELECT *, least(1, 0.7::DOUBLE * loss / 0.35::DOUBLE + 0.3::DOUBLE * credibility_penalty) AS stability_penalty FROM ca1),
td AS (SELECT *, greatest(total_return - net_return, 0) AS cost FROM ca WHERE trades > 0),
nm AS (SELECT *, {', '.join(f"CASE WHEN abs(max({e}) OVER s - min({e}) OVER s) < 1e-12 THEN 0.5 ELSE ({e} - min({e}) OVER s) / (max({e}) OVER s - min({e}) OVER s) END AS n_{n}" for n, e in [('net', 'net_return'), ('alpha', 'alpha'), ('depth', 'abs(max_drawdown)'), ('win', 'win_rate'), ('cost', 'cost'), ('cx', 'complexity')])}
 FROM td WINDOW s AS (PARTITION BY {SET})),
sc0 AS (SELECT *, 0.7::DOUBLE * n_alpha + 0.3::DOUBLE * n_net AS edge_quality, 0.65::DOUBLE * (1 - n_depth) + 0.35::DOUBLE * n_win AS stability_quality, 1 - n_cost AS friction_quality, 1 - credibility_penalty AS credibility_quality FROM nm),
sc1 AS (SELECT *, 0.35::DOUBLE * edge_quality + 0.25::DOUBLE * stability_quality + 0.2::DOUBLE * friction_quality + 0.2::DOUBLE * credibility_quality - 0.05::DOUBLE * n_cx - 0.05::DOUBLE * stability_penalty AS score FROM sc0),
sc AS (SELECT *, row_number() OVER (PARTITION BY {SET} ORDER BY beats_hold DESC, round(score, 9) DESC, rule_id) AS rank FROM sc1)"""
SWEEP_SQL = f"""RECURSIVE {numbered_sql(BARS_1D)}, {ema_rows_sql()}, {WINDOWS_SQL},
ws0 AS (SELECT sig.*, 'ema_cross' AS family, 'ungated' AS gate, win."window", split_part(rule_id, ':', 2) AS rule_key FROM sig JOIN win ON win.symbol = sig.symbol AND sig.ts >= win.start_ts),
ws AS (SELECT *, 'long' AS side FROM ws0 UNION ALL SELECT * REPLACE (exit AS entry, entry AS exit), 'inverse' AS side FROM ws0),
{SCORING_SQL}"""


def daily_candidates(spark, sf):
    """The candidate table of the daily sweep."""
    return S.indicator_sweep(daily(spark, sf), ["ema_cross"], "1d", inverse=True, min_bars=20)


@query("window_table", f"""WITH {BARS_1D}, {WINDOWS_SQL} SELECT symbol, "window", start_ts, end_ts, window_bars, {r('hold_return', 'hold_return')}, trade_floor FROM win""")
def window_table(spark, sf):
    return show(S.window_table(daily(spark, sf), min_bars=20), ["symbol", "window", "start_ts", "end_ts", "window_bars", "trade_floor"], ["hold_return"])


@query("candidate_scores", f"""WITH {SWEEP_SQL} SELECT symbol, "window", side, rule_id, trades, {r('credibility_penalty', 'credibility_penalty')}, {r('stability_penalty', 'stability_penalty')},
 {r('complexity', 'complexity')}, {r('edge_quality', 'edge_quality')}, {r('score', 'score')}, beats_hold, rank FROM sc""")
def candidate_scores(spark, sf):
    out = S.score(daily_candidates(spark, sf))
    return show(out, ["symbol", "window", "side", "rule_id", "trades", "beats_hold", "rank"], ["credibility_penalty", "stability_penalty", "complexity", "edge_quality", "score"])


@query("top_candidates", f"""WITH {SWEEP_SQL} SELECT symbol, "window", side, rule_id, {r(slog_sql('alpha'), 'alpha_log')}, {r('score', 'score')}, rank FROM sc WHERE rank <= 5""")
def top_candidates(spark, sf):
    """Best five per set."""
    out = S.score(daily_candidates(spark, sf)).where("rank <= 5")
    return show(out.withColumn("alpha_log", slog(F.col("alpha"))), ["symbol", "window", "side", "rule_id", "rank"], ["alpha_log", "score"])


@query("rejections", f"""WITH {SWEEP_SQL},
mk AS (SELECT *, trades <= 0 OR credibility_penalty >= 0.65::DOUBLE AS a, trades > 0 AND NOT beats_hold AS b, trades > 0 AND max_drawdown < -0.35::DOUBLE AS c FROM ca),
ex AS (SELECT {SET}, rule_id, alpha, 0 AS kind, 'low_credibility' AS reason FROM mk WHERE a UNION ALL SELECT {SET}, rule_id, alpha, 1, 'underperform_spot' FROM mk WHERE b
 UNION ALL SELECT {SET}, rule_id, alpha, 2, 'high_drawdown' FROM mk WHERE c),
rx AS (SELECT *, row_number() OVER (PARTITION BY {SET} ORDER BY round(alpha, 9), rule_id, kind) AS rn FROM ex),
wx AS (SELECT {SET}, string_agg(rule_id || '|' || reason, ';' ORDER BY rn) AS worst FROM rx WHERE rn <= 3 GROUP BY ALL)
SELECT mk.symbol, mk."window", mk.side, count(*) AS total_candidates, count(*) FILTER (a) AS low_credibility, count(*) FILTER (b) AS underperform_spot, count(*) FILTER (c) AS high_drawdown,
 greatest(count(*) - count(*) FILTER (a) - count(*) FILTER (b) - count(*) FILTER (c), 0) AS kept, any_value(worst) AS worst
FROM mk LEFT JOIN wx USING ({SET}) GROUP BY 1, 2, 3""")
def rejections(spark, sf):
    out = S.rejections(daily_candidates(spark, sf))
    return out.select("symbol", "window", "side", "total_candidates", "low_credibility", "underperform_spot", "high_drawdown", "kept",
                      F.array_join("worst_examples", ";").alias("worst"))


@query("full_sweep")
def full_sweep(spark, sf, timeframes=("15m", "1h")):
    """All rules of eight indicator families and six feature cores, ungated and gated by the fixed
    fusion, long and inverse, in every look-back window of each timeframe: best five per set."""
    from barloom.catalog.q_features import features_of, sweep_inputs

    feats, minute = features_of(spark, sf)
    feats, cands = stage(feats, "features"), None
    for t in timeframes:
        bars, aligned, fusion = sweep_inputs(feats, minute, t)
        part = S.indicator_sweep(bars, list(R.GRIDS), t, gate=fusion, inverse=True, features=aligned, cores=sorted({c.core for c in R.CORE_RULES.values()}))
        part = part.withColumn("timeframe", F.lit(t))
        cands = part if cands is None else cands.unionByName(part)
    out = S.score(cands, [*S.SET_KEYS, "timeframe"]).where("rank <= 5")
    return out.select("symbol", "timeframe", "family", "gate", "window", "side", "rule_id", "trades", F.round("score", 6).alias("score"), "rank")
