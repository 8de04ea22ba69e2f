"""Validation of the daily EMA-cross winners."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import query
from barloom.catalog.common import daily, r, show
from barloom.catalog.q_backtest import SET, SWEEP_SQL, backtest_sql, daily_candidates, slog, slog_sql
from barloom.operators.series import by_blocks, time_segment
from barloom.plans import features as FT
from barloom.plans import metalabel as M
from barloom.plans import rules as R
from barloom.plans import sweep as S
from barloom.plans import validate as V
from barloom.session import stage

KEYS = [*S.SET_KEYS, "rule_id"]
STEP, SPLITS, FOLDS, PURGE = 2, 4, 4, 5
KEYSQL = SET + ", rule_id"

# --- SQL: winners, sampled rows, folds --------------------------------------------------------

WINNERS_SQL = f"""{SWEEP_SQL}, wn AS (SELECT * FROM sc WHERE side = 'long' AND rank = 1),
sm0 AS (SELECT ws.symbol, ws.family, ws.gate, ws."window", ws.side, ws.rule_id, ts, close, entry, exit,
  row_number() OVER (PARTITION BY {', '.join('ws.' + k.strip() for k in SET.split(','))}, ws.rule_id ORDER BY ts) - 1 AS p,
  count(*) OVER (PARTITION BY {', '.join('ws.' + k.strip() for k in SET.split(','))}, ws.rule_id) AS nb
 FROM ws JOIN wn ON ws.symbol = wn.symbol AND ws."window" = wn."window" AND ws.side = wn.side AND ws.rule_id = wn.rule_id),
sm AS (SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY {KEYSQL}) AS n, close / lag(close) OVER w - 1 AS ret
 FROM sm0 WHERE p % {STEP} = 0 OR p = nb - 1 WINDOW w AS (PARTITION BY {KEYSQL} ORDER BY ts))"""


def _prefixed(sql: str, tag: str) -> str:
    """The backtest CTEs under other names, so that several can stand in one statement."""
    import re

    return re.sub(r"\b(p0|p1|rt|cv0|cv|tr|m1|m2|m3|mt)\b", lambda m: f"{tag}_{m.group(1)}", sql)


def folds_sql(tag: str, k: int, purge: int) -> str:
    """CTE `{tag}_alpha(keys, fold, alpha, ...)`."""
    bt = _prefixed(backtest_sql(KEYSQL + ", fold", f"{tag}_rows"), tag)
    return f"""{tag}_rows AS (SELECT * FROM (SELECT *, ((idx + 1) * {k} - 1) // n AS fold FROM sm)
 WHERE idx >= fold * n // {k} + {purge} AND idx < (fold + 1) * n // {k} - {purge} AND ((fold + 1) * n // {k} - {purge}) - (fold * n // {k} + {purge}) >= 20),
{bt}, {tag}_hold AS (SELECT {KEYSQL}, fold, arg_max(close, ts) / arg_min(close, ts) - 1 AS hold_return, count(*) AS fold_rows FROM {tag}_rows GROUP BY ALL),
{tag}_alpha AS (SELECT m.*, hold_return, fold_rows, net_return - hold_return AS alpha FROM {tag}_mt m JOIN {tag}_hold h USING ({KEYSQL}, fold))"""


WF_SQL, CV_SQL = folds_sql("wf", SPLITS, 0), folds_sql("xv", FOLDS, PURGE)


def winners(spark, sf):
    c = daily_candidates(spark, sf)
    return c, stage(S.score(c).where("side = 'long' AND rank = 1"), "winners")


def sampled_signals(spark, sf, won):
    """Signal rows of the winners only, thinned to every STEP-th bar of their window."""
    bars = stage(daily(spark, sf), "daily-bars")
    windows = S.window_table(bars, min_bars=20)
    rows = V.sampled_windows(bars, windows, STEP).drop("ts")
    sig = R.indicator_signals(bars, "ema_cross").select("symbol", "ts", "pos", "rule_id", "entry", "exit")
    picked = sig.join(won.select(*KEYS), ["symbol", "rule_id"])
    out = picked.join(rows, ["symbol", "window", "pos"])
    return out.withColumn("seg", time_segment(86_400 * S.SEGMENT_ROWS))


def prepared(spark, sf):
    cands, won = winners(spark, sf)
    return cands, won, stage(sampled_signals(spark, sf, won), "winner-signals")


def _folds(alphas):
    return alphas.select("symbol", "window", "rule_id", "fold", "fold_rows", "trades", F.round("hold_return", 6).alias("hold_return"), F.round(slog(F.col("alpha")), 6).alias("alpha_log"))


_FOLD_COLS = f"""symbol, "window", rule_id, fold::BIGINT AS fold, fold_rows, trades, {r('hold_return', 'hold_return')}, {r(slog_sql('alpha'), 'alpha_log')}"""


@query("walk_forward", f"WITH {WINNERS_SQL}, {WF_SQL} SELECT {_FOLD_COLS} FROM wf_alpha")
def walk_forward(spark, sf):
    return _folds(V.fold_alphas(prepared(spark, sf)[2], KEYS, SPLITS))


@query("purged_folds", f"WITH {WINNERS_SQL}, {CV_SQL} SELECT {_FOLD_COLS} FROM xv_alpha")
def purged_folds(spark, sf):
    return _folds(V.fold_alphas(prepared(spark, sf)[2], KEYS, FOLDS, PURGE))


_FR = ", ".join(_prefixed(backtest_sql(KEYSQL, "sm", str(b)), f"f{b}") for b in V.STRESS_BPS)
FRICTION_SQL = f"""{_FR}, fr AS (SELECT a.symbol, a."window", a.rule_id, a.net_return AS n1, b.net_return AS n2, c.net_return AS n3,
 CASE WHEN abs(a.net_return) < 1e-9 THEN CASE WHEN c.net_return >= a.net_return THEN 1 ELSE greatest(0, 1 - abs(c.net_return - a.net_return) / 0.1::DOUBLE) END
  ELSE greatest(0, least(1, 1 - greatest(0, a.net_return - c.net_return) / abs(a.net_return))) END AS friction
 FROM f10_mt a JOIN f20_mt b USING ({KEYSQL}) JOIN f30_mt c USING ({KEYSQL}))"""


@query("friction_stress", f"""WITH {WINNERS_SQL}, {FRICTION_SQL} SELECT symbol, "window", rule_id, {r('friction', 'friction')}, {r(slog_sql('n1'), 'n1')}, {r(slog_sql('n2'), 'n2')}, {r(slog_sql('n3'), 'n3')} FROM fr""")
def friction_stress(spark, sf):
    out = V.friction_stress(prepared(spark, sf)[2], KEYS)
    return out.select("symbol", "window", "rule_id", F.round("friction", 6).alias("friction"), *[F.round(slog(F.get("net_by_bps", F.lit(i))), 6).alias(f"n{i + 1}") for i in range(3)])


def _cap(e: str) -> str:
    return f"least(1, greatest(0, {e}))"


PACK_SQL = f"""vp AS (SELECT *, {_cap("0.4::DOUBLE * wf_pass_rate + 0.35::DOUBLE * cv_pass_rate + 0.25::DOUBLE * ((greatest(-1, least(1, (wf_alpha_median + cv_alpha_median) / 2 / 0.1::DOUBLE)) + 1) / 2)")} AS transferability,
 {_cap("0.4::DOUBLE * least(1, trades / greatest(trade_floor, 1)) + 0.25::DOUBLE * (1 - pbo) + 0.2::DOUBLE * " + _cap('(dsr + 1) / 2') + " + 0.15::DOUBLE * " + _cap('1 - abs(least(max_drawdown, 0)) / 0.35::DOUBLE'))} AS credibility FROM vi),
vq AS (SELECT *, {_cap("0.4::DOUBLE * transferability + 0.3::DOUBLE * credibility + 0.2::DOUBLE * friction - 0.1::DOUBLE * cpen")} AS final_score FROM vp)"""


def reasons_sql(strictness: str) -> str:
    wf, cv, pbo, dsr, fr, fin = V.STRICTNESS[strictness]
    tests = [f"wf_pass_rate < {wf}", f"cv_pass_rate < {cv}", f"pbo > {pbo}", f"dsr < {dsr}", f"friction < {fr}", f"final_score < {fin}"]
    names = ["walk_forward", "purged_cv", "pbo", "dsr", "friction", "final_score"]
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {t}::DOUBLE THEN '{n}' END" for t, n in zip(tests, names)) + ")"


_CPEN = "least(1, 0.7::DOUBLE * 0.25::DOUBLE + 0.2::DOUBLE * least(1, greatest(0, (length(rule_key) - 8) / 24.0::DOUBLE)) + 0.1::DOUBLE * 0.35::DOUBLE)"
VALID_SQL = f"""{WINNERS_SQL}, {WF_SQL}, {CV_SQL}, {FRICTION_SQL}, {_prefixed(backtest_sql(KEYSQL, 'sm'), 'ev')},
wfs AS (SELECT symbol, "window", avg((alpha >= 0)::INT) AS wf_pass_rate, quantile_cont(alpha, 0.5) AS wf_alpha_median FROM wf_alpha GROUP BY ALL),
cvs AS (SELECT symbol, "window", avg((alpha >= 0)::INT) AS cv_pass_rate, quantile_cont(alpha, 0.5) AS cv_alpha_median FROM xv_alpha GROUP BY ALL),
pb AS (SELECT symbol, "window", avg((alpha <= 0)::INT) AS pbo FROM (SELECT symbol, "window", alpha FROM wf_alpha UNION ALL SELECT symbol, "window", alpha FROM xv_alpha) GROUP BY ALL),
tn AS (SELECT symbol, "window", count(*) AS trials FROM ca WHERE side = 'long' GROUP BY ALL),
vi AS (SELECT wn.symbol, wn.gate, wn."window", wn.family, wn.rule_id, wn.rule_key, wn.trades, wn.trade_floor, wn.max_drawdown, wn.alpha,
 coalesce(wf_pass_rate, 0) AS wf_pass_rate, coalesce(wf_alpha_median, 0) AS wf_alpha_median, coalesce(cv_pass_rate, 0) AS cv_pass_rate, coalesce(cv_alpha_median, 0) AS cv_alpha_median,
 coalesce(pbo, 1) AS pbo, coalesce(friction, 0) AS friction, ev_mt.trade_sharpe - sqrt(2 * ln(greatest(2, trials)) / greatest(1, wn.trades)) AS dsr, {_CPEN} AS cpen
 FROM wn JOIN ev_mt ON ev_mt.symbol = wn.symbol AND ev_mt."window" = wn."window" LEFT JOIN wfs ON wfs.symbol = wn.symbol AND wfs."window" = wn."window"
 LEFT JOIN cvs ON cvs.symbol = wn.symbol AND cvs."window" = wn."window" LEFT JOIN pb ON pb.symbol = wn.symbol AND pb."window" = wn."window"
 LEFT JOIN fr ON fr.symbol = wn.symbol AND fr."window" = wn."window" LEFT JOIN tn ON tn.symbol = wn.symbol AND tn."window" = wn."window"),
{PACK_SQL}"""
_VCOLS = ["wf_pass_rate", "cv_pass_rate", "pbo", "dsr", "friction", "transferability", "credibility", "final_score"]


def validated(spark, sf, strictness="recovery"):
    cands, won, sig = prepared(spark, sf)
    trials = cands.where("side = 'long'").groupBy("symbol", "window").agg(F.count("*").alias("trials"))
    return V.validation_rows(won, sig, KEYS, trials, strictness, SPLITS, FOLDS, PURGE)


@query("validation_rows", f"""WITH {VALID_SQL} SELECT symbol, "window", rule_id, {', '.join(r(c, c) for c in _VCOLS)}, {reasons_sql('recovery')} AS failed FROM vq""")
def validation_rows(spark, sf):
    out = validated(spark, sf).withColumn("failed", F.array_join("failed_reasons", ","))
    return show(out, ["symbol", "window", "rule_id", "failed"], _VCOLS)


FILTER = M.FilterConfig(horizon=12, take=0.5, stop=0.5, min_events=20, gap=12, floor=0.35, grid=(0.30, 0.95, 0.05), allowlist=(FT.TENSION, FT.VOL60), cap=3)


def winner_rows(spark, sf):
    """Every bar of the winners' windows with their signals and the base features of the bar."""
    cands, won = winners(spark, sf)
    bars = stage(daily(spark, sf), "daily-bars")
    ret = by_blocks(bars, ["symbol"], lambda df, w: df.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1.0), 1)
    base = ret.join(FT.base_features(bars).drop("pos"), ["symbol", "ts"])
    span = S.window_table(bars, min_bars=20).select("symbol", "window", "start_ts", "window_bars")
    start = bars.join(span.withColumnRenamed("start_ts", "ts"), ["symbol", "ts"]).select("symbol", "window", F.col("pos").alias("_p0"), F.col("window_bars").alias("n"))
    sig = R.indicator_signals(bars, "ema_cross").select("symbol", "pos", "rule_id", "entry", "exit")
    picked = sig.join(won.select(*KEYS), ["symbol", "rule_id"]).join(start, ["symbol", "window"]).where("pos >= _p0")
    rows = picked.join(base, ["symbol", "pos"]).withColumn("pos", F.col("pos") - F.col("_p0")).withColumn("seg", time_segment(86_400 * S.SEGMENT_ROWS))
    trials = cands.where("side = 'long'").groupBy("symbol", "window").agg(F.count("*").alias("trials"))
    return won, rows.select(*KEYS, "ts", "seg", "pos", "n", "high", "low", "close", "ret", "entry", "exit", *FT.BASE_FEATURES), trials


@query("validation_filtered")
def validation_filtered(spark, sf):
    """Full validation of the winners on the entries that each one's own filter keeps."""
    won, rows, trials = winner_rows(spark, sf)
    out = V.filtered_validation(won, rows, FT.BASE_FEATURES, KEYS, trials, FILTER, STEP, "recovery", SPLITS, FOLDS, PURGE)
    out = out.withColumn("failed", F.array_join("failed_reasons", ","))
    return show(out, ["symbol", "window", "rule_id", "events", "entries_raw", "entries_kept", "trades", "veto_all", "reason", "failed", "passes"], [*_VCOLS, "threshold", "max_drawdown"])


# --- light validation of every candidate: the input of summaries and the deploy pool ----------

LIGHT_SQL = f"""{SWEEP_SQL}, vi AS (SELECT *, (alpha >= 0)::INT::DOUBLE AS wf_pass_rate, (alpha >= 0)::INT::DOUBLE AS cv_pass_rate, alpha AS wf_alpha_median, alpha AS cv_alpha_median,
 1 - (alpha >= 0)::INT::DOUBLE AS pbo, trade_sharpe AS dsr, 1::DOUBLE AS friction, {_CPEN} AS cpen FROM sc), {PACK_SQL},
lv AS (SELECT * EXCLUDE (gate), CASE WHEN side = 'long' THEN 'gated' ELSE 'ungated' END AS gate, {reasons_sql('recovery')} AS failed, {reasons_sql('recovery')} = '' AS passes FROM vq)"""


def light(spark, sf):
    """Both sides of the sweep, the long side standing for gated runs."""
    scored = S.score(daily_candidates(spark, sf))
    out = V.light_validation(scored, "recovery")
    return out.withColumn("gate", F.when(F.col("side") == "long", "gated").otherwise("ungated"))


@query("light_validation", f"""WITH {LIGHT_SQL} SELECT symbol, "window", side, rule_id, {r('transferability', 'transferability')}, {r('credibility', 'credibility')}, {r('final_score', 'final_score')}, failed, passes FROM lv""")
def light_validation(spark, sf):
    out = light(spark, sf).withColumn("failed", F.array_join("failed_reasons", ","))
    return show(out, ["symbol", "window", "side", "rule_id", "failed", "passes"], ["transferability", "credibility", "final_score"])


@query("validation_summaries", f"""WITH {LIGHT_SQL}, u AS (SELECT 'gate' AS dimension, gate AS value, * FROM lv UNION ALL SELECT 'window', "window", * FROM lv)
SELECT dimension, value, count(*) AS total, count(*) FILTER (passes) AS passed, {r('avg(passes::INT)', 'pass_rate')}, {r('avg(final_score)', 'avg_final_score')} FROM u GROUP BY 1, 2""")
def validation_summaries(spark, sf):
    return show(V.summaries(light(spark, sf)), ["dimension", "value", "total", "passed"], ["pass_rate", "avg_final_score"])


POOL_SQL = f"""{LIGHT_SQL}, d1 AS (SELECT *, row_number() OVER (PARTITION BY symbol, family, rule_id, gate ORDER BY round(final_score, 9) DESC, "window") AS rn FROM lv WHERE passes AND alpha >= 0),
d2 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY (gate = 'gated') DESC, list_position(['all', '360d', '90d', '30d'], "window"), round(final_score, 9) DESC, rule_id) AS rk FROM d1 WHERE rn = 1),
d3 AS (SELECT *, row_number() OVER (PARTITION BY symbol, family, "window" ORDER BY rk) = 1 AS fst FROM d2),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fst DESC, rk) AS deploy_rank FROM d3) WHERE deploy_rank <= 2)"""


@query("deploy_pool", f"""WITH {POOL_SQL} SELECT symbol, "window", gate, rule_id, {r('final_score', 'final_score')}, deploy_rank FROM pool""")
def deploy_pool(spark, sf):
    return show(V.deploy_pool(light(spark, sf)), ["symbol", "window", "gate", "rule_id", "deploy_rank"], ["final_score"])


@query("failure_counts", f"WITH {LIGHT_SQL} SELECT reason, count(*) AS rows FROM (SELECT unnest(string_split(failed, ',')) AS reason FROM lv WHERE failed <> '') GROUP BY 1")
def failure_counts(spark, sf):
    return V.failure_counts(light(spark, sf))


@query("trades_by_window", f"""WITH {LIGHT_SQL} SELECT "window", count(*) AS rows, sum(trades)::BIGINT AS trades_total, {r('avg(trades)', 'trades_avg')} FROM lv GROUP BY 1""")
def trades_by_window(spark, sf):
    return show(V.trades_by_window(light(spark, sf)), ["window", "rows", "trades_total"], ["trades_avg"])


@query("validation_top", f"""WITH {LIGHT_SQL} (SELECT 'score' AS board, symbol, "window", gate, rule_id, {r('final_score', 'final_score')} FROM lv ORDER BY round(lv.final_score, 9) DESC, symbol, "window", rule_id LIMIT 8)
UNION ALL (SELECT 'alpha', symbol, "window", gate, rule_id, {r('final_score', 'final_score')} FROM lv ORDER BY round(alpha, 9) DESC, symbol, "window", rule_id LIMIT 8)""")
def validation_top(spark, sf):
    rows = stage(light(spark, sf), "light")
    cols = ["symbol", "window", "gate", "rule_id"]
    a = show(V.top_rows(rows, "final_score"), cols, ["final_score"]).withColumn("board", F.lit("score"))
    b = show(V.top_rows(rows, "alpha"), cols, ["final_score"]).withColumn("board", F.lit("alpha"))
    return a.unionByName(b)


@query("deploy_readiness", f"""WITH {POOL_SQL} SELECT (SELECT count(*) FROM lv) AS candidates_total, (SELECT count(*) FROM lv WHERE passes) AS candidates_passed,
 count(DISTINCT symbol) AS deploy_symbols, count(*) AS deploy_rules, (SELECT count(*) FROM lv WHERE passes) > 0 AND count(*) > 0 AS deploy_ready FROM pool""")
def deploy_readiness(spark, sf):
    rows = stage(light(spark, sf), "light")
    return V.readiness(rows, V.deploy_pool(rows))


@query("filtered_results", f"""WITH {LIGHT_SQL} SELECT symbol, "window", rule_id, {r('final_score', 'final_score')} FROM (SELECT * FROM lv WHERE gate = 'gated' ORDER BY final_score DESC, symbol, "window", rule_id LIMIT 25)""")
def filtered_results(spark, sf):
    return show(V.filter_results(light(spark, sf), ["gated"], 25), ["symbol", "window", "rule_id"], ["final_score"])


@query("meta_vetoed_rows", f"""WITH {LIGHT_SQL}, ve AS (SELECT DISTINCT symbol, "window", rule_id FROM lv WHERE trades < 20)
SELECT lv.symbol, lv."window", side, lv.rule_id, passes AND ve.symbol IS NULL AS passes, CASE WHEN ve.symbol IS NOT NULL THEN concat_ws(',', nullif(failed, ''), 'meta_precision_floor') ELSE failed END AS failed
FROM lv LEFT JOIN ve ON ve.symbol = lv.symbol AND ve."window" = lv."window" AND ve.rule_id = lv.rule_id""")
def meta_vetoed_rows(spark, sf):
    """Rules with few trades stand for rules whose filter found no threshold."""
    rows = stage(light(spark, sf), "light")
    keys = ["symbol", "window", "rule_id"]
    meta = rows.where("trades < 20").select(*keys).distinct().withColumn("veto_all", F.lit(True))
    out = V.with_meta_veto(rows, meta, keys)
    return out.select("symbol", "window", "side", "rule_id", "passes", F.array_join("failed_reasons", ",").alias("failed"))
