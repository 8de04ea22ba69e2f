"""Report tables and run-history analytics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.catalog import query
from barloom.catalog.common import daily, event_bars_sql, r, show
from barloom.catalog.q_backtest import SWEEP_SQL, daily_candidates, slog, slog_sql
from barloom.plans import reports as P
from barloom.plans import runs as H
from barloom.plans import sweep as S
from barloom.session import stage, staging_dir
from barloom.sources import artifacts
from barloom.sources.tables import table

# Each fast span of the EMA cross plays a core; the two sides play the gates.
RESULTS_SQL = f"""{SWEEP_SQL}, sx AS (SELECT * EXCLUDE (gate), split_part(rule_id, ':', 3) AS core, CASE WHEN side = 'long' THEN 'gated' ELSE 'ungated' END AS gate FROM sc),
wr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, core, gate, "window" ORDER BY beats_hold DESC, round(score, 9) DESC, rule_id) AS rn,
 min(credibility_penalty) OVER (PARTITION BY symbol, core, gate, "window") > 0.8::DOUBLE AS insufficient FROM sx) WHERE rn = 1)"""
CELL = ["symbol", "core", "window"]


def scored(spark, sf):
    out = S.score(daily_candidates(spark, sf))
    return out.withColumns({"gate": F.when(F.col("side") == "long", "gated").otherwise("ungated"), "core": F.split_part("rule_id", F.lit(":"), F.lit(3))})


def results(spark, sf):
    return stage(P.window_results(scored(spark, sf)), "window-results")


@query("grades", f"""WITH {RESULTS_SQL} SELECT symbol, core, gate, "window", CASE WHEN insufficient THEN 'C*' WHEN beats_hold AND alpha >= 0.05 AND max_drawdown >= -0.35 AND trades >= trade_floor THEN 'A'
 WHEN beats_hold AND alpha >= 0 AND trades >= trade_floor THEN 'B' ELSE 'C' END AS grade FROM wr""")
def grades(spark, sf):
    return results(spark, sf).select("symbol", "core", "gate", "window", P.grade().alias("grade"))


@query("leaderboard", f"""WITH {RESULTS_SQL} SELECT symbol, core, gate, "window", rule_id, {r('score', 'score')} FROM (SELECT * FROM wr ORDER BY round(score, 9) DESC, symbol, core, gate, "window" LIMIT 80)""")
def leaderboard(spark, sf):
    return show(P.leaderboard(results(spark, sf), "score"), ["symbol", "core", "gate", "window", "rule_id"], ["score"])


HEALTH_SQL = f"""{RESULTS_SQL}, hb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, gate, "window" ORDER BY round(alpha, 9) DESC, core) AS hr FROM wr) WHERE hr = 1),
hl AS (SELECT gate, "window", count(*) AS observed_total, count(*) FILTER (beats_hold) AS pass_count, count(*) FILTER (insufficient) AS insufficient_count, avg(net_return) AS avg_strategy_return,
 avg(hold_return) AS avg_spot_return, (SELECT count(DISTINCT symbol) FROM bars) AS expected_total FROM hb GROUP BY ALL), he AS (SELECT *, pass_count / expected_total AS pass_rate FROM hl)"""


def health(spark, sf):
    return P.gate_window_health(results(spark, sf), daily(spark, sf).select("symbol"))


@query("gate_window_health", f"""WITH {HEALTH_SQL} SELECT gate, "window", expected_total, observed_total, pass_count, insufficient_count, {r('pass_rate', 'pass_rate')}, {r(slog_sql('avg_strategy_return'), 'avg_return_log', 5)}, {r('avg_spot_return', 'avg_spot_return')} FROM he""")
def gate_window_health(spark, sf):
    out = health(spark, sf)
    return out.select("gate", "window", "expected_total", "observed_total", "pass_count", "insufficient_count", F.round("pass_rate", 6).alias("pass_rate"),
                      F.round(slog(F.col("avg_strategy_return")), 5).alias("avg_return_log"), F.round("avg_spot_return", 6).alias("avg_spot_return"))


@query("gate_delta_by_window", f"""WITH {HEALTH_SQL} SELECT coalesce(a."window", b."window") AS "window", {r('coalesce(a.pass_rate, 0)', 'gated_pass_rate')}, {r('coalesce(b.pass_rate, 0)', 'ungated_pass_rate')},
 {r('coalesce(a.pass_rate, 0) - coalesce(b.pass_rate, 0)', 'delta_pass_rate')} FROM (SELECT * FROM he WHERE gate = 'gated') a FULL JOIN (SELECT * FROM he WHERE gate = 'ungated') b ON a."window" = b."window" """)
def gate_delta_by_window(spark, sf):
    return show(P.gate_delta_by_window(health(spark, sf)), ["window"], ["gated_pass_rate", "ungated_pass_rate", "delta_pass_rate"])


CELLS_SQL = f"""{RESULTS_SQL}, ce AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.core, b.core) AS core, coalesce(a."window", b."window") AS "window", a.symbol IS NOT NULL AS has_gated, b.symbol IS NOT NULL AS has_ungated,
 a.alpha AS ga, b.alpha AS ua, a.beats_hold AS gp, b.beats_hold AS up FROM (SELECT * FROM wr WHERE gate = 'gated') a FULL JOIN (SELECT * FROM wr WHERE gate = 'ungated') b ON a.symbol = b.symbol AND a.core = b.core AND a."window" = b."window")"""


@query("cell_gate_delta", f"""WITH {CELLS_SQL} SELECT symbol, core, "window", has_gated, has_ungated, {r(slog_sql('(coalesce(ga, 0) - coalesce(ua, 0))'), 'delta_log')} FROM ce""")
def cell_gate_delta(spark, sf):
    out = P.cell_gate_delta(results(spark, sf))
    return out.select(*CELL, "has_gated", "has_ungated", F.round(slog(F.col("delta_alpha")), 6).alias("delta_log"))


@query("executive_headline", f"""WITH {HEALTH_SQL} SELECT gate, "window", {r('pass_rate', 'pass_rate')}, insufficient_count, {r(slog_sql('avg_strategy_return'), 'avg_return_log', 5)}, {r('avg_spot_return', 'avg_spot_return')} FROM he WHERE gate = 'gated'""")
def executive_headline(spark, sf):
    out = P.executive_headline(health(spark, sf))
    return out.select("gate", "window", F.round("pass_rate", 6).alias("pass_rate"), "insufficient_count", F.round(slog(F.col("avg_strategy_return")), 5).alias("avg_return_log"), F.round("avg_spot_return", 6).alias("avg_spot_return"))


_SIDES = [(g, c) for g in ("gated", "ungated") for c in ("alpha", "score")]
_SIDES_SQL = ", ".join(r(slog_sql(f"{g}_{c}"), f"{g}_{c}", 5) for g, c in _SIDES) + ", " + ", ".join(r(slog_sql(f"(gated_{c} - ungated_{c})"), f"delta_{c}", 5) for c in ("alpha", "score"))


def _sides(prefix: str = ""):
    return [*[F.round(slog(F.col(f"{prefix}{g}_{c}")), 5).alias(f"{g}_{c}") for g, c in _SIDES], *[F.round(slog(F.col(f"delta_{c}")), 5).alias(f"delta_{c}") for c in ("alpha", "score")]]


@query("core_delta", f"""WITH {RESULTS_SQL}, x AS (SELECT core, {', '.join(f"coalesce(avg({c}) FILTER (gate = '{g}'), 0) AS {g}_{c}" for g, c in _SIDES)},
 count(*) FILTER (gate = 'gated') AS samples_gated, count(*) FILTER (gate = 'ungated') AS samples_ungated FROM wr GROUP BY 1)
SELECT core, samples_gated, samples_ungated, {_SIDES_SQL} FROM x""")
def core_delta(spark, sf):
    return P.core_delta(results(spark, sf)).select("core", "samples_gated", "samples_ungated", *_sides("avg_"))


@query("heatmap_cells", f"""WITH {RESULTS_SQL}, x AS (SELECT symbol, core, "window", {', '.join(f"coalesce(max({c}) FILTER (gate = '{g}'), 0) AS {g}_{c}" for g, c in _SIDES)},
 coalesce(bool_or(beats_hold) FILTER (gate = 'gated'), false) AS gated_beats_hold, coalesce(bool_or(beats_hold) FILTER (gate = 'ungated'), false) AS ungated_beats_hold FROM wr GROUP BY 1, 2, 3)
SELECT symbol, core, "window", gated_beats_hold, ungated_beats_hold, {_SIDES_SQL} FROM x""")
def heatmap_cells(spark, sf):
    return P.heatmap_cells(results(spark, sf)).select(*CELL, "gated_beats_hold", "ungated_beats_hold", *_sides())


_ALL_RATE = """coalesce((SELECT pass_rate FROM he WHERE gate = '{}' AND "window" = 'all'), 0)"""


@query("run_credibility", f"""WITH {HEALTH_SQL}, lo AS (SELECT (count(*) FILTER (trades <= 0 OR credibility_penalty >= 0.65::DOUBLE)) / count(*) AS share FROM ca WHERE side = 'long')
SELECT {r('(SELECT share FROM lo)', 'low_credibility_ratio')}, {r(f"{_ALL_RATE.format('gated')} - {_ALL_RATE.format('ungated')}", 'delta_pass_rate')}""")
def run_credibility(spark, sf):
    """Share of low-credibility candidates of the gated runs, and the gate's gain in pass rate over the whole history."""
    cands = daily_candidates(spark, sf).withColumn("gate", F.when(F.col("side") == "long", "gated").otherwise("ungated"))
    return show(H.run_credibility(cands, P.gate_delta_by_window(health(spark, sf))), [], ["low_credibility_ratio", "delta_pass_rate"])


@query("core_overview", f"""WITH {CELLS_SQL} SELECT core, count(*) AS samples, {r('coalesce(avg(gp::INT), 0)', 'gated_pass_rate')}, {r('coalesce(avg(up::INT), 0)', 'ungated_pass_rate')},
 {r(slog_sql('coalesce(avg(ga), 0)'), 'gated_avg_alpha_log', 5)} FROM ce GROUP BY 1""")
def core_overview(spark, sf):
    out = P.core_overview(P.cell_gate_delta(results(spark, sf)))
    return out.select("core", "samples", F.round("gated_pass_rate", 6).alias("gated_pass_rate"), F.round("ungated_pass_rate", 6).alias("ungated_pass_rate"), F.round(slog(F.col("gated_avg_alpha")), 5).alias("gated_avg_alpha_log"))


@query("rank_shift", f"""WITH {RESULTS_SQL}, rr AS (SELECT *, row_number() OVER (PARTITION BY gate, "window" ORDER BY round(alpha, 9) DESC, symbol, core) AS rk FROM wr)
SELECT a.symbol, a.core, a."window", a.rk AS gated_rank, b.rk AS ungated_rank, b.rk - a.rk AS shift FROM rr a JOIN rr b ON a.symbol = b.symbol AND a.core = b.core AND a."window" = b."window" AND a.gate = 'gated' AND b.gate = 'ungated'""")
def rank_shift(spark, sf):
    return P.rank_shift(results(spark, sf))


@query("gate_dashboard", f"""WITH {HEALTH_SQL} SELECT gate, count(*) AS windows, {r('avg(pass_rate)', 'avg_pass_rate')}, {r('min(pass_rate)', 'min_pass_rate')}, sum(insufficient_count)::BIGINT AS insufficient_count FROM he GROUP BY 1""")
def gate_dashboard(spark, sf):
    return show(P.gate_dashboard(health(spark, sf)), ["gate", "windows", "insufficient_count"], ["avg_pass_rate", "min_pass_rate"])


@query("core_comparison", f"""WITH {RESULTS_SQL} SELECT symbol, "window", gate, string_agg(core, '>' ORDER BY round(alpha, 9) DESC, core) AS ranking, count(*) AS cores FROM wr GROUP BY 1, 2, 3""")
def core_comparison(spark, sf):
    out = P.core_comparison(results(spark, sf))
    return out.select("symbol", "window", "gate", F.array_join("order", ">").alias("ranking"), "cores")


@query("rule_catalogue", f"WITH {RESULTS_SQL} SELECT core, count(DISTINCT rule_id) AS rules, string_agg(DISTINCT rule_key, ',') AS rule_keys FROM sx GROUP BY 1")
def rule_catalogue(spark, sf):
    out = P.rule_catalogue(scored(spark, sf))
    return out.select("core", "rules", F.array_join("rule_keys", ",").alias("rule_keys"))


_DG = f"{r('avg(beats_hold::INT)', 'pass_rate')}, {r('avg(max_drawdown)', 'avg_drawdown')}, sum(trades)::BIGINT AS trades, {r('avg(trades / trade_floor)', 'trade_density')}"


@query("window_diagnostics", f"""WITH {RESULTS_SQL} SELECT 'symbol' AS dimension, symbol AS value, count(*) AS rows, {_DG} FROM wr WHERE "window" = 'all' GROUP BY 2
UNION ALL SELECT 'core', core, count(*), {_DG} FROM wr WHERE "window" = 'all' GROUP BY 2""")
def window_diagnostics(spark, sf):
    rows = results(spark, sf)
    part = lambda by: P.window_diagnostics(rows, by).withColumnRenamed(by, "value").withColumn("dimension", F.lit(by))
    return show(part("symbol").unionByName(part("core")), ["dimension", "value", "rows", "trades"], ["pass_rate", "avg_drawdown", "trade_density"])


@query("explainability", f"""WITH {RESULTS_SQL}, gd AS (SELECT wr.*, win.start_ts, win.end_ts, CASE WHEN insufficient THEN 'C*' WHEN beats_hold AND alpha >= 0.05 AND max_drawdown >= -0.35 AND trades >= wr.trade_floor THEN 'A'
 WHEN beats_hold AND alpha >= 0 AND trades >= wr.trade_floor THEN 'B' ELSE 'C' END AS grade FROM wr JOIN win ON win.symbol = wr.symbol AND win."window" = wr."window")
SELECT symbol, core, gate, "window", grade, start_ts, end_ts, row_number() OVER (PARTITION BY gate ORDER BY grade, round(alpha, 9) DESC, symbol, core, "window") AS place FROM gd""")
def explainability(spark, sf):
    out = P.explainability(results(spark, sf), S.window_table(daily(spark, sf), min_bars=20))
    return out.select("symbol", "core", "gate", "window", "grade", "start_ts", "end_ts", "place")


@query("round_quality", f"""WITH {RESULTS_SQL}, ex AS (SELECT * FROM (SELECT DISTINCT symbol FROM wr), (SELECT DISTINCT core FROM wr), (SELECT unnest(['gated', 'ungated']) AS gate), (SELECT unnest(['all', '360d', '90d', '30d']) AS "window")),
cl AS (SELECT ex.*, wr.symbol IS NOT NULL AS have, beats_hold, insufficient FROM ex LEFT JOIN wr ON wr.symbol = ex.symbol AND wr.core = ex.core AND wr.gate = ex.gate AND wr."window" = ex."window"),
pw AS (SELECT gate, "window", count(*) AS e, count(*) FILTER (have) AS o, count(*) FILTER (insufficient) AS i, count(*) FILTER (beats_hold) AS p FROM cl GROUP BY ALL)
SELECT gate, sum(e)::BIGINT AS expected_cells, sum(o)::BIGINT AS observed_cells, {r('sum(o) / sum(e)', 'coverage')}, {r('coalesce(sum(i) / nullif(sum(o), 0), 0)', 'insufficient_rate')}, {r('coalesce(sum(p) / nullif(sum(o), 0), 0)', 'pass_rate')}, min(p) AS min_passing_in_window FROM pw GROUP BY 1""")
def round_quality(spark, sf):
    rows = results(spark, sf)
    return show(H.round_quality(rows, _expected(rows)), ["gate", "expected_cells", "observed_cells", "min_passing_in_window"], ["coverage", "insufficient_rate", "pass_rate"])


def _expected(rows):
    """All cells a round should have: symbols x cores x gates x windows, fixed lists exploded per symbol."""
    cores = rows.agg(F.collect_set("core").alias("cs"))  # as many entries as there are cores
    base = rows.select("symbol").distinct().join(cores).select("symbol", F.explode("cs").alias("core"))
    gates = F.explode(F.array(*[F.lit(g) for g in P.GATES]))
    return base.withColumn("gate", gates).withColumn("window", F.explode(F.array(*[F.lit(w) for w in ("all", "360d", "90d", "30d")])))


@query("missing_cells", f"""WITH {RESULTS_SQL}, ex AS (SELECT * FROM (SELECT DISTINCT symbol FROM wr), (SELECT DISTINCT core FROM wr), (SELECT unnest(['gated', 'ungated']) AS gate), (SELECT unnest(['all', '360d', '90d', '30d']) AS "window"))
SELECT symbol, core, gate, "window" FROM ex WHERE NOT EXISTS (SELECT 1 FROM wr WHERE wr.symbol = ex.symbol AND wr.core = ex.core AND wr.gate = ex.gate AND wr."window" = ex."window")""")
def missing_cells(spark, sf):
    rows = results(spark, sf)
    return H.missing_cells(rows, _expected(rows))


@query("policy_value", f"""WITH {SWEEP_SQL}, z AS (SELECT *, score - 0.35::DOUBLE * credibility_penalty - 0.25::DOUBLE * stability_penalty AS z, net_return - 0.45::DOUBLE * abs(max_drawdown) - 0.0008::DOUBLE * trades AS rw FROM sc),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY symbol, "window", side)) AS e FROM z)
SELECT symbol, "window", side, count(*) AS candidates, {r('sum(e * max_drawdown) / sum(e)', 'exp_drawdown')}, {r('sum(e * trades) / sum(e)', 'exp_trades')}, {r(slog_sql('(sum(e * rw) / sum(e))'), 'exp_reward', 5)},
 arg_max(rule_id, (round(z, 9), rule_id)) AS best_rule FROM e GROUP BY 1, 2, 3""")
def policy_value(spark, sf):
    out = H.policy_value(S.score(daily_candidates(spark, sf)), ["symbol", "window", "side"])
    out = out.withColumn("exp_reward", F.round(slog(F.col("exp_reward")), 5))
    return show(out, ["symbol", "window", "side", "candidates", "best_rule", "exp_reward"], ["exp_drawdown", "exp_trades"])


_SHADOW_SQL = f"""{SWEEP_SQL}, z AS (SELECT *, score - 0.35::DOUBLE * credibility_penalty - 0.25::DOUBLE * stability_penalty AS z FROM sc WHERE "window" = 'all' AND side = 'long' AND rank <= 8),
e AS (SELECT *, exp(z - max(z) OVER ()) AS e FROM z)"""


@query("shadow_report", f"""WITH {_SHADOW_SQL}, a AS (SELECT count(*) FILTER (rank = 1) AS legacy_count, avg(net_return) FILTER (rank = 1) AS lr, min(max_drawdown) FILTER (rank = 1) AS ld, avg(trades) FILTER (rank = 1) AS lt,
 count(*) AS shadow_count, sum(e * net_return) / sum(e) AS sr, sum(e * max_drawdown) / sum(e) AS sd, sum(e * trades) / sum(e) AS st FROM e),
b AS (SELECT *, lr - 0.45::DOUBLE * abs(ld) - 0.0008::DOUBLE * greatest(0, round_even(lt, 0)) AS lw, sr - 0.45::DOUBLE * abs(sd) - 0.0008::DOUBLE * greatest(0, round_even(st, 0)) AS sw FROM a)
SELECT legacy_count, shadow_count, {r(slog_sql('lr'), 'legacy_return_log', 5)}, {r('ld', 'legacy_drawdown')}, {r('lt', 'legacy_trades')}, {r(slog_sql('sr'), 'shadow_return_log', 5)}, {r('sd', 'shadow_drawdown')}, {r('st', 'shadow_trades')},
 CASE WHEN sw > lw * 1.03::DOUBLE AND abs(sd) <= abs(ld) * 1.05::DOUBLE THEN 'candidate_for_promotion' ELSE 'hold_shadow' END AS recommend FROM b""")
def shadow_report(spark, sf):
    """Winners of the daily sweep against a softmax policy over the eight best of each set."""
    out, _ = H.shadow_policy(S.score(daily_candidates(spark, sf)), ["symbol", "family", "gate"])
    out = out.withColumns({f"{k}_return_log": F.round(slog(F.col(f"{k}_return")), 5) for k in ("legacy", "shadow")})
    return show(out, ["legacy_count", "shadow_count", "legacy_return_log", "shadow_return_log", "recommend"], ["legacy_drawdown", "legacy_trades", "shadow_drawdown", "shadow_trades"])


@query("shadow_actions", f"""WITH {_SHADOW_SQL}, t AS (SELECT *, sum(e) OVER () AS w, sum(e * max_drawdown) OVER () AS wd, row_number() OVER (ORDER BY round(z, 9) DESC, symbol, family, gate, rule_id) AS place FROM e)
SELECT symbol, rule_id, place, {r('e / w', 'probability')}, {r('score', 'score')}, trades, {r('(wd - e * max_drawdown) / nullif(w - e, 0)', 'rest_drawdown')} FROM t WHERE place <= 12""")
def shadow_actions(spark, sf):
    """The twelve most likely actions, and the policy's drawdown without each."""
    scored = stage(S.score(daily_candidates(spark, sf)), "scored")
    _, out = H.shadow_policy(scored, ["symbol", "family", "gate"])
    return show(out, ["symbol", "rule_id", "place", "trades"], ["probability", "score", "rest_drawdown"])


# --- run history: orders as runs, one series per priority -------------------------------------

RUNS_SQL = "runs AS (SELECT o_orderpriority AS profile, o_orderdate AS ts, o_orderkey AS run_id, o_totalprice / 600000 AS pass_rate, o_custkey AS c FROM orders)"
SERIES = ["profile"]


def runs_of(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("profile"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("run_id"),
        (F.col("o_totalprice") / 600000).alias("pass_rate"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


@query("run_deltas", f"WITH {RUNS_SQL} SELECT profile, run_id, {r('pass_rate - lag(pass_rate) OVER (PARTITION BY profile ORDER BY ts, run_id)', 'delta_pass_rate', 9)} FROM runs")
def run_deltas(spark, sf):
    return show(H.with_deltas(runs_of(spark, sf), SERIES, ["pass_rate"]), ["profile", "run_id"], ["delta_pass_rate"], 9)


@query("newest_runs", f"WITH {RUNS_SQL} SELECT profile, run_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY ts DESC, run_id DESC)::INT AS rn FROM runs) WHERE rn <= 8")
def newest_runs(spark, sf):
    return H.newest(runs_of(spark, sf), SERIES, 8).select("profile", "run_id", "rn")


@query("stability_streak", f"""WITH {RUNS_SQL}, x AS (SELECT *, sum((pass_rate < 0.1)::INT) OVER (PARTITION BY profile ORDER BY ts DESC, run_id DESC) AS bad FROM runs)
SELECT profile, count(*) FILTER (bad = 0) AS streak FROM x GROUP BY 1""")
def stability_streak(spark, sf):
    return H.stability_streak(runs_of(spark, sf), SERIES, F.col("pass_rate") >= 0.1)


@query("expectation", f"""WITH {RUNS_SQL}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY ts DESC, run_id DESC) AS rn FROM runs) WHERE rn <= 8),
d AS (SELECT *, pass_rate - lag(pass_rate) OVER w AS d, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER w AS gap FROM l WINDOW w AS (PARTITION BY profile ORDER BY ts, run_id)),
a AS (SELECT profile, arg_max(pass_rate, (ts, run_id)) AS latest, quantile_cont(d, 0.5) AS slope, stddev_pop(pass_rate) AS sd, greatest(600, coalesce(quantile_cont(gap, 0.5) FILTER (gap > 0), 14400)) AS round_seconds FROM d GROUP BY 1)
SELECT profile, {r('latest', 'latest')}, {r('slope', 'slope')}, {r('latest + slope', 'next')}, {r('greatest(0.01, abs(slope) * 1.8, sd * 0.8)', 'band')}, {r('round_seconds', 'round_seconds')},
 {r('CASE WHEN latest >= 0.9 THEN 0 WHEN slope > 1e-9 THEN (0.9::DOUBLE - latest) / slope END', 'rounds_to_target', 4)} FROM a""")
def expectation(spark, sf):
    out = H.expectation(runs_of(spark, sf), SERIES, "pass_rate", 0.9, 0.01)
    return show(out, ["profile"], ["latest", "slope", "next", "band", "round_seconds"]).join(show(out, ["profile"], ["rounds_to_target"], 4), "profile")


def _reach_sql(targets: dict[str, tuple[str, float]]) -> str:
    """Chance per measure (expression, target) and their geometric mean, over the last eight runs."""
    d = ", ".join(f"{m} - lag({m}) OVER w AS d_{m}" for m in targets)
    a = ", ".join(f"arg_max({m}, (ts, run_id)) AS l_{m}, coalesce(quantile_cont(d_{m}, 0.5), 0) AS s_{m}" for m in targets)
    n = ", ".join(f"CASE WHEN l_{m} >= {t}::DOUBLE THEN 0 WHEN s_{m} > 1e-9 THEN ({t}::DOUBLE - l_{m}) / s_{m} END AS r_{m}" for m, (_, t) in targets.items())
    p = ", ".join(f"CASE WHEN l_{m} >= {t}::DOUBLE THEN 0.88::DOUBLE WHEN r_{m} IS NULL THEN CASE WHEN s_{m} <= 0 THEN 0.06::DOUBLE ELSE 0.15::DOUBLE END ELSE least(1, exp(-0.45::DOUBLE * r_{m})) END AS p_{m}" for m, (_, t) in targets.items())
    return f"""WITH {RUNS_SQL.replace('FROM orders', ', ' + ', '.join(f'{e} AS {m}' for m, (e, _) in targets.items() if m != 'pass_rate') + ' FROM orders')},
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY ts DESC, run_id DESC) AS rn FROM runs) WHERE rn <= 8), d AS (SELECT *, {d} FROM l WINDOW w AS (PARTITION BY profile ORDER BY ts, run_id)),
a AS (SELECT profile, {a} FROM d GROUP BY 1), n AS (SELECT *, {n} FROM a), p AS (SELECT *, {p} FROM n)
SELECT profile, {', '.join(r(f'p_{m}', f'{m}_chance') for m in targets)}, {r('pow(' + ' * '.join(f'p_{m}' for m in targets) + f', 1.0::DOUBLE / {len(targets)})', 'reach_probability')},
 {r('greatest(' + ', '.join(f'r_{m}' for m in targets) + ')', 'eta_rounds', 4)} FROM p"""


_TARGETS = {"pass_rate": ("o_totalprice / 600000", 0.35), "alpha": ("o_totalprice / 300000 - 0.5", 0.4), "deploy": ("(o_custkey % 12)::DOUBLE", 6.0)}


@query("reach_probability", _reach_sql(_TARGETS))
def reach_probability(spark, sf):
    runs = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("profile"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("run_id"), (F.col("o_totalprice") / 600000).alias("pass_rate"),
        (F.col("o_totalprice") / 300000 - 0.5).alias("alpha"), (F.col("o_custkey") % 12).cast("double").alias("deploy"))
    out = H.reach_probability(runs, SERIES, {m: t for m, (_, t) in _TARGETS.items()})
    return show(out, ["profile"], [*(f"{m}_chance" for m in _TARGETS), "reach_probability"]).join(show(out, ["profile"], ["eta_rounds"], 4), "profile")


@query("baseline_gate", f"""WITH {RUNS_SQL}, m AS (SELECT profile, quantile_cont(pass_rate, 0.5) AS pass_rate, quantile_cont(run_id, 0.5) AS run_id FROM runs GROUP BY 1)
SELECT profile, {r('pass_rate', 'pass_rate')}, concat_ws(',', CASE WHEN pass_rate < 0.25 THEN 'pass_rate' END, CASE WHEN run_id > 7500 THEN 'run_id' END) AS blockers FROM m""")
def baseline_gate(spark, sf):
    out = H.baseline_gate(runs_of(spark, sf), SERIES, {"pass_rate": ("min", 0.25), "run_id": ("max", 7500)})
    return out.select("profile", F.round("pass_rate", 6).alias("pass_rate"), F.array_join("blockers", ",").alias("blockers"))


@query("history_contract", f"WITH {RUNS_SQL} SELECT profile, min(ts) AS first_ts, min(ts) <= TIMESTAMP '1995-01-02' AS meets_contract FROM runs GROUP BY 1")
def history_contract(spark, sf):
    return H.history_contract(runs_of(spark, sf), SERIES, F.lit("1995-01-02").cast("timestamp"))


@query("signal_funnel", f"""SELECT o_orderpriority AS profile, count(*) AS raw, count(*) FILTER (o_orderstatus <> 'O') AS labelled, count(*) FILTER (o_orderstatus = 'F') AS kept,
 {r("count(*) FILTER (o_orderstatus <> 'O') / count(*)", 'labelled_ratio')}, {r("coalesce(count(*) FILTER (o_orderstatus = 'F') / nullif(count(*) FILTER (o_orderstatus <> 'O'), 0), 0)", 'kept_ratio')} FROM orders GROUP BY 1""")
def signal_funnel(spark, sf):
    rows = runs_of(spark, sf).select("profile", F.lit(1).alias("raw"), (F.col("status") != "O").cast("int").alias("labelled"), (F.col("status") == "F").cast("int").alias("kept"))
    return show(H.funnel(rows, SERIES, ["raw", "labelled", "kept"]), ["profile", "raw", "labelled", "kept"], ["labelled_ratio", "kept_ratio"])


@query("profile_comparison", f"""WITH {RUNS_SQL}, p AS (SELECT profile, count(*) AS runs, avg(pass_rate) AS a, max(pass_rate) AS b FROM runs GROUP BY 1)
SELECT profile, runs, {r('a', 'avg_value')}, {r('b', 'best_value')}, row_number() OVER (ORDER BY round(a, 9) DESC, profile) AS place FROM p""")
def profile_comparison(spark, sf):
    return show(H.profile_comparison(runs_of(spark, sf), "profile", "pass_rate"), ["profile", "runs", "place"], ["avg_value", "best_value"])


@query("profile_effectiveness", f"""WITH {RUNS_SQL}, d AS (SELECT profile, pass_rate - lag(pass_rate) OVER (PARTITION BY profile ORDER BY ts, run_id) AS d FROM runs)
SELECT profile, count(d) AS rounds, {r('avg(greatest(-0.2, least(0.2, d)))', 'effect')}, {r('avg((d > 0)::INT)', 'win_share')} FROM d WHERE d IS NOT NULL GROUP BY 1""")
def profile_effectiveness(spark, sf):
    d = H.with_deltas(runs_of(spark, sf), SERIES, ["pass_rate"])
    return show(H.profile_effectiveness(d, "profile", "pass_rate", 0.2), ["profile", "rounds"], ["effect", "win_share"])


@query("rollback_needed", f"""WITH {RUNS_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY ts DESC, run_id DESC) AS rn FROM runs),
a AS (SELECT profile, max(pass_rate) FILTER (rn = 1) AS latest, quantile_cont(pass_rate, 0.5) FILTER (rn BETWEEN 2 AND 6) AS baseline FROM l WHERE rn <= 6 GROUP BY 1)
SELECT profile, {r('latest', 'latest')}, {r('baseline', 'baseline')}, baseline - latest > 0.05 AS rollback FROM a""")
def rollback_needed(spark, sf):
    return show(H.rollback_needed(runs_of(spark, sf), SERIES, "pass_rate", 0.05), ["profile", "rollback"], ["latest", "baseline"])


@query("run_progress", f"""WITH d AS (SELECT event_type AS symbol, event_id % 6 AS task, user_id AS run_id, min(ts) AS ts FROM events GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, symbol DESC, task DESC) AS rn FROM d),
a AS (SELECT run_id, count(*) AS done, count(DISTINCT symbol) AS symbols, epoch(max(ts))::BIGINT AS mx, max(ts) AS t1, min(ts) AS t0 FROM d GROUP BY 1),
n AS (SELECT run_id, count(*) AS k, min(ts) AS k0, max(ts) AS k1 FROM l WHERE rn <= 6 GROUP BY 1),
z AS (SELECT a.run_id, done, symbols, done / 30.0::DOUBLE AS share, floor(epoch(t1))::BIGINT - floor(epoch(t0))::BIGINT AS total, floor(epoch(k1))::BIGINT - floor(epoch(k0))::BIGINT AS span, k FROM a JOIN n USING (run_id))
SELECT run_id, done, symbols, {r('least(1, share)', 'share')}, {r('CASE WHEN total > 0 THEN (done - 1) / total END * 3600', 'global_per_hour')}, {r('CASE WHEN span > 0 THEN (k - 1) / span END * 3600', 'recent_per_hour')}, {r('CASE WHEN coalesce(s, g) > 0 THEN greatest(0, 30 - done) / coalesce(s, g) END / 3600', 'eta_hours')},
 CASE WHEN done >= 6 AND g > 0 AND s > 0 AND abs(s - g) / greatest(g, 1e-9) < 0.15::DOUBLE THEN 'high' WHEN done >= 6 AND g > 0 AND s > 0 AND abs(s - g) / greatest(g, 1e-9) < 0.35::DOUBLE THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT *, CASE WHEN total > 0 THEN (done - 1) / total END AS g, CASE WHEN span > 0 THEN (k - 1) / span END AS s FROM z)""")
def run_progress(spark, sf):
    """Users as runs, event types as symbols with six tasks each."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("symbol"), (F.col("event_id") % 6).alias("task"), "ts")
    out = H.progress(e, 30, recent=6)
    return out.select("run_id", "done", "symbols", "confidence", F.round(F.col("eta_seconds") / 3600, 6).alias("eta_hours"), F.round("share", 6).alias("share"), F.round(F.col("global_rate") * 3600, 6).alias("global_per_hour"), F.round(F.col("recent_rate") * 3600, 6).alias("recent_per_hour"))


@query("run_symbols", """WITH d AS (SELECT user_id AS run_id, event_type AS symbol, count(DISTINCT event_id % 4) AS done FROM events GROUP BY 1, 2),
c AS (SELECT * FROM (SELECT DISTINCT user_id AS run_id FROM events), (SELECT DISTINCT event_type AS symbol FROM events))
SELECT run_id, symbol, least(coalesce(done, 0), 3) AS done, round(least(coalesce(done, 0), 3) * 100.0 / 3.0::DOUBLE, 4) AS percent,
 CASE WHEN done >= 3 THEN 'done' WHEN done > 0 THEN 'running' ELSE 'pending' END AS phase FROM c LEFT JOIN d USING (run_id, symbol)""")
def run_symbols(spark, sf):
    """Users as runs; three of the four kinds of task finish a symbol."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("symbol"), (F.col("event_id") % 4).alias("task"))
    names = e.select("symbol").distinct().agg(F.collect_set("symbol").alias("s"))  # five names
    every = e.select("run_id").distinct().crossJoin(F.broadcast(names)).select("run_id", F.explode("s").alias("symbol"))
    out = H.symbol_progress(e, every, 3)
    return out.select("run_id", "symbol", "done", F.round("percent", 4).alias("percent"), "phase")


@query("validation_tail", """WITH p AS (SELECT user_id, floor(epoch(max(ts) FILTER (event_type = 'click')))::BIGINT AS d, floor(epoch(max(ts) FILTER (event_type = 'purchase')))::BIGINT AS e FROM events GROUP BY 1)
SELECT count(*) AS runs, round(quantile_cont(e - d, 0.5)::DOUBLE, 4) AS median_tail_seconds FROM p WHERE e - d >= 0""")
def validation_tail(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("event"), "ts")
    return show(H.validation_tail(e, "click", "purchase"), ["runs"], ["median_tail_seconds"], 4)


# --- run reports: months of a priority as runs, written as JSON in the reports' form and read back ----

_MONTHLY = """SELECT o_orderpriority || ' ' || strftime(o_orderdate, '%Y-%m') AS run_id, o_orderpriority AS profile, CAST(strftime(min(o_orderdate), '%m') AS INT) AS mon, max(o_orderdate) AS ts, count(*) AS n,
 count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, avg(o_totalprice) / 200000 - 0.7::DOUBLE AS alpha,
 quantile_cont(o_totalprice / 600000, 0.5) AS med, count(DISTINCT o_custkey % 5) AS syms, avg(o_totalprice / 300000 - 0.5) AS dalpha FROM orders GROUP BY 1, 2"""
_RUN_TARGETS = {"pass_rate": 0.5, "all_alpha": -0.1, "deploy_alpha": -0.05, "deploy_symbols": 4, "deploy_rules": 6}


@query("run_reports", f"""WITH m AS ({_MONTHLY}), x AS (SELECT *, mon % 5 = 0 AS no_val, mon % 4 = 0 AS no_dep FROM m),
y AS (SELECT run_id, profile, CASE WHEN no_val THEN 0 ELSE n END AS candidates_total, CASE WHEN no_val THEN 0 ELSE f END AS candidates_passed,
 CASE WHEN no_val THEN CASE WHEN mon = 10 THEN 0.25::DOUBLE ELSE 0 END ELSE f / n::DOUBLE END AS pass_rate, CASE WHEN no_val THEN 0 ELSE med END AS median_score,
 CASE WHEN no_val THEN CASE WHEN mon = 10 THEN 0.125::DOUBLE ELSE -10 END ELSE alpha END AS all_alpha, CASE WHEN no_dep THEN 0 ELSE syms END AS deploy_symbols, CASE WHEN no_dep THEN 0 ELSE n END AS deploy_rules,
 CASE WHEN no_dep THEN 0 ELSE dalpha END AS deploy_alpha, CASE WHEN no_val THEN 0 ELSE p / n::DOUBLE END AS fail,
 CASE WHEN no_val OR greatest(o, p) = 0 THEN NULL WHEN o >= p THEN 'open' ELSE 'pending' END AS top_rejection FROM x)
SELECT run_id, profile, candidates_total, candidates_passed, {', '.join(r(c, c) for c in ('pass_rate', 'median_score', 'all_alpha', 'deploy_alpha'))}, deploy_symbols, deploy_rules, top_rejection,
 {' AND '.join(f'{k} >= {v}' for k, v in _RUN_TARGETS.items())} AS gate_hit,
 CASE WHEN fail >= 0.999 THEN 'STATUS_VETO_ALL' WHEN pass_rate <= 0 THEN 'STATUS_STALLED' WHEN pass_rate < 0.2 THEN 'STATUS_RECOVERY' ELSE 'STATUS_STABLE' END AS status,
 CASE WHEN fail >= 0.5 THEN 'REGIME_VETO_HOLD' WHEN all_alpha > 0 THEN 'REGIME_EXPANSION' ELSE 'REGIME_CONSOLIDATION' END AS regime FROM y""")
def run_reports(spark, sf):
    """Reports of every run; some runs lack a report, and the oldest form lacks the best round."""
    orders = table(spark, sf, "orders").select(
        F.concat_ws(" ", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM")).alias("run_id"), F.col("o_orderpriority").alias("profile"), "o_orderdate", "o_orderstatus", "o_totalprice", "o_custkey")
    mon = F.substring("run_id", -2, 2).cast("int")
    count = lambda s: F.count_if(F.col("o_orderstatus") == s)
    runs = orders.groupBy("run_id", "profile").agg(F.max(F.col("o_orderdate").cast("timestamp")).alias("ts_utc")).withColumn("best_round_score", F.when(mon == 10, F.struct(
        F.lit(0.25).alias("validation_pass_rate"), F.lit(0.125).alias("all_window_avg_alpha_vs_spot"))))
    val = orders.where(mon % 5 != 0).groupBy("run_id").agg(
        F.count("*").alias("candidates_total"), count("F").alias("candidates_passed"), (count("F") / F.count("*")).alias("pass_rate"), (count("P") / F.count("*")).alias("failsafe_veto_all_rate"),
        F.collect_list(F.struct(F.struct((F.col("o_totalprice") / 600000).alias("final_score")).alias("scores"))).alias("rows"),  # the orders of a month
        F.array(F.struct(F.lit("30d").alias("window"), F.lit(9.0).alias("avg_alpha_vs_spot")), F.struct(F.lit("all").alias("window"), (F.avg("o_totalprice") / 200000 - 0.7).alias("avg_alpha_vs_spot"))).alias("summary_by_window"),
        F.create_map(F.lit("open"), count("O"), F.lit("pending"), count("P")).alias("failed_reason_counts"), F.lit("v2").alias("unknown_field"))
    per = orders.where(mon % 4 != 0).groupBy("run_id", (F.col("o_custkey") % 5).cast("string").alias("symbol")).agg(F.collect_list(F.struct((F.col("o_totalprice") / 300000 - 0.5).alias("alpha_vs_spot"))).alias("rules"))
    dep = per.groupBy("run_id").agg(F.count("*").alias("total_symbols"), F.sum(F.size("rules")).alias("total_rules"), F.collect_list(F.struct("symbol", "rules")).alias("symbols"))
    root = f"{staging_dir(spark).rstrip('/')}/reports-{uuid.uuid4().hex}"
    for name, df in (("runs", runs), ("validation", val), ("deploy", dep)):
        df.write.json(f"{root}/{name}")
    out = H.run_metrics(artifacts.read_run_reports(spark, f"{root}/runs", f"{root}/validation", f"{root}/deploy"), _RUN_TARGETS)
    return show(out, ["run_id", "profile", "candidates_total", "candidates_passed", "deploy_symbols", "deploy_rules", "top_rejection", "gate_hit", "status", "regime"], ["pass_rate", "median_score", "all_alpha", "deploy_alpha"])
