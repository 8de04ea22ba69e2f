"""Features, fusion, core rules and gates on one-minute bars of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import query
from barloom.catalog.common import WINDOW, event_bars_sql, minutely, r, show
from barloom.catalog.q_bars import HTF_COLS, htf_sql
from barloom.catalog.q_rules import SUMMARY, ewm_sql, summary
from barloom.functions.expr import bar_return
from barloom.operators import bars as B
from barloom.plans import features as FT
from barloom.plans import fusion as FU
from barloom.plans import rules as R
from barloom.session import stage

KEY = ["symbol", "ts"]
FRAMES = {"5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "4h": "4 hours", "1d": "1 day", "1w": "7 days"}
HOURS = {"5m": 5 / 60, "15m": 0.25, "1h": 1, "4h": 4, "1d": 24, "1w": 168}
MINUTES = {"5m": 5, "15m": 15, "1h": 60, "4h": 240, "1d": 1440, "1w": 10080}
WARMUP = 300


def q(name: str) -> str:
    return f'"{name}"'


def _frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _at_least(agg: str, col: str, n: int, m: int) -> str:
    return f"CASE WHEN count({col}) OVER {_frame(n)} >= {m} THEN {agg} OVER {_frame(n)} END"


BASE_SQL = f"""RECURSIVE {event_bars_sql('1 minute', 'bars')},
b0 AS (SELECT symbol, ts, nullif(close, 0) AS c, nullif(volume, 0) AS v, (high - low) / nullif(close, 0) AS rng, ln(1 + greatest(volume, 0)) AS lv,
 ln((nullif(close, 0) + 1e-12) / (lag(nullif(close, 0)) OVER w + 1e-12)) AS ret, ln((nullif(volume, 0) + 1e-12) / (lag(nullif(volume, 0)) OVER w + 1e-12)) AS vret,
 row_number() OVER w AS i FROM bars {WINDOW}),
e AS (SELECT symbol, i, v AS f, v AS s, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS n, CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END AS k FROM b0 WHERE i = 1
 UNION ALL SELECT x.symbol, x.i,
  CASE WHEN x.v IS NULL THEN e.f WHEN e.f IS NULL THEN x.v ELSE (pow(1 - 2.0::DOUBLE / 31, e.k) * e.f + 2.0::DOUBLE / 31 * x.v) / (pow(1 - 2.0::DOUBLE / 31, e.k) + 2.0::DOUBLE / 31) END,
  CASE WHEN x.v IS NULL THEN e.s WHEN e.s IS NULL THEN x.v ELSE (pow(1 - 2.0::DOUBLE / 241, e.k) * e.s + 2.0::DOUBLE / 241 * x.v) / (pow(1 - 2.0::DOUBLE / 241, e.k) + 2.0::DOUBLE / 241) END,
  e.n + CASE WHEN x.v IS NULL THEN 0 ELSE 1 END, CASE WHEN x.v IS NOT NULL THEN 1 WHEN e.k > 0 THEN e.k + 1 ELSE 0 END
 FROM e JOIN b0 x ON x.symbol = e.symbol AND x.i = e.i + 1),
b1 AS (SELECT b0.*, ln((CASE WHEN n >= 30 THEN f END + 1e-12) / (CASE WHEN n >= 60 THEN s END + 1e-12)) AS regime FROM b0 JOIN e USING (symbol, i)),
b2 AS (SELECT *, {_at_least('quantile_cont(ret, 0.5)', 'ret', 60, 20)} AS rmed, {_at_least('quantile_cont(v, 0.5)', 'v', 240, 30)} AS vmed,
 {_at_least('quantile_cont(lv, 0.5)', 'lv', 240, 30)} AS lmed, lag_q AS jthr FROM (SELECT *, {_at_least('quantile_cont(abs(ret), 0.97)', 'ret', 480, 60)} AS lag_q FROM b1)),
b3 AS (SELECT *, abs(ret - rmed) AS rdev, abs(lv - lmed) AS ldev, ln((v + 1e-12) / (vmed + 1e-12)) AS relv, coalesce(abs(ln((v + 1e-12) / (vmed + 1e-12))), 0) AS src,
 coalesce((abs(ret) > lag(jthr) OVER w)::INT, 0) AS j FROM b2 {WINDOW}),
b4 AS (SELECT *, {_at_least('quantile_cont(rdev, 0.5)', 'rdev', 60, 20)} AS rmad, {_at_least('quantile_cont(ldev, 0.5)', 'ldev', 240, 30)} AS lmad,
 {_at_least('quantile_cont(src, 0.95)', 'src', 480, 60)} AS sthr FROM b3),
b5 AS (SELECT *, coalesce((src > lag(sthr) OVER w)::INT, 0) AS s FROM b4 {WINDOW}),
base AS (SELECT symbol, ts, i, ret AS {q(FT.RET)}, vret AS {q(FT.VOL_RET)}, coalesce((ret - rmed) / nullif(1.4826::DOUBLE * rmad, 0), 0) AS {q(FT.TENSION)},
 rng AS {q(FT.RANGE)}, {_at_least('stddev_samp(ret)', 'ret', 60, 20)} AS {q(FT.VOL60)}, relv AS {q(FT.REL_VOLUME)},
 coalesce((lv - lmed) / nullif(1.4826::DOUBLE * lmad, 0), 0) AS {q(FT.VOLUME_Z)}, ln((abs(ret) + 1e-12) / (coalesce(v, 0) + 1e-12)) AS {q(FT.IMPACT)},
 ln((abs(rng) + 1e-12) / (coalesce(v, 0) + 1e-12)) AS {q(FT.RANGE_VOLUME)}, regime AS {q(FT.REGIME)},
 {_at_least('avg(s)', 's', 240, 30)} AS {q(FT.SHOCKS)}, {_at_least('avg(j)', 'j', 240, 30)} AS {q(FT.JUMPS)} FROM b5)"""


@query("base_features", f"WITH {BASE_SQL} SELECT symbol, ts, {', '.join(r(q(c), q(c)) for c in FT.BASE_FEATURES)} FROM base")
def base_features(spark, sf):
    return show(FT.base_features(minutely(spark, sf)), KEY, FT.BASE_FEATURES)


def features_of(spark, sf, warmup=WARMUP):
    bars = stage(minutely(spark, sf), "minute-bars")
    coarse = {t: B.resample(bars, t) for t in FRAMES}
    return FT.feature_set(bars, coarse, warmup=warmup), bars


def _set_sql() -> str:
    ctes, joins, cols, clocks = [], [], [], []
    for t, span in FRAMES.items():
        bucket = "date_trunc('week', ts)::TIMESTAMP" if t == "1w" else f"time_bucket(INTERVAL '{span}', ts)"
        ctes.append(f"""c_{t} AS (SELECT symbol, {bucket} AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2)""")
        ctes.append(htf_sql(f"c_{t}", f"h_{t}", 0).replace("INTERVAL 0 HOUR", f"INTERVAL {MINUTES[t]} MINUTE"))
        joins.append(f"ASOF LEFT JOIN h_{t} ON base.symbol = h_{t}.symbol AND base.ts >= h_{t}.close_ts")
        cols += [f"h_{t}.{c} AS {q(FT.htf_name(c, t))}" for c in FT.HTF_FAMILIES]
        left = f"({MINUTES[t]} - (epoch(base.ts)::BIGINT // 60) % {MINUTES[t]})"
        clocks += [f"{left}::DOUBLE AS {q(FT.clock_name('ttc_min', t))}", f"ln(1 + {left}) AS {q(FT.clock_name('ttc_log', t))}", f"{left} / {MINUTES[t]}::DOUBLE AS {q(FT.clock_name('ttc_phase', t))}"]
    allc = FT.feature_columns(list(FRAMES))
    fill = ", ".join(f"coalesce(last_value({q(c)} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS {q(c)}" for c in allc)
    return f"""{BASE_SQL}, {', '.join(ctes)},
wide AS (SELECT base.*, {', '.join(cols + clocks)} FROM base {' '.join(joins)}),
feat AS (SELECT * FROM (SELECT symbol, ts, i, count(*) OVER (PARTITION BY symbol) AS n_rows, {fill} FROM wide) WHERE n_rows <= {WARMUP} OR i > {WARMUP})"""


SET_SQL = _set_sql()
ALL_COLUMNS = FT.feature_columns(list(FRAMES))


@query("feature_set", f"WITH {SET_SQL} SELECT symbol, ts, {', '.join(r(q(c), q(c)) for c in ALL_COLUMNS)} FROM feat")
def feature_set(spark, sf):
    return show(features_of(spark, sf)[0], KEY, ALL_COLUMNS)


# Look-back windows that begin inside the month of events, so that each has rows before it.
_LATE = {"all": None, "20d": 20, "10d": 10, "5d": 5}


def _causal_sql() -> str:
    wins = ", ".join(f"('{w}', {d or 100000})" for w, d in _LATE.items())
    at = lambda c, q: f"quantile_cont(f.{c}, {q}) FILTER (f.ts < s.start_ts)"
    lo_hi = ", ".join(f"{at(q(c), FT.WINSOR[0])} AS lo_{i}, {at(q(c), FT.WINSOR[1])} AS hi_{i}" for i, c in enumerate(ALL_COLUMNS))
    cut = ", ".join(r(f"CASE WHEN {q(c)} < lo_{i} THEN lo_{i} WHEN {q(c)} > hi_{i} THEN hi_{i} ELSE {q(c)} END", q(c)) for i, c in enumerate(ALL_COLUMNS))
    return f"""WITH {SET_SQL}, st AS (SELECT symbol, win, min(ts) AS start_ts FROM feat JOIN (SELECT symbol, max(ts) AS mx FROM feat GROUP BY 1) USING (symbol) CROSS JOIN (VALUES {wins}) v(win, days)
 WHERE ts >= mx - to_days(days) GROUP BY 1, 2),
wb AS (SELECT f.symbol, s.win, any_value(s.start_ts) AS start_ts, {lo_hi} FROM feat f JOIN st s ON s.symbol = f.symbol GROUP BY 1, 2)
SELECT symbol, ts, win AS "window", {cut} FROM feat JOIN wb USING (symbol) WHERE ts >= start_ts"""


@query("feature_windows", _causal_sql())
def feature_windows(spark, sf):
    """The feature set of each look-back window, clipped to bounds from the rows before the window."""
    feats = stage(features_of(spark, sf)[0], "features")
    starts = stage(B.lookback_slices(feats.select("symbol", "ts"), lookbacks=_LATE).groupBy("symbol", "window").agg(F.min("ts").alias("start_ts")), "starts")
    return show(FT.causal_windows(feats, starts, list(_LATE), ["symbol"], ALL_COLUMNS), [*KEY, "window"], ALL_COLUMNS)


_NAMES = ", ".join(q(c) for c in ALL_COLUMNS)
_REGISTRY_SQL = f"""{SET_SQL}, lg AS (SELECT symbol, name, x FROM (SELECT symbol, {_NAMES} FROM feat) UNPIVOT INCLUDE NULLS (x FOR name IN ({_NAMES}))),
rg AS (SELECT symbol, name, CASE WHEN contains(name, '__') THEN split_part(name, '__', 1) ELSE 'flow_liquidity' END AS family, count(x) / count(*)::DOUBLE AS non_null_ratio,
 coalesce(stddev_samp(x), 0) AS std, coalesce(avg(abs(x)), 0) AS mean_abs FROM lg GROUP BY ALL)"""
_REG = ["non_null_ratio", "std", "mean_abs"]


@query("feature_registry", f"WITH {_REGISTRY_SQL} SELECT symbol, name, family, {', '.join(r(c, c, 5) for c in _REG)} FROM rg")
def feature_registry(spark, sf):
    return show(FT.feature_registry(features_of(spark, sf)[0], ALL_COLUMNS), ["symbol", "name", "family"], _REG, 5)


@query("registry_merge", f"""WITH {_REGISTRY_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY non_null_ratio DESC, symbol) AS rn FROM rg)
SELECT symbol, name, family, {', '.join(r(c, c, 5) for c in _REG)} FROM x WHERE rn = 1""")
def registry_merge(spark, sf):
    reg = FT.feature_registry(features_of(spark, sf)[0], ALL_COLUMNS)
    return show(FT.merge_registries(reg), ["symbol", "name", "family"], _REG, 5)


# --- fusion -----------------------------------------------------------------------------------

_COMP = [f"{f}_component" for f in FU.FAMILIES]


def fuse_sql(src: str, shares: tuple[float, float, float], out: str) -> str:
    """CTEs from `src(symbol, ts, i, raw_*, w_*)` to `out` with components, score and confidence."""
    comp = ", ".join((f"-w_{f} * abs(raw_{f})" if f in ("risk", "timing") else f"w_{f} * raw_{f}") + f" AS {f}_component" for f in FU.FAMILIES)
    mm = lambda e: f"CASE WHEN max({e}) OVER s - min({e}) OVER s < 1e-12 THEN 0.5 ELSE ({e} - min({e}) OVER s) / (max({e}) OVER s - min({e}) OVER s) END"
    a, b, c = shares
    return f"""{out}_c AS (SELECT *, {comp} FROM {src}), {out}_f AS (SELECT *, {' + '.join(_COMP)} AS fusion_score FROM {out}_c),
{out} AS (SELECT *, least(1, greatest(0, {a}::DOUBLE * {mm('abs(fusion_score)')} + {b}::DOUBLE * least(1, greatest(0, (raw_flow + 1) / 2)) + {c}::DOUBLE * (1 - {mm('abs(raw_risk)')}))) AS confidence
 FROM {out}_f WINDOW s AS (PARTITION BY symbol))"""


FIXED_SQL = f"""{SET_SQL}, fx AS (SELECT symbol, ts, i, {', '.join(f"{q(FU.FIXED_COLUMNS[f][0])} AS raw_{f}, {w}::DOUBLE AS w_{f}" for f, w in FU.FIXED_WEIGHTS.items())} FROM feat),
{fuse_sql('fx', (0.55, 0.25, 0.2), 'fus')}"""
_FUSED = [*_COMP, "fusion_score", "confidence"]


@query("fusion_fixed", f"WITH {FIXED_SQL} SELECT symbol, ts, {', '.join(r(c, c) for c in _FUSED)} FROM fus")
def fusion_fixed(spark, sf):
    return show(FU.fixed_fusion(features_of(spark, sf)[0]), KEY, _FUSED)


def _adaptive_sql() -> str:
    fams = {f: FU.family_columns(f, ALL_COLUMNS) for f in FU.FAMILIES}
    used = sorted({c for m in fams.values() for c in m})
    fr = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    zs = ", ".join(f"tanh(CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) > 60 THEN coalesce(({q(c)} - avg({q(c)}) {fr}) / nullif(stddev_pop({q(c)}) {fr}, 0), 0) ELSE 0 END) AS {q('z_' + c)}" for c in used)
    raws = ", ".join("(" + " + ".join(f"{t} * {q('z_' + c)}" for c, t in m.items()) + f") / {sum(m.values())}::DOUBLE AS raw_{f}" for f, m in fams.items())
    xs = ", ".join(f"coalesce(lag(raw_{f}) OVER w, 0) AS x_{f}" for f in FU.FAMILIES)
    m = ewm_sql("rm", "rx", {**{f"m_{f}": (f"x_{f}", "0.02::DOUBLE") for f in FU.FAMILIES}, "m_y": ("y", "0.02::DOUBLE")})
    dv = ", ".join(f"(x_{f} - m_{f}) * (y - m_y) AS xy_{f}, (x_{f} - m_{f}) * (x_{f} - m_{f}) AS xx_{f}" for f in FU.FAMILIES)
    v = ewm_sql("rv", "rd", {**{f"{p}_{f}": (f"{p}_{f}", "0.02::DOUBLE") for f in FU.FAMILIES for p in ("xy", "xx")}, "yy": ("yy", "0.02::DOUBLE")}, 120)
    ex = ", ".join(f"exp(least(8, greatest(-8, 3::DOUBLE * (0.65::DOUBLE + 1.35::DOUBLE * least(0.85::DOUBLE, abs(coalesce(CASE WHEN rv.i >= 239 THEN rv.xy_{f} / sqrt(rv.xx_{f} * rv.yy + 1e-12) END, 0)))) * {b}::DOUBLE))) AS e_{f}" for f, b in FU.BASE_WEIGHTS.items())
    tot = " + ".join(f"e_{f}" for f in FU.FAMILIES)
    wf = ", ".join(f"greatest(0.05::DOUBLE, e_{f} / ({tot})) AS u_{f}" for f in FU.FAMILIES)
    ut = " + ".join(f"u_{f}" for f in FU.FAMILIES)
    return f"""{SET_SQL}, zz AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, {q(FT.RET)} AS y, {zs} FROM feat), rw AS (SELECT symbol, ts, i, y, {raws} FROM zz),
rx AS (SELECT *, {xs} FROM rw {WINDOW}), {m}, rd AS (SELECT rx.symbol, rx.ts, rx.i, {dv}, (y - m_y) * (y - m_y) AS yy FROM rx JOIN rm USING (symbol, i) WHERE rx.i >= 120), {v},
we AS (SELECT rw.*, {ex} FROM rw LEFT JOIN rv ON rv.symbol = rw.symbol AND rv.i = rw.i), wu AS (SELECT *, {wf} FROM we),
wn AS (SELECT *, {', '.join(f'u_{f} / ({ut}) AS w_{f}' for f in FU.FAMILIES)} FROM wu), {fuse_sql('wn', (0.5, 0.3, 0.2), 'fus')}"""


@query("fusion_adaptive", f"WITH {_adaptive_sql()} SELECT symbol, ts, {', '.join(r(c, c) for c in _FUSED + ['w_trend', 'w_flow'])} FROM fus")
def fusion_adaptive(spark, sf):
    return show(FU.adaptive_fusion(features_of(spark, sf)[0], ALL_COLUMNS), KEY, _FUSED + ["w_trend", "w_flow"])


# --- feature worth ----------------------------------------------------------------------------

_DIAG_SQL = f"""{SET_SQL}, tg AS (SELECT symbol, ts, coalesce(ln((lead(close, 5) OVER w + 1e-12) / (close + 1e-12)), 0) AS y FROM bars {WINDOW}),
wd AS (SELECT symbol, ts, y, {_NAMES} FROM feat JOIN tg USING (symbol, ts)), lg AS (SELECT symbol, ts, name, x, y FROM wd UNPIVOT INCLUDE NULLS (x FOR name IN ({_NAMES}))),
dg0 AS (SELECT symbol, name, CASE WHEN contains(name, '__') THEN split_part(name, '__', 1) ELSE 'flow_liquidity' END AS family, corr(x, y) AS correlation, avg((abs(x) > 1e-12)::INT) AS coverage
 FROM lg WHERE x IS NOT NULL GROUP BY ALL HAVING count(*) >= 80 AND stddev_samp(x) > 1e-12),
dg1 AS (SELECT *, abs(correlation) * (0.5::DOUBLE + 0.5::DOUBLE * coverage) AS utility FROM dg0),
dg AS (SELECT *, CASE WHEN correlation >= 0 THEN 'positive' ELSE 'negative' END AS direction, sum(utility) OVER (PARTITION BY symbol, family) / sum(utility) OVER (PARTITION BY symbol) AS family_share,
 row_number() OVER (PARTITION BY symbol ORDER BY round(utility, 9) DESC, name) AS rank FROM dg1)"""


def diagnosed(spark, sf):
    feats, bars = features_of(spark, sf)
    rows = feats.join(FU.forward_returns(bars, 5).select(*KEY, "fwd_ret"), KEY)
    return stage(rows, "diagnosed")


@query("feature_diagnostics", f"WITH {_DIAG_SQL} SELECT symbol, name, family, direction, rank, {', '.join(r(c, c) for c in ('utility', 'correlation', 'coverage', 'family_share'))} FROM dg WHERE rank <= 30")
def feature_diagnostics(spark, sf):
    return show(FU.diagnostics(diagnosed(spark, sf), ALL_COLUMNS), ["symbol", "name", "family", "direction", "rank"], ["utility", "correlation", "coverage", "family_share"])


@query("prune_list", f"""WITH {_DIAG_SQL}, pr AS (SELECT a.symbol, a.name, b.name AS leader, abs(corr(a.x, b.x)) AS c FROM lg a JOIN lg b ON b.symbol = a.symbol AND b.ts = a.ts AND b.name <> a.name GROUP BY ALL), ct AS (SELECT symbol, quantile_cont(utility, 0.2) AS cut FROM dg GROUP BY 1),
bs AS (SELECT pr.symbol, pr.name, arg_max(leader, (round(c, 9), leader)) AS correlated_with, arg_max(c, (round(c, 9), leader)) AS correlation_abs
 FROM pr JOIN dg ON dg.symbol = pr.symbol AND dg.name = pr.leader AND dg.rank <= 10 WHERE NOT isnan(c) GROUP BY 1, 2),
lo AS (SELECT dg.symbol, dg.name, family, utility, correlated_with, coalesce(correlation_abs, 0) AS correlation_abs,
 CASE WHEN correlation_abs >= 0.9 THEN 'low_utility_high_collinearity' ELSE 'low_utility' END AS reason FROM dg JOIN ct USING (symbol) LEFT JOIN bs ON bs.symbol = dg.symbol AND bs.name = dg.name WHERE utility <= cut),
lr AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY (reason = 'low_utility')::INT, round(utility, 9), name) AS rank FROM lo)
SELECT symbol, name, family, correlated_with, reason, {r('utility', 'utility')}, {r('correlation_abs', 'correlation_abs')}, rank FROM lr WHERE rank <= 20""")
def prune_list(spark, sf):
    rows = diagnosed(spark, sf)
    ranked = FU.diagnostics(rows, ALL_COLUMNS, top=None)
    out = FU.prune_candidates(rows, ALL_COLUMNS, ranked)
    return show(out, ["symbol", "name", "family", "correlated_with", "reason", "rank"], ["utility", "correlation_abs"])


@query("weight_profile", f"""WITH {FIXED_SQL}, s AS (SELECT symbol, {', '.join(f'coalesce(avg(abs({f}_component)) FILTER (confidence > 0.6), avg(abs({f}_component))) AS s_{f}, coalesce(avg({f}_component) FILTER (confidence > 0.6), avg({f}_component)) AS {f}_component_avg' for f in FU.FAMILIES)} FROM fus GROUP BY 1)
SELECT symbol, {', '.join(r(f"s_{f} / ({' + '.join('s_' + g for g in FU.FAMILIES)})", f'{f}_weight_share') for f in FU.FAMILIES)}, {', '.join(r(f'{f}_component_avg', f'{f}_component_avg') for f in FU.FAMILIES)} FROM s""")
def weight_profile(spark, sf):
    fus = FU.fixed_fusion(features_of(spark, sf)[0]).withColumn("entry", F.col("confidence") > 0.6)
    out = FU.weight_profile(fus, "entry")
    return show(out, ["symbol"], [c for c in out.columns if c != "symbol"])


# --- core rules and gates ---------------------------------------------------------------------


def core_rows(spark, sf):
    feats, bars = features_of(spark, sf)
    rets = stage(bars, "rets")
    from barloom.operators.series import by_blocks

    ret = by_blocks(rets, ["symbol"], lambda df, w: df.withColumn("ret", bar_return(F.col("close"), F.lag("close").over(w))), 1)
    return stage(feats.join(ret.select(*KEY, "ret", "close"), KEY), "core-rows")


def _core_sql() -> str:
    used = sorted({f for c in R.CORE_RULES.values() for f, _, _ in (*c.entry, *c.exit)})
    name = {f: f"f{i}" for i, f in enumerate(used)}
    cr = ", ".join(f"{q(f)} AS {name[f]}, lag({q(f)}) OVER w AS p{name[f]}" for f in used)

    def test(f, op, par, p):
        x, px, lv = name[f], "p" + name[f], f"{p[par]!r}::DOUBLE"
        return {"x>": f"coalesce({px} <= {lv} AND {x} > {lv}, false)", "x<": f"coalesce({px} >= {lv} AND {x} < {lv}, false)", ">": f"{x} > {lv}", "<": f"{x} < {lv}"}[op]

    arms = []
    for rule in R.core_rule_grid():
        c, p = R.CORE_RULES[rule.rule_key], dict(rule.params)
        ent = " AND ".join(test(*t, p) for t in c.entry)
        ext = " OR ".join(test(*t, p) for t in c.exit)
        arms.append(f"SELECT symbol, i, '{rule.rule_id}' AS rule_id, {ent} AS entry, {ext} AS exit FROM cr")
    return f"""{SET_SQL}, cr AS (SELECT symbol, i, {cr} FROM feat {WINDOW}), s AS ({' UNION ALL '.join(arms)})
SELECT symbol, rule_id, {SUMMARY} FROM s GROUP BY 1, 2"""


@query("core_signals", f"WITH {_core_sql()}")
def core_signals(spark, sf):
    """All 132 feature-core rules."""
    return summary(R.core_signals(core_rows(spark, sf)))


@query("gate_levels", f"""WITH {FIXED_SQL}, lv AS (SELECT symbol, quantile_cont(fusion_score, 0.55) AS sl, greatest(0.05, least(0.95, quantile_cont(confidence, 0.4))) AS cl FROM fus GROUP BY 1)
SELECT symbol, {r('any_value(sl)', 'score_level')}, {r('any_value(cl)', 'conf_level')}, count(*) FILTER (fusion_score >= sl AND confidence >= cl) AS open_long,
 count(*) FILTER (fusion_score <= -abs(sl) AND confidence >= cl) AS open_inverse FROM fus JOIN lv USING (symbol) GROUP BY 1""")
def gate_levels(spark, sf):
    fus = stage(FU.fixed_fusion(features_of(spark, sf)[0]), "fusion")
    levels = R.gate_levels(fus, ["symbol"])
    out = fus.join(levels, "symbol").groupBy("symbol").agg(
        F.first("score_level").alias("score_level"), F.first("conf_level").alias("conf_level"),
        F.count_if(R.gate_long()).alias("open_long"), F.count_if(R.gate_inverse()).alias("open_inverse"),
    )
    return show(out, ["symbol", "open_long", "open_inverse"], ["score_level", "conf_level"])


# --- feature reports --------------------------------------------------------------------------


@query("feature_importance", f"""WITH {_DIAG_SQL} SELECT name, family, count(*) AS seen, {r('avg(utility)', 'avg_utility')}, {r('avg(abs(correlation))', 'avg_abs_corr')} FROM dg GROUP BY 1, 2""")
def feature_importance(spark, sf):
    from barloom.plans.reports import feature_importance as overview

    return show(overview(FU.diagnostics(diagnosed(spark, sf), ALL_COLUMNS, top=None)), ["name", "family", "seen"], ["avg_utility", "avg_abs_corr"])


@query("prune_overview", f"""WITH {_DIAG_SQL}, ct AS (SELECT symbol, quantile_cont(utility, 0.2) AS cut FROM dg GROUP BY 1), lo AS (SELECT name, family, utility FROM dg JOIN ct USING (symbol) WHERE utility <= cut)
SELECT name, family, count(*) AS seen, {r('avg(utility)', 'avg_utility')} FROM lo GROUP BY 1, 2""")
def prune_overview(spark, sf):
    from barloom.plans.reports import prune_overview as overview

    rows = diagnosed(spark, sf)
    out = overview(FU.prune_candidates(rows, ALL_COLUMNS, FU.diagnostics(rows, ALL_COLUMNS, top=None)))
    return show(out, ["name", "family", "seen"], ["avg_utility"])


# --- core sweep on hourly bars, gated and ungated ---------------------------------------------


def _core_sweep_sql() -> str:
    from barloom.catalog.q_backtest import SCORING_SQL, WINDOWS_SQL

    used = sorted({f for c in R.CORE_RULES.values() for f, _, _ in (*c.entry, *c.exit)})
    name = {f: f"f{i}" for i, f in enumerate(used)}
    raw = {f: FU.FIXED_COLUMNS[f][0] for f in FU.FAMILIES}
    every = sorted({*used, *raw.values()})
    last = ", ".join(f"arg_max({q(c)}, ts) AS {q(c)}" for c in every)
    cols = ", ".join(f"coalesce({q(c)}, 0) AS {q(c)}" for c in every)
    lags = ", ".join(f"{q(f)} AS {name[f]}, lag({q(f)}) OVER w AS p{name[f]}" for f in used)

    def test(f, op, par, p):
        x, px, lv = name[f], "p" + name[f], f"{p[par]!r}::DOUBLE"
        return {"x>": f"coalesce({px} <= {lv} AND {x} > {lv}, false)", "x<": f"coalesce({px} >= {lv} AND {x} < {lv}, false)", ">": f"{x} > {lv}", "<": f"{x} < {lv}"}[op]

    arms = []
    for rule in R.core_rule_grid():
        c, p = R.CORE_RULES[rule.rule_key], dict(rule.params)
        arms.append(f"SELECT symbol, ts, close, ret, '{rule.rule_id}' AS rule_id, '{c.core}' AS family, {' AND '.join(test(*t, p) for t in c.entry)} AS entry, {' OR '.join(test(*t, p) for t in c.exit)} AS exit FROM cr")
    return f"""{SET_SQL}, hb AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2),
hf AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, {last} FROM feat GROUP BY 1, 2),
al AS (SELECT hb.symbol, hb.ts, close, {cols} FROM hb LEFT JOIN hf ON hf.symbol = hb.symbol AND hf.ts = hb.ts),
cr AS (SELECT symbol, ts, close, close / lag(close) OVER w - 1 AS ret, {lags} FROM al {WINDOW}),
fx AS (SELECT symbol, ts, 0 AS i, {', '.join(f"{q(raw[f])} AS raw_{f}, {w}::DOUBLE AS w_{f}" for f, w in FU.FIXED_WEIGHTS.items())} FROM al), {fuse_sql('fx', (0.55, 0.25, 0.2), 'fus')},
{WINDOWS_SQL.replace('FROM bars', 'FROM hb')}, lv AS (SELECT f.symbol, win."window", quantile_cont(fusion_score, 0.55) AS sl, greatest(0.05, least(0.95, quantile_cont(confidence, 0.4))) AS cl FROM fus f JOIN win ON win.symbol = f.symbol AND f.ts >= win.start_ts GROUP BY ALL),
sg AS ({' UNION ALL '.join(arms)}), w0 AS (SELECT sg.*, win."window", split_part(rule_id, ':', 2) AS rule_key FROM sg JOIN win ON win.symbol = sg.symbol AND sg.ts >= win.start_ts),
ws AS (SELECT *, 'ungated' AS gate, 'long' AS side FROM w0 UNION ALL SELECT w0.* REPLACE (w0.entry AND fusion_score >= sl AND confidence >= cl AS entry), 'gated', 'long' FROM w0 JOIN fus ON fus.symbol = w0.symbol AND fus.ts = w0.ts JOIN lv ON lv.symbol = w0.symbol AND lv."window" = w0."window"),
{SCORING_SQL} SELECT symbol, family, gate, "window", rule_id, trades, {r('score', 'score', 5)}, rank FROM sc"""


def sweep_inputs(feats, minute, step):
    """Bars of `step`, the columns of all cores on them, and their fixed fusion."""
    from barloom.operators.series import by_blocks, number_bars

    bars = stage(number_bars(B.resample(minute, step), step=step), "sweep-bars")
    used = {f for c in R.CORE_RULES.values() for f, _, _ in (*c.entry, *c.exit)} | {FU.FIXED_COLUMNS[f][0] for f in FU.FAMILIES}
    last = B.resample_last(feats, step, sorted(used))
    ret = by_blocks(bars, ["symbol"], lambda df, w: df.withColumn("ret", bar_return(F.col("close"), F.lag("close").over(w))), 1)
    index = ret.select("symbol", "ts", "pos", "ret", "close")
    aligned = stage(B.align_to_index(index, last, sorted(used), 7 * 86_400), "aligned")
    return bars, aligned, stage(FU.fixed_fusion(aligned).select("symbol", "ts", "fusion_score", "confidence"), "fusion")


@query("core_sweep", f"WITH {_core_sweep_sql()}")
def core_sweep(spark, sf):
    """All six feature cores (132 rules) on hourly bars, ungated and gated by the fixed fusion, in every look-back window."""
    from barloom.plans import sweep as S

    bars, aligned, fusion = sweep_inputs(*features_of(spark, sf), "1h")
    cands = S.indicator_sweep(bars, [], "1h", gate=fusion, min_bars=20, features=aligned, cores=sorted({c.core for c in R.CORE_RULES.values()}))
    out = S.score(cands)
    return show(out, ["symbol", "family", "gate", "window", "rule_id", "trades", "rank"], ["score"], 5)
