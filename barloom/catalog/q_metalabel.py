"""Triple-barrier labels and the filter trained on them, for one Bollinger rule on hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import query
from barloom.catalog.common import BARS_1H, hourly, r, show
from barloom.catalog.q_rules import numbered_sql
from barloom.operators.series import by_blocks
from barloom.plans import metalabel as M
from barloom.session import stage

HORIZON, MULT, VOL = 12, 0.05, 14

# Entries: close above the previous close. The barrier events of all of them.
EVENTS_SQL = f"""{numbered_sql(BARS_1H)}, b1 AS (SELECT *, i - 1 AS pos, max(i) OVER (PARTITION BY symbol) - 1 AS lst, tr / (abs(nullif(lag(close) OVER w, 0)) + 1e-12::DOUBLE) AS trr FROM nb WINDOW w AS (PARTITION BY symbol ORDER BY i)),
b2 AS (SELECT *, CASE WHEN count(trr) OVER f >= {VOL // 2} THEN avg(trr) OVER f END AS a0 FROM b1 WINDOW f AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN {VOL - 1} PRECEDING AND CURRENT ROW)),
b3 AS (SELECT *, lag(a0) OVER (PARTITION BY symbol ORDER BY i) AS atr FROM b2), md AS (SELECT symbol, quantile_cont(atr, 0.5) AS mid FROM b3 GROUP BY 1),
en AS (SELECT b3.*, greatest(CASE WHEN atr > 0 THEN atr WHEN mid > 0 THEN mid ELSE 0.001 END, 1e-6) AS vol FROM b3 JOIN md USING (symbol) WHERE d > 0 AND pos < lst - 1),
lv AS (SELECT *, close * (1 + {MULT}::DOUBLE * vol) AS bup, close * greatest(0.01::DOUBLE, 1 - {MULT}::DOUBLE * vol) AS bdn FROM en),
ht AS (SELECT lv.symbol, lv.pos, min(b.pos) AS hit FROM lv JOIN b3 b ON b.symbol = lv.symbol AND b.pos BETWEEN lv.pos + 1 AND lv.pos + {HORIZON} WHERE b.high >= bup OR b.low <= bdn GROUP BY ALL),
ev0 AS (SELECT lv.symbol, lv.ts, lv.pos AS entry_idx, coalesce(hit, least(lst, lv.pos + {HORIZON})) AS exit_idx, vol AS volatility, lv.close AS px, bdn, hit FROM lv LEFT JOIN ht ON ht.symbol = lv.symbol AND ht.pos = lv.pos),
ev1 AS (SELECT ev0.*, b.close / (px + 1e-12::DOUBLE) - 1 - 0.002::DOUBLE AS net_return, b.low AS xlow FROM ev0 JOIN b3 b ON b.symbol = ev0.symbol AND b.pos = exit_idx),
ev AS (SELECT *, CASE WHEN hit IS NOT NULL AND xlow <= bdn THEN 'sl_first' WHEN hit IS NOT NULL THEN 'tp_first' WHEN net_return > 0 THEN 'vertical_pos' ELSE 'vertical_nonpos' END AS provenance FROM ev1),
evl AS (SELECT *, (provenance IN ('tp_first', 'vertical_pos'))::INT AS label FROM ev)"""


def entry_bars(spark, sf):
    def fn(df, w):
        return df.withColumn("entry", F.coalesce(F.col("close") > F.lag("close").over(w), F.lit(False)))

    return stage(by_blocks(hourly(spark, sf), ["symbol"], fn, 1), "entry-bars")


def events_of(spark, sf):
    bars = entry_bars(spark, sf)
    return stage(M.barrier_events(bars, HORIZON, MULT, MULT, VOL), "barrier-events"), bars


@query("barrier_events", f"WITH {EVENTS_SQL} SELECT symbol, ts, entry_idx, exit_idx, {r('volatility', 'volatility', 5)}, {r('net_return', 'net_return')}, provenance, label FROM evl")
def barrier_events(spark, sf):
    ev = M.barrier_events(entry_bars(spark, sf), HORIZON, MULT, MULT, VOL)
    return ev.select("symbol", "ts", "entry_idx", "exit_idx", F.round("volatility", 5).alias("volatility"), F.round("net_return", 6).alias("net_return"), "provenance", "label")


@query("provenance_counts", f"WITH {EVENTS_SQL} SELECT symbol, provenance, count(*) AS events, {r('avg(net_return)', 'avg_net_return')} FROM evl GROUP BY 1, 2")
def provenance_counts(spark, sf):
    return show(M.provenance_counts(events_of(spark, sf)[0]), ["symbol", "provenance", "events"], ["avg_net_return"])


WEIGHTS_SQL = f"""{EVENTS_SQL}, cc AS (SELECT e.symbol, b.pos, count(*) AS c FROM evl e JOIN b3 b ON b.symbol = e.symbol AND b.pos BETWEEN e.entry_idx + 1 AND e.exit_idx GROUP BY ALL),
uw AS (SELECT e.symbol, e.entry_idx, avg(1.0::DOUBLE / c) AS w FROM evl e JOIN cc ON cc.symbol = e.symbol AND cc.pos BETWEEN e.entry_idx + 1 AND e.exit_idx GROUP BY ALL),
wt AS (SELECT *, w / avg(w) OVER (PARTITION BY symbol) AS weight FROM uw)"""


@query("uniqueness_weights", f"WITH {WEIGHTS_SQL} SELECT symbol, entry_idx, {r('weight', 'weight')} FROM wt")
def uniqueness_weights(spark, sf):
    ev, bars = events_of(spark, sf)
    return show(M.uniqueness_weights(ev, bars), ["symbol", "entry_idx"], ["weight"])


_COMBOS = ", ".join(f"({i}, {c})" for i, c in M.fold_table(6, 2, 24))
SPLIT_SQL = f"""{EVENTS_SQL}, eo AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_idx) - 1 AS e, count(*) OVER (PARTITION BY symbol) AS n FROM evl),
gr AS (SELECT *, CASE WHEN e < (n % 6) * (n // 6 + 1) THEN e // (n // 6 + 1) ELSE n % 6 + (e - (n % 6) * (n // 6 + 1)) // (n // 6) END AS grp FROM eo),
fo(fold, test) AS (VALUES {_COMBOS}),
bd AS (SELECT symbol, fold, any_value(test) AS test, min(entry_idx) - 24 AS b0, max(entry_idx) + 24 AS b1 FROM gr JOIN fo ON list_contains(test, grp) GROUP BY 1, 2),
rl AS (SELECT gr.*, fold, CASE WHEN list_contains(bd.test, grp) THEN 'test' WHEN NOT entry_idx BETWEEN b0 AND b1 THEN 'train' END AS role FROM gr JOIN bd USING (symbol)),
rk AS (SELECT * FROM (SELECT *, count(*) FILTER (role = 'train') OVER (PARTITION BY symbol, fold) AS nt FROM rl WHERE role IS NOT NULL) WHERE nt >= 10)"""


def split_rows(events):
    return M.cpcv_rows(events, 6, 2, gap=24)


@query("cpcv_splits", f"WITH {SPLIT_SQL} SELECT symbol, fold, role, count(*) AS events, min(entry_idx) AS first_idx, max(entry_idx) AS last_idx, sum(label)::BIGINT AS positives FROM rk GROUP BY 1, 2, 3")
def cpcv_splits(spark, sf):
    rows = split_rows(events_of(spark, sf)[0])
    return rows.groupBy("symbol", "fold", "role").agg(
        F.count("*").alias("events"), F.min("entry_idx").alias("first_idx"), F.max("entry_idx").alias("last_idx"), F.sum("label").alias("positives"))


# one plain feature, one that is constant in training but not in test, one with gaps, one that is always missing
_X = {"x": "volatility", "flat": "CASE WHEN role = 'train' THEN 2.0 ELSE 2.5 END", "gaps": "CASE WHEN entry_idx % 3 > 0 THEN volatility END", "none": "CAST(NULL AS DOUBLE)"}
_UNIT = {c: f"coalesce(({c} - m_{c}) / CASE WHEN s_{c} < 1e-9 THEN 1 ELSE s_{c} END, 0)" for c in _X}


@query("standardised", f"""WITH {SPLIT_SQL}, fx AS (SELECT *, {', '.join(f'CAST({v} AS DOUBLE) AS "{k}"' for k, v in _X.items())} FROM rk),
st AS (SELECT symbol, fold, {', '.join(f"avg({c}) FILTER (role = 'train') AS m_{c}, stddev_pop({c}) FILTER (role = 'train') AS s_{c}" for c in _X)} FROM fx GROUP BY 1, 2)
SELECT symbol, fold, role, {', '.join(f"{r(f'avg({u})', f'mean_{c}')}, {r(f'max({u})', f'max_{c}')}" for c, u in _UNIT.items())} FROM fx JOIN st USING (symbol, fold) GROUP BY 1, 2, 3""")
def standardised(spark, sf):
    rows = split_rows(events_of(spark, sf)[0]).withColumns({k: F.expr(f"CAST({v} AS DOUBLE)") for k, v in _X.items()})
    out = M.standardise(rows, list(_X), ["symbol", "fold"])
    return out.groupBy("symbol", "fold", "role").agg(*[a for c in _X for a in (F.round(F.avg(c), 6).alias(f"mean_{c}"), F.round(F.max(c), 6).alias(f"max_{c}"))])


# A score that both engines can compute: how small the bar's volatility is.
_PROB = "round(1 / (1 + volatility / 100), 4)"
_GRID = M.threshold_grid(0.05, 0.95, 0.05)
_G = ", ".join(repr(t) for t in _GRID)


def scored(spark, sf):
    return events_of(spark, sf)[0].withColumn("prob", F.expr("round(1 / (1 + volatility / 100), 4)"))


@query("threshold_scan", f"""WITH {EVENTS_SQL}, sp AS (SELECT symbol, label, {_PROB} AS prob FROM evl), th AS (SELECT symbol, t AS threshold, count(*) FILTER (label = 1 AND prob >= t) AS tp,
 count(*) FILTER (label = 0 AND prob >= t) AS fp, count(*) FILTER (label = 1 AND prob < t) AS fn FROM sp, (SELECT unnest([{_G}]::DOUBLE[]) AS t) GROUP BY 1, 2),
pm AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM th),
fb AS (SELECT *, CASE WHEN p > 0 OR rc > 0 THEN 2 * p * rc / (p + rc + 1e-12) ELSE 0 END AS f1, CASE WHEN p > 0 OR rc > 0 THEN 1.25 * p * rc / (0.25 * p + rc + 1e-12) ELSE 0 END AS f05 FROM pm),
ok AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(f05, 10) DESC, round(p, 10) DESC, threshold DESC) AS rn, count(*) OVER (PARTITION BY symbol) AS vc FROM fb WHERE p >= 0.2)
SELECT s.symbol, coalesce(vc, 0) AS valid_count, {r('threshold', 'threshold')}, {r('p', 'precision')}, {r('rc', 'recall')}, {r('f1', 'f1')}, {r('f05', 'f05')}, ok.symbol IS NULL AS veto_all
FROM (SELECT DISTINCT symbol FROM sp) s LEFT JOIN ok ON ok.symbol = s.symbol AND rn = 1""")
def threshold_scan(spark, sf):
    out = M.threshold_scan(scored(spark, sf), ["symbol"], _GRID, floor=0.2)
    return show(out, ["symbol", "valid_count", "veto_all"], ["threshold", "precision", "recall", "f1", "f05"])


@query("average_precision", f"""WITH {EVENTS_SQL}, sp AS (SELECT symbol, {_PROB} AS prob, sum(label) AS p, count(*) AS n FROM evl GROUP BY 1, 2),
cu AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen, sum(p) OVER (PARTITION BY symbol) AS al FROM sp WINDOW w AS (PARTITION BY symbol ORDER BY prob DESC))
SELECT symbol, {r('coalesce(sum(CASE WHEN al > 0 THEN p / al * tp / seen END), 0)', 'pr_auc')} FROM cu GROUP BY 1""")
def average_precision(spark, sf):
    return show(M.average_precision(scored(spark, sf), ["symbol"]), ["symbol"], ["pr_auc"])


FEATURES = ["x_ret", "x_vol", "x_range"]


def _fitted(spark, sf):
    ev, bars = events_of(spark, sf)

    def fn(df, w):
        prev = F.lag("close").over(w)
        return df.select("*", F.ln(F.col("close") / prev).alias("x_ret"), F.log1p("volume").alias("x_vol"), F.log1p((F.col("high") - F.col("low")) / F.col("close")).alias("x_range"))

    x = by_blocks(bars, ["symbol"], fn, 1).select("symbol", F.col("pos").alias("entry_idx"), *FEATURES)
    weighted = M.uniqueness_weights(ev, bars).join(x, ["symbol", "entry_idx"])
    rows = stage(M.standardise(split_rows(weighted), FEATURES, ["symbol", "fold"]), "fold-rows")
    beta = M.fit_folds(rows, FEATURES, ["symbol", "fold"])
    return ev, stage(M.score_folds(rows, beta, FEATURES, ["symbol", "fold"]), "scored"), beta, rows


@query("meta_fold_report")
def meta_fold_report(spark, sf):
    """Logistic filter of every fold: threshold, precision, recall, average precision, veto."""
    _, sc, *_ = _fitted(spark, sf)
    return M.fold_report(sc, ["symbol", "fold"], M.threshold_grid(), 0.6)


@query("meta_veto")
def meta_veto(spark, sf):
    """Entries that pass the filter, per symbol."""
    ev, sc, *_ = _fitted(spark, sf)
    mean = M.mean_probability(sc, ["symbol", "entry_idx"])
    kept = M.veto(ev, sc, M.threshold_scan(mean, ["symbol"], _GRID, 0.3), ["symbol"])
    n = ev.groupBy("symbol").agg(F.count("*").alias("events"))
    return n.join(kept.groupBy("symbol").agg(F.count("*").alias("kept")), "symbol", "left").select("symbol", "events", F.coalesce("kept", F.lit(0)).alias("kept"))


@query("meta_summary")
def meta_summary(spark, sf):
    """Counts and medians over the fold reports, one row in all."""
    from barloom.plans.validate import meta_summary as summary

    _, sc, *_ = _fitted(spark, sf)
    rep = M.fold_report(sc, ["symbol", "fold"], M.threshold_grid(), 0.6)
    rows = rep.select("*", F.lit(True).alias("meta_enabled"), F.col("samples").alias("events"), F.lit(0.6).alias("precision_floor"))
    return summary(rows)


@query("meta_optimality", f"WITH {SPLIT_SQL}, k AS (SELECT symbol, fold, count(*) FILTER (role = 'train' AND label = 0) AS a, count(*) FILTER (role = 'train' AND label = 1) AS b,"
       " count(*) FILTER (role = 'test' AND label = 0) AS c, count(*) FILTER (role = 'test' AND label = 1) AS d FROM rk GROUP BY 1, 2)"
       " SELECT symbol, fold, true AS converged, CAST(0 AS DOUBLE) + 0 AS slope FROM k WHERE least(a, b, c, d) > 0")
def meta_optimality(spark, sf):
    """How far each fold is from the optimum: the largest violation of the optimality conditions of the
    penalised loss, computed anew from the training rows. Zero to six digits at the optimum."""
    ev, _, beta, rows = _fitted(spark, sf)
    c, names = 0.25, FEATURES
    y = F.col("label")
    per = rows.where("role = 'train'")
    kinds = per.groupBy("symbol", "fold").agg(F.count_if(y == 1).alias("n1"), F.count_if(y == 0).alias("n0"))
    t = per.join(kinds, ["symbol", "fold"]).join(beta, ["symbol", "fold"])
    w = F.col("weight") * (F.col("n0") + F.col("n1")) / (2.0 * F.when(y == 1, F.col("n1")).otherwise(F.col("n0")))
    z = F.get("beta", F.lit(len(names)))
    for i, f in enumerate(names):
        z = z + F.get("beta", F.lit(i)) * F.col(f)
    e = w * (1.0 / (1.0 + F.exp(-z)) - y)
    g = t.groupBy("symbol", "fold").agg(F.first("beta").alias("beta"), F.first("converged").alias("converged"), F.array(*[c * F.sum(e * v) for v in [*map(F.col, names), F.lit(1.0)]]).alias("g"))
    off = []
    for i in range(len(names)):
        b, s_ = F.get("beta", F.lit(i)), F.get("g", F.lit(i))
        off.append(F.when(b == 0, F.greatest(F.abs(s_) - 1.0, F.lit(0.0))).otherwise(F.abs(s_ + F.signum(b))))
    return g.select("symbol", "fold", "converged", (F.round(F.greatest(*off, F.abs(F.get("g", F.lit(len(names))))), 6) + 0.0).alias("slope"))


@query("meta_coefficients")
def meta_coefficients(spark, sf):
    """Coefficients of every fold: size and sign per feature."""
    _, _, beta, _ = _fitted(spark, sf)
    named = F.arrays_zip(F.array(*[F.lit(f) for f in FEATURES]).alias("feature"), F.slice("beta", 1, len(FEATURES)).alias("coef"))
    each = beta.select("symbol", "fold", F.explode(named).alias("c")).select("symbol", "fold", "c.feature", "c.coef")
    return each.groupBy("symbol", "feature").agg(F.count("*").alias("folds"), F.avg("coef").alias("avg_coef"), F.avg((F.col("coef") > 0).cast("int")).alias("positive_share"))
