"""Validation of the sweep's winners: folds, overfit and friction tests, scores, deploy pool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import clip, clip01
from barloom.operators.series import BLOCK_ROWS, by_blocks, look_up
from barloom.plans import backtest as BT
from barloom.plans.metalabel import FilterConfig, entry_filter
from barloom.session import stage

MIN_FOLD_ROWS = 20
STRESS_BPS = (10, 20, 30)
# Limits per strictness (walk-forward, purged folds, PBO at most, DSR, friction, final score).
STRICTNESS = {
    "recovery": (0.35, 0.30, 0.60, -1.80, 0.15, 0.30),
    "institutional": (0.50, 0.45, 0.75, -2.00, 0.00, 0.45),
    "balanced": (0.50, 0.45, 0.35, -0.25, 0.35, 0.45),
    "fast": (0.40, 0.35, 0.50, -0.50, 0.25, 0.35),
}
WINDOW_ORDER = ("all", "360d", "90d", "30d")


# --- sampled series and folds -----------------------------------------------------------------


def sampled_windows(bars: DataFrame, windows: DataFrame, step: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Every `step`-th bar of each (symbol, window) and its last one, renumbered from 0 as `idx` of `n`.

    Positions are arithmetic on the dense bar number. `ret` is the change since the bar sampled
    before.
    """
    span = windows.select("symbol", "window", "start_ts", "window_bars")
    first = bars.join(span.withColumnRenamed("start_ts", "ts"), ["symbol", "ts"]).groupBy("symbol").agg(F.collect_list(F.struct("window", F.col("pos").alias("_p0"), "window_bars")).alias("_ws"))  # four windows at most
    inside = look_up(bars, first, ["symbol"], F.col("pos")).withColumn("_w", F.explode("_ws")).where(F.col("pos") >= F.col("_w._p0"))
    inside = inside.withColumns({"window": F.col("_w.window"), "window_bars": F.col("_w.window_bars"), "_p": F.col("pos") - F.col("_w._p0")})
    last = F.col("window_bars") - 1
    kept = inside.where((F.col("_p") % step == 0) | (F.col("_p") == last))
    idx = F.ceil(F.col("_p") / step)
    numbered = kept.select("symbol", "window", "ts", F.col("pos").alias("bar"), "close", idx.alias("pos"), (F.ceil(last / step) + 1).alias("n"))

    def returns(df: DataFrame, w) -> DataFrame:
        return df.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1.0)

    out = by_blocks(numbered, ["symbol", "window"], returns, back=1, rows=rows)
    return out.withColumnRenamed("pos", "idx").withColumnRenamed("bar", "pos")


def with_folds(rows: DataFrame, folds: int, purge: int = 0) -> DataFrame:
    """Fold number of each row: equal parts of the n rows, `purge` rows cut from both ends of each."""
    idx, n = F.col("idx"), F.col("n")
    fold = F.floor(((idx + 1) * folds - 1) / n)
    lo, hi = F.floor(fold * n / folds) + purge, F.floor((fold + 1) * n / folds) - purge
    return rows.withColumn("fold", fold).where((idx >= lo) & (idx < hi) & (hi - lo >= MIN_FOLD_ROWS))


def fold_alphas(signals: DataFrame, keys: Sequence[str], folds: int, purge: int = 0, bps: float = 10.0) -> DataFrame:
    """Net return over buy-and-hold of every fold, each backtested from a flat start."""
    keys = list(keys)
    cut = with_folds(signals, folds, purge)
    m = BT.rule_metrics(cut, [*keys, "fold"], bps).select(*keys, "fold", "net_return", "trades")
    hold = cut.groupBy(*keys, "fold").agg(BT.hold_return().alias("hold_return"), F.count("*").alias("fold_rows"))
    return m.join(hold, [*keys, "fold"]).withColumn("alpha", F.col("net_return") - F.col("hold_return"))


def fold_summary(alphas: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """Share of folds that beat holding, and the median margin."""
    return alphas.groupBy(*keys).agg(
        F.avg((F.col("alpha") >= 0).cast("int")).alias(f"{prefix}_pass_rate"), F.percentile("alpha", F.lit(0.5)).alias(f"{prefix}_alpha_median"),
        F.count("*").alias(f"{prefix}_folds"),
    )


def overfit_share(alphas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PBO: share of all folds whose margin is not positive."""
    return alphas.groupBy(*keys).agg(F.avg((F.col("alpha") <= 0).cast("int")).alias("pbo"))


def friction_stress(signals: DataFrame, keys: Sequence[str], bps: Sequence[int] = STRESS_BPS) -> DataFrame:
    """Net return at each cost level, and how well it holds up."""
    keys = list(keys)
    levels = signals.withColumn("bps", F.explode(F.array(*[F.lit(float(b)) for b in sorted(set(bps))])))
    positions = BT.with_positions(levels, [*keys, "bps"])
    piece = stage(BT.pieces(BT.with_returns(positions, F.col("bps")), [*keys, "bps"]), "friction-pieces")
    m = BT.metrics_of_pieces(piece, [*keys, "bps"])
    ends = m.groupBy(*keys).agg(
        F.min_by("net_return", "bps").alias("first"), F.max_by("net_return", "bps").alias("last"),
        F.sort_array(F.collect_list(F.struct("bps", "net_return"))).alias("_levels"),
    )
    return ends.select(*keys, robustness(F.col("first"), F.col("last")).alias("friction"), F.transform("_levels", lambda s: s["net_return"]).alias("net_by_bps"))


def robustness(first: Column, last: Column) -> Column:
    flat = F.when(last >= first, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(last - first) / 0.10))
    return F.when(F.abs(first) < 1e-9, flat).otherwise(clip01(1.0 - F.greatest(F.lit(0.0), first - last) / F.abs(first)))


# --- scores -----------------------------------------------------------------------------------


def deflated_sharpe(trade_sharpe: Column, trials: Column, trades: Column) -> Column:
    return trade_sharpe - F.sqrt(2.0 * F.ln(F.greatest(F.lit(2), trials)) / F.greatest(F.lit(1), trades))


def complexity_penalty(n_params: Column, rule_key: Column, gate: Column) -> Column:
    by_params = F.least(F.lit(1.0), n_params / 8.0)
    by_name = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.length(rule_key) - 8) / 24.0))
    return F.least(F.lit(1.0), 0.7 * by_params + 0.2 * by_name + 0.1 * F.when(gate == "gated", 0.5).otherwise(0.35))


def score_pack(rows: DataFrame) -> DataFrame:
    """Transferability, credibility and final score from the validation columns."""
    signal = (clip((F.col("wf_alpha_median") + F.col("cv_alpha_median")) / 2.0 / 0.1, -1.0, 1.0) + 1.0) / 2.0
    steady = clip01(1.0 - F.abs(F.least(F.col("max_drawdown"), F.lit(0.0))) / 0.35)
    enough = F.least(F.lit(1.0), F.col("trades") / F.greatest(F.col("trade_floor"), F.lit(1)))
    out = rows.withColumns(
        {
            "transferability": clip01(0.4 * F.col("wf_pass_rate") + 0.35 * F.col("cv_pass_rate") + 0.25 * signal),
            "alpha_quality": clip01((F.col("alpha") + 0.05) / 0.2),
            "credibility": clip01(0.4 * enough + 0.25 * (1.0 - F.col("pbo")) + 0.2 * clip01((F.col("dsr") + 1.0) / 2.0) + 0.15 * steady),
        }
    )
    final = 0.4 * F.col("transferability") + 0.3 * F.col("credibility") + 0.2 * clip01(F.col("friction")) - 0.1 * F.col("complexity_penalty")
    return out.withColumn("final_score", clip01(final))


def failed_reasons(strictness: str) -> Column:
    """Names of the limits a row misses."""
    if strictness not in STRICTNESS:
        raise ValueError(f"unknown strictness: {strictness}")
    wf, cv, pbo, dsr, friction, final = STRICTNESS[strictness]
    tests = [
        (F.col("wf_pass_rate") < wf, "walk_forward"), (F.col("cv_pass_rate") < cv, "purged_cv"), (F.col("pbo") > pbo, "pbo"),
        (F.col("dsr") < dsr, "dsr"), (F.col("friction") < friction, "friction"), (F.col("final_score") < final, "final_score"),
    ]
    return F.filter(F.array(*[F.when(t, name) for t, name in tests]), lambda x: x.isNotNull())


def validation_rows(winners: DataFrame, signals: DataFrame, keys: Sequence[str], trials: DataFrame, strictness: str = "balanced",
                    splits: int = 4, folds: int = 4, purge: int = 120, bps: float = 10.0) -> DataFrame:
    """Full validation of one rule per (symbol, window, ...) key.

    `winners` carries the sweep's metrics, `signals` the sampled signal rows of just those rules,
    `trials` the number of candidates each set evaluated.
    """
    keys = list(keys)
    signals = stage(signals, "sampled-signals")
    sampled = BT.rule_metrics(signals, keys, bps).select(*keys, "trade_sharpe")
    wf = stage(fold_alphas(signals, keys, splits, 0, bps), "walk-forward")
    cv = stage(fold_alphas(signals, keys, folds, purge, bps), "purged-folds")
    pbo = overfit_share(wf.select(*keys, "alpha").unionByName(cv.select(*keys, "alpha")), keys)
    out = winners.drop("trade_sharpe").join(sampled, keys)
    for part in (fold_summary(wf, keys, "wf"), fold_summary(cv, keys, "cv"), pbo, friction_stress(signals, keys)):
        out = out.join(part, keys, "left")
    out = out.join(trials, [k for k in trials.columns if k != "trials"], "left")
    zero = F.lit(0.0)
    out = out.withColumns({c: F.coalesce(c, zero) for c in ("wf_pass_rate", "wf_alpha_median", "cv_pass_rate", "cv_alpha_median", "friction")})
    out = out.withColumns(
        {
            "pbo": F.coalesce("pbo", F.lit(1.0)),
            "dsr": deflated_sharpe(F.col("trade_sharpe"), F.coalesce("trials", F.lit(1)), F.col("trades")),
            "complexity_penalty": complexity_penalty(F.col("n_params"), F.col("rule_key"), F.col("gate")),
        }
    )
    out = score_pack(out).withColumn("failed_reasons", failed_reasons(strictness))
    return out.withColumn("passes", F.size("failed_reasons") == 0)


def sampled_rows(rows: DataFrame, keys: Sequence[str], step: int, block: int = BLOCK_ROWS) -> DataFrame:
    """Every `step`-th of the rows `pos` = 0 .. n - 1 of a key and its last one, as `idx` of a new `n`, with new `ret`."""
    keys, last = list(keys), F.col("n") - 1
    kept = rows.where((F.col("pos") % step == 0) | (F.col("pos") == last))
    cut = kept.select(*keys, "ts", "seg", "close", "entry", "exit", F.ceil(F.col("pos") / step).alias("pos"), (F.ceil(last / step) + 1).alias("n"))
    out = by_blocks(cut, keys, lambda df, w: df.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1.0), 1, rows=block)
    return out.withColumnRenamed("pos", "idx")


def filtered_validation(winners: DataFrame, rows: DataFrame, columns: Sequence[str], keys: Sequence[str], trials: DataFrame, cfg: FilterConfig = FilterConfig(),
                        step: int = 6, strictness: str = "balanced", splits: int = 4, folds: int = 4, purge: int = 120, bps: float = 10.0) -> DataFrame:
    """Validation of each winner with its own entry filter: only kept entries reach metrics, folds and friction.

    rows: every bar of each winner's window: keys, ts, seg, pos (dense from 0), n, high, low, close, ret,
    entry, exit and the feature columns. winners: the sweep's rows with `hold_return` and `trade_floor`;
    their return, trades, win rate, drawdown and margin are measured anew on the kept entries. A key
    whose filter vetoes everything fails with a reason of its own.
    """
    keys = list(keys)
    rows = stage(rows, "winner-rows")
    kept, report = entry_filter(rows, columns, keys, cfg)
    rows = rows.join(kept.withColumn("_kept", F.lit(True)), [*keys, "pos"], "left")
    rows = stage(rows.withColumn("raw_entry", F.col("entry")).withColumn("entry", F.col("entry") & F.coalesce("_kept", F.lit(False))).drop("_kept"), "filtered-rows")
    counts = rows.groupBy(*keys).agg(F.count_if("raw_entry").alias("entries_raw"), F.count_if("entry").alias("entries_kept"))
    m = BT.rule_metrics(rows, keys, bps).select(*keys, "total_return", "net_return", "max_drawdown", "win_rate", "trades")
    own = winners.drop("total_return", "net_return", "max_drawdown", "win_rate", "trades", "alpha", "beats_hold").join(m, keys)
    own = own.withColumn("alpha", F.col("net_return") - F.col("hold_return"))
    out = validation_rows(own, sampled_rows(rows, keys, step), keys, trials, strictness, splits, folds, purge, bps)
    report = report.select(*keys, "events", "positive", "threshold", "valid_count", "precision", "veto_all", "reason")
    return with_meta_veto(out, report, keys).join(report, keys, "left").join(counts, keys)


def light_validation(candidates: DataFrame, strictness: str = "balanced") -> DataFrame:
    """Validation from summary metrics alone: the whole window stands in for every fold."""
    won = (F.col("alpha") >= 0).cast("double")
    rows = candidates.withColumns(
        {
            "wf_pass_rate": won, "cv_pass_rate": won, "wf_alpha_median": F.col("alpha"), "cv_alpha_median": F.col("alpha"),
            "pbo": 1.0 - won, "dsr": F.col("trade_sharpe"), "friction": F.lit(1.0),
            "complexity_penalty": complexity_penalty(F.col("n_params"), F.col("rule_key"), F.col("gate")),
        }
    )
    out = score_pack(rows).withColumn("failed_reasons", failed_reasons(strictness))
    return out.withColumn("passes", F.size("failed_reasons") == 0)


def with_meta_veto(rows: DataFrame, meta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose meta-label filter vetoes every entry fail, with a reason of their own.

    `meta` has one row per key with a filter (`veto_all`); keys without one keep their result.
    """
    keys = list(keys)
    joined = rows.join(meta.select(*keys, F.col("veto_all").alias("_veto")), keys, "left")
    vetoed = F.coalesce("_veto", F.lit(False))
    reasons = F.when(vetoed, F.array_append("failed_reasons", F.lit("meta_precision_floor"))).otherwise(F.col("failed_reasons"))
    return joined.withColumn("failed_reasons", reasons).withColumn("passes", F.col("passes") & ~vetoed).drop("_veto")


# --- summaries and selection ------------------------------------------------------------------


def summaries(rows: DataFrame) -> DataFrame:
    """Totals by gate and by window in one pass."""
    g = rows.groupingSets([["gate"], ["window"]], "gate", "window").agg(
        F.count("*").alias("total"), F.count_if("passes").alias("passed"), F.avg("final_score").alias("avg_final_score"),
        F.avg("alpha").alias("avg_alpha"), F.grouping("gate").alias("_by_window"),
    )
    return g.select(
        F.when(F.col("_by_window") == 1, "window").otherwise("gate").alias("dimension"), F.coalesce("gate", "window").alias("value"),
        "total", "passed", (F.col("passed") / F.col("total")).alias("pass_rate"), "avg_final_score", "avg_alpha",
    )


def filter_results(rows: DataFrame, gates: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """The caller's own selection: gate modes and a maximum number of rows, best score first."""
    out = rows.where(F.col("gate").isin(list(gates))) if gates else rows
    return out.orderBy(F.desc("final_score"), "symbol", "window", "rule_id").limit(limit) if limit else out


def deploy_pool(rows: DataFrame, per_symbol: int = 2) -> DataFrame:
    """Rules to deploy: distinct (core, window) first, then fill up to `per_symbol`."""
    passed = rows.where("passes AND alpha >= 0")
    same = Window.partitionBy("symbol", "family", "rule_id", "gate").orderBy(F.desc(F.round("final_score", 9)), "window")
    best = passed.withColumn("_rn", F.row_number().over(same)).where("_rn = 1").drop("_rn")
    window_at = F.array_position(F.array(*[F.lit(w) for w in WINDOW_ORDER]), F.col("window"))
    order = [F.desc(F.col("gate") == "gated"), window_at, F.desc(F.round("final_score", 9)), F.desc(F.round("friction", 9)), F.col("rule_id")]
    ranked = best.withColumn("_rank", F.row_number().over(Window.partitionBy("symbol").orderBy(*order)))
    first = F.row_number().over(Window.partitionBy("symbol", "family", "window").orderBy("_rank")) == 1
    pick = Window.partitionBy("symbol").orderBy(F.desc("_first"), "_rank")
    out = ranked.withColumn("_first", first).withColumn("deploy_rank", F.row_number().over(pick))
    return out.where(F.col("deploy_rank") <= per_symbol).drop("_rank", "_first")


def failure_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("failed_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


def trades_by_window(rows: DataFrame) -> DataFrame:
    return rows.groupBy("window").agg(F.count("*").alias("rows"), F.sum("trades").alias("trades_total"), F.avg("trades").alias("trades_avg"))


def top_rows(rows: DataFrame, by: str, n: int = 8) -> DataFrame:
    """The `n` best rows of the whole table (a report's own cut)."""
    return rows.orderBy(F.desc(F.round(by, 9)), "symbol", "window", "rule_id").limit(n)


def readiness(rows: DataFrame, pool: DataFrame) -> DataFrame:
    """One line: how many rows passed, what is deployed, whether a rerun is needed."""
    a = rows.agg(F.count("*").alias("candidates_total"), F.count_if("passes").alias("candidates_passed"))
    b = pool.agg(F.count_distinct("symbol").alias("deploy_symbols"), F.count("*").alias("deploy_rules"))
    return a.join(b).withColumn("deploy_ready", (F.col("candidates_passed") > 0) & (F.col("deploy_rules") > 0))


def meta_summary(rows: DataFrame) -> DataFrame:
    """Counts, rates and medians over the rows that have a meta-label."""
    on = F.col("meta_enabled")
    med = lambda c: F.coalesce(F.percentile(F.when(on, F.col(c)), F.lit(0.5)), F.lit(0.0)).alias(f"{c}_median")
    return rows.agg(
        F.count("*").alias("rows_total"), F.count_if(on).alias("rows_with_meta"), F.coalesce(F.sum(F.when(on, F.col("events"))), F.lit(0)).alias("events_total"),
        F.count_if(on & F.col("veto_all")).alias("veto_all_count"),
        (F.count_if(on & F.col("veto_all")) / F.greatest(F.count_if(on), F.lit(1))).alias("veto_all_rate"),
        F.coalesce(F.max(F.when(on, F.col("precision_floor"))), F.lit(0.0)).alias("precision_floor"),
        *[med(c) for c in ("precision", "recall", "f1", "f05", "pr_auc")],
    )
