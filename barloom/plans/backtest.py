"""Backtests of long signal tables (keys, seg, ts, entry, exit, ret).

A key is one (symbol, window, rule, ...). Its rows are cut into time segments `seg`. Positions,
equity and trades need the state at the start of a segment; that state comes from one summary row
per segment, so a long history is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import EPS, clip01
from barloom.operators.quantiles import exact_quantiles
from barloom.operators.series import before, carried
from barloom.session import stage

BARS_PER_YEAR = 525_600


def hold_return(close: str = "close", ts: str = "ts") -> Column:
    """Buy and hold from first to last bar, an aggregate."""
    first, last = F.min_by(close, ts), F.max_by(close, ts)
    return F.when((F.count("*") < 2) | (F.abs(first) < EPS), 0.0).otherwise(last / first - 1.0)


def with_positions(signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Position after each bar: more entries than exits so far. Surplus exits must be repaid."""
    keys = list(keys)
    src = signals.withColumn("_step", F.col("entry").cast("int") - F.col("exit").cast("int"))
    totals = src.groupBy(*keys, "seg").agg(F.sum("_step").alias("_t"))
    bases = totals.select(*keys, "seg", F.coalesce(F.sum("_t").over(before(keys, ["seg"])), F.lit(0)).alias("_base"))
    w = Window.partitionBy(*keys, "seg").orderBy("ts")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = src.join(carried(bases), [*keys, "seg"]).withColumn("held", (F.col("_base") + F.sum("_step").over(upto)) > 0)
    return out.withColumn("was_held", F.coalesce(F.lag("held").over(w), F.col("_base") > 0)).drop("_step", "_base")


def with_returns(positions: DataFrame, bps: float | Column = 10.0) -> DataFrame:
    """Bar returns before and after turnover cost."""
    cost = (bps if isinstance(bps, Column) else F.lit(float(bps))) / 10_000.0
    gross = F.when(F.col("was_held"), F.coalesce("ret", F.lit(0.0))).otherwise(0.0)
    turn = F.when(F.col("held") != F.col("was_held"), cost).otherwise(0.0)
    return positions.withColumn("gross", gross).withColumn("net", gross - turn)


def _inside(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equity, its peak and the run number, counted from the start of the segment."""
    upto = Window.partitionBy(*keys, "seg").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select(
        "*",
        F.product(1.0 + F.col("net")).over(upto).alias("_eq"),
        F.sum((F.col("held") & ~F.col("was_held")).cast("int")).over(upto).alias("_run"),
    )
    return out.withColumn("_peak", F.max("_eq").over(upto))


def pieces(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (key, segment, run): a run is a trade, or its part in the segment, and the flat bars after it."""
    held = F.col("held")
    return (
        _inside(rows, keys)
        .groupBy(*keys, "seg", F.col("_run").alias("run"))
        .agg(
            F.product(1.0 + F.col("net")).alias("growth"),
            F.product(1.0 + F.col("gross")).alias("gross_growth"),
            F.min("_eq").alias("lo"), F.max("_eq").alias("hi"), F.min(F.col("_eq") / F.col("_peak") - 1.0).alias("worst"),
            F.product(F.when(held, 1.0 + F.col("net"))).alias("trade_growth"),
            F.sum(F.when(held, F.col("net"))).alias("trade_pnl"),
            F.count_if(held).alias("held_bars"),
            F.min(F.when(held, F.col("ts"))).alias("start_ts"), F.max(F.when(held, F.col("ts"))).alias("end_ts"),
            F.count("*").alias("n"), F.avg("net").alias("mean"), F.var_pop("net").alias("var"),
        )
    )


def _segments(piece: DataFrame, keys: Sequence[str]) -> DataFrame:
    seg = piece.groupBy(*keys, "seg").agg(
        F.product("growth").alias("growth"), F.product("gross_growth").alias("gross_growth"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("worst").alias("worst"), F.max("run").alias("starts"),
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s1"),
        F.sum(F.col("n") * (F.col("var") + F.col("mean") * F.col("mean"))).alias("s2"),
    )
    prior = before(keys, ["seg"])
    out = seg.select(
        "*", F.coalesce(F.product("growth").over(prior), F.lit(1.0)).alias("e0"),
        F.coalesce(F.sum("starts").over(prior), F.lit(0)).alias("base"),
    )
    return out.withColumn("m0", F.max(F.col("e0") * F.col("hi")).over(prior))


def equity_curve(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equity and drawdown of every bar. The running peak starts at the first equity value."""
    keys = list(keys)
    seg = _segments(pieces(rows, keys), keys).select(*keys, "seg", "e0", "m0")
    out = _inside(rows, keys).join(carried(seg), [*keys, "seg"])
    equity = F.col("e0") * F.col("_eq")
    peak = F.greatest(F.col("m0"), F.col("e0") * F.col("_peak"))
    return out.select(*rows.columns, equity.alias("equity"), (equity / peak - 1.0).alias("drawdown"))


def trades(piece: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per trade; parts of a trade in neighbouring segments share its number."""
    keys = list(keys)
    seg = _segments(piece, keys).select(*keys, "seg", "base")
    parts = piece.where("held_bars > 0").join(carried(seg), [*keys, "seg"])
    return parts.groupBy(*keys, (F.col("base") + F.col("run")).alias("trade_id")).agg(
        (F.product("trade_growth") - 1.0).alias("trade_return"), F.sum("trade_pnl").alias("pnl"),
        F.sum("held_bars").alias("bars"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"),
    )


def rule_metrics(signals: DataFrame, keys: Sequence[str], bps: float | Column = 10.0) -> DataFrame:
    """Gross and net return, drawdown, win rate, trades, Sharpe and trade Sharpe per key.

    The rule x bar rows are passed once; what is staged is one row per trade and segment.
    """
    keys = list(keys)
    piece = stage(pieces(with_returns(with_positions(signals, keys), bps), keys), "pieces")
    return metrics_of_pieces(piece, keys)


def metrics_of_pieces(piece: DataFrame, keys: Sequence[str]) -> DataFrame:
    seg = _segments(piece, keys)
    dd = F.least(F.col("worst"), F.when(F.col("m0").isNotNull(), F.col("e0") * F.col("lo") / F.col("m0") - 1.0))
    curve = seg.groupBy(*keys).agg(
        (F.product("gross_growth") - 1.0).alias("total_return"), (F.product("growth") - 1.0).alias("net_return"),
        F.min(dd).alias("max_drawdown"), F.sum("n").alias("bars"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"),
    )
    t = trades(piece, keys).groupBy(*keys).agg(
        F.count("*").alias("trades"), F.avg((F.col("trade_return") > 0).cast("int")).alias("win_rate"),
        F.avg("trade_return").alias("tm"), F.stddev_pop("trade_return").alias("ts"),
    )
    mean = F.col("s1") / F.col("bars")
    std = F.sqrt(F.greatest(F.col("s2") / F.col("bars") - mean * mean, F.lit(0.0)))
    zero = F.lit(0.0)
    return curve.join(t, keys, "left").select(
        *keys, "total_return", "net_return", "max_drawdown", F.coalesce("win_rate", zero).alias("win_rate"),
        F.coalesce("trades", F.lit(0)).alias("trades"), "bars",
        F.when(std > EPS, mean / std * BARS_PER_YEAR**0.5).otherwise(0.0).alias("sharpe"),
        F.coalesce(F.when(F.col("ts") > EPS, F.col("tm") / F.col("ts") * F.sqrt("trades")), zero).alias("trade_sharpe"),
    )


def trade_samples(trade: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Worst, median-nearest and best trade of each key (earliest on ties)."""
    keys = list(keys)
    trade = stage(trade, "trades")
    mid = exact_quantiles(trade, keys, {"_mid": ("pnl", 0.5)})
    t = trade.join(mid, keys)
    row = F.struct("trade_id", "start_ts", "end_ts", "pnl", "bars")
    picked = t.groupBy(*keys).agg(
        F.min_by(row, F.struct("pnl", "trade_id")).alias("worst_trade"),
        F.min_by(row, F.struct(F.abs(F.col("pnl") - F.col("_mid")), F.col("pnl"), F.col("trade_id"))).alias("median_trade"),
        F.max_by(row, F.struct("pnl", "trade_id")).alias("best_trade"),
    )
    kinds = ("worst_trade", "median_trade", "best_trade")
    each = picked.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("t")) for k in kinds])).alias("s"))
    return each.select(*keys, "s.type", "s.t.*")


def signal_frequency(signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries per weekday class, UTC session and hour of day."""
    e = signals.where("entry").withColumn("_h", F.hour("ts"))
    weekend = F.dayofweek("ts").isin(1, 7)
    return e.groupBy(*keys).agg(
        F.count("*").alias("total_entries"), F.count_if(~weekend).alias("weekday_entries"), F.count_if(weekend).alias("weekend_entries"),
        F.count_if(F.col("_h") < 8).alias("asia_00_08"), F.count_if(F.col("_h").between(8, 15)).alias("europe_08_16"),
        F.count_if(F.col("_h") >= 16).alias("us_16_24"),
        F.array(*[F.count_if(F.col("_h") == h) for h in range(24)]).alias("hourly_entries"),
    )


# --- scoring expressions ----------------------------------------------------------------------


def trade_floor(window: Column, start: Column, end: Column, base: int = 100, overrides: dict[str, int] | None = None) -> Column:
    """Trades a window should have: an override, or the yearly base scaled to its days."""
    days = F.greatest(F.lit(1), F.floor((F.unix_seconds(end) - F.unix_seconds(start)) / 86_400))
    scaled = F.bround(F.lit(float(base)) * days / 365.25, 0)
    out = F.least(F.greatest(scaled, F.lit(15.0)), F.lit(float(max(base, 1) * 3))).cast("int")
    for name, value in (overrides or {}).items():
        out = F.when(F.lower(window) == name.lower(), F.lit(value)).otherwise(out)
    return out


def rule_complexity(n_params: Column, rule_key: Column) -> Column:
    by_params = F.least(F.lit(1.0), n_params / 8.0)
    by_name = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.length(rule_key) - 8) / 24.0))
    return F.least(F.lit(1.0), 0.75 * by_params + 0.25 * by_name)


def credibility_penalty(trades_: Column, floor: Column, win_rate: Column, drawdown: Column, n_params: Column) -> Column:
    loss = F.abs(F.least(drawdown, F.lit(0.0)))
    good = 0.8 * clip01(trades_ / F.greatest(floor, F.lit(1))) + 0.1 * clip01((win_rate - 0.35) / 0.35) + 0.1 * clip01(1.0 - loss / 0.45)
    return clip01(1.0 - clip01(good) + 0.15 * clip01(n_params / 10.0))


def stability_penalty(drawdown: Column, penalty: Column) -> Column:
    return clip01(0.7 * F.abs(F.least(drawdown, F.lit(0.0))) / 0.35 + 0.3 * penalty)
