"""Causal multi-timeframe features of bar series.

Names follow family__feature__timeframe. The short historical names of the same columns are a
view (`legacy_aliases`), never stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import EPS, clip, finite, log_ratio, nonzero
from barloom.operators import kernels as K
from barloom.operators.bars import close_clock, drop_warmup
from barloom.operators.quantiles import exact_quantiles
from barloom.operators.series import (
    look_up,
    BLOCK_ROWS,
    TIMEFRAME_SECONDS,
    by_blocks,
    carry_forward,
    number_bars,
    time_segment,
)
from barloom.session import stage

HIGHER_TIMEFRAMES = ("5m", "15m", "1h", "4h", "1d", "1w")
WARMUP_ROWS = 720
WINSOR = (0.005, 0.995)

RET = "trend__ret_log__1m"
TENSION = "oscillation__revert_tension_60__1m"
RANGE = "risk_volatility__range_ratio__1m"
VOL60 = "risk_volatility__realized_vol_60__1m"
REL_VOLUME = "flow_liquidity__rel_volume_log__1m"
VOLUME_Z = "flow_liquidity__volume_z__1m"
IMPACT = "flow_liquidity__impact_proxy_log__1m"
RANGE_VOLUME = "flow_liquidity__range_over_volume_log__1m"
REGIME = "flow_liquidity__regime_expand_contract__1m"
SHOCKS = "flow_liquidity__shock_density__1m"
JUMPS = "timing_execution__jump_density__1m"
VOL_RET = "vol_logret_1m"
BASE_FEATURES = [RET, VOL_RET, TENSION, RANGE, VOL60, REL_VOLUME, VOLUME_Z, IMPACT, RANGE_VOLUME, REGIME, SHOCKS, JUMPS]

# Higher-timeframe columns and the family each belongs to.
HTF_FAMILIES = {
    "logret": "trend",
    "range_ratio": "risk_volatility",
    "wick_ratio": "risk_volatility",
    "realized_vol_20": "risk_volatility",
    "breakout_high_dist": "oscillation",
    "breakout_low_dist": "oscillation",
}
LEGACY_HTF = ["logret", "range_ratio", "wick_ratio", "breakout_high_dist", "breakout_low_dist"]


def htf_name(feature: str, timeframe: str) -> str:
    return f"{HTF_FAMILIES[feature]}__{feature}__{timeframe}"


def clock_name(feature: str, timeframe: str) -> str:
    return f"timing_execution__{feature}__{timeframe}"


def feature_columns(timeframes: Sequence[str] = HIGHER_TIMEFRAMES) -> list[str]:
    cols = list(BASE_FEATURES)
    for t in timeframes:
        cols += [htf_name(f, t) for f in HTF_FAMILIES] + [clock_name(c, t) for c in ("ttc_min", "ttc_log", "ttc_phase")]
    return cols


def legacy_aliases(timeframes: Sequence[str] = HIGHER_TIMEFRAMES) -> dict[str, str]:
    """Historical name -> stored column."""
    names = {"ret_1m": RET}
    for t in timeframes:
        names.update({f"htf_{f}_{t}": htf_name(f, t) for f in LEGACY_HTF})
        names.update({f"{c}_{t}": clock_name(c, t) for c in ("ttc_min", "ttc_log")})
    return names


def with_legacy_columns(features: DataFrame) -> DataFrame:
    have = set(features.columns)
    return features.select("*", *[F.col(c).alias(a) for a, c in legacy_aliases().items() if c in have])


def higher_timeframe_features(bars: DataFrame, timeframe: str, keys: Sequence[str] = ("symbol",), rows: int = BLOCK_ROWS) -> DataFrame:
    """Features of one coarse bar, stamped with the time it closes."""
    numbered = bars if "pos" in bars.columns else number_bars(bars, keys, timeframe, rows)

    def build(df: DataFrame, w) -> DataFrame:
        past = w.rowsBetween(-20, -1)
        enough = F.count("*").over(past) >= 5
        close, opened = nonzero(F.col("close")), nonzero(F.col("open"))
        out = df.select(
            "*",
            log_ratio(close, opened).alias("logret"),
            F.when(enough, F.max("high").over(past)).alias("_hi"),
            F.when(enough, F.min("low").over(past)).alias("_lo"),
        )
        wick = (F.col("high") - F.greatest("open", "close")) + (F.least("open", "close") - F.col("low"))
        return out.select(
            *keys, "ts", "pos", "_blk", "logret",
            ((F.col("high") - F.col("low")) / close).alias("range_ratio"),
            (wick / nonzero(F.col("high") - F.col("low"))).alias("wick_ratio"),
            ((close - F.col("_hi")) / nonzero(F.col("_hi"))).alias("breakout_high_dist"),
            ((close - F.col("_lo")) / nonzero(F.col("_lo"))).alias("breakout_low_dist"),
            K.rolling_std("logret", w, 20, 5).alias("realized_vol_20"),
        )

    out = by_blocks(numbered, keys, build, back=40, rows=rows)
    closes = F.timestamp_seconds(F.unix_seconds("ts") + TIMEFRAME_SECONDS[timeframe])
    return out.drop("pos").withColumn("close_ts", closes)


def base_features(bars: DataFrame, keys: Sequence[str] = ("symbol",), rows: int = BLOCK_ROWS) -> DataFrame:
    """Features of the finest bars; needs dense positions."""
    keys = list(keys)

    def returns(df: DataFrame, w) -> DataFrame:
        close, volume = nonzero(F.col("close")), nonzero(F.col("volume"))
        out = df.select(
            *keys, "ts", "pos", "_blk",
            log_ratio(close, F.lag(close).over(w)).alias(RET),
            log_ratio(volume, F.lag(volume).over(w)).alias(VOL_RET),
            ((F.col("high") - F.col("low")) / close).alias(RANGE),
            volume.alias("_v"),
            F.log1p(F.greatest(F.col("volume"), F.lit(0.0))).alias("_lv"),
        )
        return out.select("*", K.rolling_std(RET, w, 60, 20).alias(VOL60), F.abs(RET).alias("_ar"))

    step = by_blocks(bars, keys, returns, back=62, rows=rows)
    step = K.ewm_with_gaps(step, keys, [K.span("_fast", "_v", 30), K.span("_slow", "_v", 240, 60)], rows)
    step = K.rolling_order_stats(
        step, keys,
        [
            K.OrderStat(TENSION, RET, 60, 20, "robust_z"),
            K.OrderStat("_med", "_v", 240, 30),
            K.OrderStat(VOLUME_Z, "_lv", 240, 30, "robust_z"),
            K.OrderStat("_jump", "_ar", 480, 60, q=0.97),
        ],
        rows,
    )
    v0 = F.coalesce("_v", F.lit(0.0))
    step = step.select(
        "*",
        log_ratio(F.col("_v"), F.col("_med")).alias(REL_VOLUME),
        finite(F.ln((F.abs(RET) + EPS) / (v0 + EPS))).alias(IMPACT),
        finite(F.ln((F.abs(RANGE) + EPS) / (v0 + EPS))).alias(RANGE_VOLUME),
        log_ratio(F.col("_fast"), F.col("_slow")).alias(REGIME),
    ).withColumn("_src", F.coalesce(F.abs(REL_VOLUME), F.lit(0.0)))
    step = K.rolling_order_stats(step, keys, [K.OrderStat("_shock", "_src", 480, 60, q=0.95)], rows)

    def densities(df: DataFrame, w) -> DataFrame:
        def above(x: str, level: str) -> Column:
            return F.coalesce((F.col(x) > F.lag(level).over(w)).cast("double"), F.lit(0.0))

        out = df.select("*", above("_src", "_shock").alias("_s"), above("_ar", "_jump").alias("_j"))
        return out.select(
            *keys, "ts", "pos", "_blk", *[c for c in BASE_FEATURES if c not in (SHOCKS, JUMPS)],
            K.rolling_mean("_s", w, 240, 30).alias(SHOCKS), K.rolling_mean("_j", w, 240, 30).alias(JUMPS),
        )

    out = by_blocks(step, keys, densities, back=241, rows=rows)
    return out.select(*keys, "ts", "pos", *BASE_FEATURES)


def feature_set(
    bars: DataFrame, coarse: dict[str, DataFrame], keys: Sequence[str] = ("symbol",), warmup: int = WARMUP_ROWS,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Base features, the last closed coarse bar of each timeframe, and the close clocks.

    `bars` needs dense positions. All timeframes join in one as-of pass. Values are carried
    forward over missing ones; the warm-up rows are dropped; what is still missing becomes 0.
    """
    keys = list(keys)
    segment = 60 * rows
    base = stage(base_features(bars, keys, rows), "base-features")
    frames = list(coarse)
    right = None
    for t in frames:
        f = higher_timeframe_features(coarse[t], t, keys, rows)
        part = f.select(*keys, F.col("close_ts").alias("_t"), F.struct(*HTF_FAMILIES).alias(f"_h_{t}"))
        right = part if right is None else right.unionByName(part, allowMissingColumns=True)
    cols = ["pos", *BASE_FEATURES]
    both = base.select(*keys, F.col("ts").alias("_t"), F.lit(1).alias("_side"), F.struct(*cols).alias("_base")).unionByName(
        right.withColumn("_side", F.lit(0)), allowMissingColumns=True
    ).withColumn("_seg", time_segment(segment, "_t"))
    joined = carry_forward(both, keys, "_seg", ["_t", "_side"], [f"_h_{t}" for t in frames]).where("_side = 1")
    wide = joined.select(
        *keys, F.col("_t").alias("ts"), "_base.*",
        *[finite(F.col(f"_h_{t}.{f}")).alias(htf_name(f, t)) for t in frames for f in HTF_FAMILIES],
    )
    for t in frames:
        wide = wide.withColumns({clock_name(k, t): c for k, c in close_clock("ts", t).items()})
    features = feature_columns(frames)
    wide = stage(wide.withColumn("_seg", time_segment(segment)), "feature-rows")
    filled = carry_forward(wide, keys, "_seg", ["ts"], features)
    kept = drop_warmup(filled, warmup, keys)
    return kept.select(*keys, "ts", "pos", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in features])


# --- winsor bounds ----------------------------------------------------------------------------


def winsor_bounds(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], q: tuple[float, float] = WINSOR) -> DataFrame:
    """Quantile bounds per key and column, as one row of (lo, hi) structs per key."""
    ends = {f"{i}_{side}": (c, level) for i, c in enumerate(columns) for side, level in zip(("lo", "hi"), q)}
    found = exact_quantiles(rows, keys, ends)
    return found.select(*keys, *[F.struct(F.col(f"{i}_lo").alias("lo"), F.col(f"{i}_hi").alias("hi")).alias(c) for i, c in enumerate(columns)])


def winsor_apply(rows: DataFrame, bounds: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Clip to fitted bounds; columns or keys without bounds pass unchanged."""
    named = bounds.select(*keys, *[F.col(c).alias(f"_w_{c}") for c in columns])
    joined = look_up(rows, named, list(keys), F.struct(*columns), "left")
    cols = []
    for c in rows.columns:
        if c in columns:
            x, lo, hi = F.col(c), F.col(f"_w_{c}.lo"), F.col(f"_w_{c}.hi")
            cols.append(F.when(x < lo, lo).when(x > hi, hi).otherwise(x).alias(c))
        else:
            cols.append(F.col(c))
    return joined.select(*cols)


def prefix_bounds(rows: DataFrame, starts: DataFrame, names: Sequence[str], keys: Sequence[str], columns: Sequence[str], q: tuple[float, float] = WINSOR, ts: str = "ts") -> DataFrame:
    """Quantile bounds of the rows before each window's start: (keys, window, one (lo, hi) struct per column).

    starts: keys, window, start_ts with one row per key and window; `names` are the windows wanted. The
    prefixes are nested: a row counts for every window that it lies before, and all windows and columns
    share one sketch, one count and one selection (see `exact_quantiles`). A window that begins with its
    series has no rows before it and no bounds.
    """
    keys = list(keys)
    begin = starts.where(F.col("window").isin(list(names))).groupBy(*keys).agg(F.collect_list(F.struct("window", "start_ts")).alias("_at"))  # a few windows per key
    marked = look_up(rows.select(*keys, ts, *columns), begin, keys, F.col(ts)).withColumn("_w", F.explode("_at")).where(F.col(ts) < F.col("_w.start_ts"))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)]))
    long = marked.select(*keys, F.col("_w.window").alias("window"), cells.alias("_c")).select(*keys, "window", F.col("_c.i").alias("_i"), F.col("_c.x").alias("_x"))
    found = exact_quantiles(long, [*keys, "window", "_i"], {"lo": ("_x", q[0]), "hi": ("_x", q[1])})
    each = [F.max(F.when(F.col("_i") == i, F.struct("lo", "hi"))).alias(c) for i, c in enumerate(columns)]
    return found.groupBy(*keys, "window").agg(*each)


def causal_windows(rows: DataFrame, starts: DataFrame, names: Sequence[str], keys: Sequence[str], columns: Sequence[str], q: tuple[float, float] = WINSOR) -> DataFrame:
    """The rows of each window, clipped to bounds that were fitted before the window began: `rows` plus `window`."""
    keys = list(keys)
    bounds = prefix_bounds(rows, starts, names, keys, columns, q).withColumnsRenamed({c: f"_w_{c}" for c in columns})
    about = starts.select(*keys, "window", "start_ts").join(bounds, [*keys, "window"], "left").groupBy(*keys).agg(F.collect_list(F.struct("window", "start_ts", *[f"_w_{c}" for c in columns])).alias("_ws"))
    each = look_up(rows, about, keys, F.col("ts")).withColumn("_w", F.explode("_ws")).where(F.col("ts") >= F.col("_w.start_ts"))

    def clipped(c: str) -> Column:
        x, b = F.col(c), F.col("_w")[f"_w_{c}"]
        return F.when(x < b["lo"], b["lo"]).when(x > b["hi"], b["hi"]).otherwise(x).alias(c)

    return each.select(*[clipped(c) if c in columns else F.col(c) for c in rows.columns], F.col("_w.window").alias("window"))


# --- registry ---------------------------------------------------------------------------------


def feature_family(name: Column) -> Column:
    """Family of a feature, told by its name."""
    return (
        F.when(name.contains("__"), F.split_part(name, F.lit("__"), F.lit(1)))
        .when(name.startswith("htf_logret_") | (name == "ret_1m"), "trend")
        .when(name.startswith("htf_breakout_"), "oscillation")
        .when(name.startswith("htf_range_ratio_") | name.startswith("htf_wick_ratio_"), "risk_volatility")
        .when(name.startswith("vol_") | name.contains("volume"), "flow_liquidity")
        .when(name.startswith("ttc_"), "timing_execution")
        .otherwise("misc")
    )


def feature_registry(features: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Share of present values, spread and mean size of each feature per key.

    One aggregation over the wide rows; only its single result row per key is turned long.
    """
    keys = list(keys)
    clean = features.select(*keys, *[finite(F.col(c)).alias(c) for c in columns])
    wide = clean.groupBy(*keys).agg(
        *[
            F.struct(
                F.lit(c).alias("name"),
                (F.count(c) / F.count("*")).alias("non_null_ratio"),
                F.stddev_samp(c).alias("std"),
                F.avg(F.abs(c)).alias("mean_abs"),
            ).alias(f"_{i}")
            for i, c in enumerate(columns)
        ]
    )
    long = wide.select(*keys, F.explode(F.array(*[f"_{i}" for i in range(len(columns))])).alias("r"))
    return long.select(
        *keys, "r.name", feature_family(F.col("r.name")).alias("family"), "r.non_null_ratio",
        F.coalesce("r.std", F.lit(0.0)).alias("std"), F.coalesce("r.mean_abs", F.lit(0.0)).alias("mean_abs"),
    )


def merge_registries(registry: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One row per feature: the key with the highest share of present values (first key on ties)."""
    w = Window.partitionBy("name").orderBy(F.desc("non_null_ratio"), *keys)
    return registry.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
