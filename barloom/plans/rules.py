"""Indicators, rule grids and the entry/exit signals of every rule.

Each distinct indicator parameter is computed once as a column ("variant"). A bar then carries an
array of variant states, the rules of a family are exploded against it, and every rule reads the
state of its variant. The rule list is fixed configuration, a literal in the plan.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from barloom.functions.expr import bar_return, crossed_above, crossed_below, flag, nonzero
from barloom.operators import kernels as K
from barloom.operators.quantiles import exact_quantiles
from barloom.operators.series import BLOCK_ROWS, TIMEFRAME_SECONDS, by_blocks, time_segment
from barloom.plans import features as FT

# The parameter lists of the indicator grids.
GRIDS: dict[str, dict[str, Sequence[float]]] = {
    "rsi": {
        "rsi_window": (7, 10, 14, 18, 21, 28, 35, 42, 56),
        "lower": (10, 15, 20, 25, 30, 35, 40, 45),
        "upper": (55, 60, 65, 70, 75, 80, 85, 90),
    },
    "macd": {"fast_window": (8, 12, 16), "slow_window": (21, 26, 34), "signal_window": (7, 9)},
    "ema_cross": {"fast_window": (8, 13, 21, 34), "slow_window": (55, 89, 144)},
    "bollinger": {"window": (14, 20, 30), "std_mult": (1.8, 2.0, 2.2)},
    "stoch_rsi": {"rsi_window": (14, 21), "stoch_window": (14, 21), "lower": (20, 30), "upper": (70, 80)},
    "adx": {"window": (14, 21, 28), "threshold": (18, 22, 28)},
    "cci": {"window": (20, 30), "lower": (-200, -150, -100), "upper": (100, 150, 200)},
    "atr_regime": {"atr_window": (14, 21), "ema_window": (50, 100, 150), "atr_floor": (0.003, 0.006, 0.010)},
}
RULE_KEYS = {
    "rsi": ("mean_revert", "breakout", "centerline"),
    "macd": ("momentum_follow", "zero_line_follow"),
    "ema_cross": ("trend_cross",),
    "bollinger": ("bb_breakout", "bb_mean_revert"),
    "stoch_rsi": ("stoch_mean_revert", "stoch_breakout"),
    "adx": ("adx_trend",),
    "cci": ("cci_mean_revert", "cci_breakout"),
    "atr_regime": ("atr_regime_filter",),
}
# Parameters that choose an indicator column; the others are levels the rule compares with.
VARIANT_KEYS = {
    "rsi": ("rsi_window",),
    "macd": ("fast_window", "slow_window", "signal_window"),
    "ema_cross": ("fast_window", "slow_window"),
    "bollinger": ("window",),
    "stoch_rsi": ("rsi_window", "stoch_window"),
    "adx": ("window",),
    "cci": ("window",),
    "atr_regime": ("atr_window", "ema_window"),
}
ORDERED_PAIRS = (("lower", "upper"), ("fast_window", "slow_window"))


@dataclass(frozen=True)
class Rule:
    family: str
    rule_key: str
    params: tuple[tuple[str, float], ...]

    @property
    def rule_id(self) -> str:
        return ":".join([self.family, self.rule_key, *[f"{k}={v:g}" for k, v in self.params]])


def rule_grid(family: str) -> list[Rule]:
    if family not in GRIDS:
        raise ValueError(f"unknown indicator family: {family}")
    names = list(GRIDS[family])
    rules = []
    for key in RULE_KEYS[family]:
        for values in product(*GRIDS[family].values()):
            p = dict(zip(names, (float(v) for v in values)))
            if all(p[a] < p[b] for a, b in ORDERED_PAIRS if a in p and b in p):
                rules.append(Rule(family, key, tuple(p.items())))
    return rules


def variants(family: str) -> list[tuple[float, ...]]:
    return list(product(*[tuple(float(v) for v in GRIDS[family][k]) for k in VARIANT_KEYS[family]]))


RULE_TYPE = "array<struct<rule_id:string,family:string,rule_key:string,variant:int,params:map<string,double>>>"


def rules_literal(rules: Sequence[Rule]) -> Column:
    """The rule list as one constant array."""
    index = {f: {v: i for i, v in enumerate(variants(f))} for f in {r.family for r in rules} if f in GRIDS}
    rows = []
    for rule in rules:
        p = dict(rule.params)
        at = index[rule.family][tuple(p[k] for k in VARIANT_KEYS[rule.family])] if rule.family in index else 0
        rows.append({"rule_id": rule.rule_id, "family": rule.family, "rule_key": rule.rule_key, "variant": at, "params": p})
    return F.from_json(F.lit(json.dumps(rows)), RULE_TYPE)


# --- indicator states -------------------------------------------------------------------------
# A builder adds one struct column per variant, named _v0, _v1, ...


def _moves(df: DataFrame, w: WindowSpec) -> DataFrame:
    d = F.col("close") - F.lag("close").over(w)
    return df.withColumn("_up", F.greatest(d, F.lit(0.0) * d)).withColumn("_dn", F.greatest(-d, F.lit(0.0) * d))


def _rsi(df: DataFrame, w: WindowSpec, part: Sequence[str], windows: Sequence[int]) -> DataFrame:
    specs = [s for n in windows for s in (K.wilder(f"_g{n}", "_up", n), K.wilder(f"_l{n}", "_dn", n))]
    out = K.ewm_in_block(_moves(df, w), w, part, specs)
    cols = [(100.0 - 100.0 / (1.0 + F.col(f"_g{n}") / nonzero(F.col(f"_l{n}")))).alias(f"rsi_{n}") for n in windows]
    return out.select(*df.columns, *cols)


def _pair(x: str, w: WindowSpec) -> Column:
    return F.struct(F.col(x).alias("x"), F.lag(x).over(w).alias("px"))


def rsi_states(df: DataFrame, w: WindowSpec, part: Sequence[str]) -> DataFrame:
    ns = [int(v[0]) for v in variants("rsi")]
    out = _rsi(df, w, part, ns)
    return out.select(*df.columns, *[_pair(f"rsi_{n}", w).alias(f"_v{i}") for i, n in enumerate(ns)])


def macd_states(df: DataFrame, w: WindowSpec, part: Sequence[str]) -> DataFrame:
    vs = [tuple(int(x) for x in v) for v in variants("macd")]
    spans = sorted({n for v in vs for n in v[:2]})
    out = K.ewm_in_block(df, w, part, [K.span(f"_e{n}", "close", n) for n in spans])
    for f, s in sorted({v[:2] for v in vs}):
        out = out.withColumn(f"_m{f}_{s}", F.col(f"_e{f}") - F.col(f"_e{s}"))
    out = K.ewm_in_block(out, w, part, [K.span(f"_s{f}_{s}_{g}", f"_m{f}_{s}", g) for f, s, g in vs])
    cols = []
    for i, (f, s, g) in enumerate(vs):
        m, sig = F.col(f"_m{f}_{s}"), F.col(f"_s{f}_{s}_{g}")
        cols.append(
            F.struct(m.alias("m"), F.lag(m).over(w).alias("pm"), sig.alias("s"), (m - sig).alias("h"), F.lag(m - sig).over(w).alias("ph")).alias(f"_v{i}")
        )
    return out.select(*df.columns, *cols)


def ema_states(df: DataFrame, w: WindowSpec, part: Sequence[str]) -> DataFrame:
    vs = [tuple(int(x) for x in v) for v in variants("ema_cross")]
    out = K.ewm_in_block(df, w, part, [K.span(f"_e{n}", "close", n) for n in sorted({n for v in vs for n in v})])
    cols = [(F.col(f"_e{f}") - F.col(f"_e{s}")).alias(f"_d{i}") for i, (f, s) in enumerate(vs)]
    out = out.select(*df.columns, *cols)
    return out.select(*df.columns, *[_pair(f"_d{i}", w).alias(f"_v{i}") for i in range(len(vs))])


def bollinger_states(df: DataFrame, w: WindowSpec, part: Sequence[str]) -> DataFrame:
    ns = [int(v[0]) for v in variants("bollinger")]
    out = df.select(
        "*",
        *[K.rolling_mean("close", w, n, n).alias(f"_m{n}") for n in ns],
        *[K.rolling_std("close", w, n, n, ddof=0).alias(f"_s{n}") for n in ns],
    )
    cols = []
    for i, n in enumerate(ns):
        now = {"c": F.col("close"), "m": F.col(f"_m{n}"), "s": F.col(f"_s{n}")}
        cols.append(F.struct(*[c.alias(k) for k, c in now.items()], *[F.lag(c).over(w).alias(f"p{k}") for k, c in now.items()]).alias(f"_v{i}"))
    return out.select(*df.columns, *cols)


def stoch_states(df: DataFrame, w: WindowSpec, part: Sequence[str]) -> DataFrame:
    vs = [tuple(int(x) for x in v) for v in variants("stoch_rsi")]
    out = _rsi(df, w, part, sorted({v[0] for v in vs}))
    cols = []
    for i, (n, k) in enumerate(vs):
        lo, hi = K.rolling_min(f"rsi_{n}", w, k, k), K.rolling_max(f"rsi_{n}", w, k, k)
        cols.append(F.coalesce(100.0 * (F.col(f"rsi_{n}") - lo) / nonzero(hi - lo), F.lit(50.0)).alias(f"_k{i}"))
    out = out.select("*", *cols)
    return out.select(*df.columns, *[_pair(f"_k{i}", w).alias(f"_v{i}") for i in range(len(vs))])


def true_range(w: WindowSpec) -> Column:
    prev = F.lag("close").over(w)
    return F.greatest(F.abs(F.col("high") - F.col("low")), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def average_true_range(df: DataFrame, w: WindowSpec, part: Sequence[str], windows: Sequence[int]) -> DataFrame:
    """ATR columns `atr_<n>`, 0 until enough rows."""
    out = df.withColumn("_tr", true_range(w))
    out = K.ewm_in_block(out, w, part, [K.wilder(f"_a{n}", "_tr", n) for n in windows])
    return out.select(*df.columns, *[F.coalesce(f"_a{n}", F.lit(0.0)).alias(f"atr_{n}") for n in windows])


def directional_index(df: DataFrame, w: WindowSpec, part: Sequence[str], windows: Sequence[int]) -> DataFrame:
    """+DI, -DI and ADX columns per window."""
    up = F.col("high") - F.lag("high").over(w)
    dn = F.lag("low").over(w) - F.col("low")
    out = average_true_range(df, w, part, windows)
    out = out.withColumn("_pdm", F.when((up > dn) & (up > 0), up).otherwise(0.0)).withColumn(
        "_mdm", F.when((dn > up) & (dn > 0), dn).otherwise(0.0)
    )
    out = K.ewm_in_block(out, w, part, [s for n in windows for s in (K.wilder(f"_p{n}", "_pdm", n), K.wilder(f"_q{n}", "_mdm", n))])
    for n in windows:
        atr = nonzero(F.col(f"atr_{n}"))
        out = out.withColumn(f"_p{n}", 100.0 * F.col(f"_p{n}") / atr).withColumn(f"_q{n}", 100.0 * F.col(f"_q{n}") / atr)
        p, q = F.col(f"_p{n}"), F.col(f"_q{n}")
        out = out.withColumn(f"_dx{n}", 100.0 * F.abs(p - q) / nonzero(p + q))
    out = K.ewm_in_block(out, w, part, [K.wilder(f"_x{n}", f"_dx{n}", n) for n in windows])
    zero = F.lit(0.0)
    return out.select(
        *df.columns,
        *[F.coalesce(f"_{a}{n}", zero).alias(f"{b}_{n}") for n in windows for a, b in (("p", "pdi"), ("q", "mdi"), ("x", "adx"))],
    )


def adx_states(df: DataFrame, w: WindowSpec, part: Sequence[str]) -> DataFrame:
    ns = [int(v[0]) for v in variants("adx")]
    out = directional_index(df, w, part, ns)
    cols = []
    for i, n in enumerate(ns):
        p, q = F.col(f"pdi_{n}"), F.col(f"mdi_{n}")
        cols.append(F.struct(p.alias("p"), q.alias("q"), F.col(f"adx_{n}").alias("a"), (p - q).alias("x"), F.lag(p - q).over(w).alias("px")).alias(f"_v{i}"))
    return out.select(*df.columns, *cols)


def commodity_channel(df: DataFrame, w: WindowSpec, windows: Sequence[int]) -> DataFrame:
    out = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3.0)
    out = out.select("*", *[K.rolling_mean("_tp", w, n, n).alias(f"_sma{n}") for n in windows])
    out = out.select("*", *[F.abs(F.col("_tp") - F.col(f"_sma{n}")).alias(f"_ad{n}") for n in windows])
    cols = []
    for n in windows:
        md = K.rolling_mean(f"_ad{n}", w, n, n)
        cols.append(F.coalesce((F.col("_tp") - F.col(f"_sma{n}")) / (0.015 * nonzero(md)), F.lit(0.0)).alias(f"cci_{n}"))
    return out.select(*df.columns, *cols)


def cci_states(df: DataFrame, w: WindowSpec, part: Sequence[str]) -> DataFrame:
    ns = [int(v[0]) for v in variants("cci")]
    out = commodity_channel(df, w, ns)
    return out.select(*df.columns, *[_pair(f"cci_{n}", w).alias(f"_v{i}") for i, n in enumerate(ns)])


def atr_regime_states(df: DataFrame, w: WindowSpec, part: Sequence[str]) -> DataFrame:
    vs = [tuple(int(x) for x in v) for v in variants("atr_regime")]
    out = average_true_range(df, w, part, sorted({v[0] for v in vs}))
    out = K.ewm_in_block(out, w, part, [K.span(f"_e{n}", "close", n) for n in sorted({v[1] for v in vs})])
    cols = []
    for i, (a, e) in enumerate(vs):
        dist = F.col("close") - F.col(f"_e{e}")
        ratio = F.col(f"atr_{a}") / nonzero(F.col("close"))
        cols.append(F.struct(dist.alias("x"), F.lag(dist).over(w).alias("px"), ratio.alias("ratio")).alias(f"_v{i}"))
    return out.select(*df.columns, *cols)


STATES: dict[str, Callable[[DataFrame, WindowSpec, Sequence[str]], DataFrame]] = {
    "rsi": rsi_states, "macd": macd_states, "ema_cross": ema_states, "bollinger": bollinger_states,
    "stoch_rsi": stoch_states, "adx": adx_states, "cci": cci_states, "atr_regime": atr_regime_states,
}
# Rows of history each family needs: two nested exponential means, or two nested row frames.
HISTORY = {
    "rsi": K.wilder("", "", 56).reach + 2,
    "macd": K.span("", "", 34).reach + K.span("", "", 9).reach + 1,
    "ema_cross": K.span("", "", 144).reach + 1,
    "bollinger": 31,
    "stoch_rsi": K.wilder("", "", 21).reach + 23,
    "adx": 2 * K.wilder("", "", 28).reach + 2,
    "cci": 60,
    "atr_regime": K.span("", "", 150).reach + 1,
}


# --- entry and exit conditions ----------------------------------------------------------------


class Ops(NamedTuple):
    """What conditions are built from: crossings of a level, and a boolean with missing read as false."""

    above: Callable
    below: Callable
    flag: Callable


COLUMNS = Ops(crossed_above, crossed_below, flag)
ARRAYS = Ops(lambda prev, now, level: (prev <= level) & (now > level), lambda prev, now, level: (prev >= level) & (now < level), lambda x: x)  # NaN compares as false
# Fields of a variant's state, in the order of the arrays that a sweep reads.
STATE_FIELDS = {
    "rsi": ("x", "px"), "macd": ("m", "pm", "s", "h", "ph"), "ema_cross": ("x", "px"), "bollinger": ("c", "m", "s", "pc", "pm", "ps"), "stoch_rsi": ("x", "px"),
    "adx": ("p", "q", "a", "x", "px"), "cci": ("x", "px"), "atr_regime": ("x", "px", "ratio"),
}


def _banded(x: Column, px: Column, lo: Column, hi: Column, revert: str, breakout: str, ops: Ops) -> dict[str, tuple[Column, Column]]:
    return {
        revert: (ops.below(px, x, lo), ops.above(px, x, hi)),
        breakout: (ops.above(px, x, hi), ops.below(px, x, lo)),
    }


def conditions(family: str, s: Column, p: Column, ops: Ops = COLUMNS) -> dict[str, tuple[Column, Column]]:
    """(entry, exit) of every rule key of a family, from state `s` and parameters `p`: columns, or arrays with `ARRAYS`."""
    crossed_above, crossed_below, flag = ops
    if family == "rsi":
        x, px, lo, hi = s["x"], s["px"], p["lower"], p["upper"]
        return {
            **_banded(x, px, lo, hi, "mean_revert", "breakout", ops),
            "centerline": (crossed_above(px, x, 50.0) & flag(x < hi), crossed_below(px, x, 50.0) & flag(x > lo)),
        }
    if family == "stoch_rsi":
        return _banded(s["x"], s["px"], p["lower"], p["upper"], "stoch_mean_revert", "stoch_breakout", ops)
    if family == "cci":
        return _banded(s["x"], s["px"], p["lower"], p["upper"], "cci_mean_revert", "cci_breakout", ops)
    if family == "macd":
        return {
            "momentum_follow": (crossed_above(s["ph"], s["h"], 0.0) & flag(s["m"] > 0), crossed_below(s["ph"], s["h"], 0.0) | flag(s["m"] < 0)),
            "zero_line_follow": (crossed_above(s["pm"], s["m"], 0.0) & flag(s["s"] > 0), crossed_below(s["pm"], s["m"], 0.0)),
        }
    if family == "ema_cross":
        return {"trend_cross": (crossed_above(s["px"], s["x"], 0.0), crossed_below(s["px"], s["x"], 0.0))}
    if family == "bollinger":
        k = p["std_mult"]
        over, pover = s["c"] - (s["m"] + k * s["s"]), s["pc"] - (s["pm"] + k * s["ps"])
        under, punder = s["c"] - (s["m"] - k * s["s"]), s["pc"] - (s["pm"] - k * s["ps"])
        mid, pmid = s["c"] - s["m"], s["pc"] - s["pm"]
        return {
            "bb_breakout": (crossed_above(pover, over, 0.0), crossed_below(pmid, mid, 0.0)),
            "bb_mean_revert": (crossed_below(punder, under, 0.0), crossed_above(pmid, mid, 0.0)),
        }
    if family == "adx":
        t = p["threshold"]
        return {
            "adx_trend": (
                flag((s["p"] > s["q"]) & (s["a"] > t)) & crossed_above(s["px"], s["x"], 0.0),
                flag(s["q"] > s["p"]) | flag(s["a"] < t * 0.8),
            )
        }
    if family == "atr_regime":
        t = p["atr_floor"]
        return {
            "atr_regime_filter": (
                crossed_above(s["px"], s["x"], 0.0) & flag(s["ratio"] > t),
                crossed_below(s["px"], s["x"], 0.0) | flag(s["ratio"] < t * 0.8),
            )
        }
    raise ValueError(f"unknown indicator family: {family}")


def choose(rule_key: Column, options: dict[str, tuple[Column, Column]], side: int) -> Column:
    out = F.lit(False)
    for key, pair in options.items():
        out = F.when(rule_key == key, pair[side]).otherwise(out)
    return out


def indicator_states(bars: DataFrame, family: str, keys: Sequence[str] = ("symbol",), rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, ts, pos, ret, _v): the states of all variants of a family, one row per bar."""

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        out = df.withColumn("ret", bar_return(F.col("close"), F.lag("close").over(w)))
        return STATES[family](out, w, [*keys, "_blk"])

    states = by_blocks(bars, keys, build, back=HISTORY[family], rows=rows)
    return states.select(*keys, "ts", "pos", "ret", F.array(*[f"_v{i}" for i in range(len(variants(family)))]).alias("_v"))


def expand_rules(states: DataFrame, family: str, keys: Sequence[str] = ("symbol",), rules: Sequence[Rule] | None = None) -> DataFrame:
    """(keys, ts, pos, ret, family, rule_id, rule_key, n_params, entry, exit) for every bar and rule."""
    rules = rule_grid(family) if rules is None else list(rules)
    each = states.withColumn("r", F.explode(rules_literal(rules)))
    each = each.withColumn("_s", F.get(F.col("_v"), F.col("r.variant")))
    options = conditions(family, F.col("_s"), F.col("r.params"))
    return each.select(
        *keys, "ts", "pos", "ret", "r.family", "r.rule_id", "r.rule_key", F.size("r.params").alias("n_params"),
        choose(F.col("r.rule_key"), options, 0).alias("entry"), choose(F.col("r.rule_key"), options, 1).alias("exit"),
    )


def indicator_signals(
    bars: DataFrame, family: str, keys: Sequence[str] = ("symbol",), rows: int = BLOCK_ROWS, rules: Sequence[Rule] | None = None
) -> DataFrame:
    """Signals of all rules of a family.

    Bars are shuffled once by (key, block) for the indicators; exploding the rules adds no shuffle.
    """
    return expand_rules(indicator_states(bars, family, keys, rows), family, keys, rules)


def inverse(signals: DataFrame) -> DataFrame:
    """Swap entries and exits."""
    return signals.withColumns({"entry": F.col("exit"), "exit": F.col("entry")})


# --- feature-core rules -----------------------------------------------------------------------
# Each core rule as conditions (feature, comparison, parameter). Entry conditions
# must all hold, exit conditions are alternatives; "x>" and "x<" are crossings.


@dataclass(frozen=True)
class CoreRule:
    core: str
    entry: tuple[tuple[str, str, str], ...]
    exit: tuple[tuple[str, str, str], ...]
    grid: dict[str, tuple[float, ...]]
    fixed: dict[str, float]


_BH = {t: FT.htf_name("breakout_high_dist", t) for t in ("15m", "1h", "4h")}
_BL = {t: FT.htf_name("breakout_low_dist", t) for t in ("15m", "1h")}
_T4, _WICK = FT.htf_name("logret", "4h"), FT.htf_name("wick_ratio", "1h")
_PHASE = FT.clock_name("ttc_phase", "5m")

CORE_RULES: dict[str, CoreRule] = {
    "pulse_follow": CoreRule(
        "momentum_pulse",
        ((FT.RET, "x>", "ret_entry"), (FT.REL_VOLUME, ">", "flow_min"), (FT.VOL60, "<", "risk_cap")),
        ((FT.RET, "x<", "ret_exit"), (FT.REL_VOLUME, "<", "flow_exit"), (FT.VOL60, ">", "risk_stop")),
        {"ret_entry": (0.0002, 0.0005), "flow_min": (0.0, 0.2), "risk_cap": (0.004, 0.006),
         "ret_exit": (0.0, -0.0002), "flow_exit": (-0.2, -0.4), "risk_stop": (0.007, 0.009)},
        {},
    ),
    "drift_hold": CoreRule(
        "momentum_pulse",
        ((_T4, ">", "trend4h_min"), (_BH["1h"], "x>", "breakout_entry"), (FT.REGIME, ">", "flow_regime_min")),
        ((_BH["1h"], "x<", "breakout_exit"), (_T4, "<", "trend4h_exit"), (FT.REGIME, "<", "flow_regime_exit")),
        {"trend4h_min": (0.0, 0.002), "breakout_entry": (0.0, 0.002), "flow_regime_min": (0.0, 0.05)},
        {"breakout_exit": -0.001, "flow_regime_exit": -0.03},
    ),
    "deep_reclaim": CoreRule(
        "mean_reclaim",
        ((FT.TENSION, "<", "tension_low"), (_BL["1h"], "<", "low_dist_min"), (_WICK, "<", "wick_cap")),
        ((FT.TENSION, ">", "tension_exit"), (_BH["1h"], ">", "high_dist_exit"), (_WICK, ">", "wick_stop")),
        {"tension_low": (-1.6, -1.2), "low_dist_min": (-0.01, -0.005), "wick_cap": (0.55, 0.75)},
        {"tension_exit": 0.2, "high_dist_exit": 0.015, "wick_stop": 1.2},
    ),
    "snap_back": CoreRule(
        "mean_reclaim",
        ((FT.TENSION, "x>", "tension_recover"), (_BL["1h"], "<", "low_dist_gate"), (_WICK, "<", "wick_cap")),
        ((FT.TENSION, "x<", "tension_fail"), (_BH["1h"], ">", "high_dist_exit")),
        {"tension_recover": (-0.6, -0.3), "low_dist_gate": (-0.015, -0.008)},
        {"tension_fail": -0.8, "high_dist_exit": 0.02, "wick_cap": 0.9},
    ),
    "regime_break": CoreRule(
        "breakout_regime",
        ((_BH["4h"], "x>", "breakout_entry"), (FT.REGIME, ">", "flow_regime_min"), (FT.SHOCKS, "<", "shock_cap")),
        ((_BH["4h"], "x<", "breakout_exit"), (FT.SHOCKS, ">", "shock_stop"), (FT.RANGE, ">", "risk_stop")),
        {"breakout_entry": (0.0, 0.003), "flow_regime_min": (0.0, 0.04), "shock_cap": (0.3, 0.5)},
        {"breakout_exit": -0.002, "shock_stop": 0.75, "risk_stop": 0.012},
    ),
    "vol_reaccel": CoreRule(
        "breakout_regime",
        ((_BH["15m"], "x>", "breakout15_entry"), (FT.REGIME, ">", "flow_regime_min"), (FT.RANGE, "<", "risk_cap")),
        ((_BH["15m"], "x<", "breakout15_exit"), (FT.REGIME, "<", "flow_regime_exit"), (FT.RANGE, ">", "risk_stop")),
        {"breakout15_entry": (0.0, 0.004), "flow_regime_min": (0.0, 0.05)},
        {"breakout15_exit": -0.002, "flow_regime_exit": -0.02, "risk_cap": 0.009, "risk_stop": 0.013},
    ),
    "shock_absorb": CoreRule(
        "flow_absorption",
        ((FT.SHOCKS, ">", "shock_min"), (FT.IMPACT, "<", "impact_cap"), (FT.RET, ">", "ret_min")),
        ((FT.SHOCKS, "<", "shock_exit"), (FT.IMPACT, ">", "impact_stop"), (FT.RET, "<", "ret_exit")),
        {"shock_min": (0.25, 0.35), "impact_cap": (-11.5, -10.5), "ret_min": (0.0, 0.0002)},
        {"shock_exit": 0.15, "impact_stop": -8.8, "ret_exit": -0.0004},
    ),
    "flow_reprice": CoreRule(
        "flow_absorption",
        ((FT.REL_VOLUME, "x>", "rel_volume_entry"), (FT.IMPACT, "<", "impact_cap"), (FT.RET, ">", "ret_min")),
        ((FT.REL_VOLUME, "x<", "rel_volume_exit"), (FT.IMPACT, ">", "impact_stop")),
        {"rel_volume_entry": (0.1, 0.3), "impact_cap": (-11.5, -10.5)},
        {"rel_volume_exit": -0.1, "impact_stop": -8.5, "ret_min": 0.0},
    ),
    "compression_release": CoreRule(
        "risk_compression",
        ((FT.RANGE, "<", "range_cap"), (FT.VOL60, "<", "vol_cap"), (_BH["15m"], ">", "breakout_entry")),
        ((FT.RANGE, ">", "range_stop"), (FT.VOL60, ">", "vol_stop"), (_BL["15m"], "<", "breakout_low_exit")),
        {"range_cap": (0.0015, 0.0025), "vol_cap": (0.0015, 0.0025), "breakout_entry": (0.0, 0.002)},
        {"range_stop": 0.006, "vol_stop": 0.006, "breakout_low_exit": -0.01},
    ),
    "range_reopen": CoreRule(
        "risk_compression",
        ((_BH["15m"], "x>", "breakout_cross"), (FT.RANGE, "<", "range_cap")),
        ((_BH["15m"], "x<", "breakout_fail"), (FT.RANGE, ">", "range_stop")),
        {"breakout_cross": (0.0, 0.003), "range_cap": (0.002, 0.0035)},
        {"breakout_fail": -0.002, "range_stop": 0.006},
    ),
    "phase_edge": CoreRule(
        "timing_efficiency",
        ((_PHASE, "<", "phase_entry"), (FT.RET, ">", "ret_min"), (FT.REL_VOLUME, ">", "flow_min")),
        ((_PHASE, ">", "phase_exit"), (FT.RET, "<", "ret_exit"), (FT.REL_VOLUME, "<", "flow_exit")),
        {"phase_entry": (0.10, 0.25), "ret_min": (0.0, 0.0002), "flow_min": (-0.05, 0.1)},
        {"phase_exit": 0.85, "ret_exit": -0.0003, "flow_exit": -0.2},
    ),
    "jump_sync": CoreRule(
        "timing_efficiency",
        ((FT.JUMPS, "x>", "jump_entry"), (FT.RET, ">", "ret_min"), (_PHASE, "<", "phase_cap")),
        ((FT.JUMPS, "x<", "jump_exit"), (FT.RET, "<", "ret_exit")),
        {"jump_entry": (0.05, 0.12), "phase_cap": (0.4, 0.7)},
        {"jump_exit": 0.03, "ret_min": 0.0, "ret_exit": -0.0003},
    ),
}


def core_features() -> list[str]:
    """Every feature that a core rule reads."""
    return sorted({f for c in CORE_RULES.values() for f, _, _ in (*c.entry, *c.exit)})


def core_rule_grid(core: str | None = None) -> list[Rule]:
    known = {c.core for c in CORE_RULES.values()}
    if core is not None and core not in known:
        raise ValueError(f"unknown core: {core}")
    rules = []
    for key, c in CORE_RULES.items():
        if core in (None, c.core):
            for values in product(*c.grid.values()):
                p = {**dict(zip(c.grid, values)), **c.fixed}
                if key == "drift_hold":
                    p["trend4h_exit"] = p["trend4h_min"] - 0.001
                rules.append(Rule(c.core, key, tuple(p.items())))
    return rules


def core_signals(features: DataFrame, core: str | None = None, keys: Sequence[str] = ("symbol",), rows: int = BLOCK_ROWS) -> DataFrame:
    """Signals of the feature-core rules; needs feature columns, `pos`, `ret` and `ts`.

    A missing feature column counts as 0, decided when the plan is built.
    """
    rules = core_rule_grid(core)
    wanted = {k: c for k, c in CORE_RULES.items() if core in (None, c.core)}
    used = sorted({f for c in wanted.values() for f, _, _ in (*c.entry, *c.exit)})
    name = {f: f"_f{i}" for i, f in enumerate(used)}

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        have = set(df.columns)
        now = df.select(*keys, "ts", "pos", "_blk", "ret", *[(F.coalesce(f, F.lit(0.0)) if f in have else F.lit(0.0)).alias(name[f]) for f in used])
        return now.select("*", *[F.lag(name[f]).over(w).alias(f"p{name[f]}") for f in used])

    each = by_blocks(features, keys, build, back=1, rows=rows).withColumn("r", F.explode(rules_literal(rules)))

    def test(f: str, op: str, par: str) -> Column:
        x, px, level = F.col(name[f]), F.col(f"p{name[f]}"), F.col("r.params")[par]
        if op == "x>":
            return crossed_above(px, x, level)
        if op == "x<":
            return crossed_below(px, x, level)
        return flag(x > level) if op == ">" else flag(x < level)

    options = {}
    for key, c in wanted.items():
        entry, exit_ = F.lit(True), F.lit(False)
        for cond in c.entry:
            entry = entry & test(*cond)
        for cond in c.exit:
            exit_ = exit_ | test(*cond)
        options[key] = (entry, exit_)
    return each.select(
        *keys, "ts", "pos", "ret", "r.family", "r.rule_id", "r.rule_key", F.size("r.params").alias("n_params"),
        choose(F.col("r.rule_key"), options, 0).alias("entry"), choose(F.col("r.rule_key"), options, 1).alias("exit"),
    )


# --- gates ------------------------------------------------------------------------------------


def gate_levels(scores: DataFrame, keys: Sequence[str], q_score: float = 0.55, q_conf: float = 0.40) -> DataFrame:
    """Entry levels per key: quantiles of fusion score and confidence over the key's rows.

    Keys include the look-back window for the sweep's gate, and leave it out for the whole-series
    gate of the validation.
    """
    found = exact_quantiles(scores, keys, {"score_level": ("fusion_score", q_score), "_conf": ("confidence", q_conf)})
    return found.select(*keys, "score_level", F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.col("_conf"))).alias("conf_level"))


def gate_long() -> Column:
    return flag((F.col("fusion_score") >= F.col("score_level")) & (F.col("confidence") >= F.col("conf_level")))


def gate_inverse() -> Column:
    return flag((F.col("fusion_score") <= -F.abs("score_level")) & (F.col("confidence") >= F.col("conf_level")))


def segment_column(step: str, rows: int) -> Column:
    return time_segment(TIMEFRAME_SECONDS[step] * rows)
