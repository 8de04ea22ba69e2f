"""The rule sweep: every rule in every look-back window, scored inside its candidate set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import clip, clip01, min_max_scale
from barloom.operators.bars import LOOKBACKS
from barloom.operators.series import BLOCK_ROWS, look_up
from barloom.plans import backtest as BT
from barloom.plans import block_sweep as BS
from barloom.plans import rules as R
from barloom.session import stage

MIN_WINDOW_BARS = 140
REJECT_PENALTY = 0.65
CREDIBLE_PENALTY = 0.80
DRAWDOWN_FLOOR = -0.35
SET_KEYS = ["symbol", "family", "gate", "window", "side"]
SEGMENT_ROWS = 8_192


def window_table(bars: DataFrame, keys: Sequence[str] = ("symbol",), base_floor: int = 100, overrides: dict[str, int] | None = None,
                 min_bars: int = MIN_WINDOW_BARS) -> DataFrame:
    """One row per (key, window): bounds, bars, buy-and-hold return and trade floor."""
    newest = bars.groupBy(*keys).agg(F.max("ts").alias("_max"))
    tagged = look_up(bars, newest, list(keys), F.col("ts")).withColumn("_w", F.explode(_options()))
    inside = tagged.where(_in_window())
    out = inside.groupBy(*keys, F.col("_w.name").alias("window")).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("window_bars"), BT.hold_return().alias("hold_return"),
    )
    floor = BT.trade_floor(F.col("window"), F.col("start_ts"), F.col("end_ts"), base_floor, overrides)
    return out.withColumn("trade_floor", floor).where(F.col("window_bars") >= min_bars)


def _options() -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).cast("int").alias("days")) for n, d in LOOKBACKS.items()])


def _in_window() -> Column:
    return F.col("_w.days").isNull() | (F.col("ts") >= F.col("_max") - F.make_dt_interval(days=F.col("_w.days")))


def signals_by_window(signals: DataFrame, windows: DataFrame, step: str, keys: Sequence[str] = ("symbol",), rows: int = SEGMENT_ROWS) -> DataFrame:
    """Signal rows of each look-back window, with the segment the backtest is cut by.

    The window bounds travel as one small array per key, so rows multiply only by the windows
    they are in.
    """
    bounds = windows.groupBy(*keys).agg(F.collect_list(F.struct("window", "start_ts")).alias("_ws"))  # four windows per key at most
    out = look_up(signals, bounds, list(keys), F.col("ts")).withColumn("_w", F.explode("_ws")).where(F.col("ts") >= F.col("_w.start_ts"))
    return out.select(*signals.columns, F.col("_w.window").alias("window"), R.segment_column(step, rows).alias("seg"))


def candidates(signals: DataFrame, windows: DataFrame, bps: float = 10.0) -> DataFrame:
    """Metrics, penalties and objective margin of every (set, rule)."""
    return candidates_of(BT.rule_metrics(signals, [*SET_KEYS, "rule_id"], bps), windows)


def candidates_of(metrics: DataFrame, windows: DataFrame) -> DataFrame:
    m = metrics.drop("bars")
    # name and size of a rule are part of its id; leaving them out keeps the shuffled rows small
    m = m.withColumns({"rule_key": F.split_part("rule_id", F.lit(":"), F.lit(2)), "n_params": F.regexp_count("rule_id", F.lit("="))})
    out = m.join(windows.select("symbol", "window", "hold_return", "trade_floor"), ["symbol", "window"])
    penalty = BT.credibility_penalty(F.col("trades"), F.col("trade_floor"), F.col("win_rate"), F.col("max_drawdown"), F.col("n_params"))
    out = out.select(
        "*", BT.rule_complexity(F.col("n_params"), F.col("rule_key")).alias("complexity"), penalty.alias("credibility_penalty"),
        (F.col("net_return") - F.col("hold_return")).alias("alpha"), (F.col("net_return") >= F.col("hold_return")).alias("beats_hold"),
    )
    return out.withColumn("stability_penalty", BT.stability_penalty(F.col("max_drawdown"), F.col("credibility_penalty")))


def score(cands: DataFrame, keys: Sequence[str] = SET_KEYS) -> DataFrame:
    """Scores of the candidates that traded, normalised inside each set, and their rank.

    Candidates that beat buy-and-hold come first. Equal scores rank by rule id.
    """
    traded = cands.where("trades > 0").withColumns(
        {"cost": F.greatest(F.col("total_return") - F.col("net_return"), F.lit(0.0)), "depth": F.abs("max_drawdown")}
    )
    cols = ["net_return", "alpha", "depth", "win_rate", "cost", "complexity"]
    bounds = traded.groupBy(*keys).agg(*[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols])

    def n(c: str) -> Column:
        return min_max_scale(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"))

    q = traded.join(bounds, list(keys)).withColumns(
        {
            "edge_quality": clip01(0.7 * n("alpha") + 0.3 * n("net_return")),
            "stability_quality": clip01(0.65 * (1.0 - n("depth")) + 0.35 * n("win_rate")),
            "friction_quality": clip01(1.0 - n("cost")),
            "credibility_quality": clip01(1.0 - F.col("credibility_penalty")),
            "_cx": n("complexity"),
        }
    )
    total = (
        0.35 * F.col("edge_quality") + 0.25 * F.col("stability_quality") + 0.20 * F.col("friction_quality")
        + 0.20 * F.col("credibility_quality") - 0.05 * F.col("_cx") - 0.05 * clip01(F.col("stability_penalty"))
    )
    q = q.withColumn("score", clip(total, -1.0, 1.0))
    w = Window.partitionBy(*keys).orderBy(F.desc("beats_hold"), F.desc(F.round("score", 9)), "rule_id")
    own = [c for c in cands.columns] + ["edge_quality", "stability_quality", "friction_quality", "credibility_quality", "score"]
    return q.select(*own, F.row_number().over(w).alias("rank"))


def rejection_marks() -> Column:
    """Reasons a candidate is marked for; a candidate without trades has only the first."""
    traded = F.col("trades") > 0
    return F.filter(
        F.array(
            F.when(~traded | (F.col("credibility_penalty") >= REJECT_PENALTY), "low_credibility"),
            F.when(traded & ~F.col("beats_hold"), "underperform_spot"),
            F.when(traded & (F.col("max_drawdown") < DRAWDOWN_FLOOR), "high_drawdown"),
        ),
        lambda x: x.isNotNull(),
    )


def rejections(cands: DataFrame, keys: Sequence[str] = SET_KEYS) -> DataFrame:
    """Marks per set, candidates left after subtracting them, and the three worst examples."""
    m = cands.withColumn("marks", rejection_marks())
    counts = m.groupBy(*keys).agg(
        F.count("*").alias("total_candidates"),
        *[F.count_if(F.array_contains("marks", k)).alias(k) for k in ("low_credibility", "underperform_spot", "high_drawdown")],
    )
    left = F.col("total_candidates") - F.col("low_credibility") - F.col("underperform_spot") - F.col("high_drawdown")
    w = Window.partitionBy(*keys).orderBy(F.round("alpha", 9), "rule_id", "at")
    worst = (
        m.select(*keys, "rule_id", "alpha", F.posexplode("marks").alias("at", "reason"))
        .withColumn("rn", F.row_number().over(w)).where("rn <= 3")
        .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rn", "rule_id", "reason"))).alias("_x"))
    )
    return (
        counts.withColumn("kept", F.greatest(left, F.lit(0))).join(worst, list(keys), "left")
        .withColumn("worst_examples", F.transform("_x", lambda s: F.concat_ws("|", s["rule_id"], s["reason"]))).drop("_x")
    )


def indicator_sweep(
    bars: DataFrame, families: Sequence[str], step: str, keys: Sequence[str] = ("symbol",), bps: float = 10.0,
    rows: int = BLOCK_ROWS, gate: DataFrame | None = None, inverse: bool = False, min_bars: int = MIN_WINDOW_BARS,
    features: DataFrame | None = None, cores: Sequence[str] = (),
) -> DataFrame:
    """Candidates of all rules of `families`. `gate` adds gated runs: (symbol, ts, fusion_score, confidence).

    `cores` adds the rules of those feature cores, from `features` on the same bars (see `core_inputs`).
    Each family is a written part of its own, so plans and tasks stay small (see `block_sweep`).
    """
    bars = stage(bars, "bars")
    windows = stage(window_table(bars, keys, min_bars=min_bars), "windows")
    about = windows
    if gate is not None:
        gate = stage(gate.select(*keys, "ts", "fusion_score", "confidence"), "gate")
        inside = signals_by_window(bars.select(*keys, "ts"), windows, step, keys)
        about = windows.join(stage(R.gate_levels(inside.join(gate, [*keys, "ts"]), [*keys, "window"]), "gate-levels"), [*keys, "window"], "left")
    inputs = [(BS.indicator_inputs(bars, f, keys, rows), R.rule_grid(f), BS.indicator_matrices(f)) for f in families]
    if cores:
        inputs.append((BS.core_inputs(features, keys, rows), [r for c in cores for r in R.core_rule_grid(c)], BS.core_matrices()))
    parts = None
    for states, rules, signals in inputs:
        if gate is not None:
            states = states.join(gate, [*keys, "ts"], "left")
        part = stage(BS.segments(states, about, rules, signals, step, SEGMENT_ROWS, keys, bps, gate is not None, inverse), "segments")
        parts = part if parts is None else parts.unionByName(part)
    return stage(candidates_of(BS.metrics(parts, [*SET_KEYS, "rule_id"]), windows), "candidates")


def gated_runs(signals: DataFrame, scores: DataFrame | None = None, keys: Sequence[str] = ("symbol",), inverse: bool = False,
               levels: DataFrame | None = None) -> DataFrame:
    """Rows per gate and side. `levels`: the gate levels of (keys, window) where they are known.

    Gated entries need score and confidence of the window. The inverse side swaps the entries and
    exits of the long side (gated ones included) and asks for the opposite score.
    """
    def sides(rows: DataFrame, gate: str, test: Column | None) -> DataFrame:
        long = rows.withColumns({"gate": F.lit(gate), "side": F.lit("long")})
        if not inverse:
            return long
        other = R.inverse(rows).withColumns({"gate": F.lit(gate), "side": F.lit("inverse")})
        return long.unionByName(other if test is None else other.withColumn("entry", F.col("entry") & test))

    out = sides(signals, "ungated", None)
    if scores is not None:
        if levels is None:
            levels = R.gate_levels(signals.select(*keys, "window", "ts").distinct().join(scores, [*keys, "ts"]), [*keys, "window"])
        opened = signals.join(scores, [*keys, "ts"], "left").join(levels, [*keys, "window"], "left")
        opened = opened.withColumn("entry", F.col("entry") & R.gate_long())
        gated = sides(opened, "gated", R.gate_inverse())
        out = out.unionByName(gated.select(*out.columns))
    return out


def lookahead_audit(bars: DataFrame, family: str, keys: Sequence[str] = ("symbol",), share: float = 0.7, factor: float = 1.03,
                    rows: int = BLOCK_ROWS, rules: Sequence[R.Rule] | None = None, inputs=None, signals=None) -> DataFrame:
    """Raise the bars after `share` of each series; earlier signals must not change: (keys, checked, changed).

    Both price paths go through the same blocks, as two series of one key, and their rules are compared
    as matrices inside a segment: no row per rule and bar. `inputs` and `signals` audit rules of other
    kinds than `family` (see `block_sweep.indicator_inputs` and `indicator_matrices`).
    """
    keys, both = list(keys), [*keys, "_path"]
    size = bars.groupBy(*keys).agg(F.count("*").alias("_n"))
    cut = look_up(bars, size, keys, F.col("pos")).withColumn("_cut", F.floor(F.col("_n") * share))
    late = (F.col("pos") >= F.col("_cut")) & (F.col("_path") == 1)
    paths = cut.withColumn("_path", F.explode(F.array(F.lit(0), F.lit(1))))
    paths = paths.select(*[c for c in bars.columns if c not in ("open", "high", "low", "close")], "_path", "_cut",
                         *[F.when(late, F.col(c) * factor).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low", "close")])
    states = (inputs or BS.indicator_inputs)(paths, family, both, rows)
    limits = size.select(*keys, F.floor(F.col("_n") * share).alias("_cut"))
    early = look_up(states, limits, keys, F.col("pos")).where("pos < _cut").withColumn("seg", F.floor(F.col("pos") / SEGMENT_ROWS))
    return BS.compared(early, keys, list(rules if rules is not None else R.rule_grid(family)), signals or BS.indicator_matrices(family))
