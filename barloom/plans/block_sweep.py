"""Backtests of whole rule grids block by block, without a row per rule and bar.

A task gets one segment of one series: its bars with the states that the rules read. There every rule
is a row of a matrix, and positions, equity and trades are running sums and products along the bars.
What leaves the task is one summary per (rule, look-back window, gate, side, segment): growth, highest
and lowest equity, worst fall, moments of the bar returns, the trades inside, and the parts of the
trades that reach over either end. Summaries of neighbouring segments merge in time order, so series
of any length and rule grids of any size cost a few rows per segment and rule.

Positions count entries less exits from the start of the window, so a segment needs the count at its
start. Where a series has several segments, a first pass over the same matrices gives each segment's
total, and prefix sums of those give the counts.

A price of 0 takes all equity, and with the cost of leaving in that bar a little more: equity is then
below zero. Such a segment also lists its depths with the peaks before them, so that falls still merge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import EPS, nonzero
from barloom.operators.series import BLOCK_ROWS, before, by_blocks
from barloom.plans import backtest as BT
from barloom.plans import rules as R
from barloom.session import stage

CHUNK_RULES = 512  # rules of one task
CELLS = 1 << 20  # cells of one matrix
GATES, SIDES = ("ungated", "gated"), ("long", "inverse")
SUMMARY = {
    "n": "long", "mean": "double", "m2": "double", "growth": "double", "gross_growth": "double", "lo": "double", "hi": "double", "worst": "double", "starts": "long",
    "head": "double", "tail": "double", "trades": "long", "wins": "long", "trade_mean": "double", "trade_m2": "double"}
# Depths of the equity, and of its mirror image (for a segment that starts below zero); NULL where no equity is below zero.
DEPTHS, DEPTH = ("dips", "rises"), pa.list_(pa.struct([("peak", pa.float64()), ("low", pa.float64())]))


# --- inputs: one array of numbers per bar -----------------------------------------------------


def _numbers(columns: Sequence[Column]) -> Column:
    return F.array(*[F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in columns])


def indicator_inputs(bars: DataFrame, family: str, keys: Sequence[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, ts, pos, ret, _x): the states of all variants of a family as one array of numbers."""
    states = R.indicator_states(bars, family, keys, rows)
    return states.select(*keys, "ts", "pos", "ret", _numbers([F.col("_v")[i][f] for i in range(len(R.variants(family))) for f in R.STATE_FIELDS[family]]).alias("_x"))


def core_inputs(features: DataFrame, keys: Sequence[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, ts, pos, ret, _x): every feature that a core reads, now and one bar before. A missing column is 0."""
    have = set(features.columns)
    used = R.core_features()

    def build(df: DataFrame, w) -> DataFrame:
        now = df.select(*keys, "ts", "pos", "_blk", "ret", *[(F.coalesce(f, F.lit(0.0)) if f in have else F.lit(0.0)).alias(f"_f{i}") for i, f in enumerate(used)])
        return now.select("*", *[F.lag(f"_f{i}").over(w).alias(f"_p{i}") for i in range(len(used))])

    each = by_blocks(features, keys, build, back=1, rows=rows)
    return each.select(*keys, "ts", "pos", "ret", _numbers([F.col(f"_{k}{i}") for k in "fp" for i in range(len(used))]).alias("_x"))


Signals = Callable[[np.ndarray, list[R.Rule]], Iterator[tuple[list[int], np.ndarray, np.ndarray]]]


def indicator_matrices(family: str) -> Signals:
    """Entries and exits of the rules of a family as (rules, bars) matrices, one variant at a time."""
    fields, places = R.STATE_FIELDS[family], {v: i for i, v in enumerate(R.variants(family))}

    def run(x: np.ndarray, rules: list[R.Rule]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        groups: dict[tuple, list[int]] = {}
        for k, rule in enumerate(rules):
            p = dict(rule.params)
            groups.setdefault((places[tuple(p[c] for c in R.VARIANT_KEYS[family])], rule.rule_key), []).append(k)
        for (at, key), members in groups.items():
            state = {f: x[:, at * len(fields) + j] for j, f in enumerate(fields)}
            for few in _slices(members, len(x)):
                params = {c: np.array([dict(rules[k].params)[c] for k in few])[:, None] for c, _ in rules[few[0]].params}
                entry, exit_ = R.conditions(family, state, params, R.ARRAYS)[key]
                shape = (len(few), len(x))
                yield few, np.broadcast_to(entry, shape), np.broadcast_to(exit_, shape)

    return run


def core_matrices() -> Signals:
    """The same for the rules of the feature cores."""
    place = {f: i for i, f in enumerate(R.core_features())}

    def run(x: np.ndarray, rules: list[R.Rule]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        half = len(place)
        groups: dict[str, list[int]] = {}
        for k, rule in enumerate(rules):
            groups.setdefault(rule.rule_key, []).append(k)
        for key, members in groups.items():
            for few in _slices(members, len(x)):
                params = {c: np.array([dict(rules[k].params)[c] for k in few])[:, None] for c, _ in rules[few[0]].params}

                def test(f: str, op: str, par: str, params=params) -> np.ndarray:
                    now, prev, level = x[:, place[f]], x[:, half + place[f]], params[par]
                    return {"x>": lambda: R.ARRAYS.above(prev, now, level), "x<": lambda: R.ARRAYS.below(prev, now, level), ">": lambda: now > level, "<": lambda: now < level}[op]()

                core = R.CORE_RULES[key]
                yield few, reduce(np.logical_and, [test(*c) for c in core.entry]), reduce(np.logical_or, [test(*c) for c in core.exit])

    return run


def _slices(members: list[int], bars: int) -> Iterator[list[int]]:
    size = max(1, CELLS // max(bars, 1))
    for k in range(0, len(members), size):
        yield members[k:k + size]


# --- one segment ------------------------------------------------------------------------------


def _depths(path: np.ndarray) -> list[dict[str, float]]:
    """Points (peak so far or 0, value) among which is the deepest fall, whatever the scale of the path and the peak before it."""
    peak, below = np.maximum(np.maximum.accumulate(path), 0.0), path < 0.0
    if below.any():  # the lowest value under each peak
        peaks, first = np.unique(peak[below], return_index=True)
        points = zip(peaks, np.minimum.reduceat(path[below], first))
    else:
        worst = np.argmin(np.divide(path, peak, out=np.ones_like(path), where=peak > 0.0))
        points = [(0.0, path.min()), (peak[worst], path[worst])]
    return [{"peak": float(p), "low": float(x)} for p, x in points]


def summaries(entry: np.ndarray, exit_: np.ndarray, ret: np.ndarray, base: np.ndarray, cost: float) -> dict[str, np.ndarray]:
    """Summary of each rule (row) over the bars (columns) of a segment; `base` is the count before it."""
    rules, bars = entry.shape
    count = base[:, None] + np.cumsum(entry.astype(np.int8) - exit_.astype(np.int8), axis=1, dtype=np.int64)
    held = count > 0
    carried = base > 0
    was = np.c_[carried, held[:, :-1]]
    gross = np.where(was, ret, 0.0)
    net = gross - np.where(held != was, cost, 0.0)
    equity = np.cumprod(1.0 + net, axis=1)
    mean = net.mean(axis=1)
    peak = np.maximum.accumulate(equity, axis=1)
    out = {
        "n": np.full(rules, bars), "mean": mean, "m2": np.square(net - mean[:, None]).sum(axis=1), "growth": equity[:, -1], "gross_growth": np.prod(1.0 + gross, axis=1),
        "lo": equity.min(axis=1), "hi": equity.max(axis=1), "worst": np.divide(equity, peak, out=np.ones_like(equity), where=peak > 0.0).min(axis=1) - 1.0}
    crossing = out["lo"] < 0.0
    for name, path in zip(DEPTHS, (equity, -equity)):
        out[name] = [_depths(path[k]) if crossing[k] else None for k in range(rules)]
    # trades: runs of held bars; a column of flat bars keeps the rows apart
    flat = np.zeros((rules, bars + 1), dtype=np.int8)
    flat[:, :-1] = held
    turn = np.diff(flat.ravel(), prepend=np.int8(0))
    first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    step = np.ones((rules, bars + 1))
    step[:, :-1] += net
    value = np.multiply.reduceat(step.ravel(), np.c_[first, last].ravel())[::2] if len(first) else np.zeros(0)
    row, left, right = first // (bars + 1), first % (bars + 1) == 0, last % (bars + 1) == bars
    left &= carried[row]
    out["starts"] = np.bincount(row[~left], minlength=rules)
    for name, some in (("head", left), ("tail", right & ~left)):
        out[name] = np.full(rules, np.nan)
        out[name][row[some]] = value[some]
    inner = ~left & ~right
    who, gain = row[inner], value[inner] - 1.0
    out["trades"] = np.bincount(who, minlength=rules)
    out["wins"] = np.bincount(who, gain > 0, minlength=rules).astype(np.int64)
    out["trade_mean"] = np.bincount(who, gain, minlength=rules) / np.maximum(out["trades"], 1)
    out["trade_m2"] = np.bincount(who, np.square(gain - out["trade_mean"][who]), minlength=rules)
    return out


def _combinations(entry: np.ndarray, exit_: np.ndarray, long: np.ndarray | None, inverse: np.ndarray | None, both: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(gate, side, entries, exits): the inverse side swaps them, gated ones included, and asks for the opposite score."""
    yield 0, 0, entry, exit_
    if both:
        yield 0, 1, exit_, entry
    if long is not None:
        yield 1, 0, entry & long, exit_
        if both:
            yield 1, 1, exit_ & inverse, entry & long


def _segment(keys: Sequence[str], rules: list[R.Rule], signals: Signals, bps: float, gated: bool, inverse: bool, totals: bool):
    """Arrow function of one (keys, seg, chunk) group: bars on the left, windows and counts on the right."""
    ids, families = [r.rule_id for r in rules], [r.family for r in rules]
    names = ["total"] if totals else list(SUMMARY)

    def run(key: tuple, bars: pa.Table, about: pa.Table) -> pa.Table:
        chunk = key[-1].as_py()
        mine = list(range(chunk * CHUNK_RULES, min(len(rules), (chunk + 1) * CHUNK_RULES)))
        bars = bars.sort_by("pos")
        col = lambda t, c: t.column(c).to_numpy(zero_copy_only=False)
        ts, ret = col(bars, "ts"), np.nan_to_num(col(bars, "ret").astype(float), nan=0.0)
        x = bars.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ts), -1) if len(ts) else np.zeros((0, 1))
        kind = about.column("rule").to_pylist()
        windows, counts = [], {}
        for k, (window, start, score, conf, gate, side, base) in enumerate(zip(*(about.column(c).to_pylist() for c in ("window", "start", "score_level", "conf_level", "gate", "side", "base")))):
            if kind[k] is None:
                windows.append((window, int(np.searchsorted(ts, start)), np.nan if score is None else score, np.nan if conf is None else conf))
            else:
                counts.setdefault((window, gate, side), {})[kind[k]] = base
        found: list[tuple] = []
        score, conf = (col(bars, "fusion_score").astype(float), col(bars, "confidence").astype(float)) if gated else (None, None)
        for few, entry, exit_ in signals(x, [rules[k] for k in mine]):
            done: dict[tuple, list] = {}
            for window, at, level, sure in windows:
                if at >= len(ts):
                    continue
                same = (at, level, sure)
                if counts or same not in done:
                    done[same] = []
                    long = opposite = None
                    if gated:
                        enough = conf[at:] >= sure
                        long, opposite = (score[at:] >= level) & enough, (score[at:] <= -abs(level)) & enough
                    for gate, side, e, z in _combinations(entry[:, at:], exit_[:, at:], long, opposite, inverse):
                        if totals:
                            done[same].append((gate, side, {"total": e.sum(axis=1) - z.sum(axis=1)}))
                            continue
                        known = counts.get((window, gate, side), {})
                        base = np.array([known.get(mine[k], 0) for k in few], dtype=np.int64)
                        done[same].append((gate, side, summaries(e, z, ret[at:], base, bps / 10_000.0)))
                found += [(window, gate, side, [mine[k] for k in few], out) for gate, side, out in done[same]]
        size = [len(f[3]) for f in found]
        which = [k for f in found for k in f[3]]
        spread = lambda values: pa.array(np.repeat(np.array(values, dtype=object), size) if found else [], pa.string())
        table = {k: pa.array([v.as_py()] * len(which), v.type) for k, v in zip(keys, key)}
        table |= {"window": spread([f[0] for f in found]), "gate": spread([GATES[f[1]] for f in found]), "side": spread([SIDES[f[2]] for f in found]), "seg": pa.array([key[len(keys)].as_py()] * len(which), pa.int64())}
        if totals:
            table |= {"rule": pa.array(which, pa.int32())}
        else:
            table |= {"family": pa.array([families[k] for k in which], pa.string()), "rule_id": pa.array([ids[k] for k in which], pa.string())}
        for c in names:
            wide = totals or SUMMARY[c] == "long"
            values = np.concatenate([f[4][c] for f in found]) if found else np.zeros(0)
            table[c] = pa.array(values.astype(np.int64 if wide else float), pa.int64() if wide else pa.float64(), from_pandas=True)
        for c in () if totals else DEPTHS:
            table[c] = pa.array([x for f in found for x in f[4][c]], DEPTH)
        return pa.table(table)

    return run


def segments(rows: DataFrame, windows: DataFrame, rules: list[R.Rule], signals: Signals, step: str, seg_rows: int, keys: Sequence[str] = ("symbol",),
             bps: float = 10.0, gated: bool = False, inverse: bool = False) -> DataFrame:
    """Summaries (keys, window, gate, side, family, rule_id, seg, ...) of all rules over `rows`.

    rows: keys, ts, pos, ret, _x and, if `gated`, fusion_score and confidence. windows: keys, window,
    start_ts and, if `gated`, score_level and conf_level.
    """
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    typed = ", ".join(f"{k} {kinds[k]}" for k in keys)
    head = f"{typed}, window string, gate string, side string, seg long"
    chunks = -(-len(rules) // CHUNK_RULES)
    cut = stage(rows.withColumn("seg", R.segment_column(step, seg_rows).cast("long")).withColumn("ts", F.unix_micros("ts")), "sweep-rows")
    parts = cut.groupBy(*keys, "seg").agg(F.max("ts").alias("_end"))
    level = lambda c: (F.col(c) if gated else F.lit(None)).cast("double").alias(c)
    about = parts.join(windows.select(*keys, "window", F.unix_micros("start_ts").alias("start"), level("score_level"), level("conf_level")), keys).where("start <= _end").select(  # a row per segment and window
        *keys, "seg", "window", "start", "score_level", "conf_level", *[F.lit(None).cast("int").alias(c) for c in ("gate", "side", "rule")], F.lit(None).cast("long").alias("base"))
    each = lambda df: df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    group = [*keys, "seg", "chunk"]

    def run(side: DataFrame, totals: bool) -> DataFrame:
        schema = f"{head}, rule int, total long" if totals else f"{head}, family string, rule_id string, " + ", ".join([*[f"{k} {v}" for k, v in SUMMARY.items()], *[f"{k} array<struct<peak:double,low:double>>" for k in DEPTHS]])
        side = stage(side, "sweep-about")  # a few rows per group; written, as it stems from the rows it meets
        return each(cut).groupBy(*group).cogroup(side.groupBy(*group)).applyInArrow(_segment(keys, rules, signals, bps, gated, inverse, totals), schema)

    plain = each(about)
    if not parts.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        totals = run(plain, True).where("total <> 0")
        at = before([*keys, "window", "gate", "side", "rule"], ["seg"])
        segs = parts.select(*keys, "seg")
        # the count before a segment also holds for later segments without a total of their own
        every = totals.select(*keys, "window", "gate", "side", "rule").distinct().join(segs, keys).join(totals, [*keys, "window", "gate", "side", "rule", "seg"], "left")
        base = every.withColumn("base", F.coalesce(F.sum("total").over(at), F.lit(0))).where("base <> 0")
        plain = plain.unionByName(base.select(
            *keys, "seg", "window", F.lit(None).cast("long").alias("start"), F.lit(None).cast("double").alias("score_level"), F.lit(None).cast("double").alias("conf_level"),
            (F.col("gate") == GATES[1]).cast("int").alias("gate"), (F.col("side") == SIDES[1]).cast("int").alias("side"), "rule", "base", F.floor(F.col("rule") / CHUNK_RULES).cast("int").alias("chunk")))
    return run(plain, False)


def compared(rows: DataFrame, keys: Sequence[str], rules: list[R.Rule], signals: Signals) -> DataFrame:
    """Rule x bar pairs of two paths (`_path` 0 and 1 of each pos) and how many of them differ in entry or exit."""
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("_path", "ascending"), ("pos", "ascending")])
        x = table.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        half = len(table) // 2
        checked = changed = 0
        for (_, e0, z0), (_, e1, z1) in zip(signals(x[:half], rules), signals(x[half:], rules), strict=True):
            checked += e0.size
            changed += int(((e0 != e1) | (z0 != z1)).sum())
        return pa.table({**{k: pa.array([v.as_py()], v.type) for k, v in zip(keys, key)}, "checked": [checked], "changed": [changed]})

    parts = rows.groupBy(*keys, "seg").applyInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", checked long, changed long")
    return parts.groupBy(*keys).agg(F.sum("checked").alias("checked"), F.sum("changed").alias("changed"))


# --- merging ----------------------------------------------------------------------------------


def metrics(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The metrics of `backtest.rule_metrics` from segment summaries."""
    keys = list(keys)
    prior = before(keys, ["seg"])
    parts = parts.select("*", F.coalesce(F.product("growth").over(prior), F.lit(1.0)).alias("_e0"), F.coalesce(F.sum("starts").over(prior), F.lit(0)).alias("_t0"))
    e0, m0 = F.col("_e0"), F.col("_m0")
    least, most = F.least(e0 * F.col("lo"), e0 * F.col("hi")), F.greatest(e0 * F.col("lo"), e0 * F.col("hi"))
    parts = parts.withColumn("_m0", F.max(most).over(prior))
    depths = F.transform(F.when(e0 > 0, F.col("dips")).otherwise(F.col("rises")), lambda d: F.abs(e0) * d["low"] / nonzero(F.greatest(m0, F.abs(e0) * d["peak"])) - 1.0)
    fall = F.least(F.when(e0 > 0, F.col("worst")), least / nonzero(m0) - 1.0)
    fall = F.when(e0 == 0, -1.0).when(F.col("lo") < 0, F.array_min(depths)).otherwise(fall)
    # parts of trades at the ends of segments: those of one trade have the same number
    ends = F.filter(F.array(F.struct(F.col("_t0").alias("id"), F.col("head").alias("g")), F.struct((F.col("_t0") + F.col("starts")).alias("id"), F.col("tail").alias("g"))), lambda s: s["g"].isNotNull())
    curve = parts.withColumn("_ends", ends).groupBy(*keys).agg(
        (F.product("gross_growth") - 1.0).alias("total_return"), (F.product("growth") - 1.0).alias("net_return"), F.min(fall).alias("max_drawdown"), F.sum("n").alias("bars"),
        F.sum(F.col("n") * F.col("mean")).alias("_s1"), F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")).alias("_s2"),
        F.sum("trades").alias("_n"), F.sum("wins").alias("_w"), F.sum(F.col("trades") * F.col("trade_mean")).alias("_t1"), F.sum(F.col("trade_m2") + F.col("trades") * F.col("trade_mean") * F.col("trade_mean")).alias("_t2"),
        F.flatten(F.collect_list("_ends")).alias("_ends"))  # two parts a segment at most
    one = F.array_distinct(F.transform("_ends", lambda s: s["id"]))
    whole = F.transform(one, lambda i: F.aggregate(F.filter("_ends", lambda s: s["id"] == i), F.lit(1.0), lambda acc, s: acc * s["g"]) - 1.0)
    curve = curve.withColumn("_g", whole)
    total = lambda fn: F.aggregate("_g", F.lit(0.0), lambda acc, g: acc + fn(g))
    curve = curve.withColumns({
        "trades": F.col("_n") + F.size("_g"), "_w": F.col("_w") + total(lambda g: (g > 0).cast("double")), "_t1": F.col("_t1") + total(lambda g: g), "_t2": F.col("_t2") + total(lambda g: g * g)})
    count = F.greatest(F.col("trades"), F.lit(1))
    mean, tm = F.col("_s1") / F.col("bars"), F.col("_t1") / count
    std, ts = F.sqrt(F.greatest(F.col("_s2") / F.col("bars") - mean * mean, F.lit(0.0))), F.sqrt(F.greatest(F.col("_t2") / count - tm * tm, F.lit(0.0)))
    return curve.select(
        *keys, "total_return", "net_return", "max_drawdown", (F.col("_w") / count).alias("win_rate"), "trades", "bars",
        F.when(std > EPS, mean / std * BT.BARS_PER_YEAR**0.5).otherwise(0.0).alias("sharpe"),
        F.when(ts > EPS, tm / ts * F.sqrt("trades")).otherwise(0.0).alias("trade_sharpe"))
