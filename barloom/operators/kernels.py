"""Rolling, exponential and expanding statistics.

Functions that take a window `w` are frame expressions and are meant to run inside
`series.by_blocks`, with enough rows of history copied in.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from barloom.functions.expr import EPS, finite, nonzero
from barloom.operators.series import BLOCK_ROWS, before, carried, spread_blocks

# --- fixed row frames -------------------------------------------------------------------------


def frame(w: WindowSpec, rows: int) -> WindowSpec:
    return w.rowsBetween(-(rows - 1), 0)


def rolling(agg: Column, col: str, w: WindowSpec, rows: int, min_rows: int) -> Column:
    """A frame aggregate that is NULL until `min_rows` values are present."""
    f = frame(w, rows)
    return F.when(F.count(col).over(f) >= min_rows, agg.over(f))


def rolling_mean(col: str, w: WindowSpec, rows: int, min_rows: int) -> Column:
    return rolling(F.avg(col), col, w, rows, min_rows)


def rolling_min(col: str, w: WindowSpec, rows: int, min_rows: int) -> Column:
    return rolling(F.min(col), col, w, rows, min_rows)


def rolling_max(col: str, w: WindowSpec, rows: int, min_rows: int) -> Column:
    return rolling(F.max(col), col, w, rows, min_rows)


def rolling_std(col: str, w: WindowSpec, rows: int, min_rows: int, ddof: int = 1) -> Column:
    agg = F.stddev_samp(col) if ddof == 1 else F.stddev_pop(col)
    return rolling(agg, col, w, rows, min_rows)


def rolling_quantile(col: str, w: WindowSpec, rows: int, min_rows: int, q: float) -> Column:
    """Exact quantile of a frame. Costs rows x frame; use `rolling_order_stats` for long frames."""
    return rolling(F.percentile(col, F.lit(q)), col, w, rows, min_rows)


def trend_endpoint(y: str, x: str, w: WindowSpec, rows: int) -> Column:
    """Value of the least-squares line at the newest row of the frame."""
    f = frame(w, rows)
    fitted = F.regr_intercept(y, x).over(f) + F.regr_slope(y, x).over(f) * F.col(x)
    return F.when(F.count(y).over(f) >= rows, fitted)


# --- long rolling quantiles -------------------------------------------------------------------


@dataclass(frozen=True)
class OrderStat:
    """One rolling order statistic. `kind` is `quantile` or `robust_z`."""

    out: str
    col: str
    rows: int
    min_rows: int
    kind: str = "quantile"
    q: float = 0.5

    @property
    def reach(self) -> int:
        return 2 * self.rows if self.kind == "robust_z" else self.rows


def rolling_order_stats(
    df: DataFrame, keys: Sequence[str], stats: Sequence[OrderStat], rows: int = BLOCK_ROWS, pos: str = "pos"
) -> DataFrame:
    """Rolling quantiles and robust z-scores over long frames.

    Spark's frame percentile rebuilds every frame; here each (key, block) group - at most `rows`
    rows plus the copied history - goes through one Arrow batch and an incremental rolling
    quantile. Same numbers as `rolling_quantile`.
    """
    keys, stats = list(keys), list(stats)
    schema = T.StructType(df.schema.fields + [T.StructField(s.out, T.DoubleType()) for s in stats])
    names = schema.names

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, ignore_index=True)
        for s in stats:
            x = pdf[s.col].astype("float64")
            if s.kind == "quantile":
                pdf[s.out] = x.rolling(s.rows, min_periods=s.min_rows).quantile(s.q)
            else:
                med = x.rolling(s.rows, min_periods=s.min_rows).median()
                spread = 1.4826 * (x - med).abs().rolling(s.rows, min_periods=s.min_rows).median()
                pdf[s.out] = ((x - med) / spread.where(spread != 0.0)).fillna(0.0)
        own = pdf[pos] // rows == pdf["_blk"]
        return pdf.loc[own, names]

    spread = spread_blocks(df, back=max(s.reach for s in stats), rows=rows, pos=pos)
    out = spread.groupBy(*keys, "_blk").applyInPandas(run, schema)
    return out.select(*df.columns, *[F.when(~F.isnan(s.out), F.col(s.out)).alias(s.out) for s in stats])


# --- exponential means ------------------------------------------------------------------------


@dataclass(frozen=True)
class Ewm:
    """Exponentially weighted mean (recursive form) of column `col`."""

    out: str
    col: str
    alpha: float
    min_rows: int

    @property
    def decay(self) -> float:
        return -math.log1p(-self.alpha)

    @property
    def reach(self) -> int:
        """Rows after which an older value weighs less than one part in 10^17."""
        return max(self.min_rows, math.ceil(40.0 / self.decay))

    @property
    def chunk(self) -> int:
        """Rows per rescaled running sum: the largest power of four that cannot overflow."""
        return 4 ** max(1, math.floor(math.log(300.0 / self.decay, 4)))


def span(out: str, col: str, n: int, min_rows: int | None = None) -> Ewm:
    return Ewm(out, col, 2.0 / (n + 1.0), n if min_rows is None else min_rows)


def wilder(out: str, col: str, n: int) -> Ewm:
    return Ewm(out, col, 1.0 / n, n)


def ewm_in_block(df: DataFrame, w: WindowSpec, part: Sequence[str], specs: Sequence[Ewm], pos: str = "pos") -> DataFrame:
    """EWM columns for inputs without gaps (leading NULLs are fine), inside `by_blocks`.

    y[t] = g*y[t-1] + a*x[t] is rewritten as g^r * sum(x * g^-r): a running sum, so it stays a
    window aggregate. The sum restarts every `chunk` rows to keep g^-r finite, and takes the end
    of the chunk before as its start; what lies further back weighs e^-75 or less.
    """
    keep = df.columns
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    chunks = sorted({s.chunk for s in specs})
    out = df.withColumn("_r", F.row_number().over(w) - 1)
    out = out.select(
        "*",
        *[F.floor(F.col("_r") / c).alias(f"_c{c}") for c in chunks],
        *[F.count(s.col).over(upto).alias(f"_n_{s.out}") for s in specs],
    )
    terms = []
    for s in specs:
        inner = F.col("_r") % s.chunk
        weight = F.when(F.col(f"_n_{s.out}") == 1, F.lit(1.0)).otherwise(F.lit(s.alpha))
        terms.append((F.col(s.col) * weight * F.exp(inner * s.decay)).alias(f"_x_{s.out}"))
    out = out.select("*", *terms)
    sums = []
    for s in specs:
        inner = F.col("_r") % s.chunk
        cw = Window.partitionBy(*part, f"_c{s.chunk}").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        sums.append((F.exp(-inner * s.decay) * F.coalesce(F.sum(f"_x_{s.out}").over(cw), F.lit(0.0))).alias(f"_y_{s.out}"))
    out = out.select("*", *sums)
    done = []
    for s in specs:
        inner = F.col("_r") % s.chunk
        prev = F.last(F.when(inner == s.chunk - 1, F.col(f"_y_{s.out}")), ignorenulls=True).over(earlier)
        y = F.col(f"_y_{s.out}") + F.coalesce(F.exp(-(inner + 1) * s.decay) * prev, F.lit(0.0))
        done.append(F.when(F.col(f"_n_{s.out}") >= s.min_rows, y).alias(s.out))
    return out.select(*keep, *done)


def ewm_reach(specs: Sequence[Ewm]) -> int:
    return max(s.reach for s in specs)


def ewm_with_gaps(
    df: DataFrame, keys: Sequence[str], specs: Sequence[Ewm], rows: int = BLOCK_ROWS, pos: str = "pos"
) -> DataFrame:
    """EWM columns for inputs with NULLs inside the series; exact for any gap length.

    Across a gap of k rows the old weight decays k times: y = (g^k*y + a*x)/(g^k + a). Within a
    block every value is an affine function of the block's first observed mean, so one row per
    block is enough to find that mean; it is joined back on (key, block).
    """
    keys = list(keys)
    out = df.withColumn("_blk", F.floor(F.col(pos) / rows))
    part = [*keys, "_blk"]
    w = Window.partitionBy(*part).orderBy(pos)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)

    seen = [F.last(F.when(F.col(s.col).isNotNull(), F.col(pos)), ignorenulls=True).over(earlier) for s in specs]
    out = out.select(
        "*",
        *[(F.col(pos) - p).alias(f"_k_{s.out}") for s, p in zip(specs, seen)],
        *[F.count(s.col).over(upto).alias(f"_n_{s.out}") for s in specs],
    )
    out = _affine_terms(out, specs)
    out = _affine_scan(out, part, pos, [s.out for s in specs])

    ends = out.groupBy(*part).agg(
        *[
            F.struct(
                F.min_by(s.col, F.when(F.col(s.col).isNotNull(), F.col(pos))).alias("x0"),
                F.min(F.when(F.col(s.col).isNotNull(), F.col(pos))).alias("first"),
                F.max(F.when(F.col(s.col).isNotNull(), F.col(pos))).alias("last"),
                F.max_by(f"_cc_{s.out}", pos).alias("c"),
                F.max_by(f"_dd_{s.out}", pos).alias("d"),
                F.count(s.col).alias("n"),
            ).alias(f"_z_{s.out}")
            for s in specs
        ]
    )
    starts = _block_starts(ends, keys, specs)
    joined = out.join(carried(starts), part)
    final = []
    for s in specs:
        y = F.exp(F.col(f"_cc_{s.out}")) * F.col(f"_s_{s.out}.y0") + F.col(f"_dd_{s.out}")
        y = F.when(F.col(f"_n_{s.out}") > 0, y).otherwise(F.col(f"_s_{s.out}.carry"))
        n = F.col(f"_n_{s.out}") + F.coalesce(F.col(f"_s_{s.out}.n"), F.lit(0))
        final.append(F.when(n >= s.min_rows, y).alias(s.out))
    return joined.select(*df.columns, *final)


def _gap_weight(k: Column, s: Ewm) -> tuple[Column, Column]:
    """(weight of the old mean, weight of the new value) after a gap of k rows."""
    old = F.exp(-k * s.decay)
    return old / (old + s.alpha), F.lit(s.alpha) / (old + s.alpha)


def _affine_terms(df: DataFrame, specs: Sequence[Ewm]) -> DataFrame:
    cols = []
    for s in specs:
        k = F.col(f"_k_{s.out}")
        a, b = _gap_weight(k, s)
        later = F.col(s.col).isNotNull() & k.isNotNull()
        cols.append(F.when(later, F.greatest(F.ln(a), F.lit(-700.0))).otherwise(0.0).alias(f"_la_{s.out}"))
        cols.append(F.when(later, b * F.col(s.col)).otherwise(0.0).alias(f"_b_{s.out}"))
    return df.select("*", *cols)


def _affine_scan(df: DataFrame, part: Sequence[str], order: str, tags: Sequence[str]) -> DataFrame:
    """Solve D[t] = exp(la[t])*D[t-1] + b[t] from D = 0; C is the running sum of la."""
    w = Window.partitionBy(*part).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    out = df.select("*", *[F.sum(f"_la_{t}").over(upto).alias(f"_cc_{t}") for t in tags])
    out = out.select("*", *[F.floor(-F.col(f"_cc_{t}") / 300.0).alias(f"_q_{t}") for t in tags])
    sums = []
    for t in tags:
        shift = F.col(f"_cc_{t}") + 300.0 * F.col(f"_q_{t}")
        cw = Window.partitionBy(*part, f"_q_{t}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        sums.append((F.exp(shift) * F.sum(F.col(f"_b_{t}") * F.exp(-shift)).over(cw)).alias(f"_d_{t}"))
        sums.append((F.lead(f"_q_{t}").over(w) != F.col(f"_q_{t}")).alias(f"_end_{t}"))
    out = out.select("*", *sums)
    done = []
    for t in tags:
        prev = F.last(F.when(F.col(f"_end_{t}"), F.struct(F.col(f"_cc_{t}").alias("c"), F.col(f"_d_{t}").alias("d"))), ignorenulls=True).over(earlier)
        done.append(
            (F.col(f"_d_{t}") + F.coalesce(F.exp(F.col(f"_cc_{t}") - prev["c"]) * prev["d"], F.lit(0.0))).alias(f"_dd_{t}")
        )
    return out.select("*", *done).drop(*[f"_{p}_{t}" for t in tags for p in ("la", "b", "q", "d", "end")])


def _block_starts(ends: DataFrame, keys: Sequence[str], specs: Sequence[Ewm]) -> DataFrame:
    """From one row per block: mean at the block's first value, mean and count before the block."""
    prior = before(keys, ["_blk"])
    t = ends.select(
        "*",
        *[F.max(f"_z_{s.out}.last").over(prior).alias(f"_p_{s.out}") for s in specs],
        *[F.sum(f"_z_{s.out}.n").over(prior).alias(f"_n_{s.out}") for s in specs],
    )
    cols = []
    for s in specs:
        z = F.col(f"_z_{s.out}")
        k = z["first"] - F.col(f"_p_{s.out}")
        a, b = _gap_weight(k, s)
        la = F.when(z["n"] > 0, F.when(k.isNull(), F.lit(0.0)).otherwise(F.ln(a)) + z["c"]).otherwise(0.0)
        add = F.when(z["n"] > 0, F.exp(z["c"]) * F.when(k.isNull(), 1.0).otherwise(b) * z["x0"] + z["d"]).otherwise(0.0)
        cols += [F.greatest(la, F.lit(-1e6)).alias(f"_la_{s.out}"), add.alias(f"_b_{s.out}")]
    scanned = _affine_scan(t.select("*", *cols), keys, "_blk", [s.out for s in specs])
    prev = Window.partitionBy(*keys).orderBy("_blk")
    scanned = scanned.select("*", *[F.lag(f"_dd_{s.out}").over(prev).alias(f"_cy_{s.out}") for s in specs])
    starts = []
    for s in specs:
        z = F.col(f"_z_{s.out}")
        k = z["first"] - F.col(f"_p_{s.out}")
        a, b = _gap_weight(k, s)
        y0 = F.when(k.isNull(), z["x0"]).otherwise(a * F.col(f"_cy_{s.out}") + b * z["x0"])
        starts.append(F.struct(y0.alias("y0"), F.col(f"_cy_{s.out}").alias("carry"), F.col(f"_n_{s.out}").alias("n")).alias(f"_s_{s.out}"))
    return scanned.select(*keys, "_blk", *starts)


# --- expanding moments ------------------------------------------------------------------------


def expanding_z(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], min_rows: int, rows: int = BLOCK_ROWS, pos: str = "pos"
) -> DataFrame:
    """(x - mean)/std_pop of all earlier rows, per column, as `z_<column>`; 0 where undefined.

    Mean and squared deviations of the earlier blocks are merged with those inside the block.
    """
    keys = list(keys)
    out = df.withColumn("_blk", F.floor(F.col(pos) / rows))
    part = [*keys, "_blk"]
    stats = out.groupBy(*part).agg(
        *[F.count(c).alias(f"_n_{c}") for c in columns],
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[F.var_pop(c).alias(f"_v_{c}") for c in columns],
    )
    prior = before(keys, ["_blk"])
    sums = []
    for c in columns:
        n, m, v = F.col(f"_n_{c}"), F.col(f"_m_{c}"), F.col(f"_v_{c}")
        sums.append(F.struct(F.sum(n).over(prior).alias("n"), F.sum(n * m).over(prior).alias("s"), F.sum(n * (v + m * m)).over(prior).alias("q")).alias(f"_a_{c}"))
    merged = stats.select(*part, *sums)
    w = Window.partitionBy(*part).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    inside = out.select(
        "*",
        *[F.count(c).over(w).alias(f"_n_{c}") for c in columns],
        *[F.avg(c).over(w).alias(f"_m_{c}") for c in columns],
        *[F.var_pop(c).over(w).alias(f"_v_{c}") for c in columns],
    ).join(carried(merged), part)
    zs = []
    for c in columns:
        n1, s1, t1 = (F.coalesce(F.col(f"_a_{c}.{p}"), F.lit(0.0)) for p in "nsq")
        m1 = F.coalesce(s1 / nonzero(n1), F.lit(0.0))
        q1 = t1 - n1 * m1 * m1
        n2, m2, v2 = (F.coalesce(F.col(f"_{p}_{c}"), F.lit(0.0)) for p in "nmv")
        n = n1 + n2
        mean = (n1 * m1 + n2 * m2) / nonzero(n)
        sq = q1 + n2 * v2 + n1 * n2 / nonzero(n) * (m2 - m1) * (m2 - m1)
        std = nonzero(F.sqrt(F.greatest(sq / nonzero(n), F.lit(0.0))))
        z = F.when(n >= min_rows, finite((F.col(c) - mean) / std))
        zs.append(F.coalesce(z, F.lit(0.0)).alias(f"z_{c}"))
    return inside.select(*df.columns, *zs)


def ew_correlation(
    df: DataFrame, w: WindowSpec, part: Sequence[str], pairs: Sequence[tuple[str, str, str]],
    alpha: float = 0.02, min_rows: int = 120, pos: str = "pos",
) -> DataFrame:
    """Causal exponentially weighted correlation; `pairs` holds (out, signal, return) names.

    The signal is lagged one row. Runs inside `by_blocks` with `ew_correlation_reach` rows back.
    """
    keep = df.columns
    pairs = list(pairs)
    out = df
    for o, x, y in pairs:
        out = out.withColumn(f"_x_{o}", F.coalesce(F.lag(x).over(w), F.lit(0.0))).withColumn(
            f"_y_{o}", F.coalesce(F.col(y), F.lit(0.0))
        )
    means = [Ewm(f"_m{s}_{o}", f"_{s}_{o}", alpha, min_rows) for o, _, _ in pairs for s in "xy"]
    out = ewm_in_block(out, w, part, means, pos)
    for o, _, _ in pairs:
        dx, dy = F.col(f"_x_{o}") - F.col(f"_mx_{o}"), F.col(f"_y_{o}") - F.col(f"_my_{o}")
        out = out.withColumns({f"_xy_{o}": dx * dy, f"_xx_{o}": dx * dx, f"_yy_{o}": dy * dy})
    second = [Ewm(f"_e{s}_{o}", f"_{s}_{o}", alpha, min_rows) for o, _, _ in pairs for s in ("xy", "xx", "yy")]
    out = ewm_in_block(out, w, part, second, pos)
    cols = []
    for o, _, _ in pairs:
        corr = F.col(f"_exy_{o}") / F.sqrt(F.col(f"_exx_{o}") * F.col(f"_eyy_{o}") + EPS)
        cols.append(F.coalesce(finite(corr), F.lit(0.0)).alias(o))
    return out.select(*keep, *cols)


def ew_correlation_reach(alpha: float = 0.02, min_rows: int = 120) -> int:
    return 2 * (Ewm("", "", alpha, min_rows).reach + min_rows) + 1


def expanding_z_wide(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], min_rows: int, rows: int = BLOCK_ROWS, pos: str = "pos"
) -> DataFrame:
    """`expanding_z` for dozens of columns: the same block merge, with one Arrow batch per block.

    Count, mean and squared deviations of all earlier blocks arrive as one small row per block and
    column, co-grouped with the block's rows.
    """
    keys, columns = list(keys), list(columns)
    part = [*keys, "_blk"]
    src = df.withColumn("_blk", F.floor(F.col(pos) / rows))
    wide = src.groupBy(*part).agg(
        *[F.struct(F.lit(i).alias("i"), F.count(c).alias("n"), F.avg(c).alias("m"), F.var_pop(c).alias("v")).alias(f"_{i}") for i, c in enumerate(columns)]
    )
    long = wide.select(*part, F.explode(F.array(*[f"_{i}" for i in range(len(columns))])).alias("s")).select(*part, "s.*")
    prior = Window.partitionBy(*keys, "i").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    m = F.coalesce("m", F.lit(0.0))
    stats = long.select(
        *[F.col(k).alias(f"_of_{k}") for k in part], "i", F.sum("n").over(prior).alias("n"), F.sum(F.col("n") * m).over(prior).alias("s"),
        F.sum(F.col("n") * (F.coalesce("v", F.lit(0.0)) + m * m)).over(prior).alias("q"),
    )
    schema = T.StructType(df.schema.fields + [T.StructField(f"z_{c}", T.DoubleType()) for c in columns])
    kept = list(df.columns)

    def run(block: pd.DataFrame, earlier: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(pos, ignore_index=True)
        e = earlier.sort_values("i").fillna(0.0)
        n1, s1, q1 = (e[k].to_numpy(float) for k in ("n", "s", "q"))
        m1 = np.divide(s1, n1, out=np.zeros_like(s1), where=n1 > 0)
        q1 = q1 - n1 * m1 * m1
        x = block[columns].to_numpy(float)
        seen = ~np.isnan(x)
        centre = np.nan_to_num(x[0])  # a constant column then deviates by exactly 0
        d = np.where(seen, x - centre, 0.0)

        def lagged(a: np.ndarray) -> np.ndarray:
            out = np.zeros(a.shape)
            out[1:] = np.cumsum(a, axis=0)[:-1]
            return out

        n2, a, b = lagged(seen.astype(float)), lagged(d), lagged(d * d)
        with np.errstate(divide="ignore", invalid="ignore"):
            off = np.where(n2 > 0, a / n2, 0.0)
            m2, q2 = centre + off, b - n2 * off * off
            n = n1 + n2
            mean = (n1 * m1 + n2 * m2) / n
            sq = q1 + q2 + n1 * n2 / n * (m2 - m1) ** 2
            var = sq / n
            z = (x - mean) / np.sqrt(np.where(var > 1e-15 * mean * mean, var, np.nan))
        z[(n < min_rows) | ~np.isfinite(z)] = 0.0
        return pd.concat([block[kept], pd.DataFrame(z, columns=[f"z_{c}" for c in columns])], axis=1)

    return src.groupBy(*part).cogroup(stats.groupBy(*[f"_of_{k}" for k in part])).applyInPandas(run, schema)
