"""Fusion of the feature families into one score, and what features are worth."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import EPS, clip, clip01, finite, min_max_scale
from barloom.operators import kernels as K
from barloom.operators.series import BLOCK_ROWS, by_blocks, look_up
from barloom.plans import features as FT
from barloom.session import stage

# Families, weights and the columns they are read from.
FAMILIES = ("trend", "oscillation", "risk", "flow", "timing")
FAMILY_PREFIX = {"trend": "trend", "oscillation": "oscillation", "risk": "risk_volatility", "flow": "flow_liquidity", "timing": "timing_execution"}
BASE_WEIGHTS = {"trend": 0.30, "oscillation": 0.20, "risk": 0.20, "flow": 0.20, "timing": 0.10}
FIXED_WEIGHTS = {"trend": 0.50, "oscillation": 0.00, "risk": 0.20, "flow": 0.25, "timing": 0.05}
# Raw columns of the fixed form, first present one wins.
FIXED_COLUMNS = {
    "trend": (FT.htf_name("logret", "15m"), FT.RET),
    "flow": (FT.SHOCKS, FT.REL_VOLUME),
    "risk": (FT.VOL60, FT.RANGE),
    "timing": (FT.clock_name("ttc_phase", "5m"), FT.JUMPS),
    "oscillation": (FT.htf_name("breakout_high_dist", "15m"), FT.TENSION),
}
MAX_RELEVANCE, BETA, FLOOR = 0.85, 3.0, 0.05


def family_columns(family: str, columns: Sequence[str]) -> dict[str, int]:
    """Columns of a family with their multiplicity: a column that also has a historical name counts twice."""
    double = set(FT.legacy_aliases().values())
    out = {c: 1 + (c in double) for c in columns if c.startswith(FAMILY_PREFIX[family] + "__")}
    if family == "flow" and FT.VOL_RET in columns:
        out[FT.VOL_RET] = 1
    return out


def _scaled(rows: DataFrame, keys: Sequence[str], cols: dict[str, Column]) -> DataFrame:
    """Add min-max scaled columns over each key's rows; the bounds are one aggregate row per key."""
    tmp = rows.select("*", *[c.alias(f"_x_{n}") for n, c in cols.items()])
    lim = tmp.groupBy(*keys).agg(
        *[F.min(f"_x_{n}").alias(f"_lo_{n}") for n in cols], *[F.max(f"_x_{n}").alias(f"_hi_{n}") for n in cols]
    )
    out = look_up(tmp, lim, list(keys), F.col("ts"))
    return out.select(*rows.columns, *[min_max_scale(F.col(f"_x_{n}"), F.col(f"_lo_{n}"), F.col(f"_hi_{n}")).alias(n) for n in cols])


def _fuse(rows: DataFrame, keys: Sequence[str], shares: tuple[float, float, float], keep: Sequence[str]) -> DataFrame:
    """Weighted components, score and confidence from raw_<family> and w_<family>."""
    parts = {
        f: (-F.col(f"w_{f}") * F.abs(f"raw_{f}") if f in ("risk", "timing") else F.col(f"w_{f}") * F.col(f"raw_{f}")) for f in FAMILIES
    }
    out = rows.select("*", *[c.alias(f"{f}_component") for f, c in parts.items()])
    total = F.lit(0.0)
    for f in FAMILIES:
        total = total + F.col(f"{f}_component")
    out = _scaled(out.withColumn("fusion_score", total), keys, {"_strength": F.abs("fusion_score"), "_pressure": F.abs("raw_risk")})
    support = clip01((F.col("raw_flow") + 1.0) / 2.0)
    conf = clip01(shares[0] * F.col("_strength") + shares[1] * support + shares[2] * (1.0 - F.col("_pressure")))
    return out.select(*keep, *[f"{f}_component" for f in FAMILIES], *[f"w_{f}" for f in FAMILIES], "fusion_score", conf.alias("confidence"))


def fixed_fusion(features: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Few degrees of freedom: constant weights on one raw column per family."""
    have = set(features.columns)

    def raw(f: str) -> Column:
        name = next((c for c in FIXED_COLUMNS[f] if c in have), None)
        return F.coalesce(F.col(name), F.lit(0.0)) if name else F.lit(0.0)

    rows = features.select(
        *keys, "ts", "pos", *[raw(f).alias(f"raw_{f}") for f in FAMILIES], *[F.lit(w).alias(f"w_{f}") for f, w in FIXED_WEIGHTS.items()]
    )
    return _fuse(rows, keys, (0.55, 0.25, 0.20), [*keys, "ts", "pos"])


def family_scores(features: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",), min_rows: int = 60,
                  rows: int = BLOCK_ROWS) -> DataFrame:
    """raw_<family>: mean over its columns of tanh of the expanding z-score."""
    members = {f: family_columns(f, columns) for f in FAMILIES}
    used = sorted({c for m in members.values() for c in m})
    z = K.expanding_z_wide(features.select(*keys, "ts", "pos", *dict.fromkeys([FT.RET, *used])), keys, used, min_rows, rows)

    def mean(m: dict[str, int]) -> Column:
        if not m:
            return F.lit(0.0)
        total = F.lit(0.0)
        for c, times in m.items():
            total = total + F.lit(float(times)) * F.tanh(f"z_{c}")
        return total / float(sum(m.values()))

    return z.select(*keys, "ts", "pos", F.col(FT.RET).alias("_ret"), *[mean(members[f]).alias(f"raw_{f}") for f in FAMILIES])


def adaptive_fusion(features: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",), rows: int = BLOCK_ROWS) -> DataFrame:
    """Softmax weights from each family's causal correlation with the return."""
    scores = stage(family_scores(features, columns, keys, rows=rows), "family-scores")

    def build(df: DataFrame, w) -> DataFrame:
        return K.ew_correlation(df, w, [*keys, "_blk"], [(f"rel_{f}", f"raw_{f}", "_ret") for f in FAMILIES])

    out = by_blocks(scores, keys, build, back=K.ew_correlation_reach(), rows=rows)
    total = F.lit(0.0)
    for f in FAMILIES:
        relevance = F.least(F.abs(f"rel_{f}"), F.lit(MAX_RELEVANCE))
        out = out.withColumn(f"_e_{f}", F.exp(clip(BETA * (0.65 + 1.35 * relevance) * BASE_WEIGHTS[f], -8.0, 8.0)))
        total = total + F.col(f"_e_{f}")
    out = out.withColumn("_sum", total)
    out = out.withColumns({f"_w_{f}": F.greatest(F.col(f"_e_{f}") / F.col("_sum"), F.lit(FLOOR)) for f in FAMILIES})
    norm = F.lit(0.0)
    for f in FAMILIES:
        norm = norm + F.col(f"_w_{f}")
    out = out.withColumn("_norm", norm)
    out = out.withColumns({f"w_{f}": F.col(f"_w_{f}") / F.col("_norm") for f in FAMILIES})
    return _fuse(out, keys, (0.50, 0.30, 0.20), [*keys, "ts", "pos"])


# --- what a feature is worth ------------------------------------------------------------------


def forward_returns(bars: DataFrame, horizon: int, keys: Sequence[str] = ("symbol",), rows: int = BLOCK_ROWS) -> DataFrame:
    """Log return over the next `horizon` bars, 0 at the end of the series."""

    def build(df: DataFrame, w) -> DataFrame:
        r = F.ln((F.lead("close", horizon).over(w) + EPS) / (F.col("close") + EPS))
        return df.withColumn("fwd_ret", F.coalesce(finite(r), F.lit(0.0)))

    return by_blocks(bars, keys, build, back=0, ahead=horizon, rows=rows)


def correlation(x: str, y: str) -> Column:
    """Correlation over the rows that have both, as an aggregate; NULL where either does not vary."""
    there = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.stddev_pop(F.when(there, F.col(x))) * F.stddev_pop(F.when(there, F.col(y)))
    return F.when(spread > 0, F.covar_pop(x, y) / spread)


def diagnostics(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",), target: str = "fwd_ret", min_rows: int = 80,
                top: int | None = 30) -> DataFrame:
    """Correlation with the forward return, coverage, utility and family share of each feature.

    One aggregate over the wide rows gives a row per key; it is turned long only then. A feature
    needs `min_rows` values and some spread.
    """
    clean = rows.select(*keys, target, *[finite(F.col(c)).alias(c) for c in columns])
    wide = clean.groupBy(*keys).agg(
        *[
            F.struct(
                F.lit(c).alias("name"), F.count(c).alias("n"), F.stddev_samp(c).alias("std"),
                correlation(c, target).alias("corr"), F.avg((F.abs(c) > EPS).cast("int")).alias("coverage"),
            ).alias(f"_{i}")
            for i, c in enumerate(columns)
        ]
    )
    long = wide.select(*keys, F.explode(F.array(*[f"_{i}" for i in range(len(columns))])).alias("r")).select(*keys, "r.*")
    ok = long.where((F.col("n") >= min_rows) & (F.col("std") > EPS)).withColumn("correlation", F.coalesce(finite(F.col("corr")), F.lit(0.0)))
    ok = ok.withColumn("utility", F.abs("correlation") * (0.5 + 0.5 * F.col("coverage"))).withColumn("family", FT.feature_family(F.col("name")))
    by_key, by_family = Window.partitionBy(*keys), Window.partitionBy(*keys, "family")
    total = F.sum("utility").over(by_key)
    out = ok.select(
        *keys, "name", "family", "utility", "correlation", "coverage", F.when(F.col("correlation") >= 0, "positive").otherwise("negative").alias("direction"),
        F.when(total > EPS, F.sum("utility").over(by_family) / total).otherwise(0.0).alias("family_share"),
        F.row_number().over(by_key.orderBy(F.desc(F.round("utility", 9)), "name")).alias("rank"),
    )
    return out if top is None else out.where(F.col("rank") <= top)


def pair_correlations(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """(keys, name, leader, corr) of every pair of columns, over the rows where both are finite.

    A task adds up the moments of all pairs as matrix products of its rows, about the means of the key;
    what is shuffled is one row per pair, key and task, summed on the way.
    """
    keys, d = list(keys), len(columns)
    clean = rows.select(*keys, *[finite(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    means = clean.groupBy(*keys).agg(F.array(*[F.coalesce(F.avg(f"c{i}"), F.lit(0.0)) for i in range(d)]).alias("_m"))
    shifted = look_up(clean, means, keys, F.struct(*[f"c{i}" for i in range(d)])).select(*keys, F.array(*[F.coalesce(F.col(f"c{i}") - F.get("_m", F.lit(i)), F.lit(float("nan"))) for i in range(d)]).alias("_x"))
    first, second = np.triu_indices(d, 1)
    kinds = {f.name: f.dataType.simpleString() for f in clean.schema.fields}
    names = ["n", "x", "y", "xx", "yy", "xy"]

    def moments(batches):
        for b in batches:
            pdf = pa.Table.from_batches([b]).select(keys).to_pandas()
            x = b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for key, at in pdf.groupby(keys, sort=False, dropna=False).indices.items():
                there = ~np.isnan(x[at])
                v, m = np.where(there, x[at], 0.0), there.astype(float)
                parts = [m.T @ m, v.T @ m, m.T @ v, (v * v).T @ m, m.T @ (v * v), v.T @ v]
                key = key if isinstance(key, tuple) else (key,)
                cols = [pa.array([k] * len(first)).cast(b.schema.field(c).type) for c, k in zip(keys, key)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(len(first), dtype=np.int32)), *[pa.array(p[first, second]) for p in parts]], [*keys, "pair", *names])

    sums = shifted.mapInArrow(moments, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", pair int, " + ", ".join(f"{c} double" for c in names)).groupBy(*keys, "pair").agg(*[F.sum(c).alias(c) for c in names])
    spread = lambda c: F.col(c + c) - F.col(c) * F.col(c) / F.greatest("n", F.lit(1.0))
    both = F.sqrt(F.greatest(spread("x"), F.lit(0.0))) * F.sqrt(F.greatest(spread("y"), F.lit(0.0)))
    corr = F.when((F.col("n") > 1) & (both > 0), (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / both)
    name = lambda side: F.element_at(F.array(*[F.lit(columns[i]) for i in side]), F.col("pair") + 1)
    return sums.select(*keys, name(first).alias("name"), name(second).alias("leader"), corr.alias("corr"))


def prune_candidates(rows: DataFrame, columns: Sequence[str], ranked: DataFrame, keys: Sequence[str] = ("symbol",), q: float = 0.20,
                     leaders: int = 10, top: int = 20) -> DataFrame:
    """Features of low utility, and the leading feature each resembles most.

    `ranked` is the whole `diagnostics` table (top=None).
    """
    keys = list(keys)
    cut = ranked.groupBy(*keys).agg(F.percentile("utility", F.lit(q)).alias("_cut"))
    low = ranked.join(cut, keys).where(F.col("utility") <= F.col("_cut"))
    lead = ranked.where(F.col("rank") <= leaders).select(*keys, F.col("name").alias("leader"))
    half = pair_correlations(rows, columns, keys).select(*keys, "name", "leader", F.abs("corr").alias("corr_abs"))
    full = half.unionByName(half.select(*keys, F.col("leader").alias("name"), F.col("name").alias("leader"), "corr_abs"))
    near = full.where(~F.isnan("corr_abs") & F.col("corr_abs").isNotNull()).join(lead, [*keys, "leader"])
    best = near.groupBy(*keys, "name").agg(F.max_by(F.struct("leader", "corr_abs"), F.struct(F.round("corr_abs", 9), "leader")).alias("b"))
    out = low.join(best, [*keys, "name"], "left").select(
        *keys, "name", "family", "utility", F.col("b.leader").alias("correlated_with"), F.coalesce("b.corr_abs", F.lit(0.0)).alias("correlation_abs")
    )
    reason = F.when((F.col("correlation_abs") >= 0.90) & F.col("correlated_with").isNotNull(), "low_utility_high_collinearity").otherwise("low_utility")
    out = out.withColumn("reason", reason)
    w = Window.partitionBy(*keys).orderBy((F.col("reason") == "low_utility").cast("int"), F.round("utility", 9), "name")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def weight_profile(fusion: DataFrame, entry: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mean size of each component on entry rows (all rows of keys without entries), as shares."""
    on = F.col(entry)
    cols = []
    for f in FAMILIES:
        c = F.col(f"{f}_component")
        cols.append(F.coalesce(F.avg(F.when(on, F.abs(c))), F.avg(F.abs(c))).alias(f"_s_{f}"))
        cols.append(F.coalesce(F.avg(F.when(on, c)), F.avg(c)).alias(f"{f}_component_avg"))
    out = fusion.groupBy(*keys).agg(*cols)
    total = F.lit(0.0)
    for f in FAMILIES:
        total = total + F.col(f"_s_{f}")
    return out.withColumn("_total", total).select(
        *keys,
        *[F.when(F.col("_total") <= EPS, 0.2).otherwise(F.col(f"_s_{f}") / F.col("_total")).alias(f"{f}_weight_share") for f in FAMILIES],
        *[f"{f}_component_avg" for f in FAMILIES],
    )
