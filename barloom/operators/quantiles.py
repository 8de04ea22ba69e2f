"""Exact quantiles of groups of any size, by rank bracketing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.series import look_up, running_sum
from barloom.session import stage

ACCURACY = 2_000  # of the sketch: ranks are off by one part in so many at most
BAND_ROWS = 50_000  # distinct values of a bracket that one task numbers, on average


def exact_quantiles(rows: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]], accuracy: int = ACCURACY, band_rows: int = BAND_ROWS) -> DataFrame:
    """Linear-interpolated quantiles per key: out column -> (column, q).

    The built-in exact percentile keeps every distinct value of a group in one buffer. Here a sketch
    gives each quantile a bracket of values around its rank; a second pass counts the values below and
    inside; only those inside, about four parts in `accuracy`, are shuffled and numbered. A bracket
    that should miss its rank is widened to everything, so the result never rests on the sketch. NULLs
    are left out; a key without values has NULL quantiles.
    """
    keys, names = list(keys), list(wanted)
    cols = sorted({c for c, _ in wanted.values()})
    anchor = keys if keys else ["_all"]
    src = rows.select(*keys, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    src = stage(src if keys else src.withColumn("_all", F.lit(0)), "quantile-values")
    at = {o: cols.index(wanted[o][0]) for o in names}
    margin = 2.0 / accuracy
    near: dict[int, list[float]] = {i: sorted({min(1.0, max(0.0, wanted[o][1] + d)) for o in names if at[o] == i for d in (-margin, margin)}) for i in range(len(cols))}

    shape = src.groupBy(*anchor).agg(
        *[F.count(f"_x{i}").alias(f"_n{i}") for i in near], *[F.min(f"_x{i}").alias(f"_least{i}") for i in near], *[F.max(f"_x{i}").alias(f"_most{i}") for i in near],
        *[F.percentile_approx(f"_x{i}", ps, accuracy).alias(f"_s{i}") for i, ps in near.items()])

    def edge(o: str, way: int) -> Column:
        i, p = at[o], min(1.0, max(0.0, wanted[o][1] + way * margin))
        return F.col(f"_least{i}") if p == 0.0 else F.col(f"_most{i}") if p == 1.0 else F.get(f"_s{i}", F.lit(near[i].index(p)))

    shape = stage(shape.select(*anchor, *[f"_n{i}" for i in near], *[f"_least{i}" for i in near], *[f"_most{i}" for i in near],
                               *[F.struct(edge(o, -1).alias("lo"), edge(o, 1).alias("hi")).alias(f"_b{k}") for k, o in enumerate(names)]), "quantile-brackets")
    salt = F.struct(*[f"_x{i}" for i in near])
    x = [F.col(f"_x{at[o]}") for o in names]
    inside = [x[k].between(F.col(f"_b{k}.lo"), F.col(f"_b{k}.hi")) for k in range(len(names))]
    counted = look_up(src, shape, anchor, salt).groupBy(*anchor).agg(
        *[F.count_if(x[k] < F.col(f"_b{k}.lo")).alias(f"_below{k}") for k in range(len(names))], *[F.count_if(inside[k]).alias(f"_in{k}") for k in range(len(names))])
    shape = shape.join(counted, anchor)
    rank = [F.lit(float(wanted[o][1])) * (F.col(f"_n{at[o]}") - 1) for o in names]
    fits = [(F.col(f"_below{k}") <= F.floor(rank[k])) & (F.ceil(rank[k]) < F.col(f"_below{k}") + F.col(f"_in{k}")) for k in range(len(names))]
    found = lambda k, o: F.struct(
        F.when(fits[k], F.col(f"_b{k}.lo")).otherwise(F.col(f"_least{at[o]}")).alias("lo"), F.when(fits[k], F.col(f"_b{k}.hi")).otherwise(F.col(f"_most{at[o]}")).alias("hi"),
        F.when(fits[k], F.col(f"_below{k}")).otherwise(0).alias("below"), F.when(fits[k], F.col(f"_in{k}")).otherwise(F.col(f"_n{at[o]}")).alias("size"))
    shape = stage(shape.select(*anchor, *[rank[k].alias(f"_r{k}") for k in range(len(names))], *[found(k, o).alias(f"_b{k}") for k, o in enumerate(names)]), "quantile-ranks")

    most = shape.agg(F.max(F.greatest(*[F.col(f"_b{k}.size") for k in range(len(names))], F.lit(0)))).first()[0] or 0
    bands = min(4096, max(1, -(-most // band_rows)))
    marked = look_up(src, shape, anchor, salt)
    some = F.filter(F.array(*[F.when(x[k].between(F.col(f"_b{k}.lo"), F.col(f"_b{k}.hi")), F.struct(F.lit(k).alias("_q"), x[k].alias("_x"), F.col(f"_b{k}.below").alias("_below"), F.col(f"_r{k}").alias("_rank"))) for k in range(len(names))]), lambda s: s.isNotNull())
    counts = marked.select(*anchor, F.explode(some).alias("_v")).groupBy(*anchor, "_v._q", "_v._x", "_v._below", "_v._rank").agg(F.count("*").alias("_n"))
    group = [*anchor, "_q"]
    if bands > 1:  # a bracket of many distinct values is numbered in bands of about equal size
        counts = stage(counts, "quantile-inside")
        cuts = counts.groupBy(*group).agg(F.percentile_approx("_x", [i / bands for i in range(1, bands)], 10 * bands).alias("_cuts"))
        counts = look_up(counts, cuts, group, F.col("_x")).withColumn("_band", F.size(F.filter("_cuts", lambda c: c < F.col("_x")))).drop("_cuts")
    else:
        counts = counts.withColumn("_band", F.lit(0))
    upto = running_sum(counts, group, "_band", ["_x"], {"_upto": F.col("_n")}).withColumn("_upto", F.col("_upto") + F.col("_below"))
    holds = lambda r: F.max(F.when((F.col("_upto") > r) & (F.col("_upto") - F.col("_n") <= r), F.col("_x")))
    lo, hi = holds(F.floor("_rank")), holds(F.ceil("_rank"))
    per = upto.groupBy(*group).agg((lo + (hi - lo) * F.max(F.col("_rank") - F.floor("_rank"))).alias("_value"))
    wide = per.groupBy(*anchor).agg(*[F.max(F.when(F.col("_q") == k, F.col("_value"))).alias(o) for k, o in enumerate(names)])
    out = shape.select(*anchor).join(wide, anchor, "left")
    return out if keys else out.drop("_all")
