"""Triple-barrier labels and the filter trained on them."""

from __future__ import annotations

from functools import reduce
import json
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from barloom.functions.expr import EPS, finite, nonzero
from barloom.operators import kernels as K
from barloom.operators.quantiles import exact_quantiles
from barloom.operators.series import BLOCK_ROWS, by_blocks, dense_position, look_up, ordered_sums, running_sum
from barloom.plans.rules import true_range
from barloom.session import stage


FIT_ROWS = 100_000  # training rows of a fold that a task fits on its own


@dataclass(frozen=True)
class FilterConfig:
    """Settings of the entry filter."""

    horizon: int = 48
    take: float = 1.5
    stop: float = 1.0
    vol_window: int = 14
    bps: float = 10.0
    min_events: int = 40
    allowlist: tuple[str, ...] = ()
    cap: int = 3
    groups: int = 6
    test_groups: int = 2
    gap: int = 24
    max_folds: int = 24
    penalty: str = "l1"
    c: float = 0.25
    balanced: bool = True
    grid: tuple[float, float, float] = (0.50, 0.95, 0.05)
    floor: float = 0.60
    objective: str = "f05"


def lagged_atr_ratio(df: DataFrame, w: WindowSpec, window: int, name: str = "atr_ratio") -> DataFrame:
    """Rolling mean of true range over the previous close, one row late. Needs window + 2 rows back."""
    scale = nonzero(F.abs(F.lag("close").over(w)))
    n = max(2, window)
    out = df.withColumn("_trr", true_range(w) / (scale + EPS))
    out = out.withColumn("_mean", K.rolling_mean("_trr", w, n, max(2, window // 2)))
    return out.withColumn(name, finite(F.lag("_mean").over(w))).drop("_trr", "_mean")


# --- barrier events ---------------------------------------------------------------------------


def barrier_events(
    bars: DataFrame, horizon: int, take: float, stop: float, vol_window: int = 14, bps: float = 10.0,
    keys: Sequence[str] = ("symbol",), rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Outcome of every entry: which barrier its price meets first within `horizon` bars.

    `bars` needs dense positions and a boolean `entry`. The next `horizon` bars are looked at in a
    forward frame of the block; both barriers in one bar count as the stop.
    """
    keys = list(keys)

    def reference(df: DataFrame, w: WindowSpec) -> DataFrame:
        return lagged_atr_ratio(df, w, vol_window, "_atr")

    rated = stage(by_blocks(bars, keys, reference, back=vol_window + 2, rows=rows), "rated-bars")
    size = rated.groupBy(*keys).agg(F.max("pos").alias("_last")).join(exact_quantiles(rated, keys, {"_mid": ("_atr", 0.5)}), keys)

    def ahead(df: DataFrame, w: WindowSpec) -> DataFrame:
        nxt = F.collect_list(F.struct("pos", "high", "low", "close")).over(w.rowsBetween(1, horizon))
        return df.withColumn("_next", F.when(F.col("entry"), nxt))

    e = by_blocks(rated, keys, ahead, back=0, ahead=horizon, rows=rows).where("entry")
    e = look_up(e, size, keys, F.col("pos"))
    e = e.where((F.col("pos") < F.col("_last") - 1) & (F.col("close") > 0))
    fallback = F.when(F.col("_mid") > 0, F.col("_mid")).otherwise(0.001)
    vol = F.greatest(F.when(F.col("_atr") > 0, F.col("_atr")).otherwise(fallback), F.lit(1e-6))
    e = e.withColumn("volatility", vol)
    up, down = max(take, 0.05) * F.col("volatility"), max(stop, 0.05) * F.col("volatility")
    e = e.withColumns({"_up": F.col("close") * (1.0 + up), "_dn": F.col("close") * F.greatest(F.lit(0.01), 1.0 - down)})
    hits = F.filter("_next", lambda b: (b["high"] >= F.col("_up")) | (b["low"] <= F.col("_dn")))
    e = e.withColumn("_hit", F.get(hits, F.lit(0))).withColumn("_end", F.element_at("_next", -1))
    touched = F.col("_hit").isNotNull()
    exit_bar = F.coalesce("_hit", "_end")
    net = exit_bar["close"] / (F.col("close") + EPS) - 1.0 - 2.0 * bps / 10_000.0
    stopped = F.col("_hit.low") <= F.col("_dn")
    provenance = F.when(touched & stopped, "sl_first").when(touched, "tp_first").when(net > 0, "vertical_pos").otherwise("vertical_nonpos")
    out = e.select(
        *keys, "ts", F.col("pos").alias("entry_idx"), exit_bar["pos"].alias("exit_idx"), "volatility", net.alias("net_return"), provenance.alias("provenance"),
    )
    return out.withColumn("label", F.col("provenance").isin("tp_first", "vertical_pos").cast("int"))


def uniqueness_weights(events: DataFrame, bars: DataFrame, keys: Sequence[str] = ("symbol",), rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean of 1/concurrency over each event's bars, scaled to mean 1 per key.

    Concurrency is a running sum of starts and ends; the mean over a span is a difference of two
    prefix sums. Nothing multiplies with the length of an event.
    """
    keys = list(keys)
    starts = events.groupBy(*keys, (F.col("entry_idx") + 1).alias("pos")).agg(F.count("*").alias("_s"))
    ends = events.groupBy(*keys, (F.col("exit_idx") + 1).alias("pos")).agg(F.count("*").alias("_t"))
    flow = bars.select(*keys, "pos").join(starts, [*keys, "pos"], "left").join(ends, [*keys, "pos"], "left")
    flow = flow.withColumn("_blk", F.floor(F.col("pos") / rows))
    step = F.coalesce("_s", F.lit(0)) - F.coalesce("_t", F.lit(0))
    live = running_sum(flow, keys, "_blk", ["pos"], {"live": step}).select(*keys, "pos", "_blk", "live")
    part = F.when(F.col("live") > 0, 1.0 / F.col("live")).otherwise(0.0)
    total = running_sum(live, keys, "_blk", ["pos"], {"area": part}).select(*keys, "pos", "area")
    a = total.select(*keys, F.col("pos").alias("entry_idx"), F.col("area").alias("_a0"))
    b = total.select(*keys, F.col("pos").alias("exit_idx"), F.col("area").alias("_a1"))
    raw = events.join(a, [*keys, "entry_idx"]).join(b, [*keys, "exit_idx"])
    raw = raw.withColumn("_w", F.when(F.col("exit_idx") > F.col("entry_idx"), (F.col("_a1") - F.col("_a0")) / (F.col("exit_idx") - F.col("entry_idx"))).otherwise(1.0))
    mean = raw.groupBy(*keys).agg(F.avg("_w").alias("_m"))
    out = look_up(raw, mean, keys, F.col("entry_idx")).withColumn("weight", F.when(F.col("_m") > EPS, F.col("_w") / F.col("_m")).otherwise(F.col("_w")))
    return out.select(*events.columns, "weight")


# --- folds ------------------------------------------------------------------------------------


def fold_table(groups: int, test_groups: int, max_folds: int) -> list[tuple[int, list[int]]]:
    """All choices of test groups, thinned evenly to `max_folds` (a constant of the configuration)."""
    combos = list(combinations(range(groups), max(1, min(test_groups, groups - 1))))
    if len(combos) > max_folds:
        combos = combos[:: max(1, len(combos) // max_folds)][:max_folds]
    return [(i, list(c)) for i, c in enumerate(combos)]


def cpcv_rows(
    events: DataFrame, n_groups: int = 6, test_groups: int = 2, gap: int = 0, max_folds: int = 24, min_train: int = 10,
    keys: Sequence[str] = ("symbol",), rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(event, fold, role) rows: contiguous event groups, every combination of test groups, and a
    band around the test span kept out of training. Folds with too little training data drop out.
    """
    keys = list(keys)
    numbered = dense_position(events, keys, ["entry_idx"], F.floor(F.col("entry_idx") / rows), "event_no")
    n = numbered.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n >= 4")
    k = F.greatest(F.lit(3), F.least(F.lit(n_groups), F.col("_n"))).cast("long")
    q, extra = F.floor(F.col("_n") / F.col("_k")), F.col("_n") % F.col("_k")
    big = extra * (q + 1)
    group = F.when(F.col("event_no") < big, F.floor(F.col("event_no") / (q + 1))).otherwise(extra + F.floor((F.col("event_no") - big) / q))
    g = look_up(numbered, n, keys, F.col("entry_idx")).withColumn("_k", k).withColumn("grp", group.cast("int"))
    spans = g.groupBy(*keys, "_k", "grp").agg(F.min("entry_idx").alias("_lo"), F.max("entry_idx").alias("_hi"), F.count("*").alias("_c"))
    folds = [(size, i, c) for size in range(3, n_groups + 1) for i, c in fold_table(size, test_groups, max_folds)]
    table = F.from_json(F.lit(json.dumps([{"k": s, "fold": i, "test": c} for s, i, c in folds])), "array<struct<k:bigint,fold:int,test:array<int>>>")
    options = spans.withColumn("f", F.explode(table)).where((F.col("f.k") == F.col("_k")) & F.array_contains("f.test", F.col("grp")))
    band = options.groupBy(*keys, F.col("f.fold").alias("fold")).agg(
        F.first("f.test").alias("test"), (F.min("_lo") - gap).alias("_b0"), (F.max("_hi") + gap).alias("_b1"))
    packed = band.groupBy(*keys).agg(F.collect_list(F.struct("fold", "test", "_b0", "_b1")).alias("_folds"))  # at most max_folds per key
    each = look_up(g, packed, keys, F.col("entry_idx")).withColumn("_f", F.explode("_folds"))
    inside = F.array_contains("_f.test", F.col("grp"))
    banned = F.col("entry_idx").between(F.col("_f._b0"), F.col("_f._b1"))
    out = each.withColumn("role", F.when(inside, "test").when(~banned, "train")).where("role IS NOT NULL")
    out = out.select(*numbered.columns, F.col("_f.fold").alias("fold"), "role")
    enough = out.groupBy(*keys, "fold").agg(F.count_if(F.col("role") == "train").alias("_t")).where(F.col("_t") >= min_train)
    return out.join(enough.select(*keys, "fold"), [*keys, "fold"], "left_semi")


def finite(c: str | Column) -> Column:
    """NULL for NaN and infinity."""
    x = F.col(c).cast("double") if isinstance(c, str) else c
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def standardise(rows: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Scale features with the mean and population std of the fold's training rows.

    A std below 1e-9 counts as 1, so a feature that is constant in training stays in its own units.
    Values that are missing or not finite count neither in the mean nor in the std and become 0.
    """
    train = F.col("role") == "train"
    stats = rows.groupBy(*keys).agg(
        *[F.avg(F.when(train, finite(c))).alias(f"_m_{c}") for c in features],
        *[F.stddev_pop(F.when(train, finite(c))).alias(f"_s_{c}") for c in features],
    )
    unit = lambda c: F.when(F.col(f"_s_{c}") < 1e-9, 1.0).otherwise(F.col(f"_s_{c}"))
    scaled = {c: F.coalesce(finite((finite(c) - F.col(f"_m_{c}")) / unit(c)), F.lit(0.0)) for c in features}
    return look_up(rows, stats, list(keys), F.struct(*features)).select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in rows.columns])


# --- logistic regression over all folds at once -----------------------------------------------


def _newton_step(h: np.ndarray, g: np.ndarray, beta: np.ndarray, penalty: str, c: float) -> np.ndarray:
    """Next coefficients from the summed curvature and gradient of one fold (intercept last)."""
    d = len(beta) - 1
    h, g = c * h, c * g
    if penalty == "l2":
        ridge = np.diag(np.r_[np.ones(d), 0.0])
        return beta - np.linalg.solve(h + ridge + 1e-10 * np.eye(d + 1), g + ridge @ beta)
    new = beta.copy()
    for _ in range(10_000):
        last = new.copy()
        for j in range(d + 1):
            grad = g[j] + h[j] @ (new - beta)
            curve = h[j, j] + 1e-10
            target = new[j] - grad / curve
            new[j] = target if j == d else np.sign(target) * max(abs(target) - 1.0 / curve, 0.0)
        if np.abs(new - last).max() < 1e-13:
            break
    return new


def _penalised(loss: float, beta: np.ndarray, penalty: str, c: float) -> float:
    return c * loss + (0.5 * (beta[:-1] ** 2).sum() if penalty == "l2" else np.abs(beta[:-1]).sum())


def _fit_one(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: str, c: float, iterations: int, tolerance: float) -> tuple[np.ndarray, bool]:
    """The fit of one fold that is small enough for a task: the same steps as `fit_folds` takes."""
    x = np.c_[x, np.ones(len(x))]

    def sums(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = x @ beta
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
        loss = (w * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0.0) - y * z)).sum()
        return _penalised(loss, beta, penalty, c), x.T @ (w * (p - y)), (x * (w * p * (1.0 - p))[:, None]).T @ x

    best = np.zeros(x.shape[1])
    least, g, h = sums(best)
    for _ in range(iterations):
        step, scale = _newton_step(h, g, best, penalty, c) - best, 1.0
        while True:
            if np.abs(scale * step).max() < tolerance:
                return best, True
            total, g1, h1 = sums(best + scale * step)
            if total <= least + 1e-12 * abs(least):
                break
            scale /= 2
        best, least, g, h = best + scale * step, total, g1, h1
    return best, False


def fit_folds(
    rows: DataFrame, features: Sequence[str], keys: Sequence[str], weight: str = "weight", label: str = "label", penalty: str = "l1",
    c: float = 0.25, balanced: bool = True, iterations: int = 2500, tolerance: float = 1e-8, small: int = FIT_ROWS,
) -> DataFrame:
    """Weighted logistic regression of every (key, fold) at the same time: (keys, beta, converged).

    Folds need both classes in training and in test; missing features count as 0. Where no fold has
    more than `small` training rows, each is one group of a grouped fit. Otherwise one Newton iteration
    is one aggregation: loss, gradient and curvature of a fold are sums over its training rows, so no
    fold is ever gathered in one task, and only the small system of each fold is solved in Python. A
    step that raises the penalised loss is halved. A fold is done when its largest change is below
    `tolerance`; only the others are read again.
    """
    keys, x = list(keys), list(features)
    d = len(x) + 1
    y = F.col(label)
    kinds = rows.groupBy(*keys).agg(
        *[F.count_if((F.col("role") == role) & (y == v)).alias(f"_{role}{v}") for role in ("train", "test") for v in (0, 1)]
    ).where("_train0 > 0 AND _train1 > 0 AND _test0 > 0 AND _test1 > 0")
    n = F.col("_train0") + F.col("_train1")
    balance = n / (2.0 * F.when(y == 1, F.col("_train1")).otherwise(F.col("_train0"))) if balanced else F.lit(1.0)
    clean = [F.coalesce(finite(f), F.lit(0.0)).alias(f) for f in x]
    train = stage(
        look_up(rows.where("role = 'train'"), kinds, keys, F.struct(*x)).select(*keys, *clean, y.alias("_y"), (F.col(weight) * balance).alias("_w")), "fold-train"
    )
    most = train.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= small:
        typed = T.StructType([train.schema[k] for k in keys] + [T.StructField("beta", T.ArrayType(T.DoubleType())), T.StructField("converged", T.BooleanType())])

        def fit(pdf):
            beta, settled = _fit_one(pdf[x].to_numpy(float), pdf["_y"].to_numpy(float), pdf["_w"].to_numpy(float), penalty, c, iterations, tolerance)
            return pdf[keys].head(1).assign(beta=[beta.tolist()], converged=[settled])

        return stage(train.groupBy(*keys).applyInPandas(fit, typed), "fold-fits")
    numbers = lambda k: F.array(*[F.lit(0.0)] * k)
    state = train.select(*keys).distinct().withColumns({
        "beta": numbers(d), "best": numbers(d), "least": F.lit(float("inf")), "step": numbers(d), "scale": F.lit(1.0), "converged": F.lit(False)})
    fields = ["beta", "best", "least", "step", "scale", "converged"]
    schema = T.StructType([train.schema[k] for k in keys] + [state.schema[f] for f in fields])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                beta, best, least, step, scale = (np.array(v, float) for v in (r.beta, r.best, r.least, r.step, r.scale))
                total = _penalised(r.loss, beta, penalty, c)
                if total <= least + 1e-12 * abs(least) if np.isfinite(least) else True:
                    m = np.zeros((d, d))
                    for (i, j), v in zip(pairs, r.h):
                        m[i, j] = m[j, i] = v
                    best, least, scale = beta, total, 1.0
                    step = _newton_step(m, np.asarray(r.g, float), beta, penalty, c) - beta
                else:
                    scale = scale / 2
                small = np.abs(scale * step).max() < tolerance
                out.append((best if small else best + scale * step, best, float(least), step, float(scale), bool(small)))
            yield pdf[keys].assign(**{f: [o[k] for o in out] for k, f in enumerate(fields)})

    done = []
    for i in range(iterations):
        t = look_up(train, state, keys, F.struct(*x, "_w"))
        vals = [F.col(f) for f in x] + [F.lit(1.0)]
        t = t.withColumn("_z", _dot(x)).withColumn("_p", 1.0 / (1.0 + F.exp(-F.col("_z")))).withColumn("_k", F.col("_w") * F.col("_p") * (1.0 - F.col("_p")))
        loss = F.log1p(F.exp(-F.abs("_z"))) + F.greatest("_z", F.lit(0.0)) - F.col("_y") * F.col("_z")
        sums = t.groupBy(*keys).agg(
            *[F.first(f).alias(f) for f in fields],
            F.sum(F.col("_w") * loss).alias("loss"),
            F.array(*[F.sum(F.col("_k") * vals[a] * vals[b]) for a, b in pairs]).alias("h"),
            F.array(*[F.sum(F.col("_w") * (F.col("_p") - F.col("_y")) * v) for v in vals]).alias("g"),
        )
        state = stage(sums.mapInPandas(solve, schema), f"beta-{i}")
        done.append(state.where("converged"))
        state = state.where("NOT converged")
        if state.isEmpty():
            break
    else:
        done.append(state)
    return reduce(DataFrame.unionByName, done).select(*keys, "beta", "converged") if done else state.select(*keys, "beta", "converged")


def _dot(features: Sequence[str]) -> Column:
    z = F.get("beta", F.lit(len(features)))
    for i, f in enumerate(features):
        z = z + F.get("beta", F.lit(i)) * F.col(f)
    return z


def score_folds(rows: DataFrame, beta: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Probability of each test row of each fold."""
    return rows.where("role = 'test'").join(beta.select(*keys, "beta"), list(keys)).withColumn("prob", 1.0 / (1.0 + F.exp(-_dot(list(features))))).drop("beta")


def mean_probability(scored: DataFrame, event: Sequence[str]) -> DataFrame:
    """Out-of-fold mean per event."""
    return scored.groupBy(*event).agg(F.avg("prob").alias("prob"), F.first("label").alias("label"))


# --- thresholds and metrics -------------------------------------------------------------------


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    b = beta * beta
    return F.when((precision > 0) | (recall > 0), (1.0 + b) * precision * recall / (b * precision + recall + EPS)).otherwise(0.0)


def confusion_metrics(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return {"precision": precision, "recall": recall, "f1": f_beta(precision, recall, 1.0), "f05": f_beta(precision, recall, 0.5)}


def threshold_grid(lo: float = 0.50, hi: float = 0.95, step: float = 0.05) -> list[float]:
    lo, hi = sorted((min(max(lo, 0.0), 1.0), min(max(hi, 0.0), 1.0)))
    step = max(step, 1e-3)
    return [lo + i * step for i in range(int((hi + step * 0.5 - lo) / step + 1e-9) + 1) if lo + i * step < hi + step * 0.5]


def threshold_scan(scored: DataFrame, keys: Sequence[str], grid: Sequence[float], floor: float = 0.6, objective: str = "f05") -> DataFrame:
    """Best threshold per key among those with enough precision, and how many there are.

    All thresholds are counted in one aggregation. Ties go to higher precision, then to the higher
    threshold. Keys without a valid threshold have NULL: every entry is vetoed.
    """
    keys = list(keys)
    yes = F.col("label") == 1
    counts = scored.groupBy(*keys).agg(
        F.array(*[F.struct(F.lit(t).alias("threshold"), F.count_if(yes & (F.col("prob") >= t)).alias("tp"), F.count_if(~yes & (F.col("prob") >= t)).alias("fp"),
                           F.count_if(yes & (F.col("prob") < t)).alias("fn")) for t in grid]).alias("c")
    )
    each = counts.withColumn("s", F.explode("c")).select(*keys, "s.*").withColumns(confusion_metrics(F.col("tp"), F.col("fp"), F.col("fn")))
    ok = F.col("precision") >= floor
    order = F.struct(F.round(objective, 10), F.round("precision", 10), "threshold")
    best = each.groupBy(*keys).agg(
        F.count_if(ok).alias("valid_count"), F.max_by(F.struct("threshold", "precision", "recall", "f1", "f05"), F.when(ok, order)).alias("b")
    )
    return best.select(*keys, "valid_count", "b.*", F.col("b").isNull().alias("veto_all"))


def average_precision(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under the precision-recall steps at distinct scores.

    Counts per distinct score come first; cumulative counts run over ranges of the scores.
    """
    keys = list(keys)
    per = scored.groupBy(*keys, "prob").agg(F.sum(F.col("label").cast("long")).alias("_p"), F.count("*").alias("_n"))
    cum = ordered_sums(per, keys, [F.desc("prob")], {"tp": F.col("_p"), "seen": F.col("_n")})
    total = scored.groupBy(*keys).agg(F.sum(F.col("label").cast("long")).alias("_all"))
    area = look_up(cum, total, keys, F.col("prob")).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("_all") > 0, F.col("_p") / F.col("_all") * F.col("tp") / F.col("seen"))), F.lit(0.0)).alias("pr_auc")
    )
    return area


def fold_report(scored: DataFrame, keys: Sequence[str], grid: Sequence[float], floor: float = 0.6, objective: str = "f05") -> DataFrame:
    """Per fold: samples, chosen threshold, metrics there, average precision, veto flag."""
    keys = list(keys)
    n = scored.groupBy(*keys).agg(F.count("*").alias("samples"))
    return n.join(threshold_scan(scored, keys, grid, floor, objective), keys).join(average_precision(scored, keys), keys)


def veto(events: DataFrame, scored: DataFrame, threshold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries whose mean probability reaches the key's threshold; none where it is NULL."""
    keys = list(keys)
    p = mean_probability(scored, [*keys, "entry_idx"]).drop("label")
    t = threshold.select(*keys, "threshold")
    return events.join(p, [*keys, "entry_idx"]).join(t, keys).where(F.col("prob") >= F.col("threshold"))


def chosen_features(columns: Sequence[str], allowlist: Sequence[str] = (), cap: int = 0) -> list[str]:
    """Columns that the filter is fitted on: those of the allowlist, then the others in their order up to `cap`.

    Without a cap, the allowlist alone, or the first three columns where it names none.
    """
    picked = [c for c in dict.fromkeys(allowlist) if c in columns]
    most = min(cap, len(columns)) if cap > 0 else len(picked) or min(3, len(columns))
    return [*picked, *(c for c in columns if c not in picked)][:most]


def entry_filter(rows: DataFrame, columns: Sequence[str], keys: Sequence[str], cfg: FilterConfig = FilterConfig(), rows_per_block: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The whole filter of every key at once: (kept entries as keys and pos, report with one row per key).

    rows: keys, ts, pos (dense from 0 within the key), high, low, close, entry and the feature columns.
    A key with too few events, without a usable fold, or without a threshold of enough precision keeps
    nothing: `veto_all`.
    """
    keys, x = list(keys), chosen_features(columns, cfg.allowlist, cfg.cap)
    rows = stage(rows.select(*keys, "ts", "pos", "high", "low", "close", "entry", *x), "filter-rows")
    every = stage(barrier_events(rows, cfg.horizon, cfg.take, cfg.stop, cfg.vol_window, cfg.bps, keys, rows_per_block), "filter-events")
    size = every.groupBy(*keys).agg(F.count("*").alias("events"), F.sum("label").alias("positive"))
    some = size.where(F.col("events") >= max(2, cfg.min_events))
    events = look_up(every, some.select(*keys), keys, F.col("entry_idx"))
    weighted = uniqueness_weights(events, rows, keys, rows_per_block).join(rows.select(*keys, F.col("pos").alias("entry_idx"), *x), [*keys, "entry_idx"])
    folds = stage(standardise(cpcv_rows(weighted, cfg.groups, cfg.test_groups, cfg.gap, cfg.max_folds, keys=keys, rows=rows_per_block), x, [*keys, "fold"]), "filter-folds")
    beta = fit_folds(folds, x, [*keys, "fold"], penalty=cfg.penalty, c=cfg.c, balanced=cfg.balanced)
    scored = stage(score_folds(folds, beta, x, [*keys, "fold"]), "filter-scores")
    mean = stage(mean_probability(scored, [*keys, "entry_idx"]), "filter-means")
    threshold = threshold_scan(mean, keys, threshold_grid(*cfg.grid), cfg.floor, cfg.objective)
    report = stage(rows.select(*keys).distinct().join(size, keys, "left").join(threshold, keys, "left").select(
        *keys, F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("positive", F.lit(0)).alias("positive"), "threshold", F.coalesce("valid_count", F.lit(0)).alias("valid_count"),
        "precision", "recall", "f05", F.coalesce("veto_all", F.lit(True)).alias("veto_all"),
        F.when(F.coalesce("events", F.lit(0)) < max(2, cfg.min_events), "insufficient_events").when(F.coalesce("veto_all", F.lit(True)), "precision_floor_unmet_global").otherwise("ok").alias("reason")), "filter-report")
    limits = report.where("NOT veto_all").select(*keys, "threshold")
    kept = look_up(mean, limits, keys, F.col("entry_idx")).where(F.col("prob") >= F.col("threshold"))
    return stage(kept.select(*keys, F.col("entry_idx").alias("pos")), "filter-kept"), report


def provenance_counts(events: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return events.groupBy(*keys, "provenance").agg(F.count("*").alias("events"), F.avg("net_return").alias("avg_net_return"))
