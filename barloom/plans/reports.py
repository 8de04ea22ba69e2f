"""Report tables over window results: one row per (symbol, core, gate, window) with its best rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.series import ordered_number

GATES = ("gated", "ungated")
CELL = ["symbol", "core", "window"]


def window_results(scored: DataFrame, credible: float = 0.80) -> DataFrame:
    """Best candidate per (symbol, core, gate, window); insufficient when no candidate is credible."""
    w = Window.partitionBy("symbol", "core", "gate", "window").orderBy(F.desc("beats_hold"), F.desc(F.round("score", 9)), "rule_id")
    cell = Window.partitionBy("symbol", "core", "gate", "window")
    out = scored.withColumn("_rn", F.row_number().over(w)).withColumn("insufficient", F.min("credibility_penalty").over(cell) > credible)
    return out.where("_rn = 1").drop("_rn")


def grade() -> Column:
    """A, B, C, or C* without statistical support."""
    enough = F.col("trades") >= F.col("trade_floor")
    return (
        F.when(F.col("insufficient"), "C*")
        .when(F.col("beats_hold") & (F.col("alpha") >= 0.05) & (F.col("max_drawdown") >= -0.35) & enough, "A")
        .when(F.col("beats_hold") & (F.col("alpha") >= 0.0) & enough, "B")
        .otherwise("C")
    )


def leaderboard(rows: DataFrame, by: str, n: int = 80) -> DataFrame:
    """Top `n` rows of the whole table by one measure (a top-k sort, no full sort)."""
    return rows.orderBy(F.desc(F.round(by, 9)), "symbol", "core", "gate", "window").limit(n)


def gate_window_health(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Best row per symbol, gate and window by margin; pass rate over the whole universe."""
    w = Window.partitionBy("symbol", "gate", "window").orderBy(F.desc(F.round("alpha", 9)), "core")
    best = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    size = universe.agg(F.count_distinct("symbol").alias("expected_total"))
    out = best.groupBy("gate", "window").agg(
        F.count("*").alias("observed_total"), F.count_if("beats_hold").alias("pass_count"), F.count_if("insufficient").alias("insufficient_count"),
        F.avg("net_return").alias("avg_strategy_return"), F.avg("hold_return").alias("avg_spot_return"),
    )
    return out.join(size).withColumn("pass_rate", F.when(F.col("expected_total") > 0, F.col("pass_count") / F.col("expected_total")).otherwise(0.0))


def gate_delta_by_window(health: DataFrame) -> DataFrame:
    """Gated minus ungated pass rate and return per window."""
    wide = health.groupBy("window").pivot("gate", list(GATES)).agg(F.first("pass_rate").alias("pass_rate"), F.first("avg_strategy_return").alias("ret"))
    zero = F.lit(0.0)
    d = lambda c: F.coalesce(f"gated_{c}", zero) - F.coalesce(f"ungated_{c}", zero)
    return wide.select("window", F.coalesce("gated_pass_rate", zero).alias("gated_pass_rate"), F.coalesce("ungated_pass_rate", zero).alias("ungated_pass_rate"),
                       d("pass_rate").alias("delta_pass_rate"), d("ret").alias("delta_return"))


def cell_gate_delta(rows: DataFrame) -> DataFrame:
    """Both gates of each (symbol, core, window) side by side, with presence flags."""
    def side(g: str) -> DataFrame:
        return rows.where(F.col("gate") == g).select(*CELL, F.col("alpha").alias(f"{g}_alpha"), F.col("beats_hold").alias(f"{g}_passes"), F.lit(True).alias(f"has_{g}"))

    out = side("gated").join(side("ungated"), CELL, "full")
    no = F.lit(False)
    return out.select(
        *CELL, *[F.coalesce(f"has_{g}", no).alias(f"has_{g}") for g in GATES], *[f"{g}_alpha" for g in GATES], *[f"{g}_passes" for g in GATES],
        (F.coalesce("gated_alpha", F.lit(0.0)) - F.coalesce("ungated_alpha", F.lit(0.0))).alias("delta_alpha"),
    )


def executive_headline(health: DataFrame) -> DataFrame:
    """Pass rate, insufficient windows and returns per window of the gated runs; of the first gate there is where none are gated."""
    first = health.agg(F.coalesce(F.max(F.when(F.col("gate") == "gated", F.col("gate"))), F.min("gate")).alias("gate"))
    return health.join(first, "gate", "left_semi").select("gate", "window", "pass_rate", "insufficient_count", "avg_strategy_return", "avg_spot_return")


def core_delta(rows: DataFrame) -> DataFrame:
    """Per core: mean margin and score with and without the gate, their differences, and the samples of both."""
    z = F.lit(0.0)
    mean = lambda g, c: F.coalesce(F.avg(F.when(F.col("gate") == g, F.col(c))), z)
    out = rows.groupBy("core").agg(
        *[mean(g, c).alias(f"avg_{g}_{c}") for g in GATES for c in ("alpha", "score")], *[F.count_if(F.col("gate") == g).alias(f"samples_{g}") for g in GATES])
    return out.withColumns({f"delta_{c}": F.col(f"avg_gated_{c}") - F.col(f"avg_ungated_{c}") for c in ("alpha", "score")})


def heatmap_cells(rows: DataFrame) -> DataFrame:
    """Both gates of each (symbol, core, window): margin, score, verdict and differences, 0 and false where one is missing."""
    values = ("alpha", "score", "beats_hold")
    out = rows.groupBy(*CELL).agg(*[F.max(F.when(F.col("gate") == g, F.col(c))).alias(f"{g}_{c}") for g in GATES for c in values])
    out = out.withColumns({f"{g}_{c}": F.coalesce(f"{g}_{c}", F.lit(False if c == "beats_hold" else 0.0)) for g in GATES for c in values})
    return out.withColumns({f"delta_{c}": F.col(f"gated_{c}") - F.col(f"ungated_{c}") for c in ("alpha", "score")})


def core_overview(cells: DataFrame) -> DataFrame:
    """Per core: samples, average margin and pass rate in each gate, and the difference."""
    z = F.lit(0.0)
    out = cells.groupBy("core").agg(
        F.count("*").alias("samples"),
        *[F.coalesce(F.avg(f"{g}_alpha"), z).alias(f"{g}_avg_alpha") for g in GATES],
        *[F.coalesce(F.avg(F.col(f"{g}_passes").cast("int")), z).alias(f"{g}_pass_rate") for g in GATES],
    )
    return out.withColumn("delta_alpha", F.col("gated_avg_alpha") - F.col("ungated_avg_alpha"))


def rank_shift(rows: DataFrame) -> DataFrame:
    """Rank by margin inside each window in either gate, and the change from ungated to gated."""
    r = ordered_number(rows.withColumn("_a", F.round("alpha", 9)), ["gate", "window"], [F.desc("_a"), "symbol", "core"], "_rank")  # a window holds every cell
    a = r.where("gate = 'gated'").select(*CELL, F.col("_rank").alias("gated_rank"))
    b = r.where("gate = 'ungated'").select(*CELL, F.col("_rank").alias("ungated_rank"))
    return a.join(b, CELL).withColumn("shift", F.col("ungated_rank") - F.col("gated_rank"))


def gate_dashboard(health: DataFrame) -> DataFrame:
    """One line per gate: average and worst window pass rate, insufficient windows."""
    return health.groupBy("gate").agg(
        F.count("*").alias("windows"), F.avg("pass_rate").alias("avg_pass_rate"), F.min("pass_rate").alias("min_pass_rate"),
        F.sum("insufficient_count").alias("insufficient_count"), F.avg("avg_strategy_return").alias("avg_return"),
    )


def core_comparison(rows: DataFrame) -> DataFrame:
    """Cores of each (symbol, window, gate) from best to worst."""
    keys = ["symbol", "window", "gate"]
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("alpha", 9)), "core")
    r = rows.withColumn("_rank", F.row_number().over(w))
    return r.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_rank", "core"))), lambda s: s["core"]).alias("order"), F.count("*").alias("cores"))


def rule_catalogue(scored: DataFrame) -> DataFrame:
    """Rules seen per core."""
    return scored.groupBy("core").agg(F.count_distinct("rule_id").alias("rules"), F.sort_array(F.collect_set("rule_key")).alias("rule_keys"))


def window_diagnostics(rows: DataFrame, by: str, window: str = "all") -> DataFrame:
    """Whole-history rows per symbol or core: pass rate, margin, drawdown, trades per bar."""
    return rows.where(F.col("window") == window).groupBy(by).agg(
        F.count("*").alias("rows"), F.avg(F.col("beats_hold").cast("int")).alias("pass_rate"), F.avg("max_drawdown").alias("avg_drawdown"),
        F.sum("trades").alias("trades"), F.avg(F.col("trades") / F.col("trade_floor")).alias("trade_density"),
    )


def explainability(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Every window result with its grade, window bounds and place, best grades first."""
    out = rows.withColumn("grade", grade()).join(windows.select("symbol", "window", "start_ts", "end_ts"), ["symbol", "window"])
    out = ordered_number(out.withColumn("_a", F.round("alpha", 9)), ["gate"], ["grade", F.desc("_a"), "symbol", "core", "window"], "place")  # a gate holds every result
    return out.drop("_a")


def feature_importance(diagnostics: DataFrame, n: int = 120) -> DataFrame:
    """Features over all keys: mean utility and how often they appear."""
    return diagnostics.groupBy("name", "family").agg(F.count("*").alias("seen"), F.avg("utility").alias("avg_utility"), F.avg(F.abs("correlation")).alias("avg_abs_corr")).orderBy(
        F.desc(F.round("avg_utility", 9)), "name").limit(n)


def prune_overview(pruned: DataFrame, n: int = 120) -> DataFrame:
    """Prune candidates over all keys with their most frequent reason (first by name on ties)."""
    per = pruned.groupBy("name", "family", "reason").agg(F.count("*").alias("n"), F.sum("utility").alias("u"))
    return per.groupBy("name", "family").agg(
        F.sum("n").alias("seen"), (F.sum("u") / F.sum("n")).alias("avg_utility"), F.min_by("reason", F.struct(-F.col("n"), "reason")).alias("reason")
    ).orderBy(F.desc("seen"), "name").limit(n)
