"""Bars: resampling, gaps, alignment, look-back windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators.series import (
    BLOCK_ROWS,
    TIMEFRAME_SECONDS,
    by_blocks,
    carry_backward,
    carry_forward,
    dense_position,
    look_up,
    number_bars,
    spread_blocks,
    time_segment,
)

# Look-back windows in days; None is the whole history.
LOOKBACKS: dict[str, int | None] = {"all": None, "360d": 360, "90d": 90, "30d": 30}


def bucket_start(timeframe: str, ts: str | Column = "ts") -> Column:
    """Start of the left-closed bucket of a timestamp. Weeks start on Monday."""
    col = F.col(ts) if isinstance(ts, str) else ts
    if timeframe == "1w":
        return F.date_trunc("week", col)
    size = TIMEFRAME_SECONDS[timeframe]
    return F.timestamp_seconds(F.floor(F.unix_seconds(col) / size) * size)


def bars_from_ticks(
    ticks: DataFrame, timeframe: str, tie: Sequence[str] = (), keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """OHLCV bars from (keys, ts, price, volume); `tie` orders ticks of equal timestamp.

    Pure partial aggregation: a hot symbol is reduced on the map side before the shuffle.
    """
    at = tick_order(ticks, tie)
    return (
        ticks.groupBy(*keys, bucket_start(timeframe).alias("ts"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("volume").alias("volume"),
        )
    )


def tick_order(ticks: DataFrame, tie: Sequence[str]) -> Column:
    """Order of ticks as one fixed-width value where possible.

    With a fixed-width order first and last price stay in a hash aggregate; a struct would make
    Spark sort every tick before the partial aggregation.
    """
    if not tie:
        return F.col("ts")
    if len(tie) == 1 and ticks.schema[tie[0]].dataType.typeName() in ("long", "integer", "short", "byte"):
        micros = F.unix_micros("ts").cast("decimal(18,0)")
        return (micros * F.lit("1" + "0" * 19).cast("decimal(20,0)") + F.col(tie[0]).cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.struct("ts", *tie)


def resample(bars: DataFrame, timeframe: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Coarser OHLCV bars from finer ones; empty buckets do not appear."""
    return bars.groupBy(*keys, bucket_start(timeframe).alias("ts")).agg(
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
    )


def resample_all(bars: DataFrame, timeframes: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """All timeframes in one pass: each bar is counted once per timeframe inside the aggregate."""
    frames = F.array(*[F.struct(F.lit(t).alias("timeframe"), bucket_start(t).alias("bucket")) for t in timeframes])
    wide = bars.withColumn("_f", F.explode(frames))
    return wide.groupBy(*keys, F.col("_f.timeframe").alias("timeframe"), F.col("_f.bucket").alias("bucket")).agg(
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
    ).withColumnRenamed("bucket", "ts")


def resample_last(rows: DataFrame, timeframe: str, columns: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Last non-missing value of each column per bucket."""
    return rows.groupBy(*keys, bucket_start(timeframe).alias("ts")).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in columns]
    )


def find_gaps(
    bars: DataFrame, step: str, start: Column | None = None, end: Column | None = None, keys: Sequence[str] = ("symbol",),
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Missing ranges (first and last missing step) inside the data and at both ends of [start, end]."""
    size = TIMEFRAME_SECONDS[step]
    keys = list(keys)
    base = bars.select(*keys, F.unix_seconds("ts").alias("t")).distinct()
    seg = base.withColumn("_seg", F.floor(F.col("t") / (size * rows)))
    w = Window.partitionBy(*keys, "_seg").orderBy("t")
    inner = seg.withColumn("nxt", F.lead("t").over(w)).where(F.col("nxt") - F.col("t") > size)
    inner = inner.select(*keys, (F.col("t") + size).alias("lo"), (F.col("nxt") - size).alias("hi"))
    ends = seg.groupBy(*keys, "_seg").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    wk = Window.partitionBy(*keys).orderBy("_seg")
    between = (
        ends.withColumn("nxt", F.lead("a").over(wk))
        .where(F.col("nxt") - F.col("b") > size)
        .select(*keys, (F.col("b") + size).alias("lo"), (F.col("nxt") - size).alias("hi"))
    )
    gaps = inner.unionByName(between)
    if start is not None and end is not None:
        span = ends.groupBy(*keys).agg(F.min("a").alias("a"), F.max("b").alias("b"))
        lo, hi = F.unix_seconds(start), F.unix_seconds(end)
        head = span.select(*keys, lo.alias("lo"), F.least(F.col("a") - size, hi).alias("hi")).where("lo <= hi")
        tail = span.select(*keys, F.greatest(F.col("b") + size, lo).alias("lo"), hi.alias("hi")).where("lo <= hi")
        gaps = gaps.unionByName(head).unionByName(tail)
    return gaps.select(
        *keys,
        F.timestamp_seconds("lo").alias("gap_start"),
        F.timestamp_seconds("hi").alias("gap_end"),
        ((F.col("hi") - F.col("lo")) / size + 1).cast("long").alias("missing"),
    )


def keep_last(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by `order`. A `max_by` aggregate: duplicates merge before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def fill_gaps(primary: DataFrame, backfill: DataFrame, step: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Primary rows plus those backfill rows that fall on missing steps between first and last bar.

    A backfill row lies inside a gap exactly when its time is within the primary's range and not
    among the primary's rows, so an anti join replaces the range join.
    """
    keys = list(keys)
    span = primary.groupBy(*keys).agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    cols = [*keys, "ts", "open", "high", "low", "close", "volume"]
    usable = (
        backfill.join(span, keys)
        .where(F.col("ts").between(F.col("_lo"), F.col("_hi")))
        .join(primary.select(*keys, "ts"), [*keys, "ts"], "left_anti")
    )
    return primary.select(*cols, F.lit("archive").alias("origin")).unionByName(
        usable.select(*cols, F.lit("backfill").alias("origin"))
    )


def asof_join(
    left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, columns: Sequence[str],
    segment_seconds: int, keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Each left row with the last right row at or before it (exact match allowed).

    Both sides are merged and sorted inside (key, time segment); one carry row per segment brings
    the last right row of earlier segments, so no key is sorted in one task.
    """
    keys = list(keys)
    payload = F.struct(*[F.col(c) for c in columns])
    l = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    r = right.select(*keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), payload.alias("_right"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_seg", time_segment(segment_seconds, "_t"))
    filled = carry_forward(both, keys, "_seg", ["_t", "_side"], ["_right"])
    return filled.where("_side = 1").select("_left.*", *[F.col(f"_right.{c}").alias(c) for c in columns])


def align_to_index(
    index: DataFrame, values: DataFrame, columns: Sequence[str], segment_seconds: int, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Forward-fill `columns` onto the timestamps of `index`; 0 before the first value."""
    keys = list(keys)
    joined = index.join(values.withColumn("_v", F.lit(1)), [*keys, "ts"], "full").join(
        index.select(*keys, "ts", F.lit(True).alias("_want")), [*keys, "ts"], "left"
    )
    seg = joined.withColumn("_seg", time_segment(segment_seconds))
    out = carry_forward(seg, keys, "_seg", ["ts"], columns).where("_want")
    return out.select(*index.columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])


def fill_both_ways(
    rows: DataFrame, columns: Sequence[str], fallback: str, segment_seconds: int, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Forward fill, then back fill, then take `fallback`."""
    keys = list(keys)
    seg = rows.withColumn("_seg", time_segment(segment_seconds))
    seg = seg.select("*", *[F.col(c).alias(f"_b_{c}") for c in columns])
    fwd = carry_forward(seg, keys, "_seg", ["ts"], columns)
    both = carry_backward(fwd, keys, "_seg", ["ts"], [f"_b_{c}" for c in columns])
    rest = [c for c in rows.columns if c not in columns]
    return both.select(*rest, *[F.coalesce(c, f"_b_{c}", fallback).alias(c) for c in columns])


def close_clock(ts: str, timeframe: str) -> dict[str, Column]:
    """Minutes to the end of the bucket: plain, logarithmic and as a share of the bucket.

    Buckets count from the epoch for every timeframe, the week included.
    """
    n = TIMEFRAME_SECONDS[timeframe] // 60
    left = (F.lit(n) - F.floor(F.unix_seconds(ts) / 60) % n).cast("double")
    return {"ttc_min": left, "ttc_log": F.log1p(left), "ttc_phase": left / float(n)}


def lookback_slices(bars: DataFrame, keys: Sequence[str] = ("symbol",), lookbacks: dict[str, int | None] | None = None) -> DataFrame:
    """Rows of every look-back window (all, and N days up to each key's newest row), tagged `window`."""
    lookbacks = lookbacks or LOOKBACKS
    newest = bars.groupBy(*keys).agg(F.max("ts").alias("_max"))
    options = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).cast("int").alias("days")) for n, d in lookbacks.items()])
    tagged = look_up(bars, newest, list(keys), F.col("ts")).withColumn("_w", F.explode(options))
    since = F.col("_max") - F.make_dt_interval(days=F.col("_w.days"))
    return (
        tagged.where(F.col("_w.days").isNull() | (F.col("ts") >= since))
        .select(*bars.columns, F.col("_w.name").alias("window"))
    )


def every_nth(bars: DataFrame, step: int, keys: Sequence[str] = ("symbol",), pos: str = "pos") -> DataFrame:
    """Every `step`-th row of a key and its last row; needs dense positions."""
    last = bars.groupBy(*keys).agg(F.max(pos).alias("_last"))
    picked = look_up(bars, last, list(keys), F.col(pos)).where((F.col(pos) % step == 0) | (F.col(pos) == F.col("_last")))
    return picked.select(*bars.columns)


def drop_warmup(bars: DataFrame, rows: int = 720, keys: Sequence[str] = ("symbol",), pos: str = "pos") -> DataFrame:
    """Drop the first `rows` rows of keys that have more than that."""
    size = bars.groupBy(*keys).agg(F.count("*").alias("_n"))
    kept = look_up(bars, size, list(keys), F.col(pos)).where((F.col("_n") <= rows) | (F.col(pos) >= rows))
    return kept.select(*bars.columns)


def bars_around(
    trades: DataFrame, bars: DataFrame, pad_minutes: int = 120, limit: int = 500, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Bars from `pad_minutes` before a trade to as long after it, the last `limit` of them.

    The interval join goes through hour buckets: a trade lists the hours it touches, a bar has
    one. `limit` is the feature's own cut. Trades need (keys, trade_id, start_ts, end_ts).
    """
    pad = F.expr(f"INTERVAL {pad_minutes} MINUTES")
    hour = 3600
    lo, hi = F.col("start_ts") - pad, F.col("end_ts") + pad
    t = trades.withColumn("_lo", lo).withColumn("_hi", hi)
    t = t.withColumn("_h", F.explode(F.sequence(F.floor(F.unix_seconds("_lo") / hour), F.floor(F.unix_seconds("_hi") / hour))))
    b = bars.withColumn("_h", F.floor(F.unix_seconds("ts") / hour))
    hit = t.join(b, [*keys, "_h"]).where(F.col("ts").between(F.col("_lo"), F.col("_hi")))
    w = Window.partitionBy(*keys, "trade_id").orderBy(F.desc("ts"))
    return hit.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn", "_h", "_lo", "_hi")


def first_seen(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Date of the first bar of each key."""
    return bars.groupBy(*keys).agg(F.to_date(F.min("ts")).alias("first_seen_date"))
