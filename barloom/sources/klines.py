"""Exchange kline files: header-less CSV with twelve columns, epoch unit unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.bars import keep_last

# Column order of a kline file (fixed format).
KLINE_COLUMNS = [
    "open_time", "open", "high", "low", "close", "volume",
    "close_time", "quote_volume", "trades", "taker_base", "taker_quote", "ignore",
]
BAR_COLUMNS = ["open", "high", "low", "close", "volume"]


def epoch_millis(value: Column, largest: Column) -> Column:
    """Epoch number in ms; the unit is told by the largest magnitude seen."""
    v = value.cast("long")
    return (
        F.when(largest >= 100_000_000_000_000_000, F.floor(v / 1_000_000))
        .when(largest >= 100_000_000_000_000, F.floor(v / 1_000))
        .otherwise(v)
    )


def parse_klines(rows: DataFrame, group: list[str]) -> DataFrame:
    """Typed bars from string rows; bad rows are dropped. The unit is decided per `group`.

    The largest magnitude is one small aggregate per group, joined back.
    """
    typed = rows.select(
        *[c for c in rows.columns if c not in KLINE_COLUMNS],
        F.expr("try_cast(open_time AS bigint)").alias("_t"),
        *[F.expr(f"try_cast({c} AS double)").alias(c) for c in BAR_COLUMNS],
    ).dropna(subset=["_t", *BAR_COLUMNS])
    largest = typed.groupBy(*group).agg(F.max(F.abs("_t")).alias("_largest"))
    out = typed.join(largest, group)
    return out.withColumn("ts", F.timestamp_millis(epoch_millis(F.col("_t"), F.col("_largest")))).drop("_t", "_largest")


def read_klines(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Bars of all unpacked kline files under `path`; `source_file` orders overlapping files."""
    schema = ", ".join(f"{c} string" for c in KLINE_COLUMNS)
    raw = spark.read.schema(schema).csv(path).withColumn("source_file", F.col("_metadata.file_path"))
    name = F.lit(symbol) if symbol else F.regexp_extract("source_file", r"([A-Z0-9]+)-[0-9a-z]+-\d{4}-\d{2}[^/]*$", 1)
    return parse_klines(raw, ["source_file"]).select(name.alias("symbol"), "ts", *BAR_COLUMNS, "source_file")


def merge_files(bars: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row per (symbol, ts) in [start, end], the latest file winning."""
    inside = bars.where(F.col("ts").between(start, end))
    return keep_last(inside, ["symbol", "ts"], ["source_file"]).drop("source_file")
