"""Bar lake: layer/ + hive partitions (symbol, timeframe, date), one `run_tag` per write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators.bars import keep_last

BAR_FIELDS = ["open", "high", "low", "close", "volume"]
ROWS_PER_FILE = 5_000_000


def write_bars(bars: DataFrame, root: str, layer: str, run_tag: str) -> None:
    """Append bars (symbol, timeframe, ts, OHLCV).

    Rows are clustered by (symbol, timeframe, date) before the write, so a partition gets one file per run; a date
    of bars is bounded, so no task grows with a hot symbol.
    """
    out = bars.withColumn("date", F.to_date("ts")).withColumn("run_tag", F.lit(run_tag))
    (
        out.repartition("symbol", "timeframe", "date")
        .sortWithinPartitions("symbol", "timeframe", "date", "ts")
        .write.option("maxRecordsPerFile", ROWS_PER_FILE)
        .mode("append")
        .partitionBy("symbol", "timeframe", "date")
        .parquet(f"{root}/{layer}")
    )


def latest_runs(rows: DataFrame, part: list[str] | None = None) -> DataFrame:
    """Rows of the newest run in each partition; an earlier run of that day is hidden whole."""
    part = part or ["symbol", "timeframe", "date"]
    newest = rows.groupBy(*part).agg(F.max("run_tag").alias("run_tag"))
    return rows.join(newest, [*part, "run_tag"], "left_semi")


def clean_bars(rows: DataFrame, key: list[str]) -> DataFrame:
    """Numeric fields, no missing values, one row per key."""
    typed = rows.select(*[c for c in rows.columns if c not in BAR_FIELDS], *[F.expr(f"try_cast({c} AS double)").alias(c) for c in BAR_FIELDS])
    return keep_last(typed.dropna(subset=["ts", *BAR_FIELDS]), key, ["ts", *BAR_FIELDS])


def read_bars(
    spark: SparkSession, root: str, layer: str, symbols: list[str] | None = None, timeframe: str | None = None,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Latest-run bars; symbol, timeframe and date predicates prune partitions at the scan."""
    rows = spark.read.parquet(f"{root}/{layer}")
    if symbols is not None:
        rows = rows.where(F.col("symbol").isin(symbols))
    if timeframe is not None:
        rows = rows.where(F.col("timeframe") == timeframe)
    if start is not None:
        rows = rows.where(F.col("date") >= F.to_date(F.lit(start)))
    if end is not None:
        rows = rows.where(F.col("date") <= F.to_date(F.lit(end)))
    out = clean_bars(latest_runs(rows), ["symbol", "timeframe", "ts"])
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    return out


def last_bars(bars: DataFrame, n: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The newest `n` bars of each key.

    Bar counts per day tell from which date on `n` rows exist, so only those days are ranked.
    """
    days = bars.groupBy(*keys, F.to_date("ts").alias("_d")).agg(F.count("*").alias("_n"))
    newest_first = Window.partitionBy(*keys).orderBy(F.desc("_d")).rowsBetween(Window.unboundedPreceding, -1)
    need = days.withColumn("_after", F.coalesce(F.sum("_n").over(newest_first), F.lit(0))).where(F.col("_after") < n)
    cut = bars.withColumn("_d", F.to_date("ts")).join(need.select(*keys, "_d"), [*keys, "_d"], "left_semi")
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"))
    return cut.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn", "_d")


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], version: str) -> DataFrame:
    """Keyed upsert as a new table: the row with the highest `version` wins, incoming on ties."""
    tagged = current.withColumn("_src", F.lit(0)).unionByName(incoming.withColumn("_src", F.lit(1)))
    return keep_last(tagged, key, [version, "_src"]).drop("_src")


def since(ts: str, newest: Column, days: int) -> Column:
    return F.col(ts) >= newest - F.make_dt_interval(days=F.lit(days))
