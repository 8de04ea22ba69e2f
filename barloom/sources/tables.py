"""Bars and ticks derived from the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.bars import bars_from_ticks


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table with zone-less timestamps read as UTC."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def event_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """`events` as ticks: event_type trades at `value`, with volume `k` of the payload."""
    e = table(spark, folder, "events")
    volume = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), volume.alias("volume"), "event_id")


def event_bars(spark: SparkSession, folder: str, timeframe: str = "1h") -> DataFrame:
    return bars_from_ticks(event_ticks(spark, folder), timeframe, tie=["event_id"])


def line_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """`lineitem` as ticks: flag and status trade at the unit price on the ship date."""
    li = table(spark, folder, "lineitem")
    return li.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )


def line_bars(spark: SparkSession, folder: str, timeframe: str = "1d") -> DataFrame:
    tie = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return bars_from_ticks(line_ticks(spark, folder), timeframe, tie=tie)
