"""Inputs and SQL fragments shared by the named queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.series import number_bars
from barloom.sources.tables import event_bars, line_bars

# SQL views of the derived bars -----------------------------------------------------------------


def event_bars_sql(timeframe: str = "1 hour", name: str = "bars") -> str:
    return f"""{name} AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL '{timeframe}', ts) AS ts,
         arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close,
         sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS volume
  FROM events GROUP BY 1, 2)"""


BARS_1H = event_bars_sql("1 hour")
BARS_1M = event_bars_sql("1 minute")
BARS_1D = """bars AS (
  SELECT l_returnflag || l_linestatus AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts,
         arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS close,
         sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""
WINDOW = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def r(expr: str, name: str, digits: int = 6) -> str:
    """Rounded output column; adding zero removes the sign of a negative zero."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {name}"


# Spark inputs ----------------------------------------------------------------------------------


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return number_bars(event_bars(spark, sf, "1h"), step="1h")


def minutely(spark: SparkSession, sf: str) -> DataFrame:
    return number_bars(event_bars(spark, sf, "1m"), step="1m")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return number_bars(line_bars(spark, sf, "1d"), step="1d")


def show(df: DataFrame, keep: Sequence[str], values: Sequence[str], digits: int = 6) -> DataFrame:
    return df.select(*keep, *[F.round(v, digits).alias(v) for v in values])
