"""JSON and CSV artifacts: run histories, event logs, sanitised output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.expr import finite

ITERATION_SCHEMA = """
    run_id string, ts_utc timestamp, profile string, stability_streak int,
    final_objective_balance_score double,
    round_reports array<struct<round_index:int, delta_vs_prev_round:double,
        validation_metrics:struct<pass_rate:double, all_alpha:double, final_score:double>>>
"""
# Fields of the reports that belong to a run. Files of other versions may lack some or have more.
RUN_SCHEMA = """run_id string, ts_utc timestamp, profile string,
    best_round_score struct<validation_pass_rate:double, all_window_avg_alpha_vs_spot:double, deploy_total_symbols:long, deploy_total_rules:long>"""
VALIDATION_SCHEMA = """run_id string, candidates_total long, candidates_passed long, pass_rate double, failsafe_veto_all_rate double,
    rows array<struct<scores:struct<final_score:double>>>, summary_by_window array<struct<window:string, avg_alpha_vs_spot:double>>, failed_reason_counts map<string,long>"""
DEPLOY_SCHEMA = "run_id string, total_symbols long, total_rules long, symbols array<struct<symbol:string, rules:array<struct<alpha_vs_spot:double>>>>"
EVENT_SCHEMA = "ts string, event string, run_id string, symbol string, task string, status string"


def read_iterations(spark: SparkSession, path: str, newest: int | None = None) -> DataFrame:
    """Iteration reports, one per file; `newest` keeps the latest by time (the report's own cut)."""
    runs = spark.read.schema(ITERATION_SCHEMA).option("multiLine", True).json(path)
    return runs.orderBy(F.desc("ts_utc"), F.desc("run_id")).limit(newest) if newest else runs


def read_run_reports(spark: SparkSession, runs: str, validation: str, deploy: str, newest: int | None = None, multi_line: bool = False) -> DataFrame:
    """Runs with their validation and deploy reports: (run_id, ts_utc, profile, best, validation, deploy).

    `newest` keeps the latest runs before their reports are joined. A report that is missing or cannot be
    read is NULL, as is a field that a file lacks; of several reports of one run that with the most
    candidates or rules counts.
    """
    read = lambda path, schema: spark.read.schema(schema).option("multiLine", multi_line).json(path).where("run_id IS NOT NULL")
    last = read(runs, RUN_SCHEMA).withColumnRenamed("best_round_score", "best")
    if newest:
        last = last.orderBy(F.desc("ts_utc"), F.desc("run_id")).limit(newest)

    def report(path: str, schema: str, name: str, size: str) -> DataFrame:
        rows = read(path, schema)
        return rows.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "run_id"]), F.coalesce(size, F.lit(-1))).alias(name))

    return last.join(report(validation, VALIDATION_SCHEMA, "validation", "candidates_total"), "run_id", "left").join(report(deploy, DEPLOY_SCHEMA, "deploy", "total_rules"), "run_id", "left")


def parse_event_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Event log lines: keep those that are JSON with an event name and a valid time."""
    parsed = lines.select(F.from_json(column, EVENT_SCHEMA).alias("e"), column)
    out = parsed.select("e.*").withColumn("ts", F.expr("try_cast(ts AS timestamp)"))
    return out.where(F.col("ts").isNotNull() & (F.coalesce(F.length("event"), F.lit(0)) > 0))


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_event_lines(spark.read.text(path))


def sanitise(df: DataFrame) -> DataFrame:
    """NaN and infinities to 0, control characters in text to blanks."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.when(c.isNull(), c).otherwise(F.coalesce(finite(c), F.lit(0.0))).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            cols.append(F.regexp_replace(c, r"[\x00-\x1f\x7f]", " ").alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def write_json(df: DataFrame, path: str) -> None:
    sanitise(df).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
