"""Session settings and the shared staging folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_PRIVATE: dict[str, str] = {}  # one folder per application without a configured one


def build_session(app: str = "barloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: `spark.checkpoint.dir` of the session.

    A session with a local master that names none gets a private folder, removed when Python ends. On
    any other master the folder must be set: machines of a cluster do not see each other's folders.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _PRIVATE:
        _PRIVATE[app] = tempfile.mkdtemp(prefix="barloom-stage-")
        atexit.register(shutil.rmtree, _PRIVATE[app], ignore_errors=True)
    return _PRIVATE[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the staging folder and read it back.

    Used where a result feeds several branches: the upstream plan runs once, later stages prune
    columns at the scan, and a lost executor costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
