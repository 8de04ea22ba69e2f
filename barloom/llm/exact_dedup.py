"""Exact deduplication with streaming state (operator 7), native functions only.

A stream over the rows' digests keeps, per digest and without expiry, the smallest doc_id, the place
of that row's content and the number of rows. The state lives in RocksDB on the executors' disks and
in the shared checkpoint folder; after the stream has read everything, the state itself is read as a
table. Rows that hit a known digest are compared with the kept row byte by byte, and a digest that
stands for several texts is resolved by the texts themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.base import stage, staging_dir, whole_text, without

ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a store that has committed gives its memory and local files back
}


RESULTS = ("dd_digest", "dd_place", "keep_id", "group_size", "kept", "keep_place", "dd_text")


def one_space(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def digest_state(marked: DataFrame, path: str) -> DataFrame:
    """Digest state of the table at `path` (dd_digest, dd_place, doc_id): dd_digest, keep_id, keep_place, group_size."""
    spark = marked.sparkSession
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    checkpoint = f"{staging_dir(spark).rstrip('/')}/op7-state-{uuid.uuid4().hex}"
    try:
        for k, v in ROCKS.items():
            spark.conf.set(k, v)
        rows = spark.readStream.schema(marked.schema).parquet(path).select("dd_digest", "dd_place", "doc_id")
        groups = rows.groupBy("dd_digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min_by("dd_place", F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("keep_place"))
        run = groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if run.lastProgress is None:  # an empty table starts no batch
        return marked.limit(0).select("dd_digest", F.col("doc_id").alias("keep_id"), F.col("dd_place").alias("keep_place"), F.col("doc_id").alias("group_size"))
    state = spark.read.format("statestore").load(checkpoint)
    kept, size, place = state.schema["value"].dataType.names[:3]
    return state.select("key.dd_digest", F.col(f"value.`{kept}`").alias("keep_id"), F.col(f"value.`{place}`").alias("keep_place"), F.col(f"value.`{size}`").alias("group_size"))


def grouped_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """All rows and columns of docs plus dd_digest, dd_place, keep_id, group_size and kept.

    docs: doc_id long, text string, more columns allowed. Texts are equal when they agree after each
    run of white space became one space; null counts as empty. The row with the smallest doc_id stays;
    of repeated rows with that doc_id exactly one. Rows without doc_id stay only where their whole
    group has none. Columns of docs with the name of a result are replaced by it.
    """
    docs = without(docs, RESULTS)
    spark = docs.sparkSession
    marked = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("dd_digest", digest(one_space(whole_text()))).withColumn("dd_place", F.monotonically_increasing_id())
    path = f"{staging_dir(spark).rstrip('/')}/op7-rows-{uuid.uuid4().hex}"
    marked.write.parquet(path)
    marked = spark.read.schema(marked.schema).parquet(path)
    state = stage(digest_state(marked, path), "op7-groups")
    # full bytes of every hit against the kept row
    hits = stage(marked.select("dd_digest", "dd_place", one_space(whole_text()).alias("text")).join(
        state.where("group_size > 1").select("dd_digest", "keep_place"), "dd_digest"), "op7-hits")
    kept = hits.where("dd_place = keep_place").select("dd_digest", F.col("text").alias("kept_text"))
    clash = stage(hits.where("dd_place <> keep_place").join(kept, "dd_digest").where("text <> kept_text").select("dd_digest").distinct(), "op7-clashes")
    columns = [*docs.columns, *RESULTS[:5]]
    decided = lambda rows: rows.withColumn("kept", F.col("dd_place") == F.col("keep_place")).select(*columns)
    if clash.isEmpty():
        return decided(marked.join(state, "dd_digest"))
    fine = marked.join(state.join(clash, "dd_digest", "left_anti"), "dd_digest")
    mixed = marked.join(clash, "dd_digest", "left_semi").withColumn("dd_text", one_space(whole_text()))
    exact = mixed.groupBy("dd_digest", "dd_text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min_by("dd_place", F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("keep_place"))
    return decided(fine).unionByName(decided(mixed.join(exact, ["dd_digest", "dd_text"])))
