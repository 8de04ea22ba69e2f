"""Filter interaction audit with a counting-Bloom duplicate prepass (operator 13).

Which filter removes a document depends on the order of the filters. Each document's failures become
one bit mask; masks are counted per part, and every order and step is arithmetic on those counts.

The duplicate filter is the only one that needs other rows. A first scan adds each text's hash to a
counting Bloom sketch: tasks count cells on their own, the counts are merged by block of cells. A text
with a cell that counted one is unique for certain and never shuffled; only possible repeats travel,
and an aggregate over their full text finds the exact smallest doc_id.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.base import stage, whole_text

CELLS_A_TEXT = 16  # cells of the sketch for each text, before rounding up to a power of two
MAX_BITS = 30  # cells are at most 2^30, so the bits that go out are at most 128 MB; beyond, fewer texts are cleared
BLOCK_BITS = 13  # cells of one block: what one group merges
PROBES = 3
BATCH = 1 << 18  # hashes that a task counts at a time


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def filter_masks(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that need the row alone, by letter."""
    words = words_of(text)
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


# --- counting Bloom sketch --------------------------------------------------------------------


def cells_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Cells of each hash, one row per probe. Probes of one hash may fall together; they count once then."""
    x = hashes.astype(np.int64).view(np.uint64)
    out = []
    for _ in range(PROBES):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        out.append((x >> np.uint64(64 - bits)).astype(np.int64))
    return np.stack(out)


def _counted(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sketch(hashes: np.ndarray) -> pa.RecordBatch:
            each = np.sort(cells_of(hashes, bits), axis=0)
            fresh = np.ones(each.shape, bool)
            fresh[1:] = each[1:] != each[:-1]
            cell, count = np.unique(each[fresh], return_counts=True)
            block = cell >> BLOCK_BITS
            cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            inner, count = (cell & ((1 << BLOCK_BITS) - 1)).astype(np.uint16), np.minimum(count, 2).astype(np.uint8)
            ends = np.r_[cut[1:], len(cell)]
            return pa.RecordBatch.from_arrays([
                pa.array(block[cut], pa.int64()), pa.array([inner[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
                pa.array([count[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())], ["block", "cells", "counts"])

        held: list[np.ndarray] = []
        for b in batches:
            held.append(b.column("hash").to_numpy())
            if sum(map(len, held)) >= BATCH:
                yield sketch(np.concatenate(held))
                held = []
        if sum(map(len, held)):
            yield sketch(np.concatenate(held))

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Counts of one block from all tasks, as bits of the cells that counted two or more."""
    total = np.zeros(1 << BLOCK_BITS, dtype=np.uint8)
    for cells, counts in zip(table.column("cells"), table.column("counts")):
        at = np.frombuffer(cells.as_buffer(), np.uint16)
        total[at] = np.minimum(total[at] + np.frombuffer(counts.as_buffer(), np.uint8), 2)
    return pa.table({"block": [table.column("block")[0].as_py()], "bits": pa.array([np.packbits(total >= 2).tobytes()], pa.binary())})


def repeat_bits(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bit per cell, set where two or more rows of `hashes` (hash long) hit it: at most 2^MAX_BITS bits."""
    blocks = hashes.select("hash").mapInArrow(_counted(bits), "block long, cells binary, counts binary").groupBy("block").applyInArrow(_merge, "block long, bits binary")
    out = np.zeros(1 << bits >> 3, dtype=np.uint8)
    width = 1 << BLOCK_BITS >> 3
    for r in blocks.toLocalIterator():  # one part of the blocks at a time
        out[r.block * width:(r.block + 1) * width] = np.frombuffer(r.bits, np.uint8)
    return out


def sketch_bits(rows: int) -> int:
    return min(MAX_BITS, max(BLOCK_BITS + 1, math.ceil(math.log2(max(rows, 1) * CELLS_A_TEXT))))


def possible_repeat(hashes: DataFrame, bits: int | None = None) -> Column:
    """Whether the text behind column `hash` may occur twice in `hashes`; False is certain."""
    bits = bits or sketch_bits(hashes.count())
    sent = hashes.sparkSession.sparkContext.broadcast(repeat_bits(hashes, bits))

    @F.arrow_udf("boolean")
    def maybe(column: pa.Array) -> pa.Array:
        cells = cells_of(column.to_numpy(zero_copy_only=False), bits)
        seen = (sent.value[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1
        return pa.array(seen.all(axis=0))

    return maybe("hash")


# --- flags and counts -------------------------------------------------------------------------


def failures(docs: DataFrame, bits: int | None = None, part: str = "source") -> DataFrame:
    """doc_id, part, mask of every row: bits 1, 2, 4, 8 for filters A to D and 16 for E, an earlier equal text.

    docs: doc_id, text and the part column; other columns are ignored. Null text is empty, a null part
    the empty string. Of equal texts all but those with the smallest doc_id fail E; rows without
    doc_id neither fail E nor make others fail. `bits` sets the size of the sketch (for tests).
    """
    text = whole_text()
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(filter_masks(text).values())), F.lit(0))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = stage(base.select("doc_id", "part", mask.alias("mask"), F.xxhash64("text").alias("hash"), F.unhex(F.sha2("text", 256)).alias("digest")), "op13-rows")
    maybe = possible_repeat(rows, bits)
    texts = base.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("hash")).where(maybe)
    # the smallest id per full text; tasks take the minimum of their own rows first, so copies do not meet in one task
    first = texts.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(True).alias("first"))
    tested = rows.withColumn("maybe", maybe & F.col("doc_id").isNotNull())
    some = tested.where("maybe").drop("maybe").join(first, ["doc_id", "digest"], "left")
    late = some.select("doc_id", "part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(16)).alias("mask"))
    return late.unionByName(tested.where("NOT maybe").select("doc_id", "part", "mask"))


def mask_counts(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each mask, and those among them that a label marks.

    labels: doc_id, quality, toxic; of several labels of one document the largest counts.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return flags.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def order_audit(counts: DataFrame, letters: str = "ABCDE", orders: Sequence[str] | None = None) -> DataFrame:
    """Every order and step per part from the mask counts; bit k of a mask is letter k.

    The counts of a part are at most 2^letters rows; they become one array, and each order and step is
    a sum over it.
    """
    steps = [(order, k + 1, sum(1 << letters.index(x) for x in order[:k]), 1 << letters.index(order[k])) for order in (orders or ["".join(p) for p in itertools.permutations(letters)]) for k in range(len(letters))]
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("_c"))
    plan = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("before"), F.lit(f).alias("bit")) for o, s, b, f in steps])
    rows = parts.withColumn("_s", F.explode(plan))

    def total(test, value: str = "n") -> Column:
        return F.aggregate(F.filter("_c", test), F.lit(0).cast("long"), lambda acc, c: acc + c[value])

    before, bit = F.col("_s.before"), F.col("_s.bit")
    here = lambda c: (c["mask"].bitwiseAND(before) == 0) & (c["mask"].bitwiseAND(bit) != 0)
    out = rows.select(
        "part", "_s.filter_order", "_s.step", bit.alias("_bit"),
        total(lambda c: c["mask"].bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"), total(here).alias("removed"),
        total(lambda c: (c["mask"].bitwiseAND(before) != 0) & (c["mask"].bitwiseAND(bit) != 0)).alias("redundant"),
        total(lambda c: c["mask"] == bit).alias("unique_fails"), total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"))
    sums = out.groupBy("part", "_bit").agg(F.sum("removed").alias("shapley"))
    return out.join(sums, ["part", "_bit"]).drop("_bit")


def audit(docs: DataFrame, labels: DataFrame, bits: int | None = None) -> DataFrame:
    """Interaction of filters A to E on `docs` (see `failures`): a row per part, order and step, zeros included.

    An empty table has no parts and gives no rows.
    """
    return order_audit(stage(mask_counts(failures(docs, bits), labels), "op13-masks"))
