"""What several corpus operators share: reading, staging, word and shingle hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import session
from barloom.session import staging_dir

__all__ = ["stage", "staging_dir", "table", "whole_text", "words_of", "WHITE", "chunks", "split_words", "shingle_hashes", "mix", "connected", "Powers", "byte_sums", "range_hashes", "fit_logistic", "labelled", "without", "unused"]

WHITE = r"[\x20\x09-\x0D]+"  # what separates words, also in every SQL of this package
CHUNK_BYTES = 1 << 20  # texts are hashed in slices of about this size; a longer text is a slice of its own


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again; the shuffle files of the write are given back at once."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN, None)
    conf.set(CLEAN, "true")
    try:
        return session.stage(df, name)
    finally:
        conf.unset(CLEAN) if before is None else conf.set(CLEAN, before)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def without(docs: DataFrame, results: tuple[str, ...]) -> DataFrame:
    """docs without columns that have the name of a result: the result replaces them."""
    return docs.drop(*[c for c in docs.columns if c in results])


def unused(docs: DataFrame, name: str) -> str:
    """`name`, with underscores behind it until docs has no such column."""
    while name in docs.columns:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """Number of words of a text, native: pieces between blanks that are not empty."""
    return F.size(F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly (wraps around)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_codes(fold: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if fold:
        codes[65:91] += np.uint64(32)
    return mix(codes + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64; kept by the task that makes one."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            base, size = 0x9E3779B97F4A7C55, 1 << max(10, int(n).bit_length())
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(size, b, dtype=np.uint64)
                p[0] = 1
                both.append(np.cumprod(p, dtype=np.uint64))
            self.up, self.down = both
        return self.up, self.down


def _white(marks: bool) -> np.ndarray:
    w = np.zeros(256, dtype=bool)
    w[[32, 9, 10, 11, 12, 13]] = True
    if marks:
        w[:128] = [not chr(k).isalnum() for k in range(128)]
    return w


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string or binary column: first row, end row, bytes, offsets within the bytes."""
    kind = column.type
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32, count=column.offset + len(column) + 1)[column.offset:].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(max(end, at + 1), len(column))
        yield at, end, raw[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def byte_sums(data: np.ndarray, powers: Powers, fold: bool = True) -> np.ndarray:
    """Running sums from which the hash of any byte range follows."""
    up, _ = powers.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_byte_codes(fold)[data] * up[:len(data)], dtype=np.uint64, out=total[1:])
    return total


def range_hashes(total: np.ndarray, powers: Powers, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers.upto(len(total))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def split_words(data: np.ndarray, offsets: np.ndarray, powers: Powers, fold: bool = True, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts that lie one after the other: text index, start, end, hash of each word.

    fold: A-Z as a-z. marks: ASCII punctuation separates words too.
    """
    n = len(data)
    empty = np.zeros(0, np.int64)
    if not n:
        return empty, empty, empty, np.zeros(0, np.uint64)
    inside = ~_white(marks)[data]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    code = range_hashes(byte_sums(data, powers, fold), powers, start, end)
    return np.searchsorted(offsets, start, side="right") - 1, start, end, code


def shingle_hashes(text: np.ndarray, code: np.ndarray, n: int, texts: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, first word and hash of each run of n words; with `short`, a text of fewer words is one run."""
    count = np.bincount(text, minlength=texts) if len(text) else np.zeros(texts, np.int64)
    m = len(code) - n + 1
    salt = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    if m > 0:
        ok = np.flatnonzero(text[:m] == text[n - 1:])
        h = np.zeros(m, dtype=np.uint64)
        for j in range(n):
            h += code[j:j + m] * salt[j]
        owner, first, value = text[ok], ok, mix(h[ok] + np.uint64(n))
    else:
        owner, first, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if short and ((count > 0) & (count < n)).any():
        begin = np.concatenate([[0], np.cumsum(count)])
        few = np.flatnonzero((count > 0) & (count < n))
        extra = np.zeros(len(few), dtype=np.uint64)
        for j in range(n - 1):
            has = count[few] > j
            extra[has] += code[begin[few[has]] + j] * salt[j]
        owner = np.concatenate([owner, few])
        first = np.concatenate([first, begin[few]])
        value = np.concatenate([value, mix(extra + count[few].astype(np.uint64))])
        order = np.argsort(owner, kind="stable")
        owner, first, value = owner[order], first[order], value[order]
    return owner, first, value


def connected(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node in `edges` (a, b long): columns node, component.

    Large-star and small-star steps in turn; each round is written to the shared folder, so the plan
    stays short. Only the number of changed edges reaches the driver. Raises where `rounds` do not do.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    for _ in range(rounds):
        near = both(now)
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        step = small.where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        step = stage(step, name)
        sums = lambda e: e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        done = tuple(sums(step)) == tuple(sums(now))
        now = step
        if done:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    raise RuntimeError(f"components are not settled after {rounds} rounds")



def labelled(docs: DataFrame, labels: DataFrame, target: str, most: int) -> DataFrame:
    """doc_id, text and y of at most `most` labelled documents: the bounded sample a classifier is fitted on.

    The rows with the smallest hash of doc_id are taken, so the sample is even and repeatable; of
    several labels of one document the largest counts.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    few = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.join(F.broadcast(few.select(F.col("doc_id").cast("long").alias("doc_id"), "y")), "doc_id")  # at most `most` rows


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge-penalised logistic model (the last is the constant), by Newton steps with halving."""
    x = np.c_[x, np.ones(len(x))]
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (x @ w)).sum() + 0.5 * (penalty * w * w).sum()
    w, now = np.zeros(x.shape[1]), None
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), slope)
        now, size = loss(w), 1.0
        while loss(w - size * step) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w
