"""Benchmark decontamination (operator 2).

Each document is read in windows of exactly the sizes of the benchmark items. A window's SimHash
over its weighted words is looked up in a multi-index: the 64 bits are cut into four blocks, and
every item is listed under all block values that differ from its own in at most RADIUS // 4 bits, so
each fingerprint within RADIUS is met in some block. Candidates of the window's size are then
compared exactly by weighted word shingles. Windows without any shingle of an item of their size
have similarity zero and are not fingerprinted.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.base import Powers, chunks, mix, shingle_hashes, split_words, unused, whole_text

SHINGLE = 5
SIMILAR = 0.8
RADIUS, BLOCKS = 19, 4
ITEMS = 1000  # items that are searched for in one reading of the documents
SCREEN = 1 << 22


def simhash(codes: np.ndarray, weights: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """SimHash of word ranges: the sign of the weighted sum of each hash bit."""
    bits = ((codes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int64) * 2 - 1
    total = np.zeros((len(codes) + 1, 64), dtype=np.int64)
    np.cumsum(bits * weights[:, None], axis=0, out=total[1:])
    on = (total[start + size] - total[start]) > 0
    return (on.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def near_values(width: int, radius: int) -> np.ndarray:
    """Bit masks of a block with at most `radius` bits set."""
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in itertools.combinations(range(width), k)], dtype=np.int64)


class ItemIndex:
    """Fingerprints, shingles and block index of a bounded number of items."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, radius: int) -> None:
        powers = Powers()
        self.shingle, self.radius = shingle, radius
        self.ids, self.size, self.parts, prints = [], [], [], []
        for item, text in items:
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            owner, a, b, code = split_words(data, np.array([0, len(data)]), powers, marks=True)
            if not len(code):
                continue
            n = min(shingle, len(code))
            _, first, value = shingle_hashes(owner, code, n, 1, short=False)
            self.ids.append(item)
            self.size.append(len(code))
            self.parts.append(shingle_weights(value, first, b - a, n))
            prints.append(simhash(code, b - a, np.zeros(1, np.int64), np.array([len(code)]))[0])
        self.size = np.array(self.size, dtype=np.int64)
        self.prints = np.array(prints, dtype=np.uint64)
        self.screens = {}
        for n in set(np.minimum(self.size, shingle).tolist()):
            mine = [k for k in range(len(self.ids)) if min(self.size[k], shingle) == n]
            value = np.concatenate([self.parts[k][0] for k in mine])
            item = np.repeat(mine, [len(self.parts[k][0]) for k in mine])
            order = np.argsort(value, kind="stable")
            seen = np.zeros(SCREEN, dtype=bool)
            seen[(value & np.uint64(SCREEN - 1)).astype(np.int64)] = True
            self.screens[n] = (seen, value[order], item[order])
        width = 64 // BLOCKS
        masks = near_values(width, radius // BLOCKS)
        self.tables = []
        for k in range(BLOCKS):
            block = ((self.prints >> np.uint64(k * width)) & np.uint64((1 << width) - 1)).astype(np.int64)
            at = (block[:, None] ^ masks).ravel()
            order = np.argsort(at, kind="stable")
            self.tables.append((np.searchsorted(at[order], np.arange((1 << width) + 1)), (order // len(masks)).astype(np.int32)))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (print, item) pairs within the radius, and their distance."""
        width, who, what = 64 // BLOCKS, [], []
        for k, (start, items) in enumerate(self.tables):
            block = ((prints >> np.uint64(k * width)) & np.uint64((1 << width) - 1)).astype(np.int64)
            at, which = spread(start[block], start[block + 1])
            who.append(which)
            what.append(items[at].astype(np.int64))
        pair = np.unique(np.concatenate(who) * len(self.ids) + np.concatenate(what))
        who, what = pair // len(self.ids), pair % len(self.ids)
        apart = np.bitwise_count(prints[who] ^ self.prints[what])
        ok = apart <= self.radius
        return who[ok], what[ok], apart[ok]


def spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of several ranges, and the range of each."""
    length = stop - start
    which = np.repeat(np.arange(len(length)), length)
    return np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length) + start[which], which


def shingle_weights(value: np.ndarray, first: np.ndarray, bytes_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weight, the bytes of their words."""
    total = np.concatenate([[0], np.cumsum(bytes_of)])
    distinct, at = np.unique(value, return_index=True)
    return distinct, (total[first[at] + n] - total[first[at]]).astype(np.int64)


def overlap(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Weight of the common shingles by the weight of the heavier side."""
    common = np.isin(one[0], two[0], assume_unique=True)
    return float(one[1][common].sum() / max(one[1].sum(), two[1].sum()))


def leaks_of(texts: int, owner, start, stop, code, index: ItemIndex, similar: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, similarity, first word, distance) of each item found in a text: its best window."""
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    begin = np.searchsorted(owner, np.arange(texts + 1))
    starts, sizes = [], []
    for n, (seen, values, items) in index.screens.items():
        _, first, value = shingle_hashes(owner, code, n, texts, short=False)
        maybe = np.flatnonzero(seen[(value & np.uint64(SCREEN - 1)).astype(np.int64)])
        low, high = np.searchsorted(values, value[maybe], "left"), np.searchsorted(values, value[maybe], "right")
        at, which = spread(low, high)
        if not len(at):
            continue
        word, size = first[maybe[which]], index.size[items[at]]
        pair = np.unique(np.stack([word, size], axis=1), axis=0)  # word of a shared shingle, size of the windows over it
        word, size = pair[:, 0], pair[:, 1]
        text = owner[word]
        last = np.maximum(begin[text], begin[text + 1] - size)
        a = np.minimum(np.maximum(begin[text], word - size + n), last)
        window, which = spread(a, np.minimum(word, last) + 1)
        starts.append(window)
        sizes.append(size[which])
    if not starts:
        return []
    window = np.unique(np.stack([np.concatenate(starts), np.concatenate(sizes)], axis=1), axis=0)
    at, size = window[:, 0], window[:, 1]
    text = owner[at]
    real = np.minimum(size, begin[text + 1] - at)  # a text shorter than the item is one window
    bytes_of = stop - start
    for t in np.unique(text).tolist():
        mine = np.flatnonzero(text == t)
        b, e = begin[t], begin[t + 1]
        who, what, apart = index.within(simhash(code[b:e], bytes_of[b:e], at[mine] - b, real[mine]))
        fits = index.size[what] == size[mine][who]
        for w, k, d in zip(mine[who[fits]].tolist(), what[fits].tolist(), apart[fits].tolist(), strict=True):
            n = int(min(index.size[k], index.shingle))
            x, y = int(at[w]), int(at[w] + real[w])
            if y - x < n:
                continue
            _, first, value = shingle_hashes(np.zeros(y - x, np.int64), code[x:y], n, 1, short=False)
            near = overlap(index.parts[k], shingle_weights(value, first, bytes_of[x:y], n))
            if near >= similar and (-near, x - b) < (-found.get((t, k), (0.0, 0, 0))[0], found.get((t, k), (0.0, 1 << 60, 0))[1]):
                found[(t, k)] = (near, int(x - b), int(d))
    return [(t, k, *v) for (t, k), v in sorted(found.items())]


def _searched(index, similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, items = Powers(), index.value
        for b in batches:
            ids = b.column("doc_id")
            for at, end, data, offsets in chunks(b.column("text")):
                rows = leaks_of(end - at, *split_words(data, offsets, powers, marks=True), items, similar)
                if rows:
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array([at + r[0] for r in rows])), pa.array([items.ids[r[1]] for r in rows], pa.int64()), pa.array([r[2] for r in rows]),
                        pa.array([r[3] for r in rows], pa.int64()), pa.array([int(items.size[r[1]]) for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int32())],
                        ["doc_id", "item_id", "similarity", "first_word", "words", "distance"])

    return run


def _passed(index, similar: float, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, items = Powers(), index.value
        for b in batches:
            bad = np.zeros(len(b), dtype=bool)
            for at, end, data, offsets in chunks(b.column(name)):
                for r in leaks_of(end - at, *split_words(data, offsets, powers, marks=True), items, similar):
                    bad[at + r[0]] = True
            yield b.filter(pa.array(~bad)).drop_columns([name])

    return run


def item_indexes(benchmark: DataFrame, shingle: int, radius: int, items: int) -> list:
    """The items in blocks of about `items`, each indexed on the driver and broadcast."""
    rows = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text"))
    blocks = max(1, -(-rows.count() // items))
    out = []
    for k in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        index = ItemIndex([(r.item_id, r.text) for r in block.toLocalIterator()], shingle, radius)
        if index.ids:
            out.append(benchmark.sparkSession.sparkContext.broadcast(index))
    return out


LEAK = "doc_id long, item_id long, similarity double, first_word long, words long, distance int"


def leaks(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE, radius: int = RADIUS, items: int = ITEMS) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds: doc_id, item_id, similarity of the best
    window, its first word and size, and the Hamming distance of the fingerprints.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Words are runs of ASCII
    letters, digits and non-ASCII characters, A-Z folded. Null or empty texts hold nothing, items
    without words are never found, and items of fewer words than a shingle are one shingle. Each
    block of `items` benchmark rows is one reading of the documents; repeated rows come out repeated.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    parts = [base.mapInArrow(_searched(i, similar), LEAK) for i in item_indexes(benchmark, shingle, radius, items)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], LEAK)


def without_leaks(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE, radius: int = RADIUS, items: int = ITEMS) -> DataFrame:
    """Rows and columns of docs whose text holds no benchmark item; no shuffle."""
    out = docs
    for i in item_indexes(benchmark, shingle, radius, items):
        name = unused(docs, "dc_text")
        out = out.withColumn(name, whole_text()).mapInArrow(_passed(i, similar, name), docs.schema)
    return out
