"""Removal of repeated byte strings by a distributed merge sort of suffixes (operator 9).

A byte goes if a string of WINDOW bytes that covers it also starts earlier: in a document with a
smaller doc_id, or earlier in the same one. Sorting every suffix is not needed: each window has an
anchor, its leftmost k-gram of the smallest hash, and equal windows have it at the same offset. So
only suffixes that begin at an anchor are sorted, and only those whose k-gram occurs twice.

Each task sorts its anchored suffixes, keeps the earliest of equal contexts, and sends them front
coded: the length shared with the suffix before and the rest. A bucket of k-grams merges the runs
with a loser tree that knows for each player how much it shares with the last winner and so never
compares a known prefix again. The merge yields the suffix order and its common-prefix lengths;
windows are equal where these reach far enough and the bytes left of the anchor agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.base import Powers, chunks, mix, stage, whole_text

WINDOW, GRAM = 100, 24
LEFT = WINDOW - GRAM  # most bytes that a window has before its anchor
RUN_ROWS = 100_000  # suffixes that a task sorts at once
BUCKET_ROWS = 60_000  # suffixes of a merge, on average


def anchors(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all anchors in texts that lie one after the other, and the hash of their k-gram."""
    n = len(data)
    grams, windows = n - GRAM + 1, n - WINDOW + 1
    if windows < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers.upto(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(np.arange(256, dtype=np.uint64))[data] * up[:n], dtype=np.uint64, out=total[1:])
    code = mix((total[GRAM:] - total[:-GRAM]) * down[:grams])
    at = np.arange(grams, dtype=np.uint64)
    bits = np.uint64(max(1, int(grams).bit_length()))
    packed = (code >> bits << bits) | at  # smallest hash, then leftmost
    width = LEFT + 1
    blocks = -(-grams // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:grams] = packed
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(back[:windows], ahead[width - 1:width - 1 + windows])
    inside = np.zeros(windows, dtype=bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= WINDOW:
            inside[a:b - WINDOW + 1] = True
    place = (best[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    place = place[np.r_[True, place[1:] != place[:-1]]] if len(place) else place
    return place, code[place]


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for b in batches:
        for at, _, data, offsets in chunks(b.column("text")):
            place, code = anchors(data, offsets, powers)
            row = np.searchsorted(offsets, place, side="right") - 1
            take = pa.array(at + row)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), b.column("sd_id").take(take), b.column("sd_sub").take(take), pa.array((place - offsets[row]).astype(np.int32))], ["gram", "sd_id", "sd_sub", "pos"])


def contexts(data: np.ndarray, start: np.ndarray, stop: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes from each anchor on, bytes before it backwards, and how many of both the document has."""
    padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(WINDOW, np.uint8)])
    right = padded[place[:, None] + LEFT + np.arange(WINDOW)]
    left = padded[place[:, None] + LEFT - 1 - np.arange(LEFT)]
    n_right, n_left = np.minimum(stop - place, WINDOW), np.minimum(place - start, LEFT)
    right[np.arange(WINDOW) >= n_right[:, None]] = 0
    left[np.arange(LEFT) >= n_left[:, None]] = 0
    return right, left, n_right, n_left


def shared_with_previous(right: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    out = np.zeros(len(right), dtype=np.int64)
    if len(right) > 1:
        differ = right[1:] != right[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), WINDOW)
        out[1:] = np.minimum(first, np.minimum(n_right[1:], n_right[:-1]))
    return out


class Run:
    """Suffixes of one task, sorted: arrays for all of them and their front-coded form."""

    HEAD = np.dtype([("id", "<i8"), ("sub", "<i4"), ("pos", "<i4"), ("gram", "<u8"), ("lcp", "u1"), ("right", "u1"), ("left", "u1")])

    @staticmethod
    def pack(head: np.ndarray, right: np.ndarray, left: np.ndarray) -> bytes:
        col = np.arange(WINDOW)
        tail = right[(col >= head["lcp"][:, None]) & (col < head["right"][:, None])]
        before = left[np.arange(LEFT) < head["left"][:, None]]
        return zstandard.compress(np.int64(len(head)).tobytes() + head.tobytes() + tail.tobytes() + before.tobytes(), 1)

    @classmethod
    def unpack(cls, raw: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        raw = zstandard.decompress(raw)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        head = np.frombuffer(raw, cls.HEAD, n, 8)
        at, last, suffixes = 8 + n * cls.HEAD.itemsize, b"", []
        for lcp, size in zip(head["lcp"].tolist(), head["right"].tolist(), strict=True):
            last = last[:lcp] + raw[at:at + size - lcp]
            at += size - lcp
            suffixes.append(last)
        left = np.zeros((n, LEFT), np.uint8)
        left[np.arange(LEFT) < head["left"][:, None]] = np.frombuffer(raw, np.uint8, offset=at)
        return head, suffixes, left


def sorted_run(ids, subs, pos, gram, right, left, n_right, n_left, buckets: int) -> tuple[list[tuple[int, bytes]], np.ndarray]:
    """Front-coded suffixes per bucket without the later ones of equal contexts; and those, as spans."""
    r, lf = np.ascontiguousarray(right).view(f"V{WINDOW}").ravel(), np.ascontiguousarray(left).view(f"V{LEFT}").ravel()
    bucket = (gram % np.uint64(buckets)).astype(np.int64)
    words = lambda m: [np.ascontiguousarray(m[:, k:k + 8]).view(">u8").ravel() for k in range(0, m.shape[1] - 7, 8)]
    wide = np.pad(right, ((0, 0), (0, -WINDOW % 8)))
    wide_left = np.pad(left, ((0, 0), (0, -LEFT % 8)))
    order = np.lexsort((pos, subs, ids, n_left, *words(wide_left)[::-1], n_right, *words(wide)[::-1], bucket))
    same = np.zeros(len(order), dtype=bool)
    a, b = order[1:], order[:-1]
    same[1:] = (bucket[a] == bucket[b]) & (n_right[a] == n_right[b]) & (n_left[a] == n_left[b]) & (r[a] == r[b]) & (lf[a] == lf[b])
    later = order[same]
    whole = later[n_right[later] + n_left[later] >= WINDOW]
    spans = np.stack([ids[whole], subs[whole], pos[whole] - n_left[whole], pos[whole] + n_right[whole]], axis=1).astype(np.int64)
    kept, out = order[~same], []
    cut = np.flatnonzero(np.r_[True, bucket[kept][1:] != bucket[kept][:-1], True]) if len(kept) else np.zeros(1, np.int64)
    for x, y in zip(cut[:-1], cut[1:], strict=True):
        k = kept[x:y]
        head = np.zeros(len(k), Run.HEAD)
        head["id"], head["sub"], head["pos"], head["gram"] = ids[k], subs[k], pos[k], gram[k]
        head["lcp"], head["right"], head["left"] = shared_with_previous(right[k], n_right[k]), n_right[k], n_left[k]
        out.append((int(bucket[k[0]]), Run.pack(head, right[k], left[k])))
    return out, spans


def _runs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush():
            cat = [np.concatenate(x) for x in zip(*held, strict=True)]
            blocks, spans = sorted_run(*cat, buckets)
            kinds = [b for b, _ in blocks] + ([-1] if len(spans) else [])
            raw = [x for _, x in blocks] + ([spans.tobytes()] if len(spans) else [])
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(raw, pa.binary())], ["bucket", "block"])

        for b in batches:
            ids, subs = b.column("sd_id").to_numpy(), b.column("sd_sub").to_numpy()
            listed = b.column("hits")
            for at, end, data, offsets in chunks(b.column("text")):
                part = listed.slice(at, end - at)
                counts = np.diff(part.offsets.to_numpy())
                hits = part.flatten()
                row = np.repeat(np.arange(end - at), counts)
                pos, gram = hits.field("pos").to_numpy().astype(np.int64), hits.field("gram").to_numpy().view(np.uint64)
                for x in range(0, len(row), RUN_ROWS // 4):
                    s = slice(x, x + RUN_ROWS // 4)
                    place = offsets[row[s]] + pos[s]
                    held.append((ids[at + row[s]], subs[at + row[s]], pos[s], gram[s], *contexts(data, offsets[row[s]], offsets[row[s] + 1], place)))
                    rows += len(place)
                    if rows >= RUN_ROWS:
                        yield flush()
                        held, rows = [], 0
        if held:
            yield flush()

    return run


def _shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes need no look."""
    n = min(len(a), len(b))
    j = known
    while j < n and a[j:j + 16] == b[j:j + 16]:
        j += 16
    if j >= n:
        return n
    while j < n and a[j] == b[j]:
        j += 1
    return j


def merged(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Loser tree over sorted runs with common-prefix lengths: run and index of each suffix in order, and its prefix shared with the one before."""
    k = 1
    while k < len(runs):
        k *= 2
    texts = [r[0] for r in runs] + [[]] * (k - len(runs))
    inner = [r[1] for r in runs] + [[]] * (k - len(runs))
    at, head, known = [0] * k, [t[0] if t else None for t in texts], [0] * k
    loser = [0] * k

    def better(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two players; the loser learns what it shares with the winner."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        j = _shared(x, y, known[a])
        if x[j:j + 1] <= y[j:j + 1]:
            known[b] = j
            return a, b
        known[a] = j
        return b, a

    level = list(range(k))
    node = k
    while len(level) > 1:
        node //= 2
        up = []
        for i in range(0, len(level), 2):
            w, x = better(level[i], level[i + 1])
            loser[node + i // 2] = x
            up.append(w)
        level = up
    w = level[0]
    out_run, out_at, out_lcp = [], [], []
    while head[w] is not None:
        out_run.append(w)
        out_at.append(at[w])
        out_lcp.append(known[w])
        at[w] += 1
        i = at[w]
        if i < len(texts[w]):
            head[w], known[w] = texts[w][i], inner[w][i]
        else:
            head[w] = None
        p = (w + k) // 2
        while p:
            w, loser[p] = better(w, loser[p])
            p //= 2
    return out_run, out_at, out_lcp


def repeated(head: np.ndarray, left: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Spans (id, sub, start, end) of suffixes in order whose windows also start earlier."""
    n = len(head)
    rank = np.empty(n, dtype=np.int64)
    rank[np.lexsort((head["pos"], head["sub"], head["id"]))] = np.arange(n)
    n_right, n_left = head["right"].astype(np.int64), head["left"].astype(np.int64)
    most, least = np.full(n, -1), np.full(n, WINDOW)
    group = np.cumsum(lcp < GRAM) - 1
    size = np.bincount(group)
    # two suffixes: what they share on both sides
    first = np.flatnonzero((size[group] == 2) & (lcp < GRAM))
    second = first + 1
    differ = left[first] != left[second]
    before = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), LEFT), np.minimum(n_left[first], n_left[second]))
    hit = before + lcp[second] >= WINDOW
    late = np.where(rank[first] > rank[second], first, second)[hit]
    most[late], least[late] = before[hit], WINDOW - lcp[second][hit]
    # more: windows of each offset by their class of right and left bytes
    rows = np.flatnonzero(size[group] > 2)
    code = mix(np.zeros(len(rows), np.uint64))
    for m in range(LEFT + 1):
        right_class = np.cumsum(lcp < WINDOW - m)[rows]
        ok = np.flatnonzero((n_left[rows] >= m) & (n_right[rows] >= WINDOW - m))
        key = mix(code[ok] + right_class[ok].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.lexsort((rank[rows[ok]], key))
        again = np.zeros(len(order), dtype=bool)
        again[1:] = key[order][1:] == key[order][:-1]
        late = rows[ok[order[again]]]
        most[late] = m  # m grows
        least[late] = np.minimum(least[late], m)
        if m < LEFT:
            code = mix(code + left[rows, m].astype(np.uint64) + np.uint64(1))
    late = np.flatnonzero(most >= 0)
    pos = head["pos"][late].astype(np.int64)
    return np.stack([head["id"][late], head["sub"][late].astype(np.int64), pos - most[late], pos + WINDOW - least[late]], axis=1)


SPANS = "sd_id long, sd_sub int, a int, b int"


def _span_rows(spans: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(spans[:, 0]), *(pa.array(spans[:, k].astype(np.int32)) for k in (1, 2, 3))], ["sd_id", "sd_sub", "a", "b"])


def _merge_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket, blocks = None, []

    def settle():
        parts = [Run.unpack(x) for x in blocks]
        run, at, lcp = merged([(s, h["lcp"].tolist()) for h, s, _ in parts])
        begin = np.concatenate([[0], np.cumsum([len(h) for h, _, _ in parts])])
        order = begin[np.array(run)] + np.array(at)
        return _span_rows(repeated(np.concatenate([h for h, _, _ in parts])[order], np.concatenate([x for _, _, x in parts])[order], np.array(lcp)))

    for b in batches:  # sorted by bucket
        for k, raw in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), strict=True):
            if k < 0:  # spans that a task has found by itself
                yield _span_rows(np.frombuffer(raw, np.int64).reshape(-1, 4))
                continue
            if k != bucket and blocks:
                yield settle()
                blocks = []
            bucket = k
            blocks.append(raw)
    if blocks:
        yield settle()


def _cut(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, spans = b.column("doc_id"), b.column("text"), b.column("spans")
            total, removed, runs, digests, kept = [], [], [], [], []
            for text, span in zip(texts, spans, strict=True):
                raw = (text.as_buffer().to_pybytes() if text.as_buffer() else b"")
                gone, pieces, at, count = 0, [], 0, 0
                if span.is_valid:
                    v = span.values
                    a, z = v.field("a").to_numpy(), v.field("b").to_numpy()
                    order = np.argsort(a, kind="stable")
                    a, z = a[order], np.maximum.accumulate(z[order])
                    lead = np.flatnonzero(np.r_[True, a[1:] > z[:-1]])
                    for x, y in zip(a[lead].tolist(), z[np.r_[lead[1:] - 1, len(z) - 1]].tolist(), strict=True):
                        pieces.append(raw[at:x])
                        gone += y - x
                        at = y
                        count += 1
                pieces.append(raw[at:])
                rest = b"".join(pieces)
                total.append(len(raw))
                removed.append(gone)
                runs.append(count)
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if whole else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def cut_repeats(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, texts: bool = True) -> DataFrame:
    """Every document without repeated bytes: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary, null without `texts`).

    docs: doc_id long, text string; other columns are ignored. Null text is empty; a text under
    WINDOW bytes stays whole. Rows without doc_id come after all others. Rows that share a doc_id are
    taken in order of their texts; equal rows in any order, one after the other.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("sd_id"), whole_text().alias("text"))
    if base.groupBy("sd_id").count().where("count > 1").isEmpty():
        base = base.withColumn("sd_sub", F.lit(0))
    else:
        base = stage(base.withColumn("sd_sub", F.row_number().over(Window.partitionBy("sd_id").orderBy("text"))), "op9-rows")
    key = ["sd_id", "sd_sub"]
    found = base.select(*key, "text").mapInArrow(_anchored, "gram long, sd_id long, sd_sub int, pos int")
    twice = found.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("gram"))).where("times > 1")
    hits = stage(twice.groupBy(*key).agg(F.collect_list(F.struct("gram", "pos")).alias("hits")), "op9-hits")
    total = hits.agg(F.sum(F.size("hits"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_rows))
    runs = base.select(*key, "text").join(hits, key).select(*key, "text", "hits").mapInArrow(_runs(buckets), "bucket int, block binary")
    dealt = runs.withColumn("deal", F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("block"), F.lit(64))).otherwise(F.col("bucket")).cast("int"))
    spans = dealt.repartition("deal").sortWithinPartitions("bucket").select("bucket", "block").mapInArrow(_merge_buckets, SPANS)
    per_doc = stage(spans.groupBy(*key).agg(F.collect_list(F.struct("a", "b")).alias("spans")), "op9-spans")
    return base.join(per_doc, key, "left").select("doc_id", "text", "spans").mapInArrow(
        _cut(texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
