"""Phrase collocation mining by multikey three-way quicksort of suffix pointers (operator 11).

Each word is the start of a suffix of at most four words of its piece. Tasks turn words into ids,
merge equal suffixes, and route them by the order of their leading words; the bounds follow words two
to four where a leading word or pair is too frequent for one task. A routed range is sorted by
three-way partitions on one word at a time: the middle part is equal in one more word, its size is the
phrase's count, and a part that is too small to hold a frequent phrase is abandoned. Phrases that
reach over a bound are summed afterwards.

Counts of single words come first: they name the words, give the totals of each language, and leave
out words that are too rare to be in any phrase.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.base import Powers, chunks, mix, range_hashes, stage, whole_text

DEPTH = 4  # words of a phrase, at most
BUCKET_ROWS = 600_000  # suffixes of one routed range, on average
SAMPLE = 200_000  # suffixes that the bounds of the ranges are taken from: they balance tasks, no result depends on them
VOCABULARY = 1 << 22  # frequent words up to this number go out as ids (32 MB); beyond, suffixes travel as 64-bit codes
CHUNK = 3 << 20  # bytes of text that a task sorts at a time
HASHED = 1 << 20  # bytes that share running sums
SEEDS = 4  # codings that are tried until no two words share a code
PREFIX_BITS = (24, 44, 56, 64)  # bits of the routing key that the first one, two, three, four words fill

# What separates pieces and words (fixed values of the contract).
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"


# --- words of a chunk -------------------------------------------------------------------------


def _tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower case, code and kind (0 letter, 1 blank, 2 end of a piece) of each byte."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    codes = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 + 256 * seed)) | np.uint64(1)
    kind = np.zeros(256, dtype=np.uint8)
    kind[list(BLANKS)], kind[list(PIECE_ENDS)] = 1, 2
    return lower, codes, kind


class Coder:
    """Cuts chunks of texts into words and codes them; what it holds is bounded by the longest text."""

    def __init__(self, seed: int) -> None:
        self.lower, self.codes, self.kind = _tables(seed)
        self.powers, self.langs = Powers(), {}

    def lang(self, name: str) -> int:
        if name not in self.langs:
            self.langs[name] = int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little")
        return self.langs[name]

    def words(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]) -> tuple[np.ndarray, ...]:
        """Text, start, end, code of each word, whether the next word follows in the same piece, and the lower-case bytes."""
        low = self.lower[data]
        kind = self.kind[low]
        inside = kind == 0
        edge = np.zeros(len(low) + 1, dtype=bool)
        edge[offsets] = True
        start = np.flatnonzero(inside & np.r_[True, ~inside[:-1] | edge[1:-1]]) if len(low) else np.zeros(0, np.int64)
        end = np.flatnonzero(inside & np.r_[~inside[1:] | edge[1:-1], True]) + 1 if len(low) else start
        code = np.empty(len(start), dtype=np.uint64)
        at = 0
        while at < len(offsets) - 1:  # running sums of about HASHED bytes at a time
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + HASHED, side="right")) - 1)
            bytes_ = low[offsets[at]:offsets[to]]
            total = np.zeros(len(bytes_) + 1, dtype=np.uint64)
            up, _ = self.powers.upto(len(bytes_) + 1)
            np.cumsum(self.codes[bytes_] * up[:len(bytes_)], dtype=np.uint64, out=total[1:])
            a, b = np.searchsorted(start, (offsets[at], offsets[to]))
            code[a:b] = range_hashes(total, self.powers, start[a:b] - offsets[at], end[a:b] - offsets[at])
            at = to
        text = np.searchsorted(offsets, start, side="right") - 1
        code = mix(code ^ np.array([self.lang(x) for x in langs], dtype=np.uint64)[text])
        code[code == 0] = 1
        ends = np.zeros(len(low) + 1, dtype=np.int64)
        np.cumsum(kind == 2, out=ends[1:])
        linked = np.zeros(len(start), dtype=bool)
        linked[:-1] = (text[1:] == text[:-1]) & (ends[start[1:]] == ends[end[:-1]])
        return text, start, end, code, linked, low


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Texts of several batches together, about CHUNK bytes at a time."""
    data: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    langs: list[str] = []
    held = 0
    for b in batches:
        names = b.column("lang").to_pylist()
        for at, end, raw, offsets in chunks(b.column("text"), CHUNK):
            data.append(raw)
            sizes.append(np.diff(offsets))
            langs += names[at:end]
            held += len(raw)
            if held >= CHUNK:
                yield np.concatenate(data), np.r_[0, np.cumsum(np.concatenate(sizes))], langs
                data, sizes, langs, held = [], [], [], 0
    if held:
        yield np.concatenate(data), np.r_[0, np.cumsum(np.concatenate(sizes))], langs


def _counted_words(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(seed)
        for data, offsets, langs in _chunks(batches):
            text, start, end, code, _, low = coder.words(data, offsets, langs)
            value, first, count = np.unique(code, return_index=True, return_counts=True)
            raw = low.tobytes()
            word = pa.array([raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array([langs[k] for k in text[first]], pa.string()), word, pa.array(count)], ["code", "lang", "word", "n"])

    return run


def word_counts(docs: DataFrame) -> tuple[DataFrame, int]:
    """code, lang, word, n of every word of (lang, text), and the seed of the coding: no two rows share a code."""
    for seed in range(SEEDS):
        rows = docs.mapInArrow(_counted_words(seed), "code long, lang string, word string, n long")
        words = stage(rows.groupBy("code", "lang", "word").agg(F.sum("n").alias("n")), "op11-words")
        if words.groupBy("code").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
            return words, seed
    raise RuntimeError(f"words share codes in {SEEDS} codings")


# --- suffixes ---------------------------------------------------------------------------------


def routing_key(codes: list[np.ndarray]) -> np.ndarray:
    """64 bits that order suffixes by their leading words: 24, 20, 12 and 8 bits of the four words."""
    c1, c2, c3, c4 = codes
    u = np.uint64
    return (c1 >> u(40) << u(40)) | (c2 >> u(44) << u(20)) | (c3 >> u(52) << u(8)) | (c4 >> u(56))


def suffixes(code: np.ndarray, linked: np.ndarray, known: np.ndarray | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Codes and ids of the suffixes of two to four words; 0 where a suffix has ended.

    known: sorted codes of the frequent words; ids are places there, from 1, and a suffix ends before
    any other word. Without it ids are the codes.
    """
    if known is None:
        ident, frequent = code, np.ones(len(code), bool)
    else:
        value, back = np.unique(code, return_inverse=True)
        at = np.searchsorted(known, value)
        hit = known[np.minimum(at, len(known) - 1)] == value if len(known) else np.zeros(len(value), bool)
        ident = np.where(hit, at + 1, 0).astype(np.uint32)[back]
        frequent = ident > 0
    go = np.zeros(len(code) + DEPTH, dtype=bool)
    go[:len(code) - 1] = (linked[:-1] & frequent[:-1] & frequent[1:]) if len(code) else False
    first = np.flatnonzero(go)
    codes, ids = [code[first]], [ident[first]]
    more = np.ones(len(first), bool)
    for k in range(1, DEPTH):
        more = more & go[first + k - 1]
        at = np.minimum(first + k, len(code) - 1)
        codes.append(np.where(more, code[at], np.uint64(0)))
        ids.append(np.where(more, ident[at], ident.dtype.type(0)))
    return codes, ids


def _planes(column: np.ndarray) -> bytes:
    return np.ascontiguousarray(column.view(np.uint8).reshape(-1, column.dtype.itemsize).T).tobytes()


def _unplanes(raw: bytes, n: int, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()


def packed(ids: list[np.ndarray], weight: np.ndarray) -> bytes:
    """A sorted run of suffixes: differences of the first words, bytes by rank, compressed."""
    lead = ids[0].copy()
    lead[1:] -= ids[0][:-1]
    return pa.compress(b"".join(map(_planes, [lead, *ids[1:], weight.astype(np.uint32)])), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int, kind: np.dtype) -> tuple[list[np.ndarray], np.ndarray]:
    width = kind.itemsize * n
    data = pa.decompress(raw, decompressed_size=DEPTH * width + 4 * n, codec="zstd", asbytes=True)
    ids = [_unplanes(data[k * width:(k + 1) * width], n, kind) for k in range(DEPTH)]
    ids[0] = np.cumsum(ids[0], dtype=kind)
    return ids, _unplanes(data[DEPTH * width:], n, np.dtype(np.uint32)).astype(np.int64)


def _sampled(seed: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(seed)
        for data, offsets, langs in _chunks(batches):
            _, start, _, code, linked, _ = coder.words(data, offsets, langs)
            codes, _ = suffixes(code, linked, None)
            key = routing_key(codes)
            picked = mix(np.arange(len(key), dtype=np.uint64) + np.uint64(len(data))) < np.uint64(share * (2**64 - 2**11))
            yield pa.RecordBatch.from_arrays([pa.array(key[picked].view(np.int64))], ["key"])

    return run


def range_bounds(docs: DataFrame, words: int, seed: int, ranges: int) -> np.ndarray:
    """Routing keys that cut the suffixes into about even ranges, from a sample of about SAMPLE suffixes."""
    if ranges < 2:
        return np.zeros(0, np.uint64)
    share = min(1.0, SAMPLE / words)
    texts = min(1.0, 20 * share)  # whole texts first, then suffixes inside
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(texts * 1_000_000) + 1)
    rows = some.mapInArrow(_sampled(seed, share / texts), "key long").toPandas()  # about SAMPLE rows
    keys = np.sort(rows["key"].to_numpy().astype(np.int64).view(np.uint64))
    return np.unique(keys[np.linspace(0, len(keys), ranges + 1).astype(int)[1:-1]]) if len(keys) else keys


def _routed(seed: int, known, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(seed)
        for data, offsets, langs in _chunks(batches):
            _, _, _, code, linked, _ = coder.words(data, offsets, langs)
            codes, ids = suffixes(code, linked, None if known is None else known.value)
            key = routing_key(codes)
            order = np.argsort(key)
            key, ids = key[order], [x[order] for x in ids]
            new = np.ones(len(key), dtype=bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in ids])
            at = np.flatnonzero(new)
            weight = np.diff(np.r_[at, len(key)])
            key, ids = key[at], [x[at] for x in ids]
            cut = np.r_[0, np.searchsorted(key, bounds), len(key)]
            some = np.flatnonzero(cut[1:] > cut[:-1])
            yield pa.RecordBatch.from_arrays([
                pa.array(some.astype(np.int32)), pa.array((cut[some + 1] - cut[some]).astype(np.int32)),
                pa.array([packed([x[a:b] for x in ids], weight[a:b]) for a, b in zip(cut[some], cut[some + 1])], pa.binary())], ["bucket", "n", "run"])

    return run


# --- three-way quicksort ----------------------------------------------------------------------


def frequent_phrases(ids: np.ndarray, weight: np.ndarray, least: int, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pointer, depth and count of every phrase of two words and more.

    ids: (DEPTH, suffixes), 0 where a suffix has ended. tie: how many leading words of a suffix may
    also lead suffixes of other ranges; phrases of up to so many words are given whatever their count.

    All parts of a round are split together, each by a pivot of its own on the word at its depth: less,
    equal, greater. An equal part goes one word deeper. A part lighter than `least` is abandoned.
    """
    g = np.random.default_rng(7)
    point = np.arange(ids.shape[1])
    sizes, depth = np.array([len(point)]), np.array([0])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(point):
        parts = len(sizes)
        begin = np.cumsum(sizes) - sizes
        part = np.repeat(np.arange(parts), sizes)
        value = ids[depth[part], point]
        probe = np.sort(value[begin + (g.random((3, parts)) * sizes).astype(np.int64)], axis=0)[1][part]
        side = (value >= probe).astype(np.int8) + (value > probe)
        # a stable deal: place of each element = start of its side in its part + rank among that side
        place = np.empty(len(point), dtype=np.int64)
        many = np.zeros((parts, 3), dtype=np.int64)
        ranks = []
        for k in range(3):
            run = np.cumsum(side == k)
            before = np.where(begin > 0, run[begin - 1], 0)
            many[:, k] = run[begin + sizes - 1] - before
            ranks.append((run, before))
        starts = (np.cumsum(many.ravel()) - many.ravel()).reshape(parts, 3)
        for k, (run, before) in enumerate(ranks):
            at = np.flatnonzero(side == k)
            place[at] = starts[part[at], k] + run[at] - 1 - before[part[at]]
        dealt = np.empty_like(point)
        dealt[place] = point
        point, equal = dealt, np.tile(np.array([0, 1, 0]), parts)
        sizes, depth = many.ravel(), np.repeat(depth, 3) + equal
        some = sizes > 0
        sizes, depth, equal = sizes[some], depth[some], equal[some] == 1
        begin = np.cumsum(sizes) - sizes
        mass = np.add.reduceat(weight[point], begin)
        lead = point[begin]
        report = equal & (depth >= 2) & ((mass >= least) | (tie[lead] >= depth))
        found.append((lead[report], depth[report], mass[report]))
        # deeper only where a word follows and the part may still hold a frequent phrase
        go = (depth < DEPTH) & ((mass >= least) | (np.maximum.reduceat(tie[point], begin) > depth))
        each = np.repeat(go, sizes)
        low = np.repeat(depth, sizes)
        each[each] = ids[low[each], point[each]] != 0
        point, sizes = point[each], np.add.reduceat(each.astype(np.int64), begin)
        depth, sizes = depth[sizes > 0], sizes[sizes > 0]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def ties(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Leading words of each suffix whose other suffixes may lie beyond the bounds of its range."""
    out = np.zeros(len(key), dtype=np.int64)
    for bound in (*low, *high):
        for k, bits in enumerate(PREFIX_BITS):
            shift = np.uint64(64 - bits)
            np.maximum(out, np.where(key >> shift == bound >> shift, k + 1, 0), out=out)
    return out


def _mined(known, bounds: np.ndarray, least: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, kind = key[0].as_py(), np.dtype(np.uint64 if known is None else np.uint32)
        runs = [unpacked(r.as_py(), n.as_py(), kind) for n, r in zip(table.column("n"), table.column("run"))]
        ids = np.stack([np.concatenate([r[0][k] for r in runs]) for k in range(DEPTH)])
        weight = np.concatenate([r[1] for r in runs])
        if known is None:
            codes = list(ids)
        else:
            place = np.r_[np.uint64(0), known.value]
            codes = [place[x] for x in ids]
        tie = ties(routing_key(codes), bounds[bucket - 1:bucket] if bucket else bounds[:0], bounds[bucket:bucket + 1])
        lead, depth, count = frequent_phrases(ids, weight, least, tie)
        flat = np.stack([c[lead] for c in codes], axis=1).view(np.int64) if len(lead) else np.zeros((0, DEPTH), np.int64)
        phrase = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(depth)].astype(np.int32)), pa.array(flat[np.arange(DEPTH)[None, :] < depth[:, None]]))
        return pa.table({"phrase": phrase, "f": pa.array(count.astype(np.int64)), "open": pa.array(tie[lead] >= depth)})

    return run


def phrase_counts(docs: DataFrame, words: DataFrame, seed: int, least: int, bucket_rows: int = BUCKET_ROWS, vocabulary: int = VOCABULARY) -> DataFrame:
    """phrase (codes of two to four words), f: all phrases of (lang, text) that occur `least` times or more."""
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = words.where(F.col("n") >= least).select("code")
    known = None
    if frequent.count() <= vocabulary:  # checked size: eight bytes a word
        known = docs.sparkSession.sparkContext.broadcast(np.sort(frequent.toPandas()["code"].to_numpy().astype(np.int64).view(np.uint64)))
    bounds = range_bounds(docs, total, seed, -(-total // bucket_rows))
    routed = docs.mapInArrow(_routed(seed, known, bounds), "bucket int, n int, run binary")
    mined = stage(routed.groupBy("bucket").applyInArrow(_mined(known, bounds, least), "phrase array<long>, f long, open boolean"), "op11-mined")
    over = mined.where("open").groupBy("phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)  # a phrase is in few ranges
    return mined.where("NOT open").select("phrase", "f").unionByName(over)


# --- scores -----------------------------------------------------------------------------------


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """phrase, a, l, r, score: the cut with the lowest floor(2000000 * a / (l + r)), the first of equal ones."""
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1))).select(
        "phrase", F.col("f").alias("a"), "k", F.slice("phrase", F.lit(1), F.col("k")).alias("left"), F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k")).alias("right"))
    part = lambda side, name: counts.select(F.col("phrase").alias(side), F.col("f").alias(name))
    both = cuts.join(part("left", "l"), "left").join(part("right", "r"), "right")
    exact = "decimal(38,0)"  # 2000000 * a may pass 64 bits
    both = both.withColumn("score", F.expr(f"CAST(a AS {exact}) * CAST(2000000 AS {exact}) div (CAST(l AS {exact}) + CAST(r AS {exact}))"))
    best = both.groupBy("phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_b"))
    return best.select("phrase", "a", "_b.l", "_b.r", F.col("_b.score").cast("long").alias("score"))


def maximal(phrases: DataFrame, share: int) -> DataFrame:
    """Phrases without a longer phrase around them that has `share` percent of their count."""
    longer = phrases.where(F.size("phrase") > 2).withColumn("k", F.explode(F.sequence(F.lit(2), F.size("phrase") - 1)))
    inner = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("phrase") - F.col("k") + 1))).select(F.slice("phrase", F.col("at"), F.col("k")).alias("phrase"), "f")
    around = inner.groupBy("phrase").agg(F.max("f").alias("_around"))  # the most frequent one decides
    wide = lambda c, by: F.col(c).cast("decimal(38,0)") * by
    out = phrases.join(around, "phrase", "left")
    return out.where(F.col("_around").isNull() | (wide("_around", 100) < wide("f", share))).drop("_around")


def collocations(docs: DataFrame, least: int = 30, share: int = 80, top: int = 2000, bucket_rows: int = BUCKET_ROWS, vocabulary: int = VOCABULARY) -> DataFrame:
    """Best phrases of two to four words per language: lang, rank, phrase, a, l, r, n, score.

    docs: text and lang; other columns are ignored. Null text is empty, null lang is "und". A language
    without candidates has no rows; repeated rows count repeatedly.
    """
    base = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().alias("text"))
    words, seed = word_counts(base)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = stage(phrase_counts(base, words, seed, least, bucket_rows, vocabulary), "op11-phrases")
    single = words.where(F.col("n") >= least).select(F.array("code").alias("phrase"), F.col("n").alias("f"))
    best = stage(scored(maximal(phrases, share), phrases.unionByName(single)), "op11-scored")
    named = words.where(F.col("n") >= least).select("code", "lang", "word")
    best = best.withColumn("code", F.col("phrase")[0]).join(named.select("code", "lang"), "code")
    order = [F.desc("score"), F.desc("a")]
    # equal scores at the edge all stay until their words are known; each task cuts its own rows first
    few = best.withColumn("_place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_place") <= top).drop("code", "_place")
    few = stage(few, "op11-few")
    each = few.select("phrase", F.posexplode("phrase").alias("at", "code")).join(named.select("code", "word"), "code")
    text = each.groupBy("phrase").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda s: s["word"])).alias("text"))  # four words at most
    out = few.join(text, "phrase").join(totals, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "text"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), F.col("text").alias("phrase"), "a", "l", "r", "n", "score")
