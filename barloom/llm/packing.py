"""Best-fit packing of tokenised documents into sequences by length-histogram planning (operator 12).

Documents become pieces of at most `size` tokens. Only the number of pieces of each length reaches the
driver: at most `size` counts, whatever the corpus. Best-fit decreasing runs on those counts - all
pieces of one length fill whole groups of equal sequences at a time - and gives a plan of a few
thousand runs of slots. Each piece then takes its slot by its rank among the pieces of its length.
Ranks come from a window over (length, bucket) and a running sum over buckets, so copies that all have
one length are spread over many tasks.
"""

from __future__ import annotations

import heapq
import os
import sys
import types
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.base import chunks, stage, whole_text

SIZE = 2048  # tokens of a sequence
END = 0  # id after each document
RANK_ROWS = 1_000  # pieces of one rank bucket, on average
CHUNK = 4 << 20  # bytes of text whose words are told apart at a time
CACHE_WORDS = 1_200_000  # words whose ids a worker process keeps
MARKS = ".,;:!?"  # a word's last sentence mark is encoded on its own


class Run(NamedTuple):
    """Slots of pieces of one length: the pieces of rank first to last - 1 go to sequences from `sequence` on, `each` to a sequence from `offset` on."""

    length: int
    first: int
    last: int
    sequence: int
    each: int
    offset: int


def plan(counts: dict[int, int], size: int = SIZE) -> tuple[list[Run], int]:
    """Best-fit decreasing over a histogram of lengths: runs of slots, and the number of sequences.

    A group is a range of sequences with the same room left. The longest pieces go first; each step
    takes the group with the least room that fits, fills each of its sequences with as many pieces as
    go in, and splits off the sequence that is filled in part. This is what best-fit does piece by
    piece, as a sequence that took one piece has less room than its neighbours and stays the best fit.
    """
    runs: list[Run] = []
    rooms: list[int] = []  # sorted rooms that some group has
    groups: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, sequences)
    total = 0

    def put(room: int, first: int, many: int) -> None:
        if many and room:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            heapq.heappush(groups[room], (first, many))

    for length in sorted((k for k, n in counts.items() if n > 0 and k > 0), reverse=True):
        if length > size:
            raise ValueError(f"a piece of {length} tokens does not fit into {size}")
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = heapq.heappop(groups[room])
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first, many = size, total, -(-left // (size // length))
                total += many
            each = room // length
            whole = min(many, left // each)
            if whole:
                runs.append(Run(length, rank, rank + whole * each, first, each, size - room))
                put(room - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if left and whole < many:  # the last sequence of this length takes the rest
                runs.append(Run(length, rank, rank + left, first + whole, left, size - room))
                put(room - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            put(room, first + whole, many - whole)
    return runs, total


class Words:
    """Token ids of texts as bytes, one 32-bit number an id.

    With `by_words`, texts are cut at blanks and line ends and each distinct word is encoded once, in
    lower case: right for vocabularies that fold case and whose tokens never reach over white space nor
    from a letter to a sentence mark.
    New words are encoded many at a time, as one text, and told apart by the places of their tokens.
    Otherwise whole texts are encoded.
    """

    def __init__(self, vocabulary: str, by_words: bool) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives one core to a task
        # a worker process runs many tasks: the vocabulary and the words it has met stay there
        home = sys.modules.setdefault("barloom_worker", types.ModuleType("barloom_worker"))
        key = hash(vocabulary)
        if getattr(home, "vocabulary", None) != key:
            home.vocabulary, home.tokenizer, home.known = key, Tokenizer.from_str(vocabulary), {"": b""}
        self.tokenizer, self.known, self.by_words = home.tokenizer, home.known, by_words

    def encoded(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.asarray(found.ids, dtype="<u4")
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        cut = (4 * np.searchsorted([a for a, _ in found.offsets], starts)).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cut, cut[1:])]

    def learn(self, words: list[str]) -> None:
        parts = {w: (w[:-1], w[-1]) if w[-1] in MARKS and w[-2:-1].isalnum() else (w,) for w in words}
        # ASCII letters fold to lower case; "<" may begin a special token, which does not
        small = {x: x.lower() if x.isascii() and "<" not in x else x for p in parts.values() for x in p}
        bare = [x for x in {*small.values()} if x not in self.known]
        for k in range(0, len(bare), 2_000):
            self.known.update(zip(bare[k:k + 2_000], self.encoded(bare[k:k + 2_000])))
        self.known.update([(w, b"".join([self.known[small[x]] for x in p])) for w, p in parts.items()])

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text."""
        if not self.by_words:
            for text in texts:
                yield np.asarray(self.tokenizer.encode(text.as_py(), add_special_tokens=False).ids, dtype="<u4").tobytes()
            return
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > CACHE_WORDS:
            self.known.clear()
            self.known[""] = b""
        new = [w for w in distinct if w not in self.known]
        if new:
            self.learn(new)
        raw = [self.known[w] for w in distinct]
        size = np.array([len(r) // 4 for r in raw], dtype=np.int64)
        table = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)]), pa.array(np.frombuffer(b"".join(raw), dtype="<u4")))
        every = table.take(coded.indices).flatten().to_numpy()
        ends = np.r_[0, np.cumsum(size[coded.indices.to_numpy()])]
        bounds = ends[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield every[a:b].tobytes()


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, by_words: bool = False, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with `ids`, the token ids of each piece.

    docs: doc_id, text; other columns are ignored. Null text is empty: its only id is `end`, which
    closes every document. vocabulary: the content of a tokenizer file, which travels with the task.
    Only documents of more than `size` ids are cut; the last piece may be shorter. Repeated rows come
    out repeated.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else "")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    closing = np.array([end], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(vocabulary, by_words)
        width = 4 * size

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 5
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array([len(p) // 4 for p in cols[3]], pa.int64()), pa.array(cols[4], pa.int64())]
            if ids:
                flat = np.frombuffer(b"".join(cols[3]), dtype="<i4")
                arrays.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) // 4 for p in cols[3]], dtype=np.int64)].astype(np.int32)), pa.array(flat)))
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            rows, held = [], 0
            texts = b.column("text")
            every = (raw for at, stop, _, _ in chunks(texts, CHUNK) for raw in words.ids(texts.slice(at, stop - at)))
            for doc, raw in zip(b.column("doc_id").to_pylist(), every, strict=True):
                raw += closing
                for k, at in enumerate(range(0, len(raw), width)):
                    part = raw[at:at + width]
                    rows.append((doc, k, at // 4, part, zlib.crc32(part)))
                held += len(raw)
                if held > 1 << 24:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    return base.mapInArrow(cut, schema)


def ranked(rows: DataFrame, counts: dict[int, int], most: int = RANK_ROWS) -> DataFrame:
    """rows (doc_id, piece, start, length, ids_crc32, ...) plus `rank` from 0 within each length.

    counts: pieces of each length; a length gets buckets of about `most` pieces. Rows that are equal in
    all five columns may swap ranks; nothing else depends on the order of tasks.
    """
    spread = rows.sparkSession.createDataFrame([(k, -(-n // most)) for k, n in counts.items()], "length long, _buckets long")
    rows = rows.join(F.broadcast(spread), "length").withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("_buckets"))).drop("_buckets")  # at most a row per length
    sums = rows.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    placed = rows.withColumn("_at", F.row_number().over(inside) - 1)
    return placed.join(base, ["length", "_bucket"]).withColumn("rank", F.col("_base") + F.col("_at")).drop("_bucket", "_base", "_at")


def packed(rows: DataFrame, size: int = SIZE, rank_rows: int = RANK_ROWS) -> DataFrame:
    """Pieces (see `pieces`) plus sequence_id (from 0) and offset, in as few sequences of `size` as best-fit needs.

    Rows are read three times, so give a written table. Pieces without tokens are not allowed; an empty
    table gives an empty one.
    """
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    runs, _ = plan(counts, size)
    spark = rows.sparkSession
    slots = spark.createDataFrame([tuple(r) for r in runs], "length long, _first long, _last long, _sequence long, _each long, _offset long")
    at = F.col("rank") - F.col("_first")
    # a few runs per length: the plan depends on `size`, not on the corpus
    out = ranked(rows, counts, rank_rows).join(F.broadcast(slots), "length").where("rank >= _first AND rank < _last")
    return out.select(*rows.columns, (F.col("_sequence") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"), (F.col("_offset") + at % F.col("_each") * F.col("length")).cast("long").alias("offset"))


def sequences(rows: DataFrame) -> DataFrame:
    """Packed sequences: sequence_id, length, ids, doc_ids and starts of the pieces, from `packed` rows with ids.

    A group is one sequence, so at most `size` tokens meet in it.
    """
    parts = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("_p"), F.sum("length").alias("length"))
    return parts.select("sequence_id", "length", F.flatten("_p.ids").alias("ids"), F.col("_p.doc_id").alias("doc_ids"), F.col("_p.offset").alias("starts"))


def packed_documents(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, by_words: bool = False, ids: bool = True) -> DataFrame:
    """Documents tokenised, cut and packed: one row per piece with its place."""
    return packed(stage(pieces(docs, vocabulary, size, end, by_words, ids), "op12-pieces"), size)
