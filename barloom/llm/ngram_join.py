"""N-gram Jaccard join with prefix trees (operator 3).

Sets of word n-grams are ordered by their hash, one global order. Which sets have to meet is decided
without comparing any. A set of n elements shares at least ceil(t * n) of them with a set of Jaccard
similarity t or more, so in any fixed order of all elements one that they share is among the first
n - ceil(t * n) + 1 of both. Here the elements of a fixed slice of the hash space come first, those that
fewer sets have before others; only the few sets with too little in the slice look at more. So a share
SLICE * (1 - t) of the elements is dealt by hash to buckets and counted exactly there. Elements that one
set alone has come first and route nothing: a set is routed only if more than 1 - 1 / SLICE of the slice is
found elsewhere, by the rarest of that, however many passages it shares and however large the corpus is.

What travels to a bucket is packed: a few bytes an element. Buckets are made for about KEYS elements, so
the memory of a task does not grow with the corpus. Sets that share a routing element get a link to the
smallest document of that element, and the groups of these links are an upper bound of the true
groups. Each group's sets are shipped once and joined in a prefix tree: nodes hold runs of 16 elements,
a traversal carries the overlap of the path shared by all sets below, and a subtree is cut off when
its overlap plus the smaller of the remaining lengths cannot reach what the smallest set below needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.base import Powers, chunks, connected, mix, shingle_hashes, split_words, stage, whole_text

RUN = 16  # elements of a tree node
GROUP_TOKENS = 4_000_000  # elements of a group that one task takes; a larger group is dealt in pairs of slices
SLICE = 3.5  # share of the hash space that comes first, as a multiple of the share in which similar sets may differ
KEYS = 500_000  # elements that a bucket is made for
FLUSH = 1_000_000  # elements that a task holds before it deals them out
DEALT = "bucket int, docs binary, keys binary, levels binary"


def ordered_sets(data, offsets, powers: Powers, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes, and the sorted distinct n-gram hashes of all texts, one text after the other."""
    texts = len(offsets) - 1
    word_text, _, _, code = split_words(data, offsets, powers)
    owner, _, value = shingle_hashes(word_text, code, n, texts)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    if len(value):
        new = np.ones(len(value), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        owner, value = owner[new], value[new]
    return np.bincount(owner, minlength=texts), value


def in_slice(values: np.ndarray, num: int, den: int) -> np.ndarray:
    return (values >> np.uint64(32)) < np.uint64(min(1.0, SLICE * (den - num) / den) * (1 << 32))


def leading(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of how many first elements similar sets share one."""
    return sizes + num * sizes // -den + 1


def slice_sizes(sizes: np.ndarray, values: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes)[in_slice(values, num, den)], minlength=len(sizes))


def planes(a: np.ndarray) -> bytes:
    """All first bytes, all second bytes and so on: small numbers leave runs of zeros, which the shuffle packs."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplaned(raw: bytes, dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def dealt(bucket: np.ndarray, docs: np.ndarray, keys: np.ndarray, levels: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each bucket: its documents as differences, their keys and the levels of the keys."""
    order = np.lexsort((docs, bucket))
    bucket, docs, keys = bucket[order], docs[order], keys[order]
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    step = np.diff(docs, prepend=np.int64(0))  # may wrap around, and wraps back
    step[start] = docs[start]
    spans = list(zip(start.tolist(), [*start[1:].tolist(), len(bucket)], strict=True)) if len(start) else []
    return pa.RecordBatch.from_arrays([
        pa.array(bucket[start].astype(np.int32)), pa.array([planes(step[a:b]) for a, b in spans], pa.binary()), pa.array([planes(keys[a:b]) for a, b in spans], pa.binary()),
        pa.array([None if levels is None else levels[order[a:b]].tobytes() for a, b in spans], pa.binary())], ["bucket", "docs", "keys", "levels"])


def gathered(rows, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, keys and levels of the rows of a bucket."""
    docs = [np.cumsum(unplaned(d, np.int64)) for d in rows.column("docs").to_pylist()]
    keys = [unplaned(k, dtype) for k in rows.column("keys").to_pylist()]
    levels = [np.frombuffer(x or b"", dtype=np.uint8) for x in rows.column("levels").to_pylist()]
    return np.concatenate([np.zeros(0, np.int64), *docs]), np.concatenate([np.zeros(0, dtype), *keys]), np.concatenate([np.zeros(0, np.uint8), *levels])


def occurrences(keys: np.ndarray) -> np.ndarray:
    """How often the key of each place occurs."""
    order = np.argsort(keys, kind="stable")
    cut = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]]) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.r_[cut, len(keys)])
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.repeat(size, size)
    return out


def fingerprints(sizes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set."""
    out = []
    begin = np.concatenate([[0], np.cumsum(sizes)])
    for salt in (0x1B873593CC9E2D51, 0x38B34AE5A1E38B93):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(mix(total[begin[1:]] - total[begin[:-1]] + sizes.astype(np.uint64)))
    return out[0], out[1]


def _described(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            for at, end, data, offsets in chunks(b.column("text")):
                sizes, values = ordered_sets(data, offsets, powers, n)
                one, two = fingerprints(sizes, values)
                inside = slice_sizes(sizes, values, num, den)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, end - at), *(pa.array(x.astype(np.int64)) for x in (sizes, inside)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["doc_id", "n", "inside", "f1", "f2"])

    return run


def _dealt_elements(n: int, num: int, den: int, buckets: int):
    """Elements and their documents. An element is named by its bucket, 31 more bits and whether it is out of the
    slice: two that share a name count as one, which links documents that need not meet and never keeps any apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen, docs, elements, held = Powers(), set(), [], [], 0

        def out():
            values = np.concatenate(elements)
            name = mix(values ^ np.uint64(0x5851F42D4C957F2D))
            key = (name & np.uint64(0xFFFFFFFE)) | ~in_slice(values, num, den)
            return dealt(((name >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), np.concatenate(docs), key.astype(np.uint32))

        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for at, end, data, offsets in chunks(b.column("text")):
                sizes, values = ordered_sets(data, offsets, powers, n)
                one, two = fingerprints(sizes, values)
                first = np.zeros(len(sizes), dtype=bool)  # copies in this task travel once: they are joined by fingerprint
                for k, f in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                    if f not in seen:
                        seen.add(f)
                        first[k] = True
                more = slice_sizes(sizes, values, num, den) < leading(sizes, num, den)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                use = first[owner] & (more[owner] | in_slice(values, num, den))
                docs.append(ids[at:end][owner[use]])
                elements.append(values[use])
                held += len(elements[-1])
                if held >= FLUSH:
                    yield out()
                    docs, elements, held = [], [], 0
        if held:
            yield out()

    return run


def document_bucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(docs.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _levelled(buckets: int):
    def run(key, rows):
        """Elements found more than once go back to their documents with a level that grows with their count."""
        docs, keys, _ = gathered(rows, np.uint32)
        times = occurrences(keys)
        docs, keys, times = docs[times > 1], keys[times > 1].astype(np.uint64) | np.uint64(key[0].as_py() << 32), times[times > 1]
        return pa.Table.from_batches([dealt(document_bucket(docs, buckets), docs, keys, np.minimum(8 * np.log2(times), 255).astype(np.uint8))])

    return run


def _spared(num: int, den: int, buckets: int):
    """How many elements of each set come after its leading ones; the lowest bit tells that it looks out of the slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, inside = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "n", "inside"))
            need = leading(sizes, num, den)
            more = inside < need
            yield dealt(document_bucket(ids, buckets), ids, ((np.where(more, sizes, inside) - need) * 2 + more).astype(np.uint64))

    return run


def _routed(key, rows):
    """Routing keys of the documents of a bucket: what they share, without the most common that come after the leading elements.

    A set that looks out of the slice needs all that it shares in the slice. Of several texts of one
    doc_id the one that spares least decides, so that each keeps what it needs.
    """
    known = pa.compute.is_null(rows.column("levels"))
    texts, spare, _ = gathered(rows.filter(known), np.uint64)
    docs, keys, levels = gathered(rows.filter(pa.compute.invert(known)), np.uint64)
    outside = (keys & np.uint64(1)).astype(bool)
    order = np.lexsort((keys, levels, outside, docs))
    docs, keys, outside = docs[order], keys[order], outside[order]
    ids, begin, shared = np.unique(docs, return_index=True, return_counts=True)
    beyond = np.add.reduceat(outside.astype(np.int64), begin) if len(ids) else np.zeros(0, np.int64)
    drop, more = np.full(len(ids), 1 << 62), np.zeros(len(ids), dtype=bool)
    at = np.searchsorted(ids, texts)
    mine = np.flatnonzero(ids[np.minimum(at, len(ids) - 1)] == texts) if len(ids) else np.zeros(0, np.int64)
    np.minimum.at(drop, at[mine], (spare[mine] >> np.uint64(1)).astype(np.int64))
    np.logical_or.at(more, at[mine], (spare[mine] & np.uint64(1)).astype(bool))
    drop = np.where(more, np.minimum(drop, beyond), drop)
    send = np.arange(len(docs)) < np.repeat(begin + shared - drop, shared)
    return pa.table({"key": pa.array(keys[send].view(np.int64)), "doc_id": pa.array(docs[send])})


class PrefixTree:
    """Ordered sets as a tree whose nodes hold runs of RUN elements, level by level in arrays."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int) -> None:
        self.num, self.den, m = num, den, len(sets)
        self.sizes = np.array([len(s) for s in sets])
        begin = np.concatenate([[0], np.cumsum(self.sizes)])
        self.alphabet, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.sets = [flat[begin[k]:begin[k + 1]] for k in range(m)]
        none = len(self.alphabet)
        padded = np.concatenate([flat, np.full(RUN, none)])
        self.levels = []
        rows, parent = np.flatnonzero(self.sizes > 0), np.zeros(m, dtype=np.int64)
        depth = 0
        factor = mix(np.arange(1, RUN + 1, dtype=np.uint64)) | np.uint64(1)
        while len(rows):
            at = begin[rows] + depth * RUN
            take = at[:, None] + np.arange(RUN)
            run = padded[np.minimum(take, len(padded) - 1)]
            run[take >= begin[rows + 1][:, None]] = none
            key = mix(mix(parent[rows].astype(np.uint64)) + (run.astype(np.uint64) * factor).sum(axis=1, dtype=np.uint64))
            order = np.lexsort((key, parent[rows]))
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (parent[rows][order][1:] != parent[rows][order][:-1])
            node = np.empty(len(rows), dtype=np.int64)
            node[order] = np.cumsum(new) - 1
            lead = order[new]
            cut = np.flatnonzero(new)
            size, rest = self.sizes[rows][order], np.maximum(self.sizes[rows][order] - (depth + 1) * RUN, 0)
            ends = self.sizes[rows] <= (depth + 1) * RUN
            leaf = np.argsort(node[ends], kind="stable")
            last = np.where(run[lead] < none, run[lead], -1).max(axis=1)
            above = parent[rows][lead]
            count = int(parent[rows].max()) + 1 if depth else 1
            self.levels.append({
                "run": run[lead], "last": last, "low": np.minimum.reduceat(size, cut), "high": np.maximum.reduceat(size, cut), "rest": np.maximum.reduceat(rest, cut),
                "first": np.searchsorted(above, np.arange(count + 1)), "leaves": rows[ends][leaf], "leaf_at": np.searchsorted(node[ends][leaf], np.arange(len(lead) + 1))})
            parent[rows] = node
            rows = rows[~ends]
            depth += 1

    @staticmethod
    def _spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of several ranges, and the range of each."""
        length = stop - start
        which = np.repeat(np.arange(len(length)), length)
        return np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length) + start[which], which

    def partners(self, k: int) -> np.ndarray:
        """Sets that are similar to set k, itself included."""
        size = int(self.sizes[k])
        mark = np.zeros(len(self.alphabet) + 1, dtype=np.int64)
        mark[self.sets[k]] = 1
        passed = np.cumsum(mark)
        front, overlap, found = np.arange(len(self.levels[0]["low"])), None, []
        for depth, level in enumerate(self.levels):
            if depth:
                front, which = self._spans(level["first"][front], level["first"][front + 1])
                overlap = overlap[which]
            if not len(front):
                break
            got = mark[level["run"][front]].sum(axis=1)
            overlap = got if overlap is None else overlap + got
            leaves, which = self._spans(level["leaf_at"][front], level["leaf_at"][front + 1])
            if len(leaves):
                hit = level["leaves"][leaves]
                shared = overlap[which]
                found.append(hit[self.den * shared >= self.num * (size + self.sizes[hit] - shared)])
            low, high = level["low"][front], level["high"][front]
            most = overlap + np.minimum(size - passed[level["last"][front]], level["rest"][front])
            go = (level["rest"][front] > 0) & ((self.num + self.den) * most >= self.num * (size + low)) & (high * self.den >= self.num * size) & (size * self.den >= self.num * low)
            front, overlap = front[go], overlap[go]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def spanning_links(ids: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect exactly what all links of these sets connect.

    Sets of the largest component found so far need not be looked up: links that leave it are found
    from the other side. A group of near copies so takes one lookup and one for each stray set.
    """
    m = len(sets)
    if m == 2:
        a, b = sets
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return [(ids[0], ids[1])] if len(a) and len(b) and den * shared >= num * (len(a) + len(b) - shared) else []
    tree = PrefixTree(sets, num, den)
    weight = np.bincount(np.concatenate(tree.sets), minlength=len(tree.alphabet))
    central = np.array([weight[s].mean() if len(s) else 0 for s in tree.sets])
    group, links = np.arange(m), []
    waiting = tree.sizes > 0
    order = np.argsort(-central, kind="stable")
    while True:
        counts = np.bincount(group, minlength=m)
        top = int(counts.argmax())
        left = order[waiting[order] & ((group[order] != top) | (counts[top] == 1))]
        if not len(left):
            return links
        k = int(left[0])
        waiting[k] = False
        hits = tree.partners(k)
        fresh = np.unique(group[hits])
        for g in fresh[fresh != group[k]].tolist():
            links.append((ids[k], ids[int(hits[group[hits] == g][0])]))
        group[np.isin(group, fresh)] = group[k]


def _joined(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, part, ids, sets = Powers(), None, [], []

        def links():
            found = spanning_links(ids, sets, num, den) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for b in batches:  # sorted by part, so a group ends where the part changes
            for at, end, data, offsets in chunks(b.column("text")):
                sizes, values = ordered_sets(data, offsets, powers, n)
                begin = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                for k, (p, i) in enumerate(zip(b.column("part").slice(at, end - at).to_pylist(), b.column("doc_id").slice(at, end - at).to_pylist(), strict=True)):
                    if p != part:
                        yield links()
                        part, ids, sets = p, [], []
                    ids.append(i)
                    sets.append(values[begin[k]:begin[k + 1]])
        yield links()

    return run


def similar_groups(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Groups of documents linked by n-gram Jaccard similarity num/den or more.

    docs: doc_id long, text string; other columns are ignored. A null text counts as empty. An empty
    set is linked with nothing. Rows with equal doc_id count as one document that has several texts;
    rows without doc_id come back with a null component. Returns a row per input row: doc_id,
    n_shingles, component_id (smallest doc_id of the group).
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    known = base.where("doc_id IS NOT NULL")
    rows = stage(base.mapInArrow(_described(n, num, den), "doc_id long, n long, inside long, f1 long, f2 long"), "op3-sets")
    full = rows.where("n > 0 AND doc_id IS NOT NULL")
    # equal sets: linked to their smallest document
    first = full.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    dup = stage(first.where("rows > 1"), "op3-equal")
    equal = full.join(dup, ["f1", "f2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    total = full.agg(F.sum("n")).first()[0] or 0
    buckets = max(12, int(total * min(1.0, SLICE * (den - num) / den)) // KEYS)
    found = known.mapInArrow(_dealt_elements(n, num, den, buckets), DEALT).groupBy("bucket").applyInArrow(_levelled(buckets), DEALT)
    spared = full.select("doc_id", "n", "inside").mapInArrow(_spared(num, den, buckets), DEALT)
    routes = found.unionByName(spared).groupBy("bucket").applyInArrow(_routed, "key long, doc_id long")
    hub = F.min("doc_id").over(Window.partitionBy("key"))
    coarse = routes.withColumn("hub", hub).where("hub <> doc_id").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    may = connected(coarse.unionByName(equal), "op3-coarse")
    # one document of each set is compared
    ones = full.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "n")).alias("x")).select("x.doc_id", "x.n")
    member = stage(ones.join(may.withColumnRenamed("node", "doc_id"), "doc_id"), "op3-members")
    size = member.groupBy("component").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")).where("docs > 1")
    slices = F.ceil(F.col("tokens") / group_tokens).cast("int")
    placed = member.join(size.select("component", slices.alias("slices")), "component")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("slices").cast("long")).cast("int")
    others = F.when(F.col("slices") == 1, F.array(F.lit("0-0"))).otherwise(F.transform(
        F.filter(F.sequence(F.lit(0), F.col("slices") - 1), lambda j: j != mine), lambda j: F.concat_ws("-", F.least(j, mine), F.greatest(j, mine))))
    placed = placed.select("doc_id", F.explode(others).alias("slice"), "component").select("doc_id", F.concat_ws(":", "component", "slice").alias("part")).distinct()
    # the groups grow with the documents, so they are never broadcast; texts are smaller than their sets
    parts = known.hint("merge").join(placed, "doc_id").select("part", "doc_id", "text")
    links = parts.repartition("part").sortWithinPartitions("part").mapInArrow(_joined(n, num, den), "a long, b long")
    final = connected(links.unionByName(equal), "op3-links")
    return rows.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
