"""Toxicity by a weighted finite-state pattern grammar (operator 4).

Words become symbols: INSULT, THREAT, TARGET, NEGATION, REPORT, the end of a sentence (BREAK) or of a
clause inside it (SOFT), or OTHER. Small transducers read the symbols and each keeps one thing in its
state: whether a negation is near, whether the clause reports what others say, whether someone is
addressed. A report reaches over the comma or colon behind it, and back over the one before it. Their composition runs over
the symbols once; at the end of a clause it emits the clause's score, so words count by the clause
they stand in. Insults are learned: word beginnings that labelled toxic documents have and others do
not. A logistic model turns the clause scores of a document into a probability.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.base import Powers, byte_sums, chunks, fit_logistic, labelled, mix, range_hashes, split_words, stage, whole_text

TRAIN_ROWS = 20_000  # labelled documents that the lexicon and the model are fitted on, at most
STEMS = (4, 5, 6, 7)  # bytes of the word beginnings that are counted
BUCKETS = 1 << 20  # counters of the word beginnings, a fixed size
MOST_STEMS = 5_000  # learned beginnings, the strongest of those that pass
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = 3, 0.005, 3.0  # a learned beginning: toxic documents, their share, log odds

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK, SOFT = range(8)
SYMBOLS = 8
REPORTED = 0.7  # what a reported insult or threat counts

# Words of the grammar in four languages (fixed values of this library).
WORDS = {
    THREAT: "kill hurt destroy punch burn töten umbringen verletzen zerstören tuer frapper détruire brûler matar golpear destruir quemar",
    TARGET: "you your yours he she they them those these this that people du dich dein ihr euch diese tu toi vous ton votre ces tú usted tus esos esta",
    NEGATION: "not no never nobody isn't aren't nicht kein keine nie niemand ne pas jamais aucun nunca jamás ningún nadie",
    REPORT: "said says wrote claimed quoted reported sagte schrieb behauptete zitierte dit écrivait prétend cité dijo escribió afirmó citó",
}


class Step(NamedTuple):
    state: int
    factor: float
    bonus: float


def negation_machine(symbol: int, state: int) -> Step:
    """A negation weakens insults and threats among the next three words of its clause."""
    if symbol == NEGATION:
        return Step(3, 1.0, 0.0)
    if symbol in (BREAK, SOFT):
        return Step(0, 1.0, 0.0)
    return Step(max(0, state - 1), 0.6 if state and symbol in (INSULT, THREAT) else 1.0, 0.0)


def report_machine(symbol: int, state: int) -> Step:
    """What a clause reports counts less, there (state 1) and in the clause behind the next comma or colon (state 2)."""
    if symbol == REPORT:
        return Step(1, 1.0, 0.0)
    if symbol in (BREAK, SOFT):
        return Step(2 if state == 1 and symbol == SOFT else 0, 1.0, 0.0)
    return Step(state, REPORTED if state and symbol in (INSULT, THREAT) else 1.0, 0.0)


def target_machine(symbol: int, state: int) -> Step:
    """An insult or threat that meets a target in its clause, before or after it, counts more, once a clause."""
    if symbol in (BREAK, SOFT):
        return Step(0, 1.0, 0.0)
    met, hit = state & 1 or symbol == TARGET, state & 2 or symbol in (INSULT, THREAT)
    state_now = (1 if met else 0) | (2 if hit else 0) | (state & 4)
    if met and hit and not state & 4:
        return Step(state_now | 4, 1.0, 0.5)
    return Step(state_now, 1.0, 0.0)


MACHINES = ((negation_machine, 4), (report_machine, 3), (target_machine, 8))


def compose() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Product of the machines as tables by state and symbol: next state, factor, bonus."""
    sizes = [n for _, n in MACHINES]
    shape = (int(np.prod(sizes)), SYMBOLS)
    after, factor, bonus = np.zeros(shape, np.int64), np.ones(shape), np.zeros(shape)
    for states in itertools.product(*(range(n) for n in sizes)):
        here = int(np.ravel_multi_index(states, sizes))
        for symbol in range(SYMBOLS):
            steps = [m(symbol, s) for (m, _), s in zip(MACHINES, states, strict=True)]
            after[here, symbol] = np.ravel_multi_index([x.state for x in steps], sizes)
            factor[here, symbol] = np.prod([x.factor for x in steps])
            bonus[here, symbol] = sum(x.bonus for x in steps)
    return after, factor, bonus


class Grammar:
    """The composed transducer with its word lists."""

    def __init__(self, stems: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(stems)
        self.stems, self.weights = stems[order], weights[order]
        self.after, self.factor, self.bonus = (t.tolist() for t in compose())
        self.reported = [bool(np.unravel_index(k, [n for _, n in MACHINES])[1]) for k in range(len(self.after))]
        powers, codes, kinds = Powers(), [], []
        for kind, words in WORDS.items():
            data = np.frombuffer(words.encode(), np.uint8)
            code = split_words(data, np.array([0, len(data)]), powers, marks=True)[3]  # cut as texts are: isn't is two words
            codes.append(code)
            kinds.append(np.full(len(code), kind))
        codes, kinds = np.concatenate(codes), np.concatenate(kinds)
        order = np.argsort(codes)
        self.codes, self.kinds = codes[order], kinds[order]

    def symbols(self, data, offsets, powers: Powers):
        """Text, symbol and weight of all words and clause breaks that matter, in order."""
        total = byte_sums(data, powers)
        owner, start, end, code = split_words(data, offsets, powers, marks=True)
        kind, weight = np.zeros(len(code), np.int64), np.zeros(len(code))
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        known = self.codes[at] == code
        kind[known] = self.kinds[at[known]]
        if len(self.stems):
            for n in STEMS:
                long = np.flatnonzero(end - start >= n)
                stem = range_hashes(total, powers, start[long], start[long] + n) & np.uint64(BUCKETS - 1)
                at = np.minimum(np.searchsorted(self.stems, stem * 8 + n), len(self.stems) - 1)
                hit = self.stems[at] == stem * 8 + n
                w = long[hit]
                kind[w] = INSULT
                weight[w] = np.maximum(weight[w], self.weights[at[hit]])
        weight[kind == THREAT] = 1.0
        hot = np.zeros(len(offsets) - 1, dtype=bool)
        hot[owner[(kind == INSULT) | (kind == THREAT)]] = True
        stop = np.zeros(256, dtype=np.int64)
        stop[[ord(c) for c in ".!?;\n"]], stop[[ord(c) for c in ",:"]] = BREAK, SOFT
        cuts = np.flatnonzero(stop[data])
        cut_owner = np.searchsorted(offsets, cuts, side="right") - 1
        cuts, cut_owner = cuts[hot[cut_owner]], cut_owner[hot[cut_owner]]
        words = np.flatnonzero(hot[owner])
        place = np.r_[start[words], cuts]
        order = np.argsort(place, kind="stable")
        return np.r_[owner[words], cut_owner][order], np.r_[kind[words], stop[data[cuts]]][order], np.r_[weight[words], np.zeros(len(cuts))][order]

    def clauses(self, kind: list[int], weight: list[float]) -> tuple[list[float], int]:
        """Scores of the clauses of a text that have one, and the number of clauses."""
        state, score, scores, clauses = 0, 0.0, [], 0
        before = -1  # place of the clause in front of this one, where a report may still follow
        told = verb = False  # this clause is reported already; it has a verb of saying
        for k, w in zip([*kind, BREAK], [*weight, 0.0], strict=True):
            if k == REPORT:
                verb = True
                if before >= 0:
                    scores[before], before = scores[before] * REPORTED, -1
            if k in (INSULT, THREAT) and self.reported[state]:
                told = True
            score += w * self.factor[state][k] + self.bonus[state][k]
            state = self.after[state][k]
            if k in (BREAK, SOFT):
                clauses += 1
                before = -1
                if score:
                    scores.append(score)
                    if k == SOFT and not told and not verb:
                        before = len(scores) - 1
                score, told, verb = 0.0, False, False
        return scores, clauses

    def features(self, data, offsets, powers: Powers) -> np.ndarray:
        """Per text: log of all clause scores, the largest, the share of scored clauses, log of bare insults, threats."""
        out = np.zeros((len(offsets) - 1, 5))
        owner, kind, weight = self.symbols(data, offsets, powers)
        cut = np.searchsorted(owner, np.arange(len(offsets)))
        for t in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[t], cut[t + 1]
            scores, clauses = self.clauses(kind[a:b].tolist(), weight[a:b].tolist())
            bare = weight[a:b][kind[a:b] == INSULT].sum()
            threats = (kind[a:b] == THREAT).sum()
            scores = scores if bare or threats else []
            out[t] = (np.log1p(sum(scores)), max(scores, default=0.0), len(scores) / clauses, np.log1p(bare), np.log1p(threats) if not bare else 0.0)
        return out


def stem_sets(data, offsets, powers: Powers) -> Iterator[np.ndarray]:
    """Distinct counters of word beginnings of each text."""
    total = byte_sums(data, powers)
    owner, start, end, _ = split_words(data, offsets, powers, marks=True)
    who, what = [], []
    for n in STEMS:
        long = np.flatnonzero(end - start >= n)
        who.append(owner[long])
        what.append((range_hashes(total, powers, start[long], start[long] + n) & np.uint64(BUCKETS - 1)) * 8 + n)
    who, what = np.concatenate(who), np.concatenate(what).astype(np.int64)
    order = np.argsort(who, kind="stable")
    cut = np.searchsorted(who[order], np.arange(len(offsets)))
    for t in range(len(offsets) - 1):
        yield np.unique(what[order[cut[t]:cut[t + 1]]])


def _fingerprinted(batches):
    """doc_id, y, text and a 128-bit fingerprint of the set of words of each text."""
    powers, salts = Powers(), (np.uint64(0), np.uint64(0xA0761D6478BD642F))
    for b in batches:
        for at, end, data, offsets in chunks(b.column("text")):
            owner, _, _, code = split_words(data, offsets, powers, marks=True)
            order = np.lexsort((code, owner))
            owner, code = owner[order], code[order]
            first = np.r_[True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])] if len(code) else np.zeros(0, bool)
            prints = np.zeros((2, end - at), np.uint64)
            for k, salt in enumerate(salts):
                np.add.at(prints[k], owner[first], mix(code[first] ^ salt))
            yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, end - at) for c in ("doc_id", "y", "text")), *(pa.array(x.view(np.int64)) for x in prints)], ["doc_id", "y", "text", "set_a", "set_b"])


def _counted(batches):
    powers, counts = Powers(), np.zeros((2, BUCKETS * 8), np.int32)
    rows = [0, 0]
    for b in batches:
        y = b.column("y").to_pylist()
        for at, _, data, offsets in chunks(b.column("text")):
            for k, s in enumerate(stem_sets(data, offsets, powers)):
                counts[y[at + k], s] += 1
                rows[y[at + k]] += 1
    used = np.flatnonzero(counts.any(axis=0))
    blocks = np.flatnonzero(np.r_[True, np.diff(used >> 14) > 0]) if len(used) else np.zeros(0, np.int64)
    keys = [-1] + (used[blocks] >> 14).tolist()
    raw = [np.array(rows, np.int64).tobytes()] + [zlib.compress(np.ascontiguousarray(counts[:, k << 14:(k + 1) << 14]).tobytes(), 1) for k in keys[1:]]
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(raw, pa.binary())], ["block", "counts"])


def _strong(least_docs: int, least_share: float):
    """Sums of one block of counters: those that enough toxic documents have."""

    def run(key, table):
        block, raw = key[0].as_py(), table.column("counts").to_pylist()
        if block < 0:
            total = sum(np.frombuffer(x, np.int64) for x in raw)
            return pa.table({"stem": pa.array([-1], pa.int64()), "clean": pa.array([int(total[0])], pa.int64()), "toxic": pa.array([int(total[1])], pa.int64())})
        total = sum(np.frombuffer(zlib.decompress(x), np.int32).reshape(2, -1).astype(np.int64) for x in raw)
        good = np.flatnonzero((total[1] >= least_docs) & (total[1] > total[0]))
        return pa.table({"stem": pa.array(good + (block << 14), pa.int64()), "clean": pa.array(total[0][good]), "toxic": pa.array(total[1][good])})

    return run


def learn_stems(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Word beginnings that mark toxic documents, and their weights.

    Rows of one label with the same set of words count once; every other row counts.
    """
    one = train.mapInArrow(_fingerprinted, "doc_id long, y int, text string, set_a long, set_b long")
    first = one.groupBy("set_a", "set_b", "y").agg(F.min_by("text", "doc_id").alias("text")).select("y", "text")
    counts = first.mapInArrow(_counted, "block int, counts binary").groupBy("block").applyInArrow(_strong(LEAST_DOCS, LEAST_SHARE), "stem long, clean long, toxic long")
    total = None
    rows = counts.orderBy(F.desc(F.col("stem") < 0), F.desc(F.col("toxic") / (F.col("clean") + 1)), "stem").limit(MOST_STEMS + 1).collect()
    found = []
    for r in rows:
        if r.stem < 0:
            total = (r.clean, r.toxic)
        else:
            found.append((r.stem, r.clean, r.toxic))
    if not total or not total[1] or not found:
        return np.zeros(0, np.uint64), np.zeros(0)
    stem, clean, toxic = np.array(found).T
    odds = np.log((toxic + 0.5) / (total[1] + 1)) - np.log((clean + 0.5) / (total[0] + 1))
    ok = (odds >= LEAST_ODDS) & (toxic >= max(LEAST_DOCS, LEAST_SHARE * total[1]))
    return stem[ok].astype(np.uint64), np.minimum(odds[ok], 6.0) / 3.0


def fit(train: DataFrame) -> tuple[Grammar, np.ndarray | None]:
    """Grammar and model weights from a bounded sample (doc_id, text, y); no weights without both labels."""
    grammar = Grammar(*learn_stems(train))

    def described(batches):
        powers = Powers()
        for b in batches:
            for at, end, data, offsets in chunks(b.column("text")):
                x = grammar.features(data, offsets, powers)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, end - at) for c in ("doc_id", "y")), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = train.mapInArrow(described, "doc_id long, y int, x array<double>").orderBy("doc_id").collect()  # bounded with train
    y = np.array([r.y for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return grammar, None
    return grammar, fit_logistic(np.array([r.x for r in rows]), y, ridge=0.1)


def toxicity(grammar: Grammar, weights: np.ndarray | None, text: Column) -> Column:
    """Score from 0 to 1 of each text."""
    w = np.array([1.0, 0.5, 0.0, 1.0, 0.5, -2.0]) if weights is None else weights

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        powers, out = Powers(), np.zeros(len(column))
        for at, end, data, offsets in chunks(column):
            out[at:end] = grammar.features(data, offsets, powers) @ w[:-1] + w[-1]
        return pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return score(text)


def scored(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, most: int = TRAIN_ROWS) -> DataFrame:
    """docs plus tox_score, which replaces a column of that name.

    docs: doc_id, text, more columns allowed; labels: doc_id, toxic. learn_from: condition on doc_id
    of the labels that may be learned from. Lexicon and model come from at most `most` of those; texts
    are scored whole. Null text is empty and has the score of a text without matches. Without labels
    of both kinds fixed weights are used.
    """
    allowed = labels if learn_from is None else labels.where(learn_from)
    grammar, weights = fit(stage(labelled(docs, allowed.select("doc_id", "toxic"), "toxic", most), "op4-train"))
    return docs.withColumn("tox_score", toxicity(grammar, weights, whole_text()))
