"""Phrase collocations, packing and the filter audit against brute force."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import collocation, filter_audit, packing

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n long, length long, hash string, mask string, code string"  # names that the operators use inside


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 1, 2, "x", "y", "z") for i, t, lang, source in rows], DOCS)


def corpus():
    g = np.random.default_rng(5)
    words = ["The", "of", "red", "fox", "été", "ß", "a-b", "x\x1cy", "New", "York", " wide", "Nächte"]
    rows = []
    for k in range(160):
        n = int(g.integers(0, 90))
        text = " ".join(words[j] + ("." if g.random() < 0.1 else "") for j in (g.zipf(1.4, n) % len(words)))
        rows.append((k, text, ["en", "de", None][k % 3], ["big", None, ""][k % 4 % 3]))
    same = "New York of the red fox! " * 9
    rows += [(200 + k, same, "en", "big") for k in range(30)]  # a hot group of copies
    rows += [(300, None, "en", "big"), (301, "", None, None), (302, " \t\n", "de", "small"), (303, "word " * 30_000, "en", "small"), (304, "AAAA BB " * 40 + "#", "en", "big"), (5, rows[5][1], "en", "big"),
             (None, same, "en", "big"), (None, None, "fr", "rare"), (200, same, "en", "small"), (305, " ".join(f"w{k}" for k in range(300)), "en", "rare"), (7, "another text under a used id", "en", "big")]
    return rows


# --- collocations -----------------------------------------------------------------------------


def mined(rows, least, share, top):
    grams, total = Counter(), Counter()
    for _, t, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            grams.update((lang or "und", *w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang in total:
        own = {g[1:]: f for g, f in grams.items() if g[0] == lang and f >= least}
        rows = []
        for g, a in own.items():
            if len(g) == 1 or any(100 * f >= share * a for h, f in own.items() if len(h) > len(g) and any(h[i:i + len(g)] == g for i in range(len(h)))):
                continue
            score, _, left, right = min((2_000_000 * a // (own[g[:k]] + own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, total[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return Counter(out)


@pytest.mark.parametrize("bucket_rows, vocabulary", [(10**9, 1 << 20), (200, 1 << 20), (50, 0)])
def test_collocations_equal_brute_force(spark, monkeypatch, bucket_rows, vocabulary):
    rows = corpus()
    want = mined(rows, 6, 80, 25)
    assert len(want) > 60
    got = collocation.collocations(frame(spark, rows).repartition(3), 6, 80, 25, bucket_rows, vocabulary)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert Counter(tuple(r) for r in got.collect()) == want


def test_words_that_share_a_code_are_coded_anew(spark, monkeypatch):
    rows = corpus()[:40]
    docs = frame(spark, rows).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    tables = collocation._tables

    def weak(seed):
        lower, codes, kind = tables(seed)
        return lower, np.zeros_like(codes) if seed == 0 else codes, kind

    monkeypatch.setattr(collocation, "_tables", weak)
    words, seed = collocation.word_counts(docs)
    assert seed == 1 and words.count() == words.select("code").distinct().count()


def test_three_way_quicksort():
    g = np.random.default_rng(2)
    ids = g.zipf(1.5, (4, 5000)).clip(max=30).astype(np.uint32)
    ids[3][g.random(5000) < 0.3] = 0
    ids[2][g.random(5000) < 0.2] = 0
    ids[3][ids[2] == 0] = 0
    weight = g.integers(1, 4, 5000)
    tie = np.where(ids[0] == 2, 2, 0)  # phrases of two words that begin with word 2 go on elsewhere
    want = Counter()
    for col, w in zip(ids.T.tolist(), weight.tolist()):
        for k in range(2, 5):
            if col[k - 1]:
                want[tuple(col[:k])] += w
    lead, depth, count = collocation.frequent_phrases(ids, weight, 40, tie)
    got = {tuple(ids[:d, p].tolist()): c for p, d, c in zip(lead, depth, count)}
    assert len(got) == len(lead)
    assert got == {k: c for k, c in want.items() if c >= 40 or (len(k) == 2 and k[0] == 2)}


def test_runs_survive_the_journey():
    g = np.random.default_rng(3)
    for kind in (np.uint32, np.uint64):
        ids = [g.integers(0, np.iinfo(kind).max, 1000, dtype=kind, endpoint=True) for _ in range(4)]
        weight = g.integers(1, 1 << 31, 1000)
        back, w = collocation.unpacked(collocation.packed(ids, weight), 1000, np.dtype(kind))
        assert all((a == b).all() for a, b in zip(ids, back)) and (w == weight).all()


# --- packing ----------------------------------------------------------------------------------


def best_fit(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(size - n)
    return len(rooms)


def test_plan_is_best_fit():
    g = np.random.default_rng(1)
    for size in (10, 64, 300):
        for _ in range(30):
            lengths = np.minimum(g.zipf(1.3, int(g.integers(1, 400))), size).tolist()
            counts = Counter(lengths)
            runs, total = packing.plan(counts, size)
            assert total == best_fit(lengths, size)
            taken, placed = defaultdict(list), Counter()
            for r in runs:
                for k in range(r.first, r.last):
                    at = k - r.first
                    taken[r.sequence + at // r.each].append((r.offset + at % r.each * r.length, r.length))
                    placed[r.length] += 1
            assert placed == counts and sorted(taken) == list(range(total))
            for parts in taken.values():
                parts.sort()
                assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= size
    many = packing.plan({7: 10**9, 3: 10**9, 10: 5}, 10)  # counts, not documents
    assert many[1] == 10**9 + 5 and len(many[0]) == 3


@pytest.mark.parametrize("by_words", [True, False])
def test_packed_documents_equal_whole_encodings(spark, by_words):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [*corpus(), (400, "Fox. fox, É, été? a.b. ... -. ≠ e.̸ x!? 7. ²; <|endoftext|>. it's <|startoftext|>x\n\ny'll  \u0085 Á E ́ ΑΣ ΣΑΣ. 日本語 \x1c\x1f　😀 12,345", "en", "big")]
    size = 128
    docs = frame(spark, rows).repartition(3)
    out = packing.packed_documents(docs, open(path, encoding="utf-8").read(), size, 0, by_words)
    got = out.collect()
    want = Counter()
    for i, t, _, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), size):
            part = np.array(ids[k:k + size], dtype="<u4")
            want[(i, k // size, k, len(part), zlib.crc32(part.tobytes()), tuple(part.tolist()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= size
    assert len(places) == best_fit([r.length for r in got], size)
    whole = packing.sequences(out).collect()
    assert len(whole) == len(places) and sum(len(s.ids) for s in whole) == sum(r.length for r in got) and all(len(s.ids) == s.length for s in whole)
    ranks = packing.ranked(out.drop("ids"), Counter(r.length for r in got), 20).groupBy("length").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.max("rank").alias("m"), F.min("rank").alias("l")).collect()
    assert all(r.n == r.d == r.m + 1 and r.l == 0 for r in ranks)  # several buckets per length


# --- filter audit -----------------------------------------------------------------------------


def audited(rows, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, _, source in rows:
        t = t or ""
        w = re.findall(WORD, t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        docs.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        removed = Counter()
        for order in itertools.permutations("ABCDE"):
            for k, x in enumerate(order):
                before, row = set(order[:k]), Counter()
                for _, fails, g, tox in (d for d in docs if d[0] == part):
                    here = x in fails and not fails & before
                    row.update(kept=not fails & (before | {x}), removed=here, redundant=x in fails and bool(fails & before), unique=fails == {x}, good=here and g, toxic=here and tox)
                removed[x] += row["removed"]
                out[(part, "".join(order), k + 1)] = [row[c] for c in ("kept", "removed", "redundant", "unique", "good", "toxic")]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed[order[step - 1]])
    return {k: tuple(int(x) for x in v) for k, v in out.items()}


@pytest.mark.parametrize("bits", [None, 14])
def test_audit_equals_brute_force(spark, bits):
    rows = corpus()
    labels = [(k, k % 2, int(k % 7 == 0)) for k in range(0, 230, 3)] + [(3, 0, 1), (None, 1, 1), (999, 1, 1), (6, None, None)]
    out = filter_audit.audit(frame(spark, rows).repartition(3), spark.createDataFrame([(*x, "extra") for x in labels], "doc_id long, quality int, toxic int, part string"), bits)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out.collect()}
    assert got == audited(rows, labels)


def test_sketch_clears_unique_texts_only(spark):
    values = [*range(3000), *range(0, 3000, 50), *([7] * 500)]
    hashes = spark.createDataFrame([(v,) for v in values], "v long").select("v", F.xxhash64("v").alias("hash")).repartition(5)
    seen = {r.v: r.maybe for r in hashes.withColumn("maybe", filter_audit.possible_repeat(hashes)).collect()}
    count = Counter(values)
    assert all(seen[v] for v in count if count[v] > 1)
    assert sum(seen[v] for v in count if count[v] == 1) < 60  # 16 cells a text: few false alarms
    full = {r.v: r.maybe for r in hashes.withColumn("maybe", filter_audit.possible_repeat(hashes, 14)).collect()}
    assert all(full[v] for v in count if count[v] > 1)


@pytest.mark.parametrize("run", [
    lambda d: collocation.collocations(d), lambda d: packing.packed_documents(d, open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()),
    lambda d: filter_audit.audit(d, d.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")))])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).count() == 0
