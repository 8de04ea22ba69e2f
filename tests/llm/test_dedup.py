"""Exact copies, near copies and repeated strings against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import exact_dedup, ngram_join, suffix_dedup

DOCS = "doc_id long, text string, lang string, gram long, dd_digest string, component string, keep_id string, kept string, prior int"  # names that the operators use inside


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "x", "y", "k", "no", 2) for i, t in rows], DOCS)


def prose(seed, n, words=300):
    g = random.Random(seed)
    return " ".join(f"w{g.randrange(words)}" for _ in range(n))


def corpus():
    g = random.Random(3)
    rows = [(k, prose(k, g.randrange(5, 120))) for k in range(60)]
    passage = prose(999, 70)
    rows += [(100 + k, prose(200 + k, 40) + " " + passage + " " + prose(300 + k, 30)) for k in range(12)]
    base = prose(77, 150).split()
    for k in range(25):  # a hot group of near copies
        copy = list(base)
        for _ in range(k % 4):
            copy[g.randrange(len(copy))] = f"edit{g.randrange(9999)}"
        rows.append((200 + k, " ".join(copy)))
    rows += [(300 + k, rows[5][1]) for k in range(10)]  # exact copies
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "One two"), (404, "one TWO"), (405, "one\ttwo  "), (406, "é" * 120), (407, "é" * 240)]
    rows += [(408, prose(5, 20_000)), (409, prose(5, 20_000) + " end"), (200, rows[72][1]), (None, "one two"), (None, None)]
    return rows


def test_similar_groups_equal_brute_force(spark):
    rows = corpus()
    for n, num, den in ((3, 90, 100), (5, 80, 100)):
        sets = {}
        for k, (i, t) in enumerate(rows):
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            sets[k] = {tuple(w[j:j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
        root = {i: i for i, _ in rows if i is not None}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a in sets:
            for b in range(a):
                i, j = rows[a][0], rows[b][0]
                if i is not None and j is not None and sets[a] and sets[b]:
                    both = len(sets[a] & sets[b])
                    if den * both >= num * (len(sets[a]) + len(sets[b]) - both) and find(i) != find(j):
                        root[max(find(i), find(j))] = min(find(i), find(j))
        want = Counter((i, len(sets[k]), find(i) if i is not None else None) for k, (i, _) in enumerate(rows))
        got = ngram_join.similar_groups(frame(spark, rows).repartition(3), n, num, den, group_tokens=1500)  # the hot group is dealt in slices
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want


def test_shared_passages_route_nothing(spark, monkeypatch):
    """Documents do not meet by passages that many share, also where counters of a fixed number are as full as on a large corpus."""
    g = random.Random(11)
    passages = [prose(500 + k, 48, words=5000) for k in range(30)]
    rows = []
    for k in range(200):  # four tenths of each document are passages of others
        parts = g.sample(passages, 3) + [prose(1000 + k, 200, words=50_000)]
        g.shuffle(parts)
        rows.append((k, " ".join(parts)))
    rows += [(300 + k, rows[k][1] + f" end{k}") for k in range(20)]
    links = []
    real = ngram_join.connected
    monkeypatch.setattr(ngram_join, "connected", lambda e, name: (links.extend(map(tuple, e.collect())) if name == "op3-coarse" else None, real(e, name))[1])
    monkeypatch.setattr(ngram_join, "BUCKETS", 1 << 12, raising=False)  # of the counters that there were
    monkeypatch.setattr(ngram_join, "KEYS", 700, raising=False)  # many buckets, many deals
    monkeypatch.setattr(ngram_join, "FLUSH", 500, raising=False)
    got = ngram_join.similar_groups(frame(spark, rows).repartition(3), 5, 80, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k % 300 for k, _ in rows}
    assert {(max(a, b), min(a, b)) for a, b in links} == {(300 + k, k) for k in range(20)}


def test_packed_elements_come_back():
    g = np.random.default_rng(2)
    docs, keys, levels = np.r_[g.integers(-(1 << 63), (1 << 63) - 1, 500), [-(1 << 63), (1 << 63) - 1]], g.integers(0, 1 << 32, 502).astype(np.uint32), g.integers(0, 256, 502).astype(np.uint8)
    bucket = g.integers(0, 7, 502)
    rows = ngram_join.pa.Table.from_batches([ngram_join.dealt(bucket, docs, keys, levels)])
    assert rows.column("bucket").to_pylist() == sorted(set(bucket.tolist()))
    for k in range(7):
        got = ngram_join.gathered(rows.slice(k, 1), np.uint32)
        assert Counter(zip(*(x.tolist() for x in got))) == Counter(zip(*(x[bucket == k].tolist() for x in (docs, keys, levels))))


def test_prefix_tree_finds_all_partners():
    g = np.random.default_rng(1)
    sets = [np.unique(g.integers(0, 400, g.integers(1, 200)).astype(np.uint64)) for _ in range(40)]
    sets += [np.setdiff1d(sets[3], g.choice(sets[3], 5)) for _ in range(20)] + [np.zeros(0, np.uint64)]
    tree = ngram_join.PrefixTree(sets, 80, 100)
    for k, s in enumerate(sets[:-1]):
        want = [j for j, t in enumerate(sets) if len(t) and 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t))]
        assert sorted(tree.partners(k).tolist()) == want


def test_copies_equal_brute_force(spark):
    rows = corpus()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 2))  # noqa: E731 a digest that clashes
    for digest in (exact_dedup.sha256, weak):
        out = exact_dedup.grouped_copies(frame(spark, rows).repartition(3), digest)
        assert out.columns == ["doc_id", "text", "lang", "gram", "component", "prior", "dd_digest", "dd_place", "keep_id", "group_size", "kept"]
        got = out.collect()
        assert len(got) == len(rows)
        for r in got:
            g = [i for i in groups[norm(r.text)] if i is not None]
            assert (r.keep_id, r.group_size) == (min(g, default=None), len(groups[norm(r.text)]))
        kept = [r for r in got if r.kept]
        assert len(kept) == len(groups) == len({norm(r.text) for r in kept})
        assert all(r.doc_id == r.keep_id for r in kept)


def test_repeats_equal_brute_force(spark):
    rows = corpus()
    order = sorted(((i if i is not None else 1 << 62, (t or "").encode()) for i, t in rows))
    seen, want = set(), Counter()
    for i, raw in order:
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - suffix_dedup.WINDOW + 1):
            w = raw[k:k + suffix_dedup.WINDOW]
            if w in seen:
                gone[k:k + suffix_dedup.WINDOW] = True
            seen.add(w)
        rest = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        want[(None if i == 1 << 62 else i, len(raw), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())] += 1
    got = suffix_dedup.cut_repeats(frame(spark, rows).repartition(3), bucket_rows=50)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())


def test_loser_tree_merges_with_right_prefixes():
    g = random.Random(5)
    runs = []
    for _ in range(5):
        texts = sorted(bytes(g.choices(b"ab", k=g.randrange(12))) for _ in range(g.randrange(0, 30)))
        inner = [0] + [suffix_dedup._shared(a, b, 0) for a, b in zip(texts, texts[1:])]
        runs.append((texts, inner[:len(texts)]))
    run, at, lcp = suffix_dedup.merged(runs)
    out = [runs[r][0][k] for r, k in zip(run, at)]
    assert out == sorted(t for r, _ in runs for t in r)
    assert lcp[1:] == [suffix_dedup._shared(a, b, 0) for a, b in zip(out, out[1:])]


@pytest.mark.parametrize("run", [lambda d: ngram_join.similar_groups(d), lambda d: exact_dedup.grouped_copies(d), lambda d: suffix_dedup.cut_repeats(d)])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).count() == 0
