"""Every stage of the pipeline against a brute-force version, each on what the stage before kept."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import mixing, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, qc_host string, mx_tokens string, dc_text string"  # extra columns with names of results


def prose(seed, n):
    g = random.Random(seed)
    return " ".join(f"w{g.randrange(4000)}x" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    g = random.Random(2)
    rows, labels = [], []
    for k in range(160):
        junk = k % 4 == 1
        text = prose(k, g.randrange(8, 70))
        rows.append((k, text.upper().replace(" ", "!! ") if junk else text, ["en", "de", None][k % 3], ["a", "a", "b", None][k % 4]))
        labels.append((k, int(not junk), 0))
    rows += [(200 + k, rows[2][1].replace(" ", "  ") if k % 2 else rows[2][1], "en", "a") for k in range(9)]  # exact copies but for blanks
    base = prose(999, 120).split()
    for k in range(12):  # near copies
        copy = list(base)
        for _ in range(k % 3):
            copy[g.randrange(len(copy))] = f"edit{g.randrange(999)}"
        rows.append((300 + k, " ".join(copy), "de", "b"))
    bench = [(k, prose(5000 + k, 20 + k)) for k in range(6)]
    rows += [(400 + k, prose(600 + k, 30) + " " + bench[k][1] + " " + prose(700 + k, 25), "en", "c") for k in range(6)]
    rows += [(500, None, None, None), (501, "", "en", "a"), (502, "  ", "en", "a"), (None, "no id here but words", "en", "a"), (None, None, None, None), (3, rows[3][1], "en", "a"), (503, prose(7, 20_000), "en", "b")]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(*r, 7, "x", "y", "z", "u") for r in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, bench


def graded(spark, rows, path):
    """The model is the operator's; scores, sites and decisions are computed here from it."""
    docs = spark.read.parquet(f"{path}/documents.parquet")
    mean, spread, w = quality.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    import pyarrow as pa

    x = quality.expand(quality.class_shares(pa.array([r.text or "" for r in rows])))
    score = 1 / (1 + np.exp(-np.clip((x - mean[:-1]) / spread[:-1] @ w[:-1] + w[-1], -30, 30)))
    host, page = defaultdict(list), defaultdict(list)
    for r, s in zip(rows, score):
        host[r.source or "unknown"].append(s)
        page[r.source or "unknown", r.lang or "unknown"].append(s)
    prior = score.mean()

    def strength(groups):  # (mean, count, prior) of each
        inner = sum(p * (1 - p) for _, _, p in groups)
        apart = (sum(n * (m - p) ** 2 for m, n, p in groups) - inner) / sum(n for _, n, _ in groups)
        return max(1.0, min(1e6, inner / len(groups) / apart)) if apart > 0 else 1e6

    k = strength([(np.mean(v), len(v), prior) for v in host.values()])
    hosts = {h: (sum(v) + k * prior) / (len(v) + k) for h, v in host.items()}
    k = strength([(np.mean(v), len(v), hosts[h]) for (h, _), v in page.items()])
    pages = {p: (sum(v) + k * hosts[p[0]]) / (len(v) + k) for p, v in page.items()}
    odds = lambda p: np.log(p / (1 - p))
    return [odds(s) + odds(pages[r.source or "unknown", r.lang or "unknown"]) - odds(prior) >= 0 for r, s in zip(rows, score)]


def first_copies(rows):
    best = {}
    for k, r in enumerate(rows):
        t = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        at = (r.doc_id is None, r.doc_id or 0)
        if t not in best or at < best[t][0]:
            best[t] = (at, k)
    return Counter((rows[k].doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", rows[k].text or "")) for _, k in best.values())


def near_roots(rows):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets.append({tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a].doc_id is not None and rows[b].doc_id is not None:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
    least = defaultdict(list)
    for k in range(len(rows)):
        least[find(k)].append(rows[k].doc_id if rows[k].doc_id is not None else 1 << 60)
    return [rows[k].doc_id is None or rows[k].doc_id == min(least[find(k)]) for k in range(len(rows))]


def leaky(rows, bench):
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())
    cut = lambda w: {tuple(w[j:j + 5]): sum(map(len, w[j:j + 5])) for j in range(len(w) - 4)}
    out = []
    for r in rows:
        w, found = split(r.text), False
        for _, text in bench:
            x = split(text)
            a = cut(x)
            for s in range(max(1, len(w) - len(x) + 1)) if set(w) & set(x) else ():
                b = cut(w[s:s + len(x)])
                found = found or bool(b) and sum(v for k, v in a.items() if k in b) / max(sum(a.values()), sum(b.values())) >= 0.8
        out.append(found)
    return out


def chances(rows, tokens):
    cells, key = defaultdict(float), []
    for r, n in zip(rows, tokens):
        t = r.text or ""
        topic = next((name for name, marks in mixing.TOPICS if any(m in t for m in marks)), "prose")
        key.append((r.source or "unknown", r.lang or "unknown", topic))
        cells[key[-1]] += n
    cells = {k: v for k, v in cells.items() if v}
    total = sum(cells.values())
    weight = {k: v / total for k, v in cells.items()}
    for _ in range(400):
        for m, power in enumerate(corpus_pipeline.MIX_POWERS[x] for x in mixing.MARGINS):
            have, now = Counter(), Counter()
            for k in cells:
                have[k[m]] += cells[k]
                now[k[m]] += weight[k]
            goal = {v: n ** power for v, n in have.items()}
            weight = {k: w * goal[k[m]] / sum(goal.values()) / now[k[m]] for k, w in weight.items()}
    ratio = {k: weight[k] / cells[k] for k in cells}
    return [ratio[k] / max(ratio.values()) if n else 0.0 for k, n in zip(key, tokens)]


def test_stages_equal_brute_force(spark, folder):
    path, bench = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    by = lambda rows: sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    names = [c.split()[0] for c in DOCS.split(", ")]
    at = docs
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = by(at.collect())
        out = corpus_pipeline.stage(step(spark, at, path), f"t{k}")
        after = by(out.collect())
        ids = Counter((r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in after)
        plain = lambda keep: Counter((r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r, k in zip(before, keep) if k)
        if name == "quality classifier":
            want = plain(graded(spark, before, path))
        elif name == "exact dedup":
            want = first_copies(before)
        elif name == "n-gram Jaccard join":
            want = plain(near_roots(before))
        elif name == "benchmark decontamination":
            want = plain([not x for x in leaky(before, bench)])
        else:
            tokens = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in before]
            p = chances(before, tokens)
            got = {r.doc_id: r.probability for r in after}
            assert all(abs(got[r.doc_id] - x) < 1e-9 for r, x in zip(before, p) if r.doc_id in got)
            draw = [r.d for r in spark.createDataFrame([(i, r.doc_id, r.text) for i, r in enumerate(before)], "i int, doc_id long, text string").select("i", mixing.draw(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("d")).orderBy("i").collect()]
            want = plain([d < x for d, x in zip(draw, p)])
        assert ids == want, name
        assert 0 < len(after) < len(before)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
            assert all((r.n_chars, r.kept, r.qc_host, r.mx_tokens, r.dc_text) == (7, "x", "y", "z", "u") for r in after)
        at = out


def test_pipeline_on_an_empty_table(spark, folder, tmp_path):
    path, _ = folder
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
