"""Mixing, preference pairs and the pipeline."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from barloom.llm import mixing, preference

FOLDER = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, weight string, tokens string, topic string"


def documents():
    rows = [(k, "word " * (1 + k % 7) + ("!!" if k % 5 == 0 else ""), ["en", "de", None][k % 3], ["big", "big", "small", None][k % 4], "a", "b", "c") for k in range(600)]
    return rows + [(600, None, "en", "big", "a", "b", "c"), (601, "", None, None, "a", "b", "c"), (5, rows[5][1], "de", "big", "a", "b", "c"), (None, "lost words", "en", "big", "a", "b", "c"), (602, "w " * 50_000, "en", "big", "a", "b", "c")]


def test_margins_of_the_sample_are_the_targets(spark):
    docs = spark.createDataFrame(documents(), DOCS)
    wanted = {"lang": {"en": 1.0, "de": 1.0, "unknown": 2.0}}
    out = mixing.mixed(docs, {"source": 0.5, "topic": 1.0}, wanted)
    assert out.columns[:7] == [c.split()[0] for c in DOCS.split(", ")]
    rows = out.collect()
    assert len(rows) == len(documents())
    drawn = Counter()
    for r in rows:
        drawn[r.mx_lang] += r.mx_tokens * r.mx_probability
    total = sum(drawn.values())
    assert all(abs(drawn[k] / total - v) < 1e-6 for k, v in {"en": 0.25, "de": 0.25, "unknown": 0.5}.items())
    present, mixed = Counter(), Counter()
    for r in rows:
        present[r.mx_source] += r.mx_tokens
        mixed[r.mx_source] += r.mx_tokens * r.mx_probability
    root = sum(v ** 0.5 for v in present.values())
    assert all(abs(mixed[s] / total - v ** 0.5 / root) < 1e-6 for s, v in present.items())
    assert max(r.mx_probability for r in rows) == 1.0
    assert all(r.mx_kept == (r.mx_draw < r.mx_probability) for r in rows) and not any(r.mx_kept for r in rows if not r.mx_tokens)
    assert len({r.mx_kept for r in rows if r.doc_id == 5}) == 1
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_targets_that_cannot_be_met(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "x"), (2, "a b", "de", "y")], "doc_id long, text string, lang string, source string")
    with pytest.raises(RuntimeError, match="cannot be met"):
        cells = mixing.described(docs).groupBy("mx_source", "mx_lang", "mx_topic").agg(F.sum("mx_tokens").alias("tokens"))
        mixing.raked(cells, {}, {"lang": {"en": 0.9, "de": 0.1}, "source": {"x": 0.1, "y": 0.9}}, rounds=4)
    rows = mixing.raked(cells, {}, {"lang": {"en": 0.9, "de": 0.1}, "source": {"x": 0.1, "y": 0.9}}, rounds=4, strict=False).collect()
    assert len(rows) == 2 and abs(sum(r.weight for r in rows) - 1) < 1e-9


def test_raking_does_not_depend_on_how_factors_travel(spark):
    cells = mixing.described(spark.createDataFrame(documents(), DOCS)).groupBy("mx_source", "mx_lang", "mx_topic").agg(F.sum("mx_tokens").alias("tokens"))
    a, b = ({(r.mx_source, r.mx_lang, r.mx_topic): r.weight for r in mixing.raked(cells, {}, {}, 1e-6, small=small).collect()} for small in (1000, 0))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_preference_pairs(spark):
    turns = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "bad"),
        (2, "chosen", 0, "user", "same"), (2, "rejected", 0, "user", "same"), (3, "chosen", 0, None, None), (3, "chosen", None, "assistant", "late"),
        (4, "rejected", 0, "user", "only"), (5, "chosen", 0, "user", "a"), (5, "chosen", 0, "user", "a"), (5, "rejected", 0, "user", "a"), (None, "chosen", 0, "user", "x"), (6, "other", 0, "user", "x")]
    data = spark.createDataFrame([(*t, "extra") for t in turns], "pair_id long, side string, turn long, role string, text string, prompt string")
    got = {r.pair_id: r for r in preference.preference_pairs(data).collect()}
    say = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert (got[1].prompt, got[1].chosen, got[1].rejected) == (say("user", "hi"), say("assistant", "good"), say("assistant", "bad"))
    a, b = map(int, got[1].chosen_spans.split(":"))
    assert got[1].chosen[a:b] == "good<|im_end|>"
    assert (got[2].prompt_turns, got[2].prompt, got[2].chosen, got[2].rejected) == (1, say("user", "same"), "", "")
    assert got[3].chosen == say("", "") + say("assistant", "late") and got[3].prompt == got[3].rejected == ""
    assert got[4].chosen == "" and got[4].rejected == say("user", "only")
    assert (got[5].prompt, got[5].chosen, got[5].rejected) == (say("user", "a"), say("user", "a"), "")
    assert preference.preference_pairs(data.limit(0)).count() == 0


@pytest.mark.skipif(not FOLDER.exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", ["op1_mixing", "op3_ngram_join", "op7_exact_dedup", "op10_preference"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, str(FOLDER))
    assert sorted(got.columns) == sorted(columns)
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(want.fetchall())


@pytest.mark.skipif(not FOLDER.exists(), reason="the test tables are not here")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    at, counts = docs, [docs.count()]
    for name, step in corpus_pipeline.STAGES:
        at = step(spark, at, str(FOLDER))
        rows = at.collect()
        assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == docs.columns
        counts.append(len(rows))
        at = spark.createDataFrame(rows, at.schema)
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
