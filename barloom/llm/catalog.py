"""Named queries of the corpus operators, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import collocation, decontaminate, exact_dedup, filter_audit, mixing, ngram_join, packing, preference, quality, secret_scan, suffix_dedup, toxicity, warc
from barloom.llm.base import stage, table

Query = Callable[[SparkSession, str], DataFrame]

# Operator 1 -------------------------------------------------------------------------------------

MIX_POWERS = {"source": 0.5, "lang": 0.5, "topic": 0.7}


def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its cell, its probability of being drawn, and whether it is."""
    rows = mixing.described(table(spark, sf, "documents")).select("doc_id", "mx_source", "mx_lang", "mx_topic", "mx_tokens", "mx_draw")
    out = mixing.drawn(stage(rows, "op1-rows"), MIX_POWERS, strict=False)  # texts are read once
    return out.select("doc_id", F.col("mx_source").alias("source"), F.col("mx_lang").alias("lang"), F.col("mx_topic").alias("topic"), F.col("mx_tokens").alias("tokens"),
                      F.round("mx_probability", 6).alias("probability"), F.round("mx_draw", 12).alias("draw"), F.col("mx_kept").alias("kept"))


def mix_sql(rounds: int = 60) -> str:
    topic = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, '{m}')" for m in marks) + f" THEN '{n}'" for n, marks in mixing.TOPICS) + " ELSE 'prose' END"
    parts = [rf"""d AS (
  SELECT doc_id, t, source, lang, {topic} AS topic, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS tokens
  FROM (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang FROM documents))""",
             "c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0)",
             "w0 AS (SELECT *, tokens / sum(tokens) OVER () AS weight FROM c)"]
    for m in mixing.MARGINS:
        parts.append(f"g_{m} AS (SELECT {m}, pow(sum(tokens), {MIX_POWERS[m]}) / sum(pow(sum(tokens), {MIX_POWERS[m]})) OVER () AS target FROM c GROUP BY {m})")
    k = 0
    for _ in range(rounds):
        for m in mixing.MARGINS:
            parts.append(f"w{k + 1} AS MATERIALIZED (SELECT w.* EXCLUDE (weight), weight * target / sum(weight) OVER (PARTITION BY {m}) AS weight FROM w{k} w JOIN g_{m} USING ({m}))")
            k += 1
    parts.append(f"p AS (SELECT source, lang, topic, (weight / tokens) / max(weight / tokens) OVER () AS probability FROM w{k})")
    parts.append("o AS (SELECT d.*, CASE WHEN tokens > 0 THEN coalesce(probability, 0) ELSE 0 END AS probability, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), t)), 1, 12) AS BIGINT) / 281474976710656.0 AS draw FROM d LEFT JOIN p USING (source, lang, topic))")
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, source, lang, topic, tokens, round(probability, 6) AS probability, round(draw, 12) AS draw, draw < probability AS kept FROM o"


# Operator 2 -------------------------------------------------------------------------------------


def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the best window."""
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


# Operator 3 -------------------------------------------------------------------------------------


def op3_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf, "documents"), n=3, num=90, den=100)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2)
      JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1) c USING (doc_id)"""

# Operator 4 -------------------------------------------------------------------------------------


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every document; the labels of the held-out third are not learned from."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    out = toxicity.scored(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.7).cast("int").alias("predicted"))


# Operator 5 -------------------------------------------------------------------------------------


def op5_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, sf, "documents"))


# Operator 6 -------------------------------------------------------------------------------------


def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its model score, its site's posteriors, its final score, and whether it is kept."""
    out = quality.graded(table(spark, sf, "documents").select("doc_id", "text", "source", "lang"), table(spark, sf, "labels"))
    return out.select("doc_id", "source", "lang", F.col("qc_doc").alias("doc_score"), "host_posterior", "path_posterior", F.col("qc_score").alias("score"), F.col("qc_kept").alias("kept"))


# Operator 7 -------------------------------------------------------------------------------------


def op7_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = exact_dedup.grouped_copies(table(spark, sf, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("dd_digest")).alias("text_sha256"))


OP7_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n"""

# Operator 8 -------------------------------------------------------------------------------------


def op8_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages"))


# Operator 9 -------------------------------------------------------------------------------------


def op9_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.cut_repeats(table(spark, sf, "documents"), texts=False).drop("kept")


# Operator 10 ------------------------------------------------------------------------------------


def preference_turns(conversations: DataFrame) -> DataFrame:
    """Pairs from single conversations: chosen is the conversation itself, rejected the same up to its
    last assistant turn and then the last assistant turn of its neighbour (2k and 2k + 1)."""
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text")
    reply = turns.where("role = 'assistant' AND turn IS NOT NULL").groupBy("conv_id").agg(F.max("turn").alias("last"))
    said = turns.where("role = 'assistant'").join(reply, "conv_id").where("turn = last").groupBy("conv_id", "last").agg(F.max("text").alias("text"))
    other = said.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), "text")
    chosen = turns.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    before = turns.join(reply, "conv_id").where("turn < last").select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", "text")
    swapped = reply.join(other, "conv_id").select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), F.col("last").alias("turn"), F.lit("assistant").alias("role"), "text")
    return chosen.unionByName(before).unionByName(swapped)


def op10_preference(spark: SparkSession, sf: str) -> DataFrame:
    return preference.preference_pairs(preference_turns(table(spark, sf, "conversations")))


OP10_SQL = """
WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
reply AS (SELECT conv_id, max(turn) AS last FROM t WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY 1),
said AS (SELECT conv_id, last, max(text) AS text FROM t JOIN reply USING (conv_id) WHERE role = 'assistant' AND turn = last GROUP BY 1, 2),
rows AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM t
  UNION ALL SELECT conv_id, 'rejected', turn, role, text FROM t JOIN reply USING (conv_id) WHERE turn < last
  UNION ALL SELECT r.conv_id, 'rejected', r.last, 'assistant', s.text FROM reply r JOIN said s ON s.conv_id = xor(r.conv_id, 1)),
n AS (SELECT pair_id, side, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY pair_id, side ORDER BY turn ASC NULLS LAST, role ASC NULLS FIRST, text ASC NULLS FIRST) AS place FROM rows),
b AS (SELECT pair_id, place, count(*) AS sides, count(DISTINCT role || chr(1) || text) AS kinds FROM n GROUP BY 1, 2),
p AS (SELECT pair_id, coalesce(min(CASE WHEN sides < 2 OR kinds > 1 THEN place END) - 1, max(place)) AS prompt_turns FROM b GROUP BY 1),
q AS (SELECT pair_id, prompt_turns, place, role, CASE WHEN place <= prompt_turns THEN 'prompt' ELSE side END AS part,
             '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS turn
      FROM n JOIN p USING (pair_id) WHERE side = 'chosen' OR place > prompt_turns),
z AS (SELECT *, sum(length(turn)) OVER (PARTITION BY pair_id, part ORDER BY place) AS stop FROM q),
o AS (SELECT pair_id, part, string_agg(turn, '' ORDER BY place) AS text,
             string_agg(CASE WHEN role = 'assistant' THEN (stop - length(turn) + 13 + length(role)) || ':' || (stop - 1) END, ',' ORDER BY place) AS spans FROM z GROUP BY 1, 2)
SELECT p.pair_id, p.prompt_turns,
       coalesce(max(CASE WHEN part = 'prompt' THEN text END), '') AS prompt,
       coalesce(max(CASE WHEN part = 'chosen' THEN text END), '') AS chosen, coalesce(max(CASE WHEN part = 'chosen' THEN spans END), '') AS chosen_spans,
       coalesce(max(CASE WHEN part = 'rejected' THEN text END), '') AS rejected, coalesce(max(CASE WHEN part = 'rejected' THEN spans END), '') AS rejected_spans
FROM p LEFT JOIN o USING (pair_id) GROUP BY 1, 2"""

# Operator 11 ------------------------------------------------------------------------------------


def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """Best phrases of each language by the contract's score."""
    return collocation.collocations(table(spark, sf, "documents").select("text", "lang"), least=30, share=80, top=2000)


OP11_SQL = r"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
           FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, k, w[i:i + k - 1] AS g FROM p, (SELECT unnest([1, 2, 3, 4]) AS k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) WHERE len(w) >= k),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY 1),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
cut AS (SELECT c.lang, c.k, c.g, c.f AS a, x.f AS l, y.f AS r, h, CAST((CAST(c.f AS HUGEINT) * 2000000) // (x.f + y.f) AS BIGINT) AS score
        FROM f c, LATERAL (SELECT unnest(range(1, c.k)) AS h) JOIN f x ON x.lang = c.lang AND x.g = c.g[:h] JOIN f y ON y.lang = c.lang AND y.g = c.g[h + 1:] WHERE c.k > 1),
s AS (SELECT lang, k, g, a, min(struct_pack(score := score, h := h, l := l, r := r)) AS b FROM cut GROUP BY ALL),
inner_ AS (SELECT lang, g[i:i + m - 1] AS g, max(f) AS around FROM f, (SELECT unnest([2, 3]) AS m), LATERAL (SELECT unnest(range(1, k - m + 2)) AS i) WHERE m < k GROUP BY ALL),
o AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, b.l AS l, b.r AS r, b.score AS score FROM s LEFT JOIN inner_ USING (lang, g) WHERE around IS NULL OR 100 * around < 80 * a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) WHERE rank <= 2000"""

# Operator 12 ------------------------------------------------------------------------------------


def op12_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 tokens."""
    import public_tokenizers

    vocabulary = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")  # a few MB; its tokens never reach over white space
    out = packing.packed_documents(table(spark, sf, "documents"), vocabulary, size=2048, end=0, by_words=True, ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


# Operator 13 ------------------------------------------------------------------------------------


def op13_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What each of five filters removes per source, in every order."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    out = filter_audit.audit(docs, table(spark, sf, "labels"))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_sql(letters: str = "ABCDE") -> str:
    steps = ", ".join(f"('{''.join(p)}', {k + 1}, {sum(1 << letters.index(x) for x in p[:k])}, {1 << letters.index(p[k])})" for p in itertools.permutations(letters) for k in range(len(letters)))
    return rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ 	-
]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
m AS (SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
             + 4 * CAST(100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(t) AS INT)
             + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > first, false) AS INT) AS mask FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
s(filter_order, step, before, bit) AS (VALUES {steps}),
o AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
             coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed, coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant,
             coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit) AS shapley FROM o"""


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_mixing, op2_decontamination, op3_ngram_join, op4_toxicity, op5_secrets, op6_quality, op7_exact_dedup, op8_warc, op9_suffix_dedup, op10_preference,
    op11_collocations, op12_packing, op13_filter_audit)}
ORACLES: dict[str, str] = {"op1_mixing": mix_sql(), "op3_ngram_join": OP3_SQL, "op7_exact_dedup": OP7_SQL, "op10_preference": OP10_SQL,
                            "op11_collocations": OP11_SQL, "op13_filter_audit": audit_sql()}
