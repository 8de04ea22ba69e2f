"""Quality classifier with hierarchical empirical Bayes (operator 6).

A logistic model over the mix of characters gives each document a probability of being good. Its sum
per host and path is shrunk twice: hosts towards the whole corpus, paths towards their host, with
prior strengths estimated from the spread of the means (method of moments). A document's final odds
are the model's odds times the odds of its path against those of the corpus, so a sparse site says
little and a large one speaks for its pages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.base import chunks, fit_logistic, labelled, stage, whole_text, without

TRAIN_ROWS = 20_000  # labelled documents that the model is fitted on, at most
SMALL = 50_000  # paths up to this number are broadcast, more are joined by hash

# Character classes (fixed values of this library): each is a feature, the share of such bytes.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", ".,", "!", "?", "|", "$%&*#", "-_=+", "()[]{}<>", "\"'`", ":;", "/\\@", "\t")


RESULTS = ("qc_doc", "qc_host", "qc_path", "qc_prior", "host_posterior", "path_posterior", "qc_score", "qc_kept")
HOST, PATH = "qc_host_of_row", "qc_path_of_row"


def class_shares(column: pa.Array) -> np.ndarray:
    """Shares of the character classes (the last: all other bytes) and the log of the length."""
    kind = np.full(256, len(CLASSES), dtype=np.uint8)
    for k, chars in enumerate(CLASSES):
        kind[[ord(c) for c in chars]] = k
    width = len(CLASSES) + 1
    out = np.zeros((len(column), width + 1))
    for at, end, data, offsets in chunks(column):
        size = np.diff(offsets)
        row = np.repeat(np.arange(end - at), size)
        counts = np.bincount(row * width + kind[data], minlength=(end - at) * width).reshape(-1, width)
        out[at:end, :width] = counts / np.maximum(size, 1)[:, None]
        out[at:end, width] = np.log1p(size)
    return out


def expand(x: np.ndarray) -> np.ndarray:
    """Shares and their roots: rare characters count from the first on."""
    return np.c_[x, np.sqrt(x[:, :-1])]


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> np.ndarray | None:
    """Mean, spread and weights of the model, or None without labels of both kinds."""
    train = labelled(docs, labels, "quality", most)

    def described(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(class_shares(b.column("text"))), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = train.mapInArrow(described, "doc_id long, y int, x array<double>").orderBy("doc_id").collect()  # at most `most` rows
    y = np.array([r.y for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    x = expand(np.array([r.x for r in rows]))
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = 1.0
    w = fit_logistic((x - mean) / spread, y)
    return np.stack([np.r_[mean, 0], np.r_[spread, 1], w])


def document_score(model: np.ndarray | None, text: Column) -> Column:
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        x = (expand(class_shares(column)) - model[0, :-1]) / model[1, :-1]
        return pa.array(1 / (1 + np.exp(-np.clip(x @ model[2, :-1] + model[2, -1], -30, 30))))

    return score(text)


def strength(groups: DataFrame, mean: str, count: str, prior: str) -> Column:
    """Prior weight in documents from the spread of group means about their prior, as one-row aggregate."""
    inner = F.sum(F.col(prior) * (1 - F.col(prior)))  # binomial variance of one document, by group
    between = F.sum(F.col(count) * F.pow(F.col(mean) - F.col(prior), 2))
    spread = (between - inner) / F.sum(count)
    return F.when(spread > 0, F.greatest(F.lit(1.0), F.least(F.lit(1e6), inner / F.count("*") / spread))).otherwise(1e6)


def site_posteriors(scored: DataFrame) -> DataFrame:
    """Host and path posteriors from qc_doc of all documents: qc_host, qc_path, qc_prior, host_posterior, path_posterior."""
    paths = stage(scored.groupBy("qc_host", "qc_path").agg(F.sum("qc_doc").alias("good"), F.count("*").alias("n")), "op6-paths")
    total = paths.agg((F.sum("good") / F.sum("n")).alias("prior"))
    hosts = paths.groupBy("qc_host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).crossJoin(F.broadcast(total)).withColumn("mean", F.col("good") / F.col("n"))
    weight = hosts.agg(strength(hosts, "mean", "n", "prior").alias("k"))
    hosts = hosts.crossJoin(F.broadcast(weight)).select("qc_host", "prior", ((F.col("good") + F.col("k") * F.col("prior")) / (F.col("n") + F.col("k"))).alias("host_posterior"))
    both = paths.join(hosts, "qc_host").withColumn("mean", F.col("good") / F.col("n"))
    weight = both.agg(strength(both, "mean", "n", "host_posterior").alias("k"))
    return stage(both.crossJoin(F.broadcast(weight)).select("qc_host", "qc_path", F.col("prior").alias("qc_prior"), "host_posterior", (
        (F.col("good") + F.col("k") * F.col("host_posterior")) / (F.col("n") + F.col("k"))).alias("path_posterior")), "op6-sites")


def graded(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, most: int = TRAIN_ROWS) -> DataFrame:
    """docs plus qc_doc, qc_host, qc_path, host_posterior, path_posterior, qc_score and qc_kept.

    docs: doc_id, text, host and path columns, more allowed; labels: doc_id, quality. The model is
    fitted on at most `most` labelled documents; scores and site sums take every row. Null hosts and
    paths are the value "unknown", null text is empty. Without labels of both kinds every model score
    is 0.5 and everything is kept. Columns of docs with the name of a result are replaced by it, but for
    the host and path columns, which may have any name.
    """
    rows = docs.withColumns({HOST: F.coalesce(F.col(host).cast("string"), F.lit("unknown")), PATH: F.coalesce(F.col(path).cast("string"), F.lit("unknown"))})
    docs = without(docs, RESULTS)
    model = fit(docs, labels, most)
    text = whole_text()
    rows = rows.drop("qc_host", "qc_path").withColumnsRenamed({HOST: "qc_host", PATH: "qc_path"})
    rows = rows.select(*docs.columns, "qc_host", "qc_path").withColumn("qc_doc", document_score(model, text))
    sites = site_posteriors(rows.select("qc_host", "qc_path", "qc_doc"))
    if sites.count() <= SMALL:
        sites = F.broadcast(sites)
    odds = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    clip = lambda c: F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col(c)))
    out = rows.join(sites, ["qc_host", "qc_path"]).withColumns({c: clip(c) for c in ("qc_doc", "qc_prior", "host_posterior", "path_posterior")})
    out = out.withColumn("qc_score", 1 / (1 + F.exp(-(odds("qc_doc") + odds("path_posterior") - odds("qc_prior")))))
    return out.withColumn("qc_kept", F.col("qc_score") >= threshold).select(*docs.columns, "qc_doc", "qc_host", "qc_path", "host_posterior", "path_posterior", "qc_score", "qc_kept")
