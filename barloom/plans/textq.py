"""Text and page quality over document and page tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.series import look_up, ordered_sums

# Patterns that must not be published, and Latin terms allowed in Chinese texts.
FORBIDDEN = [
    r"(?iU)\b[a-f0-9]{24,}\b", r"(?iU)/analysis/[a-z0-9_-]+", r"(?iU)\b(?:event[_\s-]?id|uuid|hash)\b",
    r"(?iU)\b(?:payload|權限策略|參考識別|authority record)\b", r"(?iU)\bConclusion Event\b",
]
ALLOWED_LATIN = ["USDT", "BTC", "ETH", "SOL", "XRP", "BNB", "ADA", "TRX", "LTC", "RSI", "MACD"]
HASH_LEAK = r"(?i)\b[a-f0-9]{24,}\b"
JSONLD = r"(?i)<script[^>]+application/ld\+json"
CANONICAL = r"""(?i)<link[^>]+rel=["']canonical["']"""
HREFLANG = r"""(?i)hreflang=["']([^"']+)["']"""


def scrub(text: Column) -> Column:
    """Remove forbidden patterns and collapse blanks."""
    for p in FORBIDDEN:
        text = F.regexp_replace(text, p, "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"^\s+|\s+$", "")


def slug(value: Column) -> Column:
    """Lower-case words joined by dashes, at most 120 characters (the slug's own limit)."""
    s = F.regexp_replace(F.lower(F.trim(value)), r"[^a-z0-9]+", "-")
    out = F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, 120)
    return F.when(F.length(out) > 0, out).otherwise("report")


def latin_words(text: Column, allowed: Sequence[str] = ALLOWED_LATIN) -> Column:
    """Latin words of three letters or more that are not on the allowlist."""
    for term in allowed:
        text = F.replace(text, F.lit(term), F.lit(" "))
    return F.regexp_count(text, F.lit(r"[A-Za-z]{3,}"))


def html_text(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^ | $", "")


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """Forbidden terms found as whole words."""
    return F.filter(F.array(*[F.when(text.rlike(rf"(?i)\b{t}\b"), t) for t in terms]), lambda x: x.isNotNull())


def page_markers(pages: DataFrame, html: str = "html", required: Sequence[str] = ("en", "zh-tw")) -> DataFrame:
    """Structured data, canonical link, language links, and required languages that are missing."""
    langs = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(HREFLANG), F.lit(1)), lambda x: F.lower(F.trim(x)))))
    out = pages.withColumns({"has_jsonld": F.col(html).rlike(JSONLD), "has_canonical": F.col(html).rlike(CANONICAL), "hreflangs": langs})
    return out.withColumn("missing_langs", F.array_except(F.array(*[F.lit(x) for x in required]), F.col("hreflangs")))


def surface_score(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shares of pages with markers, nearest-rank p95 latency, reliability. Needs ok, latency_ms and markers.

    Latencies are counted per value first, so the rank runs over ranges of distinct values.
    """
    keys = list(keys)
    share = lambda c: 100.0 * F.avg(c.cast("int"))
    agg = pages.groupBy(*keys).agg(
        F.count("*").alias("pages"), share(F.col("ok")).alias("uptime"), share(F.col("has_canonical")).alias("canonical"),
        share(F.col("has_jsonld")).alias("jsonld"), share(F.size("missing_langs") == 0).alias("hreflang"))
    counts = pages.groupBy(*keys, "latency_ms").agg(F.count("*").alias("_c"))
    ranked = look_up(ordered_sums(counts, keys, ["latency_ms"], {"_upto": F.col("_c")}), agg.select(*keys, "pages"), keys, F.col("latency_ms"))
    p95 = ranked.where(F.col("_upto") > F.floor(F.col("pages") * 0.95)).groupBy(*keys).agg(F.min("latency_ms").alias("p95_latency"))
    out = agg.join(p95, keys)
    latency = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - F.greatest(F.lit(0.0), F.col("p95_latency") - 800.0) / 14.0))
    return out.withColumn("reliability", 0.72 * F.col("uptime") + 0.28 * latency).withColumn(
        "seo", 0.45 * F.col("uptime") + 0.20 * F.col("canonical") + 0.20 * F.col("jsonld") + 0.15 * F.col("hreflang"))


def content_quality(docs: DataFrame, keys: Sequence[str], anchor: str, locales: int = 4) -> DataFrame:
    """Share of texts with the headings and the anchor entity, locale coverage, weighted total; needs text, lang."""
    has = lambda p: F.avg(F.col("text").rlike(p).cast("int"))
    first = F.regexp_extract("text", r"^([^\n]*)", 1)
    q = docs.groupBy(*keys).agg(
        F.count("*").alias("rows"), (100.0 * F.avg(F.col("text").contains(anchor).cast("int"))).alias("entity"),
        (100.0 * has(r"(?i)(^|\n)#{1,6}\s*(Evidence|證據)\s*\n")).alias("evidence"), (100.0 * has(r"(?i)(^|\n)#{1,6}\s*(Risk Boundary|風險邊界)\s*\n")).alias("risk"),
        F.least(F.lit(100.0), 100.0 * F.count_distinct("lang") / float(locales)).alias("locale"),
        (100.0 * F.avg(first.contains(anchor).cast("int"))).alias("anchor_first"),
    )
    return q.withColumn("quality", 0.35 * F.col("entity") + 0.30 * F.col("evidence") + 0.25 * F.col("risk") + 0.10 * F.col("locale"))
