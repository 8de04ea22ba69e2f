"""Alerts, universe picks, text and page quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import query
from barloom.catalog.common import BARS_1H, event_bars_sql, hourly, r, show
from barloom.operators import universe as U
from barloom.plans import alerts as A
from barloom.plans import textq as X
from barloom.sources import artifacts
from barloom.sources.tables import event_bars, table

LIMIT = 3000.0
BARS_4H = event_bars_sql("4 hours")
RANGE = "CASE WHEN open > 0 THEN greatest(0, (high - low) / open * 100) ELSE 0 END"


def sev_sql(v: str, t: float) -> str:
    return f"CASE WHEN {v} / {t} >= 2 THEN 'critical' WHEN {v} / {t} >= 1.6 THEN 'high' WHEN {v} / {t} >= 1 THEN 'medium' ELSE 'low' END"


@query("last_closed_range", f"""WITH {BARS_4H}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars)
SELECT symbol, ts, {r(RANGE, 'range_pct')} FROM x WHERE rn = 2""")
def last_closed_range(spark, sf):
    return show(A.last_closed_range(event_bars(spark, sf, "4h")), ["symbol", "ts"], ["range_pct"])


_DROP = "CASE WHEN {t} > 0 AND close < {t} THEN ({t} - close) / {t} * 100 ELSE 0 END"


@query("interest_drops", f"""WITH {BARS_1H}, x AS (SELECT symbol, ts, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p, max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS m FROM bars)
SELECT symbol, ts, {r(_DROP.format(t='p'), 'step_drop_pct')}, {r(_DROP.format(t='m'), 'drop_from_peak_pct')} FROM x""")
def interest_drops(spark, sf):
    return show(A.interest_drops(hourly(spark, sf), "close"), ["symbol", "ts"], ["step_drop_pct", "drop_from_peak_pct"])


ALERTS_SQL = f"""{BARS_4H}, rg AS (SELECT symbol, ts, {RANGE} AS range_pct FROM bars), al AS (SELECT symbol, ts, range_pct, 'price_range_spike_4h' AS event_type, {sev_sql('range_pct', LIMIT)} AS severity FROM rg WHERE range_pct >= {LIMIT}),
an AS (SELECT *, sha256(symbol || '|' || event_type || '|' || severity || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS event_id FROM al)"""


def range_alerts_of(spark, sf):
    rows = event_bars(spark, sf, "4h").withColumn("range_pct", A.range_pct())
    return A.anomalies(rows, "price_range_spike_4h", "range_pct", LIMIT, ["range_pct"])


@query("range_alerts", f"WITH {ALERTS_SQL} SELECT event_id, symbol, ts, event_type, severity, 'new' AS status FROM an")
def range_alerts(spark, sf):
    return range_alerts_of(spark, sf).drop("payload")


@query("pending_alerts", f"WITH {ALERTS_SQL} SELECT event_id, symbol, ts, severity FROM an WHERE severity <> 'low' ORDER BY ts, event_id LIMIT 20")
def pending_alerts(spark, sf):
    return A.pending(range_alerts_of(spark, sf)).select("event_id", "symbol", "ts", "severity")


@query("processed_alerts", f"""WITH {ALERTS_SQL} SELECT event_id, symbol, severity, CASE WHEN event_id IN (SELECT event_id FROM an WHERE severity <> 'low' ORDER BY ts, event_id LIMIT 20) THEN 'processed' ELSE 'new' END AS status FROM an""")
def processed_alerts(spark, sf):
    al = range_alerts_of(spark, sf)
    return A.mark_processed(al, A.pending(al)).select("event_id", "symbol", "severity", "status")


@query("liquidations", f"""WITH o AS (SELECT event_type AS symbol, ts, CASE WHEN user_id % 3 = 0 THEN 'BUY' WHEN user_id % 3 = 1 THEN 'SELL' ELSE 'UNKNOWN' END AS side, abs(value * CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS usd, event_id FROM events)
SELECT sha256(concat_ws('|', symbol, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ'), side, CAST(CAST(round(usd, 6) AS DECIMAL(38,6)) AS VARCHAR), event_id::VARCHAR)) AS hash_id, symbol, side, {r('usd', 'usd_value')} FROM o WHERE usd > 0""")
def liquidations(spark, sf):
    e = table(spark, sf, "events")
    side = F.when(F.col("user_id") % 3 == 0, " buy").when(F.col("user_id") % 3 == 1, "SELL").otherwise("x")
    k = F.get_json_object("props", "$.k").cast("double")
    orders = e.select(F.col("event_type").alias("symbol"), "ts", side.alias("side"), F.col("value").alias("price"), k.alias("qty"), F.col("event_id").alias("ref"))
    return A.liquidations(orders).drop("ts")


_BIAS = "least(100, greatest(0, (range_pct / thr * 0.55 + drp / greatest(thr, 1) * 0.35 + CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.72 WHEN 'medium' THEN 0.46 ELSE 0.24 END + 0.18) * 20))"
EVIDENCE_SQL = f"""{ALERTS_SQL}, h0 AS (SELECT *, {LIMIT}::DOUBLE AS thr, 0::DOUBLE AS drp FROM (SELECT * REPLACE (round(range_pct, 6) AS range_pct) FROM an)),
h1 AS (SELECT *, round(range_pct / thr, 4) AS vol_z, round(range_pct - thr, 4) AS delta, round(drp / greatest(thr, 1), 4) AS oi_stress, round({_BIAS}, 2)::DOUBLE AS bias,
 CASE WHEN {_BIAS} >= 78 THEN 'extreme' WHEN {_BIAS} >= 58 THEN 'elevated' WHEN {_BIAS} >= 35 THEN 'moderate' ELSE 'contained' END AS pulse FROM h0),
h2 AS (SELECT *, least(100, greatest(0, 28 * oi_stress + 2.4 * abs(delta) + 8.5 * vol_z)) AS fl, least(100, greatest(0, 50 + 34 * tanh(0.75 * delta + 0.55 * oi_stress))) AS dp, least(100, greatest(0, 18 * vol_z + 14 * oi_stress)) AS pr FROM h1),
h3 AS (SELECT *, least(99, greatest(5, 0.56 * bias + 0.28 * pr + 0.16 * fl)) AS cf FROM h2),
ev AS (SELECT *, round(fl, 2) AS orderflow, round(dp, 2) AS depth, round(pr, 2) AS pressure, round(cf, 2) AS confidence, CASE WHEN cf >= 74 THEN 'structural_stress_expansion' WHEN cf >= 52 THEN 'liquidity_friction_persistent' ELSE 'rebalancing_watch' END AS verdict FROM h3)"""


def evidence_of(spark, sf):
    return A.evidence(A.hard_metrics(A.payload_fields(range_alerts_of(spark, sf))))


@query("hard_metrics", f"WITH {EVIDENCE_SQL} SELECT event_id, {r('vol_z', 'vol_z', 4)}, {r('delta', 'delta', 4)}, {r('bias', 'bias', 2)}, pulse FROM ev")
def hard_metrics(spark, sf):
    return evidence_of(spark, sf).select("event_id", "vol_z", "delta", "bias", "pulse")


@query("evidence_pack", f"WITH {EVIDENCE_SQL} SELECT event_id, {r('orderflow', 'orderflow', 2)}, {r('depth', 'depth', 2)}, {r('pressure', 'pressure', 2)}, {r('confidence', 'confidence', 2)}, verdict FROM ev")
def evidence_pack(spark, sf):
    return evidence_of(spark, sf).select("event_id", "orderflow", "depth", "pressure", "confidence", "verdict")


CARD_SQL = f"""{EVIDENCE_SQL}, n0 AS (SELECT *, 28 * vol_z + 0.72 * pressure + 0.18 * confidence AS a, 0.42 * pressure AS b, 0.62 * orderflow + 0.38 * depth AS c, 30 * abs(delta) + 1.3 * abs(bias - 50) + 0.48 * pressure AS d,
 1.36 * abs(least(100, greatest(0, 50 + 5.4 * abs(delta) - 2.1 * vol_z)) - 50) + 16 * abs(delta) + 0.26 * confidence AS e FROM ev),
n1 AS (SELECT *, round(b / (a + b + c + d + e), 4) AS wb, round(c / (a + b + c + d + e), 4) AS wc, round(d / (a + b + c + d + e), 4) AS wd, round(e / (a + b + c + d + e), 4) AS we FROM n0),
n2 AS (SELECT *, round(1 - (wb + wc + wd + we), 4) AS wa FROM n1), n3 AS (SELECT *, greatest(wa, wb, wc, wd, we) AS tw FROM n2),
sk AS (SELECT *, 0.24 * least(100, 58 + 6.1 * vol_z + 4.8 * abs(delta)) + 0.22 * least(100, 52 + 0.52 * pressure + 0.56 * abs(bias - 50)) + 0.18 * 46 + 0.16 * least(100, 45 + 0.55 * orderflow) + 0.2 * least(100, 60 + 0.22 * confidence + 24 * tw) AS t FROM n3)"""


@query("narrative_weights", f"WITH {CARD_SQL} SELECT event_id, {r('wa', 'w_volatility', 4)}, {r('wb', 'w_open_interest', 4)}, {r('wc', 'w_orderflow', 4)}, {r('wd', 'w_structure_shift', 4)}, {r('we', 'w_rsi_momentum', 4)}, {r('tw', 'top_weight', 4)} FROM sk")
def narrative_weights(spark, sf):
    return A.narrative(evidence_of(spark, sf)).select("event_id", *[f"w_{m}" for m in A.METRICS], "top_weight")


@query("scorecard", f"WITH {CARD_SQL} SELECT event_id, {r('t', 'final_score', 2)}, CASE WHEN t >= 90 THEN 'A+' WHEN t >= 82 THEN 'A' WHEN t >= 74 THEN 'B' WHEN t >= 66 THEN 'C' ELSE 'D' END AS letter FROM sk")
def scorecard(spark, sf):
    return A.scorecard(A.narrative(evidence_of(spark, sf))).select("event_id", "final_score", "letter")


@query("staleness", f"""WITH x AS (SELECT user_id, max(ts) AS latest_ts FROM events GROUP BY 1)
SELECT user_id, latest_ts, {r("epoch_us(TIMESTAMP '2024-01-31 00:00:00' - latest_ts) / 3600000000.0::DOUBLE", 'lag_hours')}, TIMESTAMP '2024-01-31 00:00:00' - latest_ts > INTERVAL 12 HOUR AS stale,
 CASE WHEN TIMESTAMP '2024-01-31 00:00:00' - latest_ts > INTERVAL 12 HOUR THEN sha256('stale_feed|' || user_id || '|2024013100') END AS event_id FROM x""")
def staleness(spark, sf):
    out = A.staleness(table(spark, sf, "events"), ["user_id"], F.lit("2024-01-31 00:00:00").cast("timestamp"), 12.0)
    return show(out, ["user_id", "latest_ts", "stale", "event_id"], ["lag_hours"])


@query("wallet_tiers", """SELECT c_custkey AS wallet, CASE WHEN usd IS NOT NULL THEN CASE WHEN usd >= 1000000 THEN 'Kraken' WHEN usd >= 100000 THEN 'Whale' WHEN usd >= 10000 THEN 'Dolphin' WHEN usd >= 1000 THEN 'Fish' ELSE 'Plankton' END
 ELSE CASE WHEN c_acctbal >= 500 THEN 'Kraken' WHEN c_acctbal >= 50 THEN 'Whale' WHEN c_acctbal >= 5 THEN 'Dolphin' WHEN c_acctbal >= 0.5 THEN 'Fish' ELSE 'Plankton' END END AS tier
FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS usd FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey""")
def wallet_tiers(spark, sf):
    usd = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("usd"))
    c = table(spark, sf, "customer").join(usd, "c_custkey", "left")
    return c.select(F.col("c_custkey").alias("wallet"), A.wallet_tier(F.col("usd"), F.col("c_acctbal")).alias("tier"))


@query("unprofiled_wallets", """WITH x AS (SELECT user_id AS wallet, arg_max(event_id, (ts, event_id)) AS log_id, arg_max(props, (ts, event_id)) AS payload FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT wallet, log_id FROM x WHERE json_extract_string(payload, '$.profile') IS NULL""")
def unprofiled_wallets(spark, sf):
    logs = table(spark, sf, "events").select(F.col("user_id").alias("wallet"), "ts", F.col("event_id").alias("log_id"), F.col("props").alias("payload"))
    return A.latest_unprofiled(logs, "wallet", F.lit("2024-01-20").cast("timestamp")).select("wallet", "log_id")


@query("top_assets", f"""WITH h AS (SELECT o_custkey AS wallet, l_partkey AS asset, sum(l_quantity) AS amount, sum(l_extendedprice) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
x AS (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY v DESC, asset)::INT AS place FROM h) SELECT wallet, place, asset, {r('amount', 'amount', 2)}, {r('v', 'value', 2)} FROM x WHERE place <= 5""")
def top_assets(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    h = li.groupBy(F.col("o_custkey").alias("wallet"), F.col("l_partkey").alias("asset")).agg(
        F.sum("l_quantity").alias("amount"), F.sum("l_extendedprice").alias("usd_value"), F.lit(None).cast("double").alias("price"))
    return show(A.top_assets(h, "wallet"), ["wallet", "place", "asset"], ["amount", "value"], 2)


@query("conversion_score", f"""WITH c AS (SELECT o_orderpriority AS source, count(*) AS initiated, count(*) FILTER (o_orderstatus = 'F') AS paid FROM orders GROUP BY 1)
SELECT source, initiated, paid, {r('100.0 * paid / initiated', 'success_rate', 4)}, {r('least(100, greatest(0, 100.0 * paid / initiated * 0.92 + least(10, log2(initiated) * 2)))', 'score', 4)} FROM c""")
def conversion_score(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "source")
    return show(A.conversion_score(o, F.col("o_orderstatus") == "F", ["source"]), ["source", "initiated", "paid"], ["success_rate", "score"], 4)


# --- universe ---------------------------------------------------------------------------------


@query("tradable_pairs", """SELECT upper(split_part(p_name, ' ', 2)) AS base, arg_max('P' || p_partkey, p_partkey) AS symbol FROM part WHERE p_size > 5 AND p_brand <> 'Brand#1' AND p_type = 'ECONOMY' GROUP BY 1""")
def tradable_pairs(spark, sf):
    p = table(spark, sf, "part")
    info = p.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("base"), F.concat(F.lit("p"), F.col("p_partkey")).alias("symbol"), F.when(F.col("p_brand") != "Brand#1", "TRADING").otherwise("HALT").alias("status"),
                    (F.col("p_size") > 5).alias("spot"), F.col("p_type").alias("quote"), F.col("p_partkey").alias("listing"))
    return U.tradable(info, "ECONOMY")


def coins(spark, sf):
    li = table(spark, sf, "lineitem")
    v = li.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("quote_volume"), F.to_date(F.min("l_shipdate")).alias("first_seen_date"))
    p = table(spark, sf, "part").select("p_partkey", F.upper(F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_partkey"))).alias("base"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("market_cap"))
    return v.join(p, F.col("l_partkey") == F.col("p_partkey")).select("base", F.concat(F.lit("P"), F.col("p_partkey")).alias("symbol"), "name", "market_cap", "quote_volume", "first_seen_date")


COINS_SQL = "coins AS (SELECT upper(split_part(p_name, ' ', 2) || p_partkey) AS base, 'P' || p_partkey AS symbol, p_name AS name, p_retailprice AS market_cap, sum(l_extendedprice) AS quote_volume, CAST(min(l_shipdate) AS DATE) AS first_seen_date FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


@query("top_by_volume", f"""WITH {COINS_SQL}, x AS (SELECT *, row_number() OVER (ORDER BY quote_volume DESC, base) AS rank FROM coins)
SELECT base, symbol, {r('quote_volume', 'quote_volume', 2)}, rank FROM x WHERE NOT starts_with(base, 'W') AND quote_volume > 0 AND first_seen_date <= DATE '1995-02-15' ORDER BY rank LIMIT 50""")
def top_by_volume(spark, sf):
    return show(U.top_by_volume(coins(spark, sf), 50, F.lit("1995-02-15").cast("date")), ["base", "symbol", "rank"], ["quote_volume"], 2)


@query("top_by_market_cap", f"""WITH {COINS_SQL}, b AS (SELECT regexp_replace(base, '[0-9]+$', '') AS base, arg_max(symbol, (market_cap, symbol)) AS symbol, max(market_cap) AS market_cap FROM coins GROUP BY 1)
SELECT base, symbol, {r('market_cap', 'market_cap', 2)}, row_number() OVER (ORDER BY market_cap DESC, base) AS rank FROM b WHERE NOT starts_with(base, 'W') ORDER BY rank LIMIT 10""")
def top_by_market_cap(spark, sf):
    c = coins(spark, sf).withColumn("base", F.regexp_replace("base", "[0-9]+$", ""))
    return show(U.top_by_market_cap(c, 10), ["base", "symbol", "rank"], ["market_cap"], 2)


@query("explicit_universe", f"""WITH {COINS_SQL}, a AS (SELECT unnest(['P7', 'P3', 'P9', 'XYZECONOMY']) AS symbol, unnest([1, 2, 3, 4]) AS rank)
SELECT a.symbol, coalesce(base, regexp_replace(a.symbol, 'ECONOMY$', '')) AS base, rank FROM a LEFT JOIN coins ON coins.symbol = a.symbol""")
def explicit_universe(spark, sf):
    return U.explicit_list(coins(spark, sf), ["P7", "p3", "P7", "P9", "XYZECONOMY"], "ECONOMY")


@query("preferred_symbols", "SELECT symbol FROM (SELECT DISTINCT event_type AS symbol FROM events) ORDER BY CASE symbol WHEN 'view' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END, symbol LIMIT 3")
def preferred_symbols(spark, sf):
    return U.preferred_order(table(spark, sf, "events").select(F.col("event_type").alias("symbol")), ["view", "signup"], 3)


@query("excluded_assets", """WITH x AS (SELECT DISTINCT upper(w) AS base FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM documents) WHERE length(w) BETWEEN 3 AND 8)
SELECT left(base, 1) AS initial, count(*) AS assets, count(*) FILTER ((starts_with(base, 'W') AND base NOT IN ('WAVES', 'WOO', 'WIN')) OR ends_with(base, 'WRAP') OR regexp_matches(base, '(UP|DOWN|BULL|BEAR)$') OR base IN ('USDT', 'DAI', 'FRAX', 'STETH')) AS excluded,
 count(*) FILTER ((starts_with(base, 'W') AND base NOT IN ('WAVES', 'WOO', 'WIN')) OR ends_with(base, 'WRAP') OR regexp_matches(base, 'USD|DAI|FRAX|LUSD') OR base = 'STETH' OR regexp_matches(lower(base), 'stable|usd|dollar')) AS strict FROM x GROUP BY 1""")
def excluded_assets(spark, sf):
    """The exclusion predicates over all words of the documents."""
    words = table(spark, sf, "documents").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("w")).where(F.length("w").between(3, 8)).select(F.upper("w").alias("base")).distinct()
    return words.groupBy(F.left("base", F.lit(1)).alias("initial")).agg(
        F.count("*").alias("assets"), F.count_if(U.is_excluded(F.col("base"))).alias("excluded"), F.count_if(U.is_strict_stable(F.col("base"), F.col("base"))).alias("strict"))


_RAW = "CASE event_id % 8 WHEN 0 THEN ' btc/usdt ' WHEN 1 THEN 'Eth' WHEN 2 THEN '' WHEN 3 THEN 'SOL-USDT' WHEN 4 THEN 'doge' WHEN 5 THEN '123' WHEN 6 THEN 'usdt' END"
_SAID = "concat(event_type, CASE event_id % 3 WHEN 0 THEN ' ltcusdt fell' WHEN 1 THEN ' xUSDTx' ELSE ' of ADAUSDT' END)"
_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.ASSET_NAMES.items())


@query("asset_identity", rf"""WITH a AS (SELECT event_id, trim(coalesce({_RAW}, '')) AS raw, regexp_extract(upper({_SAID}), '\b([A-Z]{{2,10}})USDT\b') AS seen FROM events),
b AS (SELECT event_id, regexp_replace(upper(CASE WHEN raw <> '' THEN raw ELSE seen END), '[^A-Z]', '', 'g') AS l FROM a),
c AS (SELECT event_id, CASE WHEN l = '' THEN 'BTCUSDT' WHEN ends_with(l, 'USDT') THEN l ELSE l || 'USDT' END AS market FROM b),
d AS (SELECT *, coalesce(nullif(replace(market, 'USDT', ''), ''), 'BTC') AS ticker FROM c),
e AS (SELECT *, coalesce(CASE WHEN market = ticker || 'USDT' THEN CASE ticker {_NAMES} END END, upper(left(ticker, 1)) || lower(substr(ticker, 2))) AS name FROM d)
SELECT event_id, market, ticker, name, name || ' (' || ticker || ')' AS display_name, ticker || '/USDT' AS pair FROM e""")
def asset_identity(spark, sf):
    """Market of every event, from a raw name or else from its text (both set from event_id)."""
    e = table(spark, sf, "events").select("event_id", F.expr(_RAW).alias("raw"), F.expr(_SAID).alias("said"))
    return A.asset_identity(e, "raw", "said").select("event_id", "market", "ticker", "name", "display_name", "pair")


# --- text and pages ---------------------------------------------------------------------------


# Word boundaries of all scripts for an engine that knows only those of ASCII: every character that
# is no letter, digit or underscore stands between marks, and so do both ends of the text.
_MARKED = [
    r"\x01[a-f0-9]{24,}\x01", None, r"\x01(?:event(?:_|\x01[\s-]\x01)?id|uuid|hash)\x01",
    r"\x01(?:payload|權限策略|參考識別|authority\x01 \x01record)\x01", r"\x01Conclusion\x01 \x01Event\x01",
]


def _scrub_sql(t: str) -> str:
    for p in _MARKED:
        if p is None:
            t = f"regexp_replace({t}, '(?i)/analysis/[a-z0-9_-]+', '', 'g')"
        else:
            t = rf"replace(regexp_replace(chr(1) || regexp_replace({t}, '([^\pL\pN\pM_])', chr(1) || '\1' || chr(1), 'g') || chr(1), '(?i){p}', '', 'g'), chr(1), '')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace(regexp_replace({t}, '[ \\t]{{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


# Positive cases of every pattern, set around each document's text.
_LEAKS = "'event-id Uuid hash 權限策略 是權限策略嗎 payload Authority Record éhash conclusion event /Analysis/x-1 ' || text || ' 參考識別'"


@query("text_scrub", f"WITH d AS (SELECT doc_id, {_LEAKS} AS t FROM documents) SELECT doc_id, length({_scrub_sql('t')}) AS kept_chars, md5({_scrub_sql('t')}) AS digest FROM d")
def text_scrub(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.scrub(F.expr(_LEAKS)).alias("t"))
    return d.select("doc_id", F.length("t").alias("kept_chars"), F.md5("t").alias("digest"))


@query("text_slug", r"""WITH s AS (SELECT doc_id, left(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 120) AS slug FROM documents)
SELECT doc_id, CASE WHEN length(slug) > 0 THEN slug ELSE 'report' END AS slug FROM s""")
def text_slug(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.slug(F.col("text")).alias("slug"))


def _replace_sql(t: str) -> str:
    for w in X.ALLOWED_LATIN:
        t = f"replace({t}, '{w}', ' ')"
    return t


@query("latin_words", f"SELECT doc_id, len(regexp_extract_all({_replace_sql('text')}, '[A-Za-z]{{3,}}')) AS latin FROM documents")
def latin_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.latin_words(F.col("text")).alias("latin"))


_HTML = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g')"
TERMS = ["error", "page", "copyright", "the"]


@query("page_text", f"""WITH t AS (SELECT page_id, {_HTML} AS t FROM pages) SELECT page_id, length(t) AS chars, md5(t) AS digest, regexp_matches(t, '{X.HASH_LEAK}') AS hash_leak,
 concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(t, '(?i)" + chr(92) + "b" + w + chr(92) + "b') THEN '" + w + "' END" for w in TERMS)}) AS hits FROM t""")
def page_text(spark, sf):
    t = table(spark, sf, "pages").select("page_id", X.html_text(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").alias("chars"), F.md5("t").alias("digest"), F.col("t").rlike(X.HASH_LEAK).alias("hash_leak"), F.array_join(X.term_hits(F.col("t"), TERMS), ",").alias("hits"))


_MARK = f"""regexp_matches(html, '{X.JSONLD}') AS has_jsonld, regexp_matches(html, '{X.CANONICAL.replace("'", "''")}') AS has_canonical, len(regexp_extract_all(html, '{X.HREFLANG.replace("'", "''")}', 1)) AS links"""


@query("page_markers", f"SELECT page_id, has_jsonld, has_canonical, CASE WHEN links = 0 THEN 'en,zh-tw' END AS missing FROM (SELECT page_id, {_MARK} FROM pages)")
def page_markers(spark, sf):
    m = X.page_markers(table(spark, sf, "pages"))
    return m.select("page_id", "has_jsonld", "has_canonical", F.array_join("missing_langs", ",").alias("missing"))


# every fifth page gets its language links, every seventh only one of them
_LINKED = """replace(html, '</title>', '</title>' || CASE WHEN page_id % 5 = 0 THEN '<link rel="alternate" hreflang="en" href="/a"><link rel="alternate" hreflang="zh-TW" href="/b">' WHEN page_id % 7 = 0 THEN '<link rel="alternate" hreflang="en" href="/a">' ELSE '' END)"""


@query("surface_score", f"""WITH q AS (SELECT url, {_LINKED} AS html FROM pages), p AS (SELECT regexp_extract(url, '^(https?)', 1) AS scheme, length(html) AS lat, contains(html, '</html>') AS ok, {_MARK},
 contains(lower(html), 'hreflang="en"') AND contains(lower(html), 'hreflang="zh-tw"') AS langs FROM q),
a AS (SELECT scheme, count(*) AS pages, 100.0 * avg(ok::INT) AS uptime, 100.0 * avg(has_canonical::INT) AS canonical, 100.0 * avg(has_jsonld::INT) AS jsonld, 100.0 * avg(langs::INT) AS hreflang FROM p GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY lat) - 1 AS i FROM p),
l AS (SELECT k.scheme, min(lat) AS p95 FROM k JOIN a USING (scheme) WHERE i >= floor(pages * 0.95::DOUBLE) GROUP BY 1)
SELECT scheme, pages, {r('uptime', 'uptime')}, {r('hreflang', 'hreflang')}, p95 AS p95_latency, {r('0.72 * uptime + 0.28 * greatest(0, least(100, 100 - greatest(0, p95 - 800) / 14.0))', 'reliability')}, {r('0.45 * uptime + 0.2 * canonical + 0.2 * jsonld + 0.15 * hreflang', 'seo')} FROM a JOIN l USING (scheme)""")
def surface_score(spark, sf):
    """Page length stands for latency, a closed document for a page that answers; some pages have language links."""
    pages = table(spark, sf, "pages").select("url", F.expr(_LINKED).alias("html"))
    p = X.page_markers(pages).select(
        F.regexp_extract("url", "^(https?)", 1).alias("scheme"), F.length("html").alias("latency_ms"), F.col("html").contains("</html>").alias("ok"), "has_canonical", "has_jsonld", "missing_langs")
    return show(X.surface_score(p, ["scheme"]), ["scheme", "pages", "p95_latency"], ["uptime", "hreflang", "reliability", "seo"])


# headings in front of some texts: the given ones have none
_HEADED = "CASE WHEN doc_id % 3 = 0 THEN concat('## Evidence ', chr(10)) ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN concat('the', chr(10), '### risk boundary', chr(10)) ELSE '#### Riskless' END || coalesce(text, '')"
_HEADING = lambda words: f"100.0 * avg(regexp_matches(t, '(?i)(^|\\n)#{{1,6}}\\s*({words})\\s*\\n')::INT)"


@query("content_quality", f"""WITH d AS (SELECT source, lang, {_HEADED} AS t FROM documents),
a AS (SELECT source, count(*) AS rows, 100.0 * avg(contains(t, 'the')::INT) AS entity, 100.0 * avg(contains(regexp_extract(t, '^([^\\n]*)', 1), 'the')::INT) AS anchor_first,
 {_HEADING('Evidence|證據')} AS evidence, {_HEADING('Risk Boundary|風險邊界')} AS risk, least(100, 100.0 * count(DISTINCT lang) / 4) AS locale FROM d GROUP BY 1)
SELECT source, rows, {', '.join(r(c, c) for c in ('entity', 'anchor_first', 'evidence', 'risk', 'locale'))}, {r('0.35 * entity + 0.3 * evidence + 0.25 * risk + 0.1 * locale', 'quality')} FROM a""")
def content_quality(spark, sf):
    docs = table(spark, sf, "documents").select("source", "lang", F.expr(_HEADED).alias("text"))
    return show(X.content_quality(docs, ["source"], "the"), ["source", "rows"], ["entity", "anchor_first", "evidence", "risk", "locale", "quality"])


@query("event_log_lines", r"""SELECT event_id, event_type AS event, ts FROM events WHERE event_type <> 'error'""")
def event_log_lines(spark, sf):
    """Events written as JSON lines and parsed back; lines without a name or a time drop out."""
    e = table(spark, sf, "events")
    name = F.when(F.col("event_type") != "error", F.col("event_type"))
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), name.alias("event"), F.col("event_id").cast("string").alias("run_id")))
    out = artifacts.parse_event_lines(e.select(line.alias("value")))
    return out.select(F.col("run_id").cast("long").alias("event_id"), "event", "ts")
