"""Market anomalies: detection, ids, lifecycle, evidence; freshness checks; wallets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import clip
from barloom.operators.bars import bucket_start
from barloom.operators.series import BLOCK_ROWS, by_blocks
from barloom.sources.lake import last_bars, upsert

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO)


def range_pct() -> Column:
    """High to low in percent of the open; 0 without a positive open."""
    return F.when(F.col("open") > 0, F.greatest(F.lit(0.0), (F.col("high") - F.col("low")) / F.col("open") * 100.0)).otherwise(0.0)


def last_closed_range(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Range of the last closed bar: the second newest, or the only one."""
    two = last_bars(bars, 2, tuple(keys))
    row = F.struct("ts", range_pct().alias("range_pct"))
    return two.groupBy(*keys).agg(F.min(row).alias("r")).select(*keys, "r.ts", "r.range_pct")


def interest_drops(series: DataFrame, value: str, keys: Sequence[str] = ("symbol",), samples: int = 24, rows: int = BLOCK_ROWS) -> DataFrame:
    """Drop since the sample before and from the peak of the last `samples`, in percent; needs `pos`."""

    def build(df: DataFrame, w) -> DataFrame:
        prev, peak = F.lag(value).over(w), F.max(value).over(w.rowsBetween(-(samples - 1), 0))
        drop = lambda top: F.when((top > 0) & (F.col(value) < top), (top - F.col(value)) / top * 100.0).otherwise(0.0)
        return df.select("*", drop(prev).alias("step_drop_pct"), drop(peak).alias("drop_from_peak_pct"))

    return by_blocks(series, keys, build, back=samples, rows=rows)


def severity(value: Column, threshold: Column | float) -> Column:
    """Severity from the ratio of a value to its threshold."""
    t = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    ratio = value / t
    return F.when(t <= 0, "medium").when(ratio >= 2.0, "critical").when(ratio >= 1.6, "high").when(ratio >= 1.0, "medium").otherwise("low")


def event_id(symbol: Column, event_type: Column, sev: Column, ts: Column) -> Column:
    """Same id for the same finding within a four-hour bucket."""
    return F.sha2(F.concat_ws("|", symbol, event_type, sev, iso(bucket_start("4h", ts))), 256)


def anomalies(rows: DataFrame, event_type: str, value: str, threshold: float, payload: Sequence[str]) -> DataFrame:
    """Alert rows for values at or over the threshold."""
    hit = rows.where(F.col(value) >= threshold).withColumns({"event_type": F.lit(event_type), "severity": severity(F.col(value), threshold)})
    body = F.to_json(F.struct("symbol", *[F.round(c, 6).alias(c) for c in payload], F.lit(float(threshold)).alias("threshold_pct")))
    return hit.select(
        event_id(F.col("symbol"), F.col("event_type"), F.col("severity"), F.col("ts")).alias("event_id"), "ts", "symbol", "event_type", "severity",
        body.alias("payload"), F.lit("new").alias("status"),
    )


def liquidations(orders: DataFrame) -> DataFrame:
    """Forced orders (symbol, ts, side, qty, price, ref) as rows with a value and a content id."""
    side = F.upper(F.trim("side"))
    known = F.when(side.isin("BUY", "SELL", "LONG", "SHORT"), side).otherwise("UNKNOWN")
    usd = F.abs(F.col("qty") * F.col("price"))
    rows = orders.select("symbol", "ts", known.alias("side"), usd.alias("usd"), F.coalesce(F.col("ref").cast("string"), F.lit("")).alias("ref")).where("usd > 0")
    hash_id = F.sha2(F.concat_ws("|", "symbol", iso(F.col("ts")), "side", F.col("usd").cast("decimal(38,6)").cast("string"), "ref"), 256)
    return rows.select(hash_id.alias("hash_id"), "ts", "symbol", "side", F.round("usd", 6).alias("usd_value")).dropDuplicates(["hash_id"])


def pending(alerts: DataFrame, limit: int = 20) -> DataFrame:
    """The next alerts to work on: new, not low, oldest first. `limit` is the batch size of the job."""
    return alerts.where((F.col("status") == "new") & (F.col("severity") != "low")).orderBy("ts", "event_id").limit(limit)


def mark_processed(alerts: DataFrame, done: DataFrame) -> DataFrame:
    """New alert table with the given ids set to processed."""
    changed = alerts.join(done.select("event_id").distinct(), "event_id", "left_semi").withColumn("status", F.lit("processed"))
    return upsert(alerts, changed, ["event_id"], "ts")


# --- evidence ---------------------------------------------------------------------------------
# The weights below are part of the published measures.

METRICS = ("volatility", "open_interest", "orderflow", "structure_shift", "rsi_momentum")


def _clamp(c: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return clip(c, lo, hi)


def payload_fields(alerts: DataFrame) -> DataFrame:
    """Numbers of the payload, 0 where absent (threshold 5)."""
    p = F.from_json("payload", "range_pct double, threshold_pct double, step_drop_pct double, drop_from_peak_pct double")
    a = alerts.withColumn("_p", p)
    zero = F.lit(0.0)
    return a.select(
        *alerts.columns,
        *[F.greatest(zero, F.coalesce(f"_p.{c}", zero)).alias(c) for c in ("range_pct", "step_drop_pct", "drop_from_peak_pct")],
        F.greatest(F.lit(1e-6), F.coalesce("_p.threshold_pct", F.lit(5.0))).alias("threshold_pct"),
    )


def hard_metrics(rows: DataFrame) -> DataFrame:
    """Volatility ratio, distance to the threshold, open-interest stress, bias and pulse."""
    drop = F.greatest("step_drop_pct", "drop_from_peak_pct")
    volz, delta = F.col("range_pct") / F.col("threshold_pct"), F.col("range_pct") - F.col("threshold_pct")
    stress = drop / F.greatest(F.col("threshold_pct"), F.lit(1.0))
    s = F.lower("severity")
    by_severity = F.when(s == "critical", 1.0).when(s == "high", 0.72).when(s == "medium", 0.46).when(s == "low", 0.24).otherwise(0.36)
    t = F.lower("event_type")
    by_type = F.when(t == "price_range_spike_4h", 0.18).when(t == "open_interest_drop", 0.28).otherwise(0.12)
    bias = _clamp((volz * 0.55 + stress * 0.35 + by_severity + by_type) * 20.0)
    out = rows.withColumn("_bias", bias)
    pulse = F.when(F.col("_bias") >= 78, "extreme").when(F.col("_bias") >= 58, "elevated").when(F.col("_bias") >= 35, "moderate").otherwise("contained")
    return out.select(
        *rows.columns, F.round(volz, 4).alias("vol_z"), F.round(delta, 4).alias("delta"), F.round(stress, 4).alias("oi_stress"), F.round(drop, 4).alias("oi_drop"),
        F.round("_bias", 2).alias("bias"), pulse.alias("pulse"),
    )


def evidence(rows: DataFrame) -> DataFrame:
    """Order-flow proxy, depth imbalance, regime pressure, confidence and verdict."""
    z, d, o = F.col("vol_z"), F.col("delta"), F.col("oi_stress")
    out = rows.withColumns(
        {
            "_flow": _clamp(28.0 * o + 2.4 * F.abs(d) + 8.5 * z), "_depth": _clamp(50.0 + 34.0 * F.tanh(0.75 * d + 0.55 * o)),
            "_pressure": _clamp(18.0 * z + 14.0 * o),
        }
    )
    out = out.withColumn("_conf", _clamp(0.56 * F.col("bias") + 0.28 * F.col("_pressure") + 0.16 * F.col("_flow"), 5.0, 99.0))
    c = F.col("_conf")
    verdict = F.when(c >= 74, "structural_stress_expansion").when(c >= 52, "liquidity_friction_persistent").otherwise("rebalancing_watch")
    posture = F.when(c >= 74, "defensive").when(c >= 52, "defensive_to_balanced").otherwise("balanced")
    return out.select(
        *rows.columns, F.round("_flow", 2).alias("orderflow"), F.round("_depth", 2).alias("depth"), F.round("_pressure", 2).alias("pressure"),
        F.round("_conf", 2).alias("confidence"), verdict.alias("verdict"), posture.alias("posture"),
    )


def narrative(rows: DataFrame) -> DataFrame:
    """Normalised weights of five themes (rounding drift on the first) and the three leaders."""
    z, d, o, drop = (F.abs(c) for c in ("vol_z", "delta", "oi_stress", "oi_drop"))
    bias, pressure, flow, depth, conf = (F.col(c) for c in ("bias", "pressure", "orderflow", "depth", "confidence"))
    rsi = _clamp(50.0 + 5.4 * d - 2.1 * z)
    raw = {
        "volatility": 28.0 * z + 0.72 * pressure + 0.18 * conf,
        "open_interest": 30.0 * o + 2.1 * drop + 0.42 * pressure,
        "orderflow": 0.62 * flow + 0.38 * depth,
        "structure_shift": 30.0 * d + 1.3 * F.abs(bias - 50.0) + 0.48 * pressure,
        "rsi_momentum": 1.36 * F.abs(rsi - 50.0) + 16.0 * d + 0.26 * conf,
    }
    out = rows.select("*", *[F.greatest(F.lit(0.0), c).alias(f"_s_{k}") for k, c in raw.items()])
    total = sum((F.col(f"_s_{k}") for k in METRICS[1:]), F.col(f"_s_{METRICS[0]}"))
    out = out.withColumn("_total", total)
    w = {k: F.when(F.col("_total") > 0, F.round(F.col(f"_s_{k}") / F.col("_total"), 4)).otherwise(0.2) for k in METRICS}
    out = out.select("*", *[c.alias(f"_w_{k}") for k, c in w.items()])
    rest = sum((F.col(f"_w_{k}") for k in METRICS[1:]), F.lit(0.0))
    out = out.withColumn(f"_w_{METRICS[0]}", F.round(1.0 - rest, 4))
    items = F.array(*[F.struct((-F.col(f"_w_{k}")).alias("w"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(METRICS)])
    lead = F.slice(F.array_sort(items), 1, 3)
    return out.select(
        *rows.columns, *[F.col(f"_w_{k}").alias(f"w_{k}") for k in METRICS], F.transform(lead, lambda s: s["k"]).alias("leaders"), (-lead[0]["w"]).alias("top_weight"))


def scorecard(rows: DataFrame) -> DataFrame:
    """Five criteria, their weighted score and a letter grade."""
    z, d, o, drop = (F.abs(c) for c in ("vol_z", "delta", "oi_stress", "oi_drop"))
    parts = [
        (0.24, _clamp(58.0 + 6.1 * z + 4.8 * d)),
        (0.22, _clamp(52.0 + 0.52 * F.col("pressure") + 0.56 * F.abs(F.col("bias") - 50.0))),
        (0.18, _clamp(46.0 + 24.0 * o + 0.9 * drop)),
        (0.16, _clamp(45.0 + 0.55 * F.col("orderflow"))),
        (0.20, _clamp(60.0 + 0.22 * F.col("confidence") + 24.0 * F.col("top_weight"))),
    ]
    total = sum((w * c for w, c in parts[1:]), parts[0][0] * parts[0][1])
    out = rows.withColumn("_t", total)
    t = F.col("_t")
    letter = F.when(t >= 90, "A+").when(t >= 82, "A").when(t >= 74, "B").when(t >= 66, "C").otherwise("D")
    return out.select(*rows.columns, F.round("_t", 2).alias("final_score"), letter.alias("letter"))


# --- freshness, wallets, conversion -----------------------------------------------------------


def staleness(rows: DataFrame, keys: Sequence[str], now: Column, max_age_hours: float, event_type: str = "stale_feed") -> DataFrame:
    """Age of the newest row per key, and an hourly alert id where it is too old."""
    age = rows.groupBy(*keys).agg(F.max("ts").alias("latest_ts"))
    lag = (F.unix_micros(now) - F.unix_micros("latest_ts")) / 3_600_000_000.0
    out = age.withColumn("lag_hours", lag).withColumn("stale", F.col("lag_hours") > max_age_hours)
    ident = F.sha2(F.concat_ws("|", F.lit(event_type), *keys, F.date_format(now, "yyyyMMddHH")), 256)
    return out.withColumn("event_id", F.when(F.col("stale"), ident))


def wallet_tier(usd: Column, native: Column) -> Column:
    """Tier by portfolio value, or by native balance where no value is known."""
    names = ("Kraken", "Whale", "Dolphin", "Fish")

    def ladder(c: Column, steps: Sequence[float]) -> Column:
        out = F.lit("Plankton")
        for name, level in reversed(list(zip(names, steps))):
            out = F.when(c >= level, name).otherwise(out)
        return out

    return F.when(usd.isNotNull(), ladder(usd, (1e6, 1e5, 1e4, 1e3))).otherwise(ladder(native, (500, 50, 5, 0.5)))


def latest_unprofiled(logs: DataFrame, wallet: str, since: Column, profile_path: str = "$.profile") -> DataFrame:
    """Newest log per wallet since a time, only where that log carries no profile yet."""
    recent = logs.where(F.col("ts") >= since)
    rest = [c for c in logs.columns if c != wallet]
    newest = recent.groupBy(wallet).agg(F.max_by(F.struct(*rest), F.struct("ts", "log_id")).alias("_r"))
    out = newest.select(wallet, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return out.where(F.get_json_object("payload", profile_path).isNull())


def top_assets(holdings: DataFrame, wallet: str, n: int = 5) -> DataFrame:
    """The `n` most valuable assets of each wallet; value falls back to amount x price."""
    value = F.coalesce("usd_value", F.col("amount") * F.col("price"))
    h = holdings.withColumn("_v", value)
    w = Window.partitionBy(wallet).orderBy(F.desc(F.coalesce("_v", F.lit(0.0))), "asset")
    return h.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select(wallet, "place", "asset", "amount", F.col("_v").alias("value"))


def conversion_score(invoices: DataFrame, paid: Column, keys: Sequence[str]) -> DataFrame:
    """Payment success with a small bonus for volume."""
    c = invoices.groupBy(*keys).agg(F.count("*").alias("initiated"), F.count_if(paid).alias("paid"))
    rate = 100.0 * F.col("paid") / F.col("initiated")
    bonus = F.least(F.lit(10.0), F.log2(F.greatest(F.lit(1), F.col("initiated"))) * 2.0)
    return c.withColumn("success_rate", rate).withColumn("score", _clamp(rate * 0.92 + bonus))


# Names of the best-known assets.
ASSET_NAMES = {
    "BTC": "Bitcoin", "ETH": "Ethereum", "BNB": "Binance Coin", "XRP": "Ripple", "SOL": "Solana", "ADA": "Cardano", "DOGE": "Dogecoin", "TRX": "TRON",
    "LTC": "Litecoin", "LINK": "Chainlink",
}


def market_symbol(raw: Column) -> Column:
    """Letters of a market name in capitals, quoted in USDT; BTCUSDT where none are left."""
    letters = F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), "[^A-Z]", "")
    return F.when(letters == "", "BTCUSDT").when(letters.endswith("USDT"), letters).otherwise(F.concat(letters, F.lit("USDT")))


def asset_identity(events: DataFrame, raw: str, text: str) -> DataFrame:
    """events plus market, ticker, name, display_name and pair.

    The market comes from the column `raw`, where that is empty from a ticker before USDT in `text`.
    """
    named = F.trim(F.coalesce(raw, F.lit("")))
    seen = F.regexp_extract(F.upper(F.coalesce(text, F.lit(""))), r"\b([A-Z]{2,10})USDT\b", 0)
    out = events.withColumn("market", market_symbol(F.when(named != "", named).otherwise(seen)))
    bare = F.replace("market", F.lit("USDT"), F.lit(""))
    out = out.withColumn("ticker", F.when(bare == "", "BTC").otherwise(bare))
    known = F.create_map(*[F.lit(x) for pair in ASSET_NAMES.items() for x in pair])
    out = out.withColumn("name", F.coalesce(F.when(F.col("market") == F.concat("ticker", F.lit("USDT")), known[F.col("ticker")]), F.initcap("ticker")))
    return out.withColumn("display_name", F.concat("name", F.lit(" ("), "ticker", F.lit(")"))).withColumn("pair", F.concat("ticker", F.lit("/USDT")))
