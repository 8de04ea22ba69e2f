"""Indicators and rule signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import query
from barloom.catalog.common import BARS_1D, BARS_1H, WINDOW, daily, hourly, r, show
from barloom.operators.series import by_blocks
from barloom.plans import rules as R

KEY = ["symbol", "ts"]


def numbered_sql(bars: str) -> str:
    """Bars with row number and one-bar moves, the start of every recursive indicator."""
    return f"""{bars}, nb AS (SELECT symbol, ts, open, high, low, close, volume, row_number() OVER w AS i,
 close - lag(close) OVER w AS d, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn,
 greatest(abs(high - low), abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
 close / lag(close) OVER w - 1 AS ret FROM bars {WINDOW})"""


def ewm_sql(name: str, src: str, cols: dict[str, tuple[str, str]], start: int = 1) -> str:
    """Recursive EWM table: out column -> (input, alpha); rows before `start` are skipped."""
    first = ", ".join(f"{x} AS {o}" for o, (x, _) in cols.items())
    step = ", ".join(f"(1 - ({a})) * e.{o} + ({a}) * x.{x}" for o, (x, a) in cols.items())
    return f"""{name} AS (SELECT symbol, ts, i, {first} FROM {src} WHERE i = {start}
 UNION ALL SELECT x.symbol, x.ts, x.i, {step} FROM {name} e JOIN {src} x ON x.symbol = e.symbol AND x.i = e.i + 1)"""


def alpha(n: int) -> str:
    return f"1.0::DOUBLE / {n}"


def span(n: int) -> str:
    return f"2.0::DOUBLE / {n + 1}"


def _values(name: str, xs) -> str:
    return f"(SELECT unnest([{', '.join(str(float(x)) + '::DOUBLE' for x in xs)}]) AS {name}) AS t_{name}"


def rsi_sql(windows, src: str = "nb") -> str:
    """CTEs up to `rsi(symbol, ts, i, n, x)`, long over the windows."""
    cols = {}
    for n in windows:
        cols[f"g{n}"] = ("g", alpha(n))
        cols[f"l{n}"] = ("l", alpha(n))
    longs = " UNION ALL ".join(
        f"SELECT symbol, ts, i, {n} AS n, CASE WHEN i >= {n + 1} THEN 100 - 100 / (1 + g{n} / nullif(l{n}, 0)) END AS x FROM rs" for n in windows
    )
    return f"""mv AS (SELECT symbol, ts, i, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM {src}),
{ewm_sql('rs', 'mv', cols, 2)},
rsi AS ({longs} UNION ALL SELECT symbol, ts, 1, n, NULL FROM {src}, (SELECT unnest({list(windows)}) AS n) WHERE i = 1)"""


SUMMARY = """count(*) FILTER (entry) AS entries, count(*) FILTER (exit) AS exits,
 coalesce(sum(i) FILTER (entry), 0)::BIGINT AS entry_sum, coalesce(sum(i) FILTER (exit), 0)::BIGINT AS exit_sum"""


def summary(sig):
    """Per symbol and rule: how many entries and exits, and where (sum of row numbers)."""
    i = F.col("pos") + 1
    return sig.groupBy("symbol", "rule_id").agg(
        F.count_if("entry").alias("entries"), F.count_if("exit").alias("exits"),
        F.coalesce(F.sum(F.when(F.col("entry"), i)), F.lit(0)).alias("entry_sum"),
        F.coalesce(F.sum(F.when(F.col("exit"), i)), F.lit(0)).alias("exit_sum"),
    )


def banded_sql(family: str, revert: str, breakout: str, names: str, src: str) -> str:
    """Signals of the two band rules over `src(symbol, i, x, px, lower, upper, tail)`."""
    return f"""SELECT symbol, i, '{family}:{revert}:' || {names} AS rule_id, coalesce(px >= lower AND x < lower, false) AS entry, coalesce(px <= upper AND x > upper, false) AS exit FROM {src}
 UNION ALL SELECT symbol, i, '{family}:{breakout}:' || {names}, coalesce(px <= upper AND x > upper, false), coalesce(px >= lower AND x < lower, false) FROM {src}"""


G = R.GRIDS
RSI_SQL = f"""WITH RECURSIVE {numbered_sql(BARS_1H)}, {rsi_sql(G['rsi']['rsi_window'])},
p AS (SELECT *, lag(x) OVER (PARTITION BY symbol, n ORDER BY i) AS px FROM rsi),
q AS (SELECT p.*, lower, upper, 'rsi_window=' || n || ':lower=' || lower::BIGINT || ':upper=' || upper::BIGINT AS tail FROM p, {_values('lower', G['rsi']['lower'])}, {_values('upper', G['rsi']['upper'])}),
s AS ({banded_sql('rsi', 'mean_revert', 'breakout', 'tail', 'q')}
 UNION ALL SELECT symbol, i, 'rsi:centerline:' || tail, coalesce(px <= 50 AND x > 50 AND x < upper, false), coalesce(px >= 50 AND x < 50 AND x > lower, false) FROM q)
SELECT symbol, rule_id, {SUMMARY} FROM s GROUP BY 1, 2"""


@query("rsi", f"""WITH RECURSIVE {numbered_sql(BARS_1D)}, {rsi_sql((14, 28))}
SELECT symbol, ts, n AS rsi_window, {r('x', 'rsi')} FROM rsi""")
def rsi(spark, sf):
    def fn(df, w):
        return R._rsi(df, w, ["symbol", "_blk"], [14, 28])

    out = by_blocks(daily(spark, sf), ["symbol"], fn, R.HISTORY["rsi"])
    long = out.select(*KEY, F.explode(F.array(*[F.struct(F.lit(n).alias("rsi_window"), F.col(f"rsi_{n}").alias("rsi")) for n in (14, 28)])).alias("v"))
    return show(long.select(*KEY, "v.*"), [*KEY, "rsi_window"], ["rsi"])


@query("rsi_signals", RSI_SQL)
def rsi_signals(spark, sf):
    return summary(R.indicator_signals(hourly(spark, sf), "rsi"))


def _macd_sql() -> str:
    vs = [(int(f), int(s), int(g)) for f, s, g in R.variants("macd")]
    spans = sorted({n for v in vs for n in v[:2]})
    pairs = sorted({v[:2] for v in vs})
    e = ewm_sql("ee", "nb", {f"e{n}": ("close", span(n)) for n in spans})
    diffs = ", ".join(f"e{f} - e{s} AS m{f}_{s}" for f, s in pairs)
    # the signal mean starts where its MACD line does: at the slow span
    sigs = ", ".join(
        ewm_sql(f"sg{s}", "mm", {f"s{f}_{s}_{g}": (f"m{f}_{s}", span(g)) for f, s2, g in vs if s2 == s}, s) for s in sorted({p[1] for p in pairs})
    )
    longs = " UNION ALL ".join(
        f"""SELECT mm.symbol, mm.i, 'fast_window={f}:slow_window={s}:signal_window={g}' AS tail, CASE WHEN mm.i >= {s} THEN m{f}_{s} END AS m,
 CASE WHEN mm.i >= {s + g - 1} THEN s{f}_{s}_{g} END AS s FROM mm LEFT JOIN sg{s} USING (symbol, i)"""
        for f, s, g in vs
    )
    return f"""WITH RECURSIVE {numbered_sql(BARS_1H)}, {e}, mm AS (SELECT symbol, ts, i, {diffs} FROM ee), {sigs},
a AS ({longs}), b AS (SELECT *, m - s AS h FROM a),
c AS (SELECT *, lag(m) OVER w AS pm, lag(h) OVER w AS ph FROM b WINDOW w AS (PARTITION BY symbol, tail ORDER BY i)),
s AS (SELECT symbol, i, 'macd:momentum_follow:' || tail AS rule_id, coalesce(ph <= 0 AND h > 0 AND m > 0, false) AS entry,
 coalesce(ph >= 0 AND h < 0, false) OR coalesce(m < 0, false) AS exit FROM c
 UNION ALL SELECT symbol, i, 'macd:zero_line_follow:' || tail, coalesce(pm <= 0 AND m > 0 AND s > 0, false), coalesce(pm >= 0 AND m < 0, false) FROM c)
SELECT symbol, rule_id, {SUMMARY} FROM s GROUP BY 1, 2"""


@query("macd_signals", _macd_sql())
def macd_signals(spark, sf):
    return summary(R.indicator_signals(hourly(spark, sf), "macd"))


def ema_rows_sql() -> str:
    """CTEs up to `sig` of the EMA cross rules; needs WITH RECURSIVE."""
    vs = [(int(f), int(s)) for f, s in R.variants("ema_cross")]
    e = ewm_sql("ee", "nb", {f"e{n}": ("close", span(n)) for n in sorted({n for v in vs for n in v})})
    longs = " UNION ALL ".join(f"SELECT symbol, i, 'fast_window={f}:slow_window={s}' AS tail, CASE WHEN i >= {s} THEN e{f} - e{s} END AS x FROM ee" for f, s in vs)
    return f"""{e}, ea AS ({longs}),
ec AS (SELECT *, lag(x) OVER (PARTITION BY symbol, tail ORDER BY i) AS px FROM ea),
sig AS (SELECT ec.symbol, nb.ts, ec.i, nb.close, nb.ret, 'ema_cross:trend_cross:' || tail AS rule_id, coalesce(px <= 0 AND x > 0, false) AS entry, coalesce(px >= 0 AND x < 0, false) AS exit
 FROM ec JOIN nb ON nb.symbol = ec.symbol AND nb.i = ec.i)"""


@query("ema_cross_signals", f"WITH RECURSIVE {numbered_sql(BARS_1H)}, {ema_rows_sql()} SELECT symbol, rule_id, {SUMMARY} FROM sig GROUP BY 1, 2")
def ema_cross_signals(spark, sf):
    return summary(R.indicator_signals(hourly(spark, sf), "ema_cross"))


def bollinger_rows_sql(src: str = "nb", keys: str = "symbol") -> str:
    """CTEs up to `sig(symbol, ts, i, close, ret, rule_id, entry, exit)` of the Bollinger rules."""
    longs = " UNION ALL ".join(
        f"""SELECT symbol, ts, i, close, ret, {n} AS n, CASE WHEN i >= {n} THEN avg(close) OVER f{n} END AS m, CASE WHEN i >= {n} THEN stddev_pop(close) OVER f{n} END AS s
 FROM {src} WINDOW f{n} AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"""
        for n in (14, 20, 30)
    )
    return f"""bb0 AS ({longs}),
bb1 AS (SELECT *, close - (m + k * s) AS o, close - (m - k * s) AS u, close - m AS c, 'window=' || n || ':std_mult=' || (CASE WHEN k = 2 THEN '2' ELSE k::VARCHAR END) AS tail
 FROM bb0, {_values('k', (1.8, 2.0, 2.2))}),
bb2 AS (SELECT *, lag(o) OVER w AS po, lag(u) OVER w AS pu, lag(c) OVER w AS pc FROM bb1 WINDOW w AS (PARTITION BY symbol, tail ORDER BY i)),
sig AS (SELECT symbol, ts, i, close, ret, 'bollinger:bb_breakout:' || tail AS rule_id, coalesce(po <= 0 AND o > 0, false) AS entry, coalesce(pc >= 0 AND c < 0, false) AS exit FROM bb2
 UNION ALL SELECT symbol, ts, i, close, ret, 'bollinger:bb_mean_revert:' || tail, coalesce(pu >= 0 AND u < 0, false), coalesce(pc <= 0 AND c > 0, false) FROM bb2)"""


@query("bollinger_signals", f"""WITH {numbered_sql(BARS_1H)}, {bollinger_rows_sql()}
SELECT symbol, rule_id, {SUMMARY} FROM sig GROUP BY 1, 2""")
def bollinger_signals(spark, sf):
    return summary(R.indicator_signals(hourly(spark, sf), "bollinger"))


def _stoch_sql() -> str:
    longs = " UNION ALL ".join(
        f"""SELECT symbol, i, n, {k} AS k, coalesce(100 * (x - CASE WHEN count(x) OVER f{k} >= {k} THEN min(x) OVER f{k} END)
 / nullif(max(x) OVER f{k} - min(x) OVER f{k}, 0), 50) AS x FROM rsi WINDOW f{k} AS (PARTITION BY symbol, n ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"""
        for k in (14, 21)
    )
    return f"""WITH RECURSIVE {numbered_sql(BARS_1H)}, {rsi_sql((14, 21))}, st AS ({longs}),
p AS (SELECT *, lag(x) OVER (PARTITION BY symbol, n, k ORDER BY i) AS px FROM st),
q AS (SELECT p.*, lower, upper, 'rsi_window=' || n || ':stoch_window=' || k || ':lower=' || lower::BIGINT || ':upper=' || upper::BIGINT AS tail FROM p, {_values('lower', (20, 30))}, {_values('upper', (70, 80))}),
s AS ({banded_sql('stoch_rsi', 'stoch_mean_revert', 'stoch_breakout', 'tail', 'q')})
SELECT symbol, rule_id, {SUMMARY} FROM s GROUP BY 1, 2"""


@query("stoch_rsi_signals", _stoch_sql())
def stoch_rsi_signals(spark, sf):
    return summary(R.indicator_signals(hourly(spark, sf), "stoch_rsi"))


def atr_sql(windows) -> str:
    return ewm_sql("atrs", "nb", {f"a{n}": ("tr", alpha(n)) for n in windows})


@query("atr", f"""WITH RECURSIVE {numbered_sql(BARS_1D)}, {atr_sql((14, 21))}
SELECT symbol, ts, {r('CASE WHEN i >= 14 THEN a14 ELSE 0 END', 'atr_14', 5)}, {r('CASE WHEN i >= 21 THEN a21 ELSE 0 END', 'atr_21', 5)} FROM atrs""")
def atr(spark, sf):
    out = by_blocks(daily(spark, sf), ["symbol"], lambda df, w: R.average_true_range(df, w, ["symbol", "_blk"], [14, 21]), 900)
    return show(out, KEY, ["atr_14", "atr_21"], 5)


def adx_sql(bars: str, ns) -> str:
    """CTEs up to `dix(symbol, ts, i, n, p, q, a)`."""
    first = ewm_sql("dm", "dmi", {**{f"a{n}": ("tr", alpha(n)) for n in ns}, **{f"p{n}": ("pdm", alpha(n)) for n in ns}, **{f"q{n}": ("mdm", alpha(n)) for n in ns}})
    longs = " UNION ALL ".join(
        f"SELECT symbol, ts, i, {n} AS n, CASE WHEN i >= {n} THEN 100 * p{n} / nullif(a{n}, 0) END AS p, CASE WHEN i >= {n} THEN 100 * q{n} / nullif(a{n}, 0) END AS q FROM dm" for n in ns
    )
    second = ", ".join(
        f"dz{n} AS (SELECT symbol, ts, i, 100 * abs(p - q) / nullif(p + q, 0) AS dx FROM di WHERE n = {n}), " + ewm_sql(f"ax{n}", f"dz{n}", {"a": ("dx", alpha(n))}, n) for n in ns
    )
    out = " UNION ALL ".join(
        f"""SELECT di.symbol, di.ts, di.i, {n} AS n, coalesce(p, 0) AS p, coalesce(q, 0) AS q, coalesce(CASE WHEN di.i >= {2 * n - 1} THEN a END, 0) AS a
 FROM di LEFT JOIN ax{n} x ON x.symbol = di.symbol AND x.i = di.i WHERE di.n = {n}""" for n in ns
    )
    return f"""{numbered_sql(bars)}, dmi AS (SELECT symbol, ts, i, tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM nb),
{first}, di AS ({longs}), {second}, dix AS ({out})"""


@query("adx", f"""WITH RECURSIVE {adx_sql(BARS_1D, (14,))}
SELECT symbol, ts, {r('p', 'pdi_14')}, {r('q', 'mdi_14')}, {r('a', 'adx_14')} FROM dix""")
def adx(spark, sf):
    out = by_blocks(daily(spark, sf), ["symbol"], lambda df, w: R.directional_index(df, w, ["symbol", "_blk"], [14]), R.HISTORY["adx"])
    return show(out, KEY, ["pdi_14", "mdi_14", "adx_14"])


@query("adx_signals", f"""WITH RECURSIVE {adx_sql(BARS_1H, (14, 21, 28))},
c AS (SELECT *, p - q AS x, lag(p - q) OVER (PARTITION BY symbol, n ORDER BY i) AS px FROM dix),
s AS (SELECT symbol, i, 'adx:adx_trend:window=' || n || ':threshold=' || t::BIGINT AS rule_id, p > q AND a > t AND coalesce(px <= 0 AND x > 0, false) AS entry,
 q > p OR a < t * 0.8::DOUBLE AS exit FROM c, {_values('t', (18, 22, 28))})
SELECT symbol, rule_id, {SUMMARY} FROM s GROUP BY 1, 2""")
def adx_signals(spark, sf):
    return summary(R.indicator_signals(hourly(spark, sf), "adx"))


def cci_sql(bars: str) -> str:
    longs = " UNION ALL ".join(
        f"""SELECT symbol, ts, i, {n} AS n, coalesce((tp - sma) / (0.015::DOUBLE * nullif(CASE WHEN count(ad) OVER f >= {n} THEN avg(ad) OVER f END, 0)), 0) AS x
 FROM (SELECT *, abs(tp - sma) AS ad FROM (SELECT *, CASE WHEN i >= {n} THEN avg(tp) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS sma FROM tps))
 WINDOW f AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"""
        for n in (20, 30)
    )
    return f"{numbered_sql(bars)}, tps AS (SELECT symbol, ts, i, (high + low + close) / 3 AS tp FROM nb), cci AS ({longs})"


@query("cci", f"""WITH {cci_sql(BARS_1D)} SELECT symbol, ts, n AS cci_window, {r('x', 'cci', 5)} FROM cci""")
def cci(spark, sf):
    out = by_blocks(daily(spark, sf), ["symbol"], lambda df, w: R.commodity_channel(df, w, [20, 30]), 60)
    long = out.select(*KEY, F.explode(F.array(*[F.struct(F.lit(n).alias("cci_window"), F.col(f"cci_{n}").alias("cci")) for n in (20, 30)])).alias("v"))
    return show(long.select(*KEY, "v.*"), [*KEY, "cci_window"], ["cci"], 5)


@query("cci_signals", f"""WITH {cci_sql(BARS_1H)},
p AS (SELECT *, lag(x) OVER (PARTITION BY symbol, n ORDER BY i) AS px FROM cci),
q AS (SELECT p.*, lower, upper, 'window=' || n || ':lower=' || lower::BIGINT || ':upper=' || upper::BIGINT AS tail FROM p, {_values('lower', (-200, -150, -100))}, {_values('upper', (100, 150, 200))}),
s AS ({banded_sql('cci', 'cci_mean_revert', 'cci_breakout', 'tail', 'q')})
SELECT symbol, rule_id, {SUMMARY} FROM s GROUP BY 1, 2""")
def cci_signals(spark, sf):
    return summary(R.indicator_signals(hourly(spark, sf), "cci"))


def _regime_sql() -> str:
    e = ewm_sql("ee", "nb", {**{f"a{n}": ("tr", alpha(n)) for n in (14, 21)}, **{f"e{n}": ("close", span(n)) for n in (50, 100, 150)}, "c": ("close", "1.0::DOUBLE")})
    longs = " UNION ALL ".join(
        f"SELECT symbol, i, 'atr_window={a}:ema_window={m}' AS tail, CASE WHEN i >= {m} THEN c - e{m} END AS x, CASE WHEN i >= {a} THEN a{a} ELSE 0 END / nullif(c, 0) AS ratio FROM ee"
        for a in (14, 21) for m in (50, 100, 150)
    )
    return f"""WITH RECURSIVE {numbered_sql(BARS_1H)}, {e}, a AS ({longs}), c AS (SELECT *, lag(x) OVER (PARTITION BY symbol, tail ORDER BY i) AS px FROM a),
s AS (SELECT symbol, i, 'atr_regime:atr_regime_filter:' || tail || ':atr_floor=' || (CASE WHEN fl > 0.009 THEN '0.01' WHEN fl > 0.005 THEN '0.006' ELSE '0.003' END) AS rule_id,
 coalesce(px <= 0 AND x > 0 AND ratio > fl, false) AS entry, coalesce(px >= 0 AND x < 0, false) OR coalesce(ratio < fl * 0.8::DOUBLE, false) AS exit FROM c, {_values('fl', (0.003, 0.006, 0.01))})
SELECT symbol, rule_id, {SUMMARY} FROM s GROUP BY 1, 2"""


@query("atr_regime_signals", _regime_sql())
def atr_regime_signals(spark, sf):
    return summary(R.indicator_signals(hourly(spark, sf), "atr_regime"))


def _grid_sql() -> str:
    """Counts of every family and core: products of the parameter lists, with lower < upper and fast < slow."""
    arms = []
    for f, grid in R.GRIDS.items():
        keys = ", ".join(f"'{k}'" for k in R.RULE_KEYS[f])
        where = " AND ".join([f'"{a}" < "{b}"' for a, b in R.ORDERED_PAIRS if a in grid and b in grid]) or "true"
        lists = ", ".join(f'(SELECT unnest({[float(v) for v in values]}) AS "{name}")' for name, values in grid.items())
        arms.append(f"SELECT '{f}' AS family, rule_key, count(*) AS n FROM (SELECT unnest([{keys}]) AS rule_key), {lists} WHERE {where} GROUP BY 2")
    for key, c in R.CORE_RULES.items():
        lists = ", ".join(f'(SELECT unnest({[float(v) for v in values]}) AS "{name}")' for name, values in c.grid.items())
        arms.append(f"SELECT '{c.core}', '{key}', count(*) FROM {lists}")
    return " UNION ALL ".join(arms)


@query("rule_grid", f"""WITH s AS (SELECT event_type AS symbol, count(*) AS ticks FROM events GROUP BY 1), g AS ({_grid_sql()})
SELECT symbol, family, rule_key, n AS rules, n * ticks AS rule_ticks FROM s, g""")
def rule_grid(spark, sf):
    """Rules per symbol and family or core, with the number of (rule, tick) pairs a sweep evaluates."""
    from barloom.sources.tables import event_ticks

    rules = [x for f in R.GRIDS for x in R.rule_grid(f)] + R.core_rule_grid()
    ticks = event_ticks(spark, sf).groupBy("symbol").agg(F.count("*").alias("ticks"))
    grid = ticks.withColumn("r", F.explode(R.rules_literal(rules)))
    out = grid.groupBy("symbol", "r.family", "r.rule_key").agg(F.count("*").alias("rules"), F.first("ticks").alias("ticks"))
    return out.select("symbol", "family", "rule_key", "rules", (F.col("rules") * F.col("ticks")).alias("rule_ticks"))
