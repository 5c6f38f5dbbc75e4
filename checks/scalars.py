"""Sources, projections, filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.functions import scalars as S
from barspark.operators import quality as Q
from barspark.operators import windows as W
from barspark.operators.folds import lead_in
from barspark.operators.metrics import compare_market
from barspark.operators.permute import index_mismatches
from barspark.operators.prices import with_derived_prices, with_price
from barspark.operators.signals import latest, tail
from barspark.operators.sizing import with_stops
from barspark.plans.evaluate import date_slice
from barspark.series import positions, spread_join, windowed
from barspark.sources import bars as B
from barspark.sources import caches as C
from checks import DAILY, FOUR_HOURS, bars1, bars2, bars3, check, frame, keep, r, rounded, sql, table
from checks import W as OVER

OHLCV = "open, high, low, close, volume"


@check("s16_bars_daily", sql(f"SELECT symbol, ts, {OHLCV} FROM b1"))
def s16_bars_daily(spark, sf):
    return bars1(spark, sf)


@check("s16_bars_4h", sql(f"SELECT symbol, ts, {OHLCV} FROM b2"))
def s16_bars_4h(spark, sf):
    return bars2(spark, sf)


@check("s16_bars_many", sql(f"SELECT symbol, ts, {OHLCV} FROM b3"))
def s16_bars_many(spark, sf):
    return bars3(spark, sf)


_STORED = sql(
    f"""SELECT 'spot' AS mode, symbol, '1d' AS tf, ts, {OHLCV}, {r('(high+low+close)/3', 'typical', 3)},
    {r('(high+low)/2', 'median', 3)}, {r('(high+low+close)/3', 'vwap', 3)} FROM b1"""
)


def _stored(spark, sf):
    """Bars written to and read back from a partitioned store in the shared folder."""
    from uuid import uuid4

    from barspark.series import _shared_folder

    root = f"{_shared_folder(spark)}/store-{uuid4().hex}"
    B.write_bars(bars1(spark, sf).withColumns({"mode": F.lit("spot"), "tf": F.lit("1d")}), root)
    return root


@check("s01_read_bars", _STORED)
def s01_read_bars(spark, sf):
    return rounded(B.read_bars(spark, _stored(spark, sf), mode="spot", tf="1d"), 3)


@check(
    "s02_repair_time",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate
       ELSE CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END END AS ts FROM orders""",
)
def s02_repair_time(spark, sf):
    o = table(spark, sf, "orders")
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    raw = o.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 2 == 0, text).otherwise("n/a").alias("timestamp"),
        F.when(F.col("o_orderkey") % 3 != 0, F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("openTime"),
    )
    return B.require_time(B.repair_time(raw))


@check(
    "s03_candles",
    """SELECT o_orderkey, o_orderdate AS ts, o_totalprice AS open, o_totalprice + 1 AS high, o_totalprice - 1 AS low,
       o_totalprice AS close, 1.0::DOUBLE AS volume, o_orderdate + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND AS close_ts FROM orders""",
)
def s03_candles(spark, sf):
    millis = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    text = lambda c: c.cast("string")
    p = F.col("o_totalprice")
    row = F.array(text(millis), text(p), text(p + 1), text(p - 1), text(p), F.lit("1"), text(millis + 86_400_000 - 1))
    pages = table(spark, sf, "orders").select("o_orderkey", F.to_json(F.array(row)).alias("value"))
    return B.candles(pages)


@check(
    "s04_ohlcv_rows",
    f"""SELECT symbol, ts, price, {r('price', 'typical', 3)}, {r('price', 'median', 3)}, {r('price', 'vwap', 3)} FROM (
       SELECT o_orderpriority AS symbol, o_orderdate AS ts, max_by(o_totalprice, o_orderkey) AS price FROM orders
       WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY ALL)""",
)
def s04_ohlcv_rows(spark, sf):
    o = table(spark, sf, "orders")
    millis = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    p = F.col("o_totalprice")
    rows = o.select(
        F.col("o_orderpriority").alias("symbol"), millis.alias("timestamp"), p.alias("high"), p.alias("low"), p.alias("close"), "o_orderkey"
    )
    out = B.ohlcv_rows(rows, DAILY, "1994-01-01", "1996-01-01", seq="o_orderkey")
    return keep(out.withColumn("price", F.col("close")), "symbol", "ts", "price", "typical", "median", "vwap", digits=3, price=12)


@check(
    "s05_upsert_store",
    sql(
        """SELECT symbol, ts, CASE WHEN ts >= TIMESTAMP '1997-06-15' AND ts < TIMESTAMP '1997-09-01' THEN close * 2 ELSE close END AS close FROM b1"""
    ),
)
def s05_upsert_store(spark, sf):
    root = _stored(spark, sf)
    late = date_slice(bars1(spark, sf), DAILY, "1997-06-15", "1997-09-01").withColumn("close", F.col("close") * 2)
    spec = DAILY.extend("mode", "tf")
    B.upsert_into(root, late.withColumns({"mode": F.lit("spot"), "tf": F.lit("1d")}), spec)
    return B.read_bars(spark, root).select("symbol", "ts", "close")


@check(
    "s06_fetch_plan",
    sql(
        """SELECT symbol, last_ts, greatest(TIMESTAMP '1993-01-01', last_ts + INTERVAL 1 DAY) AS fetch_from,
        TIMESTAMP '1998-08-01' AS fetch_to FROM (SELECT symbol, max(ts) AS last_ts FROM b1 WHERE ts < TIMESTAMP '1998-07-31'
        OR symbol <> '5-LOW' GROUP BY symbol) WHERE greatest(TIMESTAMP '1993-01-01', last_ts + INTERVAL 1 DAY) < TIMESTAMP '1998-08-01'
        UNION ALL SELECT '6-NONE', NULL, TIMESTAMP '1993-01-01', TIMESTAMP '1998-08-01'"""
    ),
)
def s06_fetch_plan(spark, sf):
    bars = bars1(spark, sf).filter((F.col("ts") < F.lit("1998-07-31").cast("timestamp_ntz")) | (F.col("symbol") != "5-LOW"))
    names = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol")).distinct()
    asked = names.unionByName(spark.createDataFrame([("6-NONE",)], "symbol string"))
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return Q.fetch_plan(bars, asked, DAILY, at("1993-01-01"), at("1998-08-01"))


_QUALITY_SQL = """q AS (SELECT symbol, min(ts) AS available_from, max(ts) AS available_to, count(*) AS total_bars,
  count(*) FILTER (step > 2 * 86400) AS large_gaps_detected, epoch(max(ts)) - epoch(min(ts)) AS span
  FROM (SELECT symbol, ts, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY symbol ORDER BY ts) AS step FROM b1) GROUP BY symbol),
q2 AS (SELECT symbol, available_from, available_to, total_bars, large_gaps_detected,
  round(coalesce(total_bars / nullif(floor(span / 86400), 0) * 100, 0), 2) AS data_coverage_pct, floor(span / 86400)::BIGINT AS trading_days FROM q)"""


@check("a08_series_quality", sql(_QUALITY_SQL, "SELECT *, 'success' AS status FROM q2"))
def a08_series_quality(spark, sf):
    return Q.series_quality(bars1(spark, sf), DAILY).drop("ohlcv_columns")


@check(
    "a09_outcome_counts",
    "SELECT count(DISTINCT o_orderpriority) + 1 AS total_assets, count(DISTINCT o_orderpriority) AS successful_assets, 1::BIGINT AS failed_assets FROM orders",
)
def a09_outcome_counts(spark, sf):
    return Q.outcome_counts(_requested_quality(spark, sf))


def _requested_quality(spark, sf):
    names = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol")).distinct()
    asked = names.unionByName(spark.createDataFrame([("6-NONE",)], "symbol string"))
    return Q.with_requested(Q.series_quality(bars1(spark, sf), DAILY), asked, DAILY)


_INFO = """i AS (SELECT replace(symbol, '-', '') AS stem, * FROM q2)"""


@check(
    "s07_cache_summary",
    sql(
        _QUALITY_SQL,
        _INFO,
        """SELECT symbol AS asset, concat_ws(chr(10), symbol || ':', '  Status: Success', '  Type: OHLCV Cache',
        '  Available: ' || strftime(available_from, '%Y-%m-%d') || ' to ' || strftime(available_to, '%Y-%m-%d'),
        '  Bars: ' || format('{:,}', total_bars), '  Coverage: ' || printf('%.2f', data_coverage_pct) || '%',
        '  Trading Days: ' || format('{:,}', trading_days), '  Gaps: ' || large_gaps_detected::VARCHAR,
        '  Columns: open, high, low, close, volume', '  Cache File: ohlcv_' || stem || '_1d.parquet') AS value FROM i
        UNION ALL SELECT '6-NONE', concat_ws(chr(10), '6-NONE:', '  Status: no_data', '  Error: No OHLCV data returned')""",
    ),
)
def s07_cache_summary(spark, sf):
    return C.summary_lines(C.asset_info(_requested_quality(spark, sf), F.lit("1d")))


@check(
    "s08_read_cache_info",
    sql(
        _QUALITY_SQL,
        """t AS (SELECT count(*) + 1 AS total_assets, count(*) AS successful_assets, 1::BIGINT AS failed_assets FROM q2),
        a AS (SELECT 'spot' AS mode, symbol AS asset, 'success' AS status, strftime(available_from, '%Y-%m-%d') AS available_from,
        strftime(available_to, '%Y-%m-%d') AS available_to, total_bars, data_coverage_pct, true AS ok FROM q2
        UNION ALL SELECT 'spot', '6-NONE', 'no_data', NULL, NULL, NULL, NULL, false)""",
        "SELECT a.*, t.* FROM a, t UNION ALL SELECT a.* REPLACE ('futures' AS mode), t.* FROM a, t",
    ),
)
def s08_read_cache_info(spark, sf):
    from uuid import uuid4

    from barspark.series import _shared_folder

    info = C.asset_info(_requested_quality(spark, sf), F.lit("1d"))
    document = C.cache_info(info, "1d", "1992-01-01", "1999-01-01", F.current_timestamp())
    path = f"{_shared_folder(spark)}/info-{uuid4().hex}"
    C.write_cache_info(document, path)
    both = C.read_cache_info(spark, path, "spot").unionByName(C.read_cache_info(spark, path, "futures"))
    return both.select(
        "mode", "asset", "status", "available_from", "available_to", "total_bars", "data_coverage_pct", "ok",
        "total_assets", "successful_assets", "failed_assets",
    )


# --- projections ---


@check("p01_median", sql(f"SELECT symbol, ts, {r('(high+low)/2', 'median', 3)} FROM b1"))
def p01_median(spark, sf):
    return keep(with_price(bars1(spark, sf), DAILY, "median"), "symbol", "ts", "median", digits=3)


@check("p02_typical", sql(f"SELECT symbol, ts, {r('(high+low+close)/3', 'typical', 3)} FROM b1"))
def p02_typical(spark, sf):
    return keep(with_price(bars1(spark, sf), DAILY, "typical"), "symbol", "ts", "typical", digits=3)


@check("p03_stored_vwap", sql(f"SELECT symbol, ts, {r('(high+low+close)/3', 'vwap', 3)} FROM b1"))
def p03_stored_vwap(spark, sf):
    return keep(with_derived_prices(bars1(spark, sf)), "symbol", "ts", "vwap", digits=3)


@check(
    "p04_price_resolver",
    sql(
        f"""SELECT symbol, ts, close AS price_close, {r('(high+low)/2', 'price_median', 3)},
        {r(f'sum((high+low+close)/3*volume) OVER {frame(19)} / sum(volume) OVER {frame(19)} / close', 'vwap_ratio')},
        {r(f'sum((high+low+close)/3*volume) OVER {frame(49)} / sum(volume) OVER {frame(49)} / close', 'vwap50_ratio')} FROM b1"""
    ),
)
def p04_price_resolver(spark, sf):
    df = bars1(spark, sf)
    for name in ("close", "median", "vwap", "vwap50"):
        df = with_price(df, DAILY, name)
    out = df.withColumns({"vwap_ratio": F.col("vwap") / F.col("close"), "vwap50_ratio": F.col("vwap50") / F.col("close")})
    out = out.withColumnsRenamed({"close": "price_close", "median": "price_median"})
    return keep(out, "symbol", "ts", "price_close", "price_median", "vwap_ratio", "vwap50_ratio", price_median=3)


@check("p05_log_price", sql(f"SELECT symbol, ts, {r('ln(close)', 'log_price')} FROM b1"))
def p05_log_price(spark, sf):
    return rounded(bars1(spark, sf).select("symbol", "ts", S.log_price("close").alias("log_price")))


_TF = "CASE l_linenumber % 7 WHEN 0 THEN '1m' WHEN 1 THEN '5m' WHEN 2 THEN '15m' WHEN 3 THEN '1h' WHEN 4 THEN '4h' WHEN 5 THEN '1d' ELSE '1w' END"


def _with_tf(spark, sf):
    return table(spark, sf, "lineitem").withColumn("tf", F.expr(_TF))


@check(
    "p06_annualisation",
    f"""SELECT tf, count(*) AS n, {r('sqrt(525600.0 / minutes)', 'factor')} FROM (SELECT {_TF} AS tf FROM lineitem)
    JOIN (VALUES ('1m', 1), ('5m', 5), ('15m', 15), ('1h', 60), ('4h', 240), ('1d', 1440), ('1w', NULL)) t(tf, minutes) USING (tf) GROUP BY tf, minutes""",
)
def p06_annualisation(spark, sf):
    return rounded(_with_tf(spark, sf).groupBy("tf", S.annualisation_factor("tf").alias("factor")).agg(F.count("*").alias("n")))


@check(
    "p07_fee_rate",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {r("((CASE WHEN l_quantity - 25 > 0 THEN l_quantity - 25 WHEN l_returnflag = 'R' THEN 4 ELSE 10 END) + l_tax * 100) / 10000", 'rate', 10)} FROM lineitem""",
)
def p07_fee_rate(spark, sf):
    li = table(spark, sf, "lineitem")
    mode = F.when(F.col("l_returnflag") == "R", "futures").otherwise("spot")
    rate = S.fee_rate_column(F.col("l_quantity") - 25, F.col("l_tax") * 100, mode)
    return rounded(li.select("l_orderkey", "l_linenumber", "l_partkey", rate.alias("rate")), 10)


@check(
    "p08_clip",
    f"""SELECT event_id, {r('greatest(least(value / 50 - 1, 0.5), -0.5)', 'clipped')},
    {r('CASE WHEN value - 50 < 1e-12 THEN 1e-12 ELSE value - 50 END', 'floored')} FROM events""",
)
def p08_clip(spark, sf):
    e = table(spark, sf, "events")
    return rounded(e.select("event_id", S.clip(F.col("value") / 50 - 1, -0.5, 0.5).alias("clipped"), S.floor_at(F.col("value") - 50, 1e-12).alias("floored")))


_DIRTY = "CASE event_id % 4 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN NULL ELSE value END"


def _dirty():
    return F.expr("CASE event_id % 4 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN NULL ELSE value END")


@check(
    "p09_finite_or",
    f"SELECT event_id, CASE WHEN isfinite(x) THEN x END AS cleaned, CASE WHEN isfinite(x) THEN x ELSE 0.0 END AS filled FROM (SELECT event_id, {_DIRTY} AS x FROM events)",
)
def p09_finite_or(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", S.finite_or(_dirty()).alias("cleaned"), S.finite_or(_dirty(), 0.0).alias("filled"))


@check(
    "p10_json_safe",
    f"SELECT event_id, [CASE WHEN isfinite(x) THEN x END, value] AS safe FROM (SELECT event_id, value, {_DIRTY} AS x FROM events)",
)
def p10_json_safe(spark, sf):
    return table(spark, sf, "events").select("event_id", S.json_safe_array(F.array(_dirty(), F.col("value"))).alias("safe"))


_SYMBOL = "CASE o_orderkey % 5 WHEN 0 THEN 'btcusd' WHEN 1 THEN 'BTC-USD' WHEN 2 THEN 'BTC/USD' WHEN 3 THEN 'VETUSDT' ELSE 'ETH/EUR' END"


@check(
    "p11_symbols",
    f"""SELECT symbol, count(*) AS n, CASE symbol WHEN 'btcusd' THEN 'BTC/USDT' WHEN 'BTC-USD' THEN 'BTC/USDT' WHEN 'BTC/USD' THEN 'BTC/USDT'
    WHEN 'VETUSDT' THEN 'VET/USDT' ELSE 'ETH/EUR' END AS exchange, replace(replace(symbol, '/', ''), '-', '') AS file,
    CASE WHEN symbol = 'VETUSDT' THEN 'VETUSD' ELSE symbol END AS asset FROM (SELECT {_SYMBOL} AS symbol FROM orders) GROUP BY symbol""",
)
def p11_symbols(spark, sf):
    o = table(spark, sf, "orders").select(F.expr(_SYMBOL).alias("symbol"))
    named = o.groupBy("symbol").agg(F.count("*").alias("n"))
    return named.select("symbol", "n", S.exchange_symbol("symbol").alias("exchange"), S.file_symbol("symbol").alias("file"), S.asset_of_symbol("symbol").alias("asset"))


@check(
    "p12_intervals",
    f"""SELECT tf, count(*) AS n, minutes, {r('coalesce(minutes / 60.0, 1)', 'hours')}, {r('greatest(1.0, 24.0 / coalesce(minutes / 60.0, 1))', 'per_day')}, minutes IS NOT NULL AS known
    FROM (SELECT {_TF} AS tf FROM lineitem) JOIN (VALUES ('1m', 1), ('5m', 5), ('15m', 15), ('1h', 60), ('4h', 240), ('1d', 1440), ('1w', NULL)) t(tf, minutes) USING (tf) GROUP BY tf, minutes""",
)
def p12_intervals(spark, sf):
    named = _with_tf(spark, sf).groupBy("tf").agg(F.count("*").alias("n"))
    return rounded(
        named.select(
            "tf", "n", S.interval_minutes("tf").alias("minutes"), S.interval_hours("tf").alias("hours"), S.bars_per_day("tf").alias("per_day"), S.is_source_interval("tf").alias("known")
        )
    )


@check(
    "p13_parse_values",
    f"""SELECT o_orderkey, unnest(['bool', 'int', 'float', 'str']) AS kind, unnest(['true', o_orderkey::VARCHAR, o_orderkey::VARCHAR || '.5', o_orderpriority]) AS text,
    unnest([NULL, o_orderkey::DOUBLE, o_orderkey + 0.5, NULL]) AS number FROM orders""",
)
def p13_parse_values(spark, sf):
    raw = F.concat_ws(",", F.lit(" true "), F.col("o_orderkey").cast("string"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".5")), F.lit(""), "o_orderpriority")
    o = table(spark, sf, "orders").select("o_orderkey", F.explode(S.parse_values(raw)).alias("v"))
    return o.select("o_orderkey", "v.kind", "v.text", "v.number")


@check(
    "p15_up_label",
    sql(f"SELECT symbol, ts, coalesce(ln(lead(close) OVER {OVER}) - ln(close) > 0, false)::INT AS label FROM b1"),
)
def p15_up_label(spark, sf):
    out = windowed(bars1(spark, sf), DAILY, {"r": W.forward_log_return("close")})
    return out.select("symbol", "ts", S.up_label("r").alias("label"))


@check(
    "p16_digitise",
    "SELECT event_id, len(list_filter([10.0, 25.0, 50.0, 75.0], lambda e: e <= value))::INT AS class FROM events",
)
def p16_digitise(spark, sf):
    edges = F.array(*[F.lit(x) for x in (10.0, 25.0, 50.0, 75.0)])
    return table(spark, sf, "events").select("event_id", S.digitise("value", edges).alias("class"))


@check("p17_over_half", "SELECT event_id, (value / 100 > 0.5)::INT AS up FROM events")
def p17_over_half(spark, sf):
    return table(spark, sf, "events").select("event_id", S.over_half(F.col("value") / 100).alias("up"))


@check(
    "p18_extreme_preference",
    f"""SELECT event_id, {r('s', 'score')}, CASE WHEN s < -10 THEN -1 WHEN s > 10 THEN 1 ELSE 0 END AS signal FROM (
    SELECT event_id, (value + event_id % 7) - (50 + event_id % 11) AS s FROM events)""",
)
def p18_extreme_preference(spark, sf):
    e = table(spark, sf, "events")
    probabilities = F.array(F.lit(50.0), (F.col("event_id") % 11).cast("double"), F.lit(3.0), F.col("value"), (F.col("event_id") % 7).cast("double"))
    score = S.extreme_preference(probabilities)
    return rounded(e.select("event_id", score.alias("score"), S.threshold_signal(score, F.lit(-10.0), F.lit(10.0)).alias("signal")))


# --- filters ---


@check("f01_date_range", sql("SELECT symbol, ts, close FROM b1 WHERE ts >= TIMESTAMP '1994-03-01' AND ts < TIMESTAMP '1995-03-01'"))
def f01_date_range(spark, sf):
    return date_slice(bars1(spark, sf), DAILY, "1994-03-01", "1995-03-01").select("symbol", "ts", "close")


@check(
    "f02_lead_in",
    sql(
        "c AS (SELECT symbol, greatest(0, count(*) FILTER (ts < TIMESTAMP '1995-01-01') - 60) AS cut FROM p1 GROUP BY symbol)",
        "SELECT symbol, ts, pos - cut AS pos, close FROM p1 JOIN c USING (symbol) WHERE pos >= cut AND ts < TIMESTAMP '1996-01-01'",
    ),
)
def f02_lead_in(spark, sf):
    return lead_in(bars1(spark, sf), DAILY, "1995-01-01", "1996-01-01", 60).select("symbol", "ts", "pos", "close")


@check("f03_year", sql("SELECT symbol, ts, close FROM b1 WHERE year(ts) >= 1994 AND year(ts) < 1996"))
def f03_year(spark, sf):
    return bars1(spark, sf).filter((F.year("ts") >= 1994) & (F.year("ts") < 1996)).select("symbol", "ts", "close")


@check("f04_dropna", sql(f"SELECT symbol, ts, {r('r', 'r')} FROM (SELECT symbol, ts, ln(lead(close) OVER {OVER}) - ln(close) AS r FROM b1) WHERE r IS NOT NULL"))
def f04_dropna(spark, sf):
    out = windowed(bars1(spark, sf), DAILY, {"r": W.forward_log_return("close")})
    return keep(out.dropna(subset=["r"]), "symbol", "ts", "r")


@check("f05_finalised", sql("SELECT symbol, ts FROM b1 WHERE ts + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND <= TIMESTAMP '1997-01-01'"))
def f05_finalised(spark, sf):
    b = bars1(spark, sf).withColumn("close_ts", F.expr("ts + INTERVAL 1 DAY - INTERVAL 0.001 SECOND"))
    return B.finalised(b, F.lit("1997-01-01").cast("timestamp_ntz")).select("symbol", "ts")


@check("f07_time_split", sql("SELECT symbol, ts, pos < floor(n * 0.7) AS train FROM p1"))
def f07_time_split(spark, sf):
    from barspark.operators.features import time_split

    return time_split(bars1(spark, sf), DAILY, 0.7).select("symbol", "ts", "train")


@check("f08_min_sample", "SELECT l_suppkey AS symbol, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 600")
def f08_min_sample(spark, sf):
    from barspark.operators.features import enough_rows

    li = table(spark, sf, "lineitem").withColumn("symbol", F.col("l_suppkey"))
    return enough_rows(li, DAILY, 600)


# --- joins, order, sets ---


@check("j02_external_stops", sql("SELECT a.symbol, a.ts, a.close, b.low / 1000000 AS stop_loss_pct FROM b1 a LEFT JOIN b1 b ON a.ts = b.ts AND a.symbol = b.symbol AND b.volume > 1"))
def j02_external_stops(spark, sf):
    bars = bars1(spark, sf)
    stops = bars.filter("volume > 1").select("symbol", "ts", (F.col("low") / 1_000_000).alias("stop_loss_pct"))
    return with_stops(bars, stops, DAILY).select("symbol", "ts", "close", "stop_loss_pct")


@check("j04_index_mismatch", sql("SELECT ts, count(DISTINCT symbol) AS present, 5::BIGINT AS markets FROM b1 GROUP BY ts HAVING count(DISTINCT symbol) <> (SELECT count(DISTINCT symbol) FROM b1)"))
def j04_index_mismatch(spark, sf):
    return index_mismatches(bars1(spark, sf), "ts")


@check("j08_stat_broadcast", f"SELECT event_id, {r('(value - m) / s', 'z')} FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1) USING (event_type)")
def j08_stat_broadcast(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    stats = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    out = spread_join(e, stats, ["event_type"])
    return rounded(out.select("event_id", ((F.col("value") - F.col("m")) / F.col("s")).alias("z")))


@check("k02_latest_bar", sql("SELECT symbol, max(ts) AS ts, max_by(close, ts) AS close, max_by(volume, ts) AS volume FROM b2 GROUP BY symbol"))
def k02_latest_bar(spark, sf):
    return latest(bars2(spark, sf), FOUR_HOURS, "close", "volume")


@check("k02_last_rows", sql("SELECT symbol, ts, close FROM p2 WHERE pos >= n - 10"))
def k02_last_rows(spark, sf):
    return tail(positions(bars2(spark, sf), FOUR_HOURS), FOUR_HOURS, 10).select("symbol", "ts", "close")


@check("k01_sorted", sql("SELECT symbol, ts, close FROM b2 ORDER BY symbol, ts"))
def k01_sorted(spark, sf):
    return bars2(spark, sf).select("symbol", "ts", "close").orderBy("symbol", "ts")


@check(
    "u01_upsert",
    sql(
        """SELECT symbol, ts, CASE WHEN ts >= TIMESTAMP '1998-01-01' THEN close + 1 ELSE close END AS close FROM b1
        UNION ALL SELECT symbol, ts + INTERVAL 4000 DAY, close FROM b1 WHERE ts >= TIMESTAMP '1998-01-01'"""
    ),
)
def u01_upsert(spark, sf):
    bars = bars1(spark, sf).select("symbol", "ts", "close")
    recent = date_slice(bars, DAILY, "1998-01-01", None)
    shifted = recent.withColumn("ts", F.expr("ts + INTERVAL 4000 DAY"))
    new = recent.withColumn("close", F.col("close") + 1).unionByName(shifted)
    return B.upsert(bars, new, DAILY)


@check(
    "j03_compare_market",
    sql(
        f"""x AS (SELECT symbol, ts, unnest(['market', 'strategy']) AS side, unnest([r, r * s]) AS x FROM (
        SELECT symbol, ts, ln(lead(close) OVER {OVER}) - ln(close) AS r, CASE WHEN close > open THEN 1 ELSE 0 END AS s FROM b2) WHERE r IS NOT NULL),
        c AS (SELECT *, sum(x) OVER (PARTITION BY symbol, side ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cum FROM x),
        d AS (SELECT *, cum - max(cum) OVER (PARTITION BY symbol, side ORDER BY ts ROWS UNBOUNDED PRECEDING) AS fall FROM c)""",
        f"""SELECT symbol, side, {r('sum(x)', 'total_return')}, {r('avg(x) / stddev_samp(x)', 'sharpe_ratio')}, {r('stddev_samp(x)', 'volatility')},
        {r('sum(x) FILTER (x > 0) / -sum(x) FILTER (x < 0)', 'profit_factor')}, {r('min(fall)', 'max_drawdown')} FROM d GROUP BY symbol, side""",
    ),
)
def j03_compare_market(spark, sf):
    out = windowed(bars2(spark, sf), FOUR_HOURS, {"r": W.forward_log_return("close")}).dropna(subset=["r"])
    market = out.select("symbol", "ts", "r")
    strategy = out.select("symbol", "ts", (F.col("r") * (F.col("close") > F.col("open")).cast("int")).alias("strategy_r"))
    return rounded(compare_market(market.join(strategy, ["symbol", "ts"]), FOUR_HOURS))
