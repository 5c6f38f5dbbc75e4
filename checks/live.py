"""Event logs, ledgers and live paths."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from barspark.operators import ledger as L
from barspark.operators.signals import ma_long_flat
from barspark.operators.strategies import MovingAverage
from barspark.series import _shared_folder, positions, stage
from barspark.sources import events as V
from barspark.streaming import live as S
from checks import FOUR_HOURS, bars2, check, keep, r, rounded, sql, table
from checks import sqltext as T

# Trade events from orders: six forms by order key, one valid and five broken in a known way.


def _trade_line(**change):
    order = {
        "client_order_id": F.concat(F.lit("c-"), F.col("o_orderkey").cast("string")),
        "side": F.when(F.col("o_orderstatus") == "O", F.lit("BUY")).otherwise(F.lit("SELL")),
        "type": F.lit("MARKET"), "time_in_force": F.lit("IOC"), "quantity": F.lit(2.0), "price": F.col("o_totalprice"),
        "status": F.when(F.col("o_custkey") % 4 == 0, F.lit("NEW")).otherwise(F.lit("FILLED")),
    }
    fields = {
        "event_type": F.lit("FILLED"), "event_id": F.col("o_orderkey").cast("string"),
        "timestamp": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), "strategy_id": F.lit("s"), "run_id": F.lit("run"),
        "exchange": F.lit("X"), "is_paper": F.lit(True), "symbol": F.col("o_orderpriority"), "base_asset": F.lit("B"), "quote_asset": F.lit("Q"),
    }
    fields |= change.pop("fields", {})
    for name in change.pop("drop", []):
        fields.pop(name)
    order |= change.pop("order", {})
    cells = [v.alias(k) for k, v in fields.items()] + [F.struct(*[v.alias(k) for k, v in order.items()]).alias("order")]
    return F.to_json(F.struct(*cells, *[v.alias(k) for k, v in change.items()]))


def _lines(spark, sf):
    form = F.col("o_orderkey") % 6
    good = _trade_line()
    value = (
        F.when(form == 1, _trade_line(drop=["symbol"]))
        .when(form == 2, _trade_line(surprise=F.lit(1)))
        .when(form == 3, _trade_line(fields={"event_type": F.lit("NOPE")}))
        .when(form == 4, F.concat(F.lit("{"), good))
        .when(form == 5, _trade_line(order={"quantity": F.lit("two")}))
        .otherwise(good)
    )
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate", value.alias("value"))


_FORMS = "CASE o_orderkey % 6 WHEN 1 THEN ['missing symbol'] WHEN 2 THEN ['extra surprise'] WHEN 3 THEN ['value event_type'] WHEN 4 THEN ['not json'] WHEN 5 THEN ['type order.quantity'] ELSE []::VARCHAR[] END"


@check("t11_validation", f"SELECT o_orderkey, {_FORMS} AS violations, o_orderkey % 6 = 0 AS valid FROM orders")
def t11_validation(spark, sf):
    return V.validate(_lines(spark, sf), "trade").select("o_orderkey", "violations", "valid")


@check("t11_rejected", "SELECT 'SCHEMA_VALIDATION' AS source, (" + _FORMS + ")[1] AS message, count(*) AS n FROM orders WHERE o_orderkey % 6 > 0 GROUP BY ALL")
def t11_rejected(spark, sf):
    checked = V.validate(_lines(spark, sf), "trade")
    errors = V.parse(V.rejected_as_errors(checked, F.col("o_orderkey").cast("string"), F.lit("2024-01-01T00:00:00")), "error")
    return errors.groupBy("source", "message").agg(F.count("*").alias("n"))


@check("s10_read_events", "SELECT o_orderkey::VARCHAR AS event_id, o_orderpriority AS symbol, o_totalprice AS price FROM orders WHERE o_orderkey % 6 IN (0, 2, 3) UNION ALL SELECT o_orderkey::VARCHAR, NULL, o_totalprice FROM orders WHERE o_orderkey % 6 = 1 UNION ALL SELECT o_orderkey::VARCHAR, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey % 6 = 5")
def s10_read_events(spark, sf):
    return V.parse(_lines(spark, sf).select("value"), "trade").select("event_id", "symbol", "order.price")


def _log(spark, sf):
    root = f"{_shared_folder(spark)}/log-{uuid4().hex}"
    good = V.validate(_lines(spark, sf), "trade").filter("valid")
    V.write_events(good, root, "trade", F.col("o_orderdate"))
    return root


@check("s09_event_log", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, count(*) AS n FROM orders WHERE o_orderkey % 6 = 0 GROUP BY 1")
def s09_event_log(spark, sf):
    return V.read_lines(spark, _log(spark, sf), "trade").groupBy("date").agg(F.count("*").alias("n"))


@check("u02_many_log_files", "SELECT o_orderkey::VARCHAR AS event_id FROM orders WHERE o_orderkey % 6 = 0")
def u02_many_log_files(spark, sf):
    return V.read_events(spark, _log(spark, sf), "trade").select("event_id")


@check(
    "s11_bar_dates",
    "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-05-02' AND o_orderdate < TIMESTAMP '1997-06-02' AND o_orderdate IN (SELECT o_orderdate FROM orders WHERE o_orderpriority = '2-HIGH')",
)
def s11_bar_dates(spark, sf):
    o = table(spark, sf, "orders").withColumn("date", F.date_format("o_orderdate", "yyyy-MM-dd"))
    bars = o.filter("o_orderpriority = '2-HIGH'").select("date")
    today = F.lit("1997-06-01").cast("date")
    return V.with_bar_dates(o, bars, today).select("o_orderkey")


@check("f06_filled_trades", "SELECT o_orderkey::VARCHAR AS event_id FROM orders WHERE o_orderkey % 6 IN (0, 2, 3, 5) AND o_custkey % 4 <> 0 AND o_orderpriority = '5-LOW'")
def f06_filled_trades(spark, sf):
    return V.filled_trades(V.parse(_lines(spark, sf), "trade"), "5-LOW").select("event_id")


@check("k04_sorted_events", "SELECT o_orderkey::VARCHAR AS event_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM orders WHERE o_orderkey % 6 <> 4 ORDER BY 2")
def k04_sorted_events(spark, sf):
    # A sort looks at its rows twice, first for the bounds of its ranges: the lines are parsed once, before.
    return stage(V.parse(_lines(spark, sf), "trade").select("event_id", "timestamp")).orderBy("timestamp")


@check("t14_trade_feed", "SELECT o_orderpriority AS symbol, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS timestamp, CASE WHEN o_orderstatus = 'O' THEN 'BUY' ELSE 'SELL' END AS side, 2.0::DOUBLE AS quantity, o_totalprice AS price FROM orders WHERE o_orderkey % 6 = 0")
def t14_trade_feed(spark, sf):
    good = V.validate(_lines(spark, sf), "trade").filter("valid")
    return V.trade_feed(V.parse(good.select("value"), "trade"))


@check("j09_latest_run", "SELECT upper(event_type) AS symbol, '4h' AS timeframe, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS timestamp, max_by(event_id, (ts, event_id))::VARCHAR AS run_id, 'FUTURES' AS instrument_mode FROM events GROUP BY 1")
def j09_latest_run(spark, sf):
    last = table(spark, sf, "events").groupBy("event_type", F.date_trunc("second", "ts").alias("ts")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    config = F.struct(F.col("event_type").alias("symbol"), F.lit("4h").alias("timeframe"), F.lit("futures").alias("instrument_mode"))
    line = V.build_event(
        "run", event_type=F.lit("RUN_START"), event_id=F.lit("e"), timestamp=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        run_id=F.col("event_id").cast("string"), strategy_id=F.lit("s"), version=F.lit("1"), mode=F.lit("PAPER"), config=config,
    )
    return V.latest_run(V.parse(last.select(line.alias("value")), "run"))


# --- ledger ---

_BASE, _CAP, _FEE = 2.0, 120.0, 0.001
_LEDGER = [
    "sg AS (SELECT *, coalesce(f > s, false) AS target FROM (SELECT *, CASE WHEN pos >= 4 THEN avg(close) OVER (PARTITION BY symbol ORDER BY pos ROWS 4 PRECEDING) END AS f, CASE WHEN pos >= 9 THEN avg(close) OVER (PARTITION BY symbol ORDER BY pos ROWS 9 PRECEDING) END AS s FROM p2))",
    "ac AS (SELECT *, CASE WHEN target AND NOT was THEN 'ENTER' WHEN was AND NOT target THEN 'EXIT' END AS action FROM (SELECT *, coalesce(lag(target) OVER (PARTITION BY symbol ORDER BY pos), false) AS was FROM sg))",
    f"en AS (SELECT *, last_value(CASE WHEN action = 'ENTER' THEN least({_BASE}, {_CAP} / close) END IGNORE NULLS) OVER u AS q, last_value(CASE WHEN action = 'ENTER' THEN close END IGNORE NULLS) OVER u AS ep FROM ac WINDOW u AS (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING))",
    f"fl AS (SELECT *, CASE WHEN action IS NOT NULL THEN q END AS fill_qty, CASE WHEN action IS NOT NULL THEN q * close * {_FEE} ELSE 0 END AS fee, CASE WHEN action = 'EXIT' THEN (close - ep) * q END AS realized FROM en)",
    "cu AS (SELECT *, sum(coalesce(realized, 0)) OVER u AS gross, sum(fee) OVER u AS fees FROM fl WINDOW u AS (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING))",
    "eq AS (SELECT *, 10000 + gross + CASE WHEN target THEN (close - ep) * q ELSE 0 END - fees AS equity FROM cu)",
    "bk AS (SELECT *, greatest(10000, max(equity) OVER (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS peak FROM eq)",
]


def _signals(spark, sf):
    return ma_long_flat(bars2(spark, sf), FOUR_HOURS, fast=5, slow=10)


def _book(spark, sf, **more):
    return L.ledger(_signals(spark, sf), FOUR_HOURS, base_qty=_BASE, max_notional=_CAP, fee_rate=_FEE, **more)


@check("t05_positions", sql(*_LEDGER, "SELECT symbol, ts, action FROM ac WHERE action IS NOT NULL"))
def t05_positions(spark, sf):
    return L.positions_from_signals(_signals(spark, sf), FOUR_HOURS).filter("action IS NOT NULL").select("symbol", "ts", "action")


@check("t06_ledger", sql(*_LEDGER, f"SELECT symbol, ts, action, {r('fill_qty', 'fill_qty')}, {r('fee', 'fee')}, {r('realized', 'realized_pnl')}, {r('gross', 'gross_pnl')}, {r('fees', 'fees_total')} FROM cu"))
def t06_ledger(spark, sf):
    return keep(_book(spark, sf), "symbol", "ts", "action", "fill_qty", "fee", "realized_pnl", "gross_pnl", "fees_total")


@check("t07_equity", sql(*_LEDGER, f"SELECT symbol, ts, {r('equity', 'equity')}, {r('peak', 'peak')}, {r('least(0, equity - peak)', 'drawdown')} FROM bk"))
def t07_equity(spark, sf):
    return keep(_book(spark, sf), "symbol", "ts", "equity", "peak", "drawdown")


_HALT = [
    *_LEDGER,
    "tr AS (SELECT *, coalesce(max((ln)::INT) OVER (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) = 1 AS halted FROM (SELECT *, coalesce(lag(gross - fees) OVER (PARTITION BY symbol ORDER BY pos) <= -20, false) AS ln FROM cu))",
]


@check("t08_loss_limit", sql(*_HALT, f"SELECT symbol, ts, halted, CASE WHEN NOT halted THEN action END AS action, {r('last_value(CASE WHEN NOT halted THEN gross END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING)', 'gross_pnl')} FROM tr"))
def t08_loss_limit(spark, sf):
    return keep(_book(spark, sf, loss_limit=20.0), "symbol", "ts", "halted", "action", "gross_pnl")


@check("t09_snapshots", sql(*_LEDGER, f"SELECT symbol, ts, {r('equity', 'equity')}, {r('CASE WHEN target THEN q ELSE 0 END', 'qty')} FROM bk WHERE pos % 4 = 0"))
def t09_snapshots(spark, sf):
    shots = L.account_snapshots(_book(spark, sf), FOUR_HOURS, "close", 24)
    return rounded(shots.select("symbol", "ts", F.col("account.equity_quote").alias("equity"), F.col("account.positions")[0]["qty"].alias("qty")))


@check("t14_equity_curve", sql(*_LEDGER, f"SELECT symbol, ts, {r('equity', 'equity')} FROM bk"))
def t14_equity_curve(spark, sf):
    shots = L.account_snapshots(_book(spark, sf), FOUR_HOURS, "close", 1)
    line = V.build_event(
        "account", event_type=F.lit("ACCOUNT_SNAPSHOT"), event_id=F.col("symbol"), timestamp=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        strategy_id=F.lit("s"), exchange=F.lit("X"), is_paper=F.lit(True), account=F.col("account"),
    )
    parsed = V.parse(shots.select("symbol", "ts", line.alias("value")), "account")
    return rounded(parsed.select("symbol", "ts", F.col("account.equity_quote").alias("equity")))


@check(
    "a20_run_summary",
    sql(
        *_LEDGER,
        f"SELECT symbol, count(realized) AS trades, {r('count(*) FILTER (realized > 0) / count(realized)', 'win_rate')}, {r('coalesce(sum(realized), 0)', 'gross_pnl_quote')}, {r('-sum(fee)', 'fees_quote')}, {r('coalesce(sum(realized), 0) - sum(fee)', 'net_pnl_quote')}, {r('min(least(0, equity - peak))', 'max_drawdown_quote')} FROM bk GROUP BY symbol",
    ),
)
def a20_run_summary(spark, sf):
    return rounded(L.run_summary(_book(spark, sf), FOUR_HOURS))


def _trade_events(spark, sf):
    """The book's fills as trade event lines."""
    b = _book(spark, sf).filter("action IS NOT NULL")
    fill = F.struct(F.col("close").alias("price"), F.col("fill_qty").alias("qty"), F.col("fee").alias("fee_amount"))
    execution = F.struct(F.col("fill_qty").alias("cumulative_qty"), F.col("close").alias("average_fill_price"), F.array(fill).alias("fills"))
    order = F.struct(F.when(F.col("action") == "ENTER", F.lit("BUY")).otherwise(F.lit("SELL")).alias("side"), F.col("close").alias("price"), F.lit("FILLED").alias("status"))
    pnl = F.struct(F.col("realized_pnl").alias("realized_pnl"), F.col("position_qty").alias("position_qty_after"))
    line = V.build_event(
        "trade", event_type=F.lit("FILLED"), event_id=F.col("pos").cast("string"), timestamp=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        symbol=F.col("symbol"), order=order, execution=execution, pnl=pnl,
    )
    return b.select(line.alias("value"))


@check(
    "a19_event_kpis",
    sql(
        *_LEDGER,
        "lc AS (SELECT symbol, max_by(close, pos) AS lc FROM p2 GROUP BY symbol)",
        "ev AS (SELECT symbol, pos, realized, fee, sum(coalesce(realized, 0) - fee) OVER (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING) AS e FROM cu WHERE action IS NOT NULL)",
        "dd AS (SELECT *, e - greatest(0, max(e) OVER (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS d FROM ev)",
        "op AS (SELECT symbol, max_by(CASE WHEN target THEN (lc - ep) * q ELSE 0 END, pos) AS un FROM cu JOIN lc USING (symbol) GROUP BY symbol)",
        f"""SELECT symbol, count(realized) AS n, {r('count(*) FILTER (realized > 0) / count(realized)', 'win_rate')}, {r('sum(realized)', 'gross')}, {r('sum(fee)', 'fees')}, {r('sum(realized) - sum(fee)', 'net')},
        {r('avg(realized) FILTER (realized > 0)', 'avg_win')}, {r('avg(realized) FILTER (realized < 0)', 'avg_loss')}, {r('sum(realized) FILTER (realized > 0) / -sum(realized) FILTER (realized < 0)', 'profit_factor')},
        {r('any_value(un)', 'unrealized')}, {r('least(0, min(d), max_by(e, pos) + any_value(un) - greatest(0, max(e), max_by(e, pos) + any_value(un)))', 'max_drawdown')} FROM dd JOIN op USING (symbol) GROUP BY symbol""",
    ),
)
def a19_event_kpis(spark, sf):
    trades = V.parse(_trade_events(spark, sf), "trade")
    marks = L.last_mark(bars2(spark, sf), F.col("ts"))
    return keep(L.event_kpis(trades, marks), "symbol", "n", "win_rate", "gross", "fees", "net", "avg_win", "avg_loss", "profit_factor", "unrealized", "max_drawdown")


@check("t12_event_build", sql(*_LEDGER, f"SELECT symbol, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, CASE WHEN action = 'ENTER' THEN 'BUY' ELSE 'SELL' END AS side, {r('fee', 'fee')} FROM cu WHERE action IS NOT NULL"))
def t12_event_build(spark, sf):
    e = V.parse(_trade_events(spark, sf), "trade")
    return rounded(e.select("symbol", "timestamp", "order.side", F.col("execution.fills")[0]["fee_amount"].alias("fee")))


@check("t12_bar_and_signal_lines", sql(*_LEDGER, "SELECT symbol, '4h' AS timeframe, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, close, target::INT::DOUBLE AS value FROM sg"))
def t12_bar_and_signal_lines(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    rows = _signals(spark, sf)
    bar = V.build_event("bar", symbol=F.col("symbol"), timeframe=F.lit("4h"), bar=F.struct("open", "high", "low", "close", "volume", stamp.alias("timestamp")))
    signal = V.build_event("signal", symbol=F.col("symbol"), timeframe=F.lit("4h"), signal=F.struct(stamp.alias("timestamp"), F.col("signal").alias("value")))
    lines = stage(rows.select(bar.alias("bar"), signal.alias("signal")))
    bars = V.symbol_bars(V.parse(lines.select("bar"), "bar", "bar"), tf="4h")
    signals = V.parse(lines.select("signal"), "signal", "signal").select("symbol", "timeframe", "signal.timestamp", "signal.value")
    return bars.select("symbol", "timeframe", "timestamp", "close").join(signals, ["symbol", "timeframe", "timestamp"])


# --- live ---


@check("t04_retrain_schedule", sql("SELECT symbol, ts, ((pos - 60) // 20)::BIGINT AS fit, (pos - 60) % 20 = 0 AS retrains FROM p2 WHERE pos >= 60"))
def t04_retrain_schedule(spark, sf):
    return S.retrain_schedule(bars2(spark, sf), FOUR_HOURS, 60, 20).select("symbol", "ts", "fit", "retrains")


_WALK = [T.averages("av", "p2", "symbol", 12), T.pairs(12), *T.walk("wf", "av", "symbol", 60, 20, 12)]


@check("t03_latest_signals", sql(*_WALK, "SELECT symbol, ts, pos, close, signal::DOUBLE AS signal FROM wf_sig WHERE pos = n - 1"))
def t03_latest_signals(spark, sf):
    return S.latest_signals(bars2(spark, sf), FOUR_HOURS, MovingAverage(max_window=12), 60, 20)


@check("t13_second_timeframe", sql("SELECT symbol, '4h' AS tf, ts, close FROM b2 UNION ALL SELECT event_type, '1d', time_bucket(INTERVAL '1 day', ts), max_by(value, row(ts, event_id)) FROM events GROUP BY ALL"))
def t13_second_timeframe(spark, sf):
    from barspark.sources.bars import bars_from_ticks

    e = table(spark, sf, "events")
    make = lambda every: bars_from_ticks(e, {"symbol": F.col("event_type")}, F.col("ts"), F.col("value"), F.struct("ts", "event_id"), every)
    both = make("4 hours").withColumn("tf", F.lit("4h")).unionByName(make("1 day").withColumn("tf", F.lit("1d")))
    return both.select("symbol", "tf", "ts", "close")


_STREAM_SPEC = FOUR_HOURS.extend("mode", "tf")


def _land(spark, sf, landing):
    """4-hour bars as candle pages, and later files that repeat the first days with other closes."""
    bars = bars2(spark, sf)
    text = lambda c: F.col(c).cast("string")
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    page = lambda close: F.array(millis.cast("string"), text("open"), text("high"), text("low"), close, text("volume"), (millis + 4 * 3_600_000 - 1).cast("string"))
    shape = lambda rows, close: rows.select(F.lit("spot").alias("mode"), "symbol", F.lit("4h").alias("tf"), F.to_json(F.array(page(close))).alias("value"))
    shape(bars, text("close")).write.mode("append").json(landing)
    late = bars.filter(F.col("ts") < F.lit("2024-01-04").cast("timestamp_ntz"))
    shape(late, (F.col("close") + 1).cast("string")).write.mode("append").json(landing)


@check("t01_t02_live_ingest", sql("SELECT symbol, ts, CASE WHEN ts < TIMESTAMP '2024-01-04' THEN close + 1 ELSE close END AS close FROM b2"))
def t01_t02_live_ingest(spark, sf):
    from barspark.sources.bars import read_bars

    base = f"{_shared_folder(spark)}/live-{uuid4().hex}"
    _land(spark, sf, f"{base}/landing")
    stream = S.candle_stream(spark, f"{base}/landing")  # all files in one batch, in whatever order Spark packs them
    S.ingest(stream, f"{base}/store", _STREAM_SPEC, f"{base}/checkpoint").awaitTermination()
    return read_bars(spark, f"{base}/store").select("symbol", "ts", "close")


@check("t05_t10_position_stream", sql(*_LEDGER, f"SELECT symbol, ts, action, {r('fill_qty', 'fill_qty')}, {r('fee', 'fee')}, {r('realized', 'realized_pnl')}, {r('gross', 'gross_pnl')} FROM cu WHERE action IS NOT NULL"))
def t05_t10_position_stream(spark, sf):
    base = f"{_shared_folder(spark)}/fills-{uuid4().hex}"
    rows = stage(_signals(spark, sf).select("symbol", "ts", "close", "signal"))
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    for part in (rows.filter(early), rows.filter(~early)):
        part.write.mode("append").parquet(f"{base}/signals")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/signals")
        made = S.position_stream(stream, "symbol", "ts", "close", "signal", S.Book(_BASE, _CAP, _FEE))
        query = made.writeStream.format("parquet").option("path", f"{base}/fills").option("checkpointLocation", f"{base}/checkpoint")
        query.trigger(availableNow=True).start().awaitTermination()
    return keep(spark.read.parquet(f"{base}/fills"), "symbol", "ts", "action", "fill_qty", "fee", "realized_pnl", "gross_pnl")


def _in_batches(spark, rows, batch, stream, **options):
    """Rows landed batch by batch, each read by a run of the stream that goes on from the last one's checkpoint; what it has written."""
    base = f"{_shared_folder(spark)}/batches-{uuid4().hex}"
    rows = stage(rows.withColumn("batch", batch))
    for number in sorted(r[0] for r in rows.select("batch").distinct().collect()):
        rows.filter(F.col("batch") == number).drop("batch").write.mode("append").parquet(f"{base}/in")
        made = stream(spark.readStream.schema(rows.drop("batch").schema).parquet(f"{base}/in"))
        query = made.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
        query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


#: Bars come in batches of some ten days, every fifth one up to 40 hours late; they wait two days for those before them.
_SHUFFLED = "floor((unix_seconds(cast(ts AS timestamp)) + if(pos % 5 = 0, 144000, 0)) / 921600)"
_WAIT = 2 * 86_400
_TURN = "ts <= (SELECT max(ts) FROM p2 m WHERE m.symbol = {0}.symbol) - INTERVAL 2 DAY"


@check("t03_signal_stream", sql(*_WALK, f"SELECT symbol, ts, pos, close AS price, fold::BIGINT AS fold, signal::DOUBLE AS signal, false AS late FROM wf_sig WHERE pos >= 60 AND {_TURN.format('wf_sig')}"))
def t03_signal_stream(spark, sf):
    rows = positions(bars2(spark, sf), FOUR_HOURS).select("symbol", "ts", "close", "pos")
    return _in_batches(spark, rows, F.expr(_SHUFFLED), lambda s: S.signal_stream(s, FOUR_HOURS, MovingAverage(max_window=12), 60, 20, _WAIT))


@check(
    "t05_t10_shuffled_stream",
    sql(
        *_LEDGER,
        f"SELECT symbol, ts, action, {r('close', 'price')}, {r('gross', 'gross_pnl')}, {r('fees', 'fees_total')} FROM cu WHERE action IS NOT NULL AND {_TURN.format('cu')} "
        "UNION ALL SELECT symbol, ts, 'LATE', round(close, 6) + 0.0, NULL, NULL FROM p2 WHERE pos < 10",
    ),
)
def t05_t10_shuffled_stream(spark, sf):
    """The first ten bars come again in the last batch."""
    rows = positions(_signals(spark, sf), FOUR_HOURS).select("symbol", "ts", "close", "signal", "pos").withColumn("again", F.lit(False))
    rows = rows.unionByName(rows.filter("pos < 10").withColumn("again", F.lit(True)))
    batch = F.when(F.col("again"), F.lit(1 << 40)).otherwise(F.expr(_SHUFFLED))
    made = _in_batches(spark, rows, batch, lambda s: S.position_stream(s, "symbol", "ts", "close", "signal", S.Book(_BASE, _CAP, _FEE), _WAIT))
    return keep(made, "symbol", "ts", "action", "price", "gross_pnl", "fees_total")


@check("t02_corrections_in_any_order", sql("SELECT symbol, ts, CASE WHEN ts < TIMESTAMP '2024-01-04' THEN close + 1 ELSE close END AS close FROM b2"))
def t02_corrections_in_any_order(spark, sf):
    """The corrections are merged first, the pages that they correct in a later batch."""
    from barspark.sources.bars import read_bars, upsert_into

    root = f"{_shared_folder(spark)}/corrected-{uuid4().hex}"
    bars = bars2(spark, sf).withColumns({"mode": F.lit("spot"), "tf": F.lit("4h")})
    late = bars.filter(F.col("ts") < F.lit("2024-01-04").cast("timestamp_ntz")).withColumn("close", F.col("close") + 1)
    upsert_into(root, late.withColumn("page", F.lit("2/late")), _STREAM_SPEC, seq="page")
    upsert_into(root, bars.withColumn("page", F.lit("1/first")), _STREAM_SPEC, seq="page")
    return read_bars(spark, root).select("symbol", "ts", "close")
