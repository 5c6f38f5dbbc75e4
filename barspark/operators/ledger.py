"""Paper-trading ledger: long-only positions from signals, fills, PnL, equity.

Everything is a bounded frame or a running scan, also the loss limit: before it
trips the ledger is the unlimited one, and afterwards nothing changes any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.series import POS, Rolling, Running, Series, positions_in_order, running, stage, windowed


def positions_from_signals(df: DataFrame, spec: Series, signal: str = "signal") -> DataFrame:
    """Add ``target`` (signal above 0) and ``action``: ENTER, EXIT or null. Each bar acts at most once."""
    target = F.coalesce(F.col(signal) > 0, F.lit(False))
    before = Rolling(lambda w: F.coalesce(F.lag("target").over(w), F.lit(False)), back=1)
    out = windowed(df.withColumn("target", target), spec, {"__was": before})
    action = F.when(F.col("target") & ~F.col("__was"), F.lit("ENTER")).when(
        ~F.col("target") & F.col("__was"), F.lit("EXIT")
    )
    return out.withColumn("action", action).drop("__was")


def ledger(
    df: DataFrame,
    spec: Series,
    price: str = "close",
    signal: str = "signal",
    base_qty: float = 1.0,
    max_notional: float | None = None,
    fee_rate: float = 0.001,
    start_equity: float = 10_000.0,
    loss_limit: float | None = None,
) -> DataFrame:
    """One row per bar: position, fill, realised and unrealised PnL, fees, equity, peak, drawdown.

    ``loss_limit`` freezes the book, entries and exits alike, from the bar after
    realised PnL minus fees has fallen to the limit.
    """
    p = F.col(price)
    qty = F.lit(float(base_qty))
    if max_notional is not None:
        qty = F.least(qty, F.abs(F.lit(float(max_notional))) / F.greatest(p, F.lit(1e-8)))
    rows = positions_from_signals(df, spec, signal)
    enter, leave = F.col("action") == "ENTER", F.col("action") == "EXIT"
    rows = running(
        rows,
        spec,
        {"__qty": Running("last", F.when(enter, qty)), "entry_price": Running("last", F.when(enter, p))},
    )
    # Each scan reads its input twice (block totals, then rows); staging keeps a chain of scans linear.
    rows = stage(rows)
    fill = F.when(enter | leave, F.col("__qty"))
    rows = rows.withColumns(
        {
            "fill_qty": fill,
            "notional": fill * p,
            "fee": F.coalesce(fill * p * fee_rate, F.lit(0.0)),
            "realized_pnl": F.when(leave, (p - F.col("entry_price")) * F.col("__qty")),
        }
    )
    rows = running(
        rows,
        spec,
        {
            "gross_pnl": Running("sum", F.coalesce("realized_pnl", F.lit(0.0))),
            "fees_total": Running("sum", F.col("fee")),
        },
    )
    if loss_limit is not None:
        rows = _freeze(rows, spec, abs(loss_limit))
    held = F.col("target") if loss_limit is None else F.col("__held")
    rows = rows.withColumns(
        {
            "position_qty": F.when(held, F.col("__qty")).otherwise(F.lit(0.0)),
            "entry_price": F.when(held, F.col("entry_price")),
        }
    )
    unrealized = F.coalesce((p - F.col("entry_price")) * F.col("position_qty"), F.lit(0.0))
    rows = rows.withColumn("unrealized_pnl", unrealized).withColumn(
        "equity", start_equity + F.col("gross_pnl") + F.col("unrealized_pnl") - F.col("fees_total")
    )
    rows = stage(rows)
    live = F.col("equity") if loss_limit is None else F.when(~F.col("halted"), F.col("equity"))
    rows = running(rows, spec, {"peak": Running("max", live)})
    peak = F.greatest(F.coalesce("peak", F.lit(start_equity)), F.lit(start_equity))
    rows = rows.withColumn("peak", peak).withColumn("drawdown", F.least(F.lit(0.0), F.col("equity") - F.col("peak")))
    return rows.drop("__qty", "__held", "target")


def _freeze(rows: DataFrame, spec: Series, limit: float) -> DataFrame:
    """Find the first bar that starts at or below the limit and freeze the book from there."""
    tripped = Rolling(
        lambda w: F.coalesce((F.lag(F.col("gross_pnl") - F.col("fees_total")).over(w) <= -limit).cast("int"), F.lit(0)),
        back=1,
    )
    rows = stage(windowed(stage(rows), spec, {"__trip": tripped}))
    rows = running(rows, spec, {"__halt": Running("max", F.col("__trip"))})
    halted = F.col("__halt") == 1
    rows = stage(rows.withColumn("halted", halted))
    frozen = running(
        rows,
        spec,
        {
            "gross_pnl": Running("last", F.when(~halted, F.col("gross_pnl"))),
            "fees_total": Running("last", F.when(~halted, F.col("fees_total"))),
            "__held": Running("last", F.when(~halted, F.col("target"))),
            "__qty": Running("last", F.when(~halted, F.col("__qty"))),
            "entry_price": Running("last", F.when(~halted, F.col("entry_price"))),
        },
    )
    nothing = {c: F.when(~halted, F.col(c)) for c in ("action", "fill_qty", "notional", "realized_pnl")}
    return frozen.withColumns(nothing).withColumn("fee", F.when(halted, F.lit(0.0)).otherwise(F.col("fee"))).drop(
        "__trip", "__halt"
    )


def run_summary(book: DataFrame, spec: Series) -> DataFrame:
    """What a run reports at its end: closed trades, win rate, gross, fees (negative), net, largest drawdown."""
    n = F.count("realized_pnl")
    wins = F.count_if(F.col("realized_pnl") > 0)
    gross, fees = F.coalesce(F.sum("realized_pnl"), F.lit(0.0)), F.sum("fee")
    return book.groupBy(*spec.keys).agg(
        n.alias("trades"),
        F.try_divide(wins, n).alias("win_rate"),
        gross.alias("gross_pnl_quote"),
        (-fees).alias("fees_quote"),
        (gross - fees).alias("net_pnl_quote"),
        F.min("drawdown").alias("max_drawdown_quote"),
    )


def account_snapshots(book: DataFrame, spec: Series, price: str, bars_per_day: int) -> DataFrame:
    """Account state every max(1, bars per day // 6) bars."""
    every = max(1, bars_per_day // 6)
    shown = book.filter(F.col(POS) % every == 0)
    position = F.struct(
        F.col(spec.keys[0]).alias("symbol"),
        F.col("position_qty").alias("qty"),
        F.coalesce("entry_price", price).alias("entry_price"),
        F.col(price).alias("mark_price"),
        F.col("unrealized_pnl").alias("unrealized_pnl_quote"),
        F.lit("LONG").alias("side"),
    )
    account = F.struct(
        F.col("equity").alias("equity_quote"),
        F.lit(None).cast("double").alias("cash_quote"),
        F.col("unrealized_pnl").alias("unrealized_pnl_quote"),
        F.array(position).alias("positions"),
        F.array().cast("array<struct<asset:string,free:double,locked:double>>").alias("balances"),
    )
    return shown.select(*spec.by(spec.ts, POS), account.alias("account"))


def event_kpis(trades: DataFrame, marks: DataFrame, start_equity: float = 10_000.0) -> DataFrame:
    """Key figures per symbol from filled trade events, in event order, marked at the last close.

    The order of a symbol's fills is (timestamp, event_id) as text, so an unreadable
    time keeps its place and any number of fills may share one. Equity moves by realised
    PnL less fees per event, then once by the open position's mark.
    """
    filled = trades.filter(F.col("order.status") == "FILLED")
    paid = F.aggregate("execution.fills", F.lit(0.0), lambda a, f: a + F.coalesce(f["fee_amount"], F.lit(0.0)))
    fees = F.coalesce(paid, F.lit(0.0))
    rows = filled.select(
        "symbol",
        "timestamp",
        "event_id",
        fees.alias("fee"),
        F.col("pnl.realized_pnl").alias("realized"),
        F.when(
            (F.upper("order.side") == "BUY") & (F.col("pnl.position_qty_after") > 0),
            F.struct(
                F.coalesce("execution.average_fill_price", "order.price").alias("price"),
                F.col("pnl.position_qty_after").alias("qty"),
            ),
        ).alias("opened"),
    )
    spec = Series(keys=("symbol",), ts="timestamp", ties=("event_id",))
    ordered = stage(positions_in_order(rows, spec, "timestamp", "event_id"))
    net = F.coalesce("realized", F.lit(0.0)) - F.col("fee")
    curve = stage(running(ordered, spec, {"__cum": Running("sum", net)}))
    curve = stage(running(curve, spec, {"__top": Running("max", F.col("__cum"))}))
    won, lost = F.col("realized") > 0, F.col("realized") < 0
    sum_win, sum_loss = F.sum(F.when(won, F.col("realized"))), F.sum(F.when(lost, F.col("realized")))
    # The entry price is that of the first buy after the last close: later buys do not move it.
    last_close = F.max(F.when(F.col("realized").isNotNull(), F.col(POS)))
    stats = curve.groupBy("symbol").agg(
        F.count("realized").alias("n"),
        F.count_if(won).alias("wins"),
        F.count_if(lost).alias("losses"),
        F.coalesce(F.sum("realized"), F.lit(0.0)).alias("gross"),
        F.sum("fee").alias("fees"),
        sum_win.alias("__sw"),
        sum_loss.alias("__sl"),
        F.max("__cum").alias("__peak"),
        F.max_by("__cum", POS).alias("__end"),
        F.min(F.col("__cum") - F.greatest(F.col("__top"), F.lit(0.0))).alias("__dd"),
        last_close.alias("__closed"),
    )
    openings = curve.filter(F.col("opened").isNotNull()).select("symbol", POS, "opened")
    first_open = (
        openings.join(stats.select("symbol", "__closed"), "symbol")
        .filter(F.col(POS) >= F.coalesce("__closed", F.lit(0)))
        .groupBy("symbol")
        .agg(F.min_by("opened", POS).alias("__open"))
    )
    joined = stats.join(first_open, "symbol", "left").join(marks.select("symbol", "last_close"), "symbol", "left")
    unreal = F.coalesce((F.col("last_close") - F.col("__open.price")) * F.col("__open.qty"), F.lit(0.0))
    p_win = F.try_divide(F.col("wins"), F.col("n"))
    avg_win, avg_loss = F.try_divide(F.col("__sw"), F.col("wins")), F.try_divide(F.col("__sl"), F.col("losses"))
    final = F.col("__end") + unreal
    marked_dd = F.when(F.col("__open").isNotNull(), final - F.greatest(F.col("__peak"), F.lit(0.0), final))
    return joined.select(
        "symbol",
        "n",
        p_win.alias("win_rate"),
        "gross",
        "fees",
        (F.col("gross") - F.col("fees")).alias("net"),
        F.least(F.lit(0.0), F.col("__dd"), marked_dd).alias("max_drawdown"),
        avg_win.alias("avg_win"),
        avg_loss.alias("avg_loss"),
        F.when((F.col("__sw") > 0) & (F.col("__sl") < 0), F.col("__sw") / -F.col("__sl")).alias("profit_factor"),
        (p_win * avg_win + (1 - p_win) * avg_loss).alias("expectancy"),
        unreal.alias("unrealized"),
        (start_equity + final).alias("equity"),
    )


def last_mark(bars: DataFrame, order: Column) -> DataFrame:
    """Last close per symbol."""
    return bars.groupBy("symbol").agg(F.max_by("close", order).alias("last_close"))


