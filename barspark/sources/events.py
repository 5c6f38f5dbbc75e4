"""Event logs: trade, account, run, error, bar and signal events as NDJSON."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _B, _I = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


ORDER = _struct(
    exchange_order_id=_S, client_order_id=_S, side=_S, type=_S, time_in_force=_S, quantity=_D, quote_quantity=_D,
    price=_D, stop_price=_D, status=_S, post_only=_B, reduce_only=_B, leverage=_I,
)
FILL = _struct(fill_id=_S, timestamp=_S, price=_D, qty=_D, quote_qty=_D, fee_asset=_S, fee_amount=_D)
EXECUTION = _struct(
    last_fill_qty=_D, last_fill_price=_D, cumulative_qty=_D, cumulative_quote_qty=_D, average_fill_price=_D,
    slippage=_D, fills=T.ArrayType(FILL),
)
PNL = _struct(unrealized_pnl=_D, realized_pnl=_D, fees_total_quote=_D, position_qty_after=_D, position_side=_S)
POSITION = _struct(symbol=_S, qty=_D, entry_price=_D, mark_price=_D, unrealized_pnl_quote=_D, side=_S)
ACCOUNT = _struct(
    equity_quote=_D, cash_quote=_D, unrealized_pnl_quote=_D, positions=T.ArrayType(POSITION),
    balances=T.ArrayType(_struct(asset=_S, free=_D, locked=_D)),
)
RUN_CONFIG = _struct(symbol=_S, timeframe=_S, dashboard_tf=_S, instrument_mode=_S, fee_bps_used=_D)
RUN_SUMMARY = _struct(
    trades=_I, win_rate=_D, gross_pnl_quote=_D, fees_quote=_D, net_pnl_quote=_D, max_drawdown_quote=_D
)
BAR = _struct(open=_D, high=_D, low=_D, close=_D, volume=_D, timestamp=_S)
SIGNAL = _struct(timestamp=_S, value=_D)
_FREE = T.MapType(_S, _S)

SCHEMAS: dict[str, T.StructType] = {
    "trade": _struct(
        event_type=_S, event_id=_S, timestamp=_S, strategy_id=_S, run_id=_S, exchange=_S, is_paper=_B, symbol=_S,
        base_asset=_S, quote_asset=_S, order=ORDER, execution=EXECUTION, pnl=PNL, latency_ms=_D, error=_FREE, metadata=_FREE,
    ),
    "account": _struct(
        event_type=_S, event_id=_S, timestamp=_S, strategy_id=_S, run_id=_S, exchange=_S, is_paper=_B, account=ACCOUNT,
        risk_limits=_FREE, metadata=_FREE,
    ),
    "run": _struct(
        event_type=_S, event_id=_S, timestamp=_S, run_id=_S, strategy_id=_S, version=_S, mode=_S, config=RUN_CONFIG,
        summary=RUN_SUMMARY,
    ),
    "error": _struct(event_type=_S, event_id=_S, timestamp=_S, severity=_S, source=_S, code=_S, message=_S, context=_FREE),
    "bar": _struct(symbol=_S, timeframe=_S, bar=BAR),
    "signal": _struct(symbol=_S, timeframe=_S, signal=SIGNAL),
}


@dataclass(frozen=True)
class Rules:
    """What a valid event of one kind looks like: types as in JSON; ``?`` allows null."""

    fields: dict[str, str]
    required: tuple[str, ...]
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    nested: dict[str, "Rules"] = field(default_factory=dict)
    open: bool = False


# Required fields, types and enumerations of each event kind.
_ORDER_RULES = Rules(
    fields={
        "exchange_order_id": "string?", "client_order_id": "string", "side": "string", "type": "string",
        "time_in_force": "string", "quantity": "number", "quote_quantity": "number?", "price": "number?",
        "stop_price": "number?", "status": "string", "post_only": "boolean?", "reduce_only": "boolean?", "leverage": "integer?",
    },
    required=("client_order_id", "side", "type", "time_in_force", "quantity", "status"),
    open=True,
)
RULES: dict[str, Rules] = {
    "trade": Rules(
        fields={
            "event_type": "string", "event_id": "string", "timestamp": "string", "strategy_id": "string", "run_id": "string",
            "exchange": "string", "is_paper": "boolean", "symbol": "string", "base_asset": "string", "quote_asset": "string",
            "order": "object", "execution": "object?", "pnl": "object?", "latency_ms": "number?", "error": "object?",
            "metadata": "object?",
        },
        required=("event_type", "event_id", "timestamp", "strategy_id", "exchange", "symbol", "base_asset", "quote_asset", "order"),
        allowed={"event_type": ("ORDER_PLACED", "ORDER_ACK", "PARTIAL_FILL", "FILLED", "CANCELED", "REJECTED")},
        nested={"order": _ORDER_RULES},
    ),
    "account": Rules(
        fields={
            "event_type": "string", "event_id": "string", "timestamp": "string", "strategy_id": "string", "run_id": "string",
            "exchange": "string", "is_paper": "boolean", "account": "object", "risk_limits": "object?", "metadata": "object?",
        },
        required=("event_type", "event_id", "timestamp", "strategy_id", "exchange", "is_paper", "account"),
        allowed={"event_type": ("ACCOUNT_SNAPSHOT",)},
    ),
    "run": Rules(
        fields={
            "event_type": "string", "event_id": "string", "timestamp": "string", "run_id": "string", "strategy_id": "string",
            "version": "string", "mode": "string", "config": "object?", "summary": "object?",
        },
        required=("event_type", "event_id", "timestamp", "run_id", "strategy_id", "version", "mode"),
    ),
    "error": Rules(
        fields={
            "event_type": "string", "event_id": "string", "timestamp": "string", "severity": "string", "source": "string",
            "code": "string|number?", "message": "string", "context": "object?",
        },
        required=("event_type", "event_id", "timestamp", "severity", "source", "message"),
    ),
}

# Variant type names of each JSON type.
_TYPE_NAMES = {
    "string": ("STRING",),
    "boolean": ("BOOLEAN",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"),
    "object": ("OBJECT",),
}


def _types(doc: Column) -> Column:
    """Field name to JSON type name of one object; null if it is not an object."""
    fields = doc.try_cast("map<string,variant>")
    # DECIMAL(3,1), ARRAY<…> and OBJECT<…> by their first word.
    word = lambda v: F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)
    return F.transform_values(fields, lambda _k, v: F.coalesce(word(v), F.lit("VOID")))


def _violations(types: Column, rules: Rules, label: str = "") -> list[Column]:
    """What breaks the rules over the type map.

    Fields are held as ``name:TYPE`` against one constant list of those allowed, so only the
    fields that break a rule are looked at one by one.
    """
    names = {n: [t for part in wanted.rstrip("?").split("|") for t in _TYPE_NAMES[part]] + ["VOID"] * wanted.endswith("?") for n, wanted in rules.fields.items()}
    allowed = F.array(*[F.lit(f"{n}:{t}") for n, ts in names.items() for t in ts])
    found = F.zip_with(F.map_keys(types), F.map_values(types), lambda n, t: F.concat(n, F.lit(":"), t))
    odd = F.transform(F.array_except(found, allowed), lambda p: F.left(p, F.length(p) - F.length(F.substring_index(p, ":", -1)) - 1))
    if rules.open:
        wrong = F.transform(F.filter(odd, lambda n: n.isin(*names)), lambda n: F.concat(F.lit(f"type {label}"), n))
    else:
        wrong = F.transform(odd, lambda n: F.concat(F.when(n.isin(*names), F.lit(f"type {label}")).otherwise(F.lit("extra ")), n))
    missing = F.array_except(F.array(*map(F.lit, rules.required)), F.map_keys(types))
    return [F.transform(missing, lambda n: F.concat(F.lit(f"missing {label}"), n)), wrong]


def validate(lines: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """Add ``violations`` (sorted; empty when valid) and ``valid``.

    Each line is parsed once into a map of field types; the rules are lookups
    in that map.
    """
    rules = RULES[kind]
    rows = lines.withColumn("__doc", F.try_parse_json(F.col(value)))
    columns = {"__types": _types(F.col("__doc"))}
    for name in rules.nested:
        columns[f"__{name}"] = _types(F.try_variant_get("__doc", f"$.{name}", "variant"))
    for name in rules.allowed:
        columns[f"__value_{name}"] = F.try_variant_get("__doc", f"$.{name}", "string")
    rows = rows.withColumns(columns)
    parts = _violations(F.col("__types"), rules)
    none = F.array().cast("array<string>")
    for name, inner in rules.nested.items():
        found = F.concat(*_violations(F.col(f"__{name}"), inner, f"{name}."))
        parts.append(F.when(F.col(f"__{name}").isNotNull(), found).otherwise(none))
    for name, values in rules.allowed.items():
        wrong = (F.try_element_at("__types", F.lit(name)) == "STRING") & ~F.col(f"__value_{name}").isin(*values)
        parts.append(F.when(wrong, F.array(F.lit(f"value {name}"))).otherwise(none))
    found = F.when(F.col("__types").isNull(), F.array(F.lit("not json"))).otherwise(F.array_sort(F.concat(*parts)))
    helpers = ["__doc", *columns]
    # As a generator's output, the result is computed once: a filter on it cannot be
    # pushed below and evaluate the rules a second time per rule.
    checked = rows.select("*", F.explode(F.array(found)).alias("violations"))
    return checked.withColumn("valid", F.size("violations") == 0).drop(*helpers)


def parse(lines: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """Typed columns of the lines that parse; blank and malformed lines drop out."""
    keep = [c for c in lines.columns if c != value]
    good = F.filter(F.array(F.col(value)), lambda v: F.try_parse_json(v).isNotNull() & (F.trim(v) != ""))
    events = F.transform(good, lambda v: F.from_json(v, SCHEMAS[kind]))
    # As a generator's output, a line is made and parsed once: neither the test for good lines nor a
    # later filter on a field can be pushed below and make it again.
    return lines.select(*keep, F.explode(events).alias("e")).select(*keep, "e.*")


def rejected_as_errors(checked: DataFrame, event_id: Column, timestamp: Column, value: str = "value") -> DataFrame:
    """Error events for the lines that failed validation."""
    bad = checked.filter(~F.col("valid"))
    return bad.select(
        build_event(
            "error",
            event_type=F.lit("ERROR"),
            event_id=event_id,
            timestamp=timestamp,
            severity=F.lit("ERROR"),
            source=F.lit("SCHEMA_VALIDATION"),
            message=F.concat_ws("; ", "violations"),
            context=F.create_map(F.lit("payload"), F.col(value)),
        ).alias("value")
    )


def build_event(kind: str, **fields: Column) -> Column:
    """A JSON line of one event kind; fields left out or null are absent from the line."""
    unknown = set(fields) - set(SCHEMAS[kind].names)
    if unknown:
        raise ValueError(f"unknown {kind} fields: {sorted(unknown)}")
    ordered = [n for n in SCHEMAS[kind].names if n in fields]
    return F.to_json(F.struct(*[fields[n].alias(n) for n in ordered]))


def write_events(lines: DataFrame, root: str, kind: str, timestamp: Column, value: str = "value") -> None:
    """Append JSON lines below ``kind=…/date=…`` (UTC day)."""
    rows = lines.select(F.lit(kind).alias("kind"), F.date_format(timestamp, "yyyy-MM-dd").alias("date"), F.col(value).alias("value"))
    # One file per day, several for a day too large for one task.
    rows.hint("rebalance", "date").write.partitionBy("kind", "date").mode("append").text(root)


def read_lines(spark: SparkSession, root: str, kind: str, dates: list[str] | None = None) -> DataFrame:
    """Raw lines of one kind with their date; ``dates`` prunes directories."""
    schema = T.StructType([T.StructField("value", _S), T.StructField("kind", _S), T.StructField("date", _S)])
    rows = spark.read.schema(schema).text(root).filter(F.col("kind") == kind)
    return rows.filter(F.col("date").isin(*dates)) if dates else rows


def read_events(spark: SparkSession, root: str, kind: str, dates: list[str] | None = None) -> DataFrame:
    return parse(read_lines(spark, root, kind, dates).drop("kind"), kind)


def with_bar_dates(events: DataFrame, bars: DataFrame, today: Column, start: Column | None = None, end: Column | None = None, days: int = 30) -> DataFrame:
    """Events of the days in the range (by default the last ``days`` days) that have bars; without any, of today."""
    last = F.coalesce(end, today) if end is not None else today
    first = F.coalesce(start, F.date_sub(today, days)) if start is not None else F.date_sub(today, days)
    day = F.col("date").cast("date")
    active = bars.filter(day.between(first, last)).select("date").distinct()
    none = active.agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == 0)
    days_used = active.unionByName(none.select(F.date_format(today, "yyyy-MM-dd").alias("date")))
    return events.join(days_used, "date", "left_semi")


# --- views over events --------------------------------------------------------


def filled_trades(trades: DataFrame, symbol: str | None = None) -> DataFrame:
    rows = trades.filter(F.col("order.status") == "FILLED")
    return rows if symbol is None else rows.filter(F.col("symbol") == symbol)


def symbol_bars(bars: DataFrame, symbol: str | None = None, tf: str | None = None) -> DataFrame:
    rows = bars if symbol is None else bars.filter(F.col("symbol") == symbol)
    rows = rows if tf is None else rows.filter(F.col("timeframe") == tf)
    return rows.select("symbol", "timeframe", "bar.*")


def latest_run(runs: DataFrame) -> DataFrame:
    """Newest run event per (symbol, timeframe) that carries a configuration."""
    keyed = runs.filter(F.col("config").isNotNull()).select(
        F.upper("config.symbol").alias("symbol"), F.col("config.timeframe").alias("timeframe"), "timestamp", "run_id",
        F.upper(F.coalesce("config.instrument_mode", F.lit("spot"))).alias("instrument_mode"),
    )
    return keyed.groupBy("symbol", "timeframe").agg(
        F.max_by(F.struct("run_id", "instrument_mode"), "timestamp").alias("r"), F.max("timestamp").alias("timestamp")
    ).select("symbol", "timeframe", "timestamp", "r.*")


def equity_curve(accounts: DataFrame) -> DataFrame:
    return accounts.filter(F.col("account.equity_quote").isNotNull()).select(
        "timestamp", F.col("account.equity_quote").alias("equity")
    )


def trade_feed(trades: DataFrame) -> DataFrame:
    """Side, quantity and price of every trade event."""
    return trades.select(
        "symbol",
        "timestamp",
        F.upper(F.coalesce("order.side", F.lit(""))).alias("side"),
        F.coalesce("order.quantity", "order.quote_quantity").alias("quantity"),
        F.col("order.price").alias("price"),
    )
