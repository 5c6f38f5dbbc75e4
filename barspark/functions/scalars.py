"""Row-local functions: prices, intervals, symbols, fees, cleaning and parsing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Interval names the bar sources offer, in minutes.
INTERVAL_MINUTES = {"1m": 1, "5m": 5, "15m": 15, "1h": 60, "4h": 240, "1d": 1440}
# Minutes per interval unit.
UNIT_MINUTES = {"m": 1, "h": 60, "d": 1440}
# Default fee per side in basis points.
DEFAULT_FEE_BPS = {"spot": 10.0, "futures": 4.0}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- prices ---


def median_price(high="high", low="low") -> Column:
    return (_col(high) + _col(low)) / 2


def typical_price(high="high", low="low", close="close") -> Column:
    return (_col(high) + _col(low) + _col(close)) / 3


def log_price(price) -> Column:
    return F.log(_col(price))


# --- intervals ---


def parse_minutes(tf: str) -> int | None:
    """Minutes of an interval such as ``15m``, ``4h`` or ``1d``; None for unknown units."""
    tf = tf.lower().strip()
    return int(tf[:-1]) * UNIT_MINUTES[tf[-1]] if tf and tf[-1] in UNIT_MINUTES else None


def annualisation(tf: str | None, strict: bool = True) -> float:
    """sqrt(bars per year). Unknown units fail when strict, else count as hourly; empty means 1."""
    if not tf and not strict:
        return 1.0
    minutes = parse_minutes(tf or "")
    if minutes is None:
        if strict:
            raise ValueError(f"unsupported interval: {tf}")
        minutes = 60
    return math.sqrt(365 * 24 * 60 / minutes)


def interval_minutes(tf) -> Column:
    """Column twin of ``parse_minutes``: null for unknown units."""
    text = F.lower(F.trim(_col(tf)))
    unit = F.element_at(F.create_map(*[F.lit(x) for kv in UNIT_MINUTES.items() for x in kv]), F.right(text, F.lit(1)))
    return F.when(text.rlike(r"^\d+[mhd]$"), F.regexp_extract(text, r"^(\d+)", 1).try_cast("int") * unit)


def annualisation_factor(tf) -> Column:
    return F.sqrt(F.lit(525_600.0) / interval_minutes(tf))


def interval_hours(tf) -> Column:
    return F.coalesce(interval_minutes(tf) / 60, F.lit(1.0))


def bars_per_day(tf) -> Column:
    return F.greatest(F.lit(1.0), F.lit(24.0) / interval_hours(tf))


def is_source_interval(tf) -> Column:
    return _col(tf).isin(*INTERVAL_MINUTES)


def sharpe_window(tf: str) -> int:
    """Bars in 30 days, at least 10."""
    return max(10, int(24 * 30 / ((parse_minutes(tf) or 60) / 60)))


# --- symbols ---


def exchange_symbol(symbol) -> Column:
    """``BTCUSD | BTC-USD | BTC/USD | BTCUSDT`` to ``BTC/USDT``; USDT is the default quote."""
    s = F.replace(F.upper(_col(symbol)), F.lit(" "), F.lit(""))
    parts = F.split(s, "[/-]")
    split_base, split_quote = F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))
    base = F.when(F.size(parts) > 1, split_base).otherwise(F.regexp_replace(s, "(USDT|USD)$", ""))
    quote = F.when((F.size(parts) > 1) & (split_quote != "USD"), split_quote).otherwise(F.lit("USDT"))
    return F.concat_ws("/", base, quote)


def file_symbol(symbol) -> Column:
    return F.regexp_replace(_col(symbol), "[/-]", "")


def asset_of_symbol(symbol) -> Column:
    """``BTCUSDT`` to ``BTCUSD``: the asset name of an exchange symbol."""
    return F.regexp_replace(_col(symbol), "USDT$", "USD")


# --- fees ---


def fee_rate(fee_bps: float | None = None, slippage_bps: float = 0.0, mode: str = "spot", zero_fee: bool = False) -> float:
    """Cost per unit of turnover. No fee or fee 0 means the default of the mode, unless ``zero_fee``."""
    if zero_fee:
        fee = 0.0
    elif fee_bps and fee_bps > 0:
        fee = float(fee_bps)
    else:
        fee = DEFAULT_FEE_BPS["futures" if mode.strip().lower() == "futures" else "spot"]
    return (fee + float(slippage_bps)) / 10_000


def fee_rate_column(fee_bps, slippage_bps, mode) -> Column:
    fee = (
        F.when(_col(fee_bps) > 0, _col(fee_bps))
        .when(F.lower(F.trim(_col(mode))) == "futures", F.lit(DEFAULT_FEE_BPS["futures"]))
        .otherwise(F.lit(DEFAULT_FEE_BPS["spot"]))
    )
    return (fee + _col(slippage_bps)) / 10_000


# --- cleaning ---


def clip(x, low: float, high: float) -> Column:
    """Clip that keeps null (``greatest`` and ``least`` skip nulls)."""
    x = _col(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))


def floor_at(x, low: float) -> Column:
    x = _col(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(low))))


def finite_or(x, default: float | None = None) -> Column:
    """NaN and infinities to null, or to ``default``."""
    x = _col(x).cast("double")
    finite = F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
    return finite if default is None else F.coalesce(finite, F.lit(float(default)))


json_safe = finite_or


def json_safe_array(xs) -> Column:
    return F.transform(_col(xs), lambda x: finite_or(x))


def net_log_return(net_simple) -> Column:
    """log(1 + x) with the growth floored at 1e-12."""
    return F.log(floor_at(1 + _col(net_simple), 1e-12))


# --- labels and parsing ---


def up_label(forward_return) -> Column:
    return F.coalesce(_col(forward_return) > 0, F.lit(False)).cast("int")


def digitise(x, edges) -> Column:
    """Number of quantile edges at or below ``x``."""
    return F.size(F.filter(_col(edges), lambda e: e <= _col(x)))


def over_half(p) -> Column:
    return (_col(p) > 0.5).cast("int")


def extreme_preference(probabilities) -> Column:
    """(two highest classes) - (two lowest classes) of a probability array."""
    p = _col(probabilities)
    top = F.get(p, F.size(p) - 2) + F.get(p, F.size(p) - 1)
    return top - (F.get(p, F.lit(0)) + F.get(p, F.lit(1)))


def threshold_signal(score, low, high) -> Column:
    s = _col(score)
    return F.when(s < _col(low), F.lit(-1)).when(s > _col(high), F.lit(1)).otherwise(F.lit(0))


def parse_values(raw) -> Column:
    """Comma list to array of structs (text, kind, number): bool, int, float or string."""
    tokens = F.filter(F.transform(F.split(_col(raw), ","), lambda t: F.trim(t)), lambda t: t != "")

    def one(t: Column) -> Column:
        number = finite_or(t.try_cast("double"))
        kind = (
            F.when(F.lower(t).isin("true", "false"), F.lit("bool"))
            .when(number.isNotNull() & (F.abs(number - F.round(number)) < 1e-12), F.lit("int"))
            .when(number.isNotNull(), F.lit("float"))
            .otherwise(F.lit("str"))
        )
        return F.struct(t.alias("text"), kind.alias("kind"), number.alias("number"))

    return F.transform(tokens, one)
