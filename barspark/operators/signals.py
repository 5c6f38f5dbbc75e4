"""Trading signals from fixed parameters; fitted parameters live in ``strategies``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.operators import windows as W
from barspark.series import POS, Running, Series, plain, running, windowed


def _averages(price: str, fast: int, slow: int) -> dict:
    return {"__fast": W.sma(price, fast), "__slow": W.sma(price, slow)}


def _carried(df: DataFrame, spec: Series, raw: str, name: str) -> DataFrame:
    return running(df, spec, {name: Running("last", F.col(raw))}).drop(raw)


def crossover_raw(fast: Column, slow: Column) -> Column:
    """1 above, -1 below, null on a tie or before warm-up."""
    return F.when(fast > slow, F.lit(1.0)).when(fast < slow, F.lit(-1.0))


def breakout_raw(price: Column, upper: Column, lower: Column) -> Column:
    """-1 below the channel, 1 above it, null inside it."""
    return F.when(price < lower, F.lit(-1.0)).when(price > upper, F.lit(1.0))


def ma_crossover(df: DataFrame, spec: Series, price="close", fast=10, slow=30, name="signal") -> DataFrame:
    """Long above, short below, hold on a tie; null before warm-up."""
    out = windowed(
        df, spec, _averages(price, fast, slow), {"__raw": plain(crossover_raw(F.col("__fast"), F.col("__slow")))}
    ).drop("__fast", "__slow")
    return _carried(out, spec, "__raw", name)


def ma_long_flat_layers(price: str, fast: int, slow: int, name: str) -> list[dict]:
    above = F.coalesce(F.col("__fast") > F.col("__slow"), F.lit(False)).cast("double")
    return [_averages(price, fast, slow), {name: plain(above)}]


def ma_long_flat(df: DataFrame, spec: Series, price="close", fast=10, slow=30, name="signal") -> DataFrame:
    """Long while the fast average is above the slow one, else flat (also before warm-up)."""
    return windowed(df, spec, *ma_long_flat_layers(price, fast, slow, name)).drop("__fast", "__slow")


def ma_long_short(df: DataFrame, spec: Series, price="close", fast=10, slow=30, name="signal") -> DataFrame:
    """Long above, short otherwise, hence short before warm-up."""
    side = F.when(F.col("__fast") > F.col("__slow"), F.lit(1.0)).otherwise(F.lit(-1.0))
    return windowed(df, spec, _averages(price, fast, slow), {name: plain(side)}).drop("__fast", "__slow")


def donchian(df: DataFrame, spec: Series, price="close", lookback=20, name="signal") -> DataFrame:
    """Break of the prior ``lookback - 1`` bars' range, held until the opposite break."""
    if lookback < 2:
        return windowed(df, spec, {name: plain(F.lit(None).cast("double"))})
    raw = breakout_raw(F.col(price), F.col("__upper"), F.col("__lower"))
    out = windowed(
        df,
        spec,
        {"__upper": W.prior_max(price, lookback), "__lower": W.prior_min(price, lookback)},
        {"__raw": plain(raw)},
    ).drop("__upper", "__lower")
    return _carried(out, spec, "__raw", name)


def markers(df: DataFrame, spec: Series, signal="signal", name="marker") -> DataFrame:
    """Sign of the signal change: 1 buy, -1 sell, 0 no change, null at the first bar."""
    return windowed(df, spec, {name: W.sign_change(signal)}).withColumn(name, F.signum(name))


def signal_counts(df: DataFrame, spec: Series, signal="signal") -> DataFrame:
    """Rows per signal value."""
    return df.groupBy(*spec.by(signal)).agg(F.count(F.lit(1)).alias("n"))


def latest(df: DataFrame, spec: Series, *columns: str) -> DataFrame:
    """Newest row of every series."""
    picked = F.max_by(F.struct(*columns), F.col(spec.ts)).alias("__last")
    return df.groupBy(*spec.keys).agg(F.max(spec.ts).alias(spec.ts), picked).select(*spec.by(spec.ts), "__last.*")


def tail(df: DataFrame, spec: Series, k: int) -> DataFrame:
    """Last ``k`` rows of every series (needs ``pos`` and ``n_rows``)."""
    return df.filter(F.col(POS) >= F.col("n_rows") - k)
