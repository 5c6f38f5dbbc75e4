"""Position sizing: signal to weight (fraction of equity).

Null signals and null returns count as 0. Bounded-frame modes return layers
for ``windowed`` so that sizing shares the shuffle of the returns block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.scalars import annualisation, clip, finite_or
from barspark.operators import windows as W
from barspark.series import Rolling, Running, Series, plain, running, stage, windowed

SIGNAL, RETURN, WEIGHT = "signal", "simple_r", "weight"


def _zero_filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _shifted(column: str, causal: bool) -> list[dict[str, Rolling]]:
    """The return a sizing statistic may see; causal shifts it to the past."""
    base = _zero_filled(column)
    if not causal:
        return [{"__ret": plain(base)}]
    return [{"__now": plain(base)}, {"__ret": Rolling(lambda w: F.coalesce(F.lag("__now").over(w), F.lit(0.0)), back=1)}]


def _scaled(scale: Column, cap: float) -> Rolling:
    return plain(clip(_zero_filled(SIGNAL) * F.coalesce(scale, F.lit(0.0)), -cap, cap))


def sizing_layers(mode: str = "full_notional", params: dict | None = None, tf: str | None = None) -> list[dict[str, Rolling]]:
    """Layers that end with ``weight``; not for ``fixed_notional``, which is a scan."""
    p = params or {}
    causal = bool(p.get("causal", False))
    if mode == "fixed_fraction":
        fraction = min(10.0, max(0.0, float(p.get("fraction", 1.0))))
        return [{WEIGHT: plain(_zero_filled(SIGNAL) * fraction)}]
    if mode == "vol_target":
        annual = F.col("__vol") * annualisation(tf, strict=False)
        scale = F.try_divide(F.lit(float(p.get("target_vol_annual", 0.2))), F.nullif(annual, F.lit(0.0)))
        return [
            *_shifted(RETURN, causal),
            {"__vol": W.rolling_std("__ret", int(p.get("lookback", 50)))},
            {WEIGHT: _scaled(scale, float(p.get("max_leverage", 3.0)))},
        ]
    if mode == "risk_stop":
        risk, cap, stop = float(p.get("risk_per_trade_frac", 0.01)), float(p.get("max_leverage", 3.0)), p.get("stop_loss_pct")
        if stop is None:
            before = [*_shifted(RETURN, causal), {"__stop": W.rolling_mean_abs("__ret", int(p.get("lookback", 20)), floor=1e-6)}]
        elif isinstance(stop, str):
            before = [{"__stop": plain(F.col(stop).cast("double"))}]
        else:
            before = [{"__stop": plain(F.lit(float(stop)))}]
        scale = finite_or(F.try_divide(F.lit(risk), F.nullif(F.col("__stop"), F.lit(0.0))))
        return [*before, {WEIGHT: _scaled(scale, cap)}]
    return [{WEIGHT: plain(_zero_filled(SIGNAL))}]


_HELPERS = ("__ret", "__now", "__vol", "__stop")


def with_stops(df: DataFrame, stops: DataFrame, spec: Series, name: str = "stop_loss_pct") -> DataFrame:
    """Attach an external stop series by key and time; use it as ``stop_loss_pct=name``."""
    return df.join(stops.select(*spec.by(spec.ts), name), spec.by(spec.ts), "left")


def fixed_notional(df: DataFrame, spec: Series, notional: float = 1.0) -> DataFrame:
    """Constant notional: weight N / equity while equity is positive.

    While solvent, weight * return = N * signal * return / equity, so equity is
    1 + N * (running sum of signal * return before the bar). The first time it
    is not positive, the series stops for good.
    """
    gain = _zero_filled(SIGNAL) * _zero_filled(RETURN)
    out = running(df, spec, {"__sum": Running("sum", gain)})
    out = stage(out.withColumn("__equity", 1 + notional * (F.col("__sum") - gain)))
    # The sum includes the own bar and equity must not, hence the subtraction;
    # ruin is tested on the sum that ends before the bar.
    out = running(out, spec, {"__low": Running("min", F.col("__equity"))})
    weight = F.when(F.col("__low") <= 0, F.lit(0.0)).otherwise(notional / F.col("__equity") * _zero_filled(SIGNAL))
    return out.withColumn(WEIGHT, weight).drop("__sum", "__equity", "__low")


def size_positions(
    df: DataFrame, spec: Series, mode: str = "full_notional", params: dict | None = None, tf: str | None = None
) -> DataFrame:
    """Add ``weight`` to rows holding ``signal`` and ``simple_r``."""
    if mode == "fixed_notional":
        return fixed_notional(df, spec, float((params or {}).get("fixed_notional", 1.0)))
    return windowed(df, spec, *sizing_layers(mode, params, tf)).drop(*_HELPERS)
