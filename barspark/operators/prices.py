"""Resolve a price column by name, deriving it where the table does not hold it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.functions.scalars import median_price, typical_price
from barspark.operators import windows as W
from barspark.series import Running, Series, running, windowed

# Fixed value: bars of a VWAP whose name gives none.
DEFAULT_VWAP_BARS = 20


def vwap_bars(name: str) -> int | None:
    """20 for ``vwap``, N for ``vwap_N``, ``vwap-N`` and ``vwapN``; None if the name is not a VWAP."""
    if not name.startswith("vwap"):
        return None
    number = re.fullmatch(r"vwap[_-]?(\d+)", name)
    return int(number.group(1)) if number else DEFAULT_VWAP_BARS


def _require(df: DataFrame, name: str, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"cannot derive {name!r}: missing {', '.join(missing)}")


def with_price(df: DataFrame, spec: Series, name: str, derive: bool = False) -> DataFrame:
    """Add price column ``name``: a stored column wins unless ``derive``; unknown names fail."""
    known = name in ("median", "typical") or vwap_bars(name) is not None
    if name in df.columns and not (derive and known):
        return df
    if name == "median":
        _require(df, name, "high", "low")
        return df.withColumn(name, median_price())
    if name == "typical":
        _require(df, name, "high", "low", "close")
        return df.withColumn(name, typical_price())
    bars = vwap_bars(name)
    if bars is None:
        raise KeyError(f"unknown price column {name!r}")
    _require(df, name, "high", "low", "close", "volume")
    return vwap(df, spec, bars, name)


def vwap(df: DataFrame, spec: Series, bars: int = DEFAULT_VWAP_BARS, name: str = "vwap") -> DataFrame:
    """Rolling VWAP; bars whose whole frame has no volume repeat the last known value."""
    out = windowed(df, spec, {"__vwap": W.rolling_vwap(bars)})
    return running(out, spec, {name: Running("last", F.col("__vwap"))}).drop("__vwap")


def with_derived_prices(df: DataFrame) -> DataFrame:
    """The derived columns a bar cache stores; its ``vwap`` is the typical price."""
    return df.withColumns({"typical": typical_price(), "median": median_price(), "vwap": typical_price()})
