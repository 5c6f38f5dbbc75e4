"""Hand-made and seeded series for tests."""

from __future__ import annotations

import numpy as np
import pandas as pd

from barspark.series import Series

HOURLY = Series(keys=("symbol",), step=3600)
SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def series(spark, closes, symbol="A", start="2024-01-01", step_hours=1, volume=None, times=None):
    closes = np.asarray(closes, float)
    ts = pd.to_datetime(times) if times is not None else pd.date_range(start, periods=len(closes), freq=f"{step_hours}h")
    opens = np.concatenate([[closes[0]], closes[:-1]])
    pdf = pd.DataFrame(
        {"symbol": symbol, "ts": ts, "open": opens, "high": np.maximum(opens, closes), "low": np.minimum(opens, closes), "close": closes,
         "volume": np.ones(len(closes)) if volume is None else np.asarray(volume, float)}
    )
    return spark.createDataFrame(pdf, SCHEMA)


def random_walk(n, seed=1, symbols=("A", "B")):
    """Bars of a few seeded random walks, with some volume."""
    parts = []
    for i, symbol in enumerate(symbols):
        rng = np.random.default_rng(seed + i)
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        opens = np.concatenate([[100.0], close[:-1]]) * np.exp(rng.normal(0, 0.002, n))
        parts.append(
            pd.DataFrame(
                {"symbol": symbol, "ts": pd.date_range("2024-01-01", periods=n, freq="1h"), "open": opens,
                 "high": np.maximum(opens, close) * 1.001, "low": np.minimum(opens, close) * 0.999, "close": close,
                 "volume": rng.integers(1, 50, n).astype(float)}
            )
        )
    return pd.concat(parts, ignore_index=True)


def frame(spark, pdf):
    return spark.createDataFrame(pdf, SCHEMA)


def collected(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)
