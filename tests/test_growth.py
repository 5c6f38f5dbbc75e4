"""Steps that move, write or evaluate each row once."""

from dataclasses import replace

import numpy as np
import pytest
from fixtures import HOURLY, collected, frame, random_walk
from pyspark.sql import functions as F

import barspark.series
from barspark.operators import features as X
from barspark.operators import windows as W
from barspark.series import positions

FS = X.FeatureSet(tf="1h", vol_hours=20, sma=(5,), momentum=(7,), rsi=(7,), regime_window=10)


def test_features_move_the_bars_once_and_write_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(barspark.series, "_shared_folder", lambda _: str(tmp_path))
    rows = X.normalised_return(frame(spark, random_walk(200)), HOURLY, FS)
    rows.write.parquet(f"{tmp_path}/rows")
    out = X.features(spark.read.parquet(f"{tmp_path}/rows"), HOURLY, FS).select("symbol", "ts", *FS.names)
    assert [p.name for p in tmp_path.iterdir()] == ["rows"]
    plan = out._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert plan.count("Exchange hashpartitioning(symbol") == 1
    assert out.count() == 400


@pytest.mark.parametrize("block", [16, 50, 128])
def test_features_of_blocks_are_those_of_the_series(spark, block):
    """Prices that aren't numbers over whole blocks: the last known value comes from blocks before."""
    pdf = random_walk(300, seed=7)
    pdf.loc[(pdf.index % 300 >= 60) & (pdf.index % 300 < 180), "close"] = np.inf
    small, whole = (collected(X.features(X.normalised_return(frame(spark, pdf), s, FS), s, FS), "symbol", "ts") for s in (replace(HOURLY, block=block), HOURLY))
    assert len(small) == 600 and not [c for c in small.columns if c.startswith("__")]
    for n in FS.names:
        np.testing.assert_allclose(small[n].astype(float), whole[n].astype(float), rtol=1e-12, atol=1e-12, err_msg=n)
        assert np.isfinite(whole[n].astype(float)).all()
    a = whole[whole.symbol == "A"]
    assert a.mom_7.iloc[100] == a.mom_7.iloc[66]


def test_volatility_regime_of_blocks(spark):
    bars = positions(frame(spark, random_walk(300, seed=8)).withColumn("r", F.col("close") / F.col("open") - 1), HOURLY)
    small, whole = (collected(X.volatility_regime(bars, s, "r", 10), "symbol", "ts") for s in (replace(HOURLY, block=16), HOURLY))
    want = whole.groupby("symbol").r.rolling(10).std().reset_index(drop=True)
    middle = want.groupby(whole.symbol).rolling(20).median().reset_index(drop=True)
    assert small.vol_regime.tolist() == whole.vol_regime.tolist() == (want > middle).astype(float).tolist()


def test_a_median_begins_anew_where_a_series_lacks_its_first_bar(spark):
    """A bar without time is counted and dropped, so the series' first position is 1."""
    bars = positions(frame(spark, random_walk(30, seed=9)), HOURLY).filter("pos > 0").coalesce(1)
    got = collected(W.with_rolling_median(bars, HOURLY, "close", 5, "mid"), "symbol", "ts")
    want = got.groupby("symbol").close.transform(lambda x: x.rolling(5).median())
    np.testing.assert_allclose(got.mid.astype(float), want)
