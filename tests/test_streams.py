"""Streams: restart, late corrections, and agreement with the batch twin."""

import numpy as np
import pandas as pd
import pytest
from fixtures import HOURLY, collected, frame, random_walk
from pyspark.sql import functions as F

from barspark.operators import features as X
from barspark.operators import ledger as L
from barspark.operators.direction import DirectionClassifier
from barspark.operators.forecaster import Forecaster
from barspark.operators.networks import Training
from barspark.operators.strategies import Donchian, MovingAverage, PandasStrategy
from barspark.sources import bars as B
from barspark.sources import events as V
from barspark.sources import store
from barspark.streaming import live as S

SPEC = HOURLY.extend("mode", "tf")


def _land(rows, landing):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    cells = F.array(millis.cast("string"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")], (millis + 3_599_999).cast("string"))
    pages = rows.select(F.lit("spot").alias("mode"), "symbol", F.lit("1h").alias("tf"), F.to_json(F.array(cells)).alias("value"))
    pages.coalesce(1).write.mode("append").json(landing)


@pytest.fixture
def bars(spark):
    return frame(spark, random_walk(120, seed=5))


def test_ingest_restarts_and_takes_corrections(spark, bars, shared):
    cut = F.lit("2024-01-03").cast("timestamp_ntz")
    run = lambda: S.ingest(S.candle_stream(spark, f"{shared}/in"), f"{shared}/store", SPEC, f"{shared}/ckpt").awaitTermination()
    _land(bars.filter(F.col("ts") < cut), f"{shared}/in")
    run()
    _land(bars.filter(F.col("ts") >= cut), f"{shared}/in")
    _land(bars.filter(F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz")).withColumn("close", F.col("close") * 2), f"{shared}/in")
    run()
    run()
    got = collected(B.read_bars(spark, f"{shared}/store", "spot", "A", "1h"), "ts")
    want = collected(bars.filter("symbol = 'A'"), "ts")
    assert len(got) == 120
    np.testing.assert_allclose(got.close[:24], want.close[:24] * 2)
    np.testing.assert_allclose(got.close[24:], want.close[24:])


def test_later_file_wins_though_spark_reads_larger_files_first(spark, bars, shared):
    import os
    import time

    os.makedirs(f"{shared}/in")
    few, many = bars.limit(3), bars
    _land(few.withColumn("close", F.lit(1.0)), f"{shared}/a")
    _land(many.withColumn("close", F.lit(2.0)), f"{shared}/b")

    def move(folder, name, age):
        (page,) = [f for f in os.listdir(folder) if f.startswith("part")]
        with open(f"{folder}/{page}") as source, open(f"{shared}/in/{name}.json", "w") as target:
            target.write(source.read())
        os.utime(f"{shared}/in/{name}.json", (time.time() - age,) * 2)

    move(f"{shared}/b", "large", 100)  # read first, written first
    move(f"{shared}/a", "small", 10)
    S.ingest(S.candle_stream(spark, f"{shared}/in"), f"{shared}/store", SPEC, f"{shared}/ckpt").awaitTermination()
    assert B.read_bars(spark, f"{shared}/store").filter("close = 1").count() == 3
    os.utime(f"{shared}/in/small.json", (time.time() - 200,) * 2)  # now the small one is the older one
    S.ingest(S.candle_stream(spark, f"{shared}/in"), f"{shared}/other", SPEC, f"{shared}/ckpt2").awaitTermination()
    assert B.read_bars(spark, f"{shared}/other").filter("close = 1").count() == 0


def test_short_series_are_fitted_on_what_they_have(spark):
    from barspark.operators.folds import walk_forward_signals

    strategy = MovingAverage(max_window=6)
    make = lambda n, s: frame(spark, random_walk(n, seed=9, symbols=(s,)))
    bars = make(120, "A").unionByName(make(80, "B")).unionByName(make(40, "C"))
    got = {r.symbol: r.signal for r in S.latest_signals(bars, HOURLY, strategy, 100, 10).collect()}
    assert got.keys() == {"A", "B", "C"} and got["C"] is None
    # B has 80 bars: fitted on 75, signalled on the last five
    want = walk_forward_signals(make(80, "B"), HOURLY, strategy, 75, 5).filter("pos = 79").first().signal
    assert got["B"] == want


def test_unfinished_bars_wait(spark, bars, shared):
    _land(bars, f"{shared}/in")
    now = F.lit("2024-01-02").cast("timestamp_ntz")
    S.ingest(S.candle_stream(spark, f"{shared}/in"), f"{shared}/store", SPEC, f"{shared}/ckpt", now=now).awaitTermination()
    assert B.read_bars(spark, f"{shared}/store").agg(F.max("ts")).first()[0].isoformat() == "2024-01-01T23:00:00"


def _runs(spark, shared, name, parts, stream):
    """What a stream has written after one run per part of its input."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{shared}/{name}/in")
        made = stream(spark.readStream.schema(part.schema).parquet(f"{shared}/{name}/in"))
        writer = made.writeStream.format("parquet").option("path", f"{shared}/{name}/out").option("checkpointLocation", f"{shared}/{name}/ckpt")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{shared}/{name}/out")


@pytest.mark.parametrize(
    "strategy, columns",
    [
        (MovingAverage(max_window=6), ()),
        (Donchian(high=9), ()),
        (DirectionClassifier(rsi=(5,), ema=(4, 8), vol=(6,), minimum=10), ("volume",)),
        (Forecaster(X.FeatureSet(tf="1h", horizon_hours=2, vol_hours=6, sma=(3,), momentum=(4,), rsi=(5,), regime_window=None), Training(hidden=3, epochs=2)), ()),
        (PandasStrategy(lambda t: ({"level": t.close.mean()}, 1.0), lambda c, p: np.sign(c.close - p["level"]), ("level",)), ()),
    ],
)
def test_signal_stream_equals_batch_at_any_split(spark, bars, shared, strategy, columns):
    from barspark.operators.folds import walk_forward_signals

    bars = bars.select("symbol", "ts", "close", "volume")
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) - 473_352  # since the first bar
    cuts = [hour < 17, (hour >= 17) & (hour < 75), (hour >= 75) & (hour < 76), hour >= 76]
    run = lambda s: S.signal_stream(s, HOURLY, strategy, 40, 10, columns=columns)
    got = collected(_runs(spark, shared, "four", [bars.filter(c) for c in cuts], run), "symbol", "ts")
    want = collected(walk_forward_signals(bars, HOURLY, strategy, 40, 10).filter("pos >= 40"), "symbol", "ts")
    assert got.pos.tolist() == want.pos.tolist() and got.fold.tolist() == want.fold.tolist() and not got.late.any()
    np.testing.assert_array_equal(got.signal.to_numpy(float), want.signal.to_numpy(float))


def test_bars_wait_their_turn_and_late_ones_are_told(spark, bars, shared):
    signals = bars.withColumn("signal", F.signum(F.col("close") - F.col("open"))).select("symbol", "ts", "close", "signal")
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) - 473_352  # since the first bar
    moved = hour + F.when(hour % 4 == 0, 6).otherwise(0)
    wrong = signals.withColumn("close", F.lit(1e6)).filter(hour == 58)  # replaced while it waits
    parts = [signals.filter((moved < 60) & (hour != 58)).unionByName(wrong), signals.filter((moved >= 60) | (hour == 58)), signals.filter(hour < 3)]
    book = S.Book(2.0, 150.0, 0.001)
    got = collected(_runs(spark, shared, "p", parts, lambda s: S.position_stream(s, "symbol", "ts", "close", "signal", book, 8 * 3600)), "symbol", "ts")
    want = collected(L.ledger(signals, HOURLY, base_qty=2.0, max_notional=150.0, fee_rate=0.001).filter("action is not null"), "symbol", "ts")
    turn = want[want.ts <= bars.agg(F.max("ts")).first()[0] - pd.Timedelta(hours=8)]
    late = got[got.action == "LATE"]
    assert len(late) == 6 and late.position_qty.isna().all() and (late.price < 1e6).all()
    done = got[got.action != "LATE"]
    assert done.action.tolist() == turn.action.tolist() and done.ts.tolist() == turn.ts.tolist()
    np.testing.assert_allclose(done.gross_pnl, turn.gross_pnl)
    queue = S.Queue(S.NEVER, S.NEVER, {})
    assert queue.take([(5, "a"), (3, "b"), (5, "c")], 0) == ([(3, "b"), (5, "c")], [])
    assert queue.take([(5, "d"), (9, "e"), (7, "f")], 2) == ([(7, "f")], [(5, "d")]) and queue.held == {9: (9, "e")}


def test_position_stream_with_loss_limit_equals_ledger(spark, bars, shared):
    signals = bars.withColumn("signal", F.signum(F.col("close") - F.col("open"))).select("symbol", "ts", "close", "signal")
    book = S.Book(2.0, 150.0, 0.001, loss_limit=2.0)
    for day in range(1, 6):
        signals.filter(F.dayofmonth("ts") == day).coalesce(1).write.mode("append").parquet(f"{shared}/signals")
        stream = spark.readStream.schema(signals.schema).parquet(f"{shared}/signals")
        made = S.position_stream(stream, "symbol", "ts", "close", "signal", book)
        writer = made.writeStream.format("parquet").option("path", f"{shared}/fills").option("checkpointLocation", f"{shared}/ckpt")
        writer.trigger(availableNow=True).start().awaitTermination()
    got = collected(spark.read.parquet(f"{shared}/fills"), "symbol", "ts")
    want = collected(
        L.ledger(signals, HOURLY, base_qty=2.0, max_notional=150.0, fee_rate=0.001, loss_limit=2.0).filter("action is not null"), "symbol", "ts"
    )
    assert got.action.tolist() == want.action.tolist() and len(got) > 4
    np.testing.assert_allclose(got.gross_pnl, want.gross_pnl)
    np.testing.assert_allclose(got.fees_total, want.fees_total)


# --- store ---


def test_commits_are_seen_whole_or_not_at_all(spark, bars, shared):
    keyed = bars.withColumns({"mode": F.lit("spot"), "tf": F.lit("1h")})
    B.write_bars(keyed, shared)
    before = B.read_bars(spark, shared)  # a reader that began before the commits
    first = store.newest(spark, shared)
    for factor in (2.0, 3.0):
        B.upsert_into(shared, keyed.filter("symbol = 'A'").withColumn("close", F.lit(factor)), SPEC)
    assert before.filter("close in (2, 3)").isEmpty() and before.count() == 240
    after = B.read_bars(spark, shared)
    assert after.filter("close = 3").count() == 120 and after.count() == 240
    with pytest.raises(store.Conflict):  # another writer that began when the first did
        B.write_bars(keyed, shared, base=first)
    assert store.newest(spark, shared) == first + 2 and B.read_bars(spark, shared).filter("close = 3").count() == 120
    assert not B.read_bars(spark, shared, "spot", "B", "1h").isEmpty()


def test_old_snapshots_are_removed_with_their_files(spark, bars, shared):
    import os

    keyed = bars.withColumns({"mode": F.lit("spot"), "tf": F.lit("1h")})
    for factor in range(1, 7):
        B.write_bars(keyed.withColumn("close", F.lit(float(factor))), shared)
    assert len(os.listdir(f"{shared}/data")) == len([f for f in os.listdir(f"{shared}/lists") if not f.startswith(".")]) == store.KEPT
    assert B.read_bars(spark, shared).filter("close = 6").count() == 240
    empty = keyed.limit(0)
    assert B.write_bars(empty, shared) == store.newest(spark, shared) == 6
    assert B.write_bars(empty, f"{shared}/other") == 1 and B.read_bars(spark, f"{shared}/other").count() == 0
    with pytest.raises(FileNotFoundError):
        B.read_bars(spark, f"{shared}/none")


def test_the_bar_that_arrived_last_wins_in_any_batch_order(spark, bars, shared):
    keyed = bars.limit(5).withColumns({"mode": F.lit("spot"), "tf": F.lit("1h")})
    page = lambda close, name: keyed.withColumns({"close": F.lit(close), "page": F.lit("0" * 19 + name)})
    for close, name in ((2.0, "2"), (1.0, "1"), (3.0, "3"), (2.5, "2/5")):
        B.upsert_into(shared, page(close, name), SPEC, seq="page")
    assert {r.close for r in B.read_bars(spark, shared).collect()} == {3.0}
    B.upsert_into(shared, keyed.withColumn("close", F.lit(4.0)), SPEC)  # by hand: arrives now
    assert {r.close for r in B.read_bars(spark, shared).collect()} == {4.0}


# --- event log ---


def test_broken_lines_are_dropped_and_reported(spark):
    good = '{"event_type":"ERROR","event_id":"1","timestamp":"t","severity":"WARNING","source":"API","message":"m"}'
    lines = [good, "", "   ", "{oops", good.replace('"m"', "5"), good.replace('"severity":"WARNING",', ""), good[:-1] + ',"x":1}', "[1]", good[:-1] + ',"code":null}']
    rows = V.validate(spark.createDataFrame([(x,) for x in lines], "value string"), "error")
    got = {r.value: r.violations for r in rows.collect()}
    assert got[good] == [] and got[lines[8]] == []
    assert got["{oops"] == ["not json"] and got["[1]"] == ["not json"]
    assert got[lines[4]] == ["type message"] and got[lines[5]] == ["missing severity"] and got[lines[6]] == ["extra x"]
    assert V.parse(rows.select("value"), "error").count() >= 5


def test_log_round_trip(spark, shared):
    row = spark.range(3).select(
        V.build_event("signal", symbol=F.lit("A"), timeframe=F.lit("1h"), signal=F.struct(F.lit("t").alias("timestamp"), F.col("id").cast("double").alias("value"))).alias("value")
    )
    V.write_events(row, shared, "signal", F.lit("2024-03-05 10:00:00").cast("timestamp_ntz"))
    back = V.read_events(spark, shared, "signal", ["2024-03-05"])
    assert sorted(r.value for r in back.select("signal.value").collect()) == [0.0, 1.0, 2.0]
    assert V.read_events(spark, shared, "signal", ["2024-03-06"]).count() == 0
    with pytest.raises(ValueError):
        V.build_event("signal", nope=F.lit(1))


def test_missing_series_fails(spark, bars, shared):
    B.write_bars(bars.withColumns({"mode": F.lit("spot"), "tf": F.lit("1h")}), shared)
    with pytest.raises(FileNotFoundError):
        B.read_bars(spark, shared, "spot", "NOPE", "1h")


def test_times_are_repaired_or_refused(spark):
    with pytest.raises(ValueError):
        B.repair_time(spark.createDataFrame([(1.0,)], "x double"))
    bad = B.repair_time(spark.createDataFrame([("n/a",)], "timestamp string"))
    with pytest.raises(ValueError):
        B.require_time(bad)
    good = B.repair_time(spark.createDataFrame([("n/a", 1_704_067_200_000)], "index string, openTime long"))
    assert good.first().ts.isoformat() == "2024-01-01T00:00:00"
