"""Event lines are made and parsed once."""

import json

import pytest
from pyspark.sql import functions as F

from barspark.sources import events as V
from checks.live import k04_sorted_events

GOOD = {
    "event_type": "FILLED", "event_id": "1", "timestamp": "2024-01-01T00:00:00", "strategy_id": "s", "exchange": "x", "symbol": "A",
    "base_asset": "A", "quote_asset": "B", "order": {"client_order_id": "c", "side": "BUY", "type": "MARKET", "time_in_force": "IOC", "quantity": 2, "status": "FILLED"},
}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id int, value string")


def test_a_made_line_is_made_and_parsed_once(spark):
    made = spark.range(5).select("id", F.to_json(F.struct(F.col("id").cast("string").alias("event_id"), F.lit("A").alias("symbol"))).alias("value"))
    out = V.parse(made, "trade").filter("symbol = 'A'").select("id", "event_id", "symbol")
    plan = _plan(out)
    assert [plan.count(x) for x in ("StructsToJsonEvaluator", "parseJson", "from_json(")] == [1, 1, 1]
    assert [(r.id, r.event_id, r.symbol) for r in out.orderBy("id").collect()] == [(i, str(i), "A") for i in range(5)]


def test_lines_that_do_not_parse_drop_out(spark):
    values = [None, "", "  ", "{", "null", "[1]", "3", '{"event_id": "a", "event_id": "b"}', '{"event_id": "c", "order": {"quantity": "two"}}', ' {"event_id": "d"} ']
    got = V.parse(_lines(spark, *values), "trade").select("id", "event_id", "order.quantity").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(4, None, None), (5, None, None), (6, None, None), (8, "c", None), (9, "d", None)]


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, []),
        ({"pnl": None, "latency_ms": 1.5, "metadata": {}}, []),
        ({"symbol": None}, ["type symbol"]),
        ({"a:b": 1, "x\ny:": [1], "symbol:STRING": 1}, ["extra a:b", "extra symbol:STRING", "extra x\ny:"]),
        ({"latency_ms": "soon", "is_paper": 1, "error": [1]}, ["type error", "type is_paper", "type latency_ms"]),
        ({"event_type": "NOPE"}, ["value event_type"]),
        ({"event_type": 7}, ["type event_type"]),
        ({"order": 1}, ["type order"]),
        ({"order": {"quantity": "two", "note": 1, "leverage": 1.5, "price": 1e300}}, sorted(f"missing order.{n}" for n in ("client_order_id", "side", "status", "time_in_force", "type")) + ["type order.leverage", "type order.quantity"]),
    ],
)
def test_each_rule_tells_its_field(spark, change, want):
    row = V.validate(_lines(spark, json.dumps(GOOD | change)), "trade").first()
    assert row.violations == want and row.valid == (not want)


def test_lines_that_are_no_objects_are_not_json(spark):
    rows = V.validate(_lines(spark, "[1]", "3", "null", "{", "", None), "trade").orderBy("id").collect()
    assert [r.violations for r in rows] == [["not json"]] * 6
    lacking = V.validate(_lines(spark, "{}"), "trade").first().violations
    assert lacking == sorted(f"missing {n}" for n in V.RULES["trade"].required)


def test_rules_look_at_a_type_map_not_once_per_field(spark):
    """The plan names a field's type lookup no more often than there are kinds of rules."""
    assert _plan(V.validate(_lines(spark, "{}"), "trade")).count("element_at(") <= 2


def test_sorted_events_are_parsed_before_the_sort(spark, tmp_path):
    day = F.expr("timestamp_ntz'1995-01-01' + make_dt_interval(cast(pmod(o_orderkey * 7, 50) as int))")
    orders = spark.range(60).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 9).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit(2.5).alias("o_totalprice"),
        F.lit("5-LOW").alias("o_orderpriority"),
    )
    orders.withColumn("o_orderdate", day).write.parquet(f"{tmp_path}/orders.parquet")
    df = k04_sorted_events(spark, str(tmp_path))
    assert "from_json" not in _plan(df) and "Sort" in _plan(df)
    times = [r.timestamp for r in df.collect()]
    assert len(times) == 50 and times == sorted(times)
