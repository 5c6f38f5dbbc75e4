"""Sweeps: one evaluation per point of a grid of settings.

A point names settings by dot path: a field of the run (``fee_bps``, ``start``,
``sizing_params.lookback``), ``tf``, ``price``, a field of the strategy at any depth
(``strategy.max_window``, ``strategy.training.rate``), or one of the strategy's fitted
parameters, which is then given instead of fitted. Unknown names are refused.

Points are grouped by what they share. Bars are cut and priced once per source, signals
are made once per source and strategy (given parameters are key columns of one plan),
weights once per sizing rule, and costs are columns of one aggregate: rows are never
copied for them. The grid is written by hand, so it is a list on the driver, and the
plans that differ in more than a column are united.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields, is_dataclass, replace
from itertools import product
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.functions.scalars import fee_rate, net_log_return
from barspark.operators import metrics as M
from barspark.operators.prices import with_price
from barspark.operators.returns import evaluate_returns
from barspark.operators.strategies import Strategy
from barspark.plans.evaluate import Run, date_slice
from barspark.series import Series, ensure_positions, stage

Point = dict[str, Any]


def grid(**values: list) -> list[Point]:
    """All combinations; ``__`` in a name stands for a dot."""
    names = [n.replace("__", ".") for n in values]
    return [dict(zip(names, combination)) for combination in product(*values.values())]


def _put(target: Any, path: list[str], value: Any, whole: str) -> Any:
    name, rest = path[0], path[1:]
    if isinstance(target, dict):
        return {**target, name: _put(target.get(name, {}), rest, value, whole) if rest else value}
    if not is_dataclass(target) or name not in {f.name for f in fields(target)}:
        raise ValueError(f"cannot sweep {whole}")
    return replace(target, **{name: _put(getattr(target, name), rest, value, whole) if rest else value})


def settings(point: Point, strategy: Strategy, run: Run) -> tuple[Strategy, Run, tuple]:
    """(strategy, run, given parameters) of a point."""
    given = []
    for path, value in point.items():
        parts = path.split(".")
        own = parts[1:] if parts[0] == "strategy" and len(parts) > 1 else parts
        if len(own) == 1 and own[0] in strategy.params:
            given.append((own[0], value))
        elif parts[0] == "strategy":
            strategy = _put(strategy, own, value, path)
        elif path == "price":
            inner = ["price"] if any(f.name == "price" for f in fields(strategy)) else ["features", "price"]
            strategy = _put(strategy, inner, value, path)
        elif path == "fraction":
            run = replace(run, sizing="fixed_fraction", sizing_params={**run.sizing_params, "fraction": value})
        else:
            run = _put(run, parts, value, path)
    return strategy, run, tuple(sorted(given))


def _grouped(items: list, key: Callable) -> list[tuple[Any, list]]:
    out: dict[str, tuple[Any, list]] = {}
    for item in items:
        out.setdefault(repr(key(item)), (key(item), []))[1].append(item)
    return list(out.values())


def column_of(path: str) -> str:
    """The column that holds the values of a path."""
    return path.replace(".", "_")


def sweep(bars: DataFrame | dict[str, tuple[DataFrame, Series]], spec: Series, strategy: Strategy, run: Run, points: list[Point]) -> DataFrame:
    """Every metric of every point: one row per series and point, the point's values as columns.

    To sweep ``tf``, ``bars`` gives the bars and their series for each time frame.
    """
    resolved = [(i, *settings(p, strategy, run)) for i, p in enumerate(points)]
    sources = bars if isinstance(bars, dict) else {run.tf: (bars, spec)}
    missing = sorted({str(r.tf) for _, _, r, _ in resolved} - set(sources))
    if missing:
        raise ValueError(f"no bars for time frame {', '.join(missing)}")
    parts = []
    for (tf, start, end, price), here in _grouped(resolved, lambda p: (p[2].tf, p[2].start, p[2].end, p[1].price)):
        table, series = sources[tf]
        rows = stage(with_price(ensure_positions(date_slice(table, series, start, end), series), series, price))
        for (chosen, names), same in _grouped(here, lambda p: (p[1], [n for n, _ in p[3]])):
            signals, keyed = _signals(rows, series, chosen, names, [dict(p[3]) for p in same])
            rules = _grouped(same, lambda p: (p[2].sizing, p[2].sizing_params))
            signals = stage(signals) if len(rules) > 1 else signals
            parts += [_scored(signals, keyed, chosen, rule, names) for _, rule in rules]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    for path in dict.fromkeys(n for p in points for n in p):
        values = F.array(*[F.lit(p.get(path)) for p in points])
        out = out.withColumn(column_of(path), F.element_at(values, F.col("point") + 1))
    keys = [k for k in spec.keys]
    first = [*keys, *[column_of(n) for n in dict.fromkeys(n for p in points for n in p)]]
    return out.select(*first, *[c for c in out.columns if c not in (*first, "point")])


def _signals(rows: DataFrame, spec: Series, strategy: Strategy, names: list[str], given: list[Point]) -> tuple[DataFrame, Series]:
    """Signals of one strategy, with given parameters as key columns ``__given_*`` if there are any."""
    if not names:
        return strategy.signals(rows, strategy.fit(rows, spec), spec), spec
    distinct = list({tuple(g[n] for n in names): g for g in given}.values())
    marks = [f"__given_{n}" for n in names]
    literal = F.array(*[F.struct(*[F.lit(g[n]).alias(m) for n, m in zip(names, marks)]) for g in distinct])
    wide = rows.withColumn("__point", F.explode(literal)).select("*", "__point.*").drop("__point")
    keyed = spec.extend(*marks)
    params = wide.select(*keyed.keys).distinct()
    rest = [n for n in strategy.params if n not in names]
    if rest:
        raise ValueError(f"given parameters need {', '.join(rest)} too")
    return strategy.signals(wide, params.withColumns({n: F.col(m) for n, m in zip(names, marks)}), keyed), keyed


def _scored(signals: DataFrame, spec: Series, strategy: Strategy, points: list[tuple], names: list[str]) -> DataFrame:
    """Metrics of points that share signals and sizing: (series keys, ``point``, metrics)."""
    run = points[0][2]
    rows = evaluate_returns(signals.drop("blk"), spec, strategy.price, **run.costs())
    rates = {(r.fee_bps, r.slippage_bps, r.mode): fee_rate(r.fee_bps, r.slippage_bps, r.mode) for _, _, r, _ in points}
    columns = {}
    for j, rate in enumerate(rates.values()):
        columns[f"__cost{j}"] = F.lit(rate) * F.col("turnover")
        columns[f"__net{j}"] = F.col("strategy_simple_r") - F.lit(rate) * F.col("turnover")
        columns[f"__log{j}"] = net_log_return(columns[f"__net{j}"])
    rows = rows.withColumns(columns)
    stats = [
        F.struct(*M.return_stats(run.tf, f"__log{j}", f"__net{j}"), *M.cost_stats(run.tf, f"__cost{j}")).alias(f"__at{j}")
        for j in range(len(rates))
    ]
    each = rows.groupBy(*spec.keys).agg(*stats)
    number = {key: j for j, key in enumerate(rates)}
    told = []
    for i, _, r, given in points:
        mine = F.lit(True)
        for name, value in given:
            mine = mine & (F.col(f"__given_{name}") == F.lit(value))
        at = number[r.fee_bps, r.slippage_bps, r.mode]
        told.append(F.when(mine, F.struct(F.lit(i).alias("point"), F.col(f"__at{at}").alias("at"))))
    keys = [k for k in spec.keys if not k.startswith("__given_")]
    return each.select(*keys, F.explode(F.filter(F.array(*told), lambda t: t.isNotNull())).alias("t")).select(*keys, "t.point", "t.at.*")


def sweep_rows(table: DataFrame, x: str, metric_names: list[str], y: str | None = None) -> DataFrame:
    """Sweep results as text-keyed rows: x_param, x_value, (y_param, y_value), metrics."""
    axes = [F.lit(x).alias("x_param"), F.col(x).cast("string").alias("x_value")]
    if y:
        axes += [F.lit(y).alias("y_param"), F.col(y).cast("string").alias("y_value")]
    rest = [c for c in table.columns if c not in {x, y} and c not in metric_names]
    known = [c for c in rest if table.schema[c].dataType.simpleString() == "string"]
    return table.select(*known, *axes, *metric_names)


def sweep_matrix(table: DataFrame, keys: list[str], x: str, y: str, metric: str, x_values: list) -> DataFrame:
    """Two-dimensional sweep as a matrix: one row per y, one column per x."""
    wide = table.groupBy(*keys, y).pivot(x, x_values).agg(F.first(metric))
    return wide.toDF(*keys, y, *[f"{x}_{str(v).replace('.', '_')}" for v in x_values])
