"""Monte-Carlo permutation tests: the evaluation plans with a seed as one more key."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.functions.scalars import json_safe
from barspark.operators import metrics as M
from barspark.operators.permute import permutation_start, permuted_bars
from barspark.operators.prices import with_price
from barspark.operators.report import report_runs
from barspark.operators.significance import p_value
from barspark.operators.strategies import Strategy
from barspark.plans.evaluate import Run, date_slice, in_sample_returns, walk_forward_returns
from barspark.series import Running, Series, ensure_positions, positions, running, stage


# Seed of the real history among the shuffles.
REAL = -1


def _score(rows: DataFrame, spec: Series, name: str, net: bool = True) -> DataFrame:
    column = "strategy_r_net" if net else "strategy_r"
    return rows.groupBy(*spec.keys).agg(M.profit_factor(column).alias(name))


def _with_real(shuffled: DataFrame, real: DataFrame, spec: Series) -> DataFrame:
    """The real history as one more seed, so that one pipeline scores it along with the shuffles."""
    same = [c for c in shuffled.columns if c not in (*spec.keys, "seed")]
    return shuffled.unionByName(real.select(*spec.keys, F.lit(REAL).cast("long").alias("seed"), *same))


def _split(scores: DataFrame, spec: Series) -> tuple[DataFrame, DataFrame]:
    """(shuffled factors, real factor) of a staged score table."""
    real = scores.filter(F.col("seed") == REAL).select(*spec.keys, F.col("pf").alias("real_pf"))
    return scores.filter(F.col("seed") != REAL), real


def in_sample_test(
    bars: DataFrame,
    spec: Series,
    strategy: Strategy,
    run: Run,
    n_perm: int,
    perm_start: int = 0,
    slice_first: bool = False,
    metric: str = "net_pf",
    stored_price: bool = False,
    seeds: list[int] | None = None,
    histories: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(shuffled factors per seed, test result). Draws ``n_perm - 1`` shuffles, seeds 1 .. n_perm-1.

    ``histories`` may pass the table of ``shuffled_histories``, so that several strategies share one.

    The full history is shuffled and then cut to the dates; ``slice_first``
    cuts first. ``metric`` ``opt_pf`` compares the factor the fit reached
    (gross, no costs) instead of the net factor. Derived prices are derived
    anew on both sides; ``stored_price`` takes the stored column on real bars.
    """
    seeds = list(range(1, n_perm)) if seeds is None else seeds
    keyed = spec.extend("seed")

    def score(table: DataFrame, by: Series) -> DataFrame:
        if metric == "opt_pf":
            return _fit_metric(table, by, strategy, run)
        return _score(in_sample_returns(table, by, strategy, run), by, "pf")

    if stored_price and strategy.price in bars.columns:
        source = stage(positions(date_slice(bars, spec, run.start, run.end) if slice_first else bars, spec))
        real = score(bars, spec).withColumnRenamed("pf", "real_pf")
        pfs = stage(score(stage(permuted_bars(source, spec, seeds, perm_start)), keyed))
    else:
        histories = shuffled_histories(bars, spec, run, seeds, perm_start, slice_first) if histories is None else histories
        pfs, real = _split(stage(score(histories, keyed)), spec)
    return pfs, p_value(pfs, real, spec, "in_sample")


def shuffled_histories(bars: DataFrame, spec: Series, run: Run, seeds: list[int], perm_start: int = 0, slice_first: bool = False) -> DataFrame:
    """The shuffles and, as seed ``REAL``, the real history, staged."""
    source = stage(positions(date_slice(bars, spec, run.start, run.end) if slice_first else bars, spec))
    return stage(_with_real(permuted_bars(source, spec, seeds, perm_start), source, spec))


def _fit_metric(bars: DataFrame, spec: Series, strategy: Strategy, run: Run) -> DataFrame:
    rows = ensure_positions(date_slice(bars, spec, run.start, run.end), spec)
    fitted = strategy.fit(with_price(rows, spec, strategy.price), spec)
    return fitted.select(*spec.keys, F.coalesce("metric", F.lit(0.0)).alias("pf"))


def walk_forward_test(
    bars: DataFrame,
    spec: Series,
    strategy: Strategy,
    run: Run,
    length: int,
    step: int,
    n_perm: int,
    net: bool = True,
    stored_price: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(shuffled out-of-sample factors, test result). Shuffles only bars after the first training window."""
    keyed = spec.extend("seed")
    source = stage(positions(bars, spec))
    start = permutation_start(source, spec, run.start, length) if run.start else length
    shuffled = permuted_bars(source, spec, n_perm, start)

    def score(table: DataFrame, by: Series) -> DataFrame:
        return _score(walk_forward_returns(table, by, strategy, run, length, step), by, "pf", net)

    if stored_price and strategy.price in bars.columns:
        real = score(source, spec).withColumnRenamed("pf", "real_pf")
        pfs = stage(score(stage(shuffled), keyed))
    else:
        pfs, real = _split(stage(score(stage(_with_real(shuffled, source, spec)), keyed)), spec)
    return pfs, p_value(pfs, real, spec, "oos")


def permutation_curves(
    bars: DataFrame, spec: Series, strategy: Strategy, run: Run, length: int, step: int, n_perm: int
) -> DataFrame:
    """Cumulative walk-forward log return of every shuffle, as a long table (series, seed, ts, cum)."""
    keyed = spec.extend("seed")
    shuffled = permuted_bars(stage(positions(bars, spec)), spec, n_perm, length)
    rows = stage(walk_forward_returns(stage(shuffled), keyed, strategy, replace(run, start=None, end=None), length, step))
    out = running(rows, keyed, {"cum": Running("sum", F.col("strategy_r"))})
    return out.select(*keyed.by(spec.ts, "cum"))


def curves_wide(curves: DataFrame, spec: Series, n_perm: int) -> DataFrame:
    """One column per shuffle."""
    wide = curves.groupBy(*spec.by(spec.ts)).pivot("seed", list(range(n_perm))).agg(F.first("cum"))
    return wide.withColumnsRenamed({str(i): f"perm_{i}" for i in range(n_perm)})


def compare_strategies(
    bars: DataFrame, spec: Series, strategies: dict[str, Strategy], run: Run, n_perm: int
) -> DataFrame:
    """Fit factor, p-value and significance of several strategies on the same shuffles."""
    parts = []
    histories = shuffled_histories(bars, spec, run, list(range(1, n_perm)), slice_first=True)
    for name, strategy in strategies.items():
        _, result = in_sample_test(bars, spec, strategy, run, n_perm, metric="opt_pf", slice_first=True, histories=histories)
        parts.append(result.withColumn("strategy", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def full_analysis(
    bars: DataFrame, spec: Series, strategies: dict[str, Strategy], run: Run, n_perm: int
) -> tuple[DataFrame, DataFrame]:
    """(market against strategy per strategy, comparison with significance)."""
    tables = []
    for name, strategy in strategies.items():
        rows = stage(in_sample_returns(bars, spec, strategy, run))
        tables.append(M.compare_market(rows, spec).withColumn("strategy", F.lit(name)))
    return reduce(DataFrame.unionByName, tables), compare_strategies(bars, spec, strategies, run, n_perm)


def test_report(pfs: DataFrame, result: DataFrame, rows: DataFrame, spec: Series, params: dict, run_type: str) -> tuple[DataFrame, DataFrame]:
    """Report of a permutation test as two tables: one row per run with its metrics, one row per run and shuffle.

    ``pfs`` and ``result`` come from a test, ``rows`` is the returns block of the real history.
    """
    keys = list(spec.keys)
    gross = rows.groupBy(*keys).agg(M.profit_factor("strategy_r").alias("pf_gross"))
    metrics = result.join(gross, keys).select(*keys, "pf_gross", F.col("real_pf").alias("pf_net"), F.col("p_value").alias("p_value_net"))
    shuffles = pfs.select(*keys, F.lit(run_type).alias("run_type"), "seed", json_safe("pf").alias("permutation_pf_net"))
    return report_runs(metrics, spec, params, run_type), shuffles
