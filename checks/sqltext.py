"""SQL text of the longer pipelines, as CTE builders over any key list.

Every source is a CTE with the keys, ``ts``, ``pos``, ``n`` (rows in the
series) and prices. ``k`` is a comma list of key columns.
"""

from __future__ import annotations

from checks import r


def over(k: str, frame: str = "") -> str:
    return f"(PARTITION BY {k} ORDER BY pos {frame})"


UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def averages(name: str, src: str, k: str, top: int, price: str = "close") -> str:
    """Adds r and the list ``a`` of all averages 1..top (null before warm-up)."""
    cells = ", ".join(
        f"CASE WHEN pos >= {n - 1} THEN avg({price}) OVER {over(k, f'ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW')} END"
        for n in range(1, top + 1)
    )
    return f"{name} AS (SELECT *, ln(lead({price}) OVER {over(k)}) - ln({price}) AS r, [{cells}] AS a FROM {src})"


def pairs(top: int) -> str:
    return f"pairs AS (SELECT f, s FROM range(1, {top + 1}) x(f), range(1, {top + 1}) y(s) WHERE s > f)"


PF = "CASE WHEN loss > 0 THEN gain / loss WHEN gain > 0 THEN 'Infinity'::DOUBLE ELSE 0 END"


def ma_scores(name: str, src: str, k: str) -> str:
    return f"""{name} AS (SELECT *, {PF} AS pf FROM (SELECT {k}, f AS fast, s AS slow,
    sum(CASE WHEN a[f] > a[s] AND r > 0 THEN r ELSE 0 END) AS gain, sum(CASE WHEN a[f] > a[s] AND r < 0 THEN -r ELSE 0 END) AS loss
    FROM {src}, pairs GROUP BY {k}, f, s))"""


def best(name: str, src: str, k: str, params: str, valid: str = "loss > 0") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY pf DESC, {params}) AS rk
    FROM {src} WHERE pf > 0 AND {valid}) WHERE rk = 1)"""


def ma_signal(name: str, src: str, k: str, best_name: str) -> str:
    """Left joins the best pair; a tie carries."""
    return f"""{name} AS (SELECT * EXCLUDE (raw), last_value(raw IGNORE NULLS) OVER {over(k, UPTO)} AS signal FROM (
    SELECT q.*, b.fast, b.slow, CASE WHEN a[fast] > a[slow] THEN 1.0 WHEN a[fast] < a[slow] THEN -1.0 END AS raw
    FROM {src} q LEFT JOIN {best_name} b USING ({k})))"""


def returns(name: str, src: str, k: str, rate: str = "0.001", price: str = "close", weight: str = "coalesce(signal, 0)::DOUBLE") -> str:
    """The returns and cost block; needs ``signal``."""
    return f"""{name} AS (SELECT * FROM (SELECT *, ln(greatest(1 + net, 1e-12)) AS net_log, r * weight AS gross_log FROM (
    SELECT *, simple_r * weight AS gross, {rate} * turnover AS cost, simple_r * weight - {rate} * turnover AS net FROM (
    SELECT *, abs(weight - coalesce(lag(weight) OVER {over(k)}, 0)) AS turnover FROM (
    SELECT * REPLACE (ln(lead({price}) OVER {over(k)}) - ln({price}) AS r), lead({price}) OVER {over(k)} / {price} - 1 AS simple_r, {weight} AS weight
    FROM {src})))) WHERE r IS NOT NULL)"""


def pf_of(x: str) -> str:
    gain, loss = f"coalesce(sum({x}) FILTER ({x} > 0), 0)", f"coalesce(-sum({x}) FILTER ({x} < 0), 0)"
    return f"CASE WHEN {loss} > 0 THEN {gain} / {loss} WHEN {gain} > 0 THEN 'Infinity'::DOUBLE ELSE 0 END"


def trades(name: str, src: str, k: str) -> str:
    return f"""{name} AS (SELECT {k}, trade_id, min(ts) AS entry_ts, max(ts) AS exit_ts, min_by(weight, pos) AS entry_weight, max_by(weight, pos) AS exit_weight,
    product(1 + gross) - 1 AS gross_return_simple, product(1 + net) - 1 AS net_return_simple, count(*) AS bars, sum(turnover) AS turnover_sum, sum(cost) AS cost_sum
    FROM (SELECT *, sum(CASE WHEN weight <> 0 AND weight <> pw THEN 1 ELSE 0 END) OVER {over(k, UPTO)}::BIGINT AS trade_id FROM (
    SELECT *, coalesce(lag(weight) OVER {over(k)}, 0) AS pw FROM {src})) WHERE weight <> 0 GROUP BY {k}, trade_id)"""


def decomposed(name: str, src: str, k: str) -> str:
    return f"""{name} AS (SELECT *, ln(open) - ln(lag(close) OVER {over(k)}) AS gap, ln(high) - ln(open) AS rel_high, ln(low) - ln(open) AS rel_low,
    ln(close) - ln(open) AS rel_close FROM {src})"""


def permuted(name: str, src: str, k: str, first: int, last: int, start: str = "0") -> list[str]:
    """CTEs ending in ``name``: shuffled bars for seeds first..last; ``start`` is a column or number."""
    return [
        decomposed(f"{name}_d", f"(SELECT *, {start} AS perm_start FROM {src})", k),
        f"{name}_s AS (SELECT d.*, seed FROM {name}_d d, range({first}, {last + 1}) t(seed))",
        f"""{name}_o AS (SELECT *, perm_start + row_number() OVER (PARTITION BY {k}, seed ORDER BY md5(seed || ':bar:' || pos)) AS bar_to,
        perm_start + row_number() OVER (PARTITION BY {k}, seed ORDER BY md5(seed || ':gap:' || pos)) AS gap_to FROM {name}_s WHERE pos > perm_start)""",
        f"""{name}_m AS (SELECT s.* EXCLUDE (gap, rel_high, rel_low, rel_close), x.rel_high, x.rel_low, x.rel_close, y.gap FROM {name}_s s
        LEFT JOIN (SELECT {k}, seed, bar_to AS pos, rel_high, rel_low, rel_close FROM {name}_o) x USING ({k}, seed, pos)
        LEFT JOIN (SELECT {k}, seed, gap_to AS pos, gap FROM {name}_o) y USING ({k}, seed, pos))""",
        f"""{name}_c AS (SELECT *, sum(CASE WHEN pos = perm_start THEN ln(close) WHEN pos > perm_start THEN gap + rel_close END)
        OVER (PARTITION BY {k}, seed ORDER BY pos ROWS UNBOUNDED PRECEDING) AS lc FROM {name}_m)""",
        f"""{name} AS (SELECT {k}, seed, ts, pos, n, volume, CASE WHEN pos > perm_start THEN exp(lc - rel_close) ELSE open END AS open,
        CASE WHEN pos > perm_start THEN exp(lc - rel_close + rel_high) ELSE high END AS high,
        CASE WHEN pos > perm_start THEN exp(lc - rel_close + rel_low) ELSE low END AS low,
        CASE WHEN pos > perm_start THEN exp(lc) ELSE close END AS close FROM {name}_c)""",
    ]


def walk(prefix: str, src: str, k: str, length: int, step: int, top: int) -> list[str]:
    """CTEs ending in ``{prefix}_sig``: walk-forward signals of the crossover (needs ``averages`` output ``src``)."""
    return [
        f"""{prefix}_train AS (SELECT q.* REPLACE (CASE WHEN pos < fold * {step} + {length} - 1 THEN r END AS r,
        list_transform(range(1, {top + 1}), lambda w: CASE WHEN pos - fold * {step} >= w - 1 THEN a[w] END) AS a), fold FROM {src} q,
        range(0, 100000) f(fold) WHERE fold * {step} <= pos AND pos < fold * {step} + {length} AND fold < ceil((n - {length}) / {step}))""",
        ma_scores(f"{prefix}_sc", f"{prefix}_train", f"{k}, fold"),
        best(f"{prefix}_best", f"{prefix}_sc", f"{k}, fold", "fast, slow"),
        f"""{prefix}_sig AS (SELECT q.*, b.fast, b.slow, b.pf AS metric, CASE WHEN a[b.fast] > a[b.slow] THEN 1.0 WHEN a[b.fast] < a[b.slow] THEN -1.0 END AS signal
        FROM (SELECT *, CASE WHEN pos >= {length} THEN ((pos - {length}) // {step}) END AS fold FROM {src}) q LEFT JOIN {prefix}_best b USING ({k}, fold))""",
    ]


def donchian(prefix: str, src: str, k: str, high: int, start: str = "0") -> list[str]:
    """CTEs ending in ``{prefix}_sc``: held signals ``s`` of every lookback 2..high in ``{prefix}_sg``, and their scores (needs ``r``).

    Windows begin at position ``start``.
    """
    edge = lambda f, lb: f"{f}(close) OVER {over(k, f'ROWS BETWEEN {lb - 1} PRECEDING AND 1 PRECEDING')}"
    cells = ", ".join(
        f"CASE WHEN pos - {start} >= {lb - 1} THEN CASE WHEN close < {edge('min', lb)} THEN -1.0 WHEN close > {edge('max', lb)} THEN 1.0 END END" for lb in range(2, high + 1)
    )
    return [
        f"{prefix}_raw AS (SELECT *, [{cells}] AS raws FROM {src})",
        f"""{prefix}_sg AS (SELECT *, last_value(raw IGNORE NULLS) OVER (PARTITION BY {k}, lookback ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s
        FROM (SELECT * EXCLUDE (raws), unnest(range(2, {high + 1})) AS lookback, unnest(raws) AS raw FROM {prefix}_raw))""",
        f"""{prefix}_sc AS (SELECT *, {PF} AS pf FROM (SELECT {k}, lookback, coalesce(sum(s * r) FILTER (s * r > 0), 0) AS gain,
        coalesce(-sum(s * r) FILTER (s * r < 0), 0) AS loss FROM {prefix}_sg GROUP BY {k}, lookback))""",
    ]


def p_value(name: str, pfs: str, real: str, k: str) -> str:
    return f"""{name} AS (SELECT {k}, any_value(real_pf) AS real_pf, count(*) AS draws, count(*) FILTER (pf >= real_pf) AS better,
    (count(*) FILTER (pf >= real_pf) + 1) / (count(*) + 1) AS p_value FROM {pfs} JOIN {real} USING ({k}) GROUP BY {k})"""


__all__ = [
    "averages", "best", "decomposed", "donchian", "ma_scores", "ma_signal", "over", "p_value", "pairs", "permuted", "pf_of", "r",
    "returns", "trades", "walk",
]
