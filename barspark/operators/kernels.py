"""Numpy scoring kernels for one bounded stretch of one series.

Spark decides which stretch (a padded block, or the bars of a few folds) and
merges the partial sums; the kernels only do dense arithmetic.
"""

from __future__ import annotations

import numpy as np

#: Factors that differ by this share are equal: sums of equal terms may differ in their last digits.
TIE = 1e-12


def ma_pairs(max_window: int, min_window: int = 1) -> list[tuple[int, int]]:
    """All fast < slow pairs in search order: fast first, then slow."""
    return [(f, s) for f in range(min_window, max_window + 1) for s in range(f + 1, max_window + 1)]


def moving_averages(price: np.ndarray, pos: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """One column per window; NaN where fewer than that many bars of the series exist.

    Every frame is summed from its oldest bar to its newest, as an average over
    a row frame is, so equal averages tie here exactly when they tie there, and
    prices may span many orders of magnitude, as shuffled histories do.
    """
    n = len(price)
    out = np.full((n, len(windows)), np.nan)
    for j, w in enumerate(windows):
        if w <= n:
            total = np.zeros(n - w + 1)
            for back in range(w):
                total += price[back : back + n - w + 1]
            out[w - 1 :, j] = total / w
            out[pos < w - 1, j] = np.nan
    return out


def average_at(price: np.ndarray, pos: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Average over the last ``window[i]`` bars at row i; NaN before warm-up or without a window."""
    out = np.full(len(price), np.nan)
    for w in np.unique(window[~np.isnan(window)]).astype(np.int64):
        mine = np.flatnonzero((window == w) & (pos >= w - 1) & (np.arange(len(price)) >= w - 1))
        if w >= 1 and len(mine):
            total = np.zeros(len(mine))
            for back in range(w - 1, -1, -1):
                total += price[mine - back]
            out[mine] = total / w
    return out


def prior_extremes(price: np.ndarray, m: int, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Extend the running extremes of the prior m-1 bars to the prior m bars."""
    shifted = np.full(len(price), np.nan)
    shifted[m:] = price[:-m] if m else price
    return np.maximum(upper, shifted), np.minimum(lower, shifted)


def breakouts(price: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """1 above the prior range, -1 below (below wins), 0 inside or before warm-up."""
    with np.errstate(invalid="ignore"):
        raw = np.where(price > upper, 1.0, 0.0)
        return np.where(price < lower, -1.0, raw)


def held(raw: np.ndarray) -> np.ndarray:
    """Carry the last non-zero value; 0 before the first."""
    last = np.maximum.accumulate(np.where(raw != 0, np.arange(len(raw)), -1))
    return np.where(last >= 0, raw[np.maximum(last, 0)], 0.0)


def ratio(gain: np.ndarray, loss: np.ndarray, lossless: float) -> np.ndarray:
    """Profit factor with the value to use for a gain without loss."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(loss > 0, gain / np.where(loss > 0, loss, 1.0), np.where(gain > 0, lossless, 0.0))


def split_returns(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive and negative parts of the forward log return; 0 where there is none."""
    r = np.zeros(len(price))
    with np.errstate(divide="ignore", invalid="ignore"):
        r[:-1] = np.diff(np.log(price))
    r[~np.isfinite(r)] = 0.0
    return np.maximum(r, 0.0), np.maximum(-r, 0.0)


def ma_block_scores(price, pos, up, down, core, max_window, min_window=1):
    """Gain and loss of the long/flat rule over the core rows, for every pair in search order."""
    windows = np.arange(min_window, max_window + 1)
    averages = moving_averages(price, pos, windows)[core]
    moves = np.stack([up[core], down[core]])
    gain, loss = np.zeros((len(windows),) * 2), np.zeros((len(windows),) * 2)
    for j in range(1, len(windows)):
        with np.errstate(invalid="ignore"):
            above = averages[:, :j] > averages[:, j : j + 1]
        gain[:j, j], loss[:j, j] = moves @ above.astype(np.float64)
    pick = np.triu_indices(len(windows), 1)
    return windows[pick[0]], windows[pick[1]], gain[pick], loss[pick]


def donchian_block_scores(price, pos, up, down, core, low, high):
    """Per lookback: sums before and after the first break in the block, and the state at its end.

    Before the first break the state comes from an earlier block, so those rows
    report both what a long and what a short would have gained.
    """
    first, last = np.flatnonzero(core)[[0, -1]]
    upper = np.full(len(price), -np.inf)
    lower = np.full(len(price), np.inf)
    rows = []
    for m in range(1, high):
        upper, lower = prior_extremes(price, m, upper, lower)
        if m + 1 < low:
            continue
        raw = breakouts(price, upper, lower)
        raw[pos < m] = 0.0
        raw = raw[first : last + 1]
        u, d = up[first : last + 1], down[first : last + 1]
        state = held(raw)
        open_ = state == 0
        gain = np.where(state > 0, u, np.where(state < 0, d, 0.0)).sum()
        loss = np.where(state > 0, d, np.where(state < 0, u, 0.0)).sum()
        rows.append((m + 1, u[open_].sum(), d[open_].sum(), gain, loss, state[-1] if state[-1] else np.nan))
    return rows


def ma_fold_fits(price: np.ndarray, folds: list[tuple[int, int, int]], max_window: int, min_window: int = 1):
    """Best pair per fold from shared prefix sums: each bar is scored once, not once per fold."""
    windows = np.arange(min_window, max_window + 1)
    averages = moving_averages(price, np.arange(len(price)), windows)
    up, down = split_returns(price)
    starts = np.array([f[0] for f in folds])
    ends = np.array([f[1] for f in folds]) - 1  # the last training bar has no return
    best = np.zeros(len(folds))
    chosen = np.full((len(folds), 2), np.nan)
    size = len(windows)
    gain = np.zeros((len(folds), size, size))
    loss = np.zeros((len(folds), size, size))
    zero = np.zeros((1, size))
    for j in range(1, size):
        with np.errstate(invalid="ignore"):
            above = averages[:, :j] > averages[:, j : j + 1]
        g = np.concatenate([zero[:, :j], np.cumsum(above * up[:, None], axis=0)])
        d = np.concatenate([zero[:, :j], np.cumsum(above * down[:, None], axis=0)])
        begin = np.minimum(starts + windows[j] - 1, ends)
        gain[:, :j, j] = g[ends] - g[begin]
        loss[:, :j, j] = d[ends] - d[begin]
    pick = np.triu_indices(size, 1)
    scores = ratio(gain[:, pick[0], pick[1]], loss[:, pick[0], pick[1]], 0.0)
    near = scores >= scores.max(axis=1, keepdims=True, initial=-np.inf) * (1 - TIE)
    top = near.argmax(axis=1) if scores.size else np.zeros(len(folds), int)
    for k in range(len(folds)):
        if scores.size and scores[k, top[k]] > 0:
            best[k] = scores[k, top[k]]
            chosen[k] = windows[pick[0][top[k]]], windows[pick[1][top[k]]]
    return chosen, best


def ma_signal(price: np.ndarray, fast: float, slow: float) -> np.ndarray:
    """Long/short crossover with ties carried; NaN before warm-up or without parameters."""
    if np.isnan(fast) or np.isnan(slow):
        return np.full(len(price), np.nan)
    averages = moving_averages(price, np.arange(len(price)), np.sort([int(fast), int(slow)]))
    with np.errstate(invalid="ignore"):
        raw = np.sign(averages[:, 0] - averages[:, 1])
    state = held(np.nan_to_num(raw))
    return np.where(state == 0, np.nan, state)


def donchian_fold_fits(
    price: np.ndarray, folds: list[tuple[int, int, int]], low: int, high: int, lossless: float = np.inf
):
    """Best lookback per fold; a fold's state starts at the first break inside the fold."""
    up, down = split_returns(price)
    n = len(price)
    starts = np.array([f[0] for f in folds])
    ends = np.array([f[1] for f in folds]) - 1
    best, chosen = np.zeros(len(folds)), np.full(len(folds), np.nan)
    upper, lower = np.full(n, -np.inf), np.full(n, np.inf)
    for m in range(1, high):
        upper, lower = prior_extremes(price, m, upper, lower)
        if m + 1 < low:
            continue
        raw = breakouts(price, upper, lower)
        state = held(raw)
        g = np.concatenate([[0.0], np.cumsum(np.where(state > 0, up, np.where(state < 0, down, 0.0)))])
        d = np.concatenate([[0.0], np.cumsum(np.where(state > 0, down, np.where(state < 0, up, 0.0)))])
        hits = np.flatnonzero(raw)
        nxt = np.searchsorted(hits, starts + m)
        begin = np.where(nxt < len(hits), hits[np.minimum(nxt, len(hits) - 1)] if len(hits) else n, n)
        begin = np.minimum(begin, ends)
        score = ratio(g[ends] - g[begin], d[ends] - d[begin], lossless)
        better = score > best * (1 + TIE)
        best[better], chosen[better] = score[better], m + 1
    return chosen, best


def donchian_signal(price: np.ndarray, lookback: float) -> np.ndarray:
    if np.isnan(lookback):
        return np.full(len(price), np.nan)
    raw = breakouts(price, *_range_before(price, int(lookback) - 1))
    state = held(raw)
    return np.where(state == 0, np.nan, state)


def _range_before(price: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(price)
    upper, lower = np.full(n, np.nan), np.full(n, np.nan)
    if m < n:
        views = np.lib.stride_tricks.sliding_window_view(price, m)[: n - m]
        upper[m:], lower[m:] = views.max(axis=1), views.min(axis=1)
    return upper, lower


def donchian_raw_at(price: np.ndarray, pos: np.ndarray, lookback: np.ndarray) -> np.ndarray:
    """Breakout mark at each row for that row's own lookback; NaN inside the range."""
    out = np.full(len(price), np.nan)
    for lb in np.unique(lookback[~np.isnan(lookback)]):
        raw = breakouts(price, *_range_before(price, int(lb) - 1))
        raw[pos < lb - 1] = 0.0
        mine = lookback == lb
        out[mine] = np.where(raw[mine] == 0, np.nan, raw[mine])
    return out
