"""Features, labels and learned strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.operators import features as X
from barspark.operators.folds import walk_forward_signals
from barspark.operators.forecaster import Forecaster
from barspark.operators.direction import DirectionClassifier
from barspark.operators.models import fit_logistic
from barspark.operators.networks import Training
from barspark.plans import evaluate as E
from barspark.plans import montecarlo as MC
from barspark.series import positions, stage
from checks import DAILY, FOUR_HOURS, bars1, bars2, bars3, check, frame, keep, r, rounded, sql, table
from checks import W as OVER
from checks.windows import _full

FS = X.FeatureSet(tf="1d", vol_hours=480, horizon_hours=72, sma=(5, 10), momentum=(7, 14), rsi=(7,), regime_window=10)

_NR = f"""nr AS (SELECT *, CASE WHEN count(ret) OVER {frame(19)} >= 3 THEN stddev_samp(ret) OVER {frame(19)} END AS vol FROM (
SELECT *, close / lag(close) OVER {OVER} - 1 AS ret, close - lag(close) OVER {OVER} AS d FROM p1)),
nn AS (SELECT *, greatest(least(coalesce(ret / (vol + 1e-8), 0), 5), -5) AS norm_return FROM nr)"""


@check("l01_normalised_return", sql(_NR, f"SELECT symbol, ts, {r('norm_return', 'norm_return')} FROM nn"))
def l01_normalised_return(spark, sf):
    return keep(X.normalised_return(bars1(spark, sf), DAILY, FS), "symbol", "ts", "norm_return")


_FT = f"""f0 AS (SELECT *, {_full('avg(close)', 5)} AS s5, {_full('avg(close)', 10)} AS s10, lag(close, 7) OVER {OVER} AS c7, lag(close, 14) OVER {OVER} AS c14,
{_full('avg(greatest(d, 0))', 7, what='d')} AS g, {_full('avg(greatest(-d, 0))', 7, what='d')} AS l, {_full('stddev_samp(ret)', 10, what='ret')} AS rv FROM nn),
f1 AS (SELECT *, {_full('quantile_cont(rv, 0.5)', 20, what='rv')} AS rvm FROM f0),
ft AS (SELECT *, greatest(least(coalesce(close / s5 - 1, 0), 1), -1) AS sma_5, greatest(least(coalesce(close / s10 - 1, 0), 1), -1) AS sma_10,
greatest(least(coalesce(close / c7 - 1, 0), 1), -1) AS mom_7, greatest(least(coalesce(close / c14 - 1, 0), 1), -1) AS mom_14,
coalesce((100 - 100 / (1 + g / (l + 1e-8)) - 50) / 50, 0) AS rsi_7, coalesce(rv > rvm, false)::DOUBLE AS vol_regime FROM f1)"""


def _feat(spark, sf):
    return X.features(X.normalised_return(bars1(spark, sf), DAILY, FS), DAILY, FS)


@check("l02_features", sql(_NR, _FT, f"SELECT symbol, ts, {', '.join(r(n, n) for n in FS.names)} FROM ft"))
def l02_features(spark, sf):
    return keep(_feat(spark, sf), "symbol", "ts", *FS.names)


_SC = ", ".join(f"avg({n}) AS {n}_m, CASE WHEN stddev_samp({n}) = 0 THEN 1e-8 ELSE stddev_samp({n}) END AS {n}_s" for n in FS.names)


@check("a16_scaling", sql(_NR, _FT, f"sc AS (SELECT symbol, {_SC} FROM ft GROUP BY symbol)", "SELECT symbol, " + ", ".join(f"{r(f'{n}_m', f'{n}__mean')}, {r(f'{n}_s', f'{n}__std')}" for n in FS.names) + " FROM sc"))
def a16_scaling(spark, sf):
    return rounded(X.scaling(_feat(spark, sf), DAILY, FS.names))


@check("l03_standardise", sql(_NR, _FT, f"sc AS (SELECT symbol, {_SC} FROM ft GROUP BY symbol)", "SELECT symbol, ts, " + ", ".join(r(f"coalesce(greatest(least(({n} - {n}_m) / {n}_s, 10), -10), 0)", n) for n in FS.names) + " FROM ft JOIN sc USING (symbol)"))
def l03_standardise(spark, sf):
    rows = stage(_feat(spark, sf))
    return keep(X.standardise(rows, X.scaling(rows, DAILY, FS.names), DAILY, FS.names), "symbol", "ts", *FS.names)


@check(
    "l04_quantile_labels",
    sql(
        _NR, f"fr AS (SELECT symbol, ts, lead(norm_return, 3) OVER {OVER} AS f FROM nn)", "ed AS (SELECT symbol, quantile_cont(f, [0.2, 0.4, 0.6, 0.8]) AS e FROM fr WHERE f IS NOT NULL GROUP BY symbol)",
        "SELECT symbol, ts, len(list_filter(e, lambda q: q <= f))::INT AS label FROM fr JOIN ed USING (symbol) WHERE f IS NOT NULL",
    ),
)
def l04_quantile_labels(spark, sf):
    rows = X.future_return(X.normalised_return(bars1(spark, sf), DAILY, FS), DAILY, FS.horizon_bars)
    return X.quantile_labels(rows, X.label_edges(rows, DAILY, 5), DAILY).select("symbol", "ts", "label")


@check("a17_score_thresholds", f"SELECT event_type AS symbol, {r('quantile_cont(value, 0.1)', 'score_low')}, {r('quantile_cont(value, 0.9)', 'score_high')} FROM events GROUP BY 1")
def a17_score_thresholds(spark, sf):
    e = table(spark, sf, "events").withColumn("symbol", F.col("event_type"))
    return rounded(X.score_thresholds(e, DAILY, "value"))


@check(
    "l06_scored_signals",
    sql(
        "e AS (SELECT symbol, ts, pos, close / open - 1 AS score FROM p1), t AS (SELECT symbol, quantile_cont(score, 0.1) AS lo, quantile_cont(score, 0.9) AS hi FROM e GROUP BY symbol)",
        "s AS (SELECT e.symbol, ts, pos, CASE WHEN score < lo THEN -1.0 WHEN score > hi THEN 1.0 ELSE 0.0 END AS s FROM e JOIN t USING (symbol))",
        f"SELECT symbol, ts, coalesce(last_value(nullif(s, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING), 0)::DOUBLE AS signal FROM s",
    ),
)
def l06_scored_signals(spark, sf):
    rows = positions(bars1(spark, sf), DAILY).withColumn("score", F.col("close") / F.col("open") - 1)
    thresholds = X.score_thresholds(rows, DAILY, "score")
    return X.scored_signals(rows, thresholds, DAILY, "score", hold=True).select("symbol", "ts", "signal")


_L7 = f"""x AS (SELECT symbol, ts, pos, close, volume, close - lag(close) OVER {OVER} AS d FROM p1),
g AS (SELECT symbol, ts, pos, close, {_full('avg(greatest(d, 0))', 14, what='d')} AS g, {_full('avg(greatest(-d, 0))', 14, what='d')} AS l, {_full('avg(volume)', 10, what='volume')} AS v FROM x),
em AS (SELECT a.symbol, a.ts, sum(CASE WHEN b.pos = 0 THEN b.close ELSE b.close * 2 / 21 END * pow(19.0 / 21, a.pos - b.pos)) / any_value(a.close) AS e FROM p1 a JOIN p1 b ON a.symbol = b.symbol AND b.pos <= a.pos GROUP BY a.symbol, a.ts),
l7 AS (SELECT g.symbol, g.ts, pos, CASE WHEN l = 0 AND g > 0 THEN 100 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END AS rsi, e, v FROM g JOIN em USING (symbol, ts))"""


@check("l07_direction_features", sql(_L7, f"SELECT symbol, ts, {r('rsi', 'rsi')}, {r('e', 'ema_ratio')}, {r('v', 'avg_volume')} FROM l7"))
def l07_direction_features(spark, sf):
    out = X.direction_features(bars1(spark, sf), DAILY, "close", (14,), (20,), (10,))
    return rounded(out.select("symbol", "ts", F.col("RSI_14").alias("rsi"), (F.col("EMA_20") / F.col("close")).alias("ema_ratio"), F.col("VOL_AVG_10").alias("avg_volume")))


_OW = "(PARTITION BY symbol ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@check("l09_impute", sql(_L7, f"SELECT symbol, ts, {r(f'first_value(rsi IGNORE NULLS) OVER {_OW}', 'rsi')}, {r(f'first_value(v IGNORE NULLS) OVER {_OW}', 'avg_volume')} FROM l7"))
def l09_impute(spark, sf):
    out = X.direction_features(bars1(spark, sf), DAILY, "close", (14,), (20,), (10,))
    out = X.impute_both_ways(out, DAILY, ["RSI_14", "VOL_AVG_10"])
    return rounded(out.select("symbol", "ts", F.col("RSI_14").alias("rsi"), F.col("VOL_AVG_10").alias("avg_volume")))


@check("l08_logistic_fits", None)
def l08_logistic_fits(spark, sf):
    e = table(spark, sf, "lineitem")
    rows = e.select("l_returnflag", (F.col("l_discount") > 0.05).cast("int").alias("y"), "l_quantity", "l_tax")
    return fit_logistic(rows, ["l_returnflag"], "y", ["l_quantity", "l_tax"])


@check("l08_direction_classifier", None)
def l08_direction_classifier(spark, sf):
    model = DirectionClassifier(rsi=(14, 21), ema=(20,), vol=(10,))
    rows = positions(bars1(spark, sf), DAILY)
    return model.signals(rows, model.fit(rows, DAILY), DAILY).select("symbol", "ts", "signal")


@check("l05_l06_forecaster", None)
def l05_l06_forecaster(spark, sf):
    model, rows = Forecaster(FS, Training(hidden=8, epochs=15)), positions(bars1(spark, sf), DAILY)
    return model.signals(rows, model.fit(rows, DAILY), DAILY).select("symbol", "ts", "score", "signal")


# One epoch of one batch without dropout can be said in SQL: weights from md5, forward pass, gradient, first step, scores, thresholds.
ONE = Training(hidden=3, dropout=0.0, epochs=1, rate=0.05, decay=0.1, batch=1 << 30)
_D, _H, _C = len(FS.names), ONE.hidden, ONE.classes


def _normal(first: int) -> str:
    return f"(('0x' || substr(md5('{ONE.seed}:' || k), {first}, 8))::BIGINT + 0.5) / 4294967296"


def _forward(weights: str, x: str = "x") -> str:
    """before, hidden, logits of a row from lists w1 (h lists of d), b1, w2 (c lists of h), b2."""
    return f"""SELECT *, list_transform(logits, lambda l: exp(l) / list_sum(list_transform(logits, lambda q: exp(q)))) AS p FROM (
    SELECT *, list_transform(range(1, {_C + 1}), lambda c: list_dot_product(w2[c], hidden) + b2[c]) AS logits FROM (
    SELECT *, list_transform(before, lambda v: greatest(v, 0.0)) AS hidden FROM (
    SELECT *, list_transform(range(1, {_H + 1}), lambda j: list_dot_product(w1[j], {x}) + b1[j]) AS before FROM {weights})))"""


_STEP = f"w * {1 - ONE.rate * ONE.decay} - {ONE.rate} * g / (abs(g) + 1e-8)"
_PREFER = "p[4] + p[5] - p[1] - p[2]"
_X = ", ".join(f"coalesce(greatest(least(({n} - {n}_m) / {n}_s, 10), -10), 0)" for n in FS.names)
_ONE_EPOCH = [
    _NR,
    _FT,
    "cut AS (SELECT *, floor(n * 0.8) AS edge, CASE WHEN pos + 3 < floor(n * 0.8) THEN lead(norm_return, 3) OVER (PARTITION BY symbol ORDER BY pos) END AS f FROM ft)",
    f"sc AS (SELECT symbol, {_SC} FROM cut WHERE pos < edge GROUP BY symbol)",
    "ed AS (SELECT symbol, quantile_cont(f, [0.2, 0.4, 0.6, 0.8]) AS e FROM cut WHERE f IS NOT NULL GROUP BY symbol)",
    f"rw AS (SELECT symbol, ts, f, len(list_filter(e, lambda q: q <= f)) AS label, [{_X}] AS x FROM cut JOIN sc USING (symbol) JOIN ed USING (symbol))",
    f"z AS (SELECT k, sqrt(-2 * ln({_normal(1)})) * cos(2 * pi() * ({_normal(9)})) AS z FROM range(0, {_D * _H + _H * _C}) t(k))",
    f"z1 AS (SELECT k // {_H} AS i, k % {_H} AS j, z * sqrt(2.0 / {_D + _H}) AS w FROM z WHERE k < {_D * _H})",
    f"z2 AS (SELECT (k - {_D * _H}) // {_C} AS j, (k - {_D * _H}) % {_C} AS c, z * sqrt(2.0 / {_H + _C}) AS w FROM z WHERE k >= {_D * _H})",
    f"""w0 AS (SELECT (SELECT list(w ORDER BY j) FROM (SELECT j, list(w ORDER BY i) AS w FROM z1 GROUP BY j)) AS w1, list_transform(range({_H}), lambda j: 0.0) AS b1,
    (SELECT list(w ORDER BY c) FROM (SELECT c, list(w ORDER BY j) AS w FROM z2 GROUP BY c)) AS w2, list_transform(range({_C}), lambda c: 0.0) AS b2)""",
    f"fw AS ({_forward('(SELECT * FROM rw, w0 WHERE f IS NOT NULL)')})",
    f"dl AS (SELECT *, list_transform(range(0, {_C}), lambda c: p[c + 1] - (label = c)::INT) AS d FROM fw)",
    f"bk AS (SELECT *, list_transform(range(1, {_H + 1}), lambda j: CASE WHEN before[j] > 0 THEN list_dot_product(d, list_transform(w2, lambda w: w[j])) ELSE 0 END) AS b FROM dl)",
    "g1 AS (SELECT symbol, i, j, avg(x[i + 1] * b[j + 1]) AS g FROM bk, (SELECT DISTINCT i, j FROM z1) GROUP BY ALL)",
    "h1 AS (SELECT symbol, j, avg(b[j + 1]) AS g, 0.0 AS w FROM bk, (SELECT DISTINCT j FROM z1) GROUP BY ALL)",
    "g2 AS (SELECT symbol, j, c, avg(hidden[j + 1] * d[c + 1]) AS g FROM bk, (SELECT DISTINCT j, c FROM z2) GROUP BY ALL)",
    "h2 AS (SELECT symbol, c, avg(d[c + 1]) AS g, 0.0 AS w FROM bk, (SELECT DISTINCT c FROM z2) GROUP BY ALL)",
    f"""nw AS (SELECT symbol, n1 AS w1, m1 AS b1, n2 AS w2, m2 AS b2
    FROM (SELECT symbol, list(w ORDER BY j) AS n1 FROM (SELECT symbol, j, list({_STEP} ORDER BY i) AS w FROM g1 JOIN z1 USING (i, j) GROUP BY symbol, j) GROUP BY symbol)
    JOIN (SELECT symbol, list({_STEP} ORDER BY j) AS m1 FROM h1 GROUP BY symbol) USING (symbol)
    JOIN (SELECT symbol, list(w ORDER BY c) AS n2 FROM (SELECT symbol, c, list({_STEP} ORDER BY j) AS w FROM g2 JOIN z2 USING (j, c) GROUP BY symbol, c) GROUP BY symbol) USING (symbol)
    JOIN (SELECT symbol, list({_STEP} ORDER BY c) AS m2 FROM h2 GROUP BY symbol) USING (symbol))""",
    f"sd AS (SELECT symbol, ts, f, {_PREFER} AS score FROM ({_forward('(SELECT * FROM rw JOIN nw USING (symbol))')}))",
    "th AS (SELECT symbol, quantile_cont(score, 0.1) AS lo, quantile_cont(score, 0.9) AS hi FROM sd WHERE f IS NOT NULL GROUP BY symbol)",
]


@check("l05_l06_first_epoch", sql(*_ONE_EPOCH, f"SELECT symbol, ts, {r('score', 'score')}, CASE WHEN score < lo THEN -1.0 WHEN score > hi THEN 1.0 ELSE 0.0 END::DOUBLE AS signal FROM sd JOIN th USING (symbol)"))
def l05_l06_first_epoch(spark, sf):
    model, rows = Forecaster(FS, ONE), positions(bars1(spark, sf), DAILY)
    return keep(model.signals(rows, model.fit(rows, DAILY), DAILY), "symbol", "ts", "score", "signal")


@check("l06_thresholds_of_training", sql(*_ONE_EPOCH, f"SELECT symbol, {r('lo', 'score_low')}, {r('hi', 'score_high')}, 1.0::DOUBLE AS metric FROM th"))
def l06_thresholds_of_training(spark, sf):
    return keep(Forecaster(FS, ONE).fit(positions(bars1(spark, sf), DAILY), DAILY), "symbol", "score_low", "score_high", "metric")


_QUICK = Forecaster(FS, Training(hidden=8, epochs=5, rate=1e-3))


@check("e02_forecaster_in_sample", None)
def e02_forecaster_in_sample(spark, sf):
    return E.in_sample(bars1(spark, sf), DAILY, _QUICK, E.Run(start="1993-01-01", end="1997-01-01"))[1]


@check("e03_forecaster_walk_forward", None)
def e03_forecaster_walk_forward(spark, sf):
    return walk_forward_signals(bars1(spark, sf), DAILY, _QUICK, 600, 200).select("symbol", "ts", "fold", "score_low", "score_high", "signal")


@check("m06_forecaster_test", None)
def m06_forecaster_test(spark, sf):
    return MC.in_sample_test(bars1(spark, sf), DAILY, _QUICK, E.Run(), 4)[1]


@check("m07_forecaster_test", None)
def m07_forecaster_test(spark, sf):
    return MC.walk_forward_test(bars1(spark, sf), DAILY, _QUICK, E.Run(), 900, 500, 3)[1]


@check("e03_classifier_walk_forward", None)
def e03_classifier_walk_forward(spark, sf):
    model = DirectionClassifier(rsi=(14,), ema=(20,), vol=(10,), minimum=50)
    return walk_forward_signals(bars2(spark, sf), FOUR_HOURS, model, 120, 60).select("symbol", "ts", "fold", "signal")


_P3 = "p3 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos FROM b3)"


@check("l02_features_many_series", sql(_P3, _NR.replace("FROM p1", "FROM p3"), _FT, f"SELECT symbol, ts, {', '.join(r(n, n) for n in FS.names)} FROM ft"))
def l02_features_many_series(spark, sf):
    return keep(X.features(X.normalised_return(bars3(spark, sf), DAILY, FS), DAILY, FS), "symbol", "ts", *FS.names)


