"""Queries of what is learned from the panel: origin grids, rolling backtests, sweeps, sample rows, importance by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelplan.operators import forecast, ridge, sampling
from panelplan.plans.details import CTE
from panelplan.plans.registry import _panel, _r, _rs, query
from panelplan.sources.scratch import staged

_GRID = ("2000-01-01", 3, 3)


def _samples(spark, d, since: str, step: int = 3):
    """Samples of all origins from a month on: lag, window mean and the value a year before, written once."""
    p = staged(_panel(spark, d).select("series", "month_of_sale", "net_sales"), "panel")
    origins = p.select(F.col("month_of_sale").alias("origin")).distinct().filter(F.col("origin") >= F.lit(since).cast("date"))
    rows = forecast.make_samples(p, "series", "month_of_sale", "net_sales", origins, step, lags=(1,), window=6, season=12)
    return p, staged(rows.select("series", "origin", "step", "target_date", "target", "lag_1", "win_mean", F.coalesce("season_lag", F.lit(0)).alias("season_lag")), "samples")


CTE["learn"] = """SELECT o.series, o.month_of_sale AS origin, CAST(s.step AS INT) AS step, t.month_of_sale AS target_date, t.net_sales AS target, o.net_sales AS lag_1, w.win_mean, coalesce(q.net_sales, 0) AS season_lag
    FROM placed o CROSS JOIN (VALUES (1), (2), (3)) AS s(step)
    JOIN (SELECT series, place, avg(net_sales) OVER x AS win_mean FROM placed WINDOW x AS (PARTITION BY series ORDER BY place ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) w ON w.series = o.series AND w.place = o.place
    LEFT JOIN placed t ON t.series = o.series AND t.place = o.place + s.step LEFT JOIN placed q ON q.series = o.series AND q.place = o.place + s.step - 12"""
CTE["grid"] = f"""SELECT month_of_sale AS origin FROM (SELECT *, row_number() OVER (ORDER BY month_of_sale) - 1 AS k FROM (
    SELECT month_of_sale, row_number() OVER (ORDER BY month_of_sale) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT month_of_sale FROM panel)) WHERE month_of_sale >= DATE '{_GRID[0]}') WHERE k % {_GRID[1]} = 0 AND place + {_GRID[2]} <= n"""


@query("j15_origin_grid", "SELECT origin FROM grid")
def j15_origin_grid(spark, d):
    return ridge.origin_grid(_panel(spark, d), "month_of_sale", *_GRID)


@query("j15_rolling_backtest", """WITH m AS (SELECT g.origin, count(*) AS n_known, regr_slope(CAST(l.target AS DOUBLE), CAST(l.win_mean AS DOUBLE)) AS b, regr_intercept(CAST(l.target AS DOUBLE), CAST(l.win_mean AS DOUBLE)) AS a
          FROM grid g JOIN learn l ON l.origin >= DATE '1998-01-01' AND l.target_date <= g.origin GROUP BY 1)
        SELECT l.series, l.origin, l.step, l.target_date, l.target, m.n_known, round(a + b * l.win_mean, 4) + 0.0 AS forecast FROM learn l JOIN m ON l.origin = m.origin""")  # fmt: skip
def j15_rolling_backtest(spark, d):
    """All origins of the grid at once, each by the line that its own past teaches."""
    p, samples = _samples(spark, d, "1998-01-01")
    out = ridge.rolling_backtest(samples, ridge.origin_grid(p, "month_of_sale", *_GRID), ["win_mean"])
    return out.select("series", "origin", "step", "target_date", "target", "n_known", *_r("forecast"))


@query("j24_gram_sums", """WITH x AS (SELECT CAST(year(target_date) AS INT) AS fold, unnest(['1', '1', '1', '1', 'lag_1', 'lag_1', 'lag_1', 'win_mean', 'win_mean', 'target']) AS a, unnest(['1', 'lag_1', 'win_mean', 'target', 'lag_1', 'win_mean', 'target', 'win_mean', 'target', 'target']) AS b,
          unnest([1, lag_1, win_mean, target, lag_1 * lag_1, lag_1 * win_mean, lag_1 * target, win_mean * win_mean, win_mean * target, target * target]) AS v
          FROM (SELECT origin, target_date, CAST(lag_1 AS DOUBLE) AS lag_1, CAST(win_mean AS DOUBLE) AS win_mean, CAST(target AS DOUBLE) AS target FROM learn) WHERE origin >= DATE '1998-01-01' AND target IS NOT NULL)
        SELECT fold, a, b, round(sum(v), 3) + 0.0 AS value FROM x GROUP BY 1, 2, 3""")  # fmt: skip
def j24_gram_sums(spark, d):
    _, samples = _samples(spark, d, "1998-01-01")
    sums = ridge.gram_sums(samples.withColumn("fold", F.year("target_date")), "fold", ["lag_1", "win_mean"], "target")
    return ridge.gram_rows(sums, "fold", ["1", "lag_1", "win_mean", "target"]).select("fold", "a", "b", *_r("value", digits=3))


_SETTINGS = ridge.sampled_settings(50, 7, [("lag_1",), ("win_mean",), ("season_lag",)])
_VALUES = ", ".join(f"({k}, CAST({s.ridge!r} AS DOUBLE), '{s.features[0]}')" for k, s in enumerate(_SETTINGS))


@query("j24_sweep_ridge", f"""WITH x AS (SELECT CAST(year(target_date) AS INT) AS fold, unnest(['lag_1', 'win_mean', 'season_lag']) AS feature, unnest([CAST(lag_1 AS DOUBLE), CAST(win_mean AS DOUBLE), CAST(season_lag AS DOUBLE)]) AS x, CAST(target AS DOUBLE) AS y
          FROM learn WHERE origin >= DATE '1998-01-01' AND target IS NOT NULL),
        f AS (SELECT fold, feature, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM x GROUP BY 1, 2),
        k AS (SELECT *, sum(n) OVER w AS bn, sum(sx) OVER w AS bx, sum(sy) OVER w AS by_, sum(sxx) OVER w AS bxx, sum(sxy) OVER w AS bxy FROM f WINDOW w AS (PARTITION BY feature ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        s AS (SELECT setting, ridge, s.feature, k.*, (bxy - bx * by_ / bn) / (bxx - bx * bx / bn + ridge) AS b FROM (VALUES {_VALUES}) AS s(setting, ridge, feature) JOIN k ON k.feature = s.feature WHERE bn IS NOT NULL),
        e AS (SELECT setting, ridge, feature, n, syy - 2 * a * sy - 2 * b * sxy + n * a * a + 2 * a * b * sx + b * b * sxx AS sse FROM (SELECT *, (by_ - b * bx) / bn AS a FROM s)),
        r AS (SELECT setting, ridge, feature AS features, CAST(sum(n) AS BIGINT) AS n, sqrt(sum(sse) / sum(n)) AS rmse FROM e GROUP BY 1, 2, 3)
        SELECT CAST(setting AS INT) AS setting, round(ridge, 6) AS ridge, features, n, round(rmse, 4) AS rmse, setting = (SELECT setting FROM r ORDER BY r.rmse, setting LIMIT 1) AS best FROM r""")  # fmt: skip
def j24_sweep_ridge(spark, d):
    """50 sampled settings, scored on yearly folds by the years before; one pass over the samples."""
    _, samples = _samples(spark, d, "1998-01-01")
    table, _ = ridge.sweep_ridge(samples.withColumn("fold", F.year("target_date")), "fold", ["lag_1", "win_mean", "season_lag"], "target", _SETTINGS)
    return table.select("setting", *_r("ridge", digits=6), F.array_join("features", ",").alias("features"), "n", *_r("rmse"), "best")


_HASH = "CAST(concat('0x', substring(md5({}), 1, 15)) AS BIGINT)"


@query("e11_bootstrap_quantiles", f"""WITH pool AS (SELECT step, target - win_mean AS residual, row_number() OVER (PARTITION BY step ORDER BY series, origin) - 1 AS number, count(*) OVER (PARTITION BY step) AS n
          FROM learn WHERE origin >= DATE '1999-01-01' AND target_date < DATE '2000-01-01'),
        sizes AS (SELECT step, max(n) AS n FROM pool GROUP BY 1),
        draws AS (SELECT l.series, l.origin, l.step, l.win_mean, {_HASH.format("concat_ws('|', l.series, CAST(l.origin AS VARCHAR), CAST(l.step AS VARCHAR), CAST(d.draw AS VARCHAR))")} % s.n AS number
          FROM learn l JOIN grid g ON g.origin = l.origin JOIN sizes s ON s.step = l.step CROSS JOIN (SELECT unnest(range(0, 100)) AS draw) d)
        SELECT d.series, d.origin, d.step, count(*) AS n_draws, round(quantile_cont(greatest(d.win_mean + p.residual, 0), 0.1), 4) AS p10, round(quantile_cont(greatest(d.win_mean + p.residual, 0), 0.5), 4) AS p50,
               round(quantile_cont(greatest(d.win_mean + p.residual, 0), 0.9), 4) AS p90 FROM draws d JOIN pool p ON p.step = d.step AND p.number = d.number GROUP BY 1, 2, 3""")  # fmt: skip
def e11_bootstrap_quantiles(spark, d):
    """P10, P50 and P90 over 100 sample rows of each forecast: the window mean, with residuals of the year before by step."""
    p, samples = _samples(spark, d, "1999-01-01")
    residuals = samples.filter("target_date < DATE '2000-01-01'").withColumn("residual", F.col("target") - F.col("win_mean"))
    asked = samples.join(F.broadcast(ridge.origin_grid(p, "month_of_sale", *_GRID)), "origin").withColumn("forecast", F.col("win_mean"))  # a row for each origin
    rows = sampling.bootstrap_rows(asked.select("series", "origin", "step", "forecast"), residuals, ["series", "origin", "step"], ["series", "origin"], draws=100)
    counts = rows.groupBy("series", "origin", "step").agg(F.count("*").alias("n_draws"), F.percentile("sample", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))  # 100 rows each
    return counts.select("series", "origin", "step", "n_draws", *[F.round(F.col("q")[k], 4).alias(f"p{q}") for k, q in enumerate((10, 50, 90))])


@query("d36_step_importance", f"""WITH n AS (SELECT step, series, origin, target, lag_1, win_mean, season_lag, count(*) OVER (PARTITION BY step) AS n,
          row_number() OVER (PARTITION BY step ORDER BY {_HASH.format("concat_ws('|', series, CAST(origin AS VARCHAR), CAST(step AS VARCHAR), '1')")}, series, origin) - 1 AS number FROM learn WHERE origin >= DATE '2000-01-01' AND target IS NOT NULL),
        b AS (SELECT n.*, o.lag_1 AS lag_1_, o.win_mean AS win_mean_, o.season_lag AS season_lag_ FROM n JOIN n o ON o.step = n.step AND o.number = (n.number + 1) % n.n),
        e AS (SELECT step, abs(0.3 * lag_1 + 0.5 * win_mean + 0.2 * season_lag - target) AS base, abs(0.3 * lag_1_ + 0.5 * win_mean + 0.2 * season_lag - target) AS x1, abs(0.3 * lag_1 + 0.5 * win_mean_ + 0.2 * season_lag - target) AS x2, abs(0.3 * lag_1 + 0.5 * win_mean + 0.2 * season_lag_ - target) AS x3 FROM b),
        s AS (SELECT step, avg(base) AS mae, avg(x1) AS x1, avg(x2) AS x2, avg(x3) AS x3 FROM e GROUP BY 1)
        SELECT step, feature, {_rs('mae', 'mae_permuted')}, round(mae_permuted - mae, 4) + 0.0 AS importance FROM (SELECT step, mae, unnest(['lag_1', 'win_mean', 'season_lag']) AS feature, unnest([x1, x2, x3]) AS mae_permuted FROM s)""")  # fmt: skip
def d36_step_importance(spark, d):
    """What each input is worth at each step, to a weighted mean of three."""
    _, samples = _samples(spark, d, "2000-01-01")
    predict = lambda c: 0.3 * c["lag_1"] + 0.5 * c["win_mean"] + 0.2 * c["season_lag"]
    out = sampling.permutation_importance(samples.filter("target IS NOT NULL"), ["lag_1", "win_mean", "season_lag"], "target", predict, ["series", "origin"])
    return out.select("step", "feature", *_r("mae", "mae_permuted", "importance"))
