"""Rank selection, sums of products, origins, sample rows and permutations against numpy and by hand."""

from __future__ import annotations

import datetime as dt
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelplan.operators import forecast, metrics, ridge, sampling
from panelplan.operators.quantiles import exact_quantiles


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Quantiles -----------------------------------------------------------------------------------


@pytest.mark.parametrize("ranges", [16, 512])
def test_quantiles_equal_numpy(spark, ranges):
    rng = random.Random(ranges)
    groups = {
        "ties": [float(rng.randrange(3)) for _ in range(101)], "one": [7.5], "two": [1.0, 2.0], "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 9) for _ in range(200)],
        "equal": [4.0] * 50, "skew": [0.0] * 500 + [1e9], None: [3.0, 1.0, 2.0],
    }
    rows = [(k, v, None if v == 2.0 else -v) for k, vs in groups.items() for v in vs] + [("nulls", None, None), ("ties", None, float("nan"))]
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(3)
    wanted = {"a50": ("a", 0.5), "a10": ("a", 0.1), "a100": ("a", 1.0), "b25": ("b", 0.25), "a50_again": ("a", 0.5)}
    found = {r["k"]: r for r in exact_quantiles(df, ["k"], wanted, ranges).collect()}
    assert set(found) == set(groups)
    for k, r in found.items():
        a = [v for x, v, _ in rows if x == k and v is not None]
        b = [v for x, _, v in rows if x == k and v is not None and not math.isnan(v)]
        assert r["a50"] == r["a50_again"] == pytest.approx(np.quantile(a, 0.5)) and r["a10"] == pytest.approx(np.quantile(a, 0.1)) and r["a100"] == max(a)
        assert r["b25"] == pytest.approx(np.quantile(b, 0.25)) if b else r["b25"] is None
    whole = [v for _, v, _ in rows if v is not None]
    assert exact_quantiles(df, [], {"m": ("a", 0.5)}, ranges).first()["m"] == pytest.approx(np.quantile(whole, 0.5))
    assert exact_quantiles(df.filter("false"), ["k"], wanted).count() == 0


def test_medians_by_month_hold_no_group_in_a_buffer(spark):
    rows = [(dt.date(2020, 1 + k % 2, 1), f"s{k}", float(1 + k), float(2 + k), 3.0) for k in range(40)]
    df = spark.createDataFrame(rows, "month_of_sale date, series string, a double, b double, actual double")
    out = metrics.compare_by_month(df, "a", "b")
    assert "percentile" not in plan_of(out).lower() and "median(" not in plan_of(out).lower()
    for r in out.collect():
        ape = [abs(3.0 - x[2]) / 3 * 100 for x in rows if x[0] == r["month_of_sale"]]
        assert r["median_a"] == pytest.approx(np.median(ape)) and r["n_series"] == 20
    assert metrics.series_summary(spark.createDataFrame([], "wape double, bias double, total_actual double")).collect()[0]["median_wape"] is None


# Sums of products ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s in range(12):
        for m in range(30):
            x, z = rng.normal(), rng.normal()
            for step in (1, 2):
                at = m + step
                rows.append((f"s{s}", dt.date(2000 + m // 12, 1 + m % 12, 1), step, dt.date(2000 + at // 12, 1 + at % 12, 1), float(x), float(z), float(2 * x - z + 0.1 * rng.normal()) if (s, m) != (3, 3) else None))
    return spark.createDataFrame(rows, "series string, origin date, step int, target_date date, x double, z double, target double").repartition(4).cache()


def test_ridge_solutions_equal_numpy(samples):
    rows = [r for r in samples.collect() if r["target"] is not None]
    total = samples.withColumn("all", F.lit(1))
    gram = ridge.as_matrix(ridge.gram_sums(total, "all", ["x", "z"], "target").first()["g"], 4)
    a, y = np.array([(1, r["x"], r["z"]) for r in rows]), np.array([r["target"] for r in rows])
    assert gram[0, 0] == len(rows) and np.allclose(gram[:3, :3], a.T @ a) and np.allclose(gram[:3, 3], a.T @ y)
    for strength in (0.0, 5.0, 1e4):
        want = np.linalg.solve(a.T @ a + np.diag([0, strength, strength]), a.T @ y)
        found = ridge.solve(gram, strength, [0, 1])
        assert np.allclose(found, want) and ridge.squared_error(gram, found) == pytest.approx(float(((a @ want - y) ** 2).sum()))
    assert ridge.solve(gram, 1.0, [1])[1] == 0.0


def test_sweep_of_fifty_settings_is_one_job(spark, samples):
    settings = ridge.sampled_settings(50, 3, [("x",), ("z",), ("x", "z")])
    assert settings == ridge.sampled_settings(50, 3, [("x",), ("z",), ("x", "z")]) != ridge.sampled_settings(50, 4, [("x",), ("z",), ("x", "z")])
    folds = samples.withColumn("fold", F.year("target_date"))
    folds.count()
    spark.sparkContext.setJobGroup("sweep", "sweep")
    table, best = ridge.sweep_ridge(folds, "fold", ["x", "z"], "target", settings)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("sweep")
    spark.sparkContext.setJobGroup("rest", "rest")
    assert len(jobs) <= 2  # one query; adaptive execution runs its map stage as a job of its own
    rows = table.collect()
    assert len(rows) == 50 and [r["setting"] for r in rows if r["best"]] == [settings.index(best)] and min(r["rmse"] for r in rows) == rows[settings.index(best)]["rmse"]
    data = [(r["fold"], 1.0, r["x"], r["z"], r["target"]) for r in folds.collect() if r["target"] is not None]
    s, error, n = settings[0], 0.0, 0
    at = [1, *[2 + ["x", "z"].index(f) for f in s.features]]
    for fold in sorted({r[0] for r in data})[1:]:
        a, y = (np.array([[r[k] for k in at] for r in data if r[0] < fold]), np.array([r[4] for r in data if r[0] < fold]))
        b = np.linalg.solve(a.T @ a + np.diag([0.0] + [s.ridge] * len(s.features)), a.T @ y)
        e = np.array([r[4] for r in data if r[0] == fold]) - np.array([[r[k] for k in at] for r in data if r[0] == fold]) @ b
        error, n = error + float(e @ e), n + len(e)
    assert rows[0]["rmse"] == pytest.approx(math.sqrt(error / n)) and rows[0]["n"] == n
    none, nothing = ridge.sweep_ridge(folds.filter("false"), "fold", ["x", "z"], "target", settings[:2])
    assert [r["rmse"] for r in none.collect()] == [None, None] and nothing == settings[0]


def test_best_of_settings_that_doubles_cannot_tell_apart(spark):
    rng = random.Random(0)
    data = [(fold, float(x := rng.randrange(3000, 30000)), float(rng.randrange(30000) + x // 4)) for fold in (2000, 2001, 2002) for _ in range(60)]
    settings = ridge.sampled_settings(50, 7, [("x",)], ridge=(0.01, 100.0))

    def error(strength):
        total = 0
        for fold in (2001, 2002):
            known, asked = ([(Fraction(x), Fraction(y)) for f, x, y in data if keep(f)] for keep in (lambda f: f < fold, lambda f: f == fold))
            sx, sy = (sum(r[k] for r in known) for k in (0, 1))
            b = (sum(x * y for x, y in known) - sx * sy / len(known)) / (sum(x * x for x, _ in known) - sx * sx / len(known) + Fraction(strength))
            total += sum((y - (sy - b * sx) / len(known) - b * x) ** 2 for x, y in asked)
        return total

    want = min(range(50), key=lambda k: error(settings[k].ridge))
    table, best = ridge.sweep_ridge(spark.createDataFrame(data, "fold int, x double, target double").coalesce(1), "fold", ["x"], "target", settings)
    assert [r["setting"] for r in table.collect() if r["best"]] == [want] and best == settings[want]
    twice = spark.createDataFrame(data, "fold int, x double, target double").withColumn("z", F.col("x"))  # no single solution
    found = ridge.sweep_ridge(twice, "fold", ["x", "z"], "target", [ridge.Setting(0.0, ("x",)), ridge.Setting(0.0, ("x", "z"))])[0].collect()
    assert found[0]["rmse"] == pytest.approx(found[1]["rmse"])


def test_origins_and_what_they_know(samples):
    grid = [r["origin"] for r in ridge.origin_grid(samples, "origin", "2001-02-10", 4, 3).collect()]
    assert sorted(grid) == [dt.date(2001, 3, 1), dt.date(2001, 7, 1), dt.date(2001, 11, 1), dt.date(2002, 3, 1)]
    origins = ridge.origin_grid(samples, "origin", "2001-02-10", 4, 3)
    out = ridge.rolling_backtest(samples, origins, ["x", "z"]).collect()
    rows = [r for r in samples.collect() if r["target"] is not None]
    for origin in grid:
        known = [r for r in rows if r["target_date"] <= origin]
        b = np.linalg.lstsq(np.array([(1, r["x"], r["z"]) for r in known]), np.array([r["target"] for r in known]), rcond=None)[0]
        mine = [r for r in out if r["origin"] == origin]
        assert len(mine) == 24 and {r["n_known"] for r in mine} == {len(known)}
        assert all(r["forecast"] == pytest.approx(float(b @ [1, r["x"], r["z"]])) for r in mine)
    once = ridge.known_models(samples, origins, ["x", "z"], "target", refit=False).collect()
    assert len({tuple(r["coefficients"]) for r in once}) == 1


# Draws ---------------------------------------------------------------------------------------


def test_sample_rows_are_the_same_in_every_run(spark):
    residuals = [(f"s{k}", dt.date(2000, 1, 1), step, float(100 * step + k)) for k in range(7) for step in (1, 2)]
    pool = spark.createDataFrame(residuals, "series string, origin date, step int, residual double")
    rows = spark.createDataFrame([(f"s{k}", dt.date(2001, 1, 1), step, 1000.0) for k in range(30) for step in (1, 2, 3)], "series string, origin date, step int, forecast double")
    draw = lambda p, r: {(x["series"], x["step"], x["draw"]): x["sample"] for x in sampling.bootstrap_rows(r, p, ["series", "origin", "step"], ["series", "origin"], 40).collect()}
    found = draw(pool, rows)
    assert len(found) == 30 * 2 * 40 and found == draw(pool.repartition(5), rows.repartition(7))  # step 3 has no residuals
    for step in (1, 2):
        seen = [v - 1000 for (_, s, _), v in found.items() if s == step]
        assert set(seen) == {100.0 * step + k for k in range(7)}
        assert all(abs(seen.count(x) / len(seen) - 1 / 7) < 0.05 for x in set(seen))
    assert min(draw(pool.withColumn("residual", F.lit(-5000.0)), rows).values()) == 0.0


def test_rows_are_numbered_within_groups(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id"))
    rows, sizes = sampling.numbered(df, "g", [F.col("id")])
    assert {r["g"]: r["n_group"] for r in sizes.collect()} == {0: 167, 1: 167, 2: 166}
    assert all(r["number"] == r["id"] // 3 for r in rows.collect())


def test_importance_of_permuted_inputs(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{k}", 1 + k % 2, float(x), float(z), float(3 * x)) for k, (x, z) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "series string, step int, x double, z double, target double")
    out = sampling.permutation_importance(df, ["x", "z"], "target", lambda c: 3 * c["x"] + 0 * c["z"], ["series"])
    found = {(r["step"], r["feature"]): r for r in out.collect()}
    assert all(found[s, "z"]["importance"] == pytest.approx(0) and found[s, "x"]["importance"] > 1 and found[s, "x"]["mae"] == pytest.approx(0) for s in (1, 2))


@pytest.mark.parametrize("kind", ["linear", "gbt"])
def test_forecaster_with_a_static_input_gives_sample_rows(spark, samples, kind):
    coded = samples.withColumn("code", (F.substring("series", 2, 2).cast("int") % 3).cast("double"))
    model = forecast.PanelForecaster("series", ["x", "z", "step", "code"], kind, {} if kind == "linear" else {"maxIter": 3})
    model.fit(coded.filter("origin < DATE '2001-06-01'"), coded.filter("origin >= DATE '2001-06-01'"))
    asked = coded.filter("origin = DATE '2002-01-01'")
    rows = model.sample(asked, 20)
    assert rows.count() == 12 * 2 * 20
    found = metrics.draw_quantiles(rows, ["series", "step"]).collect()
    assert len(found) == 24 and all(r["p10"] <= r["p50"] <= r["p90"] for r in found)
