"""Small fixtures for the semantic decisions that the driver's tables do not reach."""

from __future__ import annotations

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from panelplan.functions import columns as C
from panelplan.operators import calendar, checks, disagg, forecast, joins, mapping, metrics, panel, planning, profile, windows
from panelplan.plans import registry
from panelplan.sources import io
from panelplan.spec import PanelSpec, RunTags


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_successor_with_two_targets_keeps_the_smallest_active(spark):
    skus = spark.createDataFrame([("a", "inactive"), ("b", "Active"), ("c", "active")], "sku string, skustatus string")
    obd = spark.createDataFrame([("x", "a"), ("x", "c"), ("x", "b"), ("y", "a")], "previous_obd_sku string, current_obd_sku string")
    assert rows(mapping.successors(obd, skus)) == [("x", "b")]
    assert rows(mapping.several_successors(obd)) == [("x", 3)]


def test_parent_dealer_drops_null_codes_and_trims(spark):
    df = spark.createDataFrame([("1", "12 - North"), (None, "13 - South"), ("1", "12 - North")], "x_dealer_code_hier string, par_org_name string")
    assert rows(mapping.parent_dealer(df)) == [("1", "12")]


def test_fill_gaps_covers_every_month(spark):
    df = spark.createDataFrame([("a", date(2020, 1, 1), 2.0), ("a", date(2020, 4, 1), 3.0), ("b", date(2020, 3, 1), -1.0)], "k string, month_of_sale date, net_sales double")
    out = panel.fill_gaps(df, ["k"])
    assert out.count() == 8
    assert out.agg(F.sum("net_sales")).first()[0] == 4.0
    assert panel.fill_gaps(df.filter("false"), ["k"]).count() == 0


def forecast_case(spark, sales, skus, value=10.0):
    fc = spark.createDataFrame([(date(2020, 4, 1), "d", "f", value)], "forecast_month date, parent_dealer_code string, model_family_code string, forecast double")
    s = spark.createDataFrame([("d", "f", k, date(2020, m, 1), v) for k, m, v in sales], "parent_dealer_code string, model_family_code string, sku string, month_of_sale date, net_sales double")
    k = spark.createDataFrame(skus, "model_family_code string, sku string, skustatus string")
    return disagg.disaggregate_months(fc, s, k)


def test_shares_without_history_are_even(spark):
    out = forecast_case(spark, [("z", 1, 5.0)], [("f", "a", "active"), ("f", "b", "Active"), ("f", "c", "inactive")])
    assert [(r.sku, r.share, r.sku_forecast, r.no_history_flag) for r in out.orderBy("sku").collect()] == [("a", 0.5, 5.0, True), ("b", 0.5, 5.0, True)]


def test_sku_without_sales_gets_nothing_and_months_outside_do_not_count(spark):
    out = forecast_case(spark, [("a", 1, 3.0), ("b", 3, 1.0), ("b", 4, 99.0)], [("f", k, "active") for k in "abc"])
    assert [(r.sku, r.share) for r in out.orderBy("sku").collect()] == [("a", 0.75), ("b", 0.25), ("c", 0.0)]
    assert disagg.reconcile(out).first()["difference"] == 0


def test_single_active_sku_takes_all_and_family_without_one_is_left_out(spark):
    assert forecast_case(spark, [("b", 2, 4.0)], [("f", "a", "active"), ("f", "b", "inactive")]).first()["sku_forecast"] == 10.0
    assert forecast_case(spark, [], [("f", "a", "inactive")]).count() == 0


def test_variability_of_short_series_is_one(spark):
    df = spark.createDataFrame([("a", date(2020, 1, 1), 1.0), ("b", date(2020, 1, 1), 1.0), ("b", date(2020, 2, 1), 9.0)] + [("c", date(2020, m, 1), float(v)) for m, v in ((1, 1), (2, 4), (5, 2))], "k string, month_of_sale date, net_sales double")
    assert {r.k: round(r.variability, 4) for r in planning.demand_variability(df, ["k"]).collect()} == {"a": 1.0, "b": 1.0, "c": round(5 / math.sqrt(2), 4)}


def test_abc_ties_and_zero_total(spark):
    df = spark.createDataFrame([("d", "x", 50.0), ("d", "y", 50.0), ("e", "x", 0.0)], "dealer string, family string, total double")
    assert rows(planning.abc_class(df, ["dealer"], "total", "family").select("dealer", "family", "running_pct", "abc_class"), "dealer", "family") == [("d", "x", 50.0, "A"), ("d", "y", 100.0, "C"), ("e", "x", 0.0, "A")]


def test_order_sweep_and_quarantine(spark):
    df = spark.createDataFrame([("d", "s", "A", 10.0, 4, 1.0, 2.0, 3.0), ("d", "t", "B", 10.0, 0, 1.0, 2.0, None), ("d", "u", "B", 10.0, 0, None, 2.0, 3.0)], "parent_dealer_code string, sku string, abc_class string, sku_forecast double, closing_stock int, min_lead_time double, avg_lead_time double, max_lead_time double")
    good, bad = planning.split_null_lead(df)
    assert (good.count(), bad.count()) == (2, 1)
    v = spark.createDataFrame([("d", "s", "sku", 2.0), ("d", "s", "family", 4.0), ("d", "u", "sku", 1.0)], "parent_dealer_code string, sku string, basis string, variability double")
    out = planning.order_sweep(good, v, spark, [(95, 1.65)])
    got = {(r.sku, r.basis): r for r in out.collect()}
    assert got["s", "sku"].safety_stock == 4.0 and got["s", "sku"].order_max == 1 + 4 + 10 - 4
    assert got["s", "family"].safety_stock == 7.0 and got["u", "sku"].lead_stock_min is None


def test_orders_keep_skus_without_a_sale(spark):
    df = spark.createDataFrame([("d", "new", "A", 10.0, 4, 1.0, 2.0, 3.0)], "parent_dealer_code string, sku string, abc_class string, sku_forecast double, closing_stock int, min_lead_time double, avg_lead_time double, max_lead_time double")
    sold = spark.createDataFrame([("d", "F", "old", date(2020, m, 1), float(v)) for m, v in ((1, 1), (2, 4), (5, 2))], "parent_dealer_code string, model_family_code string, sku string, month_of_sale date, net_sales double")
    skus = spark.createDataFrame([("F", "old"), ("F", "new")], "model_family_code string, sku string")
    v = planning.variability_by_basis(sold, sold, skus)
    got = {(r.sku, r.basis): r.variability for r in planning.order_sweep(df, v, spark, [(95, 1.65)]).collect()}
    assert got == {("new", "sku"): 1.0, ("new", "family"): pytest.approx(5 / math.sqrt(2))}
    assert [r.variability for r in planning.order_sweep(df, v.filter("false"), spark, [(95, 1.65)]).collect()] == [1.0, 1.0]


def test_every_forecast_sku_is_ordered_or_quarantined(spark):
    d = "/root/testdata/sf0.001"
    wanted = registry._order_candidates(spark, d).select("parent_dealer_code", "sku")
    marked = registry.k16_quarantine(spark, d)
    assert sorted(rows(marked.drop("quarantined"))) == sorted(rows(wanted))
    bases = len(planning.BASES) * len(planning.SERVICE_LEVELS)
    assert registry.k18_order_sweep(spark, d).count() == bases * marked.filter("not quarantined").count()


def test_nearest_anchor_ties_go_to_the_earlier(spark):
    days = spark.createDataFrame([(date(2020, 1, 5),), (date(2019, 12, 1),), (date(2020, 2, 1),)], "cal_date date")
    anchors = spark.createDataFrame([(date(2020, 1, 1),), (date(2020, 1, 9),)], "anchor date")
    assert rows(calendar.nearest_anchor(days, anchors).select("cal_date", "nearest", "offset_days"), "cal_date") == [(date(2019, 12, 1), date(2020, 1, 1), -31), (date(2020, 1, 5), date(2020, 1, 1), 4), (date(2020, 2, 1), date(2020, 1, 9), 23)]


def test_lag_map_problems(spark):
    cal = spark.createDataFrame([(date(2020, 1, 1), 1, 1), (date(2020, 1, 2), 0, 1)], "cal_date date, `N-1` int, `N+1` int")
    found = calendar.lag_date_map(cal, ["N-1", "N+1"])
    assert rows(found, "lag_day", "cal_date") == [("N+1", date(2020, 1, 1)), ("N+1", date(2020, 1, 2)), ("N-1", date(2020, 1, 1))]
    names = spark.createDataFrame([("N-1",), ("N+1",), ("N+2",)], "lag_day string")
    assert {(r.problem, r.key) for r in calendar.lag_map_problems(found, names).collect()} == {("several dates", "N+1"), ("no date", "N+2"), ("several lag days", "2020-01-01")}


def test_window_counts(spark):
    out = windows.sliding_windows(spark, "2023-04-01", "2025-06-30", 365, 184)
    assert out.count() == 822 - 549 + 1
    assert out.filter("recency = 0").first()["output_end"] == date(2025, 6, 30)
    assert windows.monthly_windows(spark, "2023-04-01", "2025-09-30", 16, 6).count() == 9
    assert windows.monthly_windows(spark, "2023-04-01", "2025-05-31", 16, 6).count() == 5
    assert windows.sliding_windows(spark, "2023-04-01", "2023-05-01", 365, 184).count() == 0


def test_event_roles(spark):
    w = windows.sliding_windows(spark, "2020-01-01", "2020-01-10", 5, 2)
    events = spark.createDataFrame([("t", date(2020, 1, 8)), ("c", date(2020, 1, 2)), ("n", date(2021, 1, 1))], "name string, date date")
    assert {r.name: r.role for r in windows.event_coverage(w, events).collect()} == {"t": "target", "c": "context only", "n": "unseen"}


def test_ols_counts_missing_years_as_zero(spark):
    df = spark.createDataFrame([("a", 2021, 4.0), ("a", 2022, 8.0), ("b", 2020, 9.0)], "k string, year int, sales double")
    out = {r.k: (round(r.slope, 6), round(r.prediction, 6)) for r in forecast.ols_extrapolate(df, ["k"], "year", "sales", [2020, 2021, 2022], 2023).collect()}
    assert out == {"a": (4.0, 12.0), "b": (-4.5, 0.0)}


def test_wide_and_long_lag_sales_agree(spark):
    df = spark.createDataFrame([("s", 2020, 1.0, 1, 0), ("s", 2020, 2.0, 1, 1), ("s", 2021, 4.0, 0, 1), ("s", 2021, 8.0, 0, None)], "series string, year int, v double, `N-1` int, `N+1` int")
    wide = forecast.lag_day_sales_wide(df, ["N-1", "N+1"], "series", "year", "v").unpivot(["series", "year"], ["`N-1`", "`N+1`"], "lag_day", "sales").filter("sales <> 0")
    long = forecast.lag_day_sales_long(df, ["N-1", "N+1"], "series", "year", "v")
    assert {(r.year, r.lag_day.strip("`"), r.sales) for r in wide.collect()} == {(r.year, r.lag_day, r.sales) for r in long.collect()}


def test_metrics_skip_zero_actuals(spark):
    df = spark.createDataFrame([("a", 0.0, 5.0), ("a", 10.0, 5.0), ("b", 0.0, 1.0)], "series string, actual double, forecast double")
    assert rows(metrics.series_mape(df)) == [("a", 50.0, 10.0)]
    assert {r.series: r.wape for r in metrics.series_metrics(df).collect()} == {"a": 1.0, "b": None}


def test_verdict_is_close_within_five_percent_and_the_first_segment_decides(spark):
    m = spark.createDataFrame([("a", "overall", "all", 10.0), ("b", "overall", "all", 10.2), ("a", "segment", "Runner", 10.0), ("b", "segment", "Runner", 20.0)], "model string, level string, value string, wmape double")
    v = metrics.verdicts(m, "a", "b")
    assert {r.value: r.verdict for r in v.collect()} == {"all": "close", "Runner": "a"}
    assert metrics.overall_verdict(v).first()["decision"] == "a"


def test_losses(spark):
    df = spark.createDataFrame([(1.0, 1.5, 1), (0.0, 3.0, 0)], "actual double, forecast double, f int")
    r = metrics.loss_metrics(df, 1.0, "f").first()
    assert (r.mse, r.huber, r.huber_ae) == ((0.25 + 9) / 2, (0.125 + 2.5) / 2, (0.625 + 2.5) / 2)


def test_scaler_of_constant_series(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("b", 0.0), ("b", 4.0)], "s string, v double")
    assert [r.scaled for r in panel.scale(df, panel.fit_scaler(df, ["s"], "v"), ["s"], "v").orderBy("s", "v").collect()] == [0.0, 0.0, 0.0, 1.0]


def test_ordinal_encode_unseen(spark):
    known = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert {r.c: r.c_code for r in panel.ordinal_encode(df, "c", known).collect()} == {"a": 0, "z": -1, None: -1}


def test_checks_find_seeded_violations(spark):
    df = spark.createDataFrame([("s", 1, date(2020, 1, 1), 1.0, "x"), ("s", 1, date(2020, 1, 1), None, "x"), ("s", 4, date(2020, 1, 3), -1.0, None)], "s string, i int, d date, v double, c string")
    assert checks.check_grain(df, ["s", "d"]).count() == 1
    assert checks.duplicates(df, ["s", "d"]).count() == 2
    assert checks.check_contiguous(df, "s", "i").count() == 2
    assert checks.check_static(df, "s", ["c"]).count() == 1
    assert rows(checks.check_targets(df, "s", "d", "v", "2020-12-31")) == [("s", 1, 1, 0)]
    assert {(r.column_name, r.problem) for r in checks.check_covariates(df, ["v", "c"]).collect()} == {("v", "null"), ("c", "not numeric")}
    assert checks.check_horizon(df, "d", "2020-02-01").count() == 1
    assert checks.check_columns(spark, df, ["s", "missing"]).count() == 1
    assert checks.check_length(df, "s", 3, 1).count() == 1
    with pytest.raises(ValueError):
        checks.require_empty(checks.check_grain(df, ["s", "d"]), "grain")


def test_column_helpers(spark):
    df = spark.createDataFrame([("12<>PASSION<>DRUM", date(2026, 8, 1), "tue", "x")], "k string, m date, w string, n string")
    r = C.parse_series_key(df, "k").select("parent_dealer_code", "model_family", "model_family_code", *[C.stock_date(F.col("m"), s).alias(s) for s in ("end", "first", "mid")], C.weekday_number(F.col("w")).alias("wd"), C.fiscal_year(F.col("m")).alias("fy"), C.path_safe(F.col("k")).alias("p")).first()
    assert tuple(r) == ("12", "PASSION", "PASSION<>DRUM", date(2026, 7, 31), date(2026, 6, 30), date(2026, 7, 15), 1, "FY'27", "12_PASSION_DRUM")
    assert C.to_numeric(df, ["n"]).first()["n"] is None
    assert C.normalize_columns(df.toDF('"A B"', "M", "N-16", "x-y"), keep=("N-16",)).columns == ["a_b", "m", "N-16", "x_y"]


def test_profile_and_coverage(spark):
    df = spark.createDataFrame([("a", date(2020, m, 1), float(v)) for m, v in ((1, 0), (2, 10), (3, 0))] + [("b", date(2020, 1, 1), 30.0)], "s string, d date, v double")
    p = {r.s: r for r in profile.series_profile(df, "s", "d", "v").collect()}
    assert p["a"].span_months == 3 and p["a"].n_nonzero == 1 and p["b"].std is None
    out = profile.coverage(profile.series_proportion(df, "s", "d", "v", "2020-01-01", "2020-12-31"), [1], [80]).first()
    assert tuple(out) == (75.0, 2)


def test_append_run_is_safe_to_repeat(spark, tmp_path):
    df, path = spark.createDataFrame([(1,), (2,)], "x int"), f"file://{tmp_path}/out"
    for version, times in (("v1", 2), ("v2", 1)):
        for _ in range(times):
            io.append_run(df, path, RunTags("20260801", version, "202608"))
    assert spark.read.parquet(path).groupBy("run_version").count().orderBy("run_version").collect()[0][1] == 2
    io.run_stage(df.withColumn("part", F.col("x")), f"file://{tmp_path}/stage", ["part"])
    io.run_stage(df.withColumn("part", F.col("x")).union(df.selectExpr("x + 5", "x + 1")), f"file://{tmp_path}/stage", ["part"])
    assert sorted(r.x for r in spark.read.parquet(f"file://{tmp_path}/stage").collect()) == [1, 2, 7]
    assert io.split_parts(df, "x", 1).select("part").distinct().count() == 2


def test_spec_roles(spark):
    df = spark.createDataFrame([("s", date(2020, 1, 1), 1.0, "x", 2)], "series string, d date, y double, c string, f int")
    spec = PanelSpec.infer(df.schema, "series", "d", "y")
    assert (spec.static, spec.future) == (("c",), ("f",))


def test_key_coverage(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("y",), ("z",), ("y",)], "k string")
    assert rows(joins.key_coverage(a, b, "k")) == [(1, 1, 1, False)]


def test_forecaster_beats_the_seasonal_baseline_on_a_trend(spark):
    data = [(f"s{k}", date(2018 + m // 12, m % 12 + 1, 1), float(10 * k + m + (5 if m % 12 == 10 else 0))) for k in range(1, 6) for m in range(48)]
    p = spark.createDataFrame(data, "series string, month_of_sale date, net_sales double").withColumn("month", F.month("month_of_sale"))
    origins = p.select(F.col("month_of_sale").alias("origin")).distinct().filter("origin >= DATE '2019-01-01'")
    samples = forecast.make_samples(p, "series", "month_of_sale", "net_sales", origins, 2, lags=(1, 2, 3), future=("month",), season=12)
    model = forecast.PanelForecaster("series", ["lag_1", "lag_2", "win_mean", "season_lag", "step", "month"])
    out = forecast.backtest(samples, model, "2021-01-01").filter("target IS NOT NULL")
    mae = out.agg(F.avg(F.abs(F.col("forecast") - F.col("target"))), F.avg(F.abs(F.col("season_lag") - F.col("target")))).first()
    assert mae[0] < 0.3 * mae[1] and out.filter("p10 > p90").count() == 0


def test_ranks_and_running_totals_over_ranges(spark):
    import random

    from panelplan.operators.ranking import with_running

    rng = random.Random(1)
    data = [(f"s{k}", float(rng.choice([0, 0, 0, 5, rng.randrange(100)]))) for k in range(500)]
    df = spark.createDataFrame(data, "series string, total double")
    got = {r.series: (r["rank"], r.running) for r in with_running(df, [-F.col("total"), F.col("series")], "rank", {"running": "total"}).collect()}
    total = 0.0
    for k, (series, value) in enumerate(sorted(data, key=lambda x: (-x[1], x[0]))):
        total += value
        assert got[series] == (k + 1, total)
    assert with_running(df.filter("false"), [F.col("series")], "rank").count() == 0


def test_strict_weights_have_no_even_split(spark):
    fc = spark.createDataFrame([(date(2020, 4, 1), "d", f, 10.0) for f in ("sold", "unsold", "unknown")], "forecast_month date, parent_dealer_code string, model_family_code string, forecast double")
    recent = spark.createDataFrame([(date(2020, 4, 1), "d", "sold", "a", 3.0), (date(2020, 4, 1), "d", "sold", "b", 1.0), (date(2020, 4, 1), "d", "unsold", "c", 0.0)], "forecast_month date, parent_dealer_code string, model_family_code string, sku string, sales double")
    got = {(r.model_family_code, r.sku): (r.share, r.sku_forecast) for r in disagg.strict_weights(fc, recent).collect()}
    assert got == {("sold", "a"): (0.75, 8.0), ("sold", "b"): (0.25, 3.0), ("unsold", "c"): (None, None), ("unknown", None): (None, None)}


def test_run_window_and_weekly_forecasts(spark):
    sales = spark.createDataFrame([(date(2020, m, 1), float(m)) for m in range(1, 13)], "month_of_sale date, net_sales double")
    run = spark.createDataFrame([(date(2020, 7, 15),)], "run_month date")
    assert sorted(r.net_sales for r in planning.run_window(sales, run, 3).collect()) == [4.0, 5.0, 6.0]
    weekly = spark.createDataFrame([(date(2020, 1, 6), "s", 1.25), (date(2020, 1, 13), "s", 1.25), (date(2020, 1, 6), "t", -3.0), (date(2020, 9, 1), "t", 5.0)], "ts date, series string, forecast double")
    dates = spark.createDataFrame([(date(2020, 1, d), date(2020, 1, 1)) for d in (6, 13)], "date date, month_date date")
    assert sorted(rows(planning.weekly_to_monthly(weekly, dates))) == [("s", date(2020, 1, 1), 2.0), ("t", date(2020, 1, 1), 0.0)]


def test_forecaster_is_least_squares(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    y = 3 + x @ [2.0, -1.0] + rng.normal(size=60) * 0.1
    df = spark.createDataFrame([("s", 1, float(a), float(b), float(t)) for (a, b), t in zip(x, y, strict=True)], "series string, step int, f1 double, f2 double, target double")
    model = forecast.PanelForecaster("series", ["f1", "f2"]).fit(df)
    want = np.linalg.lstsq(np.column_stack([np.ones(60), x]), y, rcond=None)[0]
    assert np.allclose([model.model.intercept, *model.model.coefficients], want, atol=1e-6)
    got = model.predict(df).collect()
    fitted = {(r.f1, r.f2): r.forecast for r in got}
    assert all(abs(fitted[tuple(map(float, a))] - max(0.0, v)) < 1e-6 for a, v in zip(x, np.column_stack([np.ones(60), x]) @ want, strict=True))
    assert all(r.p10 <= r.p50 <= r.p90 for r in got)


def test_steps_beyond_the_last_row_have_no_target(spark):
    p = spark.createDataFrame([("s", date(2020, m, 1), float(m), m) for m in range(1, 6)], "series string, month_of_sale date, net_sales double, month int")
    origins = spark.createDataFrame([(date(2020, 4, 1),)], "origin date")
    got = {r.step: r for r in forecast.make_samples(p, "series", "month_of_sale", "net_sales", origins, 3, lags=(1, 2), window=3, future=("month",), season=3).collect()}
    assert (got[1].target, got[1].target_date, got[1].month, got[1].lag_1, got[1].lag_2, got[1].win_mean, got[1].season_lag) == (5.0, date(2020, 5, 1), 5, 4.0, 3.0, 3.0, 2.0)
    assert [got[s].target for s in (2, 3)] == [None, None] and [got[s].season_lag for s in (2, 3)] == [3.0, 4.0]


def test_entry_without_the_training_data_operators():
    """A missing dependency of theirs leaves the other queries in place."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['panelplan.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'j2_fill_gaps' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
