"""One scan, no second read, no shuffle, no cross join: plans and results of the operators made for that."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from panelplan.operators import checks, joins, panel, windows
from panelplan.plans import catalog, registry
from panelplan.plans.structure import bucketed_blend
from panelplan.sources import io
from panelplan.sources.scratch import scratch_dir

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def faulty(spark):
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    rows = [(s, k, day(k), 1.0, "a", 1.0) for s in ("ok", "gap", "twice", "static", "nulls", "bad", "late") for k in range(10) if (s, k) != ("gap", 4)]
    rows += [("twice", 3, day(3), 1.0, "a", 1.0), ("twice", 3, day(3), 1.0, "a", 1.0), ("static", 10, day(10), 1.0, "b", 1.0), ("nulls", 10, day(10), None, None, None), ("bad", 10, day(10), -1.0, "a", 1.0), ("late", 40, day(40), 1.0, "a", 1.0), ("short", 0, day(0), 1.0, "a", None), (None, 0, day(0), 1.0, "a", 1.0)]
    return spark.createDataFrame(rows, "series string, place int, day date, value double, kind string, x double")


def report_of(df, covariates=("x",), examples=5):
    return checks.strict_report(df, "series", "place", "day", "value", "2020-01-31", ["kind"], list(covariates), 9, examples)


def test_strict_report_equals_the_single_checks(faulty):
    found = {r["check_name"]: r for r in report_of(faulty).collect()}
    assert found["V1 grain"]["violations"] == checks.check_grain(faulty, ["series", "place"]).count() == 1
    assert found["V3 contiguous"]["violations"] == checks.check_contiguous(faulty.dropDuplicates(["series", "place"]), "series", "place").count() == 2
    assert found["V6 static"]["violations"] == checks.check_static(faulty, "series", ["kind"]).count() == 2
    assert found["V7 covariate x"]["violations"] == checks.check_covariates(faulty, ["x"]).first()["n"] == 2
    assert found["V8 targets"]["violations"] == checks.check_targets(faulty, "series", "day", "value", "2020-01-31").count() == 3
    assert found["V10 length"]["violations"] == checks.check_length(faulty, "series", 5, 4).count() == 2
    assert found["V1 grain"]["examples"] == ["twice"] and set(found["V8 targets"]["examples"]) <= {"nulls", "bad", "late"} and found["V8 targets"]["first_example"] in ("nulls", "bad", "late")
    assert {r["check_name"]: r["violations"] for r in report_of(faulty, ("kind",)).collect()}["V7 covariate kind"] == faulty.count()  # not a number
    with pytest.raises(ValueError, match=r"V1 grain: 1 \(such as twice\)"):
        checks.require_clean(report_of(faulty))
    checks.require_clean(report_of(faulty.filter("series = 'ok'")))
    assert {r["violations"] for r in report_of(faulty.filter("false")).collect()} == {0}


def test_strict_report_reads_its_table_once(spark, faulty):
    path = scratch_dir(spark, "strict")
    faulty.write.parquet(path)
    report = report_of(spark.read.parquet(path))
    report.collect()
    plan = plan_of(report).split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("hashpartitioning") == 1
    many = spark.range(5000).select(F.col("id").cast("string").alias("series"), F.lit(0).alias("place"), F.lit("2020-01-01").cast("date").alias("day"), F.lit(1.0).alias("value"), F.lit("a").alias("kind"), F.lit(1.0).alias("x"))
    found = {r["check_name"]: r for r in report_of(many, examples=3).collect()}
    assert found["V10 length"]["violations"] == 5000 and len(found["V10 length"]["examples"]) == 3


def test_an_audited_write_counts_in_its_own_job(spark):
    rows = spark.range(1000).select((F.col("id") % 700).alias("k"), F.col("id").alias("v"))
    path, audit, read = scratch_dir(spark, "out"), scratch_dir(spark, "audit"), scratch_dir(spark, "in")
    rows.write.parquet(read)
    spark.sparkContext.setJobGroup("audited", "audited")
    found = io.write_audited(spark.read.schema("k long, v long").parquet(read), path, ["k"], "numbers", audit)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("audited"))
    spark.sparkContext.setJobGroup("rest", "rest")
    want = {r["check_name"]: r["value"] for r in checks.audit_counts(rows, ["k"]).collect()}
    assert found == want == {"rows": 1000, "columns": 2, "duplicate_keys": 300}
    assert {r["check_name"]: r["value"] for r in spark.read.parquet(audit).collect()} == want
    assert spark.read.parquet(path).columns == ["k", "v"] and spark.read.parquet(path).count() == 1000
    assert jobs <= 4  # the write (its map stage is a job of its own) and the three audit rows


def test_bucketed_tables_are_blended_without_a_shuffle(spark):
    model = spark.range(2000).select(F.concat(F.lit("s"), (F.col("id") % 50).cast("string")).alias("series"), F.expr("date_add(date'2001-10-01', cast(id div 50 as int))").alias("cal_date"), F.col("id").cast("double").alias("model"))
    trend = model.filter("month(cal_date) = 11").select("series", "cal_date", (F.col("model") * 2).alias("trend"))
    names = [f"t_{uuid.uuid4().hex}" for _ in range(2)]
    for df, name in zip((model, trend), names, strict=True):
        io.write_series_table(df, name, "series", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        io.use_buckets(spark)
        out = bucketed_blend(spark.table(names[0]), spark.table(names[1]))
        assert "Exchange" not in plan_of(out)
        want = bucketed_blend(model, trend)
        assert "Exchange" in plan_of(want)
        assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, want.select(*out.columns).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


@pytest.mark.parametrize("cap", [None, 5])
def test_coverage_in_closed_form_equals_the_windows_laid_out(spark, cap):
    bounds = spark.createDataFrame([("a", dt.date(2020, 1, 1), dt.date(2020, 3, 31)), ("b", dt.date(2020, 2, 20), dt.date(2020, 3, 20)), ("short", dt.date(2020, 1, 1), dt.date(2020, 1, 9))], "series string, lo date, hi date")
    days = [(f"d{k}", str(dt.date(2019, 12, 25) + dt.timedelta(days=k))) for k in range(0, 110, 3)]
    found = windows.event_coverage_by_series(bounds, days, 14, 7, cap)
    assert "CartesianProduct" not in plan_of(found) and "NestedLoop" not in plan_of(found)
    laid = windows.series_windows(bounds, 14, 7, cap).collect()
    want = set()
    for name, text in days:
        day = dt.date.fromisoformat(text)
        for series in ("a", "b"):
            mine = [w for w in laid if w["series"] == series]
            t = sum(w["output_start"] <= day <= w["output_end"] for w in mine)
            c = sum(w["input_start"] <= day < w["output_start"] for w in mine)
            want.add((series, name, day, t, c, "target" if t else "context only" if c else "unseen"))
    assert {tuple(r) for r in found.collect()} == want


def test_codes_and_relative_steps(spark):
    df = spark.createDataFrame([(k % 7, f"v{k % 5}" if k % 5 else None, dt.date(2020, 1, 1) + dt.timedelta(days=k)) for k in range(70)], "s int, v string, d date")
    coded = {(r["v"], r["v_code"]) for r in panel.ordinal_encode(df, "v").collect()}
    assert coded == {(None, -1), ("v1", 0), ("v2", 1), ("v3", 2), ("v4", 3)}
    steps = windows.relative_steps(df, "s", "d").groupBy("s").agg(F.min("relative_step").alias("lo"), F.max("relative_step").alias("hi")).collect()
    assert {(r["lo"], r["hi"]) for r in steps} == {(-9, 0)}


def test_families_as_sold_and_current_differ_where_a_successor_has_another_family(spark):
    a, b = (registry.QUERIES[q](spark, SMALL) for q in ("k9_disaggregate_months", "k9_current_family"))
    assert a.columns == b.columns and a.count() and b.count()
    assert joins.concat(a).exceptAll(b).count() > 0


def test_intermediate_folders_go(spark):
    import os

    from panelplan.operators.quantiles import exact_quantiles
    from panelplan.sources.scratch import discard, staged, temporary

    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(base))
    kept = scratch_dir(spark, "kept")
    with temporary(spark):
        inner = staged(spark.range(5), "inner")
        staged(inner.filter("id > 2"), "kept", kept)
        assert len(set(os.listdir(base)) - before) == 2
    assert {os.path.basename(kept)} == set(os.listdir(base)) - before and spark.read.parquet(kept).count() == 2
    one = staged(spark.range(3), "one")
    discard(one)
    assert not os.path.exists(one.staged_path.removeprefix("file://"))
    before = set(os.listdir(base))
    found = exact_quantiles(spark.range(100).select(F.col("id").cast("double").alias("v")), [], {"m": ("v", 0.5)})
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(base)) - before}
    assert left == {"quantile-ranks", "quantile-bounds"} and found.first()["m"] == 49.5
    names = {t.name for t in spark.catalog.listTables()}
    assert registry.QUERIES["a1_a6_catalog_table"](spark, SMALL).count() and {t.name for t in spark.catalog.listTables() if not t.isTemporary} <= names


def test_options_of_planning_profiles_and_trends(spark):
    from panelplan.operators import forecast, mapping, planning, profile

    obd = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "e")], "previous_obd_sku string, current_obd_sku string")
    skus = spark.createDataFrame([(x, "Active") for x in "bce"], "sku string, skustatus string")
    assert {tuple(r) for r in mapping.successors(obd, skus).collect()} == {("a", "b"), ("d", "e")}
    with pytest.raises(Exception, match="several successors of a"):
        mapping.successors(obd, skus, on_multi="error").collect()
    assert mapping.successors(obd.filter("current_obd_sku <> 'c'"), skus, on_multi="error").count() == 2

    months = spark.createDataFrame([("s", dt.date(2020, m, 1), float(v)) for m, v in ((1, 5), (2, 1), (5, 3))], "k string, month_of_sale date, net_sales double")
    plain, filled = (planning.demand_variability(months, ["k"], fill_gaps=f).first() for f in (False, True))
    assert (plain["n_months"], filled["n_months"]) == (3, 5) and filled["variability"] == pytest.approx((25 / 3) ** 0.5)

    ahead = months.unionByName(spark.createDataFrame([("s", dt.date(2020, m, 1), 0.0) for m in range(6, 12)], months.schema))
    share = lambda as_of: profile.series_profile(ahead, "k", "month_of_sale", "net_sales", as_of).first()["nonzero_share"]
    assert share("2020-05-31") == 1.0 and share(None) == pytest.approx(3 / 9)

    days = spark.createDataFrame([("x", 2000, 1, 0, 4.0), ("x", 2001, 1, 0, 6.0), ("y", 2001, 0, 0, 1.0)], "series string, year int, f1 int, f2 int, v double")
    few, every = (forecast.lag_day_forecast(days, ["f1", "f2"], "series", "year", "v", [2000, 2001], 2002, dense=x) for x in (False, True))
    assert few.count() == 1 and {(r["series"], r["lag_day"], r["prediction"]) for r in every.collect()} == {("x", "f1", 8.0), ("x", "f2", 0.0), ("y", "f1", 0.0), ("y", "f2", 0.0)}
    classes = planning.abc_class(spark.createDataFrame([("d", "f", 10.0)], "p string, f string, v double"), ["p"], "v", "f").first()
    assert (classes["abc_class"], classes["abc_policy"]) == ("C", "A 30,B 25,C 20")


def test_sku_forecasts_are_made_last_and_not_shuffled(spark):
    plan = plan_of(registry.QUERIES["k9_all_months"](spark, SMALL))
    above = plan[: plan.index("Generate explode(months")] if "Generate explode(months" in plan else plan
    assert "Exchange" not in above and "Window" not in above and "Sort" not in above


def test_sku_forecasts_equal_a_plain_loop(spark):
    import random

    from panelplan.operators import disagg

    rng, month = random.Random(3), lambda k: dt.date(2020 + k // 12, 1 + k % 12, 1)
    skus = [(f"f{k % 3}", f"s{k:02}", "inactive" if k % 5 == 0 else "Active") for k in range(24)] + [("none", "s99", "inactive"), ("one", "s98", "active")]
    sales = {(d, f, s, m): float(rng.randrange(-1, 9)) for d in "ab" for f, s, _ in skus for m in range(9) if rng.random() < 0.3}
    forecasts = {(m, d, f): float(m + 1) for m in (3, 4, 8, 11) for d in ("a", "b", "c", None) for f in ("f0", "f1", "f2", "none", "one") if rng.random() < 0.8}
    want = set()
    for (m, d, f), forecast in forecasts.items():
        own = {s: sum(sales.get((d, f, s, m - k), 0.0) for k in (1, 2, 3)) for x, s, status in skus if (x, status.lower()) == (f, "active")}
        total = sum(own.values())
        for s, v in own.items():
            share = 1 / len(own) if total == 0 else v / total
            want.add((month(m), d, f, s, forecast, v, total, len(own), total == 0, round(share, 5), round(forecast if len(own) == 1 else forecast * round(share, 5), 9)))
    fc = spark.createDataFrame([(month(m), d, f, v) for (m, d, f), v in forecasts.items()], "forecast_month date, parent_dealer_code string, model_family_code string, forecast double")
    sold = spark.createDataFrame([(d, f, s, month(m), v) for (d, f, s, m), v in sales.items()], "parent_dealer_code string, model_family_code string, sku string, month_of_sale date, net_sales double")
    out = disagg.disaggregate_months(fc, sold, spark.createDataFrame(skus, "model_family_code string, sku string, skustatus string")).collect()
    names = ("forecast_month", "parent_dealer_code", "model_family_code", "sku", "forecast", "sales", "family_sales", "n_skus", "no_history_flag", "share")
    assert len(out) == len(want) and {(*(r[n] for n in names), round(r["sku_forecast"], 9)) for r in out} == want


@pytest.mark.parametrize("name", ["j6_scale_series", "a9_panel_by_dealer", "a11_report", "j7_scale_all"])
def test_panel_queries_work_out_monthly_sales_once(spark, monkeypatch, name):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(value):
        seen.add(1)
        return value

    monthly = registry._monthly(spark, SMALL)
    monkeypatch.setattr(registry, "_monthly", lambda spark, d: monthly.withColumn("net_sales", counted("net_sales")))
    assert catalog.QUERIES[name](spark, SMALL).collect()
    assert seen.value == monthly.count()
