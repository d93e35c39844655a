"""Queries of the smaller operators: column work, joins, totals, accuracy, windows and validations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelplan.functions import columns as C
from panelplan.operators import calendar, checks, disagg, forecast, joins, mapping, metrics, panel, planning, profile, reports, windows
from panelplan.plans.registry import _LAGS, CTE, TYPES, _days, _family_forecast, _forecast_months, _lag_flags, _mapped, _monthly, _one_model, _panel, _r, _rs, _order_candidates, _scored, _segments, _sku_forecast, _skus, _staged_sales, j22_blend, query
from panelplan.plans.views import source, view
from panelplan.sources import io
from panelplan.sources.scratch import scratch_dir, staged
from panelplan.spec import RunTags

_SERIES = "concat(parent_dealer_code, '<>', model_family)"

# Columns -------------------------------------------------------------------------------------


@query("b2_b3_date_ranges", """SELECT 'half-open' AS kind, x_customer_type, count(*) AS n FROM retail WHERE cal_date >= DATE '1996-01-01' AND cal_date < DATE '1996-07-01' GROUP BY 2
        UNION ALL SELECT 'closed', x_customer_type, count(*) FROM retail WHERE cal_date BETWEEN DATE '1996-01-01' AND DATE '1996-07-01' GROUP BY 2""")  # fmt: skip
def b2_b3_date_ranges(spark, d):
    rows = view(spark, d, "retail")
    return joins.concat(*[C.between_dates(rows, "cal_date", "1996-01-01", "1996-07-01", closed).groupBy(F.lit(kind).alias("kind"), "x_customer_type").agg(F.count("*").alias("n")) for kind, closed in (("half-open", False), ("closed", True))])


@query("b6_i3_normalize_columns", """SELECT p_brand AS brand_name, count(*) AS part_key, CAST(sum(p_size) AS BIGINT) AS "N-16" FROM part GROUP BY 1""")
def b6_i3_normalize_columns(spark, d):
    odd = source(spark, d, "part").select(F.col("p_partkey").alias('"Part Key"'), F.col("p_brand").alias("Brand-Name"), F.col("p_size").alias('"N-16"'))
    return C.normalize_columns(odd, keep=("N-16",)).groupBy("brand_name").agg(F.count("part_key").alias("part_key"), F.sum("`N-16`").alias("N-16"))


@query("b10_b12_fill_total_drop", """SELECT series, coalesce(y96, 0) AS "1996", y97 AS "1997", coalesce(y96, 0) + coalesce(y97, 0) + coalesce(y98, 0) AS total FROM (SELECT concat(parent_dealer_code, '<>', model_family) AS series,
        sum(CASE WHEN year(month_of_sale) = 1996 THEN net_sales END) AS y96, sum(CASE WHEN year(month_of_sale) = 1997 THEN net_sales END) AS y97, sum(CASE WHEN year(month_of_sale) = 1998 THEN net_sales END) AS y98 FROM monthly GROUP BY 1)""")  # fmt: skip
def b10_b12_fill_total_drop(spark, d):
    rows = _monthly(spark, d).withColumns({"series": mapping.series_key(), "year": F.year("month_of_sale")})
    wide = rows.groupBy("series").pivot("year", [1996, 1997, 1998]).agg(F.sum("net_sales"))
    return C.drop_features(C.fill_nulls(wide, {"1996": 0.0}).withColumn("total", C.total_of(["1996", "1997", "1998"])), ["1998"])


@query("b18_to_numeric", "SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 3 = 0 THEN p_type ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS size FROM part")
def b18_to_numeric(spark, d):
    text = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.col("p_size").cast("string"))
    return C.to_numeric(source(spark, d, "part").select("p_partkey", text.alias("size")), ["size"])


@query("b21_festive_weight", f"""SELECT {_SERIES} AS series, count(*) FILTER (WHERE n.d BETWEEN -1 AND 1) AS festive_rows, CAST(sum(CASE WHEN n.d BETWEEN -1 AND 1 THEN 5 ELSE 1 END) AS DOUBLE) AS weight
        FROM mapped m JOIN near n ON m.cal_date = n.cal_date GROUP BY 1""")  # fmt: skip
def b21_festive_weight(spark, d):
    flags = ["N-1", "N+0", "N+1"]
    return _lag_flags(spark, d).groupBy("series").agg(F.count_if(C.festive_flag(flags)).alias("festive_rows"), F.sum(C.festive_weight(flags, 1.0, 5.0)).alias("weight"))


@query("i_scalar_functions", """SELECT cal_date, strftime(cal_date, '%Y%m') AS yyyymm, strftime(cal_date, '%B - %Y') AS label, strftime(cal_date, '%Y-%b') AS year_mon, strftime(cal_date, '%b''%y') AS mon_yy,
        CAST(date_trunc('month', cal_date) AS DATE) AS label_month, make_date(year(cal_date), month(cal_date), day(cal_date)) AS same_day, CAST(isodow(cal_date) - 1 AS INT) AS weekday, CAST(isodow(cal_date) - 1 AS INT) AS from_name,
        CAST(day(last_day(cal_date)) AS INT) AS days_in_month, CAST(datediff('month', DATE '1995-01-01', cal_date) AS INT) AS month_gap, last_day(CAST(date_trunc('month', cal_date) AS DATE) - INTERVAL 1 MONTH) AS stock_end,
        last_day(CAST(date_trunc('month', cal_date) AS DATE) - INTERVAL 2 MONTH) AS stock_first, CAST(CAST(date_trunc('month', cal_date) AS DATE) - INTERVAL 1 MONTH + INTERVAL 14 DAY AS DATE) AS stock_mid,
        round(sin(2 * pi() * dayofyear(cal_date) / 365.25), 6) + 0.0 AS year_sin, round(cos(2 * pi() * dayofyear(cal_date) / 365.25), 6) + 0.0 AS year_cos, (year(cal_date) - 2000) / 50.0 AS year_code
        FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS cal_date FROM lineitem)""")  # fmt: skip
def i_scalar_functions(spark, d):
    day, label = F.col("cal_date"), F.date_format("cal_date", "MMMM - yyyy")
    sine, cosine = C.cyclic(F.dayofyear(day), 365.25)
    start = F.trunc(day, "MM")
    return _days(spark, d).select(
        "cal_date", F.date_format(day, "yyyyMM").alias("yyyymm"), label.alias("label"), F.date_format(day, "yyyy-MMM").alias("year_mon"), F.date_format(day, "MMM''yy").alias("mon_yy"), C.month_of_label(label).alias("label_month"),
        C.day_of(F.year(day), F.month(day), F.dayofmonth(day)).alias("same_day"), F.weekday(day).alias("weekday"), C.weekday_number(F.date_format(day, "EEEE")).alias("from_name"), F.dayofmonth(F.last_day(day)).alias("days_in_month"),
        C.month_gap(F.lit("1995-01-01").cast("date"), day).alias("month_gap"), *[C.stock_date(start, s).alias(f"stock_{s}") for s in ("end", "first", "mid")], *[(F.round(x, 6) + 0.0).alias(n) for x, n in ((sine, "year_sin"), (cosine, "year_cos"))], C.encode_year(day).alias("year_code"),
    )


@query("i2_key_parts", """SELECT series, split_part(series, '<>', 2) AS family, replace(series, '<>', '_') AS path, upper(lower(series)) AS upper_key FROM (SELECT DISTINCT series FROM panel)""")
def i2_key_parts(spark, d):
    quoted = _panel(spark, d).select(F.concat(F.lit(' "'), "series", F.lit('"')).alias("quoted")).distinct()
    key = C.strip_quotes(F.col("quoted"))
    return quoted.select(key.alias("series"), C.key_part(key, 1).alias("family"), C.path_safe(key).alias("path"), F.upper(F.lower(key)).alias("upper_key"))


# Joins ---------------------------------------------------------------------------------------


@query("c1_c2_family_on_two_keys", """WITH act AS (SELECT sku, model, model_family FROM skus WHERE lower(skustatus) = 'active')
        SELECT 'left' AS how, a.model_family, count(*) AS n, sum(r.invoiced_sales) AS invoiced_sales FROM retail r LEFT JOIN act a ON r.sku = a.sku AND r.model = a.model GROUP BY 2
        UNION ALL SELECT 'inner', a.model_family, count(*), sum(r.invoiced_sales) FROM retail r JOIN act a ON r.sku = a.sku AND r.model = a.model GROUP BY 2""")  # fmt: skip
def c1_c2_family_on_two_keys(spark, d):
    rows, skus = view(spark, d, "retail"), C.active_skus(_skus(spark, d))
    return joins.concat(*[mapping.with_family(rows, skus, ("sku", "model"), how).groupBy(F.lit(how).alias("how"), "model_family").agg(F.count("*").alias("n"), F.sum("invoiced_sales").alias("invoiced_sales")) for how in ("left", "inner")])


CTE["family_monthly"] = "SELECT parent_dealer_code, model_family_code, month_of_sale, sum(net_sales) AS net_sales FROM sku_monthly GROUP BY 1, 2, 3"


@query("c9_join_actuals", f"""SELECT f.forecast_month AS month_of_sale, f.parent_dealer_code, f.model_family_code, {_rs('forecast')}, m.net_sales FROM family_fc f
        JOIN family_monthly m ON m.month_of_sale = f.forecast_month AND m.parent_dealer_code = f.parent_dealer_code AND m.model_family_code = f.model_family_code""")  # fmt: skip
def c9_join_actuals(spark, d):
    sales = _staged_sales(spark, d)
    found = joins.join_actuals(_family_forecast(sales).withColumnRenamed("forecast_month", "month_of_sale"), planning.family_sales(sales), ["month_of_sale", "parent_dealer_code", "model_family_code"])
    return found.select("month_of_sale", "parent_dealer_code", "model_family_code", *_r("forecast"), "net_sales")


CTE["festive_months"] = """SELECT CAST(date_trunc('month', anchor + CAST(o AS INT)) AS DATE) AS month_of_sale, count(*) AS festive_days FROM anchors, (SELECT unnest(range(-30, 8)) AS o) GROUP BY 1"""


@query("c10_with_calendar", """SELECT p.series, p.month_of_sale, p.net_sales, coalesce(f.festive_days, 0) AS festive_days, CAST(day(last_day(p.month_of_sale)) AS INT) AS days FROM panel p LEFT JOIN festive_months f ON p.month_of_sale = f.month_of_sale""")
def c10_with_calendar(spark, d):
    p = _panel(spark, d)
    festive = calendar.month_offset_flags(view(spark, d, "anchors")).groupBy("month_of_sale").agg(F.count("*").alias("festive_days"))
    length = panel.month_spine(p, "month_of_sale").withColumn("days", F.dayofmonth(F.last_day("month_of_sale")))
    return C.fill_nulls(calendar.with_calendar(p, festive, length), {"festive_days": 0}).select("series", "month_of_sale", "net_sales", "festive_days", "days")


@query("c16_c21_steps_to_dates", """SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY month_of_sale) AS INT) AS step, month_of_sale, net_sales FROM panel""")
def c16_c21_steps_to_dates(spark, d):
    """Rows numbered within their series; the dates come back by the step's number, by key and not by position."""
    steps = windows.step_numbers(_panel(spark, d).select("series", "month_of_sale", "net_sales"), "series", "month_of_sale")
    return joins.index_to_date(steps.drop("month_of_sale"), steps, "step", "month_of_sale").select("series", "step", "month_of_sale", "net_sales")


@query("h2_key_diff", "SELECT series FROM panel WHERE year(month_of_sale) = 1996 AND net_sales > 100 EXCEPT SELECT series FROM panel WHERE year(month_of_sale) = 1999 AND net_sales > 100")
def h2_key_diff(spark, d):
    p = _panel(spark, d).filter("net_sales > 100")
    return joins.key_diff(p.filter(F.year("month_of_sale") == 1996), p.filter(F.year("month_of_sale") == 1999), "series")


@query("h3_one_per_date", "SELECT cal_date, max(n_events) AS n_events, max(net_sales) AS net_sales FROM daily_panel GROUP BY 1")
def h3_one_per_date(spark, d):
    return joins.one_per_date(view(spark, d, "daily_panel"), "cal_date", ["n_events", "net_sales"])


@query("g1_sorted_output", "SELECT series, sum(net_sales) AS total FROM panel GROUP BY 1 ORDER BY total DESC, series")
def g1_sorted_output(spark, d):
    return joins.sorted_output(_panel(spark, d).groupBy("series").agg(F.sum("net_sales").alias("total")), F.col("total").desc(), "series")


# Totals and profiles -------------------------------------------------------------------------


@query("d4_active_totals", """SELECT forecast_month, parent_dealer_code, model_family_code, sku, sales, sum(sales) OVER (PARTITION BY forecast_month, parent_dealer_code, model_family_code) AS family_total,
        sum(sales) OVER (PARTITION BY forecast_month, parent_dealer_code, model_family_code, sku) AS sku_total FROM shares""")  # fmt: skip
def d4_active_totals(spark, d):
    return disagg.active_totals(_sku_forecast(spark, d)).select("forecast_month", "parent_dealer_code", "model_family_code", "sku", "sales", "family_total", "sku_total")


CTE["blended_rows"] = """SELECT m.series, m.cal_date, t.series IS NOT NULL AS is_festive, round(CASE WHEN t.series IS NOT NULL THEN t.trend * 0.5 + m.model * 0.5 ELSE m.model END, 4) AS blended FROM model_daily m
    LEFT JOIN (SELECT series, cal_date, sum(prediction) AS trend FROM trend JOIN (SELECT printf('N%+d', o) AS lag_day, CAST(DATE '2001-11-14' + CAST(o AS INT) AS DATE) AS cal_date FROM (SELECT unnest(range(-16, 11)) AS o)) USING (lag_day) GROUP BY 1, 2) t
      ON m.series = t.series AND m.cal_date = t.cal_date"""


@query("d19_blend_summary", "SELECT is_festive, count(*) AS n, round(sum(blended), 2) AS total, round(avg(blended), 4) AS mean FROM blended_rows GROUP BY 1")
def d19_blend_summary(spark, d):
    return reports.daily_blend_summary(j22_blend(spark, d), "is_festive", "blended").select("is_festive", "n", *_r("total", digits=2), *_r("mean"))


@query("d33_deviation_pct", "SELECT series, month_of_sale, round((model_a - model_b) * 100 / nullif(model_b, 0), 4) + 0.0 AS deviation_pct FROM scored")
def d33_deviation_pct(spark, d):
    return profile.deviation_pct(_scored(spark, d), "model_a", "model_b").select("series", "month_of_sale", *_r("deviation_pct"))


_MEASURES = ["l_quantity", "l_discount", "l_tax"]


@query("d36_importance_shift", """SELECT feature, round(avg(CASE WHEN y = 1996 THEN v END), 4) AS importance_1, round(avg(CASE WHEN y = 1999 THEN v END), 4) AS importance_2, round(avg(CASE WHEN y = 1999 THEN v END) - avg(CASE WHEN y = 1996 THEN v END), 4) + 0.0 AS shift
        FROM (SELECT year(l_shipdate) AS y, unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem) GROUP BY 1""")  # fmt: skip
def d36_importance_shift(spark, d):
    rows = source(spark, d, "lineitem")
    runs = [profile.importance_summary(rows.filter(F.year("l_shipdate") == y), _MEASURES) for y in (1996, 1999)]
    return profile.importance_shift(*runs).select("feature", *_r("importance_1", "importance_2", "shift"))


@query("f7_v3_contiguous", f"""SELECT series, CAST(place AS INT) AS place, CAST(before AS INT) AS before FROM (SELECT series, place, lag(place) OVER (PARTITION BY series ORDER BY place) AS before FROM (
        SELECT {_SERIES} AS series, year(month_of_sale) * 12 + month(month_of_sale) AS place FROM monthly)) WHERE place - before <> 1""")  # fmt: skip
def f7_v3_contiguous(spark, d):
    """Months that do not follow on the one before, in the panel as sold (without its gaps filled)."""
    rows = _monthly(spark, d).select(mapping.series_key().alias("series"), (F.year("month_of_sale") * 12 + F.month("month_of_sale")).alias("place"))
    return checks.check_contiguous(rows, "series", "place").select("series", "place", "before")


@query("f10_first_attributes", f"SELECT series, arg_min(model_family, month_of_sale) AS model_family, arg_min(net_sales, month_of_sale) AS net_sales FROM (SELECT *, {_SERIES} AS series FROM monthly) GROUP BY 1")
def f10_first_attributes(spark, d):
    return panel.first_attributes(_monthly(spark, d).withColumn("series", mapping.series_key()), "series", "month_of_sale", ["model_family", "net_sales"])


# Accuracy ------------------------------------------------------------------------------------

CTE["verdict_rows"] = """SELECT level, value, CASE WHEN coalesce(abs(a - b) / nullif(greatest(a, b), 0), 0) < 0.05 THEN 'close' WHEN a < b THEN 'model_a' ELSE 'model_b' END AS verdict
    FROM (SELECT level, value, max(CASE WHEN model = 'model_a' THEN wmape END) AS a, max(CASE WHEN model = 'model_b' THEN wmape END) AS b FROM segments GROUP BY 1, 2)"""


@query("e4_overall_verdict", """SELECT first, overall, CASE WHEN first IS NOT NULL AND first <> 'close' THEN first ELSE overall END AS decision FROM (
        SELECT max(CASE WHEN value = 'Runner' THEN verdict END) AS first, max(CASE WHEN level = 'overall' THEN verdict END) AS overall FROM verdict_rows)""")  # fmt: skip
def e4_overall_verdict(spark, d):
    return metrics.overall_verdict(metrics.verdicts(_segments(spark, d), "model_a", "model_b"))


@query("e5_series_summary", """SELECT round(median(wape), 4) AS median_wape, round(sum(bias) / nullif(sum(total_actual), 0), 6) + 0.0 AS total_bias FROM (
        SELECT series, sum(abs(forecast - actual)) / nullif(sum(abs(actual)), 0) AS wape, sum(forecast - actual) AS bias, sum(actual) AS total_actual FROM one_model GROUP BY 1)""")  # fmt: skip
def e5_series_summary(spark, d):
    return metrics.series_summary(metrics.series_metrics(_one_model(spark, d))).select(*_r("median_wape"), *_r("total_bias", digits=6))


CTE["mapes"] = "SELECT * FROM (SELECT series, avg(CASE WHEN actual <> 0 THEN abs(actual - forecast) / abs(actual) * 100 END) AS mape, sum(actual) AS volume FROM one_model GROUP BY 1) WHERE mape IS NOT NULL"


@query("e6_mape_histogram", """SELECT CAST(CASE WHEN mape < 0 THEN 0 WHEN mape >= 300 THEN 31 ELSE floor(mape / 10) + 1 END AS BIGINT) AS bin, count(*) AS n FROM mapes GROUP BY 1""")
def e6_mape_histogram(spark, d):
    return metrics.mape_histogram(metrics.series_mape(_one_model(spark, d)), 0.0, 300.0)


@query("e6_worst_series", "SELECT series, round(mape, 4) AS mape FROM mapes WHERE volume > 0 ORDER BY mapes.mape DESC, series LIMIT 20")
def e6_worst_series(spark, d):
    worst = joins.top_n(metrics.series_mape(_one_model(spark, d)).filter("volume > 0"), "mape", 20, "series")
    return worst.select("series", *_r("mape"))


@query("e9_daily_ape_totals", """SELECT round(sum(actual), 4) AS actual, round(sum(forecast), 4) AS forecast, round(avg(ape), 4) AS mean_ape, round(median(ape), 4) AS median_ape FROM (
        SELECT *, CASE WHEN actual <> 0 THEN abs(actual - forecast) / abs(actual) * 100 END AS ape FROM (SELECT month_of_sale, sum(actual) AS actual, sum(forecast) AS forecast FROM one_model GROUP BY 1))""")  # fmt: skip
def e9_daily_ape_totals(spark, d):
    return metrics.daily_ape_totals(metrics.daily_ape(_one_model(spark, d), "month_of_sale")).select(*_r("actual", "forecast", "mean_ape", "median_ape"))


@query("e11_pinball", "SELECT series, " + ", ".join(f"round(avg(greatest((actual - forecast) * 0.{q}, (actual - forecast) * (0.{q} - 1))), 4) + 0.0 AS loss_{q}0" for q in (1, 5, 9)) + " FROM one_model GROUP BY 1")
def e11_pinball(spark, d):
    losses = {f"loss_{q}0": F.avg(metrics.pinball(F.col("actual"), F.col("forecast"), q / 10)) for q in (1, 5, 9)}
    return _one_model(spark, d).groupBy("series").agg(*[x.alias(n) for n, x in losses.items()]).select("series", *_r(*losses))


# Panel and windows ---------------------------------------------------------------------------


@query("j4_holdout_last", "SELECT series, month_of_sale, row_number() OVER (PARTITION BY series ORDER BY month_of_sale DESC) <= 12 AS held_out FROM panel")
def j4_holdout_last(spark, d):
    return panel.holdout_last(_panel(spark, d), "series", "month_of_sale", 12).select("series", "month_of_sale", "held_out")


@query("j7_scale_all", """SELECT p.series, p.month_of_sale, round((p.net_sales - lo) / (hi - lo), 6) AS scaled, round((p.net_sales - lo) / (hi - lo) * (hi - lo) + lo, 4) AS back
        FROM panel p, (SELECT min(net_sales) AS lo, max(net_sales) AS hi FROM panel WHERE month_of_sale <= DATE '1999-12-01') s""")  # fmt: skip
def j7_scale_all(spark, d):
    p = _panel(spark, d)
    scaler = panel.fit_scaler(p.filter("month_of_sale <= DATE '1999-12-01'"), [], "net_sales")
    return panel.scale(p, scaler, [], "net_sales").withColumn("back", panel.unscale()).select("series", "month_of_sale", *_r("scaled", digits=6), *_r("back"))


@query("j9_extract_calendar", """SELECT cal_date, CAST(max(CASE WHEN d = -1 THEN 1 ELSE 0 END) AS INT) AS "N-1", CAST(max(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS INT) AS "N+0" FROM near WHERE cal_date IN (SELECT cal_date FROM mapped) GROUP BY 1""")
def j9_extract_calendar(spark, d):
    return panel.extract_calendar(_lag_flags(spark, d).select("cal_date", "N-1", "N+0"), "cal_date", ["N-1", "N+0"])


@query("v9_check_horizon", "SELECT * FROM (SELECT max(month_of_sale) AS last FROM panel) WHERE last < DATE '2002-03-01'")
def v9_check_horizon(spark, d):
    return checks.check_horizon(_panel(spark, d), "month_of_sale", "2002-03-01")


def _bounds(spark, d) -> tuple[str, str]:
    """First and last day of sales; one row."""
    lo, hi = _days(spark, d).agg(F.min("cal_date"), F.max("cal_date")).first()
    return str(lo), str(hi)


CTE["sales_days"] = "SELECT min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem"
CTE["day_windows"] = """SELECT CAST(w AS INT) AS window_id, lo + CAST(w AS INT) AS input_start, lo + CAST(w + 364 AS INT) AS input_end, lo + CAST(w + 365 AS INT) AS output_start, lo + CAST(w + 548 AS INT) AS output_end, CAST(n - 1 - w AS INT) AS recency
    FROM (SELECT lo, n, unnest(range(0, n)) AS w FROM (SELECT lo, (hi - lo) + 1 - 549 + 1 AS n FROM sales_days)) WHERE n - 1 - w < 400"""


@query("j10_sliding_windows", "SELECT * FROM day_windows")
def j10_sliding_windows(spark, d):
    return windows.sliding_windows(spark, *_bounds(spark, d), 365, 184, cap=400)


@query("j11_monthly_windows", """SELECT CAST(w AS INT) AS window_id, CAST(m + CAST(w * 2 AS INT) * INTERVAL 1 MONTH AS DATE) AS input_start, last_day(CAST(m + CAST(w * 2 + 15 AS INT) * INTERVAL 1 MONTH AS DATE)) AS input_end,
        CAST(m + CAST(w * 2 + 16 AS INT) * INTERVAL 1 MONTH AS DATE) AS output_start, last_day(CAST(m + CAST(w * 2 + 21 AS INT) * INTERVAL 1 MONTH AS DATE)) AS output_end
        FROM (SELECT m, unnest(range(0, CAST(floor((n - 22) / 2) AS BIGINT) + 1)) AS w FROM (SELECT CAST(date_trunc('month', lo) AS DATE) AS m, datediff('month', lo, hi) + 1 AS n FROM sales_days))""")  # fmt: skip
def j11_monthly_windows(spark, d):
    return windows.monthly_windows(spark, *_bounds(spark, d), 16, 6, stride=2)


@query("j12_event_coverage", """SELECT strftime(anchor, '%Y') AS name, anchor AS date, n_target, n_context, CASE WHEN n_target > 0 THEN 'target' WHEN n_context > 0 THEN 'context only' ELSE 'unseen' END AS role FROM (
        SELECT anchor, count(*) FILTER (WHERE anchor BETWEEN output_start AND output_end) AS n_target, count(*) FILTER (WHERE anchor >= input_start AND anchor < output_start) AS n_context FROM anchors, day_windows GROUP BY 1)""")  # fmt: skip
def j12_event_coverage(spark, d):
    events = view(spark, d, "anchors").select(F.date_format("anchor", "yyyy").alias("name"), F.col("anchor").alias("date"))
    return windows.event_coverage(j10_sliding_windows(spark, d), events)


@query("j13_val_bounds", """SELECT series, strip_start, strip_start + 14 AS first_target, CAST(greatest(train_end - (strip_start + 14) + 1, 0) AS INT) AS leak_days FROM (
        SELECT series, train_end, least(train_end + 1, val_end - 20) AS strip_start FROM (SELECT parent_dealer_code_model_family AS series, max(cal_date) - 10 AS train_end, max(cal_date) AS val_end FROM daily_panel GROUP BY 1))""")  # fmt: skip
def j13_val_bounds(spark, d):
    ends = view(spark, d, "daily_panel").groupBy(F.col("parent_dealer_code_model_family").alias("series")).agg(F.max("cal_date").alias("val_end"))
    params = ends.select("series", F.date_sub("val_end", 10).alias("train_end"), "val_end", F.lit(14).alias("icl"), F.lit(7).alias("ocl"))
    return windows.val_bounds(params).select("series", "strip_start", "first_target", "leak_days")


CTE["placed"] = """SELECT *, row_number() OVER (PARTITION BY series ORDER BY month_of_sale) AS place FROM panel"""


@query("j14_samples", """SELECT o.series, o.month_of_sale AS origin, CAST(s.step AS INT) AS step, o.net_sales AS lag_1, b.net_sales AS lag_2, l.net_sales AS lag_12, round(w.win_mean, 4) AS win_mean, w.win_max, t.month_of_sale AS target_date, t.net_sales AS target, q.net_sales AS season_lag
        FROM placed o CROSS JOIN (VALUES (1), (2), (3)) AS s(step) LEFT JOIN placed b ON b.series = o.series AND b.place = o.place - 1 LEFT JOIN placed l ON l.series = o.series AND l.place = o.place - 11
        JOIN (SELECT series, place, avg(net_sales) OVER x AS win_mean, max(net_sales) OVER x AS win_max FROM placed WINDOW x AS (PARTITION BY series ORDER BY place ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) w ON w.series = o.series AND w.place = o.place
        LEFT JOIN placed t ON t.series = o.series AND t.place = o.place + s.step LEFT JOIN placed q ON q.series = o.series AND q.place = o.place + s.step - 12 WHERE o.month_of_sale >= DATE '1999-01-01'""")  # fmt: skip
def j14_samples(spark, d):
    p = _panel(spark, d)
    origins = p.select(F.col("month_of_sale").alias("origin")).distinct().filter("origin >= DATE '1999-01-01'")
    out = forecast.make_samples(p, "series", "month_of_sale", "net_sales", origins, 3, lags=(1, 2, 12), window=6, season=12)
    return out.select("series", "origin", "step", "lag_1", "lag_2", "lag_12", *_r("win_mean"), "win_max", "target_date", "target", "season_lag")


@query("j21_lag_map_problems", """WITH m AS (SELECT DISTINCT printf('N%+d', d) AS lag_day, cal_date FROM near WHERE d BETWEEN -16 AND 10 UNION SELECT 'N+10', cal_date FROM near WHERE d = 9),
        flags AS (SELECT printf('N%+d', o) AS lag_day FROM (SELECT unnest(range(-16, 12)) AS o))
        SELECT CASE WHEN count(cal_date) = 0 THEN 'no date' ELSE 'several dates' END AS problem, f.lag_day AS key, count(cal_date) AS n FROM flags f LEFT JOIN m ON f.lag_day = m.lag_day GROUP BY f.lag_day HAVING count(cal_date) <> 1
        UNION ALL SELECT 'several lag days', CAST(cal_date AS VARCHAR), count(*) FROM m GROUP BY cal_date HAVING count(*) > 1""")  # fmt: skip
def j21_lag_map_problems(spark, d):
    """Over all years a lag day has a date in each; the last one is set a day early as well, and one flag is never set."""
    days = calendar.nearest_anchor(_days(spark, d), view(spark, d, "anchors"))
    flags = {n: (F.col("offset_days") == int(n[1:])).cast("int") for n in _LAGS} | {"N+10": F.col("offset_days").isin(9, 10).cast("int")}
    names = spark.range(-16, 12).select(F.format_string("N%+d", "id").alias("lag_day"))
    return calendar.lag_map_problems(calendar.lag_date_map(days.withColumns(flags), _LAGS), names)


@query("j23_finish_forecast", "SELECT series, month_of_sale, round_even(greatest(model_a - 5, 0), 2) AS forecast FROM scored WHERE month_of_sale BETWEEN DATE '2000-03-01' AND DATE '2000-08-31'")
def j23_finish_forecast(spark, d):
    rows = _scored(spark, d).select("series", "month_of_sale", (F.col("model_a") - 5).alias("forecast"))
    return forecast.finish_forecast(rows, "forecast", "month_of_sale", "2000-03-01", "2000-08-31")


@query("j24_sweep")
def j24_sweep(spark, d):
    """Two settings of the panel forecaster by their backtest's error, best first; the rows are those of fitted models."""
    p = _panel(spark, d)
    origins = p.select(F.col("month_of_sale").alias("origin")).distinct().filter("origin >= DATE '1997-01-01'")
    samples = staged(forecast.make_samples(p, "series", "month_of_sale", "net_sales", origins, 2, lags=(1, 2, 12), window=6, season=12), "samples")
    return forecast.sweep(samples, [{"regParam": 0.0}, {"regParam": 0.5}], "series", ["lag_1", "lag_2", "lag_12", "win_mean", "season_lag", "step"], "2000-01-01")


# Planning ------------------------------------------------------------------------------------


@query("k4_stage_forecast", f"""SELECT forecast_month, parent_dealer_code, split_part(model_family_code, '<>', 1) AS model_family, model_family_code, {_rs('forecast')}, '20260801' AS run_date, 'v1' AS run_version, '202608' AS planning_month FROM family_fc""")
def k4_stage_forecast(spark, d):
    """The forecast as delivered (one key), taken apart, tagged and published; as read back."""
    fc = _family_forecast(_staged_sales(spark, d)).select("forecast_month", F.concat_ws("<>", "parent_dealer_code", "model_family_code").alias("key"), "forecast")
    path = scratch_dir(spark, "predictions")
    io.append_run(planning.stage_forecast(fc, "key", {}), path, RunTags("20260801", "v1", "202608"))
    return spark.read.parquet(path).select("forecast_month", "parent_dealer_code", "model_family", "model_family_code", *_r("forecast"), F.col("run_date").cast("string").alias("run_date"), "run_version", "planning_month")


CTE["weekly"] = f"SELECT {_SERIES} AS series, CAST(date_trunc('week', cal_date) AS DATE) AS ts, sum(net_sales) / 7 - 2 AS forecast FROM mapped GROUP BY 1, 2"


@query("k5_weekly_to_monthly", """SELECT series, CAST(date_trunc('month', ts + 3) AS DATE) AS month_date, CASE WHEN sum(forecast) < 0 THEN 0.0 ELSE round_even(sum(forecast), 0) END + 0.0 AS forecast FROM weekly GROUP BY 1, 2""")
def k5_weekly_to_monthly(spark, d):
    """Weekly forecasts; a week belongs to the month of its Thursday."""
    week = F.trunc("cal_date", "week")
    weekly = _mapped(spark, d).groupBy(mapping.series_key().alias("series"), week.alias("ts")).agg((F.sum("net_sales") / 7 - 2).alias("forecast"))
    dates = _days(spark, d).select(week.alias("date")).distinct().withColumn("month_date", F.trunc(F.date_add("date", 3), "MM"))
    return planning.weekly_to_monthly(weekly, dates).withColumn("forecast", F.col("forecast") + 0.0)


@query("k10_strict_weights", """SELECT f.forecast_month, f.parent_dealer_code, f.model_family_code, w.sku, round(w.share, 6) AS share, w.family_sales = 0 AS no_history_flag, round(CASE WHEN w.family_sales <> 0 THEN f.forecast * w.share END, 0) + 0.0 AS sku_forecast FROM family_fc f
        LEFT JOIN (SELECT *, sales / nullif(family_sales, 0) AS share FROM (SELECT *, sum(sales) OVER (PARTITION BY forecast_month, parent_dealer_code, model_family_code) AS family_sales FROM recent)) w
        ON w.forecast_month = f.forecast_month AND w.parent_dealer_code = f.parent_dealer_code AND w.model_family_code = f.model_family_code""")  # fmt: skip
def k10_strict_weights(spark, d):
    sales = _staged_sales(spark, d)
    recent = disagg.lookback_sales(sales, _forecast_months(sales), ["parent_dealer_code", "model_family_code", "sku"])
    out = disagg.strict_weights(_family_forecast(sales), recent)
    return out.select("forecast_month", "parent_dealer_code", "model_family_code", "sku", *_r("share", digits=6), "no_history_flag", *_r("sku_forecast", digits=0))


@query("k11_share_of_window", """SELECT parent_dealer_code, model_family_code, sku, sku_sales, family_sales, n_skus, round(sku_sales / nullif(family_sales, 0), 6) AS share FROM (
        SELECT *, sum(sku_sales) OVER w AS family_sales, count(*) OVER w AS n_skus FROM (SELECT parent_dealer_code, model_family_code, sku, sum(net_sales) AS sku_sales FROM sku_monthly, run
          WHERE month_of_sale >= run_month - INTERVAL 3 MONTH AND month_of_sale < run_month GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY parent_dealer_code, model_family_code))""")  # fmt: skip
def k11_share_of_window(spark, d):
    sales = _staged_sales(spark, d)
    run = _forecast_months(sales).agg(F.max("forecast_month").alias("run_month"))
    out = disagg.sku_share_of_window(planning.run_window(sales, run, 3))
    return out.select("parent_dealer_code", "model_family_code", "sku", "sku_sales", "family_sales", "n_skus", *_r("share", digits=6))


@query("k18_order_inputs", """SELECT parent_dealer_code, sku, abc_class, CAST(closing_stock AS BIGINT) AS closing_stock, max_lead_time FROM orders_in""")
def k18_order_inputs(spark, d):
    return _order_candidates(spark, d).select("parent_dealer_code", "sku", "abc_class", "closing_stock", "max_lead_time")


# Validations ---------------------------------------------------------------------------------


@query("v2_columns", "SELECT m AS missing, count(*) AS n_rows FROM retail, (VALUES ('plant'), ('run_date')) AS t(m) GROUP BY 1")
def v2_columns(spark, d):
    """Required columns that the feed lacks, with the rows that are affected."""
    rows = view(spark, d, "retail")
    lacking = checks.check_columns(spark, rows, ["cal_date", "sku", "plant", "dealer_code", "run_date"])
    return rows.crossJoin(F.broadcast(lacking)).groupBy("missing").agg(F.count("*").alias("n_rows"))


@query("v4_index_ranges", f"""SELECT year, series, CAST(lo_found AS INT) AS lo_found, CAST(hi_found AS INT) AS hi_found, n_found, coalesce(lo, 0) AS lo, coalesce(hi, 0) AS hi, coalesce(n, 0) AS n FROM (SELECT {_SERIES} AS series, CAST(year(month_of_sale) AS INT) AS year, min(year(month_of_sale) * 12 + month(month_of_sale)) AS lo_found, max(year(month_of_sale) * 12 + month(month_of_sale)) AS hi_found, count(*) AS n_found FROM monthly GROUP BY 1, 2)
        LEFT JOIN (SELECT y AS year, CAST(y * 12 + 1 AS INT) AS lo, CAST(y * 12 + 12 AS INT) AS hi, CAST(12 AS INT) AS n FROM (VALUES (CAST(1996 AS INT)), (1997), (1998), (1999), (2000)) AS t(y)) USING (year) WHERE coalesce(lo_found <> lo OR hi_found <> hi OR n_found <> n, true)""")  # fmt: skip
def v4_index_ranges(spark, d):
    """Series and years that were not sold in every month; years that are not expected at all are listed too."""
    rows = _monthly(spark, d).select(mapping.series_key().alias("series"), F.year("month_of_sale").alias("year"), (F.year("month_of_sale") * 12 + F.month("month_of_sale")).alias("place"))
    expected = io.from_rows(spark, [(y, 12 * y + 1, 12 * y + 12, 12) for y in range(1996, 2001)], "year int, lo int, hi int, n int")
    found = checks.check_index_ranges(rows, expected, "series", "year", "place")
    return C.fill_nulls(found, {"lo": 0, "hi": 0, "n": 0}).select("year", "series", "lo_found", "hi_found", "n_found", "lo", "hi", "n")


@query("v5_date_coverage", """SELECT parent_dealer_code, year, first, last, n_days FROM (SELECT parent_dealer_code, CAST(year(cal_date) AS INT) AS year, min(cal_date) AS first, max(cal_date) AS last, count(DISTINCT cal_date) AS n_days FROM mapped
        WHERE month(cal_date) >= 9 GROUP BY 1, 2) WHERE first <> make_date(year, 9, 1) OR last <> make_date(year, 12, 31) OR n_days <> 122""")  # fmt: skip
def v5_date_coverage(spark, d):
    return checks.check_date_coverage(_mapped(spark, d).filter(F.month("cal_date") >= 9), "parent_dealer_code", "cal_date").select("parent_dealer_code", "year", "first", "last", "n_days")


@query("v7_covariates", """SELECT 'last_year' AS column_name, count(*) FILTER (WHERE q.net_sales IS NULL) AS n, 'null' AS problem FROM panel p LEFT JOIN panel q ON p.series = q.series AND q.month_of_sale = p.month_of_sale - INTERVAL 12 MONTH
        UNION ALL SELECT 'model_family', count(*) FILTER (WHERE model_family IS NULL), 'not numeric' FROM panel""")  # fmt: skip
def v7_covariates(spark, d):
    rows = panel.last_year_value(_panel(spark, d), ["series"], "month_of_sale", "net_sales", "last_year")
    return checks.check_covariates(rows, ["net_sales", "last_year", "model_family"])


@query("h1_i24_concat_and_fill", "SELECT x_customer_type, count(*) AS n, sum(coalesce(returned_sales, 0)) AS returned_sales FROM retail WHERE x_customer_type IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') GROUP BY 1")
def h1_i24_concat_and_fill(spark, d):
    rows = view(spark, d, "retail")
    parts = joins.concat(*[C.filter_retail(rows, [t]) for t in TYPES])
    return C.fill_nulls(parts, {"returned_sales": 0.0}).groupBy("x_customer_type").agg(F.count("*").alias("n"), F.sum("returned_sales").alias("returned_sales"))
