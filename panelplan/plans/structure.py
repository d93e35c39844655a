"""Queries of what spares passes and shuffles: one-scan validation, audited writes, bucketed joins, coverage in closed form."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelplan.operators import checks, forecast, windows
from panelplan.plans.registry import CTE, _mapped, _panel, _r, _rs, query
from panelplan.plans.storage import _name, _read_and_dropped
from panelplan.plans.views import ANCHORS, source, view
from panelplan.sources import io
from panelplan.sources.scratch import scratch_dir

_STRICT = "l_partkey", "place", "day", "l_quantity"
CTE["strict_rows"] = "SELECT l_partkey, CAST(l_shipdate AS DATE) - DATE '1992-01-01' AS place, CAST(l_shipdate AS DATE) AS day, l_quantity, l_suppkey, l_discount, l_tax FROM lineitem"
CTE["strict_keys"] = "SELECT l_partkey, place, count(*) AS n FROM strict_rows GROUP BY 1, 2"
CTE["strict_series"] = """SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE day > DATE '1998-06-30' AND l_quantity IS NOT NULL OR day <= DATE '1998-06-30' AND (l_quantity IS NULL OR l_quantity < 0)) AS wrong FROM strict_rows GROUP BY 1"""


@query("v_strict_report", """SELECT 'V1 grain' AS check_name, count(*) FILTER (WHERE n > 1) AS violations FROM strict_keys
        UNION ALL SELECT 'V3 contiguous', count(*) FROM (SELECT place - lag(place) OVER (PARTITION BY l_partkey ORDER BY place) AS gap FROM strict_keys) WHERE gap <> 1
        UNION ALL SELECT 'V6 static', count(*) FILTER (WHERE suppliers > 1) FROM strict_series UNION ALL SELECT 'V8 targets', count(*) FILTER (WHERE wrong > 0) FROM strict_series
        UNION ALL SELECT 'V10 length', count(*) FILTER (WHERE n < 30) FROM strict_series
        UNION ALL SELECT 'V7 covariate l_discount', count(*) FILTER (WHERE l_discount IS NULL) FROM strict_rows UNION ALL SELECT 'V7 covariate l_tax', count(*) FILTER (WHERE l_tax IS NULL) FROM strict_rows""")  # fmt: skip
def v_strict_report(spark, d):
    """All strict checks of sales by part and day, in one scan of lineitem."""
    rows = source(spark, d, "lineitem").withColumns({"day": F.to_date("l_shipdate"), "place": F.date_diff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date"))})
    report = checks.strict_report(rows, *_STRICT[:2], "day", "l_quantity", "1998-06-30", ["l_suppkey"], ["l_discount", "l_tax"], 30)
    return report.select("check_name", "violations")


@query("a12_audited_write", """SELECT 'lineitem' AS source, unnest(['rows', 'columns', 'duplicate_keys']) AS check_name, unnest([CAST(sum(n) AS BIGINT), 2, count(*) FILTER (WHERE n > 1)]) AS value FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
        UNION ALL SELECT 'orders', unnest(['rows', 'columns', 'duplicate_keys']), unnest([CAST(sum(n) AS BIGINT), 2, count(*) FILTER (WHERE n > 1)]) FROM (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1)""")  # fmt: skip
def a12_audited_write(spark, d):
    """Two tables written, and their audit rows from the jobs that wrote them."""
    audit = scratch_dir(spark, "audit")
    for name, key, more in (("lineitem", "l_orderkey", "l_partkey"), ("orders", "o_orderkey", "o_custkey")):
        io.write_audited(source(spark, d, name).select(key, more), scratch_dir(spark, name), [key], name, audit)
    return spark.read.parquet(audit).select("source", "check_name", "value")


def bucketed_blend(model, trend, series: str = "series", date: str = "cal_date"):
    """The blend of two tables bucketed by series, and each day's share of its series: a join and a window that shuffle nothing."""
    mixed = forecast.blend(model, trend, series, date)
    return mixed.withColumn("share", F.try_divide("blended", F.sum("blended").over(Window.partitionBy(series))))


CTE["blend_model"] = "SELECT concat(parent_dealer_code, '<>', model_family) AS series, CAST(cal_date + INTERVAL 12 MONTH AS DATE) AS cal_date, sum(net_sales) AS model FROM mapped WHERE year(cal_date) = 2000 GROUP BY 1, 2"
CTE["blend_trend"] = "SELECT concat(parent_dealer_code, '<>', model_family) AS series, CAST(cal_date + INTERVAL 24 MONTH AS DATE) AS cal_date, sum(net_sales) AS trend FROM mapped WHERE year(cal_date) = 1999 AND month(cal_date) = 11 GROUP BY 1, 2"


@query("a9_bucketed_blend", f"""SELECT series, cal_date, {_rs('model', 'blended')}, round(blended / nullif(sum(blended) OVER (PARTITION BY series), 0), 6) + 0.0 AS share FROM (
        SELECT m.series, m.cal_date, m.model, CASE WHEN t.series IS NOT NULL THEN t.trend * 0.5 + m.model * 0.5 ELSE m.model END AS blended FROM blend_model m LEFT JOIN blend_trend t ON m.series = t.series AND m.cal_date = t.cal_date)""")  # fmt: skip
def a9_bucketed_blend(spark, d):
    """Two tables bucketed by series, blended in place."""
    from panelplan.operators.mapping import series_key

    sales, names = _mapped(spark, d), {"model": _name(), "trend": _name()}
    parts = {"model": (sales.filter(F.year("cal_date") == 2000), 12), "trend": (sales.filter((F.year("cal_date") == 1999) & (F.month("cal_date") == 11)), 24)}
    for name, (rows, months) in parts.items():
        total = rows.groupBy(series_key().alias("series"), F.add_months("cal_date", months).alias("cal_date")).agg(F.sum("net_sales").alias(name))
        io.write_series_table(total, names[name], "series", 8, scratch_dir(spark, "buckets"))
    io.use_buckets(spark)
    mixed = bucketed_blend(io.read_table(spark, names["model"]), io.read_table(spark, names["trend"]))
    return _read_and_dropped(mixed.select("series", "cal_date", *_r("model", "blended"), *_r("share", digits=6)), *names.values())


CTE["series_days"] = "SELECT parent_dealer_code_model_family AS series, min(cal_date) AS lo, max(cal_date) AS hi FROM daily_panel GROUP BY 1"


@query("j12_series_coverage", """SELECT series, strftime(anchor, '%Y') AS name, anchor AS date, n_target, n_context, CASE WHEN n_target > 0 THEN 'target' WHEN n_context > 0 THEN 'context only' ELSE 'unseen' END AS role FROM (
        SELECT w.series, a.anchor, count(*) FILTER (WHERE a.anchor BETWEEN b + 14 AND b + 20) AS n_target, count(*) FILTER (WHERE a.anchor >= b AND a.anchor < b + 14) AS n_context
        FROM (SELECT series, lo + CAST(w AS INT) AS b FROM (SELECT series, lo, n, unnest(range(0, n)) AS w FROM (SELECT *, (hi - lo) + 1 - 21 + 1 AS n FROM series_days) WHERE n > 0) WHERE n - 1 - w < 400) w, anchors a GROUP BY 1, 2)""")  # fmt: skip
def j12_series_coverage(spark, d):
    """In how many of a series' newest 400 windows each event is a target or context."""
    bounds = view(spark, d, "daily_panel").groupBy(F.col("parent_dealer_code_model_family").alias("series")).agg(F.min("cal_date").alias("lo"), F.max("cal_date").alias("hi"))
    return windows.event_coverage_by_series(bounds, [(a[:4], a) for a in ANCHORS], 14, 7, cap=400)


@query("i22_relative_steps", "SELECT series, month_of_sale, CAST(row_number() OVER (PARTITION BY series ORDER BY month_of_sale) - count(*) OVER (PARTITION BY series) AS INT) AS relative_step FROM panel")
def i22_relative_steps(spark, d):
    return windows.relative_steps(_panel(spark, d).select("series", "month_of_sale"), "series", "month_of_sale")
