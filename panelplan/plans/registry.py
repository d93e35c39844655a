"""Registered queries: operators over the planning views, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelplan.functions import columns as C
from panelplan.operators import calendar, checks, disagg, forecast, joins, mapping, metrics, panel, planning, profile, reports, windows
from panelplan.operators.ranking import with_running
from panelplan.plans.views import VIEWS, load, source, view, with_views
from panelplan.sources.scratch import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RETAIL = ("retail", "dealer_hierarchy", "sku_source", "family_mapping", "obd_mapping")
TYPES = ["BUILDING", "AUTOMOBILE", "MACHINERY"]

#: Common table expressions that the oracles build on, in order.
CTE = {
    "skus": """SELECT s.sku, s.model, m.model_family, concat(m.model_family, '<>', substring(s.uniquefamilycode, strpos(s.uniquefamilycode, '<>') + 2)) AS model_family_code, s.skustatus
               FROM sku_source s LEFT JOIN family_mapping m ON s.model = m.model""",
    "following": """SELECT o.previous_obd_sku AS sku, min(o.current_obd_sku) AS current_sku FROM obd_mapping o JOIN skus s ON o.current_obd_sku = s.sku
                    WHERE lower(s.skustatus) = 'active' GROUP BY 1""",
    "dealers": "SELECT DISTINCT x_dealer_code_hier AS dealer_code, trim(split_part(par_org_name, '-', 1)) AS parent_dealer_code FROM dealer_hierarchy WHERE x_dealer_code_hier IS NOT NULL",
    "mapped": """SELECT r.cal_date, d.parent_dealer_code, s.model_family, s.model_family_code, s.sku, r.invoiced_sales + r.cancelled_sales + r.returned_sales AS net_sales
                 FROM retail r LEFT JOIN following f ON r.sku = f.sku JOIN skus s ON coalesce(f.current_sku, r.sku) = s.sku JOIN dealers d ON r.dealer_code = d.dealer_code
                 WHERE r.x_customer_type IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')""",
    "monthly": """SELECT parent_dealer_code, model_family, CAST(date_trunc('month', cal_date) AS DATE) AS month_of_sale, sum(net_sales) AS net_sales FROM mapped GROUP BY 1, 2, 3""",
    "spine": """SELECT CAST(unnest(generate_series(CAST((SELECT min(month_of_sale) FROM monthly) AS TIMESTAMP), CAST((SELECT max(month_of_sale) FROM monthly) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month_of_sale""",
    "panel": """SELECT k.parent_dealer_code, k.model_family, concat(k.parent_dealer_code, '<>', k.model_family) AS series, s.month_of_sale, coalesce(m.net_sales, 0) AS net_sales
                FROM (SELECT DISTINCT parent_dealer_code, model_family FROM monthly) k CROSS JOIN spine s
                LEFT JOIN monthly m ON m.parent_dealer_code = k.parent_dealer_code AND m.model_family = k.model_family AND m.month_of_sale = s.month_of_sale""",
    "sku_monthly": """SELECT parent_dealer_code, model_family_code, sku, CAST(date_trunc('month', cal_date) AS DATE) AS month_of_sale, sum(net_sales) AS net_sales FROM mapped GROUP BY 1, 2, 3, 4""",
    "fmonths": "SELECT DISTINCT month_of_sale AS forecast_month FROM sku_monthly ORDER BY 1 DESC LIMIT 4",
    "family_fc": """SELECT f.forecast_month, m.parent_dealer_code, m.model_family_code, sum(m.net_sales) / 3.0 AS forecast
                    FROM sku_monthly m JOIN fmonths f ON m.month_of_sale >= f.forecast_month - INTERVAL 3 MONTH AND m.month_of_sale < f.forecast_month GROUP BY 1, 2, 3""",
    "recent": """SELECT f.forecast_month, m.parent_dealer_code, m.model_family_code, m.sku, sum(m.net_sales) AS sales
                 FROM sku_monthly m JOIN fmonths f ON m.month_of_sale >= f.forecast_month - INTERVAL 3 MONTH AND m.month_of_sale < f.forecast_month GROUP BY 1, 2, 3, 4""",
    "shares": """SELECT forecast_month, parent_dealer_code, model_family_code, sku, forecast, sales, family_sales, n_skus, family_sales = 0 AS no_history_flag,
                        round_even(CASE WHEN family_sales = 0 THEN 1.0 / n_skus WHEN sales = 0 THEN 0.0 ELSE sales / family_sales END, 5) AS share
                 FROM (SELECT *, sum(sales) OVER w AS family_sales, count(*) OVER w AS n_skus FROM (
                   SELECT f.*, s.sku, coalesce(r.sales, 0) AS sales FROM family_fc f JOIN skus s ON f.model_family_code = s.model_family_code AND lower(s.skustatus) = 'active'
                   LEFT JOIN recent r ON r.forecast_month = f.forecast_month AND r.parent_dealer_code = f.parent_dealer_code AND r.model_family_code = f.model_family_code AND r.sku = s.sku)
                   WINDOW w AS (PARTITION BY forecast_month, parent_dealer_code, model_family_code))""",
    "sku_fc": "SELECT *, CASE WHEN n_skus = 1 THEN forecast ELSE share * forecast END AS sku_forecast FROM shares",
    "scored": """SELECT p.series, p.month_of_sale, p.net_sales AS actual,
                        avg(p.net_sales) OVER (PARTITION BY p.series ORDER BY p.month_of_sale ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS model_a,
                        coalesce(q.net_sales, 0) AS model_b
                 FROM panel p LEFT JOIN panel q ON p.series = q.series AND q.month_of_sale = p.month_of_sale - INTERVAL 12 MONTH""",
    "typed": """SELECT series, CASE WHEN running <= 70 THEN 'Runner' WHEN running <= 90 THEN 'Repeater' ELSE 'Stranger' END AS sku_type FROM (
                  SELECT series, sum(total) OVER (ORDER BY total DESC, series ROWS UNBOUNDED PRECEDING) * 100 / sum(total) OVER () AS running
                  FROM (SELECT series, sum(net_sales) AS total FROM panel GROUP BY 1))""",
}


def _needs(name: str, text: str) -> list[str]:
    """Views and expressions that a text names, with those that they need, in order."""
    import re

    found: list[str] = []

    def add(sql: str, own: str = "") -> None:
        for n in [*VIEWS, *CTE]:
            if n != own and n not in found and re.search(rf"\b{n}\b", sql):
                add(VIEWS.get(n) or CTE[n], n)
                if n not in found:
                    found.append(n)

    add(text)
    return found


def _duck(sql: str) -> str:
    names = _needs("", sql)
    return with_views(sql, **{n: VIEWS.get(n) or CTE[n] for n in names})


def query(name: str, sql: str | None = None):
    """Register a query, and its DuckDB text with the expressions that it names."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = _duck(sql)
        return f

    return keep


# What the queries start from -----------------------------------------------------------------


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    load(spark, d)
    return {n: spark.sql(VIEWS[n]) for n in RETAIL}


def _skus(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d)
    return mapping.sku_master(t["sku_source"], t["family_mapping"])


def _mapped(spark: SparkSession, d: str, family_from: str = "current") -> DataFrame:
    t = _tables(spark, d)
    return mapping.mapped_sales(C.filter_retail(t["retail"], TYPES), mapping.sku_master(t["sku_source"], t["family_mapping"]), t["obd_mapping"], t["dealer_hierarchy"], family_from)


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    return mapping.monthly_sales(_mapped(spark, d))


def _panel(spark: SparkSession, d: str) -> DataFrame:
    """The monthly panel without gaps, from monthly sales written once: its grid, its months and its values start from them, and so does each further use of it."""
    return panel.fill_gaps(staged(_monthly(spark, d), "monthly"), ["parent_dealer_code", "model_family"]).withColumn("series", mapping.series_key())


def _sku_monthly(spark: SparkSession, d: str, family_from: str = "current") -> DataFrame:
    return mapping.monthly_sales(_mapped(spark, d, family_from), ("parent_dealer_code", "model_family_code", "sku"))


def _forecast_months(sales: DataFrame, n: int | None = 4) -> DataFrame:
    """The newest n months, those of a planning run; None: all months."""
    months = sales.select(F.col("month_of_sale").alias("forecast_month")).distinct()
    return months if n is None else months.orderBy(F.col("forecast_month").desc()).limit(n)


def _family_forecast(sales: DataFrame, n: int | None = 4) -> DataFrame:
    recent = disagg.lookback_sales(sales, _forecast_months(sales, n), ["parent_dealer_code", "model_family_code"])
    return recent.select("forecast_month", "parent_dealer_code", "model_family_code", (F.col("sales") / 3).alias("forecast"))


def _staged_sales(spark: SparkSession, d: str, family_from: str = "current") -> DataFrame:
    """Monthly SKU sales, written once: months, family forecasts, look-backs and variability all start from them."""
    return staged(_sku_monthly(spark, d, family_from), "sku-monthly")


def _sku_forecast(spark: SparkSession, d: str, sales: DataFrame | None = None, n: int | None = 4) -> DataFrame:
    sales = _staged_sales(spark, d) if sales is None else sales
    return disagg.disaggregate_months(_family_forecast(sales, n), sales, _skus(spark, d))


def _scored(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    from pyspark.sql import Window

    p = (_panel(spark, d) if p is None else p).select("series", "month_of_sale", F.col("net_sales").alias("actual"))
    before = Window.partitionBy("series").orderBy("month_of_sale").rowsBetween(-3, -1)
    return forecast.seasonal_naive(p.withColumn("model_a", F.avg("actual").over(before)), "series", "month_of_sale", "actual").withColumnRenamed("naive", "model_b")


def _typed(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    totals = (_panel(spark, d) if p is None else p).groupBy("series").agg(F.sum("net_sales").alias("total"))
    ranked = with_running(totals, [-F.col("total"), F.col("series")], sums={"sold": "total"})
    running = F.col("sold") * 100 / F.col("whole")
    return ranked.crossJoin(F.broadcast(ranked.agg(F.sum("total").alias("whole")))).select("series", F.when(running <= 70, "Runner").when(running <= 90, "Repeater").otherwise("Stranger").alias("sku_type"))


def _r(*names: str, digits: int = 4) -> list:
    return [(F.round(n, digits) + F.lit(0.0)).alias(n) for n in names]  # + 0.0: no negative zero


def _rs(*names: str, digits: int = 4) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


# Mapping and panel ---------------------------------------------------------------------------


@query("k1_sku_master", "SELECT sku, model, model_family, model_family_code, concat(sku, '<>', model_family_code) AS sku_unique_family_code, skustatus FROM skus")
def k1_sku_master(spark, d):
    return _skus(spark, d).select("sku", "model", "model_family", "model_family_code", "sku_unique_family_code", "skustatus")


@query("k2_monthly_sales", "SELECT * FROM monthly")
def k2_monthly_sales(spark, d):
    return _monthly(spark, d)


@query("d2_monthly_sku_sales", "SELECT * FROM sku_monthly")
def d2_monthly_sku_sales(spark, d):
    return _sku_monthly(spark, d)


@query("j2_fill_gaps", "SELECT parent_dealer_code, model_family, series, month_of_sale, net_sales FROM panel")
def j2_fill_gaps(spark, d):
    return _panel(spark, d).select("parent_dealer_code", "model_family", "series", "month_of_sale", "net_sales")


@query("c3_rekey_sku", """SELECT coalesce(f.current_sku, r.sku) AS sku, count(*) AS n, sum(r.invoiced_sales) AS invoiced_sales
                          FROM retail r LEFT JOIN following f ON r.sku = f.sku GROUP BY 1""")  # fmt: skip
def c3_rekey_sku(spark, d):
    t = _tables(spark, d)
    rows = mapping.rekey_sku(t["retail"], mapping.successors(t["obd_mapping"], t["sku_source"]))
    return rows.groupBy("sku").agg(F.count("*").alias("n"), F.sum("invoiced_sales").alias("invoiced_sales"))


@query("c4_parent_dealer", "SELECT dealer_code, parent_dealer_code FROM dealers")
def c4_parent_dealer(spark, d):
    return mapping.parent_dealer(view(spark, d, "dealer_hierarchy"))


@query("d7_several_successors", "SELECT previous_obd_sku, count(DISTINCT current_obd_sku) AS successors FROM (SELECT * FROM obd_mapping UNION ALL SELECT previous_obd_sku, previous_obd_sku FROM obd_mapping WHERE CAST(previous_obd_sku AS INT) % 40 = 0) GROUP BY 1 HAVING count(DISTINCT current_obd_sku) > 1")
def d7_several_successors(spark, d):
    obd = view(spark, d, "obd_mapping")
    own = obd.filter(F.col("previous_obd_sku").cast("int") % 40 == 0).select("previous_obd_sku", F.col("previous_obd_sku").alias("current_obd_sku"))
    return mapping.several_successors(obd.unionByName(own))


@query("b1_b8_filtered_net_sales", """SELECT model, sum(invoiced_sales + cancelled_sales + returned_sales) AS net_sales, sum(greatest(invoiced_sales + cancelled_sales + returned_sales, 0)) AS clipped
                                      FROM retail WHERE x_customer_type IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') AND cal_date >= DATE '1996-01-01' AND cal_date < DATE '1998-01-01' GROUP BY 1""")  # fmt: skip
def b1_b8_filtered_net_sales(spark, d):
    rows = C.between_dates(C.filter_retail(view(spark, d, "retail"), TYPES), "cal_date", "1996-01-01", "1998-01-01")
    return rows.groupBy("model").agg(F.sum(C.net_sales()).alias("net_sales"), F.sum(C.net_sales(clip=True)).alias("clipped"))


@query("b4_b5_keep_and_drop_series", """WITH good AS (SELECT series FROM panel GROUP BY 1 HAVING count(*) FILTER (WHERE net_sales <> 0) >= 0.3 * count(*))
        SELECT series, count(*) AS n, sum(net_sales) AS total, series IN (SELECT series FROM good) AS kept FROM panel GROUP BY 1""")  # fmt: skip
def b4_b5_keep_and_drop_series(spark, d):
    p = _panel(spark, d)
    good = p.groupBy("series").agg((F.count_if(F.col("net_sales") != 0) / F.count("*")).alias("s")).filter("s >= 0.3")
    halves = [f(p, good, "series").groupBy("series").agg(F.count("*").alias("n"), F.sum("net_sales").alias("total")).withColumn("kept", F.lit(kept)) for f, kept in ((C.keep_series, True), (C.drop_series, False))]
    return joins.concat(*halves)


@query("b13_d8_fiscal_years", "SELECT concat('FY''', lpad(CAST(year(cal_date + INTERVAL 9 MONTH) % 100 AS STRING), 2, '0')) AS fiscal_year, sum(net_sales) AS total FROM mapped GROUP BY 1")
def b13_d8_fiscal_years(spark, d):
    return reports.sales_by_fiscal_year(_mapped(spark, d), C.fiscal_year(F.col("cal_date")), "net_sales")


@query("b15_swap_covariates", """WITH one AS MATERIALIZED (SELECT series, month_of_sale, net_sales FROM panel) SELECT p.series, p.month_of_sale, coalesce(s.net_sales, p.net_sales) AS net_sales FROM one p
        LEFT JOIN (VALUES (DATE '1998-10-01', DATE '1997-10-01'), (DATE '1998-11-01', DATE '1997-11-01')) AS v(target, source) ON p.month_of_sale = v.target
        LEFT JOIN one s ON s.series = p.series AND s.month_of_sale = v.source""")  # fmt: skip
def b15_swap_covariates(spark, d):
    pairs = spark.sql("SELECT * FROM VALUES (DATE '1998-10-01', DATE '1997-10-01'), (DATE '1998-11-01', DATE '1997-11-01') AS v(target, source)")
    return C.swap_covariates(_panel(spark, d), pairs, ["net_sales"], "series", "month_of_sale").select("series", "month_of_sale", "net_sales")


@query("b14_override_months", """SELECT p.series, p.month_of_sale, CASE WHEN month(p.month_of_sale) = 11 AND year(p.month_of_sale) = 1999 THEN 7.0 ELSE p.net_sales END AS net_sales FROM panel p""")
def b14_override_months(spark, d):
    fix = spark.sql("SELECT DATE '1999-11-01' AS month_of_sale, 7.0D AS net_sales")
    return C.override_months(_panel(spark, d), fix, ["month_of_sale"], ["net_sales"]).select("series", "month_of_sale", "net_sales")


@query("b16_extend_calendar", """SELECT cal_date, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CAST(l_shipdate AS DATE) AS cal_date, count(*) AS n FROM lineitem GROUP BY 1
        UNION ALL SELECT CAST(unnest(generate_series((SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem) + INTERVAL 1 DAY, TIMESTAMP '2002-03-31', INTERVAL 1 DAY)) AS DATE), 0) GROUP BY 1""")  # fmt: skip
def b16_extend_calendar(spark, d):
    days = source(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("cal_date")).agg(F.count("*").alias("n"))
    return C.extend_calendar(days, "cal_date", "2002-03-31")


@query("b20_parse_series_key", """SELECT DISTINCT series, split_part(series, '<>', 1) AS parent_dealer_code, split_part(series, '<>', 2) AS model_family,
        regexp_replace(series, '^[^<>]+<>', '') AS model_family_code FROM panel""")  # fmt: skip
def b20_parse_series_key(spark, d):
    return C.parse_series_key(_panel(spark, d).select("series").distinct(), "series")


@query("f1_f10_series_totals", """SELECT series, month_of_sale, net_sales, sum(net_sales) OVER (PARTITION BY series) AS series_total, sum(net_sales) OVER (PARTITION BY model_family, month_of_sale) AS family_total FROM panel""")
def f1_f10_series_totals(spark, d):
    p = profile.with_totals(_panel(spark, d), ["series"], "net_sales", "series_total")
    return profile.with_totals(p, ["model_family", "month_of_sale"], "net_sales", "family_total").select("series", "month_of_sale", "net_sales", "series_total", "family_total")


@query("f5_latest_row", "SELECT parent_dealer_code, model_family, month_of_sale, net_sales FROM (SELECT *, row_number() OVER (PARTITION BY parent_dealer_code ORDER BY month_of_sale DESC, net_sales DESC, model_family) AS rn FROM monthly) WHERE rn = 1")
def f5_latest_row(spark, d):
    return mapping.latest_row(_monthly(spark, d), ["parent_dealer_code"], [F.col("month_of_sale").desc(), F.col("net_sales").desc(), F.col("model_family")])


@query("f6_last_year_value", """WITH one AS MATERIALIZED (SELECT series, month_of_sale, net_sales, CAST(month_of_sale - INTERVAL 12 MONTH AS DATE) AS before FROM panel)
        SELECT p.series, p.month_of_sale, p.net_sales, q.net_sales AS last_year FROM one p LEFT JOIN one q ON p.series = q.series AND q.month_of_sale = p.before""")  # fmt: skip
def f6_last_year_value(spark, d):
    return panel.last_year_value(_panel(spark, d), ["series"], "month_of_sale", "net_sales", "last_year").select("series", "month_of_sale", "net_sales", "last_year")


@query("f8_duplicates", "SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n_rows FROM lineitem QUALIFY n_rows > 1")
def f8_duplicates(spark, d):
    return checks.duplicates(source(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


@query("f9_last_k", "SELECT series, month_of_sale, net_sales FROM panel QUALIFY row_number() OVER (PARTITION BY series ORDER BY month_of_sale DESC) <= 6")
def f9_last_k(spark, d):
    return panel.last_k(_panel(spark, d), "series", "month_of_sale", 6).select("series", "month_of_sale", "net_sales")


@query("f11_ordinal_encode", "SELECT p_partkey, p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS p_type_code FROM part")
def f11_ordinal_encode(spark, d):
    return panel.ordinal_encode(source(spark, d, "part").select("p_partkey", "p_type"), "p_type").withColumn("p_type_code", F.col("p_type_code").cast("bigint"))


@query("f12_pct_change", f"SELECT series, month_of_sale, {_rs('pct')} FROM (SELECT series, month_of_sale, (net_sales - lag(net_sales) OVER w) / nullif(lag(net_sales) OVER w, 0) * 100 AS pct FROM panel WINDOW w AS (PARTITION BY series ORDER BY month_of_sale))")
def f12_pct_change(spark, d):
    return panel.pct_change(_panel(spark, d), ["series"], "month_of_sale", "net_sales", 1, "pct").select("series", "month_of_sale", *_r("pct"))


@query("j3_split_panel", "SELECT CASE WHEN month_of_sale <= DATE '1999-12-01' THEN 'train' WHEN month_of_sale <= DATE '2000-12-01' THEN 'valid' ELSE 'test' END AS split, count(*) AS n, sum(net_sales) AS total FROM panel GROUP BY 1")
def j3_split_panel(spark, d):
    return panel.split_panel(_panel(spark, d), "month_of_sale", "1999-12-01", "2000-12-01").groupBy("split").agg(F.count("*").alias("n"), F.sum("net_sales").alias("total"))


@query("j5_warmup_strip", """SELECT series, count(*) FILTER (WHERE place > n_rows - greatest(n_val, 30)) AS strip_rows, bool_or(n_val > 0) AS has_val FROM (
        SELECT series, row_number() OVER (PARTITION BY series ORDER BY month_of_sale) AS place, count(*) OVER (PARTITION BY series) AS n_rows,
               count(*) FILTER (WHERE month_of_sale > DATE '2000-12-01') OVER (PARTITION BY series) AS n_val FROM panel) WHERE n_rows >= 30 GROUP BY 1""")  # fmt: skip
def j5_warmup_strip(spark, d):
    rows = panel.warmup_strip(_panel(spark, d), "series", "month_of_sale", "2000-12-01", 24, 6)
    return rows.groupBy("series").agg(F.count_if("in_val").alias("strip_rows"), F.bool_or("has_val").alias("has_val"))


@query("j6_scale_series", """SELECT p.series, p.month_of_sale, round(coalesce((p.net_sales - lo) / nullif(hi - lo, 0), 0), 6) AS scaled FROM panel p
        JOIN (SELECT series, min(net_sales) AS lo, max(net_sales) AS hi FROM panel WHERE month_of_sale <= DATE '1999-12-01' GROUP BY 1) s ON p.series = s.series""")  # fmt: skip
def j6_scale_series(spark, d):
    p = _panel(spark, d)
    scaler = panel.fit_scaler(p.filter("month_of_sale <= DATE '1999-12-01'"), ["series"], "net_sales")
    return panel.scale(p, scaler, ["series"], "net_sales").select("series", "month_of_sale", *_r("scaled", digits=6))


# Disaggregation ------------------------------------------------------------------------------


@query("c6_lookback_sales", "SELECT * FROM recent")
def c6_lookback_sales(spark, d):
    sales = _staged_sales(spark, d)
    return disagg.lookback_sales(sales, _forecast_months(sales), ["parent_dealer_code", "model_family_code", "sku"])


@query("d5_num_active_skus", "SELECT model_family_code, count(DISTINCT sku) AS n_active FROM skus WHERE lower(skustatus) = 'active' GROUP BY 1")
def d5_num_active_skus(spark, d):
    return disagg.num_active_skus(C.active_skus(_skus(spark, d)))


#: The chain behind the SKU forecast once more, from sales whose family is that of the SKU as sold, and for all months.
CTE["mapped_as_sold"] = """SELECT r.cal_date, d.parent_dealer_code, s.model_family, s.model_family_code, coalesce(f.current_sku, r.sku) AS sku, r.invoiced_sales + r.cancelled_sales + r.returned_sales AS net_sales
    FROM retail r JOIN skus s ON r.sku = s.sku LEFT JOIN following f ON r.sku = f.sku JOIN dealers d ON r.dealer_code = d.dealer_code WHERE r.x_customer_type IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')"""
for _suffix, _base in (("_as_sold", "mapped_as_sold"), ("_all", "mapped")):
    for _name in ("sku_monthly", "fmonths", "family_fc", "recent", "shares", "sku_fc"):
        _text = CTE[_name].replace(" LIMIT 4", "" if _suffix == "_all" else " LIMIT 4").replace("FROM mapped", f"FROM {_base}")
        for _part in ("sku_monthly", "fmonths", "family_fc", "recent", "shares"):
            _text = _text.replace(f"FROM {_part}", f"FROM {_part}{_suffix}").replace(f"JOIN {_part}", f"JOIN {_part}{_suffix}")
        CTE[f"{_name}{_suffix}"] = _text
_K9 = f"SELECT forecast_month, parent_dealer_code, model_family_code, sku, n_skus, no_history_flag, round(share, 5) AS share, {_rs('sku_forecast', digits=6)} FROM "


def _k9(found: DataFrame) -> DataFrame:
    return found.select("forecast_month", "parent_dealer_code", "model_family_code", "sku", "n_skus", "no_history_flag", *_r("share", digits=5), *_r("sku_forecast", digits=6))


@query("k9_disaggregate_months", _K9 + "sku_fc_as_sold")
def k9_disaggregate_months(spark, d):
    """Families are those of the SKUs as sold, looked up before the re-key."""
    return _k9(_sku_forecast(spark, d, _staged_sales(spark, d, "original")))


@query("k9_current_family", _K9 + "sku_fc")
def k9_current_family(spark, d):
    """Families are those of the current SKUs, looked up after the re-key."""
    return _k9(_sku_forecast(spark, d))


@query("k9_all_months", _K9 + "sku_fc_all")
def k9_all_months(spark, d):
    """Every month of the history as a forecast month."""
    return _k9(_sku_forecast(spark, d, n=None))


@query("d34_reconcile", "SELECT forecast_month, parent_dealer_code, model_family_code, round(max(forecast), 2) AS family_forecast, round(sum(sku_forecast), 2) AS sku_total, round(abs(max(forecast) - sum(sku_forecast)), 2) + 0.0 AS difference FROM sku_fc GROUP BY 1, 2, 3")
def d34_reconcile(spark, d):
    return disagg.reconcile(_sku_forecast(spark, d)).select("forecast_month", "parent_dealer_code", "model_family_code", *_r("family_forecast", "sku_total", "difference", digits=2))


# Planning ------------------------------------------------------------------------------------

#: The planning run is that of the newest forecast month; variability looks at the 12 months before it.
CTE["run"] = "SELECT max(forecast_month) AS run_month FROM fmonths"
CTE["year_sales"] = "SELECT m.* FROM sku_monthly m, run WHERE m.month_of_sale >= run_month - INTERVAL 12 MONTH AND m.month_of_sale < run_month"
_DEVIATION = """SELECT {keys}, CASE WHEN count(*) <= 2 THEN 1.0 ELSE coalesce(stddev_samp(c), 1.0) END AS variability, count(*) AS n_months
    FROM (SELECT *, net_sales - lag(net_sales) OVER (PARTITION BY {keys} ORDER BY month_of_sale) AS c FROM {sales}) GROUP BY {keys}"""
CTE["sku_variability"] = _DEVIATION.format(keys="parent_dealer_code, model_family_code, sku", sales="year_sales")
CTE["family_variability"] = _DEVIATION.format(keys="parent_dealer_code, model_family_code", sales="(SELECT parent_dealer_code, model_family_code, month_of_sale, sum(net_sales) AS net_sales FROM year_sales GROUP BY 1, 2, 3)")


def _year_sales(sales: DataFrame) -> DataFrame:
    run = _forecast_months(sales).agg(F.max("forecast_month").alias("run_month"))
    return planning.run_window(sales, run, 12)


@query("k3_run_windows", """SELECT k, parent_dealer_code, count(*) AS n, sum(net_sales) AS net_sales FROM sku_monthly, run, (VALUES (3), (12)) AS w(k)
        WHERE month_of_sale >= run_month - CAST(k AS INT) * INTERVAL 1 MONTH AND month_of_sale < run_month GROUP BY 1, 2""")  # fmt: skip
def k3_run_windows(spark, d):
    sales = _staged_sales(spark, d)
    run = _forecast_months(sales).agg(F.max("forecast_month").alias("run_month"))
    parts = [planning.run_window(sales, run, k).groupBy(F.lit(k).alias("k"), "parent_dealer_code").agg(F.count("*").alias("n"), F.sum("net_sales").alias("net_sales")) for k in (3, 12)]
    return joins.concat(*parts)


@query("k12_demand_variability", f"""SELECT 'sku' AS basis, parent_dealer_code, model_family_code, sku, n_months, {_rs('variability')} FROM sku_variability
        UNION ALL SELECT 'family', parent_dealer_code, model_family_code, NULL, n_months, {_rs('variability')} FROM family_variability""")  # fmt: skip
def k12_demand_variability(spark, d):
    sales = _year_sales(_staged_sales(spark, d))
    own = planning.demand_variability(sales, ["parent_dealer_code", "model_family_code", "sku"])
    family = planning.demand_variability(planning.family_sales(sales), ["parent_dealer_code", "model_family_code"]).withColumn("sku", F.lit(None).cast("string"))
    return joins.concat(*[x.select(F.lit(b).alias("basis"), "parent_dealer_code", "model_family_code", "sku", "n_months", *_r("variability")) for b, x in (("sku", own), ("family", family))])


CTE["plan_fc"] = "SELECT f.* FROM sku_fc f, run WHERE forecast_month = run_month"
CTE["abc"] = """SELECT parent_dealer_code, model_family_code, CASE WHEN running < 70 THEN 'A' WHEN running > 90 THEN 'C' ELSE 'B' END AS abc_class FROM (
    SELECT parent_dealer_code, model_family_code, sum(pct) OVER (PARTITION BY parent_dealer_code ORDER BY forecast DESC, model_family_code ROWS UNBOUNDED PRECEDING) AS running FROM (
      SELECT *, coalesce(forecast * 100 / nullif(sum(forecast) OVER (PARTITION BY parent_dealer_code), 0), 0) AS pct FROM (SELECT DISTINCT parent_dealer_code, model_family_code, forecast FROM plan_fc)))"""


def _plan_forecast(spark, d, sales):
    """SKU forecasts of the planning month, the newest; only that month is looked back from."""
    return _sku_forecast(spark, d, sales, n=1)


def _plan_families(spark, d, sales):
    """Family forecasts of the planning month, of families with an active SKU."""
    active = C.active_skus(_skus(spark, d)).select("model_family_code").distinct()
    return _family_forecast(sales, 1).join(active, "model_family_code", "left_semi")


def _abc(families: DataFrame) -> DataFrame:
    """ABC class of each family of a dealer, by the family's forecast."""
    return planning.abc_class(families, ["parent_dealer_code"], "forecast", "model_family_code").select("parent_dealer_code", "model_family_code", "abc_class")


@query("k13_abc_class", "SELECT * FROM abc")
def k13_abc_class(spark, d):
    return _abc(_plan_families(spark, d, _staged_sales(spark, d)))


@query("k13_abc_policy", "SELECT parent_dealer_code, model_family_code, abc_class, 'A 30,B 25,C 20' AS abc_policy FROM abc")
def k13_abc_policy(spark, d):
    """The class and, beside it, the text that a report has in its place."""
    out = planning.abc_class(_plan_families(spark, d, _staged_sales(spark, d)), ["parent_dealer_code"], "forecast", "model_family_code")
    return out.select("parent_dealer_code", "model_family_code", "abc_class", "abc_policy")


@query("k12_filled_gaps", f"""WITH s AS (SELECT parent_dealer_code, model_family_code, sku, unnest(generate_series(CAST(min(month_of_sale) AS TIMESTAMP), CAST(max(month_of_sale) AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM year_sales GROUP BY 1, 2, 3),
        x AS (SELECT s.parent_dealer_code, s.model_family_code, s.sku, m, coalesce(net_sales, 0) AS v FROM s LEFT JOIN year_sales y ON y.parent_dealer_code = s.parent_dealer_code AND y.model_family_code = s.model_family_code AND y.sku = s.sku AND y.month_of_sale = CAST(s.m AS DATE)),
        c AS (SELECT *, v - lag(v) OVER (PARTITION BY parent_dealer_code, model_family_code, sku ORDER BY m) AS c FROM x)
        SELECT parent_dealer_code, model_family_code, sku, n_months, {_rs('variability')} FROM (SELECT parent_dealer_code, model_family_code, sku, count(*) AS n_months, CASE WHEN count(*) <= 2 THEN 1.0 ELSE coalesce(stddev_samp(c), 1.0) END AS variability FROM c GROUP BY 1, 2, 3)""")  # fmt: skip
def k12_filled_gaps(spark, d):
    """Variability with months without a sale as 0."""
    out = planning.demand_variability(_year_sales(_staged_sales(spark, d)), ["parent_dealer_code", "model_family_code", "sku"], fill_gaps=True)
    return out.select("parent_dealer_code", "model_family_code", "sku", "n_months", *_r("variability"))


CTE["stock_now"] = """SELECT d.parent_dealer_code, coalesce(w.current_sku, s.sku) AS sku, CAST(sum(s.closing_stock) AS BIGINT) AS closing_stock
    FROM stock s LEFT JOIN following w ON s.sku = w.sku JOIN dealers d ON s.dealer_code = d.dealer_code GROUP BY 1, 2"""
CTE["orders_in"] = """SELECT f.parent_dealer_code, f.sku, f.model_family_code, a.abc_class, f.sku_forecast, coalesce(t.closing_stock, 0) AS closing_stock, l.min_lead_time, l.avg_lead_time, l.max_lead_time
    FROM plan_fc f LEFT JOIN abc a ON a.parent_dealer_code = f.parent_dealer_code AND a.model_family_code = f.model_family_code
    LEFT JOIN stock_now t ON t.parent_dealer_code = f.parent_dealer_code AND t.sku = f.sku
    LEFT JOIN lead_time l ON l.parent_dealer_code = f.parent_dealer_code AND l.sku = f.sku"""


def _order_candidates(spark, d, sales=None):
    t = _tables(spark, d)
    sales = _staged_sales(spark, d) if sales is None else sales
    fc = staged(_plan_forecast(spark, d, sales), "plan-forecast")
    fc = fc.join(_abc(_plan_families(spark, d, sales)), ["parent_dealer_code", "model_family_code"], "left")
    stock = planning.stock_by_sku(view(spark, d, "stock"), mapping.successors(t["obd_mapping"], t["sku_source"]), mapping.parent_dealer(t["dealer_hierarchy"]), "2001-08-31")
    return planning.order_candidates(fc, stock, view(spark, d, "lead_time"))


@query("d6_stock_by_sku", "SELECT * FROM stock_now")
def d6_stock_by_sku(spark, d):
    t = _tables(spark, d)
    return planning.stock_by_sku(view(spark, d, "stock"), mapping.successors(t["obd_mapping"], t["sku_source"]), mapping.parent_dealer(t["dealer_hierarchy"]), "2001-08-31")


@query("k16_quarantine", "SELECT parent_dealer_code, sku, max_lead_time IS NULL AS quarantined FROM orders_in")
def k16_quarantine(spark, d):
    good, bad = planning.split_null_lead(_order_candidates(spark, d))
    return joins.concat(*[x.select("parent_dealer_code", "sku", F.lit(q).alias("quarantined")) for x, q in ((good, False), (bad, True))])


_Z = "(VALUES (90, 1.28), (92, 1.41), (95, 1.65), (97, 1.88), (99, 2.33)) AS s(service_level, z)"
_SAFETY = "least(CAST(ceil(CAST(z AS DOUBLE) * variability * sqrt(CASE abc_class WHEN 'A' THEN 30 WHEN 'B' THEN 25 WHEN 'C' THEN 20 ELSE 15 END / 30.0)) AS DOUBLE), sku_forecast * 3)"


CTE["orders_each"] = f"""SELECT o.*, s.service_level, s.z, b.basis, coalesce(CASE WHEN b.basis = 'sku' THEN v.variability ELSE w.variability END, 1.0) AS variability
    FROM orders_in o LEFT JOIN sku_variability v ON v.parent_dealer_code = o.parent_dealer_code AND v.sku = o.sku
    LEFT JOIN family_variability w ON w.parent_dealer_code = o.parent_dealer_code AND w.model_family_code = o.model_family_code
    CROSS JOIN {_Z} CROSS JOIN (VALUES ('sku'), ('family')) AS b(basis) WHERE o.max_lead_time IS NOT NULL"""
CTE["order_rows"] = f"""SELECT service_level, basis, parent_dealer_code, sku, safety, greatest(lead_min + safety + sku_forecast - closing_stock, 0) AS order_min, greatest(lead_avg + safety + sku_forecast - closing_stock, 0) AS order_avg,
    greatest(lead_max + safety + sku_forecast - closing_stock, 0) AS order_max, greatest(lead_min + safety - closing_stock, 0) AS order_b_min, greatest(lead_avg + safety - closing_stock, 0) AS order_b_avg, greatest(lead_max + safety - closing_stock, 0) AS order_b_max,
    lead_min + safety AS reorder_min, lead_avg + safety AS reorder_avg, lead_max + safety AS reorder_max, lead_min + safety + sku_forecast AS total_min, lead_avg + safety + sku_forecast AS total_avg, lead_max + safety + sku_forecast AS total_max
    FROM (SELECT *, {_SAFETY} AS safety, ceil(sku_forecast * min_lead_time / 30) AS lead_min, ceil(sku_forecast * avg_lead_time / 30) AS lead_avg, ceil(sku_forecast * max_lead_time / 30) AS lead_max FROM orders_each)"""


def _orders(spark, d):
    sales = _staged_sales(spark, d)
    year = _year_sales(sales)
    variability = planning.variability_by_basis(year, planning.family_sales(year), C.active_skus(_skus(spark, d)))
    good, _ = planning.split_null_lead(_order_candidates(spark, d, sales))
    return planning.order_sweep(good, variability, spark)


@query("k18_order_sweep", """SELECT service_level, basis, parent_dealer_code, sku, round(safety, 3) AS safety_stock, round(order_min, 3) AS order_min, round(order_avg, 3) AS order_avg,
        round(order_max, 3) AS order_max, round(order_b_min, 3) AS order_b_min, round(order_b_avg, 3) AS order_b_avg, round(order_b_max, 3) AS order_b_max, round(reorder_min, 3) AS reorder_min, round(reorder_avg, 3) AS reorder_avg,
        round(reorder_max, 3) AS reorder_max, round(total_min, 3) AS total_min, round(total_avg, 3) AS total_avg, round(total_max, 3) AS total_max FROM order_rows""")  # fmt: skip
def k18_order_sweep(spark, d):
    return _orders(spark, d).select("service_level", "basis", "parent_dealer_code", "sku", *_r("safety_stock", *[f"{name}_{k}" for name in ("order", "order_b", "reorder", "total") for k in ("min", "avg", "max")], digits=3))


#: As a table of recommendations would have them: several run dates, one row for each SKU and date.
CTE["end_of_journey"] = """SELECT CAST(p_partkey AS STRING) AS sku, CASE WHEN (p_size + k) % 7 = 0 THEN 'Y' ELSE 'N' END AS recommend_end_of_journey, CAST(CASE WHEN k = 0 THEN '2001-07-01' ELSE '2001-08-01' END AS DATE) AS run_date
    FROM part CROSS JOIN (VALUES (0), (1)) AS t(k)"""
CTE["dealer_master"] = "SELECT CAST(n_nationkey AS STRING) AS dealer_code, n_name AS area_office, r_name AS zone FROM nation JOIN region ON n_regionkey = r_regionkey"


@query("k19_enrich_orders", """SELECT o.service_level, o.basis, o.parent_dealer_code, o.sku, round(o.order_max, 3) AS order_max, e.recommend_end_of_journey, m.area_office, m.zone
        FROM order_rows o LEFT JOIN (SELECT sku, recommend_end_of_journey FROM end_of_journey WHERE run_date = (SELECT max(run_date) FROM end_of_journey)) e ON e.sku = o.sku
        LEFT JOIN dealer_master m ON m.dealer_code = o.parent_dealer_code""")  # fmt: skip
def k19_enrich_orders(spark, d):
    load(spark, d)
    journeys = mapping.latest_snapshot(spark.sql(CTE["end_of_journey"]), "run_date").drop("run_date")
    out = planning.enrich_orders(_orders(spark, d), journeys, spark.sql(CTE["dealer_master"]))
    return out.select("service_level", "basis", "parent_dealer_code", "sku", *_r("order_max", digits=3), "recommend_end_of_journey", "area_office", "zone")


@query("k20_dispatch_extract", """SELECT run_date, run_cycle_id, dealer, dispatch_id, coalesce(obl_cr_limit_avail >= 100000, false) AS fund_status FROM dispatch_runs
        WHERE (run_date, run_cycle_id) = (SELECT (run_date, run_cycle_id) FROM dispatch_runs ORDER BY run_date DESC, run_cycle_id DESC LIMIT 1)""")  # fmt: skip
def k20_dispatch_extract(spark, d):
    rows = view(spark, d, "dispatch_runs")
    return mapping.dispatch_extract(rows, rows).select("run_date", "run_cycle_id", "dealer", "dispatch_id", "fund_status")


# Accuracy ------------------------------------------------------------------------------------

_APES = "abs(actual - model_a) / abs(actual) * 100 AS ape_a, abs(actual - model_b) / abs(actual) * 100 AS ape_b"


def _by_month_sql(extra: str) -> str:
    return f"""SELECT month_of_sale, n_series, {_rs('mape_a', 'mape_b', 'median_a', 'median_b')}, CASE WHEN mape_a < mape_b THEN 'a' ELSE 'b' END AS winner, round(abs(mape_a - mape_b), 4) + 0.0 AS gap FROM (
        SELECT month_of_sale, count(DISTINCT series) AS n_series, avg(ape_a) AS mape_a, avg(ape_b) AS mape_b, median(ape_a) AS median_a, median(ape_b) AS median_b
        FROM (SELECT *, {_APES} FROM scored WHERE actual <> 0 {extra} AND model_a IS NOT NULL) GROUP BY 1)"""


@query("e1_compare_by_month", _by_month_sql(""))
def e1_compare_by_month(spark, d):
    return metrics.compare_by_month(_scored(spark, d).filter("model_a IS NOT NULL"), "model_a", "model_b").select("month_of_sale", "n_series", *_r("mape_a", "mape_b", "median_a", "median_b"), "winner", *_r("gap"))


@query("e2_compare_large", _by_month_sql("AND actual >= 20"))
def e2_compare_large(spark, d):
    return metrics.compare_by_month(_scored(spark, d).filter("model_a IS NOT NULL"), "model_a", "model_b", min_actual=20).select("month_of_sale", "n_series", *_r("mape_a", "mape_b", "median_a", "median_b"), "winner", *_r("gap"))


CTE["modelled"] = """SELECT s.series, s.month_of_sale, s.actual, t.sku_type, m.model, CASE m.model WHEN 'model_a' THEN s.model_a ELSE s.model_b END AS forecast
    FROM scored s JOIN typed t ON s.series = t.series CROSS JOIN (VALUES ('model_a'), ('model_b')) AS m(model) WHERE s.model_a IS NOT NULL"""
CTE["segments"] = """SELECT model, CASE grouping_id(model, sku_type, month_of_sale) WHEN 3 THEN 'overall' WHEN 1 THEN 'segment' ELSE 'month' END AS level,
      CASE grouping_id(model, sku_type, month_of_sale) WHEN 3 THEN 'all' WHEN 1 THEN sku_type ELSE strftime(month_of_sale, '%Y-%m') END AS value,
      count(*) AS n, avg(abs(forecast - actual)) AS mae, sqrt(avg((forecast - actual) * (forecast - actual))) AS rmse, avg(CASE WHEN abs(actual) > 1e-9 THEN abs(forecast - actual) / abs(actual) * 100 END) AS mape,
      sum(abs(forecast - actual)) * 100 / nullif(sum(abs(actual)), 0) AS wmape, sum(forecast - actual) * 100 / nullif(sum(actual), 0) AS bias_pct
    FROM modelled GROUP BY GROUPING SETS ((model), (model, sku_type), (model, month_of_sale))"""


def _segments(spark, d):
    p = _panel(spark, d)
    rows = _scored(spark, d, p).filter("model_a IS NOT NULL").join(_typed(spark, d, p), "series")
    return metrics.segment_metrics(rows, ["model_a", "model_b"])


@query("e3_segment_metrics", f"SELECT model, level, value, n, {_rs('mae', 'rmse', 'mape', 'wmape', 'bias_pct')} FROM segments")
def e3_segment_metrics(spark, d):
    return _segments(spark, d).select("model", "level", "value", "n", *_r("mae", "rmse", "mape", "wmape", "bias_pct"))


@query("e4_verdicts", f"""SELECT level, value, {_rs('wmape_a', 'wmape_b')}, CASE WHEN coalesce(abs(wmape_a - wmape_b) / nullif(greatest(wmape_a, wmape_b), 0), 0) < 0.05 THEN 'close' WHEN wmape_a < wmape_b THEN 'model_a' ELSE 'model_b' END AS verdict,
        round(abs(wmape_a - wmape_b) / nullif(greatest(wmape_a, wmape_b), 0), 4) + 0.0 AS relative_gap
        FROM (SELECT level, value, max(CASE WHEN model = 'model_a' THEN wmape END) AS wmape_a, max(CASE WHEN model = 'model_b' THEN wmape END) AS wmape_b FROM segments GROUP BY 1, 2)""")  # fmt: skip
def e4_verdicts(spark, d):
    return metrics.verdicts(_segments(spark, d), "model_a", "model_b").select("level", "value", *_r("wmape_a", "wmape_b"), "verdict", *_r("relative_gap"))


CTE["one_model"] = "SELECT series, month_of_sale, actual, model_a AS forecast FROM scored WHERE model_a IS NOT NULL"


def _one_model(spark, d):
    return _scored(spark, d).filter("model_a IS NOT NULL").select("series", "month_of_sale", "actual", F.col("model_a").alias("forecast"))


@query("e5_series_metrics", f"""SELECT series, n, {_rs('mae', 'rmse', 'wape', 'bias', 'total_actual', 'total_forecast')} FROM (SELECT series, count(*) AS n, avg(abs(forecast - actual)) AS mae, sqrt(avg((forecast - actual) * (forecast - actual))) AS rmse,
        sum(abs(forecast - actual)) / nullif(sum(abs(actual)), 0) AS wape, sum(forecast - actual) AS bias, sum(actual) AS total_actual, sum(forecast) AS total_forecast FROM one_model GROUP BY 1)""")  # fmt: skip
def e5_series_metrics(spark, d):
    return metrics.series_metrics(_one_model(spark, d)).select("series", "n", *_r("mae", "rmse", "wape", "bias", "total_actual", "total_forecast"))


@query("e6_series_mape", f"SELECT series, {_rs('mape', 'volume')} FROM (SELECT series, avg(CASE WHEN actual <> 0 THEN abs(actual - forecast) / abs(actual) * 100 END) AS mape, sum(actual) AS volume FROM one_model GROUP BY 1) WHERE mape IS NOT NULL")
def e6_series_mape(spark, d):
    return metrics.series_mape(_one_model(spark, d)).select("series", *_r("mape", "volume"))


@query("e6_mape_summary", """SELECT count(*) AS n_series, round(avg(mape), 4) AS mean_mape, round(sum(mape * volume) / nullif(sum(volume), 0), 4) AS weighted_mape
        FROM (SELECT series, avg(CASE WHEN actual <> 0 THEN abs(actual - forecast) / abs(actual) * 100 END) AS mape, sum(actual) AS volume FROM one_model GROUP BY 1) WHERE mape IS NOT NULL""")  # fmt: skip
def e6_mape_summary(spark, d):
    return metrics.mape_summary(metrics.series_mape(_one_model(spark, d))).select("n_series", *_r("mean_mape", "weighted_mape"))


@query("e7_smape", """SELECT round(avg(abs(forecast - actual) * 200 / nullif(abs(actual) + abs(forecast), 0)), 4) AS smape, round(sqrt(avg((forecast - actual) * (forecast - actual))), 4) AS rmse, round(avg(abs(forecast - actual)), 4) AS mae FROM one_model""")
def e7_smape(spark, d):
    return metrics.smape(_one_model(spark, d)).select(*_r("smape", "rmse", "mae"))


@query("e8_mape_eps", "SELECT round(avg(abs(actual - forecast) / greatest(abs(actual), 1.0)), 6) AS mape FROM one_model")
def e8_mape_eps(spark, d):
    return metrics.mape_eps(_one_model(spark, d), eps=1.0).select(*_r("mape", digits=6))


@query("e9_daily_ape", f"SELECT month_of_sale, {_rs('actual', 'forecast', 'ape')} FROM (SELECT *, CASE WHEN actual <> 0 THEN abs(actual - forecast) / abs(actual) * 100 END AS ape FROM (SELECT month_of_sale, sum(actual) AS actual, sum(forecast) AS forecast FROM one_model GROUP BY 1))")
def e9_daily_ape(spark, d):
    return metrics.daily_ape(_one_model(spark, d), "month_of_sale").select("month_of_sale", *_r("actual", "forecast", "ape"))


@query("e10_loss_metrics", """SELECT round(avg(e * e), 4) AS mse, round(avg(h), 4) AS huber, round(avg(h + f * e), 4) AS huber_ae, round(sum(w * h) / sum(w), 4) AS weighted_huber FROM (
        SELECT e, CASE WHEN e <= 5 THEN e * e / 2 ELSE 5 * (e - 2.5) END AS h, f, 1 + 4 * f AS w FROM (SELECT abs(forecast - actual) AS e, CASE WHEN month(month_of_sale) IN (10, 11) THEN 1.0 ELSE 0.0 END AS f FROM one_model))""")  # fmt: skip
def e10_loss_metrics(spark, d):
    rows = _one_model(spark, d).withColumn("festive", F.month("month_of_sale").isin(10, 11).cast("int")).withColumn("w", C.festive_weight(["festive"]))
    return metrics.loss_metrics(rows, 5.0, "festive", "w").select(*_r("mse", "huber", "huber_ae", "weighted_huber"))


@query("e11_quantile_summary", "SELECT month_of_sale, round(quantile_cont(actual - forecast, 0.1), 4) AS p10, round(quantile_cont(actual - forecast, 0.5), 4) AS p50, round(quantile_cont(actual - forecast, 0.9), 4) AS p90 FROM one_model GROUP BY 1")
def e11_quantile_summary(spark, d):
    return metrics.quantile_summary(_one_model(spark, d).withColumn("sample", F.col("actual") - F.col("forecast")), ["month_of_sale"]).select("month_of_sale", *_r("p10", "p50", "p90"))


# Profiles ------------------------------------------------------------------------------------

CTE["profiled"] = """SELECT series, min(month_of_sale) AS first_date, max(month_of_sale) AS last_date, count(net_sales) AS n, min(net_sales) AS min, max(net_sales) AS max,
      quantile_cont(net_sales, 0.25) AS q1, quantile_cont(net_sales, 0.5) AS median, quantile_cont(net_sales, 0.75) AS q3, stddev_samp(net_sales) AS std, avg(net_sales) AS mean,
      count(*) FILTER (WHERE net_sales <> 0) AS n_nonzero FROM panel GROUP BY 1"""


@query("d10_series_profile", f"""SELECT series, first_date, last_date, n, min, max, q1, median, q3, {_rs('std', 'mean')}, n_nonzero, CAST(datediff('month', first_date, last_date) + 1 AS INT) AS span_months, round(std / nullif(mean, 0), 4) AS cv,
        round(n_nonzero / n, 4) AS nonzero_share, coalesce(max / nullif(mean, 0) > 5, false) AS outlier FROM profiled""")  # fmt: skip
def d10_series_profile(spark, d):
    out = profile.series_profile(_panel(spark, d), "series", "month_of_sale", "net_sales")
    return out.select("series", "first_date", "last_date", "n", "min", "max", "q1", "median", "q3", *_r("std", "mean", "cv", "nonzero_share"), "n_nonzero", "span_months", "outlier")


@query("d11_eligible_series", "SELECT series, n, round(n_nonzero / n, 4) AS nonzero_share FROM profiled WHERE n_nonzero / n >= 0.3 AND n >= 18")
def d11_eligible_series(spark, d):
    return profile.eligible_series(profile.series_profile(_panel(spark, d), "series", "month_of_sale", "net_sales")).select("series", "n", *_r("nonzero_share"))


@query("d13_monthly_contribution", """SELECT month_of_sale, total_monthly_sales, fiscal_year, total_yearly_sales, round_even(total_monthly_sales / total_yearly_sales, 4) AS monthly_contribution FROM (
        SELECT *, sum(total_monthly_sales) OVER (PARTITION BY fiscal_year) AS total_yearly_sales FROM (SELECT month_of_sale, concat('FY''', lpad(CAST(year(month_of_sale + INTERVAL 9 MONTH) % 100 AS STRING), 2, '0')) AS fiscal_year, sum(net_sales) AS total_monthly_sales FROM panel GROUP BY 1, 2))""")  # fmt: skip
def d13_monthly_contribution(spark, d):
    return profile.monthly_contribution(_panel(spark, d), "month_of_sale", "net_sales", C.fiscal_year(F.col("month_of_sale")))


@query("d9_null_counts", "SELECT count(*) FILTER (WHERE last_year IS NULL) AS last_year, count(*) FILTER (WHERE net_sales IS NULL) AS net_sales FROM (SELECT p.net_sales, q.net_sales AS last_year FROM panel p LEFT JOIN panel q ON p.series = q.series AND q.month_of_sale = p.month_of_sale - INTERVAL 12 MONTH)")
def d9_null_counts(spark, d):
    return profile.null_counts(panel.last_year_value(_panel(spark, d), ["series"], "month_of_sale", "net_sales", "last_year"), ["last_year", "net_sales"])


CTE["proportion"] = """SELECT series, nonzero_days, total, first_sale, nonzero_days / 365.0 AS nonzero_share, least(nonzero_days / nullif(CAST(DATE '1998-12-31' - first_sale + 1 AS DOUBLE), 0), 1.0) AS share_since_first,
      CAST(row_number() OVER (ORDER BY total DESC, series) AS INT) AS rank, sum(pct) OVER (ORDER BY total DESC, series ROWS UNBOUNDED PRECEDING) AS running_pct FROM (
        SELECT *, total * 100 / nullif(sum(total) OVER (), 0) AS pct FROM (
          SELECT concat(parent_dealer_code, '<>', model_family) AS series, count(*) FILTER (WHERE net_sales <> 0) AS nonzero_days, sum(net_sales) AS total, min(CASE WHEN net_sales <> 0 THEN cal_date END) AS first_sale
          FROM (SELECT parent_dealer_code, model_family, cal_date, sum(net_sales) AS net_sales FROM mapped GROUP BY 1, 2, 3) WHERE cal_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY 1))"""


def _proportion(spark, d):
    daily = _mapped(spark, d).groupBy(mapping.series_key().alias("series"), "cal_date").agg(F.sum("net_sales").alias("net_sales"))
    return profile.series_proportion(daily, "series", "cal_date", "net_sales", "1998-01-01", "1998-12-31")


@query("d22_series_proportion", f"SELECT series, nonzero_days, total, first_sale, {_rs('nonzero_share', 'share_since_first')}, rank, round(running_pct, 3) AS running_pct FROM proportion")
def d22_series_proportion(spark, d):
    return _proportion(spark, d).select("series", "nonzero_days", "total", "first_sale", *_r("nonzero_share", "share_since_first"), "rank", *_r("running_pct", digits=3))


@query("d23_coverage", "SELECT round(max(CASE WHEN rank <= 10 THEN running_pct END), 3) AS top_10_pct, round(max(CASE WHEN rank <= 100 THEN running_pct END), 3) AS top_100_pct, min(CASE WHEN running_pct >= 50 THEN rank END) AS series_for_50_pct, min(CASE WHEN running_pct >= 80 THEN rank END) AS series_for_80_pct FROM proportion")
def d23_coverage(spark, d):
    return profile.coverage(_proportion(spark, d), [10, 100], [50, 80]).select(*_r("top_10_pct", "top_100_pct", digits=3), "series_for_50_pct", "series_for_80_pct")


@query("d24_compare_periods", """SELECT column_name, max(CASE WHEN p = 1 THEN total END) AS period_1, max(CASE WHEN p = 2 THEN total END) AS period_2 FROM (
        SELECT CASE WHEN cal_date < DATE '1997-01-01' THEN 1 ELSE 2 END AS p, unnest(['invoiced_sales', 'cancelled_sales', 'returned_sales']) AS column_name, unnest([sum(invoiced_sales), sum(cancelled_sales), sum(returned_sales)]) AS total
        FROM retail WHERE cal_date >= DATE '1996-01-01' AND cal_date < DATE '1998-01-01' GROUP BY 1) GROUP BY 1""")  # fmt: skip
def d24_compare_periods(spark, d):
    return profile.compare_periods(view(spark, d, "retail"), "cal_date", ["invoiced_sales", "cancelled_sales", "returned_sales"], ("1996-01-01", "1997-01-01"), ("1997-01-01", "1998-01-01"))


@query("d25_month_highlights", "SELECT CAST(year(month_of_sale) AS INT) AS year, sum(net_sales) AS net_sales FROM panel WHERE month(month_of_sale) IN (9, 10, 11) GROUP BY 1")
def d25_month_highlights(spark, d):
    return profile.month_highlights(_panel(spark, d), "month_of_sale", [9, 10, 11], ["net_sales"])


@query("d26_monthly_cv", "SELECT month_of_sale, round(avg(net_sales), 4) AS mean, round(stddev_samp(net_sales), 4) AS std, round(stddev_samp(net_sales) / nullif(avg(net_sales), 0), 4) AS cv FROM panel GROUP BY 1")
def d26_monthly_cv(spark, d):
    return profile.monthly_cv(_panel(spark, d), "month_of_sale", "net_sales").select("month_of_sale", *_r("mean", "std", "cv"))


@query("d27_forecast_health", """SELECT round(min(total), 4) AS min_day, round(avg(total), 4) AS mean_day, round(max(total), 4) AS max_day, max_by(cal_date, (total, cal_date)) AS peak_day, round(sum(total), 4) AS grand_total,
        (SELECT count(*) FILTER (WHERE m = 0) FROM (SELECT parent_dealer_code_model_family, max(abs(net_sales)) AS m FROM daily_panel GROUP BY 1)) AS zero_series FROM (SELECT cal_date, sum(net_sales) AS total FROM daily_panel GROUP BY 1)""")  # fmt: skip
def d27_forecast_health(spark, d):
    out = profile.forecast_health(view(spark, d, "daily_panel"), "parent_dealer_code_model_family", "cal_date", "net_sales")
    return out.select(*_r("min_day", "mean_day", "max_day"), "peak_day", *_r("grand_total"), "zero_series")


@query("d28_flatness", "SELECT round(count(*) FILTER (WHERE coalesce(std, 0) < 1e-6) / count(*), 4) AS flat_share, round(median(peak / nullif(mean, 0)), 4) AS median_peak_to_mean FROM (SELECT series, stddev_samp(net_sales) AS std, max(net_sales) AS peak, avg(net_sales) AS mean FROM panel GROUP BY 1)")
def d28_flatness(spark, d):
    return profile.flatness(_panel(spark, d), "series", "net_sales").select(*_r("flat_share", "median_peak_to_mean"))


@query("d29_seasonality_check", """WITH w AS (SELECT place, max(now) AS now, max(before) AS before FROM (
          SELECT cal_date - DATE '1998-09-01' AS place, sum(net_sales) AS now, NULL AS before FROM mapped WHERE cal_date BETWEEN DATE '1998-09-01' AND DATE '1998-12-31' GROUP BY 1
          UNION ALL SELECT cal_date - DATE '1997-09-01', NULL, sum(net_sales) FROM mapped WHERE cal_date BETWEEN DATE '1997-09-01' AND DATE '1997-12-31' GROUP BY 1) GROUP BY 1)
        SELECT sum(now) AS total_now, max(now) AS peak_now, round(avg(now), 4) AS mean_now, sum(before) AS total_before, max(before) AS peak_before, round(avg(before), 4) AS mean_before, round((sum(now) - sum(before)) * 100 / sum(before), 4) AS yoy_pct,
        CAST(arg_max(place, row(now, place)) FILTER (WHERE now IS NOT NULL) AS INT) AS peak_at_now, CAST(arg_max(place, row(before, place)) FILTER (WHERE before IS NOT NULL) AS INT) AS peak_at_before FROM w""")  # fmt: skip
def d29_seasonality_check(spark, d):
    out = profile.seasonality_check(_mapped(spark, d), "cal_date", "net_sales", ("1998-09-01", "1998-12-31"))
    return out.select("total_now", "peak_now", *_r("mean_now"), "total_before", "peak_before", *_r("mean_before", "yoy_pct"), "peak_at_now", "peak_at_before")


@query("d30_sparsity", """SELECT round(median(zero_share), 4) AS median_zero_share, round(quantile_cont(zero_share, 0.9), 4) AS p90_zero_share, round(median(mean), 4) AS median_mean, round(median(peak / nullif(mean, 0)), 4) AS median_peak_to_mean
        FROM (SELECT series, count(*) FILTER (WHERE net_sales = 0) / count(*) AS zero_share, avg(net_sales) AS mean, max(net_sales) AS peak FROM panel GROUP BY 1)""")  # fmt: skip
def d30_sparsity(spark, d):
    return profile.sparsity(_panel(spark, d), "series", "net_sales").select(*_r("median_zero_share", "p90_zero_share", "median_mean", "median_peak_to_mean"))


@query("d31_level_check", """WITH t AS (SELECT cal_date, sum(net_sales) AS total FROM mapped GROUP BY 1), l AS (SELECT max(cal_date) AS last FROM t WHERE cal_date < DATE '1998-06-01')
        SELECT round(ml, 4) AS mean_long, round(ms, 4) AS mean_short, round(p, 4) AS predicted, round(s, 4) AS sold, round(p / ml, 4) AS predicted_to_long, round(p / ms, 4) AS predicted_to_short, round(p / s, 4) AS predicted_to_sold FROM (
          SELECT avg(CASE WHEN cal_date < DATE '1998-06-01' AND last - cal_date < 365 THEN total END) AS ml, avg(CASE WHEN cal_date < DATE '1998-06-01' AND last - cal_date < 90 THEN total END) AS ms,
                 avg(CASE WHEN cal_date >= DATE '1997-06-01' AND cal_date < DATE '1997-09-01' THEN total END) AS p, avg(CASE WHEN cal_date >= DATE '1998-06-01' AND cal_date < DATE '1998-09-01' THEN total END) AS s FROM t, l)""")  # fmt: skip
def d31_level_check(spark, d):
    m = _mapped(spark, d)
    part = lambda lo, hi: C.between_dates(m, "cal_date", lo, hi)
    out = profile.level_check(m.filter("cal_date < DATE '1998-06-01'"), part("1997-06-01", "1997-09-01"), part("1998-06-01", "1998-09-01"), "cal_date", "net_sales")
    return out.select(*_r("mean_long", "mean_short", "predicted", "sold", "predicted_to_long", "predicted_to_short", "predicted_to_sold"))


@query("d32_mom_yoy", f"""WITH m AS (SELECT month_of_sale, sum(net_sales) AS total FROM panel GROUP BY 1)
        SELECT a.month_of_sale, a.total, round((a.total - b.total) * 100 / nullif(b.total, 0), 4) AS mom_pct, round((a.total - c.total) * 100 / nullif(c.total, 0), 4) AS yoy_pct
        FROM m a LEFT JOIN m b ON b.month_of_sale = a.month_of_sale - INTERVAL 1 MONTH LEFT JOIN m c ON c.month_of_sale = a.month_of_sale - INTERVAL 12 MONTH""")  # fmt: skip
def d32_mom_yoy(spark, d):
    return profile.mom_yoy(_panel(spark, d), "month_of_sale", "net_sales").select("month_of_sale", "total", *_r("mom_pct", "yoy_pct"))


@query("d36_importance", """SELECT feature, round(avg(v), 4) AS importance FROM (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([CAST(l_quantity AS DOUBLE), l_discount, l_tax]) AS v FROM lineitem) GROUP BY 1""")
def d36_importance(spark, d):
    return profile.importance_summary(source(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).select("feature", *_r("importance"))


@query("d37_series_counts", "SELECT count(*) AS n_series, min(n) AS min_rows, max(n) AS max_rows, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT parent_dealer_code, model_family, count(*) AS n FROM monthly GROUP BY 1, 2)")
def d37_series_counts(spark, d):
    return profile.series_counts(_monthly(spark, d).withColumn("series", mapping.series_key()), "series")


# Reports, keys -------------------------------------------------------------------------------

_YEARS = [1996, 1997, 1998, 1999, 2000]


@query("d20_to_monthly", "SELECT CAST(date_trunc('month', cal_date) AS DATE) AS month_of_sale, sum(net_sales) AS grand_total, count(DISTINCT parent_dealer_code_model_family) AS n_series FROM daily_panel GROUP BY 1")
def d20_to_monthly(spark, d):
    return reports.month_totals(reports.to_monthly(view(spark, d, "daily_panel"), "parent_dealer_code_model_family", "cal_date", "net_sales"), "net_sales")


@query("d21_wide_report", "SELECT series, " + ", ".join(f"coalesce(sum(CASE WHEN year(month_of_sale) = {y} THEN net_sales END), 0) AS \"{y}\"" for y in _YEARS) + f", coalesce(sum(CASE WHEN year(month_of_sale) BETWEEN {_YEARS[0]} AND {_YEARS[-1]} THEN net_sales END), 0) AS total FROM panel GROUP BY 1")
def d21_wide_report(spark, d):
    rows = _panel(spark, d).withColumn("year", F.year("month_of_sale").cast("string"))
    return reports.wide_report(rows, "series", "year", "net_sales", [str(y) for y in _YEARS])


@query("d35_by_month_name", "SELECT monthname(month_of_sale) AS month_name, sum(net_sales) AS total FROM panel GROUP BY 1")
def d35_by_month_name(spark, d):
    return reports.by_month_name(_panel(spark, d), "month_of_sale", "net_sales")


@query("c13_key_coverage", """WITH a AS (SELECT DISTINCT sku FROM skus WHERE lower(skustatus) = 'active'), b AS (SELECT DISTINCT sku FROM mapped)
        SELECT count(*) FILTER (WHERE b.sku IS NULL) AS a_only, count(*) FILTER (WHERE a.sku IS NULL) AS b_only, count(*) FILTER (WHERE a.sku = b.sku) AS both, count(*) FILTER (WHERE b.sku IS NULL) = 0 AS a_subset_of_b FROM a FULL JOIN b ON a.sku = b.sku""")  # fmt: skip
def c13_key_coverage(spark, d):
    return joins.key_coverage(C.active_skus(_skus(spark, d)), _mapped(spark, d), "sku")


@query("c12_orphans", "SELECT sku FROM skus WHERE sku NOT IN (SELECT sku FROM mapped)")
def c12_orphans(spark, d):
    return joins.orphans(_skus(spark, d).select("sku"), _mapped(spark, d), ["sku"])


@query("c22_common_series", "SELECT series FROM panel WHERE year(month_of_sale) = 1996 AND net_sales > 0 INTERSECT SELECT series FROM panel WHERE year(month_of_sale) = 1998 AND net_sales > 0 INTERSECT SELECT series FROM panel WHERE year(month_of_sale) = 2000 AND net_sales > 0")
def c22_common_series(spark, d):
    p = _panel(spark, d).filter("net_sales > 0")
    return joins.common_series("series", *[p.filter(F.year("month_of_sale") == y) for y in (1996, 1998, 2000)])


@query("g2_top_series", "SELECT series, sum(net_sales) AS total FROM panel GROUP BY 1 ORDER BY total DESC, series LIMIT 20")
def g2_top_series(spark, d):
    return joins.top_n(_panel(spark, d).groupBy("series").agg(F.sum("net_sales").alias("total")), "total", 20, "series")


# Calendar and trend --------------------------------------------------------------------------

CTE["near"] = """SELECT cal_date, nearest, CAST(cal_date - nearest AS INT) AS d FROM (SELECT cal_date, min_by(anchor, (abs(cal_date - anchor), anchor)) AS nearest FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS cal_date FROM lineitem), anchors GROUP BY 1)"""


def _days(spark, d):
    return source(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("cal_date")).distinct()


@query("j16_diwali_features", """SELECT cal_date, nearest, d AS offset_days, greatest(least(d, 45), -45) AS diwali_offset, round(CASE WHEN d BETWEEN -13 AND -1 THEN (d + 14) / 13.0 ELSE 0 END, 6) AS diwali_ramp,
        CAST(d = 0 AS INT) AS is_diwali, CAST(d BETWEEN -3 AND 6 AS INT) AS diwali_window FROM near""")  # fmt: skip
def j16_diwali_features(spark, d):
    out = calendar.diwali_features(_days(spark, d), view(spark, d, "anchors"))
    return out.select("cal_date", "nearest", "offset_days", "diwali_offset", *_r("diwali_ramp", digits=6), "is_diwali", "diwali_window")


@query("j17_pitra_features", """SELECT cal_date, CAST(d BETWEEN -15 AND 0 AS INT) AS in_pitra, round(CASE WHEN d BETWEEN -15 AND -1 THEN (d + 16) / 15.0 ELSE 0 END, 6) AS pitra_ramp, CAST(d = 0 AS INT) AS is_amavasya FROM near""")
def j17_pitra_features(spark, d):
    return calendar.pitra_features(_days(spark, d), view(spark, d, "anchors")).select("cal_date", "in_pitra", *_r("pitra_ramp", digits=6), "is_amavasya")


@query("j18_month_offset_sales", """SELECT f.day_offset, count(*) AS n, sum(p.net_sales) AS net_sales FROM panel p JOIN (SELECT DISTINCT CAST(date_trunc('month', anchor + CAST(o AS INT)) AS DATE) AS month_of_sale, CAST(o AS INT) AS day_offset
        FROM anchors, (SELECT unnest(range(-30, 8)) AS o)) f ON p.month_of_sale = f.month_of_sale GROUP BY 1""")  # fmt: skip
def j18_month_offset_sales(spark, d):
    flags = calendar.month_offset_flags(view(spark, d, "anchors"))
    return _panel(spark, d).join(F.broadcast(flags), "month_of_sale").groupBy("day_offset").agg(F.count("*").alias("n"), F.sum("net_sales").alias("net_sales"))


_LAGS = [f"N{k:+d}" for k in range(-16, 11)]
CTE["lag_sales"] = """SELECT concat(m.parent_dealer_code, '<>', m.model_family) AS series, CAST(year(m.cal_date) AS INT) AS year, printf('N%+d', n.d) AS lag_day, sum(m.net_sales) AS sales
    FROM mapped m JOIN near n ON m.cal_date = n.cal_date WHERE n.d BETWEEN -16 AND 10 GROUP BY 1, 2, 3"""


def _lag_flags(spark, d):
    rows = calendar.nearest_anchor(_mapped(spark, d).withColumn("series", mapping.series_key()), view(spark, d, "anchors"))
    flags = {name: (F.col("offset_days") == int(name[1:])).cast("int") for name in _LAGS}
    return rows.withColumns(flags | {"year": F.year("cal_date")})


@query("d15_lag_day_sales_long", "SELECT * FROM lag_sales")
def d15_lag_day_sales_long(spark, d):
    return forecast.lag_day_sales_long(_lag_flags(spark, d), _LAGS, "series", "year", "net_sales")


@query("d14_lag_day_sales_wide", "SELECT concat(m.parent_dealer_code, '<>', m.model_family) AS series, CAST(year(m.cal_date) AS INT) AS year, " + ", ".join(f"sum(CASE WHEN n.d = {int(x[1:])} THEN m.net_sales ELSE 0 END) AS \"{x}\"" for x in _LAGS) + " FROM mapped m JOIN near n ON m.cal_date = n.cal_date GROUP BY 1, 2")
def d14_lag_day_sales_wide(spark, d):
    return forecast.lag_day_sales_wide(_lag_flags(spark, d), _LAGS, "series", "year", "net_sales")


CTE["trend"] = """SELECT series, lag_day, (5 * sxy - sy * 9990) / 50.0 AS slope, greatest((sy - (5 * sxy - sy * 9990) / 50.0 * 9990) / 5 + (5 * sxy - sy * 9990) / 50.0 * 2001, 0.0) AS prediction
    FROM (SELECT series, lag_day, sum(sales) AS sy, sum(sales * year) AS sxy FROM lag_sales WHERE year BETWEEN 1996 AND 2000 GROUP BY 1, 2)"""


def _trend(spark, d):
    return forecast.lag_day_forecast(_lag_flags(spark, d), _LAGS, "series", "year", "net_sales", _YEARS, 2001)


@query("j20_lag_day_forecast", f"SELECT series, lag_day, {_rs('slope', 'prediction')} FROM trend")
def j20_lag_day_forecast(spark, d):
    return _trend(spark, d).select("series", "lag_day", *_r("slope", "prediction"))


@query("d16_pivot_years", "SELECT series, lag_day, " + ", ".join(f"coalesce(sum(CASE WHEN year = {y} THEN sales END), 0) AS \"{y}\"" for y in _YEARS) + " FROM lag_sales GROUP BY 1, 2")
def d16_pivot_years(spark, d):
    return forecast.pivot_years(d15_lag_day_sales_long(spark, d), ["series", "lag_day"], "year", "sales", _YEARS)


CTE["model_daily"] = "SELECT concat(parent_dealer_code, '<>', model_family) AS series, CAST(cal_date + INTERVAL 12 MONTH AS DATE) AS cal_date, sum(net_sales) AS model FROM mapped WHERE year(cal_date) = 2000 GROUP BY 1, 2"


@query("j22_blend", f"""SELECT m.series, m.cal_date, {_rs('model')}, t.series IS NOT NULL AS is_festive, t.lag_days, round(CASE WHEN t.series IS NOT NULL THEN t.trend * 0.5 + m.model * 0.5 ELSE m.model END, 4) AS blended FROM model_daily m
        LEFT JOIN (SELECT series, cal_date, sum(prediction) AS trend, string_agg(lag_day, '+' ORDER BY lag_day) AS lag_days FROM trend JOIN (SELECT printf('N%+d', o) AS lag_day, CAST(DATE '2001-11-14' + CAST(o AS INT) AS DATE) AS cal_date FROM (SELECT unnest(range(-16, 11)) AS o)) USING (lag_day) GROUP BY 1, 2) t
          ON m.series = t.series AND m.cal_date = t.cal_date""")  # fmt: skip
def j22_blend(spark, d):
    year = spark.sql("SELECT explode(sequence(DATE '2001-10-29', DATE '2001-11-24')) AS cal_date").withColumns({n: (F.date_diff("cal_date", F.lit("2001-11-14").cast("date")) == int(n[1:])).cast("int") for n in _LAGS})
    trend = forecast.lag_days_by_date(_trend(spark, d), calendar.lag_date_map(year, _LAGS), "series")
    model = _mapped(spark, d).filter(F.year("cal_date") == 2000).groupBy(mapping.series_key().alias("series"), F.add_months("cal_date", 12).alias("cal_date")).agg(F.sum("net_sales").alias("model"))
    return forecast.blend(model, trend, "series").select("series", "cal_date", *_r("model"), "is_festive", "lag_days", *_r("blended"))


# Windows, checks -----------------------------------------------------------------------------


@query("j10_series_windows", """SELECT series, CAST(w AS INT) AS window_id, lo + CAST(w AS INT) AS input_start, lo + CAST(w + 14 AS INT) AS output_start, lo + CAST(w + 20 AS INT) AS output_end, CAST(n - 1 - w AS INT) AS recency FROM (
        SELECT series, lo, n, unnest(range(0, n)) AS w FROM (SELECT parent_dealer_code_model_family AS series, min(cal_date) AS lo, (max(cal_date) - min(cal_date)) + 1 - 21 + 1 AS n FROM daily_panel GROUP BY 1)) WHERE n - 1 - w < 5""")  # fmt: skip
def j10_series_windows(spark, d):
    bounds = view(spark, d, "daily_panel").groupBy(F.col("parent_dealer_code_model_family").alias("series")).agg(F.min("cal_date").alias("lo"), F.max("cal_date").alias("hi"))
    return windows.series_windows(bounds, 14, 7, cap=5)


@query("v1_grain", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def v1_grain(spark, d):
    return checks.check_grain(source(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("v6_static", "SELECT model_family, count(DISTINCT model_family_code) AS n_model_family_code, count(*) FILTER (WHERE model_family_code IS NULL) AS null_model_family_code FROM skus GROUP BY 1 HAVING count(DISTINCT model_family_code) > 1")
def v6_static(spark, d):
    return checks.check_static(_skus(spark, d), "model_family", ["model_family_code"])


@query("v8_targets", "SELECT series, count(*) FILTER (WHERE month_of_sale <= DATE '1999-12-01' AND net_sales IS NULL) AS missing, count(*) FILTER (WHERE month_of_sale <= DATE '1999-12-01' AND net_sales < 0) AS negative, count(*) FILTER (WHERE month_of_sale > DATE '1999-12-01') AS future FROM panel GROUP BY 1")
def v8_targets(spark, d):
    return checks.check_targets(_panel(spark, d), "series", "month_of_sale", "net_sales", "1999-12-01")


@query("v10_length", "SELECT concat(parent_dealer_code, '<>', model_family) AS series, count(*) AS n FROM monthly GROUP BY 1 HAVING count(*) < 48")
def v10_length(spark, d):
    return checks.check_length(_monthly(spark, d).withColumn("series", mapping.series_key()), "series", 36, 12)


@query("v11_audit_counts", """SELECT unnest(['rows', 'columns', 'duplicate_keys']) AS check_name, unnest([CAST(sum(n) AS BIGINT), 3, count(*) FILTER (WHERE n > 1)]) AS value FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)""")
def v11_audit_counts(spark, d):
    return checks.audit_counts(source(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


# Forecaster ----------------------------------------------------------------------------------


@query("j15_backtest")
def j15_backtest(spark, d):
    """Monthly forecasts for the origins of the last two years by one global model over all series."""
    p = _panel(spark, d).withColumn("month", F.month("month_of_sale"))
    origins = p.select(F.col("month_of_sale").alias("origin")).distinct().filter("origin >= DATE '1997-01-01'")
    samples = staged(forecast.make_samples(p, "series", "month_of_sale", "net_sales", origins, 3, lags=(1, 2, 3, 12), window=6, future=("month",), season=12), "samples")
    model = forecast.PanelForecaster("series", ["lag_1", "lag_2", "lag_3", "lag_12", "win_mean", "win_max", "season_lag", "step", "month"])
    out = forecast.backtest(samples, model, "2000-01-01", residual_from="1999-01-01")
    return out.filter("target IS NOT NULL").select("series", "origin", "step", "target_date", "target", "forecast", "p10", "p50", "p90")
