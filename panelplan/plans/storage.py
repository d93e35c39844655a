"""Queries of sources and sinks: each writes rows of the planning tables and returns what is read back."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from panelplan.operators import checks, joins, reports
from panelplan.plans.registry import _monthly, _panel, query
from panelplan.plans.views import ANCHORS, load, source, view
from panelplan.sources import io
from panelplan.sources.scratch import scratch_dir, staged
from panelplan.spec import PanelSpec, RunTags


def _name() -> str:
    return f"panelplan_{uuid.uuid4().hex}"


def _read_and_dropped(found, *names: str):
    """What a query reads from catalog tables, written, so that the tables leave the catalog."""
    out = staged(found, "read")
    for name in names:
        out.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    return out


@query("a1_a6_catalog_table", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def a1_a6_catalog_table(spark, d):
    name = _name()
    io.write_table(source(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), name, path=scratch_dir(spark, "table"))
    return _read_and_dropped(io.read_table(spark, name), name)


@query("a2_sql_parameters", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1996-01-01' AND CAST(l_shipdate AS DATE) < DATE '1997-07-01' GROUP BY 1")
def a2_sql_parameters(spark, d):
    load(spark, d)
    text = "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE CAST(l_shipdate AS DATE) >= :lo AND CAST(l_shipdate AS DATE) < :hi GROUP BY l_returnflag"
    return io.read_sql(spark, text, {"lo": date(1996, 1, 1), "hi": date(1997, 7, 1)})


@query("a3_a8_csv", "SELECT * FROM monthly")
def a3_a8_csv(spark, d):
    path = scratch_dir(spark, "csv")
    io.export(_monthly(spark, d), path, "csv")
    return io.read_panel_csv(spark, path, "parent_dealer_code string, model_family string, month_of_sale date, net_sales double")


@query("a4_a5_parquet_parts", """SELECT CAST(1996 AS INT) AS part, series, net_sales FROM panel WHERE year(month_of_sale) = 1996
        UNION ALL SELECT CAST(0 AS INT), series, sum(net_sales) FROM panel WHERE year(month_of_sale) IN (1996, 1997) GROUP BY 2""")  # fmt: skip
def a4_a5_parquet_parts(spark, d):
    p, path = _panel(spark, d), scratch_dir(spark, "parts")
    for year in (1996, 1997):
        io.export(p.filter(F.year("month_of_sale") == year), f"{path}/y{year}")
    one = io.read_parquet(spark, f"{path}/y1996", ["series", "net_sales"]).select(F.lit(1996).alias("part"), "series", "net_sales")
    both = io.read_parts(spark, f"{path}/y*").groupBy(F.lit(0).alias("part"), "series").agg(F.sum("net_sales").alias("net_sales"))
    return joins.concat(one, both)


@query("a7_append_run", """SELECT '20260801' AS run_date, v AS run_version, '202608' AS planning_month, 'N' AS obd_flag, count(*) AS n, sum(net_sales) AS net_sales
        FROM monthly, (VALUES ('v1'), ('v2')) AS t(v) GROUP BY v""")  # fmt: skip
def a7_append_run(spark, d):
    rows, path = _monthly(spark, d), scratch_dir(spark, "runs")
    for version, part in (("v1", rows.filter("net_sales > 10")), ("v2", rows), ("v1", rows)):  # v1 is run again
        io.append_run(part, path, RunTags("20260801", version, "202608"))
    back = spark.read.parquet(path).withColumn("run_date", F.col("run_date").cast("string"))
    return back.groupBy("run_date", "run_version", "planning_month", "obd_flag").agg(F.count("*").alias("n"), F.sum("net_sales").alias("net_sales"))


@query("a9_panel_by_dealer", """SELECT 'folders' AS kind, parent_dealer_code AS key, count(*) AS n, sum(net_sales) AS net_sales FROM panel GROUP BY 2
        UNION ALL SELECT 'buckets', series, count(*), sum(net_sales) FROM panel GROUP BY 2""")  # fmt: skip
def a9_panel_by_dealer(spark, d):
    p, path, name = _panel(spark, d), scratch_dir(spark, "panel"), _name()
    io.write_panel(p, path, "parent_dealer_code")
    io.write_series_table(p, name, "series", 8, scratch_dir(spark, "buckets"))
    sums = [F.count("*").alias("n"), F.sum("net_sales").alias("net_sales")]
    folders = spark.read.parquet(path).groupBy(F.lit("folders").alias("kind"), F.col("parent_dealer_code").cast("string").alias("key")).agg(*sums)
    buckets = io.read_table(spark, name).groupBy("series").agg(*sums).select(F.lit("buckets").alias("kind"), F.col("series").alias("key"), "n", "net_sales")
    return _read_and_dropped(joins.concat(folders, buckets), name)


@query("a10_split_files", """SELECT part, count(*) AS n, min(series) AS first, max(series) AS last, sum(total) AS total FROM (
        SELECT *, CAST(floor((row_number() OVER (ORDER BY series) - 1) / 50) AS INT) AS part FROM (SELECT series, sum(net_sales) AS total FROM panel GROUP BY 1)) GROUP BY 1""")  # fmt: skip
def a10_split_files(spark, d):
    path = scratch_dir(spark, "split")
    io.write_split(_panel(spark, d).groupBy("series").agg(F.sum("net_sales").alias("total")), path, "series", 50)
    return spark.read.parquet(path).groupBy("part").agg(F.count("*").alias("n"), F.min("series").alias("first"), F.max("series").alias("last"), F.sum("total").alias("total"))


@query("a11_report", """SELECT 'by_month' AS report, strftime(month_of_sale, '%Y-%m-%d') AS key, sum(net_sales) AS total FROM panel GROUP BY 2
        UNION ALL SELECT 'by_dealer', parent_dealer_code, sum(net_sales) FROM panel GROUP BY 2""")  # fmt: skip
def a11_report(spark, d):
    p, folder = _panel(spark, d), scratch_dir(spark, "report")
    keys = {"by_month": "month_of_sale", "by_dealer": "parent_dealer_code"}
    io.write_report({name: p.groupBy(F.col(k).cast("string").alias("key")).agg(F.sum("net_sales").alias("total")) for name, k in keys.items()}, folder)
    return joins.concat(*[io.read_panel_csv(spark, f"{folder}/{name}", "key string, total double").select(F.lit(name).alias("report"), "key", "total") for name in keys])


@query("a12_write_audit", """SELECT 'lineitem' AS source, unnest(['rows', 'columns', 'duplicate_keys']) AS check_name, unnest([CAST(sum(n) AS BIGINT), 2, count(*) FILTER (WHERE n > 1)]) AS value FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
        UNION ALL SELECT 'orders', unnest(['rows', 'columns', 'duplicate_keys']), unnest([CAST(sum(n) AS BIGINT), 2, count(*) FILTER (WHERE n > 1)]) FROM (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1)""")  # fmt: skip
def a12_write_audit(spark, d):
    path = scratch_dir(spark, "audit")
    for name, key, more in (("lineitem", "l_orderkey", "l_partkey"), ("orders", "o_orderkey", "o_custkey")):
        found = checks.audit_counts(source(spark, d, name).select(key, more), [key])
        io.write_audit(found.withColumn("source", F.lit(name)), path)
    return spark.read.parquet(path).select("source", "check_name", "value")


@query("a13_from_rows", "SELECT a AS anchor, count(*) AS n, sum(invoiced_sales) AS invoiced_sales FROM retail JOIN (VALUES " + ", ".join(f"(DATE '{a}')" for a in ANCHORS) + ") AS t(a) ON cal_date = a GROUP BY 1")
def a13_from_rows(spark, d):
    days = io.from_rows(spark, [(date.fromisoformat(a),) for a in ANCHORS], "anchor date")
    rows = view(spark, d, "retail").join(F.broadcast(days), F.col("cal_date") == F.col("anchor"))
    return rows.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("invoiced_sales").alias("invoiced_sales"))


@query("a14_column_roles", """SELECT unnest(['static', 'static', 'future', 'future', 'future', 'future', 'future']) AS role, unnest(['l_returnflag', 'l_linestatus', 'l_suppkey', 'l_linenumber', 'l_extendedprice', 'l_discount', 'l_tax']) AS column_name,
        unnest([count(DISTINCT l_returnflag), count(DISTINCT l_linestatus), count(DISTINCT l_suppkey), count(DISTINCT l_linenumber), count(DISTINCT l_extendedprice), count(DISTINCT l_discount), count(DISTINCT l_tax)]) AS n_values FROM lineitem""")  # fmt: skip
def a14_column_roles(spark, d):
    """Roles by type, and how many values each such column holds."""
    rows = source(spark, d, "lineitem")
    spec = PanelSpec.infer(rows.schema, "l_partkey", "l_shipdate", "l_quantity", exclude=("l_orderkey",))
    names = [*spec.static, *spec.future]
    counts = rows.agg(*[F.count_distinct(c).alias(c) for c in names]).unpivot([], names, "column_name", "n_values")
    return counts.withColumn("role", F.when(F.col("column_name").isin(list(spec.static)), "static").otherwise("future"))


@query("a15_run_stage", "SELECT CAST(year(month_of_sale) AS INT) AS year, count(*) AS n, sum(net_sales) AS net_sales FROM panel GROUP BY 1")
def a15_run_stage(spark, d):
    p, path = _panel(spark, d).withColumn("year", F.year("month_of_sale")), scratch_dir(spark, "stage")
    io.run_stage(p.filter("year < 1998"), path, ["year"])  # as far as a broken run came
    io.run_stage(p, path, ["year"])
    return spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"), F.sum("net_sales").alias("net_sales"))


@query("d20_monthly_report", "SELECT CAST(date_trunc('month', cal_date) AS DATE) AS month_of_sale, parent_dealer_code_model_family, sum(net_sales) AS net_sales FROM daily_panel GROUP BY 1, 2")
def d20_monthly_report(spark, d):
    path = scratch_dir(spark, "monthly-long")
    io.export(reports.to_monthly(view(spark, d, "daily_panel"), "parent_dealer_code_model_family", "cal_date", "net_sales"), path)
    return io.read_parquet(spark, path, ["month_of_sale", "parent_dealer_code_model_family", "net_sales"])
