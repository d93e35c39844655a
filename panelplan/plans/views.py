"""The planning tables, as views over the TPC-H-like tables; one SQL text serves Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Festival anchors by year: fixed values.
ANCHORS = ["1994-11-03", "1995-10-23", "1996-11-10", "1997-10-30", "1998-10-19", "1999-11-07", "2000-10-26", "2001-11-14"]

VIEWS = {
    "retail": """
        SELECT CAST(l_shipdate AS DATE) AS cal_date, CAST(l_suppkey AS STRING) AS dealer_code, c_mktsegment AS x_customer_type,
               p_brand AS model, CAST(l_partkey AS STRING) AS sku, l_quantity AS invoiced_sales,
               CASE WHEN l_returnflag = 'A' THEN -floor(l_quantity / 2) ELSE 0 END AS cancelled_sales,
               CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN -l_quantity ELSE 0 END AS returned_sales
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey""",
    "dealer_hierarchy": """
        SELECT CAST(s_suppkey AS STRING) AS x_dealer_code_hier, concat(CAST(s_nationkey AS STRING), ' - ', n_name) AS par_org_name
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "sku_source": """
        SELECT CAST(p_partkey AS STRING) AS sku, p_brand AS model, concat(p_brand, '<>', p_type) AS uniquefamilycode,
               CASE WHEN p_partkey % 4 = 0 THEN 'inactive' WHEN p_partkey % 4 = 1 THEN 'Active' ELSE 'active' END AS skustatus
        FROM part""",
    "family_mapping": "SELECT DISTINCT p_brand AS model, upper(replace(p_brand, 'Brand#', 'FAM')) AS model_family FROM part",
    "obd_mapping": """
        SELECT CAST(p_partkey AS STRING) AS previous_obd_sku, CAST(p_partkey + 1 AS STRING) AS current_obd_sku
        FROM part WHERE p_partkey % 20 = 0 AND p_partkey + 1 <= (SELECT max(p_partkey) FROM part)""",
    "stock": """
        SELECT DISTINCT CAST('2001-08-31' AS DATE) AS cal_date, CAST(l_suppkey AS STRING) AS dealer_code, p_brand AS model,
               CAST(l_partkey AS STRING) AS sku, (l_partkey * 7 + l_suppkey) % 40 AS closing_stock
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "lead_time": """
        SELECT DISTINCT CAST(s_nationkey AS STRING) AS parent_dealer_code, CAST(p_partkey AS STRING) AS sku,
               CASE WHEN p_size % 10 <> 0 THEN CAST(p_size % 5 + 1 AS DOUBLE) END AS min_lead_time,
               CASE WHEN p_size % 10 <> 0 THEN CAST(p_size % 5 + 3 AS DOUBLE) END AS avg_lead_time,
               CASE WHEN p_size % 10 <> 0 THEN CAST(p_size % 5 + 7 AS DOUBLE) END AS max_lead_time
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    "daily_panel": """
        SELECT concat('S', CAST(user_id % 20 AS STRING), '<>', upper(event_type)) AS parent_dealer_code_model_family, CAST(ts AS DATE) AS cal_date,
               count(*) AS n_events, sum(round(value, 0)) AS net_sales
        FROM events GROUP BY 1, 2""",
    "anchors": "SELECT CAST(a AS DATE) AS anchor FROM (VALUES " + ", ".join(f"('{a}')" for a in ANCHORS) + ") AS t(a)",
    "dispatch_runs": """
        SELECT CAST(o_orderdate AS DATE) AS run_date, CAST(o_orderkey % 3 AS INT) AS run_cycle_id, CAST(o_custkey AS STRING) AS dealer,
               o_totalprice AS obl_cr_limit_avail, o_orderkey AS dispatch_id
        FROM orders""",
}


def load(spark: SparkSession, sf_dir: str) -> None:
    """Register the source tables of a folder as temporary views."""
    for name in SOURCES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    load(spark, sf_dir)
    return spark.sql(VIEWS[name])


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str, *names: str, **more: str) -> str:
    """DuckDB text: the named views, further common table expressions, and the query."""
    parts = [f"{n} AS MATERIALIZED ({q})" for n, q in [*((n, VIEWS[n]) for n in names), *more.items()]]  # else one that is named twice is worked out twice
    own = sql.strip()
    if own.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}{', ' if parts else ''}{own[5:]}"
    return f"WITH {', '.join(parts)} {own}" if parts else own
