"""Family forecasts to SKU forecasts by recent sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookback_join(sales: DataFrame, months: DataFrame, k: int = 3, date: str = "month_of_sale", forecast: str = "forecast_month") -> DataFrame:
    """Monthly sales under each forecast month that they precede by 1 to k months.

    A range join as an equi-join: each row of monthly sales is offered to k forecast months."""
    offered = sales.withColumn(forecast, F.explode(F.sequence(F.add_months(date, 1), F.add_months(date, k), F.expr("interval 1 month"))))
    return offered.join(F.broadcast(months.select(forecast).distinct()), forecast)


def lookback_sales(sales: DataFrame, months: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """Sales of the k months before each forecast month, by keys."""
    return lookback_join(sales, months, k).groupBy("forecast_month", *keys).agg(F.sum("net_sales").alias("sales"))


def num_active_skus(skus: DataFrame) -> DataFrame:
    return skus.groupBy("model_family_code").agg(F.count_distinct("sku").alias("n_active"))


def expand_to_sku(forecast: DataFrame, active: DataFrame) -> DataFrame:
    """Each family forecast once for every active SKU of the family; families without one keep a row without SKU."""
    return forecast.join(active.select("model_family_code", "sku").distinct(), "model_family_code", "left")


def sku_share(df: DataFrame, digits: int | None = 5, strict: bool = False) -> DataFrame:
    """share of a SKU in its family's sales: 1/N where the family has none (null if strict), else its part.

    Needs sales by SKU; totals and counts are those of the rows that are there, over one window."""
    w = Window.partitionBy("forecast_month", "parent_dealer_code", "model_family_code")
    return _with_share(df.withColumns({"family_sales": F.sum("sales").over(w), "n_skus": F.count("*").over(w)}), digits, strict)


def _with_share(df: DataFrame, digits: int | None, strict: bool = False) -> DataFrame:
    """no_history_flag and share, from sales, family_sales and n_skus."""
    even = F.lit(None).cast("double") if strict else 1 / F.col("n_skus")
    share = F.when(F.col("family_sales") == 0, even).when(F.col("sales") == 0, F.lit(0.0)).otherwise(F.try_divide("sales", "family_sales"))
    out = df.withColumn("no_history_flag", F.col("family_sales") == 0)
    return out.withColumn("share", F.bround(share, digits) if digits is not None else share)


def active_totals(df: DataFrame) -> DataFrame:
    """Sales of a family's active SKUs at a dealer (family_total) and of each SKU in its family (sku_total), on every row."""
    family = Window.partitionBy("forecast_month", "parent_dealer_code", "model_family_code")
    own = Window.partitionBy("forecast_month", "parent_dealer_code", "model_family_code", "sku")
    return df.withColumns({"family_total": F.sum("sales").over(family), "sku_total": F.sum("sales").over(own)})


def strict_weights(forecast: DataFrame, recent: DataFrame) -> DataFrame:
    """The variant without an even split: SKUs that were sold share their family's forecast by sales, rounded to
    whole units; families without sales in the look-back have no weight and no forecast."""
    weights = sku_share(recent, None, strict=True).select("forecast_month", "parent_dealer_code", "model_family_code", "sku", "share", "no_history_flag")
    out = forecast.join(weights, ["forecast_month", "parent_dealer_code", "model_family_code"], "left")
    return out.withColumn("sku_forecast", F.when(~F.col("no_history_flag"), F.round(F.col("forecast") * F.col("share"), 0)))


def sku_share_of_window(sales: DataFrame) -> DataFrame:
    """Share of each SKU in its family's sales at a dealer over all months given; each SKU counts once."""
    keys = ["parent_dealer_code", "model_family_code"]
    own = sales.groupBy(*keys, "sku").agg(F.sum("net_sales").alias("sku_sales"))
    w = Window.partitionBy(*keys)
    out = own.withColumns({"family_sales": F.sum("sku_sales").over(w), "n_skus": F.count("*").over(w)})
    return out.withColumn("share", F.try_divide("sku_sales", "family_sales"))


def disaggregate(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """sku_forecast: a single active SKU takes the whole forecast, else its share of it."""
    value = F.when(F.col("n_skus") == 1, F.col("forecast")).otherwise(F.col("share") * F.col("forecast"))
    return df.withColumn("sku_forecast", F.round(value, digits) if digits is not None else value)


#: Parts that a family's SKUs are dealt into, so that a large family is the work of several tasks.
PARTS = 16


def sold_by_sku(sku_sales: DataFrame, active: DataFrame, months: DataFrame, k: int = 3) -> DataFrame:
    """(model_family_code, part, sku, sold): every active SKU once; sold is dealer -> forecast month -> sales of the k months before it.

    Dealt out by family and part, and only here: sales are looked back from behind that shuffle."""
    part = F.pmod(F.xxhash64("sku"), F.lit(PARTS)).alias("part")
    sales = sku_sales.select("model_family_code", part, "sku", "parent_dealer_code", "month_of_sale", "net_sales", F.lit(0).alias("active"))
    every = active.select("model_family_code", part, "sku", F.lit(1).alias("active"))
    rows = sales.unionByName(every, allowMissingColumns=True)
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "model_family_code", "part")
    offered = rows.withColumn("forecast_month", F.explode_outer(F.sequence(F.add_months("month_of_sale", 1), F.add_months("month_of_sale", k), F.expr("interval 1 month"))))
    asked = offered.join(F.broadcast(months.select("forecast_month").distinct().withColumn("asked", F.lit(True))), "forecast_month", "left").filter("asked OR active = 1")
    keys = ["model_family_code", "part", "sku"]
    sold = asked.groupBy(*keys, "parent_dealer_code", "forecast_month").agg(F.sum("net_sales").alias("sales"), F.max("active").alias("active"))
    by_month = F.map_from_entries(F.collect_list(F.when(F.col("forecast_month").isNotNull(), F.struct("forecast_month", "sales"))))
    by_dealer = F.map_from_entries(F.collect_list(F.when(F.col("parent_dealer_code").isNotNull(), F.struct("parent_dealer_code", "sold"))))
    sold = sold.groupBy(*keys, "parent_dealer_code").agg(by_month.alias("sold"), F.max("active").alias("active"))
    return sold.groupBy(*keys).agg(by_dealer.alias("sold"), F.max("active").alias("active")).filter("active = 1").drop("active")


def disaggregate_months(forecast: DataFrame, sku_sales: DataFrame, skus: DataFrame, k: int = 3, digits: int | None = 5) -> DataFrame:
    """SKU forecasts for all forecast months in one job.

    forecast: (forecast_month, parent_dealer_code, model_family_code, forecast), a row for each three keys; sku_sales:
    monthly net sales by (parent_dealer_code, model_family_code, sku). Families without an active SKU are left out.

    Every active SKU has a row in every month of every dealer of its family, so the result is far larger than what it
    comes from. Those rows are made last and never shuffled: families bring their totals and their number of SKUs
    along, a SKU brings its sales."""
    family = ["parent_dealer_code", "model_family_code"]
    active = skus.filter(F.lower("skustatus") == "active").select("model_family_code", "sku").distinct()
    totals = lookback_sales(sku_sales.join(active, ["model_family_code", "sku"], "left_semi"), forecast, family, k).withColumnRenamed("sales", "family_sales")
    families = forecast.join(totals, ["forecast_month", *family], "left").withColumn("family_sales", F.coalesce("family_sales", F.lit(0.0)))
    months = families.groupBy(*family).agg(F.collect_list(F.struct("forecast_month", "forecast", "family_sales")).alias("months"))
    months = months.join(num_active_skus(active).withColumnRenamed("n_active", "n_skus"), "model_family_code")
    months = months.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>")))
    rows = sold_by_sku(sku_sales, active, forecast, k).join(months, ["model_family_code", "part"])
    rows = rows.withColumn("own", F.try_element_at("sold", F.col("parent_dealer_code"))).select(*family, "sku", "n_skus", "own", F.explode("months").alias("m"))
    sales = F.coalesce(F.try_element_at("own", F.col("m.forecast_month")), F.lit(0.0)).alias("sales")
    return disaggregate(_with_share(rows.select("m.forecast_month", *family, "sku", "m.forecast", sales, "m.family_sales", "n_skus"), digits), None)


def reconcile(df: DataFrame) -> DataFrame:
    """SKU forecasts added up against the family's, and their difference, for each family and month."""
    keys = ["forecast_month", "parent_dealer_code", "model_family_code"]
    out = df.groupBy(*keys).agg(F.max("forecast").alias("family_forecast"), F.sum("sku_forecast").alias("sku_total"))
    return out.withColumn("difference", F.abs(F.col("family_forecast") - F.col("sku_total")))
