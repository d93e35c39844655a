"""Demand variability, ABC classes, safety stock and order quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelplan.functions.columns import parse_series_key

#: Standard normal quantiles of the service levels, and days of cover by ABC class.
SERVICE_LEVELS = [(90, 1.28), (92, 1.41), (95, 1.65), (97, 1.88), (99, 2.33)]
COVER_DAYS = {"A": 30, "B": 25, "C": 20}
#: What the variability of an order is taken from: the SKU's own sales, or those of its family.
BASES = ["sku", "family"]


def demand_variability(monthly: DataFrame, keys: list[str], date: str = "month_of_sale", value: str = "net_sales", out: str = "variability", fill_gaps: bool = False) -> DataFrame:
    """Sample deviation of the changes between a group's observed months; 1 for two months or fewer.

    fill_gaps: months without a row between a group's first and last one count as months with 0."""
    if fill_gaps:
        spans = monthly.groupBy(*keys).agg(F.min(date).alias("__lo"), F.max(date).alias("__hi")).select(*keys, F.explode(F.sequence("__lo", "__hi", F.expr("interval 1 month"))).alias(date))
        monthly = spans.join(monthly.select(*keys, date, value), [*keys, date], "left").fillna(0, [value])
    change = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(date))
    found = monthly.withColumn("__change", change).groupBy(*keys).agg(F.count("*").alias("n_months"), F.stddev_samp("__change").alias("__sd"))
    return found.withColumn(out, F.when(F.col("n_months") <= 2, F.lit(1.0)).otherwise(F.coalesce("__sd", F.lit(1.0)))).drop("__sd")


def run_window(sales: DataFrame, run: DataFrame, k: int, date: str = "month_of_sale") -> DataFrame:
    """Rows of the k whole months before the run's month; run has one row, a date run_month."""
    first = F.trunc("run_month", "MM")
    one = run.select(F.add_months(first, -k).alias("__lo"), first.alias("__hi"))
    return sales.join(F.broadcast(one), (F.col(date) >= F.col("__lo")) & (F.col(date) < F.col("__hi"))).drop("__lo", "__hi")


def family_sales(monthly: DataFrame, date: str = "month_of_sale", value: str = "net_sales") -> DataFrame:
    """Monthly SKU sales added up by family."""
    return monthly.groupBy("parent_dealer_code", "model_family_code", date).agg(F.sum(value).alias(value))


def running_share(df: DataFrame, part: list[str], value: str, tie: str) -> DataFrame:
    """share (% of the part's total, 0 for a total of 0) and running share, largest first, ties by `tie`."""
    whole = Window.partitionBy(*part)
    share = F.coalesce(F.try_divide(F.col(value) * 100, F.sum(value).over(whole)), F.lit(0.0))
    before = whole.orderBy(F.col(value).desc(), tie).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("share_pct", share).withColumn("running_pct", F.sum("share_pct").over(before))


def abc_class(df: DataFrame, part: list[str], value: str, tie: str) -> DataFrame:
    """A below 70 % of the running share, C above 90 %, else B."""
    ranked = running_share(df, part, value, tie)
    return ranked.withColumn("abc_class", F.when(F.col("running_pct") < 70, "A").when(F.col("running_pct") > 90, "C").otherwise("B")).withColumn("abc_policy", abc_policy())


def abc_policy() -> Column:
    """What the classes stand for, as a text beside each class: days of cover."""
    return F.lit(",".join(f"{k} {v}" for k, v in COVER_DAYS.items()))


def cover_days(abc: Column) -> Column:
    out = F.when(abc == "A", COVER_DAYS["A"])
    for k in ("B", "C"):
        out = out.when(abc == k, COVER_DAYS[k])
    return out.otherwise(15)


def safety_stock(df: DataFrame) -> DataFrame:
    """Least of ceil(z x variability x sqrt(days / 30)) and three times the SKU forecast."""
    need = F.ceil(F.col("z") * F.col("variability") * F.sqrt(cover_days(F.col("abc_class")) / F.lit(30.0)))
    return df.withColumn("safety_stock", F.least(need.cast("double"), F.col("sku_forecast") * 3))


def split_null_lead(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a largest lead time, and those without (for quarantine)."""
    return df.filter("max_lead_time IS NOT NULL"), df.filter("max_lead_time IS NULL")


def lead_time_stock(df: DataFrame) -> DataFrame:
    return df.withColumns({f"lead_stock_{k}": F.ceil(F.col("sku_forecast") * F.col(f"{k}_lead_time") / 30).cast("double") for k in ("min", "avg", "max")})


def order_quantity(df: DataFrame) -> DataFrame:
    """For each lead time: reorder level, wanted total, and the suggested order (never below 0); `_b` is
    the second approach, which leaves the forecast out."""
    new = {}
    for k in ("min", "avg", "max"):
        reorder = F.col(f"lead_stock_{k}") + F.col("safety_stock")
        new[f"reorder_{k}"] = reorder
        new[f"total_{k}"] = reorder + F.col("sku_forecast")
        new[f"order_{k}"] = F.greatest(reorder + F.col("sku_forecast") - F.col("closing_stock"), F.lit(0.0))
        new[f"order_b_{k}"] = F.greatest(reorder - F.col("closing_stock"), F.lit(0.0))
    return df.withColumns(new)


def stock_by_sku(stock: DataFrame, following: DataFrame, dealers: DataFrame, date: str) -> DataFrame:
    """Closing stock of a day by parent dealer and current SKU."""
    rows = stock.filter(F.col("cal_date") == F.lit(date).cast("date")).join(following, "sku", "left").withColumn("sku", F.coalesce("current_sku", "sku"))
    return rows.join(dealers, "dealer_code").groupBy("parent_dealer_code", "sku").agg(F.sum("closing_stock").alias("closing_stock"))


def order_candidates(forecast: DataFrame, stock: DataFrame, lead: DataFrame) -> DataFrame:
    """SKU forecasts with stock (0 if none) and lead times."""
    keys = ["parent_dealer_code", "sku"]
    return forecast.join(stock, keys, "left").withColumn("closing_stock", F.coalesce("closing_stock", F.lit(0))).join(lead, keys, "left")


def variability_by_basis(sku_sales: DataFrame, family_sales: DataFrame, skus: DataFrame) -> DataFrame:
    """(parent_dealer_code, sku, basis, variability): each SKU's own, and its family's for every SKU of skus."""
    own = demand_variability(sku_sales, ["parent_dealer_code", "sku"])
    family = demand_variability(family_sales, ["parent_dealer_code", "model_family_code"]).join(skus.select("model_family_code", "sku").distinct(), "model_family_code")
    one, two = [x.select("parent_dealer_code", "sku", F.lit(b).alias("basis"), "variability") for x, b in zip((own, family), BASES, strict=True)]
    return one.unionByName(two)


def order_sweep(candidates: DataFrame, variability: DataFrame, spark, levels: list[tuple[int, float]] = SERVICE_LEVELS, bases: list[str] = BASES) -> DataFrame:
    """Order quantities of every candidate for all bases and service levels in one job.

    variability: (parent_dealer_code, sku, basis, variability); 1 for candidates that it lacks."""
    wanted = spark.createDataFrame(levels, "service_level int, z double")
    each = candidates.crossJoin(F.broadcast(spark.createDataFrame([(b,) for b in bases], "basis string")))
    rows = each.join(variability, ["parent_dealer_code", "sku", "basis"], "left").withColumn("variability", F.coalesce("variability", F.lit(1.0))).crossJoin(F.broadcast(wanted))
    return order_quantity(lead_time_stock(safety_stock(rows)))


def enrich_orders(orders: DataFrame, end_of_journey: DataFrame, areas: DataFrame, dealer: str = "parent_dealer_code") -> DataFrame:
    """The end-of-journey flag of each SKU, and area office and zone of each dealer."""
    return orders.join(end_of_journey, "sku", "left").join(areas.withColumnRenamed("dealer_code", dealer), dealer, "left")


def stage_forecast(forecast: DataFrame, key: str, tags: dict[str, str]) -> DataFrame:
    """A prediction table: the series key taken apart, and the tags of the run."""
    return parse_series_key(forecast, key).withColumns({k: F.lit(v) for k, v in tags.items()})


def weekly_to_monthly(weekly: DataFrame, dates: DataFrame) -> DataFrame:
    """Weekly forecasts (ts, series, forecast) by month of their regularised date; negative sums are 0, others are rounded half to even."""
    rows = weekly.join(dates.withColumnRenamed("date", "ts"), "ts").groupBy("series", "month_date").agg(F.sum("forecast").alias("__sum"))
    return rows.select("series", "month_date", F.when(F.col("__sum") < 0, F.lit(0.0)).otherwise(F.bround("__sum", 0)).alias("forecast"))
