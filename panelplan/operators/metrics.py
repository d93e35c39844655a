"""Forecast accuracy, by month, segment, series and step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelplan.operators.quantiles import exact_quantiles
from panelplan.sources.scratch import staged

EPS = 2.220446049250313e-16


def ape(actual: str, forecast: str) -> Column:
    """Absolute percentage error; null where the actual is 0."""
    return F.when(F.col(actual) != 0, F.abs(F.col(actual) - F.col(forecast)) / F.abs(F.col(actual)) * 100)


def compare_by_month(df: DataFrame, a: str, b: str, actual: str = "actual", month: str = "month_of_sale", series: str = "series", min_actual: float | None = None) -> DataFrame:
    """Mean and median APE of two models by month, the winner (ties: b) and the gap in points. Zero actuals are left out."""
    rows = df.filter(F.col(actual) != 0)
    rows = rows.filter(F.col(actual) >= min_actual) if min_actual is not None else rows
    rows = staged(rows.select(month, series, ape(actual, a).alias("ape_a"), ape(actual, b).alias("ape_b")), "apes")
    means = rows.groupBy(month).agg(F.count_distinct(series).alias("n_series"), F.avg("ape_a").alias("mape_a"), F.avg("ape_b").alias("mape_b"))
    out = means.join(exact_quantiles(rows, [month], {"median_a": ("ape_a", 0.5), "median_b": ("ape_b", 0.5)}), month, "left")
    return out.withColumn("winner", F.when(F.col("mape_a") < F.col("mape_b"), "a").otherwise("b")).withColumn("gap", F.abs(F.col("mape_a") - F.col("mape_b")))


def model_rows(df: DataFrame, models: list[str]) -> DataFrame:
    """One row per model: columns of forecasts unpivoted into (model, forecast)."""
    ids = [c for c in df.columns if c not in models]
    return df.unpivot(ids, models, "model", "forecast")


def segment_metrics(df: DataFrame, models: list[str], actual: str = "actual", segment: str = "sku_type", month: str = "month_of_sale") -> DataFrame:
    """N, MAE, RMSE, MAPE, wMAPE and bias of each model overall, by segment and by month: grouping sets, one pass."""
    rows = model_rows(df, models).withColumn("e", F.col("forecast") - F.col(actual))
    x, y = F.abs("e"), F.abs(actual)
    sets = rows.groupingSets([["model"], ["model", segment], ["model", month]], "model", segment, month).agg(
        F.grouping_id("model", segment, month).alias("gid"), F.count("*").alias("n"), F.avg(x).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        F.avg(F.when(y > 1e-9, x / y * 100)).alias("mape"), F.try_divide(F.sum(x) * 100, F.sum(y)).alias("wmape"), F.try_divide(F.sum("e") * 100, F.sum(actual)).alias("bias_pct"),
    )
    level = F.when(F.col("gid") == 3, "overall").when(F.col("gid") == 1, "segment").otherwise("month")
    value = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, F.col(segment)).otherwise(F.date_format(month, "yyyy-MM"))
    return sets.withColumns({"level": level, "value": value}).select("model", "level", "value", "n", "mae", "rmse", "mape", "wmape", "bias_pct")


def verdicts(metrics: DataFrame, a: str, b: str, close: float = 0.05) -> DataFrame:
    """Winner by wMAPE of each segment; `close` if the gap is less than 5 % of the larger one."""
    one = metrics.filter(F.col("model") == a).select("level", "value", F.col("wmape").alias("wmape_a"))
    two = metrics.filter(F.col("model") == b).select("level", "value", F.col("wmape").alias("wmape_b"))
    gap = F.try_divide(F.abs(F.col("wmape_a") - F.col("wmape_b")), F.greatest("wmape_a", "wmape_b"))
    verdict = F.when(F.coalesce(gap, F.lit(0.0)) < close, "close").when(F.col("wmape_a") < F.col("wmape_b"), a).otherwise(b)
    return one.join(two, ["level", "value"]).withColumn("relative_gap", gap).withColumn("verdict", verdict)


def overall_verdict(verdict: DataFrame, first: str = "Runner") -> DataFrame:
    """The deciding segment's verdict if it is not close, else that over all rows."""
    found = verdict.agg(F.max(F.when(F.col("value") == first, F.col("verdict"))).alias("first"), F.max(F.when(F.col("level") == "overall", F.col("verdict"))).alias("overall"))
    return found.withColumn("decision", F.when(F.col("first").isNotNull() & (F.col("first") != "close"), F.col("first")).otherwise(F.col("overall")))


def series_metrics(df: DataFrame, series: str = "series", actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    e = F.col(forecast) - F.col(actual)
    return df.groupBy(series).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.try_divide(F.sum(F.abs(e)), F.sum(F.abs(actual))).alias("wape"),
        F.sum(e).alias("bias"), F.sum(actual).alias("total_actual"), F.sum(forecast).alias("total_forecast"),
    )


def series_summary(per_series: DataFrame) -> DataFrame:
    rows = staged(per_series.select("wape", "bias", "total_actual"), "per-series")
    total = rows.agg(F.try_divide(F.sum("bias"), F.sum("total_actual")).alias("total_bias"))
    return exact_quantiles(rows, [], {"median_wape": ("wape", 0.5)}).join(total, F.lit(True), "right")  # a row each


def series_mape(df: DataFrame, series: str = "series", actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    """MAPE and volume of each series with any sales; steps with actual 0 are left out of it."""
    return df.groupBy(series).agg(F.avg(ape(actual, forecast)).alias("mape"), F.sum(actual).alias("volume")).filter("mape IS NOT NULL")


def mape_summary(per_series: DataFrame) -> DataFrame:
    return per_series.agg(F.count("*").alias("n_series"), F.avg("mape").alias("mean_mape"), F.try_divide(F.sum(F.col("mape") * F.col("volume")), F.sum("volume")).alias("weighted_mape"))


def mape_histogram(per_series: DataFrame, lo: float, hi: float, bins: int = 30) -> DataFrame:
    return per_series.groupBy(F.width_bucket("mape", F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def smape(df: DataFrame, actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    e = F.col(forecast) - F.col(actual)
    return df.agg(F.avg(F.try_divide(F.abs(e) * 200, F.abs(actual) + F.abs(forecast))).alias("smape"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def mape_eps(df: DataFrame, actual: str = "actual", forecast: str = "forecast", eps: float = EPS) -> DataFrame:
    """Mean absolute error over the actual, whose size counts as eps at least."""
    return df.agg(F.avg(F.abs(F.col(actual) - F.col(forecast)) / F.greatest(F.abs(actual), F.lit(eps))).alias("mape"))


def daily_ape(df: DataFrame, date: str, actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    return df.groupBy(date).agg(F.sum(actual).alias("actual"), F.sum(forecast).alias("forecast")).withColumn("ape", ape("actual", "forecast"))


def daily_ape_totals(daily: DataFrame) -> DataFrame:
    return daily.agg(F.sum("actual").alias("actual"), F.sum("forecast").alias("forecast"), F.avg("ape").alias("mean_ape"), F.median("ape").alias("median_ape"))


def loss_metrics(df: DataFrame, delta: float = 1.0, flag: str | None = None, weight: str | None = None, actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    """MSE, Huber, Huber plus flagged AE or APE, and Huber weighted by a column."""
    e = F.abs(F.col(forecast) - F.col(actual))
    huber = F.when(e <= delta, e * e / 2).otherwise(F.lit(delta) * (e - delta / 2))
    marked = F.col(flag).cast("double") if flag else F.lit(0.0)
    w = F.col(weight) if weight else F.lit(1.0)
    share = F.coalesce(F.try_divide(e, F.abs(actual)), F.lit(0.0))
    return df.agg(F.avg(e * e).alias("mse"), F.avg(huber).alias("huber"), F.avg(huber + marked * e).alias("huber_ae"), F.avg(huber + marked * share).alias("huber_ape"), F.try_divide(F.sum(w * huber), F.sum(w)).alias("weighted_huber"))


def quantile_summary(samples: DataFrame, keys: list[str], value: str = "sample", qs: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Exact quantiles of groups of any size."""
    return exact_quantiles(samples, keys, {f"p{round(q * 100)}": (value, q) for q in qs})


def draw_quantiles(samples: DataFrame, keys: list[str], value: str = "sample", qs: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Quantiles of the draws of each forecast: groups of a fixed, small number of rows, each in one buffer."""
    found = samples.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(q) for q in qs])).alias("__q"))
    return found.select(*keys, *[F.col("__q")[k].alias(f"p{round(q * 100)}") for k, q in enumerate(qs)])


def pinball(actual: Column, quantile: Column, q: float) -> Column:
    d = actual - quantile
    return F.greatest(d * q, d * (q - 1))
