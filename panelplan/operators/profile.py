"""Profiles of series: coverage, sparsity, contribution, changes over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelplan.operators.quantiles import exact_quantiles
from panelplan.operators.ranking import with_running
from panelplan.sources.scratch import staged


def series_profile(df: DataFrame, series: str, date: str, value: str, as_of: str | None = None) -> DataFrame:
    """Dates, counts, spread and sparsity of each series; outlier: maximum over five times the mean.

    as_of: only dates up to this one count, so that empty months ahead do not lower a series' share of months with sales."""
    v = F.col(value)
    df = df.filter(F.col(date) <= F.lit(as_of).cast("date")) if as_of else df
    out = df.groupBy(series).agg(
        F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__q"), F.stddev_samp(value).alias("std"), F.avg(value).alias("mean"), F.count_if(v != 0).alias("n_nonzero"),
    )
    return out.withColumns({
        "q1": F.col("__q")[0], "median": F.col("__q")[1], "q3": F.col("__q")[2],
        "span_months": F.months_between(F.trunc("last_date", "MM"), F.trunc("first_date", "MM")).cast("int") + 1,
        "cv": F.try_divide("std", "mean"), "nonzero_share": F.try_divide("n_nonzero", "n"), "outlier": F.coalesce(F.try_divide("max", "mean") > 5, F.lit(False)),
    }).drop("__q")


def eligible_series(profile: DataFrame, min_share: float = 0.30, min_count: int = 18) -> DataFrame:
    return profile.filter((F.col("nonzero_share") >= min_share) & (F.col("n") >= min_count))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def with_totals(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(*keys)))


def monthly_contribution(df: DataFrame, date: str, value: str, year) -> DataFrame:
    """Each month's share of its fiscal year, four decimals. year: an expression of the date."""
    months = df.groupBy(F.trunc(date, "MM").alias("month_of_sale")).agg(F.sum(value).alias("total_monthly_sales")).withColumn("fiscal_year", year)
    months = with_totals(months, ["fiscal_year"], "total_monthly_sales", "total_yearly_sales")
    return months.withColumn("monthly_contribution", F.bround(F.try_divide("total_monthly_sales", "total_yearly_sales"), 4))


def series_proportion(df: DataFrame, series: str, date: str, value: str, lo: str, hi: str) -> DataFrame:
    """Sparsity and weight of each series between two dates: non-zero share of all days and since the first
    sale, share of the total, and running share, largest first."""
    low, high = F.lit(lo).cast("date"), F.lit(hi).cast("date")
    rows = df.filter(F.col(date).between(low, high))
    out = rows.groupBy(series).agg(F.count_if(F.col(value) != 0).alias("nonzero_days"), F.sum(value).alias("total"), F.min(F.when(F.col(value) != 0, F.col(date))).alias("first_sale"))
    days = F.date_diff(high, low) + 1
    since = F.date_diff(high, F.col("first_sale")) + 1
    out = out.withColumns({"nonzero_share": F.col("nonzero_days") / days, "share_since_first": F.least(F.try_divide("nonzero_days", since), F.lit(1.0))})
    whole = out.agg(F.sum("total").alias("__whole"))
    out = out.crossJoin(F.broadcast(whole)).withColumn("pct", F.try_divide(F.col("total") * 100, F.col("__whole"))).drop("__whole")  # whole: one row
    return with_running(out, [-F.col("total"), F.col(series)], "rank", {"running_pct": "pct"})


def coverage(proportion: DataFrame, ns: list[int], pcts: list[float]) -> DataFrame:
    """Share of sales in the first n series, and how many series reach p %."""
    tops = [F.max(F.when(F.col("rank") <= n, F.col("running_pct"))).alias(f"top_{n}_pct") for n in ns]
    need = [F.min(F.when(F.col("running_pct") >= p, F.col("rank"))).alias(f"series_for_{p:g}_pct") for p in pcts]
    return proportion.agg(*tops, *need)


def compare_periods(df: DataFrame, date: str, columns: list[str], first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Sums of columns in two half-open periods, a row per column."""
    inside = lambda p: (F.col(date) >= F.lit(p[0]).cast("date")) & (F.col(date) < F.lit(p[1]).cast("date"))
    rows = df.withColumn("period", F.when(inside(first), "period_1").when(inside(second), "period_2")).filter("period IS NOT NULL")
    sums = rows.groupBy("period").agg(*[F.sum(c).cast("double").alias(c) for c in columns])
    return sums.unpivot("period", columns, "column_name", "total").groupBy("column_name").pivot("period", ["period_1", "period_2"]).sum("total")


def month_highlights(df: DataFrame, date: str, months: list[int], columns: list[str]) -> DataFrame:
    return df.filter(F.month(date).isin(months)).groupBy(F.year(date).alias("year")).agg(*[F.sum(c).alias(c) for c in columns])


def monthly_cv(df: DataFrame, month: str, value: str) -> DataFrame:
    out = df.groupBy(month).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return out.withColumn("cv", F.try_divide("std", "mean"))


def forecast_health(df: DataFrame, series: str, date: str, value: str) -> DataFrame:
    """One row: spread and peak of the daily totals, the grand total, and how many series are zero throughout."""
    daily = df.groupBy(date).agg(F.sum(value).alias("total"))
    zero = df.groupBy(series).agg(F.max(F.abs(value)).alias("m")).agg(F.count_if(F.col("m") == 0).alias("zero_series"))
    shape = daily.agg(F.min("total").alias("min_day"), F.avg("total").alias("mean_day"), F.max("total").alias("max_day"), F.max_by(date, F.struct("total", date)).alias("peak_day"), F.sum("total").alias("grand_total"))
    return shape.crossJoin(zero)


def flatness(df: DataFrame, series: str, value: str) -> DataFrame:
    per = df.groupBy(series).agg(F.stddev_samp(value).alias("std"), F.max(value).alias("peak"), F.avg(value).alias("mean"))
    rows = staged(per.select("std", F.try_divide("peak", "mean").alias("peak_to_mean")), "per-series")
    flat = rows.agg((F.count_if(F.coalesce(F.col("std"), F.lit(0.0)) < 1e-6) / F.count("*")).alias("flat_share"))
    return flat.join(exact_quantiles(rows, [], {"median_peak_to_mean": ("peak_to_mean", 0.5)}), F.lit(True), "left")  # a row each


def seasonality_check(df: DataFrame, date: str, value: str, window: tuple[str, str]) -> DataFrame:
    """A window of days and the same a year before: totals, peaks, means, peak positions and growth, one row."""
    lo, hi = (F.lit(x).cast("date") for x in window)
    daily = df.groupBy(date).agg(F.sum(value).alias("total"))
    this = daily.filter(F.col(date).between(lo, hi)).withColumn("place", F.date_diff(date, lo)).select("place", F.col("total").alias("now"))
    past = daily.filter(F.col(date).between(F.add_months(lo, -12), F.add_months(hi, -12))).withColumn("place", F.date_diff(date, F.add_months(lo, -12))).select("place", F.col("total").alias("before"))
    both = this.join(past, "place", "full")
    out = both.agg(*[f(c).alias(f"{n}_{c}") for c in ("now", "before") for n, f in (("total", F.sum), ("peak", F.max), ("mean", F.avg))], F.max_by("place", F.struct("now", "place")).alias("peak_at_now"), F.max_by("place", F.struct("before", "place")).alias("peak_at_before"))
    return out.withColumn("yoy_pct", F.try_divide((F.col("total_now") - F.col("total_before")) * 100, F.col("total_before")))


def sparsity(df: DataFrame, series: str, value: str) -> DataFrame:
    per = df.groupBy(series).agg((F.count_if(F.col(value) == 0) / F.count("*")).alias("zero_share"), F.avg(value).alias("mean"), F.max(value).alias("peak"))
    rows = per.select("zero_share", "mean", F.try_divide("peak", "mean").alias("peak_to_mean"))
    wanted = {"median_zero_share": ("zero_share", 0.5), "p90_zero_share": ("zero_share", 0.9), "median_mean": ("mean", 0.5), "median_peak_to_mean": ("peak_to_mean", 0.5)}
    return exact_quantiles(rows, [], wanted)


def level_check(history: DataFrame, forecast: DataFrame, actual: DataFrame, date: str, value: str, long: int = 365, short: int = 90) -> DataFrame:
    """Daily means of the last `long` and `short` days of history against those predicted and sold."""
    daily = history.groupBy(date).agg(F.sum(value).alias("total"))
    last = daily.agg(F.max(date).alias("__last"))
    ago = F.date_diff("__last", date)
    past = daily.crossJoin(F.broadcast(last)).agg(F.avg(F.when(ago < long, F.col("total"))).alias("mean_long"), F.avg(F.when(ago < short, F.col("total"))).alias("mean_short"))
    mean = lambda df, name: df.groupBy(date).agg(F.sum(value).alias("t")).agg(F.avg("t").alias(name))
    out = past.crossJoin(mean(forecast, "predicted")).crossJoin(mean(actual, "sold"))
    return out.withColumns({"predicted_to_long": F.try_divide("predicted", "mean_long"), "predicted_to_short": F.try_divide("predicted", "mean_short"), "predicted_to_sold": F.try_divide("predicted", "sold")})


def mom_yoy(df: DataFrame, date: str, value: str) -> DataFrame:
    """Month totals with change on the month before and on the same month a year before, in percent."""
    months = df.groupBy(F.trunc(date, "MM").alias("month_of_sale")).agg(F.sum(value).alias("total"))
    change = lambda n: months.select(F.add_months("month_of_sale", n).alias("month_of_sale"), F.col("total").alias(f"before_{n}"))
    out = months.join(change(1), "month_of_sale", "left").join(change(12), "month_of_sale", "left")
    pct = lambda n: F.try_divide((F.col("total") - F.col(f"before_{n}")) * 100, F.col(f"before_{n}"))
    return out.select("month_of_sale", "total", pct(1).alias("mom_pct"), pct(12).alias("yoy_pct"))


def deviation_pct(df: DataFrame, value: str, reference: str, out: str = "deviation_pct") -> DataFrame:
    return df.withColumn(out, F.try_divide((F.col(value) - F.col(reference)) * 100, F.col(reference)))


def importance_summary(wide: DataFrame, features: list[str]) -> DataFrame:
    """Mean importance of each feature of a wide table."""
    return wide.select([F.col(f"`{c}`").cast("double").alias(c) for c in features]).unpivot([], features, "feature", "importance").groupBy("feature").agg(F.avg("importance").alias("importance"))


def importance_shift(one: DataFrame, two: DataFrame) -> DataFrame:
    a, b = one.withColumnRenamed("importance", "importance_1"), two.withColumnRenamed("importance", "importance_2")
    both = a.join(b, "feature", "full").fillna(0.0, ["importance_1", "importance_2"])
    return both.withColumn("shift", F.col("importance_2") - F.col("importance_1"))


def series_counts(df: DataFrame, series: str) -> DataFrame:
    per = df.groupBy(series).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_series"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"), F.sum("n").alias("n_rows"))
