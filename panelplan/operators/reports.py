"""Monthly and wide reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_blend_summary(df: DataFrame, flag: str, value: str) -> DataFrame:
    return df.groupBy(flag).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def to_monthly(df: DataFrame, series: str, date: str, value: str) -> DataFrame:
    return df.groupBy(series, F.trunc(date, "MM").alias("month_of_sale")).agg(F.sum(value).alias(value))


def month_totals(monthly: DataFrame, value: str) -> DataFrame:
    return monthly.groupBy("month_of_sale").agg(F.sum(value).alias("grand_total"), F.count("*").alias("n_series"))


def wide_report(df: DataFrame, index: str, column: str, value: str, values: list[str]) -> DataFrame:
    """index x column with a row total; the columns are given, so no job looks for them."""
    wide = df.groupBy(index).pivot(column, values).agg(F.sum(value)).fillna(0, values)
    return wide.withColumn("total", reduce(lambda a, b: a + b, [F.col(f"`{v}`") for v in values]))


def by_month_name(df: DataFrame, date: str, value: str) -> DataFrame:
    return df.groupBy(F.date_format(date, "MMMM").alias("month_name")).agg(F.sum(value).alias("total"))


def sales_by_fiscal_year(df: DataFrame, year, value: str) -> DataFrame:
    return df.groupBy(year.alias("fiscal_year")).agg(F.sum(value).alias("total"))
