"""Month spine, gap filling, splits, scaling, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelplan.operators.ranking import with_running


def month_spine(df: DataFrame, date: str, name: str = "month_of_sale") -> DataFrame:
    """All months from the first to the last date of df; one row of bounds, exploded."""
    bounds = df.agg(F.trunc(F.min(date), "MM").alias("lo"), F.trunc(F.max(date), "MM").alias("hi")).filter("lo is not null")
    return bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias(name))


def panel_grid(series: DataFrame, spine: DataFrame) -> DataFrame:
    """Every series in every month; the spine (a row per month) is broadcast."""
    return series.crossJoin(F.broadcast(spine))


def fill_gaps(monthly: DataFrame, keys: list[str], date: str = "month_of_sale", value: str = "net_sales") -> DataFrame:
    """The monthly panel without gaps: months that a series lacks have sales 0."""
    grid = panel_grid(monthly.select(*keys).distinct(), month_spine(monthly, date, date))
    return grid.join(monthly.select(*keys, date, value), [*keys, date], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def split_panel(df: DataFrame, date: str, train_end: str, valid_end: str) -> DataFrame:
    c = F.col(date)
    return df.withColumn("split", F.when(c <= F.lit(train_end).cast("date"), "train").when(c <= F.lit(valid_end).cast("date"), "valid").otherwise("test"))


def holdout_last(df: DataFrame, series: str, date: str, n: int) -> DataFrame:
    """Add `held_out`: whether a row is among the last n of its series."""
    return df.withColumn("held_out", F.row_number().over(Window.partitionBy(series).orderBy(F.col(date).desc())) <= n)


def last_k(df: DataFrame, series: str, date: str, k: int) -> DataFrame:
    return holdout_last(df, series, date, k).filter("held_out").drop("held_out")


def warmup_strip(df: DataFrame, series: str, date: str, train_end: str, icl: int, ocl: int) -> DataFrame:
    """Series long enough for a sample, with `has_val` (whether icl + ocl rows can end in validation) and
    `in_val`: validation rows and, before them, the rows that the first of its samples needs."""
    end = F.lit(train_end).cast("date")
    w = Window.partitionBy(series)
    n_val = F.count_if(F.col(date) > end).over(w)
    place = F.row_number().over(w.orderBy(date))
    total = F.count("*").over(w)
    out = df.withColumns({"n_rows": total, "n_val": n_val, "place": place}).filter(F.col("n_rows") >= icl + ocl)
    begin = F.greatest(F.col("n_rows") - F.greatest(F.col("n_val"), F.lit(icl + ocl)), F.lit(0))
    out = out.withColumn("has_val", (F.col("n_val") > 0) & (F.col("n_rows") >= icl + ocl))
    return out.withColumn("in_val", F.col("has_val") & (F.col("place") > begin)).drop("place")


def fit_scaler(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Minimum and maximum by series (or of all rows, by=[]), as a table."""
    return df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def scale(df: DataFrame, scaler: DataFrame, by: list[str], value: str, out: str = "scaled") -> DataFrame:
    """(value - lo) / (hi - lo); 0 for a constant series."""
    joined = df.join(scaler, by) if by else df.crossJoin(F.broadcast(scaler))
    return joined.withColumn(out, F.coalesce(F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)))


def unscale(value: str = "scaled"):
    return F.col(value) * (F.col("hi") - F.col("lo")) + F.col("lo")


def ordinal_encode(df: DataFrame, column: str, known: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """Rank of the value among the sorted distinct values of `known` (df itself if not given), from 0; -1 for others."""
    values = (known if known is not None else df).select(column).filter(F.col(column).isNotNull()).distinct()
    codes = with_running(values, [F.col(column)], "__place").select(column, (F.col("__place") - 1).alias("__code"))  # ranked over ranges
    return df.join(codes, column, "left").withColumn(out or f"{column}_code", F.coalesce("__code", F.lit(-1))).drop("__code")


def first_attributes(df: DataFrame, series: str, date: str, columns: list[str]) -> DataFrame:
    return df.groupBy(series).agg(*[F.min_by(c, date).alias(c) for c in columns])


def extract_calendar(df: DataFrame, date: str, columns: list[str]) -> DataFrame:
    """One row per date out of a panel: the maximum of each flag."""
    return df.groupBy(date).agg(*[F.max(c).alias(c) for c in columns])


def last_year_value(df: DataFrame, series: list[str], month: str, value: str, out: str) -> DataFrame:
    """The value of the same month a year before, by date, not by counting rows."""
    before = df.select(*series, F.add_months(month, 12).alias(month), F.col(value).alias(out))
    return df.join(before, [*series, month], "left")


def pct_change(df: DataFrame, series: list[str], order: str, value: str, lag: int, out: str) -> DataFrame:
    before = F.lag(value, lag).over(Window.partitionBy(*series).orderBy(order))
    return df.withColumn(out, F.try_divide(F.col(value) - before, before) * 100)
