"""Column expressions and small row-wise transforms."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of the week, Monday first.
WEEKDAYS = ["MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY"]


def filter_retail(df: DataFrame, types: list[str], models: list[str] | None = None) -> DataFrame:
    out = df.filter(F.col("x_customer_type").isin(types))
    return out.filter(F.col("model").isin(models)) if models is not None else out


def between_dates(df: DataFrame, column: str, lo: str, hi: str, closed: bool = False) -> DataFrame:
    """lo <= column < hi; with closed, hi belongs to it."""
    c, low, high = F.col(column), F.lit(lo).cast("date"), F.lit(hi).cast("date")
    return df.filter((c >= low) & (c <= high if closed else c < high))


def keep_series(df: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    return df.join(valid.select(key), key, "left_semi")


def drop_series(df: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    return df.join(valid.select(key), key, "left_anti")


def normalize_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Names without quotes, in lower case, blanks and hyphens as underscores; `keep` lists names (unquoted) to leave."""
    plain = [c.strip('"') for c in df.columns]
    return df.toDF(*[c if c in keep else c.strip().lower().replace(" ", "_").replace("-", "_") for c in plain])


def is_active(column: str = "skustatus") -> Column:
    return F.lower(F.trim(column)) == "active"


def active_skus(df: DataFrame) -> DataFrame:
    return df.filter(is_active())


def net_sales(clip: bool = False) -> Column:
    """Invoiced, cancelled and returned sales, already signed; with clip, a row never counts below zero."""
    total = F.col("invoiced_sales") + F.col("cancelled_sales") + F.col("returned_sales")
    return F.greatest(total, F.lit(0)) if clip else total


def drop_features(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def total_of(columns: list[str]) -> Column:
    """Sum of columns, nulls as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in columns])


def fill_nulls(df: DataFrame, spec: dict) -> DataFrame:
    return df.fillna(spec)


def fiscal_year(date: Column, lo: int | None = None, hi: int | None = None) -> Column:
    """FY'NN of a year that runs from April and is named by its end; `Unknown` outside lo..hi (years)."""
    ends = F.year(F.add_months(date, 9))
    label = F.concat(F.lit("FY'"), F.lpad((ends % 100).cast("string"), 2, "0"))
    if lo is None or hi is None:
        return label
    return F.when(ends.between(lo, hi), label).otherwise("Unknown")


def override_months(df: DataFrame, corrections: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Values of a correction table over those of df, where it has any."""
    new = corrections.select(*keys, *[F.col(c).alias(f"{c}__new") for c in columns])
    out = df.join(new, keys, "left").withColumns({c: F.coalesce(f"{c}__new", c) for c in columns})
    return out.drop(*[f"{c}__new" for c in columns])


def swap_covariates(df: DataFrame, pairs: DataFrame, columns: list[str], series: str, month: str) -> DataFrame:
    """In target months, covariates of the source month of the same series (pairs: target, source); their own where it is missing."""
    other = df.select(F.col(series), F.col(month).alias("source"), *[F.col(c).alias(f"{c}__src") for c in columns])
    out = df.join(F.broadcast(pairs.withColumnRenamed("target", month)), month, "left").join(other, [series, "source"], "left")
    return out.withColumns({c: F.coalesce(f"{c}__src", c) for c in columns}).drop("source", *[f"{c}__src" for c in columns])


def extend_calendar(calendar: DataFrame, date: str, end: str, fill: float = 0) -> DataFrame:
    """The calendar up to `end`, its other columns `fill` on the new dates."""
    last = calendar.agg(F.max(date).alias("last"))
    days = last.filter(F.col("last") < F.lit(end).cast("date")).select(F.explode(F.sequence(F.date_add("last", 1), F.lit(end).cast("date"))).alias(date))
    new = days.select(*[F.col(date) if f.name == date else F.lit(fill).cast(f.dataType).alias(f.name) for f in calendar.schema.fields])
    return calendar.unionByName(new)


def to_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def flag_at_least(column: Column, threshold: float) -> Column:
    return F.coalesce(column >= threshold, F.lit(False))


def parse_series_key(df: DataFrame, key: str) -> DataFrame:
    """parent_dealer_code, model_family and model_family_code (all behind the first <>) of a `<>` key."""
    c = F.col(key)
    return df.withColumns({
        "parent_dealer_code": F.trim(F.split_part(c, F.lit("<>"), F.lit(1))),
        "model_family": F.trim(F.split_part(c, F.lit("<>"), F.lit(2))),
        "model_family_code": F.trim(F.regexp_replace(c, "^[^<>]+<>", "")),
    })


def key_part(key: Column, place: int) -> Column:
    """Part of a `<>` key, from 0; null beyond its last."""
    return F.get(F.split(key, "<>"), F.lit(place))


def strip_quotes(text: Column) -> Column:
    return F.trim(F.btrim(F.trim(text), F.lit('"')))


def month_of_label(label: Column) -> Column:
    """First day of a month written as `August - 2026`; null for other texts."""
    return F.try_to_date(label, "MMMM - yyyy")


def day_of(year: Column, month: Column, day: Column) -> Column:
    return F.make_date(year, month, day)


def festive_flag(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(f"`{c}`"), F.lit(0)) != 0 for c in columns])


def festive_weight(columns: list[str], plain: float = 1, festive: float = 5) -> Column:
    return F.when(festive_flag(columns), F.lit(festive)).otherwise(F.lit(plain))


def stock_date(month: Column, season: str) -> Column:
    """The day whose stock a planning month starts from: end, first or mid."""
    if season == "end":
        return F.last_day(F.add_months(month, -1))
    if season == "first":
        return F.last_day(F.add_months(month, -2))
    if season == "mid":
        return F.date_add(F.add_months(month, -1), 14)
    raise ValueError(season)


def month_gap(earlier: Column, later: Column) -> Column:
    """Whole months between month starts."""
    return F.months_between(F.trunc(later, "MM"), F.trunc(earlier, "MM")).cast("int")


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def encode_year(date: Column) -> Column:
    return (F.year(date) - 2000) / F.lit(50.0)


def weekday_number(text: Column) -> Column:
    """0 for Monday; from a name, its first three letters, or a number as text; null for others."""
    name = F.upper(F.trim(text))
    pairs = [x for k, d in enumerate(WEEKDAYS) for n in (d, d[:3]) for x in (F.lit(n), F.lit(k))]
    return F.coalesce(F.element_at(F.create_map(*pairs), name), name.try_cast("int"))


def path_safe(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("<>"), F.lit("_")), "[^A-Za-z0-9_.]+", "_")
