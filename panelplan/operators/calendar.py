"""Festival calendars: nearest anchors, run-up features, month flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_anchor(dates: DataFrame, anchors: DataFrame, date: str = "cal_date", anchor: str = "anchor") -> DataFrame:
    """Each date with its nearest anchor and the signed offset in days; the earlier anchor on a tie.

    Only the distinct dates meet the anchors (a row per year), so the pairs stay few."""
    days = dates.select(date).distinct()
    far = F.abs(F.date_diff(date, anchor))
    best = days.crossJoin(F.broadcast(anchors.select(anchor).distinct())).groupBy(date).agg(F.min_by(anchor, F.struct(far, F.col(anchor))).alias("nearest"))
    return dates.join(F.broadcast(best), date).withColumn("offset_days", F.date_diff(date, "nearest"))


def _ramp(offset: Column, before: int, span: int) -> Column:
    """From 1/span on the first day of a run-up to 1 on its last; 0 outside."""
    up = (offset + before) / F.lit(float(span))
    return F.when(offset.between(1 - before, span - before), up).otherwise(F.lit(0.0))


def diwali_features(dates: DataFrame, anchors: DataFrame, date: str = "cal_date", clip: int = 45) -> DataFrame:
    """Clipped offset to the festival, the run-up ramp (d + 14) / 13, flags of its day and of D-3 to D+6."""
    out = nearest_anchor(dates, anchors, date)
    d = F.col("offset_days")
    return out.withColumns({
        "diwali_offset": F.greatest(F.least(d, F.lit(clip)), F.lit(-clip)), "diwali_ramp": _ramp(d, 14, 13),
        "is_diwali": (d == 0).cast("int"), "diwali_window": d.between(-3, 6).cast("int"),
    })


def flag_anchors(df: DataFrame, flag: str, date: str = "cal_date") -> DataFrame:
    """Anchors from a flag column: the distinct dates where it is 1."""
    return df.filter(F.col(f"`{flag}`") == 1).select(F.col(date).alias("anchor")).distinct()


def pitra_features(dates: DataFrame, anchors: DataFrame, date: str = "cal_date", clip: int = 45) -> DataFrame:
    """Clipped offset to the period's last day, flag of the 16 days up to it, the ramp (d + 16) / 15, and its last day."""
    out = nearest_anchor(dates, anchors, date)
    d = F.col("offset_days")
    return out.withColumns({
        "pitra_offset": F.greatest(F.least(d, F.lit(clip)), F.lit(-clip)), "in_pitra": d.between(-15, 0).cast("int"),
        "pitra_ramp": _ramp(d, 16, 15), "is_amavasya": (d == 0).cast("int"),
    })


def month_offset_flags(anchors: DataFrame, lo: int = -30, hi: int = 7, anchor: str = "anchor") -> DataFrame:
    """(month, offset, flag 1): which days around an anchor fall into which month; wide tables are pivots of it."""
    days = anchors.select(F.col(anchor), F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("day_offset"))
    return days.select(F.trunc(F.expr(f"date_add({anchor}, day_offset)"), "MM").alias("month_of_sale"), "day_offset").distinct().withColumn("flag", F.lit(1))


def with_calendar(panel: DataFrame, *calendars: DataFrame, on: str = "month_of_sale") -> DataFrame:
    """Calendar tables (a row per month or day) joined to a panel."""
    for c in calendars:
        panel = panel.join(F.broadcast(c), on, "left")
    return panel


def lag_date_map(calendar: DataFrame, flags: list[str], date: str = "cal_date") -> DataFrame:
    """(lag_day, date): on which dates each lag-day flag is set."""
    long = calendar.select(date, *[F.col(f"`{c}`").cast("int").alias(c) for c in flags]).unpivot(date, [f"`{c}`" for c in flags], "lag_day", "flag")
    return long.filter("flag <> 0").select(F.regexp_replace("lag_day", "`", "").alias("lag_day"), date).distinct()


def lag_map_problems(lag_map: DataFrame, flags: DataFrame, date: str = "cal_date") -> DataFrame:
    """Lag days (lag_day of `flags`) without a date or with several, and dates with several lag days."""
    per = flags.select("lag_day").distinct().join(lag_map, "lag_day", "left").groupBy("lag_day").agg(F.count(date).alias("n"))
    lags = per.filter("n <> 1").select(F.when(F.col("n") == 0, "no date").otherwise("several dates").alias("problem"), F.col("lag_day").alias("key"), "n")
    dates = lag_map.groupBy(date).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("several lag days").alias("problem"), F.col(date).cast("string").alias("key"), "n")
    return lags.unionByName(dates)
