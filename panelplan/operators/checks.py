"""Validations: each returns the rows that violate it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def check_grain(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of keys that occur more than once."""
    return df.withColumn("n_rows", F.count("*").over(Window.partitionBy(*keys))).filter("n_rows > 1")


def check_columns(spark: SparkSession, df: DataFrame, required: list[str]) -> DataFrame:
    return spark.createDataFrame([(c,) for c in required if c not in df.columns], "missing string")


def check_contiguous(df: DataFrame, series: str, index: str) -> DataFrame:
    """Rows whose index is not one more than the row before of their series."""
    before = F.lag(index).over(Window.partitionBy(series).orderBy(index))
    return df.withColumn("before", before).filter(F.col("before").isNotNull() & (F.col(index) - F.col("before") != 1))


def check_index_ranges(df: DataFrame, expected: DataFrame, series: str, year: str, index: str) -> DataFrame:
    """Series and years whose index range or row count differ from `expected` (year, lo, hi, n)."""
    found = df.groupBy(series, year).agg(F.min(index).alias("lo_found"), F.max(index).alias("hi_found"), F.count("*").alias("n_found"))
    wrong = (F.col("lo_found") != F.col("lo")) | (F.col("hi_found") != F.col("hi")) | (F.col("n_found") != F.col("n"))
    return found.join(F.broadcast(expected), year, "left").filter(F.coalesce(wrong, F.lit(True)))


def check_date_coverage(df: DataFrame, series: str, date: str, begin: str = "09-01", end: str = "12-31") -> DataFrame:
    """Series and years that do not hold every day of a season."""
    year = F.year(date)
    found = df.groupBy(series, year.alias("year")).agg(F.min(date).alias("first"), F.max(date).alias("last"), F.count_distinct(date).alias("n_days"))
    lo, hi = (F.to_date(F.concat(F.col("year").cast("string"), F.lit(f"-{x}"))) for x in (begin, end))
    return found.filter((F.col("first") != lo) | (F.col("last") != hi) | (F.col("n_days") != F.date_diff(hi, lo) + 1))


def check_static(df: DataFrame, series: str, columns: list[str]) -> DataFrame:
    """Series whose static attributes change or are null; null counts as a value."""
    out = df.groupBy(series).agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0null"))).alias(f"n_{c}") for c in columns], *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])
    return out.filter(reduce(lambda a, b: a | b, [(F.col(f"n_{c}") > 1) | (F.col(f"null_{c}") > 0) for c in columns]))


def check_covariates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, problem, n): covariates that are not numeric or hold nulls."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    numeric = ("int", "bigint", "smallint", "tinyint", "float", "double", "decimal")
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).unpivot([], columns, "column_name", "n")
    bad = [c for c in columns if not kinds[c].startswith(numeric)]
    problem = F.when(F.col("column_name").isin(bad), "not numeric").when(F.col("n") > 0, "null")
    return counts.withColumn("problem", problem).filter("problem IS NOT NULL")


def check_targets(df: DataFrame, series: str, date: str, value: str, last_history: str) -> DataFrame:
    """Series with missing or negative targets in history, or with targets after it."""
    past = F.col(date) <= F.lit(last_history).cast("date")
    v = F.col(value)
    out = df.groupBy(series).agg(F.count_if(past & v.isNull()).alias("missing"), F.count_if(past & (v < 0)).alias("negative"), F.count_if(~past & v.isNotNull()).alias("future"))
    return out.filter("missing + negative + future > 0")


def check_horizon(calendar: DataFrame, date: str, end: str) -> DataFrame:
    return calendar.agg(F.max(date).alias("last")).filter(F.coalesce(F.col("last") < F.lit(end).cast("date"), F.lit(True)))


def check_length(df: DataFrame, series: str, icl: int, ocl: int) -> DataFrame:
    return df.groupBy(series).agg(F.count("*").alias("n")).filter(F.col("n") < icl + ocl)


def audit_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, columns and duplicate keys, as rows of an audit table."""
    rows = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") > 1).alias("duplicate_keys"))
    return rows.withColumn("columns", F.lit(len(df.columns)).cast("bigint")).unpivot([], ["rows", "columns", "duplicate_keys"], "check_name", "value")


def strict_report(df: DataFrame, series: str, index: str, date: str, value: str, last_history: str, static: list[str], covariates: list[str], min_rows: int, examples: int = 5) -> DataFrame:
    """(check_name, violations, first_example, examples): the strict checks of a panel as counts, in one scan and one shuffle by series.

    V1 keys (series, index) that occur more than once; V3 rows whose index is not one more than the one before;
    V6 series whose static columns change or are null; V7 null or non-numeric covariates, a row for each; V8
    series with missing or negative targets in history, or targets after it; V10 series of fewer than min_rows
    rows. examples: up to so many series that violate the check, the least of each share of series by hash, so
    that what is kept does not grow; for V7 there are none. A null series counts as one; equal indices of a series
    follow one another only once."""
    past, v = F.col(date) <= F.lit(last_history).cast("date"), F.col(value)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0null"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    numeric = ("int", "bigint", "smallint", "tinyint", "float", "double", "decimal")
    wanted = dict.fromkeys([series, index, date, value, *static, *covariates])
    keyed = df.select(*wanted).repartition(series).groupBy(series, index).agg(
        F.count("*").alias("__n"), F.count_if(past & v.isNull()).alias("__missing"), F.count_if(past & (v < 0)).alias("__negative"), F.count_if(~past & v.isNotNull()).alias("__future"),
        *[f(text(c)).alias(f"__{n}_{c}") for c in static for n, f in (("lo", F.min), ("hi", F.max))], *[F.count_if(F.col(c).isNull()).alias(f"__null_{c}") for c in dict.fromkeys([*static, *covariates])],
    )
    before = F.lag(index).over(Window.partitionBy(series).orderBy(index))
    changed = reduce(lambda a, b: a | b, [(F.min(f"__lo_{c}") != F.max(f"__hi_{c}")) | (F.sum(f"__null_{c}") > 0) for c in static], F.lit(False))
    per = keyed.withColumn("__before", before).groupBy(series).agg(
        F.count_if(F.col("__n") > 1).alias("V1 grain"), F.count_if(F.col("__before").isNotNull() & (F.col(index) - F.col("__before") != 1)).alias("V3 contiguous"), changed.cast("long").alias("V6 static"),
        (F.sum("__missing") + F.sum("__negative") + F.sum("__future") > 0).cast("long").alias("V8 targets"), (F.sum("__n") < min_rows).cast("long").alias("V10 length"),
        *[(F.sum(F.col("__n") if not kinds[c].startswith(numeric) else F.col(f"__null_{c}"))).alias(f"V7 covariate {c}") for c in covariates],
    )
    names = [c for c in per.columns if c != series]
    name, share = F.col(series).cast("string"), F.pmod(F.xxhash64(series), F.lit(examples))
    some = lambda c: F.array_compact(F.array(*[F.min(F.when((F.col(c) > 0) & (share == k), name)) for k in range(examples)]))
    empty = F.array().cast("array<string>")
    total = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{k}") for k, c in enumerate(names)], *[(empty if c.startswith("V7") else F.sort_array(some(c))).alias(f"e_{k}") for k, c in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(f"n_{k}").alias("violations"), F.get(F.col(f"e_{k}"), 0).alias("first_example"), F.col(f"e_{k}").alias("examples")) for k, c in enumerate(names)])
    return total.select(F.explode(rows).alias("r")).select("r.*")


def require_clean(report: DataFrame) -> None:
    """Raise if a strict check of a report has found anything; a row for each check is looked at."""
    if found := [f"{r['check_name']}: {r['violations']} (such as {', '.join(r['examples']) or 'no series named'})" for r in report.collect() if r["violations"]]:
        raise ValueError("; ".join(found))


def require_empty(violations: DataFrame, name: str) -> None:
    """Raise if a strict check has found anything."""
    if found := violations.limit(5).collect():
        raise ValueError(f"{name}: {found}")
