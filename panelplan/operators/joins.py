"""Key comparisons between inputs, and joins by key in place of position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_actuals(forecast: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    return forecast.join(actual, keys)


def orphans(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a without a partner in b."""
    return a.join(b.select(*keys), keys, "left_anti")


def key_coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys only in a, only in b, in both, and whether a's are a subset of b's."""
    one, two = a.select(key).distinct().withColumn("in_a", F.lit(1)), b.select(key).distinct().withColumn("in_b", F.lit(1))
    out = one.join(two, key, "full").agg(
        F.count_if(F.col("in_b").isNull()).alias("a_only"), F.count_if(F.col("in_a").isNull()).alias("b_only"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("both")
    )
    return out.withColumn("a_subset_of_b", F.col("a_only") == 0)


def key_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).subtract(b.select(key))


def common_series(key: str, *frames: DataFrame) -> DataFrame:
    """Keys that all inputs have."""
    return reduce(lambda a, b: a.intersect(b), [f.select(key) for f in frames])


def concat(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def one_per_date(df: DataFrame, date: str, columns: list[str]) -> DataFrame:
    return df.groupBy(date).agg(*[F.max(c).alias(c) for c in columns])


def index_to_date(df: DataFrame, reference: DataFrame, index: str, date: str) -> DataFrame:
    """Dates of index values, by the distinct pairs of a reference."""
    return df.join(reference.select(index, date).distinct(), index, "left")


def sorted_output(df: DataFrame, *order: Column | str) -> DataFrame:
    """All rows in order, for delivery: a range shuffle, each partition sorted."""
    return df.orderBy(*order)


def top_n(df: DataFrame, column: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(column).desc(), tie).limit(n)
