"""Exact quantiles of groups of any size: ranks are looked for in ranges of values, never in a buffer of all of them.

For each wanted rank the values of its group are counted in RANGES equal ranges between their bounds; the range
that holds the rank gives the next bounds (its own least and greatest value), until these are one value. A round is a
grouped count with partial sums; it reads only values between the bounds, which grow fewer by the number of ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelplan.sources.scratch import discard, staged

RANGES = 2048


def exact_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], ranges: int = RANGES) -> DataFrame:
    """(keys, name...): for each name the quantile q of a column, between two values by their distance, as percentile() does.

    wanted: name -> (column, q). Nulls and NaN are left out; a column without values in a group has null, a group
    without any value has no row. Null keys are a group of their own; keys are compared as text."""
    columns = sorted({c for c, _ in wanted.values()})
    values = df.select(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(c).cast("double").alias(c) for c in columns])
    names = [f"__k{i}" for i in range(len(keys))] or ["__k"]
    values = values if keys else values.withColumn("__k", F.lit(""))
    long = staged(values.unpivot(names, columns, "__c", "__v").filter("__v IS NOT NULL AND NOT isnan(__v)"), "quantile-values")
    group = [*names, "__c"]
    bounds = long.groupBy(*group).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    quantiles = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(c).alias("c"), F.lit(float(q)).alias("q")) for name, (c, q) in wanted.items()])
    asked = bounds.withColumn("w", F.explode(F.filter(quantiles, lambda w: w["c"] == F.col("__c")))).withColumn("at", F.col("w.q") * (F.col("n") - 1))
    asked = staged(asked.select(*group, F.col("w.name").alias("name"), "at", "lo", "hi"), "quantile-ranks")
    ranks = asked.select(*group, F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank"), F.lit(0).cast("long").alias("below"), "lo", "hi").distinct()
    ranks = staged(ranks, "quantile-bounds")
    order = Window.partitionBy(*group, "rank").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    while ranks.filter("lo < hi").limit(1).count():
        open_ = ranks.filter("lo < hi")
        place = F.least(F.floor((F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * ranges), F.lit(ranges - 1))
        inside = long.join(open_, group).filter(F.col("__v").between(F.col("lo"), F.col("hi"))).withColumn("__range", place)
        counts = inside.groupBy(*group, "rank", "below", "__range").agg(F.count("*").alias("here"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        counts = counts.withColumn("below", F.col("below") + F.coalesce(F.sum("here").over(order), F.lit(0)))  # `ranges` rows at most
        found = counts.filter((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("here"))).select(*group, "rank", "below", "lo", "hi")
        before, ranks = ranks, staged(ranks.filter("lo = hi").unionByName(found), "quantile-bounds")
        discard(before)
    discard(long)
    value = ranks.select(*group, "rank", F.col("lo").alias("v"))
    low = value.withColumnsRenamed({"rank": "__low", "v": "v0"})
    high = value.withColumnsRenamed({"rank": "__high", "v": "v1"})
    out = asked.withColumns({"__low": F.floor("at"), "__high": F.ceil("at")}).join(low, [*group, "__low"]).join(high, [*group, "__high"])
    between = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("at") - F.col("__low"))
    by_name = out.groupBy(*names).agg(*[F.max(F.when(F.col("name") == n, between)).alias(n) for n in wanted])
    if not keys:
        return by_name.select(*wanted)
    kinds = df.select(*keys).schema
    return by_name.select(*[F.when(F.col(f"__k{i}") != "\0", F.col(f"__k{i}")).cast(kinds[k].dataType).alias(k) for i, k in enumerate(keys)], *wanted)
