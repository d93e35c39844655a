"""Ranks and running totals over all rows, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelplan.sources.scratch import staged

#: Rows looked at for each part when its bounds are chosen; parts are as many as the shuffle has, MAX_PARTS at most.
SAMPLE = 50
MAX_PARTS = 200


def with_running(df: DataFrame, order: list[Column], rank: str | None = None, sums: dict[str, str] | None = None, fixed: bool = False) -> DataFrame:
    """Add the place of each row in the order (from 1) and running sums of columns (new name -> column).

    order: ascending expressions (negate numbers for the largest first) that tell all rows apart, without
    nulls. Rows are dealt into ranges of the order by bounds from a small sample; ranks and sums run inside
    each range, and what all ranges before it hold (a row per range) is added. fixed: df is a written table already."""
    sums = sums or {}
    rows = df if fixed else staged(df, "ranked")  # looked at three times
    parts = min(MAX_PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [x.alias(f"k{i}") for i, x in enumerate(order)]
    seen = sorted(tuple(r) for r in rows.select(*keys).orderBy(F.xxhash64(*order)).limit(SAMPLE * parts).collect())  # SAMPLE x parts rows
    bounds = [seen[len(seen) * k // parts] for k in range(1, parts)] if len(seen) >= parts else []
    here = F.struct(*keys)
    place = F.size(F.filter(F.array(*[F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(b)]) for b in bounds]), lambda b: b <= here)) if bounds else F.lit(0)
    keyed = rows.withColumn("__part", place)
    totals = keyed.groupBy("__part").agg(F.count("*").alias("__rows"), *[F.sum(c).alias(f"__{name}") for name, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    totals = totals.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in totals.columns[1:]])
    inside = Window.partitionBy("__part").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.join(F.broadcast(totals), "__part")  # MAX_PARTS rows at most
    new = {name: F.col(f"__{name}") + F.sum(c).over(so_far) for name, c in sums.items()}
    if rank:
        new[rank] = (F.col("__rows") + F.row_number().over(inside)).cast("int")
    return out.withColumns(new).drop("__part", "__rows", *[f"__{name}" for name in sums])
