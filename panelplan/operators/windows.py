"""Training windows over days and months."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sliding_windows(spark: SparkSession, lo: str, hi: str, icl: int, ocl: int, cap: int | None = None) -> DataFrame:
    """All windows of icl input days and ocl output days inside [lo, hi], oldest first; recency 0 is the
    newest, which ends on hi. cap keeps the newest so many."""
    count = f"date_diff(date'{hi}', date'{lo}') + 1 - {icl + ocl} + 1"
    rows = spark.sql(f"SELECT explode(sequence(0, {count} - 1)) AS window_id, {count} AS n WHERE {count} > 0")
    rows = rows.withColumns({
        "input_start": F.date_add(F.lit(lo).cast("date"), F.col("window_id")),
        "input_end": F.date_add(F.lit(lo).cast("date"), F.col("window_id") + icl - 1),
        "output_start": F.date_add(F.lit(lo).cast("date"), F.col("window_id") + icl),
        "output_end": F.date_add(F.lit(lo).cast("date"), F.col("window_id") + icl + ocl - 1),
        "recency": F.col("n") - 1 - F.col("window_id"),
    }).drop("n")
    return rows.filter(F.col("recency") < cap) if cap is not None else rows


def series_windows(bounds: DataFrame, icl: int, ocl: int, cap: int | None = None) -> DataFrame:
    """The same for each series of (series, lo, hi)."""
    n = F.date_diff("hi", "lo") + 1 - (icl + ocl) + 1
    rows = bounds.withColumn("n", n).filter("n > 0").withColumn("window_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.withColumns({"input_start": F.date_add("lo", F.col("window_id")), "output_start": F.date_add("lo", F.col("window_id") + icl), "output_end": F.date_add("lo", F.col("window_id") + icl + ocl - 1), "recency": F.col("n") - 1 - F.col("window_id")}).drop("n", "lo", "hi")
    return rows.filter(F.col("recency") < cap) if cap is not None else rows


def monthly_windows(spark: SparkSession, lo: str, hi: str, inputs: int, outputs: int, stride: int = 1) -> DataFrame:
    """Windows of whole months, a new one every `stride` months, that fit into the months lo to hi."""
    bounds = spark.range(1).select(F.trunc(F.lit(lo).cast("date"), "MM").alias("lo"), F.trunc(F.lit(hi).cast("date"), "MM").alias("hi"))
    n = (F.months_between("hi", "lo").cast("int") + 1 - (inputs + outputs)) / stride
    rows = bounds.withColumn("n", F.floor(n).cast("int")).filter("n >= 0").withColumn("window_id", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda k: F.expr(f"add_months(lo, CAST(window_id * {stride} + {k} AS INT))")
    return rows.select("window_id", at(0).alias("input_start"), F.last_day(at(inputs - 1)).alias("input_end"), at(inputs).alias("output_start"), F.last_day(at(inputs + outputs - 1)).alias("output_end"))


def event_coverage(windows: DataFrame, events: DataFrame) -> DataFrame:
    """For each event (name, date): in how many windows it is a target, in how many only context, and its role."""
    d = F.col("date")
    target = F.count_if(d.between(F.col("output_start"), F.col("output_end")))
    context = F.count_if((d >= F.col("input_start")) & (d < F.col("output_start")))
    out = events.crossJoin(F.broadcast(windows)).groupBy("name", "date").agg(target.alias("n_target"), context.alias("n_context"))
    return out.withColumn("role", F.when(F.col("n_target") > 0, "target").when(F.col("n_context") > 0, "context only").otherwise("unseen"))


def event_coverage_by_series(bounds: DataFrame, events: list[tuple[str, str]], icl: int, ocl: int, cap: int | None = None) -> DataFrame:
    """The same for each series of (series, lo, hi) and its own windows, without laying the windows out.

    A series' windows begin on consecutive days, so those that hold a day in their output, or in their input, are
    those between two numbers: counts are differences. events: (name, date), a short list given by the caller.
    cap: only the newest so many windows of each series. Series too short for a window have no row."""
    n = F.date_diff("hi", "lo") + 1 - (icl + ocl) + 1
    first = F.greatest(n - cap, F.lit(0)) if cap is not None else F.lit(0)
    listed = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(day).cast("date").alias("date")) for name, day in events])
    rows = bounds.withColumns({"__last": n - 1, "__first": first}).filter("__last >= 0").withColumn("__e", F.explode(listed))
    x = F.date_diff(F.col("__e.date"), F.col("lo")) - icl  # the last window whose output has begun on the day
    between = lambda lo, hi: F.greatest(F.least(hi, F.col("__last")) - F.greatest(lo, F.col("__first")) + 1, F.lit(0))
    out = rows.select("series", "__e.name", "__e.date", between(x - (ocl - 1), x).cast("bigint").alias("n_target"), between(x + 1, x + icl).cast("bigint").alias("n_context"))
    return out.withColumn("role", F.when(F.col("n_target") > 0, "target").when(F.col("n_context") > 0, "context only").otherwise("unseen"))


def val_bounds(params: DataFrame) -> DataFrame:
    """Validation bounds from (train_end, val_end, icl, ocl): where the strip begins, and how many of its
    days are targets that training has seen."""
    begin = F.least(F.date_add("train_end", 1), F.expr("date_sub(val_end, icl + ocl - 1)"))
    out = params.withColumn("strip_start", begin).withColumn("first_target", F.expr("date_add(strip_start, icl)"))
    return out.withColumn("leak_days", F.greatest(F.date_diff("train_end", "first_target") + 1, F.lit(0)))


def step_numbers(df: DataFrame, series: str, date: str) -> DataFrame:
    return df.withColumn("step", F.row_number().over(Window.partitionBy(series).orderBy(date)))


def relative_steps(df: DataFrame, series: str, date: str) -> DataFrame:
    """relative_step: the place of a row from the end of its window: 0 for the last one, negative before it."""
    w = Window.partitionBy(series)
    return df.withColumn("relative_step", F.row_number().over(w.orderBy(date)) - F.count("*").over(w).cast("int"))
