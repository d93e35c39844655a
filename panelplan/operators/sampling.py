"""Draws and permutations that are the same in every run: rows numbered over ranges, hashes of keys, equi-joins by number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelplan.operators.ranking import with_running
from panelplan.sources.scratch import staged


def key_hash(*keys: Column | str) -> Column:
    """60 bits of the md5 of the keys as text, joined by |; any engine can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])), 1, 15), 16, 10).cast("bigint")


def numbered(df: DataFrame, group: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """df with `number`, the place of a row in its group from 0 on, and (group, n_group): a row for each group.

    For few groups that hold a large part of all rows each: rows are numbered over ranges of (group, order), so no
    task sorts a group. order tells the rows of a group apart, without nulls."""
    rows = staged(df, "numbered")
    sizes = staged(rows.groupBy(group).agg(F.count("*").alias("n_group")), "group-sizes")
    ranked = with_running(rows, [F.col(group), *order], rank="__rank", fixed=True)
    first = sizes.alias("a").join(sizes.alias("b"), F.col(f"a.{group}") > F.col(f"b.{group}"), "left").groupBy(F.col(f"a.{group}").alias(group)).agg(F.coalesce(F.sum("b.n_group"), F.lit(0)).alias("__first"))
    return ranked.join(F.broadcast(first), group).withColumn("number", F.col("__rank") - 1 - F.col("__first")).drop("__rank", "__first"), sizes


def bootstrap_rows(forecasts: DataFrame, residuals: DataFrame, keys: list[str], order: list[str], draws: int = 100, step: str = "step", value: str = "forecast") -> DataFrame:
    """Sample rows: each forecast `draws` times, every time with another residual of its step added, floored at 0.

    residuals: (step, residual, order...). Draw d of a row takes the residual numbered hash(keys, d) mod their
    count: an equi-join on numbers that are spread evenly, whatever the series. Steps without residuals have no
    rows. The result has `draws` rows for each forecast: draw and sample."""
    pool, sizes = numbered(residuals.select(step, "residual", *order), step, [F.col(c) for c in order])
    wanted = forecasts.join(F.broadcast(sizes), step).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))  # a row for each step
    wanted = wanted.withColumn("number", key_hash(*keys, "draw") % F.col("n_group")).drop("n_group")
    return wanted.join(pool.select(step, "number", "residual"), [step, "number"]).withColumn("sample", F.greatest(F.col(value) + F.col("residual"), F.lit(0.0))).drop("number", "residual")


def permutation_importance(samples: DataFrame, features: list[str], target: str, predict: Callable[[dict[str, Column]], Column], keys: list[str], step: str = "step", seed: int = 1, model: DataFrame | None = None) -> DataFrame:
    """(step, feature, mae, mae_permuted, importance): how much worse a model does when a feature is that of another row of the step.

    Rows of a step are put into the order of a hash of their keys, and each takes the features of the next one in
    that order (the last those of the first): one keyed join for all features, no sort of a step in one task.
    predict: the forecast as an expression of columns by name."""
    keyed = samples.select(step, *keys, target, *features).withColumn("__place", key_hash(*keys, step, F.lit(seed)))
    rows, sizes = numbered(keyed, step, [F.col("__place"), *[F.col(k) for k in keys]])
    rows = staged(rows.drop("__place"), "permuted")
    other = rows.join(F.broadcast(sizes), step).select(step, ((F.col("number") + F.col("n_group") - 1) % F.col("n_group")).alias("number"), *[F.col(f).alias(f"__{f}") for f in features])
    both = rows.join(other, [step, "number"])
    own = {f: F.col(f) for f in features}
    error = lambda columns: F.avg(F.abs(predict(columns) - F.col(target)))
    out = both.groupBy(step).agg(error(own).alias("mae"), *[error(own | {f: F.col(f"__{f}")}).alias(f) for f in features])
    return out.unpivot([step, "mae"], features, "feature", "mae_permuted").withColumn("importance", F.col("mae_permuted") - F.col("mae"))
