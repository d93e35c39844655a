"""Festive-day trends, blending, samples, the panel forecaster and its backtest."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelplan.operators.sampling import bootstrap_rows


def lag_day_sales_wide(df: DataFrame, flags: list[str], series: str, year: str, value: str) -> DataFrame:
    """One column of sales per lag-day flag, in a single pass over the panel."""
    sums = [F.sum(F.when(F.coalesce(F.col(f"`{f}`"), F.lit(0)) != 0, F.col(value)).otherwise(0)).alias(f) for f in flags]
    return df.groupBy(series, year).agg(*sums)


def lag_day_sales_long(df: DataFrame, flags: list[str], series: str, year: str, value: str) -> DataFrame:
    """(series, year, lag_day, sales): flags as values; one shuffle."""
    set_flags = F.filter(F.array(*[F.when(F.coalesce(F.col(f"`{f}`"), F.lit(0)) != 0, F.lit(f)) for f in flags]), lambda x: x.isNotNull())
    rows = df.select(series, year, F.col(value).alias("sales"), F.explode(set_flags).alias("lag_day"))
    return rows.groupBy(series, year, "lag_day").agg(F.sum("sales").alias("sales"))


def pivot_years(long: DataFrame, keys: list[str], year: str, value: str, years: list[int]) -> DataFrame:
    return long.groupBy(*keys).pivot(year, years).agg(F.sum(value)).fillna(0, [str(y) for y in years])


def ols_extrapolate(long: DataFrame, keys: list[str], year: str, value: str, years: list[int], target: int) -> DataFrame:
    """Least-squares line of yearly sales for each key, read off at `target` and floored at 0.

    A year without sales counts as 0, so the sums run over the sales that are there and the years'
    own sums are constants: one grouped pass, no densified rows."""
    n, sx, sxx = len(years), sum(years), sum(y * y for y in years)
    base = n * sxx - sx * sx
    rows = long.filter(F.col(year).isin(years))
    sy, sxy = F.sum(value), F.sum(F.col(value) * F.col(year))
    out = rows.groupBy(*keys).agg(((sxy * n - sy * sx) / float(base)).alias("slope"), sy.alias("__sy"))
    level = (F.col("__sy") - F.col("slope") * sx) / n
    return out.withColumn("prediction", F.greatest(level + F.col("slope") * target, F.lit(0.0))).drop("__sy")


def lag_day_forecast(df: DataFrame, flags: list[str], series: str, year: str, value: str, years: list[int], target: int, dense: bool = False) -> DataFrame:
    """The trend of each series and lag day that was ever flagged; dense: of all of them, 0 for pairs without sales."""
    found = ols_extrapolate(lag_day_sales_long(df, flags, series, year, value), [series, "lag_day"], year, value="sales", years=years, target=target)
    if not dense:
        return found
    every = df.select(series).distinct().withColumn("lag_day", F.explode(F.array(*[F.lit(f) for f in flags])))
    return every.join(found, [series, "lag_day"], "left").fillna(0.0, ["slope", "prediction"])


def lag_days_by_date(forecast: DataFrame, lag_map: DataFrame, series: str, date: str = "cal_date") -> DataFrame:
    """Lag-day forecasts on their dates: summed, with the lag days' names in order."""
    return forecast.join(F.broadcast(lag_map), "lag_day").groupBy(series, date).agg(F.sum("prediction").alias("trend"), F.expr("listagg(lag_day, '+') WITHIN GROUP (ORDER BY lag_day)").alias("lag_days"))


def blend(model: DataFrame, trend: DataFrame, series: str, date: str = "cal_date", value: str = "model", w: float = 0.5) -> DataFrame:
    """w x trend + (1 - w) x model on festive dates, the model alone on others."""
    out = model.join(trend, [series, date], "left").withColumn("is_festive", F.col("trend").isNotNull())
    return out.withColumn("blended", F.when(F.col("is_festive"), F.col("trend") * w + F.col(value) * (1 - w)).otherwise(F.col(value)))


def finish_forecast(df: DataFrame, value: str, date: str, lo: str, hi: str, digits: int = 2) -> DataFrame:
    """Floored at 0, rounded, and cut to the horizon."""
    return df.filter(F.col(date).between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))).withColumn(value, F.bround(F.greatest(F.col(value), F.lit(0.0)), digits))


def make_samples(df: DataFrame, series: str, date: str, value: str, origins: DataFrame, horizon: int, lags: tuple[int, ...] = (1, 2, 3), window: int = 3, future: tuple[str, ...] = (), season: int | None = None) -> DataFrame:
    """Supervised rows (series, origin, step): lags and window statistics as of the origin, covariates and
    target of the step's date. Time runs in rows of the series; origins is a small table of dates. All come
    from one window over the series, so nothing is joined to itself; steps beyond the last row have null targets.

    season: also the target of as many steps before the step's date, where it is known at the origin."""
    w = Window.partitionBy(series).orderBy(date)
    past, ahead = w.rowsBetween(1 - window, 0), w.rowsBetween(1, horizon)
    later = F.collect_list(F.struct(F.col(date).alias("target_date"), F.col(value).alias("target"), *future)).over(ahead)
    new = {f"lag_{k}": F.lag(value, k - 1).over(w) for k in lags} | {"win_mean": F.avg(value).over(past), "win_max": F.max(value).over(past), "__later": later, "place": F.row_number().over(w)}
    if season:
        new["__before"] = F.collect_list(F.struct(F.col(value).alias("v"))).over(w.rowsBetween(1 - season, 0))
    known = df.select(series, date, value, *future).withColumns(new).drop(*future, value)
    at = known.join(F.broadcast(origins.select(F.col("origin").alias(date)).distinct()), date).withColumnRenamed(date, "origin")
    out = at.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("__to", F.get("__later", F.col("step") - 1))
    out = out.withColumns({"place": F.col("place") + F.col("step")} | {c: F.col("__to")[c] for c in ("target_date", "target", *future)})
    if season:
        out = out.withColumn("season_lag", F.get("__before", F.size("__before") - 1 + F.col("step") - season)["v"])
        out = out.withColumn("season_lag", F.when(F.col("step") <= season, F.col("season_lag"))).drop("__before")
    return out.drop("__later", "__to")


@dataclass
class PanelForecaster:
    """One global direct multi-step model over all series; P10, P50 and P90 from validation residuals by step.

    features: numbers, lagged, known ahead or static (ordinal codes of a series' attributes)."""

    series: str
    features: list[str]
    kind: str = "linear"
    params: dict = field(default_factory=dict)
    model: object = None
    residuals: DataFrame | None = None
    scored: DataFrame | None = None

    def _vectors(self, samples: DataFrame) -> DataFrame:
        filled = samples.fillna(0, self.features)
        return VectorAssembler(inputCols=self.features, outputCol="features").transform(filled)

    def fit(self, train: DataFrame, valid: DataFrame | None = None) -> PanelForecaster:
        learner = LinearRegression if self.kind == "linear" else GBTRegressor
        self.model = learner(featuresCol="features", labelCol="target", predictionCol="forecast", **self.params).fit(self._vectors(train.dropna(subset=["target"])))
        scored = self.model.transform(self._vectors((valid if valid is not None else train).dropna(subset=["target"])))
        # a step holds a share of all rows: sketches of stated accuracy (ranks within 1 in 10,000), merged from the tasks
        q = F.percentile_approx(F.col("target") - F.col("forecast"), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), F.lit(10_000))
        self.residuals = scored.groupBy("step").agg(q.alias("q"))  # a row per step
        self.scored = scored
        return self

    def predict(self, samples: DataFrame) -> DataFrame:
        out = self.model.transform(self._vectors(samples)).drop("features").join(F.broadcast(self.residuals), "step", "left")
        floor = lambda c: F.greatest(c, F.lit(0.0))
        return out.withColumns({f"p{p}": floor(F.col("forecast") + F.coalesce(F.col("q")[k], F.lit(0.0))) for k, p in enumerate((10, 50, 90))} | {"forecast": floor(F.col("forecast"))}).drop("q")

    def sample(self, samples: DataFrame, draws: int = 100) -> DataFrame:
        """Sample rows of each forecast: `draws` residuals of its step from the validation rows, added to it."""
        rows = self.model.transform(self._vectors(samples)).select(self.series, "origin", "step", "forecast")
        residuals = self.scored.select("step", self.series, "origin", (F.col("target") - F.col("forecast")).alias("residual"))
        return bootstrap_rows(rows, residuals, [self.series, "origin", "step"], [self.series, "origin"], draws)


def seasonal_naive(df: DataFrame, series: str, date: str, value: str, months: int = 12) -> DataFrame:
    """The same date a year before, as a baseline; 0 where there is none."""
    before = df.select(series, F.add_months(date, months).alias(date), F.col(value).alias("naive"))
    return df.join(before, [series, date], "left").withColumn("naive", F.coalesce("naive", F.lit(0)))


def backtest(samples: DataFrame, forecaster: PanelForecaster, valid_from: str, residual_from: str | None = None) -> DataFrame:
    """Forecasts for all origins from a date on, by a model that has seen only targets before it.

    residual_from: targets from this date to valid_from are kept from the fit and give the residuals that
    the quantiles come from; without it, those of the fitted rows do, which are narrower."""
    cut = F.lit(valid_from).cast("date")
    seen, valid = samples.filter(F.col("target_date") < cut), None
    if residual_from:
        held = F.lit(residual_from).cast("date")
        seen, valid = seen.filter(F.col("target_date") < held), seen.filter(F.col("target_date") >= held)
    return forecaster.fit(seen, valid).predict(samples.filter(F.col("origin") >= cut))


def sweep(samples: DataFrame, grid: list[dict], series: str, features: list[str], valid_from: str) -> DataFrame:
    """The mean absolute error of each setting's backtest, best first; one pass per setting of a given, short list."""
    scored = []
    for k, params in enumerate(grid):
        found = backtest(samples, PanelForecaster(series, features, params=params), valid_from)
        scored.append(found.agg(F.lit(k).alias("setting"), F.avg(F.abs(F.col("forecast") - F.col("target"))).alias("mae")))
    return reduce(lambda a, b: a.unionByName(b), scored).orderBy("mae", "setting")


def festive_share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))
