"""Ridge regression from sums: one pass adds up X'X and X'y by time, and every origin, fold and setting is solved from these.

A row of samples gives (p + 2)(p + 3) / 2 products of its p features, the intercept and the target. Their sums by
date (or fold) are a small table, a row for each; its running sums are the matrices of all that was known at each
origin. The driver gets that table and solves systems of p + 1 equations; the samples are read once, whatever the
number of settings and origins."""

from __future__ import annotations

import math
import random
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gram_sums(samples: DataFrame, by: str, features: list[str], target: str) -> DataFrame:
    """(by, n, g): g has the sums of products of (1, features, target), the upper triangle row by row. Rows with a null among them are left out."""
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(target).cast("double")]
    rows = samples.dropna(subset=[*features, target])
    sums = [F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.array(*sums).alias("g"))


def gram_rows(sums: DataFrame, by: str, names: list[str]) -> DataFrame:
    """(by, a, b, value): the sums as rows, for names (1, features, target)."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    at = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("g")[k].alias("value")) for k, (a, b) in enumerate(pairs)])
    return sums.select(by, F.explode(at).alias("x")).select(by, "x.a", "x.b", "x.value")


def as_matrix(g: Iterable[float], size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = list(g)
    return out + np.triu(out, 1).T


def solve(gram: np.ndarray, ridge: float, chosen: list[int]) -> np.ndarray:
    """Intercept and coefficients (0 for features not chosen) that minimise squared error plus ridge * their squares; the intercept is free."""
    at = [0, *[1 + k for k in chosen]]
    a = gram[np.ix_(at, at)] + np.diag([0.0, *[ridge] * len(chosen)])
    out = np.zeros(len(gram) - 1)
    out[at] = np.linalg.lstsq(a, gram[at, -1], rcond=None)[0]
    return out


def squared_error(gram: np.ndarray, coefficients: np.ndarray) -> float:
    """The sum of squared errors over the rows behind a matrix, without reading them again."""
    b = np.append(-coefficients, 1.0)
    return float(b @ gram @ b)


#: Digits of the errors that settings are ranked by.
DIGITS = 100


def fold_error(before: np.ndarray, gram: np.ndarray, ridge: float, chosen: list[int]) -> Decimal:
    """The sum of squared errors over a fold's matrix of the coefficients that the matrix before it gives, to DIGITS digits.

    Strengths far below the features' squares change the error by less than a double's rounding; in doubles, that would choose the best of them."""
    at = [0, *[1 + k for k in chosen]]
    if not (np.isfinite(before).all() and np.isfinite(gram).all()):
        return Decimal(squared_error(gram, solve(before, ridge, chosen)))
    with localcontext(prec=DIGITS):
        rows = [[Decimal(float(before[i, j])) + (Decimal(ridge) if i == j and i else 0) for j in at] + [Decimal(float(before[i, -1]))] for i in at]
        least = max(abs(v) for row in rows for v in row).scaleb(-DIGITS // 2)
        for k in range(len(at)):  # elimination, the greatest pivot first
            top = max(range(k, len(at)), key=lambda i: abs(rows[i][k]))
            rows[k], rows[top] = rows[top], rows[k]
            if abs(rows[k][k]) <= least:
                return Decimal(squared_error(gram, solve(before, ridge, chosen)))  # singular
            for i in range(len(at)):
                if i != k and rows[i][k]:
                    part = rows[i][k] / rows[k][k]
                    rows[i] = [a - part * b for a, b in zip(rows[i], rows[k])]
        b = [*[-row[-1] / row[k] for k, row in enumerate(rows)], Decimal(1)]
        at = [*at, len(gram) - 1]
        return sum((b[i] * b[j] * Decimal(float(gram[p, q])) for i, p in enumerate(at) for j, q in enumerate(at)), Decimal(0))


@dataclass(frozen=True)
class Setting:
    ridge: float
    features: tuple[str, ...]


def sampled_settings(n: int, seed: int, subsets: list[tuple[str, ...]], ridge: tuple[float, float] = (0.01, 1e6)) -> list[Setting]:
    """n settings: the strength log-uniform between two bounds, the features one of the subsets."""
    rng = random.Random(seed)
    return [Setting(math.exp(rng.uniform(math.log(ridge[0]), math.log(ridge[1]))), rng.choice(subsets)) for _ in range(n)]


def sweep_ridge(samples: DataFrame, fold: str, features: list[str], target: str, settings: list[Setting]) -> tuple[DataFrame, Setting]:
    """Each setting's error over all folds but the first, and the best setting (least error, then first in the list).

    Folds are in time's order: a fold is forecast by what the folds before it teach. One job, whatever the number of settings.
    All settings share the sums of that job, so what those lost in rounding does not change which is best."""
    sums = sorted(gram_sums(samples, fold, features, target).collect(), key=lambda r: r[fold])  # a row for each fold
    size = len(features) + 2
    grams = [as_matrix(r["g"], size) for r in sums]
    before, rows, errors = np.cumsum(grams, axis=0) if grams else [], [], []
    n = sum(r["n"] for r in sums[1:])
    for k, s in enumerate(settings):
        chosen = [features.index(f) for f in s.features]
        with localcontext(prec=DIGITS):
            errors.append(sum((fold_error(before[i - 1], grams[i], s.ridge, chosen) for i in range(1, len(grams))), Decimal(0)))
        rows.append((k, s.ridge, list(s.features), n, math.sqrt(max(float(errors[-1]), 0.0) / n) if n else None))
    best = min(rows, key=lambda r: (errors[r[0]].is_nan(), 0 if errors[r[0]].is_nan() else errors[r[0]], r[0])) if rows else None
    table = samples.sparkSession.createDataFrame([(*r, r[0] == best[0]) for r in rows], "setting int, ridge double, features array<string>, n bigint, rmse double, best boolean")
    return table, settings[best[0]] if best else None


def origin_grid(df: DataFrame, date: str, start: str, stride: int, horizon: int) -> DataFrame:
    """(origin): the dates of df from `start` on, every `stride`-th, as long as `horizon` dates follow. One row for each distinct date is looked at."""
    dates = df.select(F.col(date).alias("origin")).distinct()
    placed = dates.withColumn("place", F.row_number().over(Window.orderBy("origin"))).withColumn("n", F.count("*").over(Window.partitionBy()))
    late = placed.filter(F.col("origin") >= F.lit(start).cast("date")).withColumn("k", F.row_number().over(Window.orderBy("origin")) - 1)
    return late.filter((F.col("k") % stride == 0) & (F.col("place") + horizon <= F.col("n"))).select("origin")


def known_models(samples: DataFrame, origins: DataFrame, features: list[str], target: str, date: str = "target_date", ridge: float = 0.0, refit: bool = True) -> DataFrame:
    """(origin, n_known, coefficients): the model of each origin, from samples whose target's date is not after it.

    refit=False: all origins have the model of the first one."""
    sums = sorted(gram_sums(samples, date, features, target).collect(), key=lambda r: r[date])  # a row for each date
    size, out = len(features) + 2, []
    at = sorted(r["origin"] for r in origins.collect())
    total, n, k = np.zeros((size, size)), 0, 0
    for origin in at:
        while k < len(sums) and sums[k][date] <= origin and (refit or not out):
            total, n, k = total + as_matrix(sums[k]["g"], size), n + sums[k]["n"], k + 1
        out.append((origin, n, solve(total, ridge, list(range(len(features)))).tolist()))
    return samples.sparkSession.createDataFrame(out, "origin date, n_known bigint, coefficients array<double>")


def linear_forecast(features: list[str], coefficients: str = "coefficients") -> Column:
    return sum((F.col(coefficients)[k + 1] * F.col(f) for k, f in enumerate(features)), F.col(coefficients)[0])


def rolling_backtest(samples: DataFrame, origins: DataFrame, features: list[str], target: str = "target", ridge: float = 0.0, refit: bool = True) -> DataFrame:
    """Forecasts of all steps of the origins' samples, by the model of what each origin knew."""
    models = known_models(samples, origins, features, target, ridge=ridge, refit=refit)
    return samples.join(F.broadcast(models), "origin").withColumn("forecast", linear_forecast(features)).drop("coefficients")  # a row for each origin
