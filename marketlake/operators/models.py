"""Baseline forecasts, regressors, and how forecasts are judged."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlake.functions import ratio
from marketlake.operators.returns import by_date, TRADING_DAYS

# Horizons in rows.
HORIZONS = (1, 3, 5)


def naive_forecasts(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """The last seen close as the forecast for each horizon, next to what came.

    `previous` is that same close: a move is judged against it.
    """
    columns = {f"_f{h}": F.lag("close", h).over(by_date()) for h in horizons}
    pairs = F.array(
        *[
            F.struct(F.lit(h).alias("horizon"), F.col(f"_f{h}").alias("forecast"))
            for h in horizons
        ]
    )
    return (
        bars.withColumns(columns)
        .select("ticker", "date", F.col("close").alias("actual"), F.inline(pairs))
        .withColumn("previous", F.col("forecast"))
        .withColumn("model", F.lit("naive"))
        .filter(F.col("forecast").isNotNull())
    )


def forecast_metrics(forecasts: DataFrame) -> DataFrame:
    """RMSE, MAE, MAPE (percent) and the share of right directions per model and horizon."""
    error = F.col("forecast") - F.col("actual")
    same_way = F.signum(F.col("forecast") - F.col("previous")) == F.signum(
        F.col("actual") - F.col("previous")
    )
    return forecasts.groupBy("model", "horizon").agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.avg(F.abs(ratio(error, F.col("actual")))) * 100).alias("mape"),
        F.avg(same_way.cast("double")).alias("directional_accuracy"),
    )


def strategy_equity(signals: DataFrame) -> DataFrame:
    """Value of one unit that follows yesterday's signal (1, 0 or -1), and its fall from the peak.

    Needs ticker, date, ret (a fraction) and signal.
    """
    so_far = by_date().rowsBetween(W.unboundedPreceding, 0)
    held = F.coalesce(F.lag("signal").over(by_date()), F.lit(0))
    gains = signals.withColumn("gain", held * F.coalesce("ret", F.lit(0.0)))
    grown = gains.withColumn("equity", F.product(1 + F.col("gain")).over(so_far))
    peak = F.greatest(F.max("equity").over(so_far), F.lit(1.0))
    return grown.withColumn("drawdown", F.col("equity") / peak - 1)


def strategy_metrics(signals: DataFrame) -> DataFrame:
    """Annualised Sharpe ratio, maximum drawdown and final value per ticker."""
    return (
        strategy_equity(signals)
        .groupBy("ticker")
        .agg(
            (ratio(F.avg("gain"), F.stddev_samp("gain")) * math.sqrt(TRADING_DAYS)).alias("sharpe"),
            F.min("drawdown").alias("max_drawdown"),
            F.max_by("equity", "date").alias("final_equity"),
        )
    )


@dataclass(frozen=True)
class LinearFit:
    """A fitted line: prediction = intercept + sum of coefficient * feature."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def transform(self, rows: DataFrame) -> DataFrame:
        terms = [F.col(f).cast("double") * c for f, c in zip(self.features, self.coefficients, strict=True)]
        return rows.withColumn("prediction", reduce(lambda a, b: a + b, terms, F.lit(self.intercept)))


def moments(rows: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population covariances of the columns, in one pass and one row."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = rows.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    if row["m0"] is None:
        raise ValueError("no complete rows to fit")
    covariance = np.empty((len(columns), len(columns)))
    for i, j in pairs:
        covariance[i, j] = covariance[j, i] = row[f"c{i}_{j}"]
    return np.array([row[f"m{i}"] for i in range(len(columns))]), covariance


def fit_linear(rows: DataFrame, features: list[str], target: str, l1: float = 0.0, l2: float = 0.0) -> LinearFit:
    """Least squares with penalties on the coefficients of standardised features and target.

    Minimises |y - Xb|^2 / 2n + l1 |b| + l2 |b|^2 / 2 for columns of mean 0 and population variance 1, from the moments alone: normal
    equations without l1, else cyclic coordinate descent until no coefficient moves. A constant feature gets 0.
    """
    mean, covariance = moments(rows, [*features, target])
    spread = np.sqrt(np.diag(covariance))
    used = [i for i in range(len(features)) if spread[i] > 0]
    b = np.zeros(len(features))
    if used and spread[-1] > 0:
        correlation = covariance / np.outer(np.where(spread > 0, spread, 1), np.where(spread > 0, spread, 1))
        within, towards = correlation[np.ix_(used, used)], correlation[used, -1]
        b[used] = _descend(within, towards, l1, l2) if l1 else np.linalg.solve(within + l2 * np.eye(len(used)), towards)
    coefficients = b * spread[-1] / np.where(spread[:-1] > 0, spread[:-1], 1)
    return LinearFit(tuple(features), tuple(map(float, coefficients)), float(mean[-1] - coefficients @ mean[:-1]))


def _descend(within: np.ndarray, towards: np.ndarray, l1: float, l2: float, most: int = 10_000) -> np.ndarray:
    b = np.zeros(len(towards))
    for _ in range(most):
        before = b.copy()
        for j in range(len(b)):
            rest = towards[j] - within[j] @ b + within[j, j] * b[j]
            b[j] = np.sign(rest) * max(abs(rest) - l1, 0.0) / (within[j, j] + l2)
        if np.abs(b - before).max() < 1e-14:
            break
    return b


#: Penalties of the linear regressors, and the trees.
PENALTIES = {"ridge": {"l1": 0.0, "l2": 0.1}, "lasso": {"l1": 0.01, "l2": 0.0}}
TREES = {
    "random_forest": lambda: RandomForestRegressor(numTrees=20, maxDepth=5, seed=42),
    "boosted_trees": lambda: GBTRegressor(maxIter=10, maxDepth=3, seed=42),
}
REGRESSORS = [*PENALTIES, *TREES]
#: Rows of a partition that trees are fitted on at most, about: they keep each row as several objects.
PART_ROWS = 250_000


def fit_regressor(
    kind: str, rows: DataFrame, features: list[str], target: str, **params: object
) -> Model | LinearFit:
    """Fit one of REGRESSORS; rows with a null feature or target are left out.

    Trees pass over the rows once for each level, so these are persisted meanwhile, and released after. Partitions of more than
    `PART_ROWS` rows, as files read in large splits give, are dealt out anew first: what a task reads does not grow with the rows.
    """
    if kind not in REGRESSORS:
        raise ValueError(f"unknown regressor {kind!r}, choose from {REGRESSORS}")
    complete = rows.dropna(subset=[*features, target])
    if kind in PENALTIES:
        return fit_linear(complete, features, target, **(PENALTIES[kind] | params))
    estimator = TREES[kind]().setFeaturesCol("features").setLabelCol(target)
    training = _assembled(_dealt(complete.select(*dict.fromkeys([*features, target]))), features).select("features", target).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return estimator.copy({estimator.getParam(k): v for k, v in params.items()}).fit(training)
    finally:
        training.unpersist()


def _dealt(rows: DataFrame) -> DataFrame:
    sizes = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    return rows.repartition(-(-total // PART_ROWS)) if (most or 0) > PART_ROWS else rows


def predict(model: Model | LinearFit, rows: DataFrame, features: list[str]) -> DataFrame:
    complete = rows.dropna(subset=features)
    if isinstance(model, LinearFit):
        return model.transform(complete)
    return model.transform(_assembled(complete, features)).drop("features")


def _assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(rows)
