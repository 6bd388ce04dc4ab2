"""Return models: the lasso path from cross-products, MLlib lasso and boosted trees, coefficients, signals, grids."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans.gram import matrix


def _rows(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Rows whose features and label are finite."""
    ok = F.lit(True)
    for c in [*features, label]:
        ok &= F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    return df.where(ok)


def fit_lasso(train: DataFrame, valid: DataFrame, features: list[str], alpha: float = 0.0005, max_iter: int = 1000, label: str = "label") -> PipelineModel:
    """L1 regression without intercept on train and valid rows together, keys once."""
    both = train.unionByName(valid).dropDuplicates(["datetime", "vt_symbol"])
    model = LinearRegression(featuresCol="x", labelCol=label, predictionCol="signal", elasticNetParam=1.0, regParam=alpha,
                             fitIntercept=False, standardization=False, maxIter=max_iter)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x"), model]).fit(_rows(both, features, label))


def fit_trees(train: DataFrame, valid: DataFrame, features: list[str], rounds: int = 50, depth: int = 5, rate: float = 0.05,
              seed: int = 7, label: str = "label") -> PipelineModel:
    """Boosted regression trees that stop when the validation error stops falling."""
    both = train.withColumn("__valid", F.lit(False)).unionByName(valid.withColumn("__valid", F.lit(True)))
    model = GBTRegressor(featuresCol="x", labelCol=label, predictionCol="signal", maxIter=rounds, maxDepth=depth, stepSize=rate,
                         validationIndicatorCol="__valid", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x"), model]).fit(_rows(both, features, label))


def predict(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """Signal frame: keys and prediction; missing features count as zero."""
    filled = df.withColumns({c: F.coalesce(F.when(F.abs(F.col(c)) < float("inf"), F.col(c)), F.lit(0.0)) for c in features})
    return model.transform(filled).select("datetime", "vt_symbol", "signal")


def importance(model: PipelineModel, features: list[str]) -> DataFrame:
    """Non-zero coefficients or importances by magnitude (one row per feature)."""
    last = model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows = [(n, float(v)) for n, v in zip(features, values.toArray()) if v != 0.0]
    return spark.createDataFrame(rows, "feature string, value double").orderBy(F.abs("value").desc())


@dataclass(frozen=True)
class LinearModel:
    """Coefficients of a linear signal without intercept."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]

    def predict(self, df: DataFrame) -> DataFrame:
        """Signal frame: keys and prediction; missing features count as zero."""
        terms = [F.coalesce(F.when(F.abs(F.col(c)) < float("inf"), F.col(c)), F.lit(0.0)) * w for c, w in zip(self.features, self.coefficients)]
        return df.select("datetime", "vt_symbol", sum(terms[1:], terms[0]).alias("signal"))

    def detail(self, spark: SparkSession) -> DataFrame:
        """Non-zero coefficients by magnitude (one row a feature)."""
        rows = [(c, w) for c, w in zip(self.features, self.coefficients) if w != 0.0]
        return spark.createDataFrame(rows, "feature string, value double").orderBy(F.abs("value").desc())


def _descend(gram: np.ndarray, moment: np.ndarray, alpha: float, start: np.ndarray, sweeps: int) -> np.ndarray:
    """Coordinate descent for 1/2 w'Gw - c'w + alpha |w|; its cost does not depend on the rows."""
    w = start.copy()
    for _ in range(sweeps):
        largest = 0.0
        for j in range(len(w)):
            if gram[j, j] == 0.0:
                continue
            rest = moment[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - alpha, 0.0) / gram[j, j]
            largest, w[j] = max(largest, abs(new - w[j]) * np.sqrt(gram[j, j])), new
        if largest < 1e-13:
            break
    return w


def lasso_path(train: DataFrame, features: list[str], alphas: list[float], label: str = "label", sweeps: int = 100_000) -> dict[float, LinearModel]:
    """The lasso of every penalty from one pass over ``train``: X'X and X'y are summed on Spark, all penalties solved from them.

    Rows with a missing or infinite feature or label are left out. Penalties go from
    the largest down, each from the solution of the one before.
    """
    total = matrix(train, [*features, label])
    n = total[0, 0]
    if n == 0:
        raise ValueError("no complete row to fit on")
    gram, moment = total[1:-1, 1:-1] / n, total[1:-1, -1] / n
    out, w = {}, np.zeros(len(features))
    for alpha in sorted(set(alphas), reverse=True):
        w = _descend(gram, moment, alpha, w, sweeps)
        out[alpha] = LinearModel(tuple(features), tuple(map(float, w)))
    return out


def grid_search(train: DataFrame, valid: DataFrame, features: list[str], alphas: list[float], label: str = "label") -> DataFrame:
    """Validation error of every penalty, best first: one pass over ``train``, one over ``valid``."""
    models = lasso_path(train, features, alphas, label)
    total = matrix(valid, [*features, label])
    n, gram, moment, square = total[0, 0], total[1:-1, 1:-1], total[1:-1, -1], total[-1, -1]
    errors = []
    for alpha, model in models.items():
        w = np.array(model.coefficients)
        errors.append((float(alpha), float((square - 2 * w @ moment + w @ gram @ w) / n) if n else None))
    return train.sparkSession.createDataFrame(sorted(errors, key=lambda r: (r[1] is None, r[1])), "alpha double, mse double")
