"""Quality regressors over feature columns."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, functions as F

MIN_ROWS = 10


#: What a feature is where it can't be had, if not 0; and a sample's target. Fixed values.
DEFAULTS = {"wer_score": 1.0, "mer_score": 1.0, "wil_score": 1.0, "length_ratio": 1.0, "mean_confidence": 0.8, "min_confidence": 0.8, "max_confidence": 0.8, "high_confidence_ratio": 1.0}
DEFAULT_TARGET = 1.0


def with_defaults(df: DataFrame, features: list[str], target: str | None = None) -> DataFrame:
    """A feature that failed is its default, as is a target."""
    out = {f: F.coalesce(F.col(f).cast("double"), F.lit(DEFAULTS.get(f, 0.0))) for f in features}
    if target:
        out[target] = F.coalesce(F.col(target).cast("double"), F.lit(DEFAULT_TARGET))
    return df.withColumns(out)


def forest(label: str) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=label, numTrees=50, maxDepth=10, minInstancesPerNode=2, seed=42)


def boosted(label: str, rounds: int = 100) -> GBTRegressor:
    return GBTRegressor(labelCol=label, maxIter=rounds, maxDepth=6, stepSize=0.1, seed=42)


def fit(df: DataFrame, features: list[str], label: str, regressor=None) -> PipelineModel:
    """Assemble ``features`` in that order and fit; too few rows to split are refused."""
    if len(df.select(label).limit(MIN_ROWS).take(MIN_ROWS)) < MIN_ROWS:
        raise ValueError(f"fewer than {MIN_ROWS} training rows")
    stages = [VectorAssembler(inputCols=features, outputCol="features"), regressor or forest(label)]
    return Pipeline(stages=stages).fit(with_defaults(df, features))


def predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    return model.transform(with_defaults(df, model.stages[0].getInputCols())).drop("features")


def importance(spark: SparkSession, model: PipelineModel, k: int = 10) -> DataFrame:
    rows = list(zip(model.stages[0].getInputCols(), map(float, model.stages[1].featureImportances.toArray()), strict=True))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(k)


def cross_validated(df: DataFrame, features: list[str], label: str, regressor=None, folds: int = 5) -> tuple[float, float]:
    """Mean squared error over the folds: mean and population deviation."""
    pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), regressor or forest(label)])
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=ParamGridBuilder().build(), evaluator=RegressionEvaluator(labelCol=label, metricName="mse"), numFolds=folds, seed=42)
    fitted = cv.fit(with_defaults(df, features))
    return float(fitted.avgMetrics[0]), float(fitted.stdMetrics[0])


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
