"""Training, application and reloading of a text classifier with Spark ML."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import vectors as vectors_of
from ..functions.workers import joined, ship
from ..sources import sinks
from . import metrics

ship(__name__)


def pipeline(text: str, label: str, features: int = config.HYPERPARAMETERS["features"], max_iter: int = config.HYPERPARAMETERS["max_iter"],
             reg_param: float = config.HYPERPARAMETERS["reg_param"]) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"(?U)\s+"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        LogisticRegression(featuresCol="_tfidf", labelCol=label, maxIter=max_iter, regParam=reg_param, predictionCol="_prediction", probabilityCol="_probability"),
    ])


def train(df: DataFrame, text: str, label: str, **parameters) -> PipelineModel:
    """Fit on rows whose label is known; an unknown label and an empty table are errors."""
    rows = metrics.require_rows(metrics.require_labels(df, label), "rows to train on")
    return pipeline(text, label, **parameters).fit(rows.withColumn(text, F.coalesce(text, F.lit(""))))


def predict(model: PipelineModel, df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``predicted`` (int) and ``probability`` of label 1; the label stays in its row."""
    out = model.transform(df.withColumn(text, F.coalesce(text, F.lit(""))))
    return out.select(*df.columns, F.col("_prediction").cast("int").alias("predicted"), F.get(vector_to_array("_probability"), F.lit(1)).alias("probability"))


def predict_in_batches(model: PipelineModel, df: DataFrame, text: str, rows: int = config.ADAPTER["score_rows"]) -> DataFrame:
    """predict(), with the classifier applied to ``rows`` texts at once: a matrix of features in, the probabilities of all labels out.

    The features stay in the JVM, and only those that aren't 0 are sent; a worker fills the matrix of one batch of ``rows`` at a time.
    """
    features, last = model.stages[:-1], model.stages[-1]
    vectors = df.withColumn(text, F.coalesce(text, F.lit("")))
    for stage in features:
        vectors = stage.transform(vectors)
    weights, intercepts, name = last.coefficientMatrix.toArray(), last.interceptVector.toArray(), last.getFeaturesCol()

    kind = pa.list_(pa.float64())

    def probabilities(x: np.ndarray) -> np.ndarray:
        margins = x @ weights.T + intercepts
        if margins.shape[1] == 1:  # two labels have one row of weights
            margins = np.concatenate([np.zeros_like(margins), margins], axis=1)
        e = np.exp(margins - margins.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def batch(part: pa.Array) -> pa.Array:
        x = np.zeros((len(part), weights.shape[1]))
        for own, at, values in zip(x, *(part.field(c) for c in ("indices", "values"))):
            own[at.values.to_numpy() if at.is_valid else slice(None)] = values.values.to_numpy()  # a dense vector has no indices
        return pa.array(probabilities(x).tolist(), kind)

    @F.arrow_udf("array<double>")
    def score(vectors: pa.Array) -> pa.Array:
        return joined([batch(vectors.slice(at, rows)) for at in range(0, len(vectors), rows)], kind)

    out = vectors.withColumn("_scores", score(F.unwrap_udt(name)))
    return out.select(*df.columns, vectors_of.argmax(F.col("_scores")).cast("int").alias("predicted"), F.get("_scores", F.lit(1)).alias("probability"))


def predict_one(spark: SparkSession, model: PipelineModel, text_column: str, text: str) -> tuple[str, float]:
    row = predict(model, spark.createDataFrame([(text,)], f"{text_column} string"), text_column).first()
    return {v: k for k, v in config.LABEL_IDS.items()}[row["predicted"]], row["probability"]


def predict_probabilities(spark: SparkSession, model: PipelineModel, text_column: str, text: str) -> tuple[str, dict[str, float]]:
    """The predicted label of one text and the probability of every label."""
    label, p = predict_one(spark, model, text_column, text)
    return label, {name: p if i == 1 else 1 - p for name, i in config.LABEL_IDS.items()}


def registry(model: PipelineModel, **counts: int) -> dict[str, float]:
    """The parameters that a model was trained with, its size, and what else is to be kept beside it."""
    stages = {type(s).__name__: s for s in model.stages}
    last = model.stages[-1]
    return {
        "features": stages["HashingTF"].getNumFeatures(), "max_iter": last.getMaxIter(), "reg_param": last.getRegParam(),
        "seed": config.SEED, "max_length": config.MAX_TOKENS, "parameters": parameter_count(model), **counts,
    }


def write_registry(spark: SparkSession, model: PipelineModel, path: str, **counts: int) -> None:
    """The registry as JSON."""
    kept = registry(model, **counts)
    sinks.write_json(spark.createDataFrame([tuple(map(float, kept.values()))], ", ".join(f"{k} double" for k in kept)), path)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def parameter_count(model: PipelineModel) -> int:
    """Weights and intercepts of the last stage, for any number of classes."""
    last = model.stages[-1]
    return last.coefficientMatrix.numRows * last.coefficientMatrix.numCols + last.interceptVector.size


def evaluate(predictions: DataFrame, label: str) -> DataFrame:
    return metrics.metrics(metrics.confusion(predictions, label, "predicted"))
