"""Frequencies, confusion matrices and what follows from them; all from integer counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as tx


def value_counts(df: DataFrame, column: str, nulls: bool = False) -> DataFrame:
    rows = df if nulls else df.where(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def majority_class(df: DataFrame, label: str) -> DataFrame:
    """One row: the most frequent label, the smallest of equals."""
    return value_counts(df, label).orderBy(F.desc("n"), label).limit(1).select(F.col(label).alias("majority"))


def confusion(df: DataFrame, truth: str, predicted: str, *more: Column) -> DataFrame:
    """One row: tn, fp, fn, tp for the labels 0 and 1, and further aggregates."""
    t, p = F.col(truth), F.col(predicted)
    return df.agg(
        F.count_if((t == 0) & (p == 0)).alias("tn"), F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 1) & (p == 1)).alias("tp"), *more,
    )


def _over(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def metrics(matrix: DataFrame) -> DataFrame:
    """accuracy, f1_macro and recall of label 1 beside the counts.

    Macro F1 is the plain mean over the labels that occur as truth or prediction.  Further
    columns stay.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    f0 = F.when(2 * tn + fp + fn > 0, (2 * tn) / (2 * tn + fp + fn))
    f1 = F.when(2 * tp + fp + fn > 0, (2 * tp) / (2 * tp + fp + fn))
    present = f0.isNotNull().cast("int") + f1.isNotNull().cast("int")
    mean = F.when(present == 0, F.lit(0.0)).otherwise((F.coalesce(f0, F.lit(0.0)) + F.coalesce(f1, F.lit(0.0))) / present)
    return matrix.select(
        "tn", "fp", "fn", "tp", _over(tn + tp, tn + fp + fn + tp).alias("accuracy"), mean.alias("f1_macro"), _over(tp, tp + fn).alias("recall"),
        *[c for c in matrix.columns if c not in ("tn", "fp", "fn", "tp")],
    )


def errors(matrix: DataFrame) -> DataFrame:
    return matrix.select(
        F.col("fn").alias("false_negatives"), (F.col("fn") + F.col("tp")).alias("positives"),
        F.col("fp").alias("false_positives"), (F.col("fp") + F.col("tn")).alias("negatives"),
    )


def long_form(measured: DataFrame, value: str) -> DataFrame:
    """``metric, value`` rows of a row of metrics."""
    names = ["accuracy", "f1_macro", "recall"]
    return measured.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias(value)) for n in names])).alias("x")).select("x.*")


def delta(baseline: DataFrame, model: DataFrame) -> DataFrame:
    """``metric, baseline, model, delta``; metrics of one side only stay with NULLs."""
    return baseline.join(model, "metric", "full_outer").select("metric", "baseline", "model", (F.col("model") - F.col("baseline")).alias("delta"))


def goals(measured: DataFrame, wanted: dict[str, float] = config.GOALS) -> DataFrame:
    """Recall must reach its goal, macro F1 must exceed its."""
    return measured.select(
        (F.col("recall") >= wanted["recall"]).alias("recall_met"), (F.col("f1_macro") > wanted["f1_macro"]).alias("f1_met"),
    )


def majority_predictions(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """``test`` with the majority label of ``train`` as ``predicted``: a join with one row."""
    return test.crossJoin(F.broadcast(majority_class(train, label))).withColumnRenamed("majority", "predicted")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df``, if it has a row; else an error that says what is missing."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def rounded(measured: DataFrame, places: int = 4) -> DataFrame:
    """The measures as they are published; the counts stay."""
    return measured.select(*[tx.rounded(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in measured.dtypes])


def report_lines(deltas: DataFrame) -> DataFrame:
    """``metric, line``: name, baseline, model and signed difference as one line of a table."""
    return deltas.select("metric", F.concat(tx.padded(F.col("metric"), 15), *[F.concat(F.lit(" "), tx.fixed(F.col(c), 4)) for c in ("baseline", "model")], F.lit(" "), tx.signed(F.col("delta"))).alias("line"))


def require_labels(df: DataFrame, label: str) -> DataFrame:
    """``df``, if no label is NULL; else an error that says how many are."""
    n = df.where(F.col(label).isNull()).count()
    if n:
        raise ValueError(f"{n} rows without a known label")
    return df
