"""End-to-end evaluation: scored rows -> one metrics row + prediction table (MET16, SNK5).

The scored frame feeds several aggregates; when a prediction table is written it is read back
from the written files instead of recomputing the scoring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featpipe.operators import metrics as M

# Metric sets per task (MET8), metric-name aliases, primary metric per task and
# the direction of each metric.
TASK_METRICS = {
    "binary": ["accuracy", "precision", "recall", "f1", "auc"],
    "multiclass": ["accuracy", "precision", "recall", "f1"],
    "regression": ["mse", "mae", "rmse", "r2"],
}
ALIASES = {"f1_score": "f1", "r2_score": "r2", "roc_auc": "auc"}
PRIMARY = {"binary": "auc", "multiclass": "accuracy", "regression": "rmse"}
HIGHER_IS_BETTER = {"accuracy": True, "precision": True, "recall": True, "f1": True, "auc": True,
                    "mse": False, "mae": False, "rmse": False, "r2": True}


def task_from_loss(loss: str) -> str:
    n = loss.lower()
    if "bce" in n or "binary" in n:
        return "binary"
    if "cross_entropy" in n or "nll" in n:
        return "multiclass"
    return "regression"


LEAST_ROWS = 10  # fixed value: fewer valid rows than this are no evaluation


def valid_rows(df: DataFrame, label: str, score: str) -> DataFrame:
    """The rows an evaluation uses: a label, and a score that is a finite number."""
    return M.clean_scores(df, score).where(F.col(label).isNotNull())


def evaluate_binary(df: DataFrame, label: str, score: str, threshold: float = 0.5,
                    prediction_table: str | None = None, rank_by: str | None = None, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row: accuracy, precision, recall, f1, total, auc, all over the same valid rows; fewer than ``least_rows`` of them
    are an error. Optionally writes every column and ``prediction`` of those rows to ``prediction_table`` first and
    evaluates what was written. ``rank_by`` names a column in the same order as the score (e.g. the logit) to rank by."""
    scored = valid_rows(df, label, score).withColumn("prediction", M.predicted_class(score, threshold=threshold))
    if rank_by:
        scored = M.clean_scores(scored, rank_by)
    if prediction_table:
        scored.write.mode("overwrite").parquet(prediction_table)
        scored = df.sparkSession.read.parquet(prediction_table)
    n = scored.limit(least_rows).count()
    if n < least_rows:
        raise ValueError(f"{n} rows have a label and a finite score; an evaluation needs {least_rows}")
    cls = M.classification_metrics(scored, label, "prediction")
    a = M.auc(scored, label, rank_by or score)
    return cls.select("accuracy", "precision", "recall", "f1", "total", a.select("auc").scalar().alias("auc"))


def evaluate_predictions(df: DataFrame, task: str, label: str, pred: str, average: str = "macro", prediction_table: str | None = None,
                         least_rows: int = 1) -> DataFrame:
    """The metrics row of a regression or multiclass task, all over the same valid rows: a label and a prediction that are finite numbers.

    Fewer than ``least_rows`` of them are an error. ``prediction_table`` takes every column and ``prediction`` of those rows first; what was
    written is evaluated."""
    rows = df.where(M.finite(F.col(label).cast("double")) & M.finite(F.col(pred).cast("double")))
    if prediction_table:
        rows = rows if pred == "prediction" else rows.withColumn("prediction", F.col(pred))
        rows.write.mode("overwrite").parquet(prediction_table)
        rows = df.sparkSession.read.parquet(prediction_table)
    n = rows.limit(least_rows).count()
    if n < least_rows:
        raise ValueError(f"{n} rows have a label and a prediction; an evaluation needs {least_rows}")
    return M.regression_metrics(rows, label, pred) if task == "regression" else M.classification_metrics(rows, label, pred, average)


def metrics_long(row_df: DataFrame, task: str) -> DataFrame:
    """Wide metrics row -> ``(name, value, higher_is_better)`` rows for the task's metric set."""
    names = [m for m in TASK_METRICS[task] if m in row_df.columns]
    stack = ", ".join(f"'{n}', CAST(`{n}` AS DOUBLE), {str(HIGHER_IS_BETTER[n]).lower()}" for n in names)
    return row_df.selectExpr(f"stack({len(names)}, {stack}) AS (name, value, higher_is_better)")


def evaluate(df: DataFrame, task: str, label: str, pred: str | None = None, score: str | None = None,
             average: str = "macro", prediction_table: str | None = None) -> DataFrame:
    """The task's metric set as ``(name, value, higher_is_better)`` rows (MET8, MET16).

    binary: classes from ``score > 0.5`` (or ``pred``), AUC from ``score``; multiclass: ``pred``;
    regression: ``pred`` against ``label``. Rows without a valid label and score (or prediction) are left out of every metric; no valid row
    (binary: fewer than ``LEAST_ROWS``) is an error. ``prediction_table``: see ``evaluate_predictions`` and ``evaluate_binary``.
    """
    task = ALIASES.get(task, task)
    if task == "binary":
        if score is None:
            raise ValueError("binary evaluation needs a score column")
        rows = valid_rows(df, label, score)
        row = evaluate_binary(df, label, score, prediction_table=prediction_table) if pred is None else \
            M.classification_metrics(rows, label, pred).select(
                "*", M.auc(rows, label, score).select("auc").scalar().alias("auc"))
    elif task in ("multiclass", "regression"):
        row = evaluate_predictions(df, task, label, pred or "prediction", average, prediction_table)
    else:
        raise ValueError(f"unknown task {task}")
    return metrics_long(row, task).withColumn("value", F.col("value").cast("double"))
