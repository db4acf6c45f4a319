"""Prediction tables of fitted classifiers, and what is measured on them.

A prediction table has one row per test row: its keys, the true class ``y_test`` and one probability per model. All
measures start from it, so no model is applied twice.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..operators import metrics as mt
from .classifiers import evaluate


def prediction_table(models: dict[str, object], rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``y_test`` and a probability column per model; all models run over the rows in one pass."""
    scored = rows
    for name, model in models.items():
        scored = (model.transform(scored).withColumn(name, vector_to_array("probability")[1])
                  .drop("rawPrediction", "probability", "prediction"))
    return scored.select(*keep, F.col("label").cast("int").alias("y_test"), *models)


def by_model(table: DataFrame, models: dict[str, str], keep: list[str]) -> DataFrame:
    """Long form: one row per prediction and model. ``models`` maps a probability column to the model's name."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), F.col(column).alias("score"))
                               for column, name in models.items()]))
    return table.select(*keep, "y_test", each.alias("one")).select(*keep, F.col("y_test").alias("label"), "one.*")


def subsets(long: DataFrame, keys: list[str], min_positive: int = 5) -> DataFrame:
    """ROC area, size and positive rate of every model in every value of each key, told apart by ``subset``.

    Values with fewer positives than ``min_positive``, or without negatives, have no row.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("subset"), F.col(k).cast("long").alias("value")) for k in keys]))
    rows = long.select("model", "label", "score", each.alias("one")).select("model", "label", "score", "one.*")
    found = mt.rank_metrics(rows.filter(F.col("value").isNotNull()), ["model", "subset", "value"], "label", "score")
    n = F.col("positives") + F.col("negatives")
    return (found.filter((F.col("positives") >= min_positive) & (F.col("negatives") > 0))
            .select("model", "subset", "value", "auc_roc", n.alias("n_samples"), (F.col("positives") / n).alias("pos_rate")))


def comparison(long: DataFrame, folds: DataFrame) -> DataFrame:
    """Test measures of every model beside the mean and deviation of its folds."""
    spread = folds.groupBy("model").agg(
        F.avg("auc_roc").alias("cv_auc_mean"), F.stddev_pop("auc_roc").alias("cv_auc_std"),
        F.avg("avg_precision").alias("cv_ap_mean"), F.stddev_pop("avg_precision").alias("cv_ap_std"))
    return evaluate(long, ["model"]).drop("positives", "negatives").join(spread, "model", "left")


def at_youden(long: DataFrame) -> DataFrame:
    """Confusion counts of every model at the threshold that maximises sensitivity plus specificity."""
    best = mt.rank_metrics(long, ["model"], "label", "score").select("model", "optimal_threshold")
    counts = mt.confusion(long.join(best, "model"), ["model"], "label", "score", F.col("optimal_threshold"))
    return counts.join(best, "model")
