"""Model metrics over (keys, y, score) frames, computed by Spark at any size.

Rank metrics first reduce the frame to one row per distinct score, so their cost follows the number of
distinct scores, and take running totals from ``ordered_totals``. ``keys`` may name models, regions or
years; every function then returns one result per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as fc
from ..functions import stats as st
from ..functions.fixed_values import PROBABILITY_EDGES
from .ordered import grouped_stats, ordered_totals


# ---- regression -----------------------------------------------------------------------------------
def regression_metrics(df: DataFrame, keys: list[str], y: str, predicted: str, mape_positive_only: bool = True) -> DataFrame:
    """RMSE, MAE, R2 and MAPE. MAPE covers y > 0, or y <> 0 when ``mape_positive_only`` is off."""
    a, p = F.col(y).cast("double"), F.col(predicted).cast("double")
    error = a - p
    counted = F.when((a > 0) if mape_positive_only else (a != 0), F.abs(error / a))
    sums = df.groupBy(*keys).agg(F.avg(error * error).alias("_mse"), F.avg(F.abs(error)).alias("mae"),
                                 F.var_pop(a).alias("_var"), (F.avg(counted) * 100).alias("mape"), F.count(a).alias("n"))
    return sums.select(*keys, F.sqrt("_mse").alias("rmse"), "mae", (1 - F.try_divide("_mse", "_var")).alias("r2"), "mape", "n")


def residuals(df: DataFrame, y: str, predicted: str, scale: float) -> DataFrame:
    """Raw and scaled residuals. The scaling divides by the square root of prediction times scale."""
    a, p = F.col(y), F.col(predicted)
    scaled = (a - p) / F.sqrt(p * F.lit(scale))
    return df.withColumns({"residual": a - p, "pearson_residual": scaled, "sqrt_abs_residual": F.sqrt(F.abs(scaled)),
                           "abs_pct_error": F.abs((a - p) / F.when(a > 0, a).otherwise(1.0)) * 100})


def qq_points(df: DataFrame, keys: list[str], value: str, order: list[Column], low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Sorted values against normal quantiles on an even grid of probabilities."""
    from .ordered import positions
    known = df.filter(F.col(value).isNotNull())
    placed = positions(known, keys, [F.col(value), *order], name="place")
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if keys else None
    sized = placed.join(sizes, keys) if keys else placed.withColumn("_n", known.agg(F.count(F.lit(1))).scalar())
    p = F.lit(low) + (F.col("place") - 1) * (F.lit(high - low) / F.greatest(F.col("_n") - 1, F.lit(1)))
    return sized.select(*keys, "place", F.col(value).alias("sample"), st.normal_quantile(p).alias("theoretical"))


# ---- ranking --------------------------------------------------------------------------------------
def by_score(df: DataFrame, keys: list[str], y: str, score: str, **options) -> DataFrame:
    """One row per distinct score with counts at this score, at or above it, and in total."""
    known = df.filter(F.col(y).isNotNull() & F.col(score).isNotNull())
    counted = known.groupBy(*keys, F.col(score).cast("double").alias("threshold")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    placed = ordered_totals(counted, keys, "threshold", ["pos", "neg"], **options)
    return placed.select(*keys, "threshold", "pos", "neg",
                         (F.col("tot_pos") - F.col("cum_pos") + F.col("pos")).alias("tp"),
                         (F.col("tot_neg") - F.col("cum_neg") + F.col("neg")).alias("fp"),
                         F.col("tot_pos").alias("p"), F.col("tot_neg").alias("n"))


def roc_curve(df: DataFrame, keys: list[str], y: str, score: str, **options) -> DataFrame:
    """False and true positive rate at every distinct score, and the origin (NULL threshold)."""
    points = by_score(df, keys, y, score, **options)
    curve = points.select(*keys, "threshold", F.try_divide("fp", "n").alias("fpr"), F.try_divide("tp", "p").alias("tpr"))
    origin = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    return curve.unionByName(origin.select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def pr_curve(df: DataFrame, keys: list[str], y: str, score: str, **options) -> DataFrame:
    """Precision and recall at every distinct score, and the end point (1, 0)."""
    points = by_score(df, keys, y, score, **options)
    curve = points.select(*keys, "threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "p").alias("recall"))
    end = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    return curve.unionByName(end.select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")))


def rank_metrics(df: DataFrame, keys: list[str], y: str, score: str, **options) -> DataFrame:
    """Tie-aware ROC area, average precision, Youden threshold and class counts in one pass.

    NULL areas mean that a class is missing.
    """
    points = by_score(df, keys, y, score, **options)
    wide = F.col("pos").cast("double") * (F.col("n") - F.col("fp") + F.col("neg") / 2.0)
    step = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    # tp/p - fp/n compared without division, so that equal points stay equal.
    gain = F.col("tp").cast("decimal(18,0)") * F.col("n").cast("decimal(18,0)") - F.col("fp").cast("decimal(18,0)") * F.col("p").cast("decimal(18,0)")
    sums = points.groupBy(*keys).agg(
        F.sum(wide).alias("_area"), F.sum(step).alias("_steps"), F.max("p").alias("positives"), F.max("n").alias("negatives"),
        F.max_by("threshold", F.struct(gain.alias("g"), F.col("threshold").alias("t"))).alias("optimal_threshold"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return sums.select(*keys, F.when(both, F.col("_area") / pairs).alias("auc_roc"),
                       F.when(F.col("positives") > 0, F.col("_steps") / F.col("positives")).alias("avg_precision"),
                       "optimal_threshold", "positives", "negatives")


# ---- at a threshold -------------------------------------------------------------------------------
def confusion(df: DataFrame, keys: list[str], y: str, score: str, threshold: Column | float) -> DataFrame:
    hit = F.col(score) >= (threshold if isinstance(threshold, Column) else F.lit(threshold))
    yes = F.col(y) == 1
    return df.groupBy(*keys).agg(F.count_if(~yes & ~hit).alias("tn"), F.count_if(~yes & hit).alias("fp"),
                                 F.count_if(yes & ~hit).alias("fn"), F.count_if(yes & hit).alias("tp"))


def _safe(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(n, d), F.lit(0.0))


def f1(counts: DataFrame, keys: list[str]) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(*keys, _safe(2 * tp, 2 * tp + fp + fn).alias("f1_score"))


def classification_report(counts: DataFrame, names: tuple[str, str] = ("0", "1")) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, and plain and weighted averages."""
    c = {k: F.col(k).cast("double") for k in ("tn", "fp", "fn", "tp")}

    def row(hit: Column, wrong: Column, missed: Column) -> dict[str, Column]:
        return {"precision": _safe(hit, hit + wrong), "recall": _safe(hit, hit + missed),
                "f1": _safe(2 * hit, 2 * hit + wrong + missed), "support": hit + missed}

    zero, one = row(c["tn"], c["fn"], c["fp"]), row(c["tp"], c["fp"], c["fn"])
    n = zero["support"] + one["support"]
    fields = ("precision", "recall", "f1")
    lines = {names[0]: zero, names[1]: one,
             "accuracy": {**{f: _safe(c["tn"] + c["tp"], n) for f in fields}, "support": n},
             "macro avg": {**{f: (zero[f] + one[f]) / 2 for f in fields}, "support": n},
             "weighted avg": {**{f: _safe(zero[f] * zero["support"] + one[f] * one["support"], n) for f in fields}, "support": n}}
    packed = counts.select(*[F.struct(*[v.alias(k) for k, v in line.items()]).alias(name) for name, line in lines.items()])
    return packed.unpivot([], [f"`{name}`" for name in lines], "class", "r").select("class", "r.*")


# ---- probabilities --------------------------------------------------------------------------------
def brier(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.pow(F.col(score) - F.col(y), 2)).alias("brier_score"))


def _edges_below(p: Column, strict: bool) -> Column:
    """How many inner edges lie below p (or at it, when not strict)."""
    inner = PROBABILITY_EDGES[1:-1]
    return sum((F.when((p > e) if strict else (p >= e), 1).otherwise(0) for e in inner), F.lit(0))


def calibration_curve(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Observed and predicted rate per probability bin (bins closed on the right), non-empty bins numbered from 1."""
    from pyspark.sql import Window
    p = F.col(score)
    bins = (df.filter(p.isNotNull() & F.col(y).isNotNull()).withColumn("_slot", _edges_below(p, strict=True)).groupBy(*keys, "_slot")
            .agg(F.avg(y).alias("fraction_positive"), F.avg(p).alias("mean_predicted"), F.count(F.lit(1)).alias("n")))
    # At most ten rows per key.
    place = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_slot"))
    return bins.withColumn("bin", place).drop("_slot")


def expected_calibration_error(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Weighted gap between observed and predicted rate; bins closed on the left, a score of exactly 1 in none."""
    p = F.col(score)
    bins = (df.withColumn("_slot", F.when(p < PROBABILITY_EDGES[-1], _edges_below(p, strict=False))).groupBy(*keys, "_slot")
            .agg(F.count(F.lit(1)).alias("_n"), F.abs(F.avg(y) - F.avg(p)).alias("_gap"), F.sum(F.pow(p - F.col(y), 2)).alias("_sq")))
    return bins.groupBy(*keys).agg(
        (F.coalesce(F.sum(F.when(F.col("_slot").isNotNull(), F.col("_n") * F.col("_gap"))), F.lit(0.0)) / F.sum("_n")).alias("ece"),
        (F.sum("_sq") / F.sum("_n")).alias("brier_score"))


# ---- distributions --------------------------------------------------------------------------------
def ks_two_sample(df: DataFrame, features: list[str], in_first: Column, min_rows: int = 10, **options) -> DataFrame:
    """Largest gap between two empirical distributions, per feature, with means and deviations."""
    tall = (df.select(in_first.cast("int").alias("_a"), *[fc.no_nan(c).alias(c) for c in features])
            .unpivot(["_a"], features, "feature", "value").filter(F.col("value").isNotNull() & F.col("_a").isNotNull()))
    counted = tall.groupBy("feature", "value").agg(F.sum("_a").alias("a"), F.sum(1 - F.col("_a")).alias("b"))
    placed = ordered_totals(counted, ["feature"], "value", ["a", "b"], **options)
    gaps = placed.groupBy("feature").agg(
        F.max(F.abs(F.try_divide("cum_a", "tot_a") - F.try_divide("cum_b", "tot_b"))).alias("ks_statistic"),
        F.max("tot_a").alias("n_train"), F.max("tot_b").alias("n_test"))
    first, second = F.when(F.col("_a") == 1, F.col("value")), F.when(F.col("_a") == 0, F.col("value"))
    moments = tall.groupBy("feature").agg(F.avg(first).alias("train_mean"), F.stddev_pop(first).alias("train_std"),
                                          F.avg(second).alias("test_mean"), F.stddev_pop(second).alias("test_std"))
    p = st.kolmogorov_pvalue("ks_statistic", "n_train", "n_test")
    return (gaps.filter((F.col("n_train") >= min_rows) & (F.col("n_test") >= min_rows)).join(moments, "feature")
            .withColumn("ks_pvalue", p).withColumn("significant_shift", F.col("ks_pvalue") < 0.05))


# ---- subsets and folds ----------------------------------------------------------------------------
def subset_performance(df: DataFrame, key: str, y: str, score: str, min_positive: int = 5) -> DataFrame:
    """ROC area, size and positive rate per subset; subsets with too few positives are left out."""
    found = rank_metrics(df.filter(F.col(key).isNotNull()), [key], y, score)
    n = F.col("positives") + F.col("negatives")
    return (found.filter((F.col("positives") >= min_positive) & (F.col("negatives") > 0))
            .select(key, "auc_roc", n.alias("n_samples"), (F.col("positives") / n).alias("pos_rate")))


def fold_metrics(df: DataFrame, fold: str, y: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Per-fold rank metrics, F1 at a threshold, and the distribution of the scores."""
    ranks = rank_metrics(df, [fold], y, score).select(fold, "auc_roc", "avg_precision")
    at = f1(confusion(df, [fold], y, score, threshold), [fold])
    spread = df.groupBy(fold).agg(F.avg(score).alias("pred_mean"), F.stddev_pop(score).alias("pred_std"), F.count(F.lit(1)).alias("n_val"), F.avg(y).alias("pos_rate"))
    middle = grouped_stats(df, [fold], score, {"pred_median": 0.5}).select(fold, "pred_median")
    return ranks.join(at, fold).join(spread, fold).join(middle, fold)


def mean_and_std(folds: DataFrame, metrics: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    return folds.groupBy(*keys).agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics], *[F.stddev_samp(m).alias(f"std_{m}") for m in metrics])


def with_summary_row(folds: DataFrame, fold: str, formatted: list[str], averaged: list[str]) -> DataFrame:
    """Fold rows as text plus one row ``mean±std``."""
    summary = folds.agg(
        *[F.format_string("%.3f±%.3f", F.avg(m), F.stddev_samp(m)).alias(m) for m in formatted],
        *[F.avg(m).alias(m) for m in averaged]).withColumn(fold, F.lit("mean±std"))
    text = folds.select(F.col(fold).cast("string").alias(fold), *[F.format_string("%.3f", F.col(m)).alias(m) for m in formatted], *averaged)
    return text.unionByName(summary)
