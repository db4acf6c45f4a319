"""Boosted and bagged trees for the risk label."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..operators import metrics as mt
from ..operators import splits as sp
from ..session import scratch_path
from ..sources.sinks import write_stage
from . import features as ft
from .glm import Prepared, with_score
from .together import AT_ONCE, beside, sized, storage_memory, together
from .treefits import fit_boosting, fit_forest


@dataclass(frozen=True)
class TreeSettings:
    """Tree sizes. The defaults suit full panels; small data is served by smaller ones."""

    trees: int = 300
    depth: int = 5
    rate: float = 0.1
    subsample: float = 0.8
    min_leaf: int = 20
    subset: str = "sqrt"
    seed: int = 42


BOOSTING = TreeSettings()
FOREST = TreeSettings(trees=500, depth=10, subsample=1.0)
#: Memory for the histograms of a level, in MB: with the default, deep levels of many trees take several passes.
HISTOGRAMS = 1024
#: The full grids of the parameter search.
BOOSTING_GRID = {"maxIter": [200, 300, 500], "maxDepth": [3, 5, 7], "stepSize": [0.05, 0.1]}
FOREST_GRID = {"numTrees": [300, 500], "maxDepth": [8, 10, 15], "featureSubsetStrategy": ["sqrt", "log2"]}


def prepare(labelled: DataFrame, features: list[str] = fv.PREDICTIVE_FEATURES, label: str = "uninsurability_risk",
            cut: int = fv.TRAIN_YEAR_MAX, regions: bool = True, keep: tuple[str, ...] = ("county_fips", "year", "state", "fema_region"),
            train_rows=None, fill: dict | None = None) -> Prepared:
    """Region indicators, median imputation fitted on the training rows, split and assembly.

    ``train_rows`` overrides the temporal rule that marks the training part, ``fill`` the medians.
    """
    wide = ft.region_dummies(labelled)
    names = ft.available(wide, features) + ([f"fema_region_{r}" for r in fv.REGIONS] if regions else [])
    kept = [c for c in keep if c in wide.columns]
    in_train = train_rows if train_rows is not None else F.col("year") <= cut
    rows = wide.select(*kept, F.col(label).cast("double").alias("label"),
                       F.when(in_train, "train").otherwise("test").alias("split"),
                       *[F.col(n).cast("double").alias(n) for n in names if n not in kept])
    if fill is None:
        fill = ft.medians(rows.filter(F.col("split") == "train"), numeric_features(labelled, features))
    filled = ft.impute(rows, fill)
    return Prepared(ft.assemble(filled, names), names)


def numeric_features(df: DataFrame, features: list[str] = fv.PREDICTIVE_FEATURES) -> list[str]:
    return ft.available(df, features)


def boosting(s: TreeSettings = BOOSTING) -> GBTClassifier:
    return GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=s.trees, maxDepth=s.depth,
                         stepSize=s.rate, subsamplingRate=s.subsample, minInstancesPerNode=s.min_leaf,
                         featureSubsetStrategy=s.subset, seed=s.seed, maxMemoryInMB=HISTOGRAMS)


def forest(s: TreeSettings = FOREST) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=s.trees, maxDepth=s.depth,
                                  subsamplingRate=s.subsample, minInstancesPerNode=s.min_leaf,
                                  featureSubsetStrategy=s.subset, seed=s.seed, maxMemoryInMB=HISTOGRAMS)


def remembering(estimator, rows: DataFrame, fits: int | None = None, trees: int | None = None):
    """``estimator``, told to keep the node of every row in every tree where half of the storage memory holds that.

    Without it, a forest walks every row through all its trees again for each level; the trees that come out are the same.
    Two levels of node numbers of all ``fits`` at once are under way. They can be made again from the rows, so no
    checkpoint of them is written. A boosting has one shallow tree at a time and is left as it is.
    """
    if not isinstance(estimator, RandomForestClassifier):
        return estimator
    each = 4 * 2 * rows.count() * (trees or estimator.getNumTrees())
    fits_in = each * (fits or beside()) <= storage_memory(rows.sparkSession) / 2
    return estimator.copy({estimator.cacheNodeIds: True, estimator.checkpointInterval: -1}) if fits_in else estimator


def grown(estimator, rows: DataFrame):
    """``estimator.fit(rows)``, in a few long tasks instead of thousands of short ones."""
    return (fit_boosting if isinstance(estimator, GBTClassifier) else fit_forest)(estimator, rows)


def fit(estimator, train: DataFrame):
    """Fit with balanced class weights on cached rows."""
    read = train.select("label", "features").persist()
    weighted = None
    try:
        weighted = ft.with_balanced_weight(sized(read), "label").select("label", "weight", "features").persist()
        return ft.without_summary(grown(remembering(estimator, read), weighted))
    finally:
        for rows in (weighted, read):
            if rows is not None:
                rows.unpersist()


def first_trees(model: GBTClassificationModel, count: int) -> GBTClassificationModel:
    """The boosting that ended after ``count`` rounds: tree n depends on the trees before it and the seed only."""
    java, context = model._java_obj, SparkContext._active_spark_context
    jvm, new_array = context._jvm, context._gateway.new_array
    trees = new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, count)
    weights = new_array(jvm.double, count)
    known, given = java.trees(), java.treeWeights()
    for place in range(count):
        trees[place], weights[place] = known[place], given[place]
    made = jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), trees, weights, java.numFeatures(), java.numClasses())
    kept = GBTClassificationModel(made)
    for name in ("labelCol", "featuresCol", "predictionCol", "rawPredictionCol", "probabilityCol"):
        kept._set(**{name: model.getOrDefault(name)})
    kept._transfer_params_to_java()
    return kept


def evaluate(scored: DataFrame, keys: list[str]) -> DataFrame:
    """ROC area, average precision, Brier score, Youden threshold and F1 at it, per key."""
    ranks = mt.rank_metrics(scored, keys, "label", "score")
    at = scored.join(ranks.select(*keys, "optimal_threshold"), keys)
    f1 = mt.f1(mt.confusion(at, keys, "label", "score", F.col("optimal_threshold")), keys)
    return ranks.join(mt.brier(scored, keys, "label", "score"), keys).join(f1, keys)


def cross_validate(data: DataFrame, estimator, keys: list[str], k: int = 5, seed: int = 42, name: str = "model") -> DataFrame:
    """Stratified folds; every fold is scored by a model that has not seen it, and all are measured together.

    ``estimator`` is a classifier, fitted with balanced class weights, or a function from training rows to a model.
    """
    folded = write_stage(sp.kfold(data, keys, k, seed, within=["label"]), scratch_path(data.sparkSession, "folds"))

    def scored(fold: int) -> DataFrame:
        rows = folded.filter(F.col("fold") != fold)
        model = estimator(rows) if callable(estimator) else fit(estimator, rows)
        return with_score(model, folded.filter(F.col("fold") == fold)).select("fold", "label", "score")

    parts = together([lambda fold=fold: scored(fold) for fold in range(1, k + 1)])
    return mt.fold_metrics(reduce(lambda a, b: a.unionByName(b), parts), "fold", "label", "score").withColumn("model", F.lit(name))


def _shared_fits(grid: dict[str, list]) -> list[tuple[dict, list[int]]]:
    """Parameter sets that need a fit of their own, and the numbers of rounds that each one serves."""
    rounds = grid.get("maxIter")
    rest = [{}]
    for param, values in grid.items():
        if param != "maxIter":
            rest = [{**chosen, param: value} for chosen in rest for value in values]
    return [({**chosen, "maxIter": max(rounds)}, sorted(rounds)) if rounds else (chosen, []) for chosen in rest]


def grid_search(train: DataFrame, estimator, grid: dict[str, list], keys: list[str], k: int = 3, refit: bool = True):
    """Ranked mean ROC area of every parameter combination over stratified folds; returns model and table.

    Boosting with fewer rounds is the start of the same boosting with more, so one fit serves all values of ``maxIter``:
    its first trees are scored on their own. All fits of all folds run together. ``refit`` fits the best combination on
    all rows; without it, the model is None.
    """
    folded = sized(sp.kfold(ft.with_balanced_weight(train, "label"), keys, k, within=["label"]).select(
        "label", "weight", "features", "fold").persist(), fits=AT_ONCE).persist()
    measure = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction")
    kept = remembering(estimator, folded, min(AT_ONCE, k * len(_shared_fits(grid))), max(grid.get("numTrees", [0])))

    def areas(params: dict, rounds: list[int], fold: int) -> list[tuple[tuple, float]]:
        held = folded.filter(F.col("fold") == fold)
        chosen = kept.copy({kept.getParam(name): value for name, value in params.items()})
        model = ft.without_summary(grown(chosen, folded.filter(F.col("fold") != fold)))
        models = [({**params, "maxIter": count}, first_trees(model, count)) for count in rounds] or [(params, model)]
        return [(tuple(sorted(own.items())), measure.evaluate(one.transform(held))) for own, one in models]

    # The longest first, so that none of them is left to run alone at the end.
    jobs = sorted(_shared_fits(grid), key=lambda job: -job[0].get("maxDepth", 0) * max(job[0].get("maxIter", 0), job[0].get("numTrees", 0)))
    try:
        found = together([lambda p=params, r=rounds, f=fold: areas(p, r, f) for params, rounds in jobs for fold in range(1, k + 1)])
    finally:
        folded.unpersist()
    by_params: dict[tuple, list[float]] = {}
    for own, area in (pair for part in found for pair in part):
        by_params.setdefault(own, []).append(area)
    rows = []
    for own, values in by_params.items():
        mean = sum(values) / k
        rows.append((", ".join(f"{name}={value}" for name, value in own), mean, (sum((v - mean) ** 2 for v in values) / k) ** 0.5, own))
    rows.sort(key=lambda row: (-row[1], row[0]))
    table = train.sparkSession.createDataFrame([(*row[:3], place + 1) for place, row in enumerate(rows)],
                                               "params string, mean_test_score double, std_test_score double, rank_test_score int")
    best = {estimator.getParam(name): value for name, value in rows[0][3]}
    return (fit(estimator.copy(best), train) if refit else None), table


def importance(models: dict[str, object], features: list[str]) -> DataFrame:
    """Impurity importance of each feature, one column per model."""
    from pyspark.sql import SparkSession
    columns = {name: m.featureImportances.toArray() for name, m in models.items()}
    rows = [(f, *[float(v[i]) for v in columns.values()]) for i, f in enumerate(features)]
    schema = "feature string, " + ", ".join(f"{name} double" for name in columns)
    return SparkSession.active().createDataFrame(rows, schema)
