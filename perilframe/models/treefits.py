"""Spark's boosted classifier, grown by ``growing.py`` in one task, or in one a partition for many rows.

Thresholds are found by Spark's own code, and the trees become a model of Spark's, so scoring, saving and importances are as before.
"""

from __future__ import annotations

import json
import pickle
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from . import growing
from .together import MOST_ROWS, beside

#: How often a round is begun again from the trees before an error is raised.
RETRIES = 3
#: Rows up to which every task of a forest holds all of them: with 40 features, 160 MB.
MOST_IN_ALL = 4_000_000

_NODE = ("treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,"
         "leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>")


def _candidates(estimator, rows: DataFrame, numeric: bool, trees: int, subset: str) -> tuple[list[np.ndarray], int, int]:
    """Spark's thresholds of every feature, features wanted at a node, and the number of rows. Rows are checked on the way, as in its fit."""
    jvm = rows._sc._jvm
    estimator._transfer_params_to_java()
    inner = jvm.org.apache.spark.ml.tree.impl
    utils, forests = (getattr(getattr(package, f"{name}$"), "MODULE$") for package, name in ((jvm.org.apache.spark.ml.util, "DatasetUtils"), (inner, "RandomForest")))
    instances = utils.extractInstances(estimator._java_obj, rows._jdf, jvm.scala.Option.apply(2))
    tree = jvm.org.apache.spark.mllib.tree
    algo, impurity = ("Regression", "Variance") if numeric else ("Classification", "Gini")
    strategy = tree.configuration.Strategy(getattr(tree.configuration.Algo, algo)(), getattr(tree.impurity, impurity).instance(),
                                           estimator.getMaxDepth(), 2, estimator.getMaxBins(), jvm.java.util.HashMap())
    metadata = inner.DecisionTreeMetadata.buildMetadata(instances, strategy, trees, subset)
    found = forests.findSplits(instances, metadata, estimator.getSeed())
    return [np.array([split.threshold() for split in splits]) for splits in found], metadata.numFeaturesPerNode(), metadata.numExamples()


def _binned(thresholds: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per batch and partition: a byte per feature, labels and weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy()
            if not len(part):
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(part), len(thresholds))
            bins = np.empty(x.shape, np.uint8)
            for feature, limits in enumerate(thresholds):
                bins[:, feature] = np.searchsorted(limits, x[:, feature])
            label, weight = (batch.column(c).to_numpy().astype(float) for c in ("label", "weight"))
            # Several partitions may share a batch where they were put into one task; each of them is a run of rows.
            ends = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
            runs = list(zip(ends[:-1], ends[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(part[a]) for a, _ in runs], pa.int32()), *[pa.array([v[a:b].tobytes() for a, b in runs], pa.binary())
                                                                          for v in (bins, label, weight)]], ["part", "bins", "label", "weight"])
    return run


def _held(batches: Iterator, n_features: int) -> growing.Rows:
    """What arrives in a task, in the order of the partitions and of the rows in each."""
    found: dict[int, list[tuple]] = {}
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("part", "bins", "label", "weight"))) if isinstance(batch, pa.RecordBatch) else [batch]
        for row in rows:
            found.setdefault(row[0], []).append(row[1:])
    ordered = [(part, piece) for part in sorted(found) for piece in found[part]]
    bins, label, weight = (np.frombuffer(b"".join(piece[k] for _, piece in ordered), kind)
                           for k, kind in enumerate((np.uint8, np.float64, np.float64)))
    return growing.Rows(np.ascontiguousarray(bins.reshape(-1, n_features).T), label, weight,
                        [(part, sum(len(piece[1]) for piece in found[part]) // 8) for part in sorted(found)])


def _alone(thresholds: list[np.ndarray], settings: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = growing.boost(_held(batches, len(thresholds)), thresholds, **settings)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trees)], pa.binary())], ["trees"])
    return run


@dataclass
class _State:
    """The rows of a task between two rounds, packed to be handed on: weights are the few that classes have."""

    bins: np.ndarray
    label: np.ndarray
    code: np.ndarray
    weights: np.ndarray
    parts: list[tuple[int, int]]
    known: np.ndarray | None = None
    inside: np.ndarray | None = None

    def rows(self) -> growing.Rows:
        return growing.Rows(self.bins, self.label.astype(float), self.weights[self.code], self.parts)


def _states(n_features: int):
    def run(found: Iterator) -> Iterator[_State]:
        rows = _held(found, n_features)
        if rows.parts:
            weights, code = np.unique(rows.weight, return_inverse=True)
            yield _State(rows.bins, rows.label.astype(np.uint8), code.astype(np.min_scalar_type(len(weights))), weights, rows.parts)
    return run


def _advanced(trees: list[tuple[dict, dict]], first: int, rate: float, subsample: float, seed: int):
    """States with the predictions of ``trees`` added, of which the first has the number ``first``, and with the draws of the round after them."""
    def one(s: _State) -> _State:
        known = s.known if first else None
        for splits, values in trees:
            known = growing.moved(known, growing.steps(s.bins, splits, values), rate)
        return replace(s, known=known, inside=growing.taken(s.parts, seed + first + len(trees), subsample))
    return one


def _sums(splits: dict, stack: list[int], features: np.ndarray, width: int):
    def one(s: _State) -> tuple[int, np.ndarray]:
        return s.parts[0][0], growing.Round(s.rows(), s.known, s.inside).sums(splits, stack, features, width)
    return one


def _shared(binned: DataFrame, thresholds: list[np.ndarray], settings: dict) -> list[growing.Tree]:
    """Boosting in one task a partition: the driver adds up their sums and picks the splits of each level.

    Predictions go from round to round as cached rows without a lineage, which would grow with every round. Where some of them
    are lost with an executor, they are made again from the trees.
    """
    n_splits = np.array([len(t) for t in thresholds])
    width, seed = int(n_splits.max(initial=0)) + 1, settings["seed"]
    passed_on = {name: settings[name] for name in ("rate", "subsample", "seed")}
    start = binned.rdd.map(lambda r: (r["part"], bytes(r["bins"]), bytes(r["label"]), bytes(r["weight"]))).mapPartitions(_states(len(thresholds)))
    start.persist(StorageLevel.MEMORY_AND_DISK)
    state, grown, failed = start, [], 0
    growths: list[growing.Growth] = []
    try:
        while len(growths) < settings["rounds"]:
            number = len(growths)
            kept = state
            state = (state.map(_advanced(grown[-1:], max(number - 1, 0), **passed_on)) if not failed
                     else start.map(_advanced(list(grown), 0, **passed_on))).persist(StorageLevel.MEMORY_AND_DISK)
            state.localCheckpoint()

            def added(above: dict, stack: list[int], features: np.ndarray, state=state) -> np.ndarray:
                found = sorted(state.map(_sums(dict(above), stack, features, width)).collect(), key=lambda pair: pair[0])
                total = found[0][1]
                for _, more in found[1:]:
                    total = total + more
                return total

            try:
                growth = growing.grow(n_splits, settings["depth"], settings["least"], settings["wanted"], seed + number, added)
            except Py4JJavaError:
                if (failed := failed + 1) > RETRIES:
                    raise
                continue
            finally:
                if kept is not start:
                    kept.unpersist()
            failed = 0
            growths.append(growth)
            grown.append((growth.split, growth.leaf_values()))
    finally:
        state.unpersist()
        start.unpersist()
    return [growth.pruned(thresholds) for growth in growths]


def fit_boosting(estimator: GBTClassifier, rows: DataFrame, alone: int = MOST_ROWS) -> GBTClassificationModel:
    """``estimator.fit(rows)`` with the same draws, so the same trees but for the order in which sums are added.

    ``rows`` are cached, with label, weight and features. Up to ``alone`` rows are fitted in one task,
    more of them in one task a partition.
    """
    thresholds, wanted, count = _candidates(estimator, rows, True, 1, estimator.getFeatureSubsetStrategy())
    binned = _binned_rows(rows, thresholds)
    settings = {"rounds": estimator.getMaxIter(), "depth": estimator.getMaxDepth(), "rate": estimator.getStepSize(), "subsample": estimator.getSubsamplingRate(),
                "least": estimator.getMinInstancesPerNode(), "wanted": wanted, "seed": estimator.getSeed()}
    if count > alone:
        trees = _shared(binned, thresholds, settings)
    else:
        trees = pickle.loads(binned.coalesce(1).mapInArrow(_alone(thresholds, settings), "trees binary").collect()[0]["trees"])
    weights = [1.0] + [estimator.getStepSize()] * (len(trees) - 1)
    return _model(estimator, GBTClassificationModel, trees, weights, len(thresholds), rows)


def _binned_rows(rows: DataFrame, thresholds: list[np.ndarray]) -> DataFrame:
    return rows.select(F.spark_partition_id().alias("part"), F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"),
                       vector_to_array("features").alias("x")).mapInArrow(_binned(thresholds), "part int, bins binary, label binary, weight binary")


def _drawn(rows: DataFrame, trees: int, rate: float, seed: int) -> DataFrame:
    """The number ``row * trees + tree`` once for every time that a row is in a tree; rows have Spark's rising numbers.

    Spark's fit draws these from a Poisson distribution, row by row, with a generator per partition. So does its stratified sample.
    """
    spark, jvm = rows.sparkSession, rows._sc._jvm
    encoders = jvm.org.apache.spark.sql.Encoders
    places = rows.select(F.monotonically_increasing_id().alias("row")).select(F.lit(0).alias("_1"), "row", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select(
        "_1", (F.col("row") * trees + F.col("tree")).alias("_2"))
    pairs = jvm.org.apache.spark.api.java.JavaPairRDD.fromJavaRDD(getattr(places._jdf, "as")(encoders.tuple(encoders.INT(), encoders.LONG())).toJavaRDD())
    means = jvm.java.util.HashMap()
    means.put(0, float(rate))
    drawn = pairs.sampleByKey(True, means, seed + 1).values()
    return DataFrame(spark._jsparkSession.createDataset(drawn.rdd(), encoders.LONG()).toDF(), spark)


#: Rows whose counts are handed on at once.
_STEP = 10_000


def _tallied(trees: int):
    """Drawn numbers as counts: (partition, first row, a byte per row and tree)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, base, size = 0, 0, _STEP * trees
        counts = np.zeros(size, np.uint8)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([base], pa.int64()), pa.array([counts.tobytes()], pa.binary())], ["part", "base", "counts"])

        for batch in batches:
            v = batch.column(0).to_numpy()
            if len(v):
                part = int(v[0]) // trees >> 33
                v = v - (part << 33) * trees
            while len(v):
                here = v[:np.searchsorted(v, base * trees + size)] - base * trees
                # The numbers rise, so equal ones are side by side.
                ends = np.append(np.flatnonzero(np.diff(here)), len(here) - 1) if len(here) else np.empty(0, int)
                counts[here[ends]] += np.diff(ends, prepend=-1).astype(np.uint8)
                v = v[len(here):]
                if len(v):
                    yield out()
                    counts, base = np.zeros(size, np.uint8), base + _STEP
        yield out()
    return run


def _wood(n_features: int, trees: int, groups: int):
    """All rows, and then the counts of each tree of one group, from what was dealt to it."""
    def run(found: Iterator) -> Iterator[tuple]:
        binned, counted, group = [], {}, None
        for group, (kind, row) in found:
            if kind == "rows":
                binned.append(row)
            else:
                counted.setdefault(row[0], []).append(row[1:])
        if group is None:
            return
        rows = _held(binned, n_features)
        own = range(group, trees, groups)
        yield None, rows
        for place, tree in enumerate(own):
            count = np.zeros(len(rows.label), np.uint8)
            start = 0
            for part, n in rows.parts:
                for base, counts in counted.get(part, []):
                    size = min(n - base, len(counts) // len(own))
                    count[start + base:start + base + size] = np.frombuffer(counts, np.uint8, size, place * (len(counts) // len(own)))
                start += n
            yield tree, count
    return run


def _dealt_counts(trees: int, groups: int):
    def run(row) -> list:
        counts = np.frombuffer(bytes(row["counts"]), np.uint8).reshape(-1, trees)
        return [(g, ("counts", (row["part"], row["base"], np.ascontiguousarray(counts[:, g::groups].T).tobytes()))) for g in range(groups)]
    return run


def _split(given: dict, number_of_splits: np.ndarray, least: int, wanted: int):
    """Best splits of the open nodes of each tree of a task; one tree is held at a time."""
    def run(found: Iterator[tuple]) -> Iterator[tuple[int, growing.Best]]:
        rows = None
        for tree, held in found:
            if tree is None:
                rows = held
            elif tree in given:
                yield tree, growing.split_nodes(rows, held, *given[tree], number_of_splits, least, wanted)
    return run


def fit_forest(estimator: RandomForestClassifier, rows: DataFrame, most: int = MOST_IN_ALL) -> RandomForestClassificationModel:
    """``estimator.fit(rows)`` with the same draws. Trees are dealt over as many tasks as there are cores, each of which holds all rows.

    Beyond ``most`` rows they would not fit there, and Spark's own fit is taken, as for samples without replacement.
    """
    trees, seed = estimator.getNumTrees(), estimator.getSeed()
    thresholds, wanted, count = _candidates(estimator, rows, False, trees, estimator.getFeatureSubsetStrategy())
    if count > most or not estimator.getBootstrap():
        return estimator.fit(rows)
    context = rows.sparkSession.sparkContext
    groups = min(trees, max(1, -(-2 * context.defaultParallelism // beside()) if beside() > 1 else context.defaultParallelism))
    binned = _binned_rows(rows, thresholds).rdd.map(lambda r: (r["part"], bytes(r["bins"]), bytes(r["label"]), bytes(r["weight"])))
    counts = _drawn(rows, trees, estimator.getSubsamplingRate(), seed).mapInArrow(_tallied(trees), "part int, base bigint, counts binary").rdd
    dealt = context.union([binned.flatMap(lambda r: [(g, ("rows", r)) for g in range(groups)]), counts.flatMap(_dealt_counts(trees, groups))])
    wood = dealt.partitionBy(groups, lambda g: g).mapPartitions(_wood(len(thresholds), trees, groups)).persist(StorageLevel.MEMORY_AND_DISK)
    n_splits = np.array([len(t) for t in thresholds])
    forest = growing.Forest(trees, estimator.getMaxDepth(), seed, n_splits, wanted, estimator.getMaxMemoryInMB() * 2**20)
    try:
        while forest.stack:
            given = forest.taken()
            asked = {tree: (numbers, seeds, forest.own(tree, numbers), dict(forest.growths[tree].split)) for tree, (numbers, seeds) in given.items()}
            found = wood.mapPartitions(_split(asked, n_splits, estimator.getMinInstancesPerNode(), wanted)).collect()
            forest.put(given, dict(found))
    finally:
        wood.unpersist()
    return _model(estimator, RandomForestClassificationModel, [g.pruned(thresholds) for g in forest.growths], [1.0] * trees, len(thresholds), rows)


def _params(params: dict) -> dict:
    return {param.name: value for param, value in params.items()}


def _model(estimator, kind, trees: list[growing.Tree], weights: list[float], n_features: int, rows: DataFrame):
    """The model of these trees: written in Spark's format and loaded."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "grown-model")
    boosted = kind is GBTClassificationModel
    package = "org.apache.spark.ml."
    about = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "paramMap": _params(estimator._paramMap),
             "defaultParamMap": _params(estimator._defaultParamMap)}
    whole = {**about, "class": f"{package}classification.{kind.__name__}", "uid": estimator.uid, "numFeatures": n_features, "numTrees": len(trees),
             **({} if boosted else {"numClasses": 2})}
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    shared = {"featuresCol", "labelCol", "maxDepth", "maxMemoryInMB", "minInstancesPerNode", "seed", "weightCol", "cacheNodeIds", "checkpointInterval"}
    named = {"paramMap": {k: v for k, v in about["paramMap"].items() if k in shared}, "defaultParamMap": {}}
    tree_class = "regression.DecisionTreeRegressionModel" if boosted else "classification.DecisionTreeClassificationModel"
    each = [(i, json.dumps({**about, **named, "class": package + tree_class, "uid": f"{'dtr' if boosted else 'dtc'}_{i:012x}"}), w) for i, w in enumerate(weights)]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(_node_table(trees)).selectExpr(
        "treeID", "named_struct('id', id, 'prediction', prediction, 'impurity', impurity, 'impurityStats', stats, 'rawCount', count, 'gain', gain, "
        "'leftChild', leftChild, 'rightChild', rightChild, 'split', named_struct('featureIndex', feature, "
        "'leftCategoriesOrThreshold', if(leftChild < 0, array(), array(threshold)), 'numCategories', -1)) AS nodeData").to(
        spark.createDataFrame([], _NODE).schema).coalesce(1).write.parquet(f"{path}/data")
    return kind.load(path)


def _node_table(trees: list[growing.Tree]) -> pa.Table:
    sizes = [len(t.left) for t in trees]

    def joined(name: str) -> np.ndarray:
        return np.concatenate([getattr(t, name) for t in trees])

    stats = joined("stats")
    return pa.table({
        "treeID": pa.array(np.repeat(np.arange(len(trees), dtype=np.int32), sizes)), "id": pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])),
        "prediction": joined("prediction"), "impurity": joined("impurity"),
        "stats": pa.ListArray.from_arrays(np.arange(len(stats) + 1, dtype=np.int32) * stats.shape[1], stats.ravel()),
        "count": joined("count"), "gain": joined("gain"), "leftChild": joined("left"), "rightChild": joined("right"), "feature": joined("feature"),
        "threshold": joined("threshold")})
