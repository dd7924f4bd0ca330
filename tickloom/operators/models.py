"""Regression jobs on the feature table with MLlib, and their scores."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.features import FEATURES
from tickloom.operators.metrics import metric_grid
from tickloom.plans.scan import number_rows

SEED = 0
OBJECTIVE = "precision_at__threshold_1.01"
# Ranges of the parameter search, and the repeats of a permutation.
DEPTHS, TREES, ITERATIONS = range(2, 11), range(1, 11), range(1, 11)
TRIALS, REPEATS = 100, 30
PERMUTATION_BUCKETS = 1024

# Regressor, names of its parameters, and fixed settings: a forest tries all features at each split,
# boosting has 255 bins and leaves of at least 20 rows.
KINDS = {
    "decision_tree": (DecisionTreeRegressor, {"max_depth": "maxDepth"}, {}),
    "random_forest": (
        RandomForestRegressor, {"max_depth": "maxDepth", "trees": "numTrees"}, {"featureSubsetStrategy": "all"},
    ),
    "gradient_boosting": (
        GBTRegressor, {"max_depth": "maxDepth", "iterations": "maxIter"}, {"maxBins": 255, "minInstancesPerNode": 20},
    ),
}


def fit(train: DataFrame, kind: str, params: Mapping[str, int], features: Sequence[str] = FEATURES) -> PipelineModel:
    """Assemble the features and fit one regressor; the tree levels are distributed jobs."""
    make, names, settings = KINDS[kind]
    model = make(
        featuresCol="features", labelCol="target", predictionCol="y_pred", seed=SEED,
        **settings, **{names[p]: v for p, v in params.items()},
    )
    assemble = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assemble, model]).fit(train)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("y_true", F.col("target"))


def scores(model: PipelineModel, held_out: DataFrame) -> DataFrame:
    """The metric grid for each split of ``held_out``, as (split, metric, value)."""
    return metric_grid(predict(model, held_out), keys=["split"])


def random_trials(count: int = TRIALS, seed: int = SEED) -> list[tuple[str, dict[str, int]]]:
    """Parameter sets drawn at random: a kind, its depth and its size."""
    draw = random.Random(seed)
    found = []
    for _ in range(count):
        kind = draw.choice(sorted(KINDS))
        params = {"max_depth": draw.choice(DEPTHS)}
        if kind == "random_forest":
            params["trees"] = draw.choice(TREES)
        if kind == "gradient_boosting":
            params["iterations"] = draw.choice(ITERATIONS)
        found.append((kind, params))
    return found


SEARCH_SCHEMA = T.StructType(
    [
        T.StructField("trial", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("params", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
# How metric names of the two held-out splits are marked.
PREFIX = {"validate": "vldt_", "test": "test__"}


def param_search(
    split_rows: DataFrame, trials: Sequence[tuple[str, Mapping[str, int]]]
) -> tuple[DataFrame, int]:
    """Fit each parameter set on ``train``, score the other splits; the best trial by objective.

    Returns the ledger rows of all trials. Only the few scores of a trial reach the driver.
    """
    spark = split_rows.sparkSession
    rows = split_rows.persist()
    train, held_out = rows.where("split = 'train'"), rows.where("split <> 'train'")
    ledger, best, best_value = [], -1, float("-inf")
    try:
        for number, (kind, params) in enumerate(trials):
            model = fit(train, kind, params)
            for split, metric, value in scores(model, held_out).collect():
                ledger.append((number, kind, json.dumps(params, sort_keys=True), PREFIX[split] + metric, value))
                if split == "validate" and metric == OBJECTIVE and value > best_value:
                    best, best_value = number, value
    finally:
        rows.unpersist()
    return spark.createDataFrame(ledger, SEARCH_SCHEMA), best


def append_ledger(ledger: DataFrame, path: str) -> None:
    """Add runs to the ledger table."""
    ledger.write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEARCH_SCHEMA).parquet(path)


@dataclass(frozen=True)
class Nodes:
    """One tree as arrays; a leaf points at itself, so rows may be sent down ``depth`` times together."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    weight: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.value[at]


def node_arrays(model: PipelineModel) -> list[Nodes]:
    """The trees of a fitted regressor; their size is bounded by depth and number of trees."""
    fitted = model.stages[1]
    trees = list(getattr(fitted, "trees", [fitted]))
    shares = [1 / len(trees)] * len(trees) if isinstance(fitted, RandomForestRegressionModel) else None
    weights = shares or list(getattr(fitted, "treeWeights", [1.0]))
    found = []
    for tree, weight in zip(trees, weights, strict=True):
        columns: list[list[float]] = []

        def visit(node, columns=columns) -> int:
            place = len(columns)
            columns.append([0, 0.0, place, place, node.prediction()])
            if node.subtreeDepth():
                split = node.split()
                columns[place][:2] = [split.featureIndex(), split.threshold()]
                columns[place][2:4] = [visit(node.leftChild()), visit(node.rightChild())]
            return place

        visit(tree._java_obj.rootNode())
        feature, threshold, left, right, value = (np.array(c) for c in zip(*columns, strict=True))
        found.append(Nodes(feature, threshold, left, right, value, tree.depth, weight))
    return found


def permutation_importance(
    model: PipelineModel, rows: DataFrame, features: Sequence[str] = FEATURES,
    repeats: int = REPEATS, seed: int = SEED,
) -> DataFrame:
    """Loss of R2 when one feature is shuffled, mean and spread over the repeats.

    Both orders of a repeat come from hashes, and rows are numbered bucket by bucket, so
    that a shuffle is an equi-join on the number. Each row then meets one donor row per
    repeat, which lends it one feature at a time; the trees are evaluated on arrays, and squared errors are
    summed before they leave the task. Only trees that split by a feature are evaluated again for
    it, and a feature that no tree splits by loses nothing.
    """
    assembled = model.stages[0].transform(rows).select(
        "ticker", "date", "target", vector_to_array("features").alias("x")
    )
    repeated = assembled.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def ordered(tag: str, out: str) -> DataFrame:
        code = F.xxhash64(F.lit(seed), F.lit(tag), "repeat", "ticker", "date")
        bucket = F.col("repeat") * PERMUTATION_BUCKETS + F.pmod(code, F.lit(PERMUTATION_BUCKETS))
        return number_rows(repeated, F.struct(code, "ticker", "date"), bucket, out)

    takers = ordered("taker", "place")
    donors = ordered("donor", "place").select("place", "repeat", F.col("x").alias("lent"))
    trees, width = node_arrays(model), len(features)
    splits = [set(t.feature[t.left != np.arange(len(t.left))].tolist()) for t in trees]

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, lent = (
                batch.column(n).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for n in ("x", "lent")
            )
            target, repeat = batch.column("target").to_numpy(), batch.column("repeat").to_numpy()
            given = [t.weight * t.predict(x) for t in trees]
            which, group = np.unique(repeat, return_inverse=True)
            sums = np.empty((len(which), width))
            for f in range(width):
                changed = x.copy()
                changed[:, f] = lent[:, f]
                parts = [
                    t.weight * t.predict(changed) if f in used else old
                    for t, used, old in zip(trees, splits, given, strict=True)
                ]
                sums[:, f] = np.bincount(group, (target - sum(parts)) ** 2, len(which))
            yield pa.RecordBatch.from_pydict(
                {
                    "repeat": np.repeat(which, width).astype("int32"),
                    "feature": np.tile(np.arange(width, dtype="int32"), len(which)),
                    "left": sums.ravel(),
                }
            )

    # Sizes are judged before the repeats are made, so without the hint all donors would be sent through the driver.
    paired = takers.join(donors.hint("merge"), ["place", "repeat"]).select("repeat", "target", "x", "lent")
    lost = paired.mapInArrow(errors, "repeat int, feature int, left double").groupBy("repeat", "feature").agg(F.sum("left").alias("left"))
    missed = F.sum(F.pow(F.col("target") - F.col("y_pred"), F.lit(2)))
    spread, before = predict(model, rows).agg(F.var_pop("target") * F.count(F.lit(1)), missed).first()
    unused = [f for f in range(width) if not any(f in used for used in splits)]
    drop = F.try_divide(F.col("left") - F.lit(before), F.lit(spread))
    drops = lost.withColumn("drop", F.when(F.col("feature").isin(unused), F.lit(0.0)).otherwise(drop))
    names = F.array(*[F.lit(f) for f in features])
    return drops.groupBy(F.get(names, F.col("feature")).alias("feature")).agg(
        F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std")
    )
