"""Random-forest regression on Spark ML, and error measures."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import add

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweek.config import ForestParams
from areaweek.runtime import materialize, shared_dir

SHALLOW = 10  # up to this depth walking a tree is cheap
TOGETHER = 8  # groups of trees that are fitted at the same time
FEW_ROWS = 100_000  # that one part holds; every part sends statistics of its own in each pass


@dataclasses.dataclass(frozen=True)
class Forest:
    """Groups of trees; a prediction is the mean over all trees."""

    groups: list[RandomForestRegressionModel]

    @property
    def trees(self) -> list:
        return [t for g in self.groups for t in g.trees]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``; every group scores the rows in one and the same pass."""
        columns = df.columns
        total = sum(g.getNumTrees for g in self.groups)
        parts = []
        for i, g in enumerate(self.groups):
            parts.append(f"_group_{i}")
            df = g.transform(df).withColumnRenamed("prediction", parts[-1])
        mean = reduce(add, [F.col(p) * (g.getNumTrees / total) for p, g in zip(parts, self.groups, strict=True)])
        return df.select(*columns, mean.alias("prediction"))


def assemble(df: DataFrame, features: Sequence[str], missing: str = "skip") -> DataFrame:
    """Add the feature vector; ``missing`` says what to do with rows lacking a feature."""
    return VectorAssembler(
        inputCols=list(features), outputCol="features", handleInvalid=missing
    ).transform(df)


def fit_forest(
    train: DataFrame,
    features: Sequence[str],
    params: ForestParams,
    target: str = "cases",
    keys: Sequence[str] = ("district", "year", "week"),
) -> Forest:
    """Fit on rows written once to shared storage, since fitting scans them often.

    The rows are dealt by ``keys`` into as many parts as their counted number asks for, and
    sorted there, so that one seed gives one forest on any number of files and cores. The
    trees are fitted in groups at the same time, each group from a seed of its own: passes
    over few rows are mostly waiting, and groups wait together. A group's bootstrap weights
    follow from its seed and the rows' places. For deep trees node ids are kept per row
    instead of sending and walking every tree in each pass; their lineage is cut by
    checkpoints in the shared folder.
    """
    spark = train.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    rows = assemble(train.dropna(subset=[target]), features)
    label = F.col(target).cast("double").alias("label")
    rows = materialize(rows.select(*keys, "features", label), "fit-rows")
    parts = max(1, -(-rows.count() // FEW_ROWS))
    dealt = rows.coalesce(1) if parts == 1 else rows.repartition(parts, *keys)
    dealt = dealt.sortWithinPartitions(*keys, "label").select("features", "label")
    if parts == 1:
        dealt = materialize(dealt, "fit-part").coalesce(1)  # one file, in order
    groups = min(TOGETHER, params.trees)
    sizes = [params.trees // groups + (i < params.trees % groups) for i in range(groups)]

    def fit(i: int) -> RandomForestRegressionModel:
        return RandomForestRegressor(
            numTrees=sizes[i],
            maxDepth=params.depth,
            seed=params.seed + i,
            maxBins=params.max_bins,
            featureSubsetStrategy=params.feature_subset,
            maxMemoryInMB=params.stats_memory_mb,
            cacheNodeIds=params.depth > SHALLOW,
            bootstrap=params.bootstrap,
        ).fit(dealt)

    with ThreadPoolExecutor(groups) as pool:
        return Forest(list(pool.map(inheritable_thread_target(spark)(fit), range(groups))))


def score(
    model: Forest,
    df: DataFrame,
    features: Sequence[str],
    out: str = "predicted_cases",
) -> DataFrame:
    """Score all rows of a frame in one pass; a missing feature takes the upper branch."""
    return (
        model.transform(assemble(df, features, missing="keep"))
        .withColumnRenamed("prediction", out)
        .drop("features")
    )


def error_metrics(scored: DataFrame, actual: str = "cases", predicted: str = "predicted_cases"):
    """MAE, MSE and RMSE in one aggregate, with the number of rows behind them."""
    gap = F.col(actual) - F.col(predicted)
    mse = F.avg(gap * gap)
    return scored.agg(
        F.count(gap).alias("n"),
        F.avg(F.abs(gap)).alias("mae"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
    )
