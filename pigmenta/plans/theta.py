"""Prediction of the elastic margin, and the labels and models behind it."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the linear model: constant, factor of the vertices, factor of the edges.
LINEAR = (1.0825496073100667, 5.954294734547475e-07, 1.2596129615914713e-07)
#: Fixed values of the kernel model: bias and width.
KERNEL_BIAS = 2.1715487363425177
KERNEL_GAMMA = 6.226176426028005e-10
#: Most support vectors that are broadcast.
MAX_VECTORS = 100_000
#: Most rows that a kernel model is fitted on.
MAX_ROWS = 5_000


def linear_score(v: Column, e: Column) -> Column:
    return F.lit(LINEAR[0]) + F.lit(LINEAR[1]) * v + F.lit(LINEAR[2]) * e


def linear_theta(v: int, e: int) -> int:
    """The linear model's margin, rounded half away from zero."""
    return int(LINEAR[0] + LINEAR[1] * v + LINEAR[2] * e + 0.5)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Support vectors (v, e, alpha) of a Parquet or JSON table, or a CSV file with a header."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    rows = spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.json(path) if kind == "json" else spark.read.parquet(path)
    return rows.select(*(F.col(c).cast("double").alias(c) for c in ("v", "e", "alpha")))


def kernel_theta(v: int, e: int, vectors: DataFrame, bias: float = KERNEL_BIAS, gamma: float = KERNEL_GAMMA) -> int:
    """The kernel model's margin for a graph of ``v`` vertices and ``e`` edges, at least 0."""
    graphs = vectors.sparkSession.createDataFrame([(0, float(v), float(e))], "dataset int, v double, e double")
    return max(0, int(kernel_score(graphs, vectors, bias, gamma).first()["score"] + 0.5))


def kernel_score(graphs: DataFrame, vectors: DataFrame, bias: float = KERNEL_BIAS, gamma: float = KERNEL_GAMMA) -> DataFrame:
    """``graphs`` (dataset, v, e) with their score under an RBF model.

    ``vectors`` (v, e, alpha) is a table, loaded from wherever the model is kept. Its size is
    checked; all of it meets every graph, as the model's sum demands.
    """
    n = vectors.limit(MAX_VECTORS + 1).count()
    if n > MAX_VECTORS:
        raise ValueError(f"more than {MAX_VECTORS} support vectors")
    terms = vectors.agg(F.collect_list(F.struct(F.col("v").cast("double").alias("v"), F.col("e").cast("double").alias("e"), F.col("alpha").cast("double").alias("alpha"))).alias("terms"))
    far = lambda t: F.pow(t["v"] - F.col("v"), F.lit(2.0)) + F.pow(t["e"] - F.col("e"), F.lit(2.0))
    total = F.aggregate("terms", F.lit(0.0), lambda a, t: a + t["alpha"] * F.exp(F.lit(-gamma) * far(t)))
    return graphs.join(F.broadcast(terms)).withColumn("score", F.lit(bias) + total).drop("terms")


def labels(runs: DataFrame, gain: float = 1.2) -> DataFrame:
    """(dataset, theta) that a walk over the margins accepts.

    ``runs``: dataset, theta, color, runtime_ms. From margin 0's colours on, a margin is
    accepted while it needs no more colours than that; after an accepted one the walk ends
    if it was not ``gain`` times faster than the one before. Margins without a colour are skipped.
    """
    rows = runs.where("color IS NOT NULL")
    walk = Window.partitionBy("dataset").orderBy("theta")
    base = F.first("color").over(walk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    seen = rows.withColumns({"base": base, "last": F.lag("runtime_ms").over(walk), "first": F.row_number().over(walk) == 1})
    seen = seen.withColumns({"worse": F.col("color") > F.col("base"), "slow": ~F.col("first") & (F.col("last") / F.col("runtime_ms") <= gain)})
    before = walk.rowsBetween(Window.unboundedPreceding, -1)
    # the walk goes on while nothing before was worse or slow
    ends = F.coalesce(F.max(F.col("worse") | F.col("slow")).over(before), F.lit(False))
    return seen.withColumn("ended", ends).where("NOT ended AND NOT worse").groupBy("dataset").agg(F.max("theta").alias("theta"))


def features(graphs: DataFrame) -> DataFrame:
    """Vertices, edges and their whole-number ratio, as the models were trained on."""
    return graphs.select("dataset", F.col("v").cast("int").alias("v"), F.col("e").cast("int").alias("e"), (F.col("v") / F.col("e")).cast("int").alias("ratio"))


def quality(predictions: DataFrame) -> DataFrame:
    """(violation_ratio, mse, rmse, r2) of ``truth`` and ``prediction``."""
    error = F.col("prediction") - F.col("truth")
    out = predictions.agg(F.avg((F.col("prediction") > F.col("truth")).cast("int")).alias("violation_ratio"), F.avg(error * error).alias("mse"), F.var_pop("truth").alias("spread"))
    return out.select("violation_ratio", "mse", F.sqrt("mse").alias("rmse"), (1 - F.col("mse") / F.col("spread")).alias("r2"))


def fold_of(table: DataFrame, folds: int, seed: int) -> Column:
    """Fold of a row by a hash of its columns: the same on any number of partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), *(F.col(c).cast("double") for c in ("v", "e", "ratio", "theta"))), F.lit(folds))


@dataclass(frozen=True)
class KernelModel:
    """A fitted kernel model in the form that ``kernel_score`` takes."""

    vectors: DataFrame
    bias: float
    gamma: float

    def transform(self, table: DataFrame) -> DataFrame:
        return kernel_score(table, self.vectors, self.bias, self.gamma).withColumnRenamed("score", "prediction")


def _fit_kernel(learn: DataFrame, c: float = 1.0, epsilon: float = 0.1, gamma: float | None = None, rounds: int = 200) -> KernelModel:
    """Epsilon-insensitive regression by coordinate descent on the dual; the bias is regularised.

    One row is one graph, so the table is small: ``MAX_ROWS`` at most, checked. By default
    the width is one over the number of features and their variance.
    """
    rows = learn.select(*(F.col(x).cast("double") for x in ("v", "e", "theta"))).limit(MAX_ROWS + 1).toPandas()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows to learn from")
    x, y = rows[["v", "e"]].to_numpy(), rows["theta"].to_numpy()
    gamma = gamma or 1.0 / (x.shape[1] * max(x.var(), 1e-300))
    square = (x * x).sum(1)
    kernel = np.exp(-gamma * np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0.0)) + 1.0
    beta, fit = np.zeros(len(y)), np.zeros(len(y))
    for _ in range(rounds):
        moved = 0.0
        for i in range(len(y)):
            pull = y[i] - fit[i] + kernel[i, i] * beta[i]
            new = np.clip(np.sign(pull) * max(abs(pull) - epsilon, 0.0) / kernel[i, i], -c, c)
            if new != beta[i]:
                fit += kernel[i] * (new - beta[i])
                moved, beta[i] = max(moved, abs(new - beta[i])), new
        if moved < 1e-6:
            break
    used = np.flatnonzero(beta)
    vectors = learn.sparkSession.createDataFrame([(float(x[i, 0]), float(x[i, 1]), float(beta[i])) for i in used], "v double, e double, alpha double")
    return KernelModel(vectors, float(beta.sum()), float(gamma))


def _fit(learn: DataFrame, kind: str, seed: int, options: dict):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    if kind == "svr":
        return _fit_kernel(learn, **options)
    makers = {"linear": (LinearRegression, {}), "forest": (RandomForestRegressor, {"seed": seed, "numTrees": 100, "maxDepth": 20, "featureSubsetStrategy": "all"}), "boosted": (GBTRegressor, {"seed": seed, "maxIter": 50})}
    if kind not in makers:
        raise ValueError(f"unknown model: {kind}")
    maker, defaults = makers[kind]
    steps = [VectorAssembler(inputCols=["v", "e", "ratio"], outputCol="features"), maker(featuresCol="features", labelCol="theta", **(defaults | options))]
    return Pipeline(stages=steps).fit(learn)


def _scored(model, table: DataFrame) -> DataFrame:
    return model.transform(table).select(F.col("theta").alias("truth"), "prediction")


def train(table: DataFrame, kind: str = "linear", seed: int = 42, grid: dict[str, list] | None = None, folds: int = 5, **options):
    """A model of ``theta`` from v, e and ratio, and its predictions on the fifth held out.

    Kinds: linear, forest, boosted (Spark ML), svr (kernel). Rows are dealt by a hash, so the
    split and the model do not depend on the partitioning. With ``grid``, lists of options
    by name, each combination is fitted ``folds`` times on the rows to learn from, and the
    one with the least mean share of margins predicted too high is taken (the first on ties).
    """
    held = fold_of(table, 5, seed) == 0
    learn, test = table.where(~held), table.where(held)
    if grid:
        fold, best = fold_of(table, folds, seed + 1), None
        for values in itertools.product(*grid.values()):
            tried = options | dict(zip(grid, values, strict=True))
            scores = []
            for i in range(folds):
                left_out = learn.where(fold == i)
                if left_out.head(1):
                    scores.append(quality(_scored(_fit(learn.where(fold != i), kind, seed, tried), left_out)).first()["violation_ratio"])
            mean = sum(scores) / max(1, len(scores))
            if best is None or mean < best[0]:
                best = (mean, tried)
        options = best[1]
    model = _fit(learn, kind, seed, options)
    return model, _scored(model, test)
