"""Baseline models of forward labels, on chronological splits."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def boosted(rows: DataFrame, inputs: list[str], label: str, iterations: int = 10, depth: int = 3) -> DataFrame:
    """rows with the probability of label 1 (``p``) by gradient-boosted trees of their training split; rows with nulls are
    left out."""
    ready = VectorAssembler(inputCols=inputs, outputCol="_x", handleInvalid="skip").transform(rows.withColumn("_y", F.col(label).cast("double")).where("_y IS NOT NULL"))
    model = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=iterations, maxDepth=depth, seed=7)
    out = model.fit(ready.where("split = 'train'")).transform(ready)
    return out.withColumn("p", vector_to_array("probability")[1]).drop("_x", "_y", "probability", "rawPrediction", "prediction")


def logistic(samples: DataFrame, inputs: list[str], label: str, iterations: int = 5, ridge: float = 1.0) -> list[tuple[int, list[float]]]:
    """[(fold, coefficients)] of logistic regressions of samples(fold, *inputs, label), the constant first, by Newton's
    method from 0 with a ridge on all but the constant.

    An iteration is one pass over the samples for all folds at once: gradients and curvatures are sums by fold, and what
    meets the rows again are the coefficients, a row a fold.  Rows with nulls don't count; folds without rows have none."""
    rows = samples.dropna(subset=["fold", label, *inputs])
    terms = ["1.0", *inputs]
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    names = [f"g{i}" for i in range(len(terms))] + [f"h{i}_{j}" for i, j in pairs]
    fits: dict[int, np.ndarray] = {}
    for _ in range(iterations):
        scored = with_probability(rows, fits, inputs) if fits else rows.withColumn("p", F.lit(0.5))
        error, weight = f"({label} - p)", "p * (1 - p)"
        sums = [F.expr(f"sum({error} * {x})") for x in terms] + [F.expr(f"sum({weight} * {terms[i]} * {terms[j]})") for i, j in pairs]
        step = {}
        for at in scored.groupBy("fold").agg(*(s.alias(n) for s, n in zip(sums, names))).collect():  # sums of each fold
            beta = fits.get(at["fold"], np.zeros(len(terms)))
            penalty = ridge * np.array([0.0] + [1.0] * len(inputs))
            curve = np.diag(penalty)
            for i, j in pairs:
                curve[i, j] += at[f"h{i}_{j}"]
                curve[j, i] = curve[i, j]
            step[at["fold"]] = beta + np.linalg.solve(curve, np.array([at[f"g{i}"] for i in range(len(terms))]) - penalty * beta)
        fits = step
    return [(fold, [float(x) for x in fits[fold]]) for fold in sorted(fits)]


def with_probability(rows: DataFrame, fits: dict[int, np.ndarray], inputs: list[str]) -> DataFrame:
    """rows(fold, *inputs, ...) with the probability ``p`` of label 1 by their fold's coefficients; rows of other folds go."""
    table = rows.sparkSession.createDataFrame([(fold, [float(x) for x in beta]) for fold, beta in fits.items()], "fold int, _beta array<double>")
    score = F.col("_beta")[0]
    for i, c in enumerate(inputs, 1):
        score = score + F.col("_beta")[i] * F.col(c)
    return rows.join(F.broadcast(table), "fold").withColumn("p", 1 / (1 + F.exp(-score))).drop("_beta")  # a row a fold


def log_loss(label, p):
    """What a probability costs that the label belies; probabilities are kept off 0 and 1."""
    safe = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
    return -(label * F.log(safe) + (1 - label) * F.log(1 - safe))
