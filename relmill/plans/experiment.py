"""Learning on propagated features: k-hop means as columns, an MLlib head, scores over several seeds."""

from __future__ import annotations

import time

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.functions import metrics
from relmill.operators.aggregate import khop_mean
from relmill.operators.tasks import hash_split
from relmill.staging import Scratch


def propagated(edges: DataFrame, features: DataFrame, hops: int = 2) -> DataFrame:
    """(node_id, x): a node's features followed by their means after 1 to ``hops`` steps."""
    out = None
    for h, f in enumerate(khop_mean(edges, features, hops)):
        part = f.select("node_id", F.col("x").alias(f"_x{h}"))
        out = part if out is None else out.join(part, "node_id")
    return out.select("node_id", F.concat(*[f"_x{h}" for h in range(hops + 1)]).alias("x"))


def experiment(features: DataFrame, labels: DataFrame, task: str = "binary", seed: int = 0, iterations: int = 50) -> tuple[DataFrame, dict]:
    """Test predictions (node_id, label, score) and a report. labels: node_id, label."""
    begin = time.perf_counter()
    rows = hash_split(features.join(labels, "node_id"), "node_id", seed).select("node_id", "split", F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"))
    rows = Scratch(features.sparkSession).store(rows, "experiment")
    train = rows.where("split = 'train'")
    if task == "binary":
        model = LogisticRegression(maxIter=iterations, regParam=0.01).fit(train)
        scored = model.transform(rows).select("node_id", "split", "label", vector_to_array("probability")[1].alias("score"))
        measure = lambda d: metrics.roc_auc(d).first()[0]
    else:
        model = LinearRegression(maxIter=iterations, regParam=0.01).fit(train)
        scored = model.transform(rows).select("node_id", "split", "label", F.col("prediction").alias("score"))
        measure = lambda d: metrics.regression(d, pred="score").first()["mae"]
    report = {"task": task, "seed": seed, "valid": measure(scored.where("split = 'valid'")), "test": measure(scored.where("split = 'test'")), "seconds": time.perf_counter() - begin}
    return scored.where("split = 'test'").drop("split"), report


def multi_seed(features: DataFrame, labels: DataFrame, task: str = "binary", seeds: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(task, seeds, valid_mean, valid_std, test_mean, test_std) with population deviations."""
    reports = [experiment(features, labels, task, s)[1] for s in seeds]
    df = features.sparkSession.createDataFrame([(r["task"], r["seed"], float(r["valid"]), float(r["test"])) for r in reports], "task string, seed int, valid double, test double")
    stats = [f(c).alias(f"{c}_{n}") for c in ("valid", "test") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return df.groupBy("task").agg(F.count("*").alias("seeds"), *stats)
