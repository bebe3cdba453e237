"""A linear head trained epoch by epoch: AdamW, a schedule of rates, early stop, the best weights kept and saved.

Each epoch is one pass of sums over the training rows; the driver holds one weight per feature and the log.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relmill.functions import metrics
from relmill.functions.scalars import learning_rate, sigmoid
from relmill.sources.tables import _text, write_text
from relmill.staging import Scratch


@dataclass
class Head:
    """Weights of a linear model, the bias last; binary heads score by a sigmoid."""

    weights: list[float]
    task: str = "binary"
    log: list[dict] = field(default_factory=list)

    def logit(self, x: str = "x") -> Column:
        parts = [F.col(x)[i] * F.lit(w) for i, w in enumerate(self.weights[:-1])]
        out = F.lit(self.weights[-1])
        for p in parts:
            out = out + p
        return out

    def score(self, rows: DataFrame) -> DataFrame:
        """rows (x, ...) with a score."""
        return rows.withColumn("score", sigmoid(self.logit()) if self.task == "binary" else self.logit())

    def save(self, spark: SparkSession, path: str) -> None:
        write_text(spark, path, json.dumps({"weights": self.weights, "task": self.task, "log": self.log}))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Head:
        return cls(**json.loads(_text(spark, path)))


class EarlyStop:
    """Best value so far and how long ago; a gain counts from ``least`` on."""

    def __init__(self, patience: int, least: float = 0.0):
        self.patience, self.least, self.best, self.since = patience, least, -math.inf, 0

    def better(self, value: float) -> bool:
        if value > self.best + self.least:
            self.best, self.since = value, 0
            return True
        self.since += 1
        return False

    @property
    def over(self) -> bool:
        return self.since >= self.patience


def fit(
    rows: DataFrame,
    task: str = "binary",
    epochs: int = 30,
    rate: float = 0.1,
    schedule: str = "warmup_cosine",
    warmup: int = 3,
    patience: int = 8,
    clip: float = 5.0,
    decay: float = 1e-4,
    each: Callable[[dict], None] | None = None,
) -> Head:
    """The head with the best validation value over rows (split, x, label); x are arrays of one length.

    The value is ROC-AUC for binary labels, the negative mean absolute error otherwise. Gradients are scaled down to a
    norm of ``clip``. ``each`` is called with the log entry of every epoch. A loss that is no number raises.
    """
    scratch = Scratch(rows.sparkSession)
    rows = scratch.store(rows.select("split", F.col("x").cast("array<double>").alias("x"), F.col("label").cast("double").alias("label")), "rows")
    train, valid = rows.where("split = 'train'"), rows.where("split = 'valid'")
    first = rows.select(F.size("x")).first()
    if first is None:
        raise ValueError("no rows to learn from")
    dim = first[0]
    head, stop = Head([0.0] * (dim + 1), task), EarlyStop(patience)
    best, m, v = list(head.weights), [0.0] * (dim + 1), [0.0] * (dim + 1)
    for epoch in range(epochs):
        z = head.logit()
        error = (sigmoid(z) if task == "binary" else z) - F.col("label")
        loss = F.greatest(z, F.lit(0.0)) - z * F.col("label") + F.log1p(F.exp(-F.abs(z))) if task == "binary" else error * error
        sums = train.select(error.alias("e"), loss.alias("l"), "x").agg(F.avg("l"), F.avg("e"), *[F.avg(F.col("e") * F.col("x")[i]) for i in range(dim)]).first()
        if sums[0] is None or not math.isfinite(sums[0]):
            raise ValueError(f"epoch {epoch}: the loss is {sums[0]}")
        g = [*sums[2:], sums[1]]
        norm = math.sqrt(sum(x * x for x in g))
        g = [x * min(1.0, clip / norm) if norm else x for x in g]
        step = learning_rate(epoch, rate, schedule, epochs, warmup)
        for i, x in enumerate(g):  # AdamW (Loshchilov and Hutter, 2019); the bias does not decay
            m[i], v[i] = 0.9 * m[i] + 0.1 * x, 0.999 * v[i] + 0.001 * x * x
            move = m[i] / (1 - 0.9 ** (epoch + 1)) / (math.sqrt(v[i] / (1 - 0.999 ** (epoch + 1))) + 1e-8)
            head.weights[i] -= step * (move + (decay * head.weights[i] if i < dim else 0.0))
        scored = head.score(valid)
        value = metrics.roc_auc(scored).first()[0] if task == "binary" else -metrics.regression(scored, pred="score").first()["mae"]
        entry = {"epoch": epoch, "loss": sums[0], "valid": value, "rate": step, "gradient": norm}
        head.log.append(entry)
        if each:
            each(entry)
        if stop.better(value):
            best = list(head.weights)
        elif stop.over:
            break
    head.weights = best
    return head


def log_table(spark: SparkSession, head: Head) -> DataFrame:
    """(epoch, loss, valid, rate, gradient, best): the series of an epoch log, with the best value so far."""
    rows, best = [], -math.inf
    for e in head.log:
        best = max(best, e["valid"])
        rows.append((e["epoch"], float(e["loss"]), float(e["valid"]), float(e["rate"]), float(e["gradient"]), float(best)))
    return spark.createDataFrame(rows, "epoch int, loss double, valid double, rate double, gradient double, best double")


def save_metrics(df: DataFrame, folder: str) -> None:
    """The same table as JSON lines and as CSV."""
    df.write.mode("overwrite").json(f"{folder}/metrics.json")
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/metrics.csv")
