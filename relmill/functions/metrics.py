"""Evaluation metrics, each a function of a DataFrame that returns one row, and a registry of them.

Global rankings go through groups of equal scores and distributed running sums, never one sorted task.
Ties share their group, so no result depends on the order of rows. With no rows a metric is null unless
it says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relmill.operators.ordered import running_sums

REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def metric(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    if f.__name__ in REGISTRY:
        raise ValueError(f"metric {f.__name__} is registered already")
    REGISTRY[f.__name__] = f
    return f


def _by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    y = F.when(F.col(label) > 0.5, 1).otherwise(0).cast("long")
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))


@metric
def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Mann-Whitney with average ranks; 0.5 when a class is absent."""
    groups = running_sums(_by_score(df, score, label), ["s"], {"below": F.col("n") - F.col("pos")})
    neg = F.col("n") - F.col("pos")
    wins = groups.agg(F.sum(F.col("pos") * (F.col("below") - neg) + F.col("pos") * neg / 2.0).alias("w"), F.sum("pos").alias("p"), F.sum(neg).alias("q"))
    return wins.select(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("w") / (F.col("p").cast("double") * F.col("q"))).otherwise(0.5).alias("roc_auc"))


@metric
def average_precision(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Sum over score groups, best first, of precision times the gain in recall; 0 without positives."""
    groups = running_sums(_by_score(df, score, label), [F.col("s").desc()], {"tp": F.col("pos"), "all": F.col("n")})
    out = groups.agg(F.sum(F.col("pos") * F.col("tp") / F.col("all")).alias("a"), F.sum("pos").alias("p"))
    return out.select(F.when(F.col("p") > 0, F.col("a") / F.col("p")).otherwise(0.0).alias("average_precision"))


@metric
def auprc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under precision over recall by trapezoids between score groups, from precision 1 at recall 0; 0 without
    positives."""
    groups = running_sums(_by_score(df, score, label), [F.col("s").desc()], {"tp": F.col("pos"), "all": F.col("n")})
    before, pos = F.col("tp") - F.col("pos"), F.col("pos")
    earlier = F.when(F.col("all") > F.col("n"), before / (F.col("all") - F.col("n"))).otherwise(1.0)
    out = groups.agg(F.sum(pos * (F.col("tp") / F.col("all") + earlier) / 2.0).alias("a"), F.sum("pos").alias("p"))
    return out.select(F.when(F.col("p") > 0, F.col("a") / F.col("p")).otherwise(0.0).alias("auprc"))


@metric
def classification(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """Accuracy, precision, recall and F1 of 0/1 predictions; 0 where a denominator is 0."""
    p, y = F.col(pred) > 0.5, F.col(label) > 0.5
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("double")
    c = df.agg(n(p & y).alias("tp"), n(p & ~y).alias("fp"), n(~p & y).alias("fn"), n(~p & ~y).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")
    )


@metric
def macro_f1(df: DataFrame, pred: str = "pred", label: str = "label", classes: int = 2) -> DataFrame:
    """Mean F1 over all declared classes; an absent class counts 0."""
    kinds = df.sparkSession.range(classes).select(F.col("id").alias("c"))
    sides = df.select(F.explode(F.array(F.struct(F.col(pred).cast("long").alias("c"), F.lit("p").alias("side")), F.struct(F.col(label).cast("long").alias("c"), F.lit("y").alias("side")))).alias("x"), (F.col(pred) == F.col(label)).alias("ok"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    per = sides.select("x.c", "x.side", "ok").groupBy("c").agg(n(F.col("ok") & (F.col("side") == "p")).alias("tp"), F.count("*").alias("n"))
    return kinds.join(F.broadcast(per), "c", "left").agg(F.avg(F.coalesce(2.0 * F.col("tp") / F.col("n"), F.lit(0.0))).alias("macro_f1"))


@metric
def regression(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """MAE, MSE, RMSE, R2 (0 without spread in the labels) and MAPE over non-zero labels."""
    e = F.col(pred) - F.col(label)
    a = df.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(label).alias("v"), F.avg(F.when(F.abs(label) > 1e-8, F.abs(e / F.col(label)))).alias("mape"))
    return a.select("mae", "mse", F.sqrt("mse").alias("rmse"), F.when(F.col("v") > 1e-9, 1 - F.col("mse") / F.col("v")).otherwise(0.0).alias("r2"), "mape")


@metric
def brier(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Brier score and the share of scores over one half."""
    d = F.col(score) - F.col(label)
    return df.agg(F.avg(d * d).alias("brier"), F.avg(F.when(F.col(score) > 0.5, 1.0).otherwise(0.0)).alias("positive_rate"))


def _ranked(df: DataFrame, query: str, score: str, item: str) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(item))))


@metric
def ranking(df: DataFrame, k: int = 10, query: str = "query", item: str = "item", score: str = "score", relevant: str = "relevant") -> DataFrame:
    """MAP@k (over the smaller of relevant items and k; a query without any adds 0), MRR, NDCG@k with linear
    gain, recall@k, precision@k (over the smaller of k and items) and hits@k, as means over queries. Ties go
    to the smaller item."""
    rel = (F.col(relevant) > 0).cast("int")
    r = _ranked(df, query, score, item).withColumn("_rel", rel)
    r = r.withColumn("_hits", F.sum("_rel").over(Window.partitionBy(query).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)))
    top = F.col("_k") <= k
    r = r.withColumn("_ideal", F.row_number().over(Window.partitionBy(query).orderBy(F.col(relevant).desc(), F.col(item))))
    gain = F.col(relevant).cast("double")
    per = r.groupBy(query).agg(
        F.sum(F.when(top, F.col("_rel") * F.col("_hits") / F.col("_k")).otherwise(0.0)).alias("ap"), F.sum("_rel").alias("n_rel"), F.count("*").alias("n"),
        F.min(F.when(F.col("_rel") == 1, F.col("_k"))).alias("first"), F.sum(F.when(top, F.col("_rel")).otherwise(0)).alias("hit"),
        F.sum(F.when(top, gain / F.log2(F.col("_k") + 1.0)).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("_ideal") <= k, gain / F.log2(F.col("_ideal") + 1.0)).otherwise(0.0)).alias("idcg"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    cols = {
        "map_at_k": ratio(F.col("ap"), F.least("n_rel", F.lit(k))), "mrr": F.coalesce(1.0 / F.col("first"), F.lit(0.0)), "ndcg_at_k": ratio(F.col("dcg"), F.col("idcg")),
        "recall_at_k": ratio(F.col("hit"), F.col("n_rel")), "precision_at_k": ratio(F.col("hit"), F.least("n", F.lit(k))), "hits_at_k": (F.col("hit") > 0).cast("double"),
    }
    return per.agg(*[F.avg(c).alias(n) for n, c in cols.items()])


@metric
def summary(df: DataFrame, column: str = "value") -> DataFrame:
    """Count, mean, min, max, population deviation and the values at positions trunc(p (n - 1))."""
    from relmill.operators.ordered import row_index

    values = row_index(df.where(F.col(column).isNotNull()).select(F.col(column).alias("x")), ["x"])
    n = values.agg((F.count("*") - 1).alias("_last"))
    both = values.crossJoin(F.broadcast(n))
    at = lambda p: F.max(F.when(F.col("_row") == F.floor(F.col("_last") * F.lit(p)), F.col("x")))
    return both.agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"), F.stddev_pop("x").alias("std"),
        *[at(p / 100).alias(f"p{p}") for p in (50, 90, 95, 99)],
    )


def evaluate(df: DataFrame, names: list[str], **columns: str) -> DataFrame:
    """The named metrics side by side, one row."""
    out = None
    for n in names:
        if n not in REGISTRY:
            raise KeyError(f"unknown metric: {n}")
        row = REGISTRY[n](df, **columns)
        out = row if out is None else out.crossJoin(F.broadcast(row))  # one row each
    return out


def over_seeds(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Runs, and each measure's mean and population deviation over them, as <measure>_mean and <measure>_std."""
    stats = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return df.groupBy(*by).agg(F.count("*").alias("runs"), *stats)
