"""A vector quantiser with a codebook that follows its data: decayed counts and sums, dead codes started anew.

Each batch is one pass: the nearest code of every vector, then sums per code and component, pre-aggregated; the codebook is
k rows on the driver, as a parameter is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relmill.functions.scalars import squared_distance


@dataclass
class Codebook:
    """codes, and the decayed number and sum of the vectors that each has won."""

    codes: list[list[float]]
    counts: list[float]
    totals: list[list[float]]
    decay: float = 0.99
    smoothing: float = 1e-5

    @classmethod
    def start(cls, codes: list[list[float]], decay: float = 0.99, smoothing: float = 1e-5) -> Codebook:
        """Codes as they are, each with the weight of one vector."""
        return cls([list(map(float, c)) for c in codes], [1.0] * len(codes), [list(map(float, c)) for c in codes], decay, smoothing)

    def table(self, spark: SparkSession) -> DataFrame:
        """(code, c, n, s), to be stored and read again."""
        return spark.createDataFrame(list(zip(range(len(self.codes)), self.codes, self.counts, self.totals, strict=True)), "code int, c array<double>, n double, s array<double>")

    @classmethod
    def of(cls, table: DataFrame, decay: float = 0.99, smoothing: float = 1e-5) -> Codebook:
        rows = table.orderBy("code").collect()  # k rows
        return cls([list(r.c) for r in rows], [r.n for r in rows], [list(r.s) for r in rows], decay, smoothing)

    def assign(self, vectors: DataFrame) -> DataFrame:
        """vectors (x, ...) with code and distance2; ties to the smaller code."""
        codes = F.array(*[F.struct(F.lit(i).alias("code"), F.array(*[F.lit(v) for v in c]).alias("c")) for i, c in enumerate(self.codes)])
        one = vectors.sparkSession.range(1).select(codes.alias("_codes"))  # one row of k codes
        near = F.array_min(F.transform("_codes", lambda k: F.struct(squared_distance(F.col("x"), k["c"]).alias("d"), k["code"].alias("code"))))
        return vectors.crossJoin(F.broadcast(one)).withColumn("_near", near).select(*vectors.columns, F.col("_near.code").alias("code"), F.col("_near.d").alias("distance2"))

    def update(self, vectors: DataFrame, dead: float = 0.0) -> float:
        """Follows one batch of vectors (id, x): n and s decay and take in the batch, codes are s over the smoothed n. Codes
        whose n falls under ``dead`` start again from the batch's vectors that are farthest from their codes, ties to the
        smaller id. Returns the mean squared distance before the update."""
        k, dim = len(self.codes), len(self.codes[0])
        near = self.assign(vectors.select("id", "x"))
        sums = {r.code: r for r in near.groupBy("code").agg(F.count("*").alias("n"), F.sum("distance2").alias("d"), F.array(*[F.sum(F.col("x")[i]) for i in range(dim)]).alias("s")).collect()}  # k rows
        if not sums:
            return 0.0
        for i in range(k):
            n, s = (sums[i].n, sums[i].s) if i in sums else (0, [0.0] * dim)
            self.counts[i] = self.decay * self.counts[i] + (1 - self.decay) * n
            self.totals[i] = [self.decay * a + (1 - self.decay) * b for a, b in zip(self.totals[i], s, strict=True)]
        total = sum(self.counts)
        for i in range(k):
            smooth = (self.counts[i] + self.smoothing) / (total + k * self.smoothing) * total
            self.codes[i] = [v / smooth for v in self.totals[i]]
        gone = [i for i in range(k) if self.counts[i] < dead]
        far = near.orderBy(F.desc("distance2"), "id").limit(len(gone)).collect() if gone else []  # at most k rows
        for i, r in zip(gone, far, strict=False):
            self.codes[i], self.counts[i], self.totals[i] = list(r.x), 1.0, list(r.x)
        return sum(r.d for r in sums.values()) / sum(r.n for r in sums.values())
