"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words and word stems of four and five bytes, pairs of neighbours and pairs
one and two words apart of a text, hashed into 2^22 slots. FTRL-proximal keeps a learning rate per coordinate, and its L1 term holds the
weight of every feature without steady evidence at exactly zero, so the model that is sent to the
executors is a short list of slots. Training reads a bounded, class-balanced sample of labelled rows
(``per_class``); scoring reads every text whole.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmill.llm.common import KEEP, LOWER, M1, M2, M3, SPACE, mix, raw, slices, token_spans

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 22
#: Bytes between words: white space and ASCII signs. Bytes over 127 belong to words of any script.
NOT_WORD = SPACE.copy()
NOT_WORD[[i for i in range(128) if not chr(i).isalnum()]] = True
TO_WORD = LOWER.copy()
TO_WORD[NOT_WORD] = 32


def features(texts) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams and skip-grams of a batch and the texts' numbers; repeats are still there."""
    data, offsets = raw(texts)
    low = np.full(len(data) + 8, 32, np.uint8)
    low[: len(data)] = TO_WORD[data]
    starts, ends, doc = token_spans(low[: len(data)], offsets)
    size = ends - starts
    view = np.ndarray((len(data) + 1,), "<u8", low, strides=(1,))
    h = mix(size.astype(np.uint64) * M1)
    left, where, at = size, np.arange(len(size)), starts
    while len(where):
        h[where] = mix((h[where] ^ (view[at] & KEEP[np.minimum(left, 8)])) * M1 + M3)
        more = left > 8
        where, at, left = where[more], at[more] + 8, left[more] - 8
    slots, docs = [h], [doc]
    for stem in (4, 5):  # unigrams of stems, so that an inflection that was never labelled still counts
        slots.append(mix((view[starts] & KEEP[np.minimum(size, stem)]) * M1 + np.uint64(stem))), docs.append(doc)
    for gap in (1, 2, 3):
        same = doc[gap:] == doc[:-gap]
        slots.append(mix(h[:-gap][same] * M2 + h[gap:][same] + np.uint64(gap))), docs.append(doc[gap:][same])
    return (np.concatenate(slots) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(docs)


def _feature_rows(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            slot, doc = features(part.column("text"))
            key = np.unique(doc << BITS | slot)
            ends = np.searchsorted(key >> BITS, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((key & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("order"), part.column("toxic"), lists], ["order", "toxic", "slots"])


def _learner(alpha: float, beta: float, l1: float, l2: float, heft: float):
    """FTRL-proximal over the rows of one task in their order; memory is two arrays of 2^22 floats.

    ``heft`` is what a toxic row counts against another, so that the rarer class is not drowned."""

    def run(batches):
        z, n = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
        bias = np.zeros(2)  # the sum of gradients and of their squares; not regularised

        def weights(at):
            zz = z[at]
            return np.where(np.abs(zz) <= l1, 0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

        for batch in batches:
            y, lists = batch.column("toxic").to_numpy(zero_copy_only=False), batch.column("slots")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i in range(batch.num_rows):
                at = flat[ends[i] : ends[i + 1]]
                w = weights(at)
                b = -bias[0] * alpha / (beta + np.sqrt(bias[1]))
                g = (1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y[i]) * (heft if y[i] else 1.0)
                new = n[at] + g * g
                z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / alpha * w
                n[at] = new
                bias += (g, g * g)
        at = np.flatnonzero(np.abs(z) > l1)
        b = -bias[0] * alpha / (beta + np.sqrt(bias[1]))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(weights(at), b).astype(np.float64))], ["slot", "weight"])

    return run


def train(docs: DataFrame, labels: DataFrame, per_class: int = 6000, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 25.0, l2: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights), slot -1 being the bias. At most ``per_class`` labelled rows of each class are
    used, picked by a hash of the id. Rows without a label are ignored, of several labels for one id the
    larger holds. Without rows of both classes the model is empty."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    picks = [known.where(F.col("toxic") == k).withColumn("order", order).orderBy("order", "doc_id").limit(per_class) for k in (0, 1)]
    picked = picks[0].unionByName(picks[1])  # at most 2 * per_class ids: small enough to broadcast at any size
    counts = {r["toxic"]: r["count"] for r in picked.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return np.zeros(0, np.int64), np.zeros(0)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("order", "toxic", "text")
    rows = sample.mapInArrow(_feature_rows, "order long, toxic int, slots array<int>")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn("turn", F.xxhash64("order", "epoch"))
    rows = rows.repartition(1).sortWithinPartitions("epoch", "turn").select("toxic", "slots")
    got = rows.mapInArrow(_learner(alpha, beta, l1, l2, counts[0] / counts[1]), "slot int, weight double").toPandas()
    return got.slot.to_numpy(np.int64), got.weight.to_numpy(np.float64)


def _scorer(slots: np.ndarray, weights: np.ndarray):
    def run(batches):
        table, known = np.zeros(1 << BITS, np.float32), slots >= 0
        table[slots[known]] = weights[known]
        bias = float(weights[~known].sum())
        for batch in batches:
            for part in slices(batch, "text"):
                slot, doc = features(part.column("text"))
                hit = table[slot] != 0
                key = np.unique(doc[hit] << BITS | slot[hit])
                total = bias + np.bincount(key >> BITS, table[key & ((1 << BITS) - 1)], part.num_rows)
                score = 1 / (1 + np.exp(-np.clip(total, -35, 35))) if len(slots) else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(score)], ["row", "score"])

    return run


def scored_rows(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """(row, score): the columns ``keep`` as one struct, whatever their names, and a score from 0 to 1. Null
    and empty texts get the bias alone; an empty model gives 0."""
    kept = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col("text").alias("text"))
    schema = kept.select("row").withColumn("score", F.lit(0.0)).schema
    return kept.mapInArrow(_scorer(*model), schema)


def fold(id_col: Column, parts: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % parts


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out: int = 1, folds: int = 3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; labels are learnt outside fold ``held_out`` only.

    An empty table gives an empty result; a row with a null id is scored and counts as not held out."""
    model = train(docs, labels.where(fold(F.col("doc_id"), folds) != held_out), **options)
    out = scored_rows(docs, model, ["doc_id"]).select("row.doc_id", "score")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
