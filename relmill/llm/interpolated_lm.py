"""Deleted interpolation of n-gram estimates (Jelinek and Mercer, 1980), order two.

P(w | u) = l2(b) c(u w) / c(u) + l1(b) c(w) / N + l0(b) / (V + 1), where b is the bucket of c(u) by
powers of two. The weights of each bucket are learnt by expectation-maximisation on one tenth of the
training texts, against counts from which that tenth has been deleted; the final model uses all counts.

Counts and look-ups share one exchange. Texts are dealt by a hash of id and text to chunks of bounded
size. A chunk sends each distinct n-gram once, with its count, to the bucket of the n-gram's hash; the
bucket adds the counts up and sends the totals back in the same order. However frequent an n-gram is,
it is one entry per chunk, so no key is hot, nothing is broadcast but the weights, and nothing is pruned.
N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.llm.common import M1, M2, Scratch, mix, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END, BEGIN = np.uint64(0x454E44), np.uint64(0x424547)
FOLDS, BUCKETS = 10, 40  # one chunk in FOLDS is deleted for the weights; context-frequency buckets


def pack64(x: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes apart, which ordinary block compression then shrinks."""
    return np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack64(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def pack32(x: np.ndarray) -> bytes:
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack32(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def grams(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token keys, keys of each token with the one before, and text numbers; every text ends with END."""
    h, doc = word_hashes(texts)
    n = len(texts)
    per = np.bincount(doc, minlength=n) + 1
    last = np.cumsum(per) - 1
    tokens, at = np.full(int(per.sum()), END), np.repeat(np.arange(n), per)
    words = np.ones(len(tokens), bool)
    words[last] = False
    tokens[words] = h
    before = np.roll(tokens, 1)
    before[last - per + 1] = BEGIN
    return mix(tokens ^ M1), mix(before * M2 + mix(tokens + M1)), at


class Keys:
    """The distinct keys of one kind in a chunk, in the order in which the buckets answer."""

    def __init__(self, occurrences: np.ndarray, buckets: int):
        self.keys, self.inverse = np.unique(occurrences, return_inverse=True)
        where = (self.keys >> np.uint64(40)) % np.uint64(buckets)
        self.order = np.argsort(where, kind="stable")
        self.buckets, begins = np.unique(where[self.order], return_index=True)  # those that hold a key, however many there are
        self.cuts = np.append(begins, len(self.order))

    def counts(self, of: np.ndarray) -> np.ndarray:
        return np.bincount(self.inverse[of], minlength=len(self.keys))

    def answers(self, parts: dict[int, np.ndarray]) -> np.ndarray:
        """Totals for every occurrence, from the buckets' answers."""
        out = np.zeros(len(self.keys), np.int64)
        got = [parts[b] for b in self.buckets.tolist()]
        out[self.order] = np.concatenate(got) if got else np.zeros(0, np.int64)
        return out[self.inverse]


ASK = pa.schema([("bucket", pa.int32()), ("p", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])
ANSWER = pa.schema([("p", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.binary()), ("kept", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64()), ("kept_tokens", pa.int64())])


def _ask(buckets: int):
    def run(chunk: pa.Table) -> pa.Table:
        p, learn = chunk["p"][0].as_py(), chunk["learn"].to_numpy()
        one, two, at = grams(chunk["text"].combine_chunks())
        rows = []
        for kind, occurrences in ((1, one), (2, two)):
            keys = Keys(occurrences, buckets)
            n = keys.counts(slice(None)) if learn.all() else np.bincount(keys.inverse, learn[at], len(keys.keys)).astype(np.int64)
            for b, lo, hi in zip(keys.buckets.tolist(), keys.cuts, keys.cuts[1:], strict=False):
                own = keys.order[lo:hi]
                rows.append((b, p, kind, pack64(keys.keys[own]), pack32(n[own])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ASK, strict=True)], schema=ASK) if rows else ASK.empty_table()

    return run


def _answer(asked: pa.Table) -> pa.Table:
    rows = []
    bucket = asked["bucket"][0].as_py()
    kinds, chunks = asked["kind"].to_numpy(), asked["p"].to_numpy()
    for kind in (1, 2):
        at = np.flatnonzero(kinds == kind)
        if not len(at):
            continue
        keys = [unpack64(asked["keys"][int(i)].as_py()) for i in at]
        n = [unpack32(asked["n"][int(i)].as_py()) for i in at]
        deleted = [c if p % FOLDS == 0 else np.zeros_like(c) for c, p in zip(n, chunks[at], strict=True)]
        uniq, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(n), len(uniq)).astype(np.int64)
        kept = total - np.bincount(inverse, np.concatenate(deleted), len(uniq)).astype(np.int64)
        lo = 0
        for i, k in zip(at, keys, strict=True):
            own = inverse[lo : lo + len(k)]
            lo += len(k)
            rows.append((chunks[i], kind, bucket, pack32(total[own]), pack32(kept[own]) if chunks[i] % FOLDS == 0 else None, None, None, None))
        if kind == 1:
            rows.append((-1, 1, bucket, None, None, int((total > 0).sum()), int(total.sum()), int(kept.sum())))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ANSWER, strict=True)], schema=ANSWER)


def estimates(chunk: pa.Table, answers: pa.Table, field: str, buckets: int):
    """Text numbers, the totals in ``field`` of every token, pair and context, and where texts begin."""
    one, two, at = grams(chunk["text"].combine_chunks())
    kinds, where, blobs = answers["kind"].to_numpy(), answers["bucket"].to_numpy(), answers[field]
    parts = {k: {int(where[i]): unpack32(blobs[int(i)].as_py()) for i in np.flatnonzero(kinds == k)} for k in (1, 2)}
    c1, c2 = Keys(one, buckets).answers(parts[1]), Keys(two, buckets).answers(parts[2])
    context = np.roll(c1, 1)  # every token but END is a context exactly as often as it occurs
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return at, c1, c2, context, first


def mixed(c1, c2, context, tokens: int, types: int):
    bucket = np.where(context > 0, 1 + np.log2(np.maximum(context, 1)).astype(np.int64), 0)
    return np.minimum(bucket, BUCKETS - 1), c2 / np.maximum(context, 1), c1 / max(tokens, 1), 1 / (types + 1)


def interpolated_lm(docs: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 << 20, rounds: int = 12) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every text.

    Texts whose crc32(id) mod ``folds`` is 0 are scored but never learnt from. Null counts as empty; an
    empty text is its END token. A null id is learnt from and scored. Repeated rows count each time;
    other columns are ignored; an empty table gives an empty result. ``chunk_bytes`` bounds the memory of
    a task: raise it with the executors' memory for larger corpora.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    test = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (~test).alias("learn"))
    size = texts.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    chunks = FOLDS * max(1, -(-size // (FOLDS * chunk_bytes)))
    buckets = chunks
    texts = texts.withColumn("p", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))  # the text parts rows of one id, or of none
    asked = texts.groupBy("p").applyInArrow(_ask(buckets), "bucket int, p int, kind int, keys binary, n binary")
    answers = scratch.store(asked.groupBy("bucket").applyInArrow(_answer, "p int, kind int, bucket int, n binary, kept binary, types long, tokens long, kept_tokens long"), "answers")
    got = answers.where("p = -1").agg(F.sum("types"), F.sum("tokens"), F.sum("kept_tokens")).first()
    types, tokens, kept_tokens = (int(x or 0) for x in got)
    begins = texts.agg(F.sum(F.col("learn").cast("long")), F.sum((F.col("learn") & (F.col("p") % FOLDS != 0)).cast("long"))).first()
    starts, kept_starts = (int(x or 0) for x in begins)

    # the deleted tenth, as each token's bucket and estimates
    def deleted(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        out = pa.schema([("bucket", pa.list_(pa.int8())), ("f2", pa.list_(pa.float32())), ("f1", pa.list_(pa.float32()))])
        if not chunk.num_rows:
            return out.empty_table()
        at, c1, c2, context, first = estimates(chunk, replies, "kept", buckets)
        context[first] = kept_starts
        b, f2, f1, _ = mixed(c1, c2, context, kept_tokens, types)
        own = chunk["learn"].to_numpy()[at]
        return pa.Table.from_arrays([pa.array([x[own].astype(t)], f.type) for x, t, f in ((b, np.int8, out[0]), (f2, np.float32, out[1]), (f1, np.float32, out[2]))], schema=out)

    fold = texts.where(F.col("p") % FOLDS == 0).groupBy("p").cogroup(answers.where((F.col("p") >= 0) & (F.col("p") % FOLDS == 0)).groupBy("p"))
    sample = scratch.store(fold.applyInArrow(deleted, "bucket array<tinyint>, f2 array<float>, f1 array<float>"), "deleted")
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)  # a context that was never seen has no f2
    uniform = 1 / (types + 1)
    for _ in range(rounds):
        now = weights

        def expect(batches, now=now):
            total = np.zeros((BUCKETS, 3))
            for batch in batches:
                b, f2, f1 = (c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in batch.columns)
                parts = now[b] * np.stack([f2, f1, np.full(len(b), uniform)], 1)
                parts /= np.maximum(parts.sum(1, keepdims=True), 1e-300)
                for k in range(3):
                    total[:, k] += np.bincount(b, parts[:, k], BUCKETS)
            at = np.flatnonzero(total.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(total[at, k]) for k in range(3))], ["b", "x2", "x1", "x0"])

        sums = sample.mapInArrow(expect, "b int, x2 double, x1 double, x0 double").groupBy("b").agg(*[F.sum(c).alias(c) for c in ("x2", "x1", "x0")]).collect()
        weights = now.copy()
        for r in sums:  # BUCKETS rows at most
            x = np.array([r.x2, r.x1, r.x0])
            weights[r.b] = x / x.sum()
        weights = np.maximum(weights, 1e-9)
        weights[0, 0] = 0
        weights /= weights.sum(1, keepdims=True)
        if np.abs(weights - now).max() < 1e-4:
            break
    if not tokens:
        weights = np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))

    def judge(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        types_ = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not chunk.num_rows:
            return pa.schema(list(zip(names, types_, strict=True))).empty_table()
        n = chunk.num_rows
        at, c1, c2, context, first = estimates(chunk, replies, "n", buckets)
        context[first] = starts
        b, f2, f1, f0 = mixed(c1, c2, context, tokens, types)
        p = weights[b, 0] * f2 + weights[b, 1] * f1 + weights[b, 2] * f0
        base = np.log10((c1 + 0.1) / (tokens + 0.1 * (types + 1)))
        cols = [chunk["doc_id"].combine_chunks(), pa.array(~chunk["learn"].to_numpy()), pa.array(np.bincount(at, minlength=n)), pa.array(np.bincount(at, c1 > 0, n).astype(np.int64))]
        cols += [pa.array(np.full(n, tokens)), pa.array(np.bincount(at, base, n)), pa.array(np.bincount(at, np.log10(p), n))]
        return pa.Table.from_arrays(cols, names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("p").cogroup(answers.where("p >= 0").groupBy("p")).applyInArrow(judge, schema)
