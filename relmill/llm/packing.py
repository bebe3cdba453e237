"""Best-fit packing of tokenised documents, after a Martello-Toth dominance reduction.

Lengths are whole numbers up to the sequence length, so the whole instance is its histogram: at most
``length`` counts, whatever the size of the corpus. The reduction and the best-fit work on those counts
and return runs ("the items of this length from this rank on go to these sequences at this offset").
The documents themselves are ranked within their length and placed by the runs, in parallel.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.operators.ordered import row_index
from relmill.llm.common import KEEP, LOWER, M1, M3, Scratch, dealt_rank, mix, raw, slices, token_spans

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def reduce_counts(counts: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Martello-Toth reduction: takes sets off ``counts`` (by size) that some optimal packing contains.

    Returns (size, partner size or 0, times). A set with item j is fixed when it dominates every other
    feasible set with j: j alone if nothing fits beside it; j with the largest fitting k if they fill the
    sequence, if only one item fits beside j, or if at most two do and no two together outweigh k. Taking
    items away only raises the smallest sizes, so each rule holds for as many copies as there are.
    """
    fixed = []
    changed = True
    while changed:
        changed = False
        for j in range(length, 0, -1):
            while counts[j]:
                left = counts.copy()
                left[j] -= 1
                have = np.flatnonzero(left[: length - j + 1])
                if not len(have):
                    m, k = int(counts[j]), 0
                    if 2 * j <= length:  # copies of j fit beside each other: only the last one is alone
                        m = 1
                else:
                    k = int(have[-1])
                    small = np.repeat(have[:3], np.minimum(left[have[:3]], 3))[:3]
                    room = length - j
                    if k == room or len(small) < 2 or small[:2].sum() > room:
                        pass
                    elif len(small) < 3 or small.sum() > room:
                        # the best pair beside j, by the largest partner of each size
                        best = 0
                        for a in have:
                            rest = left.copy()
                            rest[a] -= 1
                            b = np.flatnonzero(rest[: max(0, room - a) + 1])
                            if len(b):
                                best = max(best, int(a + b[-1]))
                        if best > k:
                            break
                    else:
                        break
                    m = int(counts[j] // 2 if k == j else min(counts[j], counts[k]))
                counts[j] -= m
                if k:
                    counts[k] -= m
                fixed.append((j, k, m))
                changed = True
    return fixed


def plan(histogram: dict[int, int], length: int) -> np.ndarray:
    """Runs (size, first rank, items, first sequence, offset) that pack every item of the histogram."""
    counts = np.zeros(length + 1, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    used, runs, sequences = np.zeros(length + 1, np.int64), [], 0

    def run(size: int, n: int, seq: int, offset: int) -> None:
        runs.append((size, int(used[size]), n, seq, offset))
        used[size] += n

    for j, k, m in reduce_counts(counts, length):
        run(j, m, sequences, 0)
        if k:
            run(k, m, sequences, j)
        sequences += m
    open_ = defaultdict(list)  # room left: (first sequence, how many)
    for size in range(length, 0, -1):
        n = int(counts[size])
        while n:
            room = next((r for r in range(size, length) if open_.get(r)), length)
            if room == length:
                per = min(length // size, n)
                first, have = sequences, max(1, n // per)
                sequences += have
            else:
                first, have = open_[room].pop()
                per = min(room // size, n)
            take = min(have, n // per)
            for i in range(per):
                run(size, take, first, length - room + i * size)
            n -= take * per
            if have > take:
                open_[room].append((first + take, have - take))
            if room - per * size:
                open_[room - per * size].append((first, take))
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


#: Bytes that always end a run of letters in the vocabulary's own splitting. Left out: the apostrophe, which
#: may start a suffix, and < | >, which may be part of a special token.
BREAK = np.zeros(256, bool)
BREAK[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = True
LETTER = np.zeros(256, bool)
LETTER[[i for i in range(128) if chr(i).isalpha()]] = True


class Encoder:
    """Token ids of whole texts. The vocabulary drops white space, lower-cases and never joins a letter with
    a sign after it, so texts are cut there, each distinct part is encoded once and found again by a hash
    of its bytes. The store of parts is emptied when it is full, which bounds the memory of a task."""

    def __init__(self, path: str, most_words: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most_words
        self.clear()

    @staticmethod
    def of_worker(path: str) -> Encoder:
        """One encoder for the life of a Python worker, which runs many tasks."""
        kept = sys.modules.setdefault("relmill_kept_by_worker", types.ModuleType("relmill_kept_by_worker"))
        if not hasattr(kept, "encoders"):
            kept.encoders = {}
        if path not in kept.encoders:
            kept.encoders[path] = Encoder(path)
        return kept.encoders[path]

    def clear(self) -> None:
        self.index, self.pool, self.ends = {}, np.zeros(1 << 20, np.uint32), np.zeros(1, np.int64)

    def add(self, hashes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        lo = int(self.ends[-1])
        if lo + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[lo : lo + len(ids)] = ids
        first = len(self.ends) - 1
        self.index.update(zip(hashes.tolist(), range(first, first + len(hashes)), strict=True))
        self.ends = np.concatenate([self.ends, lo + np.cumsum(counts)])

    def words(self, uniq: np.ndarray, starts, ends, data: np.ndarray, plain: np.ndarray) -> np.ndarray:
        if len(self.index) + len(uniq) > max(self.most, len(uniq)):
            self.clear()
        get = self.index.get
        at = np.array([get(x, -1) for x in uniq.tolist()], np.int64)
        new = np.flatnonzero(at < 0)
        buffer = data.tobytes() if len(new) else b""
        one = new[plain[new]]  # runs of ASCII letters: one pre-token each, so many are encoded as one text
        for lo in range(0, len(one), 2000):
            part = one[lo : lo + 2000]
            text = b" ".join([buffer[s:e] for s, e in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]).decode("ascii")
            enc = self.tokenizer.encode(text, add_special_tokens=False)
            self.add(uniq[part], np.bincount(enc.word_ids, minlength=len(part)), np.array(enc.ids, np.uint32))
        rest = new[~plain[new]]
        if len(rest):
            texts = [buffer[s:e].decode("utf-8", "replace") for s, e in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            ids = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            self.add(uniq[rest], np.array([len(x) for x in ids]), np.array([y for x in ids for y in x], np.uint32))
        for i in new.tolist():
            at[i] = get(int(uniq[i]))
        return at

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by id 0, and the offsets of the texts."""
        data, offsets = raw(texts)
        n_docs = len(offsets) - 1
        if b"<|" not in data.tobytes():  # else a special token could hide or appear
            data = LOWER[data]
        starts, ends, doc = token_spans(data, offsets)
        if not len(starts):
            return np.zeros(n_docs, np.uint32), np.arange(n_docs + 1)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = LETTER[data[:-1]] & BREAK[data[1:]]
        cut[offsets] = False
        inner = np.flatnonzero(cut)
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
        doc = np.searchsorted(offsets, starts, "right") - 1
        pad = np.zeros(len(data) + 8, np.uint8)
        pad[: len(data)] = data
        size = ends - starts
        view = np.ndarray((len(data) + 1,), "<u8", pad, strides=(1,))
        h = mix(size.astype(np.uint64) * M1)
        left, where, at = size, np.arange(len(size)), starts
        while len(where):
            h[where] = mix((h[where] ^ (view[at] & KEEP[np.minimum(left, 8)])) * M1 + M3)
            more = left > 8
            where, at, left = where[more], at[more] + 8, left[more] - 8
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        letters = np.concatenate([[0], np.cumsum(LETTER[data])])
        plain = letters[ends[first]] - letters[starts[first]] == size[first]
        known = self.words(uniq, starts[first], ends[first], data, plain)
        lo, n = self.ends[known][inverse], (self.ends[known + 1] - self.ends[known])[inverse]
        total = np.bincount(doc, n, n_docs).astype(np.int64) + 1
        out_at = np.concatenate([[0], np.cumsum(total)])
        ids = np.zeros(out_at[-1], np.uint32)
        begin = np.concatenate([[0], np.cumsum(n)])
        flat = np.arange(begin[-1]) + np.repeat(lo - begin[:-1], n)
        ids[np.arange(begin[-1]) + np.repeat(doc, n)] = self.pool[flat]
        return ids, out_at


def _cut(path: str, length: int, with_ids: bool, ordered: bool):
    def run(batches):
        encode = Encoder.of_worker(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = encode(part.column("text"))
                size = np.diff(at)
                pieces = -(-size // length)
                row = np.repeat(np.arange(len(size)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * length
                n = np.minimum(size[row] - start, length)
                lo = at[row] + start
                crc = [zlib.crc32(ids[a : a + b].astype("<u4").tobytes()) for a, b in zip(lo.tolist(), n.tolist(), strict=True)]
                out = [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(n), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if ordered:
                    out.append(pa.array(part.column("at").to_numpy(zero_copy_only=False)[row], pa.int64()))
                    names.append("at")
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(lo, at[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def _place(runs: np.ndarray):
    """sequence_id and offset by length and rank; the runs are few (see ``plan``)."""

    def go(batches):
        keys = runs[:, 0] << 44 | runs[:, 1]
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            r = runs[np.searchsorted(keys, size << 44 | rank, "right") - 1] if len(size) else runs[:0]
            keep = [batch.column(c) for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(r[:, 3] + rank - r[:, 1]), pa.array(r[:, 4])], [*[c for c in batch.schema.names if c != "rank"], "sequence_id", "offset"]
            )

    return go


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, order_col: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on request).

    A document is its ids and a closing id 0; null and empty texts are that id alone. Documents longer
    than ``length`` are cut every ``length`` ids, others are never cut. Ties are broken by id and piece.
    With ``order_col`` (a long that is not null) pieces of one length are taken in its order, and sequences
    are numbered by the order of their longest piece, the first such piece if there are several.
    A repeated row is packed once more, a null id stays null. Other columns are ignored and an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    ordered = order_col is not None
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", at long" if ordered else "") + (", ids array<int>" if with_ids else "")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(order_col).cast("long").alias("at")] if ordered else []))
    pieces = scratch.store(texts.mapInArrow(_cut(tokenizer_path, length, with_ids, ordered), schema), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``length`` rows
    if not histogram:
        return pieces.drop("at").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    runs = plan(histogram, length)
    cols = [f.name for f in pieces.schema]
    if not ordered:
        ranked = dealt_rank(pieces, scratch, "length", ["doc_id", "piece"], sum(histogram.values())).withColumn("rank", F.col("rank").cast("long"))
        return ranked.select(*cols, "rank").mapInArrow(_place(runs), schema + ", sequence_id long, offset long")
    # positions over all pieces, less where a length begins: one order per length, whatever the rows
    before = scratch.spark.createDataFrame([(n, sum(c for m, c in histogram.items() if m < n)) for n in histogram], "length long, _before long")
    ranked = row_index(pieces, ["length", "at", "doc_id", "piece"]).join(F.broadcast(before), "length").withColumn("rank", F.col("_row") - F.col("_before"))
    placed = scratch.store(ranked.select(*cols, "rank").mapInArrow(_place(runs), schema + ", sequence_id long, offset long"), "placed")
    first = placed.groupBy("sequence_id").agg(F.min(F.struct((-F.col("length")).alias("l"), "at", "piece")).alias("_f"))
    number = row_index(first.select("sequence_id", "_f.at", "_f.piece"), ["at", "piece", "sequence_id"], "_number").select("sequence_id", "_number")
    named = placed.join(scratch.store(number, "numbers").hint("merge"), "sequence_id").withColumn("sequence_id", F.col("_number"))
    return named.select(*[c for c in cols if c != "at"], "sequence_id", "offset")
