"""Suffix-array deduplication: the common-prefix interval tree of repeated passages.

1. Winnowing (Schleimer et al., 2003) picks in every window of ``length`` bytes the k-gram of least
   hash. Equal windows pick the same one, so two occurrences of a passage share an anchor at the same
   place. Anchors whose k-gram occurs once cannot lie in a repeat and go. Equal texts are collapsed.
2. The windows that picked an anchor, with the bytes around it, are its context. Equal contexts of one
   anchor are repeats as a whole and are collapsed into one that stands for them.
3. The contexts that are left of one anchor are a bucket. Tasks build an enhanced suffix array of a
   bucket's windows (prefix doubling), take the intervals of common prefixes of ``length`` bytes or
   more, drop those that every occurrence extends to the left, and stack-scan the rest into a tree of
   maximal repeats with all their occurrences.
4. A bucket that is too large for a task is split by content: the windows at a range of distances from
   the anchor share a core of bytes, whose hash is the finer key. The range is halved until the buckets
   fit; at a single distance equal keys are equal windows, so the splitting always ends.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.llm.common import M1, M2, M3, Scratch, known, known_or_named, raw, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position, k a multiple of 16; the last k - 1 have none."""
    pad = np.zeros(len(data) + 8, np.uint8)
    pad[: len(data)] = data
    x = np.array(np.ndarray((len(data),), "<u8", pad, strides=(1,)))
    g = x[:-8] * M1 ^ x[8:] * M2
    g ^= g >> np.uint64(29)
    n = len(data) - k + 1
    h = g[:n] * M3
    for at in range(16, k, 16):
        h = (h ^ h >> np.uint64(31)) * M1 + g[at : at + n] * M3
    h ^= h >> np.uint64(32)
    h *= M2
    return h ^ h >> np.uint64(29)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each run of w."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    y = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    y[: len(x)] = x
    y = y.reshape(blocks, w)
    ahead = np.minimum.accumulate(y, 1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """Text number, hash, place of the anchor and first and last start of the windows that picked it."""
    none = [np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64)]
    if len(data) < length:
        return none
    h = gram_hashes(data, k)
    bits = np.uint64(31)  # for places: more than a slice can have, and the same in every slice
    mask = (np.uint64(1) << bits) - np.uint64(1)
    pos = np.arange(len(h), dtype=np.uint64)
    least = sliding_min(h & ~mask | mask - pos, length - k + 1)
    p = (mask - (least & mask)).astype(np.int64)
    start = np.arange(len(p))
    doc = np.searchsorted(offsets, start, "right") - 1
    keep = start + length <= offsets[doc + 1]
    start, p, doc = start[keep], p[keep], doc[keep]
    if not len(p):
        return none
    first = np.flatnonzero((np.diff(p, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1) | (np.diff(doc, prepend=-1) != 0))
    last = np.append(first[1:], len(p)) - 1
    base = offsets[doc[first]]
    return doc[first], h[p[first]], p[first] - base, start[first] - base, start[last] - base


def _anchor_rows(length: int, k: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                data, offsets = raw(part.column("text"))
                doc, h, p, lo, hi = anchors(data, offsets, length, k)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)[doc]
                cols = [pa.array(ids, pa.int64()), pa.array(h.view(np.int64)), *(pa.array(c.astype(np.int32)) for c in (p, lo, hi))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "p", "lo", "hi"])

    return run


def common_prefix(a: bytes, b: bytes) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def interval_tree(lcp: list[int], least: int) -> list[tuple[int, int, int, int]]:
    """(common prefix, first, last, parent) of the lcp-intervals of a run of sorted suffixes, by one scan
    with a stack; lcp[i] is the common prefix of suffixes i and i + 1, parent an index in the list or -1."""
    out: list[list[int]] = []
    stack = [[least, 0, -1]]  # prefix, first suffix, index in out of the node
    children: list[list[int]] = [[]]
    for i, value in enumerate([*lcp, -1]):
        first, carried = i, []
        while stack and value < stack[-1][0]:
            size, first, _ = stack.pop()
            own = children.pop()
            if size > least or not stack:
                out.append([size, first, i, -1])
                for c in own + carried:
                    out[c][3] = len(out) - 1
                carried = [len(out) - 1]
            else:
                carried = own + carried
        if value < 0:
            break
        if stack and value == stack[-1][0]:
            children[-1] += carried
        else:
            stack.append([value, first, -1])
            children.append(carried)
    return [tuple(x) for x in out]


def maximal_repeats(contexts: list[bytes], length: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(prefix length, parent, occurrences) of the maximal repeats of ``length`` bytes or more.

    An occurrence is (context number, start); a node lists its occurrences that no deeper node has, so all
    occurrences of a repeat are those of its subtree. The windows of all contexts are sorted by prefix
    doubling: ranks of 8, 16, ... bytes up to the window.
    """
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
    n = len(data) - 8
    ends = np.cumsum(sizes)
    begins = ends - sizes
    rank = np.unique(np.array(np.ndarray((n,), ">u8", data, strides=(1,))).astype(np.uint64), return_inverse=True)[1].astype(np.uint64)
    step = 8

    def paired(at: np.ndarray, ahead: int) -> np.ndarray:
        other = np.zeros(len(at), np.uint64)
        inside = at + ahead < n
        other[inside] = rank[at[inside] + ahead] + np.uint64(1)
        return np.unique(rank[at] << np.uint64(32) | other, return_inverse=True)[1]

    everywhere = np.arange(n)
    while 2 * step <= length:
        rank, step = paired(everywhere, step).astype(np.uint64), 2 * step
    windows = np.concatenate([np.arange(b, e - length + 1) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)] or [np.zeros(0, np.int64)])
    order_of = paired(windows, length - step) if length > step else np.unique(rank[windows], return_inverse=True)[1]
    repeated = np.bincount(order_of)[order_of] > 1
    at, group = windows[repeated], order_of[repeated]
    order = np.argsort(group, kind="stable")
    at, group = at[order], group[order]
    if not len(at):
        return []
    # left extension: one byte before each window, or a mark of its own at the edge of a context
    owner = np.searchsorted(ends, at, "right")
    before = np.where(at > begins[owner], data[at - 1].astype(np.int64), 256 + at)
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    diverse = np.minimum.reduceat(before, heads) != np.maximum.reduceat(before, heads)
    tails = np.append(heads[1:], len(at))
    text, out = data[:n].tobytes(), []
    for lo, hi in zip(heads[diverse].tolist(), tails[diverse].tolist(), strict=True):
        rows = sorted((text[a + length : e], a, o) for a, o, e in zip(at[lo:hi].tolist(), owner[lo:hi].tolist(), ends[owner[lo:hi]].tolist(), strict=True))
        lcp = [length + common_prefix(x[0], y[0]) for x, y in zip(rows, rows[1:], strict=False)]
        nodes = interval_tree(lcp, length)
        deepest = [-1] * len(rows)
        for i, (_, first, last, _) in enumerate(nodes):  # children come before parents
            for r in range(first, last + 1):
                if deepest[r] < 0:
                    deepest[r] = i
        base = len(out)
        for i, (size, _, _, parent) in enumerate(nodes):
            out.append((size, base + parent if parent >= 0 else -1, [(o, a - int(begins[o])) for (_, a, o), d in zip(rows, deepest, strict=True) if d == i]))
    return out


def _bucket_spans(length: int, most_bytes: int = 1 << 20):
    """Spans of repeats in whole buckets; rows come sorted by key, and a bucket never spans two calls."""

    def spans(rows: list[tuple]):
        found = maximal_repeats([r[4] for r in rows], length)
        doc, start, end = [], [], []
        for size, _, occurrences in found:
            for i, at in occurrences:
                if rows[i][3] == 1:  # contexts that stand for several are covered already
                    s = rows[i][2] + at
                    doc.append(rows[i][1]), start.append(s), end.append(s + size)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["doc_id", "start", "end"])

    def run(batches):
        rows, held, size = [], [], 0  # whole buckets; the bucket that is being read
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0]:
                    rows += held
                    held = []
                    if size > most_bytes:
                        yield spans(rows)
                        rows, size = [], 0
                held.append(row)
                size += len(row[4])
        if rows or held:
            yield spans(rows + held)

    return run


def repeat_spans(docs: DataFrame, scratch: Scratch, length: int, k: int = 48, most_contexts: int = 400) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rep_id, copies) of every document and (doc_id, start, end) of repeats in rep documents.

    docs: doc_id, text (not null)."""
    same = docs.select("doc_id", F.md5("text").alias("m")).groupBy("m").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("copies"))
    same = scratch.store(same, "texts")
    ids = scratch.store(docs.select("doc_id", F.md5("text").alias("m")).join(same.hint("merge"), "m").select("doc_id", "rep_id", "copies"), "text-classes")
    found = docs.mapInArrow(_anchor_rows(length, k), "doc_id long, h long, p int, lo int, hi int")
    own = found.join(same.select(F.col("rep_id").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    own = scratch.store(own.dropDuplicates(["doc_id", "p", "lo"]), "anchors")
    often = scratch.store(own.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated-anchors")
    lists = own.join(often.hint("merge"), "h").groupBy("doc_id").agg(F.collect_list(F.struct("h", "p", "lo", "hi")).alias("list"))
    read = docs.select("doc_id", F.encode("text", "UTF-8").alias("b")).join(lists.hint("merge"), "doc_id").select("doc_id", "b", F.explode("list").alias("a"))
    context = F.expr(f"substring(b, a.lo + 1, a.hi - a.lo + {length})")
    rows = read.select(F.col("a.h").alias("key"), "doc_id", F.col("a.p").alias("p"), (F.col("a.p") - F.col("a.hi")).alias("x0"), (F.col("a.p") - F.col("a.lo")).alias("x1"), context.alias("ctx"))
    rows = scratch.store(rows.withColumns({"full": F.unhex(F.md5("ctx")), "n": F.lit(1)}), "contexts")
    spans, ready, width = [], [], 1 << (length - 1).bit_length()
    while True:
        # equal contexts of a key are repeats from end to end, and one of them goes on
        classes = rows.groupBy("key", "full", "x0").agg(F.sum("n").alias("m"), F.min(F.struct("doc_id", "p")).alias("r"))
        classes = scratch.store(classes, "context-classes")
        copied = classes.where("m > 1").select("key", "full", "x0")
        span = rows.where("n = 1").join(copied.hint("merge"), ["key", "full", "x0"], "left_semi")
        spans.append(scratch.store(span.select("doc_id", (F.col("p") - F.col("x1")).alias("start"), (F.col("p") - F.col("x0") + length).alias("end")), "copied-spans"))
        sizes = scratch.store(classes.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "bucket-sizes")
        left = rows.join(classes.select("key", "full", "x0", "m", "r").hint("merge"), ["key", "full", "x0"]).where("r.doc_id = doc_id and r.p = p")
        left = left.join(sizes.hint("merge"), "key").select("key", "doc_id", "p", "x0", "x1", F.least("m", F.lit(2)).cast("int").alias("n"), "ctx", "c")
        left = scratch.store(left, "buckets")
        ready.append(left.where(F.col("c") <= most_contexts).select("key", "doc_id", (F.col("p") - F.col("x1")).alias("at"), "n", "ctx"))
        big = left.where(F.col("c") > most_contexts)
        if width == 1 or not big.take(1):
            break
        width //= 2
        cut = big.withColumn("slice", F.explode(F.sequence(F.expr(f"x0 div {width}"), F.expr(f"x1 div {width}"))))
        low, high = F.greatest("x0", F.col("slice") * width), F.least("x1", (F.col("slice") + 1) * width - 1)
        core = F.expr(f"substring(ctx, x1 - slice * {width} + 1, {length - width + 1})")
        key = F.xxhash64("key", F.lit(width), "slice", core)
        part = F.substring("ctx", F.col("x1") - high + 1, high - low + length)
        rows = cut.select(key.alias("key"), "doc_id", "p", low.cast("int").alias("x0"), high.cast("int").alias("x1"), part.alias("ctx"), F.col("n").cast("int").alias("n"))
        rows = scratch.store(rows.withColumns({"full": F.unhex(F.md5("ctx"))}).select("key", "doc_id", "p", "x0", "x1", "ctx", "full", "n"), "contexts")
    all_ready = ready[0]
    for r in ready[1:]:
        all_ready = all_ready.unionByName(r)
    n = max(1, spark_partitions(docs))
    trees = all_ready.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_bucket_spans(length), "doc_id long, start int, end int")
    out = scratch.store(trees, "tree-spans")
    for s in spans:
        out = out.unionByName(s)
    return ids, out


def spark_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _cut(length: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = raw(part.column("text"))
                out = [[], [], [], [], []]
                cols = (part.column(c).to_pylist() for c in ("spans", "copies"))
                for i, (spans, copies) in enumerate(zip(*cols, strict=True)):
                    text = data[offsets[i] : offsets[i + 1]].tobytes()
                    merged: list[list[int]] = []
                    whole = [{"start": 0, "end": len(text)}] if copies > 1 and len(text) >= length else []
                    for s in sorted((s["start"], s["end"]) for s in whole + (spans or [])):
                        if merged and s[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s[1])
                        else:
                            merged.append(list(s))
                    at, kept = 0, []
                    for s, e in merged:
                        kept.append(text[at:s])
                        at = e
                    kept = b"".join([*kept, text[at:]])
                    for o, v in zip(out, (len(text), len(text) - len(kept), len(merged), merged, kept), strict=True):
                        o.append(v)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(o, t) for o, t in zip(out, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans ([start, end) pairs) and kept (the bytes that stay).

    Every byte that a ``length``-byte string covers which also starts anywhere else goes, in all its places,
    judged on the input. Matches never cross documents. Null counts as empty; texts shorter than ``length``
    lose nothing. Ids are taken as unique and below 2^62; rows with a null id take part as any other. A repeated row is a
    copy of itself and loses its text if that is long enough. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(known_or_named(F.col(id_col), text).alias("doc_id"), text.alias("text"))
    ids, spans = repeat_spans(texts, scratch, length, **options)
    lists = spans.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    marks = ids.dropDuplicates(["doc_id"]).join(lists.hint("merge"), "doc_id", "left").select("doc_id", "copies", "spans")
    marks = scratch.store(marks, "marks")
    out = texts.join(marks.hint("merge"), "doc_id").mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary")
    return out.withColumn("doc_id", known("doc_id"))
