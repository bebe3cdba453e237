"""N-gram Jaccard join by a size-aware heavy-light scheme (after Deng, Tao and Li, 2018).

A document is its set of distinct five-word shingles. Two sets of n and m shingles with a Jaccard
similarity of at least t share at least ceil(t max(n, m)) of them, so under any one order of all
shingles the first n - ceil(t n) + k of either set share k. The order is a hash, with the shingles
that very many documents hold moved to its end.

* Small sets (n up to a boundary) enumerate every subset of size two of that prefix for k = 2.
* Large sets, and the small ones near enough in size to match one, post the prefix for k = 1 to
  inverted lists and scan those.
* The boundary is where the estimated cost of the two is least, from the counted sizes and the mean
  length of the lists.

Equal sets are collapsed first. A candidate must pass two bounds that no true link fails: after their
first common shingle both sets must still hold enough (the positional filter), and the prefixes must
share enough of the overlap themselves. What passes is verified exactly on the whole texts. Groups are the
components of the links, so a group of copies is never expanded into all its pairs.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.llm.common import M1, M2, Scratch, distinct, known, known_or_named, linked_groups, mix, slices, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 5
LOW = 53  # bits of a shingle's hash; the rest of the 64 number the texts of a slice
MOST = 1 << (63 - LOW)
PLACE = 20  # low bits of a posted key: its place in the order, for the positional filter


def shingles(texts) -> np.ndarray:
    """Distinct text << LOW | shingle hash of a slice of at most MOST texts, sorted by text, then hash."""
    h, doc = word_hashes(texts)
    n = np.bincount(doc, minlength=len(texts))
    s = h.copy()
    for k in range(1, min(WORDS, len(h))):  # a slice may hold fewer words in all
        s[: len(h) - k] = mix(s[: len(h) - k] * M1 + h[k:])
    full = np.zeros(len(h), bool)
    if len(h) >= WORDS:
        full[: len(h) - WORDS + 1] = doc[: len(h) - WORDS + 1] == doc[WORDS - 1 :]
    out = [doc[full].astype(np.uint64) << np.uint64(LOW) | s[full] >> np.uint64(64 - LOW)]
    begin = np.cumsum(n) - n
    for size in range(1, WORDS):  # a text of fewer words is one shingle
        at = np.flatnonzero(n == size)
        if len(at):
            x = h[begin[at]]
            for k in range(1, size):
                x = mix(x * M1 + h[begin[at] + k])
            out.append(at.astype(np.uint64) << np.uint64(LOW) | mix(x + np.full(1, size, np.uint64) * M2) >> np.uint64(64 - LOW))
    return distinct(np.concatenate(out))


def texts_of(batch, column: str):
    for part in slices(batch, column):
        for lo in range(0, part.num_rows, MOST):
            yield part.slice(lo, MOST)


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def prefix_mask(key: np.ndarray, doc: np.ndarray, n: np.ndarray, late: np.ndarray, percent: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the prefix members in the order (late?, hash) and their texts."""
    if len(late):
        last = np.isin(key, late)
        order = np.lexsort((key, last, doc))
    else:
        order = np.arange(len(key))
    begin = np.cumsum(n) - n
    place = np.arange(len(key)) - np.repeat(begin, n)
    keep = place < np.repeat(np.minimum(n, n - least_overlap(n, percent) + k), n)
    return order[keep], doc[keep]


def _profile(percent: int, late: np.ndarray, boundary: int, key_bits: int):
    """doc_id, n, two hashes of the set, and the keys that its size class posts."""
    shift = np.uint64(LOW - key_bits)

    def run(batches):
        for batch in batches:
            for part in texts_of(batch, "text"):
                both = shingles(part.column("text"))
                doc, key = (both >> np.uint64(LOW)).astype(np.int64), both & np.uint64((1 << LOW) - 1)
                n = np.bincount(doc, minlength=part.num_rows)
                s1, s2 = np.zeros(part.num_rows, np.uint64), np.zeros(part.num_rows, np.uint64)
                np.add.at(s1, doc, mix(key + M1)), np.add.at(s2, doc, mix(key * M2 + M1))
                place = lambda of: np.minimum(np.arange(len(of)) - np.searchsorted(of, of), (1 << PLACE) - 1).astype(np.uint64)
                post = lambda k, where: k << np.uint64(PLACE) | where
                at, of = prefix_mask(key, doc, n, late, percent, 1)
                listed = n[of] > boundary * percent // 100  # large, or near enough in size to match a large one
                keys, docs = [post(key[at] >> shift, place(of))[listed]], [of[listed]]
                small = (n[doc] <= boundary) & (n[doc] > 1)
                if small.any():
                    own = np.bincount(doc[small], minlength=part.num_rows)
                    at, of = prefix_mask(key[small], doc[small], own, late, percent, 2)
                    x, where = key[small][at], place(of)
                    for gap in range(1, int(np.bincount(of).max())):
                        same = of[gap:] == of[:-gap]
                        a, b = np.minimum(x[:-gap], x[gap:])[same], np.maximum(x[:-gap], x[gap:])[same]
                        pair = mix(mix(a + M1) + b) >> np.uint64(64 - key_bits) | np.uint64(1 << key_bits)
                        # two are shared when the second is reached, so one more may follow than its place says
                        keys.append(post(pair, where[gap:][same] - np.uint64(1))), docs.append(of[gap:][same])
                keys, docs = np.concatenate(keys).astype(np.int64), np.concatenate(docs)
                order = np.argsort(docs, kind="stable")
                ends = np.searchsorted(docs[order], np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[order]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists], ["doc_id", "n", "s1", "s2", "keys"]
                )

    return run


def _listed(percent: int, often: int = 4):
    """Per batch: keys, how often they stand in a prefix of the plain hash order and in all sets. Keys outside
    all prefixes are named only if the batch holds them ``often``: they matter for the order alone, as keys
    that would come up once the frequent ones before them have moved to the end."""

    def run(batches):
        for batch in batches:
            found, listed = [], []
            for part in texts_of(batch, "text"):
                both = shingles(part.column("text"))
                doc, key = (both >> np.uint64(LOW)).astype(np.int64), both & np.uint64((1 << LOW) - 1)
                n = np.bincount(doc, minlength=part.num_rows)
                at, _ = prefix_mask(key, doc, n, np.zeros(0, np.uint64), percent, 1)
                found.append(key), listed.append(key[at])
            key, t = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            own, count = np.unique(np.concatenate(listed), return_counts=True) if listed else (key, t)
            c = np.zeros(len(key), np.int64)
            c[np.searchsorted(key, own)] = count
            keep = (c > 0) | (t >= often)
            yield pa.RecordBatch.from_arrays([pa.array(key[keep].astype(np.int64)), pa.array(c[keep]), pa.array(t[keep])], ["key", "c", "t"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            for part in texts_of(batch, "ta"):
                hit = []
                for lo in range(0, part.num_rows, 64):
                    sub = part.slice(lo, 64)
                    a, b = shingles(sub.column("ta")), shingles(sub.column("tb"))
                    inter = np.bincount((np.intersect1d(a, b, assume_unique=True) >> np.uint64(LOW)).astype(np.int64), minlength=sub.num_rows)
                    na, nb = (np.bincount((x >> np.uint64(LOW)).astype(np.int64), minlength=sub.num_rows) for x in (a, b))
                    hit.append((100 * inter >= percent * (na + nb - inter)) & (inter > 0))
                yield part.select(["a", "b"]).filter(pa.array(np.concatenate(hit)))

    return run


def choose_boundary(sizes: dict[int, int], mean_list: float, percent: int, most: int = 64) -> int:
    """The set size up to which enumerating pairs of the prefix is cheaper than scanning the lists."""
    p = lambda n: n - math.ceil(percent * n / 100) + 1
    cost = lambda b: (
        sum(c * math.comb(min(n, p(n) + 1), 2) for n, c in sizes.items() if n <= b) + sum(c * p(n) * mean_list for n, c in sizes.items() if n > b * percent // 100)
    )
    return min(range(most + 1), key=lambda b: (cost(b), b))


def jaccard_groups(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", heavy: int = 200, most_heavy: int = 100_000, key_bits: int = 40) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach) for every row.

    Null and empty texts have an empty set and link with nothing, their component is their own id. Rows with a
    null id link as any other; their component is the smallest id that is known, or null without one. A repeated
    row has an equal set, and so shares its own component. Ids are below 2^62. Other columns are
    ignored; an empty table gives an empty result. ``heavy`` only steers the order of shingles: no list,
    candidate or partner is dropped.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(known_or_named(F.col(id_col), F.col(text_col)).alias("doc_id"), F.col(text_col).alias("text"))
    counts = texts.select("text").mapInArrow(_listed(percent), "key long, c long, t long").groupBy("key").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).where("t > 1")
    counts = scratch.store(counts, "listed")
    level = counts.groupBy(F.floor(F.log2("t")).cast("int").alias("b")).agg(F.count("*").alias("k"), F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc")).collect()  # 63 rows at most
    limit = next((b for b in range(int(math.log2(heavy)), 64) if sum(r.k for r in level if r.b >= b) <= most_heavy), 63)
    late = np.sort(np.array([r.key for r in counts.where(F.col("t") >= 2**limit).select("key").collect()], np.uint64)) if any(r.b >= limit for r in level) else np.zeros(0, np.uint64)
    mean_list = 1 + sum(r.cc for r in level if r.b < limit) / max(1, sum(r.c for r in level if r.b < limit))
    words = F.size(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"))  # only for the cost: about how many shingles
    sizes = {r["n"]: r["c"] for r in texts.where(F.length("text") < 4096).groupBy(F.greatest(F.lit(1), words - 4).alias("n")).agg(F.count("*").alias("c")).where("n <= 128").collect()}
    boundary = choose_boundary(sizes, mean_list, percent)
    sets = scratch.store(texts.mapInArrow(_profile(percent, late, boundary, key_bits), "doc_id long, n long, s1 long, s2 long, keys array<long>"), "sets")
    some = sets.where("n > 0")
    reps = scratch.store(some.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys")), "distinct-sets")
    posted = reps.select(F.explode("keys").alias("v"), "id", "n")
    members = posted.select(F.shiftright("v", PLACE).alias("key"), "id", F.col("n").alias("size"), F.col("v").bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int").alias("place"))

    def enough(overlap, n, m):
        """Whether an overlap is as large as a similarity of ``percent`` needs."""
        return overlap * (100 + percent) >= (n + m) * percent

    def fits(a, b):
        return enough(F.least(a["size"] - a["place"], b["size"] - b["place"]), a["size"], b["size"])

    def of_ids(pairs: DataFrame, table: DataFrame, name: str) -> DataFrame:
        """The rows of a table (id, ...) that the pairs name, stored."""
        wanted = scratch.store(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
        small = wanted.count() <= 1_000_000  # the list of ids is broadcast only if it is short
        return scratch.store(table.join(F.broadcast(wanted) if small else wanted.hint("merge"), "id").dropDuplicates(["id"]), name)

    def beside(pairs: DataFrame, rows: DataFrame) -> DataFrame:
        """Pairs with the rows of both sides, columns prefixed a_ and b_."""
        for side in ("a", "b"):
            pairs = pairs.join(rows.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c != "id"]).hint("merge"), side)
        return pairs

    def verify(pairs: DataFrame) -> DataFrame:
        # the overlap is at most what the prefixes share and the longer of the two rests
        least = lambda n: F.ceil(n * percent / 100)
        prefixes = of_ids(pairs, reps.select("id", "n", F.transform("keys", lambda v: F.shiftright(v, PLACE)).alias("k")), "wanted-prefixes")
        both = beside(pairs, prefixes)
        most = F.size(F.array_intersect("a_k", "b_k")) + F.greatest(least(F.col("a_n")), least(F.col("b_n"))) - 1
        lists = F.least("a_n", "b_n") > boundary * percent // 100  # both posted their whole prefix
        near = scratch.store(both.where(~lists | enough(most, F.col("a_n"), F.col("b_n"))).select("a", "b"), "near")
        found = of_ids(near, texts.select(F.col("doc_id").alias("id"), F.col("text").alias("t")), "wanted-texts")
        return beside(near, found).select("a", "b", F.col("a_t").alias("ta"), F.col("b_t").alias("tb")).mapInArrow(_verify(percent), "a long, b long")

    groups = linked_groups(members, scratch, verify, fits)
    classes = reps.select("s1", "s2", "n", "id").join(groups.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left")
    classes = scratch.store(classes.select("s1", "s2", "n", F.coalesce("component", "id").alias("component")), "classes")
    scratch.drop_since(0, sets, classes)
    out = sets.select("doc_id", "n", "s1", "s2").join(classes.hint("merge"), ["s1", "s2", "n"], "left")
    return out.select(known("doc_id"), F.col("n").alias("n_shingles"), known(F.coalesce("component", "doc_id")).alias("component_id"))
