"""Shared pieces of the corpus operators: byte-level tokens, ranks and links."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relmill.operators.components import connected_components
from relmill.staging import Scratch

# Executors get the small helpers below with each task and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ------------------------------------------------------------------------------------------------
# Tokens of a batch of texts, worked out on its bytes: A-Z lower-cased, words [^\x20\x09-\x0D]+.

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KEEP = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values of whole numbers, sorted. One sort costs a fifth of np.unique, which hashes them first."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def raw(texts) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and the offsets of its values; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch, column: str, most_bytes: int = 3 << 20):
    """Parts of an Arrow record batch with about ``most_bytes`` of text each, so that memory stays flat."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most_bytes, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def token_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words in ``data``; no word crosses two texts."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = ink & cut[:n]
    first[1:] |= ink[1:] & ~ink[:-1]
    last = ink & cut[1:]
    last[:-1] |= ink[:-1] & ~ink[1:]
    last[-1] = ink[-1]
    first[0] = ink[0]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each lower-cased word and the number of the text that it is in, in text order."""
    return sized_hashes(texts)[:2]


def sized_hashes(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_hashes, with the words' numbers of bytes."""
    data, offsets = raw(texts)
    low = np.full(len(data) + 8, 32, np.uint8)
    low[: len(data)] = LOWER[data]
    starts, ends, doc = token_spans(low[: len(data)], offsets)
    size = ends - starts
    return span_hashes(low, starts, size), doc, size


def span_hashes(low: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of ``size`` bytes at ``starts``; eight more bytes follow the last text in ``low``."""
    view = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
    h = mix(size.astype(np.uint64) * M1)
    left, where = size, np.arange(len(size))
    at = starts
    while len(where):
        part = view[at] & KEEP[np.minimum(left, 8)]
        h[where] = mix((h[where] ^ part) * M1 + M3)
        more = left > 8
        where, at, left = where[more], at[more] + 8, left[more] - 8
    return h


# ------------------------------------------------------------------------------------------------
# Rows without an id, which take part under a name made from their content. Names are above all ids.

NAMED = 1 << 62


def known_or_named(id_: Column, *content: Column) -> Column:
    """The id, or for a null one a number from 2^62 on that equal contents share."""
    return F.coalesce(id_.cast("long"), F.pmod(F.xxhash64(*content), F.lit(NAMED - 1)) + F.lit(NAMED))


def known(id_) -> Column:
    """The id again, null for a name."""
    c = F.col(id_) if isinstance(id_, str) else id_
    out = F.when(c < NAMED, c)
    return out.alias(id_) if isinstance(id_, str) else out


# ------------------------------------------------------------------------------------------------
# Ranks and links without an unbounded group in one task.


def dealt_rank(df: DataFrame, scratch: Scratch, by: str, order: list[str], rows: int, per_task: int = 200_000) -> DataFrame:
    """Adds ``rank``, from 0 within ``by``. A group is dealt to salts by a hash of ``order`` and ranked inside
    each; the salts' counts, pre-aggregated, give where each salt begins. Hot groups spread over all salts."""
    salts = max(1, -(-rows // per_task))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(by, "_salt").agg(F.count("*").alias("_n"))
    begin = F.sum("_n").over(Window.partitionBy(by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    begins = scratch.store(counts.select(F.col(by).alias("_by"), F.col("_salt").alias("_s"), F.coalesce(begin, F.lit(0)).alias("_begin")), "rank-begins")
    ranked = salted.withColumn("_rn", F.row_number().over(Window.partitionBy(by, "_salt").orderBy(*order)))
    joined = ranked.join(begins, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_salt") == F.col("_s")))
    return joined.withColumn("rank", F.col("_begin") + F.col("_rn") - 1).drop("_by", "_s", "_salt", "_begin", "_rn")


def likeliest(candidates: DataFrame) -> DataFrame:
    """Of pairs (a, b, shared), for every id the one that shares most keys, ties to the smallest other id."""
    ends = candidates.select("a", "shared", F.col("b").alias("o")).unionByName(candidates.select(F.col("b").alias("a"), "shared", F.col("a").alias("o")))
    best = ends.groupBy("a").agg(F.min_by("o", F.struct(-F.col("shared"), "o")).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def joined_groups(groups: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The groups (node, component) with the links (a, b) added. Only components that the links join meet again, each as one
    vertex; a component's name is its smallest node, so the smallest of the joined ones names all."""
    of = lambda side: groups.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")).hint("merge")
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = scratch.store(connected_components(ends, scratch), "joined")
    nodes = groups.unionByName(top.select("node", F.col("node").alias("component"))).distinct()  # ids that had no link before
    new = top.select(F.col("node").alias("component"), F.col("component").alias("_c")).hint("merge")
    return nodes.join(new, "component", "left").select("node", F.coalesce("_c", "component").alias("component"))


def linked_groups(members: DataFrame, scratch: Scratch, verify, fits=None, small: int = 16, salts: int = 16, likely_first: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """(node, component) of the ids that verified links join; ids without a link are absent.

    members: key, id and attributes; keys, if given, the same rows without the attributes, to be counted without a join. Ids that share a key are candidates, ``fits(a, b)`` is a condition on
    two members' attributes, ``verify(pairs)`` keeps the true links of (a, b). Keys with up to ``small``
    members give all their pairs. Larger keys first test every member against one head, the member that is in
    the most large keys, then against
    ``salts`` heads, and at last only those pairs whose members are still in different components. No pair
    that could join two components is left out, yet a group that its heads connect never makes all pairs.
    With ``likely_first`` every id is first tested against the one candidate that shares most keys with it, and of the
    other pairs only those are tested that are still in different components.
    """
    cols = [c for c in members.columns if c not in ("key", "id")]
    mark = len(scratch.stored)
    sizes = scratch.store((members if keys is None else keys).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key-sizes")
    live = scratch.store(members.join(sizes.hint("merge"), "key"), "key-members")
    spare = lambda side, df: df.select("key", *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != "key"])
    ok = fits({c: F.col(f"a_{c}") for c in cols}, {c: F.col(f"b_{c}") for c in cols}) if fits else F.lit(True)
    few = live.where(F.col("n") <= small).drop("n")
    pairs = spare("a", few).join(spare("b", few), "key").where((F.col("a_id") < F.col("b_id")) & ok).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    many = live.where(F.col("n") > small).drop("n")
    has_many = bool(many.take(1))
    if has_many:  # a head should be like many: the member of the most large keys, such as what all copies came from
        weight = many.groupBy("id").agg(F.count("*").alias("w"))
        many = scratch.store(many.join(scratch.store(weight, "weights").hint("merge"), "id"), "large-keys")

    def heads(df: DataFrame, k: int) -> DataFrame:
        best = F.max(F.struct("w", (-F.col("id")).alias("m"))).alias("_b")  # ties to the smallest id
        return df.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(k)).alias("_s")).agg(best).select("key", (-F.col("_b.m")).cast(df.schema["id"].dataType).alias("id"))

    def across(df: DataFrame, k: int) -> DataFrame:
        """Pairs of every member with the k heads of its key, where the components differ."""
        top = scratch.store(heads(df, k).join(df, ["key", "id"]).dropDuplicates(["key", "id"]), "heads")
        new = spare("a", top).join(spare("b", df), "key").where((F.col("a_id") != F.col("b_id")) & (F.col("a_c") != F.col("b_c")) & ok)
        return new.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))

    if has_many:
        pairs = pairs.unionByName(across(many.withColumn("c", F.col("id")), 1))
    if likely_first:
        candidates = scratch.store(pairs.groupBy("a", "b").agg(F.count("*").alias("shared")), "candidates")
        tested = candidates.select("a", "b")
        first = scratch.store(likeliest(candidates), "pairs")
        links = scratch.store(verify(first).select("a", "b"), "links")
        groups = scratch.store(connected_components(links, scratch), "groups")
        of = lambda side: groups.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")).hint("merge")
        rest = tested.join(first.hint("merge"), ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        rest = scratch.store(rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "pairs")
        groups = scratch.store(joined_groups(groups, scratch.store(verify(rest).select("a", "b"), "links"), scratch), "groups")
    else:
        tested = scratch.store(pairs.distinct(), "pairs")
        groups = scratch.store(connected_components(scratch.store(verify(tested).select("a", "b"), "links"), scratch), "groups")
    for k in (salts, None) if has_many else ():
        placed = many.join(groups.select(F.col("node").alias("id"), F.col("component").alias("c")).hint("merge"), "id", "left").withColumn("c", F.coalesce("c", "id"))
        parts = placed.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key")
        open_keys = parts.agg(F.count("*").alias("parts"), F.max(F.struct("n", "c"))["c"].alias("main")).where("parts > 1")
        open_keys = scratch.store(open_keys.select("key", "main"), "open-keys")
        if not open_keys.take(1):
            break
        placed = scratch.store(placed.join(open_keys.hint("merge"), "key"), "open")
        if k:
            new = across(placed, k)
        else:  # those outside a key's largest component against all: the largest never meets itself
            once = (F.col("b_c") == F.col("a_main")) | (F.col("a_id") < F.col("b_id"))
            both = spare("a", placed.where("c <> main")).join(spare("b", placed), "key").where((F.col("a_c") != F.col("b_c")) & once & ok)
            new = both.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
        fresh = scratch.store(new.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        more = scratch.store(verify(fresh).select("a", "b"), "links")
        tested = tested.unionByName(fresh)
        if more.take(1):
            groups = scratch.store(joined_groups(groups, more, scratch), "groups")
    scratch.drop_since(mark, groups)
    return groups
