"""Mixing sources to target weights by Pfair scheduling (Baruah et al., 1996), on DataFrames alone.

The rows of each source form blocks of ``block_rows``. With weight w the i-th block of a source is released in slot
floor((i - 1) / w) and due by slot ceil(i / w); earliest-deadline-first picks one released block per slot. No source
is ever a whole block ahead of or behind its share. When a source has no blocks left, the others go on with their
weights scaled up, and the windows count from there. Every row is placed: sources without a weight follow at the end.

Weights are exact: a number counts as the decimal that it prints as, and all windows are whole-number arithmetic. The
schedule repeats after as many slots as the weights have parts in all, so a phase needs no more of it than one period, and
no more than there are blocks; the slot of any block follows from its number. Where both are more than ``most_slots``,
blocks are made larger by twos until the plan fits. The plan is a table in the shared folder.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.llm.common import Scratch, dealt_rank
from relmill.sources.tables import write_text

MOST_SLOTS = 1 << 19
#: Rows of a plan up to which it is broadcast.
FEW = 100_000


def period(share: Mapping[str, int], slots: int | None = None) -> dict[str, list[tuple[int, int, int]]]:
    """(slot, release, deadline) of each source's blocks by earliest deadline, over one period, the sum of the shares, or
    its first ``slots``."""
    total, out = sum(share.values()), {s: [] for s in share}
    # subtask i of s: release floor((i-1) total / share), deadline ceil(i total / share)
    waiting = [(0, -(-total // w), s, 1) for s, w in share.items()]
    heapq.heapify(waiting)
    ready: list = []
    for slot in range(total if slots is None else min(slots, total)):
        while waiting and waiting[0][0] <= slot:
            release, due, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, i, release))
        due, s, i, release = heapq.heappop(ready)
        out[s].append((slot, release, due))
        if i < share[s]:
            heapq.heappush(waiting, (i * total // share[s], -(-(i + 1) * total // share[s]), s, i + 1))
    return out


def parts(weights: Mapping[str, float]) -> dict[str, int]:
    """Positive weights as whole parts of their sum, without a common divisor."""
    exact = {s: Fraction(str(w)) for s, w in weights.items() if w > 0}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * scale) for s, w in exact.items()}
    least = math.gcd(*whole.values())
    return {s: w // least for s, w in whole.items()}


def phases(blocks: Mapping[str, int], weights: Mapping[str, float]) -> list[tuple[int, int, dict[str, tuple[int, int, list]]]]:
    """(first slot, period, {source: (first block, blocks, blocks of the period)}) of each phase; one ends with a source."""
    left = {s: blocks[s] for s in sorted(blocks) if blocks[s] and weights.get(s, 0) > 0}
    done, out, begin = dict.fromkeys(left, 0), [], 0
    while left:
        part = parts({s: weights[s] for s in left})
        total = sum(part.values())
        # the phase ends when a source has placed its last block, in the slot before its deadline at the latest
        plan = period(part, min(-(-n * total // part[s]) for s, n in left.items()))
        ends = {s: (r // part[s]) * total + plan[s][r % part[s]][0] for s in part for r in [left[s] - 1] if r % part[s] < len(plan[s])}
        length = min(ends.values()) + 1
        turns, rest = divmod(length, total)
        placed = {s: turns * part[s] + sum(x[0] < rest for x in plan[s]) for s in part}
        out.append((begin, total, {s: (done[s], placed[s], plan[s] if turns else [x for x in plan[s] if x[0] < rest]) for s in part if placed[s]}))
        for s, n in placed.items():
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        begin += length
    return out


def planned(sizes: Mapping[str, int], weights: Mapping[str, float], block_rows: int, most_slots: int = MOST_SLOTS) -> tuple[int, list]:
    """Rows of a block and the phases, of sources with so many rows."""
    while True:
        blocks = {s: -(-n // block_rows) for s, n in sizes.items() if weights.get(s, 0) > 0}
        period_ = sum(parts({s: weights[s] for s in blocks}).values()) if blocks else 0
        # phases but the first have other, shorter periods; none has more slots than blocks
        if min(sum(blocks.values()), period_ * max(1, len(blocks))) <= most_slots:
            return block_rows, phases(blocks, weights)
        block_rows *= 2


def pfair(blocks: Mapping[str, int], weights: Mapping[str, float]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, phase) in slot order, for whole numbers of blocks per source: the schedule
    of ``phases`` written out."""
    out = []
    for number, (begin, total, sources) in enumerate(phases(blocks, weights)):
        for s, (first, n, plan) in sources.items():
            for i in range(n):
                slot, release, due = (begin + i // len(plan) * total + x for x in plan[i % len(plan)])
                out.append((slot, (s, first + i, release, due, number)))
    return [x for _, x in sorted(out)]


def plan_table(scratch: Scratch, rows: list[tuple], ddl: str, name: str) -> DataFrame:
    """The rows of a plan as a table, by way of lines of JSON in the shared folder."""
    names = [x.split()[0] for x in ddl.split(", ")]
    path = f"{scratch.root}/{name}.json"
    write_text(scratch.spark, path, "".join(json.dumps(dict(zip(names, row, strict=True))) + "\n" for row in rows))
    return scratch.store(scratch.spark.read.schema(ddl).json(path), name)


ADDED = ("_block", "_slot", "_place", "_release", "_deadline", "_phase")


def placed_rows(docs: DataFrame, weights: Mapping[str, float], source_col: str, order: tuple[str, ...], block_rows: int, most_slots: int = MOST_SLOTS) -> DataFrame:
    """(row, _block, _slot, _place, _release, _deadline, _phase), the row being all columns as one struct."""
    scratch = Scratch(docs.sparkSession)
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    if weights:
        known = F.create_map(*[x for s in sorted(weights) for x in (F.lit(s), F.lit(True))])
        source = F.when(F.coalesce(F.element_at(known, source), F.lit(False)), source).otherwise("")
    else:
        source = F.lit("")
    named = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), source.alias("_group"), *[F.col(c).alias(f"_order{i}") for i, c in enumerate(order)])
    sizes = {r["_group"]: r["n"] for r in named.groupBy("_group").agg(F.count("*").alias("n")).collect()}  # a row per weight at most
    block_rows, plan = planned({s: n for s, n in sizes.items() if s}, weights, block_rows, most_slots)
    spans, slots = [], []  # a row per source and phase, and per source, phase and block of the period
    for number, (begin, total, sources) in enumerate(plan):
        for s, (first, n, turns) in sources.items():
            spans.append((s, number, first, first + n, begin, total, len(turns)))
            slots += [(s, number, k, *x) for k, x in enumerate(turns[:n])]
    fields = ["_group string, _phase int, _first long, _last long, _begin long, _total long, _share long", "_group string, _phase int, _turn long, _s long, _r long, _d long"]
    few = len(slots) <= FEW
    spans, slots = (plan_table(scratch, rows, ddl, name) for rows, ddl, name in zip((spans, slots), fields, ("spans", "slots"), strict=True))
    ranked = dealt_rank(named, scratch, "_group", [f"_order{i}" for i in range(len(order))], sum(sizes.values()))
    ranked = ranked.withColumns({"_block": F.floor(F.col("rank") / block_rows).cast("long"), "_place": F.pmod("rank", F.lit(block_rows)).cast("int")})
    held = F.broadcast(spans.withColumnRenamed("_group", "_g"))
    placed = ranked.join(held, (F.col("_group") == F.col("_g")) & (F.col("_block") >= F.col("_first")) & (F.col("_block") < F.col("_last")), "left")
    since = F.col("_block") - F.col("_first")
    placed = placed.withColumns({"_turn": since % F.col("_share"), "_shift": F.col("_begin") + F.floor(since / F.col("_share")).cast("long") * F.col("_total")})
    placed = placed.join(F.broadcast(slots) if few else slots.hint("merge"), ["_group", "_phase", "_turn"], "left")
    last = max((begin + sum(n for _, n, _ in sources.values()) for begin, _, sources in plan), default=0)
    slot = F.coalesce(F.col("_shift") + F.col("_s"), F.lit(last) + F.col("_block")).cast("long")
    windows = [(F.col("_shift") + F.col(c)).alias(name) for c, name in (("_r", "_release"), ("_d", "_deadline"))]
    return placed.select("row", "_block", slot.alias("_slot"), "_place", *windows, "_phase")


def mix(docs: DataFrame, weights: Mapping[str, float], source_col: str = "source", order: tuple[str, ...] = ("doc_id",), block_rows: int = 64) -> DataFrame:
    """All rows and columns of docs with _block, _slot, _place, _release, _deadline and _phase, which replace
    columns of those names.

    Read in order of (_slot, _place) the sources keep to their weights, exactly: less than one block of deviation from
    them in every phase, for any weights and any number of rows. Rows of a null source or one
    without a weight get slots after all others, in blocks, and null windows. Inside a source the order is
    a hash of ``order``, then ``order`` itself; nulls there are allowed and repeated rows stay apart. An
    empty table gives an empty result.
    """
    out = placed_rows(docs, weights, source_col, order, block_rows)
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED], *ADDED)


def in_order(docs: DataFrame, weights: Mapping[str, float], source_col: str = "source", order: tuple[str, ...] = ("doc_id",), block_rows: int = 64) -> DataFrame:
    """docs, rows and columns as they are, sorted by slot and place over the partitions."""
    out = placed_rows(docs, weights, source_col, order, block_rows)
    return out.repartitionByRange("_slot").sortWithinPartitions("_slot", "_place").select(*[F.col("row")[c].alias(c) for c in docs.columns])
