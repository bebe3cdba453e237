"""Repair of the turns of conversations by signature deduplication.

Rows are sorted by (conversation, turn) over range partitions, so a conversation of any size is spread. Each run of up to
``segment`` rows of a conversation becomes a compact string, its signature: a letter per row for the role and the
fault. Each distinct signature is solved once, by memoised recursion over (row, state of the grammar). Almost every
conversation is one segment. Of longer ones each distinct segment gives its least cost from every state to every state;
a pass over the segments from the last to the first turns these into the cost to go at each cut, another from the
first to the last picks the states, and each distinct (signature, cost to go) is solved once. The edits are joined to
the segments, and one pass over the sorted rows replays them into a running hash, so no text is ever held with others.

Roles must read ``(s?(ua)+)?`` by their initials. The states: 0 nothing yet, 1 after s, 2 after u, 3 after a.
"""

from __future__ import annotations

import hashlib
import sys
from functools import lru_cache

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relmill.staging import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
NEVER = 1 << 40
#: The state after an inserted or re-roled row, and the letter of its role.
THEN, ROLE = (2, 2, 3, 2), ("u", "u", "a", "u")
#: The state after a kept row.
KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
SPACE = " \t\n\x0b\x0c\r"


# ------------------------------------------------------------------------------------------------
# One signature: s u a o for roles, capital if truncated, x for a row that must go.


def recursion(signature: str, end: tuple[int, ...], last: bool):
    """Least cost of rows i.. from a state; and the moves, by their letters D I K R. At most two inserts in a row: two
    bring back the same turn, but for the closing pair after a lone s. Only the last segment inserts after its rows."""
    n = len(signature)

    def moves(i: int, state: int, inserted: int):
        if i < n:
            yield "D", DELETE, (i + 1, state, 0)
        if inserted < 2 and (i < n or last):
            yield "I", INSERT, (i, THEN[state], inserted + 1)
        if i < n and signature[i] != "x":
            extra = TRUNCATED if signature[i].isupper() else 0
            kept = KEEP.get((signature[i].lower(), state))
            if kept is not None:
                yield "K", extra, (i + 1, kept, 0)
            yield "R", REROLE + extra, (i + 1, THEN[state], 0)

    @lru_cache(None)
    def cost(i: int, state: int, inserted: int) -> int:
        best = end[state] if i == n else NEVER
        return min([best, *(price + cost(*to) for _, price, to in moves(i, state, inserted))])

    for i in range(n, 0, -32):  # fills the memo from the back, so that the recursion stays shallow
        for state in range(4):
            cost(i, state, 0)
    return cost, moves


def solve(signature: str, end: tuple[int, ...] = (0, NEVER, NEVER, 0), last: bool = True) -> list[tuple[str, str, int, int]]:
    """For each entry state: the steps of the rows, one a row, joined by commas; the inserts after the last row; the
    price and the state at the end. A step is the roles inserted before the row, u or a, then D, K, or U or A for a new role."""
    cost, moves = recursion(signature, end, last)
    out = []
    for entry in range(4):
        at, steps, step, price = (0, entry, 0), [], "", 0
        while at[0] < len(signature) or cost(*at) < end[at[1]]:
            here = cost(*at)
            letter, paid, to = next(m for m in moves(*at) if m[1] + cost(*m[2]) == here)  # the least letter of the cheapest
            role = ROLE[at[1]]
            step += {"I": role, "R": role.upper()}.get(letter, letter)
            price += paid
            if to[0] > at[0]:
                steps.append(step)
                step = ""
            at = to
        out.append((",".join(steps), step, price, at[1]))
    return out


def between(signature: str) -> list[int]:
    """Least cost from each of the four states to each, entry by entry, of a segment that others follow."""
    runs = [recursion(signature, tuple(0 if s == to else NEVER for s in range(4)), False)[0] for to in range(4)]
    return [min(run(0, entry, 0), NEVER) for entry in range(4) for run in runs]


SOLVED = "signature string, last boolean, costs array<long>, steps array<string>, tails array<string>, prices array<long>, exits array<int>"


def _solved(batches):
    """Last segments with their edits, others with their costs between states, or, given the cost to go, their edits."""
    for b in batches:
        out = {"signature": [], "last": [], "costs": [], "steps": [], "tails": [], "prices": [], "exits": []}
        togo = b.column("togo").to_pylist() if "togo" in b.schema.names else [None] * b.num_rows
        for signature, last, end in zip(b.column("signature").to_pylist(), b.column("last").to_pylist(), togo, strict=True):
            edits = solve(signature) if last else solve(signature, tuple(end), False) if end else None
            costs = end or (None if last else between(signature))
            for name, value in zip(out, (signature, last, costs, *(map(list, zip(*edits, strict=True)) if edits else [None] * 4)), strict=True):
                out[name].append(value)
        kinds = [pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))


# ------------------------------------------------------------------------------------------------
# Conversations of more than one segment, and the replay. Rows come sorted by conversation.


def _costs_to_go(batches):
    """From the last segment of a conversation to its first: the cost to go at its end, less the least of it."""
    key, now = None, None
    for b in batches:
        rows = b.select(["known", "conv", "first_at", "last", "costs", "prices"]).to_pylist()
        out = []
        for r in rows:
            if (r["known"], r["conv"]) != key:
                key, now = (r["known"], r["conv"]), None
            if not r["last"]:
                out.append((*key, r["first_at"], [x - min(now) for x in now]))
                now = [min(r["costs"][4 * s + to] + now[to] for to in range(4)) for s in range(4)]
                now = [x - min(now) for x in now]
            else:
                now = r["prices"]  # a last segment's prices are its costs to go
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["known", "conv", "first_at", "togo"])


def _entries(batches):
    """From the first segment to the last: the state in which each begins."""
    key, state = None, 0
    for b in batches:
        out = []
        for r in b.select(["known", "conv", "first_at", "exits"]).to_pylist():
            if (r["known"], r["conv"]) != key:
                key, state = (r["known"], r["conv"]), 0
            out.append((*key, r["first_at"], state))
            state = r["exits"][state]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.bool_(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["known", "conv", "first_at", "entry"])


RESULT = [("known", pa.bool_()), ("conv", pa.int64()), ("gaps", pa.int64()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())]
NAMES = {"u": "user", "a": "assistant", "U": "user", "A": "assistant"}
AUDIT = str.maketrans("uaUA", "IIRR", ",")


class _Replay:
    """One conversation so far: its counts, its audit and the hash of its repaired lines."""

    def __init__(self, key):
        self.key, self.sums, self.audit, self.hash, self.lines = key, [0] * 5, [], hashlib.sha256(), 0
        self.steps, self.tail, self.place = [], "", 0
        self.low = self.high = self.turn = None
        self.turns = 0

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def close(self) -> None:
        for x in self.tail:
            self.line(NAMES[x], "")
        self.tail = ""

    def segment(self, steps: str, tail: str, sums: list[int]) -> None:
        self.audit.append((steps + tail).translate(AUDIT))
        self.steps, self.tail, self.place = steps.split(","), tail, 0
        self.sums = [a + b for a, b in zip(self.sums, sums, strict=True)]

    def row(self, turn, role: str, text: str) -> None:
        if turn is not None:
            self.turns += turn != self.turn
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        *before, edit = self.steps[self.place]
        self.place += 1
        for x in before:
            self.line(NAMES[x], "")
        if edit != "D":
            self.line(role if edit == "K" else NAMES[edit], text)

    def result(self) -> tuple:
        self.close()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return *self.key, gaps, *self.sums, "".join(self.audit), self.hash.hexdigest()


def _replay(batches):
    """Each segment comes before its rows; one row a conversation leaves."""
    now, out = None, []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(zip(*out, strict=True), RESULT, strict=True)], [n for n, _ in RESULT])

    for b in batches:
        for known, conv, kind, steps, tail, sums, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("known", "conv", "kind", "steps", "tail", "sums", "turn", "role", "text")), strict=True):
            if now is None or (known, conv) != now.key:
                if now:
                    out.append(now.result())
                now = _Replay((known, conv))
            if kind == 0:
                now.segment(steps, tail, sums)
            else:
                now.row(turn, role, text)
        if out:
            yield batch()
            out.clear()
    if now:
        out.append(now.result())
        yield batch()


# ------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after a stated damage by crc32 of ``conv_id:turn`` modulo 20; null roles, texts and key parts count as
    one space. 0 drops a row, 1 empties its text, 2 removes its full stops, question and exclamation marks, 3 repeats
    it, 4 sets the role user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    rows = conversations.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(part("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("_copies"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies", "_copy")


def _letter(initial: Column) -> Column:
    return F.when(initial.isin("s", "u", "a"), initial).otherwise("o")


def repair(rows: DataFrame, everyone: DataFrame | None = None, segment: int = 1_024) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    rows: conv_id, turn, role, text; ``everyone`` adds conversations without a row: zeros, an empty audit and the hash of
    nothing. Rows stand by turn, nulls first, then role and text, so repeated rows are next to each other. A null role or
    text counts as one space, an empty role as an illegal one; null ids are one conversation. The empty table gives an
    empty result; other columns are not read. Texts of any length pass one at a time; a conversation's hash is read by one
    task, as a hash must be, with one row in memory.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    conv = lambda df: df.select(F.col("conv_id").isNotNull().alias("known"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), "*")
    base = conv(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))).drop("conv_id")
    order = ["known", "conv", "turn"]
    base = base.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text").withColumn("at", F.monotonically_increasing_id())
    base = scratch.store(base, "sorted")  # ``at`` grows with the order of rows: a partition's number and a place in it

    tail = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    compact = base.select("known", "conv", "at", F.shiftright("at", 33).alias("part"), _letter(F.substring("role", 1, 1)).alias("who"), (tail == "").alias("blank"), (~tail.isin(".", "!", "?")).alias("cut"), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same"))
    compact = scratch.store(compact, "faults")
    seen = compact.where("not blank").groupBy("known", "conv", "same").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    faults = compact.join(scratch.store(seen, "repeated"), ["known", "conv", "same"], "left").withColumn("again", ~F.col("blank") & F.coalesce(F.col("at") > F.col("first"), F.lit(False)))
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("cut"), "truncated")
    place = F.row_number().over(Window.partitionBy("part", "known", "conv").orderBy("at")) - 1  # no run is larger than a partition
    faults = faults.select("part", "known", "conv", "at", "who", fault.alias("fault"), F.floor(place / segment).alias("segment"))
    code = F.when(F.col("fault").isin("blank", "duplicate"), F.translate("who", "suao", "wxyz")).when(F.col("fault") == "truncated", F.upper("who")).otherwise(F.col("who"))
    count = lambda name: F.count_if(F.col("fault") == name).alias(name)
    segments = faults.groupBy("part", "known", "conv", "segment").agg(F.min("at").alias("first_at"), F.array_sort(F.collect_list(F.struct("at", code.alias("code")))).alias("codes"), count("blank"), count("duplicate"), count("truncated"))
    segments = segments.withColumn("codes", F.array_join(F.transform("codes", lambda x: x["code"]), ""))
    segments = segments.withColumn("who", F.translate("codes", "SUAOwxyz", "suaosuao")).withColumn("signature", F.translate("codes", "wyz", "xxx"))
    by = Window.partitionBy("known", "conv").orderBy("first_at")
    before = F.coalesce(F.lag(F.substring("who", -1, 1)).over(by), F.lit(""))
    pairs = F.transform(F.sequence(F.lit(1), F.length("chain") - 1), lambda i: F.substring("chain", i, 2))
    illegal = F.when(F.length("chain") > 1, F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    segments = segments.withColumns({"chain": F.concat(before, "who"), "first": F.lag("first_at").over(by).isNull(), "last": F.lead("first_at").over(by).isNull()})
    segments = segments.select("known", "conv", "first_at", "first", "last", "signature", F.array(*[F.col(c).cast("long") for c in ("blank", "duplicate", "truncated")], illegal.cast("long")).alias("counts"))
    segments = scratch.store(segments, "segments")

    solved = scratch.store(segments.select("signature", "last").distinct().mapInArrow(_solved, SOLVED), "solved")
    placed = scratch.store(segments.join(solved.hint("merge"), ["signature", "last"]), "placed")
    edits = placed.where("first and last").withColumn("entry", F.lit(0))
    several = placed.where("not (first and last)")
    if several.take(1):
        ordered = lambda df, way: df.repartition("known", "conv").sortWithinPartitions("known", "conv", way)
        togo = scratch.store(ordered(several, F.desc("first_at")).mapInArrow(_costs_to_go, "known boolean, conv long, first_at long, togo array<long>"), "costs-to-go")
        key = ["known", "conv", "first_at"]
        inner = several.where("not last").select(*key, "last", "signature", "counts").join(togo, key)
        fixed = scratch.store(inner.select("signature", "last", "togo").distinct().mapInArrow(_solved, SOLVED), "solved").withColumnRenamed("costs", "togo").drop("last")
        inner = inner.join(fixed.hint("merge"), ["signature", "togo"])
        cols = [*key, "counts", "steps", "tails", "prices", "exits"]
        chains = scratch.store(inner.select(*cols).unionByName(several.where("last").select(*cols)), "chains")
        entries = ordered(chains.select(*key, "exits"), F.asc("first_at")).mapInArrow(_entries, "known boolean, conv long, first_at long, entry int")
        edits = edits.select(*cols, "entry").unionByName(chains.join(scratch.store(entries, "entries"), key).select(*cols, "entry"))
    pick = lambda c: F.element_at(c, F.col("entry") + 1)
    heads = edits.select("known", "conv", F.col("first_at").alias("at"), F.lit(0).alias("kind"), pick("steps").alias("steps"), pick("tails").alias("tail"), F.concat("counts", F.array(pick("prices"))).alias("sums"))
    body = base.select("known", "conv", "at", F.lit(1).alias("kind"), "turn", "role", "text")
    stream = heads.unionByName(body, allowMissingColumns=True).repartition("known", "conv").sortWithinPartitions("known", "conv", "at", "kind")
    done = stream.mapInArrow(_replay, ", ".join(f"{n} {'boolean' if k == pa.bool_() else 'long' if k == pa.int64() else 'string'}" for n, k in RESULT))
    if everyone is not None:
        ids = conv(everyone.select("conv_id")).select("known", "conv").distinct()
        done = ids.join(scratch.store(done, "repaired"), ["known", "conv"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return done.select(F.when(F.col("known"), F.col("conv")).alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
