"""Schedules against their exact weights and against a plain earliest-deadline-first."""

import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from relmill.llm import mixing

SIXTY = {f"s{i:02}": round(random.Random(i).random(), 6) + 0.001 for i in range(60)}


@pytest.mark.parametrize(("weights", "slots"), [({"a": 1, "b": 3}, 1_000_000), ({"a": 1, "b": 100_000}, 1_000_000), ({"a": 1, "b": 0.3333333}, 200_000), (SIXTY, 200_000)])
def test_deviation_stays_under_one_block(weights, slots):
    """From the given weights, in exact arithmetic, over the first phase."""
    whole = mixing.parts(weights)
    total = sum(whole.values())
    begin, per, sources = mixing.phases({s: slots * w // total + 2 for s, w in whole.items()}, weights)[0]
    assert begin == 0 and per == total
    order = []
    for s, (first, n, plan) in sources.items():
        assert first == 0 and (len(plan) == whole[s] or len(plan) == n)
        order += [(i // len(plan) * per + plan[i % len(plan)][0], s) for i in range(n)]
    order.sort()
    assert [t for t, _ in order] == list(range(len(order))) and len(order) > 0.99 * slots
    done, exact = Counter(), {s: Fraction(str(w)) / sum(Fraction(str(x)) for x in weights.values()) for s, w in weights.items()}
    assert all(exact[s] == Fraction(w, total) for s, w in whole.items())
    for t, s in order:
        # between its blocks a source falls back, at a block it jumps ahead: the extremes are just before and just after
        assert done[s] * total - whole[s] * t > -total
        done[s] += 1
        assert done[s] * total - whole[s] * (t + 1) < total
    assert all(abs(done[s] * total - whole[s] * len(order)) < total for s in whole)


def plain_edf(blocks, weights):
    """Slot by slot: of the released blocks the one that is due first, ties to the smaller name."""
    out, done = [], Counter()
    while live := [s for s in sorted(blocks) if done[s] < blocks[s] and weights.get(s, 0) > 0]:
        exact = {s: Fraction(str(weights[s])) for s in live}
        share = {s: w / sum(exact.values()) for s, w in exact.items()}
        since, t = Counter(), 0
        while all(done[s] < blocks[s] for s in live):
            ready = [(-(-(since[s] + 1) // share[s]), s) for s in live if since[s] // share[s] <= t]
            s = min(ready)[1]
            out.append((s, done[s]))
            since[s], done[s], t = since[s] + 1, done[s] + 1, t + 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_rows_follow_a_plain_schedule(spark, seed):
    r = random.Random(seed)
    weights = {s: r.choice([0.1, 0.25, 1, 2.5, 7]) for s in "abcde"} | {"f": 0}
    rows = [(i, r.choice("aaaabcdefg")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(docs, weights, block_rows=3).where(F.col("_release").isNotNull()).select("_slot", "source", "_block").distinct().orderBy("_slot").collect()
    n = Counter(s for _, s in rows)
    blocks = {s: -(-n[s] // 3) for s in weights if weights[s]}
    assert [(x.source, x._block) for x in got] == plain_edf(blocks, weights)


def test_plan_is_bounded():
    """Weights of many digits and many rows: larger blocks, all rows planned, still exact."""
    weights = {"a": 0.123456789012345, "b": 0.7, "c": 0.2}
    size, plan = mixing.planned({"a": 10_000_000, "b": 50_000_000, "c": 16_000_000}, weights, 64, most_slots=20_000)
    assert size > 64 and sum(len(x[2]) for _, _, sources in plan for x in sources.values()) <= 2 * 20_000
    placed = Counter()
    for _, _, sources in plan:
        for s, (first, n, _) in sources.items():
            assert first == placed[s]
            placed[s] += n
    assert placed == {"a": -(-10_000_000 // size), "b": -(-50_000_000 // size), "c": -(-16_000_000 // size)}
    assert mixing.planned({"a": 10**12, "b": 10**12}, {"a": 1, "b": 3}, 64)[0] == 64  # a short period is enough
    assert mixing.planned({}, {}, 64) == (64, [])


def test_shuffled_plan(spark, monkeypatch):
    """A plan too long to be broadcast gives the same slots."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    short = sorted(map(tuple, mixing.mix(docs, {"a": 1, "b": 1.37}, block_rows=2).collect()))
    monkeypatch.setattr(mixing, "FEW", 0)
    assert sorted(map(tuple, mixing.mix(docs, {"a": 1, "b": 1.37}, block_rows=2).collect())) == short
