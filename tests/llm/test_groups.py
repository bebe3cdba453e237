"""Shared pieces: links without an unbounded group, ranks, names of radix groups, cosines at the threshold."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relmill.llm import common, line_dedup
from relmill.llm.common import Scratch, dealt_rank, linked_groups
from relmill.llm.embedding_dedup import embedding_dedup, reaches
from relmill.llm.exact_dedup import exact_dedup


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(n)}


@pytest.mark.parametrize("likely_first", [False, True])
@pytest.mark.parametrize("kind", ["strangers", "near copies", "families", "one large"])
def test_no_link_is_lost(spark, kind, likely_first):
    """One hot key of all ids, and small ones. Links join values that differ by at most one."""
    r = random.Random(kind)
    n = 150
    value = {"strangers": lambda i: 10 * i, "near copies": lambda i: i, "families": lambda i: 10 * (i % 7) + r.randrange(4), "one large": lambda i: i if i < 120 else 10 * i}[kind]
    values = [value(i) for i in range(n)]
    rows = [("hot", i, values[i]) for i in range(n)] + [(f"k{i // 3}-{j}", i, values[i]) for i in range(n) for j in range(2)]
    members = spark.createDataFrame(rows, "key string, id long, v long").repartition(4)
    seen = []

    def verify(pairs):
        seen.append(pairs.count())
        v = members.select("id", "v").distinct()
        both = pairs.join(v.toDF("a", "va"), "a").join(v.toDF("b", "vb"), "b")
        return both.where(F.abs(F.col("va") - F.col("vb")) <= 1).select("a", "b")

    got = {x.node: x.component for x in linked_groups(members, Scratch(spark), verify, likely_first=likely_first).collect()}
    links = [(i, j) for i in range(n) for j in range(i) if abs(values[i] - values[j]) <= 1]
    want = components(n, links)
    linked = {x for p in links for x in p}
    assert got == {i: c for i, c in want.items() if i in linked}
    if kind == "families":
        assert sum(seen) < n * n / 2  # not all pairs


def test_dealt_rank(spark):
    rows = [("a", i % 50) for i in range(300)] + [("b", 7), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "g string, x int")
    out = dealt_rank(df, Scratch(spark), "g", ["x"], len(rows), per_task=40).collect()
    for g in ("a", "b", None):
        assert sorted(r["rank"] for r in out if r.g == g) == list(range(sum(x[0] == g for x in rows)))
    assert dealt_rank(df.limit(0), Scratch(spark), "g", ["x"], 0).count() == 0


@pytest.mark.parametrize("few", [0, 500_000])
def test_rows_of_one_id_and_several_texts(spark, few, monkeypatch):
    from relmill.llm import exact_dedup as E

    monkeypatch.setattr(E.radix_groups, "__defaults__", (*E.radix_groups.__defaults__[:-1], few))
    a, b = "A" * 256, "B" * 256
    rows = [(5, a + "z"), (5, b + "z"), (4, a + "z"), (3, b + "z"), (2, "A"), (1, None), (0, ""), (9, a + "z" * 3000), (8, a + "z" * 3000), (5, a + "z")]
    out = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect())
    want = [(5, 5, 3, True)] * 2 + [(4, 5, 3, False), (5, 5, 2, True), (3, 5, 2, False), (2, 2, 1, True), (1, 1, 2, True), (0, 1, 2, False), (9, 9, 2, True), (8, 9, 2, False)]
    assert got == sorted(want)


def test_cosine_at_the_threshold(spark):
    # 0.93 is a double just over or under the cosine of these: exact arithmetic decides, not rounding
    t = 0.93
    y = (1 - t * t) ** 0.5
    pairs = [(t - d, y) for d in (-4e-13, -1e-15, 0.0, 1e-15, 4e-13, 1e-3)]
    for x, z in pairs:
        exact = reaches([1.0, 0.0], [x, z], t)
        rows = [(0, [1.0, 0.0], 1), (1, [x, z], 1)]
        out = {r.vec_id: r for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
        assert (out[1].component_id == 0) == exact and out[0].n_links == int(exact)
    assert reaches([1.0, 0.0], [t + 4e-13, y], t) and not reaches([1.0, 0.0], [t - 4e-13, y], t)


def test_links_are_added_to_groups(spark, monkeypatch):
    """Groups and more links give what all links give at once, while only the components that they join meet again."""
    r = random.Random(4)
    old = [(i, i + 1) for i in range(100, 200)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    new = [(120, 5), (7, 6), (350, 130), (500, 501), (501, 502)]
    table = lambda links: spark.createDataFrame([p for p in links if p[0] != p[1]], "a long, b long")
    scratch = Scratch(spark)
    groups = scratch.store(common.connected_components(table(old), scratch), "groups")
    met, whole = [], common.connected_components
    monkeypatch.setattr(common, "connected_components", lambda edges, scratch: met.append(edges.count()) or whole(edges, scratch))
    out = common.joined_groups(groups, table(new), scratch)
    got, want = {x.node: x.component for x in out.collect()}, components(600, old + new)
    assert out.count() == len(got) and got == {i: want[i] for p in old + new if p[0] != p[1] for i in p}
    assert met == [len(new)]


def test_no_keys_are_stored_with_lines():
    """Keys are elected from the lines that are compared: every one has them, equal lines the same ones."""
    text = "some words of this line\nsome words of this line\nquite another one here"
    (lines,) = line_dedup._sketch(1)([pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})])
    assert "keys" not in lines.schema.names and lines.num_rows == 3
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), lines.column("norm")], ["rid", "norm"])
    (sent,) = line_dedup._messages(8, 20)([batch, batch.slice(0, 0)])
    data = dict(zip(sent.column("bucket").to_pylist(), sent.column("data").to_pylist(), strict=True))
    met = line_dedup.unpacked([data.pop(-1)])
    assert sorted(met["rid"].tolist()) == [1] * 20 + [2] * 20 and len(set(met["key"].tolist())) == 20
    assert sorted(line_dedup.unpacked(data.values())["rid"].tolist()) == [1] * 20 + [3] * 20
