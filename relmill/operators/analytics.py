"""Graph analytics as loops of joins. Vertices are (id), edges (src, dst) and, where used, weight.

Loops store each round in the shared folder; drivers see single numbers only, such as a largest change.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.operators.components import connected_components
from relmill.staging import Scratch


def _both_ways(edges: DataFrame, *cols: str) -> DataFrame:
    return edges.select("src", "dst", *cols).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *cols))


def simple_pairs(edges: DataFrame) -> DataFrame:
    """Undirected edges once each, a < b, without loops and parallels."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20, tol: float = 0.0) -> DataFrame:
    """(id, rank). Parallel edges count; the mass of vertices without out-edges is spread over all."""
    scratch = Scratch(edges.sparkSession, merge=True)
    n = vertices.count()
    if not n:
        return vertices.select("id", F.lit(0.0).alias("rank"))
    out = edges.groupBy("src").agg(F.count("*").alias("_out"))
    v = scratch.store(vertices.select("id").join(out.withColumnRenamed("src", "id"), "id", "left"), "vertices")
    e = scratch.store(edges.select("src", "dst"), "edges")
    ranks = v.select("id", "_out", F.lit(1.0 / n).alias("rank"))
    for _ in range(rounds):
        dangling = ranks.where("_out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        sums = e.join(ranks.where("_out is not null").select(F.col("id").alias("src"), (F.col("rank") / F.col("_out")).alias("_c")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("_c").alias("_s"))
        new = ranks.join(sums, "id", "left").select("id", "_out", F.col("rank").alias("_old"), (F.lit((1 - damping) / n) + damping * (F.coalesce("_s", F.lit(0.0)) + F.lit(dangling / n))).alias("rank"))
        new = scratch.store(new, "ranks")
        change = new.agg(F.max(F.abs(F.col("rank") - F.col("_old")))).first()[0] if tol else None
        scratch.drop(ranks)
        ranks = new.drop("_old")
        if change is not None and change < tol:
            break
    return ranks.select("id", "rank")


def eigenvector_centrality(vertices: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, score): power iteration over in-edges from 1, scaled to a sum of 1 each round."""
    scratch = Scratch(edges.sparkSession, merge=True)
    now = vertices.select("id", F.lit(1.0).alias("score"))
    for _ in range(rounds):
        sums = edges.join(now.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("score").alias("_s"))
        new = scratch.store(vertices.select("id").join(sums, "id", "left").select("id", F.coalesce("_s", F.lit(0.0)).alias("score")), "scores")
        total = new.agg(F.sum("score")).first()[0]
        if not total:
            return new
        now = new.select("id", (F.col("score") / total).alias("score"))
    return now


def degree_centrality(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, centrality): incident edges over N - 1; a self-loop counts once, isolated vertices 0."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")).groupBy("id").agg(F.count("*").alias("_d"))
    n = vertices.agg(F.count("*").alias("_n"))
    rows = vertices.select("id").join(ends, "id", "left").crossJoin(F.broadcast(n))
    return rows.select("id", F.when(F.col("_n") > 1, F.coalesce("_d", F.lit(0)) / (F.col("_n") - 1)).otherwise(0.0).alias("centrality"))


def bfs_levels(edges: DataFrame, sources: DataFrame, directed: bool = False, most: int | None = None) -> DataFrame:
    """(source, id, level, pred): hops from each source (a table with id) and the smallest predecessor; up to
    ``most`` hops if given."""
    scratch = Scratch(edges.sparkSession, merge=True)
    pairs = scratch.store((edges.select("src", "dst") if directed else _both_ways(edges)).where("src <> dst").distinct(), "pairs")
    seen = scratch.store(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("level"), F.lit(None).cast("long").alias("pred")).distinct(), "level")
    frontier = seen
    for level in count(1) if most is None else range(1, most + 1):
        new = frontier.select("source", F.col("id").alias("src")).join(pairs, "src").groupBy("source", F.col("dst").alias("id")).agg(F.min("src").alias("pred"))
        new = scratch.store(new.join(scratch.shuffled(seen.select("source", "id")), ["source", "id"], "left_anti").select("source", "id", F.lit(level).alias("level"), "pred"), "level")
        if not new.take(1):
            break
        seen, frontier = seen.unionByName(new), new
    return seen


def shortest_paths(edges: DataFrame, sources: DataFrame, directed: bool = False) -> DataFrame:
    """(source, id, distance, pred) by relaxing from the vertices that improved; weights must not be negative."""
    scratch = Scratch(edges.sparkSession, merge=True)
    pairs = edges.select("src", "dst", "weight") if directed else _both_ways(edges, "weight")
    pairs = scratch.store(pairs.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "pairs")
    best = last = scratch.store(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("distance"), F.lit(None).cast("long").alias("pred")).distinct(), "best")
    fresh = best
    while True:
        ways = fresh.select("source", F.col("id").alias("src"), "distance").join(pairs, "src")
        offer = ways.select("source", F.col("dst").alias("id"), (F.col("distance") + F.col("weight")).alias("distance"), F.col("src").alias("pred"))
        offer = offer.groupBy("source", "id").agg(F.min(F.struct("distance", "pred")).alias("_o"))
        joined = best.join(offer, ["source", "id"], "full")
        better = F.col("_o").isNotNull() & (F.col("distance").isNull() | (F.col("_o.distance") < F.col("distance")))
        new = joined.select("source", "id", F.when(better, F.col("_o.distance")).otherwise(F.col("distance")).alias("distance"), F.when(better, F.col("_o.pred")).otherwise(F.col("pred")).alias("pred"), better.alias("_new"))
        new = scratch.store(new, "best")
        scratch.drop(last)
        last, best, fresh = new, new.drop("_new"), new.where("_new").drop("_new")
        if not fresh.take(1):
            break
    return best


def closeness(vertices: DataFrame, edges: DataFrame, sources: DataFrame | None = None, directed: bool = False) -> DataFrame:
    """(id, closeness) for ``sources``, or all: undirected, vertices reached over the sum of their distances; directed,
    N - 1 over that sum. 0 if none is reached."""
    levels = bfs_levels(edges, vertices if sources is None else sources, directed)
    sums = levels.groupBy(F.col("source").alias("id")).agg((F.count("*") - 1).alias("_r"), F.sum("level").alias("_s"))
    top = F.lit(float(vertices.count() - 1)) if directed else F.col("_r")
    return sums.select("id", F.when(F.col("_s") > 0, top / F.col("_s")).otherwise(0.0).alias("closeness"))


def betweenness(vertices: DataFrame, edges: DataFrame, directed: bool = False, block_rows: int = 50_000_000) -> DataFrame:
    """(id, betweenness) over (n-1)(n-2) pairs, halved if undirected. Brandes level by level on tables: joins
    forward add up the paths, joins backward the dependencies. A source has at most a row for each vertex of its
    component; sources are taken in blocks of about ``block_rows`` such rows, which bounds the scratch tables."""
    scratch = Scratch(edges.sparkSession, merge=True)
    n = vertices.count()
    pairs = scratch.store((edges.select("src", "dst") if directed else _both_ways(edges)).where("src <> dst").distinct(), "pairs")
    every = vertices.select(F.col("id").cast("long").alias("id")).distinct()
    sizes = connected_components(pairs, scratch, "src", "dst").groupBy("component").agg(F.count("*").cast("double").alias("_n"))
    blocks = max(1, -(-int(sizes.agg(F.sum(F.col("_n") * F.col("_n"))).first()[0] or 0) // block_rows))
    sums = None
    for block in range(blocks):
        sources = every.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        levels = [scratch.store(sources.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("sigma")), "level")]
        seen = levels[0].select("source", "id")
        while True:
            ways = levels[-1].withColumnRenamed("id", "src").join(pairs, "src").groupBy("source", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
            new = scratch.store(ways.join(scratch.shuffled(seen), ["source", "id"], "left_anti"), "level")
            if not new.take(1):
                scratch.drop(new)
                break
            seen = seen.unionByName(new.select("source", "id"))
            levels.append(new)
        below, parts = None, []
        for level in reversed(levels[1:]):  # the source itself gets nothing
            if below is None:
                deep = level.withColumn("delta", F.lit(0.0))
            else:
                share = below.select("source", F.col("id").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("_w")).join(pairs, "dst")
                share = share.groupBy("source", F.col("src").alias("id")).agg(F.sum("_w").alias("_w"))
                deep = level.join(share, ["source", "id"], "left").select("source", "id", "sigma", F.coalesce(F.col("sigma") * F.col("_w"), F.lit(0.0)).alias("delta"))
            below = scratch.store(deep, "dependencies")
            parts.append(below)
        if parts:
            total = parts[0].select("id", "delta")
            for part in parts[1:]:
                total = total.unionByName(part.select("id", "delta"))
            total = scratch.store(total.groupBy("id").agg(F.sum("delta").alias("part")), "parts")
            sums = total if sums is None else sums.unionByName(total)
        for used in (*levels, *parts):
            scratch.drop(used)
    scale = (n - 1) * (n - 2)
    if sums is None or scale <= 0:
        return vertices.select("id", F.lit(0.0).alias("betweenness"))
    rows = vertices.select("id").join(scratch.shuffled(sums.groupBy("id").agg(F.sum("part").alias("_s"))), "id", "left")
    return rows.select("id", (F.coalesce("_s", F.lit(0.0)) / float(scale)).alias("betweenness"))


def triangles(edges: DataFrame) -> DataFrame:
    """(id, triangles): wedges from each vertex to later ones in order of degree, closed by a semi join. The order
    keeps the wedges of a hub few."""
    pairs = simple_pairs(edges)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    ranked = pairs.join(degree.toDF("a", "da").hint("merge"), "a").join(degree.toDF("b", "db").hint("merge"), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    out = ranked.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedge = out.toDF("u", "v").join(out.toDF("u", "w").hint("merge"), "u").where("v < w")
    closed = wedge.join(pairs.toDF("v", "w").hint("merge"), ["v", "w"], "left_semi")
    return closed.select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def clustering_coefficient(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, coefficient) on the simple undirected graph; 0 with fewer than two neighbours."""
    degree = simple_pairs(edges).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    rows = vertices.select("id").join(degree.hint("merge"), "id", "left").join(triangles(edges).hint("merge"), "id", "left")
    d = F.col("d")
    return rows.select("id", F.when(d >= 2, 2.0 * F.coalesce("triangles", F.lit(0)) / (d * (d - 1))).otherwise(0.0).alias("coefficient"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that undirected edges reach, for isolated vertices their own."""
    scratch = Scratch(edges.sparkSession, merge=True)
    found = connected_components(edges, scratch, "src", "dst")
    return vertices.select("id").join(scratch.shuffled(found.withColumnRenamed("node", "id")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def is_connected(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return components(vertices, edges).agg((F.count_distinct("component") <= 1).alias("is_connected"))


def label_propagation(vertices: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label): synchronous rounds, most frequent label of the neighbours, ties to the smallest; isolated
    vertices keep their own."""
    scratch = Scratch(edges.sparkSession, merge=True)
    pairs = scratch.store(_both_ways(edges).where("src <> dst"), "pairs")
    now = vertices.select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        votes = pairs.join(now.select(F.col("id").alias("src"), "label"), "src").groupBy("dst", "label").agg(F.count("*").alias("_n"))
        best = votes.groupBy(F.col("dst").alias("id")).agg(F.min_by("label", F.struct(-F.col("_n"), F.col("label"))).alias("_l"))
        new = scratch.store(now.join(best, "id", "left").select("id", F.coalesce("_l", "label").alias("label")), "labels")
        scratch.drop(now)
        now = new
    return now


def community_rollup(communities: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, n_edges) between communities (id, label), a <= b."""
    e = edges.join(communities.toDF("src", "ca").hint("merge"), "src").join(communities.toDF("dst", "cb").hint("merge"), "dst")
    return e.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count("*").alias("n_edges"))


def modularity(communities: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Sum over communities of e_c / m - resolution (d_c / 2m)^2."""
    e = edges.join(communities.toDF("src", "ca").hint("merge"), "src").join(communities.toDF("dst", "cb").hint("merge"), "dst")
    sides = e.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), (F.col("ca") == F.col("cb")).cast("int").alias("i")), F.struct(F.col("cb").alias("c"), F.lit(0).alias("i")))).alias("x")).select("x.*")
    per = sides.groupBy("c").agg(F.sum("i").alias("e"), F.count("*").alias("d"))
    both = per.crossJoin(F.broadcast(edges.agg(F.count("*").cast("double").alias("m"))))
    return both.agg(F.sum(F.col("e") / F.col("m") - resolution * F.pow(F.col("d") / (2 * F.col("m")), 2.0)).alias("modularity"))


def cycle_vertices(edges: DataFrame) -> DataFrame:
    """(id) of the vertices left after peeling those without in-edges again and again; empty without a cycle."""
    scratch = Scratch(edges.sparkSession, merge=True)
    now = scratch.store(edges.select("src", "dst").distinct(), "edges")
    size = now.count()
    while True:
        kept = scratch.store(now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), "edges")
        new = kept.count()
        scratch.drop(now)
        now = kept
        if new == size or not new:
            break
        size = new
    return now.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def greedy_colouring(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, colour): rounds of independent sets. A vertex is coloured once all its smaller neighbours are, with
    the smallest colour that none of them has, which is greedy colouring in order of id."""
    scratch = Scratch(edges.sparkSession, merge=True)
    pairs = scratch.store(simple_pairs(edges), "pairs")
    done = vertices.select("id").join(pairs.select(F.col("b").alias("id")), "id", "left_anti").select("id", F.lit(0).alias("colour"))
    done, left = scratch.store(done, "done"), vertices.select("id").join(done.select("id"), "id", "left_anti")
    while True:
        left = scratch.store(left, "left")
        if not left.take(1):
            break
        state = left.join(pairs.withColumnRenamed("b", "id"), "id").join(done.select(F.col("id").alias("a"), "colour"), "a", "left")
        free = state.groupBy("id").agg(F.count("*").alias("_n"), F.count("colour").alias("_c"), F.collect_set("colour").alias("_used")).where("_n = _c")
        colour = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("_used")), "_used"))
        new = scratch.store(free.select("id", colour.alias("colour")), "new")
        done, left = done.unionByName(new), left.join(new.select("id"), "id", "left_anti")
    return done


def graph_statistics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices, edges, density, mean degree, mean clustering and components, one row."""
    n = vertices.agg(F.count("*").alias("n"))
    m = edges.agg(F.count("*").alias("m"))
    c = clustering_coefficient(vertices, edges).agg(F.avg("coefficient").alias("avg_clustering"))
    k = components(vertices, edges).agg(F.count_distinct("component").alias("components"))
    row = n.crossJoin(F.broadcast(m)).crossJoin(F.broadcast(c)).crossJoin(F.broadcast(k))  # one row each
    x, e = F.col("n").cast("double"), F.col("m").cast("double")
    return row.select("n", "m", F.when(x > 1, 2 * e / (x * (x - 1))).otherwise(0.0).alias("density"), F.when(x > 0, 2 * e / x).otherwise(0.0).alias("avg_degree"), "avg_clustering", "components")




def degree_range(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest, largest and mean degree, one row; a self-loop counts once, an empty graph gives zeros."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")).groupBy("id").agg(F.count("*").alias("_d"))
    d = vertices.select("id").join(ends, "id", "left").select(F.coalesce("_d", F.lit(0)).alias("_d"))
    return d.agg(*[F.coalesce(f("_d"), F.lit(0)).alias(n) for n, f in (("min_degree", F.min), ("max_degree", F.max))], F.coalesce(F.avg("_d"), F.lit(0.0)).alias("avg_degree"))
