"""A database as a typed, timed graph: one node per row, two edges per foreign key value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmill.functions.scalars import NEVER
from relmill.operators.ordered import row_index
from relmill.schema import RelationalDB


def keyed_nodes(db: RelationalDB) -> DataFrame:
    """(table, key, node_id, type_id, row, time, refs): ids count all rows in order of table, then key (as a number
    where it is one); refs are the row's foreign key values, in order of the declared keys of its table."""
    out = []
    for i, (name, df) in enumerate(db.tables.items()):
        time = F.coalesce(F.col(db.times[name]).cast("double"), F.lit(NEVER)) if name in db.times else F.lit(NEVER)
        refs = F.array(*[F.col(fk.column).cast("string") for fk in db.foreign_keys if fk.table == name]).cast("array<string>")
        out.append(df.select(F.lit(name).alias("table"), F.lit(i).alias("type_id"), F.col(db.keys[name]).cast("string").alias("key"), time.alias("time"), refs.alias("refs")))
    rows = reduce(DataFrame.unionByName, out).withColumn("_n", F.col("key").try_cast("bigint"))
    rows = row_index(rows, ["type_id", "_n", "key"], "node_id")
    first = rows.groupBy("type_id").agg(F.min("node_id").alias("_first"))  # a row per table
    return rows.join(F.broadcast(first), "type_id").select("table", "key", "node_id", "type_id", (F.col("node_id") - F.col("_first")).alias("row"), "time", "refs")


def edges(db: RelationalDB, nodes: DataFrame) -> DataFrame:
    """(src, dst, etype, etime): relation 2k runs from the row to the one it names, 2k + 1 back. The time is
    the referring row's. Values without a target give no edge; see ``orphans``. ``nodes`` are keyed_nodes, best stored:
    a row brings its own id and its references along, so each key costs one join, with the rows that it names."""
    out = []
    for k, fk in enumerate(db.foreign_keys):
        place = [x.column for x in db.foreign_keys if x.table == fk.table].index(fk.column)
        rows = nodes.where(F.col("table") == fk.table).select(F.col("node_id").alias("a"), F.col("refs")[place].alias("ref"), F.col("time").alias("etime"))
        pair = rows.join(nodes.where(F.col("table") == fk.target).select(F.col("key").alias("ref"), F.col("node_id").alias("b")), "ref")
        both = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(2 * k).alias("etype")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), F.lit(2 * k + 1).alias("etype")))
        out.append(pair.select(F.explode(both).alias("e"), "etime").select("e.*", "etime"))
    return reduce(DataFrame.unionByName, out)


def visible(edges_: DataFrame, seed_time: float | Column, strict_nodes: DataFrame | None = None) -> DataFrame:
    """Edges known at a time, the time itself included. With nodes given, both ends must be known as well."""
    out = edges_.where(F.col("etime") <= seed_time)
    if strict_nodes is not None:
        known = strict_nodes.where(F.col("time") <= seed_time).select("node_id")
        out = out.join(known.toDF("src"), "src", "left_semi").join(known.toDF("dst"), "dst", "left_semi")
    return out


def relation_counts(edges_: DataFrame) -> DataFrame:
    return edges_.groupBy("etype").agg(F.count("*").alias("n_edges"))


def node_type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type_id").agg(F.count("*").alias("n_nodes"))


def in_degree(edges_: DataFrame) -> DataFrame:
    return edges_.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("degree"))


def density_stats(n_nodes: DataFrame, edges_: DataFrame) -> DataFrame:
    """Nodes, edges, average degree 2E/N and density 2E/(N(N-1)); 0 where undefined."""
    n = n_nodes.agg(F.count("*").alias("n"))
    both = n.crossJoin(F.broadcast(edges_.agg(F.count("*").alias("e"))))
    x, e = F.col("n").cast("double"), F.col("e").cast("double")
    return both.select("n", "e", F.when(x > 0, 2 * e / x).otherwise(0.0).alias("avg_degree"), F.when(x > 1, 2 * e / (x * (x - 1))).otherwise(0.0).alias("density"))


def orphans(fact: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null foreign key names no row."""
    return fact.where(F.col(column).isNotNull()).join(target.select(F.col(key).alias(column)), column, "left_anti")


def duplicate_edges(edges_: DataFrame, by: list[str]) -> DataFrame:
    return edges_.groupBy(*by).agg(F.count("*").alias("copies")).where("copies > 1")


def induced(edges_: DataFrame, keep: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Edges with both ends in ``keep`` (one column, node_id)."""
    ids = keep.select("node_id").distinct()
    return edges_.join(ids.withColumnRenamed("node_id", a), a, "left_semi").join(ids.withColumnRenamed("node_id", b), b, "left_semi").select(*edges_.columns)


def endpoints(edges_: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    return edges_.select(F.explode(F.array(a, b)).alias("node_id")).distinct()


def dot_lines(edges_: DataFrame, label: str = "etype") -> DataFrame:
    """The edge lines of a Graphviz file, to be written as text."""
    return edges_.select(F.format_string('  "%s" -> "%s" [label="%s"];', F.col("src").cast("string"), F.col("dst").cast("string"), F.col(label).cast("string")).alias("value"))


def edge_list(edges_: DataFrame, weight: Column | None = None) -> DataFrame:
    """source, target, relation and weight with six decimals, to be written as CSV."""
    w = F.lit(1.0) if weight is None else weight
    return edges_.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("etype").alias("relation"), F.format_string("%.6f", w.cast("double")).alias("weight"))


def adjacency(edges_: DataFrame, weight: str) -> DataFrame:
    """(i, j, v), symmetric; parallel edges add up, a self-loop counts once."""
    both = F.when(F.col("src") == F.col("dst"), F.array(F.struct(F.col("src").alias("i"), F.col("dst").alias("j")))).otherwise(
        F.array(F.struct(F.col("src").alias("i"), F.col("dst").alias("j")), F.struct(F.col("dst").alias("i"), F.col("src").alias("j")))
    )
    return edges_.select(F.explode(both).alias("x"), F.col(weight).alias("w")).select("x.*", "w").groupBy("i", "j").agg(F.sum("w").alias("v"))


def dot_graph(nodes: DataFrame, edges_: DataFrame, label: str = "etype") -> DataFrame:
    """(position, value): a whole Graphviz file, one line a row: the head, nodes (node_id, label), edges and the end."""
    spark = edges_.sparkSession
    ends = spark.createDataFrame([(0, "digraph G {"), (3, "}")], "position int, value string")
    named = nodes.select(F.lit(1).alias("position"), F.format_string('  "%s" [label="%s"];', F.col("node_id").cast("string"), F.col("label").cast("string")).alias("value"))
    return ends.unionByName(named).unionByName(dot_lines(edges_, label).select(F.lit(2).alias("position"), "value"))


def node_features(features: DataFrame, dim: int) -> DataFrame:
    """node and f0 to f(dim - 1) with six decimals, to be written as CSV."""
    return features.select(F.col("node_id").alias("node"), *[F.format_string("%.6f", F.col("x")[i].cast("double")).alias(f"f{i}") for i in range(dim)])


def check_graph(nodes: DataFrame, edges_: DataFrame, most_nodes: int = 1_000_000, most_edges: int = 10_000_000, cycles: bool = False, connected: bool = True) -> DataFrame:
    """(rule, violations) for nodes (id) and edges (src, dst): limits, repeated nodes and edges, ends that are no
    nodes, and, unless allowed, vertices behind a cycle and components beyond the first."""
    from relmill.operators.analytics import components, cycle_vertices

    n, m = nodes.agg(F.count("*").alias("v")), edges_.agg(F.count("*").alias("v"))
    over = lambda d, most: d.select(F.greatest(F.col("v") - most, F.lit(0)).alias("v"))
    known = nodes.select("id").distinct()
    ends = edges_.select(F.explode(F.array("src", "dst")).alias("id"))
    found = {
        "nodes over the limit": over(n, most_nodes), "edges over the limit": over(m, most_edges),
        "repeated nodes": nodes.groupBy("id").agg((F.count("*") - 1).alias("v")).agg(F.sum("v").alias("v")),
        "repeated edges": edges_.groupBy("src", "dst").agg((F.count("*") - 1).alias("v")).agg(F.sum("v").alias("v")),
        "missing ends": ends.join(known.hint("merge"), "id", "left_anti").agg(F.count("*").alias("v")),
    }
    if not cycles:
        found["vertices behind a cycle"] = cycle_vertices(edges_).agg(F.count("*").alias("v"))
    if connected:
        found["components beyond the first"] = components(known, edges_).agg((F.count_distinct("component") - 1).alias("v"))
    out = [d.select(F.lit(rule).alias("rule"), F.coalesce("v", F.lit(0)).cast("long").alias("violations")) for rule, d in found.items()]
    return reduce(DataFrame.unionByName, out)


def seed_nodes(nodes: DataFrame, table: str) -> DataFrame:
    """(node_id, row, key) of one table's nodes: a run of ids, as ids go by table."""
    return nodes.where(F.col("table") == table).select("node_id", "row", "key")
