"""More registered queries with their SQL: sources, scalars, layers, sampling, paths, checks and sessions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from relmill.functions import features, metrics, scalars
from relmill.operators import aggregate, analytics, communities, graph, paths, sampling, tasks, validation
from relmill.plans.catalog import HORIZON, NODES, ORDER_EDGES, QUERIES, SCORED, SEED, SEED_SECONDS, SMALL, SQL, _graph, customer_features, database, order_edges, query, scored, small_graph, smallest_of_nations, t
from relmill.sources import tables as sources
from relmill.staging import Scratch
from relmill.streaming import events as streams

__all__ = ["QUERIES", "SQL"]


def both_ways(e):
    return e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


# ---------------------------------------------------------------------------------------------- sources


def _round_trip(spark, df, kind):
    path = f"{Scratch(spark).root}/table.{kind}"
    getattr(df.write.option("header", True), kind)(path)
    return sources.load_any(spark, path).select(*[F.col(c).cast(ty).alias(c) for c, ty in df.dtypes])


@query("select n_nationkey, n_name, n_regionkey from nation")
def csv_source(spark, sf_dir):
    return _round_trip(spark, t(spark, sf_dir, "nation"), "csv")


@query("select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def json_source(spark, sf_dir):
    return _round_trip(spark, t(spark, sf_dir, "supplier"), "json")


@query("select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part")
def orc_source(spark, sf_dir):
    return _round_trip(spark, t(spark, sf_dir, "part"), "orc")


@query("select n_nationkey - 0 as _row, (row_number() over (order by n_nationkey) - 1)::bigint as n_name, n_regionkey::bigint as n_regionkey from nation")
def csv_database(spark, sf_dir):
    folder = f"{Scratch(spark).root}/shop"
    for name, key in (("region", "r_regionkey"), ("nation", "n_nationkey")):
        t(spark, sf_dir, name).coalesce(1).sortWithinPartitions(key).write.option("header", True).csv(f"{folder}/{name}.csv")
    column = lambda name, role: {"name": name, "role": role}
    spec = [
        {"name": "region", "columns": [column("r_regionkey", "PrimaryKey"), column("r_name", "Categorical")]},
        {"name": "nation", "columns": [column("n_nationkey", "PrimaryKey"), column("n_name", "Categorical"), column("n_regionkey", {"ForeignKey": "region"})]},
    ]
    sources.write_text(spark, f"{folder}/schema.json", json.dumps({"tables": spec, "seed_table": "nation"}))
    return sources.load_csv(spark, folder)[0].tables["nation"].select(F.col("_row").cast("int").alias("_row"), F.col("n_name").cast("long").alias("n_name"), F.col("n_regionkey").cast("long").alias("n_regionkey"))


@query("select o_orderkey, o_custkey, o_totalprice from orders")
def saved_database(spark, sf_dir):
    folder = f"{Scratch(spark).root}/database"
    sources.save_database(database(spark, sf_dir), folder, version="1")
    return sources.load_database(spark, folder)[0].tables["orders"].select("o_orderkey", "o_custkey", "o_totalprice")


@query("select 'nation' as \"table\", count(*) as rows from nation union all select 'customer', count(*) from customer union all select 'orders', count(*) from orders")
def table_row_counts(spark, sf_dir):
    return sources.row_counts({n: t(spark, sf_dir, n) for n in ("nation", "customer", "orders")})


@query("select * from (values ('nation', 0, 'n_nationkey', 'int', null), ('nation', 1, 'n_name', 'string', null), ('nation', 2, 'n_regionkey', 'int', 'region')) x(\"table\", position, \"column\", type, target)")
def table_schema(spark, sf_dir):
    db = database(spark, sf_dir)
    return sources.describe({"nation": db.tables["nation"]}, db.foreign_keys)


@query(f"select o_orderkey as order_key from orders where o_orderdate <= timestamp '{SEED}'")
def known_orders(spark, sf_dir):
    return database(spark, sf_dir).upto(SEED_SECONDS).tables["orders"].select(F.col("o_orderkey").alias("order_key"))


@query(f"select o_orderkey as order_key from orders where o_orderdate >= timestamp '{SEED}'")
def later_orders(spark, sf_dir):
    return database(spark, sf_dir).since(SEED_SECONDS).tables["orders"].select(F.col("o_orderkey").alias("order_key"))


@query("select o_orderpriority as priority, count(*) as n from orders where o_totalprice > 1000.0 and o_orderstatus = 'F' group by 1")
def parameterised_sql(spark, sf_dir):
    text = "select o_orderpriority as priority, count(*) as n from {orders} where o_totalprice > :least and o_orderstatus = :status group by 1"
    return sources.run_sql(spark, text, {"orders": t(spark, sf_dir, "orders")}, least=1000.0, status="F")


@query("select min(s) as first, max(s) as last from (select epoch(o_orderdate)::double as s from orders union all select epoch(date_trunc('second', ts))::double from events)")
def time_span(spark, sf_dir):
    db = database(spark, sf_dir)
    rows = {"orders": db.tables["orders"], "events": t(spark, sf_dir, "events").select(scalars.seconds(F.col("ts")).alias("_time"))}
    return tasks.time_span(rows, {"orders": "_time", "events": "_time"})


# ---------------------------------------------------------------------------------------------- scalars


@query("""select event_id, round(greatest(x, 0), 6) as relu, round(0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x))), 6) + 0.0 as gelu, round(tanh(x), 6) + 0.0 as tanh, round(1 / (1 + exp(-x)), 6) as sigmoid,
    round(case when x > 0 then x else 0.01 * x end, 6) + 0.0 as leakyrelu, round(x / (1 + exp(-x)), 6) + 0.0 as swish from (select event_id, (event_id % 41 - 20)::double / 4.0::double as x from events)""")
def activations(spark, sf_dir):
    x = (F.col("event_id") % 41 - 20).cast("double") / 4.0
    return t(spark, sf_dir, "events").select("event_id", *[(F.round(scalars.activation(n, x), 6) + (0.0 if n not in ("relu", "sigmoid") else F.lit(0.0))).alias(n) for n in ("relu", "gelu", "tanh", "sigmoid", "leakyrelu", "swish")])


@query("""select vec_id, round(embedding[1]::double / n, 6) + 0.0 as unit0, round(embedding[1]::double * least(1.0::double, 0.5 / n), 6) + 0.0 as clipped0, round(n, 5) as norm
    from (select *, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings)""")
def vector_scaling(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return t(spark, sf_dir, "embeddings").select(
        "vec_id", (F.round(scalars.l2_normalised(v)[0], 6) + 0.0).alias("unit0"), (F.round(scalars.norm_clipped(v, 0.5)[0], 6) + 0.0).alias("clipped0"), F.round(scalars.l2_norm(v), 5).alias("norm")
    )


@query("select o_orderkey as order_key, day(o_orderdate)::int as day, month(o_orderdate)::int as month, year(o_orderdate)::int as year, hour(o_orderdate)::int as hour from orders")
def date_parts(spark, sf_dir):
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), *[c.cast("int").alias(n) for n, c in scalars.date_parts(F.col("o_orderdate")).items()])


@query("select event_id, round(sin(p), 6) + 0.0 as e0, round(cos(p / power(10000.0::double, 0.5::double)), 6) + 0.0 as e1, round(sin(p / 10000.0), 6) + 0.0 as e2, round(cos(p / power(10000.0::double, 1.5::double)), 6) + 0.0 as e3 from (select event_id, (event_id % 50)::double as p from events)")
def positional_encoding_pairwise(spark, sf_dir):
    x = scalars.sinusoidal_pairwise((F.col("event_id") % 50).cast("double"), 4)
    return t(spark, sf_dir, "events").select("event_id", *[(F.round(x[i], 6) + 0.0).alias(f"e{i}") for i in range(4)])


@query("select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as double), 0.0) as k, 0.0::double as missing from events")
def json_attribute(spark, sf_dir):
    p = F.col("props")
    return t(spark, sf_dir, "events").select("event_id", scalars.attribute(p, "k").alias("k"), scalars.attribute(p, "none").alias("missing"))


@query("select user_id, 8.0::double * count(*) / (4.0::double * count(distinct event_type)) as ratio from events group by 1")
def compression_ratios(spark, sf_dir):
    e = t(spark, sf_dir, "events").groupBy("user_id").agg((8.0 * F.count("*")).alias("raw"), (4.0 * F.count_distinct("event_type")).alias("packed"))
    return e.select("user_id", scalars.compression_ratio(F.col("raw"), F.col("packed")).alias("ratio"))


@query("select n_nationkey as nation, lower(n_name) as name from nation")
def database_names(spark, sf_dir):
    url = F.concat(F.lit("postgresql://reader@host:5432/"), F.lower("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("?sslmode=require")).otherwise(F.lit("")))
    return t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), scalars.database_name(url).alias("name"))


@query("""select event_id, s::int as step, round(case when s < 5 then 0.1::double * (s + 1) / 5 else 0.1::double * 0.5 * (1 + cos(pi() * least(1.0::double, (s - 5) / greatest(1, n - 5)::double))) end, 9) as warmup_cosine,
    round(0.1::double * power(0.1::double, s // 40), 9) as step_decay, round(0.1::double * power(0.99::double, s), 9) as exponential
    from (select event_id, event_id // 64 as s from events), (select (count(*) + 63) // 64 as n from events)""")
def learning_rates(spark, sf_dir):
    """The rates at which each event is learnt from when events are taken in batches of 64."""
    e = t(spark, sf_dir, "events")
    n = e.agg(F.floor((F.count("*") + 63) / 64).alias("n"))
    rows = e.select("event_id", F.floor(F.col("event_id") / 64).cast("int").alias("step")).crossJoin(F.broadcast(n))  # one row
    step, lr = F.col("step"), scalars.learning_rates
    return rows.select(
        "event_id", "step", F.round(lr(step, 0.1, "warmup_cosine", F.col("n"), 5), 9).alias("warmup_cosine"),
        F.round(lr(step, 0.1, "step", every=40), 9).alias("step_decay"), F.round(lr(step, 0.1, "exponential", gamma=0.99), 9).alias("exponential"),
    )


# ---------------------------------------------------------------------------------------------- layers

#: Two features of customers, their mean over in-neighbours in the small graph.
LAYER = f"""with {SMALL}, f as (select c_custkey as id, c_acctbal / 1000.0 as a, c_nationkey / 10.0::double as b from customer)"""


def _layer_inputs(spark, sf_dir):
    e = small_graph(spark, sf_dir)[1].withColumn("etype", F.lit(0))
    f = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.array(F.col("c_acctbal") / 1000.0, F.col("c_nationkey") / F.lit(10.0)).alias("x"))
    return e, f


def _pair(df, key="node_id", digits=5):
    return df.select(F.col(key).alias("id"), *[(F.round(F.col("x")[i] + 1e-9, digits) + 0.0).alias(f"x{i}") for i in range(2)])


@query(f"""{LAYER}, m as (select dst as id, avg(a) as a, avg(b) as b from e join f on f.id = src group by 1)
    select id, round(greatest(f.a * 0.5 + f.b + coalesce(m.a - m.b, 0), 0) + 1e-9, 5) + 0.0 as x0, round(greatest(f.b - f.a + coalesce(2 * m.b, 0), 0) + 1e-9, 5) + 0.0 as x1 from f left join m using (id)""")
def sage_layer(spark, sf_dir):
    e, f = _layer_inputs(spark, sf_dir)
    return _pair(aggregate.sage_layer(e, f, [[0.5, 1.0], [-1.0, 1.0]], {0: [[1.0, -1.0], [0.0, 2.0]]}))


@query(f"""{LAYER}, m as (select dst as id, avg(a) as a, avg(b) as b from e join f on f.id = src group by 1)
    select id, round(greatest(f.a + coalesce(0.5 * m.a + 2 * m.b, 0), 0) + 1e-9, 5) + 0.0 as x0, round(greatest(f.b + coalesce(2 * m.a + 0.5 * m.b, 0), 0) + 1e-9, 5) + 0.0 as x1 from f left join m using (id)""")
def basis_layer(spark, sf_dir):
    e, f = _layer_inputs(spark, sf_dir)
    shared = aggregate.basis_weights([[[1.0, 0.0], [0.0, 1.0]], [[0.0, 1.0], [1.0, 0.0]]], {0: [0.5, 2.0]})
    return _pair(aggregate.sage_layer(e, f, [[1.0, 0.0], [0.0, 1.0]], shared))


@query(f"""{LAYER}, m as (select dst as id, sum(a + 2 * b + weight) as a, sum(b - weight) as b from e join f on f.id = src group by 1)
    select id, round(f.a + 2 * f.b + coalesce(m.a, 0) + 1e-9, 5) + 0.0 as x0, round(f.b + coalesce(m.b, 0) + 1e-9, 5) + 0.0 as x1 from f left join m using (id)""")
def edge_convolution(spark, sf_dir):
    e, f = _layer_inputs(spark, sf_dir)
    return _pair(aggregate.edge_conv(e.withColumn("v", F.array("weight")), f, "v", [[1.0, 2.0], [0.0, 1.0]], [[1.0], [-1.0]]))


def _head(n, w0, w1):
    """One head in SQL: features h (W x), scores from a_src = (0.1, 0) and a_dst = (0, 0.2)."""
    return f"""h{n} as (select id, {w0} as a, {w1} as b from f), s{n} as (select src, dst, s.a as a, s.b as b, case when d.b * 0.2 + s.a * 0.1 > 0 then d.b * 0.2 + s.a * 0.1 else 0.2 * (d.b * 0.2 + s.a * 0.1) end as z from e join h{n} s on s.id = src join h{n} d on d.id = dst),
    x{n} as (select dst as id, sum(exp(z) * a) / sum(exp(z)) as a, sum(exp(z) * b) / sum(exp(z)) as b from s{n} group by 1)"""


@query(f"{LAYER}, {_head(0, 'a', 'b')}, {_head(1, 'a + b', 'a - b')} select id, round(x0.a + 1e-9, 5) + 0.0 as x0, round(x0.b + 1e-9, 5) + 0.0 as x1, round(x1.a + 1e-9, 5) + 0.0 as x2, round(x1.b + 1e-9, 5) + 0.0 as x3 from x0 join x1 using (id)")
def multi_head_attention(spark, sf_dir):
    e, f = _layer_inputs(spark, sf_dir)
    heads = [([[1.0, 0.0], [0.0, 1.0]], [0.1, 0.0], [0.0, 0.2]), ([[1.0, 1.0], [1.0, -1.0]], [0.1, 0.0], [0.0, 0.2])]
    out = aggregate.multi_head_attention(e, f, heads)
    return out.select(F.col("node_id").alias("id"), *[(F.round(F.col("x")[i] + 1e-9, 5) + 0.0).alias(f"x{i}") for i in range(4)])


@query(f"with {SMALL} select dst, string_agg(src::varchar, ',' order by src) as sources from e group by 1")
def concatenated_messages(spark, sf_dir):
    e = small_graph(spark, sf_dir)[1]
    f = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.array(F.col("c_custkey").cast("string")).alias("x"))
    return aggregate.concatenated(e, f, "src").select("dst", F.array_join("x", ",").alias("sources"))


@query("""select c_custkey as key, round((c_acctbal - (select avg(c_acctbal) from customer)) / (select stddev_pop(c_acctbal) from customer) + 1e-9, 5) + 0.0 as balance, (c_mktsegment = 'BUILDING')::int::double as building, 1.0::double as ones
    from customer""")
def encoded_rows(spark, sf_dir):
    db = database(spark, sf_dir)
    segments = [r[0] for r in db.tables["customer"].select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]  # a handful of categories
    code = F.array_position(F.array(*[F.lit(s) for s in segments]), F.col("c_mktsegment")) - 1
    db.tables["customer"] = db.tables["customer"].withColumn("segment", code.cast("int"))
    x = features.encoded_rows(db, "customer", {"segment": len(segments)})
    codes = F.slice("x", 2, len(segments))
    building = codes[segments.index("BUILDING")] if "BUILDING" in segments else F.lit(0.0)
    return x.select("key", (F.round(F.col("x")[0] + 1e-9, 5) + 0.0).alias("balance"), building.alias("building"), F.aggregate(codes, F.lit(0.0), lambda s, v: s + v).alias("ones"))


# ---------------------------------------------------------------------------------------------- graph


@query(f"with {SMALL}, d as (select coalesce(n, 0) as n from v left join (select src as id, count(*) as n from u group by 1) using (id)) select min(n)::bigint as min_degree, max(n)::bigint as max_degree, round(avg(n), 9) as avg_degree from d")
def degree_range(spark, sf_dir):
    return analytics.degree_range(*small_graph(spark, sf_dir)).select("min_degree", "max_degree", F.round("avg_degree", 9).alias("avg_degree"))


@query(f"""with {SMALL} select 0 as position, 'digraph G {{' as value union all select 3, '}}' union all select 1, '  "' || c_custkey || '" [label="' || c_mktsegment || '"];' from customer
    union all select 2, '  "' || src || '" -> "' || dst || '" [label="near"];' from e""")
def dot_file(spark, sf_dir):
    nodes = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_mktsegment").alias("label"))
    return graph.dot_graph(nodes, small_graph(spark, sf_dir)[1].withColumn("etype", F.lit("near")))


@query("select c_custkey as node, printf('%.6f', c_acctbal) as f0, printf('%.6f', c_nationkey::double) as f1 from customer")
def node_feature_export(spark, sf_dir):
    return graph.node_features(customer_features(spark, sf_dir), 2)


@query(f"with {NODES}, known as (select node_id from nodes where time <= {SEED_SECONDS}) select src, dst, etype, etime from edges where etime <= {SEED_SECONDS} and src in (select node_id from known) and dst in (select node_id from known)")
def strictly_visible_edges(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.visible(edges, SEED_SECONDS, nodes).select("src", "dst", "etype", "etime")


@query(f"""with {SMALL}, x as (select src, dst from e union all select src, dst from e where src % 5 = 0) select * from (values ('nodes over the limit', (select greatest(count(*) - 1000, 0) from v)), ('edges over the limit', 0),
    ('repeated nodes', 0), ('repeated edges', (select count(*) from e where src % 5 = 0)), ('missing ends', 0), ('vertices behind a cycle', 0)) r(rule, violations)""")
def graph_check(spark, sf_dir):
    v, e = small_graph(spark, sf_dir)
    return graph.check_graph(v, e.select("src", "dst").unionByName(e.where("src % 5 = 0").select("src", "dst")), most_nodes=1000, connected=False)


REACH = f"with recursive {SMALL}, r as (select id as root, id from v union select root, dst from r join u on src = r.id), n as (select root, count(*) as n from r group by 1)"
LEVELS = f"""{REACH}, most as (select max(n) as k from n), w as (select id as source, id, 0 as level from v union select source, dst, level + 1 from w join u on src = w.id, most where level < k),
    l as (select source, id, min(level) as level from w group by 1, 2)"""

SQL["components"] = f"{REACH} select id, min(root) as component from r group by 1"
SQL["components_reached"] = SQL["components"]
SQL["is_connected"] = f"{REACH} select count(distinct c) <= 1 as is_connected from (select id, min(root) as c from r group by 1)"
SQL["closeness"] = f"{LEVELS} select source as id, case when sum(level) > 0 then (count(*) - 1) / sum(level)::double else 0 end as closeness from l group by 1"
SQL["cycle_vertices"] = f"""with recursive {SMALL}, x as (select src, dst from e union select dst, src from e where src % 11 = 0), r as (select src as root, dst as id from x union select root, dst from r join x on src = r.id),
    c as (select root as id from r where root = id) select id from c union select r.id from r join c on c.id = r.root"""
SQL["betweenness"] = f"""{LEVELS}, p as (select source, id, [id] as path from l where level = 0 union all select p.source, g.dst, list_append(p.path, g.dst) from p join (select distinct src, dst from u where src <> dst) g on g.src = p.id
    join l a on a.source = p.source and a.id = p.id join l b on b.source = p.source and b.id = g.dst and b.level = a.level + 1),
    s as (select source, id, count(*) as sigma from p group by 1, 2), i as (select p.source, p.id as target, unnest(path[2:-2]) as id from p),
    d as (select i.id, sum(1.0::double / sigma) as b from i join s on s.source = i.source and s.id = i.target group by 1)
    select id, round(coalesce(b, 0) / ((select count(*) from v) - 1) / ((select count(*) from v) - 2), 12) as betweenness from v left join d using (id)"""


@query(SQL.pop("betweenness"))
def betweenness(spark, sf_dir):
    return analytics.betweenness(*small_graph(spark, sf_dir)).select("id", F.round("betweenness", 12).alias("betweenness"))


NATION_FIRST = "(select min(c_custkey) from customer group by c_nationkey)"
SQL["bfs_levels"] = f"{LEVELS} select id, min(level) as level from l where source in {NATION_FIRST} group by 1"


@query(f"{LEVELS} select source, id, level from l")
def bfs_from_all(spark, sf_dir):
    v, e = small_graph(spark, sf_dir)
    return analytics.bfs_levels(e, v).select("source", "id", "level")


@query(f"""{LEVELS}, q as (select l.source, l.id, min(u.src) as pred from l join u on u.dst = l.id join l k on k.source = l.source and k.id = u.src and k.level = l.level - 1 group by 1, 2),
    p as (select source, id, id::varchar as path from l where level = 0 union all select q.source, q.id, p.path || ',' || q.id from p join q on q.source = p.source and q.pred = p.id)
    select source, id as target, path from p""")
def bfs_paths(spark, sf_dir):
    v, e = small_graph(spark, sf_dir)
    found = analytics.bfs_levels(e, v)
    return paths.paths(found).select("source", "target", F.array_join("path", ",").alias("path"))


def _min_plus(rounds: int) -> str:
    steps = ["g as (select src, dst, min(weight) as w from (select src, dst, weight from e union all select dst, src, weight from e) group by 1, 2)", "d0 as (select id as a, id as b, 0.0::double as d from v union all select src, dst, w from g where src <> dst)"]
    for i in range(rounds):
        steps.append(f"d{i + 1} as materialized (select x.a, y.b, min(x.d + y.d) as d from d{i} x join d{i} y on y.a = x.b group by 1, 2)")
    return f"with {SMALL}, {', '.join(steps)}"


SQL["shortest_paths"] = f"{_min_plus(6)} select b as id, min(d) as distance from d6 where a in {NATION_FIRST} group by 1"


@query(f"{_min_plus(6)} select a as source, b as id, d as distance from d6")
def all_pairs_distances(spark, sf_dir):
    return paths.all_pairs(*small_graph(spark, sf_dir))


@query(f"{_min_plus(6)} select a as source, b as id, d as distance from d6 where a in {NATION_FIRST}")
def distances_from_nations(spark, sf_dir):
    return analytics.shortest_paths(small_graph(spark, sf_dir)[1], smallest_of_nations(spark, sf_dir)).select("source", "id", "distance")


@query(f"""with recursive {SMALL}, w as (select id as source, id, 0 as level from v union select source, dst, level + 1 from w join e on src = w.id), l as (select source, id, min(level) as level from w group by 1, 2)
    select source as id, round(case when sum(level) > 0 then ((select count(*) from v) - 1) / sum(level)::double else 0 end, 9) as closeness from l group by 1""")
def closeness_directed(spark, sf_dir):
    return analytics.closeness(*small_graph(spark, sf_dir), directed=True).select("id", F.round("closeness", 9).alias("closeness"))


def _eigen_sql(rounds: int) -> str:
    steps = ["s0 as (select id, 1.0::double as s from v)"]
    for i in range(rounds):
        steps.append(f"t{i} as (select v.id, coalesce(x, 0) as s from v left join (select dst as id, sum(s) as x from u join s{i} on s{i}.id = src group by 1) using (id)), s{i + 1} as materialized (select id, s / (select sum(s) from t{i}) as s from t{i})")
    return f"with {SMALL}, {', '.join(steps)} select id, round(s, 9) as score from s{rounds}"


@query(_eigen_sql(10))
def eigenvector_undirected(spark, sf_dir):
    v, e = small_graph(spark, sf_dir)
    return analytics.eigenvector_centrality(v, both_ways(e), rounds=10).select("id", F.round("score", 9).alias("score"))


def _kmeans_sql(rounds: int) -> str:
    steps = ["x as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as p from embeddings)", "c0 as (select vec_id as cid, p, v from x where vec_id < 4)"]
    near = lambda i: f"select vec_id, arg_min(cid, {{'d': d, 'c': cid}}) as cid from (select x.vec_id, c.cid, sum((x.v - c.v) * (x.v - c.v)) as d from x join c{i} c on c.p = x.p group by 1, 2) group by 1"
    for i in range(rounds):
        steps += [f"n{i} as materialized ({near(i)})", f"m{i} as (select cid, p, avg(v) as v from n{i} join x using (vec_id) group by 1, 2)"]
        steps.append(f"c{i + 1} as materialized (select c{i}.cid, p, coalesce(m{i}.v, c{i}.v) as v from c{i} left join m{i} using (cid, p))")
    return f"with {', '.join(steps)} select cid::int as cid, count(*) as n from ({near(rounds)}) group by 1"


SQL["kmeans"] = _kmeans_sql(5)


@query()
def louvain_communities(spark, sf_dir):
    return communities.louvain(*small_graph(spark, sf_dir))


@query()
def spectral_clusters(spark, sf_dir):
    return communities.spectral_clusters(small_graph(spark, sf_dir)[1], 25)


# ---------------------------------------------------------------------------------------------- sampling


def _u(parts: str) -> str:
    return f"('0x' || md5({parts})[1:7])::bigint / 268435456.0::double"


@query(f"with {NODES} select src, dst, etype from edges where {_u('''concat_ws(':', src, dst, etype, 7)''')} >= 0.25::double")
def edge_dropout(spark, sf_dir):
    return tasks.dropped_edges(_graph(spark, sf_dir)[1], 0.25, 7).select("src", "dst", "etype")


@query(f"with {SMALL}, k as (select id from v where {_u('''concat_ws(':', id, 7)''')} >= 0.25::double) select src, dst from e where src in (from k) and dst in (from k)")
def node_dropout(spark, sf_dir):
    v, e = small_graph(spark, sf_dir)
    return sampling.without_nodes(v.withColumnRenamed("id", "node_id"), e, 0.25, 7)[1].select("src", "dst")


@query(f"""with d as (select c_custkey, c_mktsegment, {_u('''concat_ws(':', c_custkey, 42)''')} as u, row_number() over (partition by c_mktsegment order by md5(concat_ws(':', c_custkey, 42)), c_custkey) as k from customer)
    select c_custkey as customer, c_mktsegment as segment from d where u < 0.2::double or k = 1""")
def stratified_sample(spark, sf_dir):
    return tasks.stratified_sample(t(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", 0.2).select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("segment"))


WALKS = "w as (select user_id as walk, (row_number() over (partition by user_id order by event_id) - 1)::int as step, event_id % 10 as node from events)"


@query(f"with {WALKS} select distinct a.node as src, b.node as dst from w a join w b on b.walk = a.walk and b.step = a.step + 1")
def walk_subgraph(spark, sf_dir):
    from pyspark.sql import Window

    e = t(spark, sf_dir, "events")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1  # a walk for each of many users
    walks = e.select(F.col("user_id").alias("walk"), step.alias("step"), (F.col("event_id") % 10).alias("node"))
    return sampling.walk_subgraph(walks)[1]


@query(f"""with {NODES}, s as (select node_id from nodes where type_id = 1), r as (select etype, src, dst, row_number() over (partition by etype, dst order by md5(src || ':' || dst || ':3:1'), src) as k from (select distinct etype, src, dst from edges) where dst in (from s))
    select etype, src, dst from r where (etype = 1 and k <= 1) or (etype = 2 and k <= 4) or (etype = 4 and k <= 2)""")
def typed_sample(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return sampling.typed_sample(edges, nodes.where("type_id = 1").select("node_id"), {1: 1, 2: 4, 4: 2}, seed=3)


@query(f"""with {SMALL}, h as (select src, dst, row_number() over (partition by dst order by md5(src || ':' || dst || ':3:1'), src) as k from (select distinct src, dst from u)), g as (select src, dst from h where k <= 2),
    n as (select id from v union select src from g), l as (select id, row_number() over (order by id) - 1 as local from n) select 1 as hop, a.local as src, b.local as dst from g join l a on a.id = src join l b on b.id = dst""")
def sampled_inputs(spark, sf_dir):
    v, e = small_graph(spark, sf_dir)
    seeds = v.withColumnRenamed("id", "node_id")
    drawn = sampling.neighbour_sample(both_ways(e), seeds, [2], seed=3)
    return sampling.sampled_inputs(drawn, seeds, customer_features(spark, sf_dir))[1]


@query(f"""with {SMALL}, h as (select src, dst, row_number() over (partition by dst order by md5(src || ':' || dst || ':1:1'), src) as k from (select distinct src, dst from u)), c as (select c_nationkey as graph_id, min(c_custkey) as id from customer group by 1)
    select graph_id, 1 as hop, src, dst from c join h on h.dst = c.id where k <= 3""")
def seed_subgraphs(spark, sf_dir):
    seeds = t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("graph_id")).agg(F.min("c_custkey").alias("node_id"))
    return sampling.seed_subgraphs(both_ways(small_graph(spark, sf_dir)[1]), seeds, [3])


@query(f"""with {SMALL}, d as (select id, coalesce(n, 0)::double as n from v left join (select src as id, count(*) as n from u group by 1) using (id)), k as (select id from d where n >= 2 order by n desc, id limit 50)
    select src, dst from e where src in (from k) and dst in (from k)""")
def importance_subgraph(spark, sf_dir):
    v, e = small_graph(spark, sf_dir)
    degree = both_ways(e).groupBy(F.col("src").alias("node_id")).agg(F.count("*").cast("double").alias("importance"))
    return sampling.importance_sample(degree, e, 2.0, 50)[1].select("src", "dst")


@query("select event_id, value from (select event_id, value, row_number() over (order by abs(value) desc, event_id) as k, count(*) over () as n from events) where k <= floor(n * 0.25)")
def magnitude_pruning(spark, sf_dir):
    return features.sparse_weights(t(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id", 0.75)


@query("select o_orderkey as order_key, o_totalprice as price from orders order by o_totalprice, o_orderkey limit 100 offset 250")
def page_of_orders(spark, sf_dir):
    return features.page(t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("price")), ["price", "order_key"], 250, 100)


# ---------------------------------------------------------------------------------------------- labels, metrics, checks


def _item_facts(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice").join(o, "l_orderkey")


@query(f"""select p_partkey as item, (count(o_orderkey) = 0)::int as churn, coalesce(sum(cast(l_extendedprice as decimal(18,2))) filter (where o_orderkey is not null), 0)::double as ltv
    from part left join lineitem on l_partkey = p_partkey left join orders on o_orderkey = l_orderkey and o_orderdate > timestamp '{SEED}' and o_orderdate <= timestamp '{SEED}' + interval '{HORIZON} days' group by p_partkey""")
def item_churn_labels(spark, sf_dir):
    out = tasks.task_table(t(spark, sf_dir, "part"), "p_partkey", _item_facts(spark, sf_dir), "l_partkey", F.col("o_orderdate"), [SEED], HORIZON, F.col("l_extendedprice"))
    return out.select(F.col("p_partkey").alias("item"), "churn", F.col("total").alias("ltv"))


@query(f"""with g as (select score, sum(label)::double as p, count(*)::double as n from {SCORED} group by 1), w as (select p, n, sum(p) over (order by score desc) as tp, sum(n) over (order by score desc) as al from g)
    select round(sum(p * (tp / al + case when al > n then (tp - p) / (al - n) else 1 end) / 2) / sum(p), 9) as auprc from w""")
def auprc(spark, sf_dir):
    return metrics.auprc(scored(spark, sf_dir)).select(F.round("auprc", 9).alias("auprc"))


@query("""select 'events' as "table", r[1] as "column", r[2] as rule, n as rows, v::bigint as violations from (select count(*) as n, count(*) filter (where event_id % 5 = 0) as a, count(*) filter (where event_id % 7 = 0) as b, count(*) filter (where event_id % 3 = 0) as c, count(*) filter (where value < 0) as d from events),
    unnest([{'r': ['mail', 'email'], 'v': a}, {'r': ['token', 'uuid'], 'v': b}, {'r': ['at', 'timestamp'], 'v': c}, {'r': ['value', 'non_negative'], 'v': d}]) x(y), lateral (select y.r as r, y.v as v)""")
def format_report(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    wrong = lambda k, good, bad: F.when(F.col("event_id") % k == 0, F.lit(bad)).otherwise(good)
    hexed = F.md5(F.col("event_id").cast("string"))
    uuid = F.concat_ws("-", *[F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    rows = e.select(wrong(5, F.concat(F.lit("user"), "event_id", F.lit("@example.com")), "user@example").alias("mail"), wrong(7, uuid, "123-x").alias("token"), wrong(3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "yesterday").alias("at"), "value")
    return validation.validate(rows, "events", [("mail", "email"), ("token", "uuid"), ("at", "timestamp"), ("value", "non_negative")])


@query("select 'a' as \"column\", count(*) filter (where event_id % 4 = 0) as nan, count(*) filter (where event_id % 4 = 1) as infinite from events")
def not_finite(spark, sf_dir):
    r = F.col("event_id") % 4
    a = F.when(r == 0, F.lit(float("nan"))).when(r == 1, F.lit(float("-inf"))).otherwise(1.0)
    return validation.not_finite(t(spark, sf_dir, "events").select(a.alias("a")), ["a"])


@query("select 'orders' as \"table\", 'index' as suggestion union all select 'orders', 'partition' where (select count(*) from orders) > 1000 union all select 'lineitem', 'partition' where (select count(*) from lineitem) > 1000")
def table_suggestions(spark, sf_dir):
    sizes = sources.row_counts({n: t(spark, sf_dir, n) for n in ("orders", "lineitem", "nation")})
    reads = spark.createDataFrame([("orders", 5000), ("nation", 10)], "table string, accesses long")
    return validation.suggestions(sizes, reads, partition_over=1000)


@query("""with x as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval '1 hour' then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
    s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from x) select user_id, count(*) as n, min(ts) as start from s group by user_id, k""")
def stream_sessions(spark, sf_dir):
    scratch = Scratch(spark)
    target = f"{scratch.root}/sessions"
    streams.run_available(streams.sessions(streams.read_events(spark, sf_dir, "events.parquet"), late="3650 days"), target, f"{scratch.root}/sessions-state", "complete")
    return spark.read.parquet(target).select("user_id", "n", F.col("start").cast("timestamp_ntz").alias("start"))
