"""Registered queries of the relational-graph operators and their SQL.

The TPC-H-like tables stand for the database: customers are the entities, parts the items, orders and
lineitem the facts, events the stream, embeddings the node vectors. Every query reads whole tables. Doubles
are rounded in both engines where their sums depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relmill.functions import features, metrics, scalars
from relmill.operators import aggregate, analytics, codecs, graph, ordered, paths, sampling, tasks, validation
from relmill.schema import ForeignKey, RelationalDB
from relmill.staging import Scratch, spread
from relmill.streaming import events as streams

SEED, HORIZON = "2000-01-01", 90
SEED_SECONDS = 946684800.0  # SEED in seconds since 1970
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def database(spark: SparkSession, sf_dir: str) -> RelationalDB:
    names = ["region", "nation", "customer", "supplier", "part", "orders"]
    tables = {n: t(spark, sf_dir, n) for n in names}
    tables["orders"] = tables["orders"].withColumn("_time", scalars.seconds(F.col("o_orderdate")))
    keys = dict(zip(names, ["r_regionkey", "n_nationkey", "c_custkey", "s_suppkey", "p_partkey", "o_orderkey"], strict=True))
    fks = [ForeignKey("nation", "n_regionkey", "region"), ForeignKey("customer", "c_nationkey", "nation"), ForeignKey("supplier", "s_nationkey", "nation"), ForeignKey("orders", "o_custkey", "customer")]
    return RelationalDB("shop", tables, fks, keys, {"orders": "_time"})


def order_edges(spark, sf_dir) -> DataFrame:
    """Customer and part as a graph: src a customer, dst 10^9 + part, one edge per line item, dealt out by customer."""
    o, li = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    rows = li.count()  # of the files' footers
    o = spread(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"), rows, "l_orderkey")
    e = spread(li.select("l_orderkey", "l_partkey", "l_quantity"), rows, "l_orderkey").join(o.hint("merge"), "l_orderkey")
    return spread(e, rows, "o_custkey").select(F.col("o_custkey").alias("src"), (F.col("l_partkey") + 10**9).alias("dst"), F.col("l_quantity").alias("weight"), scalars.seconds(F.col("o_orderdate")).alias("etime"))


ORDER_EDGES = "(select o_custkey as src, l_partkey + 1000000000 as dst, l_quantity as weight, epoch(o_orderdate)::double as etime from lineitem join orders on l_orderkey = o_orderkey)"


def small_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Customers of one nation are close to each other: a sparse graph on customers, by keys that differ by a
    power of two within a nation, for the iterative operators."""
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    step = c.select(F.col("id").alias("src"), "nation", F.explode(F.array(*[F.lit(2**i) for i in range(8)])).alias("d")).withColumn("dst", F.col("src") + F.col("d"))
    e = step.join(c.select(F.col("id").alias("dst"), "nation").hint("merge"), ["dst", "nation"]).select("src", "dst", F.col("d").cast("double").alias("weight"))
    return c.select("id"), e


SMALL = """v as (select c_custkey as id, c_nationkey as nation from customer),
    e as (select a.id as src, b.id as dst, (b.id - a.id)::double as weight from v a join v b on a.nation = b.nation and b.id - a.id in (1, 2, 4, 8, 16, 32, 64, 128)),
    u as (select src, dst from e union all select dst, src from e)"""


# ---------------------------------------------------------------------------------------------- labels


@query(f"""select c_custkey as customer, cast(count(o_orderkey) as bigint) as n_events, coalesce(sum(cast(o_totalprice as decimal(18,2))), 0)::double as total,
    case when count(o_orderkey) = 0 then 1 else 0 end as churn
    from customer left join orders on o_custkey = c_custkey and o_orderdate > timestamp '{SEED}' and o_orderdate <= timestamp '{SEED}' + interval '{HORIZON} days' group by c_custkey""")
def task_labels(spark, sf_dir):
    out = tasks.task_table(t(spark, sf_dir, "customer"), "c_custkey", t(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderdate"), [SEED], HORIZON, F.col("o_totalprice"))
    return out.select(F.col("c_custkey").alias("customer"), "n_events", "total", "churn")


@query("""select cast(s as varchar)[:10] as seed, c_custkey as customer, cast(count(o_orderkey) as bigint) as n_events, coalesce(sum(cast(o_totalprice as decimal(18,2))), 0)::double as total
    from customer cross join (select unnest([timestamp '1998-01-01', timestamp '1999-01-01', timestamp '2000-01-01']) as s)
    left join orders on o_custkey = c_custkey and o_orderdate > s and o_orderdate <= s + interval '180 days' group by s, c_custkey""")
def task_table_multi_time(spark, sf_dir):
    out = tasks.task_table(t(spark, sf_dir, "customer"), "c_custkey", t(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderdate"), ["1998-01-01", "1999-01-01", "2000-01-01"], 180, F.col("o_totalprice"))
    return out.select(F.date_format("seed", "yyyy-MM-dd").alias("seed"), F.col("c_custkey").alias("customer"), "n_events", "total")


@query(f"""select p_partkey as item, cast(count(o_orderkey) as bigint) as n_sales, coalesce(sum(cast(l_extendedprice as decimal(18,2))) filter (where o_orderkey is not null), 0)::double as sales
    from part left join lineitem on l_partkey = p_partkey left join orders on o_orderkey = l_orderkey and o_orderdate > timestamp '{SEED}' and o_orderdate <= timestamp '{SEED}' + interval '{HORIZON} days' group by p_partkey""")
def item_sales_labels(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    facts = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice").join(o, "l_orderkey")
    out = tasks.task_table(t(spark, sf_dir, "part"), "p_partkey", facts, "l_partkey", F.col("o_orderdate"), [SEED], HORIZON, F.col("l_extendedprice"))
    return out.select(F.col("p_partkey").alias("item"), F.col("n_events").alias("n_sales"), F.col("total").alias("sales"))


SPLIT = "('0x' || md5(concat(c_custkey, ':', 7))[1:7])::bigint / 268435456.0"


@query(f"select c_custkey as customer, case when {SPLIT} < 0.6 then 'train' when {SPLIT} < 0.8 then 'valid' else 'test' end as split from customer")
def hash_split(spark, sf_dir):
    return tasks.hash_split(t(spark, sf_dir, "customer"), "c_custkey", 7).select(F.col("c_custkey").alias("customer"), "split")


@query("select o_orderkey as order_key, case when o_orderdate > timestamp '2000-01-01' then 'test' when o_orderdate > timestamp '1999-01-01' then 'valid' else 'train' end as split from orders")
def temporal_split(spark, sf_dir):
    return tasks.temporal_split(t(spark, sf_dir, "orders"), "o_orderdate", "1999-01-01", "2000-01-01").select(F.col("o_orderkey").alias("order_key"), "split")


@query(f"select round(avg(c_acctbal), 6) as mean, round(stddev_pop(c_acctbal), 6) as std from customer where {SPLIT} < 0.6")
def train_label_stats(spark, sf_dir):
    rows = tasks.hash_split(t(spark, sf_dir, "customer"), "c_custkey", 7)
    return tasks.label_stats(rows, "c_acctbal").select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("select c_custkey as customer, cast(floor((row_number() over (order by md5(concat(c_custkey, ':', 3)), c_custkey) - 1) / 64) as bigint) as batch from customer")
def mini_batches(spark, sf_dir):
    return tasks.mini_batches(t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 64, 3).select(F.col("c_custkey").alias("customer"), "batch")


# ---------------------------------------------------------------------------------------------- graph

NODES = """n0 as (select 'region' as tab, r_regionkey::bigint as k, 0 as type_id, '-inf'::double as time from region union all select 'nation', n_nationkey, 1, '-inf'::double from nation
    union all select 'customer', c_custkey, 2, '-inf'::double from customer union all select 'supplier', s_suppkey, 3, '-inf'::double from supplier
    union all select 'part', p_partkey, 4, '-inf'::double from part union all select 'orders', o_orderkey, 5, epoch(o_orderdate)::double from orders),
    nodes as (select tab, k, type_id, time, row_number() over (order by type_id, k) - 1 as node_id, row_number() over (partition by type_id order by k) - 1 as row from n0),
    pairs as (select 0 as r, n_nationkey::bigint as a, n_regionkey::bigint as b, '-inf'::double as etime, 1 as ta, 0 as tb from nation union all select 1, c_custkey, c_nationkey, '-inf'::double, 2, 1 from customer
    union all select 2, s_suppkey, s_nationkey, '-inf'::double, 3, 1 from supplier union all select 3, o_orderkey, o_custkey, epoch(o_orderdate)::double, 5, 2 from orders),
    ab as (select r, x.node_id as a, y.node_id as b, etime from pairs join nodes x on x.type_id = ta and x.k = a join nodes y on y.type_id = tb and y.k = b),
    edges as (select a as src, b as dst, 2 * r as etype, etime from ab union all select b, a, 2 * r + 1, etime from ab)"""


@query(f"with {NODES} select node_id, type_id, row, time from nodes")
def graph_nodes(spark, sf_dir):
    return graph.keyed_nodes(database(spark, sf_dir)).select("node_id", "type_id", "row", "time")


def _graph(spark, sf_dir):
    db = database(spark, sf_dir)
    nodes = Scratch(spark).store(graph.keyed_nodes(db), "nodes")
    return nodes, graph.edges(db, nodes)


@query(f"with {NODES} select src, dst, etype, etime from edges")
def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1].select("src", "dst", "etype", "etime")


@query(f"with {NODES} select src, dst, etype, etime from edges where etime <= {SEED_SECONDS}")
def visible_edges(spark, sf_dir):
    return graph.visible(_graph(spark, sf_dir)[1], SEED_SECONDS).select("src", "dst", "etype", "etime")


@query(f"with {NODES} select etype, count(*) as n_edges from edges where etime <= {SEED_SECONDS} group by etype")
def relation_counts(spark, sf_dir):
    return graph.relation_counts(graph.visible(_graph(spark, sf_dir)[1], SEED_SECONDS))


@query(f"with {NODES} select type_id, count(*) as n_nodes from nodes group by type_id")
def node_type_counts(spark, sf_dir):
    return graph.node_type_counts(_graph(spark, sf_dir)[0])


@query(f"with {NODES} select dst as node_id, count(*) as degree from edges group by dst")
def in_degree(spark, sf_dir):
    return graph.in_degree(_graph(spark, sf_dir)[1])


@query(f"with {NODES}, c as (select (select count(*) from nodes) as n, (select count(*) from edges) as e) select n, e, 2.0::double * e / n as avg_degree, 2.0::double * e / (n::double * (n - 1)) as density from c")
def density_stats(spark, sf_dir):
    return graph.density_stats(*_graph(spark, sf_dir))


@query("select l_orderkey as order_key, l_partkey as part_key, count(*) as copies from lineitem group by 1, 2 having count(*) > 1")
def duplicate_edges(spark, sf_dir):
    e = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_partkey").alias("part_key"))
    return graph.duplicate_edges(e, ["order_key", "part_key"])


@query(f"select node_id from (select src as node_id from {ORDER_EDGES} union select dst from {ORDER_EDGES})")
def edge_endpoints(spark, sf_dir):
    return graph.endpoints(order_edges(spark, sf_dir))


@query(f"select src, dst, count(*) as n from {ORDER_EDGES} where src in (select c_custkey from customer where c_acctbal > 0) and dst in (select p_partkey + 1000000000 from part where p_size <= 25) group by 1, 2")
def induced_edges(spark, sf_dir):
    customers = t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("node_id"))
    parts = t(spark, sf_dir, "part").where("p_size <= 25").select((F.col("p_partkey") + 10**9).alias("node_id"))
    return graph.induced(order_edges(spark, sf_dir), customers.unionByName(parts)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"with {SMALL} select i, j, sum(w) as v from (select src as i, dst as j, weight as w from e union all select dst, src, weight from e) group by 1, 2")
def adjacency(spark, sf_dir):
    return graph.adjacency(small_graph(spark, sf_dir)[1], "weight")


@query(f"""with {SMALL} select '  "' || src || '" -> "' || dst || '" [label="' || 'near' || '"];' as value from e""")
def dot_export(spark, sf_dir):
    return graph.dot_lines(small_graph(spark, sf_dir)[1].withColumn("etype", F.lit("near")))


@query(f"with {SMALL} select src as source, dst as target, 'near' as relation, printf('%.6f', weight) as weight from e")
def edge_list_export(spark, sf_dir):
    return graph.edge_list(small_graph(spark, sf_dir)[1].withColumn("etype", F.lit("near")), F.col("weight"))


# ---------------------------------------------------------------------------------------------- features


@query("select c_custkey as customer, round((c_acctbal - (select avg(c_acctbal) from customer)) / greatest((select stddev_pop(c_acctbal) from customer), 1e-6), 6) as z from customer")
def standardise(spark, sf_dir):
    return features.standardise(t(spark, sf_dir, "customer"), "c_acctbal", "z").select(F.col("c_custkey").alias("customer"), F.round("z", 6).alias("z"))


@query("select p_partkey as part_key, (p_retailprice - (select min(p_retailprice) from part)) / ((select max(p_retailprice) from part) - (select min(p_retailprice) from part)) as scaled from part")
def minmax_scale(spark, sf_dir):
    return features.minmax(t(spark, sf_dir, "part"), "p_retailprice", "scaled").select(F.col("p_partkey").alias("part_key"), "scaled")


@query("""with q as (select quantile_cont(c_acctbal, 0.25) as a, quantile_cont(c_acctbal, 0.5) as m, quantile_cont(c_acctbal, 0.75) as b from customer)
    select c_custkey as customer, round((c_acctbal - m) / (b - a), 6) as scaled from customer, q""")
def robust_scale(spark, sf_dir):
    return features.robust(t(spark, sf_dir, "customer"), "c_acctbal", "scaled").select(F.col("c_custkey").alias("customer"), F.round("scaled", 6).alias("scaled"))


@query("""with m as (select max(epoch(o_orderdate)::double) as tm from orders) select o_orderkey as order_key, round(epoch(o_orderdate)::double / tm, 6) as t_rel,
    round(sin(2 * pi() * epoch(o_orderdate)::double / tm), 6) + 0.0 as sin_full, round(cos(2 * pi() * epoch(o_orderdate)::double / tm), 6) + 0.0 as cos_full,
    round(sin(2 * pi() * epoch(o_orderdate)::double / (tm / 4)), 6) + 0.0 as sin_quarter, round(cos(2 * pi() * epoch(o_orderdate)::double / (tm / 4)), 6) + 0.0 as cos_quarter,
    round(sin(2 * pi() * epoch(o_orderdate)::double / (tm / 12)), 6) + 0.0 as sin_twelfth, round(cos(2 * pi() * epoch(o_orderdate)::double / (tm / 12)), 6) + 0.0 as cos_twelfth from orders, m""")
def cyclic_time(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", scalars.seconds(F.col("o_orderdate")).alias("s"))
    both = o.crossJoin(F.broadcast(o.agg(F.max("s").alias("tm"))))
    return both.select(F.col("o_orderkey").alias("order_key"), *[(F.round(c, 6) + 0.0).alias(n) for n, c in scalars.cyclic_time(F.col("s"), F.col("tm")).items()])


@query("""with f as (select p_brand as b, min(p_partkey) as m from part group by 1), d as (select b, row_number() over (order by m) - 1 as code from f)
    select p_partkey as part_key, code from part join d on b = p_brand""")
def dictionary_encode(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return features.dictionary_encoded(p, "p_brand", "p_partkey", "code").select(F.col("p_partkey").alias("part_key"), "code")


@query("select token, row_number() over (order by token) + 3 as id from (select distinct event_type as token from events)")
def vocabulary(spark, sf_dir):
    return features.vocabulary(t(spark, sf_dir, "events"), "event_type", 4)


@query("select round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std from (select unnest(embedding)::double as x from embeddings)")
def embedding_stats(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"))
    return features.embedding_stats(e, "x").select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("select s as value from (select o_totalprice as s, row_number() over (order by o_totalprice) - 1 as i, count(*) over () as n from orders) where i = cast(round((n - 1) * 0.9::double) as bigint)")
def seed_quantile(spark, sf_dir):
    return ordered.nearest_rank(t(spark, sf_dir, "orders"), "o_totalprice", 0.9).select(F.col("o_totalprice").alias("value"))


@query("""select event_id, case when try_cast(trim(x) as double) is not null then try_cast(trim(x) as double) else 0.0 end as number from (select event_id, case when event_id % 7 = 0 then ' n/a ' else ' ' || event_id || '.5 ' end as x from events)""")
def numeric_coercion(spark, sf_dir):
    x = F.when(F.col("event_id") % 7 == 0, F.lit(" n/a ")).otherwise(F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(".5 ")))
    return t(spark, sf_dir, "events").select("event_id", scalars.number_or_zero(x).alias("number"))


@query("""select event_id, case event_id % 4 when 0 then '-inf'::double when 1 then event_id::double when 2 then '-inf'::double else epoch(date_trunc('day', ts))::double end as seconds from events""")
def parse_time(spark, sf_dir):
    r = F.col("event_id") % 4
    x = F.when(r == 0, F.lit("")).when(r == 1, F.col("event_id").cast("string")).when(r == 2, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t(spark, sf_dir, "events").select("event_id", scalars.parse_time(x).alias("seconds"))


@query("""select vec_id, round(list_dot_product(embedding::double[], embedding::double[]), 5) as norm2 from embeddings""")
def vector_norms(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return t(spark, sf_dir, "embeddings").select("vec_id", F.round(scalars.dot(v, v), 5).alias("norm2"))


@query("select event_id, round(sin(p), 6) as e0, round(cos(p), 6) as e1, round(sin(p / 100.0), 6) as e2, round(cos(p / 100.0), 6) as e3 from (select event_id, (event_id % 50)::double as p from events)")
def positional_encoding(spark, sf_dir):
    x = scalars.sinusoidal((F.col("event_id") % 50).cast("double"), 4)
    return t(spark, sf_dir, "events").select("event_id", *[F.round(x[i], 6).alias(f"e{i}") for i in range(4)])


# ---------------------------------------------------------------------------------------------- messages

MESSAGES = f"""f as (select c_custkey as node_id, c_acctbal as x0, c_nationkey::double as x1 from customer), m as (select dst, x0, x1, weight from {ORDER_EDGES} join f on f.node_id = src)"""


def customer_features(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.array(F.col("c_acctbal"), F.col("c_nationkey").cast("double")).alias("x")).hint("merge")


def _two(df, key="dst"):
    return df.select(key, *[F.round(F.col("x")[i], 4).alias(f"x{i}") for i in range(2)])


@query(f"with {MESSAGES} select dst, round(sum(x0), 4) as x0, round(sum(x1), 4) as x1 from m group by dst")
def scatter_sum(spark, sf_dir):
    return _two(aggregate.scatter(order_edges(spark, sf_dir), customer_features(spark, sf_dir), "sum"))


@query(f"with {MESSAGES} select dst, round(avg(x0) + 1e-7, 4) as x0, round(avg(x1) + 1e-7, 4) as x1 from m group by dst")
def scatter_mean(spark, sf_dir):
    out = aggregate.scatter(order_edges(spark, sf_dir), customer_features(spark, sf_dir), "mean")
    return _two(out.withColumn("x", F.transform("x", lambda v: v + 1e-7)))  # off exact halves of the last digit


@query(f"with {MESSAGES} select dst, round(sum(weight * x0), 4) as x0, round(sum(weight * x1), 4) as x1 from m group by dst")
def weighted_messages(spark, sf_dir):
    return _two(aggregate.scatter(order_edges(spark, sf_dir), customer_features(spark, sf_dir), "sum", weight="weight"))


@query("""with s as (select o_orderkey, o_custkey, exp(o_totalprice / 100000.0 - (select max(o_totalprice) from orders) / 100000.0) as e from orders),
    z as (select o_custkey, sum(e) as z from s group by 1) select o_orderkey as order_key, round(e / (z + 1e-16), 8) as alpha from s join z using (o_custkey)""")
def edge_softmax(spark, sf_dir):
    e = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("dst"), (F.col("o_totalprice") / 100000.0).alias("score"))
    return aggregate.edge_softmax(e, "score").select(F.col("o_orderkey").alias("order_key"), F.round("alpha", 8).alias("alpha"))


@query(f"""with {SMALL}, h0 as (select c_custkey as id, c_acctbal as x from customer), h1 as (select id, coalesce(x1, 0) as x from v left join (select dst as id, avg(x) as x1 from u join h0 on h0.id = src group by 1) using (id)),
    h2 as (select id, coalesce(x2, 0) as x from v left join (select dst as id, avg(x) as x2 from u join h1 on h1.id = src group by 1) using (id))
    select id, h0.x as x0, round(h1.x + 1e-8, 5) as x1, round(h2.x + 1e-8, 5) as x2 from h0 join h1 using (id) join h2 using (id)""")
def khop_mean(spark, sf_dir):
    v, e = small_graph(spark, sf_dir)
    f = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.array("c_acctbal").alias("x"))
    both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    hops = aggregate.khop_mean(both, f, 2)
    out = hops[0].select(F.col("node_id").alias("id"), F.col("x")[0].alias("x0"))
    for i in (1, 2):
        out = out.join(hops[i].select(F.col("node_id").alias("id"), F.round(F.col("x")[0] + 1e-8, 5).alias(f"x{i}")), "id")
    return out


def _centroids(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").where("vec_id < 4")
    return e.select(F.col("vec_id").cast("int").alias("cid"), F.col("embedding").cast("array<double>").alias("c"))


def _vectors(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("x"))


PAIRS = "(select a.vec_id as node_id, b.vec_id::int as cid, list_dot_product(a.embedding::double[], b.embedding::double[]) as d, list_distance(a.embedding::double[], b.embedding::double[]) as dist from embeddings a, embeddings b where b.vec_id < 4)"


@query(f"select node_id, arg_min(cid, dist) as cid, round(min(dist) * min(dist), 4) as distance2 from {PAIRS} group by 1")
def nearest_centroid(spark, sf_dir):
    out = aggregate.nearest_centroid(_vectors(spark, sf_dir), _centroids(spark, sf_dir))
    return out.select("node_id", "cid", F.round("distance2", 4).alias("distance2"))


@query(f"""with p as (select node_id, cid, d / 8.0 as s from {PAIRS}), m as (select node_id, max(s) as m from p group by 1), x as (select node_id, cid, exp(s - m) as e from p join m using (node_id))
    select node_id, cid, round(e / sum(e) over (partition by node_id), 6) as attention from x""")
def centroid_attention(spark, sf_dir):
    out = aggregate.centroid_attention(_vectors(spark, sf_dir), _centroids(spark, sf_dir))
    return out.select("node_id", F.posexplode("attention").alias("cid", "a")).select("node_id", "cid", F.round("a", 6).alias("attention"))


@query()
def kmeans(spark, sf_dir):
    near = aggregate.nearest_centroid(_vectors(spark, sf_dir), aggregate.kmeans(_vectors(spark, sf_dir), _centroids(spark, sf_dir), 5))
    return near.groupBy("cid").agg(F.count("*").alias("n"))


@query("select round(avg(embedding[1]::double), 6) as m0, round(avg(embedding[64]::double), 6) as m63 from embeddings")
def element_mean(spark, sf_dir):
    out = aggregate.element_mean(_vectors(spark, sf_dir), "x")
    return out.select(F.round(F.col("mean")[0], 6).alias("m0"), F.round(F.col("mean")[63], 6).alias("m63"))


@query("""with p as (select user_id, (event_id % 3 = 0)::int::double as y, 1.0 + event_id % 2 as w from events), n as (select user_id, y, count(*) as c from p group by 1, 2)
    select user_id, round(avg(y), 8) as average, round(sum(w * y) / sum(w), 8) as weighted, (select arg_min(y, {'a': -c, 'b': y}) from n where n.user_id = p.user_id) as majority from p group by 1""")
def ensemble(spark, sf_dir):
    p = t(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 3 == 0).cast("int").cast("double").alias("y"), (F.col("event_id") % 2 + 1.0).alias("w"))
    return aggregate.ensemble(p, "user_id", "y", "w").select("user_id", F.round("average", 8).alias("average"), F.round("weighted", 8).alias("weighted"), "majority")


# ---------------------------------------------------------------------------------------------- metrics

SCORED = "(select value as score, (event_type = 'purchase')::int as label, event_id, user_id from events)"


def scored(spark, sf_dir):
    return t(spark, sf_dir, "events").select(F.col("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("label"), "event_id", "user_id")


@query(f"""with r as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as rk from {SCORED}), c as (select sum(label)::double as p, sum(1 - label)::double as q, sum(case when label = 1 then rk end) as s from r)
    select round((s - p * (p + 1) / 2) / (p * q), 9) as roc_auc from c""")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(scored(spark, sf_dir)).select(F.round("roc_auc", 9).alias("roc_auc"))


@query(f"""with g as (select score, sum(label)::double as p, count(*)::double as n from {SCORED} group by 1), w as (select p, sum(p) over (order by score desc) as tp, sum(n) over (order by score desc) as al from g)
    select round(sum(p * tp / al) / sum(p), 9) as average_precision from w""")
def average_precision(spark, sf_dir):
    return metrics.average_precision(scored(spark, sf_dir)).select(F.round("average_precision", 9).alias("average_precision"))


PRED = "(select (value > 0.5 * (select max(value) from events))::int as pred, (event_type = 'purchase')::int as label from events)"


def predicted(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.crossJoin(F.broadcast(e.agg(F.max("value").alias("m")))).select((F.col("value") > 0.5 * F.col("m")).cast("int").alias("pred"), (F.col("event_type") == "purchase").cast("int").alias("label"))


@query(f"""with c as (select sum(pred * label)::double as tp, sum(pred * (1 - label))::double as fp, sum((1 - pred) * label)::double as fn, count(*)::double as n from {PRED})
    select round((n - fp - fn) / n, 9) as accuracy, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 9) as "precision", round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 9) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 9) as f1 from c""")
def classification_metrics(spark, sf_dir):
    out = metrics.classification(predicted(spark, sf_dir))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(f"""with k as (select unnest([0, 1, 2]) as c), f as (select c, (select count(*) from {PRED} where pred = c and label = c) as tp, (select count(*) from {PRED} where pred = c) + (select count(*) from {PRED} where label = c) as n from k)
    select round(avg(case when n > 0 then 2.0::double * tp / n else 0 end), 9) as macro_f1 from f""")
def macro_f1(spark, sf_dir):
    return metrics.macro_f1(predicted(spark, sf_dir), classes=3).select(F.round("macro_f1", 9).alias("macro_f1"))


@query("""with p as (select l_extendedprice as y, l_quantity * 1500.0 as f from lineitem) select round(avg(abs(f - y)), 6) as mae, round(avg((f - y) * (f - y)), 3) as mse, round(sqrt(avg((f - y) * (f - y))), 6) as rmse,
    round(1 - avg((f - y) * (f - y)) / var_pop(y), 8) as r2, round(avg(abs((f - y) / y)) filter (where abs(y) > 1e-8), 8) as mape from p""")
def regression_metrics(spark, sf_dir):
    p = t(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500.0).alias("pred"))
    digits = {"mae": 6, "mse": 3, "rmse": 6, "r2": 8, "mape": 8}
    return metrics.regression(p).select(*[F.round(c, d).alias(c) for c, d in digits.items()])


@query(f"select round(avg((score / m - label) * (score / m - label)), 8) as brier, round(avg(case when score / m > 0.5 then 1.0 else 0.0 end), 8) as positive_rate from {SCORED}, (select max(value) as m from events)")
def brier(spark, sf_dir):
    s = scored(spark, sf_dir)
    s = s.crossJoin(F.broadcast(s.agg(F.max("score").alias("m")))).withColumn("score", F.col("score") / F.col("m"))
    out = metrics.brier(s)
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


@query(f"""with r as (select user_id as q, label, event_id, row_number() over (partition by user_id order by score desc, event_id) as k, row_number() over (partition by user_id order by label desc, event_id) as ik from {SCORED}),
    h as (select *, sum(label) over (partition by q order by k rows unbounded preceding) as hits from r),
    p as (select q, sum(case when k <= 10 then label * hits::double / k else 0 end) as ap, sum(label) as nr, count(*) as n, min(case when label = 1 then k end) as first, sum(case when k <= 10 then label else 0 end) as hit,
      sum(case when k <= 10 then label / log2(k + 1) else 0 end) as dcg, sum(case when ik <= 10 then label / log2(ik + 1) else 0 end) as idcg from h group by q)
    select round(avg(case when nr > 0 then ap / least(nr, 10) else 0 end), 8) as map_at_k, round(avg(coalesce(1.0::double / first, 0)), 8) as mrr, round(avg(case when idcg > 0 then dcg / idcg else 0 end), 8) as ndcg_at_k,
      round(avg(case when nr > 0 then hit::double / nr else 0 end), 8) as recall_at_k, round(avg(hit::double / least(n, 10)), 8) as precision_at_k, round(avg(case when hit > 0 then 1.0 else 0.0 end), 8) as hits_at_k from p""")
def ranking_metrics(spark, sf_dir):
    out = metrics.ranking(scored(spark, sf_dir), 10, "user_id", "event_id", "score", "label")
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


@query("""with r as (select value as x, row_number() over (order by value) - 1 as i, count(*) over () - 1 as l from events)
    select count(*) as n, round(avg(x), 6) as mean, min(x) as min, max(x) as max, round(stddev_pop(x), 6) as std, max(case when i = floor(l * 0.5::double) then x end) as p50, max(case when i = floor(l * 0.9::double) then x end) as p90,
    max(case when i = floor(l * 0.95::double) then x end) as p95, max(case when i = floor(l * 0.99::double) then x end) as p99 from r""")
def summary_percentiles(spark, sf_dir):
    return metrics.summary(t(spark, sf_dir, "events")).select("n", F.round("mean", 6).alias("mean"), "min", "max", F.round("std", 6).alias("std"), "p50", "p90", "p95", "p99")


@query(f"select round(avg(greatest(score / 100, 0) - score / 100 * label + ln(1 + exp(-abs(score / 100)))), 8) as bce from {SCORED}")
def bce_loss(spark, sf_dir):
    return scored(spark, sf_dir).agg(F.round(F.avg(scalars.bce_with_logits(F.col("score") / 100, F.col("label"))), 8).alias("bce"))


# ---------------------------------------------------------------------------------------------- validation and codecs

TABLES = {"nation": ("n_regionkey", "region", "r_regionkey"), "customer": ("c_nationkey", "nation", "n_nationkey"), "orders": ("o_custkey", "customer", "c_custkey"), "lineitem": ("l_orderkey", "orders", "o_orderkey")}


@query(" union all ".join(f"select '{n}' as \"table\", '{c}' as \"column\", '{g}' as target, count(*) as rows, count(*) filter (where {c} is not null and {c} not in (select {k} from {g})) as orphans from {n}" for n, (c, g, k) in TABLES.items()))
def foreign_key_report(spark, sf_dir):
    names = {*TABLES, *(x[1] for x in TABLES.values())}
    return validation.foreign_key_report({n: t(spark, sf_dir, n) for n in names}, [(n, c, g, k) for n, (c, g, k) in TABLES.items()])


@query("select l_orderkey as order_key, l_partkey as part_key from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'F')")
def orphans(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey"), "l_partkey")
    open_ = t(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    return graph.orphans(li, "l_orderkey", open_, "o_orderkey").select(F.col("l_orderkey").alias("order_key"), F.col("l_partkey").alias("part_key"))


@query(r"""select 'events' as "table", r[1] as "column", r[2] as rule, n as rows, v as violations from (select count(*) as n, count(*) filter (where event_type is null or event_type in ('', 'null', 'NULL')) as v0,
    count(*) - count(distinct user_id) - max(case when user_id is null then 1 else 0 end) as v1, count(*) filter (where value <= 0) as v2, count(*) filter (where not (value between 0 and 50)) as v3, count(*) filter (where not regexp_matches(event_type, '^[a-m]')) as v4,
    count(*) filter (where not json_valid(props)) as v5, count(*) filter (where not (value < 90)) as v6 from events),
    unnest([[['event_type', 'not_null'], [v0::varchar]], [['user_id', 'unique'], [v1::varchar]], [['value', 'positive'], [v2::varchar]], [['value', 'range'], [v3::varchar]], [['event_type', 'pattern'], [v4::varchar]], [['props', 'json'], [v5::varchar]], [['below_90', 'custom'], [v6::varchar]]]) as x(y), lateral (select y[1] as r, y[2][1]::bigint as v)""")
def validation_report(spark, sf_dir):
    rules = [("event_type", "not_null"), ("user_id", "unique"), ("value", "positive"), ("value", "range", 0, 50), ("event_type", "pattern", "^[a-m]"), ("props", "json"), ("below_90", "custom", F.col("value") < 90)]
    return validation.validate(t(spark, sf_dir, "events"), "events", rules)


@query("select event_id, user_id, event_id - coalesce(lag(event_id) over (partition by user_id order by event_id), 0) as delta from events")
def delta_encode(spark, sf_dir):
    return codecs.delta_encode(t(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id", "event_id")


@query("select event_id, user_id, event_id as value from events")
def delta_round_trip(spark, sf_dir):
    enc = codecs.delta_encode(t(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id", "event_id")
    return codecs.delta_decode(enc, "user_id", "event_id").select("event_id", "user_id", "value")


RUNS = """(select user_id, event_type, sum(new) over (partition by user_id order by event_id) as run from (select *, case when event_type is distinct from lag(event_type) over w or row_number() over w = 1 then 1 else 0 end as new
    from events window w as (partition by user_id order by event_id)))"""


@query(f"select user_id, run::bigint as run, any_value(event_type) as value, count(*) as length from {RUNS} group by 1, 2")
def run_length_encode(spark, sf_dir):
    return codecs.run_length_encode(t(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("user_id", "run", "value", "length")


@query("select user_id, event_type as value, count(*) as n from events group by 1, 2")
def run_length_round_trip(spark, sf_dir):
    runs = codecs.run_length_encode(t(spark, sf_dir, "events"), "user_id", "event_id", "event_type")
    return codecs.run_length_decode(runs, "user_id").groupBy("user_id", "value").agg(F.count("*").alias("n"))


@query("with m as (select min(value) as a, max(value) as b from events) select event_id, least(floor((value - a) * 256.0 / (b - a)), 255)::int as code from events, m")
def quantise(spark, sf_dir):
    return codecs.quantise(t(spark, sf_dir, "events"), "value", 8).select("event_id", "code")


# ---------------------------------------------------------------------------------------------- analytics


def _pagerank_sql(rounds: int) -> str:
    steps = ["r0 as (select id, 1.0::double / (select count(*) from v) as r from v)", "o as (select src as id, count(*) as d from e group by 1)"]
    for i in range(rounds):
        steps.append(
            f"r{i + 1} as (select v.id, (0.15 / (select count(*) from v)) + 0.85 * (coalesce(s, 0) + (select coalesce(sum(r), 0) from r{i} where id not in (select id from o)) / (select count(*) from v)) as r "
            f"from v left join (select dst as id, sum(r / d) as s from e join r{i} on r{i}.id = src join o on o.id = src group by 1) x using (id))"
        )
    return f"with {SMALL}, {', '.join(steps)} select id, round(r, 9) as rank from r{rounds}"


@query(_pagerank_sql(5))
def pagerank(spark, sf_dir):
    return analytics.pagerank(*small_graph(spark, sf_dir), rounds=5).select("id", F.round("rank", 9).alias("rank"))


@query()
def eigenvector_centrality(spark, sf_dir):
    return analytics.eigenvector_centrality(*small_graph(spark, sf_dir), rounds=5)


@query(f"with {SMALL} select id, coalesce(d, 0) / ((select count(*) from v) - 1)::double as centrality from v left join (select src as id, count(*) as d from u group by 1) using (id)")
def degree_centrality(spark, sf_dir):
    return analytics.degree_centrality(*small_graph(spark, sf_dir))


TRIANGLES = "p as (select distinct least(src, dst) as a, greatest(src, dst) as b from e), tri as (select x.a as a, x.b as b, y.b as c from p x join p y on y.a = x.b join p z on z.a = x.a and z.b = y.b), tc as (select id, count(*) as n from (select unnest([a, b, c]) as id from tri) group by 1)"


@query(f"with {SMALL}, {TRIANGLES} select id, n as triangles from tc")
def triangles(spark, sf_dir):
    return analytics.triangles(small_graph(spark, sf_dir)[1])


@query(f"""with {SMALL}, {TRIANGLES}, d as (select id, count(*) as d from (select unnest([a, b]) as id from p) group by 1)
    select id, round(case when d >= 2 then 2.0::double * coalesce(n, 0) / (d * (d - 1)) else 0 end, 9) as coefficient from v left join d using (id) left join tc using (id)""")
def clustering_coefficient(spark, sf_dir):
    return analytics.clustering_coefficient(*small_graph(spark, sf_dir)).select("id", F.round("coefficient", 9).alias("coefficient"))


@query()
def components_reached(spark, sf_dir):
    return analytics.components(*small_graph(spark, sf_dir)).select("id", "component")


@query()
def components(spark, sf_dir):
    return analytics.components(*small_graph(spark, sf_dir))


@query()
def is_connected(spark, sf_dir):
    return analytics.is_connected(*small_graph(spark, sf_dir))


def smallest_of_nations(spark, sf_dir):
    return t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("id")).select("id")


@query()
def bfs_levels(spark, sf_dir):
    """Hops to the nearest of the nations' first customers."""
    found = paths.nearest_source(small_graph(spark, sf_dir)[1], smallest_of_nations(spark, sf_dir))
    return found.select("id", F.col("distance").cast("int").alias("level"))


@query()
def shortest_paths(spark, sf_dir):
    """Distance to the nearest of the nations' first customers."""
    return paths.nearest_source(small_graph(spark, sf_dir)[1], smallest_of_nations(spark, sf_dir), "weight")


@query()
def closeness(spark, sf_dir):
    v, e = small_graph(spark, sf_dir)
    return analytics.closeness(v, e)


@query()
def betweenness(spark, sf_dir):
    return analytics.betweenness(*small_graph(spark, sf_dir))


def _lpa_sql(rounds: int) -> str:
    steps = ["l0 as (select id, id as label from v)"]
    for i in range(rounds):
        steps.append(f"l{i + 1} as (select v.id, coalesce(b, l.label) as label from v join l{i} l using (id) left join (select id, arg_min(label, {{'a': -n, 'b': label}}) as b from (select dst as id, label, count(*) as n from u join l{i} x on x.id = src group by 1, 2) group by 1) using (id))")
    return f"with {SMALL}, {', '.join(steps)}"


@query(f"{_lpa_sql(3)} select id, label from l3")
def label_propagation(spark, sf_dir):
    return analytics.label_propagation(*small_graph(spark, sf_dir), rounds=3)


def nation_communities(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 7).alias("label"))


@query(f"with {SMALL} select least(src % 7, dst % 7) as a, greatest(src % 7, dst % 7) as b, count(*) as n_edges from e group by 1, 2")
def community_rollup(spark, sf_dir):
    return analytics.community_rollup(nation_communities(spark, sf_dir), small_graph(spark, sf_dir)[1])


@query(f"""with {SMALL}, m as (select count(*)::double as m from e), s as (select c, sum(i) as e, count(*) as d from (select src % 7 as c, (src % 7 = dst % 7)::int as i from e union all select dst % 7, 0 from e) group by 1)
    select round(sum(e / m - power(d / (2 * m), 2)), 9) as modularity from s, m""")
def modularity(spark, sf_dir):
    return analytics.modularity(nation_communities(spark, sf_dir), small_graph(spark, sf_dir)[1]).select(F.round("modularity", 9).alias("modularity"))


@query()
def cycle_vertices(spark, sf_dir):
    e = small_graph(spark, sf_dir)[1].select("src", "dst")
    return analytics.cycle_vertices(e.unionByName(e.where("src % 11 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))))


@query()
def greedy_colouring(spark, sf_dir):
    return analytics.greedy_colouring(*small_graph(spark, sf_dir))


@query(f"""with {SMALL}, {TRIANGLES}, d as (select id, count(*) as d from (select unnest([a, b]) as id from p) group by 1), c as (select (select count(*) from v)::bigint as n, (select count(*) from e)::bigint as m)
    select n, m, 2.0::double * m / (n::double * (n - 1)) as density, 2.0::double * m / n as avg_degree, round((select avg(case when d >= 2 then 2.0::double * coalesce(t.n, 0) / (d * (d - 1)) else 0 end) from v left join d using (id) left join tc t using (id)), 9) as avg_clustering from c""")
def graph_statistics(spark, sf_dir):
    out = analytics.graph_statistics(*small_graph(spark, sf_dir))
    return out.select("n", "m", "density", "avg_degree", F.round("avg_clustering", 9).alias("avg_clustering"))


# ---------------------------------------------------------------------------------------------- sampling


@query(f"""with p as (select distinct dst as src, src as dst from {ORDER_EDGES}), h1 as (select src, dst, row_number() over (partition by dst order by md5(src || ':' || dst || ':5:1'), src) as k from p)
    select 1 as hop, src, dst from h1 where k <= 3""")
def neighbour_sample(spark, sf_dir):
    e = order_edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "etime")
    seeds = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"))
    return sampling.neighbour_sample(e, seeds, [3], seed=5)


@query(f"""with p as (select dst as src, src as dst, max(etime) as etime from {ORDER_EDGES} where etime <= {SEED_SECONDS} group by 1, 2), h as (select src, dst, row_number() over (partition by dst order by etime desc, md5(src || ':' || dst || ':0:1'), src) as k from p)
    select 1 as hop, src, dst from h where k <= 2""")
def recent_neighbours(spark, sf_dir):
    e = order_edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "etime")
    seeds = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"))
    return sampling.neighbour_sample(e, seeds, [2], seed_time=SEED_SECONDS, recent_first=True)


@query()
def random_walks(spark, sf_dir):
    v, e = small_graph(spark, sf_dir)
    both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return sampling.random_walks(both, v.select(F.col("id").alias("walk"), F.col("id").alias("node")), 4, p=2.0, q=0.5)


@query(f"""with {SMALL}, d as (select id, coalesce(d, 0) as d from v left join (select src as id, count(*) as d from u group by 1) using (id)), lo as (select o_custkey as id, max(epoch(o_orderdate)::double) as t from orders group by 1)
    select id, d::bigint as degree, round(0.4 * d / ((select count(*) from v) - 1) + 0.3 * (case when t is null then 0.5 else exp(-greatest(1000000000.0 - t, 0) / (86400.0 * 365.0)) end) + 0.3 * d / (select max(d) from d), 8) as importance from d left join lo using (id)""")
def importance(spark, sf_dir):
    v, e = small_graph(spark, sf_dir)
    last = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max(scalars.seconds(F.col("o_orderdate"))).alias("_t"))
    nodes = v.join(last, "id", "left").select(F.col("id").alias("node_id"), F.coalesce("_t", F.lit(scalars.NEVER)).alias("time"))
    out = sampling.importance(nodes, e, 1_000_000_000.0, 365.0)
    return out.select(F.col("node_id").alias("id"), F.col("degree").cast("long").alias("degree"), F.round("importance", 8).alias("importance"))


# ---------------------------------------------------------------------------------------------- streaming, learning


@query("select date_trunc('day', ts) as start, event_type, count(*) as n, sum(value::decimal(18,6))::double as total from events group by 1, 2")
def stream_windowed_counts(spark, sf_dir):
    scratch = Scratch(spark)
    target = f"{scratch.root}/stream"
    streams.run_available(streams.windowed_counts(streams.read_events(spark, sf_dir, "events.parquet")), target, f"{scratch.root}/stream-state", "complete")
    return spark.read.parquet(target).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select user_id as src, event_type as dst, count(*) as n, max(epoch(date_trunc('second', ts)))::double as last from events group by 1, 2")
def stream_edges(spark, sf_dir):
    scratch = Scratch(spark)
    target = f"{scratch.root}/edges"
    streams.run_available(streams.edge_stream(streams.read_events(spark, sf_dir, "events.parquet")), target, f"{scratch.root}/edges-state")
    return spark.read.parquet(target).groupBy("src", "dst").agg(F.count("*").alias("n"), F.max("etime").alias("last"))


@query()
def churn_experiment(spark, sf_dir):
    from relmill.plans.experiment import multi_seed, propagated

    o = t(spark, sf_dir, "orders")
    past = o.where(F.col("o_orderdate") <= F.lit(SEED).cast("timestamp_ntz"))
    own = past.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"), F.max(scalars.seconds(F.col("o_orderdate"))).alias("last"))
    c = t(spark, sf_dir, "customer").join(own, "c_custkey", "left")
    x = F.array(F.col("c_acctbal") / 1e4, F.coalesce("n", F.lit(0)) / 10.0, F.coalesce("s", F.lit(0.0)) / 1e6, (F.lit(SEED_SECONDS) - F.coalesce("last", F.lit(0.0))) / 1e8)
    f = c.select(F.col("c_custkey").alias("node_id"), x.alias("x"))
    e = small_graph(spark, sf_dir)[1].select("src", "dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    labels = task_labels(spark, sf_dir).select(F.col("customer").alias("node_id"), F.col("churn").alias("label"))
    return multi_seed(propagated(both, f, 1), labels, "binary", (0, 1))
