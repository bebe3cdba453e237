"""Registered queries of formats, checks, logs, seeds and windows, with their SQL; and SQL of queries that had none."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from relmill.functions import metrics
from relmill.functions.scalars import learning_rate
from relmill.operators import analytics, graph, paths, sampling, tasks, validation
from relmill.plans import training
from relmill.plans.catalog import NODES, SEED_SECONDS, SMALL, SPLIT, _graph, database, query, scored, small_graph, smallest_of_nations, t
from relmill.plans.learned import QUERIES, SQL
from relmill.sources import tables as sources
from relmill.staging import Scratch
from relmill.streaming import events as streams

__all__ = ["QUERIES", "SQL"]


# ---------------------------------------------------------------------------------------------- sources


def _shop_folder(spark, sf_dir, scratch) -> str:
    """Customers and orders as CSV files with a schema, keys in order."""
    folder = f"{scratch.root}/csv"
    columns = {"customer": ["c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey"], "orders": ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]}
    for name, cols in columns.items():
        t(spark, sf_dir, name).select(cols).repartitionByRange(cols[0]).sortWithinPartitions(cols[0]).write.option("header", True).csv(f"{folder}/{name}.csv")
    column = lambda name, role: {"name": name, "role": role}
    spec = [
        {"name": "customer", "columns": [column("c_custkey", "PrimaryKey"), column("c_acctbal", "Numerical"), column("c_mktsegment", "Categorical"), column("c_nationkey", "Label")]},
        {"name": "orders", "time_column": "o_orderdate", "columns": [column("o_orderkey", "PrimaryKey"), column("o_custkey", {"ForeignKey": "customer"}), column("o_totalprice", "Numerical"), column("o_orderdate", "Timestamp")]},
    ]
    sources.write_text(spark, f"{folder}/schema.json", json.dumps({"tables": spec, "seed_table": "customer"}))
    return folder


_ROWS = "(select c_custkey, row_number() over (order by c_custkey) - 1 as r from customer)"


@query(f"select row_number() over (order by o_orderkey) - 1 as _row, r as o_custkey, o_totalprice::float::double as o_totalprice, epoch(o_orderdate)::double as _time from orders join {_ROWS} c on c.c_custkey = o_custkey")
def csv_round_trip(spark, sf_dir):
    """Orders after reading CSV files, writing them again and reading those: keys and references are row numbers."""
    scratch = Scratch(spark)
    db, spec, labels = sources.load_csv(spark, _shop_folder(spark, sf_dir, scratch))
    sources.save_csv(db, spec, f"{scratch.root}/again", labels)
    again = sources.load_csv(spark, f"{scratch.root}/again")[0].tables["orders"]
    return again.select("_row", F.col("o_custkey").cast("long").alias("o_custkey"), F.col("o_totalprice").cast("double").alias("o_totalprice"), "_time")


@query(f"select r as _row, c_nationkey::double as c_nationkey from customer join {_ROWS} using (c_custkey)")
def seed_labels(spark, sf_dir):
    """The label column of the seed table of a CSV database."""
    labels = sources.load_csv(spark, _shop_folder(spark, sf_dir, Scratch(spark)))[2]
    return labels.select("_row", F.col("c_nationkey").cast("double").alias("c_nationkey"))


@query("select vec_id, embedding[1]::double as first, len(embedding)::int as size from embeddings")
def typed_embeddings(spark, sf_dir):
    """Vectors by way of a file named for their node type."""
    folder = Scratch(spark).root
    t(spark, sf_dir, "embeddings").write.parquet(f"{folder}/emb_item.parquet")
    return sources.load_embeddings(spark, folder, "item").select("vec_id", F.col("embedding")[0].alias("first"), F.size("embedding").alias("size"))


# ---------------------------------------------------------------------------------------------- graphs


@query(f"with {NODES} select node_id, row from nodes where tab = 'customer'")
def seed_nodes(spark, sf_dir):
    return graph.seed_nodes(_graph(spark, sf_dir)[0], "customer").select("node_id", "row")


YEAR = (SEED_SECONDS - 366 * 86400, SEED_SECONDS)
_WINDOW = f"""{NODES}, win as (select * from edges where etime between {YEAR[0]} and {YEAR[1]} or etime = '-inf'::double),
    h0 as (select node_id from nodes join customer on tab = 'customer' and k = c_custkey where c_mktsegment = 'BUILDING'),
    h1 as (select distinct src as node_id from win where dst in (select node_id from h0) and src not in (select node_id from h0)),
    h2 as (select distinct src as node_id from win where dst in (select node_id from h1) and src not in (select node_id from h0) and src not in (select node_id from h1)),
    found as (select node_id, 0 as hop from h0 union all select node_id, 1 from h1 union all select node_id, 2 from h2)"""


def _window(spark, sf_dir):
    """Around the customers of one market segment, orders of the year before the seed time."""
    nodes, edges = _graph(spark, sf_dir)
    building = t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("key"))
    seeds = graph.seed_nodes(nodes, "customer").join(building, "key").select("node_id")
    return sampling.window_subgraph(edges, seeds, *YEAR, hops=2)


@query(f"with {_WINDOW} select node_id, hop from found")
def window_nodes(spark, sf_dir):
    return _window(spark, sf_dir)[0]


@query(f"with {_WINDOW} select src, dst, etype, etime from win where src in (select node_id from found) and dst in (select node_id from found)")
def window_edges(spark, sf_dir):
    return _window(spark, sf_dir)[1]


DIRECTED = SMALL.replace("u as (select src, dst from e union all select dst, src from e)", "u as (select src, dst from e)")


@query(SQL["betweenness"].replace(SMALL, DIRECTED))
def betweenness_directed(spark, sf_dir):
    return analytics.betweenness(*small_graph(spark, sf_dir), directed=True).select("id", F.round("betweenness", 12).alias("betweenness"))


def _eigen(rounds: int) -> str:
    steps = ["s0 as (select id, 1.0::double as s from v)"]
    for i in range(rounds):
        steps.append(f"t{i} as (select v.id, coalesce(x, 0) as s from v left join (select dst as id, sum(s) as x from e join s{i} on s{i}.id = src group by 1) using (id))")
        steps.append(f"s{i + 1} as materialized (select id, case when (select sum(s) from t{i}) > 0 then s / (select sum(s) from t{i}) else s end as s from t{i})")
    return f"with {SMALL}, {', '.join(steps)} select id, round(s, 9) as score from s{rounds}"


@query(_eigen(5))
def eigenvector_centrality(spark, sf_dir):
    return analytics.eigenvector_centrality(*small_graph(spark, sf_dir), rounds=5).select("id", F.round("score", 9).alias("score"))


SQL["greedy_colouring"] = f"""with recursive {SMALL}, o as (select id, row_number() over (order by id) as k from v),
    before as (select y.k, list(distinct x.k) as bs from u join o x on x.id = src join o y on y.id = dst where x.k < y.k group by y.k),
    nb as (select o.k, o.id, coalesce(bs, []) as bs from o left join before using (k)),
    walk as (select 0::bigint as k, []::int[] as c union all
        select nb.k, list_append(c, list_min(list_filter(range(len(bs) + 1), lambda f: not list_contains(list_transform(bs, lambda b: c[b]), f)))::int) from walk join nb on nb.k = walk.k + 1)
    select id, c[k] as colour from nb, (select c from walk where k = (select count(*) from v))"""


def _walks(length: int, p: float, q: float) -> str:
    steps = ["w as (select distinct src, dst from u)", "s0 as (select id as walk, null::bigint as prev, id::bigint as node from v)"]
    for i in range(1, length + 1):
        u = f"(('0x' || md5(s.walk || ':' || w.dst || ':0:{i}')[1:7])::bigint + 0.5::double) / 268435456"
        weight = f"case when s.prev is null then 1 when w.dst = s.prev then {1 / p}::double when k.src is not null then 1 else {1 / q}::double end"
        steps.append(f"s{i} as materialized (select walk, node as prev, arg_min(w.dst, row(-ln({u}) / ({weight}), w.dst))::bigint as node from (select s.walk, s.node, s.prev from s{i - 1} s) s join w on w.src = s.node left join w k on k.src = s.prev and k.dst = w.dst group by walk, s.node)")
    return f"with {SMALL}, {', '.join(steps)} " + " union all ".join(f"select walk, {i} as step, node from s{i}" for i in range(length + 1))


SQL["random_walks"] = _walks(4, 2.0, 0.5)


# ---------------------------------------------------------------------------------------------- checks and measures


@query("""select 'events' as "table", c as "column", r as rule, (select count(*) from events) as rows, n as violations from (values
    ('props', 'json', (select count(*) from events where event_id % 5 = 0)), ('value', 'range', (select count(*) from events where not value between 1 and 50)),
    ('event_type', 'pattern', (select count(*) from events where not regexp_matches(event_type, '^(click|view)$'))), ('user_id', 'unique', (select count(*) - count(distinct user_id) from events)),
    ('busy', 'custom', (select count(*) from events where not (value > 10 or event_type = 'purchase')))) x(c, r, n)""")
def custom_rules(spark, sf_dir):
    """Rules with arguments, a rule of one's own, and JSON that is broken in every fifth row."""
    e = t(spark, sf_dir, "events").withColumn("props", F.when(F.col("event_id") % 5 == 0, '{"k": ').otherwise(F.col("props")))
    return validation.validate(e, "events", [("props", "json"), ("value", "range", 1, 50), ("event_type", "pattern", "^(click|view)$"), ("user_id", "unique"), ("busy", "custom", (F.col("value") > 10) | (F.col("event_type") == "purchase"))])


@query(f"select * from ({SQL['roc_auc']}), ({SQL['average_precision']})")
def evaluated(spark, sf_dir):
    """Several measures by name, side by side."""
    out = metrics.evaluate(scored(spark, sf_dir), ["roc_auc", "average_precision"], score="score", label="label")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


def _split(seed: int) -> str:
    return SPLIT.replace(", 7)", f", {seed})")


@query("with m as (" + " union all ".join(f"select avg(c_acctbal) as m from customer where {_split(s)} >= 0.8" for s in range(3)) + ") select count(*) as runs, round(avg(m), 6) as mean_mean, round(stddev_pop(m), 6) as mean_std from m")
def over_seeds(spark, sf_dir):
    """Mean and deviation over seeds of a measure of the test rows."""
    c, out = t(spark, sf_dir, "customer"), None
    for seed in range(3):
        part = tasks.hash_split(c, "c_custkey", seed).where("split = 'test'").agg(F.avg("c_acctbal").alias("mean"))
        out = part if out is None else out.unionByName(part)
    return metrics.over_seeds(out, ["mean"]).select("runs", F.round("mean_mean", 6).alias("mean_mean"), F.round("mean_std", 6).alias("mean_std"))


EPOCHS, RATE = 4, 0.1


def _head_sql() -> str:
    """Epochs of a linear head, one after the other: errors, clipped gradients, AdamW."""
    parts = [
        f"r as materialized (select c_acctbal::double / 10000 as x0, c_nationkey::double / 25 as x1, n / 10.0::double as y, case when {SPLIT} < 0.6 then 'train' when {SPLIT} < 0.8 then 'valid' end as split from customer join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey)",
        "w0 as (select " + ", ".join(f"0.0::double as {c}{i}" for c in "wmv" for i in range(3)) + ")",
    ]
    rows = []
    for e in range(EPOCHS):
        rate = learning_rate(e, RATE, "warmup_cosine", EPOCHS, 3)
        parts.append(f"a{e} as (select avg(d * d) as loss, avg(d * x0) as g0, avg(d * x1) as g1, avg(d) as g2 from (select x0, x1, x0 * w0 + x1 * w1 + w2 - y as d from r, w{e} where split = 'train'))")
        parts.append(f"c{e} as (select *, sqrt(g0 * g0 + g1 * g1 + g2 * g2) as norm from a{e})")
        parts.append(f"g{e} as (select loss, norm, " + ", ".join(f"g{i} * least(1.0::double, 5 / norm) as g{i}" for i in range(3)) + f" from c{e})")
        parts.append(f"s{e} as (select w0, w1, w2, " + ", ".join(f"0.9::double * m{i} + 0.1::double * g{i} as m{i}, 0.999::double * v{i} + 0.001::double * g{i} * g{i} as v{i}" for i in range(3)) + f" from w{e}, g{e})")
        move = lambda i: f"m{i} / {1 - 0.9 ** (e + 1)!r}::double / (sqrt(v{i} / {1 - 0.999 ** (e + 1)!r}::double) + 1e-8::double)"  # noqa: E731, B023
        parts.append(f"w{e + 1} as (select " + ", ".join(f"w{i} - {rate!r}::double * ({move(i)}{f' + 1e-4::double * w{i}' if i < 2 else ''}) as w{i}" for i in range(3)) + ", " + ", ".join(f"{c}{i}" for c in "mv" for i in range(3)) + f" from s{e})")
        parts.append(f"v{e} as (select -avg(abs(x0 * w0 + x1 * w1 + w2 - y)) as valid from r, w{e + 1} where split = 'valid')")
        rows.append(f"select {e} as epoch, loss, valid, {rate!r}::double as rate, norm as gradient from g{e}, v{e}")
    return f"with {', '.join(parts)}, log as ({' union all '.join(rows)}) select epoch::int as epoch, round(loss, 8) as loss, round(valid, 8) as valid, round(rate, 8) as rate, round(gradient, 8) as gradient, round(max(valid) over (order by epoch), 8) as best from log"


@query(_head_sql())
def head_training_log(spark, sf_dir):
    """The epoch log of a linear head that learns the number of a customer's orders, with the best value so far, read
    again from the file that it was saved to."""
    c = t(spark, sf_dir, "customer")
    n = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count("*") / F.lit(10.0)).alias("label"))
    rows = tasks.hash_split(c.join(n, "c_custkey"), "c_custkey", 7)
    rows = rows.select("split", F.array(F.col("c_acctbal").cast("double") / 10000, F.col("c_nationkey") / F.lit(25.0)).alias("x"), "label")
    head = training.fit(rows, task="regression", epochs=EPOCHS, rate=RATE)
    path = f"{Scratch(spark).root}/head.json"
    head.save(spark, path)
    log = training.log_table(spark, training.Head.load(spark, path))
    return log.select("epoch", *[F.round(c, 8).alias(c) for c in ("loss", "valid", "rate", "gradient", "best")])


@query("select user_id, upper(event_type) as kind, round(value * 2, 6) as twice from events")
def stream_mapped(spark, sf_dir):
    """A function of each micro-batch, written once."""
    scratch = Scratch(spark)
    target = f"{scratch.root}/mapped"
    each = lambda b: b.select("user_id", F.upper("event_type").alias("kind"), F.round(F.col("value") * 2, 6).alias("twice"))
    streams.run_available(streams.read_events(spark, sf_dir, "events.parquet"), target, f"{scratch.root}/mapped-state", each=each)
    return spark.read.parquet(target)


_U = "(('0x' || md5(vec_id || ':' || {0} || ':9')[{1}])::bigint + 0.5::double) / 268435456"


def _noise(i: int) -> str:
    return f"round(embedding[{i + 1}]::double + 0.1::double * sqrt(-2 * ln({_U.format(i, '1:7')})) * cos(6.283185307179586::double * {_U.format(i, '8:14')}), 6) + 0.0 as x{i}"


@query(f"select vec_id, {_noise(0)}, {_noise(63)} from embeddings")
def feature_noise(spark, sf_dir):
    """Vectors with normal noise that a rerun repeats."""
    v = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("x"))
    out = tasks.noisy(v, 0.1, 9)
    return out.select(F.col("node_id").alias("vec_id"), *[(F.round(F.col("x")[i], 6) + 0.0).alias(f"x{i}") for i in (0, 63)])


@query(f"""{SQL["distances_from_nations"].replace(" select a as source", ", f as (select a as source", 1)}),
    p as (select f.source, f.id, f.distance, min(g.src) as pred from f join g on g.dst = f.id join f b on b.source = f.source and b.id = g.src and b.distance + g.w = f.distance where f.id <> f.source group by 1, 2, 3),
    walk as (select source, source as id, source::varchar as path from f where id = source union all select p.source, p.id, walk.path || ',' || p.id from p join walk on walk.source = p.source and walk.id = p.pred)
    select source, id as target, path from walk""".replace("with ", "with recursive ", 1))
def weighted_paths(spark, sf_dir):
    """The least paths from the nations' first customers, vertex by vertex, ties to the smaller vertex."""
    e = small_graph(spark, sf_dir)[1]
    found = Scratch(spark).store(paths.predecessors(analytics.shortest_paths(e, smallest_of_nations(spark, sf_dir)), e), "found")
    return paths.paths(found).select("source", "target", F.array_join("path", ",").alias("path"))


@query("""select * from (values ('nation', 0, 'n_nationkey', 'int', true, null, false), ('nation', 1, 'n_name', 'string', false, null, false), ('nation', 2, 'n_regionkey', 'int', false, 'region', false),
    ('region', 0, 'r_regionkey', 'int', true, null, false), ('region', 1, 'r_name', 'string', false, null, false)) x("table", position, "column", type, is_key, target, is_time)""")
def database_schema(spark, sf_dir):
    """Columns of a database with keys, targets and times."""
    db = database(spark, sf_dir)
    return sources.schema_of(db).where(F.col("table").isin("nation", "region"))
