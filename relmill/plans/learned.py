"""Registered queries of what is learned and discovered, with their SQL: gradients, as-of features, keys, walks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from relmill.operators import analytics, colouring, cycles, discovery, paths, quantiser, sketches, tasks, walks
from relmill.operators.asof import asof_join
from relmill.plans import gnn
from relmill.plans.catalog import HORIZON, ORDER_EDGES, SEED, SEED_SECONDS, SMALL, SPLIT, order_edges, query, small_graph, t
from relmill.plans.extended import QUERIES, SQL, both_ways
from relmill.staging import Scratch
from relmill.streaming import events as streams
from relmill.streaming import state

__all__ = ["QUERIES", "SQL"]


# ---------------------------------------------------------------------------------------------- gradients
# One step on the graph of customers and parts with two features, two hidden dimensions and one layer.

DIM = 2
#: Relation 0 runs from a customer to a part, relation 1 back; only orders known at the seed time are edges.
SHOP = f"""o as (select * from {ORDER_EDGES} where etime <= {SEED_SECONDS}),
    e0 as (select src, dst, 0 as etype from o union all select dst, src, 1 from o),
    e as (select *, 1.0::double / count(*) over (partition by dst, etype) as w from e0),
    x as (select c_custkey::bigint as id, c_acctbal::double / 10000 as x0, 1.0::double as x1 from customer union all select p_partkey + 1000000000, p_size / 50.0::double, p_retailprice::double / 2000 from part),
    y as (select c_custkey as id, case when count(o_orderkey) = 0 then 1.0::double else 0.0::double end as y from customer left join orders on o_custkey = c_custkey
        and o_orderdate > timestamp '{SEED}' and o_orderdate <= timestamp '{SEED}' + interval '{HORIZON} days' group by c_custkey),
    t as (select c_custkey as id, y, 1.0::double / count(*) over () as share from customer join y on id = c_custkey where {SPLIT} < 0.6)"""


def stated_weights(net: gnn.Network) -> gnn.Network:
    """Weights by a rule, so that the SQL can hold the same."""
    for k, name in enumerate(sorted(net.weights)):
        i, j = np.indices(net.weights[name].shape)
        net.weights[name] = ((3 * i + 2 * j + k) % 7 - 2.5) / 8
    return net


def _affine(parts: list[str], w: np.ndarray, j: int) -> str:
    """A linear form of columns; one more row of weights is the bias."""
    out = [f"{x} * {w[i, j]}::double" for i, x in enumerate(parts)]
    return " + ".join([*out, *([f"{w[len(parts), j]}::double"] if len(w) > len(parts) else [])])


def _rows(name: str, table: str, values: list[str]) -> list[str]:
    return [f"select '{name}' as name, {i} as pos, sum({v}) as v from {table}" for i, v in enumerate(values)]


#: From the layer's output x0, x1 of table ``z`` to the gradient g0, g1 there; the loss and the head's gradient.
def _head_sql(net: gnn.Network) -> tuple[str, list[str]]:
    head = net.weights["head"]
    logit = _affine(["y0", "y1"], head, 0)
    sql = f"""s as (select z.*, coalesce(t.y, 0) as label, coalesce(t.share, 0) as share, {logit} as logit from z left join t using (id)),
        g as (select *, (1 / (1 + exp(-logit)) - label) * share as err from s),
        top as (select *, err * {head[0, 0]}::double as g0, err * {head[1, 0]}::double as g1 from g)"""
    loss = "(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))) * share"
    return sql, [*_rows("loss", "top", [loss]), *_rows("head", "top", ["err * y0", "err * y1", "err"])]


def sage_gradient_sql(net: gnn.Network, relations: int = 2) -> str:
    w, start = net.weights["w0"], net.weights["input"]
    m = ["h0", "h1", "1", *[f"m{r}{i}" for r in range(relations) for i in range(DIM)], *[f"has{r}" for r in range(relations)]]
    joins = " ".join(f"left join (select * from mean where etype = {r}) a{r} on a{r}.id = h.id" for r in range(relations))
    cols = [f"coalesce(a{r}.m{i}, 0) as m{r}{i}" for r in range(relations) for i in range(DIM)] + [f"(a{r}.id is not null)::int::double as has{r}" for r in range(relations)]
    head, rows = _head_sql(net)
    local = [f"case when {_affine(m, w, j)} > 0 then g{j} else 0 end as d{j}" for j in range(DIM)]
    back = lambda at: " + ".join(f"d{j} * {w[at, j]}::double" for j in range(DIM))
    sent = [f"{back(DIM + 1 + r * DIM + i)} as s{r}{i}" for r in range(relations) for i in range(DIM)]
    take = [f"sum(w * case etype {' '.join(f'when {r} then s{r}{i}' for r in range(relations))} end) as b{i}" for i in range(DIM)]
    return f"""with {SHOP},
        h as (select id, x0, x1, {", ".join(f"greatest({_affine(['x0', 'x1'], start, j)}, 0) as h{j}" for j in range(DIM))} from x),
        mean as (select dst as id, etype, {", ".join(f"sum(w * h{i}) as m{i}" for i in range(DIM))} from e join h on h.id = src group by 1, 2),
        m as (select h.id, x0, x1, h0, h1, {", ".join(cols)} from h {joins}),
        z as (select *, {", ".join(f"greatest({_affine(m, w, j)}, 0) + h{j} as y{j}" for j in range(DIM))} from m),
        {head},
        d as (select *, {", ".join(local)} from top),
        sent as (select id, {", ".join(sent)} from d),
        got as (select src as id, {", ".join(take)} from e join sent on sent.id = dst group by src),
        inner_ as (select d.*, {", ".join(f"case when h{i} > 0 then g{i} + {back(i)} + coalesce(b{i}, 0) else 0 end as i{i}" for i in range(DIM))} from d left join got using (id))
        select name, pos::int as pos, round(v, 7) + 0.0 as v from (
        {" union all ".join([*rows, *_rows("w0", "d", [f"{x} * d{j}" for x in m for j in range(DIM)]), *_rows("input", "inner_", [f"{x} * i{j}" for x in ("x0", "x1", "1") for j in range(DIM)])])})"""


def gat_gradient_sql(net: gnn.Network) -> str:
    """One head; the shift of the scores cancels out and is left away."""
    w, start, left, right = net.weights["w0"], net.weights["input"], net.weights["a_dst0"][0], net.weights["a_src0"][0]
    head, rows = _head_sql(net)
    dot = lambda a, b: " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True))
    lit = lambda a: [f"{x}::double" for x in a]
    return f"""with {SHOP},
        h as (select id, x0, x1, {", ".join(f"greatest({_affine(['x0', 'x1'], start, j)}, 0) as h{j}" for j in range(DIM))} from x),
        p as (select *, {", ".join(f"{_affine(['h0', 'h1'], w, j)} as p{j}" for j in range(DIM))} from h),
        n as (select *, {dot(["p0", "p1"], lit(left))} as l, {dot(["p0", "p1"], lit(right))} as r from p),
        f as (select e.src, e.dst, a.p0, a.p1, a.r + b.l as s from e join n a on a.id = src join n b on b.id = dst),
        k as (select *, exp(case when s > 0 then s else 0.2::double * s end) as k from f),
        mixed as (select dst as id, sum(k) as zz, sum(k * p0) / sum(k) as o0, sum(k * p1) / sum(k) as o1 from k group by dst),
        z as (select n.*, zz, coalesce(o0, 0) as o0, coalesce(o1, 0) as o1, greatest(coalesce(o0, 0), 0) + h0 as y0, greatest(coalesce(o1, 0), 0) + h1 as y1 from n left join mixed using (id)),
        {head},
        d as (select *, case when o0 > 0 then g0 else 0 end as d0, case when o1 > 0 then g1 else 0 end as d1 from top),
        q as (select k.src, k.dst, k / zz as al, (case when s > 0 then 1 else 0.2::double end) * k / zz * (d0 * k.p0 + d1 * k.p1 - d0 * o0 - d1 * o1) as de, d0, d1 from k join d on d.id = dst),
        at_dst as (select dst as id, sum(de) as el from q group by 1), at_src as (select src as id, sum(de) as er, sum(al * d0) as v0, sum(al * d1) as v1 from q group by 1),
        u as (select d.*, coalesce(el, 0) as el, coalesce(er, 0) as er, {", ".join(f"coalesce(v{j}, 0) + coalesce(el, 0) * {left[j]}::double + coalesce(er, 0) * {right[j]}::double as u{j}" for j in range(DIM))}
            from d left join at_dst using (id) left join at_src using (id)),
        inner_ as (select *, {", ".join(f"case when h{i} > 0 then g{i} + u0 * {w[i, 0]}::double + u1 * {w[i, 1]}::double else 0 end as i{i}" for i in range(DIM))} from u)
        select name, pos::int as pos, round(v, 7) + 0.0 as v from (
        {" union all ".join([*rows, *_rows("w0", "u", [f"{x} * u{j}" for x in ("h0", "h1", "1") for j in range(DIM)]), *_rows("a_dst0", "u", ["el * p0", "el * p1"]), *_rows("a_src0", "u", ["er * p0", "er * p1"]), *_rows("input", "inner_", [f"{x} * i{j}" for x in ("x0", "x1", "1") for j in range(DIM)])])})"""


def _shop(spark, sf_dir):
    """Features, edges and churn labels of the graph above."""
    o = order_edges(spark, sf_dir).where(F.col("etime") <= SEED_SECONDS)
    ways = F.array(F.struct("src", "dst", F.lit(0).alias("etype")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("etype")))
    e = o.select(F.explode(ways).alias("e")).select("e.*")
    customer, part = t(spark, sf_dir, "customer"), t(spark, sf_dir, "part")
    x = customer.select(F.col("c_custkey").cast("long").alias("node_id"), F.array(F.col("c_acctbal").cast("double") / 10000, F.lit(1.0)).alias("x"))
    x = x.unionByName(part.select((F.col("p_partkey") + 10**9).alias("node_id"), F.array(F.col("p_size") / F.lit(50.0), F.col("p_retailprice").cast("double") / 2000).alias("x")))
    y = tasks.task_table(customer, "c_custkey", t(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderdate"), [SEED], HORIZON, F.col("o_totalprice"))
    labels = tasks.hash_split(y.select("c_custkey", F.col("churn").cast("double").alias("label")), "c_custkey", 7)
    return x, e, labels.select(F.col("c_custkey").cast("long").alias("node_id"), "split", "label")


def _gradient(spark, sf_dir, net):
    x, e, labels = _shop(spark, sf_dir)
    edges, by_target = gnn.dealt_edges(e, net.kind, Scratch(spark, merge=True))
    loss, grads = gnn.gradients(net, x, edges, gnn._targets(labels, net), by_target)
    rows = [("loss", 0, loss)] + [(n, i, float(v)) for n, g in grads.items() for i, v in enumerate(g.ravel())]  # a row per weight
    return spark.createDataFrame(rows, "name string, pos int, v double").select("name", "pos", (F.round("v", 7) + 0.0).alias("v"))


def _stated(kind: str) -> gnn.Network:
    return stated_weights(gnn.Network.start(kind, DIM, DIM, 1, 2, heads=1))


@query(sage_gradient_sql(_stated("sage")))
def gnn_sage_gradient(spark, sf_dir):
    """The loss of churn and its gradient for every weight of a relation-wise mean layer."""
    return _gradient(spark, sf_dir, _stated("sage"))


@query(gat_gradient_sql(_stated("gat")))
def gnn_gat_gradient(spark, sf_dir):
    """The same of an attention layer."""
    return _gradient(spark, sf_dir, _stated("gat"))


def block_sql(net: gnn.Network) -> str:
    """The layer of a transformer network forwards, column by column."""
    w, heads = net.block(0), net.heads
    d = net.hidden
    width = d // heads
    at = lambda x, n=d: [f"{x}{i}" for i in range(n)]
    line = lambda out, cols, m: ", ".join(f"{_affine(cols, m, j)} as {out}{j}" for j in range(m.shape[1]))
    root = f"sqrt({width}::double)"
    keys, values = (w["centroids"] @ w[n][:-1] + w[n][-1] for n in ("gk", "gv"))
    score = lambda q, k, a: f"exp(({' + '.join(f'{q}{i} * {k(i)}' for i in range(a * width, (a + 1) * width))}) / {root})"
    n_c = len(keys)
    far = ", ".join(f"{score('gq', lambda i, c=c: f'({keys[c, i]}::double)', a)} as f{a}_{c}" for a in range(heads) for c in range(n_c))
    mix = ", ".join(f"({' + '.join(f'f{i // width}_{c} * ({values[c, i]}::double)' for c in range(n_c))}) / ({' + '.join(f'f{i // width}_{c}' for c in range(n_c))}) as g{i}" for i in range(d))
    mean = lambda x: f"(({' + '.join(at(x))}) / {d})"
    var = lambda x: "((" + " + ".join(f"({x}{i} - m) * ({x}{i} - m)" for i in range(d)) + f") / {d})"
    norm = lambda out, x, m: ", ".join(f"({x}{i} - m) / sqrt({var(x)} + 0.00001::double) * ({m[0, i]}::double) + ({m[1, i]}::double) as {out}{i}" for i in range(d))
    return f"""with {SHOP},
        h as (select id, {line("h", ["x0", "x1"], net.weights["input"])} from x),
        p as (select *, {line("q", at("h"), w["q"])}, {line("k", at("h"), w["k"])}, {line("v", at("h"), w["v"])}, {line("gq", at("h"), w["gq"])} from h),
        s as (select e.dst as id, {", ".join(f"a.v{i} as v{i}" for i in range(d))}, {", ".join(f"{score('b.q', lambda i: f'a.k{i}', a)} as s{a}" for a in range(heads))} from e join p a on a.id = src join p b on b.id = dst),
        mixed as (select id, {", ".join(f"sum(s{i // width} * v{i}) / sum(s{i // width}) as o{i}" for i in range(d))} from s group by id),
        c as (select p.*, {", ".join(f"coalesce(o{i}, 0) as o{i}" for i in range(d))}, {far} from p left join mixed using (id)),
        g as (select *, {mix} from c),
        a as (select *, {", ".join(f"h{j} + {_affine(at('o'), w['o'], j)} + {_affine(at('g'), w['go'], j)} as a{j}" for j in range(d))} from g),
        one as (select *, {norm("n", "a", w["norm1"])} from (select *, {mean("a")} as m from a)),
        up as (select id, {", ".join(at("n"))}, {line("u", at("n"), w["up"])} from one),
        b as (select id, {", ".join(f"n{j} + {_affine([f'greatest(u{i}, 0)' for i in range(2 * d)], w['down'], j)} as b{j}" for j in range(d))} from up),
        done as (select id, {norm("y", "b", w["norm2"])} from (select *, {mean("b")} as m from b))
        select id as node_id, {", ".join(f"round(y{i}, 6) + 0.0 as y{i}" for i in range(d))} from done"""


def _stated_block() -> gnn.Network:
    return stated_weights(gnn.Network.start("relgt", DIM, 4, 1, 2, heads=2, centroids=3))


@query(block_sql(_stated_block()))
def transformer_block(spark, sf_dir):
    """Tokens of customers and parts after one block: attention over their edges and over global centroids, layer norm,
    feed-forward step."""
    x, e, _ = _shop(spark, sf_dir)
    net = _stated_block()
    out = gnn.embed(net, x, Scratch(spark).store(gnn.weighed(e), "edges"))
    return out.select("node_id", *[(F.round(F.col("x")[i], 6) + 0.0).alias(f"y{i}") for i in range(net.hidden)])


@query()
def gnn_training(spark, sf_dir):
    """(node_id, score): churn scores of all customers by a trained network; a training run has no SQL."""
    x, e, labels = _shop(spark, sf_dir)
    edges, by_target = gnn.dealt_edges(e, "sage", Scratch(spark, merge=True))
    net = gnn.train(gnn.Network.start("sage", DIM, 4, 1, 2, seed=1), x, edges, labels, epochs=4, rate=0.05, every=4, by_target=by_target)
    scored = gnn.predict(net, x, edges)
    return scored.join(labels.select("node_id"), "node_id", "left_semi").select("node_id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------------------------------------- as-of features

MOMENTS = ["1998-06-01", "1999-06-01", "2000-06-01", "2024-01-02", "2024-01-10"]


@query(f"""select c_custkey as customer, s as seed, arg_max(value, row(ts, event_id)) as value, arg_max(event_type, row(ts, event_id)) as event_type
    from customer cross join (select unnest([{", ".join(f"timestamp '{m}'" for m in MOMENTS)}]) as s) left join events on user_id = c_custkey and ts <= s group by 1, 2""")
def asof_features(spark, sf_dir):
    """Every customer at several seed times, with the last event known by then."""
    seeds = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.explode(F.array(*[F.lit(m).cast("timestamp_ntz") for m in MOMENTS])).alias("seed"))
    events = t(spark, sf_dir, "events").select(F.col("user_id").alias("customer"), F.col("ts").cast("timestamp_ntz").alias("seed"), "event_id", "value", "event_type")
    return asof_join(seeds, events, ["customer"], "seed", ["value", "event_type"], order=["event_id"])


@query("""select o_orderkey as order_key, coalesce((select max(row(b.o_orderdate, b.o_orderkey))[2] from orders b where b.o_custkey = a.o_custkey and b.o_orderdate < a.o_orderdate), -1) as previous
    from orders a""")
def previous_orders(spark, sf_dir):
    """Every order with the last order of its customer on an earlier day, -1 where there is none."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    out = asof_join(o.withColumnRenamed("o_orderkey", "order_key"), o.withColumnRenamed("o_orderkey", "previous"), ["o_custkey"], "o_orderdate", ["previous"], strict=True)
    return out.select("order_key", F.coalesce("previous", F.lit(-1)).alias("previous"))


# ---------------------------------------------------------------------------------------------- keys and relations

#: Columns of the tables that can be keys: whole numbers and texts.
KEYED = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
}
_DISTINCT = "vals as materialized (" + " union all ".join(f"select distinct '{n}' as tab, '{c}' as col, {c}::varchar as v, typeof({c}) = 'VARCHAR' as txt from {n}" for n, cols in KEYED.items() for c in cols) + ")"
_PROFILE = " union all ".join(f"select '{n}' as \"table\", '{c}' as \"column\", count(distinct {c}) as n_distinct, count(*) - count({c}) as n_null, count(*) > 0 and count(distinct {c}) = count(*) as is_key from {n}" for n, cols in KEYED.items() for c in cols)


def _keyed(spark, sf_dir):
    tables = {n: t(spark, sf_dir, n).select(*cols) for n, cols in KEYED.items()}
    scratch = Scratch(spark)
    return scratch.store(discovery.column_values(tables), "values"), scratch


@query(_PROFILE)
def column_profile(spark, sf_dir):
    """Distinct values and nulls of every column that can be a key, and whether it is one."""
    return discovery.column_profile(_keyed(spark, sf_dir)[0])


@query(f"""with p as ({_PROFILE}), {_DISTINCT},
    shared as (select a.tab, a.col, b.tab as target, b.col as target_column, count(*) as n from vals a join vals b on a.v = b.v and a.txt = b.txt and a.tab <> b.tab group by all)
    select tab as "table", col as "column", target, target_column, x.n_distinct as n_values, round(x.n_distinct / k.n_distinct, 9) as coverage
    from shared join p x on x."table" = tab and x."column" = col and x.n_distinct = n join p k on k."table" = target and k."column" = target_column and k.is_key""")
def inclusion_dependencies(spark, sf_dir):
    """Every column whose values are all in a key column of another table."""
    return discovery.inclusions(*_keyed(spark, sf_dir)).withColumn("coverage", F.round("coverage", 9))


# ---------------------------------------------------------------------------------------------- streams

CLOSED = """with x as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval '1 hour' then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
    s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from x),
    closed as (select user_id, count(*) as n, min(ts) as first, max(ts) as last from s group by user_id, k having max(ts) + interval '1 hour' <= (select date_trunc('milliseconds', max(ts)) - interval '1 hour' from events))"""


@query(f"{CLOSED} select user_id as node, first as first_seen, last as last_seen, n as degree from closed")
def stream_node_activity(spark, sf_dir):
    """Spans of activity of every user that the watermark has closed, from a stream that keeps only the open ones."""
    scratch = Scratch(spark)
    target = f"{scratch.root}/activity"
    streams.run_available(state.node_activity(streams.read_events(spark, sf_dir, "events.parquet")), target, f"{scratch.root}/activity-state")
    out = spark.read.parquet(target)
    return out.select("node", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_seen")], "degree")


@query(f"{CLOSED} select user_id, n, first as start from closed")
def stream_closed_sessions(spark, sf_dir):
    """Sessions in append mode: each is written once, when the watermark has closed it, and then forgotten."""
    scratch = Scratch(spark)
    target = f"{scratch.root}/sessions"
    streams.run_available(streams.sessions(streams.read_events(spark, sf_dir, "events.parquet")), target, f"{scratch.root}/sessions-state")
    return spark.read.parquet(target).select("user_id", "n", F.col("start").cast("timestamp_ntz").alias("start"))


# ---------------------------------------------------------------------------------------------- graphs of parts
# Parts as vertices; an edge from the part of a line to the part of the order's next line, both of 30 pieces or more. Most
# parts are in one strong component.


def line_graph(spark, sf_dir):
    scratch = Scratch(spark)
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").where("l_quantity >= 30")
    nxt = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    e = li.join(nxt, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return scratch.store(t(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id")), "vertices"), scratch.store(e, "edges")


LINES = """v as materialized (select p_partkey::bigint as id from part),
    e as materialized (select a.l_partkey::bigint as src, b.l_partkey::bigint as dst from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 and a.l_quantity >= 30 and b.l_quantity >= 30),
    d as materialized (select distinct src, dst from e where src <> dst),
    u as materialized (select src, dst from d union select dst, src from d)"""
_HEX = "('0x' || md5({})[{}])::bigint"


@query(f"""with recursive {LINES},
    reach as (select id as a, id as b from v union select a, dst from reach join d on src = b),
    mutual as (select x.a as id, x.b as other from reach x join reach y on x.a = y.b and x.b = y.a)
    select id, min(other) as component, count(*) as size, count(*) > 1 or id in (select src from e where src = dst) as on_cycle from mutual group by id""")
def strong_components(spark, sf_dir):
    """Strongly connected components of the parts, and which parts are on a cycle."""
    return cycles.strong_components(*line_graph(spark, sf_dir))


@query(f"""with recursive {LINES},
    deg as (select id, coalesce(n, 0) as n from v left join (select src, count(*) as n from u group by src) on src = id),
    o as (select id, row_number() over (order by n desc, {_HEX.format("id::varchar || ':0'", "1:15")} desc, id desc) as k from deg),
    before as (select o.k, list(x.k) as bs from u join o on o.id = u.src join o x on x.id = u.dst where x.k < o.k group by o.k),
    nb as (select o.k, o.id, coalesce(bs, []) as bs from o left join before using (k)),
    walk as (select 0::bigint as k, []::int[] as c union all
        select nb.k, list_append(c, list_min(list_filter(range(len(bs) + 1), lambda f: not list_contains(list_transform(bs, lambda b: c[b]), f)))::int) from walk join nb on nb.k = walk.k + 1)
    select id, c[k] as colour from nb, (select c from walk where k = (select count(*) from v))""")
def priority_colouring(spark, sf_dir):
    """Colours of the parts by falling degree, so that no two parts on one edge share one."""
    return colouring.priority_colouring(*line_graph(spark, sf_dir))


WALK_P, WALK_Q, STEPS = 0.5, 2.0, 4
_TEXT = f"s.walk::varchar || ':7:' || (s.step + 1)::varchar || ':' || s.attempt::varchar"


@query(f"""with recursive {LINES},
    ways as materialized (select src, dst, row_number() over (partition by src order by dst) - 1 as place, count(*) over (partition by src) as degree from u),
    s as (select id as walk, 0 as step, 0 as attempt, null::bigint as prev, id as node, 0 as moved from v
        union all
        select walk, case when taken then step + 1 else step end, case when taken then 0 else attempt + 1 end, case when taken then node else prev end, case when taken then nxt else node end, taken::int from (
            select s.*, w.dst as nxt, s.prev is null or ({_HEX.format(_TEXT, "16:22")} + 0.5::double) / 268435456 * {max(1 / WALK_P, 1, 1 / WALK_Q)}::double
                < (case when w.dst = s.prev then {1 / WALK_P}::double when k.src is not null then 1 else {1 / WALK_Q}::double end) as taken
            from s join ways w on w.src = s.node and w.place = {_HEX.format(_TEXT, "1:15")} % w.degree left join u k on k.src = s.prev and k.dst = w.dst where s.step < {STEPS}))
    select walk, step, node from s where step = 0 or moved = 1""")
def node2vec_walks(spark, sf_dir):
    """Four steps of a second-order walk from every part, that likes to go back and shuns far nodes."""
    v, e = line_graph(spark, sf_dir)
    e = e.where("src <> dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return walks.node2vec_walks(both, v.select(F.col("id").alias("walk"), F.col("id").alias("node")), STEPS, WALK_P, WALK_Q, seed=7)


@query(f"""with recursive {SMALL}, w as (select distinct src, dst from u where src <> dst), hop as (select id as a, id as b, 0 as n from v union select a, dst, n + 1 from hop join w on src = b where n < 60),
    near as (select a, b, min(n) as n from hop group by 1, 2)
    select a as id, cast(count(*) filter (where n > 0) as bigint) as reached, cast(sum(n) as bigint) as distance, round(case when sum(n) > 0 then count(*) filter (where n > 0) / sum(n) else 0 end, 9) as closeness, round(sum(case when n > 0 then 1.0::double / n else 0 end), 9) as harmonic from near group by a""")
def sketched_closeness(spark, sf_dir):
    """Reach and closeness of customers from sketches; sets this small are exact in a sketch."""
    v, e = small_graph(spark, sf_dir)
    out = sketches.sketched_closeness(v, both_ways(e))
    return out.select("id", "reached", F.col("distance").cast("long").alias("distance"), F.round("closeness", 9).alias("closeness"), F.round("harmonic", 9).alias("harmonic"))


def _quantiser_sql(k: int = 4, rounds: int = 3, decay: float = 0.9, smoothing: float = 1e-5) -> str:
    parts = ["x as materialized (select vec_id, embedding::double[] as x from embeddings)", f"s0 as materialized (select (row_number() over (order by vec_id) - 1)::int as code, x as c, 1.0::double as n, x as s from x qualify code < {k})"]
    for r in range(rounds):
        parts.append(f"b{r} as materialized (select vec_id, any_value(x) as x, arg_min(code, row(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), code)) as code from x cross join s{r} where vec_id % {rounds} = {r} group by vec_id)")
        parts.append(f"t{r} as (select code, any_value(n) as n, list(v order by i) as t from (select code, i, sum(x[i]) as v, count(*) as n from b{r} cross join range(1, 65) q(i) group by 1, 2) group by code)")
        parts.append(f"n{r} as (select code, {decay}::double * s{r}.n + (1 - {decay}::double) * coalesce(t{r}.n, 0) as n, list_transform(range(1, 65), lambda i: {decay}::double * s[i] + (1 - {decay}::double) * coalesce(t[i], 0)) as s from s{r} left join t{r} using (code))")
        parts.append(f"s{r + 1} as materialized (select code, list_transform(s, lambda v: v / ((n + {smoothing}::double) / (sum(n) over () + {k} * {smoothing}::double) * sum(n) over ())) as c, n, s from n{r})")
    return f"with {', '.join(parts)} select code, round(n, 6) as n, round(list_sum(list_transform(c, lambda v: v * v)), 6) as size, round(c[1], 6) + 0.0 as c0, round(c[64], 6) + 0.0 as c63 from s{rounds}"


@query(_quantiser_sql())
def vector_quantiser(spark, sf_dir):
    """A codebook of four after three batches that together are all vectors."""
    v = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    book = quantiser.Codebook.start([r.x for r in v.orderBy("id").limit(4).collect()], decay=0.9)
    for batch in range(3):
        book.update(v.where(F.col("id") % 3 == batch))
    size = F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x)
    return book.table(spark).select("code", F.round("n", 6).alias("n"), F.round(size, 6).alias("size"), (F.round(F.col("c")[0], 6) + 0.0).alias("c0"), (F.round(F.col("c")[63], 6) + 0.0).alias("c63"))


# The iterative operators again, on a graph with one giant component. LINES with distinct edges and no loops.
SIMPLE = LINES.split("d as materialized")[0].replace("e as materialized (select a.", "e0 as materialized (select a.") + """e as materialized (select distinct src, dst, abs(src - dst)::double as weight from e0 where src <> dst),
    u as materialized (select src, dst, weight from e union all select dst, src, weight from e)"""
#: The first part of every brand.
BRANDS = "(select min(p_partkey)::bigint as id from part group by p_brand)"


def simple_line_graph(spark, sf_dir):
    v, e = line_graph(spark, sf_dir)
    return v, e.where("src <> dst").distinct().withColumn("weight", F.abs(F.col("src") - F.col("dst")).cast("double"))


def _brands(spark, sf_dir):
    return t(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").cast("long").alias("id")).select("id")


@query(SQL["pagerank"].replace(SMALL, SIMPLE))
def line_pagerank(spark, sf_dir):
    return analytics.pagerank(*simple_line_graph(spark, sf_dir), rounds=5).select("id", F.round("rank", 9).alias("rank"))


@query(f"""with recursive {SIMPLE}, reach as (select id, id as root from v union select u.dst, root from reach join u on u.src = reach.id) select id, min(root) as component from reach group by id""")
def line_components(spark, sf_dir):
    return analytics.components(*simple_line_graph(spark, sf_dir))


@query(f"""with recursive {SIMPLE}, hop as (select id, 0 as level from {BRANDS} union select u.dst, level + 1 from hop join u on u.src = hop.id where level < 30) select id, min(level)::int as level from hop group by id""")
def line_bfs(spark, sf_dir):
    """Hops from each part to the nearest of the brands' first parts; the SQL stops at 30 hops, the query does not."""
    out = paths.nearest_source(simple_line_graph(spark, sf_dir)[1], _brands(spark, sf_dir))
    return out.select("id", F.col("distance").cast("int").alias("level"))


def _relaxed(rounds: int) -> str:
    steps = [f"d0 as (select id, 0.0::double as d from {BRANDS})"]
    for i in range(rounds):
        steps.append(f"d{i + 1} as materialized (select id, min(d) as d from (select id, d from d{i} union all select u.dst, d + weight from d{i} join u on u.src = d{i}.id) group by id)")
    return f"with {SIMPLE}, {', '.join(steps)} select id, d as distance from d{rounds}"


@query(_relaxed(40))
def line_shortest_paths(spark, sf_dir):
    """Least sum of steps in the part number to the nearest of the brands' first parts; the SQL relaxes 40 times."""
    return paths.nearest_source(simple_line_graph(spark, sf_dir)[1], _brands(spark, sf_dir), "weight")


@query(SQL["label_propagation"].replace(SMALL, SIMPLE))
def line_label_propagation(spark, sf_dir):
    return analytics.label_propagation(*simple_line_graph(spark, sf_dir), rounds=3)


@query(SQL["clustering_coefficient"].replace(SMALL, SIMPLE))
def line_clustering(spark, sf_dir):
    return analytics.clustering_coefficient(*simple_line_graph(spark, sf_dir)).select("id", F.round("coefficient", 9).alias("coefficient"))
