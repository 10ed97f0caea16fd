"""Neighbourhood, walk and node-state operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgetide.catalog.fixtures import (
    kv_edges, r6, raw_logs, sql, sql_draw, sql_uniform, table, trade_edges, transition_edges,
)
from edgetide.catalog.registry import query
from edgetide.functions.vectors import one_hot
from edgetide.operators import neighbors as nb
from edgetide.operators.events import batch_number
from edgetide.schema import ACTIONS
from edgetide.session import stored


def halves(g: str) -> str:
    return f"hf as (select u as node, i as neighbor, ts_us, idx from {g} union all select i, u, ts_us, idx from {g})"


def asked(g: str) -> str:
    return f"q as (select idx as qidx, 'src' as side, u as node, ts_us as at from {g} union all select idx, 'dst', i, ts_us from {g})"


def recent(g: str, k: int) -> str:
    """Rows of each query's last k strictly earlier interactions, r = 1 for the newest."""
    return f"""{halves(g)}, {asked(g)}, rec as (select * from (select q.*, hf.neighbor, hf.ts_us as nts, hf.idx as nidx,
 row_number() over (partition by qidx, side order by hf.ts_us desc, hf.idx desc, hf.neighbor desc) as r from q join hf on hf.node=q.node and hf.ts_us < q.at) where r <= {k})"""


@query("recent_neighbors", sql("tr", body="+ " + recent("tr", 5) + """, l as (select qidx, side, string_agg(neighbor || ':' || nidx, ',' order by r desc) as recent,
 count(*) as n from rec group by 1,2) select q.qidx as idx, q.side, coalesce(recent, '') as recent, repeat('0,', 5 - coalesce(n, 0)::int) as pad from q left join l using (qidx, side)"""))
def recent_neighbors(spark, sf):
    edges = transition_edges(spark, sf)
    found = nb.recent_neighbors(nb.edge_queries(edges), edges, 5)
    text = F.transform("recent", lambda r: F.concat(r["neighbor"].cast("string"), F.lit(":"), r["idx"].cast("string")))
    pads = F.size(F.filter(nb.padded(F.col("recent"), 5), lambda x: x == 0))
    return found.select("idx", "side", F.array_join(text, ",").alias("recent"), F.repeat(F.lit("0,"), pads).alias("pad"))


# a moment's earlier interactions are the places before its first one, so the last three are three places
@query("recent_neighbors_ties", sql("trade", body=f"+ {halves('trade')}" + """, t as (select *, row_number() over (partition by node order by ts_us, idx, neighbor) as spot from hf),
 e as (select node, ts_us, min(spot) - 1 as earlier from t group by 1,2), w as (select *, unnest(range(0, 3)) as j from e where earlier > 0),
 l as (select w.node, w.ts_us, string_agg(t.idx, ',' order by t.spot) as recent from w join t on t.node=w.node and t.spot = w.earlier - w.j group by 1,2),
 q as (select idx, 'src' as side, u as node, ts_us from trade union all select idx, 'dst', i, ts_us from trade)
 select q.idx, q.side, coalesce(l.recent, '') as recent from q left join l using (node, ts_us)"""))
def recent_neighbors_ties(spark, sf):
    edges = trade_edges(spark, sf)
    queries = nb.edge_queries(edges)
    text = F.array_join(F.transform("recent", lambda r: r["idx"].cast("string")), ",")
    return nb.recent_neighbors(queries, edges, 3).select("idx", "side", text.alias("recent"))


@query("asof_neighbors", sql("kv", body=f"+ {halves('kv')}" + """ select kv.idx as idx, hf.neighbor, hf.idx as nbr_idx from kv join hf on hf.node=kv.i and hf.ts_us < kv.ts_us"""))
def asof_neighbors(spark, sf):
    edges = kv_edges(spark, sf)
    queries = edges.select("idx", F.col("i").alias("node"), "ts_us")
    return nb.asof_neighbors(queries, edges, share=16).select("idx", "neighbor", "nbr_idx")


@query("earlier_counts", sql("trade", body=f"+ {halves('trade')}" + """, e as (select node, ts_us, count(*) as c from hf group by 1,2),
 s as (select node, ts_us, sum(c) over (partition by node order by ts_us) - c as earlier from e)
 select trade.idx, cast(s.earlier as bigint) as earlier from trade join s on s.node=trade.i and s.ts_us=trade.ts_us"""))
def earlier_counts(spark, sf):
    edges = trade_edges(spark, sf)
    queries = edges.select("idx", F.col("i").alias("node"), "ts_us")
    return nb.earlier_counts(queries, nb.node_timeline(edges)).select("idx", "earlier")


@query("uniform_neighbors", sql("tr", body=f"+ {halves('tr')}" + f""", t as (select *, row_number() over (partition by node order by ts_us, idx, neighbor) as spot from hf),
 c as (select tr.idx as qid, tr.u as node, (select count(*) from hf where hf.node=tr.u and hf.ts_us < tr.ts_us) as n from tr),
 d as (select qid, node, j, {sql_draw(0, 'qid', 'j')} % n + 1 as spot from c, (select unnest(range(0, 4)) as j) where n > 0)
 select qid, cast(j as int) as j, t.neighbor, t.idx as nbr_idx from d join t on t.node=d.node and t.spot=d.spot"""))
def uniform_neighbors(spark, sf):
    edges = transition_edges(spark, sf)
    queries = edges.select(F.col("idx").alias("qid"), F.col("u").alias("node"), "ts_us")
    return nb.uniform_neighbors(queries, edges, 4).select("qid", "j", "neighbor", "nbr_idx")


@query("time_aware_neighbors", sql("tr", body=f"+ {halves('tr')}" + f""", f as (select node, max(ts_us) as final from hf group by 1),
 w as (select hf.*, exp(0.000001*(hf.ts_us-final)/1e6) as term from hf join f using (node)),
 w2 as (select *, sum(term) over (partition by node order by ts_us, idx, neighbor rows unbounded preceding) as s from w),
 w3 as (select *, exp(term/s) as mass from w2), w4 as (select *, sum(mass) over (partition by node order by ts_us, idx, neighbor rows unbounded preceding) as upto from w3),
 c as (select tr.idx as qid, tr.u as node, max(w4.upto) as total from tr join w4 on w4.node=tr.u and w4.ts_us < tr.ts_us group by 1,2),
 d as (select qid, node, j, {sql_uniform(0, 'qid', 'j')} * total as at from c, (select unnest(range(0, 3)) as j))
 select qid, cast(j as int) as j, w4.neighbor, w4.idx as nbr_idx from d join w4 on w4.node=d.node and d.at >= w4.upto - w4.mass and d.at < w4.upto"""))
def time_aware_neighbors(spark, sf):
    edges = transition_edges(spark, sf)
    queries = edges.select(F.col("idx").alias("qid"), F.col("u").alias("node"), "ts_us")
    return nb.time_aware_neighbors(queries, edges, 3, scaling=1e-6).select("qid", "j", "neighbor", "nbr_idx")


HOPS = recent("tr", 3) + """, h1 as (select qidx, neighbor, nts, nidx, 3 - r as place from rec where side='src'),
 h2 as (select * from (select h1.qidx, h1.place, hf.neighbor, hf.idx as nidx, hf.ts_us as nts, row_number() over (partition by h1.qidx, h1.place order by hf.ts_us desc, hf.idx desc, hf.neighbor desc) as r
  from h1 join hf on hf.node=h1.neighbor and hf.ts_us < h1.nts) where r <= 3)"""


@query("multi_hop_neighbors", sql("tr", body="+ " + HOPS + """ select qidx as qid, 1 as hop, place::varchar as walk, neighbor, nidx as idx from h1
 union all select qidx, 2, place || ',' || (3 - r), neighbor, nidx from h2"""))
def multi_hop_neighbors(spark, sf):
    edges = transition_edges(spark, sf)
    queries = edges.select(F.col("idx").alias("qid"), F.col("u").alias("node"), "ts_us")
    found = nb.multi_hop_neighbors(queries, edges, 2, 3)
    return found.select("qid", "hop", F.array_join("walk", ",").alias("walk"), "neighbor", "idx")


@query("temporal_walks", sql("tr", body="+ " + HOPS + """ select h1.qidx as qid, tr.u || ',' || h1.neighbor || ',' || h2.neighbor as nodes,
 tr.ts_us || ',' || h1.nts || ',' || h2.nts as times from h1 join h2 using (qidx, place) join tr on tr.idx=h1.qidx"""))
def temporal_walks(spark, sf):
    edges = transition_edges(spark, sf)
    queries = edges.select(F.col("idx").alias("qid"), F.col("u").alias("node"), "ts_us")
    found = nb.temporal_walks(queries, edges, 2, 3)
    return found.select("qid", F.array_join("nodes", ",").alias("nodes"), F.array_join("times", ",").alias("times"))


def drawn_hop(source: str, strategy: str, name: str, k: int = 2) -> str:
    """Table ``name`` (qid, walk, hop places, neighbor, nidx, nts): k draws for every row of ``source`` (qid, walk, node, at)."""
    if strategy == "uniform":
        counts = f"{name}c as (select s.qid, s.walk, s.node, count(*) as n from {source} s join tl on tl.node=s.node and tl.ts_us < s.at group by all)"
        hit = f"tl.spot = {sql_draw(0, 'd.qid', 'd.walk', 'd.j')} % d.n + 1"
    else:
        counts = f"{name}c as (select s.qid, s.walk, s.node, max(tl.upto) as n from {source} s join tl on tl.node=s.node and tl.ts_us < s.at group by all)"
        hit = f"{sql_uniform(0, 'd.qid', 'd.walk', 'd.j')} * d.n >= tl.upto - tl.mass and {sql_uniform(0, 'd.qid', 'd.walk', 'd.j')} * d.n < tl.upto"
    return f"""{counts}, {name}d as (select d.*, tl.spot, tl.neighbor, tl.idx as nidx, tl.ts_us as nts from (select *, unnest(range(0, {k})) as j from {name}c) d join tl on tl.node=d.node and {hit}),
 {name} as (select *, row_number() over (partition by qid, walk order by spot, j) - 1 as place from {name}d)"""


def drawn_hops(strategy: str) -> str:
    """Two hops of two draws each from every edge's source: ``a1`` and ``a2``."""
    line = f"""{halves('tr')}, ff as (select node, max(ts_us) as final from hf group by 1),
 t1 as (select hf.*, exp(0.000001*(hf.ts_us-final)/1e6) as term from hf join ff using (node)),
 t2 as (select *, sum(term) over (partition by node order by ts_us, idx, neighbor rows unbounded preceding) as s from t1), t3 as (select *, exp(term/s) as mass from t2),
 tl as (select *, sum(mass) over (partition by node order by ts_us, idx, neighbor rows unbounded preceding) as upto, row_number() over (partition by node order by ts_us, idx, neighbor) as spot from t3),
 q0 as (select idx as qid, '' as walk, u as node, ts_us as at from tr)"""
    return f"""{line}, {drawn_hop('q0', strategy, 'a1')}, q1 as (select qid, place::varchar as walk, neighbor as node, nts as at from a1), {drawn_hop('q1', strategy, 'a2')}"""


DRAWN_HOPS = """ select qid, 1 as hop, place::varchar as walk, neighbor, nidx as idx from a1 union all select qid, 2, walk || ',' || place, neighbor, nidx from a2"""
DRAWN_WALKS = """ select a2.qid, tr.u || ',' || a1.neighbor || ',' || a2.neighbor as nodes, tr.ts_us || ',' || a1.nts || ',' || a2.nts as times
 from a2 join a1 on a1.qid=a2.qid and a1.place::varchar=a2.walk join tr on tr.idx=a2.qid"""


def source_queries(edges):
    return edges.select(F.col("idx").alias("qid"), F.col("u").alias("node"), "ts_us")


@query("multi_hop_neighbors_uniform", sql("tr", body="+ " + drawn_hops("uniform") + DRAWN_HOPS))
def multi_hop_neighbors_uniform(spark, sf):
    edges = transition_edges(spark, sf)
    found = nb.multi_hop_neighbors(source_queries(edges), edges, 2, 2, "uniform")
    return found.select("qid", "hop", F.array_join("walk", ",").alias("walk"), "neighbor", "idx")


@query("multi_hop_neighbors_time_aware", sql("tr", body="+ " + drawn_hops("time_aware") + DRAWN_HOPS))
def multi_hop_neighbors_time_aware(spark, sf):
    edges = transition_edges(spark, sf)
    found = nb.multi_hop_neighbors(source_queries(edges), edges, 2, 2, "time_aware")
    return found.select("qid", "hop", F.array_join("walk", ",").alias("walk"), "neighbor", "idx")


@query("temporal_walks_uniform", sql("tr", body="+ " + drawn_hops("uniform") + DRAWN_WALKS))
def temporal_walks_uniform(spark, sf):
    edges = transition_edges(spark, sf)
    found = nb.temporal_walks(source_queries(edges), edges, 2, 2, "uniform")
    return found.select("qid", F.array_join("nodes", ",").alias("nodes"), F.array_join("times", ",").alias("times"))


@query("temporal_walks_time_aware", sql("tr", body="+ " + drawn_hops("time_aware") + DRAWN_WALKS))
def temporal_walks_time_aware(spark, sf):
    edges = transition_edges(spark, sf)
    found = nb.temporal_walks(source_queries(edges), edges, 2, 2, "time_aware")
    return found.select("qid", F.array_join("nodes", ",").alias("nodes"), F.array_join("times", ",").alias("times"))


@query("landing_probability", sql("tr", body="+ " + recent("tr", 3) + """, h2 as (select * from (select a.qidx, a.side, a.r as ar, hf.neighbor,
  row_number() over (partition by a.qidx, a.side, a.r order by hf.ts_us desc, hf.idx desc, hf.neighbor desc) as r from rec a join hf on hf.node=a.neighbor and hf.ts_us < a.nts) where r <= 3),
 v as (select qidx, side, node, 0 as hop from q union all select qidx, side, neighbor, 1 from rec union all select qidx, side, neighbor, 2 from h2)
 select qidx, node, hop, round(count(*) filter (where side='src') / pow(3.0, hop), 6) as from_src, round(count(*) filter (where side='dst') / pow(3.0, hop), 6) as from_dst
 from v group by 1,2,3"""))
def landing_probability(spark, sf):
    found = nb.landing_probability(transition_edges(spark, sf), 2, 3)
    return found.withColumns({c: r6(c) for c in ("from_src", "from_dst")})


@query("neighbor_cooccurrence", sql("tr", body="+ " + recent("tr", 5) + """, l as (select qidx, side, node as neighbor from q union all select qidx, side, neighbor from rec)
 select qidx as idx, neighbor, count(*) filter (where side='src') as in_src, count(*) filter (where side='dst') as in_dst from l group by 1,2"""))
def neighbor_cooccurrence(spark, sf):
    return nb.neighbor_cooccurrence(transition_edges(spark, sf), 6)


@query("neighbor_mean", sql("tr", body="+ " + recent("tr", 2000) + """, vec as (select vec_id + 1 as node, unnest(range(0, 64)) as pos, cast(unnest(embedding) as double) as x from embeddings)
 select q.qidx as qid, o.pos::int as pos, round(max(o.x) + coalesce(avg(n.x), 0), 6) as value from q join vec o on o.node=q.node
 left join rec on rec.qidx=q.qidx and rec.side=q.side left join vec n on n.node=rec.neighbor and n.pos=o.pos where q.side='src' group by 1, 2"""))
def neighbor_mean(spark, sf):
    edges = transition_edges(spark, sf)
    vectors = table(spark, sf, "embeddings").select(
        (F.col("vec_id") + 1).alias("node"), F.col("embedding").cast("array<double>").alias("vec")
    )
    queries = edges.select(F.col("idx").alias("qid"), F.col("u").alias("node"), "ts_us")
    found = nb.neighbor_mean(queries, edges, vectors, 64)
    return found.select("qid", F.posexplode("vec").alias("pos", "value")).withColumn("value", r6("value"))


@query("neighbor_time_features", sql("tr", body="+ " + recent("tr", 4) + """ select qidx as qid, neighbor, nidx as idx, round((rec.at-nts)/1e6, 6) as delta_t, tr.action_type,
 unnest(range(0, 10))::int as pos, round(cos((rec.at-nts)/1e6 * pow(10.0, -unnest(range(0, 10)))), 6) as wave from rec join tr on tr.idx=nidx where side='src'"""))
def neighbor_time_features(spark, sf):
    edges = transition_edges(spark, sf)
    queries = edges.select(F.col("idx").alias("qid"), F.col("u").alias("node"), "ts_us")
    found = nb.neighbor_time_features(queries, edges, edges.select("idx", "action_type"), 4, dim=10)
    rows = found.select("qid", "neighbor", "idx", r6("delta_t").alias("delta_t"), "action_type", F.posexplode("encoding").alias("pos", "wave"))
    return rows.withColumn("wave", r6("wave"))


@query("node_recency", sql("trade", body=f"+ {halves('trade')}, {asked('trade')}" + """, m as (select distinct node, ts_us from hf), p as (select node, ts_us, lag(ts_us) over (partition by node order by ts_us) as prev from m)
 select qidx as idx, side, q.node, round((q.at-prev)/1e6, 6) as recency from q join p on p.node=q.node and p.ts_us=q.at"""))
def node_recency(spark, sf):
    return nb.node_recency(trade_edges(spark, sf)).withColumn("recency", r6("recency"))


@query("time_shift_stats", sql("trade", body="""+ r as (select 'src' as role, u as node, ts_us, idx from trade union all select 'dst', i, ts_us, idx from trade),
 s as (select role, (ts_us - coalesce(lag(ts_us) over (partition by role, node order by idx), 0))/1e6 as shift from r)
 select role, round(avg(shift), 2) as mean_shift, round(stddev_pop(shift), 2) as std_shift from s group by 1"""))
def time_shift_stats(spark, sf):
    found = nb.time_shift_stats(trade_edges(spark, sf))
    return found.select("role", r6("mean_shift", 2).alias("mean_shift"), r6("std_shift", 2).alias("std_shift"))


@query("last_message", sql("kv", body="""+ h as (select (idx-1)//256 as batch, u as node, i as neighbor, ts_us, idx from kv union all select (idx-1)//256, i, u, ts_us, idx from kv)
 select batch, node, arg_max(neighbor, (ts_us, idx)) as last_neighbor, max(ts_us) as last_ts_us, arg_max(idx, (ts_us, idx)) as last_idx from h group by 1,2"""))
def last_message(spark, sf):
    return nb.last_message(kv_edges(spark, sf).withColumn("batch", batch_number()))


@query("prev_next_event", sql("trade", body="""+ e as (select 'out' as direction, u as node, ts_us, idx, label from trade union all select 'in', i, ts_us, idx, label from trade),
 w as (select node, ts_us, direction, arg_max(label, idx) as last, arg_min(label, idx) as first from e group by 1,2,3),
 p as (select *, lag(last) over z as pl, lag(ts_us) over z as pt, lead(first) over z as nl, lead(ts_us) over z as nt from w window z as (partition by direction, node order by ts_us))
 select trade.idx as qid, p.direction, case when pt is not null and nt is not null then pl::varchar end as prev_action, case when pt is not null and nt is not null then nl::varchar end as next_action,
 case when pt is not null and nt is not null then (p.ts_us-pt)/1e6 else 0 end as prev_gap, case when pt is not null and nt is not null then (nt-p.ts_us)/1e6 else 0 end as next_gap
 from trade join p on p.ts_us=trade.ts_us and p.node = case p.direction when 'out' then trade.u else trade.i end"""))
def prev_next_event(spark, sf):
    edges = trade_edges(spark, sf)
    actions = edges.select("idx", F.col("label").cast("string").alias("action_type"))
    sides = [(d, edges.select(F.col("idx").alias("qid"), F.col(n).alias("node"), "ts_us")) for d, n in (("out", "u"), ("in", "i"))]
    found = [nb.prev_next_event(edges, actions, queries).where(F.col("direction") == d) for d, queries in sides]
    return found[0].unionByName(found[1]).select("qid", "direction", "prev_action", "next_action", "prev_gap", "next_gap")


def log_edges(spark, sf):
    """Edges of the audit records from user to value, with their actions."""
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    return raw_logs(spark, sf).select(
        (F.col("ord") + 1).alias("idx"), F.col("pid").cast("long").alias("u"), (F.col("ppid").cast("long") + 100000).alias("i"), us.alias("ts_us"),
        F.col("action").alias("action_type"))


@query("prev_next_one_hot", sql("logs", body="""+ v as (select ['CREATE','DELETE','MODIFY','READ','RENAME','WRITE','MESSAGE','OPEN','START','LOAD','TERMINATE'] as names),
 e as (select ord + 1 as idx, cast(pid as bigint) as node, ts_us, action_type from logs),
 w as (select node, ts_us, arg_max(action_type, idx) as last, arg_min(action_type, idx) as first from e group by 1,2),
 p as (select *, lag(last) over z as pa, lead(first) over z as na from w window z as (partition by node order by ts_us))
 select e.idx as qid, case when pa is not null and na is not null then list_position(names, pa) - 1 end::int as prev_pos,
 case when pa is not null and na is not null then list_position(names, na) - 1 end::int as next_pos from e join p using (node, ts_us), v"""))
def prev_next_one_hot(spark, sf):
    edges = log_edges(spark, sf)
    queries = edges.select(F.col("idx").alias("qid"), F.col("u").alias("node"), "ts_us")
    found = nb.prev_next_event(edges.drop("action_type"), edges.select("idx", "action_type"), queries).where("direction = 'out'")
    place = lambda c: F.nullif(F.array_position(one_hot(c, ACTIONS), 1) - 1, F.lit(-1)).cast("int")
    return found.select("qid", place("prev_action").alias("prev_pos"), place("next_action").alias("next_pos"))


TWO_HOP = f"""+ {halves('tr')}, met as (select node, neighbor, min(ts_us) as first_us from hf group by 1,2),
 rk as (select *, row_number() over (partition by node order by first_us, neighbor) as rank from met),
 near as (select tr.idx, tr.u, tr.ts_us, rk.neighbor as via, rk.rank from tr join rk on rk.node=tr.u and rk.rank <= 100 and rk.first_us < tr.ts_us),
 far as (select near.*, o.neighbor as far from near join rk o on o.node=near.via and o.first_us < near.ts_us),
 firsts as (select idx, far, min(rank) as rank from far group by 1,2),
 stops as (select idx, rank, sum(count(*)) over (partition by idx order by rank) as total from firsts group by 1,2),
 stop as (select idx, min(rank) as rank from stops where total > 20 group by 1),
 taken as (select f.idx, f.far from firsts f left join stop s using (idx) where s.rank is null or f.rank <= s.rank),
 two as (select taken.idx, taken.far from taken join tr using (idx) where taken.far <> tr.u and not exists (select 1 from met where met.node=tr.u and met.neighbor=taken.far and met.first_us < tr.ts_us))"""


@query("two_hop_non_neighbors", sql("tr", body=TWO_HOP + """ select tr.idx, coalesce(string_agg(two.far, ';' order by two.far), '') as two_hop_non_neighbors
 from tr left join two using (idx) group by 1"""))
def two_hop_non_neighbors(spark, sf):
    found = nb.two_hop_non_neighbors(stored(transition_edges(spark, sf)))
    return found.select("idx", F.array_join("two_hop_non_neighbors", ";").alias("two_hop_non_neighbors"))


@query("two_hop_candidates", sql("tr", body=TWO_HOP + """ select tr.idx, count(two.far) as candidates from tr left join two using (idx) group by 1"""))
def two_hop_candidates(spark, sf):
    edges = stored(transition_edges(spark, sf))
    found = nb.two_hop_candidates(edges, nb.two_hop_sets(edges)).groupBy("idx").agg(F.count("*").alias("candidates"))
    return edges.select("idx").join(found, "idx", "left").select("idx", F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"))
