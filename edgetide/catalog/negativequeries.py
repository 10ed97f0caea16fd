"""Negative sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgetide.catalog.fixtures import (
    kv_edges, numbered_transitions, r6, sql, sql_digest, sql_draw, sql_permuted, transition_edges,
)
from edgetide.catalog.neighborhood import TWO_HOP
from edgetide.catalog.registry import query
from edgetide.operators import negatives as ng
from edgetide.operators.neighbors import two_hop_sets
from edgetide.plans.ordered import quantiles
from edgetide.session import stored

POOL = """su as (select u, row_number() over (order by u) - 1 as u_no from (select distinct u from {p})),
 si as (select i, row_number() over (order by i) - 1 as i_no from (select distinct i from {p}))"""
BATCHES = """own as (select distinct (idx-1)//{b} as batch, u, i from {e}),
 bt as (select (idx-1)//{b} as batch, count(*) as size, count(distinct (u,i)) as pairs, min(ts_us) as start_us from {e} group by 1)"""


def checked_sql(wanted: str, b: int) -> str:
    """Rows (batch, u, i) of checked random pairs for ``wanted`` (batch, need)."""
    return f"""known as (select batch, count(*) as n_own from own join su using (u) join si using (i) group by 1),
 ask as (select w.batch, w.need, coalesce(n_own, 0) as n_own, (select count(*) from su) as ns, (select count(*) from si) as nt from {wanted} w left join known using (batch) where need > 0),
 st as (select *, unnest(range(0, least(ns*nt, need + n_own))) as j from ask),
 sp as (select *, {sql_permuted('j', 'ns*nt', 0, 'batch')} as spot from st),
 pr as (select batch, need, ns*nt - n_own as free, j, su.u, si.i from sp join su on su.u_no = spot // nt join si on si.i_no = spot % nt),
 us as (select *, row_number() over (partition by batch order by j) as r from pr where not exists (select 1 from own where own.batch=pr.batch and own.u=pr.u and own.i=pr.i)),
 fill as (select batch, u, i from (select *, unnest(range(0, greatest(1, case when need > free then ceil((need - r + 1) / free::double)::bigint else 1 end))) as c from us where r <= need))"""


@query("random_negatives", sql("kv", body="+ " + POOL.format(p="kv") + f""" select idx, u, si.i, ts_us from
 (select idx, u, ts_us, {sql_draw(0, 'idx')} % (select count(*) from si) as i_no from kv) join si using (i_no)"""))
def random_negatives(spark, sf):
    edges = kv_edges(spark, sf)
    return ng.random_negatives(edges, edges)


@query("random_negatives_checked", sql("kv", body="+ " + POOL.format(p="kv") + ", " + BATCHES.format(b=256, e="kv")
       + ", want as (select batch, size as need from bt), " + checked_sql("want", 256) + " select batch, u, i from fill"))
def random_negatives_checked(spark, sf):
    edges = kv_edges(spark, sf)
    wanted = ng.batches(edges).select("batch", F.col("size").alias("need"))
    return ng.random_negatives_checked(edges, wanted, edges)


@query("random_negatives_small_space", sql("kv", body="+ " + POOL.format(p="(select u%4 as u, i%8 as i from kv)") + """,
 k2 as (select idx, u%4 as u, i%8 as i, ts_us from kv where (u%4 + i%8) % 3 <> 0), """ + BATCHES.format(b=64, e="k2")
       + ", want as (select batch, size as need from bt), " + checked_sql("want", 64) + " select batch, u, i, count(*) as n from fill group by 1,2,3"))
def random_negatives_small_space(spark, sf):
    edges = kv_edges(spark, sf).withColumn("u", F.col("u") % 4).withColumn("i", F.col("i") % 8)
    odd = edges.where((F.col("u") + F.col("i")) % 3 != 0)
    wanted = ng.batches(odd, 64).select("batch", F.col("size").alias("need"))
    found = ng.random_negatives_checked(odd, wanted, edges, size=64)
    return found.groupBy("batch", "u", "i").agg(F.count("*").alias("n"))


def prefix_sql(observed: str = "") -> str:
    low = f"(select count(*) from hist where first_us <= {observed})" if observed else "0"
    return "+ " + POOL.format(p="trn") + ", " + BATCHES.format(b=256, e="trn") + f""",
 hist as (select u, i, first_us, row_number() over (order by first_us, u, i) - 1 as spot from (select u, i, min(ts_us) as first_us from trn group by 1,2)),
 tb as (select bt.*, (select count(*) from hist where first_us <= start_us) as upto, {low} as low from bt),
 tb2 as (select *, greatest(upto - low, 0) as span from tb),
 hs as (select *, unnest(range(0, least(span, size + pairs))) as j from tb2 where span > 0),
 hp as (select batch, size, low + {sql_permuted('j', 'span', 0, 'batch')} as spot from hs),
 hc as (select hp.batch, hp.size, hist.u, hist.i from hp join hist using (spot) where not exists (select 1 from own where own.batch=hp.batch and own.u=hist.u and own.i=hist.i)),
 hk as (select *, row_number() over (partition by batch order by {sql_digest(0, 'batch', 'u', 'i')}, u, i) as r from hc),
 pref as (select batch, u, i from hk where r <= size),
 want as (select bt.batch, size - coalesce(n, 0) as need from bt left join (select batch, count(*) as n from pref group by 1) using (batch)), """ + checked_sql("want", 256) + """,
 neg as (select *, 'preferred' as source from pref union all select *, 'random' from fill)"""


@query("historical_negatives", sql("tr", "trn", body=prefix_sql() + " select * from neg"))
def historical_negatives(spark, sf):
    edges = numbered_transitions(spark, sf)
    return ng.historical_negatives(edges, edges)


@query("inductive_negatives", sql("tr", "trn", body=prefix_sql("(select floor(quantile_cont(ts_us, 0.4))::bigint from trn)") + " select * from neg"))
def inductive_negatives(spark, sf):
    edges = numbered_transitions(spark, sf)
    observed = int(quantiles(edges, "ts_us", {"t": 0.4}).first()["t"])
    return ng.inductive_negatives(edges, edges, observed)


@query("sampling_mix", sql("tr", "trn", body=prefix_sql() + """, b as (select batch, count(*) filter (where source='preferred') as p, count(*) as n from neg group by 1)
 select sum(p)::bigint as preferred, sum(n-p)::bigint as random, round(sum(p)/sum(n)::double,6) as preferred_share, round(avg(p/n::double),6) as mean_batch_share from b"""))
def sampling_mix(spark, sf):
    edges = numbered_transitions(spark, sf)
    found = ng.sampling_mix(ng.historical_negatives(edges, edges))
    return found.withColumns({c: r6(c) for c in ("preferred_share", "mean_batch_share")})


@query("popular_negatives", sql("tr", "trn", body="+ " + BATCHES.format(b=256, e="trn") + f""",
 tb as (select *, (select count(*) from trn where ts_us <= start_us) as n from bt), d as (select batch, n, unnest(range(1, size+1)) as j from tb where n > 0)
 select batch, j, a.u, b.i from (select batch, j, {sql_draw(0, "'src'", 'batch', 'j')} % n + 1 as su, {sql_draw(0, "'dst'", 'batch', 'j')} % n + 1 as si from d)
 join trn a on a.idx=su join trn b on b.idx=si"""))
def popular_negatives(spark, sf):
    edges = numbered_transitions(spark, sf)
    return ng.popular_negatives(edges, edges)


DIRECT = "exists (select 1 from met where met.node=h.u and met.neighbor=h.far and met.first_us < h.ts_us)"
TWICE = """exists (select 1 from rch r join met on met.node=r.via where r.idx=h.idx and r.rank < h.rank and met.neighbor=h.far and met.first_us < h.ts_us)"""


@query("two_hop_negatives", sql("tr", body=TWO_HOP + f""", l as (select idx, list(far order by far) as far from two group by 1),
 rch as (select n.idx, n.u, n.ts_us, n.rank, n.via, count(*) as offers from near n left join stop s using (idx) join rk o on o.node=n.via and o.first_us < n.ts_us
  where s.rank is null or n.rank <= s.rank group by all having count(*) > 1),
 sp as (select *, sum(offers) over (partition by idx order by rank) - offers as start from rch),
 tt as (select idx, sum(offers)::bigint as total from rch group by 1),
 tj as (select *, {sql_draw(0, 'idx', 'j')} % total as p from (select *, unnest(range(0, 4)) as j from tt)),
 h as (select sp.idx, sp.u, sp.ts_us, sp.rank, tj.j, o.neighbor as far from tj join sp on sp.idx=tj.idx and p >= start and p < start + offers join rk o on o.node=sp.via and o.rank = p - start + 1),
 ok as (select idx, arg_min(far, j) as far from h where far <> u and not {DIRECT} and not {TWICE} group by 1),
 si as (select i, row_number() over (order by i) - 1 as i_no from (select distinct i from tr)),
 d as (select tr.idx, tr.u, tr.ts_us, ok.far as pick, l.far, {sql_draw(0, 'tr.idx')} as n from tr left join l using (idx) left join ok using (idx))
 select d.idx, d.u, coalesce(pick, far[n % len(far) + 1], si.i) as i, d.ts_us, case when far is not null then 'preferred' else 'random' end as source
 from d join si on si.i_no = n % (select count(*) from si)"""))
def two_hop_negatives(spark, sf):
    edges = stored(transition_edges(spark, sf))
    return ng.two_hop_negatives(edges, two_hop_sets(edges), edges)


@query("replace_with_anomalies", sql("kv", body="+ " + POOL.format(p="kv") + f""", neg as (select (idx-1)//256 as batch, idx, u, si.i, ts_us from
 (select idx, u, ts_us, {sql_draw(0, 'idx')} % (select count(*) from si) as i_no from kv) join si using (i_no)),
 c as (select (idx-1)//256 as batch, count(*) filter (where label=0) - count(*) filter (where label=1) as room from kv group by 1),
 r as (select neg.*, row_number() over (partition by neg.batch order by idx) as r, room from neg join c using (batch))
 select (idx-1)//256 as batch, u, i, ts_us, (label=0)::int as target, case when label=0 then 'normal' else 'anomaly' end as kind from kv
 union all select batch, u, i, ts_us, 0, 'sampled' from r where r <= room"""))
def replace_with_anomalies(spark, sf):
    edges = kv_edges(spark, sf)
    drawn = ng.random_negatives(edges, edges).withColumn("batch", ng.batch_number())
    return ng.replace_with_anomalies(edges, drawn)
