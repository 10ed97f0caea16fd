"""Log statistics, labels, splits, hold-outs and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgetide.catalog.fixtures import (
    flat_events, kv_edges, malicious_ids, r6, scored_links, sql, sql_digest, trade_edges, transition_edges, unnumbered_trades,
)
from edgetide.catalog.registry import query
from edgetide.functions.times import epoch_bucket
from edgetide.operators import events as ev
from edgetide.operators import logstats, splits
from edgetide.plans.ordered import quantiles

QUANTILES = ["min", "q25", "median", "q75", "max"]


def cut_points(edges, low=0.7, high=0.85):
    """Two time quantiles as numbers (one row of two values)."""
    row = quantiles(edges, "ts_us", {"v": low, "t": high}).first()
    return row["v"], row["t"]


def quartile_sql(column: str) -> str:
    return ", ".join(
        f"round(quantile_cont({column}, {q}), 6) as {n}" for n, q in zip(QUANTILES, (0.0, 0.25, 0.5, 0.75, 1.0))
    )


# ------------------------------------------------------------------ raw event statistics
@query("label_edges", sql("logs", "malicious", body="""select l.id, cast(m.id is not null as int) as label from logs l
 left join malicious m on m.hostname=lower(l.hostname) and m.id=l.id"""))
def label_edges(spark, sf):
    flat = flat_events(spark, sf)
    return ev.label_edges(flat, malicious_ids(flat)).select("id", "label")


@query("action_counts", sql("logs", body="""select object_type, action_type, count(*) as n from logs
 group by grouping sets ((object_type, action_type), (object_type))"""))
def action_counts(spark, sf):
    return logstats.action_counts(flat_events(spark, sf))


ENTITY = """+ e as (select 'PROCESS' as object_type, actor_id as id from logs union all select object_type, object_id from logs),
 c as (select object_type, id, count(*) as n from e group by 1,2)"""


@query("entity_log_counts", sql("logs", body=ENTITY + " select * from c"))
def entity_log_counts(spark, sf):
    return logstats.entity_log_counts(flat_events(spark, sf))


@query("entity_count_distribution", sql("logs", body=ENTITY + f""", a as (select object_type, count(*) as total_actions from logs group by 1)
 select object_type, {quartile_sql('n')}, round(avg(n), 6) as mean, count(*) as num_objects, cast(sum(n) as bigint) as total_logs, max(total_actions) as total_actions,
 cast(object_type <> 'PROCESS' and sum(n) <> max(total_actions) as int) as mismatch from c join a using (object_type) group by 1"""))
def entity_count_distribution(spark, sf):
    found = logstats.entity_count_distribution(flat_events(spark, sf))
    return found.withColumns({c: r6(c) for c in [*QUANTILES, "mean"]})


@query("type_conflicts", sql("logs", body="""select object_id, string_agg(object_type, ',' order by object_type) as types
 from (select distinct object_id, object_type from logs) group by 1 having count(*) > 1"""))
def type_conflicts(spark, sf):
    return logstats.type_conflicts(flat_events(spark, sf)).select("object_id", F.array_join("types", ",").alias("types"))


@query("cross_role_processes", sql("logs", body="""+ p as (select * from logs where object_type='PROCESS')
 select distinct actor_id as id from logs where actor_id in (select object_id from p)
 and (actor_id in (select actor_id from logs where actor_id<>object_id) or actor_id in (select object_id from p where actor_id<>object_id))"""))
def cross_role_processes(spark, sf):
    return logstats.cross_role_processes(flat_events(spark, sf))


ADJACENCY = "+ adj as (select distinct actor_id as src, object_id as dst from logs where object_type='PROCESS' and actor_id<>object_id)"


@query("process_adjacency", sql("logs", body=ADJACENCY + " select * from adj"))
def process_adjacency(spark, sf):
    return logstats.process_adjacency(flat_events(spark, sf))


@query("process_path_counts", sql("logs", body=ADJACENCY + """ select
 (select count(*) from adj a join adj b on a.dst=b.src) as length_2,
 (select cast(sum(x.n * y.n) as bigint) from adj a join (select dst, count(*) as n from adj group by 1) x on x.dst=a.src
  join (select src, count(*) as n from adj group by 1) y on y.src=a.dst) as length_3"""))
def process_path_counts(spark, sf):
    return logstats.process_path_counts(logstats.process_adjacency(flat_events(spark, sf)))


@query("anomalies_by_client_day", sql("logs", body="""select lower(hostname) as client, substr(timestamp,1,10) as day, count(*) as n
 from logs where action_type='TERMINATE' group by 1,2"""))
def anomalies_by_client_day(spark, sf):
    return logstats.anomalies_by_client_day(flat_events(spark, sf).where("action_type = 'TERMINATE'"))


@query("malicious_entities", sql("logs", "malicious", body="""+ bad as (select l.* from logs l join malicious m on m.hostname=lower(l.hostname) and m.id=l.id)
 select hostname, actor_id as id from bad union select hostname, object_id from bad where object_type='PROCESS'"""))
def malicious_entities(spark, sf):
    flat = flat_events(spark, sf)
    return logstats.malicious_entities(ev.label_edges(flat, malicious_ids(flat)).where("label = 1"))


@query("malicious_windows", sql("logs", body="""select distinct hostname, ts_us - ts_us % 900000000 as start_us from logs
 where action_type='TERMINATE'"""))
def malicious_windows(spark, sf):
    bad = flat_events(spark, sf).where("action_type = 'TERMINATE'")
    return logstats.malicious_windows(bad).select("hostname", F.unix_micros("window_start").alias("start_us"))


@query("window_label", sql("logs", "malicious", body="""+ w as (select distinct hostname, ts_us - ts_us % 900000000 + 300000000 as start_us from logs),
 m as (select l.hostname, l.ts_us from logs l join malicious m on m.hostname=lower(l.hostname) and m.id=l.id)
 select hostname, start_us, start_us + 900000000 as end_us, cast(exists (select 1 from m where m.hostname=w.hostname
 and m.ts_us >= w.start_us and m.ts_us < w.start_us + 900000000) as int) as label from w"""))
def window_label(spark, sf):
    flat = flat_events(spark, sf)
    start = F.col("ts_us") - F.col("ts_us") % 900000000 + 300000000
    windows = flat.select("hostname", start.alias("start_us")).distinct().withColumn("end_us", F.col("start_us") + 900000000)
    bad = ev.label_edges(flat, malicious_ids(flat)).where("label = 1").select("hostname", "ts_us")
    return logstats.window_label(windows, bad)


@query("first_non_null_attr", sql("logs", body="""select actor_id, arg_min(image_path, ord) filter (where image_path is not null) as image_path,
 arg_min(command_line, ord) filter (where command_line is not null) as command_line from logs group by 1"""))
def first_non_null_attr(spark, sf):
    flat = flat_events(spark, sf)
    return flat.groupBy("actor_id").agg(*[ev.first_non_null(c, ["ord"]).alias(c) for c in ("image_path", "command_line")])


# ------------------------------------------------------------------ splits
@query("time_split", sql("trade", body="""+ c as (select quantile_disc(ts_us,0.7) as tv, quantile_disc(ts_us,0.85) as tt, max(ts_us) as te, min(ts_us) as t0 from trade)
 select case when ts_us>=t0 and ts_us<=tv then 'train' when ts_us>tv and ts_us<=tt then 'val' when ts_us>tt and ts_us<=te then 'test' end as split,
 count(*) as n, min(idx) as first, max(idx) as last from trade, c group by 1"""))
def time_split(spark, sf):
    edges = trade_edges(spark, sf)
    tv, tt = (int(x) for x in cut_points_low(edges))
    bounds = edges.agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b")).first()
    split = splits.time_split(train_start=bounds["a"], val_start=tv, test_start=tt, test_end=bounds["b"])
    return edges.groupBy(split.alias("split")).agg(
        F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last")
    )


def cut_points_low(edges):
    """The same quantiles, moved down to an observed time."""
    v, t = cut_points(edges)
    row = edges.agg(
        F.min(F.when(F.col("ts_us") >= v, F.col("ts_us"))).alias("v"), F.min(F.when(F.col("ts_us") >= t, F.col("ts_us"))).alias("t")
    ).first()
    return row["v"], row["t"]


@query("half_open_split", sql("trade", body="""+ c as (select quantile_disc(ts_us,0.7) as tv, quantile_disc(ts_us,0.85) as tt from trade)
 select case when ts_us<tv then 'train' when ts_us<tt then 'val' else 'test' end as split, count(*) as n from trade, c group by 1"""))
def half_open_split(spark, sf):
    edges = trade_edges(spark, sf)
    tv, tt = (int(x) for x in cut_points_low(edges))
    return edges.groupBy(splits.half_open_split(val_start=tv, test_start=tt).alias("split")).agg(F.count("*").alias("n"))


@query("entity_split", sql("logs", body="""select case when t < '2024-01-10T12' then case when t >= '2024-01-03' then 'train' end
 when t < '2024-01-20' then case when t <= '2024-01-15' then 'val' end else 'test' end as split, count(*) as n
 from (select timestamp as t from logs) group by 1"""))
def entity_split(spark, sf):
    split = splits.entity_split(
        "timestamp", val_start="2024-01-10T12", test_start="2024-01-20", entity_start="2024-01-03", entity_end="2024-01-15"
    )
    return flat_events(spark, sf).groupBy(split.alias("split")).agg(F.count("*").alias("n"))


SPLIT = """+ c as (select quantile_cont(ts_us,0.7) as tv, quantile_cont(ts_us,0.85) as tt from {g}),
 s as (select {g}.*, case when ts_us<=tv then 'train' when ts_us<=tt then 'val' else 'test' end as split from {g}, c)"""
KV_SPLIT, TR_SPLIT, TRADE_SPLIT = (SPLIT.format(g=g) for g in ("kv", "tr", "trade"))


@query("quantile_split", sql("trade", body=TRADE_SPLIT + " select split, count(*) as n, min(idx) as first from s group by 1"))
def quantile_split(spark, sf):
    found = splits.quantile_split(trade_edges(spark, sf), 0.15, 0.15)
    return found.groupBy("split").agg(F.count("*").alias("n"), F.min("idx").alias("first"))


HOLDOUT = KV_SPLIT + f""", late as (select distinct node from (select u as node, split from s union all select i, split from s) where split <> 'train'),
 total as (select count(distinct node) as n from (select u as node from kv union all select i from kv)),
 held as (select node from (select node, row_number() over (order by {sql_digest(2020, 'node')}, node) as r from late), total where r <= floor(0.1*n))"""


@query("inductive_holdout", sql("kv", body=HOLDOUT + """ select idx, u, i from s where split='train'
 and u not in (select node from held) and i not in (select node from held)"""))
def inductive_holdout(spark, sf):
    edges = splits.quantile_split(kv_edges(spark, sf), 0.15, 0.15)
    last = edges.where("split = 'train'").agg(F.max("ts_us")).first()[0]
    end = edges.agg(F.max("ts_us") + 1).first()[0]
    held = splits.inductive_holdout(edges, last, end)
    return splits.without_nodes(edges.where("split = 'train'"), held).select("idx", "u", "i")


@query("calibration_holdout", sql("kv", body=KV_SPLIT + f""" select idx from (select idx, row_number() over (order by {sql_digest(2020, 'idx')}, idx) as r
 from s where split='train') where r <= (select floor(0.1*count(*)) from s where split='train')"""))
def calibration_holdout(spark, sf):
    train = splits.quantile_split(kv_edges(spark, sf), 0.15, 0.15).where("split = 'train'")
    return splits.calibration_holdout(train.select("idx", "u", "i", "ts_us")).select("idx")


EARLY = """+ c as (select quantile_cont(ts_us,0.05) as t from tr), train as (select tr.* from tr, c where ts_us<=t),
 known as (select u as node from train union select i from train)"""


def early(edges, share):
    limit = quantiles(edges, "ts_us", {"t": share}).scalar()
    return edges.withColumn("_t", limit).where("ts_us <= _t").drop("_t")


@query("new_node_edges", sql("tr", body=EARLY.replace("0.05", "0.01") + """ select idx, u, i from tr, c
 where ts_us > t and (u not in (select node from known) or i not in (select node from known))"""))
def new_node_edges(spark, sf):
    edges = transition_edges(spark, sf)
    train = early(edges, 0.01)
    return splits.new_node_edges(edges.join(train.select("idx"), "idx", "left_anti"), train).select("idx", "u", "i")


@query("leakage_levels", sql("tr", body=EARLY.replace("0.05", "0.01") + """ select case (u in (select node from known))::int + (i in (select node from known))::int
 when 2 then 'both' when 1 then 'one' else 'none' end as level, count(*) as n from tr where label=1 group by 1"""))
def leakage_levels(spark, sf):
    edges = transition_edges(spark, sf)
    return splits.leakage_levels(edges.where("label = 1"), early(edges, 0.01))


@query("inject_first_edges", sql("tr", body=EARLY.replace("0.05", "0.002") + """, odd as (select u as node from tr where label=1 union select i from tr where label=1),
 missing as (select node from odd where node not in (select node from known)),
 pick as (select node, coalesce((select min(idx) from tr where u=node), (select min(idx) from tr where i=node)) as idx from missing)
 select idx, u, i from tr where idx in (select idx from train) or idx in (select idx from pick)"""))
def inject_first_edges(spark, sf):
    edges = transition_edges(spark, sf)
    return splits.inject_first_edges(edges, early(edges, 0.002)).select("idx", "u", "i")


# ------------------------------------------------------------------ sanity statistics
@query("split_stats", sql("trade", body=TRADE_SPLIT + """ select split, count(*) as num_edges, (select count(distinct node) from
 (select split as sp, u as node from s union all select split, i from s) where sp=split) as unique_nodes, count(distinct (u,i)) as unique_edges from s group by 1"""))
def split_stats(spark, sf):
    return splits.split_stats(splits.quantile_split(trade_edges(spark, sf), 0.15, 0.15))


NODE_STATS = TRADE_SPLIT + """, e as (select split, u as node, ts_us, 1 as src, 0 as dst from s union all select split, i, ts_us, 0, 1 from s),
 st as (select split, node, cast(sum(src) as bigint) as src_edges, cast(sum(dst) as bigint) as dst_edges, count(*) as total, count(distinct ts_us) as distinct_ts,
 max(ts_us)-min(ts_us) as span_us from e group by 1,2)"""


@query("node_stats", sql("trade", body=NODE_STATS + " select * from st"))
def node_stats(spark, sf):
    return splits.node_stats(splits.quantile_split(unnumbered_trades(spark, sf), 0.15, 0.15))


@query("metric_distribution", sql("trade", body=NODE_STATS + f""", long as (unpivot st on src_edges, dst_edges, total, distinct_ts, span_us into name metric value value)
 select split, metric, {quartile_sql('value')}, round(avg(value), 3) as mean from long group by 1,2"""))
def metric_distribution(spark, sf):
    stats = splits.node_stats(splits.quantile_split(unnumbered_trades(spark, sf), 0.15, 0.15))
    found = splits.metric_distribution(stats)
    return found.withColumns({c: r6(c) for c in QUANTILES}).withColumn("mean", r6("mean", 3))


@query("novelty_vs_train", sql("trade", body=TRADE_SPLIT + """, n as (select distinct split, node from (select split, u as node from s union all select split, i from s)),
 e as (select distinct split, u, i from s)
 select a.split, (select count(*) from n where n.split=a.split and node not in (select node from n where split='train')) as new_nodes,
 (select count(*) from e where e.split=a.split and not exists (select 1 from e t where t.split='train' and t.u=e.u and t.i=e.i)) as new_edges
 from (select distinct split from s where split<>'train') a"""))
def novelty_vs_train(spark, sf):
    return splits.novelty_vs_train(splits.quantile_split(trade_edges(spark, sf), 0.15, 0.15))


BUCKETS = "+ b as (select *, ts_us // 86400000000 * 86400 as bucket from kv), cnt as (select bucket, count(*) as events, sum(label) as anomalies from b group by 1)"
VAL_START, TEST_START = 1705276800, 1706140800


def daily(spark, sf):
    return kv_edges(spark, sf).withColumn("bucket", epoch_bucket("ts_us", 86400))


@query("valid_buckets", sql("kv", body=BUCKETS + f""" select idx, bucket from b join cnt using (bucket)
 where bucket >= 1704153600 and (bucket >= {VAL_START} or events >= 330)"""))
def valid_buckets(spark, sf):
    return splits.valid_buckets(daily(spark, sf), VAL_START, 330, start=1704153600).select("idx", "bucket")


@query("bucket_histogram", sql("kv", body=BUCKETS + f""" select bucket, events,
 cast(case when bucket < {VAL_START} and events < 330 then 0 else anomalies end as bigint) as anomalies,
 cast(bucket < {VAL_START} and events < 330 as int) as excluded from cnt"""))
def bucket_histogram(spark, sf):
    return splits.bucket_histogram(daily(spark, sf), VAL_START, 330)


@query("split_details", sql("kv", body=BUCKETS + f""", p as (select *, case when bucket<{VAL_START} then 'train' when bucket<{TEST_START} then 'val' else 'test' end as split from cnt)
 select split, cast(sum(events) as bigint) as events, cast(sum(anomalies) as bigint) as anomalies, count(*) as buckets,
 cast(floor((case split when 'train' then {VAL_START} - min(bucket) when 'val' then {TEST_START} - {VAL_START} else max(bucket) + 1 - {TEST_START} end) / 86400) as bigint) as expected_buckets,
 count(*) filter (where anomalies > 0) as anomalous_buckets, round(100.0 * sum(events) / (select count(*) from kv), 6) as percent from p group by 1"""))
def split_details(spark, sf):
    return splits.split_details(daily(spark, sf), VAL_START, TEST_START, 86400).withColumn("percent", r6("percent"))


# ------------------------------------------------------------------ set operations
@query("node_set", sql("tr", body="select u as node from tr union select i from tr"))
def node_set(spark, sf):
    return splits.node_set(transition_edges(spark, sf))


@query("edge_difference", sql("kv", body=KV_SPLIT + " select distinct u, i from s where split='train' except select u, i from s where split<>'train'"))
def edge_difference(spark, sf):
    edges = splits.quantile_split(kv_edges(spark, sf), 0.15, 0.15)
    return splits.edge_difference(edges.where("split = 'train'"), edges.where("split = 'val'"), edges.where("split = 'test'"))


@query("history_as_of_batch", sql("kv", body="select idx from kv where (idx-1)//256 < 20"))
def history_as_of_batch(spark, sf):
    edges = kv_edges(spark, sf).withColumn("batch", ev.batch_number())
    return splits.history_as_of_batch(edges, 20).select("idx")


@query("positives_union_negatives", sql("scored", body="""select idx, round(score,6) as score, cast(label=0 as int) as label from scored"""))
def positives_union_negatives(spark, sf):
    links = scored_links(spark, sf)
    both = splits.positives_union_negatives(links.where("label = 0"), links.where("label = 1"))
    return both.select("idx", r6("score").alias("score"), "label")
