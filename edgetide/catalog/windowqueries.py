"""Window graphs and their features."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgetide.catalog.fixtures import flat_events, raw_logs, r6, sql, table
from edgetide.catalog.registry import query
from edgetide.functions.times import epoch_bucket
from edgetide.operators import windows as wn
from edgetide.operators.textfeatures import mean_token_vector
from edgetide.plans.ordered import row_numbers
from edgetide.session import finer, stored
from edgetide.schema import ACTIONS, NODE_TYPES

DAY = 24 * 60
VECTOR_ROWS = 50  # a text with the sums of its vectors is so many rows large in memory
WINDOW_SQL = """+ ev as (select hostname, ts_us, ord, id, actor_id as src, 'Process' as src_type, replace(object_id, 'o', 'p') as dst,
  upper(substr(object_type,1,1)) || lower(substr(object_type,2)) as dst_type, action_type, (action_type='TERMINATE' and ord%3=0)::int as label,
  ts_us - ts_us % 86400000000 as window_us from logs),
 mention as (select hostname, window_us, src as node, src_type as type, ord*2 as pl from ev union all select hostname, window_us, dst, dst_type, ord*2+1 from ev),
 first as (select hostname, window_us, node, arg_min(type, pl) as type from mention group by 1,2,3),
 we as (select ev.* from ev join first a on a.hostname=ev.hostname and a.window_us=ev.window_us and a.node=src and a.type=src_type
  join first b on b.hostname=ev.hostname and b.window_us=ev.window_us and b.node=dst and b.type=dst_type),
 side as (select hostname, window_us, ts_us, ord, action_type, label, src as node, src_type as node_type, 'out' as direction, dst as other, dst_type as other_type from we
  union all select hostname, window_us, ts_us, ord, action_type, label, dst, dst_type, 'in', src, src_type from we),
 wn as (select hostname, window_us, node, any_value(node_type) as node_type,
  coalesce(arg_max(ts_us, (ts_us, ord)) filter (where direction='in' and action_type in ('CREATE','START','LOAD','ADD','COMMAND','LOGIN')), min(ts_us) - 86400000000) as start_us,
  coalesce(arg_max(ts_us, (ts_us, ord)) filter (where direction='in' and action_type in ('DELETE','TERMINATE','REMOVE','LOGOUT')), min(ts_us) + 86400000000) as end_us,
  max(label) as red from side group by 1,2,3),
 wl as (select *, abs(end_us - start_us)/1000.0 as life from wn)"""


def windowed(spark, sf):
    """Daily windows. Files and shells share ids with processes here, so type mismatches happen."""
    flat = flat_events(spark, sf)
    kind = F.concat(F.upper(F.substring("object_type", 1, 1)), F.lower(F.substring("object_type", 2, 20)))
    bad = ((F.col("action_type") == "TERMINATE") & (F.col("ord") % 3 == 0)).cast("int")
    rows = flat.select(
        "hostname", "ts_us", "ord", "id", F.col("actor_id").alias("src"),
        F.replace("object_id", F.lit("o"), F.lit("p")).alias("dst"), kind.alias("dst_type"), "action_type", bad.alias("label"),
    )
    # records are parsed once and the graph is built once; every feature below reads it several times
    return stored(wn.drop_type_mismatch(stored(wn.window_edges(rows, DAY))))


@query("drop_type_mismatch", sql("logs", body=WINDOW_SQL + " select hostname, window_us, id, dst_type from we"))
def drop_type_mismatch(spark, sf):
    return windowed(spark, sf).select("hostname", "window_us", "id", "dst_type")


@query("node_lifetime", sql("logs", body=WINDOW_SQL + " select hostname, window_us, node, node_type, start_us, end_us, life as lifetime_ms from wl"))
def node_lifetime(spark, sf):
    return wn.window_nodes(windowed(spark, sf), DAY).drop("red")


@query("red_flag", sql("logs", body=WINDOW_SQL + " select hostname, window_us, node, red from wl where red=1"))
def red_flag(spark, sf):
    return wn.window_nodes(windowed(spark, sf), DAY).where("red = 1").select("hostname", "window_us", "node", "red")


@query("window_graph_info", sql("logs", body=WINDOW_SQL + """ select w.hostname, w.window_us, count(*) as edges, sum(label)::bigint as labels, min(ts_us) as first_us, max(ts_us) as last_us,
 (select count(distinct node) from side s where s.hostname=w.hostname and s.window_us=w.window_us) as nodes from we w group by 1,2"""))
def window_graph_info(spark, sf):
    return wn.window_graph_info(windowed(spark, sf))


@query("window_graph_size", sql("logs", body=WINDOW_SQL + """ select count(*) as windows, round(avg(n),6) as mean_nodes, round(avg(e),6) as mean_edges from
 (select hostname, window_us, count(*) as n from wl group by 1,2) join (select hostname, window_us, count(*) as e from we group by 1,2) using (hostname, window_us)"""))
def window_graph_size(spark, sf):
    found = wn.window_graph_size(windowed(spark, sf))
    return found.withColumns({c: r6(c) for c in ("mean_nodes", "mean_edges")})


DEGREES = """, dg as (select hostname, window_us, node, count(*) as degree, count(*) filter (where direction='in') as in_degree, count(*) filter (where direction='out') as out_degree
 from side where node_type='Process' group by 1,2,3)"""


@query("degree_features", sql("logs", body=WINDOW_SQL + DEGREES + " select * from dg"))
def degree_features(spark, sf):
    return wn.degree_features(windowed(spark, sf))


@query("window_degree_features", sql("logs", body=WINDOW_SQL + DEGREES + """ select hostname, window_us, max(degree) as max_degree, floor(avg(degree))::bigint as mean_degree,
 max(in_degree) as max_in_degree, floor(avg(in_degree))::bigint as mean_in_degree, max(out_degree) as max_out_degree, floor(avg(out_degree))::bigint as mean_out_degree from dg group by 1,2"""))
def window_degree_features(spark, sf):
    return wn.window_degree_features(wn.degree_features(windowed(spark, sf)))


def _listed(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


FREQ = f""", fr as (select hostname, window_us, node, case direction when 'out' then 0 else {len(ACTIONS)} end + list_position({_listed(ACTIONS)}, action_type) - 1 as pos from side where node_type='Process'
 union all select hostname, window_us, node, {2 * len(ACTIONS)} + case direction when 'out' then 0 else {len(NODE_TYPES)} end + list_position({_listed(NODE_TYPES)}, other_type) - 1 from side where node_type='Process')"""


@query("type_frequency_features", sql("logs", body=WINDOW_SQL + FREQ + " select hostname, window_us, node, pos::int as pos, count(*)::double as value from fr group by 1,2,3,4"))
def type_frequency_features(spark, sf):
    found = wn.type_frequency_features(windowed(spark, sf))
    return found.select("hostname", "window_us", "node", F.posexplode("frequencies").alias("pos", "value")).where(
        "value > 0").withColumn("value", F.col("value").cast("double"))


@query("window_type_frequency_features", sql("logs", body=WINDOW_SQL + FREQ + " select hostname, window_us, pos::int as pos, count(*)::double as value from fr group by 1,2,3"))
def window_type_frequency_features(spark, sf):
    found = wn.type_frequency_features(windowed(spark, sf), by=wn.KEY)
    return found.select(*wn.KEY, F.posexplode("frequencies").alias("pos", "value")).where("value > 0").withColumn(
        "value", F.col("value").cast("double"))


@query("lifetime_features", sql("logs", body=WINDOW_SQL + """ select hostname, window_us, round(least(15, min(life)),3) as min_life, round(max(life),3) as max_life, round(sum(life),3) as sum_life
 from wl where node_type='Process' group by 1,2"""))
def lifetime_features(spark, sf):
    found = wn.lifetime_features(wn.window_nodes(windowed(spark, sf), DAY))
    return found.withColumns({c: r6(c, 3) for c in ("min_life", "max_life", "sum_life")})


LIVES = f""", nl as (select side.hostname, side.window_us, side.node, case direction when 'out' then 0 else {len(NODE_TYPES)} end + list_position({_listed(NODE_TYPES)}, other_type) - 1 as pos, wl.life
 from side join wl on wl.hostname=side.hostname and wl.window_us=side.window_us and wl.node=side.other where side.node_type='Process')"""


@query("neighbor_lifetime_by_type", sql("logs", body=WINDOW_SQL + LIVES + " select hostname, window_us, node, pos::int as pos, round(avg(life),3) as value from nl group by 1,2,3,4 having avg(life) > 0"))
def neighbor_lifetime_by_type(spark, sf):
    edges = windowed(spark, sf)
    found = wn.neighbor_lifetime_by_type(edges, wn.window_nodes(edges, DAY))
    return found.select(*wn.KEY, "node", F.posexplode("lifetimes").alias("pos", "value")).where("value > 0").withColumn(
        "value", r6("value", 3))


@query("window_encoding", sql("logs", body=WINDOW_SQL + FREQ + DEGREES + LIVES + f""", enc as (
 select hostname, window_us, node, pos::int as pos, count(*)::double as value from fr group by 1,2,3,4 union all
 select hostname, window_us, node, unnest([70,71]), degree::double from dg union all select hostname, window_us, node, unnest([72,73]), in_degree::double from dg
 union all select hostname, window_us, node, unnest([74,75]), out_degree::double from dg
 union all select hostname, window_us, node, unnest([76,77,78]), life from wl where node_type='Process' and node in (select node from dg)
 union all select hostname, window_us, node, 79 + pos::int, avg(life) from nl group by 1,2,3,pos)
 select hostname, window_us, node, pos, round(value,3) as value from enc where value > 0"""))
def window_encoding(spark, sf):
    edges = windowed(spark, sf)
    found = wn.window_encoding(edges, wn.window_nodes(edges, DAY))
    return found.select(*wn.KEY, "node", F.posexplode("encoding").alias("pos", "value")).where("value > 0").withColumn(
        "value", r6("value", 3))


@query("window_encoding_totals", sql("logs", body=WINDOW_SQL + FREQ + DEGREES + LIVES + """, enc as (
 select hostname, window_us, pos::int as pos, count(*)::double as value from fr group by 1,2,3
 union all select hostname, window_us, 70, max(degree)::double from dg group by 1,2 union all select hostname, window_us, 71, floor(avg(degree)) from dg group by 1,2
 union all select hostname, window_us, 72, max(in_degree)::double from dg group by 1,2 union all select hostname, window_us, 73, floor(avg(in_degree)) from dg group by 1,2
 union all select hostname, window_us, 74, max(out_degree)::double from dg group by 1,2 union all select hostname, window_us, 75, floor(avg(out_degree)) from dg group by 1,2
 union all select hostname, window_us, 76, least(15, min(life)) from wl where node_type='Process' group by 1,2 union all select hostname, window_us, 77, max(life) from wl where node_type='Process' group by 1,2
 union all select hostname, window_us, 78, sum(life) from wl where node_type='Process' group by 1,2
 union all select hostname, window_us, 79 + pos::int, avg(life) from nl group by 1,2,pos)
 select hostname, window_us, pos, round(value,3) as value from enc where value > 0"""))
def window_encoding_totals(spark, sf):
    edges = windowed(spark, sf)
    found = wn.window_encoding(edges, wn.window_nodes(edges, DAY), level="window")
    return found.select(*wn.KEY, F.posexplode("encoding").alias("pos", "value")).where("value > 0").withColumn(
        "value", r6("value", 3))


# texts of processes as means of the vectors of their words; every seventh word has no vector
WORDS = r"""+ tx as (select distinct t from (select unnest([image_path, parent_image_path, command_line]) as t from logs where object_type='PROCESS') where t is not null),
 tk as (select t, unnest(string_split_regex(lower(t), '[^a-z0-9]+')) as token from tx),
 nm as (select token, row_number() over (order by token) - 1 as n from (select distinct token from tk where token <> '')),
 vc as (select token, list_transform(embedding, lambda x: x::double) as v from nm join embeddings on vec_id = n % (select count(*) from embeddings) where n % 7 <> 0),
 al as (select d, avg(x) as x from (select unnest(range(0,64)) as d, unnest(v) as x from vc) group by 1),
 kn as (select t, d, avg(x) as x from (select t, unnest(range(0,64)) as d, unnest(v) as x from tk join vc using (token)) group by 1,2),
 tv as (select tx.t, al.d, coalesce(kn.x, al.x) as x from tx cross join al left join kn on kn.t=tx.t and kn.d=al.d),
 p as (select hostname, ts_us - ts_us % 86400000000 as window_us, image_path, parent_image_path, command_line, sid, coalesce(contains(parent_image_path,'\Users\'), false) as pu,
  coalesce(contains(image_path,'\Users\'), false) as cu from logs where object_type='PROCESS'),
 ws as (select hostname, window_us, unnest([0,1,2]) as part, unnest([image_path, parent_image_path, command_line]) as t from p),
 parts as (select ws.hostname, ws.window_us, part*64 + g.d as pos, coalesce(tv.x, 0.0) as x from ws cross join (select unnest(range(0,64)) as d) g left join tv on tv.t=ws.t and tv.d=g.d),
 cnt as (select hostname, window_us, unnest(range(192,203)) as pos, unnest([coalesce(contains(sid,'S-1-5-18'),false), coalesce(contains(sid,'S-1-5-19'),false), coalesce(contains(sid,'S-1-5-20'),false),
  coalesce(contains(sid,'S-1-5-21'),false), false, false, sid is null, pu and cu, pu and not cu, not pu and cu, not pu and not cu])::int as x from p)
 select hostname, window_us, pos::int as pos, round(avg(x),6) as value from parts group by 1,2,3 union all select hostname, window_us, pos::int, sum(x)::double from cnt group by 1,2,3"""


def word_vectors(spark, sf, texts, dim):
    """(token, vec): the words of ``texts`` in order, each with the next embedding, but every seventh."""
    words = texts.select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("token")).where("token <> ''").distinct()
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    numbered = row_numbers(words, ["token"], "n", start=0).where("n % 7 <> 0").withColumn("_c", vectors.agg(F.count("*")).scalar())
    return numbered.withColumn("vec_id", F.pmod("n", "_c")).join(vectors, "vec_id").select("token", "vec")


@query("process_text_encoding", sql("logs", body=WORDS))
def process_text_encoding(spark, sf):
    parts = ["image_path", "parent_image_path", "command_line"]
    logs = raw_logs(spark, sf).where("object = 'PROCESS'")
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    rows = logs.select("hostname", (us - F.pmod(us, F.lit(86_400_000_000))).alias("window_us"), *[f"properties.{c}" for c in [*parts, "sid"]])
    # equal texts are encoded once
    texts = stored(rows.select(F.explode(F.array(*parts)).alias("text")).where("text is not null").distinct())
    tokens = texts.select(F.col("text").alias("id"), F.split(F.lower("text"), "[^a-z0-9]+").alias("tokens"))
    vocabulary = stored(word_vectors(spark, sf, texts, 64))
    with finer(spark, VECTOR_ROWS * texts.count()):
        encoded = stored(mean_token_vector(tokens, vocabulary, 64)).withColumnRenamed("id", "text")
    found = wn.process_text_encoding(rows, 64, encoded).select(*wn.KEY, F.posexplode("encoding").alias("pos", "value"))
    return found.withColumn("value", r6("value"))


@query("attach_window_features", sql("logs", body="""+ f as (select actor_id as node, ts_us // 86400000000 * 86400 as bucket, count(*)::double as a, max(ord)::double as b from logs group by 1,2),
 e as (select id, actor_id as src, replace(object_id,'o','p') as dst, ts_us // 86400000000 * 86400 as bucket from logs)
 select id, coalesce(s.a,0.0) as src_a, coalesce(s.b,0.0) as src_b, coalesce(d.a,0.0) as dst_a, (s.a is null)::int + (d.a is null)::int as missing
 from e left join f s on s.node=e.src and s.bucket=e.bucket left join f d on d.node=e.dst and d.bucket=e.bucket"""))
def attach_window_features(spark, sf):
    flat = flat_events(spark, sf).withColumn("bucket", epoch_bucket("ts_us", 86400))
    features = flat.groupBy(F.col("actor_id").alias("node"), "bucket").agg(
        F.array(F.count("*").cast("double"), F.max("ord").cast("double")).alias("vec")
    )
    edges = flat.select("id", F.col("actor_id").alias("src"), F.replace("object_id", F.lit("o"), F.lit("p")).alias("dst"), "bucket")
    found = wn.attach_window_features(edges, features, 2)
    return found.select("id", F.col("src_vec")[0].alias("src_a"), F.col("src_vec")[1].alias("src_b"),
                        F.col("dst_vec")[0].alias("dst_a"), "missing")


@query("process_attributes", sql("logs", body="""select object_id as node, arg_min(pid, ord) as pid, arg_min(ppid, ord) as ppid, arg_min(command_line, ord) filter (where command_line is not null) as command_line,
 arg_min(image_path, ord) filter (where image_path is not null) as image_path, arg_min(parent_image_path, ord) as parent_image_path from logs where object_type='PROCESS' group by 1"""))
def process_attributes(spark, sf):
    logs = raw_logs(spark, sf).where("object = 'PROCESS'")
    rows = logs.select("ord", F.col("objectID").alias("node"), "pid", "ppid", *[
        F.col(f"properties.{c}").alias(c) for c in ("command_line", "image_path", "parent_image_path")])
    return wn.process_attributes(rows, ["ord"])


@query("window_text_corpus", sql("logs", body="""+ t as (select ord, unnest([case when object_type='PROCESS' then command_line end, case when object_type='PROCESS' then parent_image_path end,
 case when object_type='FILE' then file_path end, image_path]) as text, unnest(['Process','Process','File', upper(substr(object_type,1,1)) || lower(substr(object_type,2))]) as node_type, action_type as action from logs)
 select text, node_type, action, count(*) as n from t where text is not null group by 1,2,3"""))
def window_text_corpus(spark, sf):
    return wn.window_text_corpus(raw_logs(spark, sf)).groupBy("text", "node_type", "action").agg(F.count("*").alias("n"))

