"""Sources, scalar functions and numbering."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.catalog.fixtures import (
    features_of, flat_events, kv_edges, malicious_ids, r6, raw_logs, scored_links, sql, table, trade_edges,
    transition_edges,
)
from edgetide.catalog.registry import query
from edgetide.functions import codes, text, times, vectors
from edgetide.operators import events as ev
from edgetide.operators.metrics import squash_scores
from edgetide.operators.windows import node_key, orient_process_create
from edgetide.plans.ordered import row_numbers
from edgetide.session import scratch_folder
from edgetide.sources import logs as log_source
from edgetide.sources import tables as table_source

FLAT = ["id", "hostname", "timestamp", "actor_id", "object_id", "object_type", "action_type", "image_path", "file_path",
        "command_line"]


def scratch(spark: SparkSession) -> str:
    return f"{scratch_folder(spark)}/tables-{uuid.uuid4().hex}"


def elements(df: DataFrame, key: str, column: str, digits: int = 6) -> DataFrame:
    """One row per array element: key, pos, value."""
    return df.select(key, F.posexplode(column).alias("pos", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), digits)
    )


# ------------------------------------------------------------------ sources and sinks
@query("read_logs", sql("logs", body=f"select {', '.join(FLAT)} from logs"))
def read_logs(spark, sf):
    folder = scratch(spark)
    raw_logs(spark, sf).drop("ord").write.option("compression", "gzip").json(folder)
    return ev.filter_events(ev.extract_fields(log_source.read_logs(spark, folder))).select(*FLAT)


@query("select_client_files", """select distinct name from (select 'ecar-2019-09-' || (14 + event_id % 9) || '-SysClient0'
 || (200 + user_id % 3) || case when event_id % 11 = 0 then '-Label' else '' end || '.json' as name from events)
 where upper(name) like '%SYSCLIENT0201%' and name like '%2019%' and name not like '%Label%' and name not like '%canada%'
 and name not like '%09-16%' and name not like '%09-17%' and name not like '%09-18%'""")
def select_client_files(spark, sf):
    number, user = F.col("event_id"), F.col("user_id")
    name = F.concat(
        F.lit("ecar-2019-09-"), (number % 9 + 14).cast("string"), F.lit("-SysClient0"), (user % 3 + 200).cast("string"),
        F.when(number % 11 == 0, "-Label").otherwise(""), F.lit(".json"),
    )
    names = table(spark, sf, "events").select(name.alias("name"))
    return names.where(log_source.selected_file(F.col("name"), "201")).distinct()


@query("read_label_ids", sql("logs", body="select lower(hostname) as hostname, id from logs where action_type='TERMINATE'"))
def read_label_ids(spark, sf):
    folder = scratch(spark)
    raw_logs(spark, sf).where("action = 'TERMINATE'").drop("ord").write.json(folder)
    return log_source.read_label_ids(spark, folder)


GRAPH_SQL = """+ seen as (select object_type, id, pl, path from (
   select 'PROCESS' as object_type, actor_id as id, ord*2 as pl, image_path as path from logs union all
   select object_type, object_id, ord*2+1, file_path from logs)),
 firsts as (select object_type, id, min(pl) as first, arg_min(path, pl) filter (where path is not null) as path from seen group by 1,2),
 ids as (select *, row_number() over (order by first) as node_id from firsts)"""


@query("write_read_tables", sql("logs", "malicious", body=GRAPH_SQL + """
 select a.node_id as u, b.node_id as i, l.ts_us, cast(m.id is not null as int) as label,
 row_number() over (order by l.ts_us, l.ord) as idx, l.action_type, l.command_line
 from logs l join ids a on a.object_type='PROCESS' and a.id=l.actor_id join ids b on b.object_type=l.object_type and b.id=l.object_id
 left join malicious m on m.hostname=lower(l.hostname) and m.id=l.id"""))
def write_read_tables(spark, sf):
    flat = flat_events(spark, sf)
    graph = ev.build_graph(ev.label_edges(flat, malicious_ids(flat)), ["ord"])
    folder = scratch(spark)
    table_source.write_tables(graph, folder)
    read = table_source.read_tables(spark, folder)
    return read["edges"].join(read["edge_features"], "idx")


# every host a graph of its own: ids from 1 per host
HOST_SQL = GRAPH_SQL.replace("object_type, id, pl, path from (", "hostname, object_type, id, pl, path from (").replace(
    "select 'PROCESS'", "select lower(hostname) as hostname, 'PROCESS'").replace("select object_type, object_id, ord*2+1", "select lower(hostname), object_type, object_id, ord*2+1").replace(
    "select object_type, id, min(pl)", "select hostname, object_type, id, min(pl)").replace("group by 1,2)", "group by 1,2,3)").replace("over (order by first)", "over (partition by hostname order by first)")
HOST_EDGES = """, he as (select lower(l.hostname) as hostname, a.node_id as u, b.node_id as i, l.ts_us, cast(m.id is not null as int) as label,
 row_number() over (partition by lower(l.hostname) order by l.ts_us, l.ord) as idx, l.action_type, l.command_line
 from logs l join ids a on a.hostname=lower(l.hostname) and a.object_type='PROCESS' and a.id=l.actor_id join ids b on b.hostname=lower(l.hostname) and b.object_type=l.object_type and b.id=l.object_id
 left join malicious m on m.hostname=lower(l.hostname) and m.id=l.id) """


def host_graph(spark, sf):
    flat = flat_events(spark, sf)
    return ev.build_graph(ev.label_edges(flat, malicious_ids(flat)), ["ord"], host="hostname")


@query("write_read_host_tables", sql("logs", "malicious", body=HOST_SQL + HOST_EDGES + "select * from he where hostname in ('host1', 'host3')"))
def write_read_host_tables(spark, sf):
    folder = scratch(spark)
    table_source.write_graph(host_graph(spark, sf), folder)
    read = table_source.read_tables(spark, folder, hosts=["Host1", "host3"])
    return read["edges"].join(read["edge_features"], ["hostname", "idx"])


@query("write_read_host_tables_csv", sql("logs", "malicious", body=HOST_SQL + HOST_EDGES + "select he.*, s.path as src_path, d.path as dst_path from he join ids s on s.hostname=he.hostname and s.node_id=u join ids d on d.hostname=he.hostname and d.node_id=i"))
def write_read_host_tables_csv(spark, sf):
    folder = scratch(spark)
    table_source.write_graph(host_graph(spark, sf), folder, "csv")
    hosts = [f"host{n}" for n in range(5)]
    read = table_source.read_tables(spark, folder, format="csv", hosts=hosts)
    paths = {side: read["nodes"].select("hostname", F.col("node_id").alias(side), F.col("path").alias(name)) for side, name in (("u", "src_path"), ("i", "dst_path"))}
    joined = read["edges"].join(read["edge_features"], ["hostname", "idx"])
    return joined.join(paths["u"], ["hostname", "u"]).join(paths["i"], ["hostname", "i"])


# logs of three clients in files by day; the files of one client and the wanted days are read
FILED = """select id, hostname, actor_id, object_id, action_type from (select *, 'ecar-2019-09-' || (14 + ord % 9) || '-SysClient0'
 || (200 + cast(pid as bigint) % 3) || case when ord % 11 = 0 then '-Label' else '' end as name from logs)
 where upper(name) like '%SYSCLIENT0201%' and name like '%2019%' and name not like '%Label%' and name not like '%canada%'
 and name not like '%09-16%' and name not like '%09-17%' and name not like '%09-18%'"""


@query("read_client_logs", sql("logs", body=FILED))
def read_client_logs(spark, sf):
    folder = scratch(spark)
    logs = raw_logs(spark, sf)
    name = F.concat(
        F.lit("ecar-2019-09-"), (F.col("ord") % 9 + 14).cast("string"), F.lit("-SysClient0"), (F.col("pid").cast("long") % 3 + 200).cast("string"),
        F.when(F.col("ord") % 11 == 0, "-Label").otherwise(""))
    log_source.write_log_files(logs.withColumn("file", name).drop("ord"), folder, "file")
    found = log_source.read_client_logs(spark, folder, "201", part=-2)
    return found.select("id", "hostname", F.col("actorID").alias("actor_id"), F.col("objectID").alias("object_id"), F.col("action").alias("action_type"))


@query("compare_features", """select (select count(*) from embeddings) as left_rows, 64 as left_width, (select round(min(list_min(embedding))::double, 6) from embeddings) as left_low,
 (select round(max(list_max(embedding))::double, 6) from embeddings) as left_high, count(*) as right_rows, 64 as right_width, round(min(list_min(embedding))::double, 6) as right_low,
 round(max(list_max(embedding))::double, 6) as right_high, 0 as equal from embeddings where label = 1""")
def compare_features(spark, sf):
    vectors = table(spark, sf, "embeddings")
    found = table_source.compare_features(vectors, vectors.where("label = 1"), "embedding")
    return found.withColumns({c: r6(c) for c in ("left_low", "left_high", "right_low", "right_high")})


@query("read_interactions_csv", sql("kv", body="""select u, i, ts_us, label, round(idx * 0.5, 6) as f1,
 round(cast(u as double), 6) as f2 from kv"""))
def read_interactions_csv(spark, sf):
    folder = scratch(spark)
    rows = kv_edges(spark, sf).select(
        "u", "i", (F.col("ts_us") / 1e6).alias("ts"), "label", (F.col("idx") * 0.5).alias("f1"),
        F.col("u").cast("double").alias("f2"),
    )
    rows.write.option("header", True).csv(folder)
    read = table_source.read_interactions_csv(spark, folder, 2)
    return read.select("u", "i", "ts_us", "label", r6(F.col("features")[0]).alias("f1"), r6(F.col("features")[1]).alias("f2"))


@query("time_order_violations", sql("trade", body="""select count(*) as violations from (select
 ts_us, lag(ts_us) over (order by idx % 1000, idx) as p from trade) where p > ts_us"""))
def time_order_violations(spark, sf):
    rows = trade_edges(spark, sf).withColumn("slot", F.col("idx") % 1000)
    return table_source.time_order_violations(rows, ["slot", "idx"])


@query("write_read_scores", sql("scored", body="""select idx, src, dst, score, ts_us, case when label=1 then 'test' else 'val' end as split,
 case when idx%2=0 then 'random' else 'historical' end as negative_source from scored where label=1"""))
def write_read_scores(spark, sf):
    folder = scratch(spark)
    split = F.when(F.col("label") == 1, "test").otherwise("val")
    source = F.when(F.col("idx") % 2 == 0, "random").otherwise("historical")
    table_source.write_scores(
        scored_links(spark, sf).withColumn("split", split).withColumn("negative_source", source).drop("label"), folder
    )
    return table_source.read_scores(spark, folder, "test")


@query("write_report", sql("scored", body="select count(*) as links, round(avg(score),6) as mean_score from scored"))
def write_report(spark, sf):
    folder = scratch(spark)
    metrics = scored_links(spark, sf).agg(F.count("*").alias("links"), r6(F.avg("score")).alias("mean_score"))
    table_source.write_report(metrics, folder)
    return spark.read.schema("links long, mean_score double").json(folder)


@query("table_profile", sql("kv", body="""select (select count(distinct i) from kv) as num_nodes, count(*) as num_edges,
 cast((select max(len(embedding)) from embeddings) as int) as node_dim, 0 as edge_dim from kv"""))
def table_profile(spark, sf):
    edges = kv_edges(spark, sf)
    found = table_source.table_profile(edges, edges.select("i").distinct())
    vectors_ = table_source.table_profile(edges, table(spark, sf, "embeddings"), node_vector="embedding")
    return found.drop("node_dim").withColumn("node_dim", vectors_.select("node_dim").scalar())


@query("assert_tables_equal", sql("kv", body="""select (select count(*) from kv where label=1) as only_left,
 cast(0 as bigint) as only_right"""))
def assert_tables_equal(spark, sf):
    edges = kv_edges(spark, sf)
    return table_source.assert_tables_equal(edges, edges.where("label = 0"))


# ------------------------------------------------------------------ scalar functions
@query("extract_fields", sql("logs", body=f"select {', '.join(FLAT)} from logs"))
def extract_fields(spark, sf):
    return ev.extract_fields(raw_logs(spark, sf)).select(*FLAT)


@query("filter_events", sql("logs", body="""select id, actor_id, object_id, object_type from logs
 where object_type in ('PROCESS','SHELL') and ord%4<>0"""))
def filter_events(spark, sf):
    flat = ev.extract_fields(raw_logs(spark, sf))
    holed = flat.withColumn("actor_id", F.when(F.col("id").cast("long") % 4 != 0, F.col("actor_id")))
    return ev.filter_events(holed, ["PROCESS", "SHELL"]).select("id", "actor_id", "object_id", "object_type")


@query("parse_ts", sql("logs", body="select id, ts_us from logs"))
def parse_ts(spark, sf):
    return raw_logs(spark, sf).select("id", times.micros(times.parse_ts("timestamp")).alias("ts_us"))


@query("fix_fraction", """select event_id, epoch_us(date_trunc('second', ts)) + (event_id % 10) * 100000 + 14400000000 as ts_us
 from events""")
def fix_fraction(spark, sf):
    whole = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.concat(whole, F.lit("."), (F.col("event_id") % 10).cast("string"), F.lit("-04:00"))
    return table(spark, sf, "events").select("event_id", times.micros(times.parse_ts(stamp)).alias("ts_us"))


@query("shift_minutes", "select event_id, epoch_us(ts) + 900000000 as ts_us from events")
def shift_minutes(spark, sf):
    moved = times.shift_minutes(F.col("ts").cast("timestamp"), 15)
    return table(spark, sf, "events").select("event_id", times.micros(moved).alias("ts_us"))


@query("duration_ms", """select event_id, round(abs(epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1000.0, 3) as ms
 from events""")
def duration_ms(spark, sf):
    stamp = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        "event_id", F.round(times.duration_ms(F.date_trunc("day", stamp), stamp), 3).alias("ms")
    )


@query("floor_minutes", """select event_id, epoch_us(date_trunc('hour', ts)) + (minute(ts) - minute(ts) % 15) * 60000000 as start_us
 from events""")
def floor_minutes(spark, sf):
    return table(spark, sf, "events").select("event_id", times.micros(times.floor_minutes("ts", 15)).alias("start_us"))


@query("epoch_bucket", sql("kv", body="select idx, ts_us // 900000000 * 900 as bucket from kv"))
def epoch_bucket(spark, sf):
    return kv_edges(spark, sf).select("idx", times.epoch_bucket("ts_us").alias("bucket"))


def _rewrites(column: str) -> str:
    """The rewrite chain in a dialect without look-behind."""
    out = f"lower({column})"
    for pattern, replacement in text.COMMAND_REWRITES:
        if pattern.startswith("(?<="):
            pattern, replacement = r"([a-z_])\d+", r"\1<NUM>"
        replacement = replacement.replace("$1", r"\1").replace("$2", r"\2")
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return f"regexp_replace({out}, '{text.END_SPACE}', '', 'g')"


@query("normalize_cmdline", sql("logs", body=f"""select 'page' || page_id as id, {_rewrites('url')} as normal from pages
 union all select 'log' || id, {_rewrites('command_line')} from logs where command_line is not null
 union all select 'wrapped' || page_id, {_rewrites("chr(9) || url || chr(160) || chr(10)")} from pages"""))
def normalize_cmdline(spark, sf):
    pages = table(spark, sf, "pages").select(F.concat(F.lit("page"), "page_id").alias("id"), F.col("url").alias("t"))
    commands = raw_logs(spark, sf).select(F.concat(F.lit("log"), "id").alias("id"), F.col("properties.command_line").alias("t"))
    wrapped = table(spark, sf, "pages").select(
        F.concat(F.lit("wrapped"), "page_id").alias("id"), F.concat(F.lit("\t"), "url", F.lit("\u00a0\n")).alias("t"))
    rows = pages.union(commands.where("t is not null")).union(wrapped)
    return rows.select("id", text.normalize_cmdline("t").alias("normal"))


@query("tokenize_path", r"""select page_id, array_to_string(list_filter(string_split_regex(
 regexp_replace(regexp_replace(url, '/+', '/', 'g'), '/$', ''), '://|:/|//|/'), lambda x: x <> ''), '|') as tokens from pages""")
def tokenize_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(text.tokenize_path("url"), "|").alias("tokens"))


COMMAND_SQL = """'c{s}users{s}u' || pid || '{s}run.exe{s}d{s}' || ppid || '{s}10.0.0.' || ppid || '{s}0x' || ppid"""


@query("tokenize_cmdline", sql("logs", body=f"select id, {COMMAND_SQL.format(s='|')} as tokens from logs where command_line is not null"))
def tokenize_cmdline(spark, sf):
    logs = raw_logs(spark, sf).where("properties.command_line is not null")
    return logs.select("id", F.array_join(text.tokenize_cmdline("properties.command_line"), "|").alias("tokens"))


@query("text_sequence", sql("logs", body=f"""select id, case when command_line is null then '' else {COMMAND_SQL.format(s=' ')} end as sequence
 from logs"""))
def text_sequence(spark, sf):
    return raw_logs(spark, sf).select("id", text.text_sequence("properties.command_line").alias("sequence"))


@query("one_hot", sql("logs", body="""select id, cast(object_type='PROCESS' as int) || ',' || cast(object_type='FILE' as int) as hot from logs"""))
def one_hot(spark, sf):
    return raw_logs(spark, sf).select("id", F.array_join(vectors.one_hot("object", ["PROCESS", "FILE"]), ",").alias("hot"))


@query("uniform_path_extension", sql("logs", body=r"""select id, replace(file_path, '\Device\HarddiskVolume1', 'C:') as path,
 case when file_path is not null then '.txt' end as extension from logs"""))
def uniform_path_extension(spark, sf):
    path = F.col("properties.file_path")
    return raw_logs(spark, sf).select("id", text.uniform_path(path).alias("path"), text.extension(path).alias("extension"))


@query("principal_class", sql("logs", body="""select id, cast(case when principal like '%AUTHORITY%' then 1 when principal like '%SYSTEMIA%' then 2
 when principal like '%Window Manager%' then 3 when principal like '%Font Driver Host%' then 4 else 5 end as int) as class from logs"""))
def principal_class(spark, sf):
    return raw_logs(spark, sf).select("id", codes.principal_class("principal").alias("class"))


@query("sid_histogram", sql("logs", body="""+ s as (select hostname, sid, unnest(['18','19','20','21','90','96']) as c, unnest([0,1,2,3,4,5]) as pos from logs)
 select hostname, pos, cast(sum(cast(coalesce(contains(sid, 'S-1-5-' || c), false) as int)) as double) as value from s group by 1,2
 union all select hostname, 6, cast(count(*) - count(*) filter (where sid is not null) as double) from logs group by 1"""))
def sid_histogram(spark, sf):
    counted = raw_logs(spark, sf).groupBy("hostname").agg(codes.sid_histogram("properties.sid").alias("h"))
    return elements(counted, "hostname", "h")


@query("parent_child_user", sql("logs", body=r"""+ s as (select hostname, coalesce(contains(parent_image_path, '\Users\'), false) as p,
 coalesce(contains(coalesce(file_path, image_path), '\Users\'), false) as c from logs)
 select hostname, count(*) filter (where p and c) as both_user, count(*) filter (where p and not c) as parent_user,
 count(*) filter (where not p and c) as child_user, count(*) filter (where not p and not c) as neither from s group by 1"""))
def parent_child_user(spark, sf):
    child = F.coalesce("properties.file_path", "properties.image_path")
    counted = raw_logs(spark, sf).groupBy("hostname").agg(
        codes.parent_child_user("properties.parent_image_path", child).alias("h")
    )
    names = ["both_user", "parent_user", "child_user", "neither"]
    return counted.select("hostname", *[F.col("h")[n].alias(c) for n, c in enumerate(names)])


# the records as five kinds of objects, some of them without the field that names them
@query("node_key", sql("logs", body="""select id, case cast(pid as bigint)%6 when 0 then file_path when 1 then case when ord%4<>0 then 'm' || ppid || '.dll' end
 when 2 then case when ord%3<>0 then '10.0.0.' || ppid else '0' end || ':' || case when ord%5<>0 then pid else '0' end when 3 then case when ord%4<>1 then 'HKLM/' || ppid end
 when 4 then case when context_info is not null then 'h' || pid || 'u' || ppid || 'c' else object_id end else object_id end as node_key from logs"""))
def node_key_query(spark, sf):
    logs, kinds = raw_logs(spark, sf), ["FILE", "MODULE", "FLOW", "REGISTRY", "SHELL", "PROCESS"]
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("pid").cast("long") % 6).cast("int"))
    some = lambda n, rest, value: F.when(F.col("ord") % n != rest, value)
    properties = F.col("properties").withField("module_path", some(4, 0, F.concat(F.lit("m"), "ppid", F.lit(".dll")))).withField(
        "dest_ip", some(3, 0, F.concat(F.lit("10.0.0."), "ppid"))).withField("dest_port", some(5, 0, F.col("pid"))).withField(
        "key", some(4, 1, F.concat(F.lit("HKLM/"), "ppid")))
    return logs.withColumn("object", kind).withColumn("properties", properties).select("id", node_key().alias("node_key"))


@query("orient_process_create", sql("logs", body="""select id, case when action_type='CREATE' then ppid else pid end as actor_pid,
 case when action_type='CREATE' then parent_image_path else image_path end as actor_image,
 case when object_type='PROCESS' and action_type<>'CREATE' then null else pid end as target_pid,
 case when object_type='PROCESS' and action_type<>'CREATE' then pid else ppid end as target_ppid,
 case when object_type='PROCESS' and action_type<>'CREATE' then null else image_path end as target_image from logs"""))
def orient(spark, sf):
    return orient_process_create(raw_logs(spark, sf)).select(
        "id", F.col("actor.pid").alias("actor_pid"), F.col("actor.image_path").alias("actor_image"),
        F.col("target.pid").alias("target_pid"), F.col("target.ppid").alias("target_ppid"),
        F.col("target.image_path").alias("target_image"),
    )


EMBED_SQL = "+ v as (select vec_id, cast(unnest(embedding) as double) as x, unnest(range(0, len(embedding))) as pos from embeddings)"


def embed(body: str) -> str:
    return "with " + EMBED_SQL.removeprefix("+") + body


@query("minmax_normalize", embed("""select vec_id, cast(pos as int) as pos, round((x - min(x) over (partition by pos)) /
 (max(x) over (partition by pos) - min(x) over (partition by pos)), 6) as value from v"""))
def minmax_normalize(spark, sf):
    scaled = vectors.minmax_normalize(table(spark, sf, "embeddings"), "embedding", 64)
    return elements(scaled, "vec_id", "embedding")


@query("minmax_normalize_train_bounds", embed(""", b as (select pos, min(x) as lo, max(x) as hi from v where vec_id % 2 = 0 group by 1)
 select vec_id, cast(pos as int) as pos, round((x - lo) / (hi - lo), 6) as value from v join b using (pos)"""))
def minmax_normalize_train(spark, sf):
    rows = table(spark, sf, "embeddings")
    bounds = vectors.minmax_bounds(rows.where("vec_id % 2 = 0"), "embedding", 64)
    return elements(vectors.minmax_normalize(rows, "embedding", 64, bounds), "vec_id", "embedding")


@query("squash_scores", sql("scored", body="""select idx, round((score*3-1 - min(score*3-1) over ()) / (max(score*3-1) over () - min(score*3-1) over ()), 6) as score
 from scored"""))
def squash(spark, sf):
    wide = scored_links(spark, sf).withColumn("score", F.col("score") * 3 - 1)
    return squash_scores(wide).select("idx", r6("score").alias("score"))


@query("sigmoid", "select event_id, round(1/(1+exp(-(value-30)/2.0)), 6) as p from events")
def sigmoid(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(codes.sigmoid(F.col("value") - 30, 2.0)).alias("p"))


@query("time_encode", """select event_id, cast(pos as int) as pos, round(cos(value * pow(10.0, -9.0*pos/7)), 6) as value
 from events, (select unnest(range(0,8)) as pos)""")
def time_encode(spark, sf):
    return elements(
        table(spark, sf, "events").select("event_id", vectors.time_encode("value", 8).alias("e")), "event_id", "e"
    )


@query("pad_vector", embed("""select vec_id, cast(pos as int) as pos, round(x, 6) as value from v
 union all select vec_id, cast(unnest(range(64, 70)) as int), 0.0 from embeddings"""))
def pad_vector(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return elements(rows.select("vec_id", vectors.pad_vector("embedding", 70).alias("e")), "vec_id", "e")


@query("edge_code", sql("kv", body="select idx, u*200000+i as code, u as back_u, i as back_i from kv"))
def edge_code(spark, sf):
    coded = kv_edges(spark, sf).select("idx", codes.edge_code("u", "i", 200000).alias("code"))
    back_u, back_i = codes.edge_decode("code", 200000)
    return coded.select("idx", "code", back_u.alias("back_u"), back_i.alias("back_i"))


@query("position_weight", embed("""select vec_id, cast(pos as int) as pos, round(case when pos < 63 then 1 - pos/65.0 else (pos + (2-64.0))/2 end, 6) as combine,
 round(case when pos < 63 then pow(0.5, pos+1) else 0.25 end, 6) as geo, 1.0 as const from v"""))
def position_weight(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    n = F.lit(64)
    return rows.select(
        "vec_id", "pos", r6(vectors.position_weight("pos", n, "combine", last=1)).alias("combine"),
        r6(vectors.position_weight("pos", n, "geo", last=1, q=0.5)).alias("geo"),
        vectors.position_weight("pos", n).alias("const"),
    )


@query("null_key", sql("tr", "feat", body="""+ a as (select command_line, count(*) as n1 from feat group by 1),
 b as (select nullif(event_type,'view') as command_line, count(*) as n2 from events group by 1)
 select a.command_line, n1, n2 from a join b on a.command_line is not distinct from b.command_line"""))
def null_key(spark, sf):
    edges = transition_edges(spark, sf)
    first = features_of(edges).groupBy("command_line").agg(F.count("*").alias("n1"))
    every = table(spark, sf, "events").select(F.nullif("event_type", F.lit("view")).alias("command_line"))
    second = every.groupBy("command_line").agg(F.count("*").alias("n2"))
    joined = first.join(second, first["command_line"].eqNullSafe(second["command_line"]))
    return joined.select(first["command_line"], "n1", "n2")


RULES = [
    {"pattern_id": "user_run", "match_rules": {"command_line": r"\\U\d*[05]\\run", "image_path": r"windows"},
     "template": "{filename} ran {args}", "threat_level": "suspicious"},
    {"pattern_id": "from_service", "match_rules": {"parent_image": r"\\SVC\d"},
     "template": "service {parent_image} started {image_path}", "threat_level": "benign"},
]
RULE_FIELDS = {"command_line": "command_line", "image_path": "image_path", "parent_image": "parent_image_path"}
MATCH_SQL = r"""case when regexp_matches(coalesce(command_line,''), '(?i)\\U\d*[05]\\run') and regexp_matches(coalesce(image_path,''), '(?i)windows') then 'user_run'
 when regexp_matches(parent_image_path, '(?i)\\SVC\d') then 'from_service' end"""
DESCRIBE_SQL = r"""case pattern_id when 'user_run' then string_split(image_path, '\')[-1] || ' ran ' || '/d ' || ppid || ' 10.0.0.' || ppid || ' 0x' || ppid
 when 'from_service' then 'service ' || parent_image_path || ' started ' || coalesce(image_path, '') end"""


def template_logs(spark, sf):
    return raw_logs(spark, sf).select(
        "id", *[F.col(f"properties.{n}").alias(n) for n in ("command_line", "image_path", "parent_image_path")]
    )


@query("match_templates", sql("logs", body=f"""+ m as (select *, {MATCH_SQL} as pattern_id from logs)
 select id, pattern_id, case pattern_id when 'user_run' then 'suspicious' when 'from_service' then 'benign' end as threat_level,
 {DESCRIBE_SQL} as description from m"""))
def match_templates(spark, sf):
    found = text.match_templates(RULES, RULE_FIELDS | {"parent_image_path": "parent_image_path"})
    return template_logs(spark, sf).select("id", *[c.alias(n) for n, c in found.items()])


# ------------------------------------------------------------------ numbering
@query("assign_node_ids", sql("logs", body=GRAPH_SQL + " select node_id, object_type, id, path from ids"))
def assign_node_ids(spark, sf):
    return ev.assign_node_ids(flat_events(spark, sf), ["ord"])


@query("assign_sorted_node_ids", sql("logs", body="""select object_id, row_number() over (order by object_id) - 1 as node_id
 from (select distinct object_id from logs)"""))
def assign_sorted_node_ids(spark, sf):
    return ev.assign_sorted_node_ids(flat_events(spark, sf), "object_id")


@query("assign_edge_ids", sql("trade", body="""select idx, row_number() over (order by ts_us, idx % 7, idx) as new_idx from trade"""))
def assign_edge_ids(spark, sf):
    rows = trade_edges(spark, sf).withColumnRenamed("idx", "old").withColumn("slot", F.col("old") % 7)
    return ev.assign_edge_ids(rows, ["slot", "old"]).select(F.col("old").alias("idx"), F.col("idx").alias("new_idx"))


@query("reindex", sql("kv", body="""select u+1 as u, (i - (select min(i) from kv)) + (select max(u) from kv) + 1 + 1 as i, ts_us, label, idx+1 as idx
 from kv"""))
def reindex(spark, sf):
    edges = kv_edges(spark, sf)
    least = edges.agg(F.min("i")).scalar()
    return ev.reindex(edges.withColumn("i", F.col("i") - least), bipartite=True)


@query("batch_number", sql("kv", body="select idx, (idx-1)//256 as batch from kv"))
def batch_number(spark, sf):
    return kv_edges(spark, sf).select("idx", ev.batch_number().alias("batch"))


@query("every_nth", sql("trade", body="select idx, u, i from trade where (idx-1)%10=0"))
def every_nth(spark, sf):
    return ev.every_nth(trade_edges(spark, sf), 10).select("idx", "u", "i")

