"""Streaming operators replayed over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from edgetide.catalog.fixtures import kv_edges, r6, sql
from edgetide.catalog.registry import query
from edgetide.catalog.scoring import adaptive_sql, stream_links
from edgetide.session import scratch_folder, stored
from edgetide.streaming import processors as st


PARTS = 4  # micro-batches


def arriving(rows, part: str, files: int = 2):
    """``rows`` as a stream of ``PARTS`` micro-batches: files written part after part, as many of them a trigger as a part has."""
    spark = rows.sparkSession
    folder = f"{scratch_folder(spark)}/arriving-{uuid.uuid4().hex}"
    placed = stored(rows)
    for number in range(PARTS):
        placed.where(F.col(part) == number).drop(part).repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(placed.drop(part).schema).option("maxFilesPerTrigger", files).parquet(folder)


def in_time(rows):
    """``part``: quarters of the event numbers, which follow time."""
    last = rows.agg(F.max("idx")).scalar()
    return rows.withColumn("_n", last).withColumn("part", F.floor((F.col("idx") - 1) * PARTS / F.col("_n")).cast("int")).drop("_n")


def edge_stream(spark, sf):
    return arriving(in_time(kv_edges(spark, sf).withColumn("ts", F.timestamp_micros("ts_us"))), "part")


# every 40th event arrives a quarter later than the others of its time
LATE = """+ p as (select *, 'Host' || u%5 as hostname, (idx-1)*4//(select max(idx) from kv) as quarter from kv),
 a as (select *, least(quarter + (idx%40=0)::int, 3) as part, ts_us - ts_us%900000000 as start_us from p),
 m as (select q.part, max(a.ts_us) - 3600000000 as reached from (select distinct part from a) q join a on a.part < q.part group by 1),
 l as (select a.*, coalesce(start_us + 900000000 <= reached, false) as late from a left join m using (part))"""


@query("tumbling_window_edges", sql("kv", body=LATE + """ select hostname, start_us, count(*) filter (where not late) as edges, (sum(label) filter (where not late))::bigint as labels,
 count(*) filter (where late) as late from l group by 1,2"""))
def tumbling_window_edges(spark, sf):
    edges = in_time(kv_edges(spark, sf)).withColumn("part", F.least(F.col("part") + (F.col("idx") % 40 == 0).cast("int"), F.lit(PARTS - 1)))
    host = F.concat(F.lit("Host"), (F.col("u") % 5).cast("string"))
    rows = edges.select(host.alias("hostname"), F.timestamp_micros("ts_us").alias("ts"), "label", "part")
    windows, late = st.replay_windows(arriving(rows, "part"))
    start = F.unix_micros("ts") - F.pmod(F.unix_micros("ts"), F.lit(900_000_000))
    lost = late.groupBy("hostname", start.alias("start_us")).agg(F.count("*").alias("late"))
    both = windows.select("hostname", "start_us", "edges", "labels").join(lost, ["hostname", "start_us"], "full")
    none = F.lit(0).cast("long")
    return both.select("hostname", "start_us", F.coalesce("edges", none).alias("edges"), "labels", F.coalesce("late", none).alias("late"))


@query("stream_new_edges", sql("kv", body="select distinct u, i from kv"))
def stream_new_edges(spark, sf):
    return st.replay(st.stream_new_edges(edge_stream(spark, sf))).select("u", "i")


@query("stream_node_state", sql("kv", body="""+ h as (select u as node, i as neighbor, ts_us, idx from kv union all select i, u, ts_us, idx from kv)
 select node, count(*) as events, max(ts_us) as last_us, arg_max(neighbor, (ts_us, idx)) as last_neighbor from h group by 1"""))
def stream_node_state(spark, sf):
    found = st.replay(st.stream_node_state(edge_stream(spark, sf)), "update")
    # update mode writes a node once per micro-batch that touched it; the last one stands
    last = found.groupBy("node").agg(F.max_by(F.struct("events", "last_ts", "last_neighbor"), "batch_id").alias("s"))
    return last.select("node", "s.events", F.unix_micros("s.last_ts").alias("last_us"), "s.last_neighbor")


@query("stream_node_recency", sql("kv", body="""+ h as (select u as node, ts_us, idx from kv union all select i, ts_us, idx from kv)
 select node, idx, round((ts_us - lag(ts_us) over (partition by node order by ts_us, idx))/1e6, 6) as recency from h"""))
def stream_node_recency(spark, sf):
    return st.replay_recency(edge_stream(spark, sf)).select("node", "idx", r6("recency").alias("recency"))


@query("stream_adaptive_alerts", adaptive_sql("""select test.stream, test.idx, round(level, 6) as level, round(threshold, 6) as threshold,
 (test.err > threshold)::int as alert from steps join test using (stream, batch)"""))
def stream_adaptive_alerts(spark, sf):
    links = stream_links(spark, sf)
    calibration = links.where("idx % 3 = 0")
    stream = arriving(in_time(links.where("idx % 3 <> 0")).select("stream", "idx", "score", "part"), "part")
    found = st.replay_alerts(stream, calibration)
    return found.select("stream", "idx", r6("level").alias("level"), r6("threshold").alias("threshold"), "alert")
