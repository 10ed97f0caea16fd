"""Edge memories, metrics, conformal thresholds and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgetide.catalog.fixtures import (
    kv_edges, nodes_of, r6, scored_links, sql, table,
)
from edgetide.catalog.registry import query
from edgetide.catalog.sanity import KV_SPLIT
from edgetide.functions.times import epoch_bucket
from edgetide.operators import conformal, memory, metrics, reports, splits
from edgetide.operators.events import batch_number
from edgetide.plans.ordered import quantiles, running_totals


def rounded(df, *columns, digits=6):
    return df.withColumns({c: r6(c, digits) for c in columns})


# ------------------------------------------------------------------ flagship
@query("window_anomaly_ranking", sql("kv", body="""+ cut as (select quantile_cont(ts_us,0.8) c from kv),
 mem as (select distinct u,i from kv,cut where ts_us<=c), te as (select kv.*, ts_us//900000000*900 as bucket from kv,cut where ts_us>c),
 sc as (select te.bucket, te.label, te.idx, case when mem.u is null then 0.0 else 1.0 end score from te left join mem on te.u=mem.u and te.i=mem.i),
 rk as (select *, row_number() over (partition by bucket order by score,idx) r, count(*) over (partition by bucket) n from sc)
 select bucket, round(1-avg(case when r<=greatest(1,cast(floor(n*0.01) as int)) then score end),6) as anomaly_score, max(label) as label from rk group by 1"""))
def window_anomaly_ranking(spark, sf):
    edges = kv_edges(spark, sf)
    cut = quantiles(edges, "ts_us", {"c": 0.8}).scalar()
    cutted = edges.withColumn("_c", cut)
    known = memory.edge_memory_unlimited(cutted.where("ts_us <= _c"))
    test = reports.bucketed(memory.edge_membership(cutted.where("ts_us > _c"), known))
    scores = reports.bucket_score(test)
    joined = scores.join(reports.bucket_label(test), "bucket")
    return joined.select("bucket", r6(F.lit(1.0) - F.col("score")).alias("anomaly_score"), "label").orderBy(
        F.col("anomaly_score").desc(), "bucket"
    )


# ------------------------------------------------------------------ memories
def history(spark, sf):
    edges = splits.quantile_split(kv_edges(spark, sf), 0.15, 0.15)
    return edges.where("split <> 'test'"), edges.where("split = 'test'")


HIST = KV_SPLIT + ", h as (select * from s where split<>'test'), t as (select * from s where split='test')"


@query("edge_memory_unlimited", sql("kv", body=HIST + " select distinct u, i from h"))
def edge_memory_unlimited(spark, sf):
    return memory.edge_memory_unlimited(history(spark, sf)[0])


@query("edge_memory_time_window", sql("kv", body=HIST + " select distinct u, i from h where ts_us >= (select quantile_cont(ts_us, 0.85) from h)"))
def edge_memory_time_window(spark, sf):
    return memory.edge_memory_time_window(history(spark, sf)[0], 0.15)


@query("edge_memory_repeat_interval", sql("kv", body=HIST + """, p as (select u, i, count(*) as n, min(ts_us) as a, max(ts_us) as b from h group by 1,2),
 w as (select max(b) - sum(case when n>1 then (b-a)/(n-1) else 0 end)/count(*) as start from p)
 select distinct u, i from h, w where ts_us >= start"""))
def edge_memory_repeat_interval(spark, sf):
    return memory.edge_memory_repeat_interval(history(spark, sf)[0])


@query("edge_memory_repeat_threshold", sql("kv", body=HIST + """, p as (select u, i, count(*) as n from h group by 1,2)
 select u, i from p where n >= (select avg(n) from p)"""))
def edge_memory_repeat_threshold(spark, sf):
    return memory.edge_memory_repeat_threshold(history(spark, sf)[0])


@query("edge_membership", sql("kv", body=HIST + """, m as (select distinct u, i from h)
 select idx, case when m.u is null then 0.0::double else 1.0::double end as score from t left join m using (u, i)"""))
def edge_membership(spark, sf):
    past, test = history(spark, sf)
    return memory.edge_membership(test, memory.edge_memory_unlimited(past)).select("idx", "score")


@query("edgebank_scores", sql("kv", body=HIST + """, p as (select u, i, count(*) as n from h group by 1,2),
 m as (select u, i from p where n >= (select avg(n) from p)), x as (select idx, u, i, 1 as label from t union all select idx, u, 100000 + (i - 100000 + 37) % 100, 0 from t)
 select idx, label, case when m.u is null then 0.0::double else 1.0::double end as score from x left join m using (u, i)"""))
def edgebank_scores(spark, sf):
    return scored_by_memory(spark, sf, "repeat_threshold_memory")


def scored_by_memory(spark, sf, mode):
    past, test = history(spark, sf)
    positives = test.select("idx", "u", "i")
    wrong = positives.withColumn("i", F.lit(100000) + (F.col("i") - 100000 + 37) % 100)
    return memory.edgebank_scores(past, positives, wrong, mode).select("idx", "label", "score")


MEMORY = HIST + """, p as (select u, i, count(*) as n, min(ts_us) as a, max(ts_us) as z from h group by 1,2),
 m as (select u, i from p where {kept}), x as (select idx, u, i, 1 as label from t union all select idx, u, 100000 + (i - 100000 + 37) % 100, 0 from t)
 select idx, label, case when m.u is null then 0.0::double else 1.0::double end as score from x left join m using (u, i)"""


@query("edgebank_scores_unlimited", sql("kv", body=MEMORY.format(kept="true")))
def edgebank_scores_unlimited(spark, sf):
    return scored_by_memory(spark, sf, "unlimited_memory")


@query("edgebank_scores_time_window", sql("kv", body=MEMORY.format(kept="z >= (select quantile_cont(ts_us, 0.85) from h)")))
def edgebank_scores_time_window(spark, sf):
    return scored_by_memory(spark, sf, "time_window_fixed_proportion")


@query("edgebank_scores_repeat_interval", sql("kv", body=MEMORY.format(
    kept="z >= (select max(z) - sum(case when n>1 then (z-a)/(n-1) else 0 end)/count(*) from p)")))
def edgebank_scores_repeat_interval(spark, sf):
    return scored_by_memory(spark, sf, "time_window_repeat_interval")


BATCHED = KV_SPLIT + """, e as (select *, case when split='test' then (row_number() over (partition by split='test' order by idx) - 1)//256 else -1 end as batch from s),
 f as (select u, i, min(batch) as first from e group by 1,2),
 cand as (select idx, u, i, batch, 1 as label from e where batch>=0 union all select idx, u, 100000 + (i - 100000 + 37) % 100, batch, 0 from e where batch>=0),
 sc as (select c.idx, c.batch, c.label, case when f.first < c.batch then 1.0::double else 0.0::double end as score from cand c left join f using (u, i))"""


# every batch by itself: its own history, its own bound
GROWN = BATCHED + """, hb as (select b.batch as b, e.u, e.i, e.ts_us from (select distinct batch from e where batch>=0) b join e on e.batch < b.batch),
 p as (select b, u, i, count(*) as n, min(ts_us) as a, max(ts_us) as z from hb group by 1,2,3), w as ({bound})
 select c.idx, c.batch, c.label, case when {reached} >= w.bound then 1.0::double else 0.0::double end as score from cand c left join p on p.b=c.batch and p.u=c.u and p.i=c.i left join w on w.b=c.batch"""


def batched(spark, sf, mode="unlimited_memory"):
    edges = splits.quantile_split(kv_edges(spark, sf), 0.15, 0.15)
    start = edges.where("split = 'test'").agg(F.min("idx")).scalar()  # idx is dense in time order
    place = batch_number(F.col("idx") - F.col("_start") + 1)
    edges = edges.withColumn("_start", start).withColumn("batch", F.when(F.col("split") == "test", place).otherwise(-1))
    positives = edges.where("batch >= 0").select("idx", "u", "i", "batch", F.lit(1).alias("label"))
    wrong = positives.withColumn("i", F.lit(100000) + (F.col("i") - 100000 + 37) % 100).withColumn("label", F.lit(0))
    return memory.edgebank_batched(edges, positives.unionByName(wrong), mode)


@query("edgebank_batched", sql("kv", body=BATCHED + " select idx, batch, label, score from sc"))
def edgebank_batched(spark, sf):
    return batched(spark, sf).select("idx", "batch", "label", "score")


@query("edgebank_batched_time_window", sql("kv", body=GROWN.format(bound="select b, quantile_cont(ts_us, 0.85) as bound from hb group by 1", reached="p.z")))
def edgebank_batched_time_window(spark, sf):
    return batched(spark, sf, "time_window_fixed_proportion").select("idx", "batch", "label", "score")


@query("edgebank_batched_repeat_interval", sql("kv", body=GROWN.format(
    bound="select b, max(z) - sum(case when n>1 then (z-a)/(n-1) else 0 end)/count(*) as bound from p group by 1", reached="p.z")))
def edgebank_batched_repeat_interval(spark, sf):
    return batched(spark, sf, "time_window_repeat_interval").select("idx", "batch", "label", "score")


@query("edgebank_batched_repeat_threshold", sql("kv", body=GROWN.format(bound="select b, avg(n) as bound from p group by 1", reached="p.n")))
def edgebank_batched_repeat_threshold(spark, sf):
    return batched(spark, sf, "repeat_threshold_memory").select("idx", "batch", "label", "score")


def auc_sql(table: str, by: str = "", score: str = "score") -> str:
    part = f"partition by {by}" if by else ""
    cols = f"{by}, " if by else ""
    group = f" group by {by}" if by else ""
    return f"""select {cols}(sum(case when label=1 then r end) - sum(label)*(sum(label)+1)/2.0) / nullif(sum(label)*sum(1-label), 0) as auc
 from (select *, rank() over ({part} order by {score}) + (count(*) over ({part + (',' if part else 'partition by')} {score}) - 1)/2.0 as r from {table}){group}"""


def ap_sql(table: str, by: str = "", score: str = "score") -> str:
    part = f"partition by {by}" if by else ""
    cols = f"{by}, " if by else ""
    group = f" group by {by}" if by else ""
    return f"""select {cols}sum(p * tp / (tp + fp)) / sum(p) as ap from (select {cols}p, sum(p) over ({part} order by s desc) as tp, sum(n) over ({part} order by s desc) as fp
 from (select {cols}{score} as s, sum(label)::double as p, sum(1-label)::double as n from {table} group by {cols}{score})){group}"""


@query("batch_metrics", sql("kv", body=BATCHED + f""" select a.batch, round(acc, 6) as accuracy, round(ap, 6) as ap, round(auc, 6) as auc
 from ({auc_sql('sc', 'batch')}) a join ({ap_sql('sc', 'batch')}) b using (batch)
 join (select batch, avg(cast((score>0.5)::int = label as int)) as acc from sc group by 1) c using (batch)"""))
def batch_metrics(spark, sf):
    return rounded(metrics.batch_metrics(batched(spark, sf)), "accuracy", "ap", "auc")


@query("mean_batch_metrics", sql("kv", body=BATCHED + f""" select round(avg(ap), 6) as ap, round(avg(auc), 6) as auc
 from ({auc_sql('sc', 'batch')}) a join ({ap_sql('sc', 'batch')}) b using (batch)"""))
def mean_batch_metrics(spark, sf):
    return rounded(metrics.mean_metrics(metrics.batch_metrics(batched(spark, sf)), ["ap", "auc"]), "ap", "auc")


@query("log_loss", sql("kv", body=BATCHED + """ select batch, round(avg(-(label*greatest(case when score>0 then ln(score) else -100 end,-100)
 + (1-label)*greatest(case when score<1 then ln(1-score) else -100 end,-100))), 6) as loss from sc group by 1"""))
def log_loss(spark, sf):
    return rounded(metrics.log_loss(batched(spark, sf)), "loss")


@query("node_popularity", sql("kv", body="""+ c as (select quantile_cont(ts_us,0.5) as t from kv), h as (select kv.* from kv, c where ts_us<=t)
 select 'src' as side, u as node, count(*) as degree, round(count(*)/(select count(*) from h)::double, 6) as share from h group by 2
 union all select 'dst', i, count(*), round(count(*)/(select count(*) from h)::double, 6) from h group by 2"""))
def node_popularity(spark, sf):
    edges = kv_edges(spark, sf)
    until = int(quantiles(edges, "ts_us", {"t": 0.5}).first()["t"])
    return rounded(memory.node_popularity(edges, until), "share")


# ------------------------------------------------------------------ metrics
CELLS = """count(*) filter (where label=0 and z=0) as tn, count(*) filter (where label=0 and z=1) as fp,
 count(*) filter (where label=1 and z=0) as fn, count(*) filter (where label=1 and z=1) as tp"""
RATES = """round(coalesce((tp+tn)/nullif(tp+tn+fp+fn,0)::double,0),6) as accuracy, round(coalesce(tp/nullif(tp+fp,0)::double,0),6) as precision,
 round(coalesce(tp/nullif(tp+fn,0)::double,0),6) as recall, round(coalesce(2*tp/nullif(2*tp+fp+fn,0)::double,0),6) as f1"""
RATE_NAMES = ("accuracy", "precision", "recall", "f1")


@query("confusion", sql("scored", body=f"select tn, fp, fn, tp, {RATES} from (select {CELLS} from (select label, (score>0.5)::int as z from scored))"))
def confusion(spark, sf):
    marked = scored_links(spark, sf).withColumn("prediction", metrics.predicted("score", F.lit(0.5)))
    return rounded(metrics.confusion(marked), *RATE_NAMES)


@query("roc_auc", sql("scored", body=f"select round(auc, 6) as auc from ({auc_sql('scored')})"))
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(scored_links(spark, sf)), "auc")


@query("average_precision", sql("scored", body=f"select round(ap, 6) as ap from ({ap_sql('scored')})"))
def average_precision(spark, sf):
    return rounded(metrics.average_precision(scored_links(spark, sf)), "ap")


RANKED = """+ f as (select score, sum(label) as p, sum(1-label) as n from scored group by 1),
 r as (select *, sum(p) over (order by score desc) as tp, sum(n) over (order by score desc) as fp, sum(p) over () as tot_p, sum(n) over () as tot_n,
 lead(p) over (order by score desc) as p2, lead(n) over (order by score desc) as n2 from f)"""


@query("roc_curve", sql("scored", body=RANKED + """ select round(fp/tot_n::double,6) as fpr, round(tp/tot_p::double,6) as tpr, round(score,6) as threshold from r
 where p2 is null or p2<>p or n2<>n or (tp=p and fp=n) union all select 0.0, 0.0, 'infinity'::double"""))
def roc_curve(spark, sf):
    return rounded(metrics.roc_curve(scored_links(spark, sf)), "fpr", "tpr").withColumn(
        "threshold", F.when(F.col("threshold") < 2, r6("threshold")).otherwise(F.col("threshold"))
    )


@query("pr_curve", sql("scored", body=RANKED + """ select round(tp/(tp+fp)::double,6) as precision, round(tp/tot_p::double,6) as recall, round(score,6) as threshold
 from r union all select 1.0, 0.0, null"""))
def pr_curve(spark, sf):
    return rounded(metrics.pr_curve(scored_links(spark, sf)), "precision", "recall", "threshold")


@query("calibration_curve", sql("scored", body="""select cast(greatest(ceil(score*50)-1,0) as bigint) as bin, round(avg(label),6) as prob_true, round(avg(score),6) as prob_pred
 from scored group by 1"""))
def calibration_curve(spark, sf):
    return rounded(metrics.calibration_curve(scored_links(spark, sf)), "prob_true", "prob_pred")


@query("score_histogram", sql("scored", body="""select cast(least(floor(score*50),49) as bigint) as bin, count(*) filter (where label=1) as positives,
 count(*) filter (where label=0) as negatives from scored group by 1"""))
def score_histogram(spark, sf):
    return metrics.score_histogram(scored_links(spark, sf))


@query("best_f1_threshold_roc", sql("scored", body=RANKED + """ select round(score,6) as best_threshold, round(2*tp/(tp+fp+tot_p)::double,6) as f1 from r
 order by 2*tp/(tp+fp+tot_p)::double desc, score desc limit 1"""))
def best_f1_threshold_roc(spark, sf):
    return rounded(metrics.best_f1_threshold(scored_links(spark, sf)), "best_threshold", "f1")


@query("best_f1_threshold_pr", sql("scored", body=RANKED + """, q as (select score, tp/(tp+fp)::double as pr, tp/tot_p::double as rc from r)
 select round(score,6) as best_threshold, round(2*(pr*rc)/(pr+rc+1e-8),6) as f1 from q order by 2*(pr*rc)/(pr+rc+1e-8) desc, score limit 1"""))
def best_f1_threshold_pr(spark, sf):
    return rounded(metrics.best_f1_threshold(scored_links(spark, sf), "pr"), "best_threshold", "f1")


@query("run_summary", sql("scored", body="""select label, round(avg(m),6) as mean, round(stddev_samp(m),6) as std from
 (select idx%5 as run, label, avg(score) as m from scored group by 1,2) group by 1"""))
def run_summary(spark, sf):
    runs = scored_links(spark, sf).groupBy((F.col("idx") % 5).alias("run"), "label").agg(F.avg("score").alias("m"))
    return rounded(metrics.run_summary(runs, "m", ["label"]), "mean", "std")


@query("node_auc", sql("scored", body=f"""+ n as (select src, avg(score) as score, cast(src%7=0 as int) as label from scored group by 1)
 select round(auc, 6) as auc from ({auc_sql('n')})"""))
def node_auc(spark, sf):
    nodes = scored_links(spark, sf).groupBy("src").agg(F.avg("score").alias("score")).withColumn(
        "label", (F.col("src") % 7 == 0).cast("int")
    )
    return rounded(metrics.roc_auc(nodes), "auc")


@query("smooth_series", sql("scored", body="""+ b as (select (idx-1)//16 as batch, avg(score) as loss from scored group by 1)
 select batch, round(loss,6) as loss, round(quantile_cont(loss,0.5) over (order by batch rows between 3 preceding and 3 following),6) as smoothed from b"""))
def smooth_series(spark, sf):
    series = scored_links(spark, sf).groupBy(batch_number("idx", 16).alias("batch")).agg(F.avg("score").alias("loss"))
    return rounded(metrics.smooth_series(series, "loss", "batch", 7), "loss", "smoothed")


# ------------------------------------------------------------------ conformal
def stream_links(spark, sf):
    """Scored links with their type of event as ``stream``."""
    kinds = table(spark, sf, "events").select((F.col("event_id") + 1).alias("idx"), F.col("event_type").alias("stream"))
    return scored_links(spark, sf).join(kinds, "idx")


def adaptive_sql(body: str) -> str:
    """``body`` over ``test`` (idx, stream, batch, err) and ``steps`` (stream, batch, level, threshold, miscoverage, n): the
    recurrence of every stream, one batch after the other."""
    return sql("scored", body="""+ cal as (select 1-score as err, row_number() over (order by 1-score) - 1 as r from scored where idx%3=0),
 k as (select count(*) as n, max(err) as top from cal),
 test as (select idx, e.event_type as stream, 1-score as err, (row_number() over (partition by e.event_type order by idx) - 1)//256 as batch from scored join events e on e.event_id = idx - 1 where idx%3<>0),
 ends as (select stream, max(batch) as last from test group by 1),
 steps(stream, batch, level, threshold, miscoverage, n) as (
  select stream, -1::bigint, 0.05::double, 0.0::double, -1.0::double, 0::bigint from ends
  union all
  select s.stream, s.batch + 1, w.level, w.threshold, (select avg((t.err > w.threshold)::int) from test t where t.stream = s.stream and t.batch = s.batch + 1),
   (select count(*) from test t where t.stream = s.stream and t.batch = s.batch + 1)
  from steps s join ends on ends.stream = s.stream and s.batch < ends.last,
   lateral (select case when s.batch < 0 then s.level when s.miscoverage > 0.05 then s.level + 0.005 * (s.level - s.miscoverage) else s.level * 1.005 end as level) v,
   lateral (select v.level, case when floor((1 - v.level) * (k.n + 1)) >= k.n then k.top + 1e-6 else
     (select lo.err + (hi.err - lo.err) * (p.spot - floor(p.spot)) from (select floor((1 - v.level) * (k.n + 1)) / k.n * (k.n - 1) as spot) p
      join cal lo on lo.r = floor(p.spot) join cal hi on hi.r = ceil(p.spot)) end as threshold from k) w)
 """ + body).replace("with scored", "with recursive scored", 1)


ADAPTIVE = adaptive_sql("""select stream, batch, round(level, 6) as level, round(threshold, 6) as threshold, round(miscoverage, 6) as miscoverage, n
 from steps where batch >= 0""")


def calibration(spark, sf):
    links = scored_links(spark, sf)
    return links.where("idx % 3 = 0"), links.where("idx % 3 <> 0")


@query("conformal_threshold", sql("scored", body="""+ cal as (select 1-score as err from scored where idx%3=0),
 k as (select count(*) as n, floor(0.95*(count(*)+1)) as q from cal), k2 as (select n, q, q/n*(n-1) as spot from k),
 o as (select err, row_number() over (order by err) - 1 as r from cal)
 select round(case when q>=n then (select max(err)+1e-6 from cal) else lo.err + (hi.err-lo.err)*(spot-floor(spot)) end, 6) as threshold
 from k2 left join o lo on lo.r=floor(spot) left join o hi on hi.r=ceil(spot)"""))
def conformal_threshold(spark, sf):
    return rounded(conformal.conformal_threshold(calibration(spark, sf)[0]), "threshold")


@query("conformal_threshold_weighted", sql("scored", body="""+ cal as (select 1-score as err, exp(-0.000001*((select max(ts_us) from scored where idx%3=0)-ts_us)/1e6) as w from scored where idx%3=0),
 k as (select floor(0.95*(count(*)+1))/count(*) as goal, sum(w) as total from cal), g as (select err, sum(w) as w from cal group by 1),
 c as (select err, sum(w) over (order by err) as cum from g)
 select round(coalesce(min(err) filter (where cum/total >= goal), max(err)), 6) as threshold from c, k"""))
def conformal_threshold_weighted(spark, sf):
    found = conformal.conformal_threshold_weighted(calibration(spark, sf)[0], decay=1e-6)
    return rounded(found, "threshold")


@query("miscoverage", sql("scored", body="""select round(avg((1-score > 0.75)::int),6) as miscoverage from scored where idx%3<>0"""))
def miscoverage(spark, sf):
    return rounded(conformal.miscoverage(calibration(spark, sf)[1], 0.75), "miscoverage")


@query("adaptive_conformal", ADAPTIVE)
def adaptive_conformal(spark, sf):
    links = stream_links(spark, sf)
    # each stream's test links numbered densely, in shares of a busy stream
    dense = running_totals(links.where("idx % 3 <> 0"), ["stream"], ["idx"], {"_place": F.lit(1).cast("long")})
    test = dense.drop("idx").withColumnRenamed("_place", "idx")
    found = conformal.adaptive_conformal(test, links.where("idx % 3 = 0"), key="stream")
    return rounded(found, "level", "threshold", "miscoverage")


# ------------------------------------------------------------------ labels, buckets and reports
@query("join_scores_labels", sql("scored", body="""+ sc as (select src, dst, ts_us//1000000000 as ts_us, arg_max(score, idx) as score from scored group by 1,2,3)
 select idx, label, round(1-sc.score, 6) as anomaly from scored s join sc on sc.src=s.src and sc.dst=s.dst and sc.ts_us=s.ts_us//1000000000 where label=1"""))
def join_scores_labels(spark, sf):
    links = scored_links(spark, sf).withColumn("ts_us", ((F.col("ts_us") - F.col("ts_us") % 1000000000) / 1000000000).cast("long"))
    truth = links.where("label = 1").select("idx", "src", "dst", "ts_us", "label")
    return rounded(reports.join_scores_labels(links, truth).select("idx", "label", "anomaly"), "anomaly")


@query("link_score_stats", sql("scored", body="""select case when idx%4=0 then 'non_exist' when label=0 then 'benign' else 'anomaly' end as kind, count(*) as n,
 round(avg(score),6) as mean, round(stddev_pop(score),6) as std from scored group by 1"""))
def link_score_stats(spark, sf):
    links = scored_links(spark, sf)
    return rounded(reports.link_score_stats(links.where("idx % 4 <> 0"), links.where("idx % 4 = 0")), "mean", "std")


BUCKETED = "+ b as (select *, ts_us//43200000000*43200 as bucket from scored), "
LOWEST = """rk as (select *, row_number() over (partition by bucket order by score, idx) as r, count(*) over (partition by bucket) as n from b),
 bot as (select bucket, avg(score) as score from rk where r <= greatest(1, floor(n*0.01)) group by 1)"""


def half_days(spark, sf):
    return scored_links(spark, sf).withColumn("bucket", epoch_bucket("ts_us", 43200))


@query("bucket_score", sql("scored", body=BUCKETED + LOWEST + " select bucket, round(score,6) as score from bot"))
def bucket_score(spark, sf):
    return rounded(reports.bucket_score(half_days(spark, sf)), "score")


@query("bucket_score_min", sql("scored", body=BUCKETED.rstrip(", ") + " select bucket, round(min(score),6) as score from b group by 1"))
def bucket_score_min(spark, sf):
    return rounded(reports.bucket_score(half_days(spark, sf), "min"), "score")


@query("bucket_label", sql("scored", body=BUCKETED.rstrip(", ") + " select bucket, max(label) as label from b group by 1"))
def bucket_label(spark, sf):
    return reports.bucket_label(half_days(spark, sf))


@query("bucket_details", sql("scored", body=BUCKETED.replace("43200000000*43200", "900000000*900") + LOWEST + """,
 pl as (select bucket, count(*) as n, avg(score) as m, min(score) as lo from b group by 1),
 tr as (select bucket, count(*) filter (where label=0) as benign, count(*) filter (where label=1) as anomalous from b group by 1)
 select bucket, coalesce(benign,0) as benign, coalesce(anomalous,0) as anomalous, coalesce(n,0) as predicted_links, round(m,6) as mean_score,
 round(lo,6) as min_score, round(score,6) as bottom_score, cast(coalesce(anomalous,0)>0 as int) as suspicious
 from tr full outer join pl using (bucket) left join bot using (bucket)"""))
def bucket_details(spark, sf):
    links = reports.bucketed(scored_links(spark, sf))
    found = reports.bucket_details(links, links)
    return rounded(found, "mean_score", "min_score", "bottom_score")


@query("validation_thresholds", sql("scored", body=BUCKETED + LOWEST + """, mn as (select bucket, min(score) as score from b group by 1)
 select 'min' as method, round(min(score),6) as lowest, round(avg(score),6) as mean from mn union all select 'bottom', round(min(score),6), round(avg(score),6) from bot"""))
def validation_thresholds(spark, sf):
    return rounded(reports.validation_thresholds(half_days(spark, sf)), "lowest", "mean")


@query("bucket_threshold_eval", sql("scored", body=BUCKETED + LOWEST + f""", m as (select max(label) as label, bucket from b group by 2),
 z as (select m.label, (1-bot.score >= 0.998)::int as z from m left join bot using (bucket)) select tn, fp, fn, tp, {RATES} from (select {CELLS} from z)"""))
def bucket_threshold_eval(spark, sf):
    links = half_days(spark, sf)
    return rounded(reports.bucket_threshold_eval(links, links, "bottom", 0.998, invert=True), *RATE_NAMES)


@query("bucket_score_histogram", sql("scored", body=BUCKETED + LOWEST + """, w as (select bot.score, l.label from bot join (select bucket, max(label) as label from b group by 1) l using (bucket)),
 f as (select min(score) as lo, max(score) as hi, least(200, greatest(50, 2*count(*))) - 1 as bins from w)
 select cast(least(floor((score-lo)*bins/(hi-lo)), bins-1) as bigint) as bin, count(*) filter (where label=0) as benign, count(*) filter (where label=1) as anomalous from w, f group by 1"""))
def bucket_score_histogram(spark, sf):
    links = half_days(spark, sf)
    labels = reports.bucket_label(links)
    return metrics.bucket_score_histogram(reports.bucket_score(links).join(labels, "bucket"))


@query("edge_anomaly_report", sql("scored", body=RANKED.replace("from scored", "from an").replace("+ f", "+ an as (select 1-score as score, label from scored), f") + f""",
 best as (select score as t, 2*tp/(tp+fp+tot_p)::double as f from r order by 2 desc, 1 desc limit 1), z as (select label, (score>t)::int as z from an, best),
 cm as (select {CELLS} from z)
 select (select sum(label)::bigint from an) as positives, (select sum(1-label)::bigint from an) as negatives, round((select auc from ({auc_sql('an')})),6) as auc,
 round((select ap from ({ap_sql('an')})),6) as ap, (select round(f,6) from best) as best_f1, (select round(t,6) from best) as best_threshold, tn, fp, fn, tp, {RATES} from cm"""))
def edge_anomaly_report(spark, sf):
    links = scored_links(spark, sf).withColumn("anomaly", F.lit(1.0) - F.col("score"))
    return rounded(reports.edge_anomaly_report(links), "auc", "ap", "best_f1", "best_threshold", *RATE_NAMES)


# the conformal mask of every batch, from the table that adaptive_conformal returns
MASKED = f""", an as (select err as score, label, (err > threshold)::int as z from test join steps using (stream, batch) join scored using (idx)),
 f as (select score, sum(label) as p, sum(1-label) as n from an group by 1),
 r as (select *, sum(p) over (order by score desc) as tp, sum(n) over (order by score desc) as fp, sum(p) over () as tot_p from f),
 best as (select score as t, 2*tp/(tp+fp+tot_p)::double as f from r order by 2 desc, 1 desc limit 1), cm as (select {CELLS} from an)
 select (select sum(label)::bigint from an) as positives, (select sum(1-label)::bigint from an) as negatives, round((select auc from ({auc_sql('an')})),6) as auc,
 round((select ap from ({ap_sql('an')})),6) as ap, (select round(f,6) from best) as best_f1, (select round(t,6) from best) as best_threshold, tn, fp, fn, tp, {RATES},
 (select round(avg(z),6) from an) as miscoverage from cm"""


@query("edge_anomaly_report_calibrated", adaptive_sql(MASKED))
def edge_anomaly_report_calibrated(spark, sf):
    links = stream_links(spark, sf)
    dense = running_totals(links.where("idx % 3 <> 0"), ["stream"], ["idx"], {"_place": F.lit(1).cast("long")})
    test = dense.drop("idx").withColumnRenamed("_place", "idx")
    levels = conformal.adaptive_conformal(test, links.where("idx % 3 = 0"), key="stream")
    joined = test.withColumns({"batch": batch_number().cast("long"), "anomaly": F.lit(1.0) - F.col("score")})
    return rounded(reports.edge_anomaly_report(joined, levels=levels), "auc", "ap", "best_f1", "best_threshold", "miscoverage", *RATE_NAMES)


@query("window_anomaly_report", sql("scored", body=BUCKETED.replace("43200000000*43200", "900000000*900") + LOWEST + f""",
 w as (select l.label, 1-coalesce(bot.score, 1.0) as score from (select bucket, max(label) as label from b group by 1) l left join bot using (bucket)),
 f as (select score, sum(label) as p, sum(1-label) as n from w group by 1),
 r as (select *, sum(p) over (order by score desc) as tp, sum(n) over (order by score desc) as fp, sum(p) over () as tot_p from f),
 q as (select score as t, 2*(tp/(tp+fp)::double*(tp/tot_p::double))/(tp/(tp+fp)::double+tp/tot_p::double+1e-8) as f1 from r order by 2 desc, 1 limit 1),
 z as (select label, (score>=t)::int as z from w, q), cm as (select {CELLS} from z)
 select (select count(*) from w) as num_windows, (select round(avg(label),6) from w) as anomaly_share, round((select auc from ({auc_sql('w')})),6) as auc,
 round((select ap from ({ap_sql('w')})),6) as ap, (select round(t,6) from q) as best_threshold, (select round(f1,6) from q) as f1, tn, fp, fn, tp,
 round(coalesce(tp/nullif(tp+fp,0)::double,0),6) as precision, round(coalesce(tp/nullif(tp+fn,0)::double,0),6) as recall from cm"""))
def window_anomaly_report(spark, sf):
    links = scored_links(spark, sf)
    found = reports.window_anomaly_report(links, links)
    return rounded(found, "anomaly_share", "auc", "ap", "best_threshold", "f1", "precision", "recall")


@query("link_report", sql("scored", body=f"""+ x as (select score, (label=0)::int as label from scored), z as (select label, (score>0.5)::int as z from x), cm as (select {CELLS} from z)
 select (select sum(label)::bigint from x) as positives, (select sum(1-label)::bigint from x) as negatives, round((select auc from ({auc_sql('x')})),6) as auc,
 round((select ap from ({ap_sql('x')})),6) as ap, tn, fp, fn, tp, {RATES} from cm"""))
def link_report(spark, sf):
    links = scored_links(spark, sf)
    return rounded(reports.link_report(links.where("label = 0"), links.where("label = 1")), "auc", "ap", *RATE_NAMES)


def by_source_sql(score: str) -> str:
    return f"""+ raw as (select idx, {score} as score, label from scored), pos as (select score, 1 as label from raw where label=0),
 src as (select unnest(['historical','inductive','random']) as negative_source),
 y as (select negative_source, score, label from pos, src union all select case idx%3 when 0 then 'random' when 1 then 'historical' else 'inductive' end, score, 0 from raw where label=1),
 lim as (select negative_source, min(score) as lo, max(score) as hi from y group by 1),
 x as (select negative_source, case when lo<0 or hi>1 then (score-lo)/(hi-lo) else score end as score, label from y join lim using (negative_source)),
 m as (select negative_source, sum(label)::bigint as positives, sum(1-label)::bigint as negatives, count(*) filter (where score<=0.5 and label=0) as tn, count(*) filter (where score>0.5 and label=0) as fp,
  count(*) filter (where score<=0.5 and label=1) as fn, count(*) filter (where score>0.5 and label=1) as tp from x group by 1)
 select m.*, round(auc,6) as auc, round(ap,6) as ap, round((tp+tn)/(positives+negatives)::double,6) as accuracy, round(coalesce(tp/nullif(tp+fp,0)::double,0),6) as precision,
 round(coalesce(tp/nullif(positives,0)::double,0),6) as recall, round(coalesce(2*tp/nullif(2*tp+fp+fn,0)::double,0),6) as f1
 from m join ({auc_sql('x', 'negative_source')}) a using (negative_source) join ({ap_sql('x', 'negative_source')}) b using (negative_source)"""


def by_source(spark, sf, score):
    links = scored_links(spark, sf).withColumn("score", score)
    third = F.col("idx") % 3
    source = F.when(third == 0, "random").when(third == 1, "historical").otherwise("inductive")
    wrong = links.where("label = 1").withColumn("negative_source", source)
    return rounded(reports.report_by_negative_source(links.where("label = 0"), wrong), "auc", "ap", "accuracy", "precision", "recall", "f1")


@query("report_by_negative_source", sql("scored", body=by_source_sql("score")))
def report_by_negative_source(spark, sf):
    return by_source(spark, sf, F.col("score"))


@query("report_by_negative_source_unbounded", sql("scored", body=by_source_sql("score*3-1")))
def report_by_negative_source_unbounded(spark, sf):
    return by_source(spark, sf, F.col("score") * 3 - 1)


@query("extreme_predictions", sql("scored", body="""+ ex as (select * from scored where label=0), ne as (select * from scored where label=1),
 x as ((select 'existing' as links, 'low' as e, * from ex order by score, idx limit 100) union all (select 'existing', 'high', * from ex order by score desc, idx limit 100)
 union all (select 'non_existing', 'high', * from ne order by score desc, idx limit 100) union all (select 'non_existing', 'low', * from ne order by score, idx limit 100))
 select links, e as "end", idx, src, dst, ts_us, round(score,6) as score, case src%3 when 0 then 'PROCESS' when 1 then 'FILE' else 'SHELL' end as src_type, '/n/' || src as src_path,
 case dst%3 when 0 then 'PROCESS' when 1 then 'FILE' else 'SHELL' end as dst_type, '/n/' || dst as dst_path from x"""))
def extreme_predictions(spark, sf):
    links = scored_links(spark, sf)
    nodes = nodes_of(links.select(F.col("src").alias("u"), F.col("dst").alias("i")))
    return rounded(reports.extreme_predictions(links.where("label = 0"), links.where("label = 1"), nodes), "score")

