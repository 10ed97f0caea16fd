"""Corpora, token vectors, text features and template enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgetide.catalog.basics import (
    DESCRIBE_SQL, MATCH_SQL, RULE_FIELDS, RULES, elements, template_logs,
)
from edgetide.catalog.fixtures import flat_events, nodes_of, r6, raw_logs, sql, sql_digest, table, transition_edges
from edgetide.catalog.registry import query
from edgetide.functions.text import last_part
from edgetide.operators import linkmodel, negatives, textfeatures as tx
from edgetide.operators.events import text_corpus
from edgetide.operators.metrics import roc_auc
from edgetide.plans.ordered import quantiles, row_numbers
from edgetide.session import stored

DIM = 64
# a vocabulary with vectors: all words of the benchmark items in order, each with the next embedding
VOCABULARY = """bw as (select distinct unnest(string_split_regex(lower(text), '[^a-z]+')) as token from benchmark),
 voc as (select token, row_number() over (order by token) - 1 as n from bw where token <> ''),
 vec as (select token, list_transform(embedding, lambda x: x::double) as v from voc join embeddings on vec_id = n % (select count(*) from embeddings))"""
TOKENS = "tok as (select doc_id, string_split_regex(lower(text), '[^a-z]+') as tokens from documents)"


def vocabulary(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token"))
    numbered = row_numbers(words.where("token <> ''").distinct(), ["token"], "n", start=0)
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    count = vectors.agg(F.count("*")).scalar()
    return numbered.withColumn("vec_id", F.pmod("n", count)).join(vectors, "vec_id").select("token", "vec")


def tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.split(F.lower("text"), "[^a-z]+").alias("tokens"))


@query("text_corpus", sql("logs", body="select text, count(*) as n from (select unnest([image_path, file_path, command_line]) as text from logs) where text is not null group by 1"))
def text_corpus_query(spark, sf):
    return text_corpus(flat_events(spark, sf)).groupBy("text").agg(F.count("*").alias("n"))


@query("sample_corpus", f"""select doc_id from (select doc_id, row_number() over (order by {sql_digest(0, 'doc_id')}, doc_id) as r from documents)
 where r <= (select ceil(0.01*count(*)) from documents)""")
def sample_corpus(spark, sf):
    return tx.sample_corpus(table(spark, sf, "documents").select("doc_id"), 0.01, key="doc_id")


# SQL can say which words get a vector
@query("train_token_vectors", f"""with {TOKENS}, w as (select unnest(tokens) as token from tok)
 select token, 16 as dim from w group by 1 having count(*) >= 5""")
def train_token_vectors(spark, sf):
    corpus = tokens(spark, sf)
    found = tx.train_token_vectors(corpus, dim=16, epochs=1, seed=1, min_count=5, partitions=8)
    return found.select("token", F.size("vec").alias("dim"))


def mean_sql(weight: str) -> str:
    return f"""+ {VOCABULARY}, {TOKENS}, t as (select doc_id, unnest(tokens) as token, unnest(range(0, len(tokens))) as k, len(tokens) as n from tok),
 m as (select doc_id, pos, avg(x*({weight})) as x from (select doc_id, k, n, unnest(range(0, {DIM})) as pos, unnest(v) as x from t join vec using (token)) group by 1,2),
 al as (select pos, avg(x) as x from (select unnest(range(0, {DIM})) as pos, unnest(v) as x from vec) group by 1)
 select documents.doc_id, al.pos::int as pos, round(coalesce(m.x, al.x), 6) as value from documents cross join al left join m on m.doc_id=documents.doc_id and m.pos=al.pos"""


@query("mean_token_vector", "with " + mean_sql("1").removeprefix("+ "))
def mean_token_vector(spark, sf):
    return elements(tx.mean_token_vector(tokens(spark, sf), vocabulary(spark, sf), DIM, "doc_id"), "doc_id", "vec")


@query("mean_token_vector_weighted", "with " + mean_sql("1.0 - k/(n+1)::double").removeprefix("+ "))
def mean_token_vector_weighted(spark, sf):
    rows = tokens(spark, sf)
    weights = F.transform("tokens", lambda t, k: F.lit(1.0) - k / (F.size("tokens") + 1))
    found = tx.mean_token_vector(rows.withColumn("weights", weights), vocabulary(spark, sf), DIM, "doc_id")
    return elements(found, "doc_id", "vec")


@query("similar_tokens", """with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), q as (select e from v where vec_id=0)
 select v.vec_id::varchar as token, round(list_cosine_similarity(v.e, q.e), 6) as similarity from v, q order by list_cosine_similarity(v.e, q.e) desc, token limit 10""")
def similar_tokens(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("token"), F.col("embedding").alias("vec"))
    target = vectors.where("vec_id = 0").agg(F.min("vec")).scalar()
    return tx.similar_tokens(vectors, target, 10).withColumn("similarity", r6("similarity"))


# every context against every token; similarities are compared to 12 digits
IMPUTED = f"""with {VOCABULARY}, {TOKENS}, t as (select doc_id, unnest(tokens) as token, unnest(range(0, len(tokens)))::int as pos from tok),
 kn as (select doc_id, pos as near, v from t join vec using (token)),
 un as (select doc_id, pos, token from t where token not in (select token from vec)),
 el as (select un.doc_id, un.pos, unnest(range(0, {DIM})) as d, unnest(v) as x from (select *, unnest(range(pos - 5, pos + 6)) as near from un) un join kn on kn.doc_id=un.doc_id and kn.near=un.near),
 av as (select doc_id, pos, d, avg(x) as x from el group by 1,2,3), cx as (select doc_id, pos, list(x order by d)::double[{DIM}] as c from av group by 1,2),
 fv as (select token, v::double[{DIM}] as v from vec),
 top as (select doc_id, pos, arg_min(fv.token, (-round(array_cosine_similarity(c, fv.v), 12), fv.token), 2) as t from cx cross join fv group by 1,2),
 fi as (select doc_id, pos, list_transform(list_zip(a.v, b.v), lambda z: (z[1] + z[2]) / 2) as v from top join vec a on a.token=t[1] join vec b on b.token=t[2]),
 al as (select list(x order by d) as v from (select d, avg(x) as x from (select unnest(range(0, {DIM})) as d, unnest(v) as x from vec) group by 1))
 select un.doc_id, un.pos, un.token, list_aggregate(list_transform(coalesce(fi.v, al.v), lambda x: round(x * 1000000)::bigint::varchar), 'string_agg', ',') as vec
 from un left join fi using (doc_id, pos) cross join al"""


@query("impute_unknown_tokens", IMPUTED)
def impute_unknown_tokens(spark, sf):
    text = lambda vec: F.array_join(F.transform(vec, lambda x: F.round(x * 1_000_000).cast("long").cast("string")), ",")
    return tx.impute_unknown_tokens(tokens(spark, sf), stored(vocabulary(spark, sf)), DIM, key="doc_id", shown=text)


@query("entity_features", sql("logs", body="""+ v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
 x as (select id, object_type, v.e from logs left join v on v.vec_id=cast(pid as int))
 select id, unnest(range(0,66))::int as pos, round(unnest([(object_type='PROCESS')::int::double, (object_type='FILE')::int::double] || coalesce(e, list_transform(range(0,64), lambda n: 0.0::double))),6) as value from x"""))
def entity_features(spark, sf):
    logs = raw_logs(spark, sf).select("id", "object", F.col("pid").cast("long").alias("vec_id"))
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    text = logs.join(vectors, "vec_id").select("id", "vec")
    found = tx.entity_features(logs, "object", text, tx.NODE_FEATURE_TYPES, DIM)
    return elements(found, "id", "features")


@query("entity_features_none", sql("logs", body="select id, unnest(range(0,10))::int as pos, case when pos = list_position(['OPEN','CREATE','TERMINATE','MODIFY','WRITE','RENAME','READ','DELETE'], action_type) - 1 then 1.0 else 0.0 end as value from logs"))
def entity_features_none(spark, sf):
    logs = raw_logs(spark, sf).select("id", "action")
    return elements(tx.entity_features(logs, "action", None, tx.EDGE_FEATURE_ACTIONS, 2), "id", "features")


@query("stratified_log_sample", sql("logs", body=rf"""+ b as (select id, lower(string_split(parent_image_path, '\')[-1]) as bucket from logs),
 r as (select *, row_number() over (partition by bucket order by {sql_digest(0, 'id')}, id) as r from b)
 select id, bucket from r where r <= greatest(1, 500 // (select count(distinct bucket) from b)) order by r, bucket limit 500"""))
def stratified_log_sample(spark, sf):
    logs = raw_logs(spark, sf).select("id", F.col("properties.parent_image_path").alias("parent_image_path"))
    return tx.stratified_log_sample(logs, 500).select("id", "bucket")


@query("dedup_enrich", sql("logs", body=f"""+ m as (select *, {MATCH_SQL} as pattern_id from logs)
 select id, pattern_id, {DESCRIBE_SQL} as description from m"""))
def dedup_enrich(spark, sf):
    fields = RULE_FIELDS | {"parent_image_path": "parent_image_path"}
    unique = {k: v for k, v in fields.items() if k != "parent_image"}
    found = tx.dedup_enrich(template_logs(spark, sf).withColumn("parent_image", F.col("parent_image_path")), RULES,
                            unique | {"parent_image": "parent_image"})
    return found.select("id", "pattern_id", "description")


@query("last_path_part", sql("logs", body=r"select id, string_split(parent_image_path, '\')[-1] as program from logs"))
def last_path_part(spark, sf):
    return raw_logs(spark, sf).select("id", last_part("properties.parent_image_path").alias("program"))


def entity_vectors(spark, sf):
    """(node, vec): one-hot type and text vector of every node of the transition graph."""
    nodes = nodes_of(transition_edges(spark, sf)).select(F.col("node_id").alias("id"), "object_type")
    text = table(spark, sf, "embeddings").select((F.col("vec_id") + 1).alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    found = tx.entity_features(nodes, "object_type", text, tx.NODE_FEATURE_TYPES, DIM)
    return found.select(F.col("id").alias("node"), F.col("features").alias("vec"))


WIDTH = len(tx.NODE_FEATURE_TYPES) + DIM
# every feature of every edge worked out by itself, k = 20
LINKS = f"""+ ev as (select node_id as node, [(object_type='PROCESS')::int::double, (object_type='FILE')::int::double] || coalesce(list_transform(embedding, lambda x: x::double), list_transform(range(0, {DIM}), lambda n: 0.0::double)) as v
  from nodes left join embeddings on vec_id = node_id - 1),
 hf as (select u as node, i as neighbor, ts_us, idx, 1 as o from tr union all select i, u, ts_us, idx, 0 from tr),
 q as (select idx as qidx, 'src' as side, u as node, i as other, ts_us as mo from tr union all select idx, 'dst', i, u, ts_us from tr),
 al as (select q.*, hf.neighbor, hf.ts_us as nts, o, row_number() over (partition by qidx, side order by hf.ts_us desc, hf.idx desc, hf.neighbor desc, o desc) as r from q join hf on hf.node=q.node and hf.ts_us < q.mo),
 mv as (select qidx, side, list(x order by d) as s from (select a.qidx, a.side, e.d, sum(a.c * e.x) as x from (select qidx, side, neighbor, count(*) as c from al group by all) a join (select node, unnest(range(0, {WIDTH})) as d, unnest(v) as x from ev) e on e.node=a.neighbor group by 1,2,3) group by 1,2),
 st as (select qidx, side, count(*) filter (r <= 20) as known, max(nts) as latest, count(*) as total, sum(o) as out, count(*) filter (r <= 20 and neighbor = other) as met, max(nts) filter (r <= 20 and neighbor = other) as met_at,
  list_distinct(list(neighbor) filter (r <= 20)) as ids, {", ".join(f"avg(cos((mo-nts)/1e6 * pow(10.0, -9.0 * {n} / 3))) filter (r <= 20) as w{n}" for n in range(4))} from al group by 1,2),
 f as (select q.qidx, q.side, q.mo, coalesce(known, 0)::double as known, ln(1 + coalesce((q.mo - latest)/1e6, 1e7)) as age, ln(1 + coalesce(total, 0)) as total, ln(1 + coalesce(out, 0)) as out, coalesce(met, 0)::double as met,
  met_at, coalesce(ids, []) as ids, {", ".join(f"coalesce(w{n}, 0) as w{n}" for n in range(4))}, coalesce(list_cosine_similarity(mv.s, ov.v), 0) as fit, sv.v as own
  from q left join st using (qidx, side) left join mv using (qidx, side) join ev sv on sv.node=q.node join ev ov on ov.node=q.other)
 select s.qidx as cid, {", ".join(f"round({a}.{n}, 6) as {name}_{n}" for a, name in (("s", "src"), ("d", "dst")) for n in ("known", "age", "total", "out", "fit"))},
  s.met as met_in_src, d.met as met_in_dst, len(list_intersect(s.ids, d.ids))::double as common, round(ln(1 + coalesce((s.mo - s.met_at)/1e6, 1e7)), 6) as met_ago, round(coalesce(list_cosine_similarity(s.own, d.own), 0), 6) as own_fit,
  {", ".join(f"round({a}.w{n}, 6) as {name}_wave{n}" for a, name in (("s", "src"), ("d", "dst")) for n in range(4))}
 from f s join f d on d.qidx=s.qidx and d.side='dst' where s.side='src'"""


@query("link_features", sql("tr", "nodes", body=LINKS))
def link_features(spark, sf):
    edges = transition_edges(spark, sf)
    candidates = edges.select(F.col("idx").alias("cid"), "u", "i", "ts_us")
    found = linkmodel.link_features(candidates, edges, entity_vectors(spark, sf), WIDTH)
    return found.select("cid", *[r6(c).alias(c) for c in linkmodel.FEATURES])


@query("link_classifier")
def link_classifier(spark, sf):
    """AUC of the fitted link score on later edges against random destinations."""
    edges = transition_edges(spark, sf)
    drawn = negatives.random_negatives(edges, edges)
    columns = ["u", "i", "ts_us"]
    both = edges.select(F.concat(F.lit("p"), "idx").alias("cid"), *columns, F.lit(1).alias("label")).unionByName(
        drawn.select(F.concat(F.lit("n"), "idx").alias("cid"), *columns, F.lit(0).alias("label"))
    )
    cut = quantiles(edges, "ts_us", {"c": 0.7}).first()["c"]
    known = linkmodel.numbered_vectors(entity_vectors(spark, sf))
    features = stored(linkmodel.link_features(both, edges, known, WIDTH, numbered=True))
    model = linkmodel.fit_link_classifier(features.where(F.col("ts_us") <= cut), known=known)
    scored = linkmodel.score_links(model, features.where(F.col("ts_us") > cut), known, WIDTH)
    return roc_auc(scored).select(r6("auc", 3).alias("auc"))

