"""Hops and walks by each strategy."""

import random

import pytest
from pyspark.sql import functions as F

from edgetide.operators import neighbors
from edgetide.plans import ordered

EDGE = "idx long, u long, i long, ts_us long, label int"


def graph(spark, seed=4, n=80, nodes=9):
    rng = random.Random(seed)
    rows = [(k + 1, 1 if rng.random() < 0.35 else rng.randint(1, nodes), rng.randint(1, nodes), 1_000_000 * (k // 2), 0) for k in range(n)]
    return rows, spark.createDataFrame(rows, EDGE).repartition(3)


def met_before(rows, node, moment):
    out = []
    for idx, u, i, t, _ in rows:
        if t < moment:
            out += [(t, idx, i)] if u == node else []
            out += [(t, idx, u)] if i == node else []
    return out


@pytest.mark.parametrize("strategy", neighbors.STRATEGIES)
def test_every_hop_is_earlier_and_complete(spark, strategy):
    rows, edges = graph(spark)
    queries = edges.select(F.col("idx").alias("qid"), F.col("u").alias("node"), "ts_us")
    found = neighbors.multi_hop_neighbors(queries, edges, 2, 3, strategy, scaling=0.05).collect()
    at = {(r["qid"], tuple(r["walk"])): r for r in found}
    assert len(at) == len(found)
    start = {idx: (u, t) for idx, u, _, t, _ in rows}
    children = {}
    for (qid, walk), r in at.items():
        node, moment = start[qid] if len(walk) == 1 else (at[qid, walk[:-1]]["neighbor"], at[qid, walk[:-1]]["ts_us"])
        assert (r["ts_us"], r["idx"], r["neighbor"]) in met_before(rows, node, moment)
        children.setdefault((qid, walk[:-1]), []).append((walk[-1], r["ts_us"]))
    for qid, (node, moment) in start.items():
        known = len(met_before(rows, node, moment))
        assert len(children.get((qid, ()), [])) == (min(known, 3) if strategy == "recent" else 3 * (known > 0))
    for siblings in children.values():
        assert [t for _, t in sorted(siblings)] == sorted(t for _, t in siblings)  # places follow time
    walks = neighbors.temporal_walks(queries, edges, 2, 3, strategy, scaling=0.05).collect()
    expected = sorted((q, [start[q][0], at[q, w[:1]]["neighbor"], r["neighbor"]], [start[q][1], at[q, w[:1]]["ts_us"], r["ts_us"]]) for (q, w), r in at.items() if len(w) == 2)
    assert sorted((r["qid"], r["nodes"], r["times"]) for r in walks) == expected


def test_draws_follow_the_strategy(spark):
    rows = [(n + 1, 1, 100 + n, n * 1_000_000, 0) for n in range(40)]
    edges = spark.createDataFrame(rows, EDGE)
    queries = spark.range(400).select(F.col("id").alias("qid"), F.lit(1).cast("long").alias("node"), F.lit(40_000_000).cast("long").alias("ts_us"))
    late = {}
    for strategy in ("uniform", "time_aware"):
        found = neighbors.multi_hop_neighbors(queries, edges, 1, 2, strategy, scaling=5.0)
        late[strategy] = found.where("neighbor >= 138").count() / 800
    assert 0.01 < late["uniform"] < 0.1 and late["time_aware"] > late["uniform"]


def test_unknown_strategy(spark):
    rows, edges = graph(spark)
    with pytest.raises(ValueError):
        neighbors.sampler(edges, 2, "newest")


def test_time_aware_hops_move_rows_once(spark, monkeypatch):
    """A hop joined its rows to the node's mass, looked draws up and placed them in a shuffle each (F8); busy nodes find the same."""
    rows, edges = graph(spark, n=160)
    queries = edges.select(F.col("idx").alias("qid"), F.col("u").alias("node"), "ts_us").unionByName(
        spark.createDataFrame([(900, None, 50_000_000), (901, 1, None), (902, 77, 50_000_000)], "qid long, node long, ts_us long"))
    stored, got = [], {}
    keep = neighbors.stored
    monkeypatch.setattr(neighbors, "stored", lambda df: stored.append(df.columns) or keep(df))
    for busy in (2_000_000, 40):
        monkeypatch.setattr(ordered, "BUSY", busy)
        walks = neighbors.temporal_walks(queries, edges, 2, 3, "time_aware", scaling=0.05)
        if busy == 2_000_000:
            assert walks._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
            assert "Join" not in walks._jdf.queryExecution().optimizedPlan().toString() and stored[0] == neighbors.WEIGHTED
        hops = neighbors.multi_hop_neighbors(queries, edges, 2, 3, "time_aware", scaling=0.05)
        got[busy] = [sorted(map(str, found.collect())) for found in (walks, hops)]
    assert got[40] == got[2_000_000] and len(got[40][0]) > 500


@pytest.mark.parametrize("strategy", ["uniform", "time_aware"])
def test_places_of_a_query_at_two_nodes_differ(spark, strategy):
    edges = graph(spark)[1]
    queries = spark.createDataFrame([(7, 1, 60_000_000), (7, 2, 60_000_000), (8, 1, 60_000_000)], "qid long, node long, ts_us long")
    found = neighbors.multi_hop_neighbors(queries, edges, 1, 3, strategy, scaling=0.05).collect()
    assert sorted((r.qid, r.walk[0]) for r in found) == [*((7, n) for n in range(6)), *((8, n) for n in range(3))]
