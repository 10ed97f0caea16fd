"""Two-hop sets as rows: against a plain search, on stars, and drawn without writing the sets out."""

import random
import time

import pytest
from pyspark.sql import functions as F

from edgetide.operators import negatives, neighbors

EDGE = "idx long, u long, i long, ts_us long, label int"


def by_hand(rows, max_neighbors, stop_after):
    out = {}
    for idx, u, _, t, _ in rows:
        first = {}
        for _, a, b, s, _ in rows:
            if s < t:
                for x, y in ((a, b), (b, a)):
                    first.setdefault(x, {}).setdefault(y, s)
                    first[x][y] = min(first[x][y], s)
        order = sorted(first.get(u, {}).items(), key=lambda p: (p[1], p[0]))
        taken = set()
        for via, _ in order[:max_neighbors]:
            taken |= set(first.get(via, {}))
            if len(taken) > stop_after:
                break
        out[idx] = sorted(taken - {u} - set(first.get(u, {})))
    return out


def random_edges(seed, n=120, nodes=18, hub=True):
    rng = random.Random(seed)
    rows, moment = [], 0
    for k in range(n):
        moment += rng.choice([0, 1, 1, 7])
        u = 3 if hub and rng.random() < 0.3 else rng.randint(1, nodes)
        rows.append((k + 1, u, rng.randint(1, nodes), moment, 0))
    return rows


@pytest.mark.parametrize("limits", [(100, 20), (3, 4), (100, 0)])
def test_against_a_plain_search(spark, limits):
    for seed, nodes in ((1, 18), (2, 60)):
        rows = random_edges(seed, nodes=nodes)
        found = neighbors.two_hop_non_neighbors(spark.createDataFrame(rows, EDGE).repartition(3), *limits).collect()
        assert {r["idx"]: r["two_hop_non_neighbors"] for r in found} == by_hand(rows, *limits)


def test_draws_come_from_the_sets_and_reach_all_of_them(spark):
    rows = random_edges(3, 90, 40)
    edges, sets = spark.createDataFrame(rows, EDGE), by_hand(rows, 100, 20)
    hops = neighbors.two_hop_sets(edges)
    seen = {idx: set() for idx in sets}
    for seed in range(3):
        drawn = {r["idx"]: r["i"] for r in negatives.two_hop_draws(edges, hops, seed).collect()}
        assert set(drawn) == {idx for idx, far in sets.items() if far}
        assert all(i in sets[idx] for idx, i in drawn.items())
        for idx, i in drawn.items():
            seen[idx].add(i)
    assert max(len(s) for s in seen.values()) >= 2
    only_rest = {r["idx"]: r["i"] for r in negatives.two_hop_draws(edges.where("idx > 80"), hops, 1, attempts=1).collect()}
    assert all(i in sets[idx] for idx, i in only_rest.items())
    rows_of = neighbors.two_hop_candidates(edges, hops).collect()
    assert sorted((r["idx"], r["far"]) for r in rows_of) == sorted((idx, far) for idx, s in sets.items() for far in s)


def test_a_star_of_100_000_leaves(spark):
    hub = 10 ** 9
    outward = spark.range(100_000).select((F.col("id") + 1).alias("idx"), F.lit(hub).alias("u"), (F.col("id") + 1).alias("i"),
                                          F.col("id").alias("ts_us"), F.lit(0).alias("label"))
    inward = outward.select((F.col("idx") + 100_000).alias("idx"), F.col("i").alias("u"), F.col("u").alias("i"), (F.col("ts_us") + 100_000).alias("ts_us"), "label")
    begin = time.time()
    sets = neighbors.two_hop_sets(outward)
    assert sets.moments.count() == 0  # a leaf offers nothing but the hub
    # every leaf comes back once: it could reach all others, and a draw does not write them out
    back = neighbors.two_hop_sets(outward.unionByName(inward))
    assert back.reach.count() == 100_000 and back.moments.count() == 100_000
    drawn = negatives.two_hop_draws(inward, back)
    assert drawn.count() == 100_000 and drawn.where("i = idx - 100000 or i not between 1 and 100000").count() == 0
    assert time.time() - begin < 300
