"""Ordered lookups by one shuffle of the keys, and keys too busy for a task beside them: equal results, little moved."""

import random

import pytest
from pyspark.sql import functions as F

from edgetide.operators import linkmodel, neighbors, textfeatures
from edgetide.plans import ordered

EDGE = "idx long, u long, i long, ts_us long"


def edge_rows(n, seed=3):
    rng = random.Random(seed)
    node = lambda: 1 if rng.random() < 0.5 else rng.randint(2, 9)
    rows = [(k + 1, node(), node(), 1_000_000 * (k // 3)) for k in range(n)]
    return [*rows, (n + 1, None, 3, 5), (n + 2, 1, 2, None), (n + 3, 4, None, 7_000_000), rows[5]]


def shuffles(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


@pytest.fixture(params=["one task", "both"])
def load(request, monkeypatch):
    """Rows that a key may have for one task: all, or all but those of node 1."""
    monkeypatch.setattr(ordered, "BUSY", {"one task": 2_000_000, "both": 60}[request.param])
    return request.param


def test_last_rows_move_once(spark, load):
    rows = edge_rows(90)
    edges = spark.createDataFrame(rows, EDGE).repartition(3)
    for k in (1, 3):
        found = neighbors.recent_neighbors(neighbors.edge_queries(edges), edges, k)
        if load == "one task":
            assert shuffles(found) == 1 and "Join" not in found._jdf.queryExecution().executedPlan().toString()
        got = sorted(((r.idx, r.side, r.recent and [x.idx for x in r.recent]) for r in found.collect()), key=str)
        expected = []
        for idx, u, i, t in rows:
            for side, node in (("src", u), ("dst", i)):
                line = [(s is not None, s, x, b) for x, u2, i2, s in rows for a, b in ((u2, i2), (i2, u2)) if a == node and node is not None and (s is None or (t is not None and s < t))]
                line.sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3] is not None, x[3] or 0))
                expected.append((idx, side, None if node is None or t is None else [x[2] for x in line[-k:]]))
        assert got == sorted(expected, key=str)


def test_totals_next_and_as_of(spark, load):
    rng = random.Random(5)
    rows = [(n, 1 if rng.random() < 0.6 else rng.randint(2, 6), rng.randrange(40), rng.randrange(9)) for n in range(200)]
    table = spark.createDataFrame(rows, "id long, k long, t long, v long").repartition(4)
    state, line = {}, sorted(rows, key=lambda r: (r[2], r[0]))
    totals, following, before = {}, {}, {}
    for r in line:
        state[r[1]] = totals[r[0]] = state.get(r[1], 0) + r[3]
        if r[1] in before:
            following[before[r[1]]] = r[0]
        before[r[1]] = r[0]
    assert {r.id: r.s for r in ordered.running_totals(table, ["k"], ["t", "id"], {"s": F.col("v")}).collect()} == totals
    assert {r.id: r.after for r in ordered.next_row(table, ["k"], ["t", "id"], {"after": "id"}).collect()} == {r[0]: following.get(r[0]) for r in rows}
    marks = table.groupBy("k", "t").agg(F.max("id").alias("p")).where("p % 3 = 0")
    points = {(r.k, r.t): r.p for r in marks.collect()}
    found = ordered.last_at_or_before(marks, table.select("id", "k", "t"), ["k"], "t", ["p"])
    if load == "one task":
        assert shuffles(found.select("id")) <= 2  # points are grouped first
    for r in found.collect():
        seen = [t for k, t in points if k == r.k and t <= r.t]
        assert r.p == (points[r.k, max(seen)] if seen else None)


def moved(monkeypatch, module):
    """Columns of every table that ``module`` stores."""
    seen, keep = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df: seen.append(df.dtypes) or keep(df))
    return seen


def test_links_and_means_of_busy_nodes(spark, monkeypatch):
    rows = [r for r in edge_rows(70, 8) if None not in r][:-1]
    edges = spark.createDataFrame(rows, EDGE).repartition(3)
    table = spark.createDataFrame([(n, [n * 0.5, 1.0 - n, float(n % 3)]) for n in range(1, 9)], "node long, vec array<double>")
    links = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)] + [(900, None, 2, 9_000_000), (901, 1, None, 9_000_000), (902, 1, 2, None)],
                                  "cid long, u long, i long, ts_us long")
    asks = spark.createDataFrame([(n, r[1], r[3]) for n, r in enumerate(rows)], "qid long, node long, ts_us long")
    seen = moved(monkeypatch, linkmodel)
    got = {}
    for busy in (2_000_000, 60):
        monkeypatch.setattr(ordered, "BUSY", busy)
        features = linkmodel.link_features(links, edges, table, 3, k=4).orderBy("cid").collect()
        means = neighbors.neighbor_mean(asks, edges, table, 3, gap=5).orderBy("qid").collect()
        got[busy] = [[x for x in r if not isinstance(x, list)] for r in features], [x for r in means for x in r.vec]
        if busy == 2_000_000:
            assert seen and not any(kind == "array<double>" for columns in seen for _, kind in columns)
    for a, b in zip(got[60][0], got[2_000_000][0], strict=True):
        assert a == pytest.approx(b)
    assert got[60][1] == pytest.approx(got[2_000_000][1])


def test_imputed_tokens_move_as_numbers(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{n}" for n in range(12)]
    vectors = spark.createDataFrame([(w, [rng.gauss(0, 1) for _ in range(3)]) for w in words], "token string, vec array<double>")
    rows = [(n % 9 if n % 4 else None, [rng.choice([*words, "?", "!", "x"]) for _ in range(rng.randrange(30))]) for n in range(14)] + [(50, ["?"] * 9), (51, None)]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>")
    seen, got = moved(monkeypatch, textfeatures), []
    for most in (2_000_000, 0):
        monkeypatch.setattr(textfeatures, "BROADCAST_NUMBERS", most)
        found = textfeatures.impute_unknown_tokens(docs, vectors, 3).collect()
        got.append(sorted(((str(r.id), r.pos, r.token, [round(x, 9) for x in r.vec]) for r in found)))
    assert got[0] == got[1] and len(got[0]) == sum(t in "?!x" for _, tokens in rows for t in tokens or [])
    assert seen and not any("double" in kind for columns in seen for _, kind in columns)
