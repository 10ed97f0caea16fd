"""Ordered helpers against brute force, with one key holding most rows and many equal times."""

import random

import numpy as np
import pytest

from edgetide.plans import ordered


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = []
    for n in range(400):
        key = 1 if rnd.random() < 0.6 else rnd.randrange(2, 9)
        out.append((n, key, rnd.randrange(60), rnd.randrange(100)))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, k long, t long, v long").cache()


def test_row_numbers(table, rows):
    got = [(r.rn, r.id) for r in ordered.row_numbers(table, ["t", "id"], "rn").collect()]
    expected = sorted(rows, key=lambda r: (r[2], r[0]))
    assert sorted(got) == [(n, r[0]) for n, r in enumerate(expected, 1)]


def test_running_totals(spark, table, rows):
    from pyspark.sql import functions as F

    got = ordered.running_totals(table, ["k"], ["t", "id"], {"s": F.col("v"), "n": F.lit(1)}).collect()
    expected, state = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        total, count = state.get(r[1], (0, 0))
        state[r[1]] = (total + r[3], count + 1)
        expected[r[0]] = state[r[1]]
    assert {r.id: (r.s, r.n) for r in got} == expected


def test_next_row(table, rows):
    got = {r.id: r.nid for r in ordered.next_row(table, ["k"], ["t", "id"], {"nid": "id"}).collect()}
    expected = {}
    for key in {r[1] for r in rows}:
        chain = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        for a, b in zip(chain, [*chain[1:], None]):
            expected[a[0]] = b[0] if b else None
    assert got == expected


def test_quantiles(table, rows):
    at = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.k: r for r in ordered.quantiles(table, "v", at, ["k"]).collect()}
    for key in {r[1] for r in rows}:
        values = [r[3] for r in rows if r[1] == key]
        for name, q in at.items():
            assert got[key][name] == pytest.approx(np.quantile(values, q))
    whole = ordered.quantiles(table, "v", at).collect()[0]
    assert whole.c == pytest.approx(np.quantile([r[3] for r in rows], 0.5))


@pytest.mark.parametrize("k", [1, 4, 30])
def test_last_before(spark, table, rows, k):
    extra = spark.createDataFrame([(1, 1000), (1, -5), (2, 31), (77, 3)], "k long, t long")
    queries = table.select("k", "t").union(extra)
    got = ordered.last_before(table, queries, ["k"], "t", ["v"], k, tie=["id"]).collect()
    asked = {(r[1], r[2]) for r in rows} | {(1, 1000), (1, -5), (2, 31), (77, 3)}
    assert {(r.k, r.t) for r in got} == asked
    for r in got:
        earlier = sorted((x for x in rows if x[1] == r.k and x[2] < r.t), key=lambda x: (x[2], x[0]))
        assert [x.id for x in r.recent] == [x[0] for x in earlier[-k:]]


def test_last_at_or_before(spark, table, rows):
    points = table.where("id % 3 = 0").groupBy("k", "t").max("id").withColumnRenamed("max(id)", "p")
    got = ordered.last_at_or_before(points, table.select("id", "k", "t"), ["k"], "t", ["p"]).collect()
    for r in got:
        hits = [x for x in rows if x[1] == r.k and x[0] % 3 == 0 and x[2] <= r.t]
        expected = max(hits, key=lambda x: (x[2], x[0]))[0] if hits else None
        assert r.p == expected
    assert len(got) == len(rows)
