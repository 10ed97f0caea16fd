"""Literal cases for draws on large spaces, curves, reports, command lines and two-hop lists."""

import pytest
from pyspark.sql import functions as F

from edgetide.functions import text
from edgetide.operators import metrics, neighbors, reports
from edgetide.plans.sampling import draw, permuted, uniform


@pytest.mark.parametrize("size", [10**10, 10**17, 7, 2**32 + 1])
def test_permuted_reaches_the_whole_space(spark, size):
    rows = spark.range(400).where(F.col("id") < size).withColumn("size", F.lit(size)).withColumn("batch", F.lit(3))
    spots = [r[0] for r in rows.select(permuted(F.col("id"), F.col("size"), 5, "batch")).collect()]
    assert len(set(spots)) == len(spots) and min(spots) >= 0 and max(spots) < size
    if size > 1000:
        thirds = {s * 3 // size for s in spots}
        assert thirds == {0, 1, 2}


def test_steps_far_out_do_not_overflow(spark):
    row = spark.range(1).select(F.lit(10**17 - 1).alias("j"), F.lit(10**17).alias("size"), F.lit(1).alias("b"))
    assert 0 <= row.select(permuted(F.col("j"), F.col("size"), 5, "b")).first()[0] < 10**17


def test_draws_are_wide_and_even(spark):
    rows = spark.range(3000).select(draw(1, "id").alias("d"), uniform(1, "id").alias("u")).collect()
    assert max(r["d"] for r in rows) > 2**59 and all(0 <= r["u"] < 1 for r in rows)
    assert abs(sum(r["u"] for r in rows) / 3000 - 0.5) < 0.03
    assert len({r["d"] % 10**10 // 10**9 for r in rows}) == 10


def test_roc_curve_keeps_the_first_point(spark):
    rows = [(0.9, 1), (0.8, 1), (0.7, 1), (0.6, 0), (0.5, 1), (0.5, 0)]
    curve = metrics.roc_curve(spark.createDataFrame(rows, "score double, label int")).orderBy(F.col("threshold").desc()).collect()
    assert [tuple(r) for r in curve] == [(0.0, 0.0, float("inf")), (0.0, 0.25, 0.9), (0.0, 0.75, 0.7), (0.5, 0.75, 0.6), (1.0, 1.0, 0.5)]


def test_report_by_source_squashes_each_source(spark):
    positives = spark.createDataFrame([(4.0,), (3.0,), (0.0,)], "score double")
    negatives = spark.createDataFrame([(-4.0, "a"), (1.0, "a"), (0.2, "b"), (9.0, "b")], "score double, negative_source string")
    rows = {r["negative_source"]: r for r in reports.report_by_negative_source(positives, negatives).collect()}
    # a: [-4, 4] to [0, 1], 0.5 at 0, so 4, 3 and 1 are above; b: [0, 9] to [0, 1], 0.5 at 4.5, so only 9 is
    assert [rows["a"][c] for c in ("tn", "fp", "fn", "tp")] == [1, 1, 1, 2]
    assert [rows["b"][c] for c in ("tn", "fp", "fn", "tp")] == [1, 1, 3, 0]
    assert rows["a"]["recall"] == pytest.approx(2 / 3) and rows["a"]["precision"] == pytest.approx(2 / 3) and rows["b"]["f1"] == 0.0


def test_normalize_cmdline_strips_all_white_space(spark):
    rows = spark.createDataFrame([("\t Run  \n",), (" x　\x1c",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.normalize_cmdline("t")).collect()] == ["run", "x", None]


def test_neighbor_mean_over_ties_and_gaps(spark):
    edges = [(n + 1, 1, 10 + n % 4, 100 + n // 5) for n in range(40)]  # five interactions at each moment
    frame = spark.createDataFrame(edges, "idx long, u long, i long, ts_us long").withColumn("label", F.lit(0))
    vectors = {10: [1.0, 0.0], 11: [0.0, 2.0], 12: [4.0, 4.0], 1: [0.5, 0.5]}
    known = spark.createDataFrame(list(vectors.items()), "node long, vec array<double>")
    queries = frame.select(F.col("idx").alias("qid"), F.col("u").alias("node"), "ts_us")
    for gap in (3, 7, 2000):
        found = {r["qid"]: r["vec"] for r in neighbors.neighbor_mean(queries, frame, known, 2, gap=gap).collect()}
        for idx, u, _, ts in edges:
            line = [i for _, _, i, t in edges if t < ts][-gap:]
            seen = [vectors[i] for i in line if i in vectors]
            expected = [0.5 + (sum(v[d] for v in seen) / len(seen) if seen else 0.0) for d in (0, 1)]
            assert found[idx] == pytest.approx(expected)


def test_two_hop_takes_a_neighbours_whole_set(spark):
    edges = [(n + 1, 500, 1000 + n, 10 + n) for n in range(60)] + [(61, 1, 500, 100), (62, 1, 2, 200)]
    frame = spark.createDataFrame(edges, "idx long, u long, i long, ts_us long").withColumn("label", F.lit(0))
    found = {r["idx"]: r["two_hop_non_neighbors"] for r in neighbors.two_hop_non_neighbors(frame).collect()}
    assert found[62] == [1000 + n for n in range(60)] and found[61] == []
