"""Features of candidate links and reports under conformal masks, against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgetide.operators import conformal, linkmodel, metrics, paths, reports, textfeatures

EDGE = "idx long, u long, i long, ts_us long"


def test_link_features_by_hand(spark):
    rng = random.Random(9)
    rows = [(n + 1, 1 if rng.random() < 0.4 else rng.randint(1, 6), rng.randint(1, 6), 1_000_000 * (n // 2)) for n in range(50)]
    edges = spark.createDataFrame(rows, EDGE).repartition(3)
    vectors = {n: [rng.gauss(0, 1) for _ in range(3)] for n in range(1, 6)}
    vectors[4] = [float("inf"), 0.0, 1.0]  # of no use to anyone's mean
    table = spark.createDataFrame(list(vectors.items()), "node long, vec array<double>")
    asked = [(n, *r[1:]) for n, r in enumerate(rows)] + [(90, 1, 2, 0), (91, 7, 8, 99_000_000)]
    found = linkmodel.link_features(spark.createDataFrame(asked, "cid long, u long, i long, ts_us long"), edges, table, 3, k=4).collect()

    def cos(a, b):
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.dot(a, b) / size) if size else 0.0

    def state(node, moment):
        line = []
        for idx, u, i, t in rows:
            if t < moment:
                line += [(t, idx, i, 1)] if u == node else []
                line += [(t, idx, u, 0)] if i == node else []
        return sorted(line)

    assert len(found) == len(asked)
    for r in found:
        both = {"src": state(r["u"], r["ts_us"]), "dst": state(r["i"], r["ts_us"])}
        for side, other, far in (("src", "dst", r["i"]), ("dst", "src", r["u"])):
            line, recent = both[side], both[side][-4:]
            assert r[f"{side}_known"] == len(recent) and r[f"{side}_total"] == pytest.approx(math.log1p(len(line)))
            assert r[f"{side}_out"] == pytest.approx(math.log1p(sum(x[3] for x in line)))
            age = (r["ts_us"] - line[-1][0]) / 1e6 if line else 1e7
            assert r[f"{side}_age"] == pytest.approx(math.log1p(age))
            total = np.sum([vectors[x[2]] for x in line if x[2] in vectors and x[2] != 4], axis=0) if line else np.zeros(3)
            own = vectors.get(far, [0.0] * 3)
            if far != 4:
                assert r[f"{side}_fit"] == pytest.approx(cos(np.zeros(3) + total, own))
            for n in range(linkmodel.WAVES):
                waves = [math.cos((r["ts_us"] - x[0]) / 1e6 * 10 ** (-9 * n / 3)) for x in recent]
                assert r[f"{side}_wave{n}"] == pytest.approx(sum(waves) / len(waves) if waves else 0.0)
        assert r["met_in_src"] == sum(x[2] == r["i"] for x in both["src"][-4:])
        assert r["common"] == len({x[2] for x in both["src"][-4:]} & {x[2] for x in both["dst"][-4:]})
    assert linkmodel.link_features(spark.createDataFrame(asked, "cid long, u long, i long, ts_us long"), edges).where("src_fit <> 0").count() == 0


@pytest.mark.parametrize("form", ["roc", "pr"])
def test_sweep_report_is_the_separate_metrics(spark, form):
    rng = np.random.default_rng(3)
    rows = [(float(np.round(rng.random(), 1)), int(rng.random() < 0.3)) for _ in range(80)]
    table = spark.createDataFrame(rows, "score double, label int")
    got = metrics.sweep_report(table, form).first()
    best = metrics.best_f1_threshold(table, form).first()
    marked = table.withColumn("prediction", metrics.predicted("score", F.lit(best["best_threshold"]), form == "pr"))
    cells = metrics.confusion(marked).first()
    assert got["auc"] == pytest.approx(metrics.roc_auc(table).first()["auc"]) and got["ap"] == pytest.approx(metrics.average_precision(table).first()["ap"])
    assert (got["best_f1"], got["best_threshold"]) == (pytest.approx(best["f1"]), best["best_threshold"])
    assert [got[c] for c in ("tn", "fp", "fn", "tp")] == [cells[c] for c in ("tn", "fp", "fn", "tp")]


def test_report_under_the_mask_of_every_batch(spark):
    rng = np.random.default_rng(5)
    cal = spark.createDataFrame([(float(s),) for s in rng.random(50)], "score double")
    rows = [("a" if n % 3 else "b", n // 3 + 1 if n % 3 == 0 else n - n // 3, float(rng.random()), int(rng.random() < 0.2)) for n in range(150)]
    test = spark.createDataFrame(rows, "stream string, idx long, score double, label int")
    levels = conformal.adaptive_conformal(test, cal, alpha=0.2, rate=0.2, batch=16, key="stream")
    joined = test.withColumns({"batch": F.floor((F.col("idx") - 1) / 16), "anomaly": 1 - F.col("score")})
    got = reports.edge_anomaly_report(joined, levels=levels).first()
    limit = {(r["stream"], r["batch"]): r["threshold"] for r in levels.collect()}
    flags = [(label, int(1 - score > limit[s, (idx - 1) // 16])) for s, idx, score, label in rows]
    assert [got[c] for c in ("tn", "fp", "fn", "tp")] == [sum(f == p for f in flags) for p in ((0, 0), (0, 1), (1, 0), (1, 1))]
    assert got["miscoverage"] == pytest.approx(np.mean([z for _, z in flags]))
    # a batch without a level takes the last earlier one of its stream, and none before the first
    part = reports.edge_anomaly_report(joined, levels=levels.where("batch = 1")).first()
    late = [(label, int(b >= 1 and 1 - score > limit[s, 1])) for s, idx, score, label in rows for b in [(idx - 1) // 16]]
    assert part["tp"] == sum(f == (1, 1) for f in late) and part["fp"] == sum(f == (0, 1) for f in late)


def test_paths_in_train_by_hand(spark):
    rng = random.Random(2)
    kinds = "abc"

    def edges(n, start):
        return [(k, rng.randint(1, 6), rng.randint(1, 6), start + k // 2, rng.choice(kinds), rng.choice([None, "x", "y", "z"]), 0) for k in range(n)]

    def signed(rows):
        full = [(i, u, v, t, f"T{u % 3}", f"T{v % 3}", act, cmd, label) for i, u, v, t, act, cmd, label in rows]
        return full, spark.createDataFrame(full, "idx long, u long, i long, ts_us long, object_type_src string, object_type_dst string, action_type string, command_line string, label int")

    train, now = edges(40, 0), edges(60, 100)
    (a, first), (b, second) = signed(train), signed(now)
    got = {tuple(r) for r in paths.paths_in_train(second, first).collect()}
    heads, tails = {(r[2], r[4], r[5], r[6], r[7]) for r in a}, {(r[1], r[5], r[6], r[7]) for r in a}
    expected = {(x[4], x[5], y[5], x[6], x[7], y[6], y[7]) for x in b for y in b if x[2] == y[1] and y[3] > x[3]
                and (x[2], x[4], x[5], x[6], x[7]) in heads and (y[1], y[5], y[6], y[7]) in tails}
    assert got == expected and expected


def test_nearest_tokens_with_equal_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = {f"t{n:03d}": rng.normal(size=8).tolist() for n in range(60)}
    vectors |= {f"a{n}": vectors["t005"] for n in range(4)}  # equal vectors: ties go to the smaller token
    vectors["zero"] = [0.0] * 8
    contexts = [(f"c{n}", rng.normal(size=8).tolist()) for n in range(40)] + [("same", vectors["t005"]), ("none", [0.0] * 8)]
    table = spark.createDataFrame(list(vectors.items()), "token string, vec array<double>")
    asked = spark.createDataFrame(contexts, "cid string, context array<double>")
    for blocks in ((7, 9), (10_000, 10_000)):
        got = {}
        for r in textfeatures.nearest_tokens(asked, table, 3, *blocks).orderBy("cid", F.desc("similarity"), "token").collect():
            got.setdefault(r["cid"], []).append(r["token"])
        for cid, c in contexts:
            size = lambda v: np.linalg.norm(v) * np.linalg.norm(c)
            order = sorted(vectors, key=lambda t: (-round(float(np.dot(vectors[t], c) / size(vectors[t])), 12) if size(vectors[t]) else 0.0, t))
            assert got[cid] == order[:3]
        assert got["same"] == ["a0", "a1", "a2"]


def test_links_are_fitted_without_their_vectors(spark, monkeypatch):
    """Every row's two vectors were stored, and kept again by the fit (F7); the model is that of Spark's own fit."""
    rng = random.Random(21)
    rows = [(n + 1, rng.randint(1, 8), rng.randint(1, 8), 1_000_000 * (n // 2)) for n in range(160)]
    edges = spark.createDataFrame(rows, EDGE)
    table = spark.createDataFrame([(n, [rng.gauss(0, 1) for _ in range(3)]) for n in range(1, 7)], "node long, vec array<double>")
    asked = [(f"a{n}", *r[1:], int(r[1] < r[2] or n % 5 == 0)) for n, r in enumerate(rows)] + [("c", 99, 2, 5, 1)]
    links = spark.createDataFrame(asked, "cid string, u long, i long, ts_us long, label int")
    known = linkmodel.numbered_vectors(table)
    apart = linkmodel.link_features(links, edges, known, 3, k=4, numbered=True)
    assert not any(kind.startswith("array") for _, kind in apart.dtypes)
    whole = linkmodel.link_features(links, edges, table, 3, k=4)
    ours, theirs = linkmodel.fit_link_classifier(apart, known=known), linkmodel.fit_link_classifier(whole)
    scores = lambda found: [r.score for r in found.orderBy("cid").collect()]
    expected = scores(linkmodel.score_links(theirs, whole))
    assert scores(linkmodel.score_links(ours, apart, known, 3)) == pytest.approx(expected, abs=2e-2)
    with pytest.raises(ValueError):
        linkmodel.fit_link_classifier(apart.withColumn("src_age", F.lit(None).cast("double")), known=known)
    monkeypatch.setattr(linkmodel, "BROADCAST_NUMBERS", 0)  # vectors that do not fit are put in place for Spark's fit
    far = linkmodel.fit_link_classifier(apart, known=known)
    assert scores(linkmodel.score_links(far, apart, known, 3)) == pytest.approx(expected, abs=1e-6)


def test_sums_of_vectors_are_not_sorted(spark):
    """Vectors joined a node's rows before they were sorted, and their sums were sorted again (F7)."""
    edges = spark.createDataFrame([(1, 1, 2, 10), (2, 2, 3, 20)], EDGE)
    table = spark.createDataFrame([(1, [1.0, 2.0])], "node long, vec array<double>")
    asks = spark.createDataFrame([(1, 30, 7)], "node long, ts_us long, x int")
    table = linkmodel.numbered_vectors(table.union(table))
    found = linkmodel._near_states(asks, linkmodel._half_edges(edges), table, 2, 3)
    assert [(r.total, r.sums) for r in linkmodel._near_states(asks.withColumn("node", F.lit(2).cast("long")), linkmodel._half_edges(edges), table, 2, 3).collect()] == [(3, [2.0, 4.0])]
    plan = found._jdf.queryExecution().executedPlan().toString()
    top = plan[:plan.index("BroadcastHashJoin")]
    assert "Window" in top and "Sort" not in top
