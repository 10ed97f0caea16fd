"""Edge memories that grow by batch, each batch worked out by itself."""

import numpy as np
import pytest

from edgetide.operators import memory

EDGE = "idx long, u long, i long, ts_us long, batch long"
CANDIDATE = "idx long, u long, i long, batch long, label int"


def by_hand(edges, candidates, mode, proportion):
    out = {}
    for idx, u, i, batch, _ in candidates:
        past = [e for e in edges if e[4] < batch]
        pairs = {}
        for _, a, b, t, _ in past:
            pairs.setdefault((a, b), []).append(t)
        if not past:
            known = set()
        elif mode == "unlimited_memory":
            known = set(pairs)
        elif mode == "repeat_threshold_memory":
            known = {p for p, ts in pairs.items() if len(ts) >= len(past) / len(pairs)}
        else:
            times = [e[3] for e in past]
            if mode == "time_window_fixed_proportion":
                start = np.quantile(times, 1 - proportion)
            else:
                gaps = sum(np.mean(np.diff(sorted(ts))) for ts in pairs.values() if len(ts) > 1)
                start = max(times) - gaps / len(pairs)
            known = {p for p, ts in pairs.items() if max(ts) >= start}
        out[idx] = float((u, i) in known)
    return out


@pytest.mark.parametrize("mode", list(memory.MEMORIES))
def test_every_batch_by_itself(spark, mode):
    rng = np.random.default_rng(8)
    times = np.sort(rng.integers(0, 400, 300)) * 1000
    # one pair holds a third of all edges; batch 3 has no edges, batch -1 is what came before
    edges = []
    for n in range(300):
        u, i = (1, 50) if rng.random() < 0.33 else (int(rng.integers(1, 6)), int(rng.integers(50, 58)))
        edges.append((n + 1, u, i, int(times[n]), -1 if n < 90 else 4 + (n - 90) // 16 if n > 138 else (n - 90) // 16))
    edges = [(*e[:3], e[3], e[4]) for e in edges if e[4] != 3]
    candidates = [(n + 1, int(rng.integers(1, 7)), int(rng.integers(50, 59)), b, n % 2) for n, b in enumerate(rng.integers(-2, 20, 200).tolist())]
    frame = spark.createDataFrame(edges, EDGE).repartition(4)
    asked = spark.createDataFrame(candidates, CANDIDATE)
    got = memory.edgebank_batched(frame, asked, mode, 0.2)
    assert set(got.columns) == {*asked.columns, "score"}
    assert {r["idx"]: r["score"] for r in got.collect()} == by_hand(edges, candidates, mode, 0.2)


def test_batches_out_of_order_are_refused(spark):
    edges = spark.createDataFrame([(1, 1, 2, 50, 0), (2, 1, 3, 10, 1), (3, 1, 2, 60, 2)], EDGE)
    asked = spark.createDataFrame([(1, 1, 2, 3, 1)], CANDIDATE)
    for mode in ("time_window_fixed_proportion", "time_window_repeat_interval"):
        with pytest.raises(Exception, match="follow each other"):
            memory.edgebank_batched(edges, asked, mode).collect()
    with pytest.raises(ValueError):
        memory.edgebank_batched(edges, asked, "no such memory")


def test_nothing_before_the_first_batch(spark):
    edges = spark.createDataFrame([(1, 1, 2, 50, 5)], EDGE)
    asked = spark.createDataFrame([(1, 1, 2, 5, 1), (2, 1, 2, 6, 1)], CANDIDATE)
    for mode in ("time_window_fixed_proportion", "repeat_threshold_memory"):
        assert {r["idx"]: r["score"] for r in memory.edgebank_batched(edges, asked, mode).collect()} == {1: 0.0, 2: 1.0}
    assert memory.edgebank_batched(edges.limit(0), asked, "repeat_threshold_memory").where("score > 0").count() == 0
