"""Streams replayed from files, several micro-batches each."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgetide.operators import conformal
from edgetide.streaming import processors as st

SCORED = "stream string, idx long, score double"


def written(spark, tmp_path, rows, schema, parts, files=2):
    """``rows`` in ``parts`` (lists of rows) as a stream of one micro-batch per part."""
    for part in parts:
        spark.createDataFrame(part, schema).repartition(files).write.mode("append").parquet(str(tmp_path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(str(tmp_path))


def test_alerts_match_the_batch_operator(spark, tmp_path):
    size = 60  # neither micro-batch ends with a full batch
    rng = np.random.default_rng(4)
    cal = spark.createDataFrame([(float(s),) for s in np.round(rng.random(80), 2)], "score double")
    rows = [("busy" if n % 3 else f"host{n % 2}", n + 1, float(s)) for n, s in enumerate(np.round(rng.random(100) * 0.9, 2))]
    stream = written(spark, tmp_path, rows, SCORED, [rows[at:at + size] for at in range(0, 100, size)])
    got = st.replay_alerts(stream, cal, alpha=0.2, rate=0.3, batch=16).collect()
    dense, counts = [], {}
    for name, idx, score in rows:
        counts[name] = counts.get(name, 0) + 1
        dense.append((name, idx, counts[name], score))
    test = spark.createDataFrame([(name, place, score) for name, _, place, score in dense], "host string, idx long, score double")
    levels = {(r["stream"], r["batch"]): r for r in conformal.adaptive_conformal(test, cal, alpha=0.2, rate=0.3, batch=16, key="host").collect()}
    assert len(got) == 100
    found = {r["idx"]: r for r in got}
    for name, idx, place, score in dense:
        level = levels[name, (place - 1) // 16]
        assert found[idx]["level"] == pytest.approx(level["level"]) and found[idx]["threshold"] == pytest.approx(level["threshold"])
        assert found[idx]["alert"] == int(1 - score > level["threshold"] + 1e-12)


def test_summaries_hold_only_reachable_ranks(spark):
    cal = spark.range(1000).select((F.col("id") / 1000.0).alias("score"))
    test = spark.range(256 * 8).select((F.col("id") + 1).alias("idx"), (F.pmod(F.col("id") * 37, F.lit(1000)) / 1000.0).alias("score"))
    ladder = conformal.rank_ladder(cal)
    rows = test.select(F.lit("s").alias("stream"), F.floor((F.col("idx") - 1) / 256).alias("batch"), (1 - F.col("score")).alias("at"))
    zero = F.lit(0).cast("long")
    ranked = conformal.ranked_errors(rows, ladder).withColumns({"level": F.lit(0.05), "seen": zero, "missed": zero})
    kept = {r["batch"]: len(r["ranks"]) for r in conformal.batch_summaries(ranked, 0.005).collect()}
    assert kept[0] <= 3 and max(kept.values()) < 40  # of 256 each


def test_windows_and_late_events_are_the_input(spark, tmp_path):
    zero = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rng = np.random.default_rng(6)
    rows = []
    for n in range(300):
        minutes = n // 3 - (90 if n % 17 == 0 else 0)  # every 17th event is an hour and a half late
        rows.append((f"h{int(rng.integers(0, 3))}" if n % 2 else "busy", zero + timedelta(minutes=float(minutes)), int(n % 5 == 0)))
    rows[200] = (None, None, 1)
    schema = "hostname string, ts timestamp, label int"
    parts = [rows[:140], rows[140:141], rows[141:]]
    windows, late = st.replay_windows(written(spark, tmp_path, rows, schema, parts, files=1), minutes=15, lateness_ms=1_800_000)
    got = {(r["hostname"], r["start_us"]): (r["edges"], r["labels"]) for r in windows.collect()}
    lost = late.collect()
    micros = lambda ts: round((ts - zero).total_seconds() * 1e6) + 1_704_067_200_000_000
    expected, expected_late, reached = {}, 0, None
    for part in parts:
        for host, ts, label in part:
            start = None if ts is None else micros(ts) // 900_000_000 * 900_000_000
            if ts is None or (reached is not None and start + 900_000_000 <= reached):
                expected_late += 1
            else:
                edges, labels = expected.get((host, start), (0, 0))
                expected[host, start] = (edges + 1, labels + label)
        newest = max(micros(ts) for _, ts, _ in part if ts) - 1_800_000_000
        reached = newest if reached is None else max(reached, newest)
    assert got == expected and len(lost) == expected_late > 3
    assert sum(e for e, _ in got.values()) + len(lost) == len(rows)


def test_no_events(spark, tmp_path):
    schema = "hostname string, ts timestamp, label int"
    spark.createDataFrame([], schema).write.mode("append").parquet(str(tmp_path))
    windows, late = st.replay_windows(spark.readStream.schema(schema).parquet(str(tmp_path)))
    assert windows.count() == 0 and late.count() == 0


def test_recency_and_novelty_over_batches(spark, tmp_path):
    schema = "idx long, u long, i long, ts timestamp"
    zero = datetime(2024, 1, 1, tzinfo=timezone.utc)
    seconds = [(n + 1, 0 if n % 3 else n % 4, 10 + n % 2 if n % 7 else 0, n * 10 // 3) for n in range(90)]
    rows = [(idx, u, i, zero + timedelta(seconds=s)) for idx, u, i, s in seconds]
    stream = written(spark, tmp_path, rows, schema, [rows[:31], rows[31:]])
    got = sorted(((r["node"], r["idx"], r["recency"]) for r in st.replay_recency(stream).collect()), key=repr)
    last, expected = {}, []
    for idx, u, i, s in seconds:
        for node in (u, i):
            expected.append((node, idx, float(s - last[node]) if node in last else None))
            last[node] = s
    assert got == sorted(expected, key=repr)
    new = st.replay(st.stream_new_edges(stream)).collect()
    assert sorted((r.u, r.i) for r in new) == sorted({(u, i) for _, u, i, _ in seconds})


def test_recency_timers_forget(spark, tmp_path):
    schema = "idx long, u long, i long, ts timestamp"
    zero = datetime(2024, 1, 1, tzinfo=timezone.utc)
    seconds = [(1, 1, 2, 0), (2, 1, 2, 1), (3, 3, 4, 500), (4, 1, 2, 501), (5, 3, 4, 505)]
    rows = [(idx, u, i, zero + timedelta(seconds=s)) for idx, u, i, s in seconds]
    stream = written(spark, tmp_path, rows, schema, [rows[:2], rows[2:]], files=1)
    kept = {(r["node"], r["idx"]): r["recency"] for r in st.replay_recency(stream, keep_ms=60_000).collect()}
    first, second = {1: None, 2: 1.0, 4: None}, {3: None, 5: 5.0}
    assert kept == {(node, idx): gap for nodes, gaps in (((1, 2), first), ((3, 4), second)) for node in nodes for idx, gap in gaps.items()}
