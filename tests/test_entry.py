"""The registered queries: names agree, and one runs end to end next to its SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"


def test_names():
    queries, oracles = entry_point.queries(), entry_point.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 140
    from edgetide import catalog

    own = catalog.load()
    assert set(own) - set(catalog.ORACLES) == {"link_classifier"}
    assert set(own) <= set(queries) and set(catalog.ORACLES) <= set(oracles)


def test_flagship(spark):
    frame = entry_point.entry(spark)
    assert frame.columns == ["bucket", "anomaly_score", "label"] and frame.count() > 0


# one of each kind: sources, logs, ids, splits, paths, memories, neighbourhoods, negatives, windows, texts, metrics, conformal, reports
@pytest.mark.parametrize("name", [
    "unique_edges", "roc_auc", "bucket_score", "historical_negatives", "write_read_tables", "action_counts", "quantile_split",
    "edgebank_scores_repeat_interval", "recent_neighbors", "time_shift_stats", "window_graph_size", "adaptive_conformal", "confusion"])
def test_against_sql(spark, name):
    base = duckdb.connect()
    for file in sorted(glob.glob(f"{FOLDER}/*.parquet")):
        base.execute(f"create view {os.path.basename(file)[:-8]} as select * from '{file}'")
    frame = entry_point.queries()[name](spark, FOLDER)
    result = base.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in result.description]
    expected = sorted((tuple(r[names.index(c)] for c in frame.columns) for r in result.fetchall()), key=repr)
    got = sorted((tuple(r) for r in frame.collect()), key=repr)
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        for a, b in zip(g, e):
            assert a == (pytest.approx(b) if isinstance(b, float) else b)


def test_link_classifier_is_deterministic(spark):
    query = entry_point.queries()["link_classifier"]
    first, second = (query(spark, FOLDER).first()["auc"] for _ in range(2))
    assert first == second and 0 <= first <= 1
