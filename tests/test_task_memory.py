"""Tasks of bounded rows where rows are far larger in memory than shuffled or stored."""

from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from edgetide import session
from edgetide.catalog import fixtures
from edgetide.operators.splits import node_stats

COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"


@pytest.mark.parametrize("rows,off", [(5, False), (45, True)])
def test_finer_keeps_tasks_apart(spark, rows, off, monkeypatch):
    """Without this, Spark puts the tasks together again by the few bytes they shuffle (F12, F28)."""
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    before = spark.conf.get(COALESCE)
    spark.conf.set(COALESCE, "true")
    try:
        with session.finer(spark, rows):
            spread = spark.range(1000).groupBy(F.col("id") % 100).count().rdd.getNumPartitions()
        assert spark.conf.get(COALESCE) == "true"
        assert spread == (5 if off else 1)
    finally:
        spark.conf.set(COALESCE, before)


def test_stored_files_can_be_read_in_parts(spark, tmp_path, monkeypatch):
    """One row group is the least a task can read, however small the parts asked for (F28)."""
    monkeypatch.setattr(session, "ROW_GROUP", 1 << 16)
    kept = session.stored(spark.range(0, 200_000, 1, 1).select(F.xxhash64("id").alias("h")))
    [path] = [f.removeprefix("file://").removeprefix("file:") for f in kept.inputFiles()]
    assert pq.ParquetFile(path).num_row_groups > 1
    assert kept.distinct().count() == 200_000


def test_node_stats_counts_sides(spark):
    rows = [("a", 1, 2, 10), ("a", 1, 2, 10), ("a", 2, 1, 30), ("a", 1, 1, 40), ("b", None, 1, 5), ("b", 1, None, None)]
    edges = spark.createDataFrame(rows, "split string, u long, i long, ts_us long")
    found = {(r.split, r.node): (r.src_edges, r.dst_edges, r.total, r.distinct_ts, r.span_us) for r in node_stats(edges).collect()}
    assert found[("a", 1)] == (3, 2, 5, 3, 30) and found[("a", 2)] == (1, 2, 3, 2, 20)
    assert found[("b", 1)] == (1, 1, 2, 2, 0) and found[("b", None)] == (1, 1, 2, 2, 0)


def test_trades_without_numbers_are_the_same_rows(spark, tmp_path):
    """node_stats and metric_distribution read no numbers, so nothing is sorted for them (F27, F28)."""
    spark.createDataFrame([(1, 7), (2, 8)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate string, l_returnflag string"
    lines = [(1, 1, 5, 3, 1.0, 2.0, "1994-01-02", "R"), (1, 1, 5, 3, 1.0, 2.0, "1994-01-02", "R"), (2, 1, None, 4, 1.0, 2.0, None, "N"), (9, 1, 5, 3, 1.0, 2.0, "1994-01-02", "R")]
    spark.createDataFrame(lines, line).withColumn("l_shipdate", F.col("l_shipdate").cast("date")).write.parquet(f"{tmp_path}/lineitem.parquet")
    names = ["u", "i", "ts_us", "label"]
    numbered = Counter(map(tuple, fixtures.trade_edges(spark, str(tmp_path)).select(*names).collect()))
    assert Counter(map(tuple, fixtures.unnumbered_trades(spark, str(tmp_path)).select(*names).collect())) == numbered
    assert sum(numbered.values()) == 3
