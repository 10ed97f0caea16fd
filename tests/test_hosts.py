"""Graph tables with one graph per host, files of one client, and checks of features."""

import json

import pytest
from pyspark.sql import functions as F

from edgetide.operators import events as ev
from edgetide.sources import logs as log_source
from edgetide.sources import tables

EVENT = "hostname string, id string, actor_id string, object_id string, object_type string, action_type string, image_path string, file_path string, command_line string, ts_us long, label int, ord long"


def events(spark):
    rows = []
    for n in range(60):
        host = [None, "HostA", "hosta", "HostB", "busy"][n % 5 if n % 3 else 4]
        rows.append((host, f"r{n}", f"p{n % 4}", f"o{n % 7}", "FILE" if n % 2 else "PROCESS", "READ", f"/bin/{n % 4}", ['say "x",\ny', None, "", "/f"][n % 4],
                     None if n % 5 else "", 1000 - n // 2, n % 2, n))
    return rows, spark.createDataFrame(rows, EVENT).repartition(4)


def test_ids_are_dense_in_every_host(spark):
    rows, frame = events(spark)
    graph = ev.build_graph(frame, ["ord"], host="hostname")
    nodes = {(r["hostname"], r["node_id"]): r for r in graph["nodes"].collect()}
    edges = graph["edges"].join(graph["edge_features"], ["hostname", "idx"]).collect()
    assert len(edges) == len(rows)
    for host in {(r[0] or "").lower() for r in rows}:
        mine = sorted((r for r in rows if (r[0] or "").lower() == host), key=lambda r: r[-1])
        ids = {}
        for r in mine:
            for key in (("PROCESS", r[2]), (r[4], r[3])):
                ids.setdefault(key, len(ids) + 1)
        assert sorted(i for h, i in nodes if h == host) == list(range(1, len(ids) + 1))
        in_time = sorted(mine, key=lambda r: (r[9], r[11]))
        got = sorted((e["idx"], e["u"], e["i"]) for e in edges if e["hostname"] == host)
        assert got == [(n + 1, ids["PROCESS", r[2]], ids[r[4], r[3]]) for n, r in enumerate(in_time)]


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_written_by_host_and_read_pruned(spark, tmp_path, format):
    _, frame = events(spark)
    graph = ev.build_graph(frame, ["ord"], host="hostname")
    tables.write_graph(graph, str(tmp_path / format), format)
    read = tables.read_tables(spark, str(tmp_path / format), format=format, hosts=["HostA", "busy"])
    for name, table in read.items():
        expected = graph[name].where("hostname in ('hosta', 'busy')")
        found = tables.assert_tables_equal(expected, table.select(*expected.columns)).first()
        assert (name, found["only_left"], found["only_right"]) == (name, 0, 0)
    plan = read["edges"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "hostname" in plan.split("PartitionFilters: [")[1].split("]")[0]
    folders = {p.name for p in (tmp_path / format / "edges").iterdir() if p.is_dir()}
    assert {"hostname=hosta", "hostname=busy", "hostname=hostb"} <= folders


def test_files_of_one_client(spark, tmp_path):
    names = ["a-2019-09-23-SysClient0201.json", "sub/b-2019-sysclient0201.json.gz", "c-2019-09-16-SysClient0201.json", "Label-2019-SysClient0201.json",
             "d-2019-SysClient0202.json", "e-2018-SysClient0201.json", "f-2019-canada-SysClient0201.json"]
    import gzip

    for n, name in enumerate(names):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        text = json.dumps({"id": f"r{n}", "hostname": "h"}).encode() + b"\n\n"
        # a file that must not be opened is not even JSON
        (tmp_path / name).write_bytes((gzip.compress(text) if name.endswith("gz") else text) if n < 2 else b"{broken")
    found = log_source.read_client_logs(spark, str(tmp_path), "201")
    assert sorted(r["id"] for r in found.collect()) == ["r0", "r1"]
    assert log_source.read_client_logs(spark, str(tmp_path), "999").count() == 0


def test_compare_features(spark):
    rows = spark.createDataFrame([(1, [1.0, -2.0]), (2, [0.5, 3.0]), (3, None)], "id long, vec array<double>")
    same = tables.compare_features(rows, rows.withColumn("vec", F.reverse("vec")), "vec").first()
    assert (same["left_width"], same["left_rows"], same["left_low"], same["left_high"], same["equal"]) == (2, 2, -2.0, 3.0, 1)
    assert tables.compare_features(rows, rows.where("id = 1"), "vec").first()["equal"] == 0
    empty = tables.compare_features(rows.limit(0), rows.limit(0), "vec").first()
    assert (empty["left_width"], empty["left_low"], empty["equal"]) == (0, None, 1)
