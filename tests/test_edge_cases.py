"""Hand-made cases with literal results."""

import gzip
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgetide.functions import text, vectors
from edgetide.operators import events as ev
from edgetide.operators import conformal, memory, metrics, negatives, neighbors, paths, reports, splits, textfeatures
from edgetide.sources import logs as log_source

EDGE = "idx long, u long, i long, ts_us long, label int"


def record(n, actor="a", obj="o", kind="FILE", ts="2019-09-23T14:44:53.8-04:00", **properties):
    return {"id": f"r{n}", "hostname": "H", "actorID": actor, "objectID": obj, "object": kind, "action": "READ",
            "timestamp": ts, "properties": properties}


@pytest.fixture
def log_folder(tmp_path):
    rows = [
        record(1, image_path=None, file_path=None), record(2, image_path="C:\\a.exe", file_path="f.txt"),
        record(3, actor=None), record(4, kind="FLOW"), record(5, obj="p2", kind="PROCESS", ts="2019-09-23T14:44:52-04:00"),
    ]
    rows.append({k: v for k, v in record(6).items() if k != "properties"})
    lines = [json.dumps(r) for r in rows]
    lines.insert(2, "   ")
    with gzip.open(tmp_path / "x-SysClient0201-2019.json.gz", "wt") as out:
        out.write("\n".join(lines) + "\n\n")
    (tmp_path / "x-SysClient0201-2019-09-17.json").write_text(json.dumps(record(9)) + "\n")
    (tmp_path / "y-SysClient0051-2019.json").write_text(json.dumps(record(10)) + "\n")
    return str(tmp_path)


def test_logs_to_graph(spark, log_folder):
    logs = log_source.read_client_logs(spark, log_folder, "201")
    flat = ev.with_time(ev.filter_events(ev.extract_fields(logs))).withColumn("ord", F.col("id"))
    assert sorted(r.id for r in flat.collect()) == ["r1", "r2", "r5", "r6"]
    times = {r.id: r.ts_us for r in flat.collect()}
    assert times["r1"] - times["r5"] == 1_800_000
    graph = ev.build_graph(ev.label_edges(flat, spark.createDataFrame([("h", "r2")], "hostname string, id string")), ["ord"])
    nodes = [(r.node_id, r.object_type, r.path) for r in graph["nodes"].orderBy("node_id").collect()]
    assert nodes == [(1, "PROCESS", "C:\\a.exe"), (2, "FILE", "f.txt"), (3, "PROCESS", None)]
    edges = [(r.idx, r.u, r.i, r.label) for r in graph["edges"].orderBy("idx").collect()]
    assert edges == [(1, 1, 3, 0), (2, 1, 2, 0), (3, 1, 2, 1), (4, 1, 2, 0)]
    assert sorted(r.text for r in graph["corpus"].collect()) == ["C:\\a.exe", "f.txt"]


def test_malformed_line_and_missing_time(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"id": "1"}\n{oops\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        log_source.read_logs(spark, str(tmp_path)).collect()
    none = spark.createDataFrame([(None,)], "timestamp string")
    with pytest.raises(Exception, match="missing timestamp"):
        ev.with_time(none).collect()


def test_equal_times_are_not_neighbours(spark):
    edges = spark.createDataFrame([(1, 1, 2, 10, 0), (2, 1, 3, 10, 0), (3, 1, 1, 20, 0), (4, 4, 1, 30, 0)], EDGE)
    queries = spark.createDataFrame([(1, 10), (1, 20), (1, 30), (4, 30), (2, 11), (9, 5)], "node long, ts_us long")
    found = {(r.node, r.ts_us): [x.idx for x in r.recent] for r in neighbors.recent_neighbors(queries, edges, 10).collect()}
    assert found == {(1, 10): [], (1, 20): [1, 2], (1, 30): [1, 2, 3, 3], (4, 30): [], (2, 11): [1], (9, 5): []}


def test_two_hop(spark):
    # 1-2, 2-3, 2-4, then 1-4: afterwards 4 is a direct neighbour of 1 and only 3 is left
    rows = [(1, 1, 2, 10, 0), (2, 2, 3, 20, 0), (3, 2, 4, 30, 0), (4, 1, 4, 40, 0), (5, 1, 9, 50, 0), (6, 8, 1, 60, 0)]
    edges = spark.createDataFrame(rows, EDGE)
    found = {r.idx: r.two_hop_non_neighbors for r in neighbors.two_hop_non_neighbors(edges).collect()}
    assert found == {1: [], 2: [], 3: [], 4: [3, 4], 5: [3], 6: []}
    capped = {r.idx: r.two_hop_non_neighbors for r in neighbors.two_hop_non_neighbors(edges, stop_after=1).collect()}
    assert all(set(v) <= set(found[k]) for k, v in capped.items())


def test_two_hop_exact_when_no_cap_applies(spark):
    rng = np.random.default_rng(3)
    rows = [(n + 1, int(a), int(b), int(t), 0) for n, (a, b, t) in enumerate(
        zip(rng.integers(1, 12, 60), rng.integers(1, 12, 60), np.sort(rng.integers(0, 30, 60))))]
    got = {r.idx: r.two_hop_non_neighbors for r in neighbors.two_hop_non_neighbors(spark.createDataFrame(rows, EDGE)).collect()}
    for idx, u, _, t, _ in rows:
        near = {}
        for _, a, b, s, _ in rows:
            if s < t:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        reach = set().union(*[near[w] for w in near.get(u, set())]) if near.get(u) else set()
        assert got[idx] == sorted(reach - near.get(u, set()) - {u})


def test_missing_commands_match(spark):
    schema = "object_type_src string, object_type_dst string, action_type string, command_line string, n_edges long"
    a = spark.createDataFrame([("P", "F", "R", None, 2), ("P", "F", "R", "x", 1)], schema)
    b = spark.createDataFrame([("P", "F", "R", None, 5), ("P", "F", "R", "y", 7)], schema)
    assert [(r.command_line, r.n_edges_1, r.n_edges_2) for r in paths.similar_edges(a, b).collect()] == [(None, 2, 5)]
    assert [r.command_line for r in paths.non_present_edges(a, b).collect()] == ["y"]


def normal_by_hand(command):
    if command is None:
        return None
    out = command.lower()
    for pattern, replacement in text.COMMAND_REWRITES:
        out = re.sub(pattern, replacement.replace("$", "\\"), out)
    return out.strip()


def test_command_lines(spark):
    rows = [
        '"C:\\Users\\bob\\a b.exe" /d "x" 10.0.0.1 0xFF', "\\\\?\\C:\\Temp\\ab12.tmp", "global\\pipe_12 deadbeef 123 v42",
        "x {1a2b-0F} y", None, "", '"C:\\p\\cmd.exe" "run \\a\\b -x" plain', "my report.pdf --channel=\"beta\"",
    ]
    df = spark.createDataFrame([(n, r) for n, r in enumerate(rows)], "n int, t string")
    got = {r.n: r for r in df.select("n", text.normalize_cmdline("t").alias("s"), text.tokenize_cmdline("t").alias("w"),
                                     text.text_sequence("t").alias("q")).collect()}
    for n, row in enumerate(rows):
        assert got[n].s == normal_by_hand(row)
    assert got[1].s == "c:\\temp\\<TMPDIR>"
    assert got[2].s == "global\\<PIPE> <HEXID> <NUM> v<NUM>"
    assert got[3].s == "x <GUID> y"
    assert got[4].s is None and got[4].q == "" and got[5].q == ""
    assert got[6].w == ["C", "p", "cmd.exe", "run", "a", "b", "-x", "plain"]
    assert got[7].s == "<DOC>.pdf --channel=<CHANNEL>"


def test_extension_and_vectors(spark):
    df = spark.createDataFrame([("a/b.tar.gz",), ("a/.bashrc",), ("a.d/file",), ("x.",)], "p string")
    assert [r.e for r in df.select(text.extension("p").alias("e")).collect()] == [".gz", "", "", "."]
    long = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    with pytest.raises(Exception, match="longer than padding"):
        long.select(vectors.pad_vector("v", 2)).collect()


def test_score_edge_cases(spark):
    equal = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 0)], "score double, label int")
    assert metrics.roc_auc(equal).first()[0] == 0.5
    assert metrics.average_precision(equal).first()[0] == pytest.approx(1 / 3)
    one = spark.createDataFrame([(0.5, 1), (0.7, 1)], "score double, label int")
    assert metrics.roc_auc(one).first()[0] is None
    bins = spark.createDataFrame([(0.0, 1), (0.02, 1), (1.0, 0)], "score double, label int")
    assert sorted(r.bin for r in metrics.calibration_curve(bins).collect()) == [0, 49]
    assert sorted((r.bin, r.positives, r.negatives) for r in metrics.score_histogram(bins).collect()) == [
        (0, 1, 0), (1, 1, 0), (49, 0, 1)]


def test_auc_of_reversed_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(float(s), int(y)) for s, y in zip(np.round(rng.random(200), 2), rng.integers(0, 2, 200))]
    df = spark.createDataFrame(rows, "score double, label int")
    a, b = metrics.roc_auc(df).first()[0], metrics.roc_auc(df.withColumn("score", -F.col("score"))).first()[0]
    assert a + b == pytest.approx(1.0)


def test_bucket_without_scores(spark):
    truth = spark.createDataFrame([(900, 1), (1800, 0)], "bucket long, label int")
    scored = spark.createDataFrame([(900, 0.4), (900, 0.2)], "bucket long, score double")
    got = {r.bucket: r for r in reports.bucket_details(scored, truth).collect()}
    assert got[1800].min_score is None and got[1800].predicted_links == 0
    assert got[900].bottom_score == 0.2 and got[900].suspicious == 1


def _threshold(errors, alpha):
    n = len(errors)
    q = int((1 - alpha) * (n + 1))
    return max(errors) + 1e-6 if q >= n else float(np.quantile(errors, max(q, 0) / n))


def test_conformal_small(spark):
    one = spark.createDataFrame([(0.3, 0)], "score double, ts_us long")
    assert conformal.conformal_threshold(one).first()[0] == pytest.approx(0.7 + 1e-6)
    assert conformal.conformal_threshold_weighted(one).first()[0] == pytest.approx(0.7)
    many = spark.createDataFrame([(float(n) / 50, n) for n in range(50)], "score double, ts_us long")
    expected = _threshold([1 - n / 50 for n in range(50)], 0.2)
    assert conformal.conformal_threshold(many, 0.2).first()[0] == pytest.approx(expected)


def adaptive_brute(errors, cal, alpha, rate, batch):
    level, out = alpha, []
    for at in range(0, len(errors), batch):
        chunk = errors[at:at + batch]
        limit = _threshold(cal, level)
        missed = float(np.mean(np.array(chunk) > limit))
        out.append((level, limit, missed))
        if len(chunk) == batch:
            level += rate * ((level - missed) if missed > alpha else level)
    return out


@pytest.mark.parametrize("digits", [1, 3])
def test_adaptive_conformal(spark, digits):
    rng = np.random.default_rng(5)
    cal, test = np.round(rng.random(60), digits), np.round(rng.random(43) * 1.1 - 0.1, digits)
    got = conformal.adaptive_conformal(
        spark.createDataFrame([(n + 1, float(s)) for n, s in enumerate(test)], "idx long, score double"),
        spark.createDataFrame([(float(s),) for s in cal], "score double"), alpha=0.2, rate=0.5, batch=8,
    ).orderBy("batch").collect()
    expected = adaptive_brute(list(1 - test), list(1 - cal), 0.2, 0.5, 8)
    assert len(got) == len(expected)
    for g, (level, limit, missed) in zip(got, expected):
        assert (g.level, g.threshold, g.miscoverage) == (pytest.approx(level), pytest.approx(limit), pytest.approx(missed))


def test_samplers(spark):
    rows = [(n + 1, n % 5 + 1, 10 + n % 7, 1000 + n // 3, 0) for n in range(120)]
    edges = spark.createDataFrame(rows, EDGE)
    batches = {}
    for idx, u, i, _, _ in rows:
        batches.setdefault((idx - 1) // 16, set()).add((u, i))
    first_seen, starts = {}, {}
    for idx, u, i, t, _ in rows:
        first_seen.setdefault((u, i), t)
        starts.setdefault((idx - 1) // 16, t)
    got = {}
    for r in negatives.historical_negatives(edges, edges, size=16).collect():
        got.setdefault(r.batch, []).append(r)
    sizes = {b: sum((x[0] - 1) // 16 == b for x in rows) for b in batches}
    for b, pairs in batches.items():
        preferred = [(r.u, r.i) for r in got[b] if r.source == "preferred"]
        random = [(r.u, r.i) for r in got[b] if r.source == "random"]
        possible = {p for p, t in first_seen.items() if t <= starts[b]} - pairs
        assert len(preferred) == len(set(preferred)) == min(sizes[b], len(possible)) and set(preferred) <= possible
        assert len(preferred) + len(random) == sizes[b] and not set(random) & pairs
        assert len(set(random)) == len(random)


def test_sampler_repeats_when_pairs_run_out(spark):
    edges = spark.createDataFrame([(n + 1, n % 2, n % 3, n, 0) for n in range(5)], EDGE)
    wanted = spark.createDataFrame([(0, 5)], "batch long, need long")
    got = [(r.u, r.i) for r in negatives.random_negatives_checked(edges, wanted, edges).collect()]
    assert len(got) == 5 and set(got) == {(1, 2)}


def test_two_hop_negatives_fall_back(spark):
    edges = spark.createDataFrame([(1, 1, 2, 10, 0), (2, 2, 3, 20, 0), (3, 1, 5, 30, 0)], EDGE)
    found = {r.idx: r for r in negatives.two_hop_negatives(edges, neighbors.two_hop_sets(edges), edges).collect()}
    assert found[3].i == 3 and found[3].source == "preferred"
    assert found[1].source == "random" and found[1].i in {2, 3, 5}


def test_repeat_interval_without_repeats(spark):
    edges = spark.createDataFrame([(1, 1, 2, 10, 0), (2, 1, 3, 20, 0), (3, 2, 3, 20, 0)], EDGE)
    assert sorted((r.u, r.i) for r in memory.edge_memory_repeat_interval(edges).collect()) == [(1, 3), (2, 3)]


def test_split_boundaries(spark):
    df = spark.createDataFrame([(t,) for t in (0, 10, 11, 20, 21, 30, 31)], "ts_us long")
    closed = splits.time_split(train_start=0, val_start=10, test_start=20, test_end=30)
    half = splits.half_open_split(val_start=10, test_start=20)
    got = [(r.a, r.b) for r in df.orderBy("ts_us").select(closed.alias("a"), half.alias("b")).collect()]
    assert [a for a, _ in got] == ["train", "train", "val", "val", "test", "test", None]
    assert [b for _, b in got] == ["train", "val", "val", "test", "test", "test", "test"]


@pytest.mark.parametrize("block", [3, 1000])
def test_impute_unknown_tokens(spark, monkeypatch, block):
    rng = np.random.default_rng(2)
    vocabulary = {f"w{n}": rng.random(3) for n in range(9)}
    rows = [(n, [f"w{x}" for x in rng.integers(0, 14, 12)]) for n in range(6)] + [(99, ["zz", "yy"])]
    table = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vocabulary.items()], "token string, vec array<double>")
    nearest = textfeatures.nearest_tokens
    monkeypatch.setattr(textfeatures, "nearest_tokens", lambda c, v, k: nearest(c, v, k, block, block))
    got = textfeatures.impute_unknown_tokens(spark.createDataFrame(rows, "id long, tokens array<string>"), table, 3).collect()
    everyone = np.mean(list(vocabulary.values()), axis=0)
    seen = 0
    for r in got:
        tokens = dict(rows)[r.id]
        near = [vocabulary[t] for p, t in enumerate(tokens) if t in vocabulary and p != r.pos and abs(p - r.pos) <= 5]
        if near:
            c = np.mean(near, axis=0)
            order = sorted(vocabulary, key=lambda t: (-np.dot(vocabulary[t], c) / np.linalg.norm(vocabulary[t]) / np.linalg.norm(c), t))
            expected = np.mean([vocabulary[t] for t in order[:2]], axis=0)
        else:
            expected = everyone
        assert np.allclose(r.vec, expected)
        seen += 1
    assert seen == sum(t not in vocabulary for _, ts in rows for t in ts)


def test_temporal_paths_are_the_same_for_any_cell(spark):
    rows = [(n + 1, n % 4, (n * 3) % 4, n // 2, 0) for n in range(40)]
    edges = spark.createDataFrame(rows, EDGE)
    expected = sorted((a[0], b[0]) for a in rows for b in rows if a[2] == b[1] and b[3] > a[3])
    for cell in (3, 1000):
        assert sorted((r.idx_1, r.idx_2) for r in paths.temporal_paths_2(edges, cell=cell).collect()) == expected
