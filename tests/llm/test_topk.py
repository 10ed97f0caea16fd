import math
import random

import pytest
from pyspark.sql import functions as F

from edgetide.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, query_id long, score long"


def brute(rows, k, is_query):
    usable = [(i, [math.floor(1024 * x) for x in e]) for i, e, *_ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q in sorted({i for i, _ in usable if is_query(i)}):
        vector = min(((len(e), e) for i, e in usable if i == q))[1]
        found = sorted((-sum(a * b for a, b in zip(vector, e)), i) for i, e in usable if i != q and len(e) == len(vector))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


@pytest.mark.parametrize("blocks", [(2048, 4096), (2, 7)])
def test_against_brute_force(spark, blocks):
    rng = random.Random(5)
    vectors = [[float(rng.choice([-1, 0, 0.5, 1])) if n % 3 else rng.gauss(0, 3) for _ in range(6)] for n in range(60)]
    rows = [(n, v, 0, 1, 1) for n, v in enumerate(vectors)] + [
        (100, [float("nan")] * 6, 0, 1, 1), (101, None, 0, 1, 1), (None, [1.0] * 6, 0, 1, 1), (102, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 0, 1, 1),
        (103, [float("inf")] + [0.0] * 5, 0, 1, 1), (5, vectors[5], 0, 1, 1), (10, vectors[10], 0, 1, 1), (110, [1.0, 2.0], 0, 1, 1), (120, [3.0, 4.0], 0, 1, 1),
        (130, [], 0, 1, 1), (140, [], 0, 1, 1), (150, [7.0] * 3, 0, 1, 1)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = [tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 5 == 0, 10, *blocks).orderBy("query_id", "rank").collect()]
    plain = [(i, None if e is None else [None if x is None else float(x) for x in e]) for i, e in ((r["vec_id"], r["embedding"]) for r in frame.collect())]
    assert got == brute(plain, 10, lambda i: i % 5 == 0)


def test_bounds_stop_early_and_stay_exact():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 400
    vectors = np.floor(centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16)) * 5).astype(np.int64)
    pivots = topk.choose_pivots(vectors[:500])
    near = list(topk.distances(vectors.astype(float), pivots))
    block = pd.DataFrame({"vec_id": np.arange(3000), "vector": list(vectors), "near": near, "dim": 16})
    evaluated = []
    plain = topk.scores
    topk.scores = lambda v, q, f: evaluated.append(len(v)) or plain(v, q, f)
    try:
        found = topk.best_in_block(block.head(10), block, 10)
    finally:
        topk.scores = plain
    assert sum(evaluated) < 0.5 * 10 * 3000
    for q, own in found.groupby("query_id"):
        s = vectors @ vectors[q]
        order = [int(i) for i in np.lexsort((np.arange(3000), -s)) if i != q][:10]
        assert own["vec_id"].tolist() == order


def test_large_components(spark):
    rows = [(n, [float(10 ** (12 + n % 3)), float(-n)], 0, 0, 0) for n in range(6)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(frame, F.col("vec_id") == 0, 2).orderBy("rank").collect()
    assert [r["score"] for r in got] == [(1 << 63) - 1] * 2


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 2 == 0).count() == 0
