"""Exact top-k inner products by pivot-table elimination.

Vectors become integers. For x and y the inner product is (|x|^2 + |y|^2 - |x - y|^2) / 2, and |x - y| is at least
|d(x, p) - d(y, p)| for every pivot p. Distances to the pivots are computed once per vector; the largest of the lower
bounds gives an upper bound of the score. Candidates are evaluated in the order of that bound, until it falls
below the k-th best score found. Queries and candidates meet block by block in a grid, so no task
holds more than one block of each, and each cell passes on at most k rows per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgetide.session import stored

PIVOTS = 32
SAMPLE = 1024  # vectors, at most, that pivots are chosen from
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 4096
STEP = 256  # candidates evaluated between two looks at the bound
EXACT = 1 << 53
FOUND = "query_id long, vec_id long, score long"


def integer_vectors(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, vector array<long>, dim): floor(scale * x) of every component.

    Rows without id, without vector, or with a null or non-finite component are left out.
    """
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    usable = rows.where(F.col("vec_id").isNotNull() & e.isNotNull()).where(~bad)
    return usable.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(e, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("vector"),
    ).withColumn("dim", F.size("vector"))


def matrix(vectors, dim: int) -> np.ndarray:
    return np.array([np.asarray(v, np.int64) for v in vectors], np.int64).reshape(len(vectors), dim)


def choose_pivots(vectors: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Far-apart vectors: each next pivot is the one farthest from those chosen so far."""
    points = vectors.astype(float)
    chosen, nearest = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < count and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((vectors - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def scores(vectors: np.ndarray, query: np.ndarray, floats: np.ndarray | None) -> np.ndarray:
    """Exact inner products; in doubles where every partial sum is below 2^53, else in unbounded integers."""
    if floats is not None:
        return (floats @ query.astype(float)).astype(np.int64)
    whole = vectors.astype(object) @ query.astype(object)
    return np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in whole], np.int64)


def best_in_block(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k best rows of one block of candidates: score descending, then id ascending."""
    dim = int(queries["dim"].iloc[0])
    vectors, ids = matrix(block["vector"], dim), block["vec_id"].to_numpy(np.int64)
    near, norms = np.stack(block["near"].to_numpy()), (vectors.astype(float) ** 2).sum(axis=1)
    asked, asked_ids = matrix(queries["vector"], dim), queries["vec_id"].to_numpy(np.int64)
    asked_near = np.stack(queries["near"].to_numpy())
    out = []
    for query, own, place in zip(asked, asked_ids, asked_near):
        norm = float((query.astype(float) ** 2).sum())
        exact = dim == 0 or np.sqrt(norm * norms.max(initial=0.0)) * 1.01 < EXACT
        lower = np.abs(near - place).max(axis=1, initial=0.0)
        total = norm + norms
        upper = (total - lower ** 2) / 2 + 1e-9 * total + 1  # the slack covers rounding of the distances
        order = np.argsort(-upper, kind="stable")
        kept_scores, kept_ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(order), STEP):
            part = order[at:at + STEP]
            if len(kept_ids) >= k and upper[part[0]] < kept_scores[k - 1]:
                break
            part = part[ids[part] != own]
            got = scores(vectors[part], query, vectors[part].astype(float) if exact else None)
            all_scores, all_ids = np.r_[kept_scores, got], np.r_[kept_ids, ids[part]]
            first = np.lexsort((all_ids, ~all_scores))[:k]  # ~s orders as -s does and cannot overflow
            kept_scores, kept_ids = all_scores[first], all_ids[first]
        out.append(pd.DataFrame({"query_id": own, "vec_id": kept_ids, "score": kept_scores}))
    return pd.concat(out, ignore_index=True)


def top_k(rows: DataFrame, is_query: Column, k: int = 10, query_block: int = QUERY_BLOCK,
          candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products among all other vectors.

    Ties go to the smaller id; fewer than k candidates give fewer rows. Only vectors of the query's length are
    candidates. Rows that repeat a vec_id are candidates each, except for the query of that id itself; a repeated query
    id is asked once, with its smallest vector. Scores beyond the range of a long stop at its ends.
    """
    vectors = stored(integer_vectors(rows))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE).toPandas()
    pivots = {int(dim): choose_pivots(matrix(own["vector"], int(dim))) for dim, own in sample.groupby("dim") if dim}

    def add_distances(batches):
        for batch in batches:
            near = np.empty(len(batch), object)
            for dim, places in batch.groupby("dim").indices.items():
                own = matrix(batch["vector"].iloc[places], int(dim)).astype(float)
                found = distances(own, pivots[dim]) if dim in pivots else np.zeros((len(own), 1))
                for at, row in zip(places, found):
                    near[at] = row
            yield batch.assign(near=near)

    pivot_table = stored(vectors.mapInPandas(add_distances, "vec_id long, vector array<long>, dim int, near array<double>"))
    queries = pivot_table.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "vector", "near")).alias("row")).select("vec_id", "row.*")
    queries = stored(queries)
    n_queries, n_rows = queries.count(), pivot_table.count()
    query_blocks, blocks = max(1, -(-n_queries // query_block)), max(1, -(-n_rows // candidate_block))
    every_query_block = F.sequence(F.lit(0), F.lit(query_blocks - 1))
    every_block = F.sequence(F.lit(0), F.lit(blocks - 1))
    # block numbers come from a hash of all a row has, so equal ids do not pile up in one block
    asked = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).withColumn("cb", F.explode(every_block))
    spread = F.pmod(F.xxhash64("vec_id", "vector", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    candidates = pivot_table.withColumn("cb", spread).withColumn("qb", F.explode(every_query_block))
    cell = ["dim", "qb", "cb"]

    def meet(queries_here: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries_here) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return best_in_block(queries_here, block, k)

    found = asked.groupBy(*cell).cogroup(candidates.groupBy(*cell)).applyInPandas(meet, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


# The same result in SQL, for tables that one process can hold.
TOP_K_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e) where q.vec_id % 100 = 0)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10
"""
