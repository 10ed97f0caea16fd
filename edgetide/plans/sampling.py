"""Deterministic pseudo-random choices: every draw is a function of a seed and the row's keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgetide.plans.ordered import row_numbers

BITS = 60
# Primes above any table size; stepping by one of them visits every residue of a smaller size once.
STEPS = (
    1152921504606847009, 1152921504606847067, 1152921504606847081, 1152921504606847123,
    1152921504606847127, 1152921504606847189, 1152921504606847201, 1152921504606847229,
)


def digest(seed: int, *keys) -> Column:
    """md5 text of ``seed|key|...``; ordering by it is a reproducible shuffle."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def draw(seed: int, *keys) -> Column:
    """Uniform integer in [0, 2**60) from the digest."""
    return F.conv(F.substring(digest(seed, *keys), 1, BITS // 4), 16, 10).cast("long")


def uniform(seed: int, *keys) -> Column:
    """Uniform double in [0, 1), of 53 random bits."""
    return F.shiftright(draw(seed, *keys), BITS - 53) / F.lit(float(1 << 53))


def permuted(j: Column, size: Column, seed: int, *keys) -> Column:
    """The ``j``-th element of a seeded permutation of [0, size), size < 2**60: distinct for distinct ``j`` < size.

    Start and step are drawn per key. The step is a prime above ``size`` taken modulo ``size``, so it is coprime to the
    size and as large as the size allows; products are computed in 38 digits.
    """
    chosen = F.get(F.array(*[F.lit(p) for p in STEPS]), (draw(seed, F.lit("step"), *keys) % len(STEPS)).cast("int"))
    wide = lambda c: c.cast("decimal(19,0)")
    moved = wide(F.pmod(chosen, size)) * wide(j) + F.pmod(draw(seed, *keys), size)
    return F.pmod(moved, wide(size)).cast("long")


def smallest_digests(rows: DataFrame, wanted: Column, seed: int, key: str) -> DataFrame:
    """The ``wanted`` rows (a scalar) of smallest digest of a unique ``key``: a sample of exact size.

    Rows are counted per digest prefix (at most 65,536 counts). Whole prefixes below the boundary are taken
    as they are; only the boundary prefix has to be sorted.
    """
    tagged = rows.withColumn("_d", digest(seed, key)).withColumn("_g", F.substring("_d", 1, 4))
    sizes = tagged.groupBy("_g").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_g"))
    edge = sizes.select("_g", "_n", upto.alias("_upto")).withColumn("_want", wanted).where("_upto >= _want")
    edge = edge.agg(F.min(F.struct("_g", (F.col("_want") - F.col("_upto") + F.col("_n")).alias("left")))).scalar()
    marked = tagged.withColumn("_edge", edge)
    whole = marked.where("_edge is null or _g < _edge._g")
    border = row_numbers(marked.where("_g = _edge._g"), ["_d", key], "_rank").where("_rank <= _edge.left")
    return whole.unionByName(border.drop("_rank")).drop("_d", "_g", "_edge")
