"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DRAW = 1 << 40
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bounds what a Python worker is handed at once by bytes, as texts differ in length by orders of magnitude."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores in front until no column of ``taken`` has it (case is ignored, as Spark does)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def whole_text(column: Column | str) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def held_out(doc_id: str, parts: int, rest: int) -> Column:
    """True for the fold that is never learned from. Rows without an id are never learned from either."""
    return F.coalesce(fold(doc_id, parts) == rest, F.lit(True))


def sampled(rows: DataFrame, stratum: str, keys: list[str], bound: int, seed: int = 17) -> DataFrame:
    """About ``bound`` rows of each stratum, or all of a smaller one, drawn by a hash of ``keys``.

    The share kept is ``bound`` over the stratum's row count, so the rule is the same at every size and the
    expected number of rows has a bound. Rows with a null stratum are left out.
    """
    size, drawn = fresh(rows.columns, "stratum_rows"), F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(DRAW))
    counts = rows.where(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count("*").alias(size))
    kept = rows.join(counts, stratum).where(drawn * F.col(size).cast("double") < float(bound) * DRAW)
    return kept.select(*rows.columns)


def small(rows: DataFrame, most: int = 500_000) -> DataFrame:
    """``rows`` with a hint to broadcast them after counting at most ``most``, else as they are: the join then shuffles.

    For narrow rows only: ids, hashes and counts.
    """
    return F.broadcast(rows) if rows.count() <= most else rows


def apart(rows: DataFrame) -> DataFrame:
    """``rows`` with a hint to meet others in a shuffle, for tables that grow with the input.

    Spark sizes a table by its files, or by its rows before an explode, and may send one of many times that size through the driver.
    """
    return rows.hint("merge")
