"""Reproducible shuffle into shards: a keyed Feistel permutation of global row numbers with cycle walking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.llm.common import fresh, whole_text
from edgetide.plans.ordered import row_numbers

ROUNDS = 6


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(numbers: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The places of ``numbers`` (all in [0, size)) under a permutation of [0, size) chosen by ``seed``.

    A balanced Feistel network permutes the next power of four; numbers that land outside walk on until they
    are inside, which needs fewer than four steps on average.
    """
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [(seed * 0x632BE59BD9B4E019 + n * 0xD1342543DE82EF95) % (1 << 64) for n in range(ROUNDS)]
    places = numbers.astype(np.uint64)
    walking = np.ones(len(places), dtype=bool)
    with np.errstate(over="ignore"):
        while walking.any():
            left, right = places[walking] >> half, places[walking] & mask
            for key in keys:
                left, right = right, left ^ (_mixed(right, key) & mask)
            places[walking] = (left << half) | right
            walking = places >= np.uint64(size)
    return places.astype(np.int64)


def permuted(number: Column, size: int, seed: int) -> Column:
    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), size, seed))

    return place(number)


def assign_shards(rows: DataFrame, order: list[str], shards: int, seed: int = 11) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: shard sizes differ by at most one and slots have no gaps.

    Rows are numbered globally in ``order``; the number's place under the permutation gives the shard (place
    modulo ``shards``) and the slot (place div ``shards``), so both can be computed for any row number without
    the data. Nulls sort first. Rows equal in ``order`` are numbered in any order, so name enough columns to
    tell apart whatever matters. The result does not depend on how the input was partitioned. An empty table
    gives an empty table. Columns of ``rows`` called ``shard`` or ``slot`` are replaced.
    """
    base = rows.drop("shard", "slot")
    number = fresh(base.columns, "row_number")
    numbered = row_numbers(base, order, number, start=0)
    size = numbered.count()
    place = fresh(base.columns, "place")
    placed = numbered.withColumn(place, permuted(F.col(number), size, seed))
    return placed.select(
        *base.columns, (F.col(place) % shards).cast("int").alias("shard"),
        F.expr(f"`{place}` div {shards}").alias("slot"),
    )


def document_shards(docs: DataFrame, shards: int = 40, seed: int = 11) -> DataFrame:
    """Each document's size, text checksum, shard and slot under the law ``rows``.

    Only id, size and checksum are shuffled, never the text. A null text counts as empty: size 16, checksum 0.
    Repeated rows are kept and get slots of their own.
    """
    text = whole_text("text")
    small = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    dealt = assign_shards(small, ["doc_id", "text_crc32", "size"], shards, seed)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
