"""Reversible line deduplication: exact document counts per line key, sharded cuckoo filters in front of them.

A *line index* has two tables. ``refs`` holds the exact number of documents of every key, ``filters`` one cuckoo
filter per shard with the keys that are frequent at the moment. Adding documents and taking them away both are small
tables of count changes; keys that cross the threshold enter or leave the filters, so a line comes back as soon
as too few documents hold it. Lookups ask the filter of the key's shard first and read the exact counts
only for keys it lets through. A shard holds a bounded number of keys, whatever the number of keys is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.llm.common import fresh, whole_text
from edgetide.session import stored

BLANK = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 20_000  # keys of a shard when an index is laid out
SLOTS, KICKS = 4, 500
OCCURRENCES = "doc_id long, text_hash long, key binary"
FILTERS = "shard long, n_buckets long, slots binary"


def line_key(line: bytes) -> bytes | None:
    """md5 of the line without blanks at its ends and with A-Z in lower case; None if nothing is left."""
    core = line.strip(BLANK).lower()
    return hashlib.md5(core).digest() if core else None


class CuckooFilter:
    """Set of 128-bit keys with deletion, as 16-bit marks in buckets of four; may say yes wrongly, never no."""

    def __init__(self, n_buckets: int, slots: bytes | None = None):
        self.n = n_buckets  # a power of two
        self.slots = np.zeros((n_buckets, SLOTS), np.uint16) if slots is None else np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy()

    @staticmethod
    def sized(keys: int) -> CuckooFilter:
        return CuckooFilter(1 << max(2, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * 0.8))))))

    def places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
        marks = (words[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (words[:, 0] & np.uint64(self.n - 1)).astype(np.int64)
        return marks, first, first ^ self.step(marks)

    def step(self, marks):
        return (marks.astype(np.int64) * 0x5BD1E995 >> 7) & (self.n - 1)

    def contains(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        marks, first, second = self.places(keys)
        return ((self.slots[first] == marks[:, None]) | (self.slots[second] == marks[:, None])).any(axis=1)

    def add(self, keys: list[bytes]) -> bool:
        """False if there was no room; the filter must then be built anew with more buckets."""
        if not keys:
            return True
        for mark, first, second in zip(*self.places(keys)):
            for at in (first, second):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = mark
                    break
            else:
                at = second
                for kick in range(KICKS):
                    slot = (int(mark) + kick) % SLOTS
                    mark, self.slots[at, slot] = self.slots[at, slot], mark
                    at = at ^ int(self.step(np.array([mark]))[0])
                    free = np.flatnonzero(self.slots[at] == 0)
                    if len(free):
                        self.slots[at, free[0]] = mark
                        break
                else:
                    return False
        return True

    def remove(self, keys: list[bytes]) -> None:
        """Takes out keys that were added before."""
        for mark, first, second in zip(*self.places(keys)) if keys else ():
            for at in (first, second):
                hit = np.flatnonzero(self.slots[at] == mark)
                if len(hit):
                    self.slots[at, hit[0]] = 0
                    break


def built(keys: list[bytes]) -> CuckooFilter:
    size = len(keys)
    while True:
        made = CuckooFilter.sized(size)
        if made.add(keys):
            return made
        size = 2 * max(size, 4)


@dataclass
class LineIndex:
    refs: DataFrame  # shard, key, n_docs: one row per key that some document holds
    filters: DataFrame  # shard, n_buckets, slots: one row per shard with a frequent key
    shards: int
    threshold: int


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, key): the distinct keys of the lines of each document; repeated rows are documents too."""

    @F.pandas_udf("array<binary>")
    def keys(texts: pd.Series) -> pd.Series:
        return pd.Series([list({k for k in map(line_key, t.encode().split(b"\n")) if k}) for t in texts], dtype=object)

    text = whole_text("text")
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.explode(keys(text)).alias("key"))


def counted(found: DataFrame) -> DataFrame:
    return found.groupBy("key").agg(F.count("*").alias("n_docs"))


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("long")


def _filters(frequent: DataFrame) -> DataFrame:
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made = built(list(rows["key"]))
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "n_buckets": [made.n], "slots": [made.slots.tobytes()]})

    return frequent.select("shard", "key").groupBy("shard").applyInPandas(build, FILTERS)


def new_index(found: DataFrame, threshold: int, shards: int | None = None) -> LineIndex:
    """An index over ``occurrences``; the number of shards follows the number of keys unless given."""
    counts = stored(counted(found))
    shards = shards or max(1, -(-counts.count() // SHARD_KEYS))
    refs = counts.select(shard_of(F.col("key"), shards).alias("shard"), "key", "n_docs")
    return LineIndex(refs, stored(_filters(refs.where(F.col("n_docs") >= threshold))), shards, threshold)


def changed_index(index: LineIndex, found: DataFrame, sign: int) -> LineIndex:
    """The index after documents with these occurrences were inserted (sign 1) or deleted (sign -1).

    Deleting documents that were never inserted is an error of the caller; counts below one vanish.
    """
    change = counted(found).select(shard_of(F.col("key"), index.shards).alias("shard"), "key", (F.col("n_docs") * sign).alias("delta"))
    merged = stored(
        index.refs.select("shard", "key", F.col("n_docs").alias("was"), F.lit(0).cast("long").alias("delta"))
        .unionByName(change.withColumn("was", F.lit(0).cast("long")))
        .groupBy("shard", "key").agg(F.sum("was").alias("was"), F.sum("delta").alias("delta"))
    )
    refs = merged.select("shard", "key", (F.col("was") + F.col("delta")).alias("n_docs")).where("n_docs > 0")
    before, after = F.col("was") >= index.threshold, F.col("was") + F.col("delta") >= index.threshold
    crossing = merged.where(before != after).select("shard", "key", after.alias("enters"))

    def update(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if len(old):
            made, room = CuckooFilter(int(old["n_buckets"].iloc[0]), old["slots"].iloc[0]), True
        else:
            made, room = CuckooFilter.sized(len(new)), True
        if len(new):
            made.remove(list(new.loc[~new["enters"], "key"]))
            room = made.add(list(new.loc[new["enters"], "key"]))
        shard = (old if len(old) else new)["shard"].iloc[0]
        return pd.DataFrame({"shard": [shard], "n_buckets": [made.n if room else 0], "slots": [made.slots.tobytes()]})

    updated = stored(index.filters.groupBy("shard").cogroup(crossing.groupBy("shard")).applyInPandas(update, FILTERS))
    full = updated.where("n_buckets = 0").select("shard")  # no room left: built anew from the exact counts
    again = _filters(refs.where(F.col("n_docs") >= index.threshold).join(full, "shard", "left_semi"))
    return LineIndex(refs, stored(updated.where("n_buckets > 0").unionByName(again)), index.shards, index.threshold)


def frequent_keys(index: LineIndex, keys: DataFrame) -> DataFrame:
    """Those of the distinct ``key`` rows that the index holds as frequent: filter first, exact counts next."""

    def probe(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return asked.head(0)[["shard", "key"]]
        known = CuckooFilter(int(own["n_buckets"].iloc[0]), own["slots"].iloc[0])
        return asked.loc[known.contains(list(asked["key"])), ["shard", "key"]]

    asked = keys.select(shard_of(F.col("key"), index.shards).alias("shard"), "key")
    maybe = index.filters.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(probe, "shard long, key binary")
    exact = index.refs.where(F.col("n_docs") >= index.threshold)
    return maybe.join(exact, ["shard", "key"], "left_semi").select("key")


def without_keys(docs: DataFrame, found: DataFrame, hits: DataFrame, into: str = "cleaned") -> DataFrame:
    """``docs`` with a column ``into`` (struct n_lines, n_dropped, kept): every line whose key is a hit is dropped.

    ``found`` are the occurrences of ``docs``. A null text counts as one empty line and keeps an empty text.
    """
    dropped = found.join(hits, "key", "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set("key").alias("keys"))
    h, taken = fresh(docs.columns, "text_hash"), fresh(docs.columns, "taken")
    left = docs.withColumn(h, F.xxhash64(whole_text("text")))
    # sides may not share names: ids of both are compared null-safely
    own_id, own_hash, own_keys = (fresh([*docs.columns, h, taken], f"right_{name}") for name in ("id", "hash", "keys"))
    right = dropped.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), F.col("keys").alias(own_keys))
    joined = left.join(right, left["doc_id"].eqNullSafe(right[own_id]) & (left[h] == right[own_hash]), "left")

    @F.pandas_udf("struct<n_lines: long, n_dropped: long, kept: string>")
    def clean(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        rows = []
        for text, gone in zip(texts, keys):
            lines = text.split("\n")
            if gone is None:
                rows.append((len(lines), 0, text))
                continue
            gone = set(map(bytes, gone))
            kept = [x for x in lines if line_key(x.encode()) not in gone]
            rows.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
        return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])

    cleaned = joined.withColumn(taken, clean(whole_text("text"), F.col(own_keys)))
    return cleaned.select(*docs.columns, F.col(taken).alias(into))


def dedup_lines(docs: DataFrame, threshold: int = 10, into: str = "cleaned") -> DataFrame:
    """``docs`` with a column ``into``: lines found in at least ``threshold`` documents are dropped in all of them.

    Lines that are empty but for blanks always stay. A column of ``docs`` with that name is replaced. Repeated rows are
    separate documents. Ids may be null or repeat; documents are told apart by id and text.
    """
    base = docs.drop(into)
    found = stored(occurrences(base))
    index = new_index(found, threshold)
    return without_keys(base, found, frequent_keys(index, index.refs.select("key")), into)


def cleaned_documents(docs: DataFrame, threshold: int = 10) -> DataFrame:
    """The documents with the cleaned text in place of their own; null texts stay null, ``n_chars`` is counted anew."""
    into = fresh(docs.columns, "cleaned")
    out = dedup_lines(docs, threshold, into).withColumn("text", F.when(F.col("text").isNotNull(), F.col(into)["kept"]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def line_digest(docs: DataFrame, threshold: int = 10) -> DataFrame:
    small = dedup_lines(docs.select("doc_id", "text"), threshold)
    return small.select("doc_id", "cleaned.n_lines", "cleaned.n_dropped", F.sha2("cleaned.kept", 256).alias("kept_sha256"))


# The same result in SQL, for tables that one process can hold.
LINE_DIGEST_SQL = r"""
with docs as (
  select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
each as (
  select r, i, lines[i] as line,
         translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from docs, unnest(range(1, len(lines) + 1)) as u(i)),
frequent as (select k from each where k <> '' group by k having count(distinct r) >= 10),
marked as (select r, i, line, k in (select k from frequent) as gone from each)
select doc_id, n_lines, n_dropped, sha256(kept) as kept_sha256 from docs join (
  select r, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
         coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '') as kept
  from marked group by r) using (r)
"""
