"""SimHash near-duplicates: 64-bit fingerprints linked at a few differing bits through deletion-variant signatures.

Two fingerprints with at most four differing bits have a segment, of three, in which they differ by at most one
bit. Every segment is indexed once per bit with that bit left out (64 signatures per fingerprint), so such a
pair shares a signature. Signatures are compared by equality, pairs that share one are verified.

A signature held by many fingerprints is dealt out as a grid of blocks, and links inside a block are reported as a
spanning forest, never as all pairs: the forests connect exactly what all links would connect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgetide.llm.common import fresh, whole_text
from edgetide.llm.components import components
from edgetide.session import stored

SEGMENTS = ((0, 21), (21, 42), (42, 64))  # bit ranges; each differs by at most one bit somewhere at distance 4
DISTANCE = 4
PAIRED = 48  # up to so many fingerprints of one signature are compared row by row
BLOCK = 2048  # fingerprints of a signature that are compared in one go
SEED, WORDS = 42, 4


def fingerprint(text: str, words: int = WORDS) -> int:
    """Majority bits of the hashes of all word shingles, repeats included; zero for a text without words."""
    found = text.encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    else:
        ends = np.cumsum([len(w) + 1 for w in found])
        starts, digest = [0, *ends[:-words].tolist()], xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(text: Column) -> Column:
    """The fingerprint as a long (the same 64 bits, read as signed)."""

    @F.pandas_udf("long")
    def mark(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], "<u8").view("<i8"))

    return mark(whole_text(text))


def signatures(fp: Column) -> Column:
    """Array of 64 longs: for each bit, the rest of the bit's segment together with the bit's number."""
    found = []
    for low, high in SEGMENTS:
        segment = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        for bit in range(low, high):
            rest = segment.bitwiseAND(F.lit(~(1 << (bit - low))))
            found.append(rest.bitwiseOR(F.lit(bit << 32)))
    return F.array(*found)


def _first_shared(differing: np.ndarray) -> np.ndarray:
    """Number of the lowest bit whose signature two fingerprints share, given their differing bits."""
    shared = np.full(len(differing), 64)
    for low, high in reversed(SEGMENTS):
        part = (differing >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        count = np.bitwise_count(part)
        own = np.where(count == 0, low, low + np.bitwise_count(part - np.uint64(1)).astype(int))
        shared = np.where(count <= 1, own, shared)
    return shared


def _forest(values: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever is connected among ``values`` by links of at most ``distance`` bits."""
    left, found = values, []
    while len(left):
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            here = queue.pop()
            for centre in here:
                near = np.bitwise_count(left ^ centre) <= distance
                if near.any():
                    reached, left = left[near], left[~near]
                    found.append((np.full(len(reached), centre), reached))
                    queue.append(reached)
                    if not len(left):
                        break
    return found


def _pairs(signature: np.ndarray, values: np.ndarray, distance: int, once: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within runs of equal signatures; small runs row by row.

    With ``once``, a link of a small run is reported by the first signature that its ends share only.
    """
    starts = np.flatnonzero(np.r_[True, signature[1:] != signature[:-1]])
    lengths = np.diff(np.r_[starts, len(signature)])
    found = []
    large = np.flatnonzero(lengths > PAIRED)
    for n in large:
        found += _forest(values[starts[n]:starts[n] + lengths[n]], distance)
    small = np.repeat(lengths <= PAIRED, lengths)
    signature, values = signature[small], values[small]
    for lag in range(1, int(lengths[lengths <= PAIRED].max(initial=1))):
        a, b = values[:-lag], values[lag:]
        same = np.flatnonzero(signature[:-lag] == signature[lag:])
        if not len(same):
            break
        differing = a[same] ^ b[same]
        close = np.bitwise_count(differing) <= distance
        same, differing = same[close], differing[close]
        if once:
            same = same[_first_shared(differing) == (signature[same] >> 32)]
        found.append((a[same], b[same]))
    return found


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cell", pa.int64()), ("block", pa.int64())])


def _batch(a, b, cell=None, block=None) -> pa.RecordBatch:
    n, none = len(a), pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([
        pa.array(np.asarray(a).view(np.int64)), none if b is None else pa.array(np.asarray(b).view(np.int64)),
        none if cell is None else pa.array(np.full(n, cell)), none if block is None else pa.array(block),
    ], schema=LINKS)


def linked_runs(batches: Iterator[pa.RecordBatch], distance: int, defer: bool, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within the runs of equal ``sig`` of a sorted partition.

    With ``defer``, a run of more than ``size`` values is not compared but passed on as rows (a, cell, block).
    """
    open_sig, open_values, passed = None, np.zeros(0, np.uint64), 0

    def cut(sig, values, done):
        """The run's whole blocks, passed on as rows."""
        return _batch(values, None, sig, (done + np.arange(len(values))) // size)

    for batch in batches:
        sig = batch.column("sig").to_numpy(zero_copy_only=False)
        values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(sig):
            continue
        if open_sig is not None:
            if passed and sig[0] != open_sig:
                yield cut(open_sig, open_values, passed)
                open_values, passed = np.zeros(0, np.uint64), 0
            if not passed:
                sig = np.r_[np.full(len(open_values), open_sig), sig]
                values = np.r_[open_values, values]
                open_values = np.zeros(0, np.uint64)
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        lengths = np.diff(np.r_[starts, len(sig)])
        if passed:  # the first run goes on from earlier batches
            yield cut(open_sig, np.r_[open_values, values[:lengths[0]]], passed)
            passed += len(open_values) + int(lengths[0])
            open_values, sig, values = np.zeros(0, np.uint64), sig[lengths[0]:], values[lengths[0]:]
            if not len(sig):
                continue
            passed, starts, lengths = 0, starts[1:] - lengths[0], lengths[1:]
        last = int(starts[-1])
        if defer:
            for n in np.flatnonzero(lengths[:-1] > size):
                yield cut(sig[starts[n]], values[starts[n]:starts[n] + lengths[n]], 0)
            whole = np.repeat(lengths[:-1] <= size, lengths[:-1])
            found = _pairs(sig[:last][whole], values[:last][whole], distance, True) if whole.any() else []
        else:
            found = _pairs(sig[:last], values[:last], distance, False) if last else []
        open_sig, open_values = int(sig[last]), values[last:]
        if defer and len(open_values) > size:
            yield cut(open_sig, open_values, 0)
            passed, open_values = len(open_values), np.zeros(0, np.uint64)
        for a, b in found:
            yield _batch(a, b)
    if len(open_values):
        if passed:
            yield cut(open_sig, open_values, passed)
        else:
            for a, b in _pairs(np.full(len(open_values), open_sig), open_values, distance, defer):
                yield _batch(a, b)


SCHEMA = "a long, b long, cell long, block long"


def links(marks: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` exactly as all links of ``distance`` bits do."""
    if distance > 5:
        raise ValueError("three segments find pairs of up to five differing bits")
    signed = marks.select(F.explode(signatures(F.col("fp"))).alias("sig"), "fp")
    sorted_rows = signed.repartition("sig").sortWithinPartitions("sig", "fp")
    first = stored(sorted_rows.mapInArrow(lambda rows: linked_runs(rows, distance, True, block), SCHEMA))
    # signatures with very many fingerprints: every pair of blocks is one cell
    blocks = first.where("cell is not null").select("cell", "block", F.col("a").alias("fp"))
    counts = blocks.groupBy("cell").agg((F.max("block") + 1).alias("n_blocks"))
    dealt = (
        blocks.join(counts, "cell").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
        .where("n_blocks = 1 or block <> other")
        .select(F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")).alias("sig"), "fp")
    )
    rest = dealt.repartition("sig").sortWithinPartitions("sig", "fp").mapInArrow(
        lambda rows: linked_runs(rows, distance, False, block), SCHEMA)
    return first.where("cell is null").unionByName(rest).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, text_hash, fingerprint, group_key, component_id) per row of ``docs``.

    ``component_id`` is the smallest id reachable over links, the row's own included; ``group_key`` names
    the component also where all its ids are null (then ``component_id`` is null). Texts without words have
    fingerprint zero. Repeated rows give repeated rows.
    """
    text = whole_text("text")
    marked = stored(docs.select("doc_id", F.xxhash64(text).alias("text_hash"), fingerprints(F.col("text")).alias("fp")))
    marks = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(marks.select("fp"), distance), "a", "b")
    rooted = (
        marks.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
        .withColumn("root", F.coalesce("root", "fp"))
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(least, "root").select("fp", F.col("root").alias("group_key"), "component_id"))
    return marked.join(named, "fp").select(
        "doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "group_key", "component_id")


def fingerprint_components(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest id stays.

    Among rows that repeat the smallest id (or lack an id, where a whole component does), the one with the
    smallest text hash stays, and of wholly equal ones any.
    """
    found = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = found.groupBy("group_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("row")).select(
        F.col("row.doc_id").alias("_kept_id"), F.col("row.text_hash").alias("_kept_hash"))
    h = fresh(docs.columns, "text_hash")
    rows = docs.withColumn(h, F.xxhash64(whole_text("text")))
    same = rows["doc_id"].eqNullSafe(chosen["_kept_id"]) & (rows[h] == chosen["_kept_hash"])
    kept = rows.join(chosen, same, "left_semi")
    number = fresh(kept.columns, "number")
    # equal ids and texts are rows of one original; a document without copies of itself is alone in its window
    first = Window.partitionBy("doc_id", h).orderBy(F.xxhash64(F.to_json(F.struct(*docs.columns))))
    return kept.withColumn(number, F.row_number().over(first)).where(F.col(number) == 1).select(*docs.columns)
