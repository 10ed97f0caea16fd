"""Ordered computations over data that is larger than one task.

Keys that one task can sort (at most ``BUSY`` rows in their hash bucket) take one shuffle by key and a plain window.
Everything else rests on one placement: rows are range-partitioned and sorted by the order columns, then
written to the shared folder with their place, so the placement never changes afterwards. A key with very many rows is
then spread over several consecutive partitions, and only a *carry* of one small row per partition has to
travel from one partition to the next. No step sorts or collects a busy key in one task, and the carry
tables hold at most one row per partition, which is what makes broadcasting them safe.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgetide.session import stored

PART, POS = "_part", "_pos"
_IN_PARTITION = (1 << 33) - 1  # monotonically_increasing_id keeps the row position in its low 33 bits
BUSY = 2_000_000  # rows of a bucket of keys that one task sorts
BUCKETS = 1 << 14


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def range_sorted(df: DataFrame, *order, keep: Sequence[str] = ("*",)) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, with ``_part`` and ``_pos`` naming each row's place; columns ``keep``.

    The places are stored as columns, so they stay what they are however the table is read later.
    """
    cols = [_column(c) for c in order]
    placed = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    return stored(placed.select(
        *keep,
        F.spark_partition_id().alias(PART),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)).alias(POS),
    ))


def busy_keys(keys: Sequence[str], *tables: DataFrame) -> Column | None:
    """Condition on the rows of keys whose hash bucket holds more than ``BUSY`` rows of ``tables``; None without any.

    Buckets are counted map-side, so the count moves next to nothing; at most one bucket in ``BUSY`` rows is full.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    rows = reduce(DataFrame.unionAll, [t.select(bucket.alias("_bucket")) for t in tables])
    full = rows.groupBy("_bucket").agg(F.count("*").alias("_n")).where(F.col("_n") > BUSY).collect()
    return bucket.isin([r["_bucket"] for r in full]) if full else None


def so_far(keys: Sequence[str], order: Sequence):
    """Window from a key's first row in ``order`` to the current one, for keys that are not busy."""
    return Window.partitionBy(*keys).orderBy(*[_column(c) for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` shuffled by ``keys`` to all tasks. Rows that grow after the shuffle must not be put together by their bytes before it."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _in_part(keys: Sequence[str]):
    return Window.partitionBy(PART, *keys).orderBy(POS)


def _over_parts(keys: Sequence[str]):
    """Window over carry tables: few rows per key, at most one per partition."""
    return (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(PART)


def _attach(placed: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return placed.join(F.broadcast(carry), [PART, *keys], "left")


def _ends(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per partition: its last key, the partition after it and whether the key goes on there."""
    ends = placed.groupBy(PART).agg(F.min(F.struct(*keys)).alias("_first"), F.max(F.struct(*keys)).alias("_final"))
    line = _over_parts([])
    linked = ends.select(
        PART, "_final", F.lead("_first").over(line).alias("_next_first"), F.lead(PART).over(line).alias("_next_part"))
    return linked.select(PART, "_final.*", "_next_part", (F.col("_final") == F.col("_next_first")).alias("_goes_on"))


def row_numbers(df: DataFrame, order: Sequence, name: str, start: int = 1, keep: Sequence[str] = ("*",)) -> DataFrame:
    """Dense global numbering of rows in ``order``. Columns that only the order needs are not stored if ``keep`` names the others."""
    placed = range_sorted(df, *order, keep=keep)
    sizes = placed.groupBy(PART).agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(_over_parts([]).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(PART, F.coalesce(earlier, F.lit(0)).alias("_before"))
    numbered = placed.join(F.broadcast(offsets), PART)
    return numbered.withColumn(name, F.col("_before") + F.col(POS) + F.lit(start)).drop(PART, POS, "_before")


def running_totals(
    df: DataFrame, within: Sequence[str], order: Sequence, sums: Mapping[str, Column]
) -> DataFrame:
    """Inclusive running sums per ``within`` key (non-null), rows in ``order``. With keys, the result is stored."""
    if within:
        busy = busy_keys(within, df)
        window = so_far(within, order)
        near = (df if busy is None else df.where(~busy)).select(
            "*", *[(F.lit(0) + F.sum(expr).over(window)).alias(n) for n, expr in sums.items()])
        return stored(near if busy is None else near.unionByName(_placed_totals(df.where(busy), within, order, sums)))
    return _placed_totals(df, within, order, sums)


def _placed_totals(df: DataFrame, within: Sequence[str], order: Sequence, sums: Mapping[str, Column]) -> DataFrame:
    inputs = df.select("*", *[expr.alias(f"_in_{n}") for n, expr in sums.items()])
    placed = range_sorted(inputs, *within, *order)
    parts = [F.sum(f"_in_{n}").alias(f"_in_{n}") for n in sums]
    if within:
        # only the last key of a partition can go on in the next one: one row per partition is summed and carried
        ends = _ends(placed, within).where("_goes_on")
        totals = placed.join(F.broadcast(ends.select(PART, *within, "_next_part")), [PART, *within]).groupBy(
            PART, *within, "_next_part").agg(*parts)
        before = _over_parts(within).rowsBetween(Window.unboundedPreceding, 0)
        carry = totals.select(
            F.col("_next_part").alias(PART), *within, *[F.sum(f"_in_{n}").over(before).alias(f"_base_{n}") for n in sums])
    else:
        before = _over_parts([]).rowsBetween(Window.unboundedPreceding, -1)
        carry = placed.groupBy(PART).agg(*parts).select(
            PART, *[F.sum(f"_in_{n}").over(before).alias(f"_base_{n}") for n in sums])
    local = _in_part(within).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.select("*", *[F.sum(f"_in_{n}").over(local).alias(n) for n in sums])
    out = _attach(summed, carry, within)
    for n in sums:
        out = out.withColumn(n, F.coalesce(F.col(f"_base_{n}"), F.lit(0)) + F.col(n))
    return out.drop(PART, POS, *[f"_in_{n}" for n in sums], *[f"_base_{n}" for n in sums])


def next_row(df: DataFrame, within: Sequence[str], order: Sequence, values: Mapping[str, str]) -> DataFrame:
    """Adds, for each ``new: column`` in ``values``, the column's value in the following row of the key. With keys, the
    result is stored."""
    if within:
        busy = busy_keys(within, df)
        following = F.lead(F.struct(*[F.col(c).alias(n) for n, c in values.items()])).over(
            Window.partitionBy(*within).orderBy(*[_column(c) for c in order]))
        near = (df if busy is None else df.where(~busy)).withColumn("_next", following).select(
            *[c for c in df.columns if c not in values], *[F.col(f"_next.{n}").alias(n) for n in values])
        return stored(near if busy is None else near.unionByName(_placed_next(df.where(busy), within, order, values)))
    return _placed_next(df, within, order, values)


def _placed_next(df: DataFrame, within: Sequence[str], order: Sequence, values: Mapping[str, str]) -> DataFrame:
    placed = range_sorted(df, *within, *order)
    payload = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    # the first row of a partition follows the last row of the one before it
    first, last = F.struct(*within, payload.alias("_carry")), F.struct(*within, F.lit(0).alias("_all"))
    heads = placed.groupBy(PART).agg(F.min_by(first, POS).alias("_head"), F.max_by(last, POS).alias("_last"))
    following = heads.select(PART, "_last", F.lead("_head").over(_over_parts([])).alias("_head"))
    same = [F.col(f"_last.{c}") == F.col(f"_head.{c}") for c in within]
    carry = following.where(reduce(and_, same, F.col("_head").isNotNull())).select(
        PART, *[F.col(f"_last.{c}").alias(c) for c in within], "_head._carry")
    out = _attach(placed.withColumn("_next", F.lead(payload).over(_in_part(within))), carry, within)
    out = out.withColumn("_next", F.coalesce("_next", "_carry"))
    kept = [c for c in df.columns if c not in values]
    return out.select(*kept, *[F.col(f"_next.{n}").alias(n) for n in values])


def quantiles(
    df: DataFrame, value: str, at: Mapping[str, float], within: Sequence[str] = ()
) -> DataFrame:
    """Exact linear-interpolated quantiles per key: one row per key, one column per name in ``at``.

    Works on counts per distinct value, so no task holds the values of a whole key.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*within, value).agg(F.count("*").alias("_c"))
    ranked = running_totals(counted, within, [value], {"_cum": F.col("_c")})
    sizes = ranked.groupBy(*within).agg(F.max("_cum").alias("_n"))
    if within:
        ranked = ranked.join(sizes, list(within))
    else:
        ranked = ranked.withColumn("_n", sizes.scalar())
    found, expressions = [], []
    for name, fraction in at.items():
        spot = F.lit(float(fraction)) * (F.col("_n") - 1)
        low, high = F.floor(spot), F.ceil(spot)
        found += [
            F.min(F.when(F.col("_cum") > low, F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_cum") > high, F.col(value))).alias(f"_hi_{name}"),
            F.max(spot - low).alias(f"_w_{name}"),
        ]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        expressions.append((lo + (hi - lo) * F.col(f"_w_{name}")).cast("double").alias(name))
    return ranked.groupBy(*within).agg(*found).select(*within, *expressions)


def _last(array: Column, k: int) -> Column:
    return F.slice(array, F.greatest(F.size(array) - F.lit(k - 1), F.lit(1)), k)


def last_before(
    points: DataFrame, queries: DataFrame, keys: Sequence[str], at: str, payload: Sequence[str], k: int,
    tie: Sequence[str] = (), name: str = "recent",
) -> DataFrame:
    """The last ``k`` points of a key strictly before each queried moment, oldest first.

    Returns one row per distinct ``(*keys, at)`` of ``queries`` with an array of ``payload`` structs.
    Points of one moment are ordered by ``tie``. Only the last ``k`` points of a moment can ever be
    needed, so moments are cut to ``k`` points before anything is shuffled by time (the row_number
    filter runs map-side first); distinct moments are then sorted once for all queries.
    """
    if not keys:
        points, queries = (t.withColumn("_all", F.lit(0)) for t in (points, queries))
        return last_before(points, queries, ["_all"], at, payload, k, tie, name).drop("_all")
    newest = Window.partitionBy(*keys, at).orderBy(*[F.col(t).desc() for t in (*tie, *payload)])
    entry = F.struct(*tie, *payload)
    moments = (
        points.select(*dict.fromkeys([*keys, at, *tie, *payload]))
        .withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= k)
        .groupBy(*keys, at).agg(F.sort_array(F.collect_list(entry)).alias("_items"))
    )
    item_type = moments.schema["_items"].dataType
    merged = (
        moments.select("*", F.lit(0).alias("_asked"))
        .unionByName(queries.select(*keys, at, F.lit(None).cast(item_type).alias("_items"), F.lit(1).alias("_asked")))
        .groupBy(*keys, at).agg(F.max("_items").alias("_items"), F.max("_asked").alias("_asked"))
    )
    placed = range_sorted(merged, *keys, at)

    # inside a partition: the k filled moments before this one. Filled moments sit at even numbers and empty
    # ones (queries only) at odd numbers, so one range frame serves both.
    filled = F.count("_items").over(_in_part(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    slot = F.when(F.col("_items").isNotNull(), filled * 2).otherwise(filled * 2 + 1)
    frame = Window.partitionBy(PART, *keys).orderBy("_slot").rangeBetween(-2 * k, -1)
    local = placed.withColumn("_slot", slot).withColumn("_local", F.flatten(F.collect_list("_items").over(frame)))

    # across partitions: the tail of the key that continues into the next partition, one row per partition
    linked = _ends(placed, keys).where("_goes_on").select(PART, "_next_part", *keys)
    latest = Window.partitionBy(PART, *keys).orderBy(F.col(at).desc())
    tails = (
        placed.where("_items is not null").join(F.broadcast(linked), [PART, *keys])
        .withColumn("_rank", F.row_number().over(latest)).where(F.col("_rank") <= k)
        .groupBy(PART, *keys)
        .agg(F.sort_array(F.collect_list(F.struct(at, "_items"))).alias("_t"))
        .select(PART, *keys, _last(F.flatten(F.col("_t._items")), k).alias("_tail"))
    )
    recent_tails = F.collect_list("_tail").over(_over_parts(keys).rowsBetween(-(k - 1), 0))
    joined = tails.select(PART, *keys, _last(F.flatten(recent_tails), k).alias("_tail"))
    up_to_here = _over_parts(keys).rowsBetween(Window.unboundedPreceding, 0)
    carry = (
        linked.join(joined, [PART, *keys], "left")
        .withColumn("_carry", F.last("_tail", ignorenulls=True).over(up_to_here))
        .select(F.col("_next_part").alias(PART), *keys, "_carry")
    )
    empty = F.array().cast(item_type)
    combined = _last(F.concat(F.coalesce("_carry", empty), F.coalesce("_local", empty)), k)
    out = _attach(local.where("_asked = 1"), carry, keys)
    return out.select(*keys, at, combined.alias(name))


def last_items(item: str, keys: Sequence[str], slot: str, k: int) -> Column:
    """The ``k`` items before a row. Rows with an item sit at even numbers of ``slot`` and others at odd ones (see ``slots``)."""
    return F.collect_list(item).over(Window.partitionBy(*keys).orderBy(slot).rangeBetween(-2 * k, -1))


def slots(items: Column, is_item: Column) -> Column:
    """Twice the number of items so far, one more for rows that are none: a range of slots is a number of items."""
    return items * 2 + F.when(is_item, 0).otherwise(1)


def with_last_before(
    points: DataFrame, queries: DataFrame, keys: Sequence[str], at: str, payload: Sequence[str], k: int,
    tie: Sequence[str] = (), name: str = "recent",
) -> DataFrame:
    """Every row of ``queries`` with what ``last_before`` finds for its key and moment; null where one of them is null.

    Points and queries are sorted together, queries before the points of their moment: one shuffle by key, in which the
    query's other columns travel along. Only busy keys are looked up apart and joined back.
    """
    busy = busy_keys(keys, points, queries)
    item = F.struct(*tie, *payload)
    others = [c for c in queries.columns if c not in (*keys, at)]
    marks = points.select(*keys, at, F.lit(1).alias("_kind"), item.alias("_item"))
    asks = queries.select(*keys, at, F.lit(0).alias("_kind"), (F.struct(*others) if others else F.lit(0)).alias("_row"))
    both = marks.unionByName(asks, allowMissingColumns=True)
    window = so_far(keys, [at, "_kind", "_item"])
    rows = both if busy is None else both.where(~busy)
    if k == 1:
        hit = F.last("_item", ignorenulls=True).over(window)
        found = rows.withColumn("_hit", hit).withColumn("_found", F.filter(F.array("_hit"), lambda x: x.isNotNull()))
    else:
        numbered = rows.withColumn("_slot", slots(F.count("_item").over(window), F.col("_kind") == 1))
        found = numbered.withColumn("_found", last_items("_item", keys, "_slot", k))
    known = reduce(and_, [F.col(c).isNotNull() for c in (*keys, at)])
    own = [F.col(f"_row.{c}").alias(c) if c in others else F.col(c) for c in queries.columns]
    near = found.where("_kind = 0").select(*own, F.when(known, F.col("_found")).alias(name))
    if busy is None:
        return near
    apart = queries.where(busy)
    far = apart.join(last_before(points.where(busy), apart, keys, at, payload, k, tie, name), [*keys, at], "left")
    return near.unionByName(far)


def last_at_or_before(
    points: DataFrame, queries: DataFrame, keys: Sequence[str], at: str, payload: Sequence[str]
) -> DataFrame:
    """``queries`` with the payload of the last point of the key whose ``at`` is not after the query's."""
    found = F.struct(*payload)
    slots = [c for c in queries.columns if c not in (*keys, at)]
    row = F.struct(*slots) if slots else F.lit(0)
    marks = points.select(*keys, at, F.lit(0).alias("_kind"), found.alias("_point"))
    asks = queries.select(*keys, at, F.lit(1).alias("_kind"), row.alias("_row"))
    both = marks.unionByName(asks, allowMissingColumns=True)
    take = lambda hit: [*keys, at, *[F.col(f"_row.{c}").alias(c) for c in slots], *[F.col(f"{hit}.{c}").alias(c) for c in payload]]
    if not keys:
        return _placed_at_or_before(both, keys, at).select(take("_hit"))
    busy = busy_keys(keys, both)
    latest = F.last("_point", ignorenulls=True).over(so_far(keys, [at, "_kind"]))
    near = (both if busy is None else both.where(~busy)).withColumn("_hit", latest).where("_kind = 1").select(take("_hit"))
    return near if busy is None else near.unionByName(_placed_at_or_before(both.where(busy), keys, at).select(take("_hit")))


def _placed_at_or_before(both: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    placed = range_sorted(both, *keys, at, "_kind")
    latest = F.max_by("_point", F.when(F.col("_kind") == 0, F.col(POS))).alias("_tail")
    if keys:
        # only the last key of a partition can go on in the next one
        ends = _ends(placed, keys).where("_goes_on").select(PART, *keys, "_next_part")
        tails = placed.join(F.broadcast(ends), [PART, *keys]).groupBy(PART, *keys, "_next_part").agg(latest)
        earlier = _over_parts(keys).rowsBetween(Window.unboundedPreceding, 0)
        carry = tails.select(
            F.col("_next_part").alias(PART), *keys, F.last("_tail", ignorenulls=True).over(earlier).alias("_carry"))
    else:
        before = _over_parts([]).rowsBetween(Window.unboundedPreceding, -1)
        carry = placed.groupBy(PART).agg(latest).select(PART, F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    carry = carry.where("_carry is not null")
    local = F.last("_point", ignorenulls=True).over(
        _in_part(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = _attach(placed.withColumn("_point", local).where("_kind = 1"), carry, keys)
    return out.withColumn("_hit", F.coalesce("_point", "_carry"))
