"""Edge memories: which (u, i) pairs count as known, and scores from membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.plans.ordered import last_at_or_before, next_row, quantiles, row_numbers, running_totals
from edgetide.session import stored


def edge_memory_unlimited(history: DataFrame) -> DataFrame:
    return history.select("u", "i").distinct()


def edge_memory_time_window(history: DataFrame, proportion: float, ts: str = "ts_us") -> DataFrame:
    """Pairs seen at or after the (1 - proportion) quantile of history time."""
    start = quantiles(history, ts, {"start": 1 - proportion}).scalar()
    return history.where(F.col(ts) >= start).select("u", "i").distinct()


def edge_memory_repeat_interval(history: DataFrame, ts: str = "ts_us") -> DataFrame:
    """Pairs seen within one mean repeat gap of the end.

    The mean gap of a pair telescopes to (last - first) / (n - 1); the window sums it over repeated pairs
    and divides by the number of all distinct pairs.
    """
    pairs = history.groupBy("u", "i").agg(
        F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")
    )
    gap = F.when(F.col("n") > 1, (F.col("last") - F.col("first")) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    start = pairs.agg(F.max("last") - F.sum(gap) / F.count("*")).scalar()
    # a pair lies in the window exactly when its last sighting does
    return pairs.where(F.col("last") >= start).select("u", "i")


def edge_memory_repeat_threshold(history: DataFrame) -> DataFrame:
    """Pairs seen at least as often as the mean pair."""
    pairs = history.groupBy("u", "i").agg(F.count("*").alias("n"))
    return pairs.where(F.col("n") >= pairs.agg(F.avg("n")).scalar()).select("u", "i")


MEMORIES = {
    "unlimited_memory": lambda h, p: edge_memory_unlimited(h),
    "time_window_fixed_proportion": edge_memory_time_window,
    "time_window_repeat_interval": lambda h, p: edge_memory_repeat_interval(h),
    "repeat_threshold_memory": lambda h, p: edge_memory_repeat_threshold(h),
}


def edge_membership(edges: DataFrame, memory: DataFrame) -> DataFrame:
    """``score`` 1 for pairs in memory, else 0."""
    known = memory.select("u", "i").distinct().withColumn("_known", F.lit(1.0))
    return edges.join(known, ["u", "i"], "left").withColumn("score", F.coalesce("_known", F.lit(0.0))).drop("_known")


def edgebank_scores(
    history: DataFrame, positives: DataFrame, negatives: DataFrame, mode: str = "unlimited_memory",
    proportion: float = 0.15,
) -> DataFrame:
    """Positives (label 1) and negatives (label 0) scored by one memory of ``history``."""
    both = positives.withColumn("label", F.lit(1)).unionByName(negatives.withColumn("label", F.lit(0)))
    return edge_membership(both, MEMORIES[mode](history, proportion))


def _unlimited_batched(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    first = edges.groupBy("u", "i").agg(F.min("batch").alias("_first"))
    known = F.coalesce((F.col("_first") < F.col("batch")).cast("double"), F.lit(0.0))
    return candidates.join(first, ["u", "i"], "left").withColumn("score", known).drop("_first")


def pair_changes(edges: DataFrame) -> DataFrame:
    """One row per pair and batch that holds it: what is known of the pair once the batch is over, and what was before.

    ``seen`` sightings up to ``last``, and ``gap``, the mean time between them (0 for one); ``was_seen`` and ``was_gap``
    are null and 0 in the pair's first batch.
    """
    counted = edges.groupBy("u", "i", "batch").agg(
        F.count("*").alias("n"), F.min("ts_us").alias("_first"), F.max("ts_us").alias("last"))
    origin = edges.groupBy("u", "i").agg(F.min("ts_us").alias("_origin"))
    held = running_totals(counted, ["u", "i"], ["batch"], {"seen": F.col("n")}).join(origin, ["u", "i"])
    gap = F.when(F.col("seen") > 1, (F.col("last") - F.col("_origin")) / (F.col("seen") - 1)).otherwise(F.lit(0.0))
    held = held.select("u", "i", "batch", "n", "_first", "last", "seen", gap.alias("gap"))
    # in falling order of batches the row after a row is the change before it
    both = next_row(held, ["u", "i"], [F.col("batch").desc()], {"was_seen": "seen", "was_gap": "gap"})
    return both.withColumn("was_gap", F.coalesce("was_gap", F.lit(0.0)))


def batch_bounds(edges: DataFrame, changes: DataFrame, mode: str, proportion: float) -> DataFrame:
    """(at, bound): from batch ``at`` on, until a later row, the memory keeps pairs that reach ``bound``.

    A history is the prefix of all batches before one, so its pairs, sightings and gaps are running sums of what each batch
    changed, and its time quantile stands at a known place of the one global order of times. That needs batches in
    time order: a batch that begins before the end of an earlier one is an error.
    """
    per_batch = changes.groupBy("batch").agg(
        F.sum("n").alias("_n"), F.count_if(F.col("was_seen").isNull()).alias("_new"),
        F.sum(F.col("gap") - F.col("was_gap")).alias("_gap"), F.min("_first").alias("_first"), F.max("last").alias("_newest"))
    facts = running_totals(per_batch, [], ["batch"], {"edges": F.col("_n"), "pairs": F.col("_new"), "gaps": F.col("_gap")})
    facts = next_row(facts, [], ["batch"], {"_next_first": "_first"}).withColumn("at", F.col("batch") + 1)
    if mode == "repeat_threshold_memory":
        return facts.select("at", (F.col("edges") / F.col("pairs")).alias("bound"))
    disorder = F.raise_error(F.lit("batches must follow each other in time"))
    newest = F.when(F.col("_next_first") < F.col("_newest"), disorder.cast("long")).otherwise(F.col("_newest"))
    if mode == "time_window_repeat_interval":
        return facts.select("at", (newest - F.col("gaps") / F.col("pairs")).alias("bound"))
    spot = F.lit(1.0 - proportion) * (F.col("edges") - 1)
    places = facts.where(newest.isNotNull()).select(
        "at", (spot - F.floor(spot)).alias("_w"), F.explode(F.array_distinct(F.array(F.floor(spot), F.ceil(spot)))).alias("_rank"))
    ranked = row_numbers(edges.select(F.col("ts_us").alias("_ts")), ["_ts"], "_rank", start=0)
    low, high = F.min("_ts"), F.max("_ts")
    return places.join(ranked, "_rank").groupBy("at").agg((low + (high - low) * F.max("_w")).alias("bound"))


def edgebank_batched(
    edges: DataFrame, candidates: DataFrame, mode: str = "unlimited_memory", proportion: float = 0.15
) -> DataFrame:
    """A memory that grows with every finished batch, for all batches at once.

    ``edges``: all edges with ``batch`` (below 0 for rows before the test period), for the window modes in time order.
    ``candidates``: rows with u, i, batch, label. A candidate of batch b is scored 1 if the memory of ``mode`` over all
    edges of earlier batches holds its pair, else 0; before the first edge nothing is known.
    """
    if mode not in MEMORIES:
        raise ValueError(f"unknown memory {mode}")
    if mode == "unlimited_memory":
        return _unlimited_batched(edges, candidates)
    changes = stored(pair_changes(edges))
    bounds = batch_bounds(edges, changes, mode, proportion)
    asked = candidates.select(F.col("batch").alias("at")).distinct()
    current = last_at_or_before(bounds, asked, [], "at", ["bound"]).select(F.col("at").alias("batch"), F.col("bound").alias("_bound"))
    # a change is visible from the batch after its own
    marks = changes.select("u", "i", (F.col("batch") + 1).alias("_at"), F.col("seen").alias("_seen"), F.col("last").alias("_last"))
    states = last_at_or_before(marks, candidates.withColumn("_at", F.col("batch")), ["u", "i"], "_at", ["_seen", "_last"])
    reached = F.col("_seen" if mode == "repeat_threshold_memory" else "_last") >= F.col("_bound")
    scored = states.join(current, "batch", "left").withColumn("score", F.coalesce(reached.cast("double"), F.lit(0.0)))
    return scored.select(*candidates.columns, "score")


def node_popularity(history: DataFrame, until: int) -> DataFrame:
    """Degree share of sources and destinations among edges up to ``until``."""
    seen = history.where(F.col("ts_us") <= until)
    side = F.explode(F.array(
        F.struct(F.lit("src").alias("side"), F.col("u").alias("node")),
        F.struct(F.lit("dst").alias("side"), F.col("i").alias("node")),
    ))
    counts = seen.select(side.alias("_s")).select("_s.*").groupBy("side", "node").agg(F.count("*").alias("degree"))
    total = seen.agg(F.count("*")).scalar()
    return counts.withColumn("share", F.col("degree") / total)
