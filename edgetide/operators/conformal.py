"""Conformal thresholds on errors 1 - score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgetide.plans.ordered import last_at_or_before, last_before, next_row, running_totals
from edgetide.schema import BATCH
from edgetide.session import stored


def _errors(scored: DataFrame) -> DataFrame:
    return scored.select("*", (F.lit(1.0) - F.col("score")).alias("_error"))


def _level(n: Column, alpha: float) -> Column:
    return F.floor(F.lit(1.0 - alpha) * (n + 1))


def conformal_threshold(calibration: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The q/n quantile of the errors, q = int((1 - alpha)(n + 1)); above the largest error when q >= n."""
    counted = _errors(calibration).groupBy("_error").agg(F.count("*").alias("_c"))
    ranked = running_totals(counted, [], ["_error"], {"_cum": F.col("_c")})
    n = ranked.agg(F.max("_cum")).scalar()
    level = _level(F.col("_n"), alpha)
    spot = level / F.col("_n") * (F.col("_n") - 1)
    lo, hi = F.floor(spot), F.ceil(spot)
    return ranked.withColumn("_n", n).agg(
        F.min(F.when(F.col("_cum") > lo, F.col("_error"))).alias("lo"),
        F.min(F.when(F.col("_cum") > hi, F.col("_error"))).alias("hi"),
        F.max("_error").alias("top"), F.max(spot - lo).alias("w"), F.max((level >= F.col("_n")).cast("int")).alias("over"),
    ).select(
        F.when(F.col("over") == 1, F.col("top") + F.lit(1e-6))
        .otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w")).alias("threshold")
    )


def conformal_threshold_weighted(calibration: DataFrame, alpha: float = 0.05, decay: float = 0.001) -> DataFrame:
    """Smallest error whose share of recency weight exp(-decay * age in seconds) reaches q/n; the largest
    error when no share does."""
    newest = calibration.agg(F.max("ts_us")).scalar()
    age = (F.col("_newest") - F.col("ts_us")) / F.lit(1e6)
    weighted = _errors(calibration.withColumn("_newest", newest)).groupBy("_error").agg(
        F.sum(F.exp(-F.lit(decay) * age)).alias("_w"), F.count("*").alias("_c")
    )
    ranked = running_totals(weighted, [], ["_error"], {"_cum": F.col("_w")})
    facts = ranked.agg(F.struct(F.sum("_w").alias("w"), F.sum("_c").alias("n"))).scalar()
    goal = _level(F.col("_f.n"), alpha) / F.col("_f.n")
    reached = F.col("_cum") / F.col("_f.w") >= goal
    return ranked.withColumn("_f", facts).agg(
        F.coalesce(F.min(F.when(reached, F.col("_error"))), F.max("_error")).alias("threshold")
    )


def miscovered(score: str, threshold) -> Column:
    return (F.lit(1.0) - F.col(score) > threshold).cast("int")


def miscoverage(scored: DataFrame, threshold) -> DataFrame:
    """Share of rows whose error exceeds the threshold; ``threshold`` is a number or a one-cell table."""
    limit = threshold.scalar() if isinstance(threshold, DataFrame) else F.lit(threshold)
    return scored.withColumn("_t", limit).agg(F.avg(miscovered("score", F.col("_t")).cast("double")).alias("miscoverage"))


class AdaptiveLevel:
    """The miscoverage level that moves with every full batch.

    A threshold at level a is the calibration quantile at rank ``position(a, n)`` of n errors; None stands for a threshold
    just above the largest calibration error.
    """

    def __init__(self, alpha: float, rate: float = 0.005, batch: int = BATCH):
        self.alpha, self.rate, self.batch = alpha, rate, batch

    @staticmethod
    def position(level: float, n: int) -> float | None:
        q = max(int((1 - level) * (n + 1)), 0)
        return None if q >= n else q / n * (n - 1)

    def follow(self, level: float, missed: float) -> float:
        if missed > self.alpha:
            return level + self.rate * (level - missed)
        return level + self.rate * level


JUST_ABOVE = 1e-6  # of the largest error


def rank_ladder(calibration: DataFrame) -> DataFrame:
    """The calibration errors as a stored table: each distinct error, the next larger one (null for the largest), the ranks
    (from 0) of its first and last occurrence, and on every row the number of errors and the largest."""
    counted = _errors(calibration).groupBy("_error").agg(F.count("*").alias("_c"))
    ranked = running_totals(counted, [], ["_error"], {"_cum": F.col("_c")})
    ranked = next_row(ranked, [], ["_error"], {"_next": "_error"})
    ladder = stored(ranked.select(
        "_error", "_next", (F.col("_cum") - F.col("_c")).alias("_low"), (F.col("_cum") - 1).alias("_high")))
    facts = ladder.agg(F.struct((F.max("_high") + 1).alias("n"), F.max("_error").alias("top"))).scalar()
    return ladder.withColumn("_f", facts).select("_error", "_next", "_low", "_high", F.col("_f.n").alias("_n"), F.col("_f.top").alias("_top"))


def ranked_errors(rows: DataFrame, ladder: DataFrame) -> DataFrame:
    """``rows`` (with the error ``at``) plus ``rank``, the error's fractional rank among the calibration errors, and the
    ladder's ``_n`` and ``_top``. An error exceeds the threshold at rank p exactly when its own rank exceeds p."""
    # equal errors must not see themselves, so a calibration error becomes visible just after its value
    marks = ladder.select(F.col("_error").alias("at"), F.col("_error").alias("below"), "_next", "_high")
    placed = last_before(marks, rows.select("at"), [], "at", ["below", "_next", "_high"], 1)
    hit = F.get("recent", F.lit(0))
    step = F.try_divide(F.col("at") - hit["below"], hit["_next"] - hit["below"])
    own = F.when(hit.isNull(), F.lit(0.0)).when(hit["_next"].isNull(), F.lit(float("inf"))).otherwise(hit["_high"] + step)
    facts = ladder.agg(F.struct(F.max("_n").alias("n"), F.max("_top").alias("top"))).scalar()
    ranked = rows.join(placed.select("at", own.alias("rank")), "at").withColumn("_f", facts)
    return ranked.withColumns({"_n": F.col("_f.n"), "_top": F.col("_f.top")}).drop("_f")


def batch_summaries(ranked: DataFrame, rate: float) -> DataFrame:
    """One row per (stream, batch) with all the recurrence needs of it.

    ``ranked`` has ``stream``, ``batch`` (numbered from 0 in this run), ``at``, ``rank``, ``_n``, ``_top`` and the stream's first ``level``.
    After k batches the level lies between 1 + (level - 1)(1 + rate)^k, where every error was missed, and level (1 + rate)^k, where
    none was. Ranks above the positions of that range are missed for sure and only counted, ranks below it never; the
    row keeps those in between, at most a batch of them.
    """
    grown = F.least(F.pow(F.lit(1.0 + rate), F.col("batch")), F.lit(1e300))
    place = lambda level: (F.lit(1.0) - level) * (F.col("_n") + 1) * (F.col("_n") - 1) / F.col("_n")
    highest = place(F.lit(1.0) + (F.col("level") - 1.0) * grown) + 2.0  # two ranks of slack for rounding
    lowest = place(F.col("level") * grown) - 2.0
    open_rank = F.when((F.col("rank") >= lowest) & (F.col("rank") <= highest), F.col("rank"))
    return ranked.groupBy("stream", "batch").agg(
        F.count("*").alias("size"), F.count_if(F.col("rank") > highest).alias("above"),
        F.count_if(F.col("at") > F.col("_top") + JUST_ABOVE).alias("beyond"), F.collect_list(open_rank).alias("ranks"),
        F.first("_n").alias("_n"), F.first("_top").alias("_top"), F.first("level").alias("first_level"),
        F.first("seen").alias("first_seen"), F.first("missed").alias("first_missed"))


LEVELS = ("stream string, batch long, level double, position double, missed long, size long, next_level double, next_seen long, "
          "next_missed long")


def chain_levels(summaries: DataFrame, rule: AdaptiveLevel) -> DataFrame:
    """The level of every batch, each stream's batches in order. A stream is one chain by definition: what is chained is one
    row per batch, read as it comes."""

    def chain(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, level, seen, missed = None, 0.0, 0, 0
        for chunk in chunks:
            out = []
            for row in chunk.itertuples(index=False):
                if row.stream != current:
                    current, level, seen, missed = row.stream, row.first_level, row.first_seen, row.first_missed
                at, spot = level, rule.position(level, row.n)
                lost = int(row.beyond) if spot is None else int(row.above) + int((np.asarray(row.ranks) > spot).sum())
                seen, missed = seen + row.size, missed + lost
                if seen == rule.batch:
                    level, seen, missed = rule.follow(level, missed / seen), 0, 0
                out.append((row.stream, row.batch, at, spot, lost, row.size, level, seen, missed))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LEVELS.split(", ")]).astype({"position": "float64"})

    # the window makes Spark keep a stream's batches together and in order; a bare repartition may be planned away
    in_order = Window.partitionBy("stream").orderBy("batch")
    ordered = summaries.withColumnRenamed("_n", "n").withColumn("place", F.row_number().over(in_order))
    return ordered.mapInPandas(chain, LEVELS).withColumn("position", F.nanvl("position", F.lit(None).cast("double")))


def thresholds(levels: DataFrame, ladder: DataFrame) -> DataFrame:
    """``levels`` plus ``threshold``, the calibration error at ``position``."""
    top = ladder.agg(F.max("_top")).scalar()
    asked = levels.withColumn("at", F.floor(F.coalesce("position", F.lit(0.0))))
    found = last_at_or_before(ladder.select(F.col("_low").alias("at"), "_error", "_next", "_high"), asked, [], "at", ["_error", "_next", "_high"])
    # between the last copy of an error and the next error the quantile is a straight line
    over = F.greatest(F.col("position") - F.col("_high"), F.lit(0.0))
    value = F.col("_error") + over * (F.coalesce("_next", "_error") - F.col("_error"))
    above = F.col("_above") + F.lit(JUST_ABOVE)
    return found.withColumn("_above", top).withColumn("threshold", F.when(F.col("position").isNull(), above).otherwise(value)).drop(
        "at", "_error", "_next", "_high", "_above")


def adaptive_conformal(
    test: DataFrame, calibration: DataFrame, alpha: float = 0.05, rate: float = 0.005, batch: int = BATCH,
    key: str | None = None,
) -> DataFrame:
    """Per batch of ``test`` (dense ``idx`` from 1 inside each stream ``key``): level, threshold, miscoverage.

    The level of a batch depends on the batch before it, so each stream is a chain, but the chain needs no
    calibration errors: every test error is first given its fractional rank among them (by joins), batches are reduced to the
    ranks the level can still reach, and thresholds are looked up afterwards. Give each host its own ``key``: streams
    are independent chains, and without a key all batches are one.
    """
    ladder = rank_ladder(calibration)
    number = ((F.col("idx") - 1 - F.pmod(F.col("idx") - 1, F.lit(batch))) / F.lit(batch)).cast("long")
    stream = F.col(key).cast("string") if key else F.lit("all")
    rows = _errors(test).select(stream.alias("stream"), number.alias("batch"), F.col("_error").alias("at"))
    start = {"level": F.lit(alpha), "seen": F.lit(0).cast("long"), "missed": F.lit(0).cast("long")}
    ranked = ranked_errors(rows, ladder).withColumns(start)
    levels = chain_levels(batch_summaries(ranked, rate), AdaptiveLevel(alpha, rate, batch))
    found = thresholds(levels.select("stream", "batch", "level", "position", "missed", "size"), ladder)
    return found.select("stream", "batch", "level", "threshold", (F.col("missed") / F.col("size")).alias("miscoverage"), F.col("size").alias("n"))


def adaptive_alerts(
    events: DataFrame, ladder: DataFrame, states: DataFrame | None, alpha: float = 0.05, rate: float = 0.005, batch: int = BATCH
) -> tuple[DataFrame, DataFrame]:
    """One step of endless streams: the alerts of ``events`` (stream, idx, score) and the streams' states after them.

    ``states`` (stream, level, seen, missed) are what the step before returned, None at first. Events of a stream follow
    each other by ``idx``; a batch that is not full at the end of a step goes on in the next one.
    """
    at_first = {"level": F.lit(alpha), "seen": F.lit(0).cast("long"), "missed": F.lit(0).cast("long")}
    rows = _errors(events).select(F.col("stream").cast("string").alias("stream"), "idx", F.col("_error").alias("at"))
    numbered = running_totals(rows, ["stream"], ["idx"], {"_place": F.lit(1).cast("long")})
    if states is None:
        started = numbered.withColumns(at_first)
    else:
        known = numbered.join(states, "stream", "left")
        started = known.withColumns({name: F.coalesce(name, first) for name, first in at_first.items()})
    placed = started.withColumn("batch", F.floor((F.col("seen") + F.col("_place") - 1) / batch))
    ranked = stored(ranked_errors(placed, ladder))
    levels = stored(chain_levels(batch_summaries(ranked, rate), AdaptiveLevel(alpha, rate, batch)))
    limits = thresholds(levels.select("stream", "batch", "level", "position"), ladder)
    joined = ranked.drop("level").join(limits, ["stream", "batch"])
    alert = F.when(F.col("position").isNull(), F.col("at") > F.col("_top") + JUST_ABOVE).otherwise(F.col("rank") > F.col("position"))
    alerts = joined.select("stream", "idx", "level", "threshold", alert.cast("int").alias("alert"))
    last = levels.groupBy("stream").agg(F.max_by(F.struct("next_level", "next_seen", "next_missed"), "batch").alias("s"))
    after = last.select("stream", F.col("s.next_level").alias("level"), F.col("s.next_seen").alias("seen"), F.col("s.next_missed").alias("missed"))
    if states is not None:
        after = after.unionByName(states.join(after.select("stream"), "stream", "left_anti").select("stream", "level", "seen", "missed"))
    return alerts, after
