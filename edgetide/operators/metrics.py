"""Exact ranking and classification metrics.

Scores are first folded to one row per distinct score with its positives and negatives; ranks are running
totals over those rows. Every function takes ``by``, so one pass serves batches, sources or hosts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgetide.plans.ordered import next_row, running_totals


def squash_scores(scored: DataFrame, score: str = "score") -> DataFrame:
    """Min-max to [0, 1], only when some score lies outside."""
    limits = scored.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi"))).scalar()
    lo, hi = F.col("_lim.lo"), F.col("_lim.hi")
    squashed = F.when((lo < 0) | (hi > 1), F.try_divide(F.col(score) - lo, hi - lo)).otherwise(F.col(score))
    return scored.withColumn("_lim", limits).withColumn(score, squashed).drop("_lim")


def _folded(scored: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    return scored.groupBy(*by, score).agg(
        F.sum(F.col(label).cast("long")).alias("_p"), F.sum((1 - F.col(label)).cast("long")).alias("_n")
    )


def ranked_scores(scored: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Per distinct score, highest first: ``_p/_n`` at the score, ``tp/fp`` at or above it, totals ``P/N``."""
    folded = _folded(scored, by, score, label)
    ranked = running_totals(folded, list(by), [F.col(score).desc()], {"tp": F.col("_p"), "fp": F.col("_n")})
    totals = folded.groupBy(*by).agg(F.sum("_p").alias("P"), F.sum("_n").alias("N"))
    if by:
        return ranked.join(totals, list(by))
    return ranked.withColumn("_t", totals.select(F.struct("P", "N")).scalar()).select(
        "*", F.col("_t.P").alias("P"), F.col("_t.N").alias("N")
    ).drop("_t")


def roc_auc(scored: DataFrame, by: Sequence[str] = (), **columns: str) -> DataFrame:
    """Area under the ROC curve, ties counting half; null when one class is missing."""
    ranked = ranked_scores(scored, by, **columns)
    # positives strictly above, plus half of those level, per negative
    wins = F.sum(F.col("_n").cast("double") * (F.col("tp") - F.col("_p") / F.lit(2.0)))
    pairs = F.max(F.col("P").cast("double") * F.col("N"))
    return ranked.groupBy(*by).agg(F.try_divide(wins, pairs).alias("auc"))


def average_precision(scored: DataFrame, by: Sequence[str] = (), **columns: str) -> DataFrame:
    """Sum over distinct scores of recall gained times precision; null without positives."""
    ranked = ranked_scores(scored, by, **columns)
    gained = F.sum(F.col("_p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return ranked.groupBy(*by).agg(F.try_divide(gained, F.max("P")).alias("ap"))


def ranking_summary(scored: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """AUC, average precision and the best F1 of the ROC sweep with its threshold, in one pass over the ranks."""
    ranked = ranked_scores(scored, by, score, label)
    wins = F.sum(F.col("_n").cast("double") * (F.col("tp") - F.col("_p") / F.lit(2.0)))
    gained = F.sum(F.col("_p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    f1 = F.lit(2.0) * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("P"))
    best = F.max(F.struct(f1.alias("f1"), F.col(score).alias("at")))
    return ranked.groupBy(*by).agg(
        F.max("P").alias("positives"), F.max("N").alias("negatives"),
        F.try_divide(wins, F.max(F.col("P").cast("double") * F.col("N"))).alias("auc"),
        F.try_divide(gained, F.max("P")).alias("ap"), best["f1"].alias("best_f1"), best["at"].alias("best_threshold"),
    )


def roc_curve(scored: DataFrame, score: str = "score", label: str = "label", drop_intermediate: bool = True) -> DataFrame:
    """(fpr, tpr, threshold) from the highest score down, opened by (0, 0, infinity).

    ``drop_intermediate`` leaves out points on a straight line between their neighbours, as the usual
    library does; the point of the highest score always stays.
    """
    ranked = ranked_scores(scored, (), score, label).withColumn("threshold", F.col(score).cast("double"))
    if drop_intermediate:
        ahead = next_row(ranked, [], [F.col("threshold").desc()], {"_p2": "_p", "_n2": "_n"})
        ranked = ahead.where("_p2 is null or _p2 <> _p or _n2 <> _n or (tp = _p and fp = _n)")
    points = ranked.select(
        F.try_divide("fp", "N").alias("fpr"), F.try_divide("tp", "P").alias("tpr"), "threshold"
    )
    opening = scored.sparkSession.range(1).select(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold")
    )
    return opening.unionByName(points)


def pr_curve(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(precision, recall, threshold) per distinct score, closed by (1, 0, null)."""
    points = ranked_scores(scored, (), score, label).select(
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "P").alias("recall"),
        F.col(score).cast("double").alias("threshold"),
    )
    closing = scored.sparkSession.range(1).select(
        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(None).cast("double").alias("threshold")
    )
    return points.unionByName(closing)


def best_f1_threshold(scored: DataFrame, form: str = "roc", score: str = "score", label: str = "label") -> DataFrame:
    """Threshold of the highest F1 and that F1. ``roc``: highest threshold among equals. ``pr``: 2pr/(p+r+1e-8),
    lowest threshold among equals."""
    ranked = ranked_scores(scored, (), score, label)
    tp, fp, total = F.col("tp"), F.col("fp"), F.col("P")
    if form == "roc":
        f1, tie = F.lit(2.0) * tp / (tp + fp + total), F.col(score)
    else:
        precision, recall = tp / (tp + fp), F.try_divide(tp, total)
        f1, tie = F.lit(2.0) * (precision * recall) / (precision + recall + F.lit(1e-8)), -F.col(score)
    best = F.max(F.struct(f1.alias("f1"), tie.alias("tie"), F.col(score).cast("double").alias("threshold")))
    return ranked.agg(best.alias("_b")).select(
        F.col("_b.threshold").alias("best_threshold"), F.col("_b.f1").alias("f1")
    )


def predicted(score: str | Column, threshold, inclusive: bool = False) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return (score >= threshold if inclusive else score > threshold).cast("int")


def confusion(predictions: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """tn, fp, fn, tp and accuracy, precision, recall, F1 (0 when undefined)."""
    cell = lambda y, z: F.sum(((F.col(label) == y) & (F.col(prediction) == z)).cast("long"))
    counts = predictions.groupBy(*by).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )
    return counts.select("*", *rates())


def rates() -> list[Column]:
    """Accuracy, precision, recall and F1 of the columns tn, fp, fn, tp; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    share = lambda top, bottom: F.coalesce(F.try_divide(top, bottom), F.lit(0.0))
    return [
        share(tp + tn, tp + tn + fp + fn).alias("accuracy"), share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def sweep_report(scored: DataFrame, form: str = "roc", flag: Column | None = None) -> DataFrame:
    """One row from one ranking of ``scored`` (score, label): AUC, average precision, best F1 with its threshold, and the
    confusion of the rows above that threshold (at or above it for the form ``pr``), or of the rows that ``flag`` marks.

    Rows are folded to distinct scores once; the fold carries the flagged ones along, and the confusion at a threshold is
    a pair of running totals, so nothing is scanned or ranked again.
    """
    one, hit = F.col("label").cast("long"), (F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))).cast("long")
    folded = scored.groupBy("score").agg(
        F.sum(one).alias("_p"), F.sum(1 - one).alias("_n"), F.sum(one * hit).alias("_fp"), F.sum((1 - one) * hit).alias("_fn"))
    ranked = running_totals(folded, [], [F.col("score").desc()], {"tp": F.col("_p"), "fp": F.col("_n")})
    total = ranked.agg(F.max("tp")).scalar()
    tp, fp = F.col("tp"), F.col("fp")
    if form == "roc":  # strictly above the threshold; the highest threshold among equals
        f1, tie, above = F.lit(2.0) * tp / (tp + fp + F.col("P")), F.col("score"), (tp - F.col("_p"), fp - F.col("_n"))
    else:
        precision, recall = tp / (tp + fp), F.try_divide(tp, F.col("P"))
        f1, tie, above = F.lit(2.0) * (precision * recall) / (precision + recall + F.lit(1e-8)), -F.col("score"), (tp, fp)
    best = F.max(F.struct(f1.alias("f1"), tie.alias("tie"), F.col("score").cast("double").alias("at"), above[0].alias("tp"), above[1].alias("fp")))
    wins = F.sum(F.col("_n").cast("double") * (tp - F.col("_p") / F.lit(2.0)))
    found = ranked.withColumn("P", total).agg(
        F.max("tp").alias("positives"), F.max("fp").alias("negatives"), wins.alias("_wins"),
        F.sum(F.col("_p") * tp / (tp + fp)).alias("_gained"), best.alias("_b"), F.sum("_fp").alias("_ftp"), F.sum("_fn").alias("_ffp"))
    p, n = F.col("positives"), F.col("negatives")
    hits, alarms = (F.col("_b.tp"), F.col("_b.fp")) if flag is None else (F.col("_ftp"), F.col("_ffp"))
    cells = found.select(
        "positives", "negatives", F.try_divide("_wins", p.cast("double") * n).alias("auc"), F.try_divide("_gained", p).alias("ap"),
        F.col("_b.f1").alias("best_f1"), F.col("_b.at").alias("best_threshold"),
        (n - alarms).alias("tn"), alarms.alias("fp"), (p - hits).alias("fn"), hits.alias("tp"))
    return cells.select("*", *rates())


def calibration_curve(scored: DataFrame, bins: int = 50, score: str = "score", label: str = "label") -> DataFrame:
    """Mean score and share of positives per right-closed bin; empty bins have no row."""
    slot = F.greatest(F.ceil(F.col(score) * bins) - 1, F.lit(0)).cast("long")
    return scored.groupBy(slot.alias("bin")).agg(
        F.avg(F.col(label).cast("double")).alias("prob_true"), F.avg(score).alias("prob_pred")
    )


def score_histogram(scored: DataFrame, bins: int = 50, score: str = "score", label: str = "label") -> DataFrame:
    """Counts per class and left-closed bin of [0, 1], the last bin closed on both sides."""
    slot = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("long")
    inside = scored.where(F.col(score).between(0, 1))
    return inside.groupBy(slot.alias("bin")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("positives"), F.sum((F.col(label) == 0).cast("long")).alias("negatives")
    )


def batch_metrics(scored: DataFrame, by: Sequence[str] = ("batch",), threshold: float = 0.5) -> DataFrame:
    """Accuracy at the threshold, average precision and AUC per group.

    A batch is small by construction, so its ranks are a plain window; no global sort is needed.
    """
    folded = _folded(scored, by, "score", "label")
    order = Window.partitionBy(*by).orderBy(F.col("score").desc())
    total = Window.partitionBy(*by)
    ranked = folded.select(
        *by, "score", "_p", "_n", F.sum("_p").over(order).alias("tp"), F.sum("_n").over(order).alias("fp"),
        F.sum("_p").over(total).alias("P"), F.sum("_n").over(total).alias("N"),
    )
    wins = F.sum(F.col("_n") * (F.col("tp") - F.col("_p") / F.lit(2.0)))
    right = F.sum(F.when(F.col("score") > threshold, F.col("_p")).otherwise(F.col("_n")))
    return ranked.groupBy(*by).agg(
        (right / F.max(F.col("P") + F.col("N"))).alias("accuracy"),
        F.try_divide(F.sum(F.col("_p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("P")).alias("ap"),
        F.try_divide(wins, F.max(F.col("P") * F.col("N"))).alias("auc"),
    )


def mean_metrics(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    return metrics.agg(*[F.avg(n).alias(n) for n in names])


def run_summary(runs: DataFrame, value: str, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Mean and sample deviation over runs."""
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def log_loss(scored: DataFrame, by: Sequence[str] = ("batch",)) -> DataFrame:
    """Mean binary cross-entropy, each log term floored at -100."""
    floor = lambda x: F.when(x > 0, F.greatest(F.log(x), F.lit(-100.0))).otherwise(F.lit(-100.0))
    p, y = F.col("score"), F.col("label")
    return scored.groupBy(*by).agg(F.avg(-(y * floor(p) + (1 - y) * floor(1 - p))).alias("loss"))


def smooth_series(series: DataFrame, value: str, order: str, width: int) -> DataFrame:
    """Centred running median over at most ``width`` rows (shorter at both ends).

    Positions are numbered and cut into shares; a share also receives ``width // 2`` rows of its neighbours,
    so windows are complete inside it and no task holds the series.
    """
    half, share = width // 2, max(8 * width, 4096)
    spots = running_totals(series, [], [order], {"_spot": F.lit(1)})
    own = F.floor(F.col("_spot") / share)
    reached = F.array_distinct(F.array(
        F.floor((F.col("_spot") - half) / share), own, F.floor((F.col("_spot") + half) / share)
    ))
    spread = spots.withColumn("_own", own).withColumn("_share", F.explode(reached))
    around = Window.partitionBy("_share").orderBy("_spot").rowsBetween(-half, half)
    near = F.sort_array(F.collect_list(value).over(around))  # at most ``width`` values
    middle = lambda up: F.get("_near", F.floor((F.size("_near") - 1 + up) / 2).cast("int"))
    smoothed = spread.withColumn("_near", near).withColumn("smoothed", (middle(0) + middle(1)) / 2)
    return smoothed.where("_own = _share").select(order, value, "smoothed")


def bucket_score_histogram(buckets: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Per class counts over e = min(200, max(50, 2n)) equally spaced edges from lowest to highest score."""
    facts = buckets.agg(F.struct(
        F.min(score).alias("lo"), F.max(score).alias("hi"),
        (F.least(F.lit(200), F.greatest(F.lit(50), 2 * F.count("*"))) - 1).alias("bins"),
    )).scalar()
    lo, hi, bins = F.col("_f.lo"), F.col("_f.hi"), F.col("_f.bins")
    place = F.coalesce(F.try_divide((F.col(score) - lo) * bins, hi - lo), F.lit(0.0))
    slot = F.least(F.floor(place), bins - 1)
    return buckets.withColumn("_f", facts).groupBy(slot.cast("long").alias("bin")).agg(
        F.sum((F.col(label) == 0).cast("long")).alias("benign"), F.sum((F.col(label) == 1).cast("long")).alias("anomalous")
    )


