"""Scored links to reports: labels, bucket scores, anomaly metrics per edge and per window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.functions.times import epoch_bucket
from edgetide.operators.metrics import confusion, predicted, ranking_summary, squash_scores, sweep_report
from edgetide.operators.splits import positives_union_negatives
from edgetide.plans.ordered import last_at_or_before, running_totals
from edgetide.schema import WINDOW_SECONDS

LINK = ["src", "dst", "ts_us"]


def join_scores_labels(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Truth rows with the last score of their (src, dst, ts); ``anomaly`` is 1 - score. Unscored truth goes."""
    last = scores.groupBy(*LINK).agg(F.max_by("score", "idx").alias("score"))
    return truth.join(last, LINK).withColumn("anomaly", F.lit(1.0) - F.col("score"))


def link_score_stats(joined: DataFrame, negatives: DataFrame) -> DataFrame:
    """Count, mean and population deviation of scores of benign, anomalous and non-existing links."""
    kind = F.when(F.col("label") == 0, "benign").otherwise("anomaly")
    rows = joined.select(kind.alias("kind"), "score").unionByName(negatives.select(F.lit("non_exist").alias("kind"), "score"))
    return rows.groupBy("kind").agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")
    )


def bucketed(rows: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    return rows.withColumn("bucket", epoch_bucket("ts_us", seconds))


def lowest_count(n: Column, share: float = 0.01) -> Column:
    return F.greatest(F.lit(1), F.floor(n * F.lit(share)))


def bucket_score(scored: DataFrame, method: str = "bottom", share: float = 0.01, by: Sequence[str] = ("bucket",)) -> DataFrame:
    """Per bucket ``score``: the lowest score, or the mean of the lowest max(1, int(n * share)).

    Equal scores are folded and ranked by running totals, so a bucket holding much of the data is not
    sorted in one task.
    """
    if method == "min":
        return scored.groupBy(*by).agg(F.min("score").alias("score"))
    folded = scored.groupBy(*by, "score").agg(F.count("*").alias("_c"))
    ranked = running_totals(folded, list(by), ["score"], {"_cum": F.col("_c")})
    sizes = folded.groupBy(*by).agg(lowest_count(F.sum("_c"), share).alias("_m"))
    taken = F.greatest(F.least(F.col("_c"), F.col("_m") - (F.col("_cum") - F.col("_c"))), F.lit(0))
    low = ranked.join(sizes, list(by)).withColumn("_t", taken).where("_t > 0")
    return low.groupBy(*by).agg((F.sum(F.col("score") * F.col("_t")) / F.sum("_t")).alias("score"))


def bucket_label(truth: DataFrame, by: Sequence[str] = ("bucket",)) -> DataFrame:
    return truth.groupBy(*by).agg(F.max("label").alias("label"))


def bucket_details(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """Benign and anomalous counts, predicted links, mean, minimum and lowest-share mean per bucket."""
    facts = truth.groupBy("bucket").agg(
        F.sum((F.col("label") == 0).cast("long")).alias("benign"), F.sum((F.col("label") == 1).cast("long")).alias("anomalous")
    )
    plain = scored.groupBy("bucket").agg(
        F.count("*").alias("predicted_links"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score")
    )
    bottom = bucket_score(scored).withColumnRenamed("score", "bottom_score")
    zero = F.lit(0).cast("long")
    return facts.join(plain.join(bottom, "bucket"), "bucket", "full_outer").select(
        "bucket", F.coalesce("benign", zero).alias("benign"), F.coalesce("anomalous", zero).alias("anomalous"),
        F.coalesce("predicted_links", zero).alias("predicted_links"), "mean_score", "min_score", "bottom_score",
        (F.coalesce("anomalous", zero) > 0).cast("int").alias("suspicious"),
    )


def validation_thresholds(scored: DataFrame) -> DataFrame:
    """Lowest and mean bucket score per method."""
    out = None
    for method in ("min", "bottom"):
        row = bucket_score(scored, method).agg(
            F.lit(method).alias("method"), F.min("score").alias("lowest"), F.avg("score").alias("mean")
        )
        out = row if out is None else out.unionByName(row)
    return out


def bucket_threshold_eval(scored: DataFrame, truth: DataFrame, method: str, threshold: float, invert: bool = False) -> DataFrame:
    """Confusion of bucket score (``invert``: 1 - score) at or above ``threshold`` against bucket labels."""
    scores = bucket_score(scored, method)
    value = F.lit(1.0) - F.col("score") if invert else F.col("score")
    joined = bucket_label(truth).join(scores.withColumn("score", value), "bucket", "left")
    joined = joined.withColumn("score", F.coalesce("score", F.lit(1.0)))
    return confusion(joined.withColumn("prediction", predicted("score", F.lit(threshold), inclusive=True)))


def extreme_predictions(scores: DataFrame, negatives: DataFrame, nodes: DataFrame, k: int = 100) -> DataFrame:
    """The k lowest and highest scored existing links and the k highest and lowest non-existing ones, with
    both endpoints' type and path."""
    parts = []
    for table, links, orders in (("existing", scores, ("low", "high")), ("non_existing", negatives, ("high", "low"))):
        for end in orders:
            score = F.col("score").asc() if end == "low" else F.col("score").desc()
            top = links.select("idx", *LINK, "score").orderBy(score, "idx").limit(k)
            parts.append(top.withColumn("links", F.lit(table)).withColumn("end", F.lit(end)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    # 4k rows at most: cheaper to send them to the nodes than the other way round
    for side in ("src", "dst"):
        about = nodes.select(
            F.col("node_id").alias(side), F.col("object_type").alias(f"{side}_type"), F.col("path").alias(f"{side}_path")
        )
        wanted = F.broadcast(rows.select(side).distinct())
        rows = rows.join(about.join(wanted, side, "left_semi"), side, "left")
    return rows


def edge_anomaly_report(joined: DataFrame, threshold: float | None = None, levels: DataFrame | None = None) -> DataFrame:
    """Ranking metrics of ``anomaly`` and the confusion above the best-F1 threshold, above a fixed one, or of a conformal mask.

    ``levels`` (stream, batch, threshold) is a table of ``adaptive_conformal``: each row of ``joined`` (with stream and batch) is
    held against the threshold of its own batch, or of the last earlier batch of its stream that has one; rows before
    the first are not flagged. The share of flagged rows is then reported as ``miscoverage``.
    """
    if levels is None:
        table = joined.select("label", F.col("anomaly").alias("score"))
        return sweep_report(table, flag=None if threshold is None else F.col("score") > F.lit(threshold))
    asked = joined.select("stream", "batch", "label", F.col("anomaly").alias("score"))
    held = last_at_or_before(levels.select("stream", "batch", "threshold"), asked, ["stream"], "batch", ["threshold"])
    found = sweep_report(held, flag=F.col("score") > F.col("threshold"))
    return found.withColumn("miscoverage", (F.col("tp") + F.col("fp")) / (F.col("positives") + F.col("negatives")))


def window_anomaly_report(scored: DataFrame, truth: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Per-window anomaly 1 - mean lowest score (0 without scores) against window labels: AUC, AP, share of
    anomalous windows and the confusion at the best precision/recall threshold, itself included."""
    windows = bucket_label(bucketed(truth, seconds)).join(bucket_score(bucketed(scored, seconds)), "bucket", "left")
    table = windows.select("label", (F.lit(1.0) - F.coalesce("score", F.lit(1.0))).alias("score"))
    total = F.col("positives") + F.col("negatives")
    return sweep_report(table, "pr").select(
        total.alias("num_windows"), (F.col("positives") / total).alias("anomaly_share"), "auc", "ap", "best_threshold",
        F.col("best_f1").alias("f1"), "tn", "fp", "fn", "tp", "precision", "recall",
    )


def link_report(positives: DataFrame, negatives: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Existing against non-existing links: AUC, AP and the confusion above the threshold."""
    table = squash_scores(positives_union_negatives(positives.select("score"), negatives.select("score")))
    summary = ranking_summary(table).select("positives", "negatives", "auc", "ap")
    marked = table.withColumn("prediction", predicted("score", F.lit(threshold)))
    cells = confusion(marked).select(F.struct("*")).scalar()
    return summary.withColumn("_c", cells).select("*", "_c.*").drop("_c")


def report_by_negative_source(positives: DataFrame, negatives: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``link_report`` of all positives against each ``negative_source``, in one pass: AUC, average precision, confusion
    counts, accuracy, precision, recall and F1 (0 where undefined).

    Positives are folded to distinct scores before they are repeated per source.
    """
    folded = positives.groupBy("score").agg(F.count("*").alias("p")).withColumn("n", F.lit(0).cast("long"))
    sources = negatives.select("negative_source").distinct()
    listed = sources.agg(F.sort_array(F.collect_list("negative_source"))).scalar()  # a handful of samplers
    spread = folded.withColumn("negative_source", F.explode(listed))
    counted = negatives.groupBy("negative_source", "score").agg(F.count("*").alias("n")).withColumn("p", F.lit(0).cast("long"))
    both = spread.unionByName(counted).groupBy("negative_source", "score").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    limits = both.groupBy("negative_source").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    ranked = running_totals(both, ["negative_source"], [F.col("score").desc()], {"tp": F.col("_p"), "fp": F.col("_n")})
    ranked = ranked.join(limits, "negative_source")  # one row per sampler
    # scores outside [0, 1] are squashed over the positives and the negatives of the source
    outside = (F.col("_lo") < 0) | (F.col("_hi") > 1)
    squashed = F.when(outside, F.try_divide(F.col("score") - F.col("_lo"), F.col("_hi") - F.col("_lo"))).otherwise(F.col("score"))
    above = F.coalesce(squashed > threshold, F.lit(False))
    wins = F.sum(F.col("_n").cast("double") * (F.col("tp") - F.col("_p") / F.lit(2.0)))
    total_p, total_n = F.sum("_p"), F.sum("_n")
    # average precision is sum(_p * precision) over all positives
    found = ranked.groupBy("negative_source").agg(
        total_p.alias("positives"), total_n.alias("negatives"),
        F.try_divide(wins, total_p.cast("double") * total_n).alias("auc"),
        F.try_divide(F.sum(F.col("_p") * F.col("tp") / (F.col("tp") + F.col("fp"))), total_p).alias("ap"),
        F.sum(F.when(above, F.lit(0)).otherwise(F.col("_n"))).alias("tn"), F.sum(F.when(above, F.col("_n")).otherwise(F.lit(0))).alias("fp"),
        F.sum(F.when(above, F.lit(0)).otherwise(F.col("_p"))).alias("fn"), F.sum(F.when(above, F.col("_p")).otherwise(F.lit(0))).alias("tp"),
    )
    none = F.lit(0.0)
    return found.select(
        "*", ((F.col("tp") + F.col("tn")) / (F.col("positives") + F.col("negatives"))).alias("accuracy"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), none).alias("precision"),
        F.coalesce(F.try_divide("tp", "positives"), none).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), none).alias("f1"),
    )
