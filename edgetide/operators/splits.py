"""Temporal splits, hold-outs, set operations and sanity statistics. Times are microseconds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.operators.logstats import QUARTILES
from edgetide.plans.ordered import quantiles
from edgetide.plans.sampling import smallest_digests
from edgetide.session import finer, stored


def time_split(ts="ts_us", *, train_start, val_start, test_start, test_end) -> Column:
    """train [start, val], val (val, test], test (test, end]; null outside."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (
        F.when((ts >= train_start) & (ts <= val_start), "train")
        .when((ts > val_start) & (ts <= test_start), "val")
        .when((ts > test_start) & (ts <= test_end), "test")
    )


def half_open_split(ts="ts_us", *, val_start, test_start) -> Column:
    """train before val start, val before test start, test from there."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.when(ts < val_start, "train").when(ts < test_start, "val").otherwise("test")


def entity_split(ts, *, val_start, test_start, entity_start, entity_end) -> Column:
    """Half-open split that also leaves out train before the entity start and val after the entity end."""
    split = half_open_split(ts, val_start=val_start, test_start=test_start)
    col = F.col(ts) if isinstance(ts, str) else ts
    outside = ((split == "train") & (col < entity_start)) | ((split == "val") & (col > entity_end))
    return F.when(~outside, split)


def quantile_split(edges: DataFrame, val_ratio: float, test_ratio: float, ts: str = "ts_us") -> DataFrame:
    """Adds ``split`` by exact time quantiles: train up to the first cut, val up to the second, then test."""
    cuts = quantiles(edges, ts, {"val": 1 - val_ratio - test_ratio, "test": 1 - test_ratio})
    limits = cuts.select(F.struct("val", "test")).scalar()
    where = (
        F.when(F.col(ts) <= F.col("_cut.val"), "train").when(F.col(ts) <= F.col("_cut.test"), "val").otherwise("test")
    )
    return edges.withColumn("_cut", limits).withColumn("split", where).drop("_cut")


def endpoints(edges: DataFrame, *keep: str) -> DataFrame:
    return edges.select(*keep, F.explode(F.array("u", "i")).alias("node"))


def node_set(edges: DataFrame) -> DataFrame:
    return endpoints(edges).distinct()


def edge_difference(history: DataFrame, *others: DataFrame) -> DataFrame:
    """Distinct historical (u, i) found in none of ``others``."""
    pairs = history.select("u", "i").distinct()
    return reduce(lambda left, right: left.join(right.select("u", "i"), ["u", "i"], "left_anti"), others, pairs)


def history_as_of_batch(edges: DataFrame, batch: int, column: str = "batch") -> DataFrame:
    return edges.where(F.col(column) < batch)


def positives_union_negatives(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    marked = positives.withColumn("label", F.lit(1)), negatives.withColumn("label", F.lit(0))
    return marked[0].unionByName(marked[1], allowMissingColumns=True)


def sample_ranked(rows: DataFrame, share: float, seed: int, key: str, of: Column | None = None) -> DataFrame:
    """The int(share * n) rows of smallest digest. ``of`` replaces n, the number of rows."""
    size = of if of is not None else rows.agg(F.count("*")).scalar()
    return smallest_digests(rows, F.floor(F.lit(share) * size), seed, key)


def inductive_holdout(edges: DataFrame, val_start: int, end: int, share: float = 0.1, seed: int = 2020) -> DataFrame:
    """Held-out nodes: int(share * all nodes) of those seen inside (val_start, end)."""
    late = node_set(edges.where((F.col("ts_us") > val_start) & (F.col("ts_us") < end)))
    total = node_set(edges).agg(F.count("*")).scalar()
    return sample_ranked(late, share, seed, "node", of=total)


def without_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges touching none of ``nodes``."""
    for side in ("u", "i"):
        edges = edges.join(nodes.select(F.col("node").alias(side)), side, "left_anti")
    return edges


def calibration_holdout(train: DataFrame, share: float = 0.1, seed: int = 2020) -> DataFrame:
    return sample_ranked(train, share, seed, "idx")


def new_node_edges(edges: DataFrame, train: DataFrame) -> DataFrame:
    """Edges with an endpoint that train does not contain."""
    known = node_set(train).withColumn("_known", F.lit(1))
    for side in ("u", "i"):
        edges = edges.join(
            known.select(F.col("node").alias(side), F.col("_known").alias(f"_{side}")), side, "left"
        )
    return edges.where("_u is null or _i is null").drop("_u", "_i")


def leakage_levels(anomalies: DataFrame, train: DataFrame) -> DataFrame:
    """Anomalous edges by number of endpoints known from train: both, one or none."""
    known = node_set(train).withColumn("_known", F.lit(1))
    for side in ("u", "i"):
        anomalies = anomalies.join(
            known.select(F.col("node").alias(side), F.col("_known").alias(f"_{side}")), side, "left"
        )
    seen = F.coalesce("_u", F.lit(0)) + F.coalesce("_i", F.lit(0))
    level = F.when(seen == 2, "both").when(seen == 1, "one").otherwise("none")
    return anomalies.groupBy(level.alias("level")).agg(F.count("*").alias("n"))


def inject_first_edges(edges: DataFrame, train: DataFrame) -> DataFrame:
    """Train plus, per anomalous node unknown to it, the node's first edge as source, else as destination."""
    missing = node_set(edges.where("label = 1")).join(node_set(train), "node", "left_anti")
    role = F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(0).alias("role")),
        F.struct(F.col("i").alias("node"), F.lit(1).alias("role")),
    ))
    touched = edges.select(role.alias("_r"), "idx").select("_r.*", "idx").join(missing, "node", "left_semi")
    first = touched.groupBy("node").agg(F.min(F.struct("role", "idx")).alias("_f"))
    extra = edges.join(first.select(F.col("_f.idx").alias("idx")).distinct(), "idx", "left_semi")
    return train.unionByName(extra.join(train.select("idx"), "idx", "left_anti").select(*train.columns))


def split_stats(edges: DataFrame) -> DataFrame:
    """Edges, nodes and distinct (u, i) per ``split``."""
    plain = edges.groupBy("split").agg(F.count("*").alias("num_edges"))
    nodes = endpoints(edges, "split").distinct().groupBy("split").agg(F.count("*").alias("unique_nodes"))
    pairs = edges.select("split", "u", "i").distinct().groupBy("split").agg(F.count("*").alias("unique_edges"))
    return plain.join(nodes, "split").join(pairs, "split")


def node_stats(edges: DataFrame) -> DataFrame:
    """Per (split, node): edges as source, as destination, both, distinct times and time span.

    Counts are first folded per (node, time), so a node's many edges reach its final row pre-aggregated. The result is stored.
    """
    # each side is read apart: a task then folds one row an edge, and the rows are not made as structs first
    source, destination = (edges.select("split", "ts_us", F.col(c).alias("node"), F.lit(s).alias("s")) for c, s in (("u", 1), ("i", 0)))
    rows = source.unionByName(destination)
    moments = rows.groupBy("split", "node", "ts_us").agg(F.sum("s").alias("s"), F.count("*").alias("n"))
    stats = moments.groupBy("split", "node").agg(
        F.sum("s").alias("src_edges"), F.sum(F.col("n") - F.col("s")).alias("dst_edges"), F.sum("n").alias("total"),
        F.count("*").alias("distinct_ts"), (F.max("ts_us") - F.min("ts_us")).alias("span_us"),
    )
    # a moment is ten times larger in a task's memory than in the shuffle
    with finer(edges.sparkSession, 2 * edges.count()):
        return stored(stats)


def metric_distribution(stats: DataFrame) -> DataFrame:
    """Quartiles and mean of every node statistic, per split."""
    metrics = ["src_edges", "dst_edges", "total", "distinct_ts", "span_us"]
    pairs = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("value")) for m in metrics
    ]))
    long = stats.select("split", pairs.alias("_p")).select("split", "_p.*")
    means = long.groupBy("split", "metric").agg(F.avg("value").alias("mean"))
    return quantiles(long, "value", QUARTILES, ["split", "metric"]).join(means, ["split", "metric"])


def novelty_vs_train(edges: DataFrame) -> DataFrame:
    """Distinct nodes and (u, i) pairs per other split that train lacks."""
    train, rest = edges.where("split = 'train'"), edges.where("split <> 'train'")
    nodes = endpoints(rest, "split").distinct().join(node_set(train), "node", "left_anti")
    pairs = rest.select("split", "u", "i").distinct().join(
        train.select("u", "i").distinct(), ["u", "i"], "left_anti"
    )
    found = nodes.select("split", F.lit(1).alias("n"), F.lit(0).alias("e")).union(
        pairs.select("split", F.lit(0).alias("n"), F.lit(1).alias("e"))
    )
    counts = found.groupBy("split").agg(F.sum("n").alias("new_nodes"), F.sum("e").alias("new_edges"))
    zero = F.lit(0).cast("long")
    return rest.select("split").distinct().join(counts, "split", "left").select(
        "split", F.coalesce("new_nodes", zero).alias("new_nodes"), F.coalesce("new_edges", zero).alias("new_edges")
    )


def bucket_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("bucket").agg(F.count("*").alias("events"), F.sum("label").alias("anomalies"))


def valid_buckets(edges: DataFrame, val_start: int, min_events: int = 2000, start: int | None = None) -> DataFrame:
    """Edges of buckets from val start on, and of earlier buckets with at least ``min_events`` events."""
    kept = edges if start is None else edges.where(F.col("bucket") >= start)
    good = bucket_counts(kept).where((F.col("bucket") >= val_start) | (F.col("events") >= min_events))
    return kept.join(good.select("bucket"), "bucket", "left_semi")


def bucket_histogram(edges: DataFrame, val_start: int, min_events: int = 2000) -> DataFrame:
    """Events and anomalies per bucket; anomalies count only in buckets that are kept."""
    excluded = (F.col("bucket") < val_start) & (F.col("events") < min_events)
    return bucket_counts(edges).select(
        "bucket", "events", F.when(excluded, F.lit(0)).otherwise(F.col("anomalies")).alias("anomalies"),
        excluded.cast("int").alias("excluded"),
    )


def split_details(edges: DataFrame, val_start: int, test_start: int, seconds: int = 900) -> DataFrame:
    """Events, anomalies, buckets found, expected and with anomalies, and share of events per split."""
    split = half_open_split("bucket", val_start=val_start, test_start=test_start)
    by_split = bucket_counts(edges).withColumn("split", split).groupBy("split").agg(
        F.sum("events").alias("events"), F.sum("anomalies").alias("anomalies"),
        F.count("*").alias("buckets"), F.sum((F.col("anomalies") > 0).cast("long")).alias("anomalous_buckets"),
        F.min("bucket").alias("_first"), F.max("bucket").alias("_final"),
    )
    start = F.when(F.col("split") == "train", F.col("_first")).when(F.col("split") == "val", F.lit(val_start)).otherwise(
        F.lit(test_start)
    )
    end = F.when(F.col("split") == "train", F.lit(val_start)).when(F.col("split") == "val", F.lit(test_start)).otherwise(
        F.col("_final") + 1
    )
    total = by_split.agg(F.sum("events")).scalar()
    return by_split.select(
        "split", "events", "anomalies", "buckets", F.floor((end - start) / F.lit(seconds)).alias("expected_buckets"),
        "anomalous_buckets", (F.lit(100.0) * F.col("events") / total).alias("percent"),
    )
