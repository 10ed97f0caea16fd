"""Statistics over raw events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.functions.times import floor_minutes, parse_ts
from edgetide.plans.ordered import quantiles

QUARTILES = {"min": 0.0, "q25": 0.25, "median": 0.5, "q75": 0.75, "max": 1.0}


def action_counts(events: DataFrame) -> DataFrame:
    """Events per (object type, action); ``action_type`` null holds the object type's total."""
    counted = events.rollup("object_type", "action_type").agg(F.count("*").alias("n"), F.grouping_id().alias("_level"))
    return counted.where(F.col("_level") < 3).drop("_level")


def entity_log_counts(events: DataFrame) -> DataFrame:
    """Events per entity; an event counts for its actor (a PROCESS) and for its object."""
    actor = F.struct(F.lit("PROCESS").alias("object_type"), F.col("actor_id").alias("id"))
    obj = F.struct(F.col("object_type"), F.col("object_id").alias("id"))
    both = events.select(F.explode(F.array(actor, obj)).alias("_e"))
    return both.select("_e.*").groupBy("object_type", "id").agg(F.count("*").alias("n"))


def entity_count_distribution(events: DataFrame) -> DataFrame:
    """Quartiles and mean of events per entity, entities, events and actions per type, and the mismatch flag."""
    counts = entity_log_counts(events)
    spread = quantiles(counts, "n", QUARTILES, ["object_type"])
    totals = counts.groupBy("object_type").agg(
        F.avg("n").alias("mean"), F.count("*").alias("num_objects"), F.sum("n").alias("total_logs")
    )
    actions = events.groupBy("object_type").agg(F.count("*").alias("total_actions"))
    joined = spread.join(totals, "object_type").join(actions, "object_type")
    odd = (F.col("object_type") != "PROCESS") & (F.col("total_logs") != F.col("total_actions"))
    return joined.withColumn("mismatch", odd.cast("int"))


def type_conflicts(events: DataFrame) -> DataFrame:
    """Object ids seen with more than one type."""
    kinds = events.select("object_id", "object_type").distinct()
    found = kinds.groupBy("object_id").agg(F.array_sort(F.collect_list("object_type")).alias("types"))
    return found.where(F.size("types") > 1)


def cross_role_processes(events: DataFrame) -> DataFrame:
    """Ids used as actor and as PROCESS object, in at least one event with two different ids."""
    other = F.col("actor_id") != F.col("object_id")
    process = F.col("object_type") == "PROCESS"
    actor = F.struct(F.col("actor_id").alias("id"), F.lit(True).alias("acts"), F.lit(False).alias("is_acted"),
                     other.alias("apart"))
    obj = F.struct(F.col("object_id").alias("id"), F.lit(False).alias("acts"), process.alias("is_acted"),
                   (other & process).alias("apart"))
    roles = events.select(F.explode(F.array(actor, obj)).alias("_r")).select("_r.*")
    flags = roles.groupBy("id").agg(*[F.max(c).alias(c) for c in ("acts", "is_acted", "apart")])
    return flags.where("acts and is_acted and apart").select("id")


def process_adjacency(events: DataFrame) -> DataFrame:
    pairs = events.where("object_type = 'PROCESS' and actor_id <> object_id")
    return pairs.select(F.col("actor_id").alias("src"), F.col("object_id").alias("dst")).distinct()


def process_path_counts(adjacency: DataFrame) -> DataFrame:
    """Numbers of length-2 and length-3 paths from degrees alone; no path is enumerated."""
    ins = adjacency.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    outs = adjacency.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    two = ins.join(outs, "node").agg(F.coalesce(F.sum(F.col("n_in") * F.col("n_out")), F.lit(0)).alias("length_2"))
    three = (
        adjacency.join(ins.withColumnRenamed("node", "src"), "src")
        .join(outs.withColumnRenamed("node", "dst"), "dst")
        .agg(F.coalesce(F.sum(F.col("n_in") * F.col("n_out")), F.lit(0)))
    )
    return two.withColumn("length_3", three.scalar())


def anomalies_by_client_day(labels: DataFrame) -> DataFrame:
    keys = [F.lower("hostname").alias("client"), F.substring("timestamp", 1, 10).alias("day")]
    return labels.groupBy(*keys).agg(F.count("*").alias("n"))


def malicious_entities(labels: DataFrame) -> DataFrame:
    """Per host, ids of malicious actors and of PROCESS objects."""
    actors = labels.select("hostname", F.col("actor_id").alias("id"))
    objects = labels.where("object_type = 'PROCESS'").select("hostname", F.col("object_id").alias("id"))
    return actors.union(objects).where("id is not null").distinct()


def malicious_windows(labels: DataFrame, minutes: int = 15) -> DataFrame:
    """Per host, starts of windows holding a malicious event."""
    return labels.select("hostname", floor_minutes(parse_ts("timestamp"), minutes).alias("window_start")).distinct()


def window_label(windows: DataFrame, malicious: DataFrame, minutes: int = 15) -> DataFrame:
    """1 when a malicious ``ts_us`` of the host lies in [start_us, end_us).

    Windows and events meet on (host, bucket): a window of any alignment touches at most the buckets it
    spans, so the interval test runs inside a hash join.
    """
    width = minutes * 60_000_000
    first, final = F.col("start_us"), F.col("end_us") - 1
    bucket = lambda c: ((c - F.pmod(c, F.lit(width))) / F.lit(width)).cast("long")
    spread = windows.withColumn("_bucket", F.explode(F.sequence(bucket(first), bucket(final))))
    events = malicious.select("hostname", "ts_us", bucket(F.col("ts_us")).alias("_bucket")).distinct()
    hit = (F.col("ts_us") >= F.col("start_us")) & (F.col("ts_us") < F.col("end_us"))
    joined = spread.join(events, ["hostname", "_bucket"], "left")
    return joined.groupBy(*windows.columns).agg(F.max(F.coalesce(hit.cast("int"), F.lit(0))).alias("label"))
