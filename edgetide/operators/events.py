"""From raw logs to graph tables: fields, filters, labels, stable ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.functions.times import micros, parse_ts
from edgetide.plans.ordered import row_numbers, running_totals
from edgetide.schema import BATCH, OBJECT_TYPES


def extract_fields(logs: DataFrame) -> DataFrame:
    """Flat event columns; a field missing at any level is null."""
    flat = ["image_path", "file_path", "command_line"]
    return logs.select(
        "id", "hostname", "timestamp", F.col("actorID").alias("actor_id"), F.col("objectID").alias("object_id"),
        F.col("object").alias("object_type"), F.col("action").alias("action_type"),
        *[F.col(f"properties.{name}").alias(name) for name in flat],
    )


def filter_events(events: DataFrame, types: Sequence[str] = tuple(OBJECT_TYPES)) -> DataFrame:
    """Events on the given object types that name an actor, an object and a time."""
    named = F.col("actor_id").isNotNull() & F.col("object_id").isNotNull() & F.col("timestamp").isNotNull()
    return events.where(F.col("object_type").isin(*types) & named)


def with_time(events: DataFrame) -> DataFrame:
    return events.withColumn("ts_us", micros(parse_ts("timestamp")))


def label_edges(events: DataFrame, ids: DataFrame) -> DataFrame:
    """``label`` 1 when the record id is malicious on the record's host."""
    marked = ids.select("hostname", "id").distinct().withColumn("_hit", F.lit(1))
    host = events.withColumn("_host", F.lower("hostname"))
    joined = host.join(marked.withColumnRenamed("hostname", "_host"), ["_host", "id"], "left")
    return joined.withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit", "_host")


def text_corpus(events: DataFrame) -> DataFrame:
    """One row per non-null image path, file path and command line."""
    texts = F.explode(F.array("image_path", "file_path", "command_line"))
    return events.select(texts.alias("text")).where("text is not null")


def endpoints_of(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Two rows per event: the actor as PROCESS (role 0) with its image, the object (role 1) with its file.

    ``order`` names all columns of the event that the rows keep.
    """
    actor = F.struct(
        F.lit("PROCESS").alias("object_type"), F.col("actor_id").alias("id"), F.lit(0).alias("role"),
        F.col("image_path").alias("path"),
    )
    obj = F.struct(
        F.col("object_type"), F.col("object_id").alias("id"), F.lit(1).alias("role"), F.col("file_path").alias("path")
    )
    return events.select(*order, F.explode(F.array(actor, obj)).alias("_e")).select(*order, "_e.*")


def first_non_null(value: str, order: Sequence[str]) -> Column:
    """Aggregate: earliest non-null ``value`` in ``order``."""
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))


def assign_node_ids(events: DataFrame, order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Nodes with dense ids from 1 by first appearance (actor before object in one event) and first known path.

    ``within`` (non-null, e.g. a host) gives every one of its values ids of its own, from 1.
    """
    seen = endpoints_of(events, [*within, *order])
    place = [*order, "role"]
    nodes = seen.groupBy(*within, "object_type", "id").agg(
        F.min(F.struct(*place)).alias("_first"), first_non_null("path", place).alias("path")
    )
    return _numbered(nodes, ["_first"], "node_id", within).select(*within, "node_id", "object_type", "id", "path")


def _numbered(rows: DataFrame, order: Sequence[str], name: str, within: Sequence[str]) -> DataFrame:
    """Dense numbers from 1, over all rows or inside each key; a busy key is spread over several partitions."""
    if within:
        return running_totals(rows, list(within), order, {name: F.lit(1).cast("long")})
    return row_numbers(rows, order, name)


def assign_sorted_node_ids(keys: DataFrame, key: str) -> DataFrame:
    """Ids from 0 in sorted key order."""
    return row_numbers(keys.select(key).distinct(), [key], "node_id", start=0)


def assign_edge_ids(events: DataFrame, order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """``idx`` from 1 by time, inside each key of ``within`` if given; equal times keep input order."""
    return _numbered(events, ["ts_us", *order], "idx", within)


def build_graph(events: DataFrame, order: Sequence[str], host: str | None = None) -> dict[str, DataFrame]:
    """Edges, edge features, nodes and corpus of filtered, timed, labelled events.

    ``host`` names the events' host column: every host, in lower case, is then a graph of its own, with node and edge ids
    from 1, and all tables carry ``hostname``. Events without host are a graph with an empty name.
    """
    within = []
    if host:
        events = events.withColumn("hostname", F.lower(F.coalesce(F.col(host), F.lit(""))))
        within = ["hostname"]
    nodes = assign_node_ids(events, order, within)
    key = nodes.select(*within, "node_id", "object_type", "id")
    src = key.where("object_type = 'PROCESS'").select(*within, F.col("node_id").alias("u"), F.col("id").alias("actor_id"))
    dst = key.select(*within, F.col("node_id").alias("i"), "object_type", F.col("id").alias("object_id"))
    joined = events.join(src, [*within, "actor_id"]).join(dst, [*within, "object_type", "object_id"])
    numbered = assign_edge_ids(joined, order, within)
    texts = F.explode(F.array("image_path", "file_path", "command_line")).alias("text")
    return {
        "edges": numbered.select(*within, "u", "i", "ts_us", "label", "idx"),
        "edge_features": numbered.select(*within, "idx", "action_type", "command_line"),
        "nodes": nodes.select(*within, "node_id", "object_type", "path"),
        "corpus": events.select(*within, texts).where("text is not null"),
    }


def reindex(edges: DataFrame, bipartite: bool) -> DataFrame:
    """Ids from 1; for a bipartite graph destinations follow the sources. Ids must be contiguous there."""
    if not bipartite:
        return edges.select(
            (F.col("u") + 1).alias("u"), (F.col("i") + 1).alias("i"), "ts_us", "label", (F.col("idx") + 1).alias("idx")
        )
    spans = []
    for side in ("u", "i"):
        ids = edges.select(side).distinct()
        gap = ids.agg((F.max(side) - F.min(side) + 1 - F.count("*")).alias("gap"))
        spans.append(gap.scalar())
    upper = edges.agg(F.max("u") + 1).scalar()
    checked = edges.withColumn("_upper", upper).withColumn("_gap", F.abs(spans[0]) + F.abs(spans[1]))
    top = F.when(F.col("_gap") == 0, F.col("_upper")).otherwise(F.raise_error(F.lit("ids not contiguous")).cast("long"))
    return checked.select(
        (F.col("u") + 1).alias("u"), (F.col("i") + top + 1).alias("i"), "ts_us", "label",
        (F.col("idx") + 1).alias("idx"),
    )


def batch_number(idx="idx", size: int = BATCH) -> Column:
    """Number (from 0) of the consecutive batch holding edge ``idx`` (from 1)."""
    idx = F.col(idx) if isinstance(idx, str) else idx
    return ((idx - 1 - F.pmod(idx - 1, F.lit(size))) / F.lit(size)).cast("long")


def every_nth(edges: DataFrame, n: int = 10) -> DataFrame:
    return edges.where(F.pmod(F.col("idx") - 1, F.lit(n)) == 0)


def half_edges(edges: DataFrame, *keep: str) -> DataFrame:
    """Both directions of every edge: ``node, neighbor, ts_us, idx`` and the columns to ``keep``."""
    forth = F.struct(F.col("u").alias("node"), F.col("i").alias("neighbor"))
    back = F.struct(F.col("i").alias("node"), F.col("u").alias("neighbor"))
    both = F.explode(F.array(forth, back)).alias("_h")
    return edges.select(both, "ts_us", "idx", *keep).select("_h.*", "ts_us", "idx", *keep)
