"""Window graphs: events of a host grouped by time window, with node, edge and window features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.functions.codes import parent_child_user, sid_histogram
from edgetide.functions.times import floor_us
from edgetide.functions.vectors import mean_by_position, weighted_mean_by_position, zeros
from edgetide.operators.events import first_non_null
from edgetide.schema import ACTIONS, END_ACTIONS, NODE_TYPES, START_ACTIONS

KEY = ["hostname", "window_us"]
FLOOR_LIFE = 15  # fixed value: the window minimum of lifetimes starts here


def _context(name: str) -> Column:
    return F.regexp_extract(F.col("properties.context_info"), name + " = ([^\\n]*)", 1)


def node_key() -> Column:
    """Identity of a record's object: path, address, key or shell context by type, else the object id."""
    p = lambda name: F.col(f"properties.{name}")
    text = lambda c: F.coalesce(c, F.lit("0"))
    shell = F.concat(*[F.coalesce(_context(n), F.lit("")) for n in ("Host ID", "User", "Command Name")])
    kind = F.col("object")
    return (
        F.when(kind == "FILE", p("file_path")).when(kind == "MODULE", p("module_path"))
        .when(kind == "FLOW", F.concat(text(p("dest_ip")), F.lit(":"), text(p("dest_port"))))
        .when(kind == "REGISTRY", p("key")).when((kind == "SHELL") & (shell != ""), shell)
        .otherwise(F.col("objectID"))
    )


def orient_process_create(logs: DataFrame) -> DataFrame:
    """Adds ``actor`` and ``target`` structs (pid, ppid, image_path, parent_image_path, command_line).

    Creating a process describes the new one, so its actor is known by the parent's pid and path. Other
    actions on a process describe the actor, so the target only knows its parent pid.
    """
    p = lambda name: F.col(f"properties.{name}")
    none = F.lit(None).cast("string")
    own = F.struct(
        F.col("pid"), F.col("ppid"), p("image_path").alias("image_path"),
        p("parent_image_path").alias("parent_image_path"), p("command_line").alias("command_line"),
    )
    parent = F.struct(
        F.col("ppid").alias("pid"), none.alias("ppid"), p("parent_image_path").alias("image_path"),
        none.alias("parent_image_path"), none.alias("command_line"),
    )
    child = F.struct(
        none.alias("pid"), F.col("pid").alias("ppid"), none.alias("image_path"), none.alias("parent_image_path"),
        none.alias("command_line"),
    )
    process, create = F.col("object") == "PROCESS", F.col("action") == "CREATE"
    return logs.withColumn("actor", F.when(process & create, parent).otherwise(own)).withColumn(
        "target", F.when(process & ~create, child).otherwise(own)
    )


def window_edges(events: DataFrame, minutes: int = 15) -> DataFrame:
    """Events with ``window_us``. ``events``: hostname, ts_us, ord, id, src, dst, dst_type, action_type, label."""
    return events.withColumn("window_us", floor_us("ts_us", minutes * 60_000_000)).withColumn(
        "src_type", F.lit("Process")
    )


def drop_type_mismatch(edges: DataFrame) -> DataFrame:
    """An id keeps the first type it has in a window; events naming it with another type are dropped.

    Places are folded per id and type first, and only the types that an id does not keep meet the events.
    """
    named = F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.col("src_type").alias("type"), F.lit(0).alias("role")),
        F.struct(F.col("dst").alias("node"), F.col("dst_type").alias("type"), F.lit(1).alias("role")),
    ))
    # a missing place comes before all others, as in the order of structs
    places = edges.select(*KEY, "ord", named.alias("_n")).select(*KEY, "ord", "_n.*").groupBy(*KEY, "node", "type", "role").agg(
        F.min("ord").alias("_ord"), F.max(F.col("ord").isNull().cast("int")).alias("_none"))
    place = F.struct(F.when(F.col("_none") == 0, F.col("_ord")).alias("ord"), "role")
    types = F.collect_set("type").alias("types")
    kept = places.groupBy(*KEY, "node").agg(F.min_by("type", place).alias("kept"), types)
    lost = kept.select(*KEY, "node", "kept", F.explode("types").alias("type")).where("not type <=> kept")
    for side in ("src", "dst"):
        named_by = [*KEY, side, f"{side}_type"]
        other = lost.select(*KEY, F.col("node").alias(side), F.col("type").alias(f"{side}_type"))
        edges = edges.dropna(subset=named_by).join(other, named_by, "left_anti")
    return edges


def window_nodes(edges: DataFrame, minutes: int = 15) -> DataFrame:
    """Nodes of each window: type, lifetime bounds and whether any event touching them is malicious.

    A lifetime spans one window length around the node's first event; start actions on it set the start and
    end actions the end, the last one winning.
    """
    rows = edges.select(
        *KEY, "ts_us", "ord", "action_type", "label", F.explode(F.array(
            F.struct(F.col("src").alias("node"), F.col("src_type").alias("node_type"), F.lit(0).alias("role")),
            F.struct(F.col("dst").alias("node"), F.col("dst_type").alias("node_type"), F.lit(1).alias("role")),
        )).alias("_n")
    ).select(*KEY, "ts_us", "ord", "action_type", "label", "_n.*")
    order, target = F.struct("ts_us", "ord"), F.col("role") == 1
    last = lambda actions: F.max_by(
        F.when(target & F.col("action_type").isin(*actions), F.col("ts_us")),
        F.when(target & F.col("action_type").isin(*actions), order),
    )
    width = F.lit(minutes * 60_000_000)
    first = F.min("ts_us")
    nodes = rows.groupBy(*KEY, "node").agg(
        F.min_by("node_type", F.struct("ord", "role")).alias("node_type"),
        F.coalesce(last(START_ACTIONS), first - width).alias("start_us"),
        F.coalesce(last(END_ACTIONS), first + width).alias("end_us"), F.max("label").alias("red"),
    )
    return nodes.withColumn("lifetime_ms", F.abs(F.col("end_us") - F.col("start_us")) / F.lit(1000.0))


def process_attributes(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per node: first non-null pid, ppid, command line and paths in event order."""
    names = ["pid", "ppid", "command_line", "image_path", "parent_image_path"]
    return events.groupBy("node").agg(*[first_non_null(n, order).alias(n) for n in names])


def window_graph_info(edges: DataFrame) -> DataFrame:
    """Nodes, edges, malicious events and first/last time of each window."""
    nodes = edges.select(*KEY, F.explode(F.array("src", "dst")).alias("node")).distinct()
    sizes = nodes.groupBy(*KEY).agg(F.count("*").alias("nodes"))
    facts = edges.groupBy(*KEY).agg(
        F.count("*").alias("edges"), F.sum("label").alias("labels"), F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
    )
    return facts.join(sizes, KEY)


def window_graph_size(edges: DataFrame) -> DataFrame:
    return window_graph_info(edges).agg(
        F.count("*").alias("windows"), F.avg("nodes").alias("mean_nodes"), F.avg("edges").alias("mean_edges")
    )


def _sides(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row per edge and endpoint: the node, its direction and what it sees on the other side."""
    out = F.struct(
        F.col("src").alias("node"), F.col("src_type").alias("node_type"), F.lit("out").alias("direction"),
        F.col("dst").alias("other"), F.col("dst_type").alias("other_type"),
    )
    into = F.struct(
        F.col("dst").alias("node"), F.col("dst_type").alias("node_type"), F.lit("in").alias("direction"),
        F.col("src").alias("other"), F.col("src_type").alias("other_type"),
    )
    rows = edges.select(*KEY, "action_type", F.explode(F.array(out, into)).alias("_s")).select(*KEY, "action_type", "_s.*")
    if nodes is None:
        return rows
    lives = nodes.select(*KEY, F.col("node").alias("other"), F.col("lifetime_ms").alias("other_life"))
    return rows.join(lives, [*KEY, "other"])


def _hits(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def degree_features(edges: DataFrame, selected: str = "Process") -> DataFrame:
    """Per selected node: total, in and out degree (a self loop counts on both sides)."""
    rows = _sides(edges).where(F.col("node_type") == selected)
    return rows.groupBy(*KEY, "node").agg(
        F.count("*").alias("degree"), _hits(F.col("direction") == "in").alias("in_degree"),
        _hits(F.col("direction") == "out").alias("out_degree"),
    )


def window_degree_features(degrees: DataFrame) -> DataFrame:
    """Per window: highest and truncated mean of each degree."""
    names = ["degree", "in_degree", "out_degree"]
    columns = [c for n in names for c in (F.max(n).alias(f"max_{n}"), F.floor(F.avg(n)).alias(f"mean_{n}"))]
    return degrees.groupBy(*KEY).agg(*columns)


def _slot(vocabulary: Sequence[str], value: str, start: int) -> Column:
    """Vector position of a vocabulary value, out values first and in values after them; -1 when unknown."""
    place = F.array_position(F.array(*[F.lit(v) for v in vocabulary]), F.col(value)).cast("int") - 1
    side = F.when(F.col("direction") == "out", F.lit(start)).otherwise(F.lit(start + len(vocabulary)))
    return F.when(place >= 0, place + side).otherwise(F.lit(-1))


def _vectors(rows: DataFrame, by: Sequence[str], value: Column, name: str, dim: int) -> DataFrame:
    """Aggregates ``value`` per key and vector position ``slot`` and lays the results out as one vector.

    Positions are grouped first, so a key's rows arrive at its vector as at most ``dim`` numbers.
    """
    cells = rows.groupBy(*by, "slot").agg(value.cast("double").alias("_v"))
    filled = cells.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("slot", "_v"))).alias("_m"))
    places = F.sequence(F.lit(0), F.lit(dim - 1))
    vector = F.transform(places, lambda n: F.coalesce(F.try_element_at("_m", n), F.lit(0.0)))
    return filled.select(*by, vector.alias(name))


def type_frequency_features(
    edges: DataFrame, selected: str = "Process", by: Sequence[str] = (*KEY, "node"),
    actions: Sequence[str] = tuple(ACTIONS), types: Sequence[str] = tuple(NODE_TYPES),
) -> DataFrame:
    """Counts of out and in actions, then of out and in neighbour types, in vocabulary order.

    ``by`` = window key and node gives node features, the window key alone their window totals.
    """
    rows = _sides(edges).where(F.col("node_type") == selected)
    slots = F.explode(F.array(_slot(actions, "action_type", 0), _slot(types, "other_type", 2 * len(actions))))
    return _vectors(
        rows.select(*by, slots.alias("slot")), by, F.count("*"), "frequencies", 2 * (len(actions) + len(types))
    )


def lifetime_features(nodes: DataFrame, selected: str = "Process") -> DataFrame:
    """Per window: lowest (never above the floor), highest and total lifetime of the selected nodes."""
    life = F.col("lifetime_ms")
    return nodes.where(F.col("node_type") == selected).groupBy(*KEY).agg(
        F.least(F.lit(float(FLOOR_LIFE)), F.min(life)).alias("min_life"), F.max(life).alias("max_life"),
        F.sum(life).alias("sum_life"),
    )


def neighbor_lifetime_by_type(
    edges: DataFrame, nodes: DataFrame, selected: str = "Process", by: Sequence[str] = (*KEY, "node"),
    types: Sequence[str] = tuple(NODE_TYPES),
) -> DataFrame:
    """Mean lifetime of out and in neighbours per type, 0 without any; per node or, by window key, per window."""
    rows = _sides(edges, nodes).where(F.col("node_type") == selected)
    slotted = rows.select(*by, _slot(types, "other_type", 0).alias("slot"), "other_life")
    return _vectors(slotted, by, F.avg("other_life"), "lifetimes", 2 * len(types))


def window_encoding(edges: DataFrame, nodes: DataFrame, level: str = "node", selected: str = "Process") -> DataFrame:
    """Frequencies, degrees, lifetimes and neighbour lifetimes in one vector per node or per window."""
    key = [*KEY, "node"] if level == "node" else KEY
    frequencies = type_frequency_features(edges, selected, key)
    neighbors = neighbor_lifetime_by_type(edges, nodes, selected, key)
    degrees = degree_features(edges, selected)
    if level == "node":
        numbers = [c for n in ("degree", "in_degree", "out_degree") for c in (F.col(n), F.col(n))]
        lives = nodes.where(F.col("node_type") == selected).select(*key, F.array_repeat("lifetime_ms", 3).alias("life"))
    else:
        degrees = window_degree_features(degrees)
        numbers = [F.col(f"{f}_{n}") for n in ("degree", "in_degree", "out_degree") for f in ("max", "mean")]
        lives = lifetime_features(nodes, selected).select(*key, F.array("min_life", "max_life", "sum_life").alias("life"))
    degrees = degrees.select(*key, F.array(*numbers).alias("degrees"))
    joined = frequencies.join(degrees, key).join(lives, key).join(neighbors, key)
    real = lambda c: F.col(c).cast("array<double>")
    return joined.select(*key, F.concat(real("frequencies"), real("degrees"), real("life"), real("lifetimes")).alias("encoding"))


def process_text_encoding(processes: DataFrame, dim: int, vectors: DataFrame | None = None) -> DataFrame:
    """Per window: mean image, parent and command vectors, account histogram and parent/child counts.

    ``processes``: window key, sid, image_path, parent_image_path and either image_vec, parent_vec, command_vec or, with ``vectors``
    (``text``, ``vec``, a row per text), command_line. A text's vector then meets the number of its rows in a window instead of the
    rows; a text without a vector counts as zeros.
    """
    counts = [sid_histogram("sid"), parent_child_user("parent_image_path", "image_path")]
    numbers = F.concat(*[c.cast("array<double>") for c in counts])
    if vectors is None:
        means = [mean_by_position(c, dim) for c in ("image_vec", "parent_vec", "command_vec")]
        return processes.groupBy(*KEY).agg(F.concat(*means, numbers).alias("encoding"))
    texts = ("image_path", "parent_image_path", "command_line")
    part = F.explode(F.array(*[F.struct(F.lit(n).alias("part"), F.col(c).alias("text")) for n, c in enumerate(texts)]))
    folded = processes.select(*KEY, part.alias("_p")).select(*KEY, "_p.*").groupBy(*KEY, "part", "text").agg(F.count("*").alias("n"))
    met = folded.join(vectors.select("text", "vec"), "text", "left").withColumn("vec", F.coalesce("vec", zeros(dim)))
    means = met.groupBy(*KEY, "part").agg(weighted_mean_by_position("vec", "n", dim).alias("_mean"))
    tall = means.unionByName(processes.groupBy(*KEY).agg(numbers.alias("_mean")).withColumn("part", F.lit(len(texts))))
    parts = [F.first(F.when(F.col("part") == n, F.col("_mean")), ignorenulls=True) for n in range(len(texts) + 1)]
    return tall.groupBy(*KEY).agg(F.concat(*parts).alias("encoding"))


def attach_window_features(edges: DataFrame, features: DataFrame, dim: int) -> DataFrame:
    """Vectors of both endpoints in the edge's bucket; zeros where there are none, with a 0/1 ``missing`` count."""
    for side in ("src", "dst"):
        own = features.select(F.col("node").alias(side), "bucket", F.col("vec").alias(f"{side}_vec"))
        edges = edges.join(own, [side, "bucket"], "left")
    missing = F.col("src_vec").isNull().cast("int") + F.col("dst_vec").isNull().cast("int")
    edges = edges.withColumn("missing", missing)
    for side in ("src", "dst"):
        edges = edges.withColumn(f"{side}_vec", F.coalesce(f"{side}_vec", zeros(dim)))
    return edges


def window_text_corpus(logs: DataFrame) -> DataFrame:
    """(text, node_type, action) rows: commands and parent paths of processes, file, new and module paths, and
    the image path of every event."""
    p = lambda name: F.col(f"properties.{name}")
    kind = F.col("object")
    own = F.concat(F.upper(F.substring("object", 1, 1)), F.lower(F.substring("object", 2, 100)))
    entry = lambda when, name, node: F.struct(
        F.when(when, p(name)).alias("text"), node.alias("node_type"), F.col("action").alias("action")
    )
    rows = F.array(
        entry(kind == "PROCESS", "command_line", F.lit("Process")),
        entry(kind == "PROCESS", "parent_image_path", F.lit("Process")),
        entry(kind == "FILE", "file_path", F.lit("File")), entry(kind == "FILE", "new_path", F.lit("File")),
        entry(kind == "MODULE", "module_path", F.lit("Module")), entry(F.lit(True), "image_path", own),
    )
    return logs.select(F.explode(rows).alias("_t")).select("_t.*").where("text is not null")
