"""Strictly-before neighbourhoods. A neighbour of a query at time t has interacted before t, never at t."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgetide.functions.vectors import brought, time_encode, zeros
from edgetide.operators.events import half_edges
from edgetide.plans.ordered import busy_keys, dealt, last_at_or_before, running_totals, slots, so_far, with_last_before
from edgetide.plans.sampling import draw, uniform
from edgetide.session import stored

ENTRY = ["neighbor", "ts_us", "idx"]
SIDES = 16  # shares of a side of an all-pairs join, so the most times a row of the other side is repeated


def _entries(struct: str, prefix: str = "") -> list[Column]:
    return [F.col(f"{struct}.{c}").alias(f"{prefix}{c}") for c in ENTRY]


def recent_neighbors(queries: DataFrame, edges: DataFrame, k: int = 20) -> DataFrame:
    """``queries`` (with ``node`` and ``ts_us``) plus ``recent``: the last k earlier interactions, oldest first."""
    halves = half_edges(edges).withColumn("nbr_ts_us", F.col("ts_us"))
    found = with_last_before(halves, queries, ["node"], "ts_us", ["neighbor", "nbr_ts_us"], k, tie=["idx"])
    items = F.transform("recent", lambda r: F.struct(r["neighbor"].alias("neighbor"), r["nbr_ts_us"].alias("ts_us"),
                                                     r["idx"].alias("idx")))
    return found.withColumn("recent", items)


def padded(recent, k: int) -> Column:
    """Neighbour ids left-padded with 0 to ``k``."""
    ids = F.transform(recent, lambda r: r["neighbor"])
    return F.concat(F.array_repeat(F.lit(0).cast("long"), F.lit(k) - F.size(ids)), ids)


def edge_queries(edges: DataFrame) -> DataFrame:
    """Two queries per edge: its source (side ``src``) and destination (``dst``) at the edge's time."""
    src = F.struct(F.lit("src").alias("side"), F.col("u").alias("node"))
    dst = F.struct(F.lit("dst").alias("side"), F.col("i").alias("node"))
    return edges.select("idx", "ts_us", F.explode(F.array(src, dst)).alias("_q")).select("idx", "ts_us", "_q.*")


def node_timeline(edges: DataFrame) -> DataFrame:
    """Half-edges numbered from 1 inside their node by (time, edge): ``spot``."""
    halves = half_edges(edges)
    return running_totals(halves, ["node"], ["ts_us", "idx", "neighbor"], {"spot": F.lit(1)})


def earlier_counts(queries: DataFrame, timeline: DataFrame) -> DataFrame:
    """``queries`` (node, ts_us) plus ``earlier``: interactions of the node strictly before the moment."""
    ends = timeline.groupBy("node", "ts_us").agg(F.max("spot").alias("earlier"))
    marks = ends.select("node", (F.col("ts_us") + 1).alias("at"), "earlier")  # visible from the next microsecond
    found = last_at_or_before(marks, queries.withColumn("at", F.col("ts_us")), ["node"], "at", ["earlier"])
    return found.drop("at").withColumn("earlier", F.coalesce("earlier", F.lit(0).cast("long")))


def asof_neighbors(queries: DataFrame, edges: DataFrame, share: int = 100_000) -> DataFrame:
    """Every interaction of the queried node strictly before the query, one row each, numbered by time.

    Time lines are cut into shares of ``share`` numbered interactions, or of one in ``SIDES`` of all interactions where that is more;
    a query is sent to the shares it covers. So a busy node is spread over several tasks, what is shuffled grows with queries and
    interactions, and only the result grows with their pairs.
    """
    numbered = node_timeline(edges)
    total = numbered.agg(F.count("*")).scalar()
    share = F.greatest(F.lit(share), F.ceil(total / F.lit(SIDES)))
    timeline = numbered.withColumn("_share", F.floor((F.col("spot") - 1) / share))
    counted = earlier_counts(queries, numbered).where("earlier > 0")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("earlier") - 1) / share)))
    items = timeline.select("node", "_share", "spot", "neighbor", F.col("ts_us").alias("nbr_ts_us"),
                            F.col("idx").alias("nbr_idx"))
    key = ["node", "_share"]
    joined = dealt(counted.withColumn("_share", parts), *key).join(dealt(items, *key), key)
    return joined.where(F.col("spot") <= F.col("earlier")).drop("_share", "earlier")


def uniform_neighbors(queries: DataFrame, edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k draws with replacement among earlier interactions; one row per draw, none without history.

    ``queries`` needs ``qid``. Draws point at numbered spots of the time line, so the join key is
    (node, spot) and a busy node's lookups are spread over all its spots.
    """
    timeline = node_timeline(edges)
    counted = earlier_counts(queries, timeline).where("earlier > 0")
    draws = counted.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(
        "spot", F.pmod(draw(seed, "qid", "j"), "earlier") + 1
    )
    items = timeline.select("node", "spot", "neighbor", F.col("ts_us").alias("nbr_ts_us"), F.col("idx").alias("nbr_idx"))
    return draws.join(items, ["node", "spot"]).drop("earlier")


def weighted_timeline(edges: DataFrame, scaling: float = 1e-6) -> DataFrame:
    """``node_timeline`` with each interaction's ``_mass`` and the running ``_upto`` of its node.

    An interaction's weight is exp(scaling * (t - node's last t)) over the running sum of those terms (t in
    seconds); its mass is the exponential of the weight, so draws proportional to mass follow the softmax of the weights.
    """
    halves = half_edges(edges).where("node is not null")
    busy = busy_keys(["node"], halves)
    near = _near_weights(halves if busy is None else halves.where(~busy), scaling)
    return stored(near if busy is None else near.unionByName(_placed_weights(halves.where(busy), scaling)))


LINE_ORDER = ["ts_us", "idx", "neighbor"]
WEIGHTED = ["node", *LINE_ORDER, "spot", "_mass", "_upto"]


def _term(scaling: float) -> Column:
    return F.exp(F.lit(scaling) * (F.col("ts_us") - F.col("_final")) / 1e6)


def _mass() -> Column:
    return F.when(F.col("_sum") > 0, F.exp(F.col("_term") / F.col("_sum"))).otherwise(F.lit(0.0))


def _near_weights(halves: DataFrame, scaling: float) -> DataFrame:
    """``weighted_timeline`` of nodes that are not busy: one shuffle and one sort, nothing stored on the way."""
    window = so_far(["node"], LINE_ORDER)
    line = halves.withColumn("_final", F.max("ts_us").over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    total = lambda c: F.lit(0) + F.sum(c).over(window)
    line = line.withColumn("_term", _term(scaling)).select("*", total("_term").alias("_sum"), total(F.lit(1)).alias("spot"))
    return line.withColumn("_mass", _mass()).withColumn("_upto", total("_mass")).select(*WEIGHTED)


def _placed_weights(halves: DataFrame, scaling: float) -> DataFrame:
    final = halves.groupBy("node").agg(F.max("ts_us").alias("_final"))
    terms = running_totals(halves.join(final, "node").withColumn("_term", _term(scaling)), ["node"], LINE_ORDER,
                           {"_sum": F.col("_term"), "spot": F.lit(1)})
    return running_totals(terms.withColumn("_mass", _mass()), ["node"], LINE_ORDER, {"_upto": F.col("_mass")}).select(*WEIGHTED)


def _earlier_mass(line: DataFrame, queries: DataFrame) -> DataFrame:
    """``queries`` (node, ts_us) plus the mass and number of strictly earlier interactions."""
    ends = line.groupBy("node", "ts_us").agg(F.max("_upto").alias("_total"), F.max("spot").alias("earlier"))
    marks = ends.select("node", (F.col("ts_us") + 1).alias("at"), "_total", "earlier")
    return last_at_or_before(marks, queries.withColumn("at", F.col("ts_us")), ["node"], "at", ["_total", "earlier"]).drop("at")


def _intervals(line: DataFrame) -> DataFrame:
    """Each interaction at the start of its interval of the node's running mass."""
    return line.where("_mass > 0").select(
        "node", (F.col("_upto") - F.col("_mass")).alias("at"), "spot", "neighbor", F.col("ts_us").alias("nbr_ts_us"), F.col("idx").alias("nbr_idx"))


def time_aware_neighbors(queries: DataFrame, edges: DataFrame, k: int, scaling: float = 1e-6, seed: int = 0) -> DataFrame:
    """k draws with replacement, later interactions preferred (see ``weighted_timeline``).

    Each interaction owns an interval of the running mass and a draw picks the interval it falls into.
    """
    line = weighted_timeline(edges, scaling)
    draws = _earlier_mass(line, queries).where("_total > 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    draws = draws.withColumn("at", uniform(seed, "qid", "j") * F.col("_total")).drop("_total")
    found = last_at_or_before(_intervals(line), draws, ["node"], "at", ["neighbor", "nbr_ts_us", "nbr_idx"])
    return found.drop("at", "earlier")


STRATEGIES = ("recent", "uniform", "time_aware")


class Sampler(NamedTuple):
    """How a hop picks ``k`` neighbours: the ``recent`` ones, or draws with replacement from the stored time lines ``line``."""

    edges: DataFrame
    strategy: str
    k: int
    seed: int
    line: DataFrame | None


def sampler(edges: DataFrame, k: int, strategy: str = "recent", scaling: float = 1e-6, seed: int = 0) -> Sampler:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    line = None if strategy == "recent" else node_timeline(edges) if strategy == "uniform" else weighted_timeline(edges, scaling)
    return Sampler(edges, strategy, k, seed, line)


def _near_draws(line: DataFrame, frontier: DataFrame, k: int, seed: int) -> DataFrame:
    """Time-aware draws from nodes that are not busy: a row of ``frontier`` for each draw ``_j``, with what it hits.

    Rows meet their node's line once: sorted by time to see the mass before a row's moment, then, in the same task, by running mass.
    """
    others = [c for c in frontier.columns if c not in ("node", "ts_us")]
    points = line.select("node", "ts_us", F.lit(1).alias("_kind"), "spot", "neighbor", "idx", "_mass", "_upto")
    asks = frontier.select("node", "ts_us", F.lit(0).alias("_kind"), F.struct(*others).alias("_row"))
    rows = dealt(points.unionByName(asks, allowMissingColumns=True), "node")
    total = F.last("_upto", ignorenulls=True).over(so_far(["node"], ["ts_us", "_kind", "spot"]))  # a row before the points of its moment
    is_ask = F.col("_kind") == 0
    seen = rows.withColumn("_total", total).where((is_ask & (F.col("_total") > 0)) | (~is_ask & (F.col("_mass") > 0)))
    number = F.when(is_ask, F.sequence(F.lit(0), F.lit(k - 1))).otherwise(F.array(F.lit(0)))
    drawn = uniform(seed, "_row.qid", F.array_join("_row.walk", ","), "_j") * F.col("_total")
    spread = seen.withColumn("_j", F.explode(number)).withColumn("_at", F.when(is_ask, drawn).otherwise(F.col("_upto") - F.col("_mass")))
    point = F.when(~is_ask, F.struct("spot", "neighbor", F.col("ts_us").alias("nbr_ts_us"), F.col("idx").alias("nbr_idx")))
    hit = F.last(point, ignorenulls=True).over(so_far(["node"], ["_at", F.col("_kind").desc()]))
    found = spread.withColumn("_hit", hit).where(is_ask)
    own = [F.col(c) if c in ("node", "ts_us") else F.col(f"_row.{c}").alias(c) for c in frontier.columns]
    return found.select(*own, "_j", "_hit.*")


def next_hop(frontier: DataFrame, pick: Sampler, local: bool = False) -> DataFrame:
    """One hop from every row of ``frontier`` (qid, walk, node, ts_us, ...): a row per neighbour found, with its ``place``.

    ``walk`` holds the places taken so far; a place is the neighbour's position, by time, among the k. Rows whose node has
    no earlier interaction end. Draws are a function of the seed, the query, the walk and their number. ``local`` says that rows of
    one (qid, walk) stand at one node.
    """
    k = pick.k
    if pick.strategy == "recent":
        found = recent_neighbors(frontier, pick.edges, k).where("recent is not null").withColumn("_n", F.size("recent"))
        rows = found.select(*frontier.columns, "_n", F.posexplode("recent").alias("_p", "_r"))
        place = (F.lit(k) - F.col("_n") + F.col("_p")).cast("int")  # lists are padded on the left
        return rows.select(*frontier.columns, place.alias("place"), F.col("_r.neighbor").alias("neighbor"),
                           F.col("_r.ts_us").alias("nbr_ts_us"), F.col("_r.idx").alias("nbr_idx"))
    asked = frontier.select("node", "ts_us").distinct()
    keys = ["qid", F.array_join("walk", ","), "_j"]
    number = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    if pick.strategy == "uniform":
        counted = earlier_counts(asked, pick.line).where("earlier > 0")
        draws = frontier.join(counted, ["node", "ts_us"]).withColumn("_j", number)
        draws = draws.withColumn("spot", F.pmod(draw(pick.seed, *keys), "earlier") + 1)
        items = pick.line.select("node", "spot", "neighbor", F.col("ts_us").alias("nbr_ts_us"), F.col("idx").alias("nbr_idx"))
        found = draws.join(items, ["node", "spot"])
    else:
        busy = busy_keys(["node"], pick.line, frontier)
        found = _near_draws(pick.line if busy is None else pick.line.where(~busy), frontier if busy is None else frontier.where(~busy), k, pick.seed)
        if busy is not None:
            counted = _earlier_mass(pick.line.where(busy), asked.where(busy)).where("_total > 0").select("node", "ts_us", "_total")
            draws = frontier.where(busy).join(counted, ["node", "ts_us"]).withColumn("_j", number)
            draws = draws.withColumn("at", uniform(pick.seed, *keys) * F.col("_total")).drop("_total")
            far = last_at_or_before(_intervals(pick.line.where(busy)), draws, ["node"], "at", ["spot", "neighbor", "nbr_ts_us", "nbr_idx"])
            found = found.unionByName(far.drop("at"))
    by_time = Window.partitionBy(*["node"] * local, "qid", "walk").orderBy("spot", "_j")  # k draws
    placed = found.withColumn("place", (F.row_number().over(by_time) - 1).cast("int"))
    return placed.select(*frontier.columns, "place", "neighbor", "nbr_ts_us", "nbr_idx")


def _one_node_each(queries: DataFrame) -> bool:
    """Whether all rows of a ``qid`` stand at one node; what follows from there does so by its walk."""
    return queries.groupBy("qid").agg(F.min("node").alias("_a"), F.max("node").alias("_b")).where("_a <> _b").isEmpty()


def _roots(queries: DataFrame) -> DataFrame:
    return queries.select("qid", "node", "ts_us", F.array().cast("array<int>").alias("walk"))


def multi_hop_neighbors(
    queries: DataFrame, edges: DataFrame, hops: int, k: int, strategy: str = "recent", scaling: float = 1e-6, seed: int = 0
) -> DataFrame:
    """One row per (query, path of places): hop n+1 asks for the neighbour found at hop n at its own time.

    ``queries`` needs ``qid``. ``hop`` counts from 1, ``walk`` holds the places taken (0 oldest); padding
    rows are left out. Each hop takes the most recent neighbours, or draws uniformly or by time (see ``next_hop``).
    """
    pick, current, out = sampler(edges, k, strategy, scaling, seed), _roots(queries), None
    local = strategy == "time_aware" and _one_node_each(queries)
    for hop in range(1, hops + 1):
        found = next_hop(current, pick, local or hop > 1).select(
            "qid", F.concat("walk", F.array("place")).alias("walk"), "neighbor", F.col("nbr_ts_us").alias("ts_us"), F.col("nbr_idx").alias("idx"))
        level = (found if hop == hops else stored(found)).withColumn("hop", F.lit(hop))
        out = level if out is None else out.unionByName(level)
        current = level.select("qid", F.col("neighbor").alias("node"), "ts_us", "walk")
    return out


def temporal_walks(
    queries: DataFrame, edges: DataFrame, hops: int, k: int, strategy: str = "recent", scaling: float = 1e-6, seed: int = 0
) -> DataFrame:
    """Root-first walks of exactly ``hops`` steps, one row each, as arrays of nodes and times; steps as in ``next_hop``."""
    pick = sampler(edges, k, strategy, scaling, seed)
    local = strategy == "time_aware" and _one_node_each(queries)
    # ``nodes`` and ``times`` are those left behind
    path = _roots(queries).withColumns({"nodes": F.array().cast("array<long>"), "times": F.array().cast("array<long>")})
    for hop in range(1, hops + 1):
        found = next_hop(path, pick, local or hop > 1).select(
            "qid", F.concat("walk", F.array("place")).alias("walk"), F.col("neighbor").alias("node"), F.col("nbr_ts_us").alias("ts_us"),
            F.concat("nodes", F.array("node")).alias("nodes"), F.concat("times", F.array("ts_us")).alias("times"))
        # stored where the next hop counts and reads it
        path = stored(found) if strategy == "time_aware" and hop < hops else found
    return path.select("qid", F.concat("nodes", F.array("node")).alias("nodes"), F.concat("times", F.array("ts_us")).alias("times"))


def landing_probability(edges: DataFrame, hops: int, k: int, targets: DataFrame | None = None) -> DataFrame:
    """Per edge, node and hop: share of the k**hop places the node takes in the walks of each side.

    Padding takes the remaining places and has no row.
    """
    asked = edge_queries(edges if targets is None else targets)
    queries = asked.withColumn("qid", F.struct("idx", "side"))
    reached = multi_hop_neighbors(queries, edges, hops, k).select(
        F.col("qid.idx").alias("qidx"), F.col("qid.side").alias("side"), F.col("neighbor").alias("node"), "hop"
    )
    roots = asked.select(F.col("idx").alias("qidx"), "side", "node", F.lit(0).alias("hop"))
    share = lambda side: F.sum(
        F.when(F.col("side") == side, F.pow(F.lit(float(k)), -F.col("hop"))).otherwise(F.lit(0.0))
    )
    return reached.unionByName(roots).groupBy("qidx", "node", "hop").agg(
        share("src").alias("from_src"), share("dst").alias("from_dst")
    )


def neighbor_cooccurrence(edges: DataFrame, length: int, targets: DataFrame | None = None) -> DataFrame:
    """Per edge and node of either list: appearances in the source's and in the destination's list.

    A list is the node itself followed by its most recent ``length - 1`` earlier neighbours.
    """
    asked = edge_queries(edges if targets is None else targets)
    found = recent_neighbors(asked, edges, length - 1)
    ids = F.transform("recent", lambda r: r["neighbor"])
    members = F.concat(F.array("node"), F.coalesce(ids, F.array().cast("array<long>")))
    rows = found.select("idx", "side", F.explode(members).alias("neighbor"))
    count = lambda side: F.sum((F.col("side") == side).cast("long"))
    return rows.groupBy("idx", "neighbor").agg(count("src").alias("in_src"), count("dst").alias("in_dst"))


def neighbor_mean(
    queries: DataFrame, edges: DataFrame, vectors: DataFrame, dim: int, gap: int = 2000, divisor: str = "valid"
) -> DataFrame:
    """Own vector plus the mean vector of the last ``gap`` earlier neighbours (zeros without any).

    ``queries`` needs ``qid``; ``vectors`` is (node, vec). ``divisor="padded"`` divides the mean once more by ``gap``.
    Running sums cannot lose a component that is not finite, so a neighbour whose vector has one (or a null) counts as
    one without vector.
    """
    finite = vectors.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).select(
        F.col("node").alias("neighbor"), F.col("vec").alias("_vec"))
    points = half_edges(edges)
    met = stored(finite.join(points.select("neighbor").distinct(), "neighbor", "left_semi"))
    asks = queries.select("qid", "node", "ts_us")
    # the places of a node's line are those of its interactions only if every neighbour has one vector
    alone = met.groupBy("neighbor").count().where("count > 1").isEmpty()
    busy = busy_keys(["node"], points, asks) if alone else F.lit(True)
    if busy is None:
        sums = _gap_sums(points, asks, met, dim, gap)
    else:
        sums = _placed_gap_sums(edges, asks.where(busy), points.where(busy), met, dim, gap)
        if alone:
            sums = sums.unionByName(_gap_sums(points.where(~busy), asks.where(~busy), met, dim, gap))
    scale = F.col("_n") * F.lit(gap) if divisor == "padded" else F.col("_n")
    mean = F.coalesce(F.transform("_sum", lambda x: x / scale), zeros(dim))
    used = stored(vectors.join(asks.select("node").distinct(), "node", "left_semi"))
    own = queries.join(sums, "qid", "left").join(brought(used, dim), "node", "left")
    total = F.zip_with(F.coalesce("vec", zeros(dim)), mean, lambda a, b: a + b)
    return own.select(*queries.columns, total.alias("vec"))


def _running_vectors(dim: int, window) -> tuple[list[Column], Column]:
    """Columns with the number of known vectors and the sum of each component so far, and the array of the sums."""
    names = [f"_s{n}" for n in range(dim)]
    known = F.sum(F.col("_vec").isNotNull().cast("long")).over(window).alias("_known")
    sums = [F.sum(F.coalesce(F.col("_vec")[n], F.lit(0.0))).over(window).alias(name) for n, name in enumerate(names)]
    return [known, *sums], F.array(*names).cast("array<double>")


def _gap_sums(points: DataFrame, asks: DataFrame, met: DataFrame, dim: int, gap: int) -> DataFrame:
    """(qid, _sum, _n): sum and number of the vectors of the last ``gap`` neighbours, for nodes that are not busy.

    Only ids move: vectors come to a node's sorted rows, where the sums are made, if they fit every task.
    """
    # a query without a time sees the interactions without one
    kind = F.when(F.col("ts_us").isNull(), 2).otherwise(0)
    both = points.withColumn("_kind", F.lit(1)).unionByName(asks.withColumn("_kind", kind), allowMissingColumns=True)
    rows = dealt(both, "node").join(brought(met, dim), "neighbor", "left")
    window, is_point = so_far(["node"], ["ts_us", "_kind", "idx", "neighbor"]), F.col("_kind") == 1
    totals, sums = _running_vectors(dim, window)
    placed = rows.select("qid", "node", "_kind", F.count(F.when(is_point, 1)).over(window).alias("_places"), *totals)
    line = placed.select("qid", "node", "_kind", "_known", sums.alias("_sums"), slots(F.col("_places"), is_point).alias("_slot"))
    # of the rows so many places back, the one that is a point
    back = Window.partitionBy("node").orderBy("_slot").rangeBetween(-2 * gap - 1, -2 * gap)
    ends = line.withColumn("_start", F.first(F.when(is_point, F.struct("_known", "_sums")), ignorenulls=True).over(back))
    return _difference(ends.where("_kind <> 1 and node is not null").withColumn("_end", F.struct("_known", "_sums")), dim)


def _difference(ends: DataFrame, dim: int) -> DataFrame:
    known = F.col("_end._known") - F.coalesce("_start._known", F.lit(0))
    # vectors of a node without earlier neighbours, or only unknown ones, stay as they are
    summed = F.zip_with(F.col("_end._sums"), F.coalesce("_start._sums", zeros(dim)), lambda x, y: x - y)
    return ends.select("qid", summed.alias("_sum"), known.alias("_n")).where("_n > 0")


def _placed_gap_sums(edges: DataFrame, asks: DataFrame, points: DataFrame, met: DataFrame, dim: int, gap: int) -> DataFrame:
    """As ``_gap_sums``, for busy nodes: the sum over a gap is a difference of two rows of the node's line of running totals."""
    names = [f"_s{n}" for n in range(dim)]
    parts = {"spot": F.lit(1), "_known": F.col("_vec").isNotNull().cast("long")}
    parts |= {name: F.coalesce(F.col("_vec")[n], F.lit(0.0)) for n, name in enumerate(names)}
    line = running_totals(points.join(met, "neighbor", "left"), ["node"], ["ts_us", "idx", "neighbor"], parts)
    line = line.select("node", "spot", "_known", F.array(*names).alias("_sums"))

    def at(spot: str, name: str) -> DataFrame:
        return line.select("node", F.col("spot").alias(spot), F.struct("_known", "_sums").alias(name))

    counted = earlier_counts(asks, node_timeline(edges)).where("earlier > 0")
    counted = counted.select("qid", "node", "earlier", (F.col("earlier") - gap).alias("_before"))
    ends = counted.join(at("earlier", "_end"), ["node", "earlier"]).join(at("_before", "_start"), ["node", "_before"], "left")
    return _difference(ends, dim)


def neighbor_time_features(
    queries: DataFrame, edges: DataFrame, features: DataFrame, k: int = 20, dim: int = 100
) -> DataFrame:
    """Per query and recent neighbour: time since the interaction (seconds), its encoding, its edge features."""
    found = recent_neighbors(queries, edges, k)
    rows = found.select("qid", F.col("ts_us").alias("_at"), F.posexplode("recent").alias("place", "_r"))
    delta = (F.col("_at") - F.col("_r.ts_us")) / 1e6
    timed = rows.select(
        "qid", "place", F.col("_r.neighbor").alias("neighbor"), F.col("_r.idx").alias("idx"), delta.alias("delta_t")
    )
    return timed.withColumn("encoding", time_encode("delta_t", dim)).join(features, "idx", "left")


def node_recency(edges: DataFrame) -> DataFrame:
    """Per edge and side: seconds since the node's previous interaction (null for its first)."""
    asked = edge_queries(edges)
    found = recent_neighbors(asked, edges, 1)
    return found.select(
        "idx", "side", "node", ((F.col("ts_us") - F.get("recent", F.lit(0))["ts_us"]) / 1e6).alias("recency")
    )


def time_shift_stats(edges: DataFrame) -> DataFrame:
    """Mean and population deviation of seconds since a node's previous edge in the same role (0 before the first)."""
    rows = edges.select("idx", "ts_us", F.explode(F.array(
        F.struct(F.lit("src").alias("role"), F.col("u").alias("node")),
        F.struct(F.lit("dst").alias("role"), F.col("i").alias("node")),
    )).alias("_r")).select("idx", "ts_us", "_r.*")
    found = with_last_before(rows, rows, ["role", "node"], "idx", ["ts_us"], 1)
    shifts = found.select(
        "role", ((F.col("ts_us") - F.coalesce(F.get("recent", F.lit(0))["ts_us"], F.lit(0))) / 1e6).alias("shift")
    )
    return shifts.groupBy("role").agg(F.avg("shift").alias("mean_shift"), F.stddev_pop("shift").alias("std_shift"))


def last_message(edges: DataFrame, by: str = "batch") -> DataFrame:
    """Per batch and node: the latest edge that touched it and its time."""
    rows = half_edges(edges, by)
    return rows.groupBy(by, "node").agg(
        F.max_by("neighbor", F.struct("ts_us", "idx", "neighbor")).alias("last_neighbor"),
        F.max(F.struct("ts_us", "idx")).alias("_l"),
    ).select(by, "node", "last_neighbor", F.col("_l.ts_us").alias("last_ts_us"), F.col("_l.idx").alias("last_idx"))


def prev_next_event(edges: DataFrame, actions: DataFrame, queries: DataFrame) -> DataFrame:
    """Previous and next action of the queried node and the gaps, for incoming and outgoing edges.

    ``queries`` needs ``qid, node, ts_us``. A direction where either event is missing has zero gaps and no
    actions (null); ``one_hot`` over the action vocabulary turns them into vectors.
    """
    # stored, as both passes count and read it
    rows = stored(edges.join(actions.select("idx", "action_type"), "idx").select(
        "idx", "ts_us", "action_type", F.explode(F.array(
            F.struct(F.lit("out").alias("direction"), F.col("u").alias("node")),
            F.struct(F.lit("in").alias("direction"), F.col("i").alias("node")),
        )).alias("_r")
    ).select("idx", "ts_us", "action_type", "_r.*"))
    asked = queries.withColumn("direction", F.explode(F.array(F.lit("in"), F.lit("out"))))
    keys, out = ["direction", "node"], asked
    for name, sign in (("prev", 1), ("next", -1)):
        line = rows.select(*keys, (F.col("ts_us") * sign).alias("at"), F.col("ts_us").alias("when"), "action_type",
                           (F.col("idx") * sign).alias("tie"))
        ask = out.withColumn("at", F.col("ts_us") * sign)
        out = with_last_before(line, ask, keys, "at", ["action_type", "when"], 1, tie=["tie"], name=name).drop("at")
    prev, nxt = F.get("prev", F.lit(0)), F.get("next", F.lit(0))
    both = prev.isNotNull() & nxt.isNotNull()
    return out.select(
        "qid", "node", "direction",
        F.when(both, prev["action_type"]).alias("prev_action"), F.when(both, nxt["action_type"]).alias("next_action"),
        F.when(both, (F.col("ts_us") - prev["when"]) / 1e6).otherwise(0.0).alias("prev_gap"),
        F.when(both, (nxt["when"] - F.col("ts_us")) / 1e6).otherwise(0.0).alias("next_gap"),
    )


def first_contacts(edges: DataFrame) -> DataFrame:
    """Per ordered pair of neighbours (self loops included once): the first time they met."""
    return half_edges(edges).groupBy("node", "neighbor").agg(F.min("ts_us").alias("first_us"))


class TwoHop(NamedTuple):
    """Two-hop sets as rows; nothing in it is longer than the edges, their neighbours up to the limit, or the pairs.

    ``contacts`` (node, neighbor, first_us, place): everyone a node met, numbered from 1 in order. ``moments`` (u, ts_us, set_us):
    the moments of edges whose source has a set to look at, and the earliest moment with the very same set. ``reach``
    (u, set_us, known, rank, via, offers): the neighbours that are expanded; the node ``via`` offers its first ``offers``
    contacts, and the first ``known`` contacts of u are its direct neighbours.
    """

    contacts: DataFrame
    moments: DataFrame
    reach: DataFrame


def _stops(seen: DataFrame, need: int) -> DataFrame:
    """(node, at, stop): from the moment ``at`` on, neighbours up to rank ``stop`` offer ``need`` nodes together.

    ``seen`` (node, rank, far, from_us) holds at most ``max_neighbors * need`` rows per node. For growing ranks the ``need``
    earliest visible nodes are kept; a node that drops out can only come back with an earlier time of its own.
    """

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, rank, earliest, settled, out = None, None, {}, None, []

        def close() -> None:
            nonlocal settled
            if len(earliest) == need and (settled is None or max(earliest.values()) < settled):
                settled = max(earliest.values())
                out.append((node, settled + 1, rank))

        for batch in batches:
            for n, r, far, from_us in zip(batch["node"], batch["rank"], batch["far"], batch["from_us"]):
                if (n, r) != (node, rank):
                    close()
                    if n != node:
                        earliest, settled = {}, None
                    node, rank = n, r
                if settled is not None and from_us >= settled:
                    continue
                if from_us < earliest.get(far, from_us + 1):
                    earliest[far] = from_us
                    if len(earliest) > need:
                        del earliest[max(earliest, key=earliest.get)]
            yield pd.DataFrame(out, columns=["node", "at", "stop"])
            out = []
        close()
        yield pd.DataFrame(out, columns=["node", "at", "stop"])

    # the window makes Spark keep a node's rows together and in order; a bare repartition may be planned away
    dealt = seen.withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy("rank")))
    return dealt.mapInPandas(settle, "node long, at long, stop long")


def two_hop_sets(edges: DataFrame, max_neighbors: int = 100, stop_after: int = 20) -> TwoHop:
    """Which neighbours of u every edge expands, and how much each of them offers, over strictly earlier edges.

    A sampling operator: neighbours are taken in the order they were first met, at most ``max_neighbors`` of them, and expansion
    stops after the neighbour that brings the collected nodes above ``stop_after``; a neighbour offers all it met before the
    edge. Whether a neighbour is the last one can be told from its first ``stop_after + 1`` contacts alone, so moments at
    which the choice changes are found from rows of bounded number per node. Neighbours that met nobody but u offer nothing.
    """
    met = first_contacts(edges)
    contacts = running_totals(met, ["node"], ["first_us", "neighbor"], {"place": F.lit(1).cast("long")})
    sources = edges.select(F.col("u").alias("node")).distinct()
    near = contacts.where(F.col("place") <= max_neighbors).join(sources, "node", "left_semi").select(
        "node", F.col("place").alias("rank"), F.col("neighbor").alias("via"), F.col("first_us").alias("via_us"))
    first_offers = contacts.where(F.col("place") <= stop_after + 1).select(
        F.col("node").alias("via"), F.col("neighbor").alias("far"), F.col("first_us").alias("far_us"))
    seen = near.join(first_offers, "via").select("node", "rank", "far", F.greatest("via_us", "far_us").alias("from_us"))
    # at most ``max_neighbors`` changes a node
    stops = _stops(seen, stop_after + 1).groupBy("node", "at").agg(F.min("stop").alias("stop"))
    stops = stops.groupBy(F.col("node").alias("u")).agg(F.sort_array(F.collect_list(F.struct("at", "stop"))).alias("_stops"))

    marks = contacts.groupBy("node", (F.col("first_us") + 1).alias("at")).agg(F.max("place").alias("n"))
    social = marks.groupBy(F.col("node").alias("via")).agg(F.max("n").alias("_n")).where("_n > 1").select("via")
    useful = near.join(social, "via", "left_semi").select(F.col("node").alias("u"), "rank", "via", "via_us")
    asked = edges.select("u", "ts_us").distinct().join(stops, "u", "left")
    last = F.try_element_at(F.filter("_stops", lambda s: s["at"] <= F.col("ts_us")), F.lit(-1))["stop"]
    asked = asked.select("u", "ts_us", F.coalesce(last, F.lit(max_neighbors).cast("long")).alias("_stop"))
    expanded = stored(asked.join(useful, "u").where("rank <= _stop and via_us < ts_us").drop("via_us"))

    # how many contacts a node has at a moment, asked once for sources and neighbours together
    moments = expanded.select(F.explode(F.array("u", "via")).alias("node"), F.col("ts_us").alias("at")).distinct()
    counts = last_at_or_before(marks, moments, ["node"], "at", ["n"])
    of = lambda node, name: counts.select(F.col("node").alias(node), F.col("at").alias("ts_us"), F.col("n").alias(name))
    counted = expanded.join(of("via", "offers"), ["via", "ts_us"]).where("offers > 1").join(of("u", "known"), ["u", "ts_us"])
    counted = stored(counted.select("u", "ts_us", "known", "_stop", "rank", "via", "offers"))
    # counts only grow with time, so moments with equal counts have equal sets
    states = counted.groupBy("u", "ts_us", "known", "_stop").agg(F.sum("offers").alias("_offered"))
    alike = states.groupBy("u", "known", "_stop", "_offered").agg(F.min("ts_us").alias("set_us"))
    moments = stored(states.join(alike, ["u", "known", "_stop", "_offered"]).select("u", "ts_us", "set_us"))
    sets = moments.where("ts_us = set_us").select("u", "ts_us")
    reach = counted.join(sets, ["u", "ts_us"], "left_semi").withColumnRenamed("ts_us", "set_us")
    return TwoHop(contacts, moments, reach.drop("_stop"))


def two_hop_members(sets: TwoHop, reach: DataFrame | None = None, share: int = 100_000) -> DataFrame:
    """(u, set_us, far): the nodes of every set, without u and its direct neighbours.

    A busy node's contacts are read in shares of at most ``share`` rows, so they spread over many tasks.
    """
    part = lambda c: F.floor((F.col(c) - 1) / share)
    asked = (sets.reach if reach is None else reach).withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), part("offers"))))
    offered = sets.contacts.select(F.col("node").alias("via"), F.col("neighbor").alias("far"), "place", part("place").alias("_share"))
    far = asked.join(offered, ["via", "_share"]).where("place <= offers and far <> u").select("u", "set_us", "known", "far").distinct()
    direct = sets.contacts.select(F.col("node").alias("u"), F.col("neighbor").alias("far"), F.col("place").alias("_direct"))
    return far.join(direct, ["u", "far"], "left").where("_direct is null or _direct > known").select("u", "set_us", "far")


def two_hop_non_neighbors(edges: DataFrame, max_neighbors: int = 100, stop_after: int = 20) -> DataFrame:
    """Per edge: the sorted list of its two-hop set (see ``two_hop_sets``), empty where there is none.

    The list is the result's format: as long as the contacts of the last expanded neighbour. Sets are worked out once for
    all moments that share them.
    """
    sets = two_hop_sets(edges, max_neighbors, stop_after)
    lists = two_hop_members(sets).groupBy("u", "set_us").agg(F.sort_array(F.collect_list("far")).alias("_list"))
    found = edges.select("idx", "u", "i", "ts_us").join(sets.moments, ["u", "ts_us"], "left").join(lists, ["u", "set_us"], "left")
    none = F.array().cast("array<bigint>")
    return found.select("idx", "u", "i", "ts_us", F.coalesce("_list", none).alias("two_hop_non_neighbors"))


def two_hop_candidates(queries: DataFrame, sets: TwoHop) -> DataFrame:
    """(idx, far): the two-hop nodes of each queried edge (idx, u, ts_us), one row each."""
    asked = queries.select("idx", "u", "ts_us").join(sets.moments, ["u", "ts_us"])
    wanted = sets.reach.join(asked.select("u", "set_us").distinct(), ["u", "set_us"], "left_semi")
    return asked.join(two_hop_members(sets, wanted), ["u", "set_us"]).select("idx", "far")
