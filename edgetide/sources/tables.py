"""Graph tables, interaction files, score tables, reports and their checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.plans.ordered import next_row

GRAPH_TABLES = ("edges", "edge_features", "nodes", "corpus")


def write_tables(tables: dict[str, DataFrame], folder: str, format: str = "parquet", by: Sequence[str] = ()) -> None:
    """One sub-folder per table; ``by`` partitions the files of tables having those columns."""
    for name, table in tables.items():
        writer = table.write.mode("overwrite").format(format)
        if format == "csv":  # empty and missing texts stay apart
            writer = writer.option("header", True).option("escape", '"').option("nullValue", "\\N")
        keys = [c for c in by if c in table.columns]
        (writer.partitionBy(*keys) if keys else writer).save(f"{folder}/{name}")


# what the graph tables hold, for formats that do not say so themselves
GRAPH_COLUMNS = {
    "edges": "u LONG, i LONG, ts_us LONG, label INT, idx LONG", "edge_features": "idx LONG, action_type STRING, command_line STRING",
    "nodes": "node_id LONG, object_type STRING, path STRING", "corpus": "text STRING",
}


def write_graph(tables: dict[str, DataFrame], folder: str, format: str = "parquet") -> None:
    """Graph tables of ``build_graph`` by host: one folder per host in each table. Rows are dealt to files by host and a
    hash of the row, so a busy host is several files, and a task writes few."""
    for name, table in tables.items():
        spread = table.repartition("hostname", F.pmod(F.xxhash64(*[c for c in table.columns if c != "hostname"]), F.lit(16)))
        write_tables({name: spread}, folder, format, by=("hostname",))


def read_tables(
    spark: SparkSession, folder: str, names: Sequence[str] = GRAPH_TABLES, format: str = "parquet", hosts: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """The tables of ``write_tables``; of tables by host, only the folders of ``hosts`` are read if they are given."""
    found = {}
    for name in names:
        reader = spark.read.format(format)
        if format == "csv":
            reader = reader.option("header", True).option("escape", '"').option("nullValue", "\\N").option("multiLine", True)
            reader = reader.option("mode", "FAILFAST").schema(f"{GRAPH_COLUMNS[name]}, hostname STRING" if hosts is not None else GRAPH_COLUMNS[name])
        table = reader.load(f"{folder}/{name}")
        found[name] = table if hosts is None else table.where(F.col("hostname").isin([h.lower() for h in hosts]))
    return found


def read_interactions_csv(spark: SparkSession, path: str, features: int) -> DataFrame:
    """``u,i,ts,label,f1..fn`` with a header line, features as one array."""
    names = [f"f{n + 1}" for n in range(features)]
    schema = ", ".join(["u LONG", "i LONG", "ts DOUBLE", "label INT", *[f"{n} DOUBLE" for n in names]])
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    vector = F.array(*names) if names else F.array().cast("array<double>")
    return rows.select("u", "i", F.round(F.col("ts") * 1_000_000).cast("long").alias("ts_us"), "label",
                       vector.alias("features"))


def time_order_violations(rows: DataFrame, order: Sequence[str], ts: str = "ts_us") -> DataFrame:
    """Number of rows, in file order, whose time lies before the previous row's."""
    following = next_row(rows.select(*dict.fromkeys([*order, ts])), [], list(order), {"_following": ts})
    return following.agg(F.coalesce(F.sum((F.col("_following") < F.col(ts)).cast("long")), F.lit(0)).alias("violations"))


def write_scores(scores: DataFrame, folder: str) -> None:
    """Scored links with ``split`` and ``negative_source`` columns, partitioned by both."""
    scores.write.mode("overwrite").partitionBy("split", "negative_source").parquet(folder)


def read_scores(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    scores = spark.read.parquet(folder)
    return scores.where(F.col("split") == split) if split else scores


def write_report(metrics: DataFrame, folder: str) -> None:
    """A report is a table of a few rows; it is written as JSON lines in one file."""
    metrics.repartition(1).write.mode("overwrite").json(folder)


def table_profile(edges: DataFrame, nodes: DataFrame, node_vector: str | None = None,
                  edge_vector: str | None = None) -> DataFrame:
    """Nodes, edges and feature widths of one dataset, in one row."""
    width = lambda column: F.coalesce(F.max(F.size(column)), F.lit(0)) if column else F.lit(0)
    counted_nodes = nodes.agg(F.struct(F.count("*").alias("n"), width(node_vector).alias("d"))).scalar()
    return edges.agg(F.count("*").alias("num_edges"), width(edge_vector).cast("int").alias("edge_dim")).select(
        counted_nodes["n"].alias("num_nodes"), "num_edges", counted_nodes["d"].cast("int").alias("node_dim"), "edge_dim"
    )


def assert_tables_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows found on one side only, counted: ``only_left`` and ``only_right`` (duplicates matter)."""
    columns = left.columns
    sides = [(left, 1), (right, -1)]
    tagged = reduce(DataFrame.unionByName, [t.select(*columns, F.lit(s).alias("_side")) for t, s in sides])
    balance = tagged.groupBy(*columns).agg(F.sum("_side").alias("_balance"))
    return balance.agg(
        F.coalesce(F.sum(F.greatest("_balance", F.lit(0))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("_balance"), F.lit(0))), F.lit(0)).alias("only_right"),
    )


def compare_features(left: DataFrame, right: DataFrame, vector: str) -> DataFrame:
    """One row on two tables' feature vectors: width, rows, smallest and largest value of each, and whether all agree.

    Widths are the widest vectors'; a table without vectors has width 0 and no values.
    """
    facts = lambda table: table.agg(
        F.count(vector).alias("rows"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("width"),
        F.min(F.array_min(vector)).cast("double").alias("low"), F.max(F.array_max(vector)).cast("double").alias("high"))
    both = facts(left).select([F.col(c).alias(f"left_{c}") for c in ("rows", "width", "low", "high")])
    other = facts(right).agg(F.first(F.struct("rows", "width", "low", "high"))).scalar()
    joined = both.withColumn("_o", other).select("*", *[F.col(f"_o.{c}").alias(f"right_{c}") for c in ("rows", "width", "low", "high")]).drop("_o")
    same = [F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}")) for c in ("rows", "width", "low", "high")]
    return joined.withColumn("equal", reduce(and_, same).cast("int"))
