"""Structured Streaming versions of the window, novelty, node state and alerting operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from edgetide.operators import conformal
from edgetide.plans.ordered import next_row
from edgetide.schema import BATCH
from edgetide.session import scratch_folder, stored

OPEN = "hostname string, start_us long, edges long, labels long, first_us long, last_us long, watermark long"
HEADS = "node long, idx long, first_us long, last_us long, source_batch long, clock_us long"
STATES = "stream string, level double, seen long, missed long"
ALERTS = "stream string, idx long, level double, threshold double, alert int"
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tumbling_window_edges(stream: DataFrame, minutes: int = 15, lateness: str = "1 hour") -> DataFrame:
    """Events, labels and time bounds per host and window of event time.

    Windows are aligned to the clock; an event later than ``lateness`` behind the newest one is dropped, and the last windows
    stay open. ``window_edges`` keeps both. ``stream`` needs hostname, ts (timestamp), label.
    """
    windowed = stream.withWatermark("ts", lateness).groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "hostname")
    return windowed.agg(
        F.count("*").alias("edges"), F.sum("label").alias("labels"), F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    ).select("hostname", F.col("w.start").alias("window_start"), "edges", "labels", "first_ts", "last_ts")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hostname", "start_us").agg(
        F.sum("edges").alias("edges"), F.sum("labels").alias("labels"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def window_edges(stream: DataFrame, folder: str, minutes: int = 15, lateness_ms: int = 3_600_000) -> StreamingQuery:
    """Starts counting events, labels and time bounds per host and clock window of ``stream`` (hostname, ts, label), losing none.

    The watermark stands ``lateness_ms`` behind the newest event of all earlier micro-batches. It is the timer: once it reaches
    a window's end, the window is closed and written to ``windows``. An event whose window was closed before its
    micro-batch, or that has no time, goes to the side table ``late`` as it is. What is open is a table of one row per host and open window, which
    every micro-batch folds into its own partial sums. All tables are per micro-batch, so a repeated one overwrites itself.
    """
    spark, length = stream.sparkSession, minutes * 60_000_000

    def step(events: DataFrame, batch_id: int) -> None:
        timed = events.withColumn("_us", F.unix_micros("ts")).withColumn("_start", F.col("_us") - F.pmod("_us", F.lit(length)))
        if batch_id:
            before = spark.read.schema(OPEN).parquet(f"{folder}/open/{batch_id - 1}")
            reached = before.agg(F.max("watermark")).scalar()
        else:
            before, reached = spark.createDataFrame([], OPEN), F.lit(None).cast("long")
        timed = stored(timed.withColumn("_reached", reached))
        is_late = F.col("ts").isNull() | F.coalesce(F.col("_start") + length <= F.col("_reached"), F.lit(False))
        timed.where(is_late).drop("_us", "_start", "_reached").write.mode("overwrite").parquet(f"{folder}/late/batch_id={batch_id}")
        fresh = timed.where(~is_late).select(
            "hostname", F.col("_start").alias("start_us"), F.lit(1).cast("long").alias("edges"), F.col("label").cast("long").alias("labels"),
            F.col("_us").alias("first_us"), F.col("_us").alias("last_us"))
        kept = before.where("start_us is not null").select(*fresh.columns)
        newest = timed.agg(F.greatest(F.max("_us") - lateness_ms * 1000, F.max("_reached"))).scalar()
        carried = before.agg(F.max("watermark")).scalar()  # an empty micro-batch moves nothing
        windows = stored(_summed(fresh.unionByName(kept)).withColumn("watermark", F.coalesce(newest, carried)))
        closed = F.coalesce(F.col("start_us") + length <= F.col("watermark"), F.lit(False))
        windows.where(closed).drop("watermark").write.mode("overwrite").parquet(f"{folder}/windows/batch_id={batch_id}")
        # one row without window carries the watermark even if nothing is open
        mark = spark.range(1).select(
            *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in OPEN.split(", ")[:-1]], F.coalesce(newest, carried).alias("watermark"))
        windows.where(~closed).unionByName(mark).write.mode("overwrite").parquet(f"{folder}/open/{batch_id}")

    return stream.writeStream.foreachBatch(step).trigger(availableNow=True).option("checkpointLocation", f"{folder}/progress").start()


def flush_windows(spark: SparkSession, folder: str, last_batch: int) -> DataFrame:
    """All windows of an ended stream: those closed by the watermark and those open after its last micro-batch."""
    closed = spark.read.schema(f"{OPEN.rpartition(',')[0]}, batch_id long").parquet(f"{folder}/windows").drop("batch_id")
    still = spark.read.schema(OPEN).parquet(f"{folder}/open/{last_batch}").where("start_us is not null").drop("watermark")
    return closed.unionByName(still)


def replay_windows(stream: DataFrame, minutes: int = 15, lateness_ms: int = 3_600_000) -> tuple[DataFrame, DataFrame]:
    """(windows, late) of everything available in ``stream``: the windows' events and the late rows are its events."""
    spark = stream.sparkSession
    folder = f"{scratch_folder(spark)}/windows-{uuid.uuid4().hex}"
    query = window_edges(stream, folder, minutes, lateness_ms)
    query.awaitTermination()
    last = query.lastProgress
    if last is None:
        return spark.createDataFrame([], OPEN).drop("watermark"), spark.createDataFrame([], stream.schema)
    late = spark.read.schema(f"{_ddl(stream)}, batch_id long").parquet(f"{folder}/late").drop("batch_id")
    return flush_windows(spark, folder, last.batchId), late


def stream_new_edges(stream: DataFrame, forget_after: str | None = None) -> DataFrame:
    """The first event of every (u, i). With ``forget_after`` a pair counts as new again after that long,
    which bounds the state."""
    if forget_after is None:
        return stream.dropDuplicates(["u", "i"])
    return stream.withWatermark("ts", forget_after).dropDuplicatesWithinWatermark(["u", "i"])


def stream_node_state(stream: DataFrame) -> DataFrame:
    """Per node: number of events, last time and last neighbour (update mode). Both endpoints count.

    A plain aggregation, so a busy node is folded inside every task before its state is touched.
    """
    sides = F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.col("i").alias("neighbor")),
        F.struct(F.col("i").alias("node"), F.col("u").alias("neighbor")),
    ))
    rows = stream.select("ts", "idx", sides.alias("_s")).select("ts", "idx", "_s.*")
    return rows.groupBy("node").agg(
        F.count("*").alias("events"), F.max("ts").alias("last_ts"),
        F.max(F.struct("ts", "idx", "neighbor"))["neighbor"].alias("last_neighbor"),
    )


class _Recency(StatefulProcessor):
    """Per node the time of its last event; takes one row per node and micro-batch of the stream before it."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        # as many rows as micro-batches were waiting
        heads = sorted((r for part in rows for r in part.itertuples(index=False)), key=lambda r: r.source_batch)
        before, out = self.last.get()[0] if self.last.exists() else None, []
        for r in heads:
            forgotten = before is None or (self.keep_ms is not None and r.first_us - before > self.keep_ms * 1000)
            out.append((key[0], r.idx, None if forgotten else (r.first_us - before) / 1e6))
            before = r.last_us
        self.last.update((int(before),))
        if self.keep_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(heads[-1].clock_us) // 1000 + self.keep_ms)
        yield pd.DataFrame(out, columns=["node", "idx", "recency"]).astype({"recency": "float64"})

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def ordered_heads(stream: DataFrame, folder: str) -> StreamingQuery:
    """Starts the first half of ``node_recency``: every micro-batch is ordered by node and time before any state is asked.

    Inside a micro-batch an event's predecessor is the row before it, found by the range-sorted carry, so a hub's events
    spread over many tasks; these recencies are written to ``inside``. Of each node one row goes on to ``heads``: its first
    event, which only the state can answer, and the time of its last.
    """
    spark = stream.sparkSession

    def step(events: DataFrame, batch_id: int) -> None:
        rows = events.select(F.posexplode(F.array("u", "i")).alias("_side", "node"), "idx", F.unix_micros("ts").alias("ts_us"))
        backwards = [F.col(c).desc() for c in ("ts_us", "idx", "_side")]
        placed = stored(next_row(rows, ["node"], backwards, {"_before": "ts_us"}))
        inside = placed.where("_before is not null")
        inside.select("node", "idx", ((F.col("ts_us") - F.col("_before")) / 1e6).alias("recency")).write.mode("overwrite").parquet(
            f"{folder}/inside/batch_id={batch_id}")
        # the newest event so far: a clock that never goes back, whatever order events come in
        clock = placed.agg(F.max("ts_us").alias("clock_us"))
        if batch_id:
            clock = clock.unionByName(spark.read.schema("clock_us long").parquet(f"{folder}/clock/{batch_id - 1}")).agg(F.max("clock_us").alias("clock_us"))
        clock = stored(clock)
        clock.write.mode("overwrite").parquet(f"{folder}/clock/{batch_id}")
        last = placed.groupBy("node").agg(F.max("ts_us").alias("last_us"))
        first = placed.where("_before is null").select("node", "idx", F.col("ts_us").alias("first_us"))
        first.join(last, "node").withColumn("source_batch", F.lit(batch_id).cast("long")).withColumn("clock_us", clock.scalar()).select(*[c.split()[0] for c in HEADS.split(", ")]).write.mode(
            "overwrite").parquet(f"{folder}/heads/{batch_id}")

    return stream.writeStream.foreachBatch(step).trigger(availableNow=True).option("checkpointLocation", f"{folder}/progress").start()


def head_recency(heads: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """The second half of ``node_recency``: the recency of each head, from a state of one time per node.

    With ``keep_ms`` an event that long after the node's last one counts as its first, and an event-time timer drops
    the state of a node that long after it was touched, so the state holds nodes of recent times only.
    """
    timed = heads if keep_ms is None else heads.withColumn("_clock", F.timestamp_micros("clock_us")).withWatermark("_clock", "0 seconds")
    return timed.groupBy("node").transformWithStateInPandas(
        statefulProcessor=_Recency(keep_ms), outputStructType="node long, idx long, recency double",
        outputMode="append", timeMode="none" if keep_ms is None else "eventTime",
    )


def replay_recency(stream: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Per event and endpoint of ``stream`` (u, i, idx, ts): seconds since the node's previous event, null for its first.

    Runs both halves over everything available. Micro-batches follow each other in time.
    """
    spark = stream.sparkSession
    folder = f"{scratch_folder(spark)}/recency-{uuid.uuid4().hex}"
    ordered_heads(stream, folder).awaitTermination()
    heads = spark.readStream.schema(HEADS).parquet(f"{folder}/heads/*")
    across = replay(head_recency(heads, keep_ms)).drop("batch_id")
    inside = spark.read.schema("node long, idx long, recency double, batch_id long").parquet(f"{folder}/inside").drop("batch_id")
    return inside.unionByName(across)


def adaptive_alerts(
    stream: DataFrame, calibration: DataFrame, folder: str, alpha: float = 0.05, rate: float = 0.005, batch: int = BATCH
) -> StreamingQuery:
    """Starts alerting: per scored event (stream, idx, score), whether its error exceeds its stream's moving conformal threshold.

    Every micro-batch is ranked against the stored ladder of calibration errors, of any size, by a distributed join, and
    carries each stream's state on from the micro-batch before. Alerts and states of a micro-batch are tables of
    their own under ``folder``, so one that is run again after a failure overwrites what it had written.
    """
    ladder, spark = conformal.rank_ladder(calibration), stream.sparkSession

    def step(events: DataFrame, batch_id: int) -> None:
        states = spark.read.schema(STATES).parquet(f"{folder}/states/{batch_id - 1}") if batch_id else None
        alerts, after = conformal.adaptive_alerts(events, ladder, states, alpha, rate, batch)
        alerts.write.mode("overwrite").parquet(f"{folder}/alerts/batch_id={batch_id}")
        after.write.mode("overwrite").parquet(f"{folder}/states/{batch_id}")

    return stream.writeStream.foreachBatch(step).trigger(availableNow=True).option("checkpointLocation", f"{folder}/progress").start()


def replay_alerts(stream: DataFrame, calibration: DataFrame, **parameters) -> DataFrame:
    """The alerts of everything available in ``stream``, with the ``batch_id`` that wrote them."""
    spark = stream.sparkSession
    folder = f"{scratch_folder(spark)}/alerts-{uuid.uuid4().hex}"
    adaptive_alerts(stream, calibration, folder, **parameters).awaitTermination()
    return spark.read.schema(f"{ALERTS}, batch_id long").parquet(f"{folder}/alerts")


def replay(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a streaming query over everything available and returns what it wrote, with its ``batch_id``.

    Every micro-batch overwrites its own folder, so a repeated batch does not duplicate rows.
    """
    spark: SparkSession = stream.sparkSession
    folder = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    earlier = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    try:
        query = (
            stream.writeStream.outputMode(mode).foreachBatch(write).trigger(availableNow=True)
            .option("checkpointLocation", f"{folder}/state").start()
        )
        query.awaitTermination()
    finally:
        if earlier is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", earlier)
    return spark.read.schema(f"{_ddl(stream)}, batch_id long").parquet(f"{folder}/out")


def _ddl(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
