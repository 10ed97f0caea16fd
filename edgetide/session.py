"""Session helpers shared by operators that must cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "edgetide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE, skew joins)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A local session without the setting gets a
    temporary folder; a cluster session without it is an error, because executors on other machines
    could not read a folder of one machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="edgetide-"))
        folder = context.getCheckpointDir()
    return folder


def scratch_folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_folder(spark)}/edgetide-{spark.sparkContext.applicationId}"


ROW_GROUP = 8 << 20
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder as parquet and read back.

    Cuts lineage like a checkpoint, survives lost executors, and later readers fetch only the columns they use. Row groups are small, as
    one is the least that a task can read, and rows that compress well are far larger in memory than stored. What was shuffled for the
    table is removed once it is written; else it would lie beside the table until the driver collects its garbage.
    """
    spark = df.sparkSession
    folder = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(folder)
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(folder)


TASK_ROWS = 1_000_000


@contextmanager
def finer(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside get tasks of at most about ``TASK_ROWS`` rows, for aggregations whose rows are far larger in memory than shuffled or stored.

    Spark would put tasks together again by their bytes, which say little about such rows: that is off where there is more than one task's rows.
    """
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    settings = {
        "spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(tasks),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m", "spark.sql.files.maxPartitionBytes": "8m",
    }
    if rows > TASK_ROWS:
        settings["spark.sql.adaptive.coalescePartitions.enabled"] = "false"
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> SparkSession:
    """Bounds what a Python worker is handed at once by bytes, for rows that hold long arrays."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return spark


def release_scratch(spark: SparkSession) -> None:
    """Removes the tables this application stored; call it when their readers are done."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
