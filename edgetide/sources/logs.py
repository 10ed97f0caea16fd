"""Reading raw audit logs and label files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.schema import LOG_SCHEMA

# File-name parts that exclude a log file.
EXCLUDED_NAME_PARTS = ["Label", "canada", "09-16", "09-17", "09-18"]


def read_logs(spark: SparkSession, paths: str | Sequence[str], spread: int | None = None) -> DataFrame:
    """JSON-lines logs, plain or gzip. Blank lines are skipped; a malformed line fails the query.

    A gzip file is one task whatever its size; ``spread`` repartitions after the read for the work behind it.
    """
    logs = spark.read.schema(LOG_SCHEMA).option("mode", "FAILFAST").json(paths)
    return logs.repartition(spread) if spread else logs


def selected_file(name: Column, client: str) -> Column:
    """Whether a file name belongs to ``client`` and is not an excluded file."""
    wanted = F.upper(name).contains(f"SYSCLIENT0{client}".upper()) & name.contains("2019")
    for part in EXCLUDED_NAME_PARTS:
        wanted = wanted & ~name.contains(part)
    return wanted


def write_log_files(logs: DataFrame, folder: str, file: str) -> None:
    """JSON lines in one folder per value of the column ``file``, which is not written into the lines."""
    logs.write.mode("overwrite").partitionBy(file).json(folder)


def read_client_logs(spark: SparkSession, folder: str, client: str, part: int = -1) -> DataFrame:
    """Logs of one client: whole files are skipped by name, before their lines are parsed.

    The name is the file's own, or with ``part`` -2 that of the folder it lies in, as of files written in parts.
    """
    logs = (
        spark.read.schema(LOG_SCHEMA).option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(folder)
    )
    return logs.where(selected_file(F.element_at(F.split("_metadata.file_path", "/"), part), client))


def read_label_ids(spark: SparkSession, path: str) -> DataFrame:
    """(hostname, id) of malicious records, host in lower case."""
    return label_ids(read_logs(spark, path))


def label_ids(logs: DataFrame) -> DataFrame:
    return logs.select(F.lower("hostname").alias("hostname"), "id")
