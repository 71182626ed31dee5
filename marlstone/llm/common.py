"""Shared folders, staged tables and small helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words everywhere in this subpackage.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows of a table of texts, and of one of keys and numbers, for each task that writes it, where a bound on the rows is known.
ROWS_A_TASK = 50_000
KEYS_A_TASK = 200_000
#: Fewer keys than these are not worth a task of their own.
LEAST_KEYS_A_TASK = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that is unset a local session gets a temporary folder; a cluster's executors would not see one, so there it is
    an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one. It is deleted when the driver ends, so staged tables don't pile up."""
    path = f"{shared_dir(spark)}/marlstone-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        system.mkdirs(folder)
        system.deleteOnExit(folder)
    return path


def staged(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It cuts the lineage: what is computed above it runs once, and a lost executor costs only the tasks it was running.

    rows: about how many rows of keys and numbers ``df`` has at most, if that is known. It bounds tasks and files, as
    ``key_tasks`` tells, never rows: not a file for each shuffle partition. On a local file system every file also costs the
    executor three processes (Hadoop's chmod), each of which for a moment counts as large as the executor itself.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(key_tasks(spark, rows))
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def key_tasks(spark: SparkSession, rows: int) -> int:
    """Tasks for a table of about ``rows`` keys and numbers: at most KEYS_A_TASK each, and all cores where each of them gets
    LEAST_KEYS_A_TASK."""
    return max(1, -(-rows // KEYS_A_TASK), min(spark.sparkContext.defaultParallelism, -(-rows // LEAST_KEYS_A_TASK)))


def gathered(docs: DataFrame, rows: int) -> DataFrame:
    """The same rows in fewer partitions: a task for ROWS_A_TASK of about ``rows`` rows of texts, and one for each core at least."""
    return docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(taken, name: str) -> str:
    """``name``, with underscores until no column has it."""
    while name in taken:
        name += "_"
    return name
