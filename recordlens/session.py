"""Session helpers: a local session for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", app: str = "recordlens") -> SparkSession:
    """Session for one machine; a cluster passes its own session to every function instead."""
    parts = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def stream_session(spark: SparkSession) -> SparkSession:
    """Session of its own for streams: state in RocksDB and, on one machine, one state partition per core.

    A stream keeps its number of partitions for life, so it is set here and not on the caller's session.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass",
                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    if spark.sparkContext.master.startswith("local"):
        partitions = str(spark.sparkContext.defaultParallelism)
    own.conf.set("spark.sql.shuffle.partitions", partitions)
    return own


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only a local master (tests, local runs) may do without: a temporary folder is set once.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="recordlens-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """New, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back, where a shared step feeds many others.

    Later steps read the stored rows, so a lost executor never repeats what came before.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """The frame as a table of the shared folder, in buckets by ``keys`` and sorted by them.

    Joins and groupings by the keys need no exchange. There are as many buckets as shuffle partitions, so the table
    fits whatever is joined to it. Its catalog entry is the name of its folder; both stay until the shared folder is
    cleared, since the result is read later.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys) \
        .option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def read_if_there(spark: SparkSession, path: str, *, schema: str | None = None,
                  recursive: bool = False) -> DataFrame | None:
    """The table at a path, None where the path does not exist; any other trouble stays an error."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    try:
        return (reader.schema(schema) if schema else reader).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that these modules wrote, on whatever file system it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
