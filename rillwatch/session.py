"""Session settings, folders for stored tables and lineage cuts."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# what the operators rely on; can be set on a running session
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a JSON record that repeats a key keeps the last value instead of being rejected
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

# settings a job should start with; cluster sizing (executors, memory) is left to spark-submit
SETTINGS = {
    **RUNTIME,
    # the JVM never compiles a larger method: run such a stage operator by operator instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

_folders: list[str] = []


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to an existing session."""
    for name, value in RUNTIME.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named in ``spark.checkpoint.dir``, else one below the
    warehouse folder, which a cluster shares anyway."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/rillwatch"


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder, for one run's tables or stream state."""
    path = f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _folders.append(path)
    return path


def remove_folders(spark: SparkSession) -> None:
    """Remove all folders that :func:`new_folder` has named in this process.

    Tables in them can't be read any more, so call it once results are written elsewhere.
    """
    while _folders:
        remove_folder(spark, _folders.pop())


def _located(spark: SparkSession, path: str):
    """A path and its file system, as Spark itself sees them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_folder(spark: SparkSession, path: str) -> None:
    place, system = _located(spark, path)
    system.delete(place, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    place, system = _located(spark, path)
    return system.exists(place)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it does not exist."""
    place, system = _located(spark, path)
    if not system.exists(place):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(place) if s.isDirectory())


def publish(df: DataFrame, path: str) -> bool:
    """Write ``df`` as the table ``path`` in one step: readers see all of it or none.

    The table is written beside its place and then renamed. A table that is already there was finished by
    an earlier run and stays as it is; the result says whether this call wrote it. One process at a time
    may publish a path.
    """
    spark = df.sparkSession
    if folder_exists(spark, path):
        return False
    parent, name = path.rstrip("/").rsplit("/", 1)
    staged = f"{parent}/_staged-{name}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(staged)
    except Exception:
        remove_folder(spark, staged)
        raise
    source, system = _located(spark, staged)
    if not system.rename(source, _located(spark, path)[0]):
        raise OSError(f"{staged} could not be renamed to {path}")
    return True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` as a table in the shared folder, so that reading it twice, in part or after the loss
    of an executor redoes nothing before it."""
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def state_partitions(spark: SparkSession, number: int | None) -> Iterator[None]:
    """Number of state partitions of a stream that is started within; the stream keeps it for good.

    None leaves the configured number of shuffle partitions.
    """
    name = "spark.sql.shuffle.partitions"
    configured = spark.conf.get(name)
    if number is not None:
        spark.conf.set(name, str(number))
    try:
        yield
    finally:
        spark.conf.set(name, configured)
