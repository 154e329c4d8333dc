"""Work tables: a result that several parts of a plan read is computed once and written."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is named, as in tests, one of our own
    on this machine, which only a local master can use."""
    found = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="verdigris-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """The application's own folder for work tables, removed when the driver ends in order."""
    path = f"{shared_dir(spark)}/work-{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN[path] = path
        atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended: the folder is left to whoever cleans the shared one
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to a Parquet table in the shared folder and read back, with the schema given."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def moved(spark: SparkSession, source: str, target: str) -> None:
    """Moves a finished folder into place: readers see all of it or nothing."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(target).getParent())
    if files.exists(path(target)) or not files.rename(path(source), path(target)):
        raise OSError(f"{source} could not be moved to {target}")
