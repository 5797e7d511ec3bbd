"""Tables in the folder that all executors share, which is the one in spark.checkpoint.dir.

What is written there is deleted by discard(), as soon as nothing reads it any more, or else when Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of applications that have no shared one, by application; only where all executors are on this machine.
_local: dict[str, str] = {}
#: Of each application the paths that still have something.
_written: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one if the master is local, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if context.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _local:
        folder = tempfile.mkdtemp(prefix="filigree-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local[context.applicationId] = "file://" + folder
    return _local[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has used yet, in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    application = spark.sparkContext.applicationId
    if application not in _written:
        _written[application] = set()
        atexit.register(_at_exit, spark)
    _written[application].add(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor costs nothing that was written."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer parts than there are cores (a small file of one row group, say) is dealt to all of them before work that costs more than the
    dealing; any other stays as it is, so a large table is never shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._written_to)


def clean(spark: SparkSession) -> None:
    """Delete all that this application still has in the shared folder. Results that read from there must be stored by then."""
    for path in list(_written.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        clean(spark)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _written[spark.sparkContext.applicationId].discard(path)
