"""Session helpers: time zone, checkpoint folder, materialised tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone the results depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for materialised tables and stream state.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a scratch folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured is None and context.getCheckpointDir() is not None:
        return context.getCheckpointDir()
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spanvigil-checkpoint-")
        context.setCheckpointDir(configured)
    return configured


def materialise(frame: DataFrame, *partition_by: str) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    Used where several operators read one intermediate table: it is computed
    once, survives lost executors, keeps column pruning, and its file size is
    known to Catalyst.  A small one (window bounds, per-service summaries) is
    therefore broadcast only if it really is below
    ``spark.sql.autoBroadcastJoinThreshold``, and shuffled otherwise.
    """
    spark = frame.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    frame.write.partitionBy(*partition_by).parquet(path)
    table = spark.read.schema(frame.schema).parquet(path)
    table._written_to = path
    _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return table


#: Folders of the tables that each application has written and not dropped.
_WRITTEN: dict[str, set[str]] = {}


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete(spark: SparkSession, path: str) -> None:
    delete_path(spark, path)
    _WRITTEN.get(spark.sparkContext.applicationId, set()).discard(path)


def drop_table(table: DataFrame) -> None:
    """Delete the files of a frame that ``materialise`` returned.

    Whoever writes a table for his own steps drops it after the last of them;
    nothing lazy may still depend on it.
    """
    _delete(table.sparkSession, table._written_to)


def drop_tables(spark: SparkSession) -> None:
    """Delete all tables written by this application, once its results are stored."""
    for path in list(_WRITTEN.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)
