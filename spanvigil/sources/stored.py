"""A store of JSON documents: faulty ones are set aside, replacements are atomic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanvigil.session import delete_path

_CORRUPT = "_corrupt"


def checked_documents(spark: SparkSession, path: str, schema: str, required: str, one_per_file: bool = True) -> DataFrame:
    """``path``, ``body``, ``document`` and ``fault`` of every stored document.

    A document is a file or, with ``one_per_file=False``, a line.  ``fault`` is NULL
    for a good document, else ``empty``, ``unreadable`` (no JSON object of this
    schema) or ``incomplete`` (field ``required`` is missing).  Only files of no bytes
    have no row, as Spark makes no split of them.
    """
    bodies = spark.read.text(path, wholetext=one_per_file, recursiveFileLookup=True)
    parsed = F.from_json("body", f"{schema}, {_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    rows = bodies.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")).withColumn("document", parsed)
    fault = (
        F.when(~F.rlike("body", F.lit(r"\S")), "empty")
        .when(F.col("document").isNull() | F.col(f"document.{_CORRUPT}").isNotNull(), "unreadable")
        .when(F.col(f"document.{required}").isNull(), "incomplete")
    )
    return rows.withColumn("fault", fault).withColumn("document", F.col("document").dropFields(_CORRUPT))


def readable(checked: DataFrame) -> DataFrame:
    """The good documents, a column a field."""
    return checked.where("fault IS NULL").select("document.*")


def quarantined(checked: DataFrame) -> DataFrame:
    """``path``, ``fault``, ``body`` of the documents set aside."""
    return checked.where("fault IS NOT NULL").select("path", "fault", "body")


def quarantine(checked: DataFrame, path: str) -> DataFrame:
    """Append the faulty documents to the quarantine table, return the good ones."""
    quarantined(checked).write.mode("append").parquet(path)
    return readable(checked)


# --- artifacts by generation -----------------------------------------------------------


def publish(artifacts: DataFrame, path: str, generation: str) -> None:
    """Write artifacts as one generation; readers see all of it or nothing.

    A generation counts from the moment its ``_SUCCESS`` mark stands, which Spark
    writes last.  Generations are ordered as text.  A job that is run again replaces
    its own generation, so an executor or driver lost half-way leaves no trace.
    """
    artifacts.write.mode("overwrite").json(f"{path}/generation={generation}")


def _finished(spark: SparkSession, path: str) -> list[str]:
    """Folders of the finished generations: one name per publication not yet compacted."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/generation=*/_SUCCESS")
    marks = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(mark.getPath().getParent().toString() for mark in marks or ())


def published(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Artifacts as they stand: of each key, the rows of its newest generation.

    With keys (service, model_version) a version is replaced and the others stay.
    Without any finished generation the result is empty.
    """
    folders = _finished(spark, path)
    if not folders:
        return spark.createDataFrame([], f"{schema}, generation string")
    rows = spark.read.schema(f"{schema}, generation string").option("basePath", path).json(folders)
    newest = Window.partitionBy(*keys).orderBy(F.desc("generation"))
    return rows.withColumn("_place", F.rank().over(newest)).where("_place = 1").drop("_place")


def compact(spark: SparkSession, path: str, schema: str, keys: list[str], generation: str) -> None:
    """Write the artifacts as they stand as a new generation, then delete the older ones."""
    older = _finished(spark, path)
    if not older:
        return
    if f"generation={generation}" <= older[-1].rsplit("/", 1)[-1]:
        raise ValueError(f"generation {generation!r} is not newer than those stored")
    publish(published(spark, path, schema, keys).drop("generation"), path, generation)
    for folder in older:
        delete_path(spark, folder)
