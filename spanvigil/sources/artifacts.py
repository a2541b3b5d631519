"""Stored documents: training data, baseline artifacts, incident runs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASELINE_SCHEMA = (
    "service string, model_name string, model_version string, trained_at string, "
    "metrics map<string,double>, "
    "attribute_distributions map<string,map<string,double>>, "
    "correlations_with_target map<string,double>"
)
CALIBRATION_SCHEMA = (
    "service string, generated_at string, metric double, "
    "attribute_modes map<string,string>, model_version string, n_spans bigint"
)
INCIDENT_SCHEMA = (
    "run_id string, project_name string, started_at string, finished_at string, final_state string, "
    "slack_message_ts string, approval struct<decision:string,by:string,at:string>, "
    "incident_report struct<title:string,severity:string,tldr:string>, "
    "sentinel_verdict struct<status:string,severity_score:double,summary:string>, "
    "events array<struct<timestamp:string,state:string,agent:string,message:string,duration_ms:bigint,metadata:map<string,string>>>"
)


def training_data(spark: SparkSession, prefix: str, files: int | None = None) -> DataFrame:
    """All parquet files below a prefix; with ``files``, those of the first names.

    The names come from a listing that opens no file, so only the chosen ones are
    read; at most ``files`` names reach the driver.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if files is not None:
        listed = reader.format("binaryFile").option("pathGlobFilter", "*.parquet").load(prefix).select("path")
        chosen = [r["path"] for r in listed.orderBy("path").limit(files).collect()]
        if chosen:
            plain = [re.sub(r"([\\\[\]{}*?])", r"\\\1", path) for path in chosen]
            return spark.read.option("mergeSchema", "true").parquet(*plain)
    return spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(prefix)


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option(
        "recursiveFileLookup", "true"
    ).json(path)


def baselines(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark, path, BASELINE_SCHEMA)


def calibrations(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark, path, CALIBRATION_SCHEMA)


def incident_documents(spark: SparkSession, path: str) -> DataFrame:
    """Run documents; corrupt or partial files are skipped."""
    return _documents(spark, path, INCIDENT_SCHEMA).where("run_id IS NOT NULL")


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """One JSON document per row, below ``service=<name>/``; a service's former
    documents are replaced, other services' stay."""
    copied = artifacts.withColumn("part", F.col("service"))
    copied.withColumnRenamed("part", "service_key").write.option(
        "partitionOverwriteMode", "dynamic"
    ).mode("overwrite").partitionBy("service_key").json(path)


def append_events(events: DataFrame, path: str) -> None:
    """Incident events are only ever appended, never rewritten."""
    events.write.mode("append").parquet(path)
