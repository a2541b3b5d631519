"""The given tables seen as reliability data.

Each view is a projection or aggregation over whole tables; nothing is sampled.
``workload/oracle_base.py`` states the same views in SQL.
"""

from __future__ import annotations

import os
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanvigil import settings as st
from spanvigil.session import prepare

AS_OF = "2024-01-31 00:00:00"
AS_OF_DATE = date.fromisoformat(AS_OF[:10])
LOOKBACK = 43_200
SWITCH = "2024-01-16 00:00:00"  # model v2 goes live

SERVICES = [
    st.ServiceSettings(
        service=f"svc{i}",
        lookback_minutes=LOOKBACK,
        segments=("input.event_type", "input.user_bucket"),
        explicit_baseline={0: 20.0}.get(i),
        configured_baseline={9: 55.0}.get(i),
        disabled_checks=("output_drift",) if i == 3 else (),
        attribute_baselines={"channel": "web", "event_type": "click"},
        attributes_of_interest=("channel", "event_type"),
    )
    for i in (0, 1, 2, 3, 9)
]

SPECS = [
    st.MetricSpec(service=f"svc{i}", **spec)
    for i in (0, 1, 2, 3, 9)
    for spec in (
        dict(name="mean_error", attribute="eval.error", agg="mean", baseline=30.0),
        dict(name="p95_latency", attribute="latency_ms", agg="p95"),
        dict(name="p99_amount", attribute="input.amount", agg="p99", baseline=150.0),
        dict(name="median_amount", attribute="input.amount", agg="p50", segment_by="input.channel"),
        dict(name="hit_rate", attribute="eval.hit", agg="rate", direction=st.HIGHER, baseline=0.9),
        dict(name="traffic", attribute="eval.error", agg="count"),
        dict(name="traffic_rate", attribute="eval.error", agg="count", baseline_scale="rate"),
        dict(name="missing_error", attribute="eval.error", agg="null_rate"),
        dict(name="total_amount", attribute="input.amount", agg="sum"),
        dict(name="absent", attribute="input.nothing", agg="null_rate"),
    )
]

REGISTRY_FAMILIES = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def stamp(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


_SETTINGS: dict[tuple[str, str], DataFrame] = {}


def _once(spark: SparkSession, name: str, build) -> DataFrame:
    """Settings are local relations; one per session is enough."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _SETTINGS:
        _SETTINGS[key] = build()
    return _SETTINGS[key]


def services(spark: SparkSession) -> DataFrame:
    return _once(spark, "services", lambda: st.services_frame(spark, SERVICES))


def specs(spark: SparkSession) -> DataFrame:
    return _once(spark, "specs", lambda: st.metric_specs_frame(spark, SPECS))


def event_spans(events: DataFrame) -> DataFrame:
    """events -> spans; the service split, the new channel and the longer
    latencies after the switch give the checks something to find."""
    at = F.col("ts").cast("timestamp")
    new = at >= F.lit(SWITCH).cast("timestamp")
    k = F.get_json_object("props", "$.k")
    failed = F.col("event_type") == "error"
    third = F.col("user_id") % 3
    moved = (third == 2) & new & ~failed
    service = F.when(moved, "svc3").otherwise(F.concat(F.lit("svc"), third.cast("string")))
    channel = F.when(new & F.col("event_type").isin("click", "view"), "app").otherwise("web")
    error = F.when(~failed, F.abs(F.col("value") - k.cast("double")))
    # A NULL value means the span does not carry the attribute.
    inputs = F.create_map(
        F.lit("event_type"), F.col("event_type"),
        F.lit("k"), k,
        F.lit("user_bucket"), (F.col("user_id") % 10).cast("string"),
        F.lit("channel"), channel,
        F.lit("legacy"), F.when(~new, F.col("event_type")),
        F.lit("amount"), (F.col("value") * F.when(new, 1.5).otherwise(1.0)).cast("string"),
    )
    return events.select(
        service.alias("service"),
        at.alias("start_time"),
        at.alias("end_time"),
        F.when(failed, "ERROR").otherwise("OK").alias("status_code"),
        F.col("event_id").cast("string").alias("request_id"),
        F.when(new, "v2").otherwise("v1").alias("model_version"),
        inputs.alias("inputs"),
        F.create_map(F.lit("prediction"), F.col("value").cast("string")).alias("outputs"),
        F.create_map(
            F.lit("error"), error,
            F.lit("hit"), F.when(error < 25, 1.0).when(error >= 25, 0.0),
        ).alias("evals"),
        (F.col("value") * F.when(new & (service == "svc1"), 2.0).otherwise(1.0)).alias("latency_ms"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_spans(table(spark, sf_dir, "events"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("load_id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_totalprice").alias("predicted"),
        F.col("o_orderpriority").alias("bucket"),
        F.col("o_orderstatus").alias("family"),
        F.concat(F.lit("svc"), (F.col("o_custkey") % 4).cast("string")).alias("service"),
    )


def actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("load_id"))
        .agg(
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("actual"),
            F.max("l_shipdate").cast("timestamp").alias("delivered_at"),
        )
    )
