"""Headline metric, per-segment breakdown, modes and volume.

Everything but the headline reads the attribute count table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanvigil.functions.scalars import round_to, worse_ratio
from spanvigil.operators.values import error_keys, error_value


def headline(spans: DataFrame, services: DataFrame) -> DataFrame:
    """service, n_spans, n_errors, metric (unrounded mean, NULL without values)."""
    return (
        spans.join(error_keys(services), "service")
        .withColumn("error", error_value())
        .groupBy("service")
        .agg(
            F.count(F.lit(1)).alias("n_spans"),
            F.count("error").alias("n_errors"),
            F.avg("error").alias("metric"),
        )
    )


def _segment_names(services: DataFrame) -> DataFrame:
    return services.select("service", F.explode("segments").alias("attr"))


def segment_breakdown(counts: DataFrame, services: DataFrame) -> DataFrame:
    """One row per (service, configured segment attribute, value): n, metric.

    Spans without a value for the attribute are left out; a segment without
    error values has a NULL metric.
    """
    return counts.join(_segment_names(services), ["service", "attr"]).select(
        "service",
        "attr",
        "value",
        F.col("n_error").alias("n"),
        F.try_divide("error_sum", "n_error").alias("metric"),
    )


def with_ratio(frame: DataFrame, baselines: DataFrame) -> DataFrame:
    """Add baseline and ratio columns from (service, baseline, direction)."""
    return frame.join(baselines.select("service", "baseline", "direction"), "service").withColumn(
        "ratio", worse_ratio(F.col("metric"), F.col("baseline"), F.col("direction"))
    )


def segment_counts(counts: DataFrame, services: DataFrame, top: int) -> DataFrame:
    """Most frequent values per segment attribute, ties by value.

    ``row_number() <= top`` lets Spark keep only the leading rows of each group
    before the shuffle.
    """
    order = Window.partitionBy("service", "attr").orderBy(F.desc("n"), "value")
    return (
        counts.join(_segment_names(services), ["service", "attr"])
        .select("service", "attr", "value", "n", F.row_number().over(order).alias("rank"))
        .where(F.col("rank") <= top)
    )


def modal_values(counts: DataFrame, attributes: DataFrame) -> DataFrame:
    """Most frequent value per (service, attribute of interest); ties by value."""
    wanted = attributes.select(
        "service", "attribute", F.concat(F.lit("input."), F.col("attribute")).alias("attr")
    )
    return (
        counts.join(wanted, ["service", "attr"])
        .groupBy("service", "attribute")
        .agg(F.min(F.struct((-F.col("n")).alias("k"), "value", "n")).alias("best"))
        .select("service", "attribute", F.col("best.value").alias("value"), F.col("best.n").alias("n"))
    )


def live_version(counts: DataFrame) -> DataFrame:
    """Most common model_version per service; ties go to the smallest."""
    return (
        counts.where("attr = 'model_version'")
        .groupBy("service")
        .agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("model_version"))).alias("best"))
        .select("service", "best.model_version")
    )


def volume_per_hour(totals: DataFrame, services: DataFrame) -> DataFrame:
    """``totals``: service, n_spans."""
    hours = F.col("lookback_minutes") / F.lit(60.0)
    return totals.join(services.select("service", "lookback_minutes"), "service").select(
        "service", "n_spans", round_to(F.col("n_spans") / hours, 1).alias("per_hour")
    )
