"""Operational baselines from live telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanvigil.functions.scalars import round_to

from spanvigil.operators import segments
from spanvigil.settings import MIN_BASELINE_SPANS


def schema_check(counts: DataFrame, services: DataFrame) -> DataFrame:
    """One row per configured name: is it in the live data?  role is 'error' or
    'segment'."""
    configured = services.select(
        "service",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("error").alias("role"), F.col("error_attribute").alias("attr"))),
                F.transform("segments", lambda s: F.struct(F.lit("segment").alias("role"), s.alias("attr"))),
            )
        ).alias("c"),
    ).select("service", "c.role", "c.attr")
    seen = counts.select("service", "attr").distinct().withColumn("present", F.lit(True))
    return configured.join(seen, ["service", "attr"], "left").withColumn(
        "present", F.coalesce("present", F.lit(False))
    )


def available_attributes(counts: DataFrame) -> DataFrame:
    """Sorted eval and input names per service; a set of names, not of values."""
    names = counts.select("service", "attr").distinct()
    of = lambda prefix: F.array_sort(F.collect_set(F.when(F.startswith("attr", F.lit(prefix)), F.col("attr"))))
    return names.groupBy("service").agg(of("eval.").alias("evals"), of("input.").alias("inputs"))


def calibrate(
    counts: DataFrame, profile: DataFrame, services: DataFrame, signals: DataFrame
) -> DataFrame:
    """One row per service with spans: what normal looks like right now."""
    interest = services.select("service", F.explode("attributes_of_interest").alias("attribute"))
    modes = (
        segments.modal_values(counts, interest)
        .groupBy("service")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", "value")))).alias("attribute_modes"))
    )
    critical = signals.where("status = 'CRITICAL'").groupBy("service").agg(F.count(F.lit(1)).alias("n_critical"))
    return (
        segments.volume_per_hour(profile.select("service", "n_spans"), services)
        .join(profile.select("service", round_to("metric", 2).alias("metric")), "service")
        .join(segments.live_version(counts), "service", "left")
        .join(modes, "service", "left")
        .join(critical, "service", "left")
        .withColumn("n_critical", F.coalesce("n_critical", F.lit(0)))
    )


def auto_baseline(calibration: DataFrame, existing: DataFrame, min_spans: int = MIN_BASELINE_SPANS) -> DataFrame:
    """Baselines to write for services that have none: 'established', or
    'deferred' while the window looks unhealthy.  Other services give no row."""
    outcome = F.when(F.col("n_critical") > 0, "deferred").when(F.col("metric").isNotNull(), "established")
    return (
        calibration.join(existing.select("service"), "service", "left_anti")
        .where(F.col("n_spans") >= min_spans)
        .withColumn("outcome", outcome)
        .where("outcome IS NOT NULL")
    )
