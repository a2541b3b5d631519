"""The health snapshot: every check of every service in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanvigil.functions.scalars import psi_band, round_to, worse_ratio
from spanvigil.operators import custom_metrics as cm
from spanvigil.operators import decision, drift, reliability, segments
from spanvigil.operators.condensed import attribute_quantiles, condensed_counts
from spanvigil.operators.baselines import expected_values
from spanvigil.operators.halves import with_halves
from spanvigil.session import materialise
from spanvigil.settings import WARNING_RATIO


@dataclass
class HealthTables:
    """Lazily planned child tables of one snapshot."""

    split: DataFrame
    counts: DataFrame
    profile: DataFrame
    segments: DataFrame
    psi: DataFrame
    signals: DataFrame
    metrics: DataFrame
    silent: DataFrame
    snapshot: DataFrame


def recent_spans(spans: DataFrame, services: DataFrame, as_of: Column, lookback_minutes: int) -> DataFrame:
    """Spans of the configured services within the lookback.

    ``lookback_minutes`` is the longest lookback of the fleet: a literal bound
    that reaches the scan and prunes date partitions.  Services with a shorter
    one are cut again after the join with their settings.
    """
    own_start = F.unix_micros(as_of) - F.col("lookback_minutes") * F.lit(60_000_000)
    return (
        spans.where(F.col("start_time") >= as_of - F.make_dt_interval(mins=F.lit(lookback_minutes)))
        .join(services.select("service", "lookback_minutes"), "service")
        .where(F.unix_micros("start_time") >= own_start)
        .drop("lookback_minutes")
    )


def health_tables(
    spans: DataFrame,
    services: DataFrame,
    specs: DataFrame,
    baselines: DataFrame,
    as_of: Column,
    max_lookback_minutes: int,
    governance: DataFrame | None = None,
) -> HealthTables:
    """``baselines``: output of ``resolve_baselines``, one row per service;
    ``governance``: output of ``lineage.governance``, models whose training cannot be
    traced.  They are counted for every service, with or without spans.
    """
    window = recent_spans(spans, services, as_of, max_lookback_minutes)
    split = with_halves(window)
    # Read by nearly every check below, so both are computed once.
    counts = condensed_counts(split, services, specs)
    quantiles = materialise(attribute_quantiles(counts))
    profile = materialise(reliability.half_profile(split, services))
    baselines = materialise(baselines)

    by_segment = segments.with_ratio(segments.segment_breakdown(counts, services), baselines)
    limits = services.select("service", "psi_warning", "psi_critical")
    psi = (
        drift.single_value_psi(counts, expected_values(baselines))
        .join(limits, "service")
        .withColumn("band", psi_band(F.col("psi"), F.col("psi_warning"), F.col("psi_critical")))
        .drop("psi_warning", "psi_critical")
    )
    inputs = reliability.battery_inputs(profile, counts, services, quantiles)
    signals = reliability.reliability_signals(inputs, as_of).unionByName(
        reliability.version_drift(
            segments.live_version(counts), baselines.select("service", "baseline_version")
        )
    )
    metrics = cm.custom_metrics(counts, profile, specs, quantiles)

    facts = (
        services.select(
            "service", "lookback_minutes", "warning_ratio", "critical_ratio", "psi_warning", "psi_critical"
        )
        .join(baselines.drop("expected", "baseline_version"), "service", "left")
        .join(profile.select("service", "n_spans", "metric"), "service", "left")
        .join(by_segment.groupBy("service").agg(F.max("ratio").alias("segment_ratio"), F.count_if(F.col("ratio") >= WARNING_RATIO).alias("n_bad_segments")), "service", "left")
        .join(psi.groupBy("service").agg(F.max("psi").alias("worst_psi")), "service", "left")
        .withColumn("n_spans", F.coalesce("n_spans", F.lit(0)))
        .withColumn(
            "overall_ratio",
            F.when(F.col("metric").isNotNull(), worse_ratio(F.col("metric"), F.col("baseline"), F.col("direction"))),
        )
    )
    if governance is None:
        facts = facts.withColumn("n_ungoverned", F.lit(0).cast("long"))
    else:
        audited = governance.groupBy("service").agg(F.count(F.lit(1)).alias("n_ungoverned"))
        facts = facts.join(audited, "service", "left").withColumn("n_ungoverned", F.coalesce("n_ungoverned", F.lit(0).cast("long")))
    raised = signals.unionByName(cm.metric_signals(metrics))
    snapshot = decision.escalate(decision.decide(facts), reliability.worst_status(raised)).select(
        "service",
        "lookback_minutes",
        "n_spans",
        round_to("metric", 1).alias("metric_value"),
        "baseline",
        "baseline_source",
        "overall_ratio",
        F.coalesce("n_bad_segments", F.lit(0)).alias("n_bad_segments"),
        F.coalesce("worst_psi", F.lit(0.0)).alias("worst_psi"),
        "n_signals",
        "n_ungoverned",
        "status",
        "severity",
        "action",
        "reason",
    )
    silent = services.select("service").join(profile, "service", "left_anti")
    return HealthTables(split, counts, profile, by_segment, psi, signals, metrics, silent, snapshot)
