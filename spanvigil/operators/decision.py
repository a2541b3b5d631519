"""Health status from ratios, drift and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanvigil.functions.scalars import bare_attribute, round_to, status_rank
from spanvigil.settings import CRITICAL_RATIO, MIN_REVERT_CONFIDENCE, PSI_WARNING, WARNING_RATIO

# --- fixed values: severities of the branches ----------------------------------
OUTAGE_MINUTES = 60
OUTAGE_SEVERITY = 0.85
QUIET_SEVERITY = 0.5
NO_METRIC_SEVERITY = 0.4
# --------------------------------------------------------------------------------

# --- fixed values: hypothesis class by anomaly metric ----------------------------
HYPOTHESES = {
    "mae": "code_or_mismatch",
    "psi": "code_or_mismatch",
    "input_drift_auto": "data_drift",
    "baseline_stale": "stale_version",
    "volume_drop": "infrastructure",
    "silence": "infrastructure",
    "error_rate": "infrastructure",
    "latency_drift": "infrastructure",
    "schema_drift": "feature_data",
    "null_rate": "feature_data",
}
# --------------------------------------------------------------------------------


def _two(number: Column) -> Column:
    return round_to(number, 2).cast("string")


def decide(facts: DataFrame) -> DataFrame:
    """Add status, severity, action and reason to one row per service.

    Reads n_spans, overall_ratio, segment_ratio (largest, may be NULL),
    worst_psi, lookback_minutes and the service's four limits.
    """
    ratio = F.greatest("overall_ratio", F.coalesce("segment_ratio", F.col("overall_ratio")))
    psi = F.coalesce("worst_psi", F.lit(0.0))
    long_window = F.col("lookback_minutes") >= OUTAGE_MINUTES
    silent = F.col("n_spans") == 0
    unmeasured = F.col("overall_ratio").isNull()
    critical = (ratio >= F.col("critical_ratio")) | (psi >= F.col("psi_critical"))
    warning = (ratio >= F.col("warning_ratio")) | (psi >= F.col("psi_warning"))

    status = (
        F.when(silent, F.when(long_window, "CRITICAL").otherwise("WARNING"))
        .when(unmeasured, "WARNING")
        .when(critical, "CRITICAL")
        .when(warning, "WARNING")
        .otherwise("HEALTHY")
    )
    strength = lambda cap, r, p: F.greatest(F.least(F.lit(cap), ratio / r), F.least(F.lit(cap), psi / p))
    severity = (
        F.when(silent, F.when(long_window, OUTAGE_SEVERITY).otherwise(QUIET_SEVERITY))
        .when(unmeasured, NO_METRIC_SEVERITY)
        .when(critical, round_to(strength(1.0, 5.0, 0.5), 2))
        .when(warning, round_to(strength(0.6, 4.0, 0.4), 2))
        .otherwise(0.0)
    )
    action = (
        F.when(silent, "ALERT_HUMAN")
        .when(unmeasured, "INVESTIGATE")
        .when(critical, "ALERT_HUMAN")
        .when(warning, "INVESTIGATE")
        .otherwise("MONITOR")
    )
    # The dominant signal names the reason.
    drift_leads = F.when(
        critical,
        (psi >= F.col("psi_critical"))
        & (psi / F.col("psi_critical") > ratio / F.col("critical_ratio")),
    ).otherwise((psi >= F.col("psi_warning")) & (psi >= F.greatest(ratio - 1, F.lit(0.0))))
    reason = (
        F.when(silent, F.concat(F.lit("no spans in "), F.col("lookback_minutes").cast("string"), F.lit(" minutes")))
        .when(unmeasured, F.lit("spans carry no error value"))
        .when(critical | warning, F.when(drift_leads, F.concat(F.lit("PSI "), _two(psi))).otherwise(F.concat(F.lit("error ratio "), _two(ratio))))
        .otherwise(F.concat(F.lit("error ratio "), _two(ratio), F.lit(", PSI "), _two(psi)))
    )
    return (
        facts.withColumn("status", status)
        .withColumn("severity", severity)
        .withColumn("action", action)
        .withColumn("reason", reason)
    )


def escalate(decided: DataFrame, worst: DataFrame) -> DataFrame:
    """Raise, never lower, a decision by its service's signals.

    ``worst``: service, signal_status, n_signals, worst(check, severity, detail).
    """
    higher = F.coalesce(
        status_rank(F.col("signal_status")) > status_rank(F.col("status")), F.lit(False)
    )
    joined = decided.join(worst, "service", "left").withColumn("higher", higher)
    return (
        joined.withColumn(
            "severity",
            F.when(F.col("higher"), F.greatest("severity", round_to("worst.severity", 2))).otherwise(F.col("severity")),
        )
        .withColumn(
            "action",
            F.when(F.col("higher") & (F.col("signal_status") == "CRITICAL"), "ALERT_HUMAN")
            .when(F.col("higher"), "INVESTIGATE")
            .otherwise(F.col("action")),
        )
        .withColumn(
            "reason",
            F.when(F.col("higher"), F.concat("reason", F.lit("; "), "worst.check", F.lit(": "), "worst.detail")).otherwise(F.col("reason")),
        )
        .withColumn("status", F.when(F.col("higher"), F.col("signal_status")).otherwise(F.col("status")))
        .withColumn("n_signals", F.coalesce("n_signals", F.lit(0)))
        .drop("higher", "worst", "signal_status")
    )


def anomalies(
    segments: DataFrame,
    psi: DataFrame,
    silent: DataFrame,
    signals: DataFrame,
    metrics: DataFrame,
    governance: DataFrame | None = None,
) -> DataFrame:
    """One row per anomaly: service, metric, segment, current, baseline, ratio.

    ``segments`` carries baseline and ratio; ``silent`` the services without spans;
    ``signals`` only raised ones; ``metrics`` custom metric rows; ``governance`` service,
    model_family, n_warnings.
    """
    number = lambda c: c.cast("double")
    columns = ["service", "metric", "segment", "current_value", "baseline_value", "ratio"]
    parts = [
        segments.where(F.col("ratio") >= WARNING_RATIO).select(
            "service",
            F.lit("mae").alias("metric"),
            F.concat(bare_attribute(F.col("attr")), F.lit("="), "value").alias("segment"),
            round_to(F.col("metric"), 1).alias("current_value"),
            F.col("baseline").alias("baseline_value"),
            "ratio",
        ),
        psi.where("band <> 'healthy'").select(
            "service",
            F.lit("psi").alias("metric"),
            bare_attribute(F.col("attr")).alias("segment"),
            F.col("psi").alias("current_value"),
            F.lit(PSI_WARNING).alias("baseline_value"),
            (F.col("psi") / PSI_WARNING).alias("ratio"),
        ),
        silent.select(
            "service",
            F.lit("prediction_volume").alias("metric"),
            F.lit("overall").alias("segment"),
            F.lit(0.0).alias("current_value"),
            F.lit(1.0).alias("baseline_value"),
            F.lit(0.0).alias("ratio"),
        ),
        signals.where("kind = 'reliability' AND status <> 'HEALTHY'").select(
            "service",
            F.col("check").alias("metric"),
            F.lit("overall").alias("segment"),
            number(F.col("current_value")).alias("current_value"),
            F.lit(0.0).alias("baseline_value"),
            F.col("severity").alias("ratio"),
        ),
        metrics.where("status <> 'HEALTHY'").select(
            "service",
            F.col("name").alias("metric"),
            F.when(F.col("segment") == "", "overall").otherwise(F.col("segment")).alias("segment"),
            F.col("value").alias("current_value"),
            F.col("baseline").alias("baseline_value"),
            "ratio",
        ),
    ]
    if governance is not None:
        parts.append(
            governance.select(
                "service",
                F.lit("governance").alias("metric"),
                F.col("model_family").alias("segment"),
                number(F.col("n_warnings")).alias("current_value"),
                F.lit(0.0).alias("baseline_value"),
                number(F.col("n_warnings")).alias("ratio"),
            )
        )
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    return out


def hypothesis_class(metric: Column) -> Column:
    """Where to look first for an anomaly of this metric."""
    known = F.create_map(*[F.lit(x) for pair in HYPOTHESES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, metric), F.lit("custom"))


def remediation_action(
    status: Column, commit_sha: Column, confidence: Column, floor: float = MIN_REVERT_CONFIDENCE
) -> Column:
    """Revert only an unhealthy model with a known commit and enough confidence."""
    revert = (status != "HEALTHY") & (F.coalesce(commit_sha, F.lit("")) != "") & (confidence >= floor)
    return F.when(revert, "REVERT_COMMIT").otherwise("NO_ACTION")


def recovery_status(worst_after: Column, n_spans: Column) -> Column:
    return (
        F.when(n_spans == 0, "NO_DATA")
        .when(worst_after.isNull(), "INCONCLUSIVE")
        .when(worst_after < WARNING_RATIO, "PASS")
        .when(worst_after < CRITICAL_RATIO, "INCONCLUSIVE")
        .otherwise("FAIL")
    )
