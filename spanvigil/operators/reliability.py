"""The baseline-free reliability battery.

``half_profile`` is one aggregate row per service; each check is a column
expression over it (plus the drift tables), so the whole battery costs the
shuffles of its inputs and nothing per check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanvigil.functions.scalars import (
    round_to,
    drift_severity,
    drift_status,
    is_error_status,
    status_rank,
)
from spanvigil.operators import drift
from spanvigil.operators.attributes import feature_counts
from spanvigil.operators.condensed import attribute_quantiles, quantile_at
from spanvigil.operators.values import error_keys, error_value
from spanvigil.settings import DEFAULT_CHECKS

SIGNAL = "struct<check:string,status:string,severity:double,detail:string,current_value:double>"

# --- fixed values: severities of the checks --------------------------------------
VOLUME_SEVERITY = 0.85
SILENCE_SEVERITY = 0.55
NULL_SEVERITY = 0.45
WARNING_SEVERITY = 0.5
# ----------------------------------------------------------------------------------


def half_profile(split_spans: DataFrame, services: DataFrame) -> DataFrame:
    """Per service: counts per half, errored spans, error values and their mean,
    last span."""
    earlier, recent = F.col("half") == "earlier", F.col("half") == "recent"
    return (
        split_spans.join(error_keys(services), "service")
        .withColumn("error", error_value())
        .groupBy("service")
        .agg(
            F.count(F.lit(1)).alias("n_spans"),
            F.count_if(earlier).alias("n_earlier"),
            F.count_if(recent).alias("n_recent"),
            F.count("status_code").alias("n_status"),
            F.count_if(is_error_status(F.col("status_code"))).alias("n_errored"),
            F.count_if(F.col("error").isNull()).alias("n_missing"),
            F.avg("error").alias("metric"),
            F.max("start_time").alias("last_span"),
        )
    )


def latency_p95(counts: DataFrame, quantiles: DataFrame | None = None) -> DataFrame:
    """Exact p95 latency of each half, one row per service."""
    quantiles = attribute_quantiles(counts.where("attr = 'latency_ms'")) if quantiles is None else quantiles
    value = quantile_at(0.95)
    halves = quantiles.where("attr = 'latency_ms' AND part <> ''")
    return halves.groupBy("service").agg(
        F.max(F.when(F.col("part") == "_earlier", value)).alias("p95_earlier"),
        F.max(F.when(F.col("part") == "_recent", value)).alias("p95_recent"),
    )


def vanished_attribute(counts: DataFrame, profile: DataFrame) -> DataFrame:
    """First attribute (by name) populated on more than half of the earlier
    spans and on none of the recent ones."""
    named = counts.where(F.col("attr").rlike(r"^(input|eval|output)\."))
    presence = named.groupBy("service", "attr").agg(
        F.sum("n_earlier").alias("seen_earlier"), F.sum("n_recent").alias("seen_recent")
    )
    return (
        presence.join(profile.select("service", "n_earlier", "n_recent"), "service")
        .where("n_recent > 0 AND seen_recent = 0 AND seen_earlier > 0.5 * n_earlier")
        .groupBy("service")
        .agg(F.min("attr").alias("vanished"))
    )


def battery_inputs(
    profile: DataFrame, counts: DataFrame, services: DataFrame, quantiles: DataFrame | None = None
) -> DataFrame:
    """Everything the checks read, one row per service.  ``quantiles``: a table of
    ``condensed.attribute_quantiles``, where there is one."""
    psi = drift.two_sample_psi(feature_counts(counts), quantiles)
    inputs = drift.worst_attribute(psi.where(F.startswith("attr", F.lit("input."))))
    outputs = (
        psi.where(F.startswith("attr", F.lit("output.")))
        .groupBy("service")
        .agg(F.min(F.struct("attr", "psi")).alias("o"))
    )
    return (
        profile.join(services.drop("error_attribute").withColumnRenamed("lookback_minutes", "lookback"), "service")
        .join(latency_p95(counts, quantiles), "service", "left")
        .join(inputs.select("service", F.col("attr").alias("drift_attr"), F.col("psi").alias("drift_psi")), "service", "left")
        .join(outputs.select("service", F.col("o.attr").alias("out_attr"), F.col("o.psi").alias("out_psi")), "service", "left")
        .join(vanished_attribute(counts, profile), "service", "left")
    )


def _signal(check: str, status: Column, severity: Column, detail: Column, value: Column) -> Column:
    fields = F.struct(
        F.lit(check).alias("check"),
        status.alias("status"),
        severity.cast("double").alias("severity"),
        detail.alias("detail"),
        value.cast("double").alias("current_value"),
    ).cast(SIGNAL)
    return F.when(status.isNotNull() & (status != "HEALTHY"), fields)


def _text(number: Column, digits: int = 0) -> Column:
    rounded = round_to(number, digits)
    return (rounded.cast("bigint") if digits == 0 else rounded).cast("string")


def volume_drop() -> Column:
    ratio = F.col("n_recent") / F.col("n_earlier")
    # 1 - limit in double arithmetic, as the limits are given as drops.
    status = F.when(
        (F.col("n_recent") > 0) & (F.col("n_earlier") >= 2),
        F.when(ratio <= 1 - F.col("volume_drop_critical"), "CRITICAL").when(
            ratio <= 1 - F.col("volume_drop_warn"), "WARNING"
        ),
    )
    severity = F.when(status == "CRITICAL", VOLUME_SEVERITY).otherwise(WARNING_SEVERITY)
    detail = F.concat(
        F.lit("volume down "), _text((1 - ratio) * 100), F.lit("%: "),
        F.col("n_recent").cast("string"), F.lit(" recent spans, "),
        F.col("n_earlier").cast("string"), F.lit(" earlier"),
    )
    return _signal("volume_drop", status, severity, detail, round_to(ratio, 2))


def gap_minutes(as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros("last_span")) / F.lit(60e6)


def silence(as_of: Column) -> Column:
    gap = gap_minutes(as_of)
    status = F.when(gap >= F.col("lookback") * F.col("silence_warn_frac"), "WARNING")
    detail = F.concat(
        F.lit("silent for "), _text(gap), F.lit(" of "), F.col("lookback").cast("string"), F.lit(" minutes")
    )
    return _signal("silence", status, F.lit(SILENCE_SEVERITY), detail, round_to(gap, 1))


def error_rate() -> Column:
    rate = F.col("n_errored") / F.col("n_spans")
    status = F.when(
        F.col("n_status") > 0,
        F.when(rate >= F.col("error_rate_critical"), "CRITICAL").when(
            rate >= F.col("error_rate_warn"), "WARNING"
        ),
    )
    severity = F.when(status == "CRITICAL", F.least(F.lit(1.0), rate * 2)).otherwise(WARNING_SEVERITY)
    detail = F.concat(_text(rate * 100, 1), F.lit("% of spans failed"))
    return _signal("error_rate", status, severity, detail, round_to(rate, 3))


def latency_drift() -> Column:
    ratio = F.when(F.col("p95_earlier") > 0, F.col("p95_recent") / F.col("p95_earlier"))
    status = F.when(ratio >= F.col("latency_critical_ratio"), "CRITICAL").when(
        ratio >= F.col("latency_warn_ratio"), "WARNING"
    )
    severity = F.when(status == "CRITICAL", F.least(F.lit(1.0), ratio / 4)).otherwise(WARNING_SEVERITY)
    detail = F.concat(
        F.lit("p95 latency "), _text(ratio, 1), F.lit(" times the earlier "), _text(F.col("p95_earlier"))
    )
    return _signal("latency_drift", status, severity, detail, round_to(ratio, 2))


def null_rate() -> Column:
    rate = F.col("n_missing") / F.col("n_spans")
    status = F.when((rate > 0) & (rate < 1) & (rate >= F.col("null_rate_warn")), "WARNING")
    detail = F.concat(_text(rate * 100), F.lit("% of spans carry no error value"))
    return _signal("null_rate", status, F.lit(NULL_SEVERITY), detail, round_to(rate, 3))


def _drift_signal(check: str, attr: str, psi: str) -> Column:
    limits = F.col("drift_psi_warn"), F.col("drift_psi_critical")
    status = F.when(F.col(psi).isNotNull(), drift_status(F.col(psi), *limits))
    detail = F.concat(F.col(attr), F.lit(" moved within the window, PSI "), F.col(psi).cast("string"))
    return _signal(check, status, drift_severity(F.col(psi), *limits), detail, F.col(psi))


def schema_drift() -> Column:
    status = F.when(F.col("vanished").isNotNull(), "WARNING")
    detail = F.concat(F.col("vanished"), F.lit(" is no longer emitted"))
    return _signal("schema_drift", status, F.lit(WARNING_SEVERITY), detail, F.lit(0.0))


def reliability_signals(inputs: DataFrame, as_of: Column) -> DataFrame:
    """Long table of raised signals with their position in the battery.

    Disabled checks are dropped per service; a disabled battery raises none.
    """
    checks = F.array(
        volume_drop(),
        silence(as_of),
        error_rate(),
        latency_drift(),
        null_rate(),
        _drift_signal("input_drift_auto", "drift_attr", "drift_psi"),
        _drift_signal("output_drift", "out_attr", "out_psi"),
        schema_drift(),
    )
    raised = F.filter(
        checks,
        lambda s: s.isNotNull() & ~F.array_contains("disabled_checks", s["check"]),
    )
    names = F.array(*[F.lit(name) for name in DEFAULT_CHECKS])
    return (
        inputs.where("battery_enabled")
        .select("service", F.explode(raised).alias("s"))
        .select("service", F.lit("reliability").alias("kind"), F.array_position(names, F.col("s.check")).cast("int").alias("position"), "s.*")
    )


def version_drift(live: DataFrame, baseline_versions: DataFrame) -> DataFrame:
    """Signal where the live model is not the one the baseline was made for.

    ``live``: service, model_version; ``baseline_versions``: service,
    baseline_version.
    """
    stale = (
        (F.col("model_version") != "")
        & (F.col("baseline_version") != "")
        & (F.trim("model_version") != F.trim("baseline_version"))
    )
    detail = F.concat(
        F.lit("live model "), F.col("model_version"), F.lit(", baseline made for "), F.col("baseline_version")
    )
    return live.join(baseline_versions, "service").where(stale).select(
        "service",
        F.lit("reliability").alias("kind"),
        F.lit(len(DEFAULT_CHECKS) + 1).alias("position"),
        F.lit("baseline_stale").alias("check"),
        F.lit("WARNING").alias("status"),
        F.lit(WARNING_SEVERITY).alias("severity"),
        detail.alias("detail"),
        F.lit(None).cast("double").alias("current_value"),
    )


def worst_status(signals: DataFrame) -> DataFrame:
    """Worst status per service and the signal with the largest severity (the
    earliest in battery order wins ties)."""
    return signals.groupBy("service").agg(
        F.max_by("status", status_rank(F.col("status"))).alias("signal_status"),
        F.count_if(F.col("status") != "HEALTHY").alias("n_signals"),
        F.min(
            F.struct((-F.col("severity")).alias("k"), "position", "check", "severity", "detail")
        ).alias("worst"),
    )
