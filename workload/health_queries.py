"""Segments, drift, battery, custom metrics, snapshot and anomalies over spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanvigil.functions.scalars import round_to

from spanvigil.operators import baselines as bl
from spanvigil.operators import custom_metrics as cm
from spanvigil.operators import decision, drift, reliability, segments
from spanvigil.operators.attributes import configured_counts
from spanvigil.operators.condensed import condensed_counts
from spanvigil.operators.halves import with_halves
from spanvigil.plans.health import HealthTables, health_tables
from spanvigil.session import materialise
from workload import views
from workload.oracle_base import ORDERS_AS_OF, sql
from workload.registry import query


def split(spark: SparkSession, d: str) -> DataFrame:
    return with_halves(views.spans(spark, d))


def counts(spark: SparkSession, d: str) -> DataFrame:
    """The count table, written once as several operators of a query read it."""
    return condensed_counts(split(spark, d), views.services(spark))


def configured(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the attributes that settings name."""
    return materialise(configured_counts(split(spark, d), views.services(spark)))


def features(spark: SparkSession, d: str, maps: tuple[str, ...] = ("inputs", "outputs")) -> DataFrame:
    return condensed_counts(split(spark, d), views.services(spark), maps=maps, own=False)


def profile(spark: SparkSession, d: str) -> DataFrame:
    return reliability.half_profile(split(spark, d), views.services(spark))


def limits(spark: SparkSession) -> DataFrame:
    return views.services(spark).drop("error_attribute").withColumnRenamed("lookback_minutes", "lookback")


def attribute_baselines(spark: SparkSession) -> DataFrame:
    return views.services(spark).select("service", F.explode("attribute_baselines").alias("attribute", "expected"))


def training_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """First week's error and value shares of two services, as their training."""
    week = views.spans(spark, d).where(
        (F.col("start_time") < F.lit("2024-01-08").cast("timestamp")) & F.col("service").isin("svc0", "svc1")
    )
    metric = week.groupBy("service").agg(round_to(F.avg(F.try_element_at("evals", F.lit("error"))), 4).alias("mae"))
    shares = (
        week.select("service", F.explode(F.map_filter("inputs", lambda k, _: k.isin("channel", "event_type"))).alias("attribute", "value"))
        .groupBy("service", "attribute", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = shares.groupBy("service", "attribute").agg(F.sum("n").alias("t"))
    # A handful of values per attribute: the maps stay small.
    maps = (
        shares.join(totals, ["service", "attribute"])
        .groupBy("service", "attribute")
        .agg(F.map_from_entries(F.collect_list(F.struct("value", F.col("n") / F.col("t")))).alias("d"))
        .groupBy("service")
        .agg(F.map_from_entries(F.collect_list(F.struct("attribute", "d"))).alias("attribute_distributions"))
    )
    return metric.join(maps, "service").select(
        "service",
        F.lit("v1").alias("model_version"),
        F.lit("2024-01-08").alias("trained_at"),
        F.create_map(F.lit("mae_minutes"), F.col("mae")).alias("metrics"),
        "attribute_distributions",
    )


def calibration_artifacts(spark: SparkSession, d: str) -> DataFrame:
    days = views.spans(spark, d).where(
        (F.col("start_time") < F.lit("2024-01-12").cast("timestamp")) & (F.col("service") == "svc2")
    )
    return days.groupBy("service").agg(
        F.lit("2024-01-12").alias("generated_at"),
        round_to(F.avg(F.try_element_at("evals", F.lit("error"))), 2).alias("metric"),
        F.lit(None).cast("map<string,string>").alias("attribute_modes"),
        F.min("model_version").alias("model_version"),
    )


def rolling(spark: SparkSession, d: str) -> DataFrame:
    return bl.rolling_error(
        views.predictions(spark, d), views.actuals(spark, d), F.lit(ORDERS_AS_OF).cast("timestamp"), ["service"]
    )


def resolved(spark: SparkSession, d: str) -> DataFrame:
    wanted = views.services(spark).select("service", F.lit(None).cast("string").alias("wanted_version"))
    return bl.resolve_baselines(
        views.services(spark),
        bl.training_lookup(training_artifacts(spark, d), wanted),
        calibration_artifacts(spark, d),
        rolling(spark, d),
    )


def tables(spark: SparkSession, d: str, governance: DataFrame | None = None) -> HealthTables:
    return health_tables(
        views.spans(spark, d), views.services(spark), views.specs(spark), resolved(spark, d), views.as_of(), views.LOOKBACK, governance
    )


SNAPSHOT = ["service", "n_spans", "metric_value", "baseline", "baseline_source", "overall_ratio", "n_bad_segments", "worst_psi", "n_signals", "status", "severity", "action"]


@query("health_snapshot", sql("SELECT * FROM snapshot", "snapshot"))
def health_snapshot(spark, d):
    return tables(spark, d).snapshot.withColumn("baseline", round_to("baseline", 4)).select(*SNAPSHOT)


@query("window_halves", sql("""
SELECT service, half, count(*) AS n, strftime(min(start_time), '%Y-%m-%d %H:%M:%S.%f') AS first_span,
       strftime(max(start_time), '%Y-%m-%d %H:%M:%S.%f') AS last_span FROM split GROUP BY service, half""", "split"))
def window_halves(spark, d):
    return split(spark, d).groupBy("service", "half").agg(
        F.count(F.lit(1)).alias("n"),
        views.stamp(F.min("start_time")).alias("first_span"),
        views.stamp(F.max("start_time")).alias("last_span"),
    )


@query("headline_metric", sql("SELECT service, n_spans, n_errors, round(metric, 1) AS metric_value FROM headline", "headline"))
def headline_metric(spark, d):
    return segments.headline(views.spans(spark, d), views.services(spark)).select(
        "service", "n_spans", "n_errors", round_to("metric", 1).alias("metric_value")
    )


@query("segment_metric", sql("SELECT service, attr, value, n, round(metric, 1) AS metric_value, ratio FROM segment_ratios", "segment_ratios"))
def segment_metric(spark, d):
    rows = segments.segment_breakdown(configured(spark, d), views.services(spark))
    return segments.with_ratio(rows, resolved(spark, d)).select(
        "service", "attr", "value", "n", round_to("metric", 1).alias("metric_value"), "ratio"
    )


@query("segment_top_values", sql("""
SELECT service, attr, value, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY service, attr ORDER BY n DESC, value) AS rank
  FROM (SELECT service, attr, value, count(*) AS n FROM segment_rows GROUP BY ALL)) WHERE rank <= 10""", "segment_rows"))
def segment_top_values(spark, d):
    return segments.segment_counts(configured(spark, d), views.services(spark), 10)


@query("psi_single_value", sql("SELECT * FROM psi_banded", "psi_banded"))
def psi_single_value(spark, d):
    return drift.single_value_psi(configured(spark, d), attribute_baselines(spark))


def _two_sample(spark, d, kind):
    return drift.two_sample_psi(features(spark, d)).where(F.col("kind") == kind)


@query("psi_numeric", sql("SELECT * FROM psi_two WHERE kind = 'numeric'", "psi_two"))
def psi_numeric(spark, d):
    return _two_sample(spark, d, "numeric")


@query("psi_categorical", sql("SELECT * FROM psi_two WHERE kind = 'categorical'", "psi_two"))
def psi_categorical(spark, d):
    return _two_sample(spark, d, "categorical")


@query("psi_ranked", sql("""
SELECT service, attr, kind, psi, row_number() OVER (PARTITION BY service ORDER BY psi DESC, attr) AS rank FROM psi_two""", "psi_two"))
def psi_ranked(spark, d):
    return drift.ranked(drift.two_sample_psi(features(spark, d)))


@query("psi_histograms", sql("""
SELECT family, round(sum((n - o) * ln(n / o)), 4) AS psi FROM (
  SELECT family, CASE WHEN new = 0 THEN 0.0001 ELSE new / sum(new) OVER w END AS n, CASE WHEN old = 0 THEN 0.0001 ELSE old / sum(old) OVER w END AS o
  FROM (SELECT family, floor(predicted / 25000) AS bin,
               count(*) FILTER (timestamp >= TIMESTAMP '1998-06-01')::DOUBLE AS new,
               count(*) FILTER (timestamp < TIMESTAMP '1998-06-01')::DOUBLE AS old
        FROM predictions GROUP BY ALL)
  WINDOW w AS (PARTITION BY family)) GROUP BY family""", "predictions"))
def psi_histograms(spark, d):
    rows = views.predictions(spark, d).withColumn("bin", F.floor(F.col("predicted") / 25000))
    cut = F.lit("1998-06-01").cast("timestamp")
    halves = [
        rows.where(side).groupBy("family", "bin").agg(F.count(F.lit(1)).alias("n"))
        for side in (F.col("timestamp") < cut, F.col("timestamp") >= cut)
    ]
    return drift.histogram_psi(*halves, ["family"], "bin")


@query("worst_attribute", sql("""
SELECT service, arg_min(attr, (-psi, attr)) AS attr, max(psi) AS psi FROM psi_two WHERE psi > 0 GROUP BY service""", "psi_two"))
def worst_attribute(spark, d):
    return drift.worst_attribute(drift.two_sample_psi(features(spark, d)))


@query("volume_drop", sql("""
SELECT service, n_earlier, n_recent, round(n_recent / n_earlier::DOUBLE, 2) AS ratio, status
FROM profile JOIN battery USING (service) WHERE "check" = 'volume_drop'""", "profile", "battery"))
def volume_drop(spark, d):
    rows = profile(spark, d).join(limits(spark), "service")
    signal = reliability.volume_drop()
    return rows.where("n_recent > 0 AND n_earlier >= 2").select(
        "service", "n_earlier", "n_recent", round_to(F.col("n_recent") / F.col("n_earlier"), 2).alias("ratio"),
        F.coalesce(signal["status"], F.lit("HEALTHY")).alias("status"),
    )


@query("silence", sql("""
SELECT service, strftime(last_span, '%Y-%m-%d %H:%M:%S.%f') AS last_span, current_value AS gap_minutes, status,
       (current_value >= 30) AS quiet_half_hour
FROM profile JOIN battery USING (service) WHERE "check" = 'silence'""", "profile", "battery"))
def silence(spark, d):
    rows = profile(spark, d).join(limits(spark), "service")
    gap = round_to(reliability.gap_minutes(views.as_of()), 1)
    return rows.select(
        "service", views.stamp("last_span").alias("last_span"), gap.alias("gap_minutes"),
        F.coalesce(reliability.silence(views.as_of())["status"], F.lit("HEALTHY")).alias("status"),
        (gap >= 30).alias("quiet_half_hour"),
    )


@query("error_rate", sql("""
SELECT service, n_spans, n_errored, current_value AS rate, status FROM profile JOIN battery USING (service) WHERE "check" = 'error_rate'""", "profile", "battery"))
def error_rate(spark, d):
    rows = profile(spark, d).join(limits(spark), "service")
    return rows.select(
        "service", "n_spans", "n_errored", round_to(F.col("n_errored") / F.col("n_spans"), 3).alias("rate"),
        F.coalesce(reliability.error_rate()["status"], F.lit("HEALTHY")).alias("status"),
    )


@query("latency_drift", sql("""
SELECT service, round(p95_earlier, 4) AS p95_earlier, round(p95_recent, 4) AS p95_recent, current_value AS ratio, status
FROM profile JOIN battery USING (service) WHERE "check" = 'latency_drift'""", "profile", "battery"))
def latency_drift(spark, d):
    latency = condensed_counts(split(spark, d), views.services(spark), maps=())
    rows = reliability.latency_p95(latency).join(views.services(spark), "service")
    return rows.where("p95_earlier > 0 AND p95_recent IS NOT NULL").select(
        "service", round_to("p95_earlier", 4).alias("p95_earlier"), round_to("p95_recent", 4).alias("p95_recent"),
        round_to(F.col("p95_recent") / F.col("p95_earlier"), 2).alias("ratio"),
        F.coalesce(reliability.latency_drift()["status"], F.lit("HEALTHY")).alias("status"),
    )


@query("null_rate", sql("""
SELECT service, n_missing, current_value AS rate, status FROM profile JOIN battery USING (service) WHERE "check" = 'null_rate'""", "profile", "battery"))
def null_rate(spark, d):
    rows = profile(spark, d).join(limits(spark), "service")
    return rows.select(
        "service", "n_missing", round_to(F.col("n_missing") / F.col("n_spans"), 3).alias("rate"),
        F.coalesce(reliability.null_rate()["status"], F.lit("HEALTHY")).alias("status"),
    )


@query("input_drift", sql("SELECT * FROM worst_input", "worst_input"))
def input_drift(spark, d):
    psi = drift.two_sample_psi(features(spark, d, ("inputs",)))
    return drift.worst_attribute(psi).select("service", F.col("attr").alias("drift_attr"), F.col("psi").alias("drift_psi"))


@query("output_drift", sql("SELECT service, attr, kind, psi FROM psi_two WHERE attr LIKE 'output.%'", "psi_two"))
def output_drift(spark, d):
    return drift.two_sample_psi(features(spark, d, ("outputs",))).select("service", "attr", "kind", "psi")


@query("schema_drift", sql("SELECT * FROM vanished", "vanished"))
def schema_drift(spark, d):
    return reliability.vanished_attribute(counts(spark, d), profile(spark, d))


@query("version_drift", sql("""
SELECT service, model_version, baseline_version FROM live_version JOIN resolved USING (service)
WHERE trim(model_version) <> trim(baseline_version)""", "live_version", "resolved"))
def version_drift(spark, d):
    base = resolved(spark, d).select("service", "baseline_version")
    live = segments.live_version(configured(spark, d))
    flagged = reliability.version_drift(live, base).select("service")
    return live.join(base, "service").join(flagged, "service", "left_semi").select("service", "model_version", "baseline_version")


@query("reliability_signals", sql("""
SELECT service, position, "check", status, round(severity, 4) AS severity, current_value FROM signals""", "signals"))
def reliability_signals(spark, d):
    return tables(spark, d).signals.select(
        "service", "position", "check", "status", round_to("severity", 4).alias("severity"), "current_value"
    )


@query("worst_signal", sql("""
SELECT service, CASE max(CASE status WHEN 'CRITICAL' THEN 2 ELSE 1 END) WHEN 2 THEN 'CRITICAL' ELSE 'WARNING' END AS signal_status,
       count(*) AS n_signals, arg_min("check", (-severity, position, "check")) AS worst_check
FROM signals GROUP BY service""", "signals"))
def worst_signal(spark, d):
    return reliability.worst_status(tables(spark, d).signals).select(
        "service", "signal_status", "n_signals", F.col("worst.check").alias("worst_check")
    )


@query("custom_metrics", sql("SELECT * FROM metrics", "metrics"))
def custom_metrics(spark, d):
    rows = split(spark, d)
    table = condensed_counts(rows, views.services(spark), views.specs(spark))
    totals = reliability.half_profile(rows, views.services(spark))
    return cm.custom_metrics(table, totals, views.specs(spark))


@query("anomalies", sql("""
SELECT service, 'mae' AS metric, replace(attr, 'input.', '') || '=' || value AS segment, round(metric, 1) AS current_value,
       round(baseline, 4) AS baseline_value, round(ratio, 4) AS ratio FROM segment_ratios WHERE ratio >= 1.2
UNION ALL SELECT service, 'psi', replace(attr, 'input.', ''), psi, 0.1, round(psi / 0.1, 4) FROM psi_resolved WHERE psi >= 0.1
UNION ALL SELECT service, 'prediction_volume', 'overall', 0, 1, 0 FROM facts WHERE n_spans = 0
UNION ALL SELECT service, "check", 'overall', current_value, 0, round(severity, 4) FROM signals
UNION ALL SELECT service, name, CASE WHEN segment = '' THEN 'overall' ELSE segment END, value, round(baseline, 4), ratio FROM metrics WHERE status <> 'HEALTHY'
""", "segment_ratios", "psi_resolved", "facts", "signals", "metrics"))
def anomalies(spark, d):
    t = tables(spark, d)
    return decision.anomalies(t.segments, t.psi, t.silent, t.signals, t.metrics).select(
        "service", "metric", "segment", "current_value", round_to("baseline_value", 4).alias("baseline_value"), round_to("ratio", 4).alias("ratio")
    )


@query("rolling_mae", sql("SELECT service, n, round(mae, 2) AS mae, usable FROM rolling", "rolling"))
def rolling_mae(spark, d):
    return rolling(spark, d).select("service", "n", round_to("mae", 2).alias("mae"), "usable")


@query("baseline_resolution", sql("SELECT service, round(baseline, 4) AS baseline, baseline_source, baseline_version FROM resolved", "resolved"))
def baseline_resolution(spark, d):
    return resolved(spark, d).select("service", round_to("baseline", 4).alias("baseline"), "baseline_source", "baseline_version")


@query("expected_values", sql("SELECT * FROM resolved_expected", "resolved_expected"))
def expected_values(spark, d):
    return bl.expected_values(resolved(spark, d))
