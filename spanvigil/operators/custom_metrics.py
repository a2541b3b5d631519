"""User-declared metrics: all specs of all services from one count table.

The table holds the values of segmented metrics next to the attributes, so no
metric looks at the spans itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanvigil.functions.scalars import round_to, worse_ratio
from spanvigil.operators.attributes import METRIC
from spanvigil.operators.condensed import attribute_quantiles, quantile_at

KEYS = ["service", "name", "segment"]
PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def metric_attributes(specs: DataFrame, *more: str) -> DataFrame:
    """service, name, attr: where a metric's values stand in the count table."""
    attr = F.when(F.col("segment_by").isNull(), F.col("attribute")).otherwise(F.concat(F.lit(METRIC), F.col("name")))
    return specs.select("service", "name", attr.alias("attr"), *more)


def metric_values(counts: DataFrame, specs: DataFrame) -> DataFrame:
    """Rows of the count table by metric: those of its attribute, or those that a
    segmented metric has under its own name."""
    return counts.join(metric_attributes(specs), ["service", "attr"])


def metric_totals(values: DataFrame, profile: DataFrame, specs: DataFrame) -> DataFrame:
    """Spans per metric and segment: those of the service, or those with the segment."""
    plain, segmented = (specs.where(f"segment_by IS {without}NULL").select("service", "name") for without in ("", "NOT "))
    all_spans = profile.join(plain, "service").select(
        "service", "name", F.lit("").alias("segment"), F.col("n_spans").alias("spans"), F.col("n_earlier").alias("spans_earlier")
    )
    sums = F.sum("n").alias("spans"), F.sum("n_earlier").alias("spans_earlier")
    return all_spans.unionByName(values.join(segmented, ["service", "name"], "left_semi").groupBy(*KEYS).agg(*sums))


def _moments(values: DataFrame) -> DataFrame:
    """Present, numeric and non-zero values and sums, whole and earlier."""
    names = [f"{name}{part}" for part in ("", "_earlier") for name in ("present", "numeric", "nonzero", "total")]
    return values.groupBy(*KEYS).agg(*[F.sum(name).alias(name) for name in names])


def _quantiles(counts: DataFrame, specs: DataFrame, quantiles: DataFrame | None) -> DataFrame:
    asked = metric_attributes(specs.where(F.col("agg").isin(*PERCENTILES)), "agg")
    if quantiles is None:
        quantiles = attribute_quantiles(counts.join(asked, ["service", "attr"], "left_semi"))
    picked = F.lit(None).cast("double")
    for name, fraction in PERCENTILES.items():
        picked = F.when(F.col("agg") == name, quantile_at(fraction)).otherwise(picked)
    return quantiles.join(asked, ["service", "attr"]).groupBy(*KEYS).agg(
        F.max(F.when(F.col("part") == "", picked)).alias("quantile"),
        F.max(F.when(F.col("part") == "_earlier", picked)).alias("quantile_earlier"),
    )


def _value(suffix: str) -> Column:
    of = lambda name: F.col(f"{name}{suffix}")
    agg = F.col("agg")
    return (
        F.when(agg == "count", F.when(of("spans") > 0, of("spans").cast("double")))
        .when(agg == "null_rate", F.try_divide(of("spans") - of("present"), of("spans")))
        .when(agg == "rate", F.try_divide(of("nonzero"), of("present")))
        .when(agg == "sum", of("total"))
        .when(agg.isin(*PERCENTILES), of("quantile"))
        .otherwise(F.try_divide(of("total"), of("numeric")))
    )


def custom_metrics(counts: DataFrame, profile: DataFrame, specs: DataFrame, quantiles: DataFrame | None = None) -> DataFrame:
    """service, name, segment, agg, value, baseline, ratio, status, severity.

    ``counts`` is a count table made with ``specs``, so that segmented metrics are in it;
    ``quantiles`` is its table of ``condensed.attribute_quantiles``, where there is one.

    Without an explicit baseline the earlier half is the baseline; without
    either the value is reported as HEALTHY with a NULL ratio.  An attribute
    that no span of the service carries is skipped, except by ``count``.
    """
    values = metric_values(counts, specs)
    totals = metric_totals(values, profile, specs)

    measured = (
        totals.join(_moments(values), KEYS, "left")
        .join(_quantiles(counts, specs, quantiles), KEYS, "left")
        .join(specs.drop("attribute", "segment_by"), ["service", "name"])
        .where("present > 0 OR agg = 'count'")
        .select(*specs.drop("attribute", "segment_by").columns, "segment", _value("").alias("value"), _value("_earlier").alias("earlier_value"))
        .where("value IS NOT NULL")
    )
    halved = F.col("agg").isin("count", "sum") & (F.col("baseline_scale") == "rate")
    from_half = F.when(halved, 2 * F.col("earlier_value")).otherwise(F.col("earlier_value"))
    rated = measured.withColumn("base", F.coalesce("baseline", from_half)).withColumn(
        "ratio", F.when(F.col("base").isNotNull(), worse_ratio(F.col("value"), F.col("base"), F.col("direction")))
    )
    status = (
        F.when(F.col("ratio") >= F.col("critical_ratio"), "CRITICAL")
        .when(F.col("ratio") >= F.col("warn_ratio"), "WARNING")
        .otherwise("HEALTHY")
    )
    scaled = F.col("ratio") / (2 * F.col("critical_ratio"))
    severity = (
        F.when(F.col("status") == "CRITICAL", F.least(F.lit(1.0), scaled))
        .when(F.col("status") == "WARNING", F.least(F.lit(0.6), scaled))
        .otherwise(0.0)
    )
    return rated.withColumn("status", status).select(
        *KEYS,
        "agg",
        round_to("value", 3).alias("value"),
        round_to("base", 3).alias("baseline"),
        "ratio",
        "status",
        round_to(severity, 2).alias("severity"),
    )


def metric_signals(metrics: DataFrame) -> DataFrame:
    """Custom metric rows in the shape of reliability signals."""
    label = F.when(F.col("segment") == "", F.col("name")).otherwise(
        F.concat("name", F.lit("["), "segment", F.lit("]"))
    )
    detail = F.concat(
        label, F.lit(" is "), F.col("value").cast("string"),
        F.coalesce(F.concat(F.lit(", baseline "), F.col("baseline").cast("string")), F.lit(", no baseline")),
    )
    return metrics.select(
        "service",
        F.lit("custom").alias("kind"),
        F.lit(100).alias("position"),
        label.alias("check"),
        "status",
        "severity",
        detail.alias("detail"),
        F.col("value").alias("current_value"),
    )


def zero_scores(metrics: DataFrame, specs: DataFrame) -> DataFrame:
    """Scores (higher is better) that fell to 0: their ratio is 0, which looks
    best, so they are listed separately."""
    scores = specs.where("direction = 'higher_is_better'").select("service", "name")
    return metrics.join(scores, ["service", "name"], "left_semi").where("value = 0 AND baseline <> 0")
