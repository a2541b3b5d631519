"""Where a service's baseline comes from, and the artifacts that carry it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanvigil.operators.profiles import REST
from spanvigil.settings import DEFAULT_BASELINE, ROLLING_DAYS, ROLLING_FLOOR


def modal_key(distribution: Column) -> Column:
    """Key with the largest fraction of a value -> fraction map; ties by key.

    REST is the share of many values, not a value, and no mode; a map that holds
    nothing else means the value of that name.
    """
    entries = F.map_entries(distribution)
    listed = F.filter(entries, lambda e: e["key"] != REST)
    ranked = F.transform(
        F.when(F.size(listed) > 0, listed).otherwise(entries),
        lambda e: F.struct((-e["value"]).alias("k"), e["key"].alias("key")),
    )
    return F.array_min(ranked)["key"]


def modal_attributes(distributions: Column) -> Column:
    """attribute -> modal value, from attribute -> (value -> fraction)."""
    filled = F.map_filter(distributions, lambda _, d: F.coalesce(F.size(d) > 0, F.lit(False)))
    return F.transform_values(filled, lambda _, d: modal_key(d))


def training_lookup(artifacts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per service the artifact of the wanted version, else the newest one.

    ``wanted``: service, wanted_version (NULL for newest).  ``row_number() = 1``
    prunes to one row per service before the shuffle.
    """
    exact = F.coalesce(F.col("model_version") == F.col("wanted_version"), F.lit(False))
    order = Window.partitionBy("service").orderBy(F.desc("exact"), F.desc("trained_at"), F.desc("model_version"))
    return (
        artifacts.join(wanted, "service")
        .withColumn("exact", exact)
        .withColumn("place", F.row_number().over(order))
        .where("place = 1")
        .drop("place", "exact", "wanted_version")
    )


def rolling_error(
    predictions: DataFrame, actuals: DataFrame, as_of: Column, keys: list[str], days: int = ROLLING_DAYS
) -> DataFrame:
    """Mean absolute error of the last days' predictions that have an actual.

    Both sides are projected to the join columns; predictions are filtered on
    time before the join.
    """
    since = as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    recent = predictions.where(F.col("timestamp") >= since).select("load_id", "predicted", *keys)
    return (
        recent.join(actuals.select("load_id", "actual"), "load_id")
        .groupBy(*keys)
        .agg(F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae"), F.count(F.lit(1)).alias("n"))
        .withColumn("usable", F.coalesce(F.col("mae") >= ROLLING_FLOOR, F.lit(False)))
    )


def resolve_baselines(
    services: DataFrame,
    training: DataFrame | None = None,
    calibration: DataFrame | None = None,
    rolling: DataFrame | None = None,
    metric_name: str = "mae_minutes",
) -> DataFrame:
    """service, baseline, baseline_source, direction, expected (attribute map),
    baseline_version.

    Metric: explicit, training, calibration, rolling, configured, default.
    Attributes: training, calibration, configured.  The two chains are
    separate.  All inputs hold one row per service.
    """
    joined = services
    if training is not None:
        joined = joined.join(
            training.select(
                "service",
                F.try_element_at("metrics", F.lit(metric_name)).alias("trained_metric"),
                F.col("model_version").alias("trained_version"),
                modal_attributes(F.col("attribute_distributions")).alias("trained_attributes"),
            ),
            "service",
            "left",
        )
    if calibration is not None:
        joined = joined.join(
            calibration.select(
                "service",
                F.col("metric").alias("calibrated_metric"),
                F.col("generated_at").alias("calibrated_at"),
                F.col("model_version").alias("calibrated_version"),
                F.col("attribute_modes").alias("calibrated_attributes"),
            ),
            "service",
            "left",
        )
    if rolling is not None:
        joined = joined.join(
            rolling.where("usable").select("service", F.col("mae").alias("rolling_metric")), "service", "left"
        )
    absent = {
        "trained_metric": "double",
        "trained_version": "string",
        "trained_attributes": "map<string,string>",
        "calibrated_metric": "double",
        "calibrated_at": "string",
        "calibrated_version": "string",
        "calibrated_attributes": "map<string,string>",
        "rolling_metric": "double",
    }
    joined = joined.withColumns(
        {name: F.lit(None).cast(kind) for name, kind in absent.items() if name not in joined.columns}
    )

    chain = [
        (F.col("explicit_baseline"), F.lit("explicit")),
        (F.col("trained_metric"), F.concat(F.lit("training@"), F.coalesce("trained_version", F.lit("?")))),
        (F.col("calibrated_metric"), F.concat(F.lit("calibration@"), F.coalesce("calibrated_at", F.lit("?")))),
        (F.col("rolling_metric"), F.lit(f"rolling:{ROLLING_DAYS}d")),
        (F.col("configured_baseline"), F.lit("configured")),
        (F.lit(DEFAULT_BASELINE), F.lit("default")),
    ]
    source = F.coalesce(*[F.when(value.isNotNull(), label) for value, label in chain])
    filled = lambda name: F.when(F.size(name) > 0, F.col(name))
    return joined.select(
            "service",
            F.coalesce(*[value for value, _ in chain]).alias("baseline"),
            source.alias("baseline_source"),
            "direction",
            F.coalesce(
                filled("trained_attributes"), filled("calibrated_attributes"), F.col("attribute_baselines")
            ).alias("expected"),
            F.coalesce("calibrated_version", "trained_version").alias("baseline_version"),
        )


def expected_values(resolved: DataFrame) -> DataFrame:
    """service, attribute, expected: the resolved attribute maps as rows."""
    return resolved.select("service", F.explode("expected").alias("attribute", "expected"))
