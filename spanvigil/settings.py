"""Service settings as typed rows.

Settings come from Python (these dataclasses) or from tables with the same
columns.  ``*_frame`` turns the dataclasses into local relations, whose size
Catalyst knows exactly: it broadcasts them when they are under
``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, fields

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# --- fixed values: defaults that results depend on --------------------------
DEFAULT_BASELINE = 150.0
WARNING_RATIO = 1.2
CRITICAL_RATIO = 2.0
PSI_WARNING = 0.10
PSI_CRITICAL = 0.25
PSI_FLOOR = 1e-4
PSI_BINS = 10
NUMERIC_SHARE = 0.8
ROLLING_DAYS = 7
ROLLING_FLOOR = 10.0
MIN_BASELINE_SPANS = 50
MIN_REVERT_CONFIDENCE = 0.7
DEFAULT_CHECKS = (
    "volume_drop",
    "silence",
    "error_rate",
    "latency_drift",
    "null_rate",
    "input_drift_auto",
    "output_drift",
    "schema_drift",
)
TIMESTAMP_FIELDS = ("timestamp", "ts", "event_time", "created_at", "prediction_time")
# -----------------------------------------------------------------------------

LOWER = "lower_is_better"
HIGHER = "higher_is_better"


@dataclass(frozen=True)
class ServiceSettings:
    # The defaults are fixed values: results depend on them.
    service: str
    lookback_minutes: int = 2880
    prediction_source: str = "spans"
    error_attribute: str = "eval.error"
    direction: str = LOWER
    segments: tuple[str, ...] = ()
    explicit_baseline: float | None = None
    configured_baseline: float | None = None
    warning_ratio: float = WARNING_RATIO
    critical_ratio: float = CRITICAL_RATIO
    psi_warning: float = PSI_WARNING
    psi_critical: float = PSI_CRITICAL
    attribute_baselines: dict[str, str] = field(default_factory=dict)
    attributes_of_interest: tuple[str, ...] = ()
    battery_enabled: bool = True
    disabled_checks: tuple[str, ...] = ()
    volume_drop_warn: float = 0.4
    volume_drop_critical: float = 0.7
    silence_warn_frac: float = 0.5
    null_rate_warn: float = 0.2
    error_rate_warn: float = 0.05
    error_rate_critical: float = 0.2
    latency_warn_ratio: float = 1.5
    latency_critical_ratio: float = 2.0
    drift_psi_warn: float = 0.10
    drift_psi_critical: float = 0.25


@dataclass(frozen=True)
class MetricSpec:
    """A user-declared metric.  ``agg`` is one of mean, p50, p95, p99, sum,
    count, rate, null_rate.  ``baseline_scale='rate'`` compares count and sum per
    unit of time instead of whole window against half window."""

    # The defaults are fixed values: results depend on them.
    service: str
    name: str
    attribute: str
    agg: str = "mean"
    direction: str = LOWER
    baseline: float | None = None
    warn_ratio: float = 1.5
    critical_ratio: float = 2.0
    segment_by: str | None = None
    baseline_scale: str = "window"


@dataclass(frozen=True)
class FieldMap:
    """Message field names for the span roles; empty ``inputs`` copies every
    scalar field that is neither private nor mapped."""

    service: str
    prediction: str | None = None
    actual: str | None = None
    error: str | None = None
    model_version: str | None = None
    timestamp: str | None = None
    inputs: tuple[str, ...] = ()


@dataclass(frozen=True)
class RegistryEntry:
    service: str
    model_family: str
    experiment: str
    expected_repo: str | None = None


_ARROW = {
    "str": pa.string(),
    "str | None": pa.string(),
    "int": pa.int64(),
    "float": pa.float64(),
    "float | None": pa.float64(),
    "bool": pa.bool_(),
    "tuple[str, ...]": pa.list_(pa.string()),
    "dict[str, str]": pa.map_(pa.string(), pa.string()),
}


def settings_frame(spark: SparkSession, rows: Iterable, kind: type) -> DataFrame:
    rows = list(rows)
    columns = {}
    for item in fields(kind):
        values = [getattr(row, item.name) for row in rows]
        if item.type.startswith("tuple"):
            values = [list(v) for v in values]
        elif item.type.startswith("dict"):
            values = [list(v.items()) for v in values]
        columns[item.name] = pa.array(values, type=_ARROW[item.type])
    return spark.createDataFrame(pa.table(columns))


def services_frame(spark: SparkSession, services: Iterable[ServiceSettings]) -> DataFrame:
    return settings_frame(spark, services, ServiceSettings)


def metric_specs_frame(spark: SparkSession, specs: Iterable[MetricSpec]) -> DataFrame:
    return settings_frame(spark, specs, MetricSpec)


def field_maps_frame(spark: SparkSession, maps: Iterable[FieldMap]) -> DataFrame:
    return settings_frame(spark, maps, FieldMap)


def registry_frame(spark: SparkSession, entries: Iterable[RegistryEntry]) -> DataFrame:
    return settings_frame(spark, entries, RegistryEntry)
