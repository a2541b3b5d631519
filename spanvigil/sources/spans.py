"""Readers that end in the canonical spans table.

spans: service, start_time, end_time, status_code, request_id, model_version,
inputs MAP<STRING,STRING>, outputs MAP<STRING,STRING>, evals MAP<STRING,DOUBLE>,
latency_ms DOUBLE.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from spanvigil.functions.scalars import assert_table_identifier, safe_double
from spanvigil.settings import TIMESTAMP_FIELDS
from spanvigil.sources.messages import message_spans

SPAN_SCHEMA = (
    "service string, start_time timestamp, end_time timestamp, status_code string, "
    "request_id string, model_version string, inputs map<string,string>, "
    "outputs map<string,string>, evals map<string,double>, latency_ms double"
)
SPAN_COLUMNS = [part.split()[0] for part in SPAN_SCHEMA.split(", ")]


def recent(spans: DataFrame, as_of: Column, lookback_minutes: int) -> DataFrame:
    """Spans of the last minutes; the bound is a literal that reaches the scan.
    A table partitioned by ``span_date`` is pruned as well."""
    since = as_of - F.make_dt_interval(mins=F.lit(lookback_minutes))
    out = spans.where(F.col("start_time") >= since)
    if "span_date" in spans.columns:
        out = out.where(F.col("span_date") >= F.to_date(since))
    return out


def services_seen(spans: DataFrame) -> DataFrame:
    return spans.select("service").distinct()


def flatten_attributes(frame: DataFrame, column: str = "attributes") -> DataFrame:
    """Nested JSON attributes -> MAP of dotted scalar names, in ``flat``.

    Objects are expanded to any depth (``model.artifact.version``), arrays stay JSON
    text, nulls are left out, numbers keep their text.  Where a dotted name and a
    nested one coincide, the one nearer the top wins.  Malformed JSON gives an empty
    map.  Depth is open, which column functions cannot express: the walk is a small
    Arrow-batched function.
    """
    return frame.withColumn("flat", _flat(F.col(column).cast("string")))


def flat_scalars(text: str | None) -> dict[str, str]:
    try:
        top = json.loads(text or "", parse_int=str, parse_float=str, parse_constant=str)
    except (ValueError, RecursionError):
        return {}
    if not isinstance(top, dict):
        return {}
    out: dict[str, str] = {}
    level = [("", top)]
    while level:
        deeper = []
        for prefix, node in level:
            for name, value in node.items():
                if isinstance(value, dict):
                    deeper.append((f"{prefix}{name}.", value))
                elif value is not None:
                    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
                    out.setdefault(prefix + name, text)
        level = deeper
    return out


_flat = F.udf(flat_scalars, MapType(StringType(), StringType()), useArrow=True)


def with_start_time(frame: DataFrame) -> DataFrame:
    """Normalise the first present timestamp column to ``start_time``."""
    if "start_time" in frame.columns:
        return frame.withColumn("start_time", to_utc(frame, "start_time"))
    for name in TIMESTAMP_FIELDS:
        if name in frame.columns:
            return frame.withColumn("start_time", to_utc(frame, name))
    return frame.withColumn("start_time", F.lit(None).cast("timestamp"))


def to_utc(frame: DataFrame, name: str) -> Column:
    """Timestamp from text, timestamp or epoch nanoseconds; NULL if unreadable."""
    kind = dict(frame.dtypes)[name]
    if kind == "bigint":
        return F.timestamp_micros((F.col(name) / 1000).cast("bigint"))
    if kind == "string":
        return F.try_to_timestamp(F.col(name))
    return F.col(name).cast("timestamp")


def with_latency(frame: DataFrame) -> DataFrame:
    """``latency_ms`` from the first present of: the column, the two evals that
    may carry it, the span's duration."""
    candidates = []
    if "latency_ms" in frame.columns:
        candidates.append(F.col("latency_ms").cast("double"))
    candidates += [F.try_element_at("evals", F.lit(name)) for name in ("latency_ms", "duration_ms")]
    candidates.append((F.unix_micros("end_time") - F.unix_micros("start_time")) / F.lit(1000.0))
    return frame.withColumn("latency_ms", F.coalesce(*candidates))


def _joined(first: Column, second: Column) -> Column:
    """Both maps in one; where a key is in both, the first wins."""
    return F.map_concat(first, F.map_filter(second, lambda k, _: ~F.map_contains_key(first, k)))


def spans_from_rows(frame: DataFrame, roles: dict[str, str], service: Column, error: str = "error") -> DataFrame:
    """Warehouse rows -> canonical spans.

    ``roles`` names the columns of prediction, actual, error, model_version,
    timestamp and request_id, as far as there are any.  Every other column is an
    input, as text; the error is taken, or made from prediction and actual.
    """
    role = lambda name: F.col(roles[name]) if name in roles else F.lit(None)
    inputs = [c for c in frame.columns if c not in roles.values()]
    made = F.abs(safe_double(role("prediction").cast("string")) - safe_double(role("actual").cast("string")))
    value = F.coalesce(safe_double(role("error").cast("string")), made)
    entries = [x for c in inputs for x in (F.lit(c), F.col(c).cast("string"))]
    present = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
    at = to_utc(frame, roles["timestamp"]) if "timestamp" in roles else F.lit(None).cast("timestamp")
    return frame.select(
        service.cast("string").alias("service"),
        at.alias("start_time"),
        F.lit(None).cast("timestamp").alias("end_time"),
        F.lit("OK").alias("status_code"),
        role("request_id").cast("string").alias("request_id"),
        role("model_version").cast("string").alias("model_version"),
        (present(F.create_map(*entries)) if entries else F.expr("CAST(map() AS MAP<STRING,STRING>)")).alias("inputs"),
        present(F.create_map(F.lit("prediction"), role("prediction").cast("string"))).alias("outputs"),
        present(F.create_map(F.lit(error), value)).alias("evals"),
        F.lit(None).cast("double").alias("latency_ms"),
    )


def spans_from_flat(frame: DataFrame) -> DataFrame:
    """``flat`` attribute map -> canonical span columns."""

    def under(prefix: str) -> Column:
        chosen = F.map_filter("flat", lambda k, _: F.startswith(k, F.lit(prefix)))
        return F.transform_keys(chosen, lambda k, _: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))

    # ``prediction.value`` is the prediction unless ``prediction.prediction`` says otherwise.
    named = under("prediction.")
    predicted = _joined(
        F.map_filter(named, lambda k, _: k != "value"),
        F.transform_keys(F.map_filter(named, lambda k, _: k == "value"), lambda k, _: F.lit("prediction")),
    )
    numbers = F.map_filter(
        F.transform_values(under("eval."), lambda _, v: safe_double(v)), lambda _, v: v.isNotNull()
    )
    return frame.select(
        "service",
        "start_time",
        "end_time",
        "status_code",
        F.try_element_at("flat", F.lit("request_id")).alias("request_id"),
        F.try_element_at("flat", F.lit("model.version")).alias("model_version"),
        under("input.").alias("inputs"),
        _joined(under("output."), predicted).alias("outputs"),
        numbers.alias("evals"),
    ).transform(with_latency)


def read_predictions(spark: SparkSession, source: str, location: str, **options: str) -> DataFrame:
    """Frame of a prediction source by kind: parquet, orc, json or csv folders, a
    catalog table, JDBC or Kafka (batch).  A missing location gives an empty
    spans frame, so the service shows up as one without data.  Messages of a topic
    come as spans; ``messages.newest_offsets`` gives options that bound the read.
    """
    try:
        if source == "table":
            frame = spark.table(assert_table_identifier(location))
        elif source == "jdbc":
            frame = spark.read.format("jdbc").options(dbtable=assert_table_identifier(location), **options).load()
        elif source == "kafka":
            frame = spark.read.format("kafka").options(subscribe=location, **options).load()
        else:
            frame = spark.read.format(source).options(**options).load(location)
    except AnalysisException:
        return spark.createDataFrame([], SPAN_SCHEMA)
    return message_spans(frame) if source == "kafka" else with_start_time(frame)


def union_spans(frames: list[DataFrame]) -> DataFrame:
    """Spans of several sources; columns a source lacks become NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.select(*SPAN_COLUMNS)


def append_spans(spans: DataFrame, path: str) -> None:
    """Append to the span store, partitioned by day for lookback pruning."""
    spans.withColumn("span_date", F.to_date("start_time")).write.mode("append").partitionBy(
        "span_date"
    ).parquet(path)
