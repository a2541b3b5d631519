"""Prediction messages: decoding, peeking, and mapping to spans."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanvigil.functions.scalars import safe_double

# --- fixed values: fields of the built-in message shape ---------------------------
DEFAULT_INPUTS = ("seq_len", "api_fetch_limit", "n_pings_used", "shipper", "miles_remaining")
DEFAULT_PREDICTION = "predicted_eta_minutes"
DEFAULT_ACTUAL = "actual_eta_minutes"
DEFAULT_ERROR = "absolute_error_minutes"
REGIMES = ("healthy", "bugged", "failed", "unknown")
# ----------------------------------------------------------------------------------

MESSAGE = "MAP<STRING,VARIANT>"


def decode(messages: DataFrame, column: str = "value") -> DataFrame:
    """Add ``msg``: scalar fields of the JSON object as text.

    Malformed rows are dropped.  Nested objects, arrays and nulls are left out,
    as only scalars become span attributes.
    """
    parsed = F.from_json(F.col(column).cast("string"), MESSAGE)
    scalars = F.map_filter(parsed, lambda _, v: ~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY|VOID)"))
    texts = F.transform_values(scalars, lambda _, v: F.try_variant_get(v, "$", "string"))
    # Exploding zero or one map drops what did not parse and parses each value once;
    # a filter on the map would be pushed down and parse it again.
    return messages.withColumn("msg", F.explode(F.array_compact(F.array(texts))))


def peek_latest(messages: DataFrame, n: int) -> DataFrame:
    """The newest messages over all partitions of a topic.

    Each partition gives its last ``max(1, n div partitions + 1)`` offsets.  The
    constant bound on the row number lets Spark cut every partition down before
    the shuffle; the exact bound follows.
    """
    n_partitions = messages.agg(F.count_distinct("partition")).scalar()
    newest = Window.partitionBy("partition").orderBy(F.desc("offset"))
    return (
        messages.withColumn("place", F.row_number().over(newest))
        .where(F.col("place") <= n + 1)
        .where(F.col("place") <= F.greatest(F.lit(1), F.floor(F.lit(n) / n_partitions) + 1))
        .orderBy("place", "partition")
        .limit(n)
        .drop("place")
    )


def newest_offsets(begins: Mapping[str, Mapping[int, int]], ends: Mapping[str, Mapping[int, int]], n: int) -> dict[str, str]:
    """Reader options for the newest messages of some topics.

    ``begins`` and ``ends`` are the first kept and the next free offset per topic and
    partition.  Each partition gives its last ``max(1, n div partitions + 1)``
    offsets, none before its first kept one; only those are fetched.
    """
    since: dict[str, dict[str, int]] = {}
    for topic, partitions in ends.items():
        share = max(1, n // max(1, len(partitions)) + 1)
        since[topic] = {str(p): max(begins.get(topic, {}).get(p, 0), end - share) for p, end in sorted(partitions.items())}
    until = {topic: {str(p): end for p, end in sorted(partitions.items())} for topic, partitions in ends.items()}
    return {"startingOffsets": json.dumps(since), "endingOffsets": json.dumps(until)}


def message_spans(frames: DataFrame, service: str | None = None, field_maps: DataFrame | None = None) -> DataFrame:
    """Spans of a topic's frames (``value`` and, if there, ``timestamp`` and ``service``).

    The service is the given one, else the frame's, else the message's own field,
    else its topic.  A message without a time of its own takes the frame's.
    """
    decoded = decode(frames)
    known = [F.col(c) for c in ("service",) if c in frames.columns]
    topic = [F.col(c) for c in ("topic",) if c in frames.columns]
    name = F.lit(service) if service is not None else F.coalesce(*known, field("service"), *topic, F.lit(""))
    arrived = F.col("timestamp").cast("timestamp") if "timestamp" in frames.columns else F.lit(None).cast("timestamp")
    kept = decoded.select(name.alias("service"), arrived.alias("_arrived"), "msg")
    mapped = map_default(kept) if field_maps is None else map_configured(kept, field_maps)
    at = F.coalesce("start_time", "_arrived")
    return mapped.select(
        "service",
        at.alias("start_time"),
        at.alias("end_time"),
        "status_code",
        F.nullif("request_id", F.lit("")).alias("request_id"),
        F.nullif("model_version", F.lit("")).alias("model_version"),
        "inputs",
        "outputs",
        "evals",
        F.lit(None).cast("double").alias("latency_ms"),
    )


def field(name: Column | str) -> Column:
    return F.try_element_at("msg", F.lit(name) if isinstance(name, str) else name)


def _present(pairs: dict[str, Column]) -> Column:
    entries = [x for name, value in pairs.items() for x in (F.lit(name), value)]
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())


def absolute_error(prediction: Column, actual: Column) -> Column:
    return F.abs(safe_double(prediction) - safe_double(actual))


def map_default(decoded: DataFrame) -> DataFrame:
    """Messages or table rows of the built-in shape -> span columns and regime.

    A message with an error type is an errored span without prediction.  The named
    inputs of the shape are ``inputs``; ``payload`` keeps every scalar sent.
    """
    failed = F.map_contains_key("msg", F.lit("error_type"))
    ok = lambda c: F.when(~failed, c)
    prediction, actual = field(DEFAULT_PREDICTION), field(DEFAULT_ACTUAL)
    regime = F.coalesce(field("_regime"), F.lit("unknown"))
    stamp = field("timestamp")
    return decoded.withColumns(
        {
            "request_id": F.coalesce(field("request_id"), F.lit("")),
            "model_version": F.coalesce(field("model_version"), F.lit("")),
            "start_time": F.try_to_timestamp(stamp),
            "status_code": F.when(failed, "ERROR").otherwise("OK"),
            "error_type": field("error_type"),
            "inputs": _present({name: field(name) for name in DEFAULT_INPUTS}),
            "outputs": _present({"prediction": ok(prediction)}),
            "ground_truth": ok(safe_double(actual)),
            "evals": _present({DEFAULT_ERROR: ok(absolute_error(prediction, actual))}),
            "regime": F.when(failed, "failed").otherwise(regime),
        }
    ).withColumnRenamed("msg", "payload")


def map_configured(decoded: DataFrame, field_maps: DataFrame) -> DataFrame:
    """Messages with a ``service`` column -> span columns by the service's field map.

    A service without a map has the built-in shape.
    """
    mapped = F.array_compact(
        F.array("prediction_field", "actual_field", "error_field", "model_version_field", "timestamp_field")
    )
    explicit = F.size("input_fields") > 0
    inputs = F.map_filter(
        "msg",
        lambda k, v: F.when(explicit, F.array_contains("input_fields", k)).otherwise(
            ~F.startswith(k, F.lit("_")) & ~F.array_contains(mapped, k)
        ),
    )
    # Roles get their own names before the join, so they cannot clash.
    roles = field_maps.select(
        "service",
        *[F.col(r).alias(f"{r}_field") for r in ("prediction", "actual", "error", "model_version", "timestamp")],
        F.col("inputs").alias("input_fields"),
        F.lit(True).alias("_has_map"),
    )
    role = lambda name: F.when(F.col(f"{name}_field").isNotNull(), field(F.col(f"{name}_field")))
    error = F.when(role("error").isNotNull(), safe_double(role("error"))).otherwise(
        absolute_error(role("prediction"), role("actual"))
    )
    failed = F.map_contains_key("msg", F.lit("error_type"))
    by_map = {
        "model_version": role("model_version"),
        "start_time": F.try_to_timestamp(role("timestamp")),
        "inputs": inputs,
        "outputs": _present({"prediction": role("prediction")}),
        "ground_truth": role("actual"),
        "evals": _present({"error": error}),
    }
    plain = map_default(decoded.select("msg")).columns
    joined = decoded.join(roles, "service", "left")
    built_in = map_default(joined.withColumn("_msg", F.col("msg"))).withColumnRenamed("_msg", "msg")
    built_in = built_in.select(
        *decoded.columns, *[c for c in roles.columns if c != "service"],
        *[F.col(c).alias(f"_{c}") for c in plain if c != "payload"],
    )
    mapped = F.coalesce("_has_map", F.lit(False))
    return built_in.select(
        *[c for c in decoded.columns if c != "msg"],
        F.coalesce(field("request_id"), F.lit("")).alias("request_id"),
        F.when(failed, "ERROR").otherwise("OK").alias("status_code"),
        *[
            F.when(mapped, value).otherwise(F.col(f"_{name}").cast("string") if name == "ground_truth" else F.col(f"_{name}")).alias(name)
            for name, value in by_map.items()
        ],
        F.col("_regime").alias("regime"),
        F.col("msg").alias("payload"),
    )


def regime_counts(mapped: DataFrame) -> DataFrame:
    """Emitted spans per regime."""
    return mapped.groupBy("regime").agg(F.count(F.lit(1)).alias("n"))
