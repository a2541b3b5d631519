"""The continuous tap: messages to spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanvigil.sources import messages


def tap(
    stream: DataFrame,
    field_maps: DataFrame | None = None,
    id_column: str = "request_id",
    delay: str = "1 hour",
) -> DataFrame:
    """Decode and map each message once.

    A message read again within the watermark delay is dropped, so repeated peeks at
    a topic do not emit spans twice.  It is known by its service and id, without an
    id by its place in the topic; one with neither is never taken for another.
    """
    decoded = messages.decode(stream)
    mapped = messages.map_default(decoded) if field_maps is None else messages.map_configured(decoded, field_maps)
    named = F.when(F.col(id_column) != "", F.to_json(F.struct(*[c for c in ("service", "topic") if c in mapped.columns], id_column)))
    place = [c for c in ("topic", "service", "partition", "offset") if c in mapped.columns]
    placed = F.to_json(F.struct(*place)) if {"partition", "offset"} <= set(place) else F.lit(None)
    known = mapped.withColumn("_seen", F.coalesce(named, placed, F.uuid()))
    return known.withWatermark("start_time", delay).dropDuplicatesWithinWatermark(["_seen"]).drop("_seen")


def observed(spans: DataFrame, name: str = "tap") -> DataFrame:
    """Attach per-batch counters, visible to streaming query listeners."""
    return spans.observe(
        name,
        F.count(F.lit(1)).alias("emitted"),
        F.count_if(F.col("status_code") == "ERROR").alias("failed"),
    )
