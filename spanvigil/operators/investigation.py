"""Evidence behind anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanvigil.functions.scalars import round_to, safe_double, segment_attribute, segment_key, segment_value, with_segment_key
from spanvigil.session import materialise

#: Anomalies of a service that one row of the probe table holds, on average.
LIST_ANOMALIES = 512


def _wanted_lists(anomalies: DataFrame) -> DataFrame:
    """service, _wanted (attribute -> values): the anomalies in lists of bounded length."""
    wanted = (
        anomalies.select("service", segment_attribute(F.col("segment")).alias("attr"), segment_value(F.col("segment")).alias("value"))
        .where("attr IS NOT NULL")
        .distinct()
    )
    sizes = wanted.groupBy("service").agg(F.ceil(F.count(F.lit(1)) / LIST_ANOMALIES).alias("_lists"))
    dealt = wanted.join(sizes, "service").withColumn("_list", F.pmod(F.xxhash64("attr", "value"), F.col("_lists")))
    values = dealt.groupBy("service", "_list", "attr").agg(F.collect_set("value").alias("values"))
    entries = F.map_from_entries(F.collect_list(F.struct("attr", "values"))).alias("_wanted")
    return values.groupBy("service", "_list").agg(entries).drop("_list")


def anomaly_spans(spans: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Spans behind every ``attribute=value`` anomaly (service, segment).

    A span is probed against the anomalies of its service inside the row: only its
    matching inputs become rows.  The lists are written, so Spark knows their size
    and broadcasts them only below its threshold.
    """
    lists = materialise(_wanted_lists(anomalies))

    def asked(e: Column) -> Column:
        key = segment_key(e["value"], safe_double(e["value"]))
        return F.coalesce(F.array_contains(F.try_element_at("_wanted", e["key"]), key), F.lit(False))

    hits = spans.join(lists, "service").withColumn("_hit", F.explode(F.filter(F.map_entries("inputs"), asked)))
    return hits.select(
        "service",
        F.concat(F.lit("input."), F.col("_hit.key")).alias("attr"),
        F.col("_hit.value").alias("value"),
        "start_time",
        "request_id",
        "evals",
    ).transform(with_segment_key, "value")


def drill_down(matched: DataFrame, samples: int, error: str = "error") -> DataFrame:
    """Per anomaly: spans, first and last seen, mean error, earliest request ids.

    The samples are chosen by a bounded row number, so no group is collected.  The
    matching rows are written first: the spans are read once for both results.
    """
    keys = ["service", "attr", "value"]
    matched = materialise(matched.select(*keys, "start_time", "request_id", F.try_element_at("evals", F.lit(error)).alias("_error")))
    first = Window.partitionBy(*keys).orderBy("start_time", "request_id")
    ids = (
        matched.select(*keys, "start_time", "request_id")
        .withColumn("nth", F.row_number().over(first))
        .where(F.col("nth") <= samples)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("nth", "request_id"))).alias("s"))
        .select(*keys, F.transform("s", lambda e: e["request_id"]).alias("sample_ids"))
    )
    return (
        matched.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("start_time").alias("earliest"),
            F.max("start_time").alias("latest"),
            round_to(F.avg("_error"), 1).alias("mean_error"),
        )
        .join(ids, keys)
    )
