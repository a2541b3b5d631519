"""Continuous monitoring.

Aggregates that merge run as event-time windows in streaming state.  Checks that
need the whole window (quantile bins, percentiles) are evaluated per micro-batch
over the stored spans.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanvigil.functions.scalars import is_error_status
from spanvigil.session import checkpoint_dir
from spanvigil.sources.spans import recent


def window_metrics(
    spans: DataFrame, error: str = "error", lookback: str = "2 days", slide: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """Sliding-window counts, error mean, failure and null rates per service."""
    value = F.try_element_at("evals", F.lit(error))
    return (
        spans.withWatermark("start_time", delay)
        .groupBy(F.window("start_time", lookback, slide), "service")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("metric"),
            F.avg(is_error_status(F.col("status_code")).cast("double")).alias("error_rate"),
            F.avg(value.isNull().cast("double")).alias("null_rate"),
        )
        .select("service", F.col("window.start").alias("from"), F.col("window.end").alias("to"), "n", "metric", "error_rate", "null_rate")
    )


def silences(spans: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """One row whenever a service was silent for ``gap``: a session of spans that
    closed.  Session state is kept by Spark, keyed by service.

    Spans are merged to sessions within each input partition before the shuffle, so
    a hot service sends a few sessions a batch and not its spans.
    """
    spans.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return (
        spans.withWatermark("start_time", delay)
        .groupBy(F.session_window("start_time", gap).alias("session"), "service")
        .agg(F.count(F.lit(1)).alias("n"), F.max("start_time").alias("last_span"))
        .select("service", "last_span", "n", F.col("session.end").alias("silent_at"))
    )


def evaluate_batches(
    spans: DataFrame,
    store: str,
    evaluate: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    lookback_minutes: int,
    available_now: bool = False,
) -> StreamingQuery:
    """Store each micro-batch of spans by day, then evaluate the window that ends
    with the newest span stored.

    Only the days of the window are read; older ones are left to the store's own
    retention.  Both writes go to a folder named by the batch, so a repeated batch replaces
    itself instead of adding rows twice.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        dated = batch.withColumn("span_date", F.to_date("start_time"))
        dated.write.mode("overwrite").partitionBy("span_date").parquet(f"{store}/batch={batch_id}")
        stored = session.read.schema(dated.schema).option("basePath", store).parquet(store)
        newest = stored.agg(F.max("start_time")).first()[0]
        if newest is None:
            return
        window = recent(stored, F.lit(newest), lookback_minutes).drop("batch", "span_date")
        evaluate(window).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = spans.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def drain_evaluations(spans: DataFrame, evaluate: Callable[[DataFrame], DataFrame], lookback_minutes: int) -> DataFrame:
    """Process what the source holds now; the results carry their ``batch``."""
    spark = spans.sparkSession
    base = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    query = evaluate_batches(spans, f"{base}/spans", evaluate, f"{base}/rows", f"{base}/checkpoint", lookback_minutes, available_now=True)
    query.awaitTermination()
    return spark.read.parquet(f"{base}/rows")
