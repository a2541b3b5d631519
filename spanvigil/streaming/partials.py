"""Continuous window metrics from stored day partials.

A window of days is the sum of its days.  Each micro-batch adds to the partials of
the days that it brings and to no others; an evaluation merges the partials of the
window, whose number depends on services and days alone.  Spans are never stored
nor read again.

Partials lie in ``store/upto=<batch>/span_date=<day>``: the sums of a day up to a
batch.  A batch starts from the newest sums before itself, so a repeated batch
replaces its own result.  Sums that a later committed batch has superseded and days
behind the window are deleted, so at most two versions of a window's days are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanvigil.functions.scalars import is_error_status
from spanvigil.operators.attributes import with_error

PARTIAL = "service string, n long, n_error long, error_sum double, n_failed long, last_span timestamp, latency binary, span_date date"

#: Items of the latency sketch; its rank error is about half a percent.
SKETCH_ITEMS = 800


def day_partials(spans: DataFrame, services: DataFrame) -> DataFrame:
    """One mergeable row per (service, day) of the spans."""
    dated = with_error(spans, services).withColumn("span_date", F.to_date("start_time"))
    return dated.where("span_date IS NOT NULL").groupBy("service", "span_date").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("error").alias("n_error"),
        F.coalesce(F.sum("error"), F.lit(0.0)).alias("error_sum"),
        F.count_if(is_error_status(F.col("status_code"))).alias("n_failed"),
        F.max("start_time").alias("last_span"),
        F.kll_sketch_agg_double("latency_ms", F.lit(SKETCH_ITEMS)).alias("latency"),
    )


def _merged(partials: DataFrame, *keys: str) -> DataFrame:
    return partials.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("n", "n_error", "error_sum", "n_failed")],
        F.max("last_span").alias("last_span"),
        F.kll_merge_agg_double("latency").alias("latency"),
    )


def window_metrics(partials: DataFrame) -> DataFrame:
    """service, n, metric, error_rate, null_rate, last_span, p95_latency (approximate)."""
    whole = _merged(partials, "service")
    known = F.kll_sketch_get_n_double("latency") > 0
    return whole.select(
        "service",
        "n",
        F.try_divide("error_sum", "n_error").alias("metric"),
        (F.col("n_failed") / F.col("n")).alias("error_rate"),
        ((F.col("n") - F.col("n_error")) / F.col("n")).alias("null_rate"),
        "last_span",
        F.when(known, F.kll_sketch_get_quantile_double("latency", F.lit(0.95))).alias("p95_latency"),
    )


class DayStore:
    """The versions of a store's days, found by listing folders and not by reading."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._top = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[tuple[int, date]]:
        found = self._files.globStatus(self._top.suffix("/upto=*/span_date=*"))
        named = (re.search(r"upto=(\d+)/span_date=([0-9-]{10})$", status.getPath().toString()) for status in found or [])
        return sorted((int(m[1]), date.fromisoformat(m[2])) for m in named if m)

    def newest(self, below: int) -> dict[date, int]:
        """Day to its newest version of a batch before ``below``."""
        return {day: batch for batch, day in self.versions() if batch < below}

    def folder(self, batch: int, day: date) -> str:
        return f"{self.path}/upto={batch}/span_date={day}"

    def read(self, versions: Iterable[tuple[int, date]]) -> DataFrame:
        schema = ", ".join(part for part in PARTIAL.split(", ") if not part.startswith("span_date"))
        folders = [self.folder(*version) for version in versions]
        reader = self.spark.read.schema(f"{schema}, upto long, span_date date").option("basePath", self.path)
        rows = reader.parquet(*folders) if folders else self.spark.createDataFrame([], f"{schema}, upto long, span_date date")
        return rows.drop("upto")

    def clean(self, batch: int, since: date) -> None:
        """Delete days before ``since`` and what a batch before ``batch`` superseded."""
        committed = self.newest(batch)
        for version, day in self.versions():
            if day < since or version < committed.get(day, version):
                self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.folder(version, day)), True)


def step(batch: DataFrame, batch_id: int, store: str, services: DataFrame, lookback_days: int, as_of: date | None) -> DataFrame | None:
    """Add a batch to the store; the metrics of the window that ends with its newest day.

    Days after ``as_of`` are left out, so that one span dated in the future moves no
    window; so are days behind the window.
    """
    days = DayStore(batch.sparkSession, store)
    partials = day_partials(batch, services)
    if as_of is not None:
        partials = partials.where(F.col("span_date") <= F.lit(as_of))
    before = days.newest(batch_id)
    partials = partials.persist()
    try:
        # One row per day and service; the days of a batch are few.
        arrived = {row[0] for row in partials.select("span_date").distinct().collect()}
        known = arrived | set(before)
        if not known:
            return None
        newest = max(known)
        since = newest - timedelta(days=lookback_days - 1)
        touched = sorted(day for day in arrived if day >= since)
        added = partials.where(F.col("span_date") >= F.lit(since)).select(*[part.split()[0] for part in PARTIAL.split(", ")])
        earlier = days.read((before[day], day) for day in touched if day in before)
        _merged(added.unionByName(earlier), "service", "span_date").write.mode("overwrite").partitionBy("span_date").parquet(f"{store}/upto={batch_id}")
    finally:
        partials.unpersist()
    current = days.newest(batch_id + 1)
    days.clean(batch_id, since)
    return window_metrics(days.read((version, day) for day, version in current.items() if day >= since))


def continuous_metrics(
    spans: DataFrame,
    services: DataFrame,
    store: str,
    out: str,
    checkpoint: str,
    lookback_days: int,
    as_of: date | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Window metrics after every micro-batch, in ``out/batch=<id>``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        metrics = step(batch, batch_id, store, services, lookback_days, as_of)
        if metrics is not None:
            metrics.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = spans.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
