"""Earlier / recent halves of each service's window.

The midpoint is data dependent: halfway between a service's first and last
span.  It comes from one narrow aggregate (two columns of the scan), written as
a small table; below the broadcast threshold the row-level join then needs no
shuffle of the spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanvigil.session import materialise

MIN_ROWS = 4


def window_bounds(spans: DataFrame) -> DataFrame:
    """Per service: micros of the first and last span, and whether it splits.

    A split needs four timed spans and both halves occupied; the last span is
    always in the recent half as soon as it is later than the first one.
    """
    micros = F.unix_micros("start_time")
    bounds = spans.groupBy("service").agg(
        F.min(micros).alias("lo"),
        F.max(micros).alias("hi"),
        F.count("start_time").alias("timed"),
    )
    return bounds.withColumn("splits", (F.col("timed") >= MIN_ROWS) & (F.col("hi") > F.col("lo")))


def with_halves(spans: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Add ``half``: 'earlier', 'recent', or NULL where the window has no split.

    The comparison is done on doubled integers, so no boundary span moves
    through rounding.
    """
    bounds = materialise(window_bounds(spans)) if bounds is None else bounds
    twice = F.unix_micros("start_time") * 2
    middle = F.col("lo") + F.col("hi")
    half = F.when(F.col("splits"), F.when(twice <= middle, "earlier").when(twice > middle, "recent"))
    return (
        spans.join(bounds.select("service", "lo", "hi", "splits"), "service", "left")
        .withColumn("half", half)
        .drop("lo", "hi", "splits")
    )
