"""Window functions over groups too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_by_chunk(frame: DataFrame, key: str, time: str, tie: str, value: str, chunk: Column, out: str) -> DataFrame:
    """``lag(value) over (partition by key order by time, tie)``.

    The group is cut along time into chunks (``chunk`` must not decrease with
    ``time``); inside a chunk it is a plain window, and only a chunk's first row
    takes the last value of the previous chunk.  The per-key window then runs
    over chunks instead of rows.
    """
    # Rows without a readable time come first, in a chunk of their own.
    cut = frame.withColumn("_chunk", F.coalesce(chunk.cast("long"), F.lit(-(2**62))))
    order = Window.partitionBy(key, "_chunk").orderBy(time, tie)
    ends = cut.groupBy(key, "_chunk").agg(F.max(F.struct(time, tie, F.col(value).alias("_last"))).alias("_end"))
    along = Window.partitionBy(key).orderBy("_chunk")
    carried = ends.select(key, "_chunk", F.lag("_end._last").over(along).alias("_carried"))
    return (
        cut.withColumn("_within", F.lag(value).over(order))
        .withColumn("_nth", F.row_number().over(order))
        .join(carried, [key, "_chunk"])
        .withColumn(out, F.when(F.col("_nth") == 1, F.col("_carried")).otherwise(F.col("_within")))
        .drop("_chunk", "_within", "_nth", "_carried")
    )
