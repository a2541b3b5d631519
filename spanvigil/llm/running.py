"""Running sums over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanvigil.session import materialise


def running_sums(frame: DataFrame, keys: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the row and those before it in its group.

    Rows are dealt by range over (keys, order), so that a group that is larger than
    a partition lies in several neighbouring ones.  Sums run within a partition's
    part of a group; the sums of its parts, one row per partition, run over the
    group.  Rows that are equal in keys and order may stand in any sequence.
    """
    dealt = frame.repartitionByRange(*[F.col(k) for k in keys], *order)
    parts = materialise(dealt.withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy(*keys, "_part").agg(F.sum(value).alias("_all"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_part", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = parts.withColumn("_within", F.sum(value).over(inside))
    joined = within.join(totals, [*keys, "_part"]).withColumn(name, F.col("_within") + F.col("_earlier"))
    return joined.drop("_part", "_within", "_earlier")
