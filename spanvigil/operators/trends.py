"""Daily trends.  Rows are aggregated to days before any window runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanvigil.operators.quantiles import quantiles

ROLLING_WARNING = 1.5
ROLLING_CRITICAL = 2.0
DECILES = 10


def daily_errors(errors: DataFrame, keys: list[str]) -> DataFrame:
    return errors.groupBy(*keys, F.to_date("time").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("error").alias("mae")
    )


def rolling_trend(daily: DataFrame, keys: list[str], days: int = 6) -> DataFrame:
    """Daily error and the average of the preceding days, rated against it."""
    before = Window.partitionBy(*keys).orderBy("day").rowsBetween(-days, -1)
    status = (
        F.when(F.col("mae") > ROLLING_CRITICAL * F.col("rolling_mae"), "CRITICAL")
        .when(F.col("mae") > ROLLING_WARNING * F.col("rolling_mae"), "WARNING")
        .otherwise("HEALTHY")
    )
    return daily.withColumn("rolling_mae", F.avg("mae").over(before)).withColumn("status", status)


def last_days(errors: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    return errors.where(F.col("time") >= as_of - F.make_dt_interval(days=F.lit(days)))


def day_over_day(rows: DataFrame, keys: list[str], drop: float = 0.5, fill_days: int = 400) -> DataFrame:
    """Daily volume and whether it fell by more than ``drop`` from the day before.

    Days without any row count 0, from a key's first day to its last; so does a
    day after the last one if another key has it.  A gap is listed for ``fill_days``
    days at most, so that a wrongly dated row does not bring centuries of them.
    """
    daily = rows.groupBy(*keys, F.to_date("time").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    last = daily.agg(F.max("day")).scalar()
    order = Window.partitionBy(*keys).orderBy("day")
    until = F.coalesce(F.date_sub(F.lead("day").over(order), 1), F.lit(last))
    listed = F.sequence("day", F.least(F.date_add("day", fill_days), until))
    days = daily.withColumn("_days", listed).select(*keys, F.posexplode("_days").alias("_at", "day"), F.col("n").alias("_n"))
    daily = days.select(*keys, "day", F.when(F.col("_at") == 0, F.col("_n")).otherwise(F.lit(0).cast("long")).alias("n"))
    # After a gap that was not listed in full the day before had no rows.
    before = F.when(F.lag("day").over(order) == F.date_sub("day", 1), F.lag("n").over(order)).when(F.lag("day").over(order).isNotNull(), 0)
    return daily.withColumn("previous", before).withColumn(
        "status", F.when(F.col("n") < (1 - drop) * F.col("previous"), "WARNING").otherwise("HEALTHY")
    )


def bucket_deciles(errors: DataFrame, bucket: str, position: str) -> DataFrame:
    """Error per bucket and decile of ``position``.

    Deciles come from exact quantile edges of each bucket (right closed), not
    from a row-number window over the bucket.
    """
    fractions = [i / DECILES for i in range(1, DECILES)]
    edges = quantiles(errors, [bucket], position, fractions).select(bucket, F.col("quantiles").alias("edges"))
    return (
        errors.join(edges, bucket)
        .withColumn("decile", F.size(F.filter("edges", lambda e: e < F.col(position))) + 1)
        .groupBy(bucket, "decile")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("error").alias("mae"))
    )


def drift_onset(rated: DataFrame, keys: list[str]) -> DataFrame:
    """First day that was not healthy."""
    return rated.where("status <> 'HEALTHY'").groupBy(*keys).agg(F.min("day").alias("onset"))
