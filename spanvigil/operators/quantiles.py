"""Exact quantiles of groups of any size.

The built-in exact ``percentile`` keeps all distinct values of a group in one
task.  Here a group is cut into ranges by an approximate sketch first; the
ranges' weights tell which range holds each wanted rank, and only those few
ranges are sorted, each on its own task.  Linear interpolation between the two
neighbouring order statistics, as pandas and ``percentile`` do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# 2**RANGE_BITS ranges per group; the sketch's rank error stays below half a range.
RANGE_BITS = 8
SKETCH_ACCURACY = 1000


def range_of(cuts: Column, value: Column, bits: int = RANGE_BITS) -> Column:
    """How many of the 2**bits - 1 sorted cuts lie below the value: a binary search."""
    steps = F.expr(f"array({', '.join(str(1 << bit) for bit in reversed(range(bits)))})")
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.element_at(cuts, at + step) < value, at + step).otherwise(at),
    )


def with_range(frame: DataFrame, out: str, cuts: str, value: str, bits: int = RANGE_BITS) -> DataFrame:
    """Add ``range_of`` as a column, a step of the search at a time: compiled, where a
    lambda is interpreted for every step of every row."""
    at, placed = F.col(out), frame.withColumn(out, F.lit(0))
    for step in (1 << bit for bit in reversed(range(bits))):
        placed = placed.withColumn(out, F.when(F.element_at(cuts, at + step) < F.col(value), at + step).otherwise(at))
    return placed


def doubles(numbers: Sequence[float]) -> Column:
    return F.expr(f"array({', '.join(f'{float(number)!r}D' for number in numbers)})")


def weighted_quantiles(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    fractions: Sequence[float],
) -> DataFrame:
    """``keys``, ``n`` (total weight), ``n_distinct`` and ``quantiles``
    (array<double>, one per fraction) of ``value`` weighted by ``weight``.

    ``counts`` holds one row per (keys, value) with non-null keys; rows with a
    NULL value or non-positive weight do not count.
    """
    keys = list(keys)
    rows = counts.select(
        *keys, F.col(value).cast("double").alias("_x"), F.col(weight).cast("bigint").alias("_w")
    ).where("_x IS NOT NULL AND _w > 0")

    n_ranges = 1 << RANGE_BITS
    shares = ", ".join(f"{i / n_ranges!r}D" for i in range(1, n_ranges))
    cuts = rows.groupBy(*keys).agg(
        F.expr(f"percentile_approx(_x, array({shares}), {SKETCH_ACCURACY})").alias("_cuts")
    )
    ranged = rows.join(cuts, keys).select(*keys, "_x", "_w", range_of(F.col("_cuts"), F.col("_x")).alias("_r"))

    # At most 2**RANGE_BITS rows per group from here on.
    along = Window.partitionBy(*keys).orderBy("_r")
    whole = Window.partitionBy(*keys)
    before = F.coalesce(
        F.sum("_rw").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    wanted_ranks = F.array_distinct(
        F.flatten(
            F.transform(
                doubles(fractions),
                lambda f: F.array(F.floor(f * (F.col("_n") - 1)), F.ceil(f * (F.col("_n") - 1))),
            )
        )
    )
    targets = (
        ranged.groupBy(*keys, "_r")
        .agg(F.sum("_w").alias("_rw"), F.count(F.lit(1)).alias("_rd"))
        .select(
            *keys,
            "_r",
            "_rw",
            before.alias("_base"),
            F.sum("_rw").over(whole).alias("_n"),
            F.sum("_rd").over(whole).alias("_d"),
        )
        .withColumn(
            "_wanted",
            F.filter(
                wanted_ranks,
                lambda k: (k >= F.col("_base")) & (k < F.col("_base") + F.col("_rw")),
            ),
        )
        .where(F.size("_wanted") > 0)
        .drop("_rw")
    )

    inside = Window.partitionBy(*keys, "_r").orderBy("_x").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    end = F.col("_base") + F.col("_cum")
    hits = (
        ranged.join(targets, [*keys, "_r"])
        .withColumn("_cum", F.sum("_w").over(inside))
        .select(
            *keys,
            "_n",
            "_d",
            "_x",
            F.filter("_wanted", lambda k: (k >= end - F.col("_w")) & (k < end)).alias("_hit"),
        )
        .where(F.size("_hit") > 0)
        .withColumn("_rank", F.explode("_hit"))
    )

    def interpolated(f: Column) -> Column:
        # Measured from the nearer neighbour, as numpy does.
        at = f * (F.col("n") - 1)
        part = at - F.floor(at)
        low, high = F.element_at("_at", F.floor(at)), F.element_at("_at", F.ceil(at))
        return F.when(part < 0.5, low + (high - low) * part).otherwise(high - (high - low) * (1 - part))

    # Two order statistics per fraction, so the collected map is small and fixed.
    return (
        hits.groupBy(*keys)
        .agg(
            F.max("_n").alias("n"),
            F.max("_d").alias("n_distinct"),
            F.map_from_entries(F.collect_set(F.struct("_rank", "_x"))).alias("_at"),
        )
        .select(*keys, "n", "n_distinct", F.transform(doubles(fractions), interpolated).alias("quantiles"))
    )


def quantiles(
    frame: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float]
) -> DataFrame:
    """Quantiles of unweighted rows: equal values are pre-aggregated first."""
    counts = (
        frame.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    return weighted_quantiles(counts, keys, value, "_rows", fractions)
