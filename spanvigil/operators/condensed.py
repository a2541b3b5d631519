"""Count tables that stay small where values are many, with exact answers.

A count table has a row per value; for a continuous attribute that is a row per
span.  Here sketches come first: one pass makes a mergeable quantile sketch and a
distinct count per attribute, a second counts the rows in each of the ranges that
the sketch cuts, and a third fetches single values only from the ranges in which a
wanted rank lies.  Every other range is one row, placed at its largest value.

The result has the columns of ``attributes.attribute_counts`` and gives the same
quantiles at the wanted fractions, the same counts on either side of a quantile and
the same sums.  No exchange is keyed by a number of a continuous attribute.  The
spans are read and their maps taken apart once: the passes read a written table of
narrow attribute rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanvigil.operators.attributes import GROUP, attribute_rows, configured_names, summed, value_key
from spanvigil.operators.quantiles import doubles, weighted_quantiles, with_range
from spanvigil.session import drop_table, materialise
from spanvigil.settings import NUMERIC_SHARE, PSI_BINS

#: 2**BITS ranges per attribute, cut by a sketch of this many items.
BITS, SKETCH_ITEMS = 9, 1600

#: An attribute with more distinct numbers than this is continuous.
MANY_VALUES = 1024

#: Wanted fractions by part of the window: quantile bins and percentiles.
PERCENTILES = [0.5, 0.95, 0.99]
WANTED = {
    "": PERCENTILES,
    "_earlier": sorted({i / PSI_BINS for i in range(PSI_BINS + 1)} | {i * (1.0 / PSI_BINS) for i in range(PSI_BINS)} | set(PERCENTILES)),
    "_recent": PERCENTILES,
}


def attribute_profile(rows: DataFrame, services: DataFrame) -> DataFrame:
    """Per (service, attr, segment): ``continuous`` and, if so, the ``cuts`` of its ranges.

    One pass; sketches merge on the map side, so what is shuffled does not grow with
    the spans.  Attributes that settings name and those that count as text in drift
    checks keep a row per value.
    """
    earlier, recent, x = F.col("half") == "earlier", F.col("half") == "recent", F.col("x")
    # Bins are made of a feature's earlier half, so that is where its values are told apart.
    feature = F.col("attr").startswith("input.") | F.col("attr").startswith("output.")
    seen = rows.groupBy(*GROUP).agg(
        F.count_if(earlier).alias("n_earlier"),
        F.count_if(recent).alias("n_recent"),
        F.count(F.when(earlier, x)).alias("numeric_earlier"),
        F.count(F.when(recent, x)).alias("numeric_recent"),
        F.count("x").alias("numeric"),
        F.approx_count_distinct(F.when(earlier | ~feature, x)).alias("distinct"),
        F.kll_sketch_agg_double("x", F.lit(SKETCH_ITEMS)).alias("sketch"),
    )
    sided = (F.col("n_earlier") > 0) & (F.col("n_recent") > 0)
    numbers = (F.col("numeric_earlier") > NUMERIC_SHARE * F.col("n_earlier")) & (F.col("numeric_recent") > NUMERIC_SHARE * F.col("n_recent"))
    many = (numbers | ~(sided & feature)) & (F.col("distinct") > MANY_VALUES)
    named = F.coalesce(F.array_contains("names", F.col("attr")), F.lit(False))
    judged = seen.join(configured_names(services), "service", "left").withColumn("continuous", many & ~named)
    shares = doubles([i / (1 << BITS) for i in range(1, 1 << BITS)])
    cuts = F.when(F.col("continuous") & (F.col("numeric") > 0), F.kll_sketch_get_quantile_double("sketch", shares))
    return judged.select(*GROUP, "continuous", cuts.alias("cuts"))


def range_counts(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """The count table with a row per range of a continuous attribute and a row per
    value of any other; what is no number in a continuous one is range -1."""
    place = F.when(F.col("continuous"), F.when(F.col("x").isNull(), -1).otherwise(F.col("_at")))
    placed = with_range(rows.join(profile, GROUP), "_at", "cuts", "x", BITS).withColumn("range", place)
    kept = F.when(~F.col("continuous"), value_key()).alias("kept")
    return placed.groupBy(*GROUP, kept, "range").agg(*summed()).withColumnRenamed("kept", "value")


def _held(part: str) -> Callable[[Column], Column]:
    """Whether a range has rows between the two ranks next to a fraction, or lies between them."""
    start, end, last = (F.col(f"_{name}{part}") for name in ("from", "to", "last"))
    return lambda f: (start <= F.ceil(f * last)) & (end > F.floor(f * last))


def wanted_ranges(ranges: DataFrame) -> DataFrame:
    """service, attr, segment, range: ranges from one neighbour of a wanted rank to the
    other, empty ones between them included.

    The windows hold at most 2**BITS rows of an attribute.
    """
    whole = Window.partitionBy(*GROUP)
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    numbers = ranges.where("range >= 0")
    found = F.lit(False)
    for part, fractions in WANTED.items():
        weight = F.col("numeric") if part == "" else F.col(f"numeric{part}")
        base, total = F.coalesce(F.sum(weight).over(before), F.lit(0)), F.sum(weight).over(whole)
        numbers = numbers.withColumns({f"_from{part}": base, f"_to{part}": base + weight, f"_last{part}": total - 1})
        held = F.exists(doubles(fractions), _held(part))
        found = found | ((F.col(f"_last{part}") >= 0) & held)
    return numbers.where(found).select(*GROUP, "range")


#: Every fraction that some check asks for; one pass finds all of them.
ALL_FRACTIONS = sorted({*PERCENTILES, *(i * (1.0 / q) for q in range(2, PSI_BINS + 1) for i in range(q)), 1.0})


def attribute_quantiles(counts: DataFrame) -> DataFrame:
    """service, attr, segment, part ('', '_earlier', '_recent'), n, n_distinct and
    ``quantiles`` at ``ALL_FRACTIONS``, for all numeric attributes of a count table.

    Drift bins, latency and metrics of any number of services read this one table.
    """
    weights = F.create_map(F.lit(""), "n", F.lit("_earlier"), "n_earlier", F.lit("_recent"), "n_recent")
    rows = counts.where("x IS NOT NULL").select(*GROUP, "x", F.explode(weights).alias("part", "w"))
    return weighted_quantiles(rows, [*GROUP, "part"], "x", "w", ALL_FRACTIONS)


def quantile_at(fraction: float) -> Column:
    """The quantile at one of ``ALL_FRACTIONS``."""
    return F.element_at("quantiles", ALL_FRACTIONS.index(fraction) + 1)


def condensed_counts(
    split_spans: DataFrame,
    services: DataFrame,
    specs: DataFrame | None = None,
    **only: object,
) -> DataFrame:
    """The count table of ``attribute_counts`` without a row per number.

    Continuous attributes have one row per range, and one row per span in ranges
    that hold a wanted rank (``WANTED``); ``value`` is NULL there.  ``only`` goes to
    ``attribute_rows``.
    """
    rows = materialise(attribute_rows(split_spans, services, specs, **only))
    profile = materialise(attribute_profile(rows, services))
    ranges = materialise(range_counts(rows, profile))
    wanted = materialise(wanted_ranges(ranges))
    held = F.transform(F.sequence(F.lit(0), F.lit((1 << BITS) - 1)), lambda r: F.array_contains("ranges", r))
    listed = wanted.groupBy(*GROUP).agg(F.collect_list(F.col("range").cast("int")).alias("ranges"))
    sought = materialise(listed.join(profile, GROUP).select(*GROUP, "cuts", held.alias("held")))
    placed = with_range(rows.where("x IS NOT NULL").join(sought, GROUP), "_at", "cuts", "x", BITS)
    # Always true, and not for Spark to tell: it would copy the whole search into the
    # filter, every step of it several times.
    as_placed = F.monotonically_increasing_id() >= 0
    found = placed.withColumn("_held", F.element_at("held", F.col("_at") + 1) & as_placed).where("_held")

    earlier, recent = F.col("half") == "earlier", F.col("half") == "recent"
    one = lambda condition: F.when(condition, 1).otherwise(0).cast("long")
    x = F.col("x")
    single = found.select(
        *GROUP,
        F.lit(None).cast("string").alias("value"),
        "x",
        F.lit(1).cast("long").alias("n"),
        one(earlier).alias("n_earlier"),
        one(recent).alias("n_recent"),
        one(F.col("error").isNotNull()).alias("n_error"),
        F.col("error").alias("error_sum"),
        F.lit(1).cast("long").alias("present"),
        one(earlier).alias("present_earlier"),
        F.lit(1).cast("long").alias("numeric"),
        one(earlier).alias("numeric_earlier"),
        one(recent).alias("numeric_recent"),
        one(x != 0).alias("nonzero"),
        one(earlier & (x != 0)).alias("nonzero_earlier"),
        x.alias("total"),
        F.when(earlier, x).alias("total_earlier"),
    )
    rest = ranges.join(wanted, [*GROUP, "range"], "left_anti").select(*single.columns)
    condensed = materialise(rest.unionByName(single))
    for table in (rows, profile, ranges, wanted, sought):
        drop_table(table)
    return condensed
