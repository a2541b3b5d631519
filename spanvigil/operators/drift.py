"""Population stability indexes over the attribute count table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanvigil.functions.scalars import psi_band, psi_term, round_to, segment_key
from spanvigil.operators.condensed import ALL_FRACTIONS
from spanvigil.operators.quantiles import weighted_quantiles
from spanvigil.settings import NUMERIC_SHARE, PSI_BINS, PSI_CRITICAL, PSI_FLOOR, PSI_WARNING

KEYS = ["service", "attr"]



def bin_fractions(q: int) -> list[float]:
    """q + 1 evenly spaced fractions, with the rounding of a repeated step."""
    return [i * (1.0 / q) for i in range(q)] + [1.0]


# The fractions of every 2 <= q <= PSI_BINS, so that one call serves all of them.
FRACTIONS = sorted({f for q in range(2, PSI_BINS + 1) for f in bin_fractions(q)})


def single_value_psi(counts: DataFrame, attribute_baselines: DataFrame) -> DataFrame:
    """Observed values of a feature against the one value training expected.

    ``attribute_baselines``: service, attribute (bare name), expected.  Only
    observed values contribute.
    """
    expected = attribute_baselines.select(
        "service",
        F.concat(F.lit("input."), F.col("attribute")).alias("attr"),
        segment_key(F.col("expected")).alias("expected"),
    )
    watched = counts.select("service", "attr", "value", "n").join(expected, KEYS)
    totals = watched.groupBy(KEYS).agg(
        F.sum("n").alias("n_observed"), F.count(F.lit(1)).alias("n_distinct")
    )
    term = psi_term(
        F.col("n") / F.col("n_observed"),
        F.when(F.col("value") == F.col("expected"), 1.0).otherwise(0.0),
    )
    return (
        watched.join(totals, KEYS)
        .groupBy(KEYS)
        .agg(
            F.max("expected").alias("expected"),
            F.max("n_observed").alias("n_observed"),
            F.max("n_distinct").alias("n_distinct"),
            round_to(F.sum(term), 4).alias("psi"),
        )
        .withColumn("band", psi_band(F.col("psi"), PSI_WARNING, PSI_CRITICAL))
    )


def half_totals(counts: DataFrame) -> DataFrame:
    """Per (service, attr): values and numeric values per half."""
    numeric = F.col("x").isNotNull()
    return counts.groupBy(KEYS).agg(
        F.sum("n_earlier").alias("earlier"),
        F.sum("n_recent").alias("recent"),
        F.sum(F.when(numeric, F.col("n_earlier")).otherwise(0)).alias("earlier_numeric"),
        F.sum(F.when(numeric, F.col("n_recent")).otherwise(0)).alias("recent_numeric"),
    )


def _is_numeric() -> Column:
    return (F.col("earlier_numeric") / F.col("earlier") > NUMERIC_SHARE) & (
        F.col("recent_numeric") / F.col("recent") > NUMERIC_SHARE
    )


def two_sample_psi(counts: DataFrame, quantiles: DataFrame | None = None) -> DataFrame:
    """Recent half against earlier half for every attribute: service, attr,
    kind, psi.  Attributes empty in one half score 0.  ``quantiles``: a table of
    ``condensed.attribute_quantiles``, where there is one."""
    totals = half_totals(counts)
    sided = totals.where("earlier > 0 AND recent > 0")
    compared = numeric_psi(counts, sided.where(_is_numeric()), quantiles).unionByName(
        categorical_psi(counts, sided.where(~_is_numeric()))
    )
    return totals.select(*KEYS).join(compared, KEYS, "left").select(
        *KEYS,
        F.coalesce("kind", F.lit("empty")).alias("kind"),
        F.coalesce("psi", F.lit(0.0)).alias("psi"),
    )


def categorical_psi(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Union of both halves' values; a value missing on one side counts as 0."""
    term = psi_term(F.col("n_recent") / F.col("recent"), F.col("n_earlier") / F.col("earlier"))
    return (
        counts.where("n_earlier + n_recent > 0")
        .join(totals, KEYS)
        .groupBy(KEYS)
        .agg(round_to(F.abs(F.sum(term)), 3).alias("psi"))
        .select(*KEYS, F.lit("categorical").alias("kind"), "psi")
    )


def inner_edges(n_distinct: Column, quantile_array: Column, fractions: list[float] = FRACTIONS) -> Column:
    """Distinct quantile edges without the outer two (those become infinite)."""

    def places(q: int) -> Column:
        return F.expr(f"array({', '.join(str(fractions.index(f) + 1) for f in bin_fractions(q))})")

    wanted = F.least(n_distinct, F.lit(PSI_BINS))
    positions = F.when(wanted == PSI_BINS, places(PSI_BINS))
    for q in range(2, PSI_BINS):
        positions = positions.when(wanted == q, places(q))
    edges = F.array_distinct(F.transform(positions, lambda p: F.element_at(quantile_array, p)))
    return F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))


def numeric_psi(counts: DataFrame, totals: DataFrame, quantiles: DataFrame | None = None) -> DataFrame:
    """Quantile bins of the earlier half, right closed, duplicates dropped."""
    values = (
        counts.where("x IS NOT NULL AND n_earlier + n_recent > 0")
        .join(totals.select(*KEYS, "earlier_numeric", "recent_numeric"), KEYS)
        .select(*KEYS, "x", "n_earlier", "n_recent", F.col("earlier_numeric").alias("earlier"), F.col("recent_numeric").alias("recent"))
    )
    fractions = FRACTIONS if quantiles is None else ALL_FRACTIONS
    if quantiles is None:
        quantiles = weighted_quantiles(values, KEYS, "x", "n_earlier", FRACTIONS)
    else:
        quantiles = quantiles.where("part = '_earlier' AND segment = ''")
    edges = quantiles.where("n_distinct >= 2").select(
        *KEYS, inner_edges(F.col("n_distinct"), F.col("quantiles"), fractions).alias("edges")
    )
    bins = (
        values.join(edges, KEYS)
        .withColumn("bin", F.size(F.filter("edges", lambda edge: edge < F.col("x"))))
        .groupBy(*KEYS, "bin")
        .agg(
            F.sum("n_earlier").alias("n_earlier"),
            F.sum("n_recent").alias("n_recent"),
            F.max("earlier").alias("earlier"),
            F.max("recent").alias("recent"),
        )
    )
    term = psi_term(F.col("n_recent") / F.col("recent"), F.col("n_earlier") / F.col("earlier"))
    scored = bins.groupBy(KEYS).agg(round_to(F.abs(F.sum(term)), 3).alias("psi"))
    # Fewer than two distinct earlier values: no bins, index 0.
    return (
        totals.select(*KEYS)
        .join(scored, KEYS, "left")
        .select(*KEYS, F.lit("numeric").alias("kind"), F.coalesce("psi", F.lit(0.0)).alias("psi"))
    )


def histogram_psi(baseline: DataFrame, current: DataFrame, keys: list[str], bin: str) -> DataFrame:
    """Two stored histograms (keys, bin, n): full outer on the bin, empty bins
    floored, rounded to 4."""
    old, new = [
        frame.groupBy(*keys, bin).agg(F.sum("n").alias(name))
        for frame, name in ((baseline, "old"), (current, "new"))
    ]
    # Bins of a histogram are few; the per-key totals are small sides of AQE joins.
    both = old.join(new, [*keys, bin], "full").fillna(0, ["old", "new"])
    totals = both.groupBy(*keys).agg(F.sum("old").alias("olds"), F.sum("new").alias("news"))
    share = lambda part, whole: F.when(F.col(part) == 0, PSI_FLOOR).otherwise(
        F.col(part) / F.col(whole)
    )
    new_share, old_share = share("new", "news"), share("old", "olds")
    term = (new_share - old_share) * F.ln(new_share / old_share)
    return (
        both.join(totals, keys)
        .where("olds > 0 AND news > 0")
        .groupBy(*keys)
        .agg(round_to(F.sum(term), 4).alias("psi"))
    )


def ranked(psi: DataFrame) -> DataFrame:
    """Features of each service by falling PSI.  The window holds one row per
    attribute of a service."""
    order = Window.partitionBy("service").orderBy(F.desc("psi"), "attr")
    return psi.withColumn("rank", F.row_number().over(order))


def worst_attribute(psi: DataFrame) -> DataFrame:
    """service, attr, psi of the largest index above 0; ties by attribute name."""
    best = F.min(F.struct((-F.col("psi")).alias("key"), "attr", "psi")).alias("best")
    return psi.where("psi > 0").groupBy("service").agg(best).select("service", "best.attr", "best.psi")
