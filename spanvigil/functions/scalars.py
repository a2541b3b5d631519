"""Column expressions shared by the operators; all stay inside Catalyst."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanvigil.settings import HIGHER, PSI_FLOOR

# --- fixed values -------------------------------------------------------------
STATUS_RANKS = {"HEALTHY": 0, "MONITOR": 0, "WARNING": 1, "CRITICAL": 2}
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
MEANINGLESS_PATTERNS = ("overall", "prediction_volume", "all", "none")
# -------------------------------------------------------------------------------


def round_to(value: Column | str, digits: int = 0) -> Column:
    """Round the scaled binary value half away from zero: 0.575 scales to just
    below the tie and gives 0.57, 2.675 to the tie and gives 2.68.  Spark's own
    ``round`` works on the printed decimals."""
    number = F.col(value) if isinstance(value, str) else value
    if digits == 0:
        return F.round(number)
    scale = float(10**digits)
    return F.round(number * scale) / scale


def safe_double(value: Column) -> Column:
    """Number or NULL.  Text is checked by pattern first: a failing parse costs an
    exception per row, and ``1d``, NaN and infinities are not wanted as numbers."""
    text = value.cast("string")
    return F.when(F.rlike(text, F.lit(NUMBER)), text.try_cast("double"))


def segment_key(value: Column, number: Column | None = None) -> Column:
    """Text form of a value: integral numbers lose their decimals, other numbers
    take their shortest form, anything else stays as it is.  Equal numbers get
    equal keys.

    Pass ``number`` where ``safe_double(value)`` is already a column, so that the
    text is parsed once per row.
    """
    text = value.cast("string")
    number = safe_double(text) if number is None else number
    integral = (number == F.floor(number)) & (F.abs(number) < F.lit(9e15))
    return F.when(integral, F.floor(number).cast("string")).otherwise(
        F.coalesce(number.cast("string"), text)
    )


def with_segment_key(frame: DataFrame, column: str) -> DataFrame:
    """Normalise a text column with ``segment_key``, parsing it once."""
    return (
        frame.withColumn("_number", safe_double(F.col(column)))
        .withColumn(column, segment_key(F.col(column), F.col("_number")))
        .drop("_number")
    )


def status_rank(status: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in STATUS_RANKS.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, status), F.lit(0))


def worse_ratio(value: Column, baseline: Column, direction: Column | str) -> Column:
    """Above 1 always means worse than baseline; 0 when not computable."""
    direction = F.lit(direction) if isinstance(direction, str) else direction
    usable = (value != 0) & (baseline != 0)
    return F.coalesce(
        F.when(usable & (direction == HIGHER), round_to(baseline / value, 2)).when(
            usable, round_to(value / baseline, 2)
        ),
        F.lit(0.0),
    )


def psi_term(observed: Column, expected: Column, floor: float = PSI_FLOOR) -> Column:
    """One value's (or bin's) share of the population stability index."""
    o = F.greatest(observed, F.lit(floor))
    e = F.greatest(expected, F.lit(floor))
    return (o - e) * F.ln(o / e)


def psi_band(psi: Column, warning: Column | float, critical: Column | float) -> Column:
    return F.when(psi >= critical, "critical").when(psi >= warning, "warning").otherwise("healthy")


def drift_status(psi: Column, warning: Column | float, critical: Column | float) -> Column:
    return F.upper(psi_band(psi, warning, critical))


def drift_severity(psi: Column, warning: Column | float, critical: Column | float) -> Column:
    scaled = psi / (F.lit(2.0) * critical)
    return (
        F.when(psi >= critical, F.least(F.lit(1.0), scaled))
        .when(psi >= warning, F.least(F.lit(0.6), scaled))
        .otherwise(F.lit(0.0))
    )


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.6, "medium").otherwise("low")


def is_error_status(status: Column) -> Column:
    return F.coalesce(F.contains(F.upper(status), F.lit("ERROR")), F.lit(False))


def is_meaningful_pattern(pattern: Column) -> Column:
    return F.coalesce(
        (pattern != "") & ~F.lower(pattern).isin(*MEANINGLESS_PATTERNS), F.lit(False)
    )


def repo_relative_path(source_path: Column, expected_repo: Column) -> Column:
    """Text after ``/<repo name>/`` in a trainer's local path, else NULL."""
    repo = F.element_at(F.split(expected_repo, "/"), -1)
    needle = F.concat(F.lit("/"), repo, F.lit("/"))
    at = F.position(needle, source_path)
    rest = F.substring(source_path, at + F.length(needle), F.length(source_path))
    return F.when((at > 0) & (source_path != "") & (expected_repo != ""), F.ltrim(rest, F.lit("/")))


def segment_attribute(label: Column) -> Column:
    return F.when(F.contains(label, F.lit("=")), F.substring_index(label, "=", 1))


def segment_value(label: Column) -> Column:
    at = F.position(F.lit("="), label)
    return F.when(at > 0, F.substring(label, at + 1, F.length(label)))


def bare_attribute(attribute: Column) -> Column:
    return F.regexp_replace(attribute, r"^input\.", "")


def assert_table_identifier(name: str) -> str:
    """Accept ``table`` or ``schema.table`` of letters, digits and underscores."""
    if re.fullmatch(r"(?=_*[^\W_])\w+(\.(?=_*[^\W_])\w+)?", name or "") is None:
        raise ValueError(f"not a plain table name: {name!r}")
    return name


_NAME_PART = r"_*[\p{L}\p{N}][\p{L}\p{N}_]*"


def is_table_identifier(name: Column | str) -> Column:
    """The same rule for a column of names; NULL is no name."""
    return F.coalesce(F.rlike(name, F.lit(rf"\A{_NAME_PART}(\.{_NAME_PART})?\z")), F.lit(False))
