"""Access to a span's attributes by dotted name.

Names come from settings.  They are taken apart on the settings' side of the
join, once per setting, so that rows only do map look-ups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_name(settings: DataFrame, column: str) -> DataFrame:
    """Add ``<column>_kind`` (input, output, eval or own) and ``<column>_key``."""
    name = F.col(column)
    kind = F.regexp_extract(name, r"^(input|output|eval)\.", 1)
    return settings.withColumns(
        {
            f"{column}_kind": F.when(kind == "", "own").otherwise(kind),
            f"{column}_key": F.regexp_replace(name, r"^(input|output|eval)\.", ""),
        }
    )


def attribute_value(column: str) -> Column:
    """The named attribute of a span as text; NULL when absent."""
    return value_of(F.col(f"{column}_kind"), F.col(f"{column}_key"))


def value_of(kind: Column, key: Column) -> Column:
    """The attribute of a span that a split name tells, as text; NULL when absent."""
    return (
        F.when(kind == "input", F.try_element_at("inputs", key))
        .when(kind == "output", F.try_element_at("outputs", key))
        .when(kind == "eval", F.try_element_at("evals", key).cast("string"))
        .when(key == "latency_ms", F.col("latency_ms").cast("string"))
        .when(key == "model_version", F.col("model_version"))
    )


def error_keys(services: DataFrame) -> DataFrame:
    """service, error_key: the configured error attribute, one of the evals."""
    return services.select("service", F.regexp_replace("error_attribute", r"^eval\.", "").alias("error_key"))


def error_value() -> Column:
    return F.nanvl(F.try_element_at("evals", F.col("error_key")), F.lit(None).cast("double"))
