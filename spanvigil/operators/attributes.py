"""The attribute count table: one row per (service, attribute, value).

Drift, schema, segment, mode, version and latency checks all work on these
counts instead of on spans.  It is one explode and one partially aggregated
shuffle; a hot service spreads over its values, and a hot value is combined on
the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType

from spanvigil.functions.scalars import safe_double, segment_key
from spanvigil.operators.values import error_keys, error_value, split_name, value_of

MAPS = {"inputs": "input.", "outputs": "output.", "evals": "eval."}

#: Between name and segment in the key of a metric's entry; neither a span nor a name holds it.
_SEPARATOR = "\x01"

#: A segmented metric's values stand among the attributes under its name.
METRIC = "metric:"


def exploded_attributes(spans: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, attr, value: one row per populated attribute of a span,
    its latency and model version included.

    The maps are exploded together; the position tells which map an entry is
    from.
    """
    own = F.array(
        F.struct(F.lit("latency_ms").alias("key"), F.col("latency_ms").cast("string").alias("value")),
        F.struct(F.lit("model_version").alias("key"), F.col("model_version").alias("value")),
    )
    empty = "CAST(array() AS ARRAY<STRUCT<key: STRING, value: STRING>>)"
    maps = [
        F.coalesce(F.map_entries(F.col(name).cast("map<string,string>")), F.expr(empty))
        for name in ("inputs", "outputs", "evals")
    ]
    sized = spans.select(
        *keep,
        F.coalesce(F.size("inputs"), F.lit(0)).alias("_to_outputs"),
        (F.coalesce(F.size("inputs"), F.lit(0)) + F.coalesce(F.size("outputs"), F.lit(0))).alias("_to_evals"),
        F.size(F.concat(*maps)).alias("_to_own"),
        F.concat(*maps, own).alias("_entries"),
    )
    at = F.col("_at")
    prefix = (
        F.when(at < F.col("_to_outputs"), "input.")
        .when(at < F.col("_to_evals"), "output.")
        .when(at < F.col("_to_own"), "eval.")
        .otherwise("")
    )
    return (
        sized.select("*", F.posexplode("_entries").alias("_at", "_e"))
        .where(F.col("_e.value").isNotNull())
        .select(
            *keep,
            F.concat(prefix, F.col("_e.key")).alias("attr"),
            F.col("_e.value").alias("value"),
        )
    )


def with_error(spans: DataFrame, services: DataFrame) -> DataFrame:
    """Add ``error``, the value of the service's error attribute."""
    return spans.join(error_keys(services), "service", "left").withColumn("error", error_value()).drop("error_key")


def _metric_entries(specs: DataFrame) -> DataFrame:
    """service, metrics: the segmented metrics of each service, names taken apart."""
    wanted = specs.where("segment_by IS NOT NULL").select("service", "name", "attribute", "segment_by")
    wanted = split_name(split_name(wanted, "attribute"), "segment_by")
    fields = F.struct("name", "attribute_kind", "attribute_key", "segment_by_kind", "segment_by_key")
    return wanted.groupBy("service").agg(F.collect_list(fields).alias("_metrics"))


def _entry(key: Column, value: Column, measured: bool = False) -> Column:
    """An attribute as text, or as the number it is: that saves printing and reading it."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    if measured:
        return F.struct(key.alias("key"), text.alias("value"), value.alias("x"))
    return F.struct(key.alias("key"), value.cast("string").alias("value"), number.alias("x"))


def _entries(spans: DataFrame, name: str) -> tuple[Column, Column]:
    """A map's entries, and from their column the same with ``key, value, x``.

    They are zipped, as a lambda would be interpreted for each of them; the empty
    array is filled with nulls.  Numbers stand in ``x``, the infinite too.
    """
    held, listed = spans.schema[name].dataType, F.col(f"_{name}")
    texts, numbers = F.expr("CAST(array() AS ARRAY<STRING>)"), F.expr("CAST(array() AS ARRAY<DOUBLE>)")
    if isinstance(held, MapType) and isinstance(held.valueType, DoubleType):
        zipped = F.arrays_zip(listed["key"].alias("key"), texts.alias("value"), listed["value"].alias("x"))
        return F.map_entries(name), zipped
    zipped = F.arrays_zip(listed["key"].alias("key"), listed["value"].alias("value"), numbers.alias("x"))
    return F.map_entries(F.col(name).cast("map<string,string>")), zipped


def attribute_rows(
    split_spans: DataFrame, services: DataFrame, specs: DataFrame | None = None, maps: tuple[str, ...] = tuple(MAPS), own: bool = True
) -> DataFrame:
    """service, half, error, attr, segment, value, x: one row per populated attribute
    of a span, its latency and model version included; a number stands in ``x``, any
    other value in ``value``.

    The maps are exploded together; the position tells which map an entry is from.
    With ``specs`` each segmented metric adds an entry per span that has its segment,
    under ``metric:<name>``; its value may be missing.  ``segment`` is '' elsewhere.
    ``maps`` and ``own`` leave out what is not asked for before anything is exploded.
    """
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<key: STRING, value: STRING, x: DOUBLE>>)")
    taken = {name: _entries(split_spans, name) for name in maps}
    entries = [F.coalesce(zipped, empty) for _, zipped in taken.values()]
    ends, size = [], F.lit(0)
    for name in maps:
        size = size + F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0))
        ends.append(size)
    if own:
        measured = isinstance(split_spans.schema["latency_ms"].dataType, DoubleType)
        latency = _entry(F.lit("latency_ms"), F.col("latency_ms"), measured)
        entries.append(F.array(latency, _entry(F.lit("model_version"), F.col("model_version"))))
        size = size + 2
    spans = split_spans if "error" in split_spans.columns else with_error(split_spans, services)
    metrics = empty
    if specs is not None:
        spans = spans.join(_metric_entries(specs), "service", "left")

        def entry(m: Column) -> Column:
            segment = value_of(m["segment_by_kind"], m["segment_by_key"])
            return _entry(F.concat(m["name"], F.lit(_SEPARATOR), segment), value_of(m["attribute_kind"], m["attribute_key"]))

        metrics = F.coalesce(F.transform("_metrics", entry), empty)
    listed = spans.withColumns({f"_{name}": whole for name, (whole, _) in taken.items()}).select(
        "service",
        "half",
        "error",
        F.array(*ends).alias("_ends"),
        size.alias("_plain"),
        F.concat(*entries, metrics).alias("_entries"),
    )
    at, key = F.col("_at"), F.col("_e.key")
    prefix = F.lit("")
    for i in reversed(range(len(maps))):
        prefix = F.when(at < F.get("_ends", i), MAPS[maps[i]]).otherwise(prefix)
    # The outer form, as the plain one has Spark build the entries once more to see whether there are any.
    rows = listed.select("*", F.posexplode_outer("_entries").alias("_at", "_e"))
    metric = at >= F.col("_plain")
    x = F.col("_e.x")
    finite = F.abs(x) < F.lit(float("inf"))  # NaN is above infinity
    named = rows.where(F.when(metric, key.isNotNull()).otherwise(F.col("_e.value").isNotNull() | x.isNotNull())).select(
        "service",
        "half",
        "error",
        F.when(metric, F.concat(F.lit(METRIC), F.substring_index(key, _SEPARATOR, 1))).otherwise(F.concat(prefix, key)).alias("attr"),
        F.when(metric, key.substr(F.locate(_SEPARATOR, key) + 1, F.length(key))).otherwise("").alias("segment"),
        F.when(finite | x.isNull(), F.col("_e.value")).otherwise(x.cast("string")).alias("value"),
        F.when(finite, x).alias("_x"),
    )
    # A version is a name, even where it looks like a number: 1.10 is not 1.1.
    version = F.col("attr") == "model_version"
    numbered = named.withColumns(
        {
            "_segment_number": F.when(F.col("segment") != "", safe_double(F.col("segment"))),
            "x": F.coalesce("_x", F.when(~version, safe_double(F.col("value")))),
        }
    )
    return numbered.select(
        "service",
        "half",
        "error",
        "attr",
        F.when(F.col("segment") != "", segment_key(F.col("segment"), F.col("_segment_number"))).otherwise(F.col("segment")).alias("segment"),
        F.when(F.col("x").isNull(), F.col("value")).alias("value"),
        "x",
    )


def value_key() -> Column:
    """The value of an attribute row as a key: equal numbers are one value."""
    return segment_key(F.col("value"), F.col("x"))


def summed() -> list[Column]:
    """The counts and sums of a count table, from attribute rows."""
    earlier, x = F.col("half") == "earlier", F.col("x")
    present = F.col("value").isNotNull() | x.isNotNull()
    return [
        F.max("x").alias("x"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(earlier).alias("n_earlier"),
        F.count_if(F.col("half") == "recent").alias("n_recent"),
        F.count("error").alias("n_error"),
        F.sum("error").alias("error_sum"),
        F.count_if(present).alias("present"),
        F.count_if(present & earlier).alias("present_earlier"),
        F.count("x").alias("numeric"),
        F.count(F.when(earlier, x)).alias("numeric_earlier"),
        F.count(F.when(F.col("half") == "recent", x)).alias("numeric_recent"),
        F.count_if(x != 0).alias("nonzero"),
        F.count_if(earlier & (x != 0)).alias("nonzero_earlier"),
        F.sum("x").alias("total"),
        F.sum(F.when(earlier, x)).alias("total_earlier"),
    ]


GROUP = ["service", "attr", "segment"]


def attribute_counts(split_spans: DataFrame, services: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """service, attr, segment, value, x (number or NULL), n, n_earlier, n_recent,
    n_error, error_sum and the sums of ``summed``.

    Equal numbers share one row, so (service, attr, segment, x) is unique where x is
    set.  Where an attribute has very many values, ``condensed.condensed_counts``
    gives the same answers without a row per value.
    """
    return attribute_rows(split_spans, services, specs).groupBy(*GROUP, value_key().alias("key")).agg(*summed()).withColumnRenamed("key", "value")


def configured_names(services: DataFrame) -> DataFrame:
    """service, names: attributes that settings name, whose values are always counted."""
    inputs = lambda names: F.transform(names, lambda n: F.concat(F.lit("input."), n))
    return services.select(
        "service",
        F.array_union(
            F.coalesce("segments", F.array()),
            F.array_union(inputs(F.coalesce(F.map_keys("attribute_baselines"), F.array())), inputs(F.coalesce("attributes_of_interest", F.array()))),
        ).alias("names"),
    )


def configured_counts(split_spans: DataFrame, services: DataFrame) -> DataFrame:
    """The count table of the attributes that settings name and of the model version.

    Other attributes are dropped from the maps before these are exploded.
    """
    named = with_error(split_spans, services).join(configured_names(services), "service")

    def chosen(column: str) -> Column:
        return F.map_filter(column, lambda key, _: F.array_contains("names", F.concat(F.lit(MAPS[column]), key)))

    latency = F.when(F.array_contains("names", F.lit("latency_ms")), F.col("latency_ms"))
    kept = named.withColumns({**{column: chosen(column) for column in MAPS}, "latency_ms": latency})
    return attribute_rows(kept, services).groupBy(*GROUP, value_key().alias("key")).agg(*summed()).withColumnRenamed("key", "value")


def feature_counts(counts: DataFrame) -> DataFrame:
    """Rows of model inputs and outputs: what drift is measured on."""
    return counts.where(F.startswith("attr", F.lit("input.")) | F.startswith("attr", F.lit("output.")))
