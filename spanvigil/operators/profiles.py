"""Profiles of wide training tables and of unknown sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanvigil.functions.scalars import round_to, safe_double
from spanvigil.operators.quantiles import quantiles

#: Stands for the values that a distribution does not list.
REST = "(other)"
PERCENTILES = (0.05, 0.25, 0.50, 0.75, 0.95)
NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")

# --- fixed values: field-role patterns, in matching order --------------------------
ROLE_PATTERNS = {
    "timestamp": r"(^|_)(ts|time|timestamp|date|_at|event_time)($|_)",
    "model_version": r"(model[_.]?version|^version$|model_ver)",
    "error": r"(error|mae|rmse|mape|loss|residual|abs[_]?err|deviation)",
    "actual": r"(actual|ground[_]?truth|y[_]?true|label|target|observed)",
    "prediction": r"(predict|prediction|pred|score|proba|prob|estimate|yhat|y[_]?hat|output|eta)",
}
NUMERIC_ROLES = ("error", "actual", "prediction")
# -----------------------------------------------------------------------------------


def columns_by_kind(frame: DataFrame) -> dict[str, list[str]]:
    kinds: dict[str, list[str]] = {"numeric": [], "datetime": [], "sequence": [], "categorical": []}
    for name, kind in frame.dtypes:
        if kind.startswith(NUMERIC_TYPES):
            kinds["numeric"].append(name)
        elif kind.startswith(("timestamp", "date")):
            kinds["datetime"].append(name)
        elif kind.startswith("array"):
            kinds["sequence"].append(name)
        else:
            kinds["categorical"].append(name)
    return kinds


def _stacked(frame: DataFrame, per_column: dict[str, Column], keys: list[str]) -> DataFrame:
    """One wide aggregate, then one row per profiled column (a handful)."""
    wide = frame.groupBy(*keys).agg(*[value.alias(f"c{i}") for i, value in enumerate(per_column.values())])
    rows = F.array(
        *[F.struct(F.lit(name).alias("column"), F.col(f"c{i}").alias("s")) for i, name in enumerate(per_column)]
    )
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.column", "r.s.*")


def numeric_profile(
    frame: DataFrame, columns: list[str], keys: list[str] | None = None, sample_std: bool = False, digits: int = 4
) -> DataFrame:
    """count, mean, std, min, max, null fraction and exact percentiles per column.

    Moments come from one pass without any row multiplication; percentiles from
    the counted values of the unpivoted columns.
    """
    keys = keys or []
    deviation = F.stddev_samp if sample_std else F.stddev_pop
    r = lambda c: round_to(c, digits)

    def moments(name: str) -> Column:
        x = F.col(name).cast("double")
        x = F.nanvl(x, F.lit(None).cast("double"))
        return F.struct(
            F.count(x).alias("count"),
            r(F.avg(x)).alias("mean"),
            r(deviation(x)).alias("std"),
            r(F.min(x)).alias("min"),
            r(F.max(x)).alias("max"),
            r(F.count_if(x.isNull()) / F.count(F.lit(1))).alias("null_frac"),
        )

    stats = _stacked(frame, {name: moments(name) for name in columns}, keys)
    long = frame.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        keys, columns, "column", "x"
    )
    exact = quantiles(long.where(~F.isnan("x")), [*keys, "column"], "x", PERCENTILES).select(
        *keys,
        "column",
        *[
            r(F.element_at("quantiles", i + 1)).alias(f"p{round(100 * p)}")
            for i, p in enumerate(PERCENTILES)
        ],
    )
    return stats.join(exact, [*keys, "column"], "left")


def value_counts(frame: DataFrame, columns: list[str]) -> DataFrame:
    texts = frame.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "column", "value"
    )
    return texts.where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def categorical_profile(frame: DataFrame, columns: list[str], top: int | None = None) -> DataFrame:
    """All values, or the ``top`` most frequent ones, per column with counts and fractions; ties by value."""
    counts = value_counts(frame, columns)
    totals = counts.groupBy("column").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("n_distinct"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return (
        (ranked if top is None else ranked.where(F.col("rank") <= top))
        .join(totals, "column")
        .withColumn("fraction", round_to(F.col("n") / F.col("count"), 4))
    )


def approximate_distinct(frame: DataFrame, columns: list[str], error: float = 0.02) -> DataFrame:
    """Sketch-based distinct counts where an exact shuffle of values is too much."""
    return _stacked(frame, {c: F.struct(F.approx_count_distinct(c, error).alias("n_distinct")) for c in columns}, [])


def sequence_profile(frame: DataFrame, columns: list[str]) -> DataFrame:
    def lengths(name: str) -> Column:
        size = F.when(F.col(name).isNotNull(), F.size(name))
        return F.struct(
            F.count(name).alias("count"),
            F.min(size).alias("len_min"),
            F.max(size).alias("len_max"),
            round_to(F.avg(size), 4).alias("len_mean"),
        )

    return _stacked(frame, {name: lengths(name) for name in columns}, [])


def datetime_profile(frame: DataFrame, columns: list[str]) -> DataFrame:
    def ends(name: str) -> Column:
        at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        return F.struct(
            F.count(name).alias("count"), at(F.min(name)).alias("min"), at(F.max(name)).alias("max")
        )

    return _stacked(frame, {name: ends(name) for name in columns}, [])


def target_correlation(frame: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Pearson correlation with the target, strongest first; undefined ones left out."""
    pairs = {
        c: F.struct(round_to(F.corr(F.col(c).cast("double"), F.col(target).cast("double")), 4).alias("correlation"))
        for c in columns
        if c != target
    }
    return (
        _stacked(frame, pairs, [])
        .where("correlation IS NOT NULL AND NOT isnan(correlation)")
        .orderBy(F.desc(F.abs("correlation")), "column")
    )


def attribute_distributions(categorical: DataFrame) -> DataFrame:
    """column, value -> fraction and the modal value.

    What the listed values leave is the share of REST, so shares add up to 1; a
    value that is itself spelt like REST is counted with it.
    """
    pairs = F.array_sort(F.collect_list(F.struct("value", "fraction")))
    rest = 1 - F.sum("n") / F.max("count")
    summed = categorical.groupBy("column").agg(
        pairs.alias("pairs"),
        F.when(F.max("n_distinct") > F.count("value"), rest).alias("rest"),
        F.min(F.struct("rank", "value"))["value"].alias("mode"),
    )
    spelt = F.exists("pairs", lambda p: p["value"] == REST)
    added = F.transform(
        "pairs", lambda p: F.struct(p["value"].alias("value"), F.when(p["value"] == REST, p["fraction"] + F.col("rest")).otherwise(p["fraction"]).alias("fraction"))
    )
    apart = F.concat("pairs", F.array(F.struct(F.lit(REST).alias("value"), F.col("rest").alias("fraction"))))
    whole = F.when(F.col("rest").isNull(), F.col("pairs")).when(spelt, added).otherwise(apart)
    return summed.select("column", F.map_from_entries(whole).alias("distribution"), "mode")


def training_baseline(frame: DataFrame, service: str, model_version: str, trained_at: str, target: str | None = None, top: int = 20) -> DataFrame:
    """The baseline artifact of one training set, one row.

    A distribution lists ``top`` values and the share of the rest: a row stays
    bounded where a column has very many values.
    """
    kinds = columns_by_kind(frame)
    shares = attribute_distributions(categorical_profile(frame, kinds["categorical"], top))
    # One entry per profiled column.
    distributions = shares.agg(
        F.map_from_entries(F.collect_list(F.struct("column", "distribution"))).alias("attribute_distributions")
    )
    if target is None:
        correlations = F.expr("CAST(map() AS MAP<STRING,DOUBLE>)")
    else:
        correlations = target_correlation(frame, kinds["numeric"], target).agg(
            F.map_from_entries(F.collect_list(F.struct("column", "correlation")))
        ).scalar()
    return distributions.select(
        F.lit(service).alias("service"),
        F.lit(service).alias("model_name"),
        F.lit(model_version).alias("model_version"),
        F.lit(trained_at).alias("trained_at"),
        F.expr("CAST(map() AS MAP<STRING,DOUBLE>)").alias("metrics"),
        "attribute_distributions",
        correlations.alias("correlations_with_target"),
    )


def field_summary(frame: DataFrame, source: str) -> DataFrame:
    """Per column of an unknown source: position, kind, sample value, distinct
    values and rows seen.

    kind: bool by type, numeric when more than 80 % of the values parse,
    otherwise categorical; 'other' without values.
    """
    bools = [c for c, kind in frame.dtypes if kind == "boolean"]
    texts = [
        (F.to_json(c) if kind.startswith(("array", "map", "struct")) else F.col(c).cast("string")).alias(c)
        for c, kind in frame.dtypes
    ]
    names = F.array(*[F.lit(c) for c in frame.columns])
    long = frame.select(*texts).unpivot([], frame.columns, "name", "value")
    counted = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    parsed = F.when(safe_double(F.col("value")).isNotNull(), F.col("n")).otherwise(0)
    stats = counted.groupBy("name").agg(
        F.sum("n").alias("n_sampled"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("n_values"),
        F.sum(parsed).alias("n_numeric"),
        F.count("value").alias("n_distinct"),
        F.min("value").alias("sample"),
    )
    kind = (
        F.when(F.col("n_values") == 0, "other")
        .when(F.col("name").isin(bools), "bool")
        .when(F.col("n_numeric") / F.col("n_values") > 0.8, "numeric")
        .otherwise("categorical")
    )
    return stats.select(
        F.lit(source).alias("source"),
        F.array_position(names, F.col("name")).cast("int").alias("position"),
        "name",
        kind.alias("kind"),
        "sample",
        "n_distinct",
        "n_sampled",
    )


def _fits(pattern: str, numeric: bool):
    def fits(f: Column) -> Column:
        hit = F.rlike(f["name"], F.lit("(?i)" + pattern)) & ~F.array_contains("used", f["name"])
        return hit & (f["kind"] == "numeric") if numeric else hit

    return fits


def field_roles(summary: DataFrame) -> DataFrame:
    """Roles of the fields of each summarised source, one row per source.

    Roles are matched in their fixed order, each taking the first unused column;
    the collected group is a source's column list.
    """
    fields = F.array_sort(F.collect_list(F.struct("position", "name", "kind", "n_distinct")))
    out = summary.groupBy("source").agg(fields.alias("fields"), F.max("n_sampled").alias("n_sampled"))
    out = out.withColumn("used", F.expr("CAST(array() AS ARRAY<STRING>)"))
    for role, pattern in ROLE_PATTERNS.items():
        first = F.try_element_at(F.filter("fields", _fits(pattern, role in NUMERIC_ROLES)), F.lit(1))
        out = out.withColumn(role, first["name"]).withColumn(
            "used", F.array_compact(F.array_append("used", F.col(role)))
        )
    limit = F.greatest(F.lit(50), F.floor(F.col("n_sampled") / 5))
    names = lambda keep: F.transform(F.filter("fields", keep), lambda f: f["name"])
    out = out.withColumn(
        "segments",
        names(
            lambda f: ~F.array_contains("used", f["name"])
            & (f["kind"] == "categorical")
            & (f["n_distinct"] > 1)
            & (f["n_distinct"] <= limit)
        ),
    ).withColumn("used", F.concat("used", "segments"))
    rest = names(
        lambda f: ~F.array_contains("used", f["name"])
        & (f["kind"] != "other")
        & ~F.rlike(f["name"], F.lit("(?i)" + ROLE_PATTERNS["timestamp"]))
    )
    missing = F.array_compact(
        F.array(
            F.when(F.col("prediction").isNull(), "prediction"),
            F.when(F.col("error").isNull() & (F.col("prediction").isNull() | F.col("actual").isNull()), "error"),
            F.when(F.col("model_version").isNull(), "model_version"),
            F.when(F.size("segments") == 0, "segments"),
        )
    )
    return out.select(
        "source", *ROLE_PATTERNS, "segments", F.concat("segments", rest).alias("inputs"), missing.alias("ambiguous")
    )
