"""Training runs: latest versions, provenance, mismatch with production."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: run tags --------------------------------------------------------
TAG_SOURCE = "mlflow.source.name"
TAG_COMMIT = "mlflow.source.git.commit"
TAG_BRANCH = "mlflow.source.git.branch"
TAG_TYPE = "mlflow.source.type"
TAG_USER = "mlflow.user"
TAG_RUN_NAME = "mlflow.runName"
# -----------------------------------------------------------------------------------


def latest_run(runs: DataFrame) -> DataFrame:
    """Newest run per experiment: a partial aggregate, no sort of an experiment."""
    whole = F.struct(*[F.col(c) for c in runs.columns])
    return (
        runs.groupBy("experiment")
        .agg(F.max_by(whole, F.struct("start_time", "run_id")).alias("run"))
        .select("run.*")
    )


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    newest = Window.partitionBy("experiment").orderBy(F.desc("start_time"), F.desc("run_id"))
    return runs.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n)


def latest_version(versions: DataFrame) -> DataFrame:
    """Row with the largest integer version per model name."""
    whole = F.struct(*[F.col(c) for c in versions.columns])
    return (
        versions.groupBy("model_name")
        .agg(F.max_by(whole, F.struct(F.col("version").try_cast("bigint"), "run_id")).alias("v"))
        .select("v.*")
    )


def training_mismatch(observed: DataFrame, latest: DataFrame) -> DataFrame:
    """``observed``: experiment, attribute, value (what production sends).

    high: training never set the parameter; medium: another value; low: agreed;
    unknown: no run.
    """
    runs = latest.select("experiment", "run_id", "params")
    trained = F.try_element_at("params", F.col("attribute"))
    severity = (
        F.when(F.col("run_id").isNull(), "unknown")
        .when(F.col("training_value").isNull(), "high")
        .when(F.trim("training_value") != F.trim("value"), "medium")
        .otherwise("low")
    )
    return (
        observed.join(runs, "experiment", "left")
        .withColumn("training_value", trained)
        .withColumn("severity", severity)
        .withColumn("mismatch", F.col("severity").isin("high", "medium"))
        .drop("params")
    )


def _tag(name: str) -> Column:
    return F.nullif(F.try_element_at("tags", F.lit(name)), F.lit(""))


def provenance(latest: DataFrame) -> DataFrame:
    """Where the training code of each latest run came from, with warnings."""
    commit, source = F.col("git_commit"), F.col("source_path")
    warnings = F.array_compact(
        F.array(
            F.when(commit.isNull(), "no_commit"),
            F.when(F.contains(source, F.lit("ipykernel")), "kernel_source"),
            F.when(F.startswith(source, F.lit("/home/")) & commit.isNull(), "personal_disk"),
            F.when(source.isNull(), "no_source"),
        )
    )
    return (
        latest.select(
            "experiment",
            "run_id",
            _tag(TAG_SOURCE).alias("source_path"),
            _tag(TAG_COMMIT).alias("git_commit"),
            _tag(TAG_BRANCH).alias("git_branch"),
            _tag(TAG_TYPE).alias("runtime"),
            _tag(TAG_USER).alias("user"),
            _tag(TAG_RUN_NAME).alias("run_name"),
        )
        .withColumn("warnings", warnings)
        .withColumn("traceable", commit.isNotNull() & (F.size("warnings") == 0))
    )


def governance(registry: DataFrame, provenances: DataFrame) -> DataFrame:
    """Registered models whose training code cannot be traced; a registry entry
    without any run is kept with the warning 'no_run'."""
    return (
        registry.join(provenances, "experiment", "left")
        .withColumn("warnings", F.coalesce("warnings", F.array(F.lit("no_run"))))
        .withColumn("traceable", F.coalesce("traceable", F.lit(False)))
        .where(~F.col("traceable") | (F.size("warnings") > 0))
        .withColumn("n_warnings", F.size("warnings"))
    )
