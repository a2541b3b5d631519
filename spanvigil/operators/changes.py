"""Code changes as suspects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanvigil.functions.scalars import is_meaningful_pattern
from spanvigil.operators.matching import contains_matches

# --- fixed values -------------------------------------------------------------------
MESSAGE_SCORE = 10
FILE_SCORE = 5
RISK_HOURS = 48
# ------------------------------------------------------------------------------------


def recent_changes(changes: DataFrame, as_of: Column, days_back: int = 7, max_commits: int | None = None) -> DataFrame:
    """Changes of the last days, the newest ``max_commits`` of them if given.

    ``title`` is the first line of the message, which stays whole.
    """
    rows = changes.where(F.col("date") >= as_of - F.make_dt_interval(days=F.lit(days_back)))
    rows = rows.withColumn("title", F.split_part("message", F.lit("\n"), F.lit(1)))
    return rows if max_commits is None else rows.orderBy(F.desc("date"), "sha").limit(max_commits)


def suspect_changes(changes: DataFrame, patterns: DataFrame, hit_files: DataFrame, top: int | None = None) -> DataFrame:
    """Changes ranked per (repo, pattern): 10 for a message naming the pattern, 5
    for every changed file whose path contains a file the pattern was found in.

    ``changes``: repo, sha, date, message, files; ``patterns``: repo, pattern;
    ``hit_files``: repo, pattern, file.
    """
    asked = patterns.where(is_meaningful_pattern(F.col("pattern"))).withColumn("needle", F.lower("pattern"))
    named = contains_matches(
        changes.select("repo", "sha", F.lower("message").alias("text")),
        "text",
        asked.select("repo", "pattern", "needle").distinct(),
        "needle",
        ["repo"],
    ).select("repo", "pattern", "sha", F.lit(MESSAGE_SCORE).alias("score"))
    paths = changes.select("repo", "sha", F.posexplode("files").alias("nth", "path"))
    hits = hit_files.join(asked.select("repo", "pattern"), ["repo", "pattern"], "left_semi").distinct()
    touched = (
        contains_matches(paths, "path", hits, "file", ["repo"])
        .select("repo", "pattern", "sha", "nth")
        .distinct()
        .select("repo", "pattern", "sha", F.lit(FILE_SCORE).alias("score"))
    )
    scores = named.unionByName(touched).groupBy("repo", "pattern", "sha").agg(F.sum("score").alias("score"))
    order = Window.partitionBy("repo", "pattern").orderBy(F.desc("score"), F.desc("date"), "sha")
    placed = scores.join(changes.select("repo", "sha", "date"), ["repo", "sha"]).withColumn("place", F.row_number().over(order))
    return placed if top is None else placed.where(F.col("place") <= top)


def newest_change_per_file(changes: DataFrame) -> DataFrame:
    files = changes.select("repo", "sha", "author", "date", F.explode("files").alias("file"))
    return (
        files.groupBy("repo", "file")
        .agg(F.max(F.struct("date", "sha", "author")).alias("c"), F.count(F.lit(1)).alias("n_changes"))
        .select("repo", "file", "c.sha", "c.author", "c.date", "n_changes")
    )


def change_detail(changes: DataFrame, pulls: DataFrame, patch_chars: int | None = None, body_chars: int | None = None) -> DataFrame:
    """Changes with patch and their first merge request, if any.

    Texts are whole unless an excerpt of so many characters is asked for.
    """
    cut = lambda c, n: c if n is None else F.left(c, F.lit(n))
    first = pulls.groupBy("sha").agg(
        F.min(F.struct("number", "title", cut(F.col("body"), body_chars).alias("body_excerpt"))).alias("pr")
    )
    return changes.join(first, "sha", "left").select(
        "sha",
        F.left("sha", F.lit(8)).alias("short_sha"),
        "date",
        cut(F.coalesce("patch", F.lit("")), patch_chars).alias("patch_excerpt"),
        F.col("pr.number").alias("pr_number"),
        F.col("pr.title").alias("pr_title"),
        F.col("pr.body_excerpt").alias("pr_body"),
    )


def changes_before_onset(changes: DataFrame, onsets: DataFrame, high_risk: DataFrame, hours: int = RISK_HOURS) -> DataFrame:
    """Changes merged in the hours before a drift onset that touch a risky file.

    The interval join goes over day buckets: an onset looks into the few days its
    window covers, a change sits in one.
    """
    start = F.col("onset") - F.make_dt_interval(hours=F.lit(hours))
    windows = onsets.withColumn("since", start).withColumn(
        "day", F.explode(F.sequence(F.to_date("since"), F.to_date("onset")))
    )
    merged = changes.withColumn("day", F.to_date("date"))
    near = merged.join(windows, ["repo", "day"]).where("date >= since AND date <= onset").drop("day", "since")
    risky = (
        changes.select("repo", "sha", F.explode("files").alias("file"))
        .join(high_risk, ["repo", "file"], "left_semi")
        .select("repo", "sha")
        .distinct()
    )
    return near.join(risky, ["repo", "sha"], "left_semi")
