"""Incident runs: fleet view, timelines, approvals, look-ups.

incidents: run_id, service, started_at, finished_at, severity, tldr, title,
final_state, message_ts; severity and tldr are NULL for runs without a report.
incident_events: run_id, seq, timestamp, state, agent, message.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanvigil.functions.scalars import status_rank
from spanvigil.operators.matching import contains_matches
from spanvigil.operators.ordered import lag_by_chunk


def from_documents(documents: DataFrame) -> DataFrame:
    """Nested run documents as flat incidents; times become timestamps."""
    return documents.select(
        "run_id",
        F.col("project_name").alias("service"),
        F.try_to_timestamp(F.col("started_at")).alias("started_at"),
        F.try_to_timestamp(F.col("finished_at")).alias("finished_at"),
        "final_state",
        F.col("incident_report.severity").alias("severity"),
        F.col("incident_report.tldr").alias("tldr"),
        F.col("incident_report.title").alias("title"),
        F.col("slack_message_ts").alias("message_ts"),
        "approval",
        F.col("sentinel_verdict.status").alias("verdict_status"),
    )


def events_of(documents: DataFrame) -> DataFrame:
    return documents.select("run_id", F.posexplode("events").alias("seq", "e")).select(
        "run_id", "seq", F.try_to_timestamp(F.col("e.timestamp")).alias("timestamp"), "e.state", "e.agent", "e.message", "e.metadata"
    )


def fleet_summary(incidents: DataFrame) -> DataFrame:
    """Per service: incidents with a report, worst severity, the newest summary of
    that severity, latest time."""
    rank = status_rank(F.col("severity"))
    return (
        incidents.where("severity IS NOT NULL")
        .groupBy("service")
        .agg(
            F.count(F.lit(1)).alias("n_incidents"),
            F.max(F.struct(rank.alias("rank"), "started_at", "run_id", "severity", "tldr")).alias("worst"),
            F.max("started_at").alias("latest_at"),
        )
        .select(
            "service",
            "n_incidents",
            F.col("worst.severity").alias("worst_severity"),
            F.when(F.col("worst.rank") > 0, F.col("worst.tldr")).otherwise("").alias("summary"),
            "latest_at",
        )
    )


def current_health(services: DataFrame, incidents: DataFrame) -> DataFrame:
    """Status of the newest run whose project contains the service's name.

    Runs are first reduced to the newest per project, so the name match runs
    over project names only.
    """
    latest = incidents.groupBy(F.col("service").alias("project")).agg(
        F.max(F.struct("started_at", "run_id", "severity", "final_state")).alias("r")
    )
    matched = (
        contains_matches(latest, "project", services.select("service"), "service", [])
        .groupBy("service")
        .agg(F.max("r").alias("r"))
    )
    return services.select("service").join(matched, "service", "left").select(
        "service",
        F.coalesce("r.severity", "r.final_state", F.lit("UNKNOWN")).alias("status"),
        F.col("r.run_id").alias("last_run"),
        F.col("r.started_at").alias("started_at"),
    )


def recent_incidents(incidents: DataFrame, limit: int) -> DataFrame:
    return incidents.orderBy(F.desc("started_at"), "run_id").limit(limit)


def incident_by_id(incidents: DataFrame, run_id) -> DataFrame:
    return incidents.where(F.col("run_id") == run_id)


def run_durations(incidents: DataFrame) -> DataFrame:
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / F.lit(1e6)
    return incidents.withColumn("duration_seconds", seconds)


def timeline(events: DataFrame) -> DataFrame:
    """Events with the seconds since the run's previous event."""
    previous = lag_by_chunk(
        events, "run_id", "timestamp", "seq", "timestamp", F.date_trunc("hour", "timestamp"), "previous_at"
    )
    return previous.withColumn(
        "step_seconds", (F.unix_micros("timestamp") - F.unix_micros("previous_at")) / F.lit(1e6)
    )


def approval_state(writes: DataFrame) -> DataFrame:
    """Decision per run over all writes of it: a later write without a decision
    does not lose an earlier one; the last decision counts."""
    decided = F.col("decision").isNotNull()
    return writes.groupBy("run_id").agg(
        F.max(F.when(decided, F.struct("at", "seq", "decision", "by"))).alias("d"),
        F.count(F.lit(1)).alias("n_writes"),
    ).select("run_id", "d.decision", "d.by", F.col("d.at").alias("decided_at"), "n_writes")


def thread_lookup(replies: DataFrame, incidents: DataFrame) -> DataFrame:
    """Replies with the newest incident posted under their thread's timestamp."""
    owners = (
        incidents.where("message_ts IS NOT NULL")
        .groupBy("message_ts")
        .agg(F.max(F.struct("started_at", "run_id", "service", "severity", "final_state")).alias("i"))
    )
    return replies.join(owners, replies["thread_ts"] == owners["message_ts"], "left").select(
        *[replies[c] for c in replies.columns], F.col("i.run_id").alias("run_id"), F.col("i.service").alias("service"), F.col("i.severity").alias("severity")
    )
