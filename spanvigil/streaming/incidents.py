"""Streams around incidents: recovery, approvals, the live event feed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# --- fixed values ---------------------------------------------------------------
TERMINAL_STATES = ("RESOLVED", "FAILED")
# --------------------------------------------------------------------------------


def recovery(polls: DataFrame, need: int = 2, cap: int = 10, quiet: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """PASS once ``need`` polls in a row passed, FAIL when ``cap`` polls did not.

    ``polls``: run_id, poll (1..), status, polled_at.  The state of a run is its streak
    and how many polls it has seen; polls beyond the cap are dropped before grouping,
    so a run never brings more than ``cap`` rows.  The last poll or the ``cap``-th one
    ends a run, so a missing poll number does not keep it open.  A run whose newest
    poll lies ``quiet`` behind the watermark is over: without a verdict it is FAIL
    without a poll, and in any case its state goes.  Time is that of the polls, so a
    drained stream expires the same runs as one that never ends.
    Polls of one micro-batch are taken in order, later batches after them.
    """
    hold = int(pd.Timedelta(quiet).total_seconds() * 1_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, seen, done, newest = state.get if state.exists else (0, 0, False, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([] if done else [(key[0], "FAIL", None)], columns=["run_id", "status", "at_poll"])
            return
        rows = pd.concat(batches).sort_values("poll")
        out = []
        for poll, status in zip(rows["poll"], rows["status"], strict=True):
            if done:
                break
            seen += 1
            streak = streak + 1 if status == "PASS" else 0
            if streak >= need or seen >= cap or poll >= cap:
                done = True
                out.append((key[0], "PASS" if streak >= need else "FAIL", int(poll)))
        newest = max(int(newest), int(rows["polled_ms"].max()))
        state.update((int(streak), int(seen), done, newest))
        state.setTimeoutTimestamp(max(newest + hold, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["run_id", "status", "at_poll"])

    timed = polls.where((F.col("poll") <= cap) & F.col("polled_at").isNotNull()).withWatermark("polled_at", delay)
    return (
        timed.withColumn("polled_ms", F.unix_millis("polled_at"))
        .groupBy("run_id")
        .applyInPandasWithState(
            step,
            outputStructType="run_id bigint, status string, at_poll bigint",
            stateStructType="streak int, seen int, done boolean, newest bigint",
            outputMode="append",
            timeoutConf=GroupStateTimeout.EventTimeTimeout,
        )
    )


def approvals(requests: DataFrame, decisions: DataFrame, timeout: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Requests with the decisions made before their timeout; a request whose
    timeout passed without one comes out with outcome TIMEOUT.

    ``requests``: run_id, requested_at; ``decisions``: run_id, decision, by,
    decided_at.  Event time on both sides bounds the join state.
    """
    asked = requests.withWatermark("requested_at", delay)
    made = decisions.withColumnRenamed("run_id", "decided_run").withWatermark("decided_at", delay)
    in_time = F.expr(
        f"run_id = decided_run AND decided_at >= requested_at AND decided_at <= requested_at + INTERVAL {timeout}"
    )
    return asked.join(made, in_time, "leftOuter").select(
        "run_id", "requested_at", "decided_at", "by", F.coalesce("decision", F.lit("TIMEOUT")).alias("outcome")
    )


def first_decision(outcomes: DataFrame) -> DataFrame:
    """A request's earliest decision, from the table the stream wrote."""
    return outcomes.groupBy("run_id").agg(F.min(F.struct("decided_at", "outcome", "by")).alias("d")).select(
        "run_id", "d.outcome", "d.by"
    )


def event_feed(events: DataFrame) -> DataFrame:
    """New events in arrival order of the log; ``done`` marks terminal states.
    The source's offsets remember what was sent already."""
    return events.withColumn("done", F.col("state").isin(*TERMINAL_STATES))
