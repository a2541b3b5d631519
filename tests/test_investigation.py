import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanvigil.operators import changes, decision, incidents, lineage, matching, validation
from spanvigil.operators.ordered import lag_by_chunk


def test_contains_matches_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [(i, rng.choice("ab"), "".join(rng.choice("xyzé ") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    needles = [(r, "".join(rng.choice("xyzé ") for _ in range(n))) for r in "ab" for n in (1, 2, 3, 4, 5, 6)]
    found = matching.contains_matches(
        spark.createDataFrame(texts, "id int, repo string, text string"), "text",
        spark.createDataFrame(needles, "repo string, needle string"), "needle", ["repo"],
    )
    expected = sorted((i, n) for i, r, t in texts for q, n in set(needles) if q == r and n in t)
    assert sorted((r["id"], r["needle"]) for r in found.collect()) == expected


def test_suspects(spark):
    rows = spark.createDataFrame(
        [("r", "a", "2024-01-01", "set SEQ_LEN to 12", ["src/model.py"]), ("r", "b", "2024-01-02", "docs", ["src/model.py", "x/src/model.py", "y"]), ("r", "c", "2024-01-03", "none", []), ("q", "d", "2024-01-03", "seq_len", [])],
        "repo string, sha string, date string, message string, files array<string>",
    )
    patterns = spark.createDataFrame([("r", "seq_len"), ("r", "overall"), ("r", "")], "repo string, pattern string")
    hits = spark.createDataFrame([("r", "seq_len", "src/model.py"), ("r", "seq_len", "model.py"), ("r", "overall", "y")], "repo string, pattern string, file string")
    found = changes.suspect_changes(rows, patterns, hits).orderBy("place").collect()
    assert [(r["sha"], r["score"]) for r in found] == [("a", 15), ("b", 10)]


def test_lag_by_chunk_equals_a_plain_window(spark):
    frame = spark.range(2_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("key"),
        F.pmod(F.hash("id"), F.lit(500)).alias("time"), F.col("id").alias("tie"), (F.col("id") * 2).alias("v"),
    )
    chunked = lag_by_chunk(frame, "key", "time", "tie", "v", F.floor(F.col("time") / 40), "before")
    plain = frame.withColumn("before", F.lag("v").over(Window.partitionBy("key").orderBy("time", "tie")))
    assert chunked.exceptAll(plain.select(chunked.columns)).count() == 0 and chunked.count() == 2_000


def test_mismatch_levels(spark):
    runs = spark.createDataFrame([("e", "r1", 1, {"limit": "73"}), ("e", "r2", 2, {"depth": "184 "})], "experiment string, run_id string, start_time int, params map<string,string>")
    seen = spark.createDataFrame([("e", "limit", "73"), ("e", "depth", "184"), ("e", "depth", "9"), ("none", "depth", "9")], "experiment string, attribute string, value string")
    found = {(r["experiment"], r["attribute"], r["value"]): (r["severity"], r["mismatch"]) for r in lineage.training_mismatch(seen, lineage.latest_run(runs)).collect()}
    assert found == {("e", "limit", "73"): ("high", True), ("e", "depth", "184"): ("low", False), ("e", "depth", "9"): ("medium", True), ("none", "depth", "9"): ("unknown", False)}


def test_provenance_and_governance(spark):
    tag = lineage.TAG_SOURCE, lineage.TAG_COMMIT
    runs = spark.createDataFrame(
        [("good", "1", 1, {tag[0]: "git/train.py", tag[1]: "abc"}), ("home", "2", 1, {tag[0]: "/home/x/train.py"}), ("kernel", "3", 1, {tag[0]: "/x/ipykernel_launcher.py", tag[1]: "abc"}), ("bare", "4", 1, {})],
        "experiment string, run_id string, start_time int, tags map<string,string>",
    )
    known = lineage.provenance(lineage.latest_run(runs))
    found = {r["experiment"]: (r["warnings"], r["traceable"]) for r in known.collect()}
    assert found == {"good": ([], True), "home": (["no_commit", "personal_disk"], False), "kernel": (["kernel_source"], False), "bare": (["no_commit", "no_source"], False)}
    registry = spark.createDataFrame([("s", "m1", "good"), ("s", "m2", "bare"), ("s", "m3", "unknown")], "service string, model_family string, experiment string")
    risky = {r["model_family"]: r["n_warnings"] for r in lineage.governance(registry, known).collect()}
    assert risky == {"m2": 2, "m3": 1}


def test_validation_verdicts(spark):
    flagged = spark.createDataFrame([("pass", "region=eu", 3.0), ("half", "region=eu", 3.0), ("half", "k=1", 2.0), ("fail", "region=eu", 3.0), ("gone", "region=eu", 3.0), ("none", "k=1", 2.0)], "service string, segment string, ratio double")
    current = spark.createDataFrame([("pass", "input.region", "eu", 1.05), ("half", "input.region", "eu", 1.5), ("half", "input.k", "1", 1.0), ("fail", "input.region", "eu", 2.4)], "service string, attr string, value string, ratio double")
    seen = spark.createDataFrame([("pass", 9), ("half", 9), ("fail", 9), ("gone", 9)], "service string, n_spans long")
    compared = validation.compare_segments(flagged, current)
    assert {(r["service"], r["segment"]): r["improvement"] for r in compared.collect()}["pass", "region=eu"] == 1.95
    rows = {r["service"]: (r["status"], r["next_step"]) for r in validation.phase_one(compared, seen).collect()}
    assert rows == {"pass": ("PASS", "monitor"), "half": ("INCONCLUSIVE", "monitor"), "fail": ("FAIL", "re-investigate"), "gone": ("INCONCLUSIVE", "monitor"), "none": ("NO_DATA", "monitor")}


def test_recovery_needs_passes_in_a_row(spark):
    polls = {"a": "PFPP", "b": "PFPF", "c": "FFFFFFFFFFPP", "d": "PP"}
    rows = [(r, i, {"P": "PASS", "F": "FAIL"}[c]) for r, text in polls.items() for i, c in enumerate(text, 1)]
    found = {r["run_id"]: (r["status"], r["at_poll"]) for r in validation.recovery(spark.createDataFrame(rows, "run_id string, poll int, status string")).collect()}
    assert found == {"a": ("PASS", 4), "b": ("FAIL", None), "c": ("FAIL", None), "d": ("PASS", 2)}


def test_remediation_and_hypotheses(spark):
    rows = spark.createDataFrame([("HEALTHY", "abc", 0.9), ("CRITICAL", None, 0.9), ("CRITICAL", "", 0.9), ("CRITICAL", "abc", 0.69), ("WARNING", "abc", 0.7)], "s string, sha string, c double")
    assert [r[0] for r in rows.select(decision.remediation_action(F.col("s"), F.col("sha"), F.col("c"))).collect()] == ["NO_ACTION"] * 4 + ["REVERT_COMMIT"]
    metrics = spark.createDataFrame([("mae",), ("silence",), ("my_metric",)], "m string")
    assert [r[0] for r in metrics.select(decision.hypothesis_class(F.col("m"))).collect()] == ["code_or_mismatch", "infrastructure", "custom"]


def test_fleet_views(spark):
    rows = spark.createDataFrame(
        [("1", "eta-prod", 1, "WARNING", "old"), ("2", "eta-prod", 2, "WARNING", "new"), ("3", "eta-prod", 3, "HEALTHY", "fine"), ("4", "eta-prod", 9, None, None), ("5", "risk", 1, "HEALTHY", "ok")],
        "run_id string, service string, started_at int, severity string, tldr string",
    ).withColumn("final_state", F.lit("RESOLVED"))
    fleet = {r["service"]: (r["n_incidents"], r["worst_severity"], r["summary"], r["latest_at"]) for r in incidents.fleet_summary(rows).collect()}
    assert fleet == {"eta-prod": (3, "WARNING", "new", 3), "risk": (1, "HEALTHY", "", 1)}
    asked = spark.createDataFrame([("eta",), ("risk",), ("fraud",)], "service string")
    assert {r["service"]: (r["status"], r["last_run"]) for r in incidents.current_health(asked, rows).collect()} == {"eta": ("RESOLVED", "4"), "risk": ("HEALTHY", "5"), "fraud": ("UNKNOWN", None)}


def test_decisions_survive_later_writes(spark):
    writes = spark.createDataFrame([("r", 1, 1, None, None), ("r", 2, 2, "APPROVED", "ann"), ("r", 3, 3, None, None), ("q", 1, 1, None, None)], "run_id string, seq int, at int, decision string, by string")
    assert {r["run_id"]: (r["decision"], r["by"], r["n_writes"]) for r in incidents.approval_state(writes).collect()} == {"r": ("APPROVED", "ann", 3), "q": (None, None, 1)}


def test_phase_two(spark):
    rows = []
    for family, new in (("kept", 10.5), ("worse", 20.0), ("drifted", 10.0)):
        rows += [(family, "short", day, 10.0 if day < 5 else new) for day in range(1, 9) for _ in range(3)]
    rows += [("early", "short", day, 10.0) for day in range(1, 4)]
    errors = spark.createDataFrame(rows, "family string, bucket string, day int, error double").withColumn("time", F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)))
    psi = spark.createDataFrame([("kept", 0.1), ("drifted", 0.2)], "family string, psi double")
    onset, fixed = F.to_timestamp(F.lit("2024-01-04")), F.to_timestamp(F.lit("2024-01-05"))
    found = {r["family"]: r["status"] for r in validation.phase_two(errors, onset, fixed, "family", ["bucket"], psi).collect()}
    assert found == {"kept": "PASS", "worse": "FAIL", "drifted": "FAIL", "early": "DEFERRED"}


def test_interval_joins(spark):
    spans = spark.createDataFrame([("s", d, f"2024-01-{d:02d} 12:00:00") for d in range(1, 29)], "service string, request_id int, at string").withColumn("start_time", F.to_timestamp("at"))
    runs = spark.createDataFrame([("s", "r1", "2024-01-10 12:00:00", "2024-01-12 12:00:00"), ("s", "r2", "2024-01-20 00:00:00", "2024-01-20 06:00:00")], "service string, run_id string, a string, b string").select("service", "run_id", F.to_timestamp("a").alias("onset"), F.to_timestamp("b").alias("resolved_at"))
    found = {}
    for r in validation.incident_snapshots(spans.select("service", "request_id", "start_time"), runs).collect():
        found.setdefault((r["run_id"], r["phase"]), set()).add(r["request_id"])
    assert found == {("r1", "pre_drift"): set(range(3, 10)), ("r1", "post_fix"): {12}, ("r2", "pre_drift"): set(range(13, 20)), ("r2", "post_fix"): {20}}
    commits = spark.createDataFrame([("r", "a", "2024-01-08 11:59:00", ["x"]), ("r", "b", "2024-01-08 12:00:00", ["x"]), ("r", "c", "2024-01-10 12:00:00", ["x", "y"]), ("r", "d", "2024-01-09 00:00:00", ["y"])], "repo string, sha string, d string, files array<string>").withColumn("date", F.to_timestamp("d"))
    onsets = spark.createDataFrame([("r", "2024-01-10 12:00:00")], "repo string, o string").select("repo", F.to_timestamp("o").alias("onset"))
    risky = spark.createDataFrame([("r", "x")], "repo string, file string")
    assert sorted(r["sha"] for r in changes.changes_before_onset(commits, onsets, risky).collect()) == ["b", "c"]


def test_counted_snapshots(spark):
    """Counts of overlapping windows are those of the listed spans, with requests that
    come again in, around and outside windows, at their ends, and without an id."""
    spans = spark.range(4000).select(
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("service"),
        F.when(F.col("id") % 7 > 0, (F.xxhash64("id") % 150).cast("string")).alias("request_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40 * 96)) * 900).alias("start_time"),
    )
    runs = spark.range(60).select(
        F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("service"),
        F.col("id").alias("run_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 54000 + F.col("id") % 5).alias("onset"),
        F.when(F.col("id") % 9 > 0, F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 54900)).alias("resolved_at"),
    )
    listed = validation.incident_snapshots(spans, runs).groupBy("service", "run_id", "phase").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("request_id").alias("n_distinct")
    )
    counted = validation.incident_snapshots(spans, runs, count="request_id")
    assert sorted(counted.collect()) == sorted(listed.collect())
    plan = counted._jdf.queryExecution().analyzed().toString()
    assert "start_time" not in plan  # the result is made of sums, no longer of spans
