"""Drill-down, code suspects, incidents, validation and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanvigil.functions.scalars import confidence_band, round_to
from spanvigil.operators import changes as ch
from spanvigil.operators import decision, drift, incidents, investigation, segments, trends, validation
from spanvigil.operators.attributes import configured_counts
from spanvigil.operators.halves import with_halves
from spanvigil.session import materialise
from workload import health_queries as hq
from workload import views
from workload.oracle_base import sql, view
from workload.registry import query

US = "'%Y-%m-%d %H:%M:%S.%f'"


# --- drill-down ------------------------------------------------------------------------


@query("anomaly_drilldown", sql(f"""
SELECT service, attr, value, n, strftime(earliest, {US}) AS earliest, strftime(latest, {US}) AS latest, mean_error,
       array_to_string(sample_ids, ',') AS sample_ids
FROM (SELECT service, attr, value, count(*) AS n, min(start_time) AS earliest, max(start_time) AS latest, round(avg(error), 1) AS mean_error,
             list(request_id ORDER BY start_time, request_id)[1:5] AS sample_ids
      FROM (SELECT service, 'input.event_type' AS attr, event_type AS value, start_time, request_id, error FROM spans
            UNION ALL SELECT service, 'input.user_bucket', user_bucket, start_time, request_id, error FROM spans)
      JOIN (SELECT service, attr, value FROM segment_ratios WHERE ratio >= 1.2) USING (service, attr, value) GROUP BY service, attr, value)""", "spans", "segment_ratios"))
def anomaly_drilldown(spark, d):
    rows = segments.with_ratio(segments.segment_breakdown(hq.configured(spark, d), views.services(spark)), hq.resolved(spark, d))
    flagged = rows.where("ratio >= 1.2").select("service", F.concat(F.regexp_replace("attr", "^input.", ""), F.lit("="), "value").alias("segment"))
    out = investigation.drill_down(investigation.anomaly_spans(views.spans(spark, d), flagged), 5)
    return out.select(
        "service", "attr", "value", "n", views.stamp("earliest").alias("earliest"), views.stamp("latest").alias("latest"), "mean_error",
        F.array_join("sample_ids", ",").alias("sample_ids"),
    )


@query("hypotheses", sql("""
SELECT metric, class, count(*) AS n FROM (
  SELECT 'mae' AS metric, 'code_or_mismatch' AS class FROM segment_ratios WHERE ratio >= 1.2
  UNION ALL SELECT 'psi', 'code_or_mismatch' FROM psi_resolved WHERE psi >= 0.1
  UNION ALL SELECT 'prediction_volume', 'custom' FROM facts WHERE n_spans = 0
  UNION ALL SELECT "check", CASE "check" WHEN 'input_drift_auto' THEN 'data_drift' WHEN 'baseline_stale' THEN 'stale_version' WHEN 'schema_drift' THEN 'feature_data' WHEN 'null_rate' THEN 'feature_data'
                            WHEN 'output_drift' THEN 'custom' ELSE 'infrastructure' END FROM signals
  UNION ALL SELECT name, 'custom' FROM metrics WHERE status <> 'HEALTHY') GROUP BY ALL""", "segment_ratios", "psi_resolved", "facts", "signals", "metrics"))
def hypotheses(spark, d):
    t = hq.tables(spark, d)
    rows = decision.anomalies(t.segments, t.psi, t.silent, t.signals, t.metrics)
    return rows.withColumn("class", decision.hypothesis_class(F.col("metric"))).groupBy("metric", "class").agg(F.count(F.lit(1)).alias("n"))


# --- changes ---------------------------------------------------------------------------

PATTERNS = ("tion", "re", "th", "overall", "src1", "password")
RISKY = ("src1", "src2", "src3")


def changes(spark, d):
    i = F.col("doc_id")
    return views.table(spark, d, "documents").select(
        F.col("lang").alias("repo"), F.lpad(i.cast("string"), 10, "0").alias("sha"), F.concat(F.lit("dev"), (i % 13).cast("string")).alias("author"),
        F.timestamp_micros(F.lit(1704067200000000) + i * 60_000_000).alias("date"), F.col("text").alias("message"),
        F.array(F.col("source"), F.concat("source", F.lit("/"), "lang")).alias("files"), F.col("text").alias("patch"),
    )


view("changes")("""
SELECT lang AS repo, lpad(CAST(doc_id AS VARCHAR), 10, '0') AS sha, 'dev' || CAST(doc_id % 13 AS VARCHAR) AS author,
       TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS date, text AS message, [source, source || '/' || lang] AS files FROM documents""")
view("hit_files")("""
SELECT DISTINCT lang AS repo, pattern, file FROM documents CROSS JOIN (VALUES ('tion', 'src1'), ('tion', 'src7/'), ('re', 'src2'), ('overall', 'src3')) v(pattern, file)""")


def repos(spark, d):
    return views.table(spark, d, "documents").select(F.col("lang").alias("repo")).distinct()


@query("suspect_changes", sql("""
SELECT repo, pattern, sha, score, place FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, pattern ORDER BY score DESC, date DESC, sha) AS place FROM (
    SELECT c.repo, p.pattern, sha, date,
           CASE WHEN contains(lower(message), p.pattern) THEN 10 ELSE 0 END
           + 5 * len(list_filter(files, lambda f: len(list_filter(hits, lambda h: contains(f, h))) > 0)) AS score
    FROM changes c JOIN (SELECT DISTINCT repo, pattern FROM changes CROSS JOIN (VALUES ('tion'), ('re'), ('th'), ('src1'), ('password')) v(pattern)) p USING (repo)
    LEFT JOIN (SELECT repo, pattern, list(file) AS hits FROM hit_files GROUP BY ALL) h ON h.repo = p.repo AND h.pattern = p.pattern) WHERE score > 0) WHERE place <= 10""", "changes", "hit_files"))
def suspect_changes(spark, d):
    names = repos(spark, d)
    patterns = names.withColumn("pattern", F.explode(F.array(*map(F.lit, PATTERNS))))
    pairs = (("tion", "src1"), ("tion", "src7/"), ("re", "src2"), ("overall", "src3"))
    hits = names.withColumn("h", F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(f).alias("file")) for p, f in pairs]))).select("repo", "h.*")
    return ch.suspect_changes(changes(spark, d), patterns, hits, 10).select("repo", "pattern", "sha", "score", "place")


@query("recent_changes", sql("""
SELECT sha, strftime(date, '%Y-%m-%d %H:%M') AS date, length(string_split(message, chr(10))[1]) AS title_chars FROM changes
WHERE date >= (SELECT max(date) FROM changes) - INTERVAL 7 DAY ORDER BY changes.date DESC, sha LIMIT 50""", "changes"))
def recent_changes(spark, d):
    rows = changes(spark, d)
    newest = rows.agg(F.max("date")).scalar()
    return ch.recent_changes(rows, newest, 7, 50).select("sha", F.date_format("date", "yyyy-MM-dd HH:mm").alias("date"), F.length("title").alias("title_chars"))


@query("newest_change_per_file", sql("""
SELECT repo, file, max(sha) AS sha, arg_max(author, sha) AS author, count(*) AS n_changes FROM (SELECT repo, sha, author, unnest(files) AS file FROM changes) GROUP BY repo, file""", "changes"))
def newest_change_per_file(spark, d):
    return ch.newest_change_per_file(changes(spark, d)).drop("date")


@query("change_detail", sql("""
SELECT sha, left(sha, 8) AS short_sha, length(message) AS patch_chars, l.doc_id * 10 AS pr_number, 'quality ' || CAST(quality AS VARCHAR) AS pr_title
FROM changes LEFT JOIN labels l ON lpad(CAST(l.doc_id AS VARCHAR), 10, '0') = sha""", "changes"))
def change_detail(spark, d):
    pulls = views.table(spark, d, "labels").select(
        F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("sha"), (F.col("doc_id") * 10).alias("number"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("title"), F.lit("").alias("body"),
    )
    return ch.change_detail(changes(spark, d), pulls).select("sha", "short_sha", F.length("patch_excerpt").alias("patch_chars"), "pr_number", "pr_title")


@query("changes_before_onset", sql("""
SELECT repo, sha FROM changes JOIN (SELECT repo, max(date) AS onset FROM changes GROUP BY repo) USING (repo)
WHERE date >= onset - INTERVAL 48 HOUR AND date <= onset AND list_has_any(files, ['src1', 'src2', 'src3'])""", "changes"))
def changes_before_onset(spark, d):
    rows = changes(spark, d)
    onsets = rows.groupBy("repo").agg(F.max("date").alias("onset"))
    risky = repos(spark, d).withColumn("file", F.explode(F.array(*map(F.lit, RISKY))))
    return ch.changes_before_onset(rows, onsets, risky).select("repo", "sha")


@query("remediation", sql("""
SELECT doc_id, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS band,
       CASE WHEN status <> 'HEALTHY' AND commit_sha IS NOT NULL AND confidence >= 0.7 THEN 'REVERT_COMMIT' ELSE 'NO_ACTION' END AS action
FROM (SELECT doc_id, (doc_id % 100) / 100.0 AS confidence, CASE WHEN toxic = 1 THEN 'CRITICAL' WHEN quality = 1 THEN 'HEALTHY' ELSE 'WARNING' END AS status,
             CASE WHEN doc_id % 5 <> 0 THEN 'sha' END AS commit_sha FROM labels)"""))
def remediation(spark, d):
    i = F.col("doc_id")
    status = F.when(F.col("toxic") == 1, "CRITICAL").when(F.col("quality") == 1, "HEALTHY").otherwise("WARNING")
    confidence = (i % 100) / 100
    return views.table(spark, d, "labels").select(
        "doc_id", confidence_band(confidence).alias("band"),
        decision.remediation_action(status, F.when(i % 5 != 0, "sha"), confidence).alias("action"),
    )


# --- incidents -------------------------------------------------------------------------


def conversation_events(spark, d):
    base = F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 2400 + F.length("text") % 7 * 60
    return views.table(spark, d, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.timestamp_seconds(base).alias("timestamp"),
        F.col("role").alias("agent"), F.col("text").alias("message"),
    )


def incident_rows(spark, d):
    n = F.col("n")
    severity = F.when(n >= 6, "CRITICAL").when(n >= 4, "WARNING").when(n >= 2, "HEALTHY")
    return (
        conversation_events(spark, d).groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("started_at"), F.max("timestamp").alias("finished_at"), F.min(F.struct("seq", "message"))["message"].alias("tldr"))
        .select(
            "run_id", F.concat(F.lit("svc"), (F.col("run_id") % 4).cast("string"), F.lit("-prod")).alias("service"), "started_at", "finished_at",
            severity.alias("severity"), F.when(severity.isNotNull(), F.col("tldr")).alias("tldr"),
            F.when(n >= 6, "RESOLVED").otherwise("FAILED").alias("final_state"), F.unix_seconds("started_at").cast("string").alias("message_ts"), "n",
        )
    )


view("incident_events")("""
SELECT conv_id AS run_id, turn AS seq, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 2400 + length(text) % 7 * 60) AS timestamp, role AS agent, text AS message FROM conversations""")
view("incidents", "incident_events")("""
SELECT run_id, 'svc' || CAST(run_id % 4 AS VARCHAR) || '-prod' AS service, started_at, finished_at,
       CASE WHEN n >= 6 THEN 'CRITICAL' WHEN n >= 4 THEN 'WARNING' WHEN n >= 2 THEN 'HEALTHY' END AS severity,
       CASE WHEN n >= 2 THEN tldr END AS tldr, CASE WHEN n >= 6 THEN 'RESOLVED' ELSE 'FAILED' END AS final_state,
       CAST(CAST(epoch(started_at) AS BIGINT) AS VARCHAR) AS message_ts, n
FROM (SELECT run_id, count(*) AS n, min(timestamp) AS started_at, max(timestamp) AS finished_at, arg_min(message, seq) AS tldr FROM incident_events GROUP BY run_id)""")

RANK = "CASE severity WHEN 'CRITICAL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END"


@query("fleet_summary", sql(f"""
SELECT service, count(*) AS n_incidents, arg_max(severity, ({RANK}, started_at, run_id)) AS worst_severity,
       CASE WHEN max({RANK}) > 0 THEN arg_max(tldr, ({RANK}, started_at, run_id)) ELSE '' END AS summary, strftime(max(started_at), {US}) AS latest_at
FROM incidents WHERE severity IS NOT NULL GROUP BY service""", "incidents"))
def fleet_summary(spark, d):
    return incidents.fleet_summary(incident_rows(spark, d)).withColumn("latest_at", views.stamp("latest_at"))


@query("current_health", sql("""
SELECT s.service, coalesce(i.severity, i.final_state, 'UNKNOWN') AS status, i.run_id AS last_run FROM services s
LEFT JOIN (SELECT DISTINCT ON (service) * FROM incidents ORDER BY service, started_at DESC, run_id DESC) i ON contains(i.service, s.service)""", "services", "incidents"))
def current_health(spark, d):
    return incidents.current_health(views.services(spark), incident_rows(spark, d)).drop("started_at")


@query("recent_incidents", sql("""
SELECT run_id, service, severity, final_state FROM incidents ORDER BY started_at DESC, run_id LIMIT 5""", "incidents"))
def recent_incidents(spark, d):
    return incidents.recent_incidents(incident_rows(spark, d), 5).select("run_id", "service", "severity", "final_state")


@query("incident_by_id", sql("""
SELECT run_id, service, severity, epoch(finished_at) - epoch(started_at) AS duration_seconds FROM incidents WHERE run_id = (SELECT max(conv_id) FROM conversations)""", "incidents"))
def incident_by_id(spark, d):
    newest = views.table(spark, d, "conversations").agg(F.max("conv_id")).scalar()
    return incidents.run_durations(incidents.incident_by_id(incident_rows(spark, d), newest)).select("run_id", "service", "severity", "duration_seconds")


@query("incident_timeline", sql("""
SELECT run_id, seq, agent, epoch(timestamp) - epoch(lag(timestamp) OVER (PARTITION BY run_id ORDER BY timestamp, seq)) AS step_seconds FROM incident_events""", "incident_events"))
def incident_timeline(spark, d):
    return incidents.timeline(conversation_events(spark, d)).select("run_id", "seq", "agent", "step_seconds")


@query("approval_state", sql(f"""
SELECT run_id, arg_max(decision, (ts, seq)) FILTER (decision IS NOT NULL) AS decision, arg_max(who, (ts, seq)) FILTER (decision IS NOT NULL) AS "by",
       strftime(max(ts) FILTER (decision IS NOT NULL), {US}) AS decided_at, count(*) AS n_writes
FROM (SELECT run_id, seq, timestamp AS ts, CASE WHEN agent = 'user' THEN CASE WHEN seq % 4 < 2 THEN 'APPROVED' ELSE 'REJECTED' END END AS decision,
             CASE WHEN agent = 'user' THEN agent || CAST(seq AS VARCHAR) END AS who FROM incident_events) GROUP BY run_id""", "incident_events"))
def approval_state(spark, d):
    user = F.col("agent") == "user"
    writes = conversation_events(spark, d).select(
        "run_id", "seq", F.col("timestamp").alias("at"), F.when(user, F.when(F.col("seq") % 4 < 2, "APPROVED").otherwise("REJECTED")).alias("decision"),
        F.when(user, F.concat("agent", F.col("seq").cast("string"))).alias("by"),
    )
    return incidents.approval_state(writes).withColumn("decided_at", views.stamp("decided_at"))


@query("thread_lookup", sql("""
SELECT reply_id, i.run_id, i.service, i.severity FROM (
  SELECT conv_id * 100 + turn AS reply_id, CASE WHEN turn % 2 = 0 THEN i.message_ts ELSE i.message_ts || 'x' END AS thread_ts
  FROM conversations JOIN incidents i ON i.run_id = conv_id WHERE turn > 0) r
LEFT JOIN (SELECT message_ts, max((started_at, run_id)) AS k, arg_max(run_id, (started_at, run_id)) AS run_id, arg_max(service, (started_at, run_id)) AS service,
                  arg_max({'s': severity}, (started_at, run_id)).s AS severity FROM incidents GROUP BY message_ts) i ON i.message_ts = r.thread_ts""", "incidents"))
def thread_lookup(spark, d):
    rows = incident_rows(spark, d)
    ts = F.when(F.col("turn") % 2 == 0, F.col("message_ts")).otherwise(F.concat("message_ts", F.lit("x")))
    replies = views.table(spark, d, "conversations").where("turn > 0").join(
        rows.select(F.col("run_id").alias("conv_id"), "message_ts"), "conv_id"
    ).select((F.col("conv_id") * 100 + F.col("turn")).alias("reply_id"), ts.alias("thread_ts"))
    return incidents.thread_lookup(replies, rows).drop("thread_ts")


# --- validation ------------------------------------------------------------------------


def segment_state(spark, d, side):
    rows = views.spans(spark, d).where(side)
    table = configured_counts(with_halves(rows), views.services(spark))
    flat = views.services(spark).select("service", F.lit(25.0).alias("baseline"), "direction")
    return materialise(segments.with_ratio(segments.segment_breakdown(table, views.services(spark)), flat))


def _side_sql(side: str) -> str:
    return f"""
SELECT service, attr, value, coalesce(CASE WHEN metric <> 0 THEN round(metric / 25.0, 2) END, 0.0) AS ratio FROM (
  SELECT service, attr, value, avg(error) AS metric FROM (
    SELECT service, 'event_type' AS attr, event_type AS value, error FROM spans WHERE {side}
    UNION ALL SELECT service, 'user_bucket', user_bucket, error FROM spans WHERE {side}) GROUP BY ALL)"""


view("before_fix", "spans")(_side_sql(f"start_time < TIMESTAMP '{views.SWITCH}'"))
view("after_fix", "spans")(_side_sql(f"start_time >= TIMESTAMP '{views.SWITCH}'"))
view("compared", "before_fix", "after_fix")("""
SELECT b.service, b.attr || '=' || b.value AS segment, b.ratio AS before_ratio, a.ratio AS after_ratio, round(b.ratio - a.ratio, 2) AS improvement,
       coalesce(a.ratio < 1.2, false) AS resolved
FROM before_fix b LEFT JOIN after_fix a ON a.service = b.service AND a.attr = b.attr AND a.value = b.value WHERE b.ratio >= 1.2""")


def _compared(spark, d):
    switch = F.lit(views.SWITCH).cast("timestamp")
    before = segment_state(spark, d, F.col("start_time") < switch).where("ratio >= 1.2")
    flagged = before.select("service", F.concat(F.regexp_replace("attr", "^input.", ""), F.lit("="), "value").alias("segment"), "ratio")
    return validation.compare_segments(flagged, segment_state(spark, d, F.col("start_time") >= switch))


@query("segment_recheck", sql("SELECT * FROM compared", "compared"))
def segment_recheck(spark, d):
    return _compared(spark, d)


@query("validate_fix", sql(f"""
SELECT service, n_flagged, n_resolved, worst_after, n_spans, status, CASE WHEN status = 'FAIL' THEN 're-investigate' ELSE 'monitor' END AS next_step FROM (
  SELECT *, CASE WHEN coalesce(n_spans, 0) = 0 THEN 'NO_DATA' WHEN worst_after IS NULL THEN 'INCONCLUSIVE' WHEN worst_after < 1.2 THEN 'PASS' WHEN worst_after < 2 THEN 'INCONCLUSIVE' ELSE 'FAIL' END AS status
  FROM (SELECT service, count(*) AS n_flagged, count(*) FILTER (resolved) AS n_resolved, max(after_ratio) AS worst_after FROM compared GROUP BY service)
  LEFT JOIN (SELECT service, count(*) AS n_spans FROM spans WHERE start_time >= TIMESTAMP '{views.SWITCH}' GROUP BY service) USING (service))""", "compared", "spans"))
def validate_fix(spark, d):
    seen = views.spans(spark, d).where(F.col("start_time") >= F.lit(views.SWITCH).cast("timestamp")).groupBy("service").agg(F.count(F.lit(1)).alias("n_spans"))
    return validation.phase_one(_compared(spark, d), seen)


def polls(spark, d):
    return views.table(spark, d, "conversations").select(
        F.col("conv_id").alias("run_id"), (F.col("turn") + 1).alias("poll"), F.when(F.length("text") % 7 == 0, None).when(F.length("text") % 3 != 0, "PASS").otherwise("FAIL").alias("status")
    )


RECOVERY = """
SELECT run_id, count(*) AS n_polls, CASE WHEN min(poll) FILTER (streak >= 2) IS NOT NULL THEN 'PASS' ELSE 'FAIL' END AS status, min(poll) FILTER (streak >= 2) AS at_poll FROM (
  SELECT run_id, poll, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, island ORDER BY poll) AS streak FROM (
    SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY poll) AS island FROM (
      SELECT conv_id AS run_id, turn + 1 AS poll, length(text) % 3 <> 0 AND length(text) % 7 <> 0 AS ok FROM conversations WHERE turn + 1 <= 10))) GROUP BY run_id"""


@query("recovery_confirmed", RECOVERY)
def recovery_confirmed(spark, d):
    return validation.recovery(polls(spark, d))


@query("feed_checks", """
SELECT service, count, null_rate, round(mean, 2) AS mean, p50, p95, min, max, identity,
       (null_rate < 0.03 AND abs(mean - 45.0) <= 9.0 AND identity AND min >= 0 AND max <= 5000) AS passed
FROM (SELECT 'svc' || CAST(user_id % 3 AS VARCHAR) AS service, count(*) AS count, round(1 - count(p) / count(*)::DOUBLE, 4) AS null_rate, avg(p) AS mean,
             round(quantile_cont(p, 0.5::DOUBLE), 2) AS p50, round(quantile_cont(p, 0.95::DOUBLE), 2) AS p95, round(min(p), 2) AS min, round(max(p), 2) AS max,
             bool_and(CASE WHEN user_id % 3 = 2 THEN event_type <> 'signup' WHEN user_id % 3 = 1 THEN event_type <> 'purchase' ELSE true END) AS identity
      FROM (SELECT *, CASE WHEN user_id % 3 <> 1 OR event_type <> 'error' THEN value END AS p FROM events) GROUP BY 1)""")
def feed_checks(spark, d):
    third = F.col("user_id") % 3
    service = F.concat(F.lit("svc"), third.cast("string"))
    feed = views.table(spark, d, "events").select(
        service.alias("service"), F.when((third == 1) & (F.col("event_type") == "purchase"), None).when((third != 2) | (F.col("event_type") != "signup"), "lstm").otherwise("old").alias("family"),
        F.when((third != 1) | (F.col("event_type") != "error"), F.col("value")).alias("prediction"),
    )
    expected = views.services(spark).select("service", F.lit("lstm").alias("family"), F.lit(45.0).alias("mean"))
    return validation.feed_checks(feed, expected)


@query("incident_snapshots", sql("""
SELECT run_id, phase, count(*) AS n, count(DISTINCT request_id) AS n_requests FROM (
  SELECT i.service, i.run_id, phase, f, t FROM (SELECT 'svc' || CAST(run_id % 3 AS VARCHAR) AS service, run_id, started_at, finished_at FROM incidents) i,
       LATERAL (VALUES ('pre_drift', started_at - INTERVAL 7 DAY, started_at), ('post_fix', finished_at, finished_at + INTERVAL 24 HOUR)) v(phase, f, t)) w
JOIN spans s ON s.service = w.service AND s.start_time >= f AND s.start_time < t GROUP BY run_id, phase""", "incidents", "spans"))
def incident_snapshots(spark, d):
    rows = incident_rows(spark, d).select(F.concat(F.lit("svc"), (F.col("run_id") % 3).cast("string")).alias("service"), "run_id", F.col("started_at").alias("onset"), F.col("finished_at").alias("resolved_at"))
    found = validation.incident_snapshots(views.spans(spark, d).select("service", "start_time", "request_id"), rows, count="request_id")
    return found.select("run_id", "phase", "n", F.col("n_distinct").alias("n_requests"))


# --- trends ----------------------------------------------------------------------------


def errors(spark, d):
    return validation.joined_errors(views.predictions(spark, d), views.actuals(spark, d)).withColumnRenamed("timestamp", "time")


view("errors", "predictions", "actuals")("SELECT p.*, timestamp AS time, abs(predicted - actual) AS error FROM predictions p JOIN actuals USING (load_id)")
view("rated", "errors")("""
SELECT *, CASE WHEN mae > 2 * rolling_mae THEN 'CRITICAL' WHEN mae > 1.5 * rolling_mae THEN 'WARNING' ELSE 'HEALTHY' END AS status FROM (
  SELECT bucket, CAST(time AS DATE) AS day, count(*) AS n, avg(error) AS mae,
         avg(avg(error)) OVER (PARTITION BY bucket ORDER BY CAST(time AS DATE) ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS rolling_mae
  FROM errors GROUP BY bucket, CAST(time AS DATE))""")


@query("daily_trend_rolling", sql("""
SELECT bucket, strftime(CAST(time AS DATE), '%Y-%m-%d') AS day, count(*) AS n, round(avg(error), 1) AS mae,
       round(avg(avg(error)) OVER (PARTITION BY bucket ORDER BY CAST(time AS DATE) ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 1) AS rolling_mae
FROM errors WHERE time >= TIMESTAMP '2001-08-01' - INTERVAL 14 DAY GROUP BY bucket, CAST(time AS DATE)""", "errors"))
def daily_trend_rolling(spark, d):
    rows = trends.last_days(errors(spark, d), F.lit("2001-08-01").cast("timestamp"), 14)
    out = trends.rolling_trend(trends.daily_errors(rows, ["bucket"]), ["bucket"])
    return out.select("bucket", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", round_to("mae", 1).alias("mae"), round_to("rolling_mae", 1).alias("rolling_mae"))


def _rated(spark, d):
    return trends.rolling_trend(trends.daily_errors(errors(spark, d), ["bucket"]), ["bucket"])


@query("rolling_alert", sql("SELECT bucket, strftime(day, '%Y-%m-%d') AS day, n, status FROM rated WHERE status <> 'HEALTHY'", "rated"))
def rolling_alert(spark, d):
    return _rated(spark, d).where("status <> 'HEALTHY'").select("bucket", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "status")


view("day_volumes", "spans")("""
SELECT service, day, coalesce(n, 0) AS n FROM (
  SELECT service, unnest(generate_series(min(start_time)::DATE, (SELECT max(start_time)::DATE FROM spans), INTERVAL 1 DAY))::DATE AS day
  FROM spans WHERE NOT (service = 'svc1' AND CAST(start_time AS DATE) IN (DATE '2024-01-05', DATE '2024-01-06')) GROUP BY service)
LEFT JOIN (SELECT service, CAST(start_time AS DATE) AS day, count(*) AS n FROM spans
           WHERE NOT (service = 'svc1' AND CAST(start_time AS DATE) IN (DATE '2024-01-05', DATE '2024-01-06')) GROUP BY ALL) USING (service, day)""")


@query("day_over_day_volume", sql("""
SELECT a.service, strftime(a.day, '%Y-%m-%d') AS day, a.n, b.n AS previous, CASE WHEN a.n < 0.5 * b.n THEN 'WARNING' ELSE 'HEALTHY' END AS status
FROM day_volumes a LEFT JOIN day_volumes b ON b.service = a.service AND b.day = a.day - 1""", "day_volumes"))
def day_over_day_volume(spark, d):
    # svc1 says nothing for two days: a day without rows is a fall to 0.
    rows = views.spans(spark, d).select("service", F.col("start_time").alias("time")).where("NOT (service = 'svc1' AND to_date(time) IN (DATE '2024-01-05', DATE '2024-01-06'))")
    return trends.day_over_day(rows, ["service"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("bucket_decile", sql(f"""
SELECT bucket, len(list_filter(edges, lambda e: e < predicted)) + 1 AS decile, count(*) AS n, round(avg(error), 1) AS mae
FROM errors JOIN (SELECT bucket, quantile_cont(predicted, [{', '.join(f'{i / 10!r}::DOUBLE' for i in range(1, 10))}]) AS edges FROM errors GROUP BY bucket) USING (bucket) GROUP BY ALL""", "errors"))
def bucket_decile(spark, d):
    return trends.bucket_deciles(materialise(errors(spark, d)), "bucket", "predicted").withColumn("mae", round_to("mae", 1))


@query("drift_onset", sql("SELECT bucket, strftime(min(day), '%Y-%m-%d') AS onset FROM rated WHERE status <> 'HEALTHY' GROUP BY bucket", "rated"))
def drift_onset(spark, d):
    return trends.drift_onset(_rated(spark, d), ["bucket"]).withColumn("onset", F.date_format("onset", "yyyy-MM-dd"))


@query("phase2_actuals", sql("""
SELECT c.family, n_cells, n_held, n_deferred, psi, CASE WHEN unseen THEN 'DEFERRED' WHEN all_held AND psi < 0.15 THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT family, count(*) AS n_cells, count(*) FILTER (a <= b * 1.1) AS n_held, count(*) FILTER (a IS NULL OR b IS NULL) AS n_deferred,
             count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) = 0 AS unseen, coalesce(bool_and(a <= b * 1.1), false) AS all_held
      FROM (SELECT family, dim, avg(error) FILTER (time < TIMESTAMP '1998-01-01') AS b, avg(error) FILTER (time >= TIMESTAMP '2000-01-01') AS a
            FROM (SELECT family, time, error, 'bucket=' || bucket AS dim FROM errors UNION ALL SELECT family, time, error, 'service=' || service FROM errors) WHERE time < TIMESTAMP '1998-01-01' OR time >= TIMESTAMP '2000-01-01' GROUP BY ALL) GROUP BY family) c
JOIN (SELECT family, round(sum((n - o) * ln(n / o)), 4) AS psi FROM (
        SELECT family, CASE WHEN new = 0 THEN 0.0001 ELSE new / sum(new) OVER w END AS n, CASE WHEN old = 0 THEN 0.0001 ELSE old / sum(old) OVER w END AS o
        FROM (SELECT family, floor(predicted / 25000) AS bin, count(*) FILTER (time >= TIMESTAMP '2000-01-01')::DOUBLE AS new, count(*) FILTER (time < TIMESTAMP '1998-01-01')::DOUBLE AS old
              FROM errors WHERE time < TIMESTAMP '1998-01-01' OR time >= TIMESTAMP '2000-01-01' GROUP BY ALL) WINDOW w AS (PARTITION BY family)) GROUP BY family) p USING (family)""", "errors"))
def phase2_actuals(spark, d):
    rows = materialise(errors(spark, d))
    onset, fixed = (F.lit(day).cast("timestamp") for day in ("1998-01-01", "2000-01-01"))
    outside = rows.where((F.col("time") < onset) | (F.col("time") >= fixed))
    bins = outside.groupBy("family", F.floor(F.col("predicted") / 25000).alias("bin"), (F.col("time") >= fixed).alias("after")).agg(F.count(F.lit(1)).alias("n"))
    psi = drift.histogram_psi(bins.where(~F.col("after")), bins.where("after"), ["family"], "bin")
    return validation.phase_two(rows, onset, fixed, "family", ["bucket", "service"], psi)


# --- a score, not an error ----------------------------------------------------------------


@query("classification_quality", """
SELECT attr, value, n, round(metric, 4) AS metric, CASE WHEN metric <> 0 THEN round(0.6 / metric, 2) ELSE 0.0 END AS ratio FROM (
  SELECT attr, value, count(ok) AS n, avg(ok) AS metric FROM (
    SELECT 'input.lang' AS attr, lang AS value, CASE WHEN (n_chars > 500) = (quality = 1) THEN 1.0 ELSE 0.0 END AS ok FROM documents JOIN labels USING (doc_id)
    UNION ALL SELECT 'input.source', source, CASE WHEN (n_chars > 500) = (quality = 1) THEN 1.0 ELSE 0.0 END FROM documents JOIN labels USING (doc_id)) GROUP BY attr, value)""")
def classification_quality(spark, d):
    from spanvigil import settings as st

    ok = F.when((F.col("n_chars") > 500) == (F.col("quality") == 1), 1.0).otherwise(0.0)
    rows = views.table(spark, d, "documents").join(views.table(spark, d, "labels"), "doc_id").select(
        F.when(F.col("quality").isNotNull(), "quality").alias("service"), F.timestamp_seconds("doc_id").alias("start_time"),
        F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("inputs"), F.expr("CAST(map() AS MAP<STRING,STRING>)").alias("outputs"),
        F.create_map(F.lit("is_correct"), ok).alias("evals"), F.lit(None).cast("double").alias("latency_ms"), F.lit(None).cast("string").alias("model_version"),
    )
    service = st.services_frame(spark, [st.ServiceSettings("quality", error_attribute="eval.is_correct", direction=st.HIGHER, segments=("input.lang", "input.source"))])
    table = segments.segment_breakdown(configured_counts(with_halves(rows), service), service)
    return segments.with_ratio(table, service.withColumn("baseline", F.lit(0.6))).select("attr", "value", "n", round_to("metric", 4).alias("metric"), "ratio")
