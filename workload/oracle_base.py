"""Shared SQL views for the DuckDB oracles, composed as CTEs on demand."""

from __future__ import annotations

from spanvigil.operators.drift import bin_fractions
from workload.views import AS_OF, LOOKBACK, SERVICES, SPECS, SWITCH

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, *needs: str):
    def register(sql: str) -> None:
        VIEWS[name] = (needs, sql)

    return register


def sql(final: str, *needs: str) -> str:
    """The final SELECT with every view it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in VIEWS[name][0]:
            visit(other)
        ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return final
    return "WITH " + ",\n".join(f"{n} AS (\n{VIEWS[n][1]}\n)" for n in ordered) + "\n" + final


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def number(value: float | None) -> str:
    return "NULL::DOUBLE" if value is None else f"{value!r}::DOUBLE"


def doubles(values) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


def values(rows, columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(r) + ')' for r in rows)}) t({columns})"


view("services")(
    values(
        [
            (text(s.service), str(s.lookback_minutes), number(s.explicit_baseline), number(s.configured_baseline), text(",".join(s.disabled_checks)))
            for s in SERVICES
        ],
        "service, lookback_minutes, explicit_baseline, configured_baseline, disabled",
    )
)
view("attribute_baselines")(
    values(
        [(text(s.service), text(a), text(v)) for s in SERVICES for a, v in s.attribute_baselines.items()],
        "service, attribute, expected",
    )
)
view("specs")(
    values(
        [
            (text(m.service), text(m.name), text(m.attribute), text(m.agg), text(m.direction), number(m.baseline), number(m.warn_ratio), number(m.critical_ratio), text(m.segment_by), text(m.baseline_scale))
            for m in SPECS
        ],
        "service, name, attribute, agg, direction, spec_baseline, warn_ratio, critical_ratio, segment_by, baseline_scale",
    )
)

view("spans")(f"""
SELECT CASE WHEN user_id % 3 = 2 AND ts >= TIMESTAMP '{SWITCH}' AND event_type <> 'error' THEN 'svc3'
            ELSE 'svc' || CAST(user_id % 3 AS VARCHAR) END AS service,
       ts AS start_time,
       CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status_code,
       CAST(event_id AS VARCHAR) AS request_id,
       CASE WHEN ts >= TIMESTAMP '{SWITCH}' THEN 'v2' ELSE 'v1' END AS model_version,
       event_type,
       json_extract_string(props, '$.k') AS k,
       CAST(user_id % 10 AS VARCHAR) AS user_bucket,
       CASE WHEN ts >= TIMESTAMP '{SWITCH}' AND event_type IN ('click', 'view') THEN 'app' ELSE 'web' END AS channel,
       CASE WHEN ts < TIMESTAMP '{SWITCH}' THEN event_type END AS legacy,
       value * CASE WHEN ts >= TIMESTAMP '{SWITCH}' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS amount,
       value AS prediction,
       CASE WHEN event_type <> 'error' THEN abs(value - CAST(json_extract_string(props, '$.k') AS DOUBLE)) END AS error,
       value * CASE WHEN ts >= TIMESTAMP '{SWITCH}' AND user_id % 3 = 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS latency_ms
FROM events""")

view("spans_hit", "spans")(
    "SELECT *, CASE WHEN error < 25 THEN 1.0::DOUBLE WHEN error >= 25 THEN 0.0::DOUBLE END AS hit FROM spans"
)

view("bounds", "spans_hit")("""
SELECT service, min(epoch_us(start_time)) AS lo, max(epoch_us(start_time)) AS hi, count(start_time) AS timed
FROM spans_hit GROUP BY service""")

view("split", "spans_hit", "bounds")("""
SELECT s.*, CASE WHEN timed >= 4 AND hi > lo THEN
              CASE WHEN 2 * epoch_us(start_time) <= lo + hi THEN 'earlier' ELSE 'recent' END END AS half
FROM spans_hit s JOIN bounds USING (service)""")

view("long", "split")(
    "\nUNION ALL\n".join(
        f"SELECT service, half, '{attr}' AS attr, {value} AS value, TRY_CAST({value} AS DOUBLE) AS x FROM split WHERE {column} IS NOT NULL"
        for attr, value, column in [
            ("input.event_type", "event_type", "event_type"),
            ("input.k", "k", "k"),
            ("input.user_bucket", "user_bucket", "user_bucket"),
            ("input.channel", "channel", "channel"),
            ("input.legacy", "legacy", "legacy"),
            ("input.amount", "CAST(amount AS VARCHAR)", "amount"),
            ("output.prediction", "CAST(prediction AS VARCHAR)", "prediction"),
            ("eval.error", "''", "error"),
            ("eval.hit", "''", "hit"),
        ]
    )
)

view("half_totals", "long")("""
SELECT service, attr,
       count(*) FILTER (half = 'earlier') AS earlier, count(*) FILTER (half = 'recent') AS recent,
       count(x) FILTER (half = 'earlier') AS earlier_numeric, count(x) FILTER (half = 'recent') AS recent_numeric
FROM long GROUP BY service, attr""")

view("kinds", "half_totals")("""
SELECT *, CASE WHEN earlier = 0 OR recent = 0 THEN 'empty'
               WHEN earlier_numeric / earlier > 0.8 AND recent_numeric / recent > 0.8 THEN 'numeric'
               ELSE 'categorical' END AS kind
FROM half_totals WHERE attr NOT LIKE 'eval.%'""")

_FLOORED = "(greatest(r, 0.0001) - greatest(e, 0.0001)) * ln(greatest(r, 0.0001) / greatest(e, 0.0001))"

view("psi_categorical", "long", "kinds")(f"""
SELECT service, attr, 'categorical' AS kind, round(abs(sum({_FLOORED})), 3) AS psi
FROM (SELECT service, attr, value,
             count(*) FILTER (half = 'recent') / any_value(recent)::DOUBLE AS r,
             count(*) FILTER (half = 'earlier') / any_value(earlier)::DOUBLE AS e
      FROM long JOIN kinds USING (service, attr) WHERE kind = 'categorical' AND half IS NOT NULL
      GROUP BY service, attr, value)
GROUP BY service, attr""")

_BY_Q = " ".join(
    f"WHEN {q} THEN quantile_cont(x, {doubles(bin_fractions(q))})" for q in range(2, 11)
)

view("edges", "long", "kinds")(f"""
SELECT service, attr, CASE least(10, count(DISTINCT x)) {_BY_Q} END AS qs
FROM long JOIN kinds USING (service, attr)
WHERE kind = 'numeric' AND half = 'earlier' AND x IS NOT NULL
GROUP BY service, attr""")

view("psi_numeric", "long", "kinds", "edges")(f"""
SELECT k.service, k.attr, 'numeric' AS kind, coalesce(psi, 0.0) AS psi
FROM kinds k LEFT JOIN (
  SELECT service, attr, round(abs(sum({_FLOORED})), 3) AS psi
  FROM (SELECT service, attr, bin,
               count(*) FILTER (half = 'recent') / any_value(recent_numeric)::DOUBLE AS r,
               count(*) FILTER (half = 'earlier') / any_value(earlier_numeric)::DOUBLE AS e
        FROM (SELECT l.service, l.attr, half, recent_numeric, earlier_numeric,
                     len(list_distinct(list_filter(qs, lambda q: q > qs[1] AND q < qs[len(qs)] AND q < x))) AS bin
              FROM long l JOIN edges USING (service, attr) JOIN kinds USING (service, attr)
              WHERE x IS NOT NULL AND half IS NOT NULL AND qs IS NOT NULL)
        GROUP BY service, attr, bin)
  GROUP BY service, attr) s USING (service, attr)
WHERE k.kind = 'numeric'""")

view("psi_two", "kinds", "psi_categorical", "psi_numeric")("""
SELECT service, attr, kinds.kind AS kind, coalesce(c.psi, n.psi, 0.0) AS psi
FROM kinds LEFT JOIN psi_categorical c USING (service, attr) LEFT JOIN psi_numeric n USING (service, attr)""")

view("psi_single", "long", "attribute_baselines")("""
SELECT service, attr, expected, sum(n)::BIGINT AS n_observed, count(*) AS n_distinct,
       round(sum((greatest(n / t, 0.0001) - CASE WHEN value = expected THEN 1.0 ELSE 0.0001 END)
             * ln(greatest(n / t, 0.0001) / CASE WHEN value = expected THEN 1.0 ELSE 0.0001 END)), 4) AS psi
FROM (SELECT service, attr, value, any_value(expected) AS expected, count(*)::DOUBLE AS n,
             sum(count(*)) OVER (PARTITION BY service, attr)::DOUBLE AS t
      FROM long JOIN (SELECT service, 'input.' || attribute AS attr, expected FROM attribute_baselines) USING (service, attr)
      GROUP BY service, attr, value)
GROUP BY service, attr, expected""")

view("psi_banded", "psi_single")("""
SELECT *, CASE WHEN psi >= 0.25 THEN 'critical' WHEN psi >= 0.1 THEN 'warning' ELSE 'healthy' END AS band
FROM psi_single""")

view("profile", "split")("""
SELECT service, count(*) AS n_spans, count(*) FILTER (half = 'earlier') AS n_earlier,
       count(*) FILTER (half = 'recent') AS n_recent,
       count(*) FILTER (status_code = 'ERROR') AS n_errored, count(*) FILTER (error IS NULL) AS n_missing,
       max(start_time) AS last_span,
       quantile_cont(latency_ms, 0.95::DOUBLE) FILTER (half = 'earlier') AS p95_earlier,
       quantile_cont(latency_ms, 0.95::DOUBLE) FILTER (half = 'recent') AS p95_recent
FROM split GROUP BY service""")

view("vanished", "half_totals", "profile")("""
SELECT service, min(attr) AS vanished FROM half_totals JOIN profile USING (service)
WHERE n_recent > 0 AND recent = 0 AND earlier > 0.5 * n_earlier GROUP BY service""")

view("worst_input", "psi_two")("""
SELECT service, arg_min(attr, (-psi, attr)) AS drift_attr, max(psi) AS drift_psi
FROM psi_two WHERE attr LIKE 'input.%' AND psi > 0 GROUP BY service""")

view("first_output", "psi_two")("""
SELECT service, min(attr) AS out_attr, arg_min(psi, attr) AS out_psi FROM psi_two WHERE attr LIKE 'output.%' GROUP BY service""")

_DRIFT = """CASE WHEN {p} >= 0.25 THEN 'CRITICAL' WHEN {p} >= 0.1 THEN 'WARNING' ELSE 'HEALTHY' END,
       CASE WHEN {p} >= 0.25 THEN least(1.0, {p} / 0.5) WHEN {p} >= 0.1 THEN least(0.6, {p} / 0.5) ELSE 0.0 END"""

view("battery", "profile", "services", "vanished", "worst_input", "first_output")(f"""
SELECT service, 1 AS position, 'volume_drop' AS "check",
       CASE WHEN n_recent / n_earlier::DOUBLE <= 1 - 0.7::DOUBLE THEN 'CRITICAL' WHEN n_recent / n_earlier::DOUBLE <= 1 - 0.4::DOUBLE THEN 'WARNING' ELSE 'HEALTHY' END AS status,
       CASE WHEN n_recent / n_earlier::DOUBLE <= 1 - 0.7::DOUBLE THEN 0.85 ELSE 0.5 END AS severity,
       round(n_recent / n_earlier::DOUBLE, 2) AS current_value
FROM profile WHERE n_recent > 0 AND n_earlier >= 2
UNION ALL
SELECT service, 2, 'silence',
       CASE WHEN (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_span)) / 60e6::DOUBLE >= lookback_minutes * 0.5::DOUBLE THEN 'WARNING' ELSE 'HEALTHY' END,
       0.55, round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_span)) / 60e6::DOUBLE, 1)
FROM profile JOIN services USING (service)
UNION ALL
SELECT service, 3, 'error_rate',
       CASE WHEN n_errored / n_spans::DOUBLE >= 0.2 THEN 'CRITICAL' WHEN n_errored / n_spans::DOUBLE >= 0.05 THEN 'WARNING' ELSE 'HEALTHY' END,
       CASE WHEN n_errored / n_spans::DOUBLE >= 0.2 THEN least(1.0, 2 * n_errored / n_spans::DOUBLE) ELSE 0.5 END,
       round(n_errored / n_spans::DOUBLE, 3)
FROM profile
UNION ALL
SELECT service, 4, 'latency_drift',
       CASE WHEN p95_recent / p95_earlier >= 2.0 THEN 'CRITICAL' WHEN p95_recent / p95_earlier >= 1.5 THEN 'WARNING' ELSE 'HEALTHY' END,
       CASE WHEN p95_recent / p95_earlier >= 2.0 THEN least(1.0, p95_recent / p95_earlier / 4) ELSE 0.5 END,
       round(p95_recent / p95_earlier, 2)
FROM profile WHERE p95_earlier > 0 AND p95_recent IS NOT NULL
UNION ALL
SELECT service, 5, 'null_rate',
       CASE WHEN n_missing > 0 AND n_missing < n_spans AND n_missing / n_spans::DOUBLE >= 0.2 THEN 'WARNING' ELSE 'HEALTHY' END,
       0.45, round(n_missing / n_spans::DOUBLE, 3)
FROM profile
UNION ALL
SELECT service, 6, 'input_drift_auto', {_DRIFT.format(p="drift_psi")}, drift_psi FROM worst_input
UNION ALL
SELECT service, 7, 'output_drift', {_DRIFT.format(p="out_psi")}, out_psi FROM first_output
UNION ALL
SELECT service, 8, 'schema_drift', 'WARNING', 0.5, 0.0 FROM vanished""")

view("live_version", "spans")("""
SELECT service, arg_min(model_version, (-n, model_version)) AS model_version
FROM (SELECT service, model_version, count(*) AS n FROM spans GROUP BY ALL) GROUP BY service""")

view("signals", "battery", "services", "live_version", "resolved")("""
SELECT b.service, position, "check", status, CAST(severity AS DOUBLE) AS severity, CAST(current_value AS DOUBLE) AS current_value
FROM battery b JOIN services s USING (service)
WHERE status <> 'HEALTHY' AND NOT list_contains(string_split(disabled, ','), "check")
UNION ALL
SELECT service, 9, 'baseline_stale', 'WARNING', 0.5, NULL
FROM live_version JOIN resolved USING (service) WHERE trim(model_version) <> trim(baseline_version)""")

view("metric_rows", "split", "specs")("""
SELECT service, name, agg, half,
       CASE WHEN segment_by IS NULL THEN '' WHEN segment_by = 'input.channel' THEN channel END AS segment,
       CASE attribute WHEN 'eval.error' THEN error WHEN 'eval.hit' THEN hit WHEN 'latency_ms' THEN latency_ms
                      WHEN 'input.amount' THEN amount END AS x
FROM split JOIN specs USING (service)""")


def _aggregate(condition: str) -> str:
    f = f"FILTER ({condition})"
    return f"""CASE agg WHEN 'count' THEN nullif(count(*) {f}, 0)::DOUBLE
       WHEN 'null_rate' THEN (count(*) {f} - count(x) {f}) / nullif(count(*) {f}, 0)::DOUBLE
       WHEN 'rate' THEN avg(CASE WHEN x <> 0 THEN 1.0 WHEN x = 0 THEN 0.0 END) {f}
       WHEN 'sum' THEN sum(x) {f}
       WHEN 'p50' THEN quantile_cont(x, 0.5::DOUBLE) {f}
       WHEN 'p95' THEN quantile_cont(x, 0.95::DOUBLE) {f}
       WHEN 'p99' THEN quantile_cont(x, 0.99::DOUBLE) {f}
       ELSE avg(x) {f} END"""


view("metric_values", "metric_rows")(f"""
SELECT service, name, agg, segment, {_aggregate("true")} AS value, {_aggregate("half = 'earlier'")} AS earlier_value
FROM metric_rows WHERE segment IS NOT NULL GROUP BY service, name, agg, segment
HAVING count(x) > 0 OR agg = 'count'""")

view("metrics", "metric_values", "specs")("""
SELECT service, name, agg, segment, round(value, 3) AS value, round(base, 3) AS baseline, ratio, status,
       round(CASE status WHEN 'CRITICAL' THEN least(1.0, ratio / (2 * critical_ratio))
                         WHEN 'WARNING' THEN least(0.6, ratio / (2 * critical_ratio)) ELSE 0.0 END, 2) AS severity
FROM (SELECT *, CASE WHEN ratio >= critical_ratio THEN 'CRITICAL' WHEN ratio >= warn_ratio THEN 'WARNING' ELSE 'HEALTHY' END AS status
      FROM (SELECT *, CASE WHEN base IS NULL THEN NULL WHEN base = 0 OR value = 0 THEN 0.0
                           WHEN direction = 'higher_is_better' THEN round(base / value, 2) ELSE round(value / base, 2) END AS ratio
            FROM (SELECT m.service, m.name, m.agg, segment, value, direction, warn_ratio, critical_ratio,
                         coalesce(spec_baseline, CASE WHEN baseline_scale = 'rate' AND m.agg IN ('count', 'sum') THEN 2 * earlier_value ELSE earlier_value END) AS base
                  FROM metric_values m JOIN specs s ON m.service = s.service AND m.name = s.name
                  WHERE value IS NOT NULL)))""")

view("headline", "spans")("""
SELECT service, count(*) AS n_spans, count(error) AS n_errors, avg(error) AS metric FROM spans GROUP BY service""")

view("segment_rows", "spans")("""
SELECT service, 'input.event_type' AS attr, event_type AS value, error FROM spans
UNION ALL SELECT service, 'input.user_bucket', user_bucket, error FROM spans""")

view("segments", "segment_rows")("""
SELECT service, attr, value, count(error) AS n, avg(error) AS metric FROM segment_rows GROUP BY service, attr, value""")

# Stand-ins for stored artifacts, derived from the first days of the data.
view("training", "spans")("""
SELECT service, version AS model_version, trained_at, mae FROM (
  SELECT service, 'v1' AS version, '2024-01-08' AS trained_at, round(avg(error), 4) AS mae
  FROM spans WHERE start_time < TIMESTAMP '2024-01-08' GROUP BY service) WHERE service IN ('svc0', 'svc1')""")

view("training_values", "spans")("""
SELECT service, attribute, value, count(*) / sum(count(*)) OVER (PARTITION BY service, attribute)::DOUBLE AS share
FROM (SELECT service, 'channel' AS attribute, channel AS value FROM spans WHERE start_time < TIMESTAMP '2024-01-08'
      UNION ALL SELECT service, 'event_type', event_type FROM spans WHERE start_time < TIMESTAMP '2024-01-08')
WHERE service IN ('svc0', 'svc1') GROUP BY service, attribute, value""")

view("calibrated", "spans")("""
SELECT service, '2024-01-12' AS generated_at, round(avg(error), 2) AS metric,
       arg_min(model_version, model_version) AS model_version
FROM spans WHERE start_time < TIMESTAMP '2024-01-12' AND service = 'svc2' GROUP BY service""")

view("actuals")("""
SELECT l_orderkey AS load_id, sum(l_extendedprice * (1 - l_discount)) AS actual, max(l_shipdate) AS delivered_at
FROM lineitem GROUP BY l_orderkey""")

view("predictions")("""
SELECT o_orderkey AS load_id, o_orderdate AS timestamp, o_totalprice AS predicted, o_orderpriority AS bucket,
       o_orderstatus AS family, 'svc' || CAST(o_custkey % 4 AS VARCHAR) AS service
FROM orders""")

ORDERS_AS_OF = "2001-08-01 00:00:00"

view("rolling", "predictions", "actuals")(f"""
SELECT service, avg(abs(predicted - actual)) AS mae, count(*) AS n,
       coalesce(avg(abs(predicted - actual)) >= 10.0, false) AS usable
FROM predictions JOIN actuals USING (load_id)
WHERE timestamp >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 7 DAY GROUP BY service""")

view("resolved", "services", "training", "training_values", "calibrated", "rolling", "attribute_baselines")("""
SELECT s.service,
       coalesce(s.explicit_baseline, t.mae, c.metric, r.mae, s.configured_baseline, 150.0) AS baseline,
       CASE WHEN s.explicit_baseline IS NOT NULL THEN 'explicit' WHEN t.mae IS NOT NULL THEN 'training@' || t.model_version
            WHEN c.metric IS NOT NULL THEN 'calibration@' || c.generated_at WHEN r.mae IS NOT NULL THEN 'rolling:7d'
            WHEN s.configured_baseline IS NOT NULL THEN 'configured' ELSE 'default' END AS baseline_source,
       coalesce(c.model_version, t.model_version) AS baseline_version
FROM services s LEFT JOIN training t USING (service) LEFT JOIN calibrated c USING (service)
LEFT JOIN (SELECT * FROM rolling WHERE usable) r USING (service)""")

view("modal_training", "training_values")("""
SELECT service, attribute, arg_min(value, (-share, value)) AS expected FROM training_values GROUP BY service, attribute""")

view("resolved_expected", "modal_training", "attribute_baselines")("""
SELECT * FROM modal_training
UNION ALL SELECT * FROM attribute_baselines WHERE service NOT IN (SELECT service FROM modal_training)""")

view("psi_resolved", "long", "resolved_expected")(
    VIEWS["psi_single"][1].replace("attribute_baselines", "resolved_expected")
)

view("segment_ratios", "segments", "resolved")("""
SELECT service, attr, value, n, metric, baseline,
       coalesce(CASE WHEN metric <> 0 AND baseline <> 0 THEN round(metric / baseline, 2) END, 0.0) AS ratio
FROM segments JOIN resolved USING (service)""")

view("facts", "services", "resolved", "headline", "segment_ratios", "psi_resolved")("""
SELECT s.service, s.lookback_minutes, baseline, baseline_source, coalesce(n_spans, 0) AS n_spans, metric,
       CASE WHEN metric IS NOT NULL THEN coalesce(CASE WHEN metric <> 0 AND baseline <> 0 THEN round(metric / baseline, 2) END, 0.0) END AS overall_ratio,
       segment_ratio, coalesce(n_bad, 0) AS n_bad_segments, coalesce(worst, 0.0) AS worst_psi
FROM services s JOIN resolved USING (service) LEFT JOIN headline USING (service)
LEFT JOIN (SELECT service, max(ratio) AS segment_ratio, count(*) FILTER (ratio >= 1.2) AS n_bad FROM segment_ratios GROUP BY service) USING (service)
LEFT JOIN (SELECT service, max(psi) AS worst FROM psi_resolved GROUP BY service) USING (service)""")

view("decided", "facts")("""
SELECT *, CASE WHEN n_spans = 0 THEN CASE WHEN lookback_minutes >= 60 THEN 'CRITICAL' ELSE 'WARNING' END
               WHEN m IS NULL THEN 'WARNING' WHEN m >= 2.0 OR worst_psi >= 0.25 THEN 'CRITICAL'
               WHEN m >= 1.2 OR worst_psi >= 0.1 THEN 'WARNING' ELSE 'HEALTHY' END AS base_status,
          CASE WHEN n_spans = 0 THEN CASE WHEN lookback_minutes >= 60 THEN 0.85 ELSE 0.5 END
               WHEN m IS NULL THEN 0.4
               WHEN m >= 2.0 OR worst_psi >= 0.25 THEN round(greatest(least(1.0, m / 5.0), least(1.0, worst_psi / 0.5)), 2)
               WHEN m >= 1.2 OR worst_psi >= 0.1 THEN round(greatest(least(0.6, m / 4.0), least(0.6, worst_psi / 0.4)), 2)
               ELSE 0.0 END AS base_severity
FROM (SELECT *, greatest(overall_ratio, coalesce(segment_ratio, overall_ratio)) AS m FROM facts)""")

view("raised", "signals", "metrics")("""
SELECT service, position, "check", status, severity FROM signals
UNION ALL SELECT service, 100, CASE WHEN segment = '' THEN name ELSE name || '[' || segment || ']' END, status, severity FROM metrics""")

view("worst_signal", "raised")("""
SELECT service, max(CASE status WHEN 'CRITICAL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) AS rank,
       count(*) FILTER (status <> 'HEALTHY') AS n_signals,
       arg_min("check", (-severity, position, "check")) AS worst_check, max(severity) AS worst_severity
FROM raised GROUP BY service""")

view("snapshot", "decided", "worst_signal")("""
SELECT service, n_spans, round(metric, 1) AS metric_value, round(baseline, 4) AS baseline, baseline_source, overall_ratio, n_bad_segments,
       worst_psi, coalesce(n_signals, 0) AS n_signals,
       CASE WHEN higher THEN CASE rank WHEN 2 THEN 'CRITICAL' ELSE 'WARNING' END ELSE base_status END AS status,
       CAST(CASE WHEN higher THEN greatest(base_severity, round(worst_severity, 2)) ELSE base_severity END AS DOUBLE) AS severity,
       CASE WHEN higher THEN CASE rank WHEN 2 THEN 'ALERT_HUMAN' ELSE 'INVESTIGATE' END
            WHEN n_spans = 0 THEN 'ALERT_HUMAN' WHEN m IS NULL THEN 'INVESTIGATE'
            WHEN base_status = 'CRITICAL' THEN 'ALERT_HUMAN' WHEN base_status = 'WARNING' THEN 'INVESTIGATE' ELSE 'MONITOR' END AS action
FROM (SELECT *, coalesce(rank, 0) > CASE base_status WHEN 'CRITICAL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END AS higher
      FROM decided LEFT JOIN worst_signal USING (service))""")
