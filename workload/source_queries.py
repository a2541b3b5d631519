"""Scans, sources, message mapping and source profiling."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from spanvigil import settings as st
from spanvigil.functions.scalars import round_to, safe_double
from spanvigil.operators import profiles
from spanvigil.operators.attributes import exploded_attributes
from spanvigil.sources import messages, spans, tables
from workload import views
from workload.oracle_base import sql, view
from workload.registry import query

FIELD_MAPS = [
    st.FieldMap("svc0", prediction="predicted_eta_minutes", actual="actual_eta_minutes", model_version="model_version", timestamp="timestamp", inputs=("shipper", "seq_len")),
    st.FieldMap("svc1", prediction="predicted_eta_minutes", actual="actual_eta_minutes", model_version="model_version", timestamp="timestamp"),
    st.FieldMap("svc2", prediction="predicted_eta_minutes", error="err", timestamp="timestamp"),
]


def message_rows(events):
    """events -> key, service, partition, offset, value (JSON); some values are cut
    short and do not parse."""
    failed = F.col("event_type") == "error"
    k = F.get_json_object("props", "$.k").cast("int")
    body = F.to_json(
        F.struct(
            F.col("event_id").alias("request_id"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
            F.col("event_type").alias("shipper"),
            k.alias("api_fetch_limit"),
            (F.col("user_id") % 50).alias("seq_len"),
            F.col("value").alias("predicted_eta_minutes"),
            F.when(F.col("event_type") != "signup", k).alias("actual_eta_minutes"),
            (F.col("user_id") % 100).alias("err"),
            F.when(F.col("user_id") % 2 == 0, "v1").otherwise("v2").alias("model_version"),
            F.when(failed, "timeout").alias("error_type"),
            F.when(F.col("user_id") % 7 != 0, F.when(F.col("user_id") % 2 == 0, "healthy").otherwise("bugged")).alias("_regime"),
            F.struct("user_id").alias("context"),
            "props",
        )
    )
    cut = (F.col("event_type") == "view") & (F.col("user_id") % 10 == 0)
    return events.select(
        F.col("event_id").alias("key"),
        F.concat(F.lit("svc"), (F.col("user_id") % 3).cast("string")).alias("service"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.when(cut, F.left(body, F.lit(30))).otherwise(body).alias("value"),
    )


view("messages")("""
SELECT event_id AS key, 'svc' || CAST(user_id % 3 AS VARCHAR) AS service, CAST(user_id % 4 AS INTEGER) AS partition, event_id AS offset,
       event_type, user_id, ts, value AS predicted, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       CASE WHEN event_type <> 'signup' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS actual,
       CASE WHEN user_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS model_version,
       (event_type = 'error') AS failed, (event_type = 'view' AND user_id % 10 = 0) AS cut,
       CASE WHEN user_id % 7 = 0 THEN 'unknown' WHEN user_id % 2 = 0 THEN 'healthy' ELSE 'bugged' END AS regime
FROM events""")


def decoded(spark, d):
    return messages.decode(message_rows(views.table(spark, d, "events")))


STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"


@query("recent_spans", sql(f"""
SELECT service, count(*) AS n, strftime(min(start_time), '%Y-%m-%d %H:%M:%S.%f') AS first_span FROM spans
WHERE start_time >= TIMESTAMP '{views.AS_OF}' - INTERVAL 10080 MINUTE GROUP BY service""", "spans"))
def recent_spans(spark, d):
    rows = spans.recent(views.spans(spark, d), views.as_of(), 10_080)
    return rows.groupBy("service").agg(F.count(F.lit(1)).alias("n"), views.stamp(F.min("start_time")).alias("first_span"))


@query("services_seen", sql("SELECT DISTINCT service FROM spans", "spans"))
def services_seen(spark, d):
    return spans.services_seen(views.spans(spark, d))


@query("flatten_attributes", sql("""
SELECT name, count(*) AS n, count(DISTINCT v) AS n_distinct FROM (
  SELECT 'input.event_type' AS name, event_type AS v FROM events
  UNION ALL SELECT 'input.user.id', CAST(user_id AS VARCHAR) FROM events
  UNION ALL SELECT 'input.user.bucket', CAST(user_id % 10 AS VARCHAR) FROM events
  UNION ALL SELECT 'eval.error', CAST(value AS VARCHAR) FROM events WHERE event_type <> 'error'
  UNION ALL SELECT 'request_id', CAST(event_id AS VARCHAR) FROM events) GROUP BY name"""))
def flatten_attributes(spark, d):
    nested = views.table(spark, d, "events").select(
        F.to_json(
            F.struct(
                F.struct("event_type", F.struct(F.col("user_id").alias("id"), (F.col("user_id") % 10).alias("bucket")).alias("user")).alias("input"),
                F.struct(F.when(F.col("event_type") != "error", F.col("value")).alias("error")).alias("eval"),
                F.col("event_id").alias("request_id"),
            )
        ).alias("attributes")
    )
    rows = spans.flatten_attributes(nested).select(F.explode("flat").alias("name", "v"))
    counted = rows.groupBy("name", "v").agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy("name").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_distinct"))


@query("source_dispatch", sql("SELECT service, count(*) AS n FROM spans GROUP BY service", "spans"))
def source_dispatch(spark, d):
    views.prepare(spark)
    found = views.event_spans(spans.read_predictions(spark, "parquet", os.path.join(d, "events.parquet")))
    missing = spans.read_predictions(spark, "parquet", os.path.join(d, "no-such-source"))
    return spans.union_spans([found, missing]).groupBy("service").agg(F.count(F.lit(1)).alias("n"))


@query("predictions_recent", sql("""
SELECT load_id, strftime(timestamp, '%Y-%m-%d') AS day, predicted, bucket FROM predictions
WHERE timestamp >= TIMESTAMP '1999-01-01' ORDER BY timestamp DESC, load_id LIMIT 1000""", "predictions"))
def predictions_recent(spark, d):
    rows = tables.newest(views.predictions(spark, d), "timestamp", F.lit("1999-01-01").cast("timestamp"), 1000, "load_id")
    return rows.select("load_id", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "predicted", "bucket")


@query("actuals_for_keys", sql("""
SELECT load_id, round(actual, 1) AS actual, strftime(delivered_at, '%Y-%m-%d') AS day FROM actuals
WHERE load_id IN (SELECT load_id FROM predictions WHERE bucket = '1-URGENT') AND delivered_at >= TIMESTAMP '1996-01-01'
ORDER BY delivered_at DESC, load_id LIMIT 1000""", "actuals", "predictions"))
def actuals_for_keys(spark, d):
    keys = views.predictions(spark, d).where("bucket = '1-URGENT'")
    rows = tables.actuals_for(views.actuals(spark, d), keys, F.lit("1996-01-01").cast("timestamp"), 1000)
    return rows.select("load_id", round_to("actual", 1).alias("actual"), F.date_format("delivered_at", "yyyy-MM-dd").alias("day"))


@query("table_replay", sql("""
SELECT CAST(load_id AS VARCHAR) AS request_id, bucket AS shipper, predicted AS prediction, 'OK' AS status_code, 'unknown' AS regime,
       strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS start_time
FROM predictions WHERE timestamp >= TIMESTAMP '2001-08-01' - INTERVAL 10080 MINUTE""", "predictions"))
def table_replay(spark, d):
    rows = views.predictions(spark, d).select(
        F.col("load_id").alias("request_id"), "timestamp", F.col("bucket").alias("shipper"),
        F.col("predicted").alias("predicted_eta_minutes"),
    )
    replayed = tables.replay(rows, "timestamp", F.lit("2001-08-01").cast("timestamp"), 10_080)
    return replayed.select(
        "request_id", F.try_element_at("inputs", F.lit("shipper")).alias("shipper"),
        safe_double(F.try_element_at("outputs", F.lit("prediction"))).alias("prediction"),
        "status_code", "regime", views.stamp("start_time").alias("start_time"),
    )


@query("tap_default", sql(f"""
SELECT CAST(key AS VARCHAR) AS request_id, model_version, {STAMP} AS start_time, CASE WHEN failed THEN 'ERROR' ELSE 'OK' END AS status_code,
       CASE WHEN failed THEN 'timeout' END AS error_type, event_type AS shipper, CAST(k AS VARCHAR) AS api_fetch_limit, 3 AS n_inputs,
       CASE WHEN NOT failed THEN predicted END AS prediction, CASE WHEN NOT failed THEN actual::DOUBLE END AS actual,
       CASE WHEN NOT failed THEN round(abs(predicted - actual), 4) END AS error, CASE WHEN failed THEN 'failed' ELSE regime END AS regime
FROM messages WHERE NOT cut""", "messages"))
def tap_default(spark, d):
    at = lambda m, k: F.try_element_at(m, F.lit(k))
    return messages.map_default(decoded(spark, d)).select(
        "request_id", "model_version", views.stamp("start_time").alias("start_time"), "status_code", "error_type",
        at("inputs", "shipper").alias("shipper"), at("inputs", "api_fetch_limit").alias("api_fetch_limit"),
        F.size("inputs").alias("n_inputs"), safe_double(at("outputs", "prediction")).alias("prediction"),
        F.col("ground_truth").alias("actual"), round_to(at("evals", messages.DEFAULT_ERROR), 4).alias("error"), "regime",
    )


@query("tap_mapped", sql(f"""
SELECT service, key, {STAMP} AS start_time,
       CASE service WHEN 'svc0' THEN 'seq_len,shipper'
            WHEN 'svc1' THEN 'api_fetch_limit,err,' || CASE WHEN failed THEN 'error_type,' ELSE '' END || 'props,request_id,seq_len,shipper'
            ELSE CASE WHEN actual IS NOT NULL THEN 'actual_eta_minutes,' ELSE '' END || 'api_fetch_limit,' || CASE WHEN failed THEN 'error_type,' ELSE '' END || 'model_version,props,request_id,seq_len,shipper' END AS input_names,
       predicted AS prediction, CASE WHEN service <> 'svc2' THEN actual::DOUBLE END AS actual,
       CASE WHEN service = 'svc2' THEN user_id % 100 ELSE round(abs(predicted - actual), 4) END::DOUBLE AS error,
       CASE WHEN service <> 'svc2' THEN model_version END AS model_version
FROM messages WHERE NOT cut""", "messages"))
def tap_mapped(spark, d):
    maps = st.field_maps_frame(spark, FIELD_MAPS)
    return messages.map_configured(decoded(spark, d), maps).select(
        "service", "key", views.stamp("start_time").alias("start_time"),
        F.array_join(F.array_sort(F.map_keys("inputs")), ",").alias("input_names"),
        safe_double(F.try_element_at("outputs", F.lit("prediction"))).alias("prediction"),
        safe_double(F.col("ground_truth")).alias("actual"),
        round_to(F.try_element_at("evals", F.lit("error")), 4).alias("error"),
        "model_version",
    )


@query("tap_counts", sql("""
SELECT CASE WHEN failed THEN 'failed' ELSE regime END AS regime, count(*) AS n FROM messages WHERE NOT cut GROUP BY 1""", "messages"))
def tap_counts(spark, d):
    return messages.regime_counts(messages.map_default(decoded(spark, d)))


@query("peek_latest", sql("""
SELECT partition, "offset", shipper FROM (
  SELECT partition, "offset", event_type AS shipper, cut FROM (
    SELECT *, row_number() OVER (PARTITION BY partition ORDER BY "offset" DESC) AS place FROM messages)
  WHERE place <= greatest(1, 10 // (SELECT count(DISTINCT partition) FROM messages) + 1) ORDER BY place, partition LIMIT 10)
WHERE NOT cut""", "messages"))
def peek_latest(spark, d):
    rows = messages.decode(messages.peek_latest(message_rows(views.table(spark, d, "events")), 10))
    return rows.select("partition", "offset", messages.field("shipper").alias("shipper"))


def scoring(spark, d):
    """events under the column names of a scoring log."""
    return views.table(spark, d, "events").select(
        F.col("event_id").alias("request_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("region"),
        F.col("value").alias("predicted_eta"), F.get_json_object("props", "$.k").alias("label"),
        F.abs(F.col("value") - F.get_json_object("props", "$.k").cast("double")).alias("abs_error_minutes"),
        F.when(F.col("user_id") % 2 == 0, "v1").otherwise("v2").alias("model_version"), (F.col("user_id") % 3 == 0).alias("priority"),
    )


def summaries(spark, d):
    named = {"events": views.table(spark, d, "events"), "orders": views.table(spark, d, "orders"), "scoring": scoring(spark, d)}
    out = None
    for source, frame in named.items():
        one = profiles.field_summary(frame, source)
        out = one if out is None else out.unionByName(one)
    return out


def _summary_sql(source: str, relation: str, columns: list[str], bools: tuple[str, ...] = ()) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{source}' AS source, {i} AS position, '{c}' AS name,
       CASE WHEN count({c}) = 0 THEN 'other' WHEN {'true' if c in bools else 'false'} THEN 'bool'
            WHEN count(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) / count({c})::DOUBLE > 0.8 THEN 'numeric' ELSE 'categorical' END AS kind,
       count(DISTINCT {c}) AS n_distinct, count(*) AS n_sampled FROM {relation}"""
        for i, c in enumerate(columns, 1)
    )


view("scoring")("""
SELECT event_id AS request_id, ts AS created_at, event_type AS region, value AS predicted_eta, json_extract_string(props, '$.k') AS label,
       abs(value - CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS abs_error_minutes,
       CASE WHEN user_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS model_version, (user_id % 3 = 0) AS priority FROM events""")
view("summaries", "scoring")(
    _summary_sql("events", "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    + "\nUNION ALL\n" + _summary_sql("orders", "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    + "\nUNION ALL\n" + _summary_sql("scoring", "scoring", ["request_id", "created_at", "region", "predicted_eta", "label", "abs_error_minutes", "model_version", "priority"], ("priority",))
)


@query("field_summary", sql("SELECT * FROM summaries", "summaries"))
def field_summary(spark, d):
    return summaries(spark, d).drop("sample")


def _role_steps() -> str:
    """The roles one after the other, each over what the former left unused."""
    step = "SELECT source, max(n_sampled) AS n, list({'position': position, 'name': name, 'kind': kind, 'd': n_distinct} ORDER BY position) AS f, []::VARCHAR[] AS used FROM summaries GROUP BY source"
    for role, pattern in profiles.ROLE_PATTERNS.items():
        numeric = " AND x.kind = 'numeric'" if role in profiles.NUMERIC_ROLES else ""
        picked = f"list_filter(f, lambda x: regexp_matches(x.name, '{pattern}', 'i'){numeric} AND NOT list_contains(used, x.name))[1].name"
        step = f"SELECT * EXCLUDE (used), CASE WHEN {role} IS NULL THEN used ELSE list_append(used, {role}) END AS used FROM (SELECT *, {picked} AS {role} FROM ({step}))"
    return step


@query("field_roles", sql(f"""
SELECT source, {', '.join(profiles.ROLE_PATTERNS)}, array_to_string(segments, ',') AS segments,
       array_to_string(list_concat(segments, list_transform(list_filter(f, lambda x: NOT list_contains(used, x.name) AND NOT list_contains(segments, x.name)
         AND x.kind <> 'other' AND NOT regexp_matches(x.name, '{profiles.ROLE_PATTERNS["timestamp"]}', 'i')), lambda x: x.name)), ',') AS inputs
FROM (SELECT *, list_transform(list_filter(f, lambda x: NOT list_contains(used, x.name) AND x.kind = 'categorical' AND x.d > 1 AND x.d <= greatest(50, n // 5)), lambda x: x.name) AS segments
      FROM ({_role_steps()}))""", "summaries"))
def field_roles(spark, d):
    roles = profiles.field_roles(summaries(spark, d))
    return roles.select(
        "source", *profiles.ROLE_PATTERNS, F.array_join("segments", ",").alias("segments"), F.array_join("inputs", ",").alias("inputs")
    )


# --- table rows as spans ---------------------------------------------------------------


ORDER_ROLES = {"prediction": "o_totalprice", "timestamp": "o_orderdate", "request_id": "o_orderkey"}


@query("order_spans", """
SELECT service, attr, count(*) AS n, count(DISTINCT value) AS n_values FROM (
  SELECT 'shop' || (o_custkey % 3) AS service, unnest([
    {'attr': 'input.o_custkey', 'value': CAST(o_custkey AS VARCHAR)}, {'attr': 'input.o_orderstatus', 'value': o_orderstatus},
    {'attr': 'input.o_orderpriority', 'value': o_orderpriority}, {'attr': 'output.prediction', 'value': CAST(o_totalprice AS VARCHAR)}], recursive := true)
  FROM orders) GROUP BY ALL""")
def order_spans(spark, d):
    """Warehouse rows as monitored spans: every column without a role is a feature."""
    rows = views.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")
    service = F.concat(F.lit("shop"), (F.col("o_custkey") % 3).cast("string"))
    counted = exploded_attributes(spans.spans_from_rows(rows, ORDER_ROLES, service), "service").groupBy("service", "attr", "value").agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy("service", "attr").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_values"))
