"""Stored documents and artifacts, written from the given tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanvigil.functions.scalars import is_table_identifier, round_to
from spanvigil.operators import baselines as bl
from spanvigil.operators import incidents
from spanvigil.session import checkpoint_dir
from spanvigil.settings import TIMESTAMP_FIELDS
from spanvigil.sources import artifacts, spans, stored
from workload import views
from workload.oracle_base import sql
from workload.registry import query

US = "'%Y-%m-%d %H:%M:%S.%f'"


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/stores/{uuid.uuid4().hex}"


# --- timestamps under any known name -----------------------------------------------------


@query("start_times", f"""
SELECT field, count(*) AS n, count(CASE WHEN field = 'created_at' AND event_id % 10 = 0 THEN NULL ELSE 1 END) AS n_readable,
       strftime(min(ts) FILTER (WHERE NOT (field = 'created_at' AND event_id % 10 = 0)), {US}) AS first_span,
       strftime(max(ts) FILTER (WHERE NOT (field = 'created_at' AND event_id % 10 = 0)), {US}) AS last_span
FROM events JOIN (VALUES {', '.join(f"({i}, '{name}')" for i, name in enumerate(TIMESTAMP_FIELDS))}) v(i, field) ON event_id % {len(TIMESTAMP_FIELDS)} = i
GROUP BY field""")
def start_times(spark, d):
    """One source per timestamp name: epoch nanoseconds, timestamps and text, some of it unreadable."""
    events = views.table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    forms = {
        "ts": F.unix_micros("at") * 1000,
        "created_at": F.when(F.col("event_id") % 10 == 0, "soon").otherwise(views.stamp("at")),
        "event_time": F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
    }
    out = None
    for i, name in enumerate(TIMESTAMP_FIELDS):
        own = events.where(F.col("event_id") % len(TIMESTAMP_FIELDS) == i)
        frame = own.select(forms.get(name, F.col("at")).alias(name))
        one = spans.with_start_time(frame).select(F.lit(name).alias("field"), "start_time")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("start_time").alias("n_readable"),
        views.stamp(F.min("start_time")).alias("first_span"),
        views.stamp(F.max("start_time")).alias("last_span"),
    )


# --- training files ----------------------------------------------------------------------


@query("training_files", """
SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 2) AS mean_price FROM orders
WHERE o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders ORDER BY 1 LIMIT 2) GROUP BY 1""")
def training_files(spark, d):
    """A file a priority; the two files of the first names are profiled."""
    folder = _folder(spark)
    orders = views.table(spark, d, "orders")
    orders.repartition("o_orderpriority").write.partitionBy("o_orderpriority").parquet(folder)
    rows = artifacts.training_data(spark, folder, files=2)
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), round_to(F.avg("o_totalprice"), 2).alias("mean_price"))


# --- baseline artifacts ------------------------------------------------------------------


@query("baseline_store", sql("""
SELECT service, model_version, round(mae, 2) AS mae, generation FROM (
  SELECT *, row_number() OVER (PARTITION BY service ORDER BY (model_version = CASE service WHEN 'svc0' THEN 'v1' WHEN 'svc1' THEN 'v9' ELSE '' END) DESC, day DESC, model_version DESC) AS place FROM (
    SELECT service, model_version, max(CAST(start_time AS DATE)) AS day, round(avg(error), 2) + CASE WHEN model_version = 'v2' THEN 1 ELSE 0 END AS mae,
           CASE WHEN model_version = 'v2' THEN 2 ELSE 1 END AS generation FROM spans GROUP BY service, model_version))
WHERE place = 1""", "spans"))
def baseline_store(spark, d):
    """Two publications, the second of one version only, and a third that never ended;
    then the exact version of a service, else its newest."""
    folder = _folder(spark)
    trained = (
        views.spans(spark, d)
        .groupBy("service", "model_version")
        .agg(
            round_to(F.avg(F.try_element_at("evals", F.lit("error"))), 2).alias("mae"),
            F.max(F.to_date("start_time")).cast("string").alias("trained_at"),
        )
    )

    def documents(rows, more):
        return rows.select(
            "service", F.col("service").alias("model_name"), "model_version", "trained_at",
            F.create_map(F.lit("mae_minutes"), F.col("mae") + F.lit(more)).alias("metrics"),
            F.expr("CAST(map() AS MAP<STRING,MAP<STRING,DOUBLE>>)").alias("attribute_distributions"),
            F.expr("CAST(map() AS MAP<STRING,DOUBLE>)").alias("correlations_with_target"),
        )

    stored.publish(documents(trained, 0.0), folder, "1")
    stored.publish(documents(trained.where("model_version = 'v2'"), 1.0), folder, "2")
    # What a lost job leaves behind: files of a generation without its mark.
    documents(trained, 50.0).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").json(f"{folder}/generation=3")
    current = stored.published(spark, folder, artifacts.BASELINE_SCHEMA, ["service", "model_version"])
    wanted = views.services(spark).select("service", F.expr("CASE service WHEN 'svc0' THEN 'v1' WHEN 'svc1' THEN 'v9' END").alias("wanted_version"))
    return bl.training_lookup(current, wanted).select(
        "service", "model_version", round_to(F.try_element_at("metrics", F.lit("mae_minutes")), 2).alias("mae"), F.col("generation").cast("int").alias("generation"),
    )


# --- incident documents ------------------------------------------------------------------


def _stored_incidents(spark, d):
    """A document a conversation; some are cut short, empty or without their id."""
    run = F.col("conv_id")
    turns = views.table(spark, d, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("size")))).alias("turns")
    )
    events = F.transform(
        "turns",
        lambda t: F.struct(
            views.stamp(F.timestamp_seconds(F.lit(1704067200) + run * 3600 + t["turn"] * 60)).alias("timestamp"),
            F.when(t["turn"] == 7, "RESOLVED").otherwise("INVESTIGATING").alias("state"),
            t["role"].alias("agent"),
            (t["size"] * 10).alias("duration_ms"),
        ),
    )
    body = F.to_json(
        F.struct(
            F.when(run % 7 != 3, F.concat(F.lit("INC-"), run.cast("string"))).alias("run_id"),
            F.concat(F.lit("svc"), (run % 3).cast("string")).alias("project_name"),
            views.stamp(F.timestamp_seconds(F.lit(1704067200) + run * 3600)).alias("started_at"),
            F.lit("RESOLVED").alias("final_state"),
            F.struct(F.when(run % 2 == 0, "CRITICAL").otherwise("WARNING").alias("severity"), F.lit("t").alias("title")).alias("incident_report"),
            events.alias("events"),
        )
    )
    folder = _folder(spark)
    turns.select(F.when(run % 5 == 1, F.left(body, F.lit(60))).when(run % 5 == 2, "  ").otherwise(body).alias("value")).write.text(folder)
    return stored.checked_documents(spark, folder, artifacts.INCIDENT_SCHEMA, "run_id", one_per_file=False)


@query("incident_scan", f"""
SELECT 'INC-' || conv_id AS run_id, 'svc' || conv_id % 3 AS service, CASE WHEN conv_id % 2 = 0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
       count(*) AS n_events, strftime(max(to_timestamp(1704067200 + conv_id * 3600 + turn * 60))::TIMESTAMP, {US}) AS last_event,
       count(*) FILTER (WHERE turn = 7) AS n_resolved
FROM conversations WHERE conv_id % 5 NOT IN (1, 2) AND conv_id % 7 <> 3 GROUP BY conv_id""")
def incident_scan(spark, d):
    """The readable documents; the others go to the quarantine table."""
    documents = stored.quarantine(_stored_incidents(spark, d), _folder(spark))
    steps = incidents.events_of(documents).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_events"), views.stamp(F.max("timestamp")).alias("last_event"), F.count_if(F.col("state") == "RESOLVED").alias("n_resolved")
    )
    return incidents.from_documents(documents).select("run_id", "service", "severity").join(steps, "run_id")


@query("incident_quarantine", """
SELECT CASE WHEN conv_id % 5 = 1 THEN 'unreadable' WHEN conv_id % 5 = 2 THEN 'empty' ELSE 'incomplete' END AS fault, count(*) AS n
FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 5 IN (1, 2) OR conv_id % 7 = 3 GROUP BY 1""")
def incident_quarantine(spark, d):
    table = _folder(spark)
    stored.quarantine(_stored_incidents(spark, d), table)
    return spark.read.parquet(table).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


@query("incident_log", """
SELECT conv_id AS run_id, count(*) AS n, max(turn) AS last_seq, count(DISTINCT role) AS n_agents FROM conversations GROUP BY conv_id""")
def incident_log(spark, d):
    """Transitions are appended twice, never rewritten."""
    folder = _folder(spark)
    turns = views.table(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.col("role").alias("agent"))
    for part in (0, 1):
        artifacts.append_events(turns.where(F.col("seq") % 2 == part), folder)
    rows = spark.read.schema(turns.schema).parquet(folder)
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"), F.count_distinct("agent").alias("n_agents"))


# --- names of sources --------------------------------------------------------------------


NAME = "_*[\\p{L}\\p{N}][\\p{L}\\p{N}_]*"


@query("plain_names", f"""
SELECT source, count(*) AS n, count(*) FILTER (WHERE regexp_full_match(name, '{NAME}(\\.{NAME})?')) AS n_plain
FROM (SELECT source, unnest(string_split_regex(text, '[\\x20\\x0A]')) AS name FROM documents) GROUP BY source""")
def plain_names(spark, d):
    """Every word of the documents as a table name somebody asks for."""
    names = views.table(spark, d, "documents").select("source", F.explode(F.split("text", "[\\x20\\x0A]")).alias("name"))
    return names.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_table_identifier("name")).alias("n_plain"))
