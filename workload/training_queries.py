"""Profiles of training tables, calibration and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanvigil.functions.scalars import round_to

from spanvigil.operators import calibration, decision, lineage, profiles, segments
from spanvigil.settings import RegistryEntry, registry_frame
from workload import health_queries as hq
from workload import views
from workload.oracle_base import sql, view
from workload.registry import query

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PCT = [(5, 0.05), (25, 0.25), (50, 0.5), (75, 0.75), (95, 0.95)]


def _profile_sql(column: str, std: str, key: str = "") -> str:
    pcts = ", ".join(f"round(quantile_cont({column}, {p!r}::DOUBLE), 4) AS p{n}" for n, p in PCT)
    lead = f"{key}, " if key else ""
    return f"""SELECT {lead}'{column}' AS "column", count({column}) AS count, round(avg({column}), 4) AS mean, round({std}({column}), 4) AS std,
       round(min({column}), 4) AS min, round(max({column}), 4) AS max, round(count(*) FILTER ({column} IS NULL) / count(*)::DOUBLE, 4) AS null_frac, {pcts}
FROM lineitem {'GROUP BY ' + key if key else ''}"""


@query("profile_numeric", "\nUNION ALL\n".join(_profile_sql(c, "stddev_pop") for c in NUMERIC))
def profile_numeric(spark, d):
    return profiles.numeric_profile(views.table(spark, d, "lineitem"), NUMERIC)


@query("profile_by_segment", "\nUNION ALL\n".join(_profile_sql(c, "stddev_samp", "l_returnflag") for c in NUMERIC))
def profile_by_segment(spark, d):
    return profiles.numeric_profile(views.table(spark, d, "lineitem"), NUMERIC, ["l_returnflag"], sample_std=True)


_TOP = """SELECT "column", value, n, rank, count, n_distinct, round(n / count::DOUBLE, 4) AS fraction FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank,
         sum(n) OVER (PARTITION BY "column")::BIGINT AS count, count(*) OVER (PARTITION BY "column") AS n_distinct
  FROM (SELECT 'p_name' AS "column", p_name AS value, count(*) AS n FROM part GROUP BY ALL
        UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY ALL
        UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY ALL)) WHERE rank <= 20"""


@query("profile_categorical", _TOP)
def profile_categorical(spark, d):
    return profiles.categorical_profile(views.table(spark, d, "part"), ["p_name", "p_brand", "p_type"], 20)


@query("attribute_modes", f"""
SELECT "column", count(*) + (max(n_distinct) > count(*))::INT AS n_values, round(sum(fraction) + 1 - sum(n) / max(count)::DOUBLE, 3) AS covered, arg_min(value, rank) AS mode FROM ({_TOP}) GROUP BY "column" """)
def attribute_modes(spark, d):
    shares = profiles.attribute_distributions(profiles.categorical_profile(views.table(spark, d, "part"), ["p_name", "p_brand", "p_type"], 20))
    covered = F.aggregate(F.map_values("distribution"), F.lit(0.0), lambda a, v: a + v)
    return shares.select("column", F.size("distribution").alias("n_values"), round_to(covered, 3).alias("covered"), "mode")


@query("profile_sequence", """
SELECT 'embedding' AS "column", count(embedding) AS count, min(len(embedding)) AS len_min, max(len(embedding)) AS len_max, round(avg(len(embedding)), 4) AS len_mean FROM embeddings""")
def profile_sequence(spark, d):
    return profiles.sequence_profile(views.table(spark, d, "embeddings"), ["embedding"])


@query("profile_datetime", """
SELECT 'l_shipdate' AS "column", count(l_shipdate) AS count, strftime(min(l_shipdate), '%Y-%m-%dT%H:%M:%S') AS min, strftime(max(l_shipdate), '%Y-%m-%dT%H:%M:%S') AS max FROM lineitem""")
def profile_datetime(spark, d):
    return profiles.datetime_profile(views.table(spark, d, "lineitem"), ["l_shipdate"])


@query("target_correlation", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", round(corr({c}, l_extendedprice), 4) AS correlation FROM lineitem""" for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")))
def target_correlation(spark, d):
    return profiles.target_correlation(views.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice")


@query("training_baseline", f"""
SELECT 'parts' AS service, '2024-01' AS model_version, count(DISTINCT "column") AS n_distributions, count(*) + count(DISTINCT "column") FILTER (n_distinct > 20) AS n_values,
       (SELECT round(corr(p_size, p_retailprice), 4) FROM part) AS size_correlation FROM ({_TOP})""")
def training_baseline(spark, d):
    base = profiles.training_baseline(views.table(spark, d, "part"), "parts", "2024-01", "2024-01-31", "p_retailprice")
    n_values = F.aggregate(F.map_values("attribute_distributions"), F.lit(0), lambda a, v: a + F.size(v))
    return base.select(
        "service", "model_version", F.size("attribute_distributions").alias("n_distributions"), n_values.alias("n_values"),
        F.try_element_at("correlations_with_target", F.lit("p_size")).alias("size_correlation"),
    )


# --- calibration ---------------------------------------------------------------------


def calibrated(spark, d):
    t = hq.tables(spark, d)
    return calibration.calibrate(t.counts, t.profile, views.services(spark), t.signals)


view("calibration", "spans", "services", "signals", "live_version", "long")(f"""
SELECT h.service, n_spans, per_hour, metric, model_version, channel_mode, type_mode, coalesce(n_critical, 0) AS n_critical
FROM (SELECT service, count(*) AS n_spans, round(count(*) / ({views.LOOKBACK} / 60.0), 1) AS per_hour, round(avg(error), 2) AS metric FROM spans GROUP BY service) h
LEFT JOIN live_version USING (service)
LEFT JOIN (SELECT service, arg_min(value, (-n, value)) FILTER (attr = 'input.channel') AS channel_mode, arg_min(value, (-n, value)) FILTER (attr = 'input.event_type') AS type_mode
           FROM (SELECT service, attr, value, count(*) AS n FROM long GROUP BY ALL) GROUP BY service) USING (service)
LEFT JOIN (SELECT service, count(*) AS n_critical FROM signals WHERE status = 'CRITICAL' GROUP BY service) USING (service)""")


def _flat(rows):
    mode = lambda k: F.try_element_at("attribute_modes", F.lit(k))
    return rows.withColumn("channel_mode", mode("channel")).withColumn("type_mode", mode("event_type")).drop("attribute_modes")


@query("calibration", sql("SELECT * FROM calibration", "calibration"))
def calibration_rows(spark, d):
    return _flat(calibrated(spark, d))


@query("auto_baseline", sql("""
SELECT service, n_spans, metric, CASE WHEN n_critical > 0 THEN 'deferred' ELSE 'established' END AS outcome
FROM calibration WHERE service NOT IN (SELECT service FROM training) AND n_spans >= 50 AND (n_critical > 0 OR metric IS NOT NULL)""", "calibration", "training"))
def auto_baseline(spark, d):
    return calibration.auto_baseline(calibrated(spark, d), hq.training_artifacts(spark, d)).select("service", "n_spans", "metric", "outcome")


@query("schema_check", sql("""
SELECT s.service, role, c.attr, (l.attr IS NOT NULL) AS present FROM services s
CROSS JOIN (VALUES ('error', 'eval.error'), ('segment', 'input.event_type'), ('segment', 'input.user_bucket')) c(role, attr)
LEFT JOIN (SELECT DISTINCT service, attr FROM long) l ON l.service = s.service AND l.attr = c.attr""", "services", "long"))
def schema_check(spark, d):
    return calibration.schema_check(hq.counts(spark, d), views.services(spark))


@query("available_attributes", sql("""
SELECT service, array_to_string(list_sort(list(DISTINCT attr) FILTER (attr LIKE 'eval.%')), ',') AS evals,
       array_to_string(list_sort(list(DISTINCT attr) FILTER (attr LIKE 'input.%')), ',') AS inputs FROM long GROUP BY service""", "long"))
def available_attributes(spark, d):
    rows = calibration.available_attributes(hq.counts(spark, d))
    return rows.select("service", F.array_join("evals", ",").alias("evals"), F.array_join("inputs", ",").alias("inputs"))


@query("volume_per_hour", sql("SELECT service, n_spans, per_hour FROM calibration", "calibration"))
def volume_per_hour(spark, d):
    return segments.volume_per_hour(hq.profile(spark, d).select("service", "n_spans"), views.services(spark))


# --- runs ----------------------------------------------------------------------------


def runs(spark, d):
    silent = F.col("o_orderkey") % 3 == 0
    params = F.map_filter(
        F.create_map(F.lit("priority"), F.when(~silent, F.col("o_orderpriority")), F.lit("status"), F.concat(F.col("o_orderstatus"), F.lit(" "))),
        lambda _, v: v.isNotNull(),
    )
    return views.table(spark, d, "orders").select(
        F.concat(F.lit("exp"), (F.col("o_custkey") % 20).cast("string")).alias("experiment"),
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("start_time"), params.alias("params"),
    )


view("runs")("""
SELECT 'exp' || CAST(o_custkey % 20 AS VARCHAR) AS experiment, o_orderkey AS run_id, o_orderdate AS start_time,
       CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS priority, o_orderstatus || ' ' AS status FROM orders""")
view("latest", "runs")("""
SELECT experiment, arg_max(run_id, (start_time, run_id)) AS run_id, max(start_time) AS start_time,
       arg_max({'v': priority}, (start_time, run_id)).v AS priority, arg_max(status, (start_time, run_id)) AS status FROM runs GROUP BY experiment""")


@query("latest_run", sql("SELECT experiment, run_id, strftime(start_time, '%Y-%m-%d') AS day, priority, status FROM latest", "latest"))
def latest_run(spark, d):
    at = lambda k: F.try_element_at("params", F.lit(k)).alias(k)
    return lineage.latest_run(runs(spark, d)).select("experiment", "run_id", F.date_format("start_time", "yyyy-MM-dd").alias("day"), at("priority"), at("status"))


@query("recent_runs", sql("""
SELECT experiment, run_id, place FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY start_time DESC, run_id DESC) AS place FROM runs) WHERE place <= 10""", "runs"))
def recent_runs(spark, d):
    return lineage.recent_runs(runs(spark, d), 10).select("experiment", "run_id", "place")


@query("latest_version", """
SELECT p_brand AS model_name, arg_max(CAST(p_size AS VARCHAR), (p_size, p_partkey)) AS version, arg_max(p_partkey, (p_size, p_partkey)) AS run_id FROM part GROUP BY p_brand""")
def latest_version(spark, d):
    versions = views.table(spark, d, "part").select(F.col("p_brand").alias("model_name"), F.col("p_size").cast("string").alias("version"), F.col("p_partkey").alias("run_id"))
    return lineage.latest_version(versions)


OBSERVED = (("priority", "1-URGENT"), ("status", "F"), ("depth", "5"))


@query("training_mismatch", sql("""
SELECT o.experiment, attribute, value, run_id, tv AS training_value,
       CASE WHEN run_id IS NULL THEN 'unknown' WHEN tv IS NULL THEN 'high' WHEN trim(tv) <> trim(value) THEN 'medium' ELSE 'low' END AS severity,
       (run_id IS NOT NULL AND (tv IS NULL OR trim(tv) <> trim(value))) AS mismatch
FROM (SELECT experiment, attribute, value, run_id, CASE attribute WHEN 'priority' THEN priority WHEN 'status' THEN status END AS tv
      FROM (SELECT DISTINCT 'exp' || CAST(c_custkey % 21 AS VARCHAR) AS experiment FROM customer)
      CROSS JOIN (VALUES ('priority', '1-URGENT'), ('status', 'F'), ('depth', '5')) v(attribute, value) LEFT JOIN latest USING (experiment)) o""", "latest"))
def training_mismatch(spark, d):
    wanted = F.array(*[F.struct(F.lit(a).alias("attribute"), F.lit(v).alias("value")) for a, v in OBSERVED])
    observed = (
        views.table(spark, d, "customer").select(F.concat(F.lit("exp"), (F.col("c_custkey") % 21).cast("string")).alias("experiment")).distinct()
        .select("experiment", F.explode(wanted).alias("o")).select("experiment", "o.*")
    )
    return lineage.training_mismatch(observed, lineage.latest_run(runs(spark, d)))


def tagged_runs(spark, d):
    i = F.col("page_id")
    source = (
        F.when(i % 11 == 0, None).when(i % 7 == 0, "/opt/conda/ipykernel_launcher.py").when(i % 5 == 0, F.concat(F.lit("/home/eng"), F.col("url"))).otherwise(F.col("url"))
    )
    tags = F.create_map(
        F.lit(lineage.TAG_SOURCE), source,
        F.lit(lineage.TAG_COMMIT), F.when(i % 3 != 0, F.concat(F.lit("c"), i.cast("string"))),
        F.lit(lineage.TAG_USER), F.lit("trainer"),
    )
    return views.table(spark, d, "pages").select(
        F.concat(F.lit("exp"), (i % 40).cast("string")).alias("experiment"), i.alias("run_id"), i.alias("start_time"),
        F.map_filter(tags, lambda _, v: v.isNotNull()).alias("tags"),
    )


view("provenance")("""
SELECT *, (git_commit IS NOT NULL AND warnings = '') AS traceable FROM (
  SELECT experiment, run_id, source_path, git_commit,
         concat_ws(',', CASE WHEN git_commit IS NULL THEN 'no_commit' END, CASE WHEN contains(source_path, 'ipykernel') THEN 'kernel_source' END,
                   CASE WHEN starts_with(source_path, '/home/') AND git_commit IS NULL THEN 'personal_disk' END, CASE WHEN source_path IS NULL THEN 'no_source' END) AS warnings
  FROM (SELECT 'exp' || CAST(i % 40 AS VARCHAR) AS experiment, i AS run_id,
               CASE WHEN i % 11 = 0 THEN NULL WHEN i % 7 = 0 THEN '/opt/conda/ipykernel_launcher.py' WHEN i % 5 = 0 THEN '/home/eng' || url ELSE url END AS source_path,
               CASE WHEN i % 3 <> 0 THEN 'c' || CAST(i AS VARCHAR) END AS git_commit
        FROM (SELECT i, any_value(url) AS url FROM (SELECT page_id AS i, url FROM pages) WHERE i IN (SELECT max(page_id) FROM pages GROUP BY page_id % 40) GROUP BY i)))""")


@query("provenance", sql("""
SELECT *, CASE WHEN contains(source_path, '/en/') THEN ltrim(substr(source_path, instr(source_path, '/en/') + 4), '/') END AS repo_path FROM provenance""", "provenance"))
def provenance(spark, d):
    from spanvigil.functions.scalars import repo_relative_path

    rows = lineage.provenance(lineage.latest_run(tagged_runs(spark, d)))
    return rows.select(
        "experiment", "run_id", "source_path", "git_commit", F.array_join("warnings", ",").alias("warnings"), "traceable",
        repo_relative_path(F.col("source_path"), F.lit("team/en")).alias("repo_path"),
    )


def registry(spark):
    return registry_frame(spark, [RegistryEntry("svc0", f"family{i}", f"exp{i}", "team/en") for i in range(45)])


@query("governance", sql("""
SELECT 'family' || CAST(i AS VARCHAR) AS model_family, 'exp' || CAST(i AS VARCHAR) AS experiment, coalesce(warnings, 'no_run') AS warnings,
       len(string_split(coalesce(warnings, 'no_run'), ',')) AS n_warnings
FROM range(45) t(i) LEFT JOIN provenance ON experiment = 'exp' || CAST(i AS VARCHAR) WHERE coalesce(warnings, 'no_run') <> '' OR NOT coalesce(traceable, false)""", "provenance"))
def governance(spark, d):
    rows = lineage.governance(registry(spark), lineage.provenance(lineage.latest_run(tagged_runs(spark, d))))
    return rows.select("model_family", "experiment", F.array_join("warnings", ",").alias("warnings"), "n_warnings")


# The audit of a service that sends spans and of one that is silent.
AUDITED = [RegistryEntry("svc0" if i < 25 else "svc9", f"family{i}", f"exp{i}", "team/en") for i in range(45)]


view("ungoverned", "provenance")("""
SELECT CASE WHEN i < 25 THEN 'svc0' ELSE 'svc9' END AS service, 'family' || CAST(i AS VARCHAR) AS model_family,
       len(string_split(coalesce(warnings, 'no_run'), ',')) AS n_warnings
FROM range(45) t(i) LEFT JOIN provenance ON experiment = 'exp' || CAST(i AS VARCHAR) WHERE coalesce(warnings, 'no_run') <> '' OR NOT coalesce(traceable, false)""")


def _audit(spark, d):
    return lineage.governance(registry_frame(spark, AUDITED), lineage.provenance(lineage.latest_run(tagged_runs(spark, d))))


@query("governed_snapshot", sql("""
SELECT s.service, s.n_spans, s.status, s.severity, coalesce(g.n, 0) AS n_ungoverned
FROM snapshot s LEFT JOIN (SELECT service, count(*) AS n FROM ungoverned GROUP BY service) g USING (service)""", "snapshot", "ungoverned"))
def governed_snapshot(spark, d):
    return hq.tables(spark, d, _audit(spark, d)).snapshot.select("service", "n_spans", "status", "severity", "n_ungoverned")


@query("governance_anomalies", sql("""
SELECT service, 'governance' AS metric, model_family AS segment, n_warnings::DOUBLE AS current_value, n_warnings::DOUBLE AS ratio FROM ungoverned
UNION ALL SELECT service, 'prediction_volume', 'overall', 0, 0 FROM facts WHERE n_spans = 0""", "ungoverned", "facts"))
def governance_anomalies(spark, d):
    t = hq.tables(spark, d)
    rows = decision.anomalies(t.segments, t.psi, t.silent, t.signals, t.metrics, _audit(spark, d))
    return rows.where("metric IN ('governance', 'prediction_volume')").select("service", "metric", "segment", "current_value", "ratio")
