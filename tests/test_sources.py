import json
import tempfile

from pyspark.sql import functions as F

from spanvigil import settings as st
from spanvigil.operators import incidents, profiles
from spanvigil.sources import artifacts, messages, spans, tables


def decoded(spark, *bodies, service="svc"):
    rows = [(service, b if isinstance(b, str) else json.dumps(b)) for b in bodies]
    return messages.decode(spark.createDataFrame(rows, "service string, value string"))


def test_configured_mapping(spark):
    rows = decoded(
        spark,
        {"risk_score": 0.9, "label": 1, "version": "m1", "ts": "2024-01-01T00:00:00", "merchant": "x", "region": "eu", "_private": 1, "nested": {"a": 1}, "none": None},
        "{not json",
    )
    maps = st.field_maps_frame(spark, [st.FieldMap("svc", prediction="risk_score", actual="label", model_version="version", timestamp="ts")])
    out = messages.map_configured(rows, maps).collect()
    assert len(out) == 1
    row = out[0]
    assert row["inputs"] == {"merchant": "x", "region": "eu"}
    assert row["outputs"] == {"prediction": "0.9"} and row["model_version"] == "m1"
    assert abs(row["evals"]["error"] - 0.1) < 1e-9 and str(row["start_time"]) == "2024-01-01 00:00:00"


def test_explicit_error_and_inputs(spark):
    maps = st.field_maps_frame(spark, [st.FieldMap("svc", prediction="pred", error="err", inputs=("seg", "gone"))])
    rows = messages.map_configured(decoded(spark, {"pred": 5, "err": 2.5, "seg": "a", "other": 1}, {"pred": "text", "seg": "b"}), maps)
    found = {r["inputs"]["seg"]: r["evals"] for r in rows.collect()}
    assert found == {"a": {"error": 2.5}, "b": {}}


def test_default_mapping(spark):
    good = {"predicted_eta_minutes": 100, "actual_eta_minutes": 130, "shipper": "acme", "api_fetch_limit": 73, "model_version": "v1", "_regime": "bugged", "request_id": "q"}
    rows = messages.map_default(decoded(spark, good, {"error_type": "Timeout", "shipper": "acme", "predicted_eta_minutes": 5}))
    ok, failed = sorted(rows.collect(), key=lambda r: r["status_code"], reverse=True)
    assert ok["inputs"] == {"shipper": "acme", "api_fetch_limit": "73"} and ok["evals"] == {messages.DEFAULT_ERROR: 30.0} and ok["regime"] == "bugged"
    assert failed["status_code"] == "ERROR" and failed["outputs"] == {} and failed["evals"] == {} and failed["regime"] == "failed"
    assert {r["regime"]: r["n"] for r in messages.regime_counts(rows).collect()} == {"bugged": 1, "failed": 1}


def test_peek_bounds(spark):
    rows = spark.createDataFrame([(p, o, "{}") for p in range(4) for o in range(20)], "partition int, offset long, value string")
    found = messages.peek_latest(rows, 10).collect()
    assert len(found) == 10 and {r["offset"] for r in found} == {17, 18, 19}
    assert messages.peek_latest(rows.where("partition = 0"), 5).count() == 5


def test_flatten_and_canonical_spans(spark):
    body = {"input": {"region": "eu", "deep": {"x": 1}}, "eval": {"error": 2.5}, "prediction": {"value": 7}, "model": {"version": "v1"}, "request_id": "q"}
    frame = spark.createDataFrame(
        [("svc", "2024-01-01 00:00:00", "2024-01-01 00:00:02", "OK", json.dumps(body)), ("svc", "bad", None, "OK", "{oops")],
        "service string, ts string, end string, status_code string, attributes string",
    ).withColumn("end_time", F.try_to_timestamp("end"))
    rows = spans.spans_from_flat(spans.flatten_attributes(spans.with_start_time(frame))).collect()
    full = next(r for r in rows if r["request_id"] == "q")
    assert full["inputs"] == {"region": "eu", "deep.x": "1"} and full["outputs"] == {"prediction": "7"}
    assert full["evals"] == {"error": 2.5} and full["model_version"] == "v1" and full["latency_ms"] == 2000.0
    empty = next(r for r in rows if r["request_id"] is None)
    assert empty["inputs"] == {} and empty["start_time"] is None


def test_missing_source_is_empty_and_store_is_pruned(spark, make_spans, now):
    assert spans.read_predictions(spark, "parquet", "/no/such/place").count() == 0
    path = tempfile.mkdtemp(prefix="spans-")
    spans.append_spans(make_spans([(5, {}), (60 * 24 * 3, {})]), path)
    rows = spans.recent(spark.read.parquet(path), F.lit(now), 60)
    assert rows.count() == 1
    assert "PartitionFilters: [isnotnull(span_date" in rows._jdf.queryExecution().toString()


def test_newest_and_actuals(spark):
    rows = spark.createDataFrame([(i, f"2024-01-{i:02d}") for i in range(1, 11)], "load_id long, d string").withColumn("delivered_at", F.to_timestamp("d"))
    keys = spark.createDataFrame([(2,), (2,), (9,), (50,)], "load_id long")
    assert [r["load_id"] for r in tables.actuals_for(rows, keys, limit=10).collect()] == [9, 2]
    assert [r["load_id"] for r in tables.newest(rows, "delivered_at", F.to_timestamp(F.lit("2024-01-05")), 3).collect()] == [10, 9, 8]


def test_artifacts_round_trip(spark):
    path = tempfile.mkdtemp(prefix="artifacts-") + "/baselines"
    training = spark.createDataFrame([(f"{i % 3}", "xy"[i % 2], float(i)) for i in range(30)], "a string, b string, y double").withColumn("z", -F.col("y"))
    one = profiles.training_baseline(training, "svc", "v1", "2024-01-01", "y")
    artifacts.write_artifacts(one, path)
    artifacts.write_artifacts(one.withColumn("service", F.lit("other")), path)
    back = {r["service"]: r for r in artifacts.baselines(spark, path).collect()}
    assert set(back) == {"svc", "other"}
    assert back["svc"]["attribute_distributions"]["b"] == {"x": 0.5, "y": 0.5}
    assert back["svc"]["correlations_with_target"] == {"z": -1.0}


def test_training_data_takes_first_files(spark):
    path = tempfile.mkdtemp(prefix="training-")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(f"{path}/part{i}")
    assert artifacts.training_data(spark, path).count() == 30
    assert [r["id"] for r in artifacts.training_data(spark, path, 1).orderBy("id").collect()] == list(range(10))


def test_corrupt_incident_documents_are_skipped(spark):
    path = tempfile.mkdtemp(prefix="incidents-")
    good = {"run_id": "INC-1", "project_name": "svc", "started_at": "2024-01-01T00:00:00", "incident_report": {"severity": "CRITICAL", "tldr": "t", "title": "x"},
            "events": [{"timestamp": "2024-01-01T00:00:00", "state": "MONITORING", "message": "m"}, {"timestamp": "2024-01-01T00:01:00", "state": "RESOLVED", "message": "n"}]}
    for name, text in (("INC-1.json", json.dumps(good, indent=2)), ("INC-2.json", '{"run_id": "INC-2", ')):
        with open(f"{path}/{name}", "w") as out:
            out.write(text)
    documents = artifacts.incident_documents(spark, path)
    assert [r["run_id"] for r in incidents.from_documents(documents).collect()] == ["INC-1"]
    steps = incidents.timeline(incidents.events_of(documents)).orderBy("seq").collect()
    assert [s["step_seconds"] for s in steps] == [None, 60.0]


def test_field_roles(spark):
    names = [("risk_score", "numeric", 90), ("label", "numeric", 2), ("merchant_category", "categorical", 4), ("region", "categorical", 2), ("model_version", "categorical", 1), ("event_time", "categorical", 100), ("user_id", "categorical", 90)]
    rows = [("s", i, n, k, d, 100) for i, (n, k, d) in enumerate(names, 1)]
    row = profiles.field_roles(spark.createDataFrame(rows, "source string, position int, name string, kind string, n_distinct long, n_sampled long")).first()
    assert (row["timestamp"], row["model_version"], row["error"], row["actual"], row["prediction"]) == ("event_time", "model_version", None, "label", "risk_score")
    assert row["segments"] == ["merchant_category", "region"] and row["inputs"] == ["merchant_category", "region", "user_id"]
    assert row["ambiguous"] == []
