"""Inputs that once gave wrong answers or lost rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanvigil import settings as st
from spanvigil.operators import ordered, profiles, segments, trends, validation
from spanvigil.operators.attributes import attribute_counts
from spanvigil.operators.halves import with_halves
from spanvigil.sources import spans
from spanvigil.streaming.sinks import drain, file_stream
from spanvigil.streaming.tap import tap


def test_json_of_any_depth(spark):
    rows = [(1, '{"a":{"b":{"c":{"d":{"e":1.50,"f":null,"g":[1,{"x":2}]}}}}}'), (2, '{"a.b":"top","a":{"b":"nested","c":true}}'), (3, "{broken"), (4, None), (5, "[1]")]
    found = {r["id"]: r["flat"] for r in spans.flatten_attributes(spark.createDataFrame(rows, "id int, attributes string")).collect()}
    assert found == {1: {"a.b.c.d.e": "1.50", "a.b.c.d.g": '["1", {"x": "2"}]'}, 2: {"a.b": "top", "a.c": "true"}, 3: {}, 4: {}, 5: {}}


def test_prediction_named_twice(spark):
    frame = spark.createDataFrame([({"output.prediction": "1", "prediction.value": "2", "prediction.unit": "m"},)], "flat map<string,string>")
    full = frame.select("flat", F.lit("s").alias("service"), *[F.lit(None).cast(t).alias(c) for c, t in (("start_time", "timestamp"), ("end_time", "timestamp"), ("status_code", "string"))])
    assert spans.spans_from_flat(full).first()["outputs"] == {"prediction": "1", "unit": "m"}


def _sent(spark, tmp_path, rows):
    schema = "service string, topic string, partition int, offset long, value string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, "*.parquet")


def test_tap_keeps_messages_without_ids(spark, tmp_path):
    body = lambda n, i: '{"timestamp":"2024-01-01T00:00:00","predicted_eta_minutes":%d%s}' % (n, f',"request_id":"{i}"' if i else "")
    rows = [("a", "t", 0, n, body(n, "")) for n in range(8)] + [("a", "t", 1, 0, body(1, "x")), ("a", "t", 1, 5, body(1, "x")), ("b", "t", 1, 1, body(1, "x")), ("a", "t", 0, 3, body(3, ""))]
    out = drain(tap(_sent(spark, tmp_path, rows)))
    assert out.count() == 10  # eight places, one id of each service


def test_tap_by_field_maps(spark, tmp_path):
    rows = [("a", "t", 0, 1, '{"p":3,"t":"2024-01-01T00:00:00","request_id":"r"}'), ("b", "t", 0, 2, '{"predicted_eta_minutes":4,"shipper":"z","timestamp":"2024-01-01T00:00:00"}')]
    maps = st.field_maps_frame(spark, [st.FieldMap("a", prediction="p", timestamp="t")])
    found = {r["service"]: r for r in drain(tap(_sent(spark, tmp_path, rows), maps)).collect()}
    assert {s: r["outputs"] for s, r in found.items()} == {"a": {"prediction": "3"}, "b": {"prediction": "4"}}
    assert found["b"]["inputs"] == {"shipper": "z"} and found["a"]["request_id"] == "r"


def test_versions_are_names(spark, make_spans):
    rows = [(1, {"version": "1.10"}), (2, {"version": "1.10"}), (3, {"version": "1.1"}), (4, {"version": "2.0"})]
    services = st.services_frame(spark, [st.ServiceSettings("svc")])
    counts = attribute_counts(with_halves(make_spans(rows)), services)
    assert segments.live_version(counts).first()["model_version"] == "1.10"
    assert {r["value"]: r["n"] for r in counts.where("attr = 'model_version'").collect()} == {"1.10": 2, "1.1": 1, "2.0": 1}


def test_incident_is_not_the_baseline(spark):
    rows = [("f", "s", day, 10.0 if day < 4 else 30.0) for day in range(1, 10) for _ in range(2)] + [("g", "s", 2, 10.0), ("g", "t", 2, 10.0), ("g", "s", 8, 10.0)]
    errors = spark.createDataFrame(rows, "family string, bucket string, day int, error double").withColumn("time", F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)))
    onset, fixed = F.to_timestamp(F.lit("2024-01-04")), F.to_timestamp(F.lit("2024-01-07"))
    found = {r["family"]: (r["status"], r["n_deferred"]) for r in validation.phase_two(errors, onset, fixed, "family", ["bucket"]).collect()}
    assert found == {"f": ("FAIL", 0), "g": ("PASS", 1)}


def test_days_without_rows_fall_to_nothing(spark):
    rows = spark.createDataFrame([("s", "2024-01-01"), ("s", "2024-01-03"), ("r", "2024-01-01"), ("r", "2024-01-02"), ("r", "2024-01-03"), ("r", "2024-01-04")], "service string, d string").withColumn("time", F.to_timestamp("d"))
    found = {(r["service"], r["day"].day): (r["n"], r["status"]) for r in trends.day_over_day(rows, ["service"]).collect()}
    assert found["s", 2] == (0, "WARNING") and found["s", 3] == (1, "HEALTHY") and found["s", 4] == (0, "WARNING")


def test_events_without_a_time_stay(spark):
    frame = spark.createDataFrame([("k", 1, 1), ("k", None, 2), ("k", 3, 3)], "key string, time long, tie int")
    out = ordered.lag_by_chunk(frame, "key", "time", "tie", "time", F.floor(F.col("time") / 2), "before").collect()
    assert {(r["time"], r["before"]) for r in out} == {(None, None), (1, None), (3, 1)}


def test_a_missing_status_resets(spark):
    polls = spark.createDataFrame([("r", 1, "PASS"), ("r", 2, None), ("r", 3, "PASS")], "run_id string, poll int, status string")
    assert validation.recovery(polls).first()["status"] == "FAIL"


def test_unknown_families_are_not_confirmed(spark):
    feed = spark.createDataFrame([("s", None, 1.0), ("s", "m", 1.0)], "service string, family string, prediction double")
    expected = spark.createDataFrame([("s", "m", 1.0)], "service string, family string, mean double")
    assert validation.feed_checks(feed, expected).first()["identity"] is False


def test_distributions_add_up(spark):
    frame = spark.createDataFrame([(str(n),) for n in range(30) for _ in range(n + 1)], "c string")
    shares = profiles.attribute_distributions(profiles.categorical_profile(frame, ["c"], 5)).first()["distribution"]
    assert len(shares) == 6 and abs(sum(shares.values()) - 1) < 1e-3
    assert len(profiles.attribute_distributions(profiles.categorical_profile(frame, ["c"])).first()["distribution"]) == 30


def test_rows_as_spans(spark):
    frame = spark.createDataFrame([(5, 2.0, 3.0, "x", "2024-01-01T00:00:00")], "id int, p double, a double, f string, at string")
    row = spans.spans_from_rows(frame, {"prediction": "p", "actual": "a", "timestamp": "at", "request_id": "id"}, F.lit("s")).first()
    assert (row["inputs"], row["outputs"], row["evals"], row["request_id"]) == ({"f": "x"}, {"prediction": "2.0"}, {"error": 1.0}, "5")
