import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from spanvigil.functions.scalars import assert_table_identifier, is_table_identifier
from spanvigil.operators import investigation
from spanvigil.sources import artifacts, stored
from spanvigil.streaming import monitor
from workload import views

SCHEMA = "service string, model_version string, metric double"


def test_faulty_documents_are_set_aside(spark):
    path = tempfile.mkdtemp(prefix="documents-")
    bodies = {
        "a.json": json.dumps({"service": "a", "metric": 1.5}, indent=2), "b.json": '{"service": "b", ', "c.json": " \n", "d.json": '{"metric": 2}',
        "e.json": '{"service": "e", "metric": "many"}', "f.json": "[1]", "deep/g.json": '{"service": "g", "other": {"x": 1}}',
    }
    os.makedirs(f"{path}/deep")
    for name, body in bodies.items():
        with open(f"{path}/{name}", "w") as out:
            out.write(body)
    checked = stored.checked_documents(spark, path, SCHEMA, "service")
    kept = tempfile.mkdtemp(prefix="quarantine-")
    assert sorted((r["service"], r["metric"]) for r in stored.quarantine(checked, kept).collect()) == [("a", 1.5), ("g", None)]
    aside = {os.path.basename(r["path"]): r for r in spark.read.parquet(kept).collect()}
    faults = {name: r["fault"] for name, r in aside.items()}
    assert faults == {"b.json": "unreadable", "c.json": "empty", "d.json": "incomplete", "e.json": "unreadable", "f.json": "unreadable"}
    assert aside["b.json"]["body"] == bodies["b.json"]


def test_generations_replace_keys_as_a_whole(spark):
    path = tempfile.mkdtemp(prefix="artifacts-") + "/store"
    keys = ["service", "model_version"]
    now = lambda: sorted((r["service"], r["model_version"], r["metric"], r["generation"]) for r in stored.published(spark, path, SCHEMA, keys).collect())
    frame = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    assert now() == []
    stored.publish(frame(("a", "v1", 1.0), ("a", "v2", 2.0), ("b", "v1", 3.0)), path, "01")
    stored.publish(frame(("a", "v2", 4.0)), path, "02")
    stands = [("a", "v1", 1.0, "01"), ("a", "v2", 4.0, "02"), ("b", "v1", 3.0, "01")]
    assert now() == stands
    stored.publish(frame(("a", "v1", 9.0)), path, "03")
    os.remove(f"{path}/generation=03/_SUCCESS")  # the job was lost before its end
    assert now() == stands
    with pytest.raises(ValueError):
        stored.compact(spark, path, SCHEMA, keys, "02")
    stored.compact(spark, path, SCHEMA, keys, "04")
    assert now() == [(s, v, m, "04") for s, v, m, _ in stands]
    assert not os.path.exists(f"{path}/generation=01") and not os.path.exists(f"{path}/generation=02")


def test_first_training_files_are_the_only_ones_opened(spark):
    path = tempfile.mkdtemp(prefix="training-")
    for name in ("part{0}", "part[1]", "qart2"):
        spark.range(5).coalesce(1).write.parquet(f"{path}/{name}")
    with open(f"{path}/qart2/broken.parquet", "w") as out:
        out.write("no parquet file")
    rows = artifacts.training_data(spark, path, 2)
    assert rows.count() == 10 and len(rows.inputFiles()) == 2


def test_names_of_tables(spark):
    names = ["t", "a.b", "_x1", "é.ü", "", "_", "a.b.c", "a b", "a;drop", "a.", ".a", "a\n", "__.x", None]
    found = spark.createDataFrame([(n,) for n in names], "name string").withColumn("ok", is_table_identifier("name")).collect()

    def plain(name):
        try:
            return assert_table_identifier(name) == name
        except ValueError:
            return False

    assert [r["ok"] for r in found] == [plain(n) for n in names]


def test_drill_down_probes_and_reads_spans_once(spark, make_spans, monkeypatch):
    monkeypatch.setattr(investigation, "LIST_ANOMALIES", 2)
    spans = make_spans([(i, {"inputs": {"limit": f"{i % 9}.0", "empty": ""}, "evals": {"error": float(i)}}) for i in range(90)] + [(5, {"inputs": {}})])
    wanted = [("svc", f"limit={i}") for i in range(7)] * 2 + [("svc", "empty="), ("svc", "overall"), ("none", "limit=1"), ("svc", "gone=1")]
    matched = investigation.anomaly_spans(spans, spark.createDataFrame(wanted, "service string, segment string"))
    rows = {(r["attr"], r["value"]): r for r in investigation.drill_down(matched, 3).collect()}
    assert set(rows) == {("input.limit", str(i)) for i in range(7)} | {("input.empty", "")}
    assert rows["input.limit", "4"]["n"] == 10 and rows["input.empty", ""]["n"] == 90
    assert rows["input.limit", "4"]["sample_ids"] == ["r85", "r76", "r67"] and rows["input.limit", "4"]["mean_error"] == 44.5


def test_a_hot_service_sends_sessions_not_spans(spark):
    """Sessions are merged before the shuffle that deals them by service."""
    stream = spark.readStream.format("rate").load()
    silent = monitor.silences(stream.select(F.col("timestamp").alias("start_time"), F.lit("hot").alias("service")))
    query = silent.writeStream.format("memory").queryName("silent_plan").trigger(once=True).start()
    query.awaitTermination()
    query._jsq.processAllAvailable()
    lines = query._jsq.explainInternal(False).splitlines()
    merging = [i for i, line in enumerate(lines) if "MergingSessions" in line]
    exchange = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert merging and exchange and max(merging) > max(exchange)
