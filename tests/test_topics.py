"""Topics as spans, without a broker."""

from __future__ import annotations

import json
from datetime import datetime

from spanvigil import settings as st
from spanvigil.sources import messages
from spanvigil.sources.spans import SPAN_COLUMNS


def test_newest_offsets_bound_each_partition():
    options = messages.newest_offsets({"t": {0: 95, 1: 0}}, {"t": {0: 100, 1: 40, 2: 0}}, 30)
    assert json.loads(options["startingOffsets"]) == {"t": {"0": 95, "1": 29, "2": 0}}
    assert json.loads(options["endingOffsets"]) == {"t": {"0": 100, "1": 40, "2": 0}}
    assert json.loads(messages.newest_offsets({}, {"t": {0: 7}}, 0)["startingOffsets"]) == {"t": {"0": 6}}


def test_messages_become_spans(spark):
    at = datetime(2024, 1, 1, 12)
    values = [
        {"request_id": "a", "service": "own", "predicted_eta_minutes": 30, "actual_eta_minutes": 42, "shipper": "s", "timestamp": "2024-01-01T10:00:00"},
        {"request_id": "b", "error_type": "Timeout"},
    ]
    rows = [(json.dumps(v).encode(), "topic", 0, n, at) for n, v in enumerate(values)] + [(b"not json", "topic", 0, 2, at)]
    frames = spark.createDataFrame(rows, "value binary, topic string, partition int, offset long, timestamp timestamp")
    found = messages.message_spans(frames)
    assert found.columns == SPAN_COLUMNS
    first, second = sorted(found.collect(), key=lambda r: r["request_id"])
    assert (first["service"], first["start_time"], first["outputs"], first["evals"]) == ("own", datetime(2024, 1, 1, 10), {"prediction": "30"}, {"absolute_error_minutes": 12.0})
    assert (second["service"], second["start_time"], second["status_code"], second["model_version"]) == ("topic", at, "ERROR", None)


def test_mapped_messages_become_spans(spark):
    maps = st.field_maps_frame(spark, [st.FieldMap("risk", prediction="score", actual="label", model_version="v")])
    frames = spark.createDataFrame([(json.dumps({"score": 0.25, "label": 1, "v": "7", "country": "us"}),)], "value string")
    row = messages.message_spans(frames, "risk", maps).first()
    assert (row["service"], row["model_version"], row["outputs"], row["evals"], row["inputs"]) == ("risk", "7", {"prediction": "0.25"}, {"error": 0.75}, {"country": "us"})
