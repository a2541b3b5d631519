from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spanvigil.sources.spans import SPAN_SCHEMA  # noqa: E402
from workload.compare import local_session  # noqa: E402

NOW = datetime(2024, 3, 1, 12, 0, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def now():
    return NOW


@pytest.fixture(scope="session")
def make_spans(spark):
    """Spans from (minutes ago, fields) pairs; fields override the defaults."""

    def build(rows, service="svc"):
        data = []
        for i, (minutes, fields) in enumerate(rows):
            at = NOW - timedelta(minutes=minutes)
            data.append(
                (
                    fields.get("service", service),
                    at,
                    at,
                    fields.get("status", "OK"),
                    fields.get("id", f"r{i}"),
                    fields.get("version"),
                    fields.get("inputs", {}),
                    fields.get("outputs", {}),
                    fields.get("evals", {}),
                    fields.get("latency"),
                )
            )
        return spark.createDataFrame(data, SPAN_SCHEMA)

    return build
