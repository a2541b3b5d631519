"""Day partials of continuous monitoring, and faults of small operators."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from spanvigil import settings as st
from spanvigil.operators import profiles, trends, validation
from spanvigil.streaming import partials


@pytest.fixture()
def services(spark):
    return st.services_frame(spark, [st.ServiceSettings("svc"), st.ServiceSettings("other")])


def metrics(frame):
    return {r["service"]: (r["n"], r["metric"], r["error_rate"], r["null_rate"]) for r in frame.collect()}


def test_batches_touch_their_own_days_and_repeat_safely(spark, make_spans, now, services, tmp_path):
    store = str(tmp_path / "days")
    day = 1_440
    first = make_spans([(2 * day, {"evals": {"error": 4.0}}), (3 * day, {"evals": {"error": 2.0}, "status": "ERROR"}), (9 * day, {})])
    late = make_spans([(3 * day, {"evals": {"error": 6.0}}), (0, {"evals": {"error": 8.0}, "service": "other"})])
    future = make_spans([(-400 * day, {"evals": {"error": 1.0}})])
    run = lambda batch, n: partials.step(batch, n, store, services, 7, now.date())
    assert metrics(run(first, 0)) == {"svc": (2, 3.0, 0.5, 0.0)}  # the span of nine days ago is behind the window
    for _ in range(2):  # a repeated batch replaces itself
        assert metrics(run(late, 1)) == {"svc": (3, 4.0, 1 / 3, 0.0), "other": (1, 8.0, 0.0, 0.0)}
    assert metrics(run(future, 2)) == metrics(run(late.limit(0), 3)) == {"svc": (3, 4.0, 1 / 3, 0.0), "other": (1, 8.0, 0.0, 0.0)}
    found = partials.DayStore(spark, store).versions()
    # Days that only batch 0 brought keep its version; superseded ones are gone.
    assert found == [(0, date(2024, 2, 28)), (1, date(2024, 2, 27)), (1, date(2024, 3, 1))]


def test_days_behind_the_window_are_deleted(spark, make_spans, now, services, tmp_path):
    store = str(tmp_path / "days")
    for n in range(12):
        partials.step(make_spans([((11 - n) * 1_440, {"latency": 5.0})]), n, store, services, 3, None)
        assert len(partials.DayStore(spark, store).versions()) <= 3
    assert sorted(d for _, d in partials.DayStore(spark, store).versions()) == [date(2024, 2, 28), date(2024, 2, 29), date(2024, 3, 1)]


def test_no_spans_no_window(make_spans, services, tmp_path):
    assert partials.step(make_spans([(0, {})]).limit(0), 0, str(tmp_path / "d"), services, 3, None) is None


def test_latency_sketch_is_close(spark, make_spans, services, tmp_path):
    spans = make_spans([(i / 10, {"latency": float(i)}) for i in range(4_000)])
    row = partials.step(spans, 0, str(tmp_path / "d"), services, 30, None).first()
    assert row["p95_latency"] == pytest.approx(3_800, abs=60) and row["null_rate"] == 1.0 and row["metric"] is None


def test_a_stray_date_does_not_fill_centuries(spark):
    rows = spark.createDataFrame([("a", datetime(1, 1, 2)), ("a", datetime(2024, 1, 1)), ("a", datetime(2024, 1, 3))], "k string, time timestamp")
    found = trends.day_over_day(rows, ["k"]).orderBy("day").collect()
    assert len(found) == 401 + 3 and [(r["n"], r["previous"]) for r in found[-3:]] == [(1, 0), (0, 1), (1, 0)]


def test_an_unknown_family_is_not_confirmed(spark):
    feed = spark.createDataFrame([("s", None, 1.0)], "service string, family string, prediction double")
    expected = spark.createDataFrame([("s", None, 1.0)], "service string, family string, mean double")
    row = validation.feed_checks(feed, expected).first()
    assert (row["identity"], row["passed"]) == (False, False)


def test_a_value_spelt_like_the_rest(spark):
    values = [profiles.REST] * 5 + ["a"] * 3 + ["b", "c"]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    shares = profiles.attribute_distributions(profiles.categorical_profile(frame, ["v"], 2)).first()["distribution"]
    assert shares == pytest.approx({profiles.REST: 0.7, "a": 0.3})
    alone = profiles.attribute_distributions(profiles.categorical_profile(frame.where(F.col("v") != profiles.REST), ["v"], 1)).first()["distribution"]
    assert alone == pytest.approx({"a": 0.6, profiles.REST: 0.4})
