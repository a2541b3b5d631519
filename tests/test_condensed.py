"""Condensed count tables give the answers of whole ones."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanvigil import settings as st
from spanvigil.operators import attributes, condensed, custom_metrics, drift, reliability
from spanvigil.operators.attributes import attribute_counts, configured_counts
from spanvigil.operators.baselines import resolve_baselines
from spanvigil.operators.halves import with_halves
from spanvigil.plans.health import health_tables
from spanvigil.session import materialise

SPECS = [
    st.MetricSpec("svc", name="p95", attribute="eval.ms", agg="p95"),
    st.MetricSpec("svc", name="mean", attribute="input.amount", agg="mean"),
    st.MetricSpec("svc", name="nulls", attribute="input.amount", agg="null_rate", segment_by="input.tier"),
    st.MetricSpec("svc", name="tiers", attribute="input.amount", agg="p50", segment_by="input.tier"),
    st.MetricSpec("svc", name="sum", attribute="eval.ms", agg="sum", segment_by="model_version"),
]


@pytest.fixture(scope="module")
def split(make_spans):
    rng = random.Random(5)
    rows = []
    for i in range(1_200):
        inputs = {"amount": str(rng.gauss(0, 5) + (i > 600)), "tier": rng.choice(["a", "b", "2.0"]), "few": str(rng.randrange(4))}
        inputs["gap"] = str(rng.random() if i > 600 or i % 2 else 100 + rng.random())
        inputs["mixed"] = "?" if rng.random() < 0.05 else str(rng.expovariate(1))
        inputs["words"] = rng.choice(["x", "y"]) + str(rng.randrange(900)) + "w"
        if i % 7 == 0:
            inputs["amount"] = None
        rows.append((1_200 - i, {"inputs": inputs, "outputs": {"prediction": str(round(rng.random(), 2))}, "evals": {"error": rng.random(), "ms": rng.paretovariate(1)}, "latency": rng.paretovariate(2), "version": "1.10" if i < 900 else "1.2"}))
    return materialise(with_halves(make_spans(rows)))


@pytest.fixture(scope="module")
def both(spark, split):
    services = st.services_frame(spark, [st.ServiceSettings("svc", segments=("input.tier",))])
    specs = st.metric_specs_frame(spark, SPECS)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(condensed, "MANY_VALUES", 64)
        patch.setattr(condensed, "BITS", 6)
        table = condensed.condensed_counts(split, services, specs)
    return materialise(attribute_counts(split, services, specs)), table, reliability.half_profile(split, services), specs


def test_condensed_tables_are_smaller_and_sum_up(both):
    whole, table, *_ = both
    assert table.where("attr = 'input.amount'").count() < whole.where("attr = 'input.amount'").count()
    sums = [F.sum(c).alias(c) for c in ("n", "n_earlier", "n_recent", "present", "numeric", "nonzero_earlier", "n_error")]
    sums += [F.round(F.sum("total"), 6).alias("total"), F.round(F.sum("error_sum"), 6).alias("error_sum")]
    a, b = ({(r["attr"], r["segment"]): r for r in frame.groupBy("attr", "segment").agg(*sums).collect()} for frame in (whole, table))
    assert a == b


def test_drift_and_latency_are_the_same(both):
    whole, table, *_ = both
    found, expected = (sorted(map(tuple, drift.two_sample_psi(counts.where("attr LIKE 'input.%' OR attr LIKE 'output.%'")).collect())) for counts in (table, whole))
    assert found == expected and {kind for _, _, kind, _ in found} == {"numeric", "categorical"}
    assert reliability.latency_p95(table).collect() == reliability.latency_p95(whole).collect()


def test_custom_metrics_are_the_same(both):
    whole, table, profile, specs = both
    found, expected = (sorted(map(str, custom_metrics.custom_metrics(counts, profile, specs).collect())) for counts in (table, whole))
    assert found == expected and len(found) == 2 + 3 + 3 + 2


def test_condensed_quantiles_equal_numpy(spark, split, both):
    values = [float(r[0]) for r in split.where("half = 'earlier'").select("inputs.amount").collect() if r[0] is not None]
    rows = both[1].where("attr = 'input.amount' AND n_earlier > 0").orderBy("x").select("x", "n_earlier").collect()
    expanded = np.repeat([r[0] for r in rows], [r[1] for r in rows])
    wanted = condensed.WANTED["_earlier"]
    assert len(expanded) == len(values) and np.allclose(np.quantile(expanded, wanted), np.quantile(values, wanted), rtol=0, atol=0)


def test_configured_counts_hold_only_what_settings_name(spark, split, both):
    services = st.services_frame(spark, [st.ServiceSettings("svc", segments=("input.tier", "latency_ms"), attributes_of_interest=("few",))])
    columns = ["attr", "value", "n", "n_earlier", "n_error", F.round("error_sum", 6)]
    found = configured_counts(split, services).select(*columns).collect()
    assert {r["attr"] for r in found} == {"input.tier", "input.few", "latency_ms", "model_version"}
    expected = both[0].where("attr IN ('input.tier', 'input.few', 'latency_ms', 'model_version')").select(*columns).collect()
    assert sorted(map(str, found)) == sorted(map(str, expected))


def test_the_snapshot_reads_the_spans_three_times(spark, make_spans, now):
    spans = materialise(make_spans([(59 - i * 0.9, {"inputs": {"a": str(i)}, "evals": {"error": float(i)}, "latency": float(i)}) for i in range(60)]))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    services = st.services_frame(spark, [st.ServiceSettings("svc", lookback_minutes=60, segments=("input.a",))])
    specs = st.metric_specs_frame(spark, SPECS)
    tables = health_tables(spans.mapInArrow(counted, spans.schema), services, specs, resolve_baselines(services), F.lit(now), 60)
    row = tables.snapshot.collect()[0]
    assert row["n_spans"] == 60 and read.value == 3 * 60


def test_one_quantile_table_serves_all_checks(both):
    whole, table, profile, specs = both
    shared = materialise(condensed.attribute_quantiles(table))
    features = table.where("attr LIKE 'input.%' OR attr LIKE 'output.%'")
    for found, expected in (
        (drift.two_sample_psi(features, shared), drift.two_sample_psi(features)),
        (reliability.latency_p95(table, shared), reliability.latency_p95(whole)),
        (custom_metrics.custom_metrics(table, profile, specs, shared), custom_metrics.custom_metrics(whole, profile, specs)),
    ):
        assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_spans_are_taken_apart_once(spark, make_spans):
    """Entries are built once a span; measured numbers are not printed and read again;
    no range is searched by an interpreted step."""
    services = st.services_frame(spark, [st.ServiceSettings("svc", lookback_minutes=60, segments=("input.region",))])
    specs = st.metric_specs_frame(spark, [st.MetricSpec("svc", "m", "input.a", agg="p50", segment_by="input.region")])
    evals = {"error": 0.1, "nan": float("nan"), "inf": float("-inf"), "none": None, "big": 1e300}
    rows = [(i, {"inputs": {"region": "1.50", "a": "7"}, "outputs": None, "evals": evals if i else None, "latency": -0.0 if i else None, "version": "1.10"}) for i in range(2)]
    frame = make_spans(rows).withColumn("half", F.lit("earlier"))
    found = attributes.attribute_rows(frame, services, specs)
    named = {(r["attr"], r["segment"]): (r["value"], r["x"]) for r in found.where("error IS NOT NULL").collect()}
    assert named == {
        ("input.region", ""): (None, 1.5), ("input.a", ""): (None, 7.0), ("eval.error", ""): (None, 0.1), ("eval.nan", ""): ("NaN", None),
        ("eval.inf", ""): ("-Infinity", None), ("eval.big", ""): (None, 1e300), ("latency_ms", ""): (None, 0.0), ("model_version", ""): ("1.10", None), ("metric:m", "1.5"): (None, 7.0),
    }
    assert sorted(r["attr"] for r in found.where("error IS NULL").collect()) == ["input.a", "input.region", "metric:m", "model_version"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("map_entries(inputs") == 1
    profile = condensed.attribute_profile(found, services)
    ranges = condensed.range_counts(found.select("service", "attr", "segment", "half", "error", "value", "x"), profile)
    assert "range" in ranges.columns and "aggregate(" not in ranges._jdf.queryExecution().analyzed().toString()


def test_rows_are_placed_and_found_without_lambdas(spark, split, monkeypatch):
    """What runs for each attribute or number is compiled, and a search stands once in a plan."""
    services = st.services_frame(spark, [st.ServiceSettings("svc", segments=("input.tier",))])
    written = []

    def noted(frame):
        written.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return materialise(frame)

    monkeypatch.setattr(condensed, "MANY_VALUES", 64)
    monkeypatch.setattr(condensed, "materialise", noted)
    condensed.condensed_counts(split, services)
    rows, last = written[0], written[-1]
    assert "lambda" not in rows
    assert "exists(" not in last and "lambda" not in last and last.count("element_at(cuts") == condensed.BITS
