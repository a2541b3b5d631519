import pytest
from pyspark.sql import functions as F

from spanvigil import settings as st
from spanvigil.operators import baselines, calibration, custom_metrics, decision, reliability
from spanvigil.operators.attributes import attribute_counts
from spanvigil.operators.halves import with_halves
from spanvigil.plans.health import health_tables
from spanvigil.session import materialise

ERROR = {"evals": {"error": 10.0}}


def battery(spark, spans, now, lookback=60, **options):
    services = st.services_frame(spark, [st.ServiceSettings("svc", lookback_minutes=lookback, **options)])
    split = materialise(with_halves(spans))
    counts = materialise(attribute_counts(split, services))
    profile = reliability.half_profile(split, services)
    inputs = reliability.battery_inputs(profile, counts, services)
    return {r["check"]: r for r in reliability.reliability_signals(inputs, F.lit(now)).collect()}


def test_volume_drop_is_critical(spark, make_spans, now):
    rows = [(55 - i * 0.1, ERROR) for i in range(20)] + [(1, ERROR)]
    assert battery(spark, make_spans(rows), now)["volume_drop"]["status"] == "CRITICAL"
    assert "volume_drop" not in battery(spark, make_spans(rows), now, disabled_checks=("volume_drop",))
    assert battery(spark, make_spans(rows), now, battery_enabled=False) == {}


def test_silence_needs_half_the_window(spark, make_spans, now):
    old = make_spans([(58, ERROR), (55, ERROR), (50, ERROR), (45, ERROR)])
    assert battery(spark, old, now)["silence"]["status"] == "WARNING"
    assert "silence" not in battery(spark, make_spans([(58, ERROR), (40, ERROR), (20, ERROR), (1, ERROR)]), now)


def test_error_null_and_latency(spark, make_spans, now):
    rows = []
    for i in range(20):
        late = i >= 10
        rows.append((55 - i * 2.5, {"status": "ERROR" if i % 2 else "OK", "evals": {} if i % 2 else {"error": 1.0}, "latency": 300.0 if late else 100.0}))
    found = battery(spark, make_spans(rows), now)
    assert found["error_rate"]["status"] == "CRITICAL" and found["error_rate"]["current_value"] == 0.5
    assert found["null_rate"]["status"] == "WARNING"
    assert found["latency_drift"]["status"] == "CRITICAL" and found["latency_drift"]["current_value"] == 3.0


def test_input_output_and_schema_drift(spark, make_spans, now):
    rows = []
    for i in range(20):
        late = i >= 10
        inputs = {"region": "eu" if late else "us", **({} if late else {"flag": "y"})}
        rows.append((55 - i * 2.5, {"inputs": inputs, "outputs": {"prediction": "9" if late else "1"}, "evals": {"error": 1.0}}))
    found = battery(spark, make_spans(rows), now)
    assert found["input_drift_auto"]["status"] == "CRITICAL" and "input.region" in found["input_drift_auto"]["detail"]
    assert "input.flag" in found["schema_drift"]["detail"]
    # a numeric output that was constant in the earlier half has no bins: index 0
    assert "output_drift" not in found


def test_steady_window_raises_nothing(spark, make_spans, now):
    rows = [(58 - i * 1.45, {"inputs": {"region": "us"}, "evals": {"error": 1.0}, "latency": 5.0}) for i in range(40)]
    assert battery(spark, make_spans(rows), now) == {}


def test_three_spans_have_no_halves(spark, make_spans, now):
    split = with_halves(make_spans([(50, ERROR), (30, ERROR), (10, ERROR)]))
    assert {r["half"] for r in split.collect()} == {None}


FACTS = "service string, n_spans long, overall_ratio double, segment_ratio double, worst_psi double, lookback_minutes int"


@pytest.mark.parametrize(
    ("facts", "status", "action", "severity"),
    [
        ((0, None, None, 0.0, 5), "WARNING", "ALERT_HUMAN", 0.5),
        ((0, None, None, 0.0, 60), "CRITICAL", "ALERT_HUMAN", 0.85),
        ((10, None, None, 0.9, 60), "WARNING", "INVESTIGATE", 0.4),
        ((100, 1.58, 4.21, 0.0, 60), "CRITICAL", "ALERT_HUMAN", 0.84),
        ((100, 1.3, 1.1, 0.0, 60), "WARNING", "INVESTIGATE", 0.33),
        ((100, 1.0, 1.0, 0.3, 60), "CRITICAL", "ALERT_HUMAN", 0.6),
        ((100, 0.9, None, 0.05, 60), "HEALTHY", "MONITOR", 0.0),
    ],
)
def test_decision(spark, facts, status, action, severity):
    limits = {"warning_ratio": 1.2, "critical_ratio": 2.0, "psi_warning": 0.1, "psi_critical": 0.25}
    frame = spark.createDataFrame([("s", *facts)], FACTS).withColumns({k: F.lit(v) for k, v in limits.items()})
    row = decision.decide(frame).first()
    assert (row["status"], row["action"]) == (status, action)
    assert row["severity"] == pytest.approx(severity, abs=0.011)


def test_escalation_never_lowers(spark):
    base = spark.createDataFrame([("a", "HEALTHY", 0.0, "MONITOR", "fine"), ("b", "CRITICAL", 0.9, "ALERT_HUMAN", "bad"), ("c", "HEALTHY", 0.0, "MONITOR", "fine")], "service string, status string, severity double, action string, reason string")
    signals = spark.createDataFrame([("a", 1, "volume_drop", "CRITICAL", 0.85, "d"), ("a", 2, "silence", "WARNING", 0.55, "d"), ("b", 2, "silence", "WARNING", 0.55, "d")], "service string, position int, check string, status string, severity double, detail string")
    rows = {r["service"]: r for r in decision.escalate(base, reliability.worst_status(signals)).collect()}
    assert (rows["a"]["status"], rows["a"]["severity"], rows["a"]["action"], rows["a"]["n_signals"]) == ("CRITICAL", 0.85, "ALERT_HUMAN", 2)
    assert "volume_drop" in rows["a"]["reason"]
    assert (rows["b"]["status"], rows["b"]["severity"]) == ("CRITICAL", 0.9)
    assert (rows["c"]["status"], rows["c"]["n_signals"]) == ("HEALTHY", 0)


def metric(spark, spans, *specs):
    services = st.services_frame(spark, [st.ServiceSettings("svc")])
    split = materialise(with_halves(spans))
    asked = st.metric_specs_frame(spark, [st.MetricSpec("svc", **s) for s in specs])
    counts = materialise(attribute_counts(split, services, asked))
    table = custom_metrics.custom_metrics(counts, reliability.half_profile(split, services), asked)
    return {(r["name"], r["segment"]): r for r in table.collect()}


def test_custom_metrics(spark, make_spans):
    rows = [(55 - i * 2.5, {"inputs": {"tier": "a" if i % 2 else "b"}, "evals": {"ms": 100.0 if i < 10 else 300.0, "ok": float(i < 10)}}) for i in range(20)]
    found = metric(
        spark, make_spans(rows),
        dict(name="p95", attribute="eval.ms", agg="p95"),
        dict(name="mean", attribute="eval.ms", agg="mean", baseline=100.0),
        dict(name="accuracy", attribute="eval.ok", agg="rate", direction=st.HIGHER, baseline=1.0),
        dict(name="traffic", attribute="eval.nothing", agg="count"),
        dict(name="steady", attribute="eval.nothing", agg="count", baseline_scale="rate"),
        dict(name="absent", attribute="eval.nothing", agg="mean"),
        dict(name="tiers", attribute="eval.ms", agg="mean", segment_by="input.tier"),
        dict(name="nulls", attribute="eval.ok", agg="null_rate"),
    )
    assert (found["p95", ""]["value"], found["p95", ""]["baseline"], found["p95", ""]["ratio"], found["p95", ""]["status"]) == (300.0, 100.0, 3.0, "CRITICAL")
    assert (found["mean", ""]["value"], found["mean", ""]["status"]) == (200.0, "CRITICAL")
    assert (found["accuracy", ""]["value"], found["accuracy", ""]["ratio"]) == (0.5, 2.0)
    assert found["traffic", ""]["ratio"] == 2.0 and found["steady", ""]["ratio"] == 1.0
    assert ("absent", "") not in found
    assert {k[1] for k in found if k[0] == "tiers"} == {"a", "b"}
    assert (found["nulls", ""]["value"], found["nulls", ""]["ratio"], found["nulls", ""]["status"]) == (0.0, 0.0, "HEALTHY")


def test_metric_without_halves_reports_the_value(spark, make_spans):
    row = metric(spark, make_spans([(1, {"evals": {"ms": 5.0}})]), dict(name="m", attribute="eval.ms"))["m", ""]
    assert (row["value"], row["baseline"], row["ratio"], row["status"]) == (5.0, None, None, "HEALTHY")


def calibrated(spark, spans, now):
    services = st.services_frame(spark, [st.ServiceSettings("svc", lookback_minutes=60, attributes_of_interest=("region",), segments=("input.region", "input.missing"))])
    split = materialise(with_halves(spans))
    counts = materialise(attribute_counts(split, services))
    profile = materialise(reliability.half_profile(split, services))
    signals = reliability.reliability_signals(reliability.battery_inputs(profile, counts, services), F.lit(now))
    return services, counts, calibration.calibrate(counts, profile, services, signals)


def test_calibration_and_auto_baseline(spark, make_spans, now):
    one = {"inputs": {"region": "us"}, "evals": {"error": 12.0}, "version": "v3"}
    services, counts, row = calibrated(spark, make_spans([(59 - i * 0.99, one) for i in range(60)]), now)
    first = row.first()
    assert (first["n_spans"], first["metric"], first["per_hour"], first["model_version"], first["attribute_modes"]) == (60, 12.0, 60.0, "v3", {"region": "us"})
    none = spark.createDataFrame([], "service string")
    assert [r["outcome"] for r in calibration.auto_baseline(row, none).collect()] == ["established"]
    assert calibration.auto_baseline(row, services).count() == 0
    assert calibration.auto_baseline(row, none, min_spans=61).count() == 0
    present = {r["attr"]: r["present"] for r in calibration.schema_check(counts, services).collect()}
    assert present == {"eval.error": True, "input.region": True, "input.missing": False}


def test_unhealthy_window_is_not_a_baseline(spark, make_spans, now):
    one = {"inputs": {"region": "us"}, "evals": {"error": 12.0}}
    _, _, row = calibrated(spark, make_spans([(59 - i * 0.01, one) for i in range(55)] + [(1, one)]), now)
    assert [r["outcome"] for r in calibration.auto_baseline(row, spark.createDataFrame([], "service string")).collect()] == ["deferred"]


def test_baseline_chain(spark):
    services = st.services_frame(
        spark,
        [st.ServiceSettings("a", explicit_baseline=150.0), st.ServiceSettings("b"), st.ServiceSettings("c", attribute_baselines={"k": "1"}), st.ServiceSettings("d"), st.ServiceSettings("e", configured_baseline=90.0), st.ServiceSettings("f")],
    )
    training = spark.createDataFrame(
        [("a", "v1", {"mae_minutes": 10.0}, {"k": {"x": 0.4, "y": 0.6}}), ("b", "v2", {"mae_minutes": 20.0}, {"k": {"x": 0.5, "y": 0.5}, "empty": {}}), ("c", "v3", {}, {})],
        "service string, model_version string, metrics map<string,double>, attribute_distributions map<string,map<string,double>>",
    )
    calibrations = spark.createDataFrame([("c", "t1", 30.0, {}, "v9"), ("b", "t0", 5.0, {"k": "z"}, None)], "service string, generated_at string, metric double, attribute_modes map<string,string>, model_version string")
    rolling = spark.createDataFrame([("d", 40.0, True), ("e", 4.0, False)], "service string, mae double, usable boolean")
    rows = {r["service"]: r for r in baselines.resolve_baselines(services, training, calibrations, rolling).collect()}
    assert {s: (r["baseline"], r["baseline_source"]) for s, r in rows.items()} == {
        "a": (150.0, "explicit"), "b": (20.0, "training@v2"), "c": (30.0, "calibration@t1"), "d": (40.0, "rolling:7d"), "e": (90.0, "configured"), "f": (150.0, "default"),
    }
    assert rows["a"]["expected"] == {"k": "y"} and rows["b"]["expected"] == {"k": "x"} and rows["c"]["expected"] == {"k": "1"}
    assert rows["b"]["baseline_version"] == "v2" and rows["c"]["baseline_version"] == "v9"
    plain = {r["service"]: r["baseline_source"] for r in baselines.resolve_baselines(services).collect()}
    assert plain == {"a": "explicit", "b": "default", "c": "default", "d": "default", "e": "configured", "f": "default"}


def test_training_lookup(spark):
    artifacts = spark.createDataFrame([("s", "v1", "2024-01-01"), ("s", "v2", "2024-02-01"), ("t", "v1", "2024-01-01")], "service string, model_version string, trained_at string")
    wanted = spark.createDataFrame([("s", "v1"), ("t", "v9")], "service string, wanted_version string")
    assert {r["service"]: r["model_version"] for r in baselines.training_lookup(artifacts, wanted).collect()} == {"s": "v1", "t": "v1"}
    newest = wanted.withColumn("wanted_version", F.lit(None).cast("string"))
    assert {r["service"]: r["model_version"] for r in baselines.training_lookup(artifacts, newest).collect()} == {"s": "v2", "t": "v1"}


def test_snapshot_of_a_fleet(spark, make_spans, now):
    """A service without spans still gets a verdict; lookbacks differ per service."""
    rows = [(50 - i, {"service": "busy", "inputs": {"region": "us"}, "evals": {"error": 400.0}}) for i in range(40)]
    rows += [(30 - i, {"service": "short", "evals": {"error": 1.0}}) for i in range(30)]
    services = st.services_frame(spark, [st.ServiceSettings("busy", lookback_minutes=60, segments=("input.region",)), st.ServiceSettings("short", lookback_minutes=10), st.ServiceSettings("gone", lookback_minutes=60)])
    specs = st.metric_specs_frame(spark, [])
    tables = health_tables(make_spans(rows), services, specs, baselines.resolve_baselines(services), F.lit(now), 60)
    found = {r["service"]: r for r in tables.snapshot.collect()}
    assert (found["gone"]["status"], found["gone"]["n_spans"], found["gone"]["severity"]) == ("CRITICAL", 0, 0.85)
    assert (found["busy"]["status"], found["busy"]["overall_ratio"], found["busy"]["n_bad_segments"]) == ("CRITICAL", 2.67, 1)
    assert found["short"]["n_spans"] == 10
    anomalies = decision.anomalies(tables.segments, tables.psi, tables.silent, tables.signals, tables.metrics).collect()
    assert {("busy", "mae", "region=us"), ("gone", "prediction_volume", "overall")} <= {(a["service"], a["metric"], a["segment"]) for a in anomalies}
