"""Modes of training columns with more values than a baseline lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanvigil import settings as st
from spanvigil.operators import baselines, profiles


def test_the_rest_is_no_mode(spark):
    values = ["top"] * 10 + [f"v{n:02d}" for n in range(60) for _ in range(2)]
    training = profiles.training_baseline(spark.createDataFrame([(v,) for v in values], "city string"), "svc", "v1", "2024-01-01")
    shares = training.first()["attribute_distributions"]["city"]
    assert max(shares, key=shares.get) == profiles.REST
    services = st.services_frame(spark, [st.ServiceSettings("svc")])
    assert baselines.resolve_baselines(services, training).first()["expected"] == {"city": "top"}


def test_a_value_of_that_name(spark):
    frame = spark.createDataFrame([({profiles.REST: 1.0},), ({"a": 0.2, profiles.REST: 0.8},), ({"b": 0.5, "a": 0.5},)], "d map<string,double>")
    assert [r[0] for r in frame.select(baselines.modal_key(F.col("d"))).collect()] == [profiles.REST, "a", "a"]
