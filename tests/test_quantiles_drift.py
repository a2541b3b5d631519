import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanvigil.operators import drift
from spanvigil.operators.quantiles import quantiles

FRACTIONS = [0.0, 0.05, 1 / 3, 0.5, 0.95, 1.0]


def test_quantiles_match_numpy(spark):
    """Groups of very different size and shape, one holding most rows."""
    rng = np.random.default_rng(7)
    groups = {
        "hot": rng.lognormal(3, 2, 20_000),
        "ties": rng.integers(0, 4, 500).astype(float),
        "narrow": 1.7e9 + rng.random(700) * 1e-3,
        "one": np.array([4.5]),
        "two": np.array([1.0, 2.0]),
        "negative": -rng.random(333) * 100,
    }
    frame = pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in groups.items()])
    rows = quantiles(spark.createDataFrame(frame), ["g"], "v", FRACTIONS).collect()
    assert {r["g"] for r in rows} == set(groups)
    for row in rows:
        values = groups[row["g"]]
        assert row["n"] == len(values)
        assert row["n_distinct"] == len(np.unique(values))
        np.testing.assert_allclose(row["quantiles"], np.quantile(values, FRACTIONS), rtol=1e-12)


def pandas_psi(expected, actual):
    """The index by its textbook definition, over pandas quantile bins."""
    e, a = pd.to_numeric(pd.Series(expected), errors="coerce"), pd.to_numeric(pd.Series(actual), errors="coerce")
    if e.notna().mean() > 0.8 and a.notna().mean() > 0.8:
        e, a = e.dropna(), a.dropna()
        if e.nunique() < 2:
            return 0.0
        edges = np.unique(np.quantile(e, np.linspace(0, 1, min(10, e.nunique()) + 1)))
        inner = edges[1:-1]
        e, a = np.searchsorted(inner, e, side="left"), np.searchsorted(inner, a, side="left")
    else:
        e, a = expected, actual
    shares = pd.concat([pd.Series(e).value_counts(normalize=True), pd.Series(a).value_counts(normalize=True)], axis=1).fillna(0.0).clip(lower=1e-4)
    shares.columns = ["e", "a"]
    return round(abs(float(((shares.a - shares.e) * np.log(shares.a / shares.e)).sum())), 3)


@pytest.mark.parametrize("seed", range(3))
def test_two_sample_psi_matches_pandas(spark, seed):
    rng = np.random.default_rng(seed)
    samples = {
        "input.normal": (rng.normal(0, 1, 400).round(3), rng.normal(0.4, 1.2, 300).round(3)),
        "input.few": (rng.integers(0, 3, 200), rng.integers(0, 5, 150)),
        "input.text": (rng.choice(["a", "b", "c"], 100), rng.choice(["b", "c", "d"], 120)),
        "input.constant": (np.ones(50), rng.normal(0, 1, 50).round(2)),
        "input.mostly": (np.where(rng.random(300) < 0.1, "?", rng.integers(0, 9, 300).astype(str)), rng.integers(0, 9, 200).astype(str)),
    }
    rows = []
    for attr, (old, new) in samples.items():
        for half, values in (("n_earlier", old), ("n_recent", new)):
            for value in values:
                rows.append((attr, half, str(value)))
    frame = spark.createDataFrame(rows, "attr string, half string, value string")
    from spanvigil.functions.scalars import safe_double, with_segment_key

    counts = (
        with_segment_key(frame, "value").groupBy(F.lit("s").alias("service"), "attr", "value")
        .agg(F.count_if(F.col("half") == "n_earlier").alias("n_earlier"), F.count_if(F.col("half") == "n_recent").alias("n_recent"))
        .withColumn("x", safe_double(F.col("value"))).withColumn("n", F.col("n_earlier") + F.col("n_recent"))
    )
    found = {r["attr"]: r["psi"] for r in drift.two_sample_psi(counts).collect()}
    for attr, (old, new) in samples.items():
        assert found[attr] == pytest.approx(pandas_psi(old, new), abs=1.1e-3), attr


def test_single_value_psi(spark):
    counts = spark.createDataFrame([("s", "input.limit", "184", 50), ("s", "input.limit", "73", 50)], "service string, attr string, value string, n long")
    wanted = spark.createDataFrame([("s", "limit", "184.0"), ("s", "gone", "1")], "service string, attribute string, expected string")
    row = drift.single_value_psi(counts, wanted).collect()
    expected = (0.5 - 1) * np.log(0.5) + (0.5 - 1e-4) * np.log(0.5 / 1e-4)
    assert [(r["psi"], r["band"], r["n_observed"]) for r in row] == [(round(expected, 4), "critical", 100)]
