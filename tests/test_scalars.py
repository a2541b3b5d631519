import pytest
from pyspark.sql import functions as F

from spanvigil.functions import scalars as sc


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_segment_key_and_numbers(spark):
    rows = [("184.0",), ("184",), ("1.50",), ("web",), ("",), ("nan",), ("1d",), (None,), ("-3.0",), ("1e3",)]
    keys = values(spark, sc.segment_key(F.col("v")), rows, "v string")
    assert keys == ["184", "184", "1.5", "web", "", "nan", "1d", None, "-3", "1000"]
    numbers = values(spark, sc.safe_double(F.col("v")), rows, "v string")
    assert numbers == [184.0, 184.0, 1.5, None, None, None, None, None, -3.0, 1000.0]


def test_ratio_directions(spark):
    rows = [(300.0, 150.0, "lower_is_better"), (0.5, 0.9, "higher_is_better"), (0.0, 2.0, "lower_is_better"), (None, 2.0, "lower_is_better")]
    column = sc.worse_ratio(F.col("v"), F.col("b"), F.col("d"))
    assert values(spark, column, rows, "v double, b double, d string") == [2.0, 1.8, 0.0, 0.0]


def test_bands(spark):
    assert values(spark, sc.psi_band(F.col("p"), 0.1, 0.25), [(0.25,), (0.1,), (0.09,)], "p double") == ["critical", "warning", "healthy"]
    assert values(spark, sc.drift_severity(F.col("p"), 0.1, 0.25), [(0.3,), (9.0,), (0.2,), (0.0,)], "p double") == [0.6, 1.0, 0.4, 0.0]
    assert values(spark, sc.confidence_band(F.col("p")), [(0.85,), (0.6,), (0.59,)], "p double") == ["high", "medium", "low"]


def test_labels_and_paths(spark):
    rows = [("region=a=b",), ("overall",)]
    assert values(spark, sc.segment_attribute(F.col("s")), rows, "s string") == ["region", None]
    assert values(spark, sc.segment_value(F.col("s")), rows, "s string") == ["a=b", None]
    paths = [("/home/x/model/train/run.py", "team/model"), ("/tmp/run.py", "team/model"), (None, "team/model")]
    assert values(spark, sc.repo_relative_path(F.col("p"), F.col("r")), paths, "p string, r string") == ["train/run.py", None, None]
    patterns = [("seq_len",), ("Overall",), ("",), (None,), ("none",)]
    assert values(spark, sc.is_meaningful_pattern(F.col("p")), patterns, "p string") == [True, False, False, False, False]


@pytest.mark.parametrize("name", ["predictions", "public.eta_rows", "t1_2"])
def test_plain_table_names(name):
    assert sc.assert_table_identifier(name) == name


@pytest.mark.parametrize("name", ["", None, "a.b.c", "t; drop table x", "a b", "a-b", "a.", "x'--"])
def test_other_table_names(name):
    with pytest.raises(ValueError):
        sc.assert_table_identifier(name)


def test_rounding_of_the_scaled_value(spark):
    assert values(spark, sc.round_to(F.col("v"), 2), [(0.575,), (2.675,), (0.125,), (-0.125,), (None,)], "v double") == [0.57, 2.68, 0.13, -0.13, None]
