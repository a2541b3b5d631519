"""The registered queries: next to SQL where there is any, else complete and repeatable."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from spanvigil.llm.queries import ORACLES, QUERIES
from workload.compare import difference, oracle_connection

SF_DIR = "/root/testdata/sf0.001"
PER_DOCUMENT = ("op1_personal_data", "op2_lattice_score", "op4_quality_model", "op5_licence_scan", "op6_quality_rules", "op7_jaccard_join", "op9_substring_dedup", "op10_mixing")


def test_registration():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, name):
    assert difference(spark, oracle_connection(SF_DIR), QUERIES[name], ORACLES[name], SF_DIR)[0] is None


@pytest.mark.parametrize("name", sorted(set(PER_DOCUMENT) - set(ORACLES)))
def test_whole_and_repeatable(spark, name):
    ids = sorted(r[0] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect())
    first, again = (sorted(map(str, QUERIES[name](spark, SF_DIR).collect())) for _ in range(2))
    assert len(first) == len(ids) and first == again
