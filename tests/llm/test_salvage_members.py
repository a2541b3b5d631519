"""Salvage inside members that hold many records, and how archives are dealt."""

from __future__ import annotations

import gzip

import pyarrow as pa
import pytest

from spanvigil.llm import warc
from spanvigil.llm.text import each, small


def five(damaged: int) -> bytes:
    parts = [warc.record(n, f"http://x/{n}", b"page %d" % n * 50, warc.base32_sha1(b"page %d" % n * 50), None) for n in range(5)]
    parts[damaged] = parts[damaged].replace(b"page %d" % damaged, b"lost %d" % damaged, 1)
    return b"".join(parts)


@pytest.mark.parametrize("damaged", range(5))
def test_one_bad_record_does_not_take_its_member(damaged):
    data = gzip.compress(five(damaged))
    found = list(warc.salvage(pa.BufferReader(data), len(data)))
    assert [what[0] for kind, _, _, what in found if kind == "record"] == [n for n in range(5) if n != damaged]
    gaps = [what for kind, _, _, what in found if kind == "gap"]
    assert len(gaps) == 1 and "digest" in gaps[0] and "inflated bytes" in gaps[0]
    assert {(a, b) for _, a, b, _ in found} == {(0, len(data))}


def test_a_member_without_records_is_a_gap():
    data = gzip.compress(b"nothing of the kind") + gzip.compress(five(0))
    found = list(warc.salvage(pa.BufferReader(data), len(data)))
    assert [kind for kind, *_ in found] == ["gap", *["record"] * 4, "gap"] and found[0][3] == "version line"


def test_archives_are_dealt_over_tasks(spark, tmp_path):
    for n in range(18):
        (tmp_path / f"{n}.warc.gz").write_bytes(gzip.compress(five(2)))
    paths = spark.createDataFrame([(f"{n}.warc.gz",) for n in range(18)], "path string")
    rows = warc.read_archives(paths, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 18
    assert rows.where("kind = 'record'").count() == 18 * 4 and rows.where("kind = 'gap'").count() == 18


def test_round_trip_of_clashing_columns_and_a_long_page(spark, tmp_path):
    rows = [(1, "u", "x" * 3_000_000, "a", "b"), (2, None, None, "a", "b"), (3, "u\r\nv", "x" * 3_000_000, "a", "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string, kind string")
    found = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages, str(tmp_path / "w")).collect()}
    assert found == {1: (3_000_000, "revisit", 3), 2: (0, "response", None), 3: (3_000_000, "response", None)}


def test_small_batches_hold_all_rows():
    batch = pa.RecordBatch.from_pydict({"a": list(range(1_000)), "b": ["t" * 100] * 1_000})
    parts = list(small([batch], byte_bound=10_000))
    assert len(parts) > 5 and sum(p.num_rows for p in parts) == 1_000
    assert [row for part in parts for row in each(part, 0, 1)] == list(zip(range(1_000), ["t" * 100] * 1_000))
