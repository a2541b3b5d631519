"""Word pairs of the quality model; seeds of texts that repeat one word."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from spanvigil.llm import decontaminate, quality_model

from tests.llm.test_record_operators import tiling_brute


def test_quality_scores_equal_a_plain_sum(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "bé", "long-word", "x1", "the"]) for _ in range(rng.randint(0, 30))) for _ in range(40)] + ["", "one", "w " * 50_000]
    model = quality_model.QualityModel().learn([t.encode() for t in texts[:30]], [n % 2 for n in range(30)])
    parts, start = model.scalars()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality_model.quality_scores(docs, None, model=model).collect()}
    for n, text in enumerate(texts):
        words = text.encode().split()
        rows = [r for w in words for r in quality_model.word_features(w)]
        for left, right in zip(words, words[1:]):
            pair = np.array([zlib.crc32(left), zlib.crc32(right)], np.uint64)
            rows += [int(quality_model.pair_rows(pair)[0])] * quality_model.PAIR_WEIGHT
        odds = start + (sum(parts[r] for r in rows) / len(rows) if rows else 0.0)
        assert abs(got[n] - 1 / (1 + np.exp(-odds))) < 1e-9


def test_every_pair_has_a_row_and_order_counts():
    codes = np.array([zlib.crc32(w) for w in (b"a", b"b", b"a", b"c", b"c", b"d", b"d")], np.uint64)
    ab, ba, ac, cc, cd, dd = quality_model.pair_rows(codes)
    assert len({ab, ba, ac, cd}) == 4 and cc == dd == quality_model.BUCKETS + quality_model.PAIRS
    assert all(quality_model.BUCKETS <= row < cc for row in (ab, ba, ac, cd))


def test_seed_runs_in_shares_equal_the_definition(monkeypatch):
    rng = random.Random(18)
    for held in (1, 3, 7, 1 << 18):
        monkeypatch.setattr(decontaminate, "PAIRS_HELD", held)
        for _ in range(40):
            items = [[rng.choice("ab") for _ in range(rng.randint(1, 12))] for _ in range(3)]
            text = [rng.choice("ab") for _ in range(rng.randint(0, 25))]
            block = decontaminate.BenchmarkBlock([(n, " ".join(item).encode()) for n, item in enumerate(items)], seed=3)
            codes = np.array([block.codes[w.encode()] for w in text], np.int64)
            covered = {n: sum(t[0] for t in decontaminate.tile(block.words[n], codes, i, j, seed)) for n, seed, i, j in block.pairs(codes)}
            for n, item in enumerate(items):
                assert covered.get(n, 0) == tiling_brute(item, text, min(3, len(item)))


def test_one_word_repeated_in_text_and_item():
    block = decontaminate.BenchmarkBlock([(1, b"w " * 300), (2, b"w " * 150 + b"v " * 150)])
    codes = np.full(50_000, block.codes[b"w"], np.int64)
    tracemalloc.start()
    found = {n: decontaminate.tile(block.words[n], codes, i, j, seed) for n, seed, i, j in block.pairs(codes)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [t[0] for t in found[0]] == [300] and [t[0] for t in found[1]] == [150]
    assert peak < 120 << 20


def test_repeated_rows_and_ties_of_items(spark):
    passage = " ".join(f"k{n}" for n in range(12))
    docs = spark.createDataFrame([(1, passage), (1, passage), (None, passage + " x"), (2, "y " * 60_000 + passage)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, passage), (5, passage), (6, passage.upper()), (None, "y y y y y y")], "item_id long, text string")
    rows = decontaminate.contaminated_pairs(docs, bench, block_bytes=60).collect()
    got = sorted((str(r.doc_id), str(r.item_id), r.covered_words) for r in rows)
    expected = sorted([(d, i, 12) for d in ("1", "1", "None", "2") for i in ("5", "5", "6")] + [("2", "None", 6)])
    assert got == expected


def test_sums_of_many_new_words_equal_their_features():
    parts = np.random.default_rng(5).normal(size=quality_model.BUCKETS + quality_model.PAIRS + 1)
    words = [b"a", b"<>", b"b>", "ü中".encode(), b"\xff\x00\x80", b"long" * 500, *(b"w%d" % n for n in range(300))]
    sums, counts = quality_model.word_sums(words, parts)
    plain = [quality_model.word_features(word) for word in words]
    assert counts.tolist() == [len(rows) for rows in plain]
    assert np.allclose(sums, [parts[rows].sum() for rows in plain], rtol=1e-12, atol=1e-12)


def test_quality_scores_do_not_depend_on_what_is_worked_on_together(monkeypatch):
    parts = np.random.default_rng(6).normal(size=quality_model.BUCKETS + quality_model.PAIRS + 1)
    texts = [b"", b"one", *(b" ".join(b"w%d" % (n * k % 97) for k in range(n)) for n in range(40)), b" ", b"w1 w1 w1"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([False] * len(texts))], names=["a", "b", "c"])

    def scores(batches) -> list[float]:
        return [x for out in quality_model._score(parts, 0.25)(iter(batches)) for x in out.column(2).to_pylist()]

    together = scores([batch])
    for name, bound in (("_GROUP_BYTES", 1), ("_GROUP_WORDS", 3), ("_REMEMBERED", 5)):
        monkeypatch.setattr(quality_model, name, bound)
        assert np.allclose(scores([batch.slice(0, 0), batch.slice(0, 7), batch.slice(7)]), together, rtol=1e-12)
    assert together[0] == together[-2] == 1 / (1 + np.exp(-0.25))
