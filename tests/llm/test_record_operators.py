"""PII, decontamination, archives, classifiers and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest

import corpus_pipeline
from spanvigil.llm import decontaminate, licence_scan, pii, quality_model, warc
from spanvigil.llm.text import read

SF = "/root/testdata/sf0.001"

# --- personal data: the contract's patterns, word for word ------------------------
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    alphabet = "a1@.+-_ (2)9%é\n0"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(6000)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (743) 555-3824", "999.1.1.1", "@@a@b.c", "000001.2.3.0255"]
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text), text


def test_base_spans_of_long_texts():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 50_000, "+" * 100_000, "1 " * 50_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def model():
    field = pii.SegmentField()
    field.learn(pii.examples_from(pii.synthetic_texts(random.Random(5))))
    return field


def test_field_adds_variants_and_leaves_numbers_alone(model):
    rng = random.Random(77)
    found = {k: 0 for k in ("phone", "plain")}
    for _ in range(20):
        number = "(%03d) %03d-%04d" % (rng.randint(200, 999), rng.randint(200, 999), rng.randint(0, 9999))
        text = f"please ring me at {number} after noon"
        base, every = pii.find_spans(text, model)
        found["phone"] += ("phone", 18, 18 + len(number)) in every
        base, every = pii.find_spans(f"in {rng.randint(1900, 2030)} there were {rng.randint(2, 900)} of them, version 2.{rng.randint(0, 9)}", model)
        found["plain"] += len(every)
    assert found["phone"] >= 16 and found["plain"] == 0


def test_program_finds_the_best_segmentation(model):
    """The dynamic program next to all segmentations of a short region."""
    text = "call +1 (743) 555-3824 or a.b@c.org"
    region = pii.region_of(text, 0, len(text))
    scores = {(i, j, y): s for j, row in model.scores(region).items() for i, y, s in row if s > 0}

    def best(at):
        if at >= len(region.tokens):
            return 0.0
        return max([best(at + 1)] + [s + best(j) for (i, j, _), s in scores.items() if i == at])

    got = sum(scores[next(k for k in scores if k[2] == y and region.tokens[k[0]][0] == a and region.tokens[k[1] - 1][1] == b)]
              for y, a, b in model.best(region))
    assert got == pytest.approx(best(0))


def test_expectations_sum(model):
    text = "x 12 y"
    region = pii.region_of(text, 0, len(text))
    assert all(0 <= p <= 1 + 1e-9 for p in model._expectations(region).values())


def test_detect(spark, small_docs, small_rows, model):
    got = pii.detect(small_docs, model=model).collect()
    want = []
    for i, t in small_rows:
        base = plain_spans(t)
        want.append((i, *[sum(k == x for x, _, _ in base) for k in pii.KINDS],
                     hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()))
    assert sorted((tuple(r[:6]) for r in got), key=repr) == sorted(want, key=repr)


def test_redact(spark, model):
    rows = [(1, "mail a.b@c.org or 1.2.3.4 now", "en", "s", 29), (2, None, None, None, None), (3, "clean text", "en", "s", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in pii.redact(docs, model=model).collect()}
    assert out[1].text == "mail [EMAIL] or [IP] now" and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[3].text == "clean text"


# --- decontamination ----------------------------------------------------------------
def tiling_brute(item, text, least):
    """Greedy tiling by its definition: the longest unmarked common run, again and again."""
    a, b = set(), set()
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and i + n not in a and j + n not in b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return len(a)
        a.update(range(best[1], best[1] + best[0]))
        b.update(range(best[2], best[2] + best[0]))


def test_tiling_equals_its_definition():
    rng = random.Random(8)
    for _ in range(150):
        item = [rng.choice("abc") for _ in range(rng.randint(1, 14))]
        text = [rng.choice("abc") for _ in range(rng.randint(0, 25))]
        block = decontaminate.BenchmarkBlock([(1, " ".join(item).encode())], seed=3)
        codes = [block.codes[w.encode()] for w in text]
        import numpy as np

        covered = 0
        for n, seed, i, j in block.pairs(np.array(codes, np.int64)):
            covered = sum(t[0] for t in decontaminate.tile(block.words[n], np.array(codes, np.int64), i, j, seed))
        assert covered == tiling_brute(item, text, min(3, len(item)))


def test_reordered_passages_are_caught(spark, small_docs):
    item = [f"q{n}" for n in range(40)]
    shuffled = item[20:] + ["x"] + item[10:20] + ["y", "z"] + item[:10]
    other = [f"p{n}" for n in range(60)]
    rows = [(1, " ".join(other + shuffled + other)), (2, " ".join(other + item[:15])), (3, " ".join(other)), (4, None), (5, " ".join(item).upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, ""), (10, "never seen here")], "item_id long, text string")
    for size in (1 << 20, 40):  # one block, and many
        got = {(r.doc_id, r.item_id): r.covered_words for r in decontaminate.contaminated_pairs(docs, bench, block_bytes=size).collect()}
        assert got == {(1, 7): 40, (5, 7): 40}
    assert decontaminate.contaminated_pairs(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated_pairs(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated_pairs(small_docs, bench).count() == 0


# --- archives -----------------------------------------------------------------------
def packed(body):
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(body) + squeeze.flush()


def an_archive(gzipped, n=12):
    parts = []
    for k in range(n):
        payload = f"<p>{k}</p>".encode() * (k * 50 + 1)
        body = warc.record(k, f"http://x/{k}", payload, warc.base32_sha1(payload), None)
        parts.append(packed(body) if gzipped else body)
    return parts


def pages_of(data):
    found = list(warc.salvage(pa.BufferReader(data), len(data)))
    at = 0
    for _, start, end, _ in found:  # every byte is accounted for
        assert start == at and end > start
        at = end
    assert at == len(data)
    return [w[0] for kind, _, _, w in found if kind == "record"], [(a, b, w) for kind, a, b, w in found if kind == "gap"]


@pytest.mark.parametrize("gzipped", [True, False])
def test_salvage(gzipped):
    parts = an_archive(gzipped)
    whole = b"".join(parts)
    assert pages_of(whole) == (list(range(12)), [])
    starts = [len(b"".join(parts[:k])) for k in range(13)]
    broken = bytearray(whole)
    broken[starts[4] + len(parts[4]) // 2] ^= 0xFF
    pages, gaps = pages_of(bytes(broken))
    assert pages == [k for k in range(12) if k != 4] and [(a, b) for a, b, _ in gaps] == [(starts[4], starts[5])]
    # cut off, junk in between, a damaged beginning, nothing valid at all
    assert pages_of(whole[: starts[11] + 5])[0] == list(range(11))
    pages, gaps = pages_of(whole[: starts[3]] + b"junk" * 100 + whole[starts[3] :])
    assert pages == list(range(12)) and len(gaps) == 1
    assert pages_of(b"\x00" * 10 + whole)[0] == list(range(12))
    assert pages_of(b"nothing here")[0] == []


def test_archives_round_trip(spark, tmp_path):
    same = "é" * 100
    rows = [(1, "u", same), (5, None, same), (3, "u\nv", same), (5, "again", same), (2, "u", None), (9, "u", ""), (None, "u", same), (4, "x", "alone" * 9999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.round_trip(pages, str(tmp_path / "a")).collect()
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        last = max((p for p, _, h in rows if p is not None and (h or "") == (html or "")), default=None)
        again = page is not None and page < last
        want.append((page, len(body), warc.base32_sha1(body), "revisit" if again else "response", last if again else None))
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert warc.round_trip(pages.limit(0), str(tmp_path / "b")).count() == 0


def test_damaged_archives_are_logged(spark, tmp_path):
    parts = an_archive(True)
    (tmp_path / "bad.warc.gz").write_bytes(parts[0] + parts[1][:-9] + parts[2])
    (tmp_path / "none.warc.gz").write_bytes(b"")
    paths = spark.createDataFrame([("bad.warc.gz",), ("none.warc.gz",)], "path string")
    rows = warc.read_archives(paths, str(tmp_path)).collect()
    assert sorted(r.page_id for r in rows if r.kind == "record") == [0, 2]
    gaps = [r for r in rows if r.kind == "gap"]
    assert [(g.start, g.stop) for g in gaps] == [(len(parts[0]), len(parts[0]) + len(parts[1]) - 9)] and gaps[0].reason


# --- classifiers --------------------------------------------------------------------
def test_quality_on_held_out_documents(spark):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    rows = quality_model.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows)
    assert len(rows) > 50 and right >= 0.97 * len(rows)


def test_quality_of_awkward_rows(spark, small_docs, small_rows):
    labels = spark.createDataFrame([(n, n % 2) for n in range(20)] + [(3, 1), (4, None), (None, 1)], "doc_id long, quality int")
    rows = quality_model.quality_scores(small_docs, labels).collect()
    assert len(rows) == len(small_rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    unlabelled = quality_model.quality_scores(small_docs, labels.limit(0)).collect()
    assert all(abs(r.score - 0.5) < 0.1 for r in unlabelled)
    assert quality_model.quality_scores(small_docs.limit(0), labels).count() == 0


@pytest.fixture(scope="module")
def licences():
    return licence_scan.LicenceModel().learn([b"the red fox and a dog of the house", b"in this way it was to be done", b"version of a file"])


def test_licence_families(licences):
    for family, templates in licence_scan.TEMPLATES.items():
        for template in templates:
            tokens = licence_scan.words(template.encode())
            assert licences.verdict(tokens)[0] == family, template
            assert licences.verdict([b"note", *tokens, b"thanks"])[0] == family, template
    for plain in (b"the cat of the house", b"of", b"", b"you may use this way to the file", b"general public opinion, version 3"):
        assert licences.verdict(licence_scan.words(plain))[0] == licence_scan.NONE, plain
    assert licences.verdict(licence_scan.words(b"Licensed under the terms of the vendor contract, version 9."))[0] == licence_scan.UNKNOWN


def test_bound_never_hides_a_licence(licences, spark):
    """The scan next to a full evaluation of every line."""
    docs = read(spark, SF, "documents")
    got = {r.doc_id: r.places for r in licence_scan.scan(docs, model=licences).collect()}
    for row in docs.collect():
        full = []
        for n, line in enumerate(row.text.encode().split(b"\n")):
            family = licences.verdict(licence_scan.words(line))[0]
            full += [f"{family}:{n}"] * (family != licence_scan.NONE)
        assert got[row.doc_id] == ",".join(full)


def test_licences_of_awkward_rows(small_docs, small_rows, licences):
    rows = licence_scan.scan(small_docs, model=licences).collect()
    assert len(rows) == len(small_rows) and all(r.families == "" for r in rows)
    assert licence_scan.scan(small_docs).count() == len(small_rows)
    assert licence_scan.scan(small_docs.limit(0)).count() == 0


# --- pipeline -----------------------------------------------------------------------
def test_pipeline(spark):
    docs = read(spark, SF, "documents").cache()
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF).cache())
        if name != "mixing":
            assert frames[-1].columns == docs.columns
    counts = [f.count() for f in frames]
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4] == counts[5] > 0
    direct = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, direct.collect()), key=repr) == sorted(map(tuple, frames[-1].collect()), key=repr)
    ids = {r.doc_id for r in frames[2].collect()}
    assert len(ids) == counts[2]
    assert not decontaminate.contaminated_pairs(frames[3], read(spark, SF, "benchmark")).count()
    assert all(not pii.base_spans(r.text) for r in frames[4].collect())


def test_pipeline_of_awkward_rows(spark, small_docs):
    docs = small_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (docs, docs.limit(0)):
        frame = rows
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, SF).cache()
            frame.count()
    assert frame.count() == 0
