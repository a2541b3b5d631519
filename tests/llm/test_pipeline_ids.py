"""The pipeline's stages over documents whose ids are null or repeated."""

from __future__ import annotations

import corpus_pipeline
from spanvigil.llm.text import read

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)


def words(n, tag):
    return " ".join(f"{tag}{k}" for k in range(n))


def kept(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=repr)


def test_contaminated_documents_go_row_by_row(spark):
    item = read(spark, SF, "benchmark").orderBy("item_id").first().text
    bad, clean, other = words(60, "a") + " " + item, words(60, "b"), words(60, "c")
    docs = frame(spark, [(None, bad), (None, clean), (1, bad), (1, other), (2, clean), (3, None)])
    want = sorted([(None, clean), (1, other), (2, clean), (3, None)], key=repr)
    assert kept(corpus_pipeline.drop_contaminated(spark, docs, SF)) == want


def test_near_copies_go_row_by_row(spark):
    one, two, three = words(80, "a"), words(80, "b"), words(80, "c")
    rows = [(5, one), (4, one + " tail"), (4, two), (4, two), (None, one), (None, three), (None, three), (6, three + " end"), (7, None), (7, None), (None, None)]
    want = sorted([(4, one + " tail"), (4, two), (6, three + " end"), (7, None), (None, None)], key=repr)
    docs = frame(spark, rows)
    out = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert out.columns == docs.columns and kept(out) == want


def test_later_stages_keep_awkward_ids(spark):
    a, b, c = words(60, "a"), words(60, "b"), words(60, "c")
    item = read(spark, SF, "benchmark").orderBy("item_id").first().text
    rows = [(None, a), (None, a), (8, b), (8, c), (8, c), (None, words(60, "d") + " " + item), (9, words(60, "e") + " " + item)]
    stage, at = frame(spark, rows), {}
    for name, run in corpus_pipeline.STAGES[1:]:
        stage = run(spark, stage, SF).cache()
        at[name] = sorted((r.doc_id for r in stage.collect()), key=repr)
    assert at["jaccard_join"] == [8, 8, 9, None, None]
    assert at["decontaminate"] == at["pii"] == at["mixing"] == [8, 8, None]


def test_clashing_names_and_maps_survive_every_stage_but_the_last(spark):
    rows = [(1, words(60, "a"), "mine", {"k": 1}), (1, words(60, "a"), "mine", {"k": 2}), (2, words(60, "b"), "mine", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _print string, _gone map<string,int>")
    for _, run in corpus_pipeline.STAGES[:4]:
        docs_after = run(spark, docs, SF)
        assert docs_after.columns == docs.columns
    out = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id, r["_print"], r["_gone"]) for r in out) == [(1, "mine", {"k": 1}), (2, "mine", None)]
