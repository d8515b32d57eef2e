"""The pipeline's stages, each on its predecessor's rows."""

from __future__ import annotations

from collections import Counter

from tests.llm import brute
from tests.llm.test_ops import DOCS, empty, folder  # noqa: F401

import corpus_pipeline as pipeline
from glyphwood.llm import quality_rules


def test_stages(spark, folder):  # noqa: F811
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder).cache()
        kept[name] = (docs.collect(), out.collect(), out.columns)
        docs = out
    for name, _ in pipeline.STAGES[:-1]:
        assert kept[name][2] == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after, _ = kept["quality classifier"]
    assert len(before) == len(DOCS) and not any(r.text in (None, "") for r in after) and set(after) <= set(before)
    before, after, _ = kept["quality rules"]
    good = {(r.doc_id, r.text) for r in quality_rules.quality_filter(spark.createDataFrame(before, spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").schema)).collect()}
    assert Counter((r.doc_id, r.text) for r in after) == Counter((r.doc_id, r.text) for r in before if (r.doc_id, r.text) in good)
    before, after, _ = kept["near dedup"]
    due = brute.components([(r.doc_id, r.text) for r in before], 5)
    assert sorted(r.doc_id for r in after) == sorted({c for _, c in due.values()})
    before, after, _ = kept["suffix dedup"]
    raw = [r.text.encode() for r in before]
    left = {r.doc_id: bytes(b for b, c in zip(t, cover, strict=True) if not c).decode("utf-8", "ignore") for r, t, cover in zip(before, raw, brute.repeated(raw), strict=True)}
    assert {r.doc_id: r.text for r in after} == left and all(r.n_chars == len(r.text) for r in after)
    before, after, _ = kept["best-fit packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_run_and_empty(spark, folder, empty):  # noqa: F811
    assert pipeline.run(spark, folder).count() > 0
    assert pipeline.run(spark, empty).count() == 0


def test_texts_that_share_an_id(spark, folder):  # noqa: F811
    """Unrelated texts under one id stay; copies and near copies go."""
    text = lambda c, n=60: " ".join(f"{c}{k}" for k in range(n))
    rows = [(1, text("a")), (1, text("b")), (1, text("b")), (2, text("d")), (3, text("d") + " more"), (3, text("e"))]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    due = Counter([(1, text("a")), (1, text("b")), (2, text("d")), (3, text("e"))])
    near = pipeline.near_stage(spark, docs, folder).cache()
    assert Counter((r.doc_id, r.text) for r in near.collect()) == due
    assert Counter((r.doc_id, r.text) for r in pipeline.suffix_stage(spark, near, folder).collect()) == due
