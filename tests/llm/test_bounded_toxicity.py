"""Toxicity in bounded memory: counts given out in pieces, texts in batches of bounded bytes."""

import corpus_pipeline
from skyweave.llm import op1_tokens, op7_toxicity
from skyweave.llm.common import table

SF = "/root/testdata/sf0.001"
NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_toxicity_stage_counts_in_pieces_and_scores_in_small_batches(spark, monkeypatch):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels").select("doc_id", "toxic")
    whole = op7_toxicity.fit(docs, labels)
    monkeypatch.setattr(op7_toxicity, "COUNTED_UNITS", 100)
    seen, fit, keep = [], op7_toxicity.fit, corpus_pipeline.store
    monkeypatch.setattr(op7_toxicity, "fit", lambda *a: seen.append(fit(*a)) or seen[-1])
    bounds = []
    monkeypatch.setattr(corpus_pipeline, "store", lambda *a: bounds.append(spark.conf.get(NAME)) or keep(*a))
    before = spark.conf.get(NAME, None)
    kept = corpus_pipeline.toxicity(spark, docs, SF)
    assert seen == [whole] and whole.scores
    assert bounds == [str(op1_tokens.BATCH_BYTES)] and spark.conf.get(NAME, None) == before
    want = op7_toxicity.score_documents(docs, whole).where("_toxicity.predicted = 0").select(*docs.columns)
    assert sorted(map(str, kept.collect())) == sorted(map(str, want.collect()))
