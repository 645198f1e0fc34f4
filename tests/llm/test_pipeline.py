"""The pipeline's stages against what their operators promise, on the smallest tables."""

import corpus_pipeline
from freshet.llm import decontaminate, language_id, near_copies, pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        was = {r.doc_id for r in before.select("doc_id").collect()}
        if k < 4:
            assert docs.columns == COLUMNS
        if k == 0:
            told = language_id.identify(before).where(f"lang_pred = 'und' or score < {language_id.LEAST}")
            assert was - ids == {r.doc_id for r in told.collect()} and docs.where("lang is null").count() == 0
        elif k == 1:
            groups = {}
            for r in near_copies.near_groups(before).collect():
                groups.setdefault(r.grp, []).append(r.doc_id)
            assert ids == {min(g) for g in groups.values()} and was - ids
        elif k == 2:
            assert was - ids == {r.doc_id for r in decontaminate.contaminated(before, bench).collect()} and was - ids
        else:
            assert ids == was
        if k == 3:
            left = pii.report(docs).where("n_email + n_ip + n_card + n_phone > 0").count()
            changed = docs.alias("a").join(before.alias("b"), "doc_id").where("a.text <> b.text")
            assert left == 0 and changed.count() and docs.where("n_chars <> length(text)").count() == 0
        seen[name] = len(ids)
    assert len(corpus_pipeline.STAGES) == 5 and docs.where("n_tokens <> size(ids)").count() == 0
    out = corpus_pipeline.run(spark, sf)
    assert {(r.doc_id, r.decoded_sha256) for r in out.collect()} == {(r.doc_id, r.decoded_sha256) for r in docs.collect()}
