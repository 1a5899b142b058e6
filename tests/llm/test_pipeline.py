import random

import corpus_pipeline as C
from spanweave.llm import jaccard, quality

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        kept[name] = (docs, out)
        if name != C.STAGES[-1][0]:
            assert out.columns == columns, name
            docs = out.cache()
    before, after = (x.select("doc_id").collect() for x in kept["quality_filter"])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.score_digest(kept["quality_filter"][0], labels).collect()}
    assert {r.doc_id for r in after} == {r.doc_id for r in before if scores[r.doc_id] >= 0.7}
    near, one = kept["near_duplicates"]
    classes = {r.doc_id: r.class_id for r in jaccard.jaccard_join(near).collect()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(classes.values()))
    packed = kept["pack_sequences"][1].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept["pack_sequences"][0].collect()}
    assert C.run(spark, SF).count() == len(packed)


def test_stages_on_odd_rows(spark):
    rng = random.Random(1)
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, size int"
    rows = [(None, None, None, None, None, "a", 1), (1, "", "en", "s", 0, "a", 1), (2, "word " * 30_000, None, "s", 5, None, 1), (2, "a b", "en", None, 3, "b", 2), (2, "a b", "en", None, 3, "b", 2)]
    rows += [(i, " ".join(rng.choice("abcd") for _ in range(40)), "en", "t", 1, "c", 3) for i in range(3, 30)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in C.STAGES:
            out = stage(spark, docs, SF)
            out.collect()
            if name != "pack_sequences":
                assert out.columns == docs.columns
    assert C.near_duplicates(spark, spark.createDataFrame(rows, schema), SF).count() <= len(rows)
