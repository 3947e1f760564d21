import collections

import corpus_pipeline
from tests.llm.test_duplicates import classes_by_force
from waybill.llm.common import Scratch, table


def test_stages_keep_columns_and_rows_follow(spark, sf_dir):
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    columns, seen = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = scratch.put(stage(spark, docs, sf_dir), f"s{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        seen.append((before, docs))
    toxic = {r.doc_id for r in table(spark, sf_dir, "labels").where("toxic = 1").collect()}
    kept = {r.doc_id for r in seen[0][1].select("doc_id").collect()}
    assert len(kept & toxic) < len(toxic)
    near = [(r.doc_id, r.text) for r in seen[2][0].collect()]
    want = {k for k, (_, c) in classes_by_force(near, 5, 80).items() if c == k}
    assert {r.doc_id for r in seen[2][1].collect()} == want
    assert seen[3][1].count() == seen[3][0].count()
    pieces = collections.Counter(r.doc_id for r in docs.collect())
    assert set(pieces) == want


def test_stages_take_odd_rows(spark, odd, sf_dir):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs.withColumn("n_chars", docs["doc_id"]), sf_dir).drop("n_chars")
        assert set(docs.columns) == set(odd.columns)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), sf_dir).count() == 0
