import pytest

import corpus_pipeline
from gridspark.llm import ngram_join, pii
from gridspark.llm.common import table, written

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, DATA, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = written(stage(spark, docs, DATA), name)
        out.append((name, docs, made))
        docs = made
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _, _ in stages] == ["quality_rules", "ngram_jaccard", "pii", "source_mix", "bpe"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns
    assert stages[-1][2].columns == ["doc_id", "n_tokens", "ids"]


def test_one_document_of_each_group_stays(stages):
    _, before, after = stages[1]
    top = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(top.values()))


def test_every_text_is_pseudonymised_once(stages):
    _, before, after = stages[2]
    want = {r.doc_id: r.text for r in pii.pseudonymise_documents(before).collect()}
    assert {r.doc_id: r.text for r in after.collect()} == want
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_last_stage_has_every_row(stages):
    _, before, after = stages[4]
    assert after.count() == before.count()


def test_run(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).select("doc_id", "n_tokens").collect())) == sorted(map(tuple, stages[4][2].select("doc_id", "n_tokens").collect()))
