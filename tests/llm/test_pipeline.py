"""The pipeline's stages one by one, each on what its predecessor kept."""

import corpus_pipeline
import duckdb
import pytest

from tarnlake.llm import common
from tests.conftest import SF
from tests.llm import brute


@pytest.fixture(scope="module")
def stages(spark):
    docs = common.table(spark, SF, "documents")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF), name)
        found.append(docs)
    return found


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality(stages):
    failed = set()
    for d, t in stages[0].select("doc_id", "text").collect():
        n, _, symbols, _, repeated, _ = brute.quality(t)
        if n < 20 or 100 * repeated > 30 * n:
            failed.add(d)
    assert not ids(stages[1]) & failed
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    good = {d for d, q in labels.items() if q and d not in failed}
    assert len(good & ids(stages[1])) >= 0.98 * len(good)
    assert not {d for d, q in labels.items() if not q} & ids(stages[1])


def test_near_duplicates(stages):
    want = brute.similar_groups([tuple(r) for r in stages[1].select("doc_id", "text").collect()])
    gone = ids(stages[1]) - ids(stages[2])
    assert gone <= set(want) and len(gone) >= 0.9 * len(want)


def test_decontamination(spark, stages):
    items = [tuple(r) for r in common.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    want = {r[0] for r in brute.decontaminate([tuple(r) for r in stages[2].select("doc_id", "text").collect()], items) if r[3]}
    assert want and ids(stages[2]) - ids(stages[3]) == want


def test_redaction(stages):
    assert ids(stages[3]) == ids(stages[4])
    for r in stages[4].collect():
        assert sum(brute.spans(r.text, brute.PII)[:4]) == 0
        assert r.n_chars == len(r.text)


def test_packing(stages):
    assert ids(stages[5]) == ids(stages[4])


def test_run(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect()))[:50]
