"""The pipeline: each stage on its own input, against brute force where the operators' tests do not already do so."""

import pytest

import corpus_pipeline as cp
from vigia.llm.common import table


@pytest.fixture(scope="module")
def stages(spark, sf_small, tmp_path_factory):
    """Input and output of each stage, written and read again as the driver does."""
    top, docs, out = tmp_path_factory.mktemp("pipeline"), table(spark, sf_small, "documents"), []
    for name, stage in cp.STAGES:
        path = str(top / name)
        stage(spark, docs, sf_small).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return dict(zip([n for n, _ in cp.STAGES], out))


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_order_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["language", "near_copies", "repeats", "decontamination", "packing"]
    for name in list(stages)[:-1]:
        a, b = stages[name]
        assert [(f.name, f.dataType) for f in b.schema] == [(f.name, f.dataType) for f in a.schema]


def test_language_keeps_prose(stages):
    before, after = map(by_id, stages["language"])
    assert set(after) <= set(before) and len(after) >= 0.98 * len(before)
    assert all(after[i] == before[i] for i in after)


def test_one_document_of_each_group_stays(stages):
    from tests.llm.test_pairs import brute_components
    before, after = map(by_id, stages["near_copies"])
    groups = brute_components([(i, r.text) for i, r in before.items()], 5, 80)
    assert set(after) == {i for i, (n, c) in groups.items() if c == i} and len(after) < len(before)


def test_repeated_bytes_go(stages):
    from tests.llm.test_pairs import brute_bytes
    before, after = map(by_id, stages["repeats"])
    ids = list(before)
    for i, (n, gone, _, _) in zip(ids, brute_bytes([before[i].text for i in ids], 200)):
        if not gone:
            assert after[i] == before[i]
        elif i in after:
            left = len(after[i].text.encode())
            assert n - gone - 8 * 3 <= left <= n - gone and after[i].n_chars == len(after[i].text)


def test_benchmark_passages_go(stages, spark, sf_small):
    before, after = map(by_id, stages["decontamination"])
    items = [r.text for r in table(spark, sf_small, "benchmark").collect()]
    gone = {i for i, r in before.items() if any(x in r.text for x in items)}
    assert gone and not gone & set(after) and len(after) >= len(before) - len(gone) - 2


def test_packing_holds_every_document(stages):
    before, after = stages["packing"]
    assert {r.doc_id for r in after.collect()} == set(by_id(before))


def test_run_equals_the_stages(stages, spark, sf_small):
    assert cp.run(spark, sf_small).count() == stages["packing"][1].count()


def test_odd_and_empty_tables(spark, sf_small, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in cp.STAGES:
            docs = stage(spark, docs, sf_small)
            docs.collect()
        if name == "packing":
            assert "sequence_id" in docs.columns
