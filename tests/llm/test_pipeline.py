"""The pipeline's stages on a small table, each against plain Python over its own input."""

import brute
import corpus_pipeline as pipeline
import pytest

from tallypact.llm.common import written
from tallypact.llm.packing import encoder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(
        spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "", "en", "s", 0)],
                              "doc_id long, text string, lang string, source string, n_chars long"))
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_stay(steps):
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes


def test_quality_keeps_trusted_documents(spark, steps):
    before, after = rows(steps[0]), rows(steps[1])
    trusted = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] == 1}
    assert trusted & set(before) <= set(after) < set(before)
    assert all(after[i] == before[i] for i in after)


def test_one_document_of_each_group(steps):
    before, after = rows(steps[1]), rows(steps[2])
    groups = brute.jaccard_groups([(i, r["text"]) for i, r in before.items()])
    assert sorted(after) == sorted(set(groups.values()))
    assert {9001, 9002, 9003} & set(after) == {9001}


def test_no_benchmark_passage_is_left(spark, steps):
    before, after = rows(steps[2]), rows(steps[3])
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = brute.op7([(i, r["text"]) for i, r in before.items()], bench)
    assert sorted(after) == sorted(r[0] for r in found if not r[5])
    assert len(after) < len(before)


def test_personal_data_is_gone(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert set(before) == set(after)
    changed = 0
    for i, r in after.items():
        assert sum(brute.op10_base(r["text"])[:4]) == 0
        assert r["text"] is None or r["n_chars"] == len(r["text"])
        if not sum(brute.op10_base(before[i]["text"])[:4]):
            assert r["text"] == before[i]["text"]
        else:
            changed += 1
    assert changed


def test_packed(steps):
    texts = [(i, r["text"]) for i, r in rows(steps[4]).items()]
    assert brute.check_packing(steps[5].collect(), texts, encoder()) == 0


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0
