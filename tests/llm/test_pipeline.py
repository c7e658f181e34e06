"""The pipeline's stages on hard cases, and registered queries against their SQL."""

import os

import pytest
import corpus_pipeline
from tests.agreement import compare, duck
from tests.llm.conftest import passage
from vouchline.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    odd.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage(20))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, odd, folder):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "token_shards":
            assert out.columns == odd.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "language":
            assert ids >= {None, 1, 2, 3, *range(100, 106)} and not ids & {4, 5, 6, 11}
        if name == "near_dedup":
            assert 2 not in ids and 1 in ids and None in ids and ids & set(range(100, 106)) == {100}
        if name == "decontamination":
            assert 100 not in ids and 1 in ids
        docs = out
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert corpus_pipeline.run(spark, folder).count() == docs.count() > 0


def test_empty_tables(spark, nothing, tmp_path):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_agreement(spark, name):
    note, _, good = compare(spark, duck(SF), SF, name, catalog.QUERIES[name], catalog.SQL[name])
    assert good, note


def test_all_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES)
    assert numbers == list(range(1, 14))
