"""The corpus pipeline's stages, each on its own input, on a small table."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillwright.llm.common import cut


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    pool = ["the", "thing", "with", "other", "nation", "when", "house", "river", "cloud", "stone"]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    rows = [(i, text(60) + (" vileword" if i % 5 == 0 else ""), "en", "s", 0) for i in range(200)]
    rows += [(500, rows[7][1], "en", "s", 0), (501, "123 456", "en", "s", 0), (502, None, None, None, None), (503, text(40) + ' token = "abcdef123456"', "en", "s", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(150)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, folder), "test-stage")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    first = seen["language_id"]
    assert 501 not in first and 502 not in first and len(first) == 202
    assert set(first) - set(seen["simhash_near_dedup"]) == {500}
    assert "abcdef123456" not in seen["secret_scan"][503].text and "[SECRET]" in seen["secret_scan"][503].text
    mixed = seen["mixing"]
    assert not [i for i in mixed if i < 150 and i % 5 == 0]
    assert len([i for i in mixed if i % 5]) >= 155
    assert all(r.parity and r.roundtrip and r.n_tokens == len(r.ids) for r in seen["sentencepiece"].values())


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.filter(F.col("n_tokens") > 0).count() > 100
