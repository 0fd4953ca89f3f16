import pytest

from pathlib import Path

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
def test_stages_hand_on_documents(spark, shared, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        here = {r.doc_id for r in docs.select("doc_id").collect()}
        assert here <= ids and here
        ids = here
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    rows = sorted(map(tuple, docs.select("start", "n_tokens").collect()))
    assert all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:])) and rows[0][0] == 0
