"""Every pipeline stage on what its predecessor kept, and the whole run, against brute force."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from test_documents import brute_components, brute_spans, brute_statistics
from test_tokens import WORD, check_packed, ids_of

from feedmine.llm import quality, secret_scan
from feedmine.llm.common import shared_folder

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"] for r in quality.judge(docs, quality.train_rules(docs, labels)).where("kept").collect()}
    assert all(not (s[0] < 20 or 100 * s[4] > 30 * s[0]) for s in (brute_statistics(rows[i]["text"]) for i in good))
    folder = shared_folder(spark, "test")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        got = docs.collect()
        if number < 3:
            assert docs.columns == columns
        if number == 0:
            assert Counter(r["doc_id"] for r in got) == Counter(good)
            kept = sorted((r["doc_id"], r["text"]) for r in got)
        if number == 1:
            _, label = brute_components(kept)
            assert sorted(r["doc_id"] for r in got) == sorted({kept[k][0] for k in label})
        if number == 2:
            for r in got:
                spans = brute_spans(rows[r["doc_id"]]["text"])
                assert r["text"] == (secret_scan.mask(rows[r["doc_id"]]["text"], spans) if spans else rows[r["doc_id"]]["text"])
                assert r["n_chars"] == len(r["text"]) and not (spans and r["text"] == rows[r["doc_id"]]["text"])
            texts = {r["doc_id"]: r["text"] for r in got}
    assert Counter(r["doc_id"] for r in got) == Counter({i: -(-(len(ids_of(WORD, t)) + 1) // 4096) for i, t in texts.items()})
    check_packed(got, 4096)
    again = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in again) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got)


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_stages_on_odd_rows(spark, table, request):
    docs = request.getfixturevalue(table)
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.columns and out.count() <= docs.count()
    packed = corpus_pipeline.STAGES[3][1](spark, docs, SF).collect()
    check_packed(packed, 4096)
    assert len({r["sequence_id"] for r in packed}) <= len(packed) and np.all([r["length"] <= 4096 for r in packed])
