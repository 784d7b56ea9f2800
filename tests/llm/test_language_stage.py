"""The pipeline's language stage on documents without any label."""

from __future__ import annotations

import corpus_pipeline


def test_documents_stay_when_no_row_has_a_label(spark):
    texts = ["plain prose", "\u00e9t\u00e9", "\u6f22\u5b57", "", " 12, 3!", None]
    docs = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(2)
    kept = corpus_pipeline.identify_language(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"], r["lang"]) for r in kept) == [(k, texts[k], None) for k in range(3)]
