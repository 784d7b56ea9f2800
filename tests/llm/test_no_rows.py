"""Every operator on tables without rows: results without rows, with the columns that others have."""

from __future__ import annotations

import public_tokenizers
import pytest

from casebook.llm import decontaminate, embed_dedup, langid, lexical, lm_scoring, merkle, minhash, packing, personal, secrets, store, substring, token_counts, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([], DOCS)


def test_documents(spark, docs):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    vocab = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    made = {
        "packing": packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")),
        "langid": langid.identify(docs, langid.sample(docs)),
        "tokens": token_counts.count_tokens(docs, vocab),
        "lm": lm_scoring.score(docs),
        "minhash": minhash.link(docs, 85),
        "kept": minhash.deduplicate(docs),
        "substring": substring.deduplicate(docs),
        "found": decontaminate.digest(decontaminate.find(docs, items)),
        "nothing": decontaminate.digest(decontaminate.find(docs, items.limit(0))),
        "clean": decontaminate.clean(docs, items),
        "secrets": secrets.digest(secrets.scan(docs)),
        "redacted": secrets.redact(docs),
        "personal": personal.digest(personal.scan(docs)),
        "search": lexical.search(lexical.index(docs, store.new_path(spark, "postings")), items),
        "proofs": merkle.verified(merkle.prove(docs)),
    }
    for name, df in made.items():
        assert df.count() == 0 and df.columns, name
    assert made["kept"].columns == made["clean"].columns == made["redacted"].columns == docs.columns


def test_embeddings(spark):
    out = embed_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert out.count() == 0 and out.columns[:4] == ["vec_id", "n_links", "component_id", "kept"]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_pages(spark, compression):
    path = store.new_path(spark, "warc")
    warc.write(warc.resolve(spark.createDataFrame([], "page_id long, url string, html string")), path, compression=compression)
    assert warc.read(spark, path).count() == 0
