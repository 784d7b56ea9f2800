"""Every operator on null ids, hot and repeated ids, ids beyond 2**53 beside nulls, clashing names, a very long text without a space, and no rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from casebook.llm import decontaminate, embed_dedup, langid, lm_scoring, minhash, packing, secrets, store, substring, token_counts, warc, words
from tests.llm import brute

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
BIG = (1 << 60) + 1
LONG = "".join(random.Random(9).choices("abcdefgh", k=300_000))
CLASH = ("block", "bucket", "unit", "side", "_gone", "_whole", "_inner", "_raw", "_row", "_same", "node", "known", "piece", "length", "spans", "kinds", "hits_0", "lang")


def texts():
    """(doc_id, text): a third of all rows has one id, a third none, and each text comes twice."""
    draw = random.Random(4)
    text = lambda k: " ".join(f"w{draw.randrange(40)}" for _ in range(k))
    own = [text(draw.choice([2, 8, 30, 60])) for _ in range(40)]
    rows = [(BIG, t) for t in own] * 2 + [(None, t) for t in own] * 2 + [(BIG + 2 + 2 * k, t) for k, t in enumerate(own)] + [(7, LONG), (8, None), (None, None), (9, ""), (None, LONG)]
    draw.shuffle(rows)
    return rows


def docs(spark, rows=None):
    names = ", ".join(f"`{c}` int" for c in CLASH)
    return spark.createDataFrame([(*r, *range(len(CLASH))) for r in (texts() if rows is None else rows)], f"doc_id long, text string, {names}").repartition(4)


def counted(rows):
    out: dict = {}
    for r in rows:
        out[r] = out.get(r, 0) + 1
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_packing(spark):
    got = packing.pack_documents(docs(spark), TOKENIZER).collect()
    encoder = packing.Encoder(open(TOKENIZER).read())
    size = {t: len(encoder.encode([(t or "").encode()])[0]) + 1 for _, t in texts()}
    assert counted((r["doc_id"], r["start"] + r["length"]) for r in got if r["start"] + r["length"] in size.values() and r["piece"] == 0 and r["length"] < 2048) == counted((d, size[t]) for d, t in texts() if size[t] < 2048)
    assert sum(r["length"] for r in got) == sum(size[t] for _, t in texts())


def test_language_id_and_token_counts(spark):
    found = langid.identify(docs(spark), [("aa", "w1 w2 w3 abc"), ("bb", "hgf edc")]).collect()
    assert counted((r["doc_id"], r["lang_pred"] == "und") for r in found) == counted((d, not any(c.isalpha() for c in t or "")) for d, t in texts())
    vocab = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    counter = token_counts.Counter(vocab)
    want = counted((d, int(counter.count([(t or "").encode()])[0])) for d, t in texts())
    assert counted((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(docs(spark), vocab).collect()) == want


def test_long_words_take_no_more_memory(spark):
    import tracemalloc

    counter = token_counts.Counter([("<unk>", 0.0), ("▁", -1.0), *((a, -2.0) for a in "abcdefgh"), ("abc", -1.0)])
    tracemalloc.start()
    counter.word("▁" + LONG)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000


def test_lm_scoring(spark):
    got = lm_scoring.score(docs(spark)).collect()
    n = lambda t: len((t or "").split()) + 1
    assert counted((r["doc_id"], r["n_tokens"], r["n_known"]) for r in got) == counted((d, n(t), n(t)) for d, t in texts())
    assert {r["train_tokens"] for r in got} == {sum(n(t) for _, t in texts())}


def test_embeddings(spark):
    rows = [(5, [1.0, 0.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0, 0.0]), (1, [1.0, 0.01, 0.0, 0.0]), (2, [1.0, 0.02, 0.0, 0.0]), (3, [0.0, 1.0, 0.01, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (BIG, [0.0, 0.0, 1e-200, 0.0]), (BIG + 2, [0.0, 0.0, 1e200, 1e198]), (BIG + 4, [0.0, 0.0, 3.0, 0.0]), (BIG + 4, [0.0, 0.0, 3.0, 0.0]), (9, None)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, node int, same int, known int").repartition(3)
    got = counted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.link(df).collect())
    assert got == counted([(5, 2, 1, False), (5, 1, 3, False), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True), (None, 0, None, True), (BIG, 3, BIG, True), (BIG + 2, 3, BIG, False), (BIG + 4, 3, BIG, False), (BIG + 4, 3, BIG, False), (9, 0, 9, True)])


def test_near_duplicates(spark):
    got = counted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.link(docs(spark), 85).collect())
    # rows with an id are one document for each text and id; all texts of the hot id are linked through it
    whole = {(d, t): len(brute.shingles(t)) for d, t in texts()}
    linked = {t for d, t in texts() if d == BIG and brute.shingles(t)}
    want = counted((d, whole[d, t], None if d is None else BIG if t in linked else d) for d, t in texts())
    assert got == want
    kept = minhash.deduplicate(docs(spark))
    assert kept.columns == docs(spark).columns
    assert counted((r["doc_id"], r["text"]) for r in kept.collect()) == counted((d, t) for d, t in texts() if d is None or d == BIG or t not in linked)


@pytest.mark.parametrize("block", [256, 32])
def test_a_large_group_of_near_copies_is_not_compared_pair_by_pair(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    draw = random.Random(2)
    base = [f"v{k}" for k in range(400)]

    def near(k):
        w = list(base)
        for _ in range(k % 5):
            w[draw.randrange(400)] = f"x{draw.randrange(10**6)}"
        return " ".join(w)

    rows = [(k, near(k)) for k in range(3000)] + [(5000 + k, " ".join(f"u{draw.randrange(10**6)}" for _ in range(50))) for k in range(50)]
    met = spark.sparkContext.accumulator(0)
    plain = minhash._similar_sets

    def counted(batches, percent):
        def seen():
            for pdf in batches:
                met.add(len(pdf))
                yield pdf

        return plain(seen(), percent)

    monkeypatch.setattr(minhash, "_similar_sets", counted)
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.link(docs(spark, rows), 80).collect()}
    assert got == {k: ((0, k == 0) if k < 5000 else (k, True)) for k, _ in rows}
    assert 2400 < met.value < 6000  # each distinct row once, and some pivots for each block


def test_exact_links_beyond_the_pivots(spark, monkeypatch):
    """Chains of near copies, whose ends are not similar, in one large cluster."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "PIVOTS", 1)
    draw = random.Random(6)
    rows, words_ = [], [f"c{k}" for k in range(200)]
    for k in range(60):
        words_ = list(words_)
        for _ in range(3):
            words_[draw.randrange(200)] = f"n{draw.randrange(10**6)}"
        rows.append((k, " ".join(words_)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.link(docs(spark, rows), 80).collect()}
    assert got == brute.near_duplicates(rows, 80)


def test_substrings(spark):
    got = counted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.deduplicate(docs(spark)).collect())
    n = lambda t: len((t or "").split())
    # the hot id is the smallest that holds these texts, rows without an id take no part
    assert got == counted((d, n(t), n(t) if d not in (None, BIG) and n(t) >= 13 else 0) for d, t in texts())


def test_contamination(spark):
    items = [("i", "w1 w2"), ("i", "w1 w2"), ("j", LONG), ("k", None), (None, "w3")] + [("i", "w1 w2")] * 40
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id string, text string, text2 int")
    want = {d: w for d, w in brute.contaminated(list(enumerate(t for _, t in texts())), [("i", "w1 w2"), ("j", LONG)]).items()}
    got = decontaminate.digest(decontaminate.find(docs(spark), bench)).collect()
    assert counted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == counted((d, *want[k]) for k, (d, _) in enumerate(texts()))
    clean = decontaminate.clean(docs(spark), bench)
    assert clean.columns == docs(spark).columns and clean.count() == sum(not want[k][4] for k in want)
    nothing = spark.createDataFrame([("z", "never there at all")], "item_id string, text string")
    assert decontaminate.find(docs(spark), nothing).where("size(spans) > 0").count() == 0


@pytest.mark.parametrize("few", [500_000, 0])
def test_warc(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "FEW_DIGESTS", few)
    html = LONG * 2
    rows = [(k, None if k % 3 == 0 else f"http://h/{k}", html if k % 4 == 0 else None if k % 4 == 1 else f"p{k}") for k in range(24)] + [(BIG, "u", html), (None, "u", "alone"), (None, "v", None)]
    pages = spark.createDataFrame([(*r, *range(4)) for r in rows], "page_id long, url string, html string, payload int, record_type int, _digest int, _first int").repartition(3)
    path = store.new_path(spark, "warc")
    warc.write(warc.resolve(pages), path, compression="gzip")
    got = warc.read(spark, path)
    want = brute.warc([(p, h) for p, _, h in rows if p is not None])
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.where("page_id is not null").collect()} == want
    assert sorted((r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got.where("page_id is null").collect()) == [(0, "revisit", 1), (5, "response", None)]
    assert got.where(F.length("payload") == len(html)).count() == 1
    files = spark.read.format("binaryFile").load(path).where("length > 100").count()
    assert files >= 2  # long payloads lie in archives of their own


def test_warc_payloads_are_not_shuffled(spark):
    pages = spark.createDataFrame([(k, "u", f"p{k % 7}") for k in range(40)], "page_id long, url string, html string").repartition(3)
    plan = warc.resolve(store.materialize(pages, "pages"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("few", [400_000, 0])
def test_secrets(spark, monkeypatch, few):
    monkeypatch.setattr(secrets, "FEW_CANDIDATES", few)
    key = "token=abcdefghijklmnop " + "AKIA" + "Q" * 16
    rows = [(d, t if k % 2 else f"{t} {key}") for k, (d, t) in enumerate(texts())]
    got = secrets.digest(secrets.scan(docs(spark, rows))).collect()
    found = brute.secrets(list(enumerate(t for _, t in rows)))
    assert counted((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == counted((d, *found[k]) for k, (d, _) in enumerate(rows))
    clean = secrets.redact(docs(spark, rows))
    assert clean.columns == docs(spark).columns and clean.where(F.col("text").contains("AKIA") | F.col("text").contains("token=a")).count() == 0


def test_frames_of_texts_are_bounded():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": pa.array([1, None, BIG] * 5000, pa.int64()), "text": ["", None, "x" * 50] * 5000})
    frames = list(words.chunks([batch, batch], 100_000))
    assert sum(map(len, frames)) == 30_000 and max(len(f) for f in frames) * words.ROW_BYTES <= 100_000
    assert frames[0]["id"][2] == BIG and frames[0]["id"].isna()[1] and frames[0]["text"][1] == b""
    assert [len(f) for f in words.chunks([pa.RecordBatch.from_pydict({"text": ["y" * 500, "z", "y" * 500]})], 200)] == [1, 1, 1]


def test_the_shared_folder_is_no_local_one_on_a_cluster():
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Cluster:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.shared_dir(Cluster())


def test_scratch_tables_go(spark):
    scratch = store.Scratch(spark, "x")
    assert scratch.store(spark.range(3), "y").count() == 3
    scratch.clear()
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch.path)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_empty_arrays_of_hits():
    table = decontaminate.Windows([("a", "x y z")], 2)
    assert table.scan([b"", b"q"]) == [(0, [], set(), []), (1, [], set(), [])]
    assert np.unique(np.zeros((2, 0), np.int64), axis=1).shape == (2, 0)
