"""Ranked lexical search: postings as a table in buckets of terms, integer scores, top k for each item.

``index`` writes the postings of all documents: term, bucket of the term, document, its length and the term's occurrences, in order of buckets
within each file, so that a search reads only row groups that hold buckets of its terms.  ``search``
joins the terms of a block of items to them, sums scores by item and document, and ranks by a window.

The join is by term, and a term held by every document is no hot key: item terms are broadcast, in
blocks of counted size (``BLOCK_ITEMS``, ``BLOCK_TERMS``), and the postings that they ask for lie in slices of documents.  As all
postings of a document are in one slice, sums by item and document need no further shuffle, and each slice gives at most k rows for an item.

Cases: null and wordless texts have no terms, no postings, and no part in counts; rows that repeat a doc_id are documents each,
equal scores and ids keep both; a null doc_id ranks before others at equal scores; rows that repeat an item_id, or lack it, are items
each; an item without terms, or none of them in a document, has no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: Buckets of terms.
BUCKETS = 64
#: Items, and distinct (item, term) rows, of a broadcast block; a row takes about 60 bytes.
BLOCK_ITEMS = 1_000
BLOCK_TERMS = 500_000
#: Documents of a slice.
SLICE_DOCS = 20_000
#: Postings, and bytes of text, of a batch.
BATCH_ROWS = 200_000
#: A-Z lower-cased, and every byte that is no part of a term a space; bytes of characters beyond ASCII are parts.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a text, in order, as UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, words, tf, lengths, sizes = 0, [], [], [], []
        for k, text in enumerate(batch.column("text")):
            found = terms(text.as_py())
            count = Counter(found)
            words += count
            tf += count.values()
            lengths.append(len(found))
            sizes.append(len(count))
            if words and (len(words) >= BATCH_ROWS or k + 1 == len(batch)):
                where = np.repeat(np.arange(first, k + 1), sizes)
                yield pa.RecordBatch.from_pydict({
                    "doc": batch.column("doc").take(pa.array(where)),
                    "doc_id": batch.column("doc_id").take(pa.array(where)),
                    "n": pa.array(np.repeat(np.array(lengths, np.int64), sizes)),
                    "lead": pa.array(np.diff(where, prepend=-1) > 0),
                    "term": pa.array(words, pa.binary()).cast(pa.string()),
                    "tf": pa.array(tf, pa.int64()),
                })
                first, words, tf, lengths, sizes = k + 1, [], [], [], []


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and distinct term: ``doc`` (a number of the document), doc_id, n (all its terms), ``lead`` (one row of each document), term and tf."""
    plain = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(_counted, f"doc long, doc_id {id_type}, n long, lead boolean, term string, tf long")


def _bucket(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the postings of ``docs`` at ``path`` in order of their terms' buckets, and read them."""
    rows = postings(docs, id_col, text_col).withColumn("bucket", _bucket()).sortWithinPartitions("bucket")
    rows.write.option("parquet.block.size", 16 << 20).parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def _blocks(items: DataFrame, id_col: str, text_col: str, scratch: store.Scratch) -> tuple[DataFrame, int]:
    """Rows (item, item_id, term, times) with the ``block`` they are searched in, and how many blocks there are."""
    plain = items.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = postings(plain).select(F.col("doc").alias("item"), F.col("doc_id").alias("item_id"), "term", F.col("tf").alias("times"))
    rows = scratch.store(rows, "items")
    size = rows.agg(F.count_distinct("item").alias("items"), F.count(F.lit(1)).alias("rows")).first()
    blocks = max(1, -(-size["items"] // BLOCK_ITEMS), -(-size["rows"] // BLOCK_TERMS))
    return rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), blocks


def search(found: DataFrame, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` highest-scoring documents with a score above 0 for each item: item_id, rank, doc_id, score.

    ``found`` has postings as of ``index``.  All but weights is of 64-bit integers; 25 times a document's terms times all documents has to be one.
    """
    spark = found.sparkSession
    scratch = store.Scratch(spark, "lexical")
    asked, blocks = _blocks(items, id_col, text_col, scratch)
    size = found.where("lead").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(1)).alias("terms")).first()
    docs, slices = size["docs"], max(store.partitions(spark), store.parts(size["docs"], SLICE_DOCS))
    m = F.expr(f"75L + (25L * n * {docs}L) div {size['terms']}L")
    weight = F.floor(1000 * F.log((2.0 * docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    out = None
    for b in range(blocks):
        block = asked.where(F.col("block") == b)
        codes = scratch.store(block.select("term").distinct().coalesce(1).withColumn("code", F.monotonically_increasing_id()), "codes")
        buckets = [r[0] for r in codes.select(_bucket()).distinct().collect()]  # at most BUCKETS
        held = found.where(F.col("bucket").isin(buckets)).join(F.broadcast(codes), "term")
        weights = scratch.store(held.groupBy("code").agg(F.count(F.lit(1)).alias("df")).select("code", weight.alias("w")), "weights")
        query = scratch.store(block.join(codes, "term").join(weights, "code").where("w > 0").select("code", "item", (F.col("w") * F.col("times")).alias("w")), "query")
        parts = held.withColumn("m", m).select("doc", "doc_id", "code", F.expr("(1000000000L * tf) div (1000L * tf + 12L * m)").alias("part"))
        matches = parts.repartition(slices, "doc").join(F.broadcast(query), "code")
        scores = matches.groupBy("item", "doc", "doc_id").agg(F.sum(F.col("w") * F.col("part")).alias("score")).where("score > 0")
        best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "doc")
        ranked = scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ranked = ranked.join(F.broadcast(block.select("item", "item_id").distinct()), "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.union(ranked)
    return out
