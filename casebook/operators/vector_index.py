"""An inverted file over vectors (K9, L9, A10, W10): entries in lists around centroids, so that a search looks at a part of them.

``build`` fits centroids by spherical k-means, on a sample of at most ``FIT_ROWS`` entries told by a hash; each round is one pass that
sums vectors in Arrow batches and adds the sums of each list.  Every entry is then stored in the list of its nearest centroid, packed as bytes in
blocks of bounded size, so that a list with a third of all entries is many blocks.  With the centroids are stored each list's size,
the widest angle of a member, and the number of lists to probe.

``search`` probes the lists whose centroids are nearest to a query; how many that takes was measured by ``build``, as the least number that
finds ``TARGET`` of the true neighbours of a held-out sample.  ``exact`` finds them all: a list is left out only if the
triangle inequality on angles says that no member can be as near as the best found so far.

Vectors that are null, zero or not finite are in no list and find nothing; of another width they are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.operators import link

#: Entries that centroids are fitted on, lists at most, rounds, and bytes of the vectors of a stored block.
FIT_ROWS, MOST_LISTS, ROUNDS, BLOCK_BYTES = 1 << 18, 4096, 8, 2 << 20
#: The share of true neighbours that probes are chosen for, entries it is measured with, and neighbours of each.
TARGET, TUNED_BY, TUNED_K = 0.95, 256, 20
DIGITS = 6
#: What rounding of cosines and angles may hide.
SLACK = 2e-6


@dataclass(frozen=True)
class Index:
    """A stored index; ``centroids``, ``sizes`` and ``reach`` (the widest angle of a member) are by list."""

    path: str
    centroids: np.ndarray
    sizes: np.ndarray
    reach: np.ndarray
    probes: int
    block: int
    spark: SparkSession = field(repr=False)

    def blocks(self) -> DataFrame:
        """Packed entries: list, part, entry_id, code, entries."""
        return self.spark.read.schema(_BLOCKS).parquet(f"{self.path}/blocks")


_ASKED = pa.schema([("list", pa.int64()), ("part", pa.int64()), ("query_id", pa.binary()), ("vectors", pa.binary())])
_BLOCKS = "list long, part long, entry_id binary, code binary, entries binary"
_LISTS = "list long, centroid array<double>, size long, reach double, probes int, block long"


def _units(batch: pa.RecordBatch, width: int) -> np.ndarray:
    x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
    return x / np.abs(x).max(axis=1, keepdims=True) / np.sqrt(((x / np.abs(x).max(axis=1, keepdims=True)) ** 2).sum(axis=1, keepdims=True))


def _usable(rows: DataFrame, width: int) -> DataFrame:
    """Rows with a finite vector that is not zero, of the right width."""
    wrong = F.raise_error(F.concat(F.lit("a vector has another width than "), F.lit(width))).cast("boolean")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    return rows.where(F.when(F.size("vector") != width, wrong).otherwise(finite & some))


def _nearest_list(units: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """List of each vector, the first of equally near ones, and the cosine to its centroid."""
    best, near = np.zeros(len(units), np.int64), np.full(len(units), -2.0)
    for a in range(0, len(units), 4096):
        sim = units[a : a + 4096] @ centroids.T
        best[a : a + 4096] = sim.argmax(axis=1)
        near[a : a + 4096] = sim.max(axis=1)
    return best, near


def _fitted(sample: DataFrame, lists: int, width: int, rounds: int) -> np.ndarray:
    """Centroids of ``sample``; the first ones are entries told by a hash, and a list that loses all its members keeps its centroid."""
    first = sample.orderBy(F.xxhash64("entry_id", F.lit(7)), "entry_id").limit(lists).select("vector").collect()  # at most MOST_LISTS
    centroids = np.array([r["vector"] for r in first], np.float64).reshape(-1, width)
    centroids /= np.sqrt((centroids**2).sum(axis=1, keepdims=True))
    for _ in range(rounds):
        now = centroids

        def summed(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros_like(now), np.zeros(len(now), bool)
            for batch in batches:
                if len(batch):
                    units = _units(batch, width)
                    best, _ = _nearest_list(units, now)
                    np.add.at(total, best, units)
                    seen[best] = True
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_pydict({"list": pa.array(at), "total": pa.array([total[k].tobytes() for k in at], pa.binary())})

        def added(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"list": pdf["list"].iloc[:1], "total": [sum(np.frombuffer(t) for t in sorted(pdf["total"])).tobytes()]})

        sums = sample.select("vector").mapInArrow(summed, "list long, total binary").groupBy("list").applyInPandas(added, "list long, total binary")
        moved = centroids.copy()
        for r in sums.collect():  # one row for each list
            total = np.frombuffer(r["total"])
            norm = math.sqrt(float(total @ total))
            if norm > 0:
                moved[r["list"]] = total / norm
        if np.abs(moved - centroids).max() < 1e-9:
            break
        centroids = moved
    return centroids


def build(dictionary: DataFrame, path: str, lists: int | None = None, rounds: int = ROUNDS, target: float = TARGET) -> Index:
    """Index ``dictionary`` (entry_id, code, vector) under ``path``; ``lists`` is about the square root of the entries unless given."""
    spark = dictionary.sparkSession
    found = link.plain_entries(dictionary)
    some = found.where(F.size("vector") > 0).select(F.size("vector")).first()
    if some is None:
        raise ValueError("there is no vector to index")
    width = some[0]
    _usable(found, width).write.mode("overwrite").parquet(f"{path}/entries")
    entries = spark.read.schema(found.schema).parquet(f"{path}/entries")
    n = entries.count()
    if not n:
        raise ValueError("there is no vector to index")
    lists = max(1, min(lists or math.isqrt(n), MOST_LISTS, n))
    sample = entries.where(F.pmod(F.xxhash64("entry_id"), F.lit(-(-n // FIT_ROWS))) == 0)
    centroids = _fitted(sample, lists, width, rounds)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, near = _nearest_list(_units(batch, width), centroids) if len(batch) else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_pydict({"list": pa.array(best), "near": pa.array(near)} | {c: batch.column(c) for c in ("entry_id", "code", "vector")})

    entries.mapInArrow(assigned, "list long, near double, entry_id long, code long, vector array<double>").write.mode("overwrite").parquet(f"{path}/assigned")
    dealt = spark.read.schema("list long, near double, entry_id long, code long, vector array<double>").parquet(f"{path}/assigned")
    block = max(1, BLOCK_BYTES // (8 * width))
    members = dealt.groupBy("list").agg(F.count(F.lit(1)).alias("size"), F.acos(F.least(F.min("near"), F.lit(1.0))).alias("reach"))
    sizes, reach = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in members.collect():  # one row for each list
        sizes[r["list"]], reach[r["list"]] = r["size"], r["reach"]
    parts = F.broadcast(spark.createDataFrame([(k, -(-int(s) // block)) for k, s in enumerate(sizes) if s], "list long, parts long"))  # at most MOST_LISTS rows
    keyed = dealt.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("entry_id"), F.col("parts")))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("entry_id")
        return pd.DataFrame({"list": [key[0]], "part": [key[1]], "entry_id": [pdf["entry_id"].to_numpy(np.int64).tobytes()], "code": [pdf["code"].fillna(0).to_numpy(np.int64).tobytes()], "entries": [np.stack(pdf["vector"].to_numpy()).tobytes()]})

    keyed.groupBy("list", "part").applyInPandas(pack, _BLOCKS).write.mode("overwrite").parquet(f"{path}/blocks")
    index = Index(path, centroids, sizes, reach, lists, block, spark)
    probes = _tuned(index, dealt, n, target)
    rows = [(k, c.tolist(), int(s), float(r), probes, block) for k, (c, s, r) in enumerate(zip(centroids, sizes, reach, strict=True))]
    spark.createDataFrame(rows, _LISTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """A stored index."""
    rows = spark.read.schema(_LISTS).parquet(f"{path}/lists").orderBy("list").collect()  # at most MOST_LISTS
    each = {c: np.array([r[c] for r in rows]) for c in ("centroid", "size", "reach")}
    return Index(path, each["centroid"], each["size"], each["reach"], rows[0]["probes"], rows[0]["block"], spark)


def _tuned(index: Index, dealt: DataFrame, n: int, target: float) -> int:
    """The least number of lists that holds ``target`` of the true neighbours of a sample, themselves left out."""
    asked = dealt.orderBy(F.xxhash64("entry_id", F.lit(11)), "entry_id").limit(TUNED_BY).select(F.col("entry_id").alias("query_id"), "vector")
    true = exact(index, asked, min(TUNED_K + 1, n)).where("query_id <> entry_id")
    pairs = true.join(dealt.select("entry_id", "list"), "entry_id").select("query_id", "list").collect()  # at most TUNED_BY * TUNED_K
    if not pairs:
        return len(index.centroids)
    vectors = {r["query_id"]: np.array(r["vector"]) for r in asked.collect()}
    ranks = []
    for q, where in ((r["query_id"], r["list"]) for r in pairs):
        unit = vectors[q] / np.abs(vectors[q]).max()
        sim = index.centroids @ (unit / math.sqrt(float(unit @ unit)))
        ranks.append(int((sim > sim[where]).sum()) + 1)
    ranks.sort()
    return ranks[min(len(ranks) - 1, math.ceil(target * len(ranks)) - 1)]


def _found(index: Index, queries: DataFrame, k: int, digits: int, wanted) -> DataFrame:
    """The ``k`` best of the lists that ``wanted`` (angles of queries and centroids, and the queries' column ``least``) asks for."""
    width, sizes, block = index.centroids.shape[1], index.sizes, index.block
    centroids = index.centroids
    least = "least" in queries.columns

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            units = _units(batch, width)
            ids = batch.column("query_id").to_numpy(zero_copy_only=False).astype(np.int64)
            floor = batch.column("least").to_numpy(zero_copy_only=False) if least else None
            each = max(1, link.CELLS // len(centroids))
            cuts = [slice(a, a + each) for a in range(0, len(units), each)]
            asked = np.concatenate([wanted(np.arccos(np.clip(units[c] @ centroids.T, -1.0, 1.0)), None if floor is None else floor[c]) & (sizes > 0) for c in cuts])
            raw = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
            for k_ in np.flatnonzero(asked.any(axis=0)):
                own = np.flatnonzero(asked[:, k_])
                for some in (own[a : a + block] for a in range(0, len(own), block)):
                    row = {"list": int(k_), "query_id": ids[some].tobytes(), "vectors": raw[some].tobytes()}
                    for part in range(-(-int(sizes[k_]) // block)):
                        yield pa.RecordBatch.from_pylist([row | {"part": part}], _ASKED)

    packed = _usable(queries, width).mapInArrow(probed, "list long, part long, query_id binary, vectors binary")
    # a query is in a row of each list that it asks for, which no estimate of sizes knows of: both sides are shuffled, none is broadcast
    pairs = packed.join(index.blocks().hint("merge"), ["list", "part"]).select(packed["query_id"], "vectors", "entry_id", "code", "entries")
    return link.best_of(pairs.mapInPandas(link.tiles(k, digits), link.FOUND), k)


def search(index: Index, queries: DataFrame, k: int = link.RETRIEVAL_K, probes: int | None = None, digits: int = DIGITS) -> DataFrame:
    """The ``k`` entries most similar to each query (query_id, vector) among those of the ``probes`` nearest lists: query_id, entry_id, code, similarity."""
    most, sizes = index.probes if probes is None else probes, index.sizes

    def wanted(angles: np.ndarray, _) -> np.ndarray:
        angles = np.where(sizes > 0, angles, 9.0)  # empty lists are no probes
        if most >= angles.shape[1]:
            return np.ones(angles.shape, bool)
        return angles <= np.partition(angles, most - 1, axis=1)[:, most - 1 : most]

    return _found(index, link.plain_queries(queries), k, digits, wanted)


def exact(index: Index, queries: DataFrame, k: int = link.RETRIEVAL_K, digits: int = DIGITS) -> DataFrame:
    """The ``k`` entries most similar to each query, as ``link.retrieve`` finds them."""
    reach = index.reach
    asked = link.plain_queries(queries)
    # the k-th best of one list is no better than the k-th best of all
    first = search(index, queries, k, 1, digits).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least"))
    bounds = asked.join(first.where(F.col("n") >= k).select("query_id", "least"), "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-1.0)))

    def wanted(angles: np.ndarray, least: np.ndarray) -> np.ndarray:
        nearest = np.cos(np.maximum(angles - reach[None, :] - SLACK, 0.0))
        return nearest >= least[:, None] - SLACK

    return _found(index, bounds, k, digits, wanted)


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """One row: how many of ``true`` (query_id, entry_id) there are, how many of them are ``found``, and their share."""
    pairs = true.select("query_id", "entry_id").join(found.select("query_id", "entry_id", F.lit(1).alias("hit")), ["query_id", "entry_id"], "left")
    return pairs.agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found")).withColumn("recall", F.col("n_found") / F.col("n_true"))
