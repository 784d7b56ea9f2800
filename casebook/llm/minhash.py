"""MinHash near-deduplication with odd sketches.

A document is its set of five-word shingles.  Documents with equal sets are one class.  Of each
class's ``SAMPLES`` MinHash values, bands of ``ROWS`` make bucket keys, and all are folded into an odd sketch: a bitmap of
parities, of which the XOR of two has a population count that tells how many
values differ.  In a bucket, sketches are compared inside the task; what leaves it is a spanning forest of the
pairs that may be similar, never all pairs.  Connected, these give coarse clusters that hold
every similar pair.  In each cluster full sets are compared in the same way, and the links found are
connected to components.

Buckets and clusters larger than ``BLOCK`` are dealt to blocks, so neither a group of copies nor one of near copies ends in one
task.  Each block first meets about ``PIVOTS`` rows of its bucket, copied to all of its blocks.  Rows of one group of near copies
are thereby connected, and pairs among them need no comparison any more.  What lies outside a bucket's largest
component then meets all blocks, so no pair of rows in different components is left out; a
group of n near copies costs n rows, not n times its blocks.  Where full sets are compared and that is more than ``FEW_GROUPS`` blocks, as
among pages of one template that are not similar enough, sets meet by their first shingles in an order that has the cluster's common ones last: two
similar sets share one of these, and pages that differ in more than similar ones may share none.

A similar pair is missed if it shares no band, with probability 6e-11 at similarity 0.85 and
1e-7 at 0.8, or if its sketches differ by 5.5 standard deviations more than expected.

Cases: null text, or text without words, has no shingles and is linked with nothing; fewer than
five words are one shingle; rows that repeat a doc_id are one document if their sets are equal, their sets linked
through their id otherwise, and are kept or go together; rows with a null doc_id get null component and are kept; other columns are ignored by ``link`` and pass ``deduplicate``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components, store, words

BANDS, ROWS, BITS = 40, 5, 512
SAMPLES = BANDS * ROWS
BLOCK, PIVOTS = 256, 8
#: Blocks outside a cluster's largest component that meet all others; more meet by their first shingles.
FEW_GROUPS = 4
#: Members of clusters whose places are broadcast, 32 bytes each.
FEW_MEMBERS = 1_000_000
#: Keys of buckets with several rows that are broadcast, 16 bytes each.
FEW_KEYS = 1_000_000
_DRAWN = np.random.Generator(np.random.PCG64(8128)).integers(0, 2**32, (2, SAMPLES), dtype=np.uint64).astype(np.uint32)
_A, _B = _DRAWN[0] | np.uint32(1), _DRAWN[1]
_U64 = np.uint64


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    found = words.split([t.lower() for t in texts])
    rolled = words.rolling(found.hash, size, 0xE7037ED1A0B428DB)
    out = []
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            out.append(words.mix(words.rolling(found.hash[a:b], b - a, 0x8EBC6AF09C88C6E3) + _U64(b - a)))
        else:
            out.append(np.zeros(0, _U64))
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    """``SAMPLES`` minima over a set that is not empty."""
    x = (shingles >> _U64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        y = _A[:, None] * x[k : k + 1024]
        y += _B[:, None]
        np.minimum(out, y.min(axis=1), out=out)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of MinHash values."""
    v = values.reshape(len(values), BANDS, ROWS).astype(_U64)
    key = words.mix(np.arange(BANDS, dtype=_U64) + _U64(0x9E3779B97F4A7C15)) + np.zeros((len(values), 1), _U64)
    for k in range(ROWS):
        key = words.mix(key * _U64(0xD6E8FEB86659FD93) + v[:, :, k])
    return key.astype(np.int64)


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """Parity bitmaps (rows of ``BITS`` / 64 words) of rows of MinHash values."""
    place = words.mix(values.astype(_U64) + (np.arange(SAMPLES, dtype=_U64) << _U64(32))) % _U64(BITS)
    flat = place.astype(np.int64) + np.arange(len(values))[:, None] * BITS
    odd = np.bincount(flat.ravel(), minlength=len(values) * BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(values), BITS), axis=1).view(_U64)


def most_different(similarity: float) -> int:
    """Bits that the sketches of two sets this similar may differ in."""
    differ = 2 * SAMPLES * (1 - similarity)
    differ += 5.5 * math.sqrt(4 * SAMPLES * similarity * (1 - similarity) + differ)
    return math.ceil(BITS / 2 * (1 - math.exp(-2 * differ / BITS)))


def _runs(batches, column: str):
    """Frames that hold all rows of some values of ``column``, from batches sorted by it."""
    held = None
    for pdf in batches:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        key = pdf[column].to_numpy()
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if last:
            yield pdf.iloc[:last]
        held = pdf.iloc[last:]
    if held is not None and len(held):
        yield held
    del held
    words.release()


def _template(pdf: pd.DataFrame, key: str) -> pd.DataFrame:
    """The shingles that at least half of a cluster's pivots hold."""
    sets = [np.frombuffer(s, _U64) for s in pdf["shingles"]]
    some, times = np.unique(np.concatenate(sets), return_counts=True)
    return pd.DataFrame({"_key": [pdf[key].iloc[0]], "_blocks": [pdf["_blocks"].iloc[0]], "_template": [some[2 * times >= len(sets)].tobytes()]})


def _prefixes(batches, key: str, percent: int):
    """Rows (id, token, indexed, rest): the first shingles of each set in an order that is one for its cluster, its template last.

    Of two sets with 100 * intersection >= percent * union, the first common shingle is among the first |x| - ceil(percent * |x| / 100) + 1 of either,
    and ``indexed``, among the first |y| - ceil(2 * percent * |y| / (100 + percent)) + 1, in the smaller one.
    """
    for pdf in batches:
        ids, tokens, indexed, rest = [], [], [], []
        for i, k, shingles, template, outside in zip(pdf["id"], pdf[key], pdf["shingles"], pdf["_template"], pdf["_rest"], strict=True):
            own, common = np.frombuffer(shingles, _U64), np.frombuffer(template, _U64)
            late = np.isin(own, common, assume_unique=True)
            size = len(own)
            first = np.concatenate((own[~late], own[late]))[: size - -(-percent * size // 100) + 1]
            tokens.append(words.mix(first ^ words.mix(np.array([k], np.int64).astype(_U64))).astype(np.int64))
            indexed.append(np.arange(len(first)) < size - -(-2 * percent * size // (100 + percent)) + 1)
            ids.append(np.full(len(first), i))
            rest.append(np.full(len(first), outside))
        if ids:
            yield pd.DataFrame({"id": np.concatenate(ids), "token": np.concatenate(tokens), "indexed": np.concatenate(indexed), "rest": np.concatenate(rest)})
    words.release()


def _links(rows: DataFrame, key: str, column: str, compare, scratch: store.Scratch, values: DataFrame | None = None, percent: int | None = None) -> DataFrame:
    """Links (a, b) that connect all rows (id, ``key``) of a key that ``compare`` finds similar.

    With ``percent``, rows hold sets of shingles, and what lies outside the largest component of a large key meets only rows that it shares
    a first shingle with (``_prefixes``).  What is compared is ``column`` of ``rows``, or of ``values`` (id, ``column``) where that is given.  ``compare`` maps frames of units,
    sorted by ``unit``, to links: a unit is one list of rows, of which all pairs are compared (side 0 only), or two lists (sides 0 and 1).
    """
    spread, carried = store.partitions(rows.sparkSession), [] if values else [column]
    sizes = scratch.store(rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1"), "sizes")
    # keys with several rows are few beside all: while they can be broadcast, no row moves to be counted
    sized = rows.join(F.broadcast(sizes) if sizes.count() <= FEW_KEYS else sizes, key)

    def found(units: DataFrame) -> DataFrame:
        met = units.join(values, "id") if values else units
        return met.select("unit", "id", "side", column).repartition(spread, "unit").sortWithinPartitions("unit").mapInPandas(compare, "a long, b long")

    def unit(df: DataFrame, kind: int, side: int, *parts: str) -> DataFrame:
        return df.select(F.xxhash64(key, *parts, F.lit(kind)).alias("unit"), "id", F.lit(side).alias("side"), *carried)

    def copies(df: DataFrame, count: str, name: str) -> DataFrame:
        return df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)).alias(name))

    def dealt(column: str, seed: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.col(column))

    small = unit(sized.where(F.col("_n") <= BLOCK), 0, 0)
    if sizes.where(F.col("_n") > BLOCK).isEmpty():
        return found(small)
    large = sized.where(F.col("_n") > BLOCK).withColumn("_blocks", F.ceil(F.col("_n") / F.lit(BLOCK)))
    large = scratch.store(large.withColumn("_block", dealt("_blocks", 7)), "large")
    # every block meets the pivots
    pivots = copies(large.where(dealt("_n", 11) < PIVOTS).drop("_block"), "_blocks", "_block")
    first = scratch.store(found(small.union(unit(large, 1, 0, "_block")).union(unit(pivots, 1, 1, "_block"))), "first")
    # what is not in a key's largest component meets everything
    comps = components.components(first, reduced=True, into=scratch).withColumnRenamed("id", "_node")
    told = scratch.store(large.join(comps, F.col("id") == F.col("_node"), "left").withColumn("_in", F.coalesce("component", "id")).drop("_node", "component"), "told")
    each = told.groupBy(F.col(key).alias("_key"), "_in").agg(F.count("*").alias("_size"))
    main = each.groupBy("_key").agg(F.max_by("_in", F.struct("_size", "_in")).alias("_main"), (F.sum("_size") - F.max("_size")).alias("_rest"))
    main = scratch.store(main.where("_rest > 0").withColumn("_groups", F.ceil(F.col("_rest") / F.lit(BLOCK))), "main")
    if main.isEmpty():
        return first
    if percent is not None:
        heavy = scratch.store(main.where(F.col("_groups") > FEW_GROUPS).select("_key", "_main"), "heavy")
        if not heavy.isEmpty():
            members = scratch.store(told.join(heavy, F.col(key) == F.col("_key")).withColumn("_rest", F.col("_in") != F.col("_main")).drop("_key", "_main", "_in"), "members")
            lead = members.where(dealt("_n", 17) < 2 * PIVOTS).select(key, "_blocks", "shingles")
            common = lead.groupBy(key).applyInPandas(lambda pdf: _template(pdf, key), "_key long, _blocks long, _template binary")
            # a copy of the template for each block of its cluster
            common = copies(common, "_blocks", "_of").drop("_blocks")
            met = members.join(common, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_of")), "left").withColumn("_template", F.coalesce("_template", F.lit(b"")))
            made = met.select("id", key, "shingles", "_template", "_rest").mapInPandas(lambda b: _prefixes(b, key, percent), "id long, token long, indexed boolean, rest boolean")
            made = scratch.store(made, "prefixes")
            some = made.groupBy("token").agg(F.count("*").alias("_all"), F.count_if("indexed").alias("_firsts"), F.count_if("rest").alias("_rests")).where("_all > 1 and _firsts > 0 and _rests > 0")
            shared = scratch.store(made.join(some.select(F.col("token").alias("_token")), F.col("token") == F.col("_token")).select("id", "token"), "shared")
            if not shared.isEmpty():
                first = first.union(_links(shared, "token", column, compare, scratch, members.select("id", column)))
            main = main.where(F.col("_groups") <= FEW_GROUPS)
    left = told.join(main, F.col(key) == F.col("_key"))
    rest = copies(left.where("_in <> _main").withColumn("_group", dealt("_groups", 13)).drop("_block"), "_blocks", "_block")
    return first.union(found(unit(rest, 2, 0, "_group", "_block").union(unit(copies(left, "_groups", "_group"), 2, 1, "_group", "_block"))))


def _pairs_of(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of a unit to compare: two lists, and whether they are the same.  An id may be in both."""
    if side.any():
        return np.flatnonzero(side == 0), np.flatnonzero(side), False
    every = np.arange(len(side))
    return every, every, True


def _similar_sketches(batches, limit: int):
    kept = []
    for pdf in _runs(batches, "unit"):
        unit, ids, side = pdf["unit"].to_numpy(), pdf["id"].to_numpy(np.int64), pdf["side"].to_numpy()
        sketch = np.frombuffer(b"".join(pdf["sketch"]), _U64).reshape(len(pdf), -1)
        first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        size = np.diff(np.append(first, len(unit)))
        two = first[size == 2]
        two = two[(ids[two] != ids[two + 1]) & ((side[two] != side[two + 1]) | (side[two] == 0))]
        near = np.bitwise_count(sketch[two] ^ sketch[two + 1]).sum(axis=1, dtype=np.int64) <= limit
        kept.append(np.stack([ids[two[near]], ids[two[near] + 1]], axis=1))
        for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            left, right, same = _pairs_of(side[a : a + n])
            own, s = ids[a : a + n], sketch[a : a + n]
            for k in range(0, len(left), 128):
                part = left[k : k + 128]
                far = np.zeros((len(part), len(right)), np.int64)
                for w in range(s.shape[1]):
                    far += np.bitwise_count(s[part, w][:, None] ^ s[right, w])
                i, j = np.nonzero(far <= limit)
                found = np.stack([own[part[i]], own[right[j]]], axis=1)
                kept.append(components.forest(found[found[:, 0] != found[:, 1]]))
        if sum(map(len, kept)) > 200_000:
            kept = [components.forest(np.concatenate(kept))]
    pairs = components.forest(np.concatenate(kept)) if kept else np.zeros((0, 2), np.int64)
    yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _similar_sets(batches, percent: int):
    """Spanning links of the pairs with 100 * intersection >= percent * union."""
    for pdf in _runs(batches, "unit"):
        unit, ids, side = pdf["unit"].to_numpy(), pdf["id"].to_numpy(np.int64), pdf["side"].to_numpy()
        sets = [np.frombuffer(s, _U64) for s in pdf["shingles"]]
        size = np.array([len(s) for s in sets], np.int64)
        first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        kept = []
        for a, n in zip(first.tolist(), np.diff(np.append(first, len(unit))).tolist(), strict=True):
            left, right, same = _pairs_of(side[a : a + n])
            own = sets[a : a + n]
            both = np.zeros((len(left), len(right)), np.float32)
            if n == 2:
                both[:] = len(np.intersect1d(own[0], own[1], assume_unique=True))
            else:
                # shingles that at least two of the sets hold, as columns of 0 and 1
                flat = np.concatenate(own)
                owner = np.repeat(np.arange(n), size[a : a + n])
                _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
                rank = np.cumsum(times > 1) - 1
                held = times[column] > 1
                owner, column = owner[held], rank[column[held]]
                order = np.argsort(column, kind="stable")
                owner, column = owner[order], column[order]
                for c in range(0, int(rank[-1]) + 1 if len(rank) else 0, 4096):
                    i, j = np.searchsorted(column, (c, c + 4096))
                    table = np.zeros((n, 4096), np.float32)
                    table[owner[i:j], column[i:j] - c] = 1
                    both += table[left] @ (table if same else table[right]).T
            i, j = np.nonzero(100 * both.astype(np.float64) >= percent * (size[a + left][:, None] + size[a + right] - both.astype(np.float64)))
            keep = ids[a + left[i]] != ids[a + right[j]]
            kept.append(components.forest(np.stack([ids[a + left[i[keep]]], ids[a + right[j[keep]]]], axis=1)))
        pairs = components.forest(np.concatenate(kept)) if kept else np.zeros((0, 2), np.int64)
        yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def link(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document; ``percent`` is the least similarity in hundredths."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("source", F.xxhash64("text"))

    def signed(batches):
        import hashlib

        for pdf in words.chunks(batches):
            sets = shingle_sets(list(pdf["text"]), size)
            values = np.stack([minhash(s) if len(s) else np.zeros(SAMPLES, np.uint32) for s in sets])
            full = [len(s) > 0 for s in sets]
            keys, sketch = band_keys(values), odd_sketch(values)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"],
                "source": pdf["source"].to_numpy(),
                "n_shingles": [len(s) for s in sets],
                "same": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if f else None for s, f in zip(sets, full, strict=True)],
                "bands": [k if f else None for k, f in zip(keys, full, strict=True)],
                "sketch": [s.tobytes() if f else None for s, f in zip(sketch, full, strict=True)],
            })

    signs = store.materialize(words.mapped(plain, signed, "doc_id long, source long, n_shingles long, same binary, bands array<long>, sketch binary"), "signs")
    scratch = store.Scratch(spark, "minhash")
    known = signs.where("doc_id is not null and same is not null")
    # one node for each set, with a row that has it
    lead = known.groupBy("same").agg(F.min(F.struct("doc_id", "source")).alias("row"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    lead = scratch.store(lead.select("same", "n", F.col("row.doc_id").alias("least"), F.col("row.source").alias("from"), "bands", "sketch", F.monotonically_increasing_id().alias("node")), "lead")
    # buckets
    limit = most_different(percent / 100)
    keys = lead.select(F.col("node").alias("id"), F.explode("bands").alias("key"))
    coarse = _links(keys, "key", "sketch", lambda b: _similar_sketches(b, limit), scratch, lead.select(F.col("node").alias("id"), "sketch"))
    coarse = components.components(coarse, reduced=True, into=scratch)
    # full sets of what is in a cluster, from one row each
    asked = coarse.join(lead.select("node", "least", "from"), F.col("id") == F.col("node")).select("id", F.col("component").alias("key"), "least", "from")
    asked = scratch.store(asked, "asked")
    if asked.count() <= FEW_MEMBERS:  # then no text moves
        asked = F.broadcast(asked)
    members = plain.join(asked, (F.col("doc_id") == F.col("least")) & (F.col("source") == F.col("from"))).groupBy("id", "key").agg(F.first("text").alias("text"))

    def sets_of(batches):
        for pdf in words.chunks(batches):
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "key": pdf["key"].to_numpy(), "shingles": [s.tobytes() for s in shingle_sets(list(pdf["text"]), size)]})

    full = scratch.store(words.mapped(members, sets_of, "id long, key long, shingles binary"), "sets")
    links = scratch.store(_links(full, "key", "shingles", lambda b: _similar_sets(b, percent), scratch, percent=percent), "links")
    # sets of rows that repeat an id are linked through it
    twice = scratch.store(known.groupBy("doc_id").agg(F.min("same").alias("one"), F.max("same").alias("other")).where("one <> other").select(F.col("doc_id").alias("_id")), "twice")
    if not twice.isEmpty():
        own = known.join(twice, F.col("doc_id") == F.col("_id")).select("_id", "same").join(lead.select("same", "node"), "same").select("_id", "node").distinct()
        own = scratch.store(own, "own")
        least = own.groupBy("_id").agg(F.min("node").alias("a"))
        links = links.union(own.join(least, "_id").where("a <> node").select("a", F.col("node").alias("b")))
    comps = components.components(links, reduced=True, into=scratch)
    # the least id of each component; a set without links has that of its own rows
    named = scratch.store(lead.select("same", "n", "least", "node").join(comps, F.col("node") == F.col("id"), "left").select("same", "n", "least", "component"), "named")
    told = named.where("component is not null").groupBy("component").agg(F.min("least").alias("_least"))
    linked = named.join(told, "component").select(F.col("same").alias("_same"), "_least")
    found = store.materialize(linked.union(named.where("component is null and n > 1").select("same", "least")), "found")
    scratch.clear()
    # rows that take no part don't meet as one null key
    apart = F.col("doc_id").isNull() | F.col("same").isNull()
    out = signs.where(~apart).join(found, F.col("same") == F.col("_same"), "left").select("doc_id", "n_shingles", F.coalesce("_least", "doc_id").alias("component_id"))
    out = out.union(signs.where(apart).select("doc_id", "n_shingles", "doc_id"))
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component left, the one with the smallest id."""
    name = store.free_name(docs, "_gone")
    gone = link(docs, percent, size, id_col, text_col).where("not kept").select(F.col("doc_id").alias(name))
    named = docs.where(F.col(id_col).isNotNull()).join(gone, F.col(id_col) == F.col(name), "left_anti")
    return named.union(docs.where(F.col(id_col).isNull()))  # rows that stay anyway don't meet as one null key
