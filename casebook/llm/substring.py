"""Substring deduplication by super-k-mer partitioning.

A window is ``n`` consecutive words of a document.  Each word that a window covers goes if the
window's word sequence also starts in a document with a smaller id.

Every window has a minimiser: the least-hashed run of ``RUN`` words in it.  Consecutive windows with the same minimiser, a super-k-mer, travel
as one packed string to the bucket of its hash, so equal windows meet there.  A bucket sorts
its windows and finds the smallest document of each.

A task holds what it has for each bucket until that is worth a row, so that rows are no shorter where buckets are many.
Before anything travels, windows that repeat within a batch are settled there: those outside
the batch's smallest document go at once, so a passage in a third of all rows
reaches its bucket once for each batch.  What a bucket and a batch found goes back to the documents by
groups of a hash of their id.  Buckets and groups are as many as the bytes of all texts ask for, a task each.

Runs that are minimisers of very many windows are told from a sample of documents and rank behind
all others, so that windows around a frequent run spread over many buckets.  The sample decides
on nothing but this order.

Windows are compared as sequences of 64-bit word hashes.

Cases: null text has no words; a document with fewer than ``n`` words loses nothing; windows repeated within
one document only stay; rows that repeat a doc_id are one document as to windows, each with its own text; a null
doc_id takes no part and loses nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, words

RUN = 2
#: Bytes of text of which a bucket has the windows, and of a group of documents; a window's words travel about three times.
PART_BYTES = 8 << 20
#: One document in this many tells the frequent minimisers.
SAMPLED = 64
BATCH_BYTES = 3_000_000
#: What a task holds before it sends a row for each bucket: so much a bucket, as short rows compress worse, but no more than fits beside its work.
ROW_BYTES, HELD_BYTES = 32 << 10, 64 << 20
#: Frequent runs that rank late, 8 bytes each in every task.
MOST_LATE = 1 << 16
_M1, _M2 = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_PLACE = np.uint64((1 << 24) - 1)
_LATE = np.uint64(1 << 63)


def _same(found: np.ndarray, i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Whether the windows at ``i`` and ``j`` hold the same words."""
    out = np.ones(len(i), bool)
    for k in range(n):
        out &= found[i + k] == found[j + k]
    return out


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` consecutive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def _minimisers(found: words.Words, at: np.ndarray, n: int, late: np.ndarray) -> np.ndarray:
    """The least run of each window: 1 bit whether it ranks late, 39 bits of hash, 24 bits of place.

    Places count from the start of a stretch of windows; stretches overlap by ``n`` - 1 words, so that places never reach the hash.
    """
    key = words.rolling(found.hash, RUN, _M2) >> np.uint64(25)
    packed = key << np.uint64(24)
    if len(late):
        packed[late[np.minimum(np.searchsorted(late, key), len(late) - 1)] == key] |= _LATE
    span = n - RUN + 1
    stretch = int(_PLACE) + 2 - span  # windows whose runs have places up to _PLACE
    out = []
    for a in range(0, max(1, len(packed) - span + 1), stretch):
        part = packed[a : a + stretch + span - 1]
        out.append(_sliding_min(part | np.arange(len(part), dtype=np.uint64), span))
    return np.concatenate(out)[at]


def _frequent(plain: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Runs that would be minimisers of more than an eighth of a bucket's mean share of windows, at most the ``MOST_LATE`` most frequent of them."""

    def counted(batches):
        for pdf in words.chunks(batches, BATCH_BYTES):
            found = words.split(list(pdf["text"]))
            doc = found.doc
            at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
            least = (_minimisers(found, at, n, np.zeros(0, np.uint64)) & ~_LATE) >> np.uint64(24) if len(at) else np.zeros(0, np.uint64)
            run, times = np.unique(least, return_counts=True)
            often = times * 8 * buckets > times.sum()
            yield pd.DataFrame({"run": np.append(run[often].astype(np.int64), -1), "n": np.append(times[often], times.sum())})

    sample = plain.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text")
    sums = words.mapped(sample, counted, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(min(8 * buckets, MOST_LATE) + 1).collect()
    total = max((r["n"] for r in sums if r["run"] == -1), default=0)
    return np.array(sorted(r["run"] for r in sums if r["run"] >= 0 and r["n"] * 8 * buckets > total), np.uint64)


def _groups(key: np.ndarray, hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """For each window (in order of document), the first equal one in that order."""
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], np.diff(key[order]) != 0))
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    lead = np.empty(len(key), np.int64)
    lead[order] = head
    other = np.flatnonzero(lead != np.arange(len(key)))
    wrong = other[~_same(hashes, at[other], at[lead[other]], n)]
    if len(wrong):  # two sequences with one hash: these are compared one by one
        seen: dict[bytes, int] = {}
        for w in np.flatnonzero(np.isin(key, key[wrong])).tolist():
            lead[w] = seen.setdefault(hashes[at[w] : at[w] + n].tobytes(), w)
    return lead


def _pack(numbers: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers).tobytes())


def _unpack(raw: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


class _Flags:
    """Windows found elsewhere: document, hash of its text and first word, dealt to groups of documents as arrays of three rows."""

    def __init__(self, groups: int):
        self.groups = groups

    def rows(self, doc: np.ndarray, text: np.ndarray, start: np.ndarray):
        if not len(doc):
            return
        group = (words.mix(doc.astype(np.uint64)) % np.uint64(self.groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        cut = np.flatnonzero(np.diff(group[order], prepend=-1)).tolist()
        for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
            o = order[a:b]
            yield int(group[o[0]]), np.stack([doc[o], text[o], start[o]])


class _Held:
    """What a task has for each bucket and group of documents, until it is worth a row each."""

    def __init__(self, buckets: int):
        self.buckets, self.size = buckets, 0
        self.texts: dict[int, list[bytes]] = {}
        self.runs: dict[int, list[np.ndarray]] = {}
        self.flags: dict[int, list[np.ndarray]] = {}

    def run(self, bucket: int, text: bytes, about: np.ndarray) -> None:
        self.texts.setdefault(bucket, []).append(text)
        self.runs.setdefault(bucket, []).append(about)
        self.size += len(text) + about.nbytes

    def flag(self, group: int, found: np.ndarray) -> None:
        self.flags.setdefault(group, []).append(found)
        self.size += found.nbytes

    def rows(self):
        """Rows (bucket, group, packed, runs), and nothing held any more."""
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for bucket in sorted(self.texts):
            yield bucket, None, pack.compress(b"\n".join(self.texts.pop(bucket))), _pack(np.concatenate(self.runs.pop(bucket), axis=1))
        for group in sorted(self.flags):
            yield group % self.buckets, group, _pack(np.concatenate(self.flags.pop(group), axis=1)), None
        self.size = 0


def _travel(pdf: pd.DataFrame, n: int, flags: _Flags, late: np.ndarray, held: _Held) -> None:
    """Hold a batch of documents' super-k-mers, and what it settled itself."""
    pdf = pdf.sort_values("doc_id", kind="stable")
    found = words.split(list(pdf["text"]))
    if len(found.hash) < n:
        return
    doc, h = found.doc, found.hash
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    if not len(at):
        return
    key = words.rolling(h, n, _M1)[at]
    ids, texts = pdf["doc_id"].to_numpy(np.int64), pdf["_text"].to_numpy(np.int64)
    own = ids[doc[at]]
    gone = own != own[_groups(key, h, at, n)]
    if gone.any():
        w = at[gone]
        for group, flagged in flags.rows(own[gone], texts[doc[w]], w - found.first[doc[w]]):
            held.flag(group, flagged)
    at = at[~gone]
    if not len(at):
        return
    least = _minimisers(found, at, n, late)
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (np.diff(at) != 1) | (doc[at][1:] != doc[at][:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    begin = at[first]
    bucket = (words.mix(least[first] >> np.uint64(24)) % np.uint64(held.buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    a, b = found.start[begin[order]].tolist(), found.end[begin[order] + size[order] + n - 2].tolist()
    owner = doc[begin]
    about = np.stack([ids[owner], texts[owner], begin - found.first[owner], size])[:, order]
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
    for i, j in zip(cut, [*cut[1:], len(order)], strict=True):
        held.run(int(bucket[order[i]]), b"\n".join([found.raw[x:y] for x, y in zip(a[i:j], b[i:j], strict=True)]), about[:, i:j].copy())


def _meet(pdf: pd.DataFrame, n: int, flags: _Flags):
    """Rows (group, flags) of one bucket."""
    import zstandard

    out = [(int(g), p) for g, p in zip(pdf["group"], pdf["packed"], strict=True) if g is not None and g == g]
    pdf = pdf[pdf["runs"].notna()]
    unpack = zstandard.ZstdDecompressor()
    hashes, places, owners = [], [], []
    base = 0
    for packed, runs in zip(pdf["packed"], pdf["runs"], strict=True):
        h = words.split([unpack.decompress(packed)]).hash
        ids, texts, start, size = _unpack(runs, np.int64).reshape(4, -1)
        stop = np.cumsum(size)
        inner = np.arange(stop[-1]) - np.repeat(stop - size, size)
        first = np.cumsum(size + n - 1) - (size + n - 1)
        hashes.append(h)
        places.append(np.repeat(first, size) + inner + base)
        owners.append(np.stack([np.repeat(ids, size), np.repeat(texts, size), np.repeat(start, size) + inner]))
        base += len(h)
    if hashes:
        h, at, own = np.concatenate(hashes), np.concatenate(places), np.concatenate(owners, axis=1)
        order = np.argsort(own[0], kind="stable")
        at, own = at[order], own[:, order]
        gone = own[0] != own[0][_groups(words.rolling(h, n, _M1)[at], h, at, n)]
        out += [(g, _pack(f)) for g, f in flags.rows(own[0][gone], own[1][gone], own[2][gone])]
    del hashes, places, owners
    words.release()
    return pd.DataFrame(out, columns=["group", "flags"])


def _kept(left: pd.DataFrame, right: pd.DataFrame, n: int, with_text: bool):
    """Documents of one group without the words that windows found elsewhere cover."""
    import zstandard

    starts: dict[tuple[int, int], np.ndarray] = {}
    if len(right):
        doc, text, start = np.concatenate([_unpack(f, np.int64).reshape(3, -1) for f in right["flags"]], axis=1)
        order = np.lexsort((start, text, doc))
        doc, text, start = doc[order], text[order], start[order]
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(text) != 0))))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(doc)], strict=True):
            starts[int(doc[a]), int(text[a])] = start[a:b]
    rows = []
    unpack = zstandard.ZstdDecompressor()
    for doc, known, key, packed in zip(left["doc_id"], left["known"], left["_text"], left["packed"], strict=True):
        found = unpack.decompress(packed).split()
        total = len(found)
        s = starts.get((int(doc), int(key))) if known else None
        if s is not None:
            cover = np.zeros(total + 1, np.int32)
            np.add.at(cover, s, 1)
            np.add.at(cover, s + n, -1)
            found = [w for w, c in zip(found, np.cumsum(cover[:-1]).tolist(), strict=True) if not c]
        kept = b" ".join(found)
        rows.append((int(doc) if known else pd.NA, total, total - len(found), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
    return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]).astype({"doc_id": "Int64"})


def _frame(held: _Held) -> pd.DataFrame:
    return pd.DataFrame(list(held.rows()), columns=["bucket", "group", "packed", "runs"]).astype({"group": "Int64"})


def deduplicate(docs: DataFrame, n: int = 13, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text: kept words joined by one space."""
    if n < RUN:
        raise ValueError(f"a window needs {RUN} words or more")
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"), F.col(id_col).isNotNull().alias("known"), F.col(text_col).cast("string").alias("text")).withColumn("_text", F.xxhash64("text"))

    # buckets and groups of bounded size, each a task's
    deal = max(store.partitions(docs.sparkSession), store.parts(store.text_bytes(plain, "text"), PART_BYTES))
    buckets, flags = deal, _Flags(deal)
    late = _frequent(plain.where("known"), n, buckets)

    enough = min(max(BATCH_BYTES, ROW_BYTES * buckets), HELD_BYTES)

    def travel(batches):
        held = _Held(buckets)
        for pdf in words.chunks(batches, BATCH_BYTES):
            _travel(pdf, n, flags, late, held)
            if held.size >= enough:
                yield _frame(held)
        if held.size:
            yield _frame(held)

    def meet(pdf):
        return _meet(pdf, n, flags)

    def kept(left, right):
        return _kept(left, right, n, with_text)

    travelled = words.mapped(plain.where("known"), travel, "bucket int, group int, packed binary, runs binary")
    met = travelled.repartitionById(buckets, "bucket").groupBy("bucket").applyInPandas(meet, "group int, flags binary")
    groups = flags.groups

    def place(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for pdf in words.chunks(batches, BATCH_BYTES):
            ids = pdf["doc_id"].where(pdf["known"], pdf["_text"]).to_numpy(np.int64).astype(np.uint64)  # null ids are dealt by text
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "known": pdf["known"], "packed": [pack.compress(t) for t in pdf["text"]], "_text": pdf["_text"], "group": (words.mix(ids) % np.uint64(groups)).astype(np.int64)})

    dealt = words.mapped(plain, place, "doc_id long, known boolean, packed binary, _text long, group int").repartitionById(groups, "group")
    out = dealt.groupBy("group").cogroup(met.repartitionById(groups, "group").groupBy("group")).applyInPandas(kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")
