"""Benchmark decontamination: word windows of benchmark items found in documents.

Texts are lower-cased (A-Z), and words are runs of digits, a-z and characters beyond ASCII.  A
window is ``n`` consecutive words of an item; an item with fewer is one window.  The items' texts are sent to the executors,
where each worker makes of them a sorted table of window hashes with where each window lies, and a filter of some twenty bits a window.
Every window of every document is looked up by hash; each hit is verified on all of its words' hashes and, once for each window
and batch, on the words themselves.

What is broadcast has a bound: items are dealt to blocks of at most about ``BLOCK_BYTES`` of text; a block is collected when its turn comes, and
let go afterwards.  One block is the usual case.  Where there are more, a filter of the windows of all items goes first: it passes documents that
may hold one, few beside those that do, and only these are stored and looked up block by block.  Its size has a bound too (``SIEVE_BYTES``, at which it
holds some twenty million windows well); beyond, it passes more.

Cases: null text has no words; null item texts are ignored, and so are null item ids unless ``nameless`` asks for
their windows, which then hit under a null item, one for all of them, as in the query's SQL; an item with an id seen
before adds to it, and repeated items count once; an empty benchmark hits nothing; repeated documents are judged row by row;
other columns pass through ``clean`` unchanged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, words

BLOCK_BYTES = 8 << 20
#: The filter of all windows, where there are several blocks: bytes at most (three a window up to there), bits set for each window, and bytes of a piece.
SIEVE_BYTES, PROBES, PIECE_BYTES = 64 << 20, 8, 1 << 20
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MULTIPLIER = 0xA0761D6478BD642F
FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _folded(texts: list[bytes]) -> words.Words:
    return words.split([t.translate(_FOLD) for t in texts])


class _Table:
    """The distinct windows of ``size`` words at places ``at`` of ``found``, each with the items that hold it."""

    def __init__(self, found: words.Words, size: int, at: np.ndarray, item: np.ndarray):
        hashes = words.rolling(found.hash, size, _MULTIPLIER)[at]
        order = np.lexsort((item, hashes))
        hashes, at, item = hashes[order], at[order], item[order]
        new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        first = np.flatnonzero(new)
        self.size, self.hashes, self.at = size, hashes[first], at[first]
        keep = new | np.concatenate(([True], item[1:] != item[:-1]))
        self.item = item[keep]
        self.begin = np.append(np.flatnonzero(new[keep]), len(self.item))  # of each window's items
        bits = 1 << max(10, int(len(first) * 16 - 1).bit_length())
        self.mask, self.bits = np.uint64(bits - 1), np.zeros(bits >> 3, np.uint8)
        place = self.hashes & self.mask
        np.bitwise_or.at(self.bits, place >> np.uint64(3), np.left_shift(np.uint8(1), (place & np.uint64(7)).astype(np.uint8)))

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are in the table, and where there."""
        place = hashes & self.mask
        maybe = np.flatnonzero((self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
        where = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        sure = self.hashes[where] == hashes[maybe]
        return maybe[sure], where[sure]


class Windows:
    """The windows of a block of items."""

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        names = sorted({i for i, _ in items}, key=lambda i: (i is None, i or ""))
        number = {i: k for k, i in enumerate(names)}
        self.names = names
        self.words = _folded([t.encode() for _, t in items])
        first = self.words.first
        size = np.minimum(np.diff(first), n)
        windows = np.where(size > 0, np.diff(first) - size + 1, 0)
        at = np.repeat(first[:-1], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        item = np.repeat(np.array([number[i] for i, _ in items], np.int64), windows)
        width = np.repeat(size, windows)
        self.tables = [_Table(self.words, w, at[width == w], item[width == w]) for w in np.unique(width).tolist()]

    def _verified(self, found: words.Words, at: np.ndarray, table: _Table, where: np.ndarray) -> np.ndarray:
        """Which hits have the same words."""
        same, own = np.ones(len(at), bool), table.at[where]
        for k in range(table.size):
            same &= found.hash[at + k] == self.words.hash[own + k]
        some, first = np.unique(where, return_index=True)
        for w, k in zip(some.tolist(), first.tolist(), strict=True):  # each window once: what else hits it has the same hashes, word by word
            a, b, last = int(at[k]), int(table.at[w]), table.size - 1
            if found.raw[found.start[a] : found.end[a + last]].split() != self.words.raw[self.words.start[b] : self.words.end[b + last]].split():
                same[where == w] = False
        return same

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str], list[tuple[int, int]]]]:
        """For each text: its number of words, the word ranges hit, the items, and the ranges as byte offsets."""
        found = _folded(texts)
        doc, first = found.doc, found.first
        starts, stops, owners, items = [], [], [], []
        for table in self.tables:
            at, where = table.hits(words.rolling(found.hash, table.size, _MULTIPLIER))
            inside = doc[at] == doc[at + table.size - 1]
            at, where = at[inside], where[inside]
            good = self._verified(found, at, table, where)
            at, where = at[good], where[good]
            starts.append(at)
            stops.append(at + table.size)
            # each document and window once, then their items
            pair = np.unique(doc[at] * len(table.hashes) + where)
            d, w = pair // len(table.hashes), pair % len(table.hashes)
            count = table.begin[w + 1] - table.begin[w]
            index = np.repeat(table.begin[w] - np.cumsum(count) + count, count) + np.arange(count.sum())
            owners.append(np.repeat(d, count))
            items.append(table.item[index])
        spans: dict[int, list] = {}
        names: dict[int, set] = {}
        if starts:
            at, stop = np.concatenate(starts), np.concatenate(stops)
            order = np.lexsort((stop, at))
            for a, b in zip(at[order].tolist(), stop[order].tolist(), strict=True):
                own = spans.setdefault(int(doc[a]), [])
                if own and a <= own[-1][1]:
                    own[-1] = (own[-1][0], max(b, own[-1][1]))
                else:
                    own.append((a, b))
            for d, i in np.unique(np.stack((np.concatenate(owners), np.concatenate(items))), axis=1).T.tolist():
                names.setdefault(d, set()).add(self.names[i])
        begin = np.concatenate(([1], np.cumsum([len(t) + 1 for t in texts]) + 1))
        out = []
        for d in range(len(texts)):
            base, own = int(first[d]), spans.get(d, [])
            places = [(int(found.start[a] - begin[d]), int(found.end[b - 1] - begin[d])) for a, b in own]
            out.append((int(first[d + 1]) - base, [(a - base, b - base) for a, b in own], names.get(d, set()), places))
        return out


def _items(benchmark: DataFrame, id_col: str, text_col: str, nameless: bool = False) -> tuple[DataFrame, int]:
    """Distinct items (id, text), and how many blocks they make."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).na.drop(subset=["text"] if nameless else ["id", "text"]).distinct()
    return items, store.parts(items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0, BLOCK_BYTES)


def _blocks(items: DataFrame, count: int):
    """Broadcasts of the items, each of bounded size, made one at a time, and whether each is the last."""
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k).collect()  # at most about BLOCK_BYTES
        yield k + 1 == count, items.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])


def _item_windows(texts: list[bytes], n: int):
    """Width and hashes of the windows of items, by width."""
    found = _folded(texts)
    size = np.minimum(np.diff(found.first), n)
    for width in np.unique(size[size > 0]).tolist():
        hashes = words.rolling(found.hash, width, _MULTIPLIER)
        first, count = found.first[:-1][size == width], np.diff(found.first)[size == width] - width + 1
        at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        yield width, hashes[at]


class Sieve:
    """A filter of the windows of all items: ``PROBES`` bits for each, in ``bits``, and the windows' ``widths``."""

    def __init__(self, bits: np.ndarray, widths: list[int]):
        self.bits, self.widths = bits, widths

    @staticmethod
    def places(hashes: np.ndarray, probe: int, size: int) -> np.ndarray:
        return words.mix(hashes + np.uint64(probe) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(8 * size)

    def add(self, hashes: np.ndarray) -> None:
        for probe in range(PROBES):
            at = self.places(hashes, probe, len(self.bits))
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))

    def suspects(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many words each text has, and whether any of its windows may be an item's."""
        found = _folded(texts)
        out = np.zeros(len(texts), bool)
        doc = found.doc
        for width in self.widths:
            hashes = words.rolling(found.hash, width, _MULTIPLIER)
            at = np.flatnonzero(doc[: len(hashes)] == doc[width - 1 :]) if len(hashes) else np.zeros(0, np.int64)
            for probe in range(PROBES):
                place = self.places(hashes[at], probe, len(self.bits))
                at = at[(self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            out[doc[at]] = True
        return np.diff(found.first), out


def _sieve(items: DataFrame, n: int) -> Sieve:
    """One filter of all windows of all items: each task makes its own, and these are united piece by piece."""

    def counted(batches):
        for pdf in words.chunks(batches):
            yield pd.DataFrame([(w, len(h)) for w, h in _item_windows(list(pdf["text"]), n)], columns=["width", "n"])

    sizes = words.mapped(items.select("text"), counted, "width long, n long").groupBy("width").agg(F.sum("n").alias("n")).collect()  # a row for each width up to n
    size = min(SIEVE_BYTES, max(1024, 3 * sum(r["n"] for r in sizes)))

    def made(batches):
        own = Sieve(np.zeros(size, np.uint8), [])
        for pdf in words.chunks(batches):
            for _, hashes in _item_windows(list(pdf["text"]), n):
                own.add(hashes)
        for k in range(0, size, PIECE_BYTES):
            if own.bits[k : k + PIECE_BYTES].any():
                yield pd.DataFrame({"piece": [k], "bits": [own.bits[k : k + PIECE_BYTES].tobytes()]})

    def united(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]])
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "bits": [bits.tobytes()]})

    pieces = words.mapped(items.select("text"), made, "piece long, bits binary").groupBy("piece").applyInPandas(united, "piece long, bits binary")
    bits = np.zeros(size, np.uint8)
    for r in pieces.collect():  # at most SIEVE_BYTES
        bits[r["piece"] : r["piece"] + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return Sieve(bits, sorted(r["width"] for r in sizes))


def _windows(shipped, n: int) -> Windows:
    """The windows of a broadcast block, built once in each worker."""
    return words.kept(("windows", hash(tuple(shipped.value)), n), lambda: Windows(shipped.value, n))


def find(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", nameless: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, spans (word ranges hit, merged) and items, sorted as strings, a null one last."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = out.schema["doc_id"].dataType.simpleString()
    items, count = _items(benchmark, item_col, item_text_col, nameless)
    clear = None
    if count > 1:  # texts are read once, and only those that may hold a window are looked up block by block
        sieve = docs.sparkSession.sparkContext.broadcast(_sieve(items, n))

        def sieved(batches):
            for pdf in words.chunks(batches):
                size, some = sieve.value.suspects(list(pdf["text"]))
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": size, "text": [t.decode() if s else None for t, s in zip(pdf["text"], some, strict=True)]})

        known = store.materialize(words.mapped(out, sieved, f"doc_id {kind}, n_words long, text string"), "sieved")
        clear = known.where("text is null").select("doc_id", "n_words", F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
        out = known.where("text is not null").select("doc_id", "text")
    for last, shipped in _blocks(items, count):
        keep = not last

        def scan(batches, shipped=shipped, keep=keep):
            windows = _windows(shipped, n)
            for pdf in words.chunks(batches):
                rows = windows.scan(list(pdf["text"]))
                if "spans" in pdf:
                    rows = [(n_words, _merged([*spans, *((s["start"], s["end"]) for s in before)]), items | set(had), None) for (n_words, spans, items, _), before, had in zip(rows, pdf["spans"], pdf["items"], strict=True)]
                done = pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": [r[0] for r in rows], "spans": [[{"start": a, "end": b} for a, b in r[1]] for r in rows], "items": [sorted(r[2], key=lambda i: (i is None, i or "")) for r in rows]})
                if keep:
                    done["text"] = [t.decode() for t in pdf["text"]]
                yield done

        out = words.mapped(out, scan, f"doc_id {kind}, {FOUND}" + ", text string" * keep)
        if keep:
            out = store.materialize(out, "scanned")
            shipped.unpersist()
    return out if clear is None else out.select(*clear.columns).union(clear)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, whole: bool = True, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", nameless: bool = False) -> DataFrame:
    """``docs`` without the documents that hold a window (``whole``), or without the spans hit.

    Items with a null id are searched too if ``nameless``.  All columns stay.  With spans cut, what is cut goes from the first hit word to the last,
    and texts without hits stay as they are.
    """
    items, count = _items(benchmark, item_col, item_text_col, nameless)
    safe = None
    if count > 1:  # only documents that may hold a window are looked up block by block
        sieve = docs.sparkSession.sparkContext.broadcast(_sieve(items, n))

        def suspects(texts: list[str | None]) -> list[bool]:
            return sieve.value.suspects([b"" if t is None else t.encode() for t in texts])[1].tolist()

        safe = words.keep_where(docs, text_col, lambda texts: [not s for s in suspects(texts)])
        docs = store.materialize(words.keep_where(docs, text_col, suspects), "suspects")
    for last, shipped in _blocks(items, count):

        def scan(texts, shipped=shipped):
            return _windows(shipped, n).scan([b"" if t is None else t.encode() for t in texts])

        def clear(texts, scan=scan) -> list[bool]:
            return [not spans for _, spans, _, _ in scan(texts)]

        def cut(texts, scan=scan) -> list[str | None]:
            return [_without(old, places) if places else old for old, (_, _, _, places) in zip(texts, scan(texts), strict=True)]

        docs = words.keep_where(docs, text_col, clear) if whole else words.replace_text(docs, text_col, cut)
        if not last:
            docs = store.materialize(docs, "cleaned")
            shipped.unpersist()
    return docs if safe is None else docs.union(safe)


def _without(text: str, places: list[tuple[int, int]]) -> str:
    raw, at, left = text.encode(), 0, []
    for a, b in places:
        left.append(raw[at:a])
        at = b
    return b"".join([*left, raw[at:]]).decode()


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of what ``find`` returned."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
