"""Best-fit packing of token sequences (bounded-space, online).

``tokenize`` cuts every text into pieces of at most ``capacity`` ids, ``pack`` places pieces
in sequences, ``pack_documents`` does both.  A packer keeps a fixed number of open bins in a
bitset keyed by free space: bit f is set while a bin with f free places is open, so the best
fit for n ids is the lowest set bit at or above n.  When no bin fits and the number of open
bins is at its limit, the fullest one (lowest set bit) closes first.

A packer takes the pieces of a partition as a stream, where they lie: nothing is shuffled, and what it
holds is its open bins and ``LOOKAHEAD`` pieces, which are placed longest first.  Each packer leaves its last
bins partly filled, about two in a thousand for a packer of 1,000 pieces.

Cases: null text counts as empty and yields its end id only; an empty table yields no rows;
repeated rows and ids, and rows with a null id, are packed like any others; other columns are ignored.
"""

from __future__ import annotations

import json
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, words

CACHE_UNITS = 600_000
#: Text that is encoded at a time; more finds more repeats and takes more memory.
BATCH_BYTES = 3_000_000
#: Bins that a packer holds open, and pieces that it orders at a time: a look-ahead beyond the open bins closes bins too early.
OPEN_BINS = LOOKAHEAD = 1024
#: Bytes of text that are enough for a packer.
PACKER_BYTES = 8 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
#: The white space of Unicode beyond ASCII.
_WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


class Encoder:
    """Ids of a byte-level BPE tokenizer file, as little-endian unsigned 32-bit numbers.

    A boundary between a character and white space is always one between pre-tokens.  So a
    text without two white-space characters in a row is the concatenation of its units
    "word", " word", ....  Each distinct unit is encoded once, those new in a batch in one
    call, and kept under its 64-bit hash while at most ``CACHE_UNITS`` are.  Texts with runs of white space, with such beyond ASCII, or with an added token in
    them go to the tokenizer as they are.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_str(tokenizer_json)
        self.added = [a.content.encode() for a in self.full.get_added_tokens_decoder().values()]
        self.fast = self._ranked(json.loads(tokenizer_json))
        self._forget()

    def _ranked(self, spec: dict):
        """The same vocabulary for the library that takes ranks, if its merges are in id order."""
        import tiktoken

        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
        added = {a["id"] for a in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if i not in added}
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        if not plain or [vocab.get(m) for m in merges] != list(range(256, 256 + len(merges))):
            return None
        ranks = {bytes(chars[c] for c in t): i for t, i in vocab.items()}
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        self.width[list(ranks.values())] = [len(t) for t in ranks]
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: bytes) -> np.ndarray:
        return np.asarray(self.full.encode(text.decode(), add_special_tokens=False).ids, "<u4")

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of units, sorted; where in the pool their ids are
        self.begin, self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _distinct(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of " " + unit for all ``units``, encoded in one call, and where each one's end."""
        ids = self.fast.encode_to_numpy(b" ".join([b"", *units]).decode()).astype("<u4")
        ends = np.cumsum([len(u) + 1 for u in units])
        return ids, np.searchsorted(np.cumsum(self.width[ids]), ends) + 1

    def _odd(self, raw: bytes, first: np.ndarray) -> np.ndarray:
        """Which texts the tokenizer must see as they are."""
        space = np.frombuffer(raw.translate(words.OUTSIDE), np.bool_)
        at = [np.flatnonzero(space[1:] & space[:-1])]
        found = {lead for lead in {w[:2] for w in _WIDE_SPACES} if lead in raw}
        for mark in (*(w for w in _WIDE_SPACES if w[:2] in found), *self.added):
            k = raw.find(mark)
            while k >= 0:
                at.append(np.array([k]))
                k = raw.find(mark, k + len(mark))
        odd = np.zeros(len(first), bool)
        odd[np.searchsorted(first, np.concatenate(at), "right") - 1] = True
        return odd

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        size = np.array([len(t) for t in texts], np.int64)
        raw = b"\x01".join([*texts, b""])
        odd = np.ones(len(texts), bool) if self.fast is None else self._odd(raw, np.concatenate(([0], np.cumsum(size + 1)))[:-1])
        for k in np.flatnonzero(odd | (size == 0)):
            out[k] = self._whole(texts[k])
        rest = np.flatnonzero(~odd & (size > 0))
        if not len(rest):
            return out
        raw = b" ".join([b"", *(texts[k] for k in rest), bytes(8)])
        gap = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
        start, end = gap[:-1] + 1, gap[1:]
        head = np.searchsorted(start, np.concatenate(([0], np.cumsum(size[rest] + 1)[:-1])) + 1)
        key = words.hash_spans(raw, start, end)
        key[head] = words.mix(key[head] ^ np.uint64(0xA5A5A5A5A5A5A5A5))  # units without a space before them
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([True], np.diff(key[order]) != 0))
        which = np.empty(len(key), np.int32)
        which[order] = np.cumsum(new, dtype=np.int32) - 1
        lead = order[new]
        a, b = start[lead], end[lead]
        heads = np.zeros(len(key), bool)
        heads[head] = True
        alone = heads[lead] | (a == b)
        key = key[lead]  # sorted
        if len(self.known) > CACHE_UNITS:
            self._forget()
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
            unseen = self.known[at] != key
        else:
            at, unseen = np.zeros(len(key), np.int64), np.ones(len(key), bool)
        spaced = np.flatnonzero(unseen & ~alone)
        units = [raw[i:j] for i, j in zip(a[spaced].tolist(), b[spaced].tolist(), strict=True)]
        pool, stops = self._distinct(units) if units else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        size = np.diff(stops, prepend=0)
        more, top = [self.pool, pool], len(self.pool) + len(pool)
        others = np.flatnonzero(unseen & alone)
        other = np.zeros((2, len(others)), np.int64)
        for n, k in enumerate(others):
            unit = raw[a[k] : b[k]] if heads[lead[k]] else b" "
            more.append(self.fast.encode_to_numpy(unit.decode()).astype("<u4"))
            other[:, n] = top, len(more[-1])
            top += len(more[-1])
        begin, length = (self.begin[at], self.length[at]) if len(self.known) else np.zeros((2, len(key)), np.int64)
        begin[spaced], length[spaced] = len(self.pool) + stops - size, size
        begin[others], length[others] = other
        pool = self.pool = np.concatenate(more)
        new = np.flatnonzero(unseen)
        place = np.searchsorted(self.known, key[new])
        self.begin, self.length = np.insert(self.begin, place, begin[new]), np.insert(self.length, place, length[new])
        self.known = np.insert(self.known, place, key[new])
        count = length[which]
        stop = np.cumsum(count)
        shift = begin[which]
        shift -= stop - count
        index = np.repeat(shift, count)
        index += np.arange(len(index))
        ids = pool[index]
        cut = np.append(stop[head] - count[head], len(ids)).tolist()
        for k, i, j in zip(rest, cut, cut[1:], strict=False):
            out[k] = ids[i:j]
        return out


def _pieces(batches, tokenizer: str, capacity: int, end_id: int, with_ids: bool):
    """Frames of pieces of the texts of Arrow batches."""
    end = np.asarray([end_id], "<u4")
    for pdf in words.chunks(batches, BATCH_BYTES):
        rows = []
        encoder = words.kept(("encoder", hash(tokenizer)), lambda: Encoder(tokenizer))
        for doc, found in zip(pdf["doc_id"], encoder.encode(list(pdf["text"])), strict=True):
            ids = np.concatenate((found, end)).tobytes()
            n, at, k = len(ids) // 4, 0, 0
            stop = n % capacity or min(n, capacity)
            while at < n:
                part = ids[4 * at : 4 * stop]
                rows.append((doc, k, at, stop - at, crc32(part), part if with_ids else None))
                at, stop, k = stop, stop + capacity, k + 1
        yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"]).astype({"doc_id": "Int64"})


def _mapped(docs: DataFrame, tokenizer_path: str, made, schema: str, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """``docs`` mapped by ``made``, which takes Arrow batches and the tokenizer file's text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())  # a tokenizer file, a few MB at most
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = words.mapped(kept, lambda batches: made(batches, shipped.value), schema)
    return out if with_ids else out.drop("ids")


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every text: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A text's ids are the tokenizer's without added ones, then ``end_id``.  Only a longer one than ``capacity`` is
    cut; its first piece takes what is left over, all others are full.
    """
    return _mapped(docs, tokenizer_path, lambda batches, file: _pieces(batches, file, capacity, end_id, with_ids), PIECES, with_ids, id_col, text_col)


class Packer:
    """Open bins of one packer: a bitset over free space and, for each, the bins that have it."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.bits, self.open, self.made, self.closed = 0, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bin_ = self.bins[free].pop()
        if not self.bins[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_

    def place(self, n: int) -> tuple[int, int]:
        """The bin for ``n`` ids and the place in it."""
        above = self.bits >> n
        if above:
            free = n + (above & -above).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
            free, bin_ = self.capacity, self.made
            self.made += 1
        left = free - n
        if left:
            self.bins[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.capacity - free


def _placed(packer: Packer, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins and places of pieces in the order of a stream, ``LOOKAHEAD`` at a time with the longest first."""
    ahead = min(LOOKAHEAD, packer.limit)
    bins, offsets = np.zeros((2, len(length)), np.int64)
    for k in range(0, len(length), ahead):
        order = np.argsort(-length[k : k + ahead], kind="stable") + k
        bins[order], offsets[order] = np.array([packer.place(n) for n in length[order].tolist()], np.int64).T
    return bins, offsets


def _own_base() -> int:
    """Where the sequence ids of this partition begin."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 40


def pack(pieces: DataFrame, capacity: int = 2048, open_bins: int = OPEN_BINS) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset, by a packer for each partition.

    What a packer does depends on its rows and their order alone.
    """

    def run(batches):
        import pyarrow as pa

        packer, base = Packer(capacity, open_bins), _own_base()
        for batch in batches:
            bins, offsets = _placed(packer, batch.column("length").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins + base), pa.array(offsets)], [*batch.schema.names, "sequence_id", "offset"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.mapInArrow(run, f"{out}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, open_bins: int = OPEN_BINS, packer_rows: int = 1000, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text of ``docs`` tokenized, cut and packed in one pass; ``with_ids`` keeps the ids themselves.

    Nothing is stored or shuffled between; partitions of few documents are read together until a packer has ``packer_rows`` or ``PACKER_BYTES`` of
    text, for which ``docs`` is counted, so it should be a stored table.
    """

    def run(batches, file: str):
        packer, base = Packer(capacity, open_bins), _own_base()
        for frame in _pieces(batches, file, capacity, end_id, with_ids):
            bins, offsets = _placed(packer, frame["length"].to_numpy())
            yield frame.assign(sequence_id=bins + base, offset=offsets)

    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)).alias("bytes")).first()
    near = docs.coalesce(max(store.parts(size["rows"], packer_rows), store.parts(size["bytes"], PACKER_BYTES)))
    return _mapped(near, tokenizer_path, run, f"{PIECES}, sequence_id long, offset long", with_ids, id_col, text_col)
