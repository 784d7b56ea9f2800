"""Words of many texts at once: positions and 64-bit hashes by numpy over the raw bytes.

A word's hash folds eight bytes at a time with a 64-bit mixer.  Two given words share a hash
with probability about 2**-64.
"""

from __future__ import annotations

import gc
from dataclasses import dataclass

import numpy as np
import pandas as pd

U64 = np.uint64
_SPACES = b" \t\n\v\f\r"


OUTSIDE = bytes(b in _SPACES for b in range(256))
#: Keeps the low n bytes of eight.
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def hash_spans(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each ``raw[start:end]``, eight bytes at a time.  ``raw`` ends in eight spare bytes."""
    eight = np.ndarray((max(len(raw) - 7, 0),), "<u8", raw, strides=(1,))
    out = np.empty(len(start), U64)
    for i in range(0, len(start), 16384):  # blocks that fit the processor's cache
        at, left = start[i : i + 16384], end[i : i + 16384] - start[i : i + 16384]
        h = mix((eight[at] & _MASK[np.minimum(left, 8)]) + left.astype(U64) * U64(0x9E3779B97F4A7C15))
        more = np.flatnonzero(left > 8)
        done = 8
        while len(more):
            rest = left[more] - done
            h[more] = mix(h[more] * U64(0xD6E8FEB86659FD93) + (eight[at[more] + done] & _MASK[np.minimum(rest, 8)]))
            done += 8
            more = more[rest > 8]
        out[i : i + 16384] = h
    return out


@dataclass
class Words:
    """Words of a batch of texts, in order: the bytes they lie in, where, and whose."""

    raw: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of the first word of each text, and the total

    @property
    def doc(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split(texts: list[bytes]) -> Words:
    """Words (runs of bytes other than the six ASCII spaces) of ``texts``."""
    raw = b"\n".join([b"", *texts, bytes(8)])
    gap = np.flatnonzero(np.frombuffer(raw.translate(OUTSIDE), np.bool_))
    wide = np.flatnonzero(np.diff(gap) > 1)
    start, end = gap[wide] + 1, gap[wide + 1]
    offset = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offset[1:])
    return Words(raw, start, end, hash_spans(raw, start, end), np.searchsorted(start, offset + 1))


def rolling(h: np.ndarray, n: int, multiplier: int) -> np.ndarray:
    """A hash of each run of ``n`` consecutive values."""
    if len(h) < n:
        return np.zeros(0, U64)
    m, size = U64(multiplier | 1), len(h) - n + 1
    out = h[:size].copy()
    for k in range(1, n):
        out *= m
        out += h[k : k + size]
    return mix(out)


def release() -> None:
    """Give freed memory back to the system, where the C library can: workers outlive their tasks and would keep it."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


_KEPT: dict = {}


def kept(key, build):
    """What ``build`` makes, kept in this worker until another key is asked for: one model at a time takes memory."""
    if key not in _KEPT:
        _KEPT.clear()
        release()
        _KEPT[key] = build()
        release()
    return _KEPT[key]


#: What a row counts for beside its text, so that frames of empty texts are bounded too.
ROW_BYTES = 64


def _cuts(batch, text: str, size: int, first: int = 0):
    """Ranges of rows of an Arrow batch with at most ``size`` bytes, the first one at most ``first``; a longer text is one of its own."""
    import pyarrow.compute as pc

    column = batch.column(batch.schema.get_field_index(text))
    at = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES)))
    begin, room = 0, first
    while begin < batch.num_rows:
        end = int(np.searchsorted(at, at[begin] + room, "right")) - 1
        if end > begin or room == size:
            end = max(end, begin + 1)
            yield begin, end - begin, int(at[end] - at[begin])
            begin = end
        room = size


def chunks(batches, size: int = 3_000_000, text: str = "text"):
    """Frames of about ``size`` bytes of text each, out of an iterator of Arrow batches.

    Column ``text`` becomes ``bytes`` (null: empty), and whole numbers keep their value beside nulls.  A longer text is a frame of its own.
    """
    import pyarrow as pa

    whole = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype(), pa.int16(): pd.Int16Dtype(), pa.int8(): pd.Int8Dtype()}
    held, total = [], 0
    for batch in batches:
        for begin, count, found in _cuts(batch, text, size, size - total):
            part = batch.slice(begin, count)
            place = part.schema.get_field_index(text)
            if total and total + found > size:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held, total = [], 0
            frame = part.drop_columns([text]).to_pandas(types_mapper=whole.get)
            held.append(frame.assign(**{text: [t or b"" for t in part.column(place).cast(pa.binary()).to_pylist()]}))
            total += found
            if total >= size:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held, total = [], 0
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
    del held
    release()


def mapped(df, made, schema: str):
    """``df`` mapped by ``made``, from an iterator of Arrow batches to frames with the columns of ``schema``.

    Nothing passes through frames on the way in, where a whole number beside a null would become an inexact one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        for frame in made(batches):
            yield pa.RecordBatch.from_pandas(frame, schema=target, preserve_index=False)

    return df.mapInArrow(run, schema)


def keep_where(docs, text_col: str, judge, size: int = 3_000_000):
    """The rows of ``docs``, unchanged, for whose texts ``judge`` (a list of texts to a list of booleans) says true."""

    def kept(batches):
        import pyarrow as pa

        for batch in batches:
            for begin, count, _ in _cuts(batch, text_col, size, size):
                part = batch.slice(begin, count)
                yield part.filter(pa.array(judge(part.column(text_col).to_pylist()), pa.bool_()))
        release()

    return docs.mapInArrow(kept, docs.schema)


def replace_text(docs, text_col: str, change, size: int = 3_000_000):
    """``docs`` with ``change`` (a list of texts to a list of texts) applied to its texts; nothing else changes."""

    def changed(batches):
        import pyarrow as pa

        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            for begin, count, _ in _cuts(batch, text_col, size, size):
                part = batch.slice(begin, count)
                column = pa.array(change(part.column(place).to_pylist()), batch.schema.field(place).type)
                yield part.set_column(place, batch.schema.field(place), column)
        release()

    return docs.mapInArrow(changed, docs.schema)


def with_numbers(docs, text_col: str, measure, names, size: int = 3_000_000):
    """``docs`` with columns ``names`` of doubles, which ``measure`` makes (a list of texts to an array for each name); nothing else changes."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    def measured(batches):
        import pyarrow as pa

        for batch in batches:
            for begin, count, _ in _cuts(batch, text_col, size, size):
                part = batch.slice(begin, count)
                found = measure(part.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(np.asarray(f, np.float64)) for f in found)], names=[*part.schema.names, *names])
        release()

    return docs.mapInArrow(measured, StructType([*docs.schema.fields, *(StructField(n, DoubleType()) for n in names)]))
