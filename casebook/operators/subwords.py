"""Windows of a model's own tokens (D1): byte-level merges with offsets into the text.

``Merges`` reads a public tokenizer file (a path is a parameter): a text is cut into units by the file's kind of pattern, a unit's bytes are joined by the
merge of lowest rank until none applies, and each token has the place of its characters in the text.  A unit's tokens are found once per
distinct unit.  ``windows`` are then those of a model with ``size`` places, and each starts and ends with a token.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.operators import spans

#: Fixed value: the units of byte-level files, contractions, words, numbers, other characters and white space.
UNITS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units longer than this are not remembered.
REMEMBERED = 64


def _alphabet() -> list[str]:
    """The character that stands for each byte in such files: printable ones for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """Tokens of texts by a byte-level file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.units = regex.compile(UNITS)
        self.bytes = _alphabet()
        self.remembered = lru_cache(200_000)(self._sizes)

    def _sizes(self, unit: str) -> tuple[int, ...]:
        """Bytes of each token of a unit.

        Pairs wait in a heap by rank and place, so that a unit of n bytes takes n log n steps.
        """
        parts: list[str | None] = [self.bytes[b] for b in unit.encode()]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(len(parts) - 1) if (r := self.ranks.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if parts[k] != a or j >= len(parts) or parts[j] != b:
                continue  # one of both is part of another token by now
            parts[k], parts[j] = a + b, None
            after[k] = after[j]
            if after[j] < len(parts):
                before[after[j]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < len(parts) and (r := self.ranks.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return tuple(len(p) for p in parts if p is not None)

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Start and end of each token, in characters; tokens that hold a part of a character's bytes have all of it."""
        out: list[tuple[int, int]] = []
        for m in self.units.finditer(text):
            unit, at = m[0], m.start()
            sizes = self.remembered(unit) if len(unit) <= REMEMBERED else self._sizes(unit)
            if unit.isascii():
                ends = list(accumulate(sizes, initial=at))
                out += zip(ends, ends[1:], strict=False)
                continue
            owner = [at + k for k, c in enumerate(unit) for _ in range(len(c.encode()))]
            first = 0
            for n in sizes:
                out.append((owner[first], owner[first + n - 1] + 1))
                first += n
        return out

    def spans(self, text: str, size: int, step: int) -> list[tuple[int, int]]:
        """Start and end, in characters, of windows of ``size`` tokens, one every ``step``: as by ``offsets``, which only the units at their ends need."""
        units = self.units.findall(text)
        tokens = [0, *accumulate(len(self.remembered(u) if len(u) <= REMEMBERED else self._sizes(u)) for u in units)]
        starts = [0, *accumulate(map(len, units))]
        n = tokens[-1]

        def place(k: int) -> tuple[int, int]:
            at = bisect_right(tokens, k) - 1
            a, b = self.offsets(units[at])[k - tokens[at]]
            return starts[at] + a, starts[at] + b

        return [(place(a)[0], place(min(a + size, n) - 1)[1]) for a in range(0, n, step) if a == 0 or a + size - step < n]


def windows(df: DataFrame, text: str, path: str, size: int = spans.MAX_TOKENS - spans.RESERVED, overlap: int = spans.OVERLAP) -> DataFrame:
    """A row for each window of ``size`` tokens: ``window``, ``window_start`` in characters and ``window_text``.

    Windows start every ``size - overlap`` tokens, the last one is the first that reaches the end; texts without tokens, or null, have none.
    """
    step = size - overlap

    @F.pandas_udf("array<struct<window:int,window_start:int,window_text:string>>")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merges = Merges(path)
        for part in parts:
            rows = []
            for t in part:
                rows.append([{"window": k, "window_start": a, "window_text": t[a:b]} for k, (a, b) in enumerate(merges.spans(t or "", size, step))])
            yield pd.Series(rows, dtype=object)

    return df.withColumn("_window", F.explode(cut(F.col(text).cast("string")))).select(*df.columns, "_window.*")
