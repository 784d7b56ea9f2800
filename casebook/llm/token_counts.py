"""Token counts under a unigram vocabulary, without the tokens themselves.

Texts are split before every space, which becomes the mark of a word's start, as the common
pre-tokenizer for such vocabularies does.  In a word, an Aho-Corasick automaton gives every
occurrence of a vocabulary entry; dynamic programming over them carries the best score and the number of pieces.  Ties go as in the
tokenizer: a later candidate must be strictly better, and candidates come by their start.  Characters
that no entry covers alone cost ten below the lowest score, neighbours among them fuse, and then count as their bytes where the
vocabulary has all of them, or as one unknown piece.

Each distinct word is counted once and its count kept under the word's 64-bit hash.  Of a word, no more is held than the
longest entry needs, so a text without any space takes no more memory than others.

Cases: null and empty texts have no tokens; repeated rows are counted alike; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

Vocabulary = list[tuple[str, float]]
MARK = "▁"
CACHE_WORDS = 3_000_000
#: Places of a word that are forgotten at a time.
_FORGET = 4096


def vocabulary(model_path: str) -> Vocabulary:
    """Pieces of a sentencepiece model; the k-th in rank gets the logarithm of Zipf's share 1 / (k + 2)."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_path)
    n = model.get_piece_size()
    total = math.fsum(1 / (k + 2) for k in range(n))
    return [(model.id_to_piece(k), -math.log((k + 2) * total)) for k in range(n)]


class Counter:
    """Counts pieces of words under a unigram vocabulary."""

    def __init__(self, vocab: Vocabulary, unknown: int = 0):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        score: dict[str, float] = {}
        for piece, s in vocab:
            score[piece] = s
        for piece, s in score.items():
            if piece:
                self.find.add_word(piece, (len(piece), s))
        self.find.make_automaton()
        self.longest = max(map(len, score))
        self.single = {p for p in score if len(p) == 1}
        self.unknown = min(score.values()) - 10.0
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in score}
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def word(self, text: str) -> int:
        """Pieces of ``text``, which starts with the mark.

        By place in the text: the best score up to there, the pieces of that way, and of unknown characters at its end, which are
        still fusing, how many bytes they are and whether the vocabulary has all of those.  Entries that end at one place
        come longest first, which is by their start.  Places further back than any entry reaches are forgotten.
        """
        score, pieces, fusing, spelled = [0.0], [0], [0], [True]
        done, end, top, start = 0, 1, None, 0  # done: how many places are forgotten
        for last, (size, s) in chain(self.find.iter(text), [(len(text), (0, 0.0))]):
            while end <= last:  # no other entry ends there
                k = end - 1 - done
                if text[end - 1] not in self.single and (top is None or score[k] + self.unknown > top):
                    raw = text[end - 1].encode()
                    spelled.append(spelled[k] and self.bytes.issuperset(raw))
                    score.append(score[k] + self.unknown)
                    pieces.append(pieces[k])
                    fusing.append(fusing[k] + len(raw))
                else:
                    k = start - done
                    score.append(top)
                    pieces.append(pieces[k] + 1 + (fusing[k] if spelled[k] else 1))
                    fusing.append(0)
                    spelled.append(True)
                end, top = end + 1, None
                if len(score) > self.longest + _FORGET:
                    for held in (score, pieces, fusing, spelled):
                        del held[:_FORGET]
                    done += _FORGET
            here = score[end - size - done] + s if size else None
            if size and (top is None or here > top):
                top, start = here, end - size
        return pieces[-1] + (fusing[-1] if spelled[-1] else 1)

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Pieces of each text."""
        mark = MARK.encode()
        texts = [t if t[:1] in (b"", b" ") or t.startswith(mark) else b" " + t for t in (t.replace(mark, b" ") for t in texts)]
        raw = b"".join([*texts, b" ", bytes(8)])
        gap = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
        if len(gap) < 2:
            return np.zeros(len(texts), np.int64)
        start, end = gap[:-1] + 1, gap[1:]
        key = words.hash_spans(raw, start, end)
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([True], np.diff(key[order]) != 0))
        which = np.empty(len(key), np.int32)
        which[order] = np.cumsum(new, dtype=np.int32) - 1
        lead = order[new]
        key = key[lead]
        if len(self.known) > CACHE_WORDS:
            self.known, self.counts = self.known[:0], self.counts[:0]
        found = np.zeros(len(key), np.int64)
        unseen = np.ones(len(key), bool)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
            unseen, found = self.known[at] != key, self.counts[at]
        fresh = np.flatnonzero(unseen)
        found[fresh] = [self.word(MARK + raw[a:b].decode()) for a, b in zip(start[lead[fresh]].tolist(), end[lead[fresh]].tolist(), strict=True)]
        place = np.searchsorted(self.known, key[fresh])
        self.known, self.counts = np.insert(self.known, place, key[fresh]), np.insert(self.counts, place, found[fresh])
        total = np.concatenate(([0], np.cumsum(found[which])))
        first = np.searchsorted(gap[:-1], np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
        return total[first[1:]] - total[first[:-1]]


def count_tokens(docs: DataFrame, vocab: Vocabulary, unknown: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every text."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocab)  # a vocabulary file, a few MB at most
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()

    def counted(batches):
        counter = words.kept(("counter", hash(tuple(shipped.value)), unknown), lambda: Counter(shipped.value, unknown))
        for pdf in words.chunks(batches, 10_000_000):
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": counter.count(list(pdf["text"]))})

    return words.mapped(kept, counted, f"doc_id {kind}, n_tokens long")
