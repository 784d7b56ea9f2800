"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is parsed, from left to right, into the longest
phrases that occur in a language's text; the language that needs the fewest phrases, in bits per
character at the logarithm of its text's length a phrase, wins.  Texts are parsed
whole, in segments that start at the root, many segments and all languages at a time.

The most frequent letters of all samples have a class each.  Where there are more letters than classes, each of the rarer
ones is spelled by a leading class and one or more following ones, so that no two letters of the samples are taken for each other.
Letters in no sample are one class, which matches nowhere.

A model is fitted on a bounded sample of labelled rows: of each label at most ``SAMPLE_DOCS`` distinct documents, of each of
which at most ``SAMPLE_CHARS`` / 40 characters, and ``SAMPLE_CHARS`` characters in all, or an equal share of
``MODEL_CHARS`` where there are many labels.  Every label is learnt; more than ``MOST_LABELS`` are an error, as such a column holds no languages.

Cases: null text or text without a letter is ``und`` with score 0; with no labelled row at all, every
text is; equal costs go to the label that sorts first; repeated rows get equal results, and count once in the sample; null ids are
rows like others; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, words

SAMPLE_CHARS = 40_000
SAMPLE_DOCS = 200
#: Characters of all samples together, which bounds the tables of a model.
MODEL_CHARS = 640_000
MOST_LABELS = 4096
SEGMENT = 512
#: Bits of advantage that make a label twice as likely.
SOFTNESS = 4.0
#: Letters below which no text is rejected, and bits a character beyond which any other is, whatever labelled documents take.
LEAST_LETTERS, MOST_BITS = 64, 9.0
#: Labelled documents that a bound needs, what a text may take beyond the worst of them, and the characters by which sampled documents are told.
BOUND_DOCS, MARGIN, BEGINNING = 30, 1.1, 48
_CLASSES = 64
_PAD = _CLASSES - 1
_UNSEEN = _CLASSES - 2
#: Classes that begin and that continue a spelled letter; they lie below _UNSEEN.
_LEADS, _TAILS = 8, 12
_FLAG = 30


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of an id's decimal text, modulo ``n``."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))


def sample(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """(label, text) of a bounded sample of rows with a label and a text."""
    each = SAMPLE_CHARS // 40
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")).where("lang is not null and length(trim(text)) > 0")
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(MOST_LABELS + 1).collect()
    if not counts:
        return []
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels: column {lang_col} holds no languages")
    # The first SAMPLE_DOCS by hash lie below twice their share, but for chances that don't matter: fewer rows do as well.
    shares = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, 2 * SAMPLE_DOCS / max(r["n"], 1))) for r in counts], "_lang string, want double")
    share = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    few = rows.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).where(share < F.col("want")).select("lang", "h", F.substring("text", 1, each).alias("text"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("h", "text"))), 1, SAMPLE_DOCS)
    chars = min(SAMPLE_CHARS, MODEL_CHARS // len(counts))
    # copies of a row are one before they meet
    best = few.dropDuplicates(["lang", "h"]).groupBy("lang").agg(F.substring(F.array_join(F.transform(first, lambda r: r["text"]), "\n"), 1, chars).alias("text"))
    return sorted((r["lang"], r["text"]) for r in best.collect())  # at most MODEL_CHARS characters


def _automaton(text: np.ndarray) -> tuple[list[dict[int, int]], np.ndarray]:
    """Suffix automaton of a sequence: transitions by state, and how often each state's strings occur."""
    step: list[dict[int, int]] = [{}]
    link, size, copied = [-1], [0], [False]
    last = 0
    for c in text.tolist():
        now = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        copied.append(False)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[now] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                copied.append(True)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    count = np.array([0 if c else 1 for c in copied], np.int64)
    for s in sorted(range(1, len(step)), key=size.__getitem__, reverse=True):
        count[link[s]] += count[s]
    return step, count


class Parser:
    """Cross-parsing against the samples of all labels at once."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.labels = [lang for lang, _ in samples]
        #: How the sampled documents begin; each is a line's start.
        self.begun = {text[k : k + BEGINNING] for _, text in samples for k in (0, *(m + 1 for m, c in enumerate(text) if c == "\n"))}
        letters = np.zeros(0x110000, np.int32)
        seen = pd.Series(list("".join(t for _, t in samples).lower())).value_counts(sort=True)
        own = [c for c in seen.index if c.isalpha()]
        rare = own[_UNSEEN - 1 - _LEADS - _TAILS :] if len(own) > _UNSEEN - 1 else []
        own = own[: len(own) - len(rare)]
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            if chr(c).isalpha():
                letters[c] = _UNSEEN
        for k, c in enumerate(sorted(own)):
            letters[ord(c)] = k + 1
        tails = 1
        while _LEADS * _TAILS**tails < len(rare):
            tails += 1
        rank = np.arange(len(rare))
        places = [rank // _TAILS**k % _TAILS + _UNSEEN - _TAILS for k in range(tails)]
        #: The classes of each spelled letter, by its number less _CLASSES.
        self.spelled = np.stack([rank // _TAILS**tails + _UNSEEN - _TAILS - _LEADS, *reversed(places)], axis=1).astype(np.int32)
        for k, c in enumerate(rare):
            letters[ord(c)] = _CLASSES + k
        self.letters = letters
        tables, counts, roots, bits, at = [], [], [], [], 0
        for _, text in samples:
            plain = self.classes(text)[0]
            sequence = self.spell(plain)
            step, count = _automaton(sequence)
            table = np.full((len(step), _CLASSES), -1, np.int32)
            for s, to in enumerate(step):
                if to:
                    table[s, list(to)] = list(to.values())
            first = np.where(table[0] < 0, 0, table[0])  # after a miss the character starts the next phrase
            missed = table < 0
            np.copyto(table, first, where=missed)
            table += np.int32(at)  # all in place: a worker builds this while its task holds a batch
            table *= np.int32(_CLASSES)
            table[missed] |= np.int32(1 << _FLAG)
            table[:, _PAD] = (np.arange(len(step)) + at) * _CLASSES
            tables.append(table)
            counts.append(count)
            roots.append(at * _CLASSES)
            bits.append(np.log2(len(plain) + 2))
            at += len(step)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.often = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.roots, self.bits = np.array(roots, np.int32), np.array(bits)

    def classes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Letters of a text by class (rarer ones: _CLASSES or more), with each run of other characters as one 0, and where line breaks fell."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
        found = self.letters[points]
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
        return found[keep], np.cumsum(keep)[np.flatnonzero(points == 10)] if len(points) else np.zeros(0, np.int64)

    def spell(self, classes: np.ndarray) -> np.ndarray:
        """The classes that the tables know: those of a text with its rarer letters spelled."""
        rare = classes >= _CLASSES
        if not rare.any():
            return classes
        size = np.where(rare, self.spelled.shape[1], 1)
        out = np.repeat(classes, size)
        first = (np.cumsum(size) - size)[rare]
        out[first[:, None] + np.arange(self.spelled.shape[1])] = self.spelled[classes[rare] - _CLASSES]
        return out

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits that each text takes under each label, and how many classes it has (0: no letter)."""
        parts = [self.classes(t)[0] for t in texts]
        size = np.array([len(p) if p.any() else 0 for p in parts], np.int64)
        parts = [self.spell(p) for p in parts]
        pieces = np.array([-(-len(p) // SEGMENT) if n else 0 for p, n in zip(parts, size, strict=True)], np.int64)
        doc = np.repeat(np.arange(len(texts)), pieces)
        total = np.zeros((len(self.labels), len(texts)))
        if not len(doc) or not len(self.labels):
            return total, size
        block = np.full((len(doc), SEGMENT), _PAD, np.int32)
        at = 0
        for p, k in zip(parts, pieces.tolist(), strict=True):
            if k:
                block[at : at + k].ravel()[: len(p)] = p
                at += k
        columns = np.ascontiguousarray(block.T)
        lanes = 2048  # as many segments at a time as keep the states in the processor's cache
        for a in range(0, len(doc), lanes):
            own = np.ascontiguousarray(columns[:, a : a + lanes])
            state = np.repeat(self.roots[:, None], own.shape[1], axis=1)
            phrases = np.zeros(state.shape, np.int32)
            for c in own:
                state += c
                state = self.table.take(state, mode="clip")
                phrases += state >> _FLAG
                state &= (1 << _FLAG) - 1
            often = self.often[state // _CLASSES]
            # the phrase under way counts as one, less where it is a frequent one
            cost = (phrases + 1 - np.log2(often + 1.0) / 32) * self.bits[:, None]
            for k in range(len(self.labels)):
                total[k] += np.bincount(doc[a : a + lanes], cost[k], len(texts))
        return total, size

    def measured(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits a character of each text under the label that takes fewest, how many classes it has (0: no letter), and whether it begins like a sampled one."""
        total, size = self.costs(texts)
        bits = (total.min(axis=0) if self.labels else np.zeros(len(texts))) / np.maximum(size, 1)
        return bits, size, np.array([t[:BEGINNING] in self.begun for t in texts])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Label, score and bits per character of each text."""
        total, size = self.costs([t or "" for t in texts])
        if not self.labels:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        best = total.argmin(axis=0)
        lead = total.min(axis=0)
        score = 1 / np.exp2(-np.minimum((total - lead) / SOFTNESS, 60)).sum(axis=0)
        none = size == 0
        labels = ["und" if n else self.labels[b] for b, n in zip(best, none, strict=True)]
        return labels, np.where(none, 0.0, score), lead / np.maximum(size, 1)


def _parser(samples) -> Parser:
    return words.kept(("parser", hash(tuple(samples))), lambda: Parser(samples))


def identify(docs: DataFrame, samples: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and bits_per_char of every text."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(samples)  # bounded by the sample's parameters

    def predicted(batches):
        for pdf in words.chunks(batches):
            labels, score, bits = _parser(shipped.value).predict([t.decode() for t in pdf["text"]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": labels, "score": score, "bits_per_char": bits})

    return words.mapped(kept, predicted, f"doc_id {kind}, lang_pred string, score double, bits_per_char double")


def bounds(found: DataFrame, lang_col: str, bits_col: str, letters_col: str, sampled_col: str) -> dict[int, float]:
    """Bits a character that a text may take, by the power of two of its letters, from all rows with a label that the model was not learnt from.

    Longer texts vary less, so a bound is the worst of the labelled documents of that length and beyond, and a margin; where these are fewer than
    ``BOUND_DOCS``, the bound of the next shorter length holds, and at last ``MOST_BITS``.
    """
    power = F.floor(F.log2(letters_col)).cast("int")
    known = found.where(F.col(lang_col).isNotNull() & (F.col(letters_col) >= LEAST_LETTERS) & (F.col(sampled_col) == 0))
    rows = known.groupBy(power.alias("power")).agg(F.max(bits_col).alias("worst"), F.count(F.lit(1)).alias("n")).collect()  # a row for each power of two
    least = int(np.log2(LEAST_LETTERS))
    out, now = {}, MOST_BITS
    for p in range(least, 64):
        beyond = [r for r in rows if r["power"] >= p]
        if sum(r["n"] for r in beyond) >= BOUND_DOCS:
            now = min(MOST_BITS, MARGIN * max(r["worst"] for r in beyond))
        out[p] = now
    return out


def keep_identified(docs: DataFrame, samples: list[tuple[str, str]], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the documents in which no language can be told.

    These are null texts, texts without a letter, and texts of ``LEAST_LETTERS`` or more that every language parses at more bits a character than
    any labelled document of their length takes (``bounds``): other languages and scripts, or no language, such as random letters.  Texts are parsed
    once, and stored with what they take.  With no label to learn from, all texts with a letter stay; with few, or no such column, those of at most ``MOST_BITS``.
    Repeated rows and null ids are rows like others; no rows give none.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(samples)  # bounded by the sample's parameters
    names = bits, letters, sampled = [store.free_name(docs, n) for n in ("lang_bits", "lang_letters", "lang_sampled")]

    def measure(texts: list[str | None]):
        return _parser(shipped.value).measured([t or "" for t in texts])

    found = words.with_numbers(docs, text_col, measure, names)
    if not samples:
        return found.where(F.col(letters) > 0).drop(*names)
    bound = F.lit(MOST_BITS)
    if lang_col in docs.columns:
        found = store.materialize(found, "measured")
        for power, value in sorted(bounds(found, lang_col, *names).items(), reverse=True):
            bound = F.when(F.col(letters) < 2.0 ** (power + 1), value).otherwise(bound)
    told = (F.col(letters) < LEAST_LETTERS) | (F.col(bits) <= bound) | (F.col(sampled) == 1)
    return found.where((F.col(letters) > 0) & told).drop(*names)
