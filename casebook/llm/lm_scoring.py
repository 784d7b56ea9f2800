"""Log-probabilities of texts under a log-bilinear model, and under counts.

Texts are lower-cased (A-Z); tokens are words between ASCII spaces, and one end for each text.  Learning
covers every training text:

1. Blocks of documents become arrays of token numbers into the block's own vocabulary, which is
   dealt by ranges of word hash.  Counts are summed for each range, and go back to the blocks as
   arrays, so no vocabulary is ever in one place.  Ranges are as many as the bytes of all texts ask for.
2. The symbols of the model are the most frequent tokens and a fixed number of classes of word forms.  There are ``SYMBOLS`` of them as
   contexts; as predicted ones, their number grows with the cube root of the distinct words (``predicted_words``).  Pairs of
   neighbouring symbols are counted over all training texts.
3. On these counts a log-bilinear model is trained by noise-contrastive estimation: the score of a
   symbol after another is (C r) . q + b, noise are symbols by frequency, and expectations over
   noise are taken exactly.  Batched matrix products over all contexts then give normalised log-probabilities.

A token's log-probability is its symbol's after the one before it (an end before the first), and for a class, its
share of the class by counts less a discount; what the discounts leave is the share of unseen words, which together are one event,
as in the base.  A class's discount is n1 / (n1 + 2 n2), n1 and n2 its words seen once and twice.

Words are counted by 64-bit hashes.

Cases: null text is empty and is one end; without training texts, counts are 0 and the model is uniform; a null doc_id is
a training row; repeated rows count and score alike; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, words

SYMBOLS, CLASSES, WIDTH = 1024, 192, 40
NOISE, STEPS = 25, 300
#: Deviation of the components of a vector that a small corpus says little about.
PRIOR = 0.2
BATCH_BYTES = 3_000_000
#: Bytes of text whose words, of all blocks, make a range; and predicted words for each in the cube root of the distinct ones.
RANGE_BYTES, GROWTH = 64 << 20, 17
_END = np.uint64(0x1D8E4E27C47D124F)
_U64 = np.uint64


def _pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(raw: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _forms(found: words.Words) -> np.ndarray:
    """The class of each word: its last mark of punctuation and its last two letters, hashed."""
    buf = np.frombuffer(found.raw, np.uint8)
    last = buf[found.end - 1]
    mark = np.where(last == 46, 1, np.where(last == 44, 2, np.where((last < 48) | ((last > 57) & (last < 97)), 3, 0)))
    end = found.end - (mark > 0)
    pair = buf[np.maximum(end - 1, found.start)].astype(_U64) * _U64(256) + buf[np.maximum(end - 2, found.start)]
    return (mark * (CLASSES // 4) + (words.mix(pair) % _U64(CLASSES // 4)).astype(np.int64)).astype(np.uint8)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Range of a hash; ranges are in the order of hashes."""
    return ((h >> _U64(40)) * _U64(buckets) >> _U64(24)).astype(np.int64)


def _blocks(batches, buckets: int):
    """A row of each block of documents, and rows of its vocabulary by range."""
    from pyspark import TaskContext

    base, seq = TaskContext.get().partitionId() << 32, 0
    for pdf in words.chunks(batches, BATCH_BYTES):
        found = words.split([t.lower() for t in pdf["text"]])
        held = pdf["held_out"].to_numpy(bool)
        size = np.diff(found.first) + 1
        stop = np.cumsum(size)
        h = np.full(stop[-1], _END, _U64)
        inner = np.ones(len(h), bool)
        inner[stop - 1] = False
        h[inner] = found.hash
        form = np.zeros(len(h), np.uint8)
        form[inner] = _forms(found)
        order = np.argsort(h, kind="stable")
        new = np.concatenate(([True], np.diff(h[order]) != 0))
        which = np.empty(len(h), np.int32)
        which[order] = np.cumsum(new, dtype=np.int32) - 1
        lead = order[new]
        vocab, form = h[lead], form[lead]
        train = np.bincount(which[np.repeat(~held, size)], minlength=len(vocab)).astype(np.int64)
        block = base + seq
        seq += 1
        ids = pdf["doc_id"].astype("Int64")
        yield block, None, _pack(vocab), _pack(form), None, _pack(which), _pack(np.stack([ids.fillna(0).to_numpy(np.int64), ids.isna().to_numpy(np.int64), held.astype(np.int64), size]))
        cut = np.searchsorted(_bucket(vocab, buckets), np.arange(buckets + 1)).tolist()
        for b, (i, j) in enumerate(zip(cut, cut[1:], strict=False)):
            if j > i:
                yield block, b, _pack(vocab[i:j]), _pack(form[i:j]), _pack(train[i:j]), None, None


_BLOCK_COLUMNS = ["block", "bucket", "vocab", "form", "train", "which", "docs"]
_PAIR_SCHEMA = "part long, keys binary, counts binary"
_BLOCK_SCHEMA = "block long, bucket int, vocab binary, form binary, train binary, which binary, docs binary"


def _summed(pdf: pd.DataFrame, most: int) -> pd.DataFrame:
    """Counts of one range of words over all blocks: an answer for each block, and the range's totals with its ``most`` frequent words."""
    parts = [_unpack(v, _U64) for v in pdf["vocab"]]
    size = [len(p) for p in parts]
    distinct, first, where = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, where, np.concatenate([_unpack(t, np.int64) for t in pdf["train"]]))
    form = np.concatenate([_unpack(f, np.uint8) for f in pdf["form"]])[first]
    answers = np.split(total[where], np.cumsum(size)[:-1])
    rows = [(b, k, _pack(a), None, None, None, *[None] * 4) for b, k, a in zip(pdf["block"], pdf["bucket"], answers, strict=True)]
    known = np.flatnonzero(total > 0)
    top = known[np.argsort(-total[known], kind="stable")[:most]]
    by_class = [np.bincount(form[known], w, CLASSES).astype(np.int64).tolist() for w in (total[known], np.ones(len(known)), total[known] == 1, total[known] == 2)]
    del parts, where, answers
    words.release()
    rows.append((None, int(pdf["bucket"].iloc[0]), None, len(known), int(total.sum()), [{"n": int(total[t]), "h": int(distinct[t].astype(np.int64)), "form": int(form[t])} for t in top], *by_class))
    return pd.DataFrame(rows, columns=["block", "bucket", "counts", "distinct", "tokens", "top", *_CLASS_SUMS]).astype({"block": "Int64", "distinct": "Int64", "tokens": "Int64"})


_CLASS_SUMS = ("class_tokens", "class_words", "class_once", "class_twice")
_SUM_SCHEMA = "block long, bucket long, counts binary, distinct long, tokens long, top array<struct<n:long,h:long,form:int>>" + "".join(f", {c} array<long>" for c in _CLASS_SUMS)


class Symbols:
    """The most frequent tokens and the classes of all others, as numbers; 0 is the end."""

    def __init__(self, top: list[tuple[int, int]]):
        h = np.array([t[0] for t in top if t[0] != int(_END.astype(np.int64))], np.int64).astype(_U64)
        self.hash = np.sort(h)
        self.size = 1 + len(h) + CLASSES

    def of(self, vocab: np.ndarray, form: np.ndarray) -> np.ndarray:
        out = 1 + len(self.hash) + form.astype(np.int64)
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, vocab), len(self.hash) - 1)
            out = np.where(self.hash[at] == vocab, 1 + at, out)
        return np.where(vocab == _END, 0, out)


def _pairs(batches, contexts: Symbols, symbols: Symbols, rows: int):
    """Counts of a context and the symbol after it in training texts, those that occur, by groups of ``rows`` contexts."""
    n = symbols.size
    keys, counts = np.zeros((2, 0), np.int64)
    for pdf in batches:
        for vocab, form, which, docs in zip(pdf["vocab"], pdf["form"], pdf["which"], pdf["docs"], strict=True):
            words_, form, which = _unpack(vocab, _U64), _unpack(form, np.uint8), _unpack(which, np.int32)
            _, _, held, size = _unpack(docs, np.int64).reshape(4, -1)
            before = np.concatenate(([0], contexts.of(words_, form)[which[:-1]]))  # each text ends with an end, 0, which is the next one's context
            pair = (before * n + symbols.of(words_, form)[which])[np.repeat(held == 0, size)]
            some, times = np.unique(pair, return_counts=True)
            both, where = np.unique(np.concatenate((keys, some)), return_inverse=True)
            keys, counts = both, np.bincount(where, np.concatenate((counts, times)), len(both)).astype(np.int64)
    cut = np.searchsorted(keys, np.arange(0, contexts.size + rows, rows) * n).tolist()
    words.release()
    for k, (i, j) in enumerate(zip(cut, cut[1:], strict=False)):
        if j > i:
            yield pd.DataFrame({"part": [k], "keys": [_pack(keys[i:j])], "counts": [_pack(counts[i:j])]})


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = np.concatenate([_unpack(k, np.int64) for k in pdf["keys"]])
    times = np.concatenate([_unpack(c, np.int64) for c in pdf["counts"]])
    some, where = np.unique(keys, return_inverse=True)
    return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "keys": [_pack(some)], "counts": [_pack(np.bincount(where, times, len(some)).astype(np.int64))]})


def train(counts: np.ndarray, width: int = WIDTH, noise: int = NOISE, steps: int = STEPS, seed: int = 1) -> dict[str, np.ndarray]:
    """A log-bilinear model of ``counts`` (context, symbol) by noise-contrastive estimation with Adam."""
    m, n = counts.shape
    draw = np.random.Generator(np.random.PCG64(seed))
    unigram = ((counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * n)).astype(np.float32)
    p = {"R": draw.normal(0, 0.1, (m, width)).astype(np.float32), "Q": draw.normal(0, 0.1, (n, width)).astype(np.float32), "C": np.eye(width, dtype=np.float32), "b": np.log(unigram)}
    total = counts.sum()
    if not total:
        return p | {"b": np.zeros(n, np.float32), "Q": np.zeros((n, width), np.float32)}  # uniform
    data = (counts / total).astype(np.float32)
    context = data.sum(axis=1, keepdims=True)
    from_noise = noise * context * unigram
    shift = np.log(noise * unigram)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        made = p["R"] @ p["C"]
        logit = made @ p["Q"].T
        logit += p["b"] - shift
        np.negative(logit, out=logit)
        np.exp(np.clip(logit, -60, 60, out=logit), out=logit)
        real = 1 / (1 + logit)
        slope = data - real * (data + from_noise)  # of the objective by each score
        g_made = slope @ p["Q"]
        grad = {"Q": slope.T @ made, "b": slope.sum(axis=0), "C": p["R"].T @ g_made, "R": g_made @ p["C"].T}
        for k in ("R", "Q"):  # as likely as the prior has it
            grad[k] -= p[k] / (PRIOR * PRIOR * total)
        rate = 0.05 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            p[k] += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
    return p


def log_table(model: dict[str, np.ndarray]) -> np.ndarray:
    """Normalised log10-probabilities of every symbol after every other, by batched matrix products."""
    out = []
    for k in range(0, len(model["R"]), 256):
        score = (model["R"][k : k + 256] @ model["C"]).astype(np.float64) @ model["Q"].T.astype(np.float64) + model["b"]
        score -= score.max(axis=1, keepdims=True)
        out.append((score - np.log(np.exp(score).sum(axis=1, keepdims=True))) / np.log(10))
    return np.concatenate(out)


class Scorer:
    """Normalised log10-probabilities of single pairs: the sum that normalises each context is taken once, over all symbols."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.made, self.q, self.b = model["R"] @ model["C"], model["Q"], model["b"].astype(np.float64)
        total = []
        for k in range(0, len(self.made), 64):
            each = self.made[k : k + 64] @ self.q.T + model["b"]
            top = each.max(axis=1, keepdims=True)
            total.append(top[:, 0] + np.log(np.exp((each - top).astype(np.float64)).sum(axis=1)))
        self.total = np.concatenate(total)

    def of(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out = np.empty(len(symbol))
        for k in range(0, len(symbol), 1 << 16):
            c, t = context[k : k + (1 << 16)], symbol[k : k + (1 << 16)]
            out[k : k + (1 << 16)] = np.einsum("ij,ij->i", self.made[c], self.q[t]) + self.b[t] - self.total[c]
        return out / np.log(10)


def predicted_words(distinct: int) -> int:
    """How many words the model predicts as themselves: as many as the contexts have, and more with the cube root of the distinct ones."""
    return max(SYMBOLS - CLASSES - 1, int(GROWTH * distinct ** (1 / 3)))


def score(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; rows where ``held_out`` is true are not learnt from."""
    spark = docs.sparkSession
    spread = store.partitions(spark)
    held = F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"))
    size = store.text_bytes(plain, "text")
    ranges = max(spread, store.parts(size, RANGE_BYTES))
    most = predicted_words(size // 2 + 1)  # a word takes two bytes or more

    def blocked(batches):
        for row in _blocks(batches, ranges):
            yield pd.DataFrame([row], columns=_BLOCK_COLUMNS).astype({"bucket": "Int64"})

    blocks = store.materialize(words.mapped(plain, blocked, _BLOCK_SCHEMA), "blocks")
    dealt = blocks.where("bucket is not null").select("block", "bucket", "vocab", "form", "train").repartitionById(ranges, "bucket")
    sums = store.materialize(dealt.groupBy("bucket").applyInPandas(lambda pdf: _summed(pdf, most), _SUM_SCHEMA), "counts")
    totals = sums.where("block is null")
    whole = totals.agg(F.sum("distinct"), F.sum("tokens")).first()
    distinct, tokens = int(whole[0] or 0), int(whole[1] or 0)
    top = [(r["h"], r["n"], r["form"]) for r in totals.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("n"), "h").limit(predicted_words(distinct)).collect()]
    classes = totals.agg(*(F.sum(F.get(c, F.lit(k))).alias(f"{c}{k}") for c in _CLASS_SUMS for k in range(CLASSES))).first()
    mass = np.array([x or 0 for x in classes], np.int64).reshape(4, CLASSES)
    end = int(_END.astype(np.int64))
    # symbols of their own are no members of a class; nor is the end, which was counted in form 0
    own = [(n, form) for _, n, form in top]
    if tokens and end not in {h for h, _, _ in top}:
        own.append((docs.where(~held).count(), 0))
    for n, form in own:
        mass[:, form] -= (n, 1, n == 1, n == 2)
    in_class, words_, once, twice = np.maximum(mass, 0).astype(float)
    discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
    discount = np.clip(discount, 0.05, 0.95)
    unseen = np.where(in_class > 0, np.log10(np.maximum(discount * words_, 1e-300)) - np.log10(np.maximum(in_class, 1)), 0.0)
    symbols, contexts = Symbols([(h, n) for h, n, _ in top]), Symbols([(h, n) for h, n, _ in top[: SYMBOLS - CLASSES - 1]])
    texts = blocks.where("bucket is null").select("block", "vocab", "form", "which", "docs")
    parts = texts.mapInPandas(lambda b: _pairs(b, contexts, symbols, 64), _PAIR_SCHEMA).groupBy("part").applyInPandas(_added, _PAIR_SCHEMA)
    counts = np.zeros(contexts.size * symbols.size, np.int64)
    for r in parts.collect():  # a table whose size is that of the model
        counts[_unpack(r["keys"], np.int64)] = _unpack(r["counts"], np.int64)
    scorer = Scorer(train(counts.reshape(contexts.size, symbols.size)))
    unit = -np.log10(tokens + distinct + 1)
    shipped = spark.sparkContext.broadcast((scorer, symbols, contexts))  # grows as the predicted words do
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        scorer, symbols, contexts = shipped.value
        answer = np.concatenate([_unpack(c, np.int64) for c in right.sort_values("bucket")["counts"]])
        out = []
        for r in left.itertuples():
            vocab, form, which = _unpack(r.vocab, _U64), _unpack(r.form, np.uint8), _unpack(r.which, np.int32)
            ids, missing, out_of, size = _unpack(r.docs, np.int64).reshape(4, -1)
            first = np.cumsum(size) - size
            symbol = symbols.of(vocab, form)
            share = np.log10(np.maximum(answer - discount[form], 0.01)) - np.log10(np.maximum(in_class[form], 1))
            inside = np.where(symbol > len(symbols.hash), np.where(answer > 0, share, unseen[form]), 0.0)
            value = scorer.of(np.concatenate(([0], contexts.of(vocab, form)[which[:-1]])), symbol[which]) + inside[which]
            base = np.log10(answer + 1.0) + unit
            add = np.add.reduceat
            out.append(pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "held_out": out_of == 1, "n_tokens": size, "n_known": add((answer > 0).astype(np.int64)[which], first), "train_tokens": tokens, "base_score": add(base[which], first), "score": add(value, first)}))
            out[-1].loc[missing == 1, "doc_id"] = pd.NA
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    answers = sums.where("block is not null").select("block", "bucket", "counts")
    # blocks numbered without large gaps are a task each
    task, place = F.shiftright("block", 32), F.col("block").bitwiseAND(0xFFFFFFFF)
    shape = texts.agg(F.count("*").alias("blocks"), F.max(task).alias("tasks"), F.max(place).alias("places")).first()
    each = (shape["places"] or 0) + 1
    spots = max(1, min(((shape["tasks"] or 0) + 1) * each, 2 * shape["blocks"] + spread))
    left, right = (df.withColumn("block", (task * each + place).cast("int")).repartitionById(spots, "block").groupBy("block") for df in (texts, answers))
    return left.cogroup(right).applyInPandas(scored, schema)
