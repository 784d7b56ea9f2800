"""Secret scans with a trigram index, by DataFrame functions only.

``trigram_query`` derives from a regex the trigrams that any match must hold, as a list of
alternatives (a disjunction of conjunctions) over lower-cased text.  ``candidates`` builds postings for those trigrams,
block by block of documents, and intersects and unites them by rule; a rule
without mandatory trigrams has every document as a candidate.  ``scan`` verifies candidates with
the regexes.

Postings are grouped by trigram and block of documents, so that the most common trigram's
postings are as many bounded groups as there are blocks.  What they give, ids with their rules, is stored; while it is
small (``FEW_CANDIDATES``, a checked number) it is broadcast and no text moves; beyond that a Bloom filter of its ids is broadcast, of bounded size, and
only documents that pass it are joined to it by id.

Cases: null text counts as empty and has no spans; repeated ids share candidates, yet each
row is verified on its own text; rows with a null id are in no posting, and candidates of every rule; other columns are ignored by ``scan`` and pass ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

BLOCK_DOCS = 4096
#: Documents with candidate rules that are broadcast, some 100 bytes each.
FEW_CANDIDATES = 400_000
#: Bits of a piece of the Bloom filter beyond that, as a bitmap of Spark's has them, pieces at most (64 MB), and bits for each id.
PIECE_BITS, MOST_PIECES, PROBES = 1 << 15, 1 << 14, 5


@dataclass(frozen=True)
class Rule:
    """``kind``'s matches of ``pattern`` whose group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three base kinds, in their order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: More kinds of credentials, by their public prefixes.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("maps_key", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)
RULES = BASE + MORE
_MOST = 128


def _flatten(strings: set[str]) -> list[frozenset[str]]:
    """One conjunction of trigrams for each string, without those that another one implies; [] holds always."""
    sets = {frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings}
    if frozenset() in sets:
        return []
    return [s for s in sets if not any(o < s for o in sets)]


def _walk(parsed) -> tuple[set[str] | None, list[list[frozenset[str]]]]:
    """The strings that a part stands for, if few; and what else any match of it must hold."""
    current, need, exact = {""}, [], True
    for op, arg in parsed:
        part: set[str] | None = None
        inner: list[list[frozenset[str]]] = []
        if op is sre.LITERAL:
            part = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            part = {chr(a).lower() for _, a in arg}
        elif op is sre.SUBPATTERN:
            part, inner = _walk(arg[3])
        elif op is sre.BRANCH:
            ways = [_walk(way) for way in arg[1]]
            if all(w[0] is not None for w in ways):
                part = set().union(*(w[0] for w in ways))
            else:
                each = [[*w[1], *([_flatten(w[0])] if w[0] is not None else [])] for w in ways]
                firsts = [next((q for q in e if q), []) for e in each]
                inner = [[c for q in firsts for c in q]] if all(firsts) else []
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            strings, within = _walk(body)
            if low >= 1:
                inner = [*within, *([_flatten(strings)] if strings else [])]
            if strings is not None and (low, high) == (0, 1):
                part = strings | {""}
            elif strings is not None and low == high == 1:
                part = strings
        if part is not None and len(current) * len(part) <= _MOST:
            current = {a + b for a in current for b in part}
            need += inner
        else:
            need += [_flatten(current), *inner]
            current, exact = part if part is not None else {""}, False
    if exact:
        return current, need
    return None, [*need, _flatten(current)]


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of lower-case trigrams: a text with a match holds all of at least one.  []: no condition."""
    strings, need = _walk(sre_parser.parse(pattern))
    if strings is not None:
        need = [*need, _flatten(strings)]
    query: list[frozenset[str]] = []
    for part in (p for p in need if p):
        both = {a | b for a in query for b in part} if query else set(part)
        if len(both) <= _MOST:
            query = [s for s in both if not any(o < s for o in both)]
    return sorted(query, key=sorted)


def candidates(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (not null) and ``kinds``, the places of those rules with mandatory trigrams whose query its postings satisfy."""
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for s in q for g in s})
    blocks = max(1, -(-docs.count() // BLOCK_DOCS))
    lowered = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(k)) for k, g in enumerate(grams))))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")
    postings = lowered.select("doc_id", block, F.explode(held).alias("gram")).groupBy("block", "gram").agg(F.collect_set("doc_id").alias("docs"))
    kind = lowered.schema["doc_id"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    table = postings.groupBy("block").agg(*(F.coalesce(F.first(F.when(F.col("gram") == k, F.col("docs")), ignorenulls=True), none).alias(f"g{k}") for k in range(len(grams))))
    place = {g: f"g{k}" for k, g in enumerate(grams)}

    def satisfied(query) -> Column:
        ways = [reduce(F.array_intersect, [F.col(place[g]) for g in sorted(way)]) for way in query]
        return reduce(F.array_union, ways)

    def of_kind(k: int):
        return lambda d: F.struct(F.lit(k).alias("kind"), d.alias("doc_id"))

    pairs = [F.transform(satisfied(q), of_kind(k)) for k, q in queries.items()]
    if not pairs:
        return lowered.select("doc_id", F.array().cast("array<int>").alias("kinds")).limit(0)
    found = table.select(F.explode(F.flatten(F.array(*pairs))).alias("c")).select("c.doc_id", "c.kind")
    return found.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _bits(id_: Column, pieces: int) -> list[Column]:
    """The piece of an id in a Bloom filter, and its places there."""
    return [F.pmod(F.xxhash64(id_, F.lit(0)), F.lit(pieces)), *(F.pmod(F.xxhash64(id_, F.lit(k + 1)), F.lit(PIECE_BITS)) for k in range(PROBES))]


def _split(docs: DataFrame, id_col: str, found: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` that may be among ``found`` (ids in ``doc``), and those that are not, by a Bloom filter of the ids.

    The filter is a bitmap for each of its pieces, which is broadcast: ten bits an id, so that one in a hundred others passes, and
    at most ``MOST_PIECES`` pieces, beyond which more do.
    """
    pieces = min(MOST_PIECES, store.parts(10 * found.count(), PIECE_BITS))
    piece, place, held, free = (store.free_name(docs, n) for n in ("bloom_piece", "bloom_place", "bloom_bits", "bloom_of"))
    own, *places = _bits(F.col(doc), pieces)
    set_ = found.select(own.alias(piece), F.explode(F.array(*places)).alias(place))
    bitmaps = set_.groupBy(F.col(piece).alias(free)).agg(F.bitmap_construct_agg(place).alias(held))
    at, *places = _bits(F.col(id_col), pieces)
    met = docs.withColumn(piece, at).join(F.broadcast(bitmaps), F.col(piece) == F.col(free), "left")

    def is_set(p: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col(held), (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, (p % 8).cast("int")) == 1

    may = F.coalesce(reduce(lambda a, b: a & b, [is_set(p) for p in places]), F.lit(False))
    return met.where(may).select(*docs.columns), met.where(~may).select(*docs.columns)


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _searched(rule: Rule) -> str:
    """A pattern with the same long matches as the rule's.

    Where only a repeated class at the end decides the length, the regex itself can skip
    short matches: they end where any later match within them would.
    """
    parts = list(sre_parser.parse(rule.pattern))
    if rule.group == 0 and rule.least and rule.pattern.endswith("]+") and all(op in (sre.LITERAL, sre.IN) for op, _ in parts[:-1]):
        return f"{rule.pattern[:-1]}{{{max(1, rule.least - len(parts) + 1)},}}"
    return rule.pattern


def _walked(hits: Column, gaps: Column, rule: Rule, order: int) -> Column:
    """Spans of matches ``hits`` with the texts ``gaps`` between them, without those that are too short."""

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        value = F.regexp_extract(pair["hit"], rule.pattern, rule.group) if rule.group else pair["hit"]
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(value) >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, first, step, lambda acc: acc["out"])


def _with_spans(docs: DataFrame, rules, id_col: str, text_col: str, spans: str) -> DataFrame:
    """All columns of ``docs`` and ``spans``, the spans by start and kind."""
    free = [store.free_name(docs, n) for n in ("span_doc", "span_kinds", "span_text", *(f"{p}_{k}" for k in range(len(rules)) for p in ("hits", "gaps")))]
    doc, kinds, text, pairs = *free[:3], list(zip(free[3::2], free[4::2], strict=True))
    found = candidates(docs, rules, id_col, text_col).select(F.col("doc_id").alias(doc), F.col("kinds").alias(kinds))
    found = store.materialize(found, "candidates")
    # rows with a null id are asked for every rule
    every = F.array(*(F.lit(k) for k in range(len(rules)))).cast("array<int>")
    if found.count() <= FEW_CANDIDATES:
        out = docs.join(F.broadcast(found), F.col(id_col) == F.col(doc), "left").withColumn(kinds, F.when(F.col(id_col).isNull(), every).otherwise(F.col(kinds)))
    else:  # rows that are no candidates stay where they are, and so do those with a null id, which would be one key of a join
        likely, rest = _split(docs.where(F.col(id_col).isNotNull()), id_col, found, doc)
        none = {doc: F.lit(None).cast(found.schema[doc].dataType), kinds: F.lit(None).cast("array<int>")}
        out = likely.join(found, F.col(id_col) == F.col(doc), "left").union(rest.withColumns(none))
        out = out.union(docs.where(F.col(id_col).isNull()).withColumns({**none, kinds: every}))
    out = out.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    strings = F.array().cast("array<string>")
    hits, gaps, each = {}, {}, []
    for k, (rule, (hit, gap)) in enumerate(zip(rules, pairs, strict=True)):
        pattern = _searched(rule)
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        asked = F.coalesce(F.array_contains(kinds, k), F.lit(False)) if trigram_query(rule.pattern) else F.lit(True)
        hits[hit] = F.when(asked, matches).otherwise(strings)
        gaps[gap] = F.when(F.size(hit) > 0, F.split(text, pattern, -1)).otherwise(strings)
        each.append(F.when(F.size(hit) > 0, _walked(F.col(hit), F.col(gap), rule, k)).otherwise(F.array().cast(_SPANS)))
    # one projection after another, so that no regex runs twice over a text
    return out.withColumns(hits).withColumns(gaps).withColumn(spans, F.array_sort(F.flatten(F.array(*each)))).drop(*free)


def scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: (start, kind, end) by start and kind, in code points, end exclusive; kind is the rule's place."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _with_spans(plain, rules, "doc_id", "text", "spans").select("doc_id", "spans")


def redact(docs: DataFrame, rules=RULES, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span, overlapping ones together, replaced by ``mark``; nothing else changes."""
    spans = store.free_name(docs, "spans")
    marked = _with_spans(docs, rules, id_col, text_col, spans)
    text = F.col(text_col).cast("string")

    def step(acc: Column, s: Column) -> Column:
        clear = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(clear, F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(spans, first, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return marked.withColumn(text_col, F.when(F.size(spans) > 0, whole).otherwise(text)).select(*docs.columns)


def digest(scanned: DataFrame, rules=RULES) -> DataFrame:
    """Counts of the base kinds and their digest, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    names = F.array(*(F.lit(r.kind) for r in rules))

    def text(spans) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(k: int):
        return lambda s: s["kind"] == k

    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return scanned.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text("spans").alias("spans"))
