"""Personal data by generators, boosted trees and calibrated thresholds, by DataFrame functions only.

``marked`` finds two lists of spans for each row in one pass over its text.  Base spans match a kind's pattern and pass its check.  Candidates are
proposed by high-recall ``GENERATORS``, whose spans overlap each other and the base spans, with small whole numbers that describe format and context.

``fit`` learns which candidates are personal data from those that lie within a base span of their kind, over all rows:
candidates are first counted by their numbers, folds and labels, and trees of depth two are grown by gradient boosting on histograms of that table.
Only histograms reach the driver, at most a number for each leaf, feature and value.  Half of the candidates, by a hash of their text, is held out;
on them isotonic regression turns scores into probabilities, and each generator's threshold is the least score with ``PRECISION``.  A generator
without enough held-out candidates adds nothing, and neither is a candidate added whose format no confirmed one of its generator has.

``scan`` adds to the base spans the candidates beyond their threshold that overlap no base span; of those that overlap each other
the leftmost stays, and the longest of these.  ``redact`` replaces all spans.

Cases: null text counts as empty and has no spans; ids play no part, so null and repeated ids are rows like any other; a table without
candidates, or without rows, gives a model that adds nothing; other columns are ignored by ``scan`` and pass ``redact``, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: The kinds in their order, and the patterns of their base spans.
KINDS = ("email", "ip", "card", "phone")
#: The patterns as asked for, with possessive repeats and starts only where the leftmost match can start, so that long texts take linear time.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[ -]?[0-9]){13,}+",  # fewer digits fail the check
    r"\+[0-9][ ().0-9-]+[0-9]",
)
#: What a text with a base span of a kind holds.
_HELD = ("@", ".", "", "+")


@dataclass(frozen=True)
class Generator:
    """Proposes spans of ``kind``; texts without any character of ``held`` have none."""

    name: str
    kind: int
    pattern: str
    held: str = ""


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
GENERATORS = (
    Generator("email", 0, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@| ?[\[(](?i:at)[\])] ?)[A-Za-z0-9-]++(?:(?:\.| ?[\[(](?i:dot)[\])] ?)[A-Za-z0-9-]++)++", "@(["),
    Generator("ip", 1, rf"(?<![0-9]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9])", "."),
    Generator("card", 2, r"(?<![0-9])[0-9]{14,19}(?![0-9])"),
    Generator("grouped card", 2, r"(?<![0-9])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"),
    Generator("phone abroad", 3, r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-][0-9]{2,4}){1,4}(?![0-9])", "+"),
    Generator("phone, area in brackets", 3, r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])", "("),
    Generator("phone", 3, r"(?<![0-9+])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
)
#: Words near a span that speak for its kind, and words that speak against any.
_OWN = ("mail|contact|write", "ip|host|server|address", "card|visa|credit|pay", "tel|phone|call|fax|mobile")
_OTHER = "version|release|order|invoice|serial|isbn|hash|token|key|password|ticket"
CONTEXT = 24
#: What describes a candidate: names, and how many values each has.
FEATURES = {"gen": len(GENERATORS), "digits": 8, "groups": 5, "first": 9, "before": 6, "after": 6, "cue": 3, "check": 2}
FORMAT = ("digits", "groups", "first", "check")
TREES = 12
RATE = 0.5
#: Least probability of a candidate that is added, and the weight of absent negatives in it.
PRECISION = 0.9
DOUBT = 2
_SPAN = "struct<start:int,kind:int,end:int>"
_FIELDS = ("start", "kind", "end", "held_out", *FEATURES)
_CANDIDATE = "struct<" + ",".join(f"{f}:{'boolean' if f == 'held_out' else 'int'}" for f in _FIELDS) + ">"
_TOLD = f"array<{_CANDIDATE[:-1]},confirmed:boolean,free:boolean>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(total: Column, k: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 1, digit * 2 - F.when(digit > 4, 9).otherwise(0)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _checked(kind: int, hit: Column) -> Column:
    """Whether a match of a base pattern passes the check of its kind."""
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return F.forall(F.split(hit, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == 2:
        d = _digits(hit)
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)
    return F.length(_digits(hit)).between(10, 15)


def _placed(hits: Column, gaps: Column) -> Column:
    """Matches with their places: struct(start, end, hit, before, after), where ``gaps`` are the texts around them.

    Places are summed in two levels of about equal length, as one fold would copy what it has at every step.
    """
    n = F.size(hits)
    after = F.slice(gaps, 2, n)
    parts = F.zip_with(F.zip_with(F.slice(gaps, 1, n), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))), after, lambda p, a: F.struct(p["gap"].alias("gap"), p["hit"].alias("hit"), F.substring(a, 1, 1).alias("after")))
    each = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / each).cast("int")), lambda b: F.slice(parts, b * each + 1, each))

    def length(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda s, p: s + F.length(p["gap"]) + F.length(p["hit"]))

    none = F.array().cast("array<int>")
    starts = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda acc, b: F.struct((acc["at"] + length(b)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["hit"])
        before = F.when(F.length(p["gap"]) > CONTEXT, F.substring(p["gap"], -CONTEXT, CONTEXT)).otherwise(p["gap"])
        span = F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("hit"), before.alias("before"), p["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    empty = F.array().cast("array<struct<start:int,end:int,hit:string,before:string,after:string>>")
    lists = F.zip_with(blocks, starts, lambda b, s: F.aggregate(b, F.struct(s.alias("at"), empty.alias("out")), step, lambda acc: acc["out"]))
    return F.when(n > 0, F.flatten(lists)).otherwise(empty)


def _side(c: Column) -> Column:
    """Class of a neighbouring character: none, space, letter, digit, punctuation of sentences, other."""
    return F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"\p{L}|_"), 2).when(c.rlike("[0-9]"), 3).when(c.rlike("[.,;:!?()]"), 4).otherwise(5)


def _bin(x: Column, ends: list[int]) -> Column:
    """How many of ``ends`` are at most ``x``."""
    out = F.lit(0)
    for k, end in enumerate(ends):
        out = F.when(x >= end, k + 1).otherwise(out)
    return out


def _described(gen: int, g: Generator):
    """A candidate with its fold and its features, as a function of its match."""

    def described(c: Column) -> Column:
        numeric = g.kind != 0  # digits of an address say nothing
        d, low = _digits(c["hit"]) if numeric else F.lit(""), F.lower(c["before"])
        first = F.coalesce(F.substring(d, 1, 1).try_cast("int"), F.lit(8))
        check = c["hit"].rlike(r"[. \])][A-Za-z]{2,}$") if g.kind == 0 else _checked(g.kind, c["hit"])
        features = {
            "gen": F.lit(gen),
            "digits": _bin(F.length(d), [7, 10, 12, 14, 16, 17, 20]),
            "groups": _bin(F.size(F.split(c["hit"], "[^0-9]+")), [2, 3, 4, 5]) if numeric else F.lit(0),
            "first": F.least(first, F.when(d == "", 8).otherwise(7)),
            "before": F.when((c["before"] == "") & (c["start"] > 0), 5).otherwise(_side(F.substring(c["before"], -1, 1))),
            "after": _side(c["after"]),
            "cue": F.when(low.rlike(_OTHER), 2).when(low.rlike(_OWN[g.kind]), 1).otherwise(0),
            "check": check.cast("int"),
        }
        held_out = F.pmod(F.crc32(c["hit"].cast("binary")), F.lit(2)) == 1
        return F.struct(c["start"].alias("start"), F.lit(g.kind).alias("kind"), c["end"].alias("end"), held_out.alias("held_out"), *(v.cast("int").alias(k) for k, v in features.items()))

    return described


def _related(base: Column, candidates: Column) -> Column:
    """``candidates`` by start, with whether a base span of their kind holds them (``confirmed``) and whether none overlaps them (``free``).

    Both lists are walked once from the right, with the nearest base span's start, and once from the left, with each kind's furthest end.
    """
    none = F.lit(None).cast(_CANDIDATE)
    spans = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("own"), b["kind"].alias("kind"), b["end"].alias("end"), none.alias("c")))
    events = F.array_sort(F.concat(spans, F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("own"), c["kind"].alias("kind"), c["end"].alias("end"), c.alias("c")))))

    def leftwards(acc: Column, e: Column) -> Column:
        seen = F.struct(e["start"].alias("start"), e["own"].alias("own"), e["kind"].alias("kind"), e["end"].alias("end"), e["c"].alias("c"), (acc["next"] >= e["end"]).alias("clear"))
        return F.struct(F.when(e["own"] == 0, e["start"]).otherwise(acc["next"]).alias("next"), F.concat(acc["out"], F.array(seen)).alias("out"))

    event = f"array<struct<start:int,own:int,kind:int,end:int,c:{_CANDIDATE},clear:boolean>>"
    right = F.aggregate(F.reverse(events), F.struct(F.lit(2**31 - 1).alias("next"), F.array().cast(event).alias("out")), leftwards, lambda acc: F.reverse(acc["out"]))
    ends = [f"end_{k}" for k in range(len(KINDS))]

    def rightwards(acc: Column, e: Column) -> Column:
        own = F.lit(-1)
        for k, name in enumerate(ends):
            own = F.when(e["kind"] == k, acc[name]).otherwise(own)
        c = e["c"]
        told = F.struct(*(c[f].alias(f) for f in _FIELDS), (own >= e["end"]).alias("confirmed"), (e["clear"] & (acc["far"] <= e["start"])).alias("free"))
        out = F.when(e["own"] == 1, F.concat(acc["out"], F.array(told))).otherwise(acc["out"])
        moved = [F.when((e["own"] == 0) & (e["kind"] == k), e["end"]).otherwise(acc[name]).alias(name) for k, name in enumerate(ends)]
        return F.struct(*moved, F.when(e["own"] == 0, F.greatest(acc["far"], e["end"])).otherwise(acc["far"]).alias("far"), out.alias("out"))

    first = F.struct(*(F.lit(-1).alias(name) for name in ends), F.lit(-1).alias("far"), F.array().cast(_TOLD).alias("out"))
    return F.when(F.size(candidates) > 0, F.aggregate(right, first, rightwards, lambda acc: acc["out"])).otherwise(F.array().cast(_TOLD))


def marked(docs: DataFrame, text_col: str, base: str, candidates: str) -> DataFrame:
    """``docs`` with its base spans (start, kind, end) by start and kind, and all candidates, as columns of these names."""
    names = ["pii_text", *(f"{p}_{k}" for k in range(len(BASE) + len(GENERATORS)) for p in ("pii_hits", "pii_gaps"))]
    free = [store.free_name(docs, n) for n in names]
    text, pairs = free[0], list(zip(free[1::2], free[2::2], strict=True))
    strings = F.array().cast("array<string>")
    out = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    hits, gaps = {}, {}
    searched = [*zip(BASE, _HELD, strict=True), *((g.pattern, g.held) for g in GENERATORS)]
    for (pattern, held), (hit, gap) in zip(searched, pairs, strict=True):
        matches = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        if held:
            matches = F.when(reduce(or_, [F.contains(F.col(text), F.lit(c)) for c in held]), matches).otherwise(strings)
        hits[hit] = matches
        gaps[gap] = F.when(F.size(hit) > 0, F.split(F.col(text), pattern, -1)).otherwise(strings)

    def spans(k: int) -> Column:
        passed = F.filter(_placed(F.col(pairs[k][0]), F.col(pairs[k][1])), lambda c: _checked(k, c["hit"]))
        return F.transform(passed, lambda c: F.struct(c["start"].alias("start"), F.lit(k).alias("kind"), c["end"].alias("end")))

    def proposed(k: int) -> Column:
        hit, gap = pairs[len(BASE) + k]
        return F.when(F.size(hit) > 0, F.transform(_placed(F.col(hit), F.col(gap)), _described(k, GENERATORS[k]))).otherwise(F.array().cast(f"array<{_CANDIDATE}>"))

    found = F.array_sort(F.flatten(F.array(*(F.when(F.size(pairs[k][0]) > 0, spans(k)).otherwise(F.array().cast(f"array<{_SPAN}>")) for k in range(len(BASE))))))
    out = out.withColumns(hits).withColumns(gaps).withColumns({base: found, candidates: F.flatten(F.array(*(proposed(k) for k in range(len(GENERATORS)))))})
    return out.withColumn(candidates, _related(F.col(base), F.col(candidates))).drop(*free)


@dataclass(frozen=True)
class Tree:
    """A split by whether a feature has a value, split once more on either side; ``out`` are the leaves' values, both first splits' yes side first."""

    split: tuple[str, int]
    sides: tuple[tuple[str, int], tuple[str, int]]
    out: tuple[tuple[float, float], tuple[float, float]]

    def value(self, c) -> Column:
        yes, no = (F.when(c[f] == v, a).otherwise(b) for (f, v), (a, b) in zip(self.sides, self.out, strict=True))
        return F.when(c[self.split[0]] == self.split[1], yes).otherwise(no)


@dataclass(frozen=True)
class Model:
    start: float
    trees: tuple[Tree, ...]
    #: Least score of each generator's candidates that are added; None adds none.
    thresholds: tuple[float | None, ...]
    #: Values of ``FORMAT`` features that confirmed candidates of each generator have.  Others are beyond what was learnt, and not added.
    known: tuple[tuple[int, str, tuple[int, ...]], ...] = ()

    def score(self, c) -> Column:
        """Log odds that a candidate is personal data, to six decimals."""
        total = F.lit(self.start)
        for t in self.trees:
            total = total + t.value(c)
        return F.round(total, 6)

    def accepts(self, c) -> Column:
        least = F.lit(None).cast("double")
        for k, t in enumerate(self.thresholds):
            if t is not None:
                least = F.when(c["gen"] == k, t).otherwise(least)
        familiar = F.lit(True)
        for k, feature, values in self.known:
            familiar = familiar & ((c["gen"] != k) | c[feature].isin(*values))
        return familiar & F.coalesce(self.score(c) >= least, F.lit(False))


def _gain(g: float, h: float) -> float:
    return g * g / (h + 1)


def _best(cells: dict[tuple[str, int], tuple[float, float]], g: float, h: float) -> tuple[str, int]:
    """The split of a node with sums ``g`` and ``h`` that gains most, equal ones by name and value."""
    return min(cells, key=lambda s: (-round(_gain(*cells[s]) + _gain(g - cells[s][0], h - cells[s][1]), 9), s), default=("gen", 0))


def _histogram(rows: DataFrame, leaf: Column) -> dict[int, dict[tuple[str, int], tuple[float, float]]]:
    """Sums of gradients and curvatures for each leaf, feature and value."""
    cell = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES)))
    sums = rows.select(leaf.alias("leaf"), cell.alias("c"), "g", "h").groupBy("leaf", "c.feature", "c.value").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    out: dict[int, dict[tuple[str, int], tuple[float, float]]] = {0: {}, 1: {}}
    for r in sums.collect():  # at most two leaves times the values of all features
        out[r["leaf"]][r["feature"], r["value"]] = (r["g"], r["h"])
    return out


def _total(cells: dict[tuple[str, int], tuple[float, float]]) -> tuple[float, float]:
    of_gen = [v for (f, _), v in cells.items() if f == "gen"]
    return math.fsum(g for g, _ in of_gen), math.fsum(h for _, h in of_gen)


def _grown(rows: DataFrame) -> Tree:
    cells = _histogram(rows, F.lit(0))[0]
    split = _best(cells, *_total(cells))
    below = _histogram(rows, F.when(F.col(split[0]) == split[1], 0).otherwise(1))
    sides, out = [], []
    for k in (0, 1):
        g, h = _total(below[k])
        side = _best(below[k], g, h)
        a, b = below[k].get(side, (0.0, 0.0))
        sides.append(side)
        out.append((RATE * a / (b + 1), RATE * (g - a) / (h - b + 1)))
    return Tree(split, tuple(sides), tuple(out))


def _calibrated(scores: list[tuple[float, int, int]]) -> float | None:
    """The least score with probability ``PRECISION`` by isotonic regression on (score, candidates, confirmed)."""
    pools: list[list] = []
    for score, n, good in sorted(scores):
        pools.append([score, n, good])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            _, n, good = pools.pop()
            pools[-1][1] += n
            pools[-1][2] += good
    return next((s for s, n, good in pools if good >= PRECISION * (n + DOUBT)), None)


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """A model of the candidates of all ``docs``."""
    return fit_marked(marked(docs.select(F.col(text_col).alias("text")), "text", "base", "candidates").select("candidates"), "candidates")


def fit_marked(rows: DataFrame, candidates: str) -> Model:
    """A model of candidates as of ``marked``."""
    scratch = store.Scratch(rows.sparkSession, "personal")
    one = rows.select(F.explode(candidates).alias("c")).select("c.*")
    counted = one.groupBy("held_out", *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.count_if("confirmed").alias("good"))
    vectors = scratch.store(counted, "vectors")
    total = vectors.where("not held_out").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    share = (total["good"] + 1) / (total["n"] + 2)
    model = Model(math.log(share / (1 - share)), (), (None,) * len(GENERATORS))
    learnt = vectors.where("not held_out")
    for _ in range(TREES if total["n"] else 0):
        p = 1 / (1 + F.exp(-model.score(F.struct(*FEATURES))))
        rows = learnt.withColumn("p", p).withColumns({"g": F.col("good") - F.col("n") * F.col("p"), "h": F.col("n") * F.col("p") * (1 - F.col("p"))})
        model = Model(model.start, (*model.trees, _grown(rows)), model.thresholds)
    held = vectors.where("held_out").withColumn("score", F.round(model.score(F.struct(*FEATURES)), 2))
    scores: dict[int, list] = {}
    for r in held.groupBy("gen", "score").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect():  # scores to two decimals of bounded log odds
        scores.setdefault(r["gen"], []).append((r["score"], r["n"], r["good"]))
    least = [_calibrated(scores.get(k, [])) for k in range(len(GENERATORS))]
    pairs = learnt.where("good > 0").select("gen", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FORMAT))).alias("c"))
    sets = pairs.groupBy("gen", "c.feature").agg(F.sort_array(F.collect_set("c.value")).alias("values")).orderBy("gen", "feature").collect()  # a row for each generator and feature
    scratch.clear()
    return Model(model.start, model.trees, tuple(None if t is None else t - 0.005 for t in least), tuple((r["gen"], r["feature"], tuple(r["values"])) for r in sets))


def _chosen(base: Column, candidates: Column, model: Model) -> Column:
    """Base spans and added ones by start and kind."""
    good = F.filter(candidates, lambda c: c["free"] & model.accepts(c))
    order = F.array_sort(F.transform(good, lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("far"), c["kind"].alias("kind"))))

    def step(acc: Column, c: Column) -> Column:
        span = F.array(F.struct(c["start"].alias("start"), c["kind"].alias("kind"), (-c["far"]).alias("end")))
        clear = c["start"] >= acc["at"]
        return F.struct(F.when(clear, -c["far"]).otherwise(acc["at"]).alias("at"), F.when(clear, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    added = F.aggregate(order, first, step, lambda acc: acc["out"])
    return F.when(F.size(order) > 0, F.array_sort(F.concat(base, added))).otherwise(base)


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ``base`` and ``spans``: (start, kind, end) by start and kind, in code points, end exclusive; kind is the place in ``KINDS``.

    Without a model one is fitted on ``docs``, whose candidates are stored, so that texts are read once.
    """
    rows = marked(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "base", "candidates").select("doc_id", "base", "candidates")
    if model is None:
        rows = store.materialize(rows, "candidates")
        model = fit_marked(rows, "candidates")
    return rows.select("doc_id", "base", _chosen(F.col("base"), F.col("candidates"), model).alias("spans"))


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with every span, overlapping ones together, replaced by the first one's kind in brackets; nothing else changes."""
    base, candidates = store.free_name(docs, "pii_base"), store.free_name(docs, "pii_candidates")
    rows = marked(docs, text_col, base, candidates).withColumn(base, _chosen(F.col(base), F.col(candidates), model))
    text, marks = F.col(text_col).cast("string"), F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.get(marks, s["kind"])))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(base, first, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return rows.withColumn(text_col, F.when(F.size(base) > 0, whole).otherwise(text)).select(*docs.columns)


def _as_text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""

    def of_kind(k: int):
        return lambda s: s["kind"] == k

    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return scanned.select("doc_id", *counts, F.sha2(_as_text(F.col("base")), 256).alias("base_sha256"), _as_text(F.col("spans")).alias("spans"))
