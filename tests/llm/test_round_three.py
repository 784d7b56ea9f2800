"""Personal data, ranked search and Merkle manifest against plain versions, on odd tables, and on planted cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from casebook.llm import lexical, merkle, personal, store

BIG = (1 << 60) + 1
CLASH = ("tree", "node", "pos", "n", "path", "row", "part", "doc", "term", "tf", "bucket", "code", "base", "spans", "pii_text", "pii_hits_0", "candidates", "leaf", "id")


def frame(spark, rows, schema):
    """Rows with columns whose names clash with those inside the operators."""
    names = ", ".join(f"`{c}` int" for c in CLASH)
    return spark.createDataFrame([(*r, *range(len(CLASH))) for r in rows], f"{schema}, {names}").repartition(4)


# Merkle manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def climb(nodes):
    """Levels of a tree, from its leaves to its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[a : a + 16])) for a in range(0, len(last), 16)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        a = i - i % 16
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 16])))
        i //= 16
    return out


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for rows (doc_id, source, lang, n_chars, text)."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([leaf(r, r[4]) for r in sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))]) for s in order}
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            bad = r[0] is not None and crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            node = leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r[4]) if bad else r[4])
            for left, right in path:
                node = h(left + node + right)
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], h("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def manifest(spark, rows):
    got = merkle.verified(merkle.prove(frame(spark, rows, SCHEMA), claimed=merkle.tampered_leaf())).collect()
    return Counter(tuple(r) for r in got)


def test_manifest_on_odd_rows(spark):
    draw = random.Random(1)
    rows = [(k, f"s{draw.randrange(40)}", "en", 3, f"Text {k} ß") for k in range(300)]
    rows += [(BIG + k % 3, "hot", None, None, "Same" if k % 2 else "Other") for k in range(200)]  # repeated ids, equal rows
    rows += [(None, None, None, None, None), (None, "hot", "de", 1, "X"), (7, None, "", 0, ""), (8, "", "en", None, "Empty"), (9, "ü", "en", 1, "A" * 100_000), (-5, "Z", "en", 1, "Neg")]
    want = Counter(plain_manifest(rows))
    got = manifest(spark, rows)
    # rows that are equal but for their place may swap their proofs
    assert got == want


def test_manifest_beyond_one_block(spark):
    rows = [(3 * k, "one", "en", k % 7, f"T{k}") for k in range(4097 + 16)] + [(1, "two", "en", 1, "t")] + [(k, f"g{k}", "en", 1, "g") for k in range(10_001, 10_031)]
    assert manifest(spark, rows) == Counter(plain_manifest(rows))


def test_manifest_without_rows(spark):
    assert not manifest(spark, []) and merkle.verified(merkle.prove(frame(spark, [], SCHEMA))).columns[0] == "doc_id"


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256, 257, 4096])
def test_traversal_holds_two_runs_a_level(n):
    leaves = [h(str(k)) for k in range(n)]
    levels = climb(leaves)
    walk = merkle.Traversal(leaves, merkle.height(n))
    assert walk.root() == levels[-1][0]
    for i, path in enumerate(walk.paths()):
        assert path == siblings(levels, i)
        held = sum(map(len, walk.existing)) + sum(len(o) for r in walk.desired for o in r.open)
        assert held <= (2 + walk.levels) * 16 * max(1, walk.levels)


def test_a_proof_fails_when_any_sibling_changes(spark):
    rows = [(k, "a" if k % 3 else "b", "en", 1, f"t{k}") for k in range(60)]
    proofs = merkle.prove(frame(spark, rows, SCHEMA))
    bent = proofs.withColumn("path", F.transform("path", lambda s: F.struct(F.translate(s["left"], "0123456789", "1234567890").alias("left"), s["right"].alias("right"))))
    good, bad = merkle.verified(proofs), merkle.verified(bent)
    assert good.where("verified").count() == 60
    assert {r["doc_id"] for r in bad.where("verified").collect()} == {r["id"] for r in proofs.collect() if not any(s["left"] for s in r["path"])}


# Ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=20):
    held = [(d, Counter(words(t))) for d, t in docs if words(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in words(text) if c[w])
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        out += [(item, r + 1, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scores)[:k])]
    return out


def texts(seed, n):
    draw = random.Random(seed)
    pool = ["the", "The", "OF", "ünder", "x_y", "a-b", "3.14", "naïve", *(f"w{k}" for k in range(30))]
    return [" ".join(draw.choices(pool, k=draw.choice([0, 1, 3, 20, 80]))) for _ in range(n)]


@pytest.mark.parametrize("blocks", [1_000, 3])
def test_search_is_the_plain_one(spark, monkeypatch, blocks):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", blocks)
    docs = [(k, t) for k, t in enumerate(texts(1, 150))] + [(BIG, t) for t in texts(2, 70)] + [(None, t) for t in texts(3, 5)] + [(500, None), (501, ""), (502, " . "), (BIG + 2, "the " * 50_000), (BIG + 4, "q" * 200_000)]
    items = [(k, t) for k, t in enumerate(texts(4, 12))] + [(3, "the the w1"), (None, "w2 w2 OF"), (90, None), (91, "unheard"), (92, "")]
    found = lexical.index(frame(spark, docs, "doc_id long, text string"), store.new_path(spark, "postings"))
    got = lexical.search(found, frame(spark, items, "item_id long, text string")).collect()
    assert Counter(tuple(r) for r in got) == Counter(plain_search(docs, items))


def test_search_without_rows(spark):
    docs, items = frame(spark, [], "doc_id long, text string"), frame(spark, [(1, "the")], "item_id long, text string")
    assert lexical.search(lexical.index(docs, store.new_path(spark, "postings")), items).count() == 0
    found = lexical.index(items.withColumnRenamed("item_id", "doc_id"), store.new_path(spark, "postings"))
    assert lexical.search(found, items.limit(0)).count() == 0


# Personal data

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def passes(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == 1:
        return all(int(p) <= 255 for p in hit.split("."))
    return kind == 0 or (14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 10 <= len(digits) <= 15)


def plain_base(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text or "") if passes(k, m[0]))


def card(draw):
    digits = "4" + "".join(draw.choices("0123456789", k=14))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def planted(n=120):
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefgh", k=5))
    rows = []
    for k in range(n):
        mid = [f"{word()}.{k}@{word()}.example.com", f"{draw.randrange(1, 255)}.{draw.randrange(255)}.{k % 256}.7", card(draw), f"+1 ({draw.randrange(200, 999)}) 555-{1000 + k}"][k % 4]
        rows.append((k, f"{word()} {word()} {mid} {word()}, {word()}"))
    return rows


def test_base_spans_are_the_plain_ones(spark):
    draw = random.Random(3)
    rows = [(k, "".join(draw.choices("a@..+-()_%  0123456789é😀x", k=draw.choice([5, 40, 200])))) for k in range(1500)]
    rows += [(BIG, f"{card(draw)}{sep}{card(draw)[:3]}") for sep in (" ", "-", "  ", "x")] + [(BIG, f"000{card(draw)}"), (1, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 256.1.1.1 00000000255.1.1.1"), (2, "+1 234 567 8901 +49 (0)30 901820"), (None, "x@y.zz"), (None, None), (3, "")]
    long = [(4, "1 " * 100_000), (5, "7" * 200_000), (6, "a" * 300_000 + "@"), (8, "+" * 50_000)]  # without a span
    rows += [(7, "9.9.9.9 " * 3_000)]
    got = personal.scan(frame(spark, rows + long, "doc_id long, text string"), personal.Model(0.0, (), (None,) * len(personal.GENERATORS)))
    found = Counter((r["doc_id"], tuple(tuple(s) for s in r["base"])) for r in got.collect())
    assert found == Counter((d, tuple(plain_base(t))) for d, t in rows) + Counter((d, ()) for d, _ in long)
    assert got.where("base != spans").count() == 0


def test_planted_cases_are_added_and_clean_texts_left_alone(spark):
    draw = random.Random(8)
    a, b = card(draw), card(draw)
    extra = [
        (1000, f"ab cd {a} {b} ef"),  # one run of 32 digits fails the check of the base pattern
        (1001, f"ab +1 (269) 555-3296 {a} ef"),
        (1002, "ab joe.99 (at) abc.example.com ef"),
        (1003, "ab (523) 555-1055 ef"),
    ]
    clean = [(2000, "ab 1234567890123456 cd"), (2001, "version 1.2 and 3.4, 12 of 13"), (2002, "abc0641917ea4e9feb9cda83477b57ac2654884f485"), (2003, "look (at) this"), (2004, "100 200 3000 times")]
    docs = frame(spark, [*planted(400), *extra, *clean], "doc_id long, text string")
    got = {r["doc_id"]: {tuple(s) for s in r["spans"]} for r in personal.scan(docs).collect()}
    assert got[1000] == {(6, 2, 22), (23, 2, 39)}
    assert got[1001] == {(3, 3, 20), (21, 2, 37)}
    assert got[1002] == {(3, 0, 30)}
    assert got[1003] == {(3, 3, 17)}
    assert not any(got[d] for d, _ in clean)
    assert all(got[d] == set(plain_base(t)) and len(got[d]) == 1 for d, t in planted(400))


def test_redaction_replaces_spans_and_keeps_the_rest(spark):
    docs = frame(spark, [*planted(), (BIG, None), (None, "")], "doc_id long, text string")
    model = personal.fit(docs)
    clean = personal.redact(docs, model)
    assert clean.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert kept[BIG] is None and kept[None] == ""
    for d, t in planted():
        (start, kind, end), = plain_base(t)
        assert kept[d] == f"{t[:start]}[{personal.KINDS[kind].upper()}]{t[end:]}"


def test_personal_data_without_rows(spark):
    docs = frame(spark, [], "doc_id long, text string")
    assert personal.digest(personal.scan(docs)).count() == 0
    assert personal.redact(docs, personal.fit(docs)).count() == 0


def test_digests_of_personal_data(spark):
    rows = [*planted(40), (None, "x@y.zz"), (BIG, None)]
    got = personal.digest(personal.scan(frame(spark, rows, "doc_id long, text string"))).collect()
    want = Counter()
    for d, t in rows:
        base = plain_base(t)
        want[d, *(sum(s[1] == k for s in base) for k in range(4)), h(",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in base))] += 1
    assert Counter(tuple(r)[:6] for r in got) == want


def test_held_out_candidates_are_told_from_others(spark):
    """Numbers inside hexadecimal digests have the digits of cards, but not their context."""
    draw = random.Random(11)
    noise = [(5000 + k, f"ab x{''.join(draw.choices('0123456789', k=16))}f cd") for k in range(300)]
    docs = frame(spark, [*planted(400), *noise], "doc_id long, text string")
    rows = personal.marked(docs.select("doc_id", "text"), "text", "base", "candidates")
    model = personal.fit_marked(rows, "candidates")
    each = rows.select(F.explode("candidates").alias("c")).select("c.*").where("held_out").withColumn("yes", model.accepts(F.struct(*personal.FEATURES)))
    right = each.agg(F.avg((F.col("yes") == F.col("confirmed")).cast("int"))).first()[0]
    assert right > 0.98
