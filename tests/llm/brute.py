"""Plain single-process versions of the contracts, to hold results against."""

from __future__ import annotations

import hashlib
import math
import re
from base64 import b32encode
from collections import Counter, defaultdict
from zlib import crc32

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def lm_base(rows):
    toks = {d: [*SPACED.findall(lower(t or "")), None] for d, t in rows}
    held = {d: crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    c = Counter(w for d, ws in toks.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in toks.items()}


def cosine_links(rows, least=0.9):
    ok = {i: [float(x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    norm = {i: math.sqrt(math.fsum(x * x for x in v)) for i, v in ok.items()}
    ids = sorted(ok)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(ok[a]) == len(ok[b]) and math.fsum(x * y for x, y in zip(ok[a], ok[b], strict=True)) / (norm[a] * norm[b]) >= least]
    n = Counter(i for link in links for i in link)
    comp = components([i for i, _ in rows], links)
    return {i: (n[i], comp[i], comp[i] == i) for i, _ in rows}


def shingles(text):
    w = SPACED.findall(lower(text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_duplicates(rows, percent=85):
    sets = {d: shingles(t) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sorted(sets.items()):
        for x in s:
            holders[x].append(d)
    shared = Counter((a, b) for ds in holders.values() for k, a in enumerate(ds) for b in ds[k + 1 :])
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    comp = components(list(sets), links)
    return {d: (len(sets[d]), comp[d], comp[d] == d) for d in sets}


def repeated_windows(rows, n=13):
    words = {d: SPACED.findall(t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        for k in range(len(words[d]) - n + 1):
            first.setdefault(tuple(words[d][k : k + n]), d)
    out = {}
    for d, ws in words.items():
        gone = set()
        for k in range(len(ws) - n + 1):
            if first[tuple(ws[k : k + n])] < d:
                gone.update(range(k, k + n))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out[d] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def contaminated(rows, bench, n=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, t in bench:
        ws = word.findall(lower(t or ""))
        size = min(n, len(ws))
        for k in range(len(ws) - size + 1 if ws else 0):
            windows[tuple(ws[k : k + size])].add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in rows:
        ws = word.findall(lower(t or ""))
        hit, items = set(), set()
        for size in sizes:
            for k in range(len(ws) - size + 1):
                if (found := windows.get(tuple(ws[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    items |= found
        out[d] = (len(ws), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    return out


def warc(rows):
    first = {}
    for p, h in sorted(rows):
        first.setdefault((h or "").encode(), p)
    out = {}
    for p, h in rows:
        raw = (h or "").encode()
        lead = first[raw]
        out[p] = (len(raw), b32encode(hashlib.sha1(raw).digest()).decode(), "response" if lead == p else "revisit", None if lead == p else lead)
    return out


def secrets(rows):
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    kinds = (("assign", assign, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))
    out = {}
    for d, t in rows:
        spans = [(m.start(), k, m.end()) for k, (_, r, g, least) in enumerate(kinds) for m in r.finditer(t or "") if len(m[g]) >= least]
        n = Counter(k for _, k, _ in spans)
        text = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(spans))
        out[d] = (n[0], n[1], n[2], hashlib.sha256(text.encode()).hexdigest())
    return out
