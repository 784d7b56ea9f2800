"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from . import secrets

_SPACED = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(key: str) -> str:
    """Smallest node that each one reaches over ``links`` (a, b), by breadth-first search from every node."""
    return f"""both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, node) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT r.id, w.b FROM reach r JOIN both_ways w ON w.a = r.node),
found AS (SELECT id AS {key}, min(node) AS component FROM reach GROUP BY 1)"""


EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id AND len(p.e) = len(q.e) AND list_cosine_similarity(p.e, q.e) >= 0.9),
{_components("vec_id")}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN found USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM both_ways GROUP BY 1) USING (vec_id)"""

NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACED}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT p.doc_id AS a, q.doc_id AS b FROM e p JOIN e q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
{_components("doc_id")}
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept FROM s LEFT JOIN found USING (doc_id)"""

SUBSTRINGS = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS x FROM w WHERE len(w) >= 13),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY x) < doc_id AS gone FROM g),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS k FROM f WHERE gone),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM w),
r AS (SELECT doc_id, count(*) FILTER (c.k IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY t.k) FILTER (c.k IS NULL) AS kept FROM t LEFT JOIN c USING (doc_id, k) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id)"""

_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAMINATION = f"""WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ITEM_WORD}') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ITEM_WORD}') AS w FROM benchmark),
x AS (SELECT DISTINCT item, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS x FROM b WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM x),
g AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS x FROM w, n WHERE len(w) >= n),
h AS (SELECT doc_id, i, n, item FROM g JOIN x USING (n, x)),
k AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, i + unnest(range(0, n)) AS k FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> {0}) & 31)::INT, 1)"
WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS lead FROM p),
c AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda i: list_transform([('0x' || substr(s, (1 + 5 * i)::INT, 5))::BIGINT], lambda v: {" || ".join(_DIGIT.format(b) for b in (15, 10, 5, 0))})[1]), '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN lead = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN lead <> page_id THEN lead END AS refers_to FROM c"""


def _rule(k: int, rule: secrets.Rule) -> str:
    """Spans of one rule: texts between matches, and the matches, give the places."""
    pattern = rule.pattern.replace("'", "''")
    value = f"regexp_extract(m[i], '{pattern}', {rule.group})"
    start = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    return f"""SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, ({start})::BIGINT AS a, ({start})::BIGINT + length(m[i]) AS b
FROM (SELECT doc_id, g, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m FROM d)) WHERE length({value}) >= {rule.least}"""


SECRETS = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ("
    + " UNION ALL ".join(_rule(k, r) for k, r in enumerate(secrets.RULES))
    + """), a AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b) FILTER (k < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b) AS spans FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""
)

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEXICAL = f"""WITH d AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}') AS w FROM documents),
l AS (SELECT doc, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0), c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM l),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}') AS w FROM benchmark),
q AS (SELECT item, term, count(*) AS times FROM (SELECT item, unnest(w) AS term FROM i) GROUP BY 1, 2),
p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
f AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY 1),
s AS (SELECT item, doc, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score FROM q JOIN p USING (term) JOIN f USING (term) JOIN l USING (doc), c GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST, doc) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r JOIN i USING (item) WHERE rank <= 20"""

#: Levels that the SQL of the manifest has: 16^6 rows a source, and as many sources.
_DEPTH = 6
_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_FIELD.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _tree(name: str, group: str) -> str:
    """Tables ``name``_1 up: nodes with the run that they are in, hashed to the next table until one node is left of a group."""
    out = []
    for k in range(_DEPTH):
        out.append(f"{name}_r{k} AS (SELECT {group}, p // 16 AS p, max(n) AS n, string_agg(h, '' ORDER BY p) AS run FROM {name}_{k} GROUP BY {group}, p // 16)")
        out.append(f"{name}_{k + 1} AS (SELECT {group}, p, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN run ELSE sha256(run) END AS h FROM {name}_r{k})")
    return ",\n".join(out)


def _path(name: str, group: str, key: str, table: str, p: str, fold: str) -> str:
    """Rows of ``table`` with the siblings of each level added to ``proof``, and ``fold`` folded over them."""
    out = []
    for k in range(_DEPTH):
        left, right = f"substr(r.run, 1, 64 * (t.{p} % 16))", f"substr(r.run, 64 * (t.{p} % 16) + 65)"
        out.append(
            f"{name}{k} AS (SELECT t.* REPLACE (t.{p} // 16 AS {p}, CASE WHEN r.n = 1 THEN t.{fold} ELSE sha256({left} || t.{fold} || {right}) END AS {fold}, "
            f"CASE WHEN r.n = 1 THEN t.proof ELSE t.proof || {left} || {right} END AS proof) FROM {table} t JOIN {key}_r{k} r ON r.{group} IS NOT DISTINCT FROM t.{group} AND r.p = t.{p} // 16)"
        )
        table = f"{name}{k}"
    return ",\n".join(out)


_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
MERKLE = f"""WITH a_0 AS (SELECT source, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY source) AS n, leaf AS h, doc_id, claimed
  FROM (SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_leaf(_LOWER.format("text"))} ELSE {_leaf("text")} END AS claimed FROM documents) WINDOW w AS (PARTITION BY source ORDER BY doc_id, leaf)),
{_tree("a", "source")},
b_0 AS (SELECT 0 AS one, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, count(*) OVER () AS n, h FROM a_{_DEPTH}),
{_tree("b", "one")},
t AS (SELECT a.doc_id, a.source, a.p AS p, b.p AS q, 0 AS one, a.h AS leaf, b.h AS subroot, a.claimed AS fold, '' AS proof FROM a_0 a JOIN b_0 b ON a.source IS NOT DISTINCT FROM b.source),
{_path("t", "source", "a", "t", "p", "fold")},
{_path("u", "one", "b", f"t{_DEPTH - 1}", "q", "fold")}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM u{_DEPTH - 1}, b_{_DEPTH}"""

ORACLE_SQL = {
    "op5_embedding_dedup": EMBEDDINGS,
    "op6_minhash_dedup": NEAR_DUPLICATES,
    "op7_substring_dedup": SUBSTRINGS,
    "op8_decontamination": CONTAMINATION,
    "op9_warc": WARC,
    "op10_secret_scan": SECRETS,
    "op12_lexical_search": LEXICAL,
    "op13_merkle_manifest": MERKLE,
}
