"""DuckDB SQL for the queries of this subpackage whose result SQL can express."""

NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, unnest(g) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT n.doc_id, n.n AS n_shingles, min(other) AS component_id, n.doc_id = min(other) AS kept
FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 800)) AS k
      FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS s FROM d WHERE n >= 400)),
t AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
p AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM w WHERE k IN (SELECT k FROM t)),
i AS (SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before + 400 THEN 1 ELSE 0 END)
             OVER (PARTITION BY doc_id ORDER BY s) AS span FROM p),
r AS (SELECT doc_id, span, min(s) AS b, max(s) + 400 AS e FROM i GROUP BY doc_id, span),
g AS (SELECT doc_id, b, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS gap FROM r),
a AS (SELECT g.doc_id, count(*) AS n_spans, sum(e - b) AS n_removed, max(e) AS last,
             string_agg(substr(h, 2 * gap + 1, 2 * (b - gap)), '' ORDER BY b) AS head FROM g JOIN d ON d.doc_id = g.doc_id GROUP BY 1)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""

PRODUCTS = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS z FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.z, c.z) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM o WHERE rank <= 5"""

# documents of similarity 0.85 or more on sets of four words
JACCARD = NEAR_DUPLICATES.replace("len(w) < 5", "len(w) < 4").replace("len(w) - 3), lambda i: array_to_string(w[i:i + 4]",
                                                                    "len(w) - 2), lambda i: array_to_string(w[i:i + 3]")
JACCARD = JACCARD.replace("100 * k >= 75", "100 * k >= 85").replace(", n.doc_id = min(other) AS kept", "")

_LEVELS = 8  # eight levels of eight: more leaves than any table that SQL is run on here


def _merkle() -> str:
    """Levels of all trees side by side: ``t`` numbers the tree of a node (its group), ``n`` the nodes of its level."""
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(concat(" + ", ".join(map(value, ("doc_id", "source", "lang", "n_chars", text))) + "))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # CRC-32 of the decimal id: a byte is xor-ed in, then eight steps of one bit (-1)
    crc = ("xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), "
           "lambda i: [ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
           "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), "
           "4294967295::BIGINT)")
    q = [f"""d AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} END AS claim FROM documents),
s AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
      count(*) OVER (PARTITION BY lang) AS n FROM d),
a0 AS (SELECT t, i, n, leaf AS h FROM s)"""]
    up = """{b} AS (SELECT t, i // 8 AS i, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h
      FROM {a} GROUP BY t, i // 8, n)"""
    q += [up.format(a=f"a{k}", b=f"a{k + 1}") for k in range(_LEVELS)]
    q.append(f"b0 AS (SELECT 0 AS t, t AS i, (SELECT count(*) FROM a{_LEVELS}) AS n, h FROM a{_LEVELS})")
    q += [up.format(a=f"b{k}", b=f"b{k + 1}") for k in range(_LEVELS)]
    # the path of every leaf, one level after the other: p the proof so far, f the folded digest
    q.append("c0 AS (SELECT doc_id, t, i, leaf, coalesce(claim, leaf) AS f, '' AS p FROM s)")
    step = """{b} AS (SELECT c.doc_id, {keep}, c.i // 8 AS i, c.leaf, CASE WHEN max(x.n) > 1 THEN sha256(
        coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (WHERE x.i < c.i), '') || c.f || coalesce(string_agg(x.h, '' ORDER BY x.i)
        FILTER (WHERE x.i > c.i), '')) ELSE c.f END AS f,
      c.p || coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (WHERE x.i <> c.i), '') AS p
      FROM {a} c JOIN {x} x ON x.t = {on} AND x.i // 8 = c.i // 8 GROUP BY c.doc_id, c.t, c.i, c.leaf, c.f, c.p{more})"""
    for k in range(_LEVELS):
        q.append(step.format(a=f"c{k}", b=f"c{k + 1}", x=f"a{k}", on="c.t", keep="c.t", more=""))
    q.append(f"e0 AS (SELECT doc_id, t, t AS i, leaf, f, p FROM c{_LEVELS})")
    for k in range(_LEVELS):
        q.append(step.format(a=f"e{k}", b=f"e{k + 1}", x=f"b{k}", on="0", keep="c.t", more=""))
    return "WITH " + ",\n".join(q) + f"""
SELECT e.doc_id, e.leaf, g.h AS subroot, r.h AS root, sha256(e.p) AS proof_sha256, e.f AS folded_root, e.f = r.h AS verified
FROM e{_LEVELS} e JOIN a{_LEVELS} g ON g.t = e.t CROSS JOIN b{_LEVELS} r"""


ORACLE = {
    "op1_hyperminhash_dedup": NEAR_DUPLICATES,
    "op5_suffix_dedup": REPEATS,
    "op10_cover_tree_topk": PRODUCTS,
    "op12_veb_merkle_manifest": _merkle(),
    "op13_pigeonhole_jaccard": JACCARD,
}
