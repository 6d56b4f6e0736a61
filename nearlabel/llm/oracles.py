"""DuckDB SQL of the operators whose results SQL can express on whole tables."""

from __future__ import annotations

from nearlabel.llm import perspectives, quality_rules, rolling_median, vector_codes, voronoi_knn

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS label FROM n UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(g.label, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT doc_id, min(label) AS label FROM r GROUP BY doc_id) g USING (doc_id)
"""

CONTAMINATION = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + 9), ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM v),
c AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM w, k)),
h AS (SELECT doc_id, item_id, i, k FROM c JOIN v USING (k, s)),
p AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

#: kind, text or its lower case, pattern in the database's dialect, group, least length.
_RULES = [
    ("assign", _LOWER, r"""(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([a-z0-9+/_.=-]+)""", 2, 8),
    ("access", "coalesce(text, '')", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "coalesce(text, '')", "[0-9a-f]+", 0, 32),
    ("private_key", "coalesce(text, '')", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:[^-]|-{1,4}[^-])*-----END [A-Z ]{0,20}PRIVATE KEY-----)?", 0, 0),
    ("git_token", "coalesce(text, '')", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat_token", "coalesce(text, '')", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("web_token", "coalesce(text, '')", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
]


def _matches(order: int, kind: str, text: str, pattern: str, group: int, least: int) -> str:
    return (
        f"SELECT doc_id, '{kind}' AS kind, {order} AS o, {least} AS least, regexp_extract_all({text}, '{pattern}') AS m, "
        f"regexp_extract_all({text}, '{pattern}', {group}) AS v, string_split_regex({text}, '{pattern}') AS g FROM documents"
    )


#: A match begins after all gaps and matches before it.
SECRETS = f"""
WITH m AS ({" UNION ALL ".join(_matches(k, *r) for k, r in enumerate(_RULES))}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m),
s AS (SELECT doc_id, kind, o, length(m[i]) AS n, CAST(list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS BIGINT) AS a
    FROM i WHERE length(v[i]) >= least),
c AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) FILTER (WHERE o < 3) AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN c USING (doc_id)
"""

ORACLES = {
    "op7_secrets": SECRETS,
    "op4_perspectives": perspectives.ORACLE,
    "op6_fragment_join": NEAR_DUPLICATES,
    "op8_decontaminate": CONTAMINATION,
    "op10_voronoi_knn": voronoi_knn.ORACLE,
    "op11_quality_cascade": quality_rules.ORACLE,
    "op12_vector_codes": vector_codes.oracle(),
    "op13_rolling_median": rolling_median.ORACLE,
}
