"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

USABLE = "len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"

TOP_K = f"""
WITH usable AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND {USABLE}
),
v AS (SELECT vec_id, list_transform(e, lambda c: floor(256 * c)) AS x FROM usable),
q AS (
    SELECT vec_id, list_transform(min(e), lambda c: floor(256 * c)) AS x FROM usable
    WHERE vec_id % 50 = 0 GROUP BY vec_id
),
scored AS (
    SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
    FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x)
),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank"
    FROM scored
)
SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 5
"""

NEAR_VECTORS = f"""
WITH RECURSIVE usable AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND {USABLE}
      AND len(list_filter(embedding, lambda c: c <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
    WHERE list_cosine_similarity(a.x, b.x) >= 0.98
),
reach(vec_id, other) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION
    SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a
),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counted AS (SELECT a AS vec_id, count(DISTINCT b) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN counted USING (vec_id)
"""

_HOST = "translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract({0}, '(?s)^.*?://[^/?#]*[^?#]*\\?([^#]*)', 1)"

#: Links with a relative target or with character references are beyond it; the tables hold none.
URL_FILTERS = f"""
WITH RECURSIVE rules(host, path, verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
           ('org', '/fr/', 'allow')
),
tags AS (
    SELECT url,
           unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?(-->|\\z)', '', 'g'), '(?is)<link\\s[^>]*>')) AS tag
    FROM pages WHERE html IS NOT NULL
),
links AS (
    SELECT url AS a, regexp_extract(tag, '(?is)\\shref\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS b
    FROM tags
    WHERE list_contains(string_split(lower(regexp_extract(tag, '(?is)\\srel\\s*=\\s*["'']?([^"''>]*)', 1)), ' '), 'canonical')
),
written AS (
    SELECT url AS u FROM pages UNION SELECT a FROM links UNION SELECT b FROM links
),
spelled AS (
    SELECT u, 'http://' || regexp_replace({_HOST.format("u")}, '^((www|m)\\.)+', '')
              || regexp_replace({_PATH.format("u")}, '/+$', '') || CASE WHEN own = '' THEN '' ELSE '?' || own END AS plain
    FROM (
        SELECT u, coalesce(array_to_string(list_filter(string_split({_QUERY.format("u")}, '&'),
            lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')), '&'), '') AS own
        FROM written WHERE u IS NOT NULL AND {_HOST.format("u")} <> ''
    )
),
ends AS (
    SELECT u AS a, plain AS b FROM spelled
    UNION SELECT links.a, links.b FROM links JOIN spelled s ON s.u = links.a JOIN spelled t ON t.u = links.b
),
edges AS (SELECT a, b FROM ends UNION SELECT b, a FROM ends),
reach(u, other) AS (
    SELECT u, u FROM spelled
    UNION
    SELECT reach.u, edges.b FROM reach JOIN edges ON reach.other = edges.a
),
nodes AS (SELECT u FROM spelled UNION SELECT plain FROM spelled),
ruled AS (
    SELECT u, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS "rule",
           arg_max(verdict, length(rules.host || rules.path)) AS verdict
    FROM nodes JOIN rules
      ON ({_HOST.format("u")} = rules.host OR ends_with({_HOST.format("u")}, '.' || rules.host))
     AND starts_with({_PATH.format("u")}, rules.path)
    GROUP BY u
),
handed AS (
    SELECT reach.u, bool_or(verdict = 'allow') AS allowed, bool_or(verdict = 'block') AS blocked
    FROM reach JOIN ruled ON reach.other = ruled.u GROUP BY reach.u
)
SELECT page_id, coalesce({_HOST.format("url")}, '') AS host, coalesce({_PATH.format("url")}, '') AS path, "rule",
       coalesce(verdict, CASE WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END) AS verdict
FROM pages LEFT JOIN ruled ON ruled.u = url LEFT JOIN handed ON handed.u = url
"""

ORACLES = {"op4_url_filters": URL_FILTERS, "op8_exact_top_k": TOP_K, "op9_near_vectors": NEAR_VECTORS}
