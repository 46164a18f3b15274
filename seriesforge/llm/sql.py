"""SQL twins (DuckDB) of the operators that SQL can state over whole tables in bounded memory.

Repeated substrings could be stated too, but a row for every 100-byte window takes
more than 10 GB at 2.5 MB of text; a brute-force test stands in for it.
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Components by reachability; ``links(a, b)`` both ways and ``nodes(id)`` come before it.
_REACH = """reach(id, c) AS (SELECT id, id FROM nodes UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.id),
comp AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)"""

OP4 = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
ok AS (SELECT id, x FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
nodes AS (SELECT id FROM v),
links AS (SELECT a.id AS a, b.id AS b FROM ok a JOIN ok b ON a.id <> b.id WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
n AS (SELECT a AS id, count(*) AS n_links FROM links GROUP BY a),
{_REACH}
SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, id = component_id AS kept FROM comp LEFT JOIN n USING (id)"""

OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
m AS (SELECT doc_id, len(sh) AS n FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN m x ON x.doc_id = a JOIN m y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
nodes AS (SELECT doc_id AS id FROM m),
links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
{_REACH}
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM m JOIN comp ON comp.id = m.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op4_pq": OP4, "op10_minhash": OP10}
