"""The same queries as DuckDB SQL over the driver's tables."""

from __future__ import annotations

_LOG = """
    log AS (SELECT event_id AS id, ts AS "timestamp", user_id,
                   CASE event_type WHEN 'error' THEN 'malicioso' WHEN 'signup' THEN 'saludo' ELSE 'academica' END AS intent,
                   event_type <> 'error' AS is_safe,
                   CASE WHEN event_type NOT IN ('error', 'signup') THEN k END AS tokens_used,
                   CAST(CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'click' AND k % 2 = 0 THEN 0 END AS INTEGER) AS feedback,
                   value AS rerank_score,
                   CASE WHEN event_type NOT IN ('error', 'signup') THEN 'model' ELSE 'router' END AS model_name
            FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))
"""

_RESULTS = """
    res AS (SELECT doc_id AS id, lang AS category, CASE WHEN doc_id % 17 <> 0 THEN text END AS answer,
                   CASE WHEN doc_id % 17 = 0 THEN 'HTTP 500' END AS error, n_chars < 200 AS no_context,
                   round((n_chars % 1000) / 1000.0, 3) AS overlap FROM documents)
"""


def _judged(system: str) -> str:
    score = "quality * 0.5 + part * 0.5" if system == "graph" else "(1 - toxic) * 0.4 * part"
    return f"""
    {system} AS (SELECT doc_id AS id, lang AS category, round({score}, 4) AS correctness,
                        CASE WHEN doc_id % 7 <> 0 THEN round(part, 4) END AS faithfulness
                 FROM (SELECT l.doc_id, lang, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic, CAST(n_chars % 100 AS DOUBLE) / 100 AS part
                       FROM labels l JOIN documents USING (doc_id)))
"""


def _stats(system: str) -> str:
    return f"""
    {system}_stats AS (SELECT CASE WHEN grouping(category) = 1 THEN '__global__' ELSE category END AS category, count(*) AS n,
                              count(faithfulness) AS n_scored, round(avg(faithfulness), 4) AS avg_faithfulness,
                              round(avg(correctness), 4) AS avg_correctness
                       FROM {system} GROUP BY GROUPING SETS ((category), ()))
"""


def _search(distance: str) -> str:
    return f"""
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
         p AS (SELECT q.vec_id AS question_id, v.vec_id, {distance} AS distance FROM v, v q WHERE q.vec_id % 100 = 0),
         r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, vec_id) AS rank FROM p)
    SELECT question_id, vec_id, round(distance, 6) + 0.0 AS distance, rank FROM r WHERE rank <= 12
"""


_COSINE = "1 - list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e)))"

_CANDIDATES = f"""
    v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    p AS (SELECT CAST(floor(q.vec_id / 100) AS BIGINT) AS question_id, q.vec_id % 100 AS query_idx, v.vec_id, {_COSINE} AS distance
          FROM v, v q WHERE q.vec_id % 100 < 5),
    h AS (SELECT *, row_number() OVER (PARTITION BY question_id, query_idx ORDER BY distance, vec_id) AS rank FROM p),
    f AS (SELECT *, row_number() OVER (PARTITION BY question_id, vec_id ORDER BY query_idx, rank) AS seen FROM h WHERE rank <= 12 AND distance <= 0.75),
    c AS (SELECT question_id, vec_id, distance, row_number() OVER (PARTITION BY question_id ORDER BY query_idx, rank, vec_id) AS position
          FROM f WHERE seen = 1)
"""

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
_HEADING = r"regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')"
_SHORT = r"""coalesce(CASE WHEN length(s) > 120 THEN substr(s, 1, 120) || '…' ELSE s END, '—')"""
#: The same noise patterns as the engine's, written for this SQL.
_NOISE = (
    r"^\s*[-–—]?\s*\d{1,4}\s*[-–—]?\s*$",
    r"^\s*[Pp][áa]gina\s+\d+\s*(de\s+\d+)?\s*$",
    r"^\s*[Pp]age\s+\d+\s*(of\s+\d+)?\s*$",
    r"^\s*https?://\S+\s*$",
    r"^\s*www\.\S+\s*$",
    r"^\s*[-_=·•]{4,}\s*$",
)


#: The same lines of an institution as the query's.
_OWN_NOISE = (r"(?i)^\s*Acme Institute\s*$", r"(?i)^\s*12 main street.*$", r"(?i)^\s*acme,?\s+\d{1,2} of \w+\s*$")


def _cleaned(text: str, more: tuple[str, ...] = ()) -> str:
    for pattern in (*_NOISE, *more):
        text = f"regexp_replace({text}, '(?m){pattern}', '', 'g')"
    return rf"regexp_replace({text}, '\n{{3,}}', chr(10) || chr(10), 'g')"


def _history(n: int, roles: str) -> str:
    return f"""
    SELECT conv_id, turn, CASE WHEN role IN ({roles}) THEN 'user' ELSE 'assistant' END AS speaker, text
    FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {n}
"""


_PAGE = 'SELECT id, "timestamp", user_id, intent, is_safe, tokens_used, feedback, rerank_score, model_name FROM log'

_LISTED = """
        WITH r AS (SELECT p_name || ' ' || (p_partkey % 97) AS title, p_size AS year, p_partkey % 5 AS d,
                          CASE p_partkey % 5 WHEN 0 THEN 'Vigente' WHEN 1 THEN 'EnImplantacion' WHEN 2 THEN 'EnExtincion' WHEN 3 THEN 'Extinto' ELSE 'Otro' END AS state FROM part),
             b AS (SELECT title, min(d) AS d FROM r GROUP BY title),
             listed AS (SELECT title, any_value(state) AS state, max(year) AS year, CASE WHEN any_value(d) < 3 THEN 'active' ELSE 'extinct' END AS bucket,
                               CASE WHEN any_value(d) < 2 THEN '' WHEN any_value(d) = 2 THEN '  [sin nueva admisión]' ELSE '  [EXTINTO]' END AS suffix, any_value(d) AS d
                        FROM r SEMI JOIN b USING (title, d) GROUP BY title)"""

#: Orders' lines as plans, with their states and regulations.
_CATALOGUE = """
             p AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS line FROM lineitem),
             s AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS line, l_linestatus AS estado FROM lineitem WHERE l_linestatus IN (SELECT o_orderstatus FROM orders)),
             f AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS line, l_returnflag FROM lineitem WHERE l_returnflag <> 'N')"""

#: Character references that the pages have.
_DECODED = "regexp_replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;?', '&', 'g')"

#: What stands before the fragments in a prompt, as the engine has it.
_FRAGMENTS = (
    "── FRAGMENTOS DE DOCUMENTOS (contexto de apoyo) ──────────────\n"
    "Usa estos fragmentos para complementar la respuesta, pero en caso\n"
    "de contradicción, los DATOS DEL GRAFO tienen prioridad absoluta.\n"
    "───────────────────────────────────────────────────────────────"
)

ORACLES: dict[str, str] = {
    "knn_cosine": _search(_COSINE),
    "knn_l2sq": _search("pow(list_distance(v.e, q.e), 2)"),
    "knn_ip": _search("1 - list_dot_product(v.e, q.e)"),
    "knn_inverted_file": f"""
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
             c AS (SELECT v.vec_id, q.vec_id AS cell, row_number() OVER (PARTITION BY v.vec_id ORDER BY round({_COSINE}, 12), q.vec_id) AS place FROM v, v q WHERE q.vec_id % 50 = 0),
             p AS (SELECT q.vec_id AS question_id, v.vec_id, {_COSINE} AS distance FROM v, v q WHERE q.vec_id % 100 = 0
                   AND EXISTS (SELECT 1 FROM c a JOIN c b USING (cell) WHERE a.vec_id = q.vec_id AND a.place <= 6 AND b.vec_id = v.vec_id AND b.place = 1)),
             r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, vec_id) AS rank FROM p)
        SELECT question_id, vec_id, round(distance, 6) + 0.0 AS distance, rank FROM r WHERE rank <= 12
    """,
    "retrieve_multiquery": f"WITH {_CANDIDATES} SELECT question_id, vec_id, round(distance, 6) + 0.0 AS distance, position FROM c",
    "retrieve_topk_cut": f"""
        WITH {_CANDIDATES},
             s AS (SELECT *, question_id % 2 = 1 AS failed, round(3.0 - distance * 8, 6) AS score FROM c),
             r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN failed THEN distance ELSE -score END, position) AS rank FROM s)
        SELECT question_id, vec_id, rank, CASE WHEN failed THEN 0.0 ELSE score END AS rerank_score FROM r WHERE rank <= 5 AND (failed OR score >= -2.0)
    """,
    "chunk_ids": "SELECT doc_id, sha256(text) AS id FROM documents",
    "upsert_batches": """
        WITH f AS (SELECT sha256(text) AS id, source, doc_id, CAST(floor(doc_id / 200) AS BIGINT) AS batch FROM documents
                   QUALIFY row_number() OVER (PARTITION BY sha256(text), floor(doc_id / 200) ORDER BY doc_id) = 1)
        SELECT id, source, doc_id, batch FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch DESC) = 1
    """,
    "anti_incremental": """
        SELECT doc_id FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 0 AND (l.quality = 1 OR d.text = ''))
    """,
    "log_stats": f"""
        WITH {_LOG} SELECT count(*) AS total_interactions, CAST(coalesce(sum(tokens_used), 0) AS BIGINT) AS total_tokens,
               round(avg(feedback), 6) AS avg_feedback, round(count(*) FILTER (is_safe) / count(*) * 100, 1) AS safe_pct FROM log
    """,
    "log_intents": f"WITH {_LOG} SELECT intent, count(*) AS n FROM log GROUP BY intent",
    "log_page_p1": f'WITH {_LOG} {_PAGE} ORDER BY "timestamp" DESC, id DESC LIMIT 10',
    "log_page_filtered": f"""WITH {_LOG} {_PAGE} WHERE intent = 'academica' AND feedback = 1 AND is_safe ORDER BY "timestamp" DESC, id DESC LIMIT 10 OFFSET 10""",
    "log_unrated": f'WITH {_LOG} {_PAGE} WHERE feedback IS NULL ORDER BY "timestamp" DESC, id DESC LIMIT 10 OFFSET 20',
    "log_page_count": f"WITH {_LOG} SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 10) AS BIGINT)) AS total_pages FROM log WHERE NOT is_safe",
    "feedback_update": f"""
        WITH {_LOG},
             u AS (SELECT o_custkey AS id, CAST(o_orderkey % 3 AS INTEGER) AS score, o_orderkey AS seq FROM orders),
             last AS (SELECT id, arg_max(score, seq) AS score FROM u WHERE score IN (0, 1) GROUP BY id)
        SELECT coalesce(score, feedback) AS feedback, count(*) AS n, 'log' AS outcome FROM log LEFT JOIN last USING (id) GROUP BY 1
        UNION ALL
        SELECT score, count(*), 'rejected' FROM u WHERE score NOT IN (0, 1) OR id NOT IN (SELECT id FROM log) GROUP BY 1
    """,
    "config_overlay": """
        WITH w AS (SELECT c_mktsegment AS key, arg_max(c_name, c_custkey) AS value FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1),
             d AS (SELECT DISTINCT c_mktsegment AS key FROM customer UNION ALL SELECT 'LAST')
        SELECT key, coalesce(nullif(value, ''), 'default') AS value FROM d LEFT JOIN w USING (key)
    """,
    "log_rows_exploded": f"""
        WITH q AS (SELECT conv_id * 1000 + turn AS id, text AS question FROM conversations WHERE role = 'user'),
             a AS (SELECT conv_id * 1000 + turn - 1 AS id, text AS answer FROM conversations WHERE role = 'assistant'),
             r AS (SELECT id, 0 AS part, 'question' AS kind, question AS t FROM q UNION ALL
                   SELECT id, 1, 'answer', answer FROM q LEFT JOIN a USING (id)),
             p AS (SELECT id, part, kind, replace(regexp_replace(regexp_replace(t, '\\*\\*(.*?)\\*\\*', '\\1', 'g'), '\\*(.*?)\\*', '\\1', 'g'), '`', '') AS s FROM r)
        SELECT id, part, kind, {_SHORT} AS shown FROM p
    """,
    "rate_limit": "SELECT user_id, date_trunc('day', ts) AS window_start, count(*) AS n, count(*) > 5 AS limited FROM events GROUP BY 1, 2",
    "graph_two_hop": """
        SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    """,
    "graph_optional": """
        WITH s AS (SELECT s_nationkey AS k, string_agg(DISTINCT s_name, ', ' ORDER BY s_name) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1),
             c AS (SELECT c_nationkey AS k, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS segments FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
        SELECT n_name, coalesce(suppliers, '') AS suppliers, coalesce(segments, '') AS segments
        FROM nation LEFT JOIN s ON s.k = n_nationkey LEFT JOIN c ON c.k = n_nationkey
    """,
    "graph_keyword": """
        SELECT p_partkey, p_name, p_type FROM part
        WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') OR contains(lower(p_name), 'small') OR contains(lower(p_type), 'small')
    """,
    "graph_listing": f"""
        {_LISTED} SELECT title, state, year, bucket, suffix FROM listed
    """,
    "graph_listing_text": f"""
        {_LISTED}, l AS (SELECT bucket, d, title, '  • ' || title || ' (Grado)' || CASE WHEN year % 2 = 0 AND year <> 0 THEN ' — ' || year || ' ECTS, 4 años' ELSE '' END || suffix AS line FROM listed)
        SELECT 'TITULACIONES EN LA ETSII (UMA):' || chr(10) || string_agg(line, chr(10) ORDER BY d, title) FILTER (bucket = 'active') || chr(10) || chr(10)
               || 'TITULACIONES YA EXTINTAS (planes antiguos):' || chr(10) || string_agg(line, chr(10) ORDER BY d, title) FILTER (bucket = 'extinct') AS listing FROM l
    """,
    "graph_degree_lookup": """
        WITH o AS (SELECT s_nationkey AS k, string_agg(DISTINCT s_name, ', ' ORDER BY s_name) AS m FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
        SELECT 'c' || c_custkey AS plan_code,
               'TITULACIÓN: ' || n_name || ' (Grado)' || chr(10) || '  PLAN: ' || c_name || chr(10) || '  ESTADO: ' || c_mktsegment || ' — ' || lower(c_mktsegment)
               || CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 240 <> 0 THEN chr(10) || '  CRÉDITOS TOTALES: ' || (c_custkey % 240) || ' ECTS en ' || (c_custkey % 5) || ' año(s)' ELSE '' END
               || CASE WHEN c_custkey % 3 = 0 AND c_custkey % 10 <> 9 THEN chr(10) || replace('  DISTRIBUCIÓN: # básica + # obligatorios + # optativos + # prácticas externas + # TFG', '#', CAST(c_custkey % 10 AS VARCHAR)) ELSE '' END
               || coalesce(chr(10) || '  MENCIONES ACTIVAS EN UMA: ' || m, '')
               || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || '  IMPARTIDO CONJUNTAMENTE CON: ' || r_name ELSE '' END
               || CASE WHEN n_nationkey % 5 = 0 THEN chr(10) || '  MÁS INFO: http://x/y' ELSE '' END AS text
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN o ON o.k = n_nationkey
    """,
    "graph_search": """
        WITH a AS (SELECT c_custkey AS question_id, 'about ' || c_mktsegment || ' near NATION_' || c_nationkey AS about FROM customer),
             q AS (SELECT question_id, lower(CASE WHEN question_id % 8 = 0 THEN 'more of it Usuario: ' || about WHEN question_id % 4 = 0 THEN 'more of it' ELSE about END) AS q FROM a),
             w AS (SELECT 'HEAD' || chr(10) || chr(10) || 'TITULACIONES EN LA ETSII (UMA):' || chr(10) || string_agg('  • ' || n_name || ' (Grado) — 240 ECTS, 4 años', chr(10) ORDER BY n_name) AS listing FROM nation),
             e AS (SELECT question_id, contains(q, 'household') AS whole, list_filter(['nation_1', 'nation_2'], lambda x: contains(q, x)) AS dw, list_filter(['building'], lambda x: contains(q, x)) AS rw FROM q),
             d AS (SELECT question_id, string_agg('D ' || n_name, chr(10) || chr(10) ORDER BY n_nationkey) AS t FROM e, nation WHERE len(list_filter(dw, lambda x: contains(lower(n_name), x))) > 0 GROUP BY 1),
             r AS (SELECT question_id, string_agg('R ' || r_name, chr(10) || chr(10) ORDER BY r_regionkey) AS t FROM e, region
                   WHERE len(list_filter(list_concat(rw, dw), lambda x: contains(lower(r_name) || ' building ' || CASE WHEN r_regionkey % 2 = 0 THEN 'nation_1' ELSE 'nation_2' END, x))) > 0 GROUP BY 1),
             b AS (SELECT question_id, concat_ws(chr(10) || chr(10), '═══ TITULACIONES ═══' || chr(10) || d.t, '═══ NORMATIVA ═══' || chr(10) || r.t) AS block FROM e LEFT JOIN d USING (question_id) LEFT JOIN r USING (question_id))
        SELECT question_id, CASE WHEN whole THEN listing WHEN block <> '' THEN 'HEAD' || chr(10) || chr(10) || block END AS graph_context FROM e JOIN b USING (question_id), w
    """,
    "graph_containment": """
        WITH k AS (SELECT DISTINCT word AS keyword FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z]+')) AS word FROM benchmark) WHERE length(word) >= 7)
        SELECT conv_id, turn, keyword FROM conversations JOIN k ON contains(lower(text), lower(keyword))
    """,
    "graph_catalogue": f"""
        WITH {_CATALOGUE}
        SELECT 'node' AS kind, 'ETSI' AS name, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'node', 'Titulacion', count(*) FROM orders
        UNION ALL SELECT 'node', 'PlanEstudio', count(*) FROM p UNION ALL SELECT 'node', 'DistribucionCreditos', count(*) FROM p WHERE line % 3 = 0
        UNION ALL SELECT 'node', 'Mencion', count(*) FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 'node', 'Estado', count(DISTINCT o_orderstatus) FROM orders
        UNION ALL SELECT 'node', 'Universidad', count(*) FROM region UNION ALL SELECT 'node', 'Normativa', count(DISTINCT l_returnflag) FROM lineitem WHERE l_returnflag <> 'N'
        UNION ALL SELECT 'edge', 'IMPARTE', count(*) FROM orders UNION ALL SELECT 'edge', 'TIENE_PLAN', count(*) FROM p UNION ALL SELECT 'edge', 'TIENE_ESTADO', count(*) FROM s
        UNION ALL SELECT 'edge', 'TIENE_DISTRIBUCION', count(*) FROM p WHERE line % 3 = 0 UNION ALL SELECT 'edge', 'REGULADO_POR', count(*) FROM f
        UNION ALL SELECT 'edge', 'APLICA_A', count(*) FROM f UNION ALL SELECT 'edge', 'OFERTA_MENCION', count(*) FROM orders WHERE o_orderkey % 5 = 0
        UNION ALL SELECT 'edge', 'IMPARTE_CON', count(*) FROM orders WHERE o_custkey % 7 < 5
    """,
    "graph_states": f"WITH {_CATALOGUE} SELECT o_orderpriority AS titulo, k || '-' || line AS plan, estado FROM s JOIN orders ON o_orderkey = k",
    "graph_counts": """
        SELECT 'node' AS kind, 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'node', 'nation', count(*) FROM nation
        UNION ALL SELECT 'node', 'customer', count(*) FROM customer UNION ALL SELECT 'node', 'supplier', count(*) FROM supplier
        UNION ALL SELECT 'node', 'part', count(*) FROM part UNION ALL SELECT 'node', 'orders', count(*) FROM orders
        UNION ALL SELECT 'edge', 'PART_OF', count(*) FROM nation UNION ALL SELECT 'edge', 'LIVES_IN', count(*) FROM customer
        UNION ALL SELECT 'edge', 'SELLS_IN', count(*) FROM supplier UNION ALL SELECT 'edge', 'ORDERED', count(*) FROM orders
    """,
    "endpoint_edges": """
        SELECT DISTINCT o_custkey AS src, 'ORDERED' AS rel, o_orderkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE c_acctbal > 0 AND o_totalprice > 1000
    """,
    "history_last6": _history(6, "'user', 'human'"),
    "history_last4": _history(4, "'user'"),
    "intent_router": """
        WITH t AS (SELECT conv_id, turn, turn % 7 = 6 OR trim(text) = '' AS blank, turn % 5 = 4 AND turn <> 0 AS bad, turn = 0 AS hello FROM conversations),
             i AS (SELECT *, CASE WHEN blank THEN 'saludo' WHEN bad THEN 'malicioso' WHEN hello THEN 'saludo' ELSE 'academica' END AS intent FROM t)
        SELECT conv_id, turn, intent, blank OR NOT bad AS is_safe, intent = 'academica' AS proceed, bad AND NOT blank AS blocked FROM i
    """,
    "entity_hints": """
        SELECT conv_id, turn, concat_ws(',', CASE WHEN contains(lower(text), 'with') THEN 'with' END, CASE WHEN contains(lower(text), 'une') THEN 'une' END,
                         CASE WHEN contains(lower(text), 'nicht') THEN 'nicht' END) AS degrees,
               concat_ws(',', CASE WHEN contains(lower(text), 'that') THEN 'that' END, CASE WHEN contains(lower(text), 'para') THEN 'para' END) AS rules,
               contains(lower(text), 'with') OR contains(lower(text), 'une') OR contains(lower(text), 'nicht') OR contains(lower(text), 'that')
                   OR contains(lower(text), 'para') AS needs_graph
        FROM conversations
    """,
    "page_title": f"""
        SELECT page_id, coalesce(nullif({_STRIP.format(_DECODED.format(_TITLE))}, ''), nullif({_STRIP.format(_DECODED.format(_HEADING))}, ''), url) AS title FROM pages
    """,
    "page_slug": r"""
        WITH n AS (SELECT page_id, trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS p, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h FROM pages),
             s AS (SELECT page_id, trim(regexp_replace(CASE WHEN p <> '' THEN replace(p, '/', '-') ELSE h END, '[^a-zA-Z0-9._-]', '-', 'g'), '-') AS slug FROM n)
        SELECT 'web__' || CASE WHEN slug <> '' THEN slug ELSE 'index' END || '.md' AS name, max(page_id) AS page_id, count(*) AS n_pages FROM s GROUP BY 1
    """,
    "page_links": r"""
        WITH a AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, regexp_replace(url, '[?#].*$', '') AS base,
                          trim(unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1))) AS href FROM pages),
             r AS (SELECT page_id, regexp_replace(CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN root || href
                          WHEN starts_with(href, '#') OR starts_with(href, '?') THEN base ELSE regexp_replace(base, '[^/]*$', '') || href END, '[?#].*$', '') AS link
                   FROM a WHERE href <> '' AND NOT regexp_matches(href, '^(mailto|javascript|tel):'))
        SELECT DISTINCT page_id, link FROM r
        WHERE NOT regexp_matches(lower(link), '\.(jpg|jpeg|png|gif|svg|webp|mp4|mp3|avi|zip|rar|exe|css|js|xml|json)$')
    """,
    "page_links_cleaned": r"""
        WITH a AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, regexp_replace(url, '[?#].*$', '') AS base,
                          trim(unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1))) AS href FROM pages WHERE page_id % 2 = 0),
             r AS (SELECT page_id, regexp_replace(CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN root || href
                          WHEN starts_with(href, '#') OR starts_with(href, '?') THEN base ELSE regexp_replace(base, '[^/]*$', '') || href END, '[?#].*$', '') AS link
                   FROM a WHERE href <> '' AND NOT regexp_matches(href, '^(mailto|javascript|tel):'))
        SELECT DISTINCT page_id, link FROM r
        WHERE NOT regexp_matches(lower(link), '\.(jpg|jpeg|png|gif|svg|webp|mp4|mp3|avi|zip|rar|exe|css|js|xml|json)$')
    """,
    "page_markdown": rf"""
        WITH a AS (SELECT page_id, url, coalesce(nullif({_STRIP.format(_DECODED.format(_TITLE))}, ''), nullif({_STRIP.format(_DECODED.format(_HEADING))}, ''), url) AS title,
                          regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS body FROM pages),
             b AS (SELECT page_id, unnest(blocks) AS block, unnest(range(len(blocks))) AS pos
                   FROM (SELECT page_id, regexp_extract_all(body, '<(?:h1|p)(?:\s[^>]*)?>(?:[^<]|</?br?(?:\s[^>]*)?/?>)*(?:</(?:h1|p)>)?') AS blocks FROM a)),
             t AS (SELECT page_id, pos, CASE WHEN starts_with(block, '<h1') THEN '# ' ELSE '' END AS mark, regexp_matches(block, '</(h1|p)>$') AS closed,
                          array_to_string(list_filter(list_transform(string_split_regex(block, '<[^>]*>'), lambda x: {_STRIP.format(_DECODED.format("x"))}), lambda x: x <> ''), ' ') AS text FROM b),
             w AS (SELECT t.page_id, t.pos, t.mark, coalesce(string_agg(u.text, ' ' ORDER BY u.pos) FILTER (u.text <> ''), '') AS text
                   FROM t JOIN t u ON t.page_id = u.page_id AND (u.pos = t.pos OR (u.pos > t.pos AND NOT t.closed)) GROUP BY 1, 2, 3),
             m AS (SELECT page_id, string_agg(mark || text, chr(10) || chr(10) ORDER BY pos) AS md FROM w WHERE text <> '' GROUP BY page_id)
        SELECT page_id, url, title, coalesce(CASE WHEN starts_with(md, '# ') THEN md ELSE '# ' || title || chr(10) || chr(10) || md END, '') AS markdown FROM a LEFT JOIN m USING (page_id)
    """,
    "page_failures": """
        SELECT CASE WHEN contains(url, '?') THEN 'ValueError' WHEN contains(url, '#') THEN 'LookupError' END AS error_class, count(*) AS n FROM pages GROUP BY 1
    """,
    "line_runs": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line, unnest(range(len(string_split(regexp_replace(text, '\n$', ''), chr(10))))) AS pos FROM documents),
             s AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS st FROM l),
             c AS (SELECT *, CASE WHEN st = '' OR st IS DISTINCT FROM lag(st) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS new FROM s),
             g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c),
             k AS (SELECT *, st = '' OR row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) <= 2 AS keep FROM g)
        SELECT doc_id, count(*) FILTER (keep) AS n_kept, count(*) FILTER (NOT keep) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS sha256 FROM k GROUP BY doc_id
    """,
    "clean_noise": rf"""
        WITH n AS (SELECT doc_id, text || chr(10) || '- ' || (doc_id % 97) || ' -' || repeat(chr(10), 4) || 'end' || chr(10) || 'https://example.org/x' || chr(10) || '=====' || chr(10) || 'last' AS t FROM documents)
        SELECT doc_id, sha256({_STRIP.format(_cleaned("t"))} || chr(10)) AS sha256 FROM n
    """,
    "clean_own_noise": rf"""
        WITH n AS (SELECT doc_id, text || chr(10) || '  ACME institute ' || chr(10) || '12 Main Street, ' || lang || chr(10) || 'acme,  3 of May' || chr(10) || 'Acme Institute stays' || chr(10) || 'last' AS t FROM documents)
        SELECT doc_id, sha256({_STRIP.format(_cleaned("t", _OWN_NOISE))} || chr(10)) AS sha256 FROM n
    """,
    "word_lines": """
        WITH w AS (SELECT p_brand AS doc, p_size AS page, p_name AS text, p_partkey % 7 * 50.0 AS x, p_partkey % 300 * 3.0 AS top, p_partkey % 300 * 3.0 + 10 AS bottom, p_partkey % 5 + 8.0 AS size FROM part),
             o AS (SELECT *, round_even(CAST(top AS DOUBLE) / 2, 0) * 2 AS row FROM w WHERE NOT (x + 20 BETWEEN 90 AND 240 AND top + 5 BETWEEN 100 AND 500)),
             l AS (SELECT doc, page, row, string_agg(text, ' ' ORDER BY x, text) AS line, avg(size) AS size, CAST(list(bottom ORDER BY x, text)[-1] AS DOUBLE) AS bottom FROM o GROUP BY 1, 2, 3)
        SELECT doc, page, row, line, round(size, 6) AS size, round(row - lag(bottom) OVER (PARTITION BY doc, page ORDER BY row), 6) AS gap FROM l
    """,
    "chunk_stats": """
        SELECT lang, count(*) AS n, CAST(floor(sum(length(text)) / count(*)) AS BIGINT) AS avg_len, max(length(text)) AS max_len, min(length(text)) AS min_len
        FROM documents GROUP BY lang
    """,
    "font_median_heading": r"""
        WITH m AS (SELECT p_brand, CAST(list_sort(list(p_size))[len(list(p_size)) // 2 + 1] AS DOUBLE) AS median FROM part GROUP BY p_brand),
             r AS (SELECT p_partkey, median, p_size / greatest(median, 1.0) AS ratio, p_partkey % 3 = 0 AS caps FROM part JOIN m USING (p_brand))
        SELECT p_partkey, median, CASE WHEN ratio >= 1.6 OR (caps AND ratio >= 1.2) THEN '#' WHEN ratio >= 1.3 THEN '##'
               WHEN ratio >= 1.15 OR (caps AND ratio >= 1.0) THEN '###' ELSE '' END AS mark FROM r
    """,
    "context_blocks": """
        WITH f AS (SELECT source || '-' || (doc_id // 100) AS question_id, doc_id, text,
                          concat_ws(' | ', CASE WHEN doc_id % 3 = 0 THEN 'Documento: ' || lang END, CASE WHEN doc_id % 2 = 0 THEN 'Fuente: ' || source END) AS header,
                          row_number() OVER (PARTITION BY source, doc_id // 100 ORDER BY doc_id) AS rank FROM documents)
        SELECT question_id, sha256(string_agg('[' || CASE WHEN header <> '' THEN header ELSE 'Fragmento ' || rank END || ']' || chr(10) || coalesce(text, ''),
                                              chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS sha256
        FROM f GROUP BY question_id
    """,
    "source_dedup": """
        WITH f AS (SELECT doc_id // 50 AS question_id, doc_id % 50 AS rank, lang AS title,
                          coalesce(CASE WHEN doc_id % 4 <> 0 THEN nullif(source, '') END, CASE WHEN doc_id % 8 = 0 THEN nullif(lang, '') END) AS source_key FROM documents),
             g AS (SELECT question_id, source_key, arg_min(title, rank) AS title, min(rank) AS rank FROM f WHERE source_key IS NOT NULL GROUP BY 1, 2)
        SELECT question_id, source_key, title, row_number() OVER (PARTITION BY question_id ORDER BY rank, source_key) AS place FROM g
    """,
    "keyword_overlap": r"""
        WITH w AS (SELECT item_id, list_distinct(list_transform(list_filter(string_split_regex(text, '\s+'), lambda x: length(x) >= 4), lambda x: lower(x))) AS ws FROM benchmark),
             d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE doc_id % 100 = 0)
        SELECT doc_id, item_id, CASE WHEN len(ws) > 0 THEN round(len(list_filter(ws, lambda x: contains(t, x))) / len(ws), 3) ELSE 0.0 END AS overlap FROM d, w
    """,
    "error_classes": """
        SELECT error, error IS NULL OR error = 'ConnectionError' OR starts_with(error, 'HTTP') AS has_latency, count(*) AS n
        FROM (SELECT CASE event_id % 7 WHEN 1 THEN 'HTTP 404' WHEN 2 THEN 'HTTP 500' WHEN 4 THEN 'bad ' || event_type WHEN 5 THEN 'bad ' || event_type WHEN 6 THEN 'ConnectionError' END AS error FROM events) GROUP BY 1, 2
    """,
    "log_times": f"""
        WITH {_LOG}
        SELECT id, strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime("timestamp", '%f') = '000000' THEN '' ELSE '.' || strftime("timestamp", '%f') END AS iso,
               strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS shown, strftime("timestamp", '%Y%m%d_%H%M%S') AS stamp,
               round((epoch_us("timestamp") - epoch_us(date_trunc('day', "timestamp"))) / 1e6, 2) AS elapsed_s FROM log
    """,
    "log_page_object": f"""
        WITH {_LOG}, f AS (SELECT id, "timestamp", feedback FROM log WHERE intent = 'academica' AND is_safe),
             p AS (SELECT * FROM f ORDER BY "timestamp" DESC, id DESC LIMIT 7 OFFSET 14)
        SELECT (SELECT string_agg(concat_ws(':', id, feedback), ',' ORDER BY "timestamp" DESC, id DESC) FROM p) AS items, (SELECT count(*) FROM f) AS total, CAST(3 AS BIGINT) AS page, CAST(7 AS BIGINT) AS page_size,
               (SELECT greatest(1, CAST(ceil(count(*) / 7) AS BIGINT)) FROM f) AS total_pages, CAST(15 AS BIGINT) AS from_row, CAST(21 AS BIGINT) AS to_row
    """,
    "feedback_percent": f"""
        WITH {_LOG} SELECT user_id, coalesce(CAST(floor(avg(feedback) * 100 + 0.5) AS BIGINT) || '%', '—') AS shown FROM log GROUP BY user_id
    """,
    "ask_outcomes": f"""
        WITH t AS (SELECT *, CASE WHEN role IN ('user', 'human') THEN 'Usuario: ' ELSE 'Asistente: ' END || coalesce(text, '') AS line FROM conversations),
             q AS (SELECT conv_id * 1000 + turn AS question_id, conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN ' ' ELSE text END AS question, conv_id % 11 = 0 AS bad,
                          row_number() OVER (ORDER BY conv_id * 1000 + turn) + 100 AS log_id FROM t WHERE role = 'user'),
             h AS (SELECT question_id, string_agg(line, chr(10) ORDER BY t.turn) AS history FROM q JOIN t ON t.conv_id = q.conv_id AND t.turn BETWEEN q.turn - 6 AND q.turn - 1 GROUP BY 1),
             f AS (SELECT doc_id // 7 AS conv_id, doc_id % 7 AS rank, lang, CASE WHEN doc_id % 2 = 0 THEN nullif(source, '') END AS url, CASE WHEN doc_id % 3 = 0 THEN lang END AS file, (n_chars % 100) / 10.0 AS score,
                          '[' || concat_ws(' | ', 'Documento: ' || nullif(lang, ''), 'Fuente: ' || CASE WHEN doc_id % 2 = 0 THEN nullif(source, '') END) || ']' || chr(10) || coalesce(text, '') AS block FROM documents),
             c AS (SELECT conv_id, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, max(score) AS score FROM f GROUP BY 1),
             s AS (SELECT conv_id, coalesce(url, file) AS k, min(rank) AS r, arg_min(coalesce(lang, '') || '=' || coalesce(url, '-'), rank) AS shown FROM f WHERE coalesce(url, file) IS NOT NULL GROUP BY 1, 2),
             l AS (SELECT conv_id, string_agg(shown, '|' ORDER BY r) AS shown FROM s GROUP BY 1),
             a AS (SELECT q.*, CASE WHEN trim(question) = '' THEN 'saludo' WHEN bad THEN 'malicioso' ELSE 'academica' END AS intent, trim(question) = '' OR NOT bad AS is_safe,
                          context, score, shown, history, CASE WHEN q.conv_id % 10 = 0 THEN 'graph' END AS graph FROM q LEFT JOIN c USING (conv_id) LEFT JOIN l USING (conv_id) LEFT JOIN h USING (question_id)),
             m AS (SELECT *, intent = 'academica' AS go, context IS NOT NULL OR graph IS NOT NULL AS ctx,
                          '[other] ' || concat_ws(chr(10) || chr(10), 'Be brief.', history, 'Contexto relevante:' || chr(10) || chr(10) || concat_ws(chr(10) || chr(10), graph, '{_FRAGMENTS}' || chr(10) || chr(10) || context)
                                                  || chr(10) || chr(10) || 'Pregunta del usuario:' || chr(10) || question) AS prompt FROM a)
        SELECT question_id, log_id, intent, is_safe, CASE WHEN NOT go THEN 'router' WHEN NOT ctx THEN 'none' ELSE 'model' END AS model_name,
               CASE WHEN NOT go THEN 'reply to ' || turn WHEN ctx THEN sha256(prompt) ELSE 'No dispongo de suficiente contexto para responder a esa pregunta. Prueba a reformularla o consulta con la secretaría de la ETSI Informática.' END AS answer,
               CASE WHEN go AND ctx THEN true END AS has_tokens, CASE WHEN go AND ctx THEN score END AS rerank_score, CAST(NULL AS VARCHAR) AS error,
               CASE WHEN go AND ctx THEN concat_ws('|', CASE WHEN graph IS NOT NULL THEN 'Grafo de Conocimiento ETSI=-' END, shown) ELSE '' END AS sources
        FROM m
    """,
    "no_context": r"""
        SELECT doc_id, contains(lower(text), 'the of') AS no_context, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n_words FROM documents
    """,
    "eval_summary": f"""
        WITH {_RESULTS}
        SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS success, count(*) FILTER (error IS NULL AND no_context) AS no_context,
               count(*) FILTER (error IS NULL AND NOT no_context) AS answered, count(*) FILTER (error IS NOT NULL) AS errors,
               round(count(*) FILTER (error IS NULL AND NOT no_context) / count(*), 3) AS answered_rate,
               round(count(*) FILTER (error IS NULL AND no_context) / count(*), 3) AS no_context_rate,
               coalesce(round(avg(overlap) FILTER (error IS NULL AND NOT no_context), 3), 0.0) AS avg_overlap FROM res
    """,
    "eval_by_category": f"WITH {_RESULTS} SELECT category, count(overlap) AS n, round(avg(overlap), 3) AS avg_overlap FROM res GROUP BY category",
    "eval_score_stats": f"WITH {_judged('graph')}, {_stats('graph')} SELECT * FROM graph_stats",
    "ab_compare": f"""
        WITH {_judged("plain")}, {_judged("graph")}, {_stats("plain")}, {_stats("graph")},
             c AS (SELECT unnest(['en', 'fr', 'de', 'es', 'xx', '__global__']) AS category),
             r AS (SELECT category, 'faithfulness' AS metric, p.avg_faithfulness AS plain, g.avg_faithfulness AS graph
                   FROM c LEFT JOIN plain_stats p USING (category) LEFT JOIN graph_stats g USING (category)
                   UNION ALL SELECT category, 'correctness', p.avg_correctness, g.avg_correctness
                   FROM c LEFT JOIN plain_stats p USING (category) LEFT JOIN graph_stats g USING (category))
        SELECT *, CASE WHEN plain <> 0 THEN round((graph - plain) / plain * 100, 2) END AS improvement_pct FROM r
    """,
    "critical_successes": f"""
        WITH {_judged("plain")}, {_judged("graph")}
        SELECT id, plain.correctness AS plain, graph.correctness AS graph, round(graph.correctness - plain.correctness, 4) AS improvement
        FROM plain JOIN graph USING (id) WHERE plain.correctness < 0.3 AND graph.correctness > 0.8
    """,
    "top_bottom5": f"""
        WITH {_judged("graph")}
        SELECT * FROM (SELECT id, correctness, 'top' AS list FROM graph WHERE correctness IS NOT NULL ORDER BY correctness DESC, id LIMIT 5)
        UNION ALL SELECT * FROM (SELECT id, correctness, 'bottom' FROM graph WHERE correctness IS NOT NULL ORDER BY correctness, id DESC LIMIT 5)
    """,
    "judge_split": f"""
        WITH {_RESULTS} SELECT coalesce(CASE WHEN error IS NOT NULL THEN 'error' WHEN answer IS NULL THEN 'no answer' END, 'judged') AS reason, count(*) AS n FROM res GROUP BY 1
    """,
    "score_bars": f"""
        WITH {_judged("graph")} SELECT id, repeat('█', CAST(round(correctness * 20) AS INTEGER)) || repeat('░', 20 - CAST(round(correctness * 20) AS INTEGER)) AS bar FROM graph
    """,
}
