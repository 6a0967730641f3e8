"""The queries over stores in DuckDB's SQL."""

from __future__ import annotations

from lodestar.plans.oracles import ORACLES as ORACLES_
from lodestar.plans.oracles import STRIPPED, VISIBLE, C, D, V, _dense, _url

PAGE_URL = f"CASE WHEN {_url(2)} <> '' THEN coalesce(nullif(lower({_url(1)}), ''), 'https') || '://' || lower({_url(2)}) || coalesce(nullif({_url(3)}, ''), '/') || {_url(4)} ELSE '' END"

E = """e AS (SELECT k AS id, 'x' || (k % 700) AS external_id, CASE WHEN k % 5 = 0 THEN '[object Object]' WHEN k % 7 <> 0 THEN p_name END AS text, CASE WHEN k % 3 = 0 THEN 'co' || (k % 11) END AS company_id,
  CASE WHEN k % 4 = 0 THEN p_brand END AS name, CASE WHEN k % 6 = 0 THEN p_type END AS label, CASE WHEN k % 9 = 0 THEN ' My  ' || p_brand || '!' END AS slug, CASE WHEN k % 8 <> 0 THEN 'x' || (k % 50) END AS parent,
  CASE WHEN k % 2 = 0 THEN ' Product ' WHEN k % 3 = 1 THEN 'service' END AS kind, CASE WHEN k % 10 < 7 THEN 'Active' WHEN k % 10 = 7 THEN 'inactive' END AS status, k % 10 = 0 AS featured, k % 4 = 1 AS public, k % 5 = 1 AS system,
  CASE WHEN k % 12 = 0 THEN p_name END AS description, CASE WHEN k % 3 = 1 THEN 'co' || (k % 7) END AS own_company FROM (SELECT *, p_partkey::BIGINT AS k FROM part))"""


def _slug(c: str) -> str:
    return rf"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN lower(trim({c})) IN ('', '[object object]') THEN '' ELSE lower({c}) END, '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), '')"


SHOWN = lambda c: f"CASE WHEN lower(trim(coalesce({c}, ''))) IN ('', '[object object]') THEN NULL ELSE trim({c}) END"
ROWS = f"""t AS (SELECT *, coalesce({SHOWN("coalesce(text, name, label)")}, external_id) AS shown_text FROM e),
n AS (SELECT *, coalesce({SHOWN("coalesce(name, label, shown_text)")}, shown_text) AS shown_name FROM t),
rows_ AS (SELECT id, external_id AS category_id, shown_text AS text, shown_name AS name, coalesce({SHOWN("label")}, shown_name) AS label,
  coalesce({_slug("slug")}, {_slug("text")}, {_slug("external_id")}) AS slug, company_id, description FROM n)"""
STATES = "(list_value('queued', 'processing', 'completed', 'failed'))[1 + event_id % 4]"
DOCS = """docs AS (SELECT CASE WHEN doc_id % 6 <> 0 THEN source END AS company_id, doc_id::VARCHAR AS document_id, lpad(doc_id::VARCHAR, 24, '0') AS object_id, 'T' || doc_id AS title, 'completed' AS state, 'j0' AS job_id,
  doc_id AS chunk_count, doc_id AS created, doc_id + 10 AS updated FROM documents)"""

ORACLES = {
    "category_rows": f"WITH {E}, {ROWS} SELECT * FROM rows_",
    "attribute_rows": f"""WITH {E}, {ROWS}, m AS (SELECT category_id, arg_min(name, id) AS name, arg_min(slug, id) AS slug FROM rows_ GROUP BY category_id),
a AS (SELECT s_suppkey::BIGINT AS id, 'a' || s_suppkey AS attribute_id, s_name AS text, 'x' || (s_suppkey % 900) AS category_id, CASE WHEN s_suppkey % 3 = 0 THEN 'L' || s_name END AS own_label, CASE WHEN s_suppkey % 5 = 0 THEN 'own name' END AS own_category FROM supplier)
SELECT a.id, attribute_id, a.text, coalesce(own_label, a.text) AS name, coalesce(own_label, a.text) AS label, a.category_id, coalesce(own_category, m.name) AS category_name, m.slug AS category_slug FROM a LEFT JOIN m USING (category_id)""",
    "category_ids": f"""WITH {E}, q AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_partkey::VARCHAR WHEN p_partkey % 3 = 1 THEN 'x' || (p_partkey % 900) ELSE {_slug("'my  ' || p_brand || '!'")} END AS identifier FROM part),
x AS (SELECT identifier, id, 'external_id' AS kind FROM q JOIN e ON external_id = identifier WHERE NOT regexp_matches(identifier, '^\\d+$')),
s AS (SELECT identifier, e.id, 'slug' AS kind FROM q JOIN e ON coalesce({_slug("e.slug")}, {_slug("e.text")}) = {_slug("identifier")} WHERE NOT regexp_matches(identifier, '^\\d+$') AND identifier NOT IN (SELECT identifier FROM x))
SELECT identifier, identifier::BIGINT AS id, 'id' AS kind FROM q WHERE regexp_matches(identifier, '^\\d+$') UNION ALL SELECT * FROM x UNION ALL SELECT * FROM s""",
    "category_filtered": f"""WITH {E} SELECT id, 'known' AS filter FROM e WHERE company_id = 'co3' AND status = 'Active' AND NOT featured
UNION ALL SELECT id, 'blank' FROM e WHERE description IS NULL AND parent = 'x7' UNION ALL SELECT id, 'slug' FROM e WHERE coalesce({_slug("slug")}, {_slug("text")}) = 'my-brand11'""",
    "category_counts": f"""WITH {E}, r AS (SELECT *, coalesce(company_id, own_company) AS company FROM e),
c AS (SELECT 'total' AS g, 'all' AS name FROM r UNION ALL SELECT 'hierarchy', CASE WHEN parent IS NULL THEN 'root' ELSE 'child' END FROM r UNION ALL SELECT 'type', coalesce(lower(trim(kind)), 'general') FROM r
  UNION ALL SELECT 'status', coalesce(lower(status), 'unknown') FROM r UNION ALL SELECT 'company', company FROM r WHERE company IS NOT NULL UNION ALL SELECT 'featured', 'featured' FROM r WHERE featured
  UNION ALL SELECT 'visibility', CASE WHEN public THEN 'public' ELSE 'private' END FROM r UNION ALL SELECT 'system', CASE WHEN system THEN 'system' ELSE 'user' END FROM r)
SELECT g AS "group", name, count(*) AS count FROM c GROUP BY ALL""",
    "category_payloads": f"""WITH {E}, p AS (SELECT *, CASE WHEN id % 11 = 0 THEN 'given name' END AS gname, CASE WHEN id % 13 = 0 THEN 'given label' END AS glabel, CASE WHEN id % 16 = 1 THEN 'p1' END AS gparent FROM e),
t AS (SELECT *, {SHOWN("coalesce(text, gname, glabel, label, name)")} AS st FROM p), n AS (SELECT *, coalesce(gname, st) AS sn FROM t)
SELECT id, st AS text, sn AS name, sn AS title, coalesce(glabel, label, sn) AS label, {_slug("coalesce(slug, st)")} AS slug, coalesce(gparent, parent) AS parent, NULL::VARCHAR AS company, CASE WHEN st IS NULL THEN 'category text must be a non-empty string' END AS error FROM n""",
    "category_upserted": f"""WITH {E}, {ROWS} SELECT c_custkey::BIGINT AS id, coalesce(r.category_id, 'new' || c_custkey) AS category_id, r.text, r.name FROM customer LEFT JOIN (SELECT * FROM rows_ WHERE id % 2 = 0) r ON r.id = c_custkey""",
    "entry_upsert": """WITH old AS (SELECT vec_id::BIGINT AS id, 'old' || vec_id AS external_id, 'text ' || vec_id AS text, CASE WHEN vec_id % 2 = 0 THEN 'coA' END AS company_id, len(embedding) AS n FROM embeddings WHERE vec_id % 3 <> 0),
new AS (SELECT vec_id AS seq, CASE WHEN vec_id % 8 = 0 THEN (vec_id - vec_id % 3)::VARCHAR WHEN vec_id % 12 = 0 THEN 'name' || (vec_id % 5) END AS key, CASE WHEN vec_id % 16 = 0 THEN 'ext' || vec_id END AS external_id,
  CASE WHEN vec_id % 20 <> 0 THEN 'new ' || vec_id END AS text, CASE WHEN vec_id % 28 = 0 THEN 'coC' WHEN vec_id % 24 = 0 THEN 'coB' END AS company_id, len(embedding) AS n FROM embeddings WHERE vec_id % 4 = 0),
hashed AS (SELECT *, CASE WHEN regexp_matches(key, '^\\d+$') THEN key::BIGINT WHEN key IS NOT NULL THEN ((('0x' || substr(sha1(key), 1, 16))::UBIGINT & 4611686018427387903::UBIGINT) | 4611686018427387904::UBIGINT)::BIGINT END AS hid FROM new),
top AS (SELECT max(x) AS m FROM (SELECT id AS x FROM old UNION ALL SELECT hid FROM hashed WHERE hid < 4611686018427387904)),
known AS (SELECT *, coalesce(hid, (SELECT m FROM top) + row_number() OVER (PARTITION BY hid IS NULL ORDER BY seq)) AS id FROM hashed),
last AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
SELECT coalesce(l.id, o.id)::BIGINT AS id, CASE WHEN l.id IS NULL THEN o.external_id ELSE coalesce(l.external_id, CASE WHEN NOT regexp_matches(l.key, '^\\d+$') THEN l.key END, o.external_id, l.id::VARCHAR) END AS external_id,
  CASE WHEN l.id IS NULL THEN o.text ELSE coalesce(l.text, o.text) END AS text, CASE WHEN l.id IS NULL THEN o.company_id ELSE coalesce(l.company_id, o.company_id) END AS company_id,
  CASE WHEN l.id IS NOT NULL THEN '2' END AS b, false AS has_company, coalesce(l.n, o.n)::INT AS dimension FROM old o FULL JOIN last l ON o.id = l.id""",
    "vector_replace": """WITH gone AS (SELECT vec_id * 2 AS id FROM embeddings WHERE vec_id % 5 = 0),
v AS (SELECT vec_id AS id, len(embedding) AS n FROM embeddings WHERE vec_id NOT IN (SELECT id FROM gone) UNION ALL SELECT vec_id + 1000000, len(embedding) FROM embeddings WHERE vec_id % 10 = 0)
SELECT count(*) AS total, max(n)::INT AS dimension, max(id) AS largest_id, bit_xor(id) AS checksum, (SELECT count(*) FROM gone) AS requested FROM v""",
    "chunks_without": f"""WITH {C} SELECT chunk_id, ingest_version FROM c WHERE doc_id <> '6' AND NOT (doc_id = '7' AND ingest_version = 'v2') AND NOT (doc_id = '8' AND ingest_version = 'v2') AND NOT (company = 'src1' AND domain = 'd1.example')""",
    "document_chunks": f"WITH {C} SELECT doc_id, chunk_id, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1)::INT AS place, ingest_version = 'v2' AS second FROM c",
    "chunk_id_sets": f"""WITH {C} SELECT company, domain, md5(array_to_string(list_sort(list(DISTINCT faiss_id)), ',')) AS faiss_ids, md5(array_to_string(list_sort(list(DISTINCT doc_id::BIGINT)), ',')) AS doc_ids, count(DISTINCT doc_id)::INT AS documents
FROM (SELECT company, domain, faiss_id, doc_id FROM c) GROUP BY company, domain""",
    "domain_chunk_counts": f"WITH {C} SELECT domain, count(*) AS chunks, max(faiss_id) AS largest_id FROM c GROUP BY domain",
    "relabelled_sources": """SELECT doc_id, CASE WHEN source = 'src1' THEN 'web' ELSE source END AS source, CASE WHEN doc_id % 5 = 1 THEN 'web' ELSE 'src' || (doc_id % 5) END AS "inner", lang FROM documents""",
    "index_snapshot": "SELECT count(*) AS total, max(len(embedding))::INT AS dimension, max(vec_id) AS largest_id, bit_xor(vec_id) AS checksum FROM embeddings",
    "company_sizes": f"WITH {C} SELECT company, count(*) AS chunks FROM c GROUP BY company",
    "search_preflight": f"""WITH {C}, w AS (SELECT doc_id, company, company_id, list_contains(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), 'the') AS has FROM c),
q(word, company, odd) AS (VALUES ('the', 'src2', false), ('the', 'nobody', false), ('zzzz', 'src2', false), ('the', 'src1', true)),
n AS (SELECT q.word, q.company, (SELECT count(*) FROM w WHERE has AND q.word = 'the' AND (NOT q.odd OR doc_id::BIGINT % 2 = 1)) AS found,
  (SELECT count(*) FROM w WHERE has AND q.word = 'the' AND (NOT q.odd OR doc_id::BIGINT % 2 = 1) AND w.company_id = q.company) AS with_company,
  (SELECT count(*) FROM w WHERE has AND q.word = 'the' AND (NOT q.odd OR doc_id::BIGINT % 2 = 1) AND w.company = q.company) AS with_metadata_company FROM q)
SELECT *, CASE WHEN found = 0 THEN 'word not found' WHEN with_company > 0 THEN 'ok' WHEN with_metadata_company > 0 THEN 'company field mismatch' ELSE 'company not found' END AS verdict FROM n""",
    "queued_documents": f"""WITH {DOCS}, d AS (SELECT * REPLACE ('src' || (document_id::BIGINT % 20) AS company_id) FROM docs),
j AS (SELECT 'src' || (user_id % 20) AS company_id, user_id::VARCHAR AS document_id, CASE event_id % 3 WHEN 0 THEN event_type END AS title, 'j' || lpad(event_id::VARCHAR, 9, '0') AS job_id, ts FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT company_id, document_id, coalesce(j.title, d.title) AS title, CASE WHEN j.job_id IS NULL THEN d.state ELSE 'queued' END AS state, coalesce(j.job_id, d.job_id) AS job_id, CASE WHEN j.job_id IS NULL THEN d.chunk_count ELSE 0 END AS chunk_count,
  coalesce(d.created, floor(epoch(j.ts))::BIGINT) AS created, CASE WHEN j.job_id IS NULL THEN d.updated ELSE floor(epoch(j.ts))::BIGINT END AS updated FROM d FULL JOIN j USING (company_id, document_id)""",
    "patched_documents": f"""WITH {DOCS}, p AS (SELECT doc_id AS patch_id, CASE WHEN doc_id % 5 = 0 THEN 'other' WHEN doc_id % 5 <> 1 THEN source END AS company_id, CASE WHEN doc_id % 4 = 0 THEN lpad(doc_id::VARCHAR, 24, '0') ELSE doc_id::VARCHAR END AS key,
  CASE WHEN doc_id % 7 = 0 THEN 'j' || doc_id END AS job_id FROM documents),
f AS (SELECT p.patch_id, p.job_id, d.document_id, CASE WHEN p.company_id = d.company_id AND p.key = d.document_id THEN 0 WHEN p.company_id IS NULL AND p.key = d.document_id THEN 1 WHEN p.company_id = d.company_id AND p.key = d.object_id THEN 2 ELSE 3 END AS try
  FROM p JOIN docs d ON (p.key = d.document_id AND (p.company_id IS NULL OR p.company_id = d.company_id)) OR p.key = d.object_id),
l AS (SELECT * FROM f QUALIFY dense_rank() OVER (PARTITION BY patch_id ORDER BY try) = 1)
SELECT d.document_id, CASE WHEN l.patch_id IS NULL THEN d.state ELSE 'failed' END AS state, coalesce(l.job_id, d.job_id) AS job_id FROM docs d LEFT JOIN l USING (document_id)""",
    "index_timeline": f"""WITH c AS (SELECT user_id AS document_id, 'j' || (event_id % 7) AS job_id, {STATES} AS state, ts FROM events),
o AS (SELECT *, last_value(CASE WHEN state = 'queued' THEN job_id END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ts, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner FROM c),
v AS (SELECT * FROM o WHERE owner IS NULL OR owner = job_id), l AS (SELECT document_id, state, job_id FROM v QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, job_id DESC) = 1)
SELECT l.document_id, l.state, l.job_id, epoch_us(max(CASE WHEN v.state = 'queued' THEN ts END))::VARCHAR AS queued_at, epoch_us(max(CASE WHEN v.state = 'processing' THEN ts END))::VARCHAR AS started_at,
  epoch_us(max(CASE WHEN v.state IN ('completed', 'failed') THEN ts END))::VARCHAR AS finished_at, count(CASE WHEN v.state = 'failed' THEN 1 END) AS failures FROM l JOIN v USING (document_id) GROUP BY l.document_id, l.state, l.job_id""",
    "states_to_tell": "SELECT event_id, (list_value('queued', 'processing', 'completed', 'failed', 'indexing'))[1 + event_id % 5] AS state FROM events WHERE event_id % 5 IN (2, 3, 4)",
    "state_callbacks": rf"""WITH {C}, n AS (SELECT doc_id, count(*) AS chunk_count, sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS token_count, sum(length(text))::BIGINT AS char_count FROM c GROUP BY doc_id), m AS (SELECT domain, count(*) AS domain_chunks FROM c GROUP BY domain),
s AS (SELECT doc_id::VARCHAR AS doc_id, CASE doc_id % 4 WHEN 1 THEN 'indexing' WHEN 2 THEN 'indexed' ELSE 'failed' END AS told_state, CASE WHEN doc_id % 3 = 0 THEN 'd' || (doc_id % 4) || '.example' END AS domain FROM documents WHERE doc_id % 4 <> 0)
SELECT doc_id, told_state, s.domain, CASE WHEN told_state = 'indexed' THEN coalesce(chunk_count, 0) ELSE 0 END AS chunk_count, CASE WHEN told_state = 'indexed' THEN coalesce(token_count, 0) ELSE 0 END AS token_count, CASE WHEN told_state = 'indexed' THEN coalesce(char_count, 0) ELSE 0 END AS char_count,
  CASE WHEN told_state = 'indexed' THEN coalesce(domain_chunks, 0) ELSE 0 END AS domain_chunks FROM s LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.domain = s.domain""",
    "job_leases": """WITH RECURSIVE q AS (SELECT DISTINCT user_id AS document_id, 'j' || (event_id % 3) AS job_id, CASE event_id % 5 WHEN 0 THEN 'release' WHEN 1 THEN 'renew' ELSE 'acquire' END AS action, floor(epoch(ts))::BIGINT AS ts FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts, job_id, action) AS n FROM q),
r AS (SELECT document_id, 0::BIGINT AS n, NULL::VARCHAR AS owner, NULL::BIGINT AS until, NULL::BOOLEAN AS granted FROM (SELECT DISTINCT document_id FROM q)
  UNION ALL SELECT document_id, n, CASE WHEN ok AND action = 'release' THEN NULL WHEN ok THEN job_id ELSE owner END, CASE WHEN ok AND action = 'release' THEN NULL WHEN ok THEN ts + 86400 ELSE until END, ok
  FROM (SELECT n.*, r.owner, r.until, CASE WHEN n.action = 'acquire' THEN r.owner IS NULL OR r.owner = n.job_id OR r.until < n.ts ELSE coalesce(r.owner = n.job_id, false) END AS ok FROM r JOIN n ON n.document_id = r.document_id AND n.n = r.n + 1))
SELECT n.document_id, n.job_id, n.action, n.ts, r.granted FROM n JOIN r USING (document_id, n)""",
    "index_options": """WITH o AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 500 + c_custkey % 7 ELSE 900 END::INT AS chunk_size, CASE WHEN c_custkey % 4 = 0 THEN 50 ELSE 200 END::INT AS chunk_overlap, CASE WHEN c_custkey % 5 = 0 THEN 20 ELSE 80 END::INT AS min_chars,
  c_custkey % 2 = 0 AS cleanup, false AS ocr, c_custkey % 6 = 0 AS lang_detect, c_mktsegment AS scope, lower(c_mktsegment) AS source FROM customer)
SELECT *, '{"chunk_count":0,"token_count":0,"char_count":0,"chunk_size":' || chunk_size || ',"chunk_overlap":' || chunk_overlap || ',"min_chars":' || min_chars || '}' AS stats FROM o""",
    "document_sources": """WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'upload' WHEN 1 THEN 'url' WHEN 2 THEN 'fetcher' ELSE CASE WHEN doc_id % 10 = 3 THEN 'crawler' ELSE 'text' END END AS source,
  CASE WHEN doc_id % 5 = 0 THEN 'page' WHEN doc_id % 9 = 0 THEN 'site' ELSE 'document' END AS doc_type, CASE WHEN doc_id % 8 = 0 THEN 'u' || doc_id WHEN doc_id % 12 = 4 THEN 'm' || doc_id END AS upload_id,
  CASE WHEN doc_id % 12 < 6 THEN 'http://x/' || doc_id WHEN doc_id % 24 = 9 THEN 'http://m/' END AS url, CASE WHEN doc_id % 7 <> 0 THEN nullif(substr(text, 1, 20), '') END AS text, CASE WHEN doc_id % 6 = 2 THEN 'dom.example' END AS domain FROM documents)
SELECT *, CASE WHEN source IN ('fetcher', 'crawler') THEN CASE WHEN domain IS NULL AND url IS NULL THEN 'crawl source missing domain' END WHEN source = 'upload' THEN CASE WHEN upload_id IS NULL THEN 'upload source missing upload_id' END
  WHEN source = 'url' THEN CASE WHEN url IS NULL THEN 'url source missing url' END WHEN text IS NULL THEN 'text source missing content' END AS error FROM r""",
    "company_claims": """WITH l AS (SELECT 'c' || s_suppkey AS company_id, CASE WHEN s_suppkey % 6 <> 0 THEN 'U' || s_suppkey END AS owner FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0),
q AS (SELECT DISTINCT CASE WHEN c_custkey % 11 <> 0 THEN 'c' || (c_custkey % 130) END AS company_id, CASE WHEN c_custkey % 13 <> 0 THEN 'u' || (c_custkey % 130 + (c_custkey % 3 = 0)::INT) END AS user_id FROM customer)
SELECT q.company_id, q.user_id, CASE WHEN q.company_id IS NULL THEN NULL WHEN q.user_id IS NULL THEN 'userId is required' WHEN l.company_id IS NULL THEN 'company_not_found_or_inactive' WHEN owner IS NULL THEN 'company_user_missing'
  WHEN lower(owner) <> lower(q.user_id) THEN 'user_mismatch' END AS error FROM q LEFT JOIN l ON l.company_id = q.company_id""",
    "crawl_rows": """WITH l AS (SELECT page_id, url, n, page_id * 10 + (n * 7) % 5 AS fetched FROM pages, range(3) t(n) WHERE (page_id + n) % 4 <> 0), latest AS (SELECT url, 'key' || n AS s3_key FROM l QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched DESC) = 1),
m AS (SELECT url, string_agg('image' || CASE WHEN n % 2 = 0 THEN ' | alt ' || n ELSE '' END || ' | /i' || n || '.png', chr(10) ORDER BY n) AS media FROM pages, range(1, 31) t(n)
  WHERE page_id % 5 <> 0 AND (n <= page_id % 30 OR (page_id % 30 = 0 AND n = 1)) AND n <= 20 GROUP BY url)
SELECT page_id, s3_key, media FROM pages LEFT JOIN latest USING (url) LEFT JOIN m USING (url)""",
    "preview_images": """SELECT page_id, url, CASE WHEN page_id % 7 <> 0 THEN CASE WHEN page_id % 3 = 0 THEN 'http://i/' || page_id WHEN page_id % 4 = 0 THEN 'http://u' WHEN page_id % 5 = 0 THEN '/g' || page_id END END AS og_image FROM pages""",
    "upload_files": """WITH f AS (SELECT o_custkey AS upload_id, min(o_orderkey) AS file_id FROM orders GROUP BY o_custkey)
SELECT c_custkey::BIGINT AS upload_id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, coalesce(CASE WHEN f.file_id % 2 = 0 THEN 'f/' || f.file_id END, CASE WHEN c_custkey % 3 <> 0 THEN 'up/' || c_custkey END) AS key,
  CASE WHEN c_custkey % 3 = 0 THEN 'upload not found' END AS error FROM customer LEFT JOIN f ON f.upload_id = c_custkey""",
    "crawl_page_totals": """WITH t AS (SELECT conv_id, turn, text, sum(length(text)) OVER w AS total, row_number() OVER w AS place FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id AS document_id, count(*) AS pages, least(max(total), 600)::BIGINT AS chars, 'u' || min(turn) AS first_url FROM t WHERE total <= 600 OR place = 1 GROUP BY conv_id""",
    "ready_documents": f"""WITH {D}, s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' Private ' WHEN 1 THEN source END AS source FROM documents)
SELECT d.doc_id, d.status, s.source FROM d JOIN s ON s.doc_id::VARCHAR = d.doc_id WHERE status IN ('ready', 'processing') AND s.doc_id % 4 <> 0""",
    "failure_notices": """SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 5 = 0 THEN 'upload_access_failed' WHEN event_id % 2 = 0 AND (event_id % 5 = 1 OR event_id % 7 = 0) THEN 'upload_format_unsupported' ELSE 'index_failed' END AS notice FROM events""",
    "web_build_counts": f"""WITH {C}, n AS (SELECT doc_id::BIGINT AS id, count(*) AS n FROM c GROUP BY doc_id)
SELECT count(*) AS processed, count(n) AS chunked, count(*) - count(n) AS skipped, coalesce(sum(n), 0)::BIGINT AS chunks FROM documents LEFT JOIN n ON id = documents.doc_id WHERE documents.doc_id >= 100 AND documents.doc_id < 500""",
    "markdown_pages": f"""WITH k AS ({ORACLES_["html_to_markdown"]}),
p AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'no scheme ' || page_id ELSE url END AS url, CASE WHEN page_id % 10 = 0 THEN 'invalid url' WHEN page_id % 7 = 0 THEN 'empty markdown' END AS error, text FROM k)
SELECT url, CASE WHEN error IS NULL THEN nullif(trim(regexp_extract(text, '(?m)^#\\s+(.+)$', 1)), '') END AS title, CASE WHEN error IS NULL THEN sha1(text) END AS content_hash, error FROM p""",
    "job_routes": """WITH l AS (SELECT DISTINCT doc_id FROM labels), r AS (SELECT event_id AS job_id, event_id % 4 AS attempt, CASE WHEN doc_id IS NOT NULL THEN 'run' WHEN event_id % 4 + 1 < 3 THEN 'retry' ELSE 'dead' END AS route FROM events LEFT JOIN l ON doc_id = user_id)
SELECT job_id, route, attempt + (route = 'retry')::INT AS attempt FROM r""",
    "entry_metadata": f"""WITH {V}, {_dense(5, queries="SELECT faiss_id AS qid, e, company_id FROM v WHERE faiss_id % 20 = 0")}
SELECT qid, rank, faiss_id AS id, CASE WHEN faiss_id % 2 = 0 THEN 'db' ELSE 'mem' END || faiss_id AS external_id, CASE WHEN faiss_id % 4 <> 0 THEN 'text of ' || CASE WHEN faiss_id % 2 = 0 THEN 'db' ELSE 'mem' END END AS text,
  v.company_id FROM top JOIN v USING (faiss_id) WHERE faiss_id % 2 = 0 OR faiss_id % 3 <> 1""",
    "category_created": f"""WITH {E}, n AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 8 = 0 THEN 'co' || (p_partkey % 11) END AS company_id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'new ' || (p_partkey % 20) END AS text FROM part),
o AS (SELECT company_id, text, arg_min(external_id, id) AS x FROM e WHERE text IS NOT NULL GROUP BY ALL), a AS (SELECT text, arg_min(external_id, id) AS x FROM e WHERE text IS NOT NULL GROUP BY text)
SELECT n, CASE WHEN n.company_id IS NULL THEN a.x ELSE o.x END AS existing, CASE WHEN CASE WHEN n.company_id IS NULL THEN a.x ELSE o.x END IS NOT NULL OR row_number() OVER (PARTITION BY n.company_id, n.text ORDER BY n) > 1 THEN 'duplicate_entry' END AS error
FROM n LEFT JOIN o ON o.company_id = n.company_id AND o.text = n.text LEFT JOIN a ON a.text = n.text""",
    "serialised_rows": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS created_at, event_type FROM events",
    "reconstructed": f"""WITH {C}, {D}, w AS (SELECT DISTINCT (vec_id * 7)::VARCHAR AS doc_id FROM embeddings), n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id), t AS (SELECT doc_id::VARCHAR AS doc_id, {STRIPPED} AS t FROM documents),
r AS (SELECT w.doc_id, status, n, t, CASE WHEN status IN ('disabled', 'removed') THEN 'document_disabled' WHEN n IS NULL THEN 'not_found' END AS error FROM w LEFT JOIN d USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id))
SELECT doc_id, status, CASE WHEN error IS NULL THEN n ELSE 0 END AS chunk_count, CASE WHEN error IS NULL THEN md5(t) END AS digest, error FROM r""",
    "remove_domain": f"""WITH {C}, {D}, h AS (SELECT *, company = 'src1' AND domain = 'd1.example' AS hit FROM c)
SELECT (SELECT count(*) FROM h WHERE NOT hit) AS chunks_left, (SELECT count(DISTINCT faiss_id) FROM h WHERE hit) AS vectors_removed, (SELECT count(*) FROM d WHERE status = 'removed' OR doc_id IN (SELECT doc_id FROM h WHERE hit)) AS removed_documents""",
    "documents_by_ids": f"WITH {D} SELECT doc_id, status FROM d WHERE doc_id::BIGINT IN (SELECT vec_id * 3 FROM embeddings)",
    "merged_rows": """WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN 5 END, quality, -1)::INT AS quality, coalesce(toxic, -1)::INT AS toxic FROM documents d FULL JOIN l ON l.doc_id = d.doc_id""",
    "other_versions": f"WITH {C} SELECT faiss_id, doc_id FROM c WHERE ingest_version <> 'v1'",
    "listed_urls": f"""SELECT page_id, u || CASE WHEN page_id % 4 = 3 THEN ' http://other.example/' ELSE '' END AS urls FROM (SELECT page_id, {PAGE_URL} AS u FROM (SELECT page_id, regexp_replace(url, '[#?].*$', '') AS url FROM pages))""",
    "row_preview": r"""SELECT doc_id, CASE WHEN length(s) > 60 THEN rtrim(substr(s, 1, 57)) || '...' ELSE s END AS preview FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS s FROM documents ORDER BY doc_id LIMIT 5)""",
    "row_count": "SELECT count(*) AS rows FROM documents",
    "source_lookup": "WITH p AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS domain FROM pages) SELECT * FROM p WHERE domain = (SELECT min(domain) FROM p)",
    "entry_visibility": f"WITH {D} SELECT doc_id FROM d WHERE {VISIBLE} AND (active_ingest_version IS NULL OR active_ingest_version = 'v1')",
}
