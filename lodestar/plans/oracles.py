"""The queries in DuckDB's SQL."""

from __future__ import annotations

V = "v AS (SELECT vec_id AS faiss_id, 'c' || (label % 4) AS company_id, embedding::DOUBLE[] AS e FROM embeddings)"
D = """d AS (SELECT doc_id::VARCHAR AS doc_id, CASE doc_id % 17 WHEN 0 THEN 'disabled' WHEN 1 THEN 'removed' WHEN 2 THEN 'processing' ELSE 'ready' END AS status,
  CASE doc_id % 3 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' END AS active_ingest_version FROM documents)"""
STRIPPED = r"regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\s+|\s+$', '', 'g')"
C = f"""c AS (
  SELECT doc_id::VARCHAR AS doc_id, doc_id || ':' || i AS chunk_id, doc_id + i * 4294967296 AS faiss_id, i::INT AS chunk_index, 'v' || (1 + doc_id % 2) AS ingest_version,
    CASE WHEN doc_id % 2 = 0 THEN source END AS company_id, source AS company, CASE WHEN doc_id % 5 <> 0 THEN 'u' || (doc_id % 7) END AS user_id,
    substr(t, 1000 * i + 1, 1200) AS text, (1000 * i)::INT AS char_start, least(1000 * i + 1200, n)::INT AS char_end, 'd' || (doc_id % 4) || '.example' AS domain, split_part(raw, '.', 1) AS title
  FROM (SELECT doc_id, source, raw, t, length(t) AS n, unnest(range(0, greatest((length(t) + 999) // 1000, 1))) AS i FROM (SELECT doc_id, source, text AS raw, {STRIPPED} AS t FROM documents))
  WHERE (i = 0 OR 1000 * i + 200 < n) AND least(n - 1000 * i, 1200) >= 40)"""
VISIBLE = "(d.status IS NULL OR d.status NOT IN ('disabled', 'removed'))"
ACTIVE = "(d.active_ingest_version IS NULL OR c.ingest_version IS NOT DISTINCT FROM d.active_ingest_version)"
SHOWN = f"shown AS (SELECT c.* FROM c LEFT JOIN d USING (doc_id) WHERE {VISIBLE} AND {ACTIVE})"


def _dense(k: int, name: str = "top", where: str = "true", same: str = "true", queries: str = "SELECT faiss_id AS qid, e, company_id FROM v WHERE faiss_id % 20 = 0") -> str:
    return f"""{name} AS (SELECT * FROM (
  SELECT q.qid, v.faiss_id, round(list_inner_product(v.e, q.e), 6) AS score,
    row_number() OVER (PARTITION BY q.qid ORDER BY round(list_inner_product(v.e, q.e), 6) DESC, v.faiss_id)::INT AS rank
  FROM v, ({queries}) q WHERE ({where}) AND ({same})) WHERE rank <= {k})"""


def _bm25(k: int, queries: str = "SELECT item_id AS qid, text FROM benchmark", rows: str = "SELECT * FROM c") -> str:
    split = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
    return f"""q AS ({queries}),
terms AS (SELECT DISTINCT qid, unnest({split}) AS term FROM q),
toks AS (SELECT chunk_id, {split} AS t FROM ({rows})),
size AS (SELECT count(*)::DOUBLE AS total, sum(len(t))::DOUBLE / count(*) AS mean FROM toks),
posts AS (SELECT chunk_id, n, term, count(*)::DOUBLE AS tf FROM (SELECT chunk_id, len(t)::DOUBLE AS n, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
dfs AS (SELECT term, count(*)::DOUBLE AS df FROM posts GROUP BY term),
scores AS (SELECT qid, chunk_id, round(sum(ln(1::DOUBLE + (total - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 6) AS score
  FROM posts JOIN terms USING (term) JOIN dfs USING (term), size GROUP BY qid, chunk_id),
lex AS (SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id)::INT AS rank FROM scores) WHERE rank <= {k})"""


def _norm(c: str) -> str:
    return rf"trim(regexp_replace(replace(lower(coalesce({c}, '')), 'ß', 'ss'), '[^\p{{L}}\p{{N}}\p{{M}}_]+', ' ', 'g'))"


MATCH = f"""CASE WHEN length({_norm('query')}) < 3 THEN 0
  WHEN ({_norm('title')} <> '' AND (contains({_norm('title')}, {_norm('query')}) OR contains({_norm('query')}, {_norm('title')}))) THEN 2
  WHEN contains({_norm('text')}, {_norm('query')}) THEN 1 ELSE 0 END::INT"""
BOTH = "SELECT item_id AS qid, text FROM benchmark WHERE item_id IN (SELECT faiss_id FROM v)"
VECTORS_OF_BOTH = "SELECT faiss_id AS qid, e, company_id FROM v WHERE faiss_id IN (SELECT item_id FROM benchmark)"


def _fused(k: int) -> str:
    return f"""{V}, {D}, {C}, {SHOWN}, {_dense(k, queries=VECTORS_OF_BOTH)}, {_bm25(k, BOTH)},
dh AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) - 1 AS r FROM top JOIN shown USING (faiss_id)),
lh AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) - 1 AS r FROM lex JOIN (SELECT chunk_id FROM shown) USING (chunk_id)),
al AS (SELECT *, 0 AS side FROM dh UNION ALL SELECT *, 1 FROM lh),
fused AS (SELECT qid, chunk_id, sum(1::DOUBLE / (60 + r)) AS rrf, arg_min(score, (side, r)) AS score, min((side, r)) AS first FROM al GROUP BY qid, chunk_id)"""


DENSE_HITS = "dh AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) - 1 AS r FROM top JOIN shown USING (faiss_id){})"
LEXICAL_HITS = "lh AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) - 1 AS r FROM lex JOIN (SELECT chunk_id FROM shown) USING (chunk_id))"
FUSED = """al AS (SELECT *, 0 AS side FROM dh UNION ALL SELECT *, 1 FROM lh),
fused AS (SELECT qid, chunk_id, sum(1::DOUBLE / (60 + r)) AS rrf, arg_min(score, (side, r)) AS score, min((side, r)) AS first FROM al GROUP BY qid, chunk_id)"""
#: The text of a chunk and of those next to it: each adds what lies beyond the end of the one before.
WIDE = """numbered AS (SELECT doc_id, chunk_id, char_start, char_end, text, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, chunk_id) AS place FROM c),
parts AS (SELECT a.chunk_id, o.place, o.char_start, o.char_end, o.text, lag(o.char_end) OVER (PARTITION BY a.chunk_id ORDER BY o.place) AS before
  FROM numbered a JOIN numbered o ON o.doc_id = a.doc_id AND o.place BETWEEN a.place - 1 AND a.place + 1),
filled AS (SELECT chunk_id, place, CASE WHEN before IS NULL THEN repeat(' ', char_start) || text ELSE substr(text, before - char_start + 1) END AS piece FROM parts),
wide AS (SELECT chunk_id, string_agg(piece, '' ORDER BY place) AS wide FROM filled GROUP BY chunk_id)"""


def _placed(k: int, old: str = "rrf DESC, first", text: str = "c.text", query: str = "q.text", single: bool = True, rerank: str = "old", more: str = "", source: str = "fused", queries: str = "JOIN q ON q.qid = f.qid") -> str:
    """From `fused` to the answer: reranking, title matches, one row for each document, the best k."""
    one = "SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY position) = 1" if single else "SELECT * FROM placed"
    return f"""{more}rows_ AS (SELECT f.qid, f.chunk_id, c.doc_id, f.score, f.rrf, row_number() OVER (PARTITION BY f.qid ORDER BY {old}) AS old, {query} AS query, c.title, {text} AS text
  FROM {source} f JOIN c USING (chunk_id) {queries}{' JOIN wide USING (chunk_id)' if more else ''}),
again AS (SELECT * REPLACE (row_number() OVER (PARTITION BY qid ORDER BY {rerank}) AS old) FROM rows_),
m AS (SELECT qid, chunk_id, doc_id, score, rrf, old, text, {MATCH} AS title_match FROM again),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY title_match DESC, {'score DESC, ' if single else ''}old) AS position FROM m),
single AS ({one})
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY position)::INT AS rank, doc_id, chunk_id, score, round(rrf, 6) AS rrf, title_match, md5(text) AS digest FROM single QUALIFY rank <= {k}"""


GIVEN = "(user_id IS NULL OR user_id = 'u1') AND domain = 'd1.example'"
SHORT = "SELECT qid, substr(text, 1, 2) AS text FROM (" + BOTH + ")"
TITLED = f"""{C}, {_bm25(20)},
rows_ AS (SELECT l.qid, l.chunk_id, c.doc_id, l.score, l.rank, q.text AS query, c.title, c.text FROM lex l JOIN c USING (chunk_id) JOIN q ON q.qid = l.qid),
m AS (SELECT qid, chunk_id, doc_id, score, rank, {MATCH} AS title_match FROM rows_),
titled AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY title_match DESC, score DESC, rank) - 1)::INT AS position FROM m)"""
HITS = """hits AS (SELECT * FROM (SELECT user_id AS query, event_type AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events) WHERE rank <= 20),
targets AS (SELECT DISTINCT user_id AS query, unnest(['purchase', 'signup']) AS key FROM events),
j AS (SELECT h.*, t.key IS NOT NULL AS hit FROM hits h LEFT JOIN targets t USING (query, key)),
m AS (SELECT query, count(DISTINCT CASE WHEN hit AND rank <= 5 THEN key END) / 2.0::DOUBLE AS recall, coalesce(1::DOUBLE / min(CASE WHEN hit THEN rank END), 0) AS rr,
  coalesce(sum(CASE WHEN hit AND rank <= 5 THEN 1::DOUBLE / log2(rank + 1) END), 0) / (1 + 1::DOUBLE / log2(3)) AS ndcg FROM j GROUP BY query)"""
TREE = """e AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id, r_name AS text FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT DISTINCT 's' || c_nationkey || '-' || lower(c_mktsegment), 'n' || c_nationkey, c_mktsegment FROM customer),
p AS (SELECT id, parent_id, text, [id] AS ids, [text] AS texts, parent_id AS next FROM e
  UNION ALL SELECT p.id, p.parent_id, p.text, list_prepend(e.id, p.ids), list_prepend(e.text, p.texts), e.parent_id FROM p JOIN e ON p.next = e.id),
whole AS (SELECT * FROM p WHERE next IS NULL)"""
URL = r"'^(?:([A-Za-z][A-Za-z0-9+.-]*)://)?([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$'"


def _url(n: int) -> str:
    return f"regexp_extract(trim(coalesce(url, '')), {URL}, {n})"


DOMAIN = rf"regexp_replace(regexp_replace(regexp_replace(lower({_url(2)}), '^.*@', ''), ':\d*$', ''), '^\.+|\.+$', '', 'g')"

# pages as markdown, for bodies of menus, footers, comments, boxes, headings, paragraphs, bold text and line breaks, as the pages at hand have
_TAGS = [
    (r"(?s)^.*<body>", ""), (r"\s+", " "), (r"<nav>.*?</nav>|<footer>.*?</footer>|<!--.*?-->|<script>.*?</script>|<style>.*?</style>", ""), ("<h1>", "\n\n# "), ("<b>", "**"), ("<br>", "\n"),
    (r"</?(?:h1|p|div|article|body|html)(?: [^>]*)?>", "\n\n"), (r"</b>", "**"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;?", "&"), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""),
]
_MARKDOWN = "html"
for _pattern, _new in _TAGS:
    _MARKDOWN = f"regexp_replace({_MARKDOWN}, '{_pattern}', '{_new}', 'g')"
PAGES = f"md AS (SELECT page_id, url, {_MARKDOWN} AS t FROM pages)"
FURNITURE = "^(gizlilik politikasi|kvkk|kullanim kosullari|cerez politikasi|privacy policy|terms|terms and conditions|cookie|cookies|contact)$|mah[.]|mahalle|sokak|cad[.]|no:|pk:|kat\\b|daire\\b|istanbul|ankara|izmir|^copyright|^[(]c[)]"

ORACLES = {
    "html_to_markdown": f"""WITH {PAGES}, l AS (SELECT page_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM md),
f AS (SELECT * FROM l WHERE length(line) > 2 AND NOT regexp_matches(line, '(?i){FURNITURE}') QUALIFY row_number() OVER (PARTITION BY page_id, lower(line) ORDER BY n) = 1)
SELECT page_id, any_value(md.url) AS url, coalesce(string_agg(line, chr(10) ORDER BY n), '') AS text FROM md LEFT JOIN f USING (page_id) GROUP BY page_id""",
    "structure_chunks": f"""WITH {PAGES}, h AS (SELECT *, length(t) AS n, CASE WHEN starts_with(t, '# ') THEN 0 ELSE strpos(t, chr(10) || '# ') END AS h FROM md),
s AS (SELECT page_id, url, t, regexp_extract(t, '(?m)^# (.*)$', 1) AS title, n, CASE WHEN h = 0 AND NOT starts_with(t, '# ') THEN n ELSE h END AS h FROM h),
p AS (SELECT page_id, url, t, 0 AS a, n AS b, CASE WHEN h = 0 THEN title ELSE '' END AS trail FROM s WHERE n > 0 AND (n <= 1200 OR h IN (0, n))
  UNION ALL SELECT page_id, url, t, 0, h, '' FROM s WHERE n > 1200 AND h NOT IN (0, n) UNION ALL SELECT page_id, url, t, h, n, title FROM s WHERE n > 1200 AND h NOT IN (0, n)),
b AS (SELECT *, regexp_replace(substr(t, a + 1, b - a), '^\\s+|\\s+$', '', 'g') AS body, substr(CASE WHEN trail = '' THEN url ELSE trail || ' (' || url || ')' END, 1, 160) || chr(10) || chr(10) AS head FROM p),
w AS (SELECT page_id, a, b, head, body, length(body) AS n, unnest(CASE WHEN length(body) > 1200 THEN range(0, length(body), 1000) ELSE [0] END) AS w FROM b WHERE length(body) >= 40),
c AS (SELECT page_id, head || substr(body, w + 1, 1200) AS text, CASE WHEN n > 1200 THEN a + w ELSE a END AS char_start, CASE WHEN n > 1200 THEN a + least(w + 1200, n) ELSE b END AS char_end FROM w WHERE (w = 0 OR w + 200 < n) AND least(n - w, 1200) >= 40)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY char_start) - 1)::INT AS chunk_index, text, char_start::INT AS char_start, char_end::INT AS char_end FROM c""",
    "schema_leaves": "SELECT event_id, CASE WHEN length(trim(repeat(event_type || ' ', 40))) >= 200 THEN trim(repeat(event_type || ' ', 40)) ELSE '' END AS text FROM events",
    "dense_topk": f"WITH {V}, {_dense(10)} SELECT * FROM top",
    "dense_topk_company": f"WITH {V}, {_dense(10, same='v.company_id = q.company_id')} SELECT * FROM top",
    "dense_post_filter": f"WITH {V}, {_dense(10)} SELECT top.*, v.company_id FROM top JOIN v USING (faiss_id) WHERE v.company_id = 'c1'",
    "dense_fallback": f"""WITH {V}, {_dense(5, 'own', where="v.company_id = 'c0'", same='v.company_id = q.company_id')}, {_dense(5, 'every')}
SELECT *, 'company' AS scope FROM own UNION ALL SELECT *, 'global_fallback' FROM every WHERE qid NOT IN (SELECT qid FROM own)""",
    "vector_norms": f"""WITH {V}, u AS (SELECT faiss_id, e, sqrt(list_sum(list_transform(e, lambda x: 9 * x * x))) AS n FROM v),
w AS (SELECT faiss_id, list_transform(e, lambda x: CASE WHEN n > 0 THEN (3 * x / n)::FLOAT::DOUBLE ELSE 3 * x END) AS e FROM u)
SELECT faiss_id, len(e)::INT AS dimension, round(list_sum(list_transform(e, lambda x: x * x)), 4) AS norm FROM w""",
    "chunk_windows": f"WITH {C} SELECT doc_id, chunk_index, char_start, char_end, text FROM c",
    "chunk_stats": rf"WITH {C} SELECT doc_id, count(*) AS chunk_count, sum(length(text))::BIGINT AS char_count, sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS token_count FROM c GROUP BY doc_id",
    "chunk_strategy": r"SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '(?m)^#{1,6}\s+\S') THEN 'structure' ELSE 'char' END AS strategy FROM documents",
    "filter_in_null": f"WITH {C} SELECT chunk_id, user_id FROM c WHERE (user_id IS NULL OR user_id = 'u1') AND domain = 'd1.example'",
    "filter_company": f"WITH {C} SELECT chunk_id, company FROM c WHERE company IN ('src1', 'src2')",
    "doc_visibility": f"WITH {C}, {D} SELECT chunk_id, status FROM c LEFT JOIN d USING (doc_id) WHERE {VISIBLE}",
    "active_version": f"WITH {C}, {D}, {SHOWN} SELECT chunk_id, ingest_version FROM shown",
    "active_chunk_count": f"WITH {C}, {D} SELECT company, count(*) AS chunks FROM c JOIN d USING (doc_id) WHERE {VISIBLE} AND {ACTIVE} GROUP BY company",
    "company_counts": f"WITH {C} SELECT company, count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM c GROUP BY company",
    "company_domain_ids": f"WITH {C} SELECT DISTINCT company, domain, doc_id, faiss_id FROM c",
    "reconstruct_text": f"SELECT doc_id::VARCHAR AS doc_id, length(t)::INT AS n_chars, md5(t) AS digest FROM (SELECT doc_id, {STRIPPED} AS t FROM documents) WHERE length(t) >= 40",
    "neighbour_radius": f"""WITH {C}, {_bm25(3)}, n AS (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, chunk_id) AS place FROM c)
SELECT lex.qid, lex.chunk_id AS hit, o.chunk_id FROM lex JOIN n ON n.chunk_id = lex.chunk_id JOIN n o ON o.doc_id = n.doc_id AND o.place BETWEEN n.place - 1 AND n.place + 1""",
    "lexical_topk": f"WITH {C}, {_bm25(10)} SELECT * FROM lex",
    "rrf_fuse": f"WITH {_fused(20)} SELECT qid, chunk_id, score, round(rrf, 6) AS rrf FROM fused",
    "title_promotion": f"WITH {TITLED} SELECT qid, chunk_id, title_match, position FROM titled",
    "doc_dedupe": f"WITH {TITLED} SELECT qid, doc_id, chunk_id, position FROM titled QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY position) = 1",
    "hybrid_search": f"""WITH {_fused(40)},
rows_ AS (SELECT f.qid, f.chunk_id, c.doc_id, f.score, f.rrf, row_number() OVER (PARTITION BY f.qid ORDER BY f.rrf DESC, f.first) AS old, q.text AS query, c.title, c.text FROM fused f JOIN c USING (chunk_id) JOIN q ON q.qid = f.qid),
m AS (SELECT qid, chunk_id, doc_id, score, rrf, old, {MATCH} AS title_match FROM rows_),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY title_match DESC, score DESC, old) AS position FROM m),
single AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY position) = 1)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY position)::INT AS rank, doc_id, chunk_id, score, round(rrf, 6) AS rrf, title_match FROM single QUALIFY rank <= 10""",
    "search_filtered": f"""WITH {V}, {D}, {C}, {SHOWN}, {_dense(5000, queries=VECTORS_OF_BOTH)}, {_bm25(5000, BOTH, f"SELECT * FROM c WHERE {GIVEN}")},
{DENSE_HITS.format(f" WHERE {GIVEN}")}, {LEXICAL_HITS}, {FUSED}, {_placed(5)}""",
    "search_fallback": f"""WITH {V}, {D}, {C}, {SHOWN}, q AS ({BOTH}), {_dense(5000, queries=VECTORS_OF_BOTH)}, {DENSE_HITS.format(" WHERE company = 'src1'")}, {_placed(5, 'r', source='(SELECT *, NULL::DOUBLE AS rrf FROM dh)')}""",
    "search_short_query": f"WITH {V}, {D}, {C}, {SHOWN}, {_dense(40, queries=VECTORS_OF_BOTH)}, {_bm25(40, SHORT)}, {DENSE_HITS.format('')}, {LEXICAL_HITS}, {FUSED}, {_placed(10, single=False)}",
    "search_radius": f"WITH {_fused(12)}, {_placed(3, text='wide.wide', more=WIDE + ', ')}",
    "search_reranked": f"WITH {_fused(40)}, {_placed(10, rerank='old > 5, CASE WHEN old <= 5 THEN -length(text) END, old')}",
    "search_report": f"""WITH {V}, {D}, {C}, {SHOWN}, {_dense(5000, queries=VECTORS_OF_BOTH)}, {_bm25(5000, BOTH, "SELECT * FROM c WHERE company = 'src1'")}, {DENSE_HITS.format(" WHERE company = 'src1'")}, {LEXICAL_HITS}
SELECT q.qid, 'hybrid' AS retrieval, true AS hybrid_applied, false AS rerank_applied, (SELECT count(*) FROM dh WHERE dh.qid = q.qid) AS dense_count, (SELECT count(*) FROM lh WHERE lh.qid = q.qid) AS lexical_count,
'global_fallback' AS index_scope, 'empty_results' AS fallback_reason FROM q""",
    "web_search": f"""WITH {V}, {D}, {C}, {_dense(10, queries=VECTORS_OF_BOTH)}, {WIDE}, seen AS (SELECT c.* FROM c LEFT JOIN d USING (doc_id) WHERE {VISIBLE} AND (user_id IS NULL OR user_id IN ('u1', 'u2')))
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id)::INT AS rank, chunk_id, score, md5(wide) AS digest FROM top JOIN seen USING (faiss_id) JOIN wide USING (chunk_id)""",
    "entry_search": f"WITH {V}, {_dense(10)} SELECT top.faiss_id AS id, qid, score, rank, company_id FROM top JOIN v USING (faiss_id) WHERE v.company_id = 'c2'",
    "rerank_top": f"WITH {C}, {_bm25(10)} SELECT qid, chunk_id, (row_number() OVER (PARTITION BY qid ORDER BY rank > 5, CASE WHEN rank <= 5 THEN -length(chunk_id) END, rank) - 1)::INT AS position FROM lex",
    "latest_per_key": "SELECT user_id AS document_id, event_id AS job_id, event_type AS state, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "topn_per_key": "SELECT user_id AS document_id, event_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS n FROM events QUALIFY n <= 3",
    "running_budget": """WITH t AS (SELECT conv_id, turn, text, sum(length(text) + 7) OVER w - 7 AS total, row_number() OVER w AS place FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, length(substr(text, 1, CASE WHEN total > 2000 THEN 2000 ELSE length(text) END))::INT AS n_chars, md5(substr(text, 1, CASE WHEN total > 2000 THEN 2000 ELSE length(text) END)) AS digest FROM t WHERE total <= 2000 OR place = 1""",
    "job_latest_state": "SELECT state, count(*) AS documents FROM (SELECT event_type AS state FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY state",
    "domain_normalize": f"SELECT page_id, {DOMAIN} AS domain FROM pages",
    "url_normalize": f"""SELECT page_id, CASE WHEN {_url(2)} <> '' THEN coalesce(nullif(lower({_url(1)}), ''), 'https') || '://' || lower({_url(2)}) || coalesce(nullif({_url(3)}, ''), '/') || {_url(4)} ELSE '' END AS page_url,
regexp_replace(lower({_url(2)}), '^www\\.', '') || regexp_replace({_url(3)}, '/+$', '') || {_url(4)} AS url_key FROM pages""",
    "slug": r"SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(c_name || '  ' || c_mktsegment), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM customer",
    "clean_lines": r"SELECT doc_id, md5(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))) AS digest FROM documents",
    "token_estimate": r"SELECT doc_id, coalesce(len(regexp_extract_all(text, '\S+')), 0)::INT AS tokens FROM documents",
    "truncate_text": "SELECT doc_id, md5(substr(text, 1, 2000)) AS digest, length(text) > 2000 AS truncated, length(text)::INT AS original_chars FROM documents",
    "string_id_hash": "SELECT c_custkey, ((('0x' || substr(sha1(c_name), 1, 16))::UBIGINT & 4611686018427387903::UBIGINT) | 4611686018427387904::UBIGINT)::BIGINT AS id FROM customer",
    "title_norm": f"SELECT item_id, {_norm('text')} AS norm FROM benchmark",
    "extract_codes": r"SELECT p_partkey, unnest(regexp_extract_all('model ' || p_type || '-' || (p_size + 100) || 'X ' || p_name, '\b([A-Z]{2,}[-_ ]?\d{2,}[A-Z0-9]{0,4})\b', 1)) AS code FROM part",
    "extract_prices": r"""SELECT p_partkey, generate_subscripts(l, 1)::INT - 1 AS n, unnest(l) AS price FROM (SELECT p_partkey, regexp_extract_all('now ' || (trunc(p_retailprice)::INT % 1000) || ' USD or $' || p_size || '.', '(?i)((?:₺|\$|€)\s?\d{1,3}(?:[.\s]\d{3})*(?:,\d{1,2})?|\b\d{1,3}(?:[.\s]\d{3})*(?:,\d{1,2})?\s?(?:TL|TRY|USD|EUR)\b)', 1) AS l FROM part)""",
    "short_text": r"""SELECT doc_id, CASE WHEN length(s) > 80 THEN rtrim(substr(s, 1, 77)) || '...' ELSE s END AS preview FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS s FROM documents)""",
    "skip_existing": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "missing_docs": "SELECT DISTINCT vec_id AS doc_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)",
    "swap_versions": f"""WITH {C}, {D}, l AS (SELECT DISTINCT doc_id::VARCHAR AS doc_id FROM labels)
SELECT c.doc_id, CASE WHEN l.doc_id IS NULL THEN ingest_version ELSE 'v9' END AS ingest_version, count(*) AS chunks, any_value(CASE WHEN l.doc_id IS NULL THEN active_ingest_version ELSE 'v9' END) AS active_ingest_version
FROM c LEFT JOIN l USING (doc_id) LEFT JOIN d USING (doc_id) GROUP BY ALL""",
    "remove_modes": f"""WITH {C}, {D}, n AS (SELECT count(*) FILTER (company <> 'src1') AS others, count(*) AS every, count(DISTINCT faiss_id) FILTER (company = 'src1') AS ids FROM c),
r AS (SELECT count(*) AS removed_documents FROM d WHERE status = 'removed' OR doc_id IN (SELECT doc_id FROM c WHERE company = 'src1'))
SELECT mode, CASE WHEN mode = 'deactivate' THEN every ELSE others END AS chunks_left, CASE WHEN mode = 'soft' THEN 0 ELSE ids END AS vectors_removed, removed_documents FROM n, r, (VALUES ('soft'), ('deactivate'), ('hard')) t(mode)""",
    "index_drift": f"""WITH {C}, {D}, a AS (SELECT company, count(*) AS active_chunks FROM c JOIN d USING (doc_id) WHERE {VISIBLE} AND {ACTIVE} GROUP BY company),
w AS (SELECT company, count(*) AS vectors FROM c JOIN embeddings ON vec_id = faiss_id GROUP BY company), t AS (SELECT company, count(*) AS chunks FROM c GROUP BY company),
z AS (SELECT company, chunks, coalesce(active_chunks, 0) AS active_chunks, coalesce(vectors, 0) AS vectors FROM t LEFT JOIN a USING (company) LEFT JOIN w USING (company))
SELECT *, vectors - active_chunks AS drift, CASE WHEN active_chunks > 0 THEN round((vectors - active_chunks) * 100.0::DOUBLE / active_chunks, 2) END AS drift_pct, greatest(vectors - active_chunks, 0) AS orphan_estimate FROM z""",
    "rebuild_ids": f"""WITH {C}, {D}, {SHOWN}, live AS (SELECT DISTINCT faiss_id FROM shown), b AS (SELECT l.faiss_id AS a, v.vec_id AS b FROM live l FULL JOIN embeddings v ON v.vec_id = l.faiss_id)
SELECT count(b) AS source, count(a) AS live, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS kept, count(*) FILTER (b IS NULL) AS missing, count(*) FILTER (a IS NULL) AS reclaimed FROM b""",
    "removal_report": f"WITH {C} SELECT company, count(*) AS requested, count(vec_id) AS removed, count(*) - count(vec_id) AS orphaned FROM c LEFT JOIN embeddings ON vec_id = faiss_id GROUP BY company",
    "migrate_groups": f"WITH {C} SELECT company_id AS company, count(*) AS chunks, count(DISTINCT faiss_id) AS ids, 0::BIGINT AS without_id FROM c GROUP BY company_id",
    "upsert_rows": """SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, coalesce(l.quality, -1)::INT AS quality, CASE WHEN d.doc_id IS NOT NULL THEN 7 ELSE l.toxic END::INT AS toxic
FROM (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l FULL JOIN documents d ON l.doc_id = d.doc_id""",
    "category_path": f"WITH RECURSIVE {TREE} SELECT id, parent_id, array_to_string(texts, ' > ') AS path, len(ids)::INT AS depth FROM whole",
    "category_attributes": f"""WITH RECURSIVE {TREE}, a AS (
  SELECT category_id, code, min(id) AS id FROM (SELECT 'n' || (p_partkey % 25) AS category_id, p_brand AS code, p_partkey AS id FROM part UNION ALL SELECT 'r' || (p_partkey % 5), p_type, p_partkey FROM part) GROUP BY ALL),
l AS (SELECT id, unnest(ids) AS category_id, generate_subscripts(ids, 1) AS level FROM whole)
SELECT l.id, a.code, l.category_id, a.id AS attribute_id FROM l JOIN a USING (category_id) QUALIFY row_number() OVER (PARTITION BY l.id, a.code ORDER BY level DESC, a.id) = 1""",
    "category_stats": f"""WITH RECURSIVE {TREE}, r AS (SELECT CASE id[1] WHEN 's' THEN 'product' WHEN 'n' THEN 'service' ELSE 'general' END AS kind, CASE WHEN ends_with(id, 'y') THEN 'active' ELSE 'unknown' END AS status, parent_id FROM e)
SELECT 'total' AS "group", 'all' AS name, count(*) AS count FROM r UNION ALL SELECT 'hierarchy', CASE WHEN parent_id IS NULL THEN 'root' ELSE 'child' END AS x, count(*) FROM r GROUP BY x
UNION ALL SELECT 'type', kind, count(*) FROM r GROUP BY kind UNION ALL SELECT 'status', status, count(*) FROM r GROUP BY status""",
    "page_offset_limit": f"WITH RECURSIVE {TREE} SELECT id, text, (SELECT count(*) FROM e) AS total FROM e ORDER BY id OFFSET 20 LIMIT 10",
    "recall_at_k": f"WITH {HITS} SELECT query, round(recall, 6) AS recall FROM m",
    "mrr": f"WITH {HITS} SELECT round(avg(rr), 6) AS mrr FROM m",
    "ndcg_at_k": f"WITH {HITS} SELECT query, round(ndcg, 6) AS ndcg FROM m",
    "percentile_latency": "SELECT event_type, round(quantile_cont(value, 0.5::DOUBLE), 6) AS p50, round(quantile_cont(value, 0.95::DOUBLE), 6) AS p95 FROM events GROUP BY event_type",
    "survey_top15": f"WITH {C} SELECT company, count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM c GROUP BY company ORDER BY chunks DESC, company LIMIT 15",
    "eval_breakdown": f"""WITH {HITS}, r AS (SELECT (query % 3)::VARCHAR AS config, (query % 2)::VARCHAR AS query_type, recall, rr, ndcg FROM m)
SELECT config, query_type, grouping(query_type)::INT AS is_summary, count(*) AS queries, 0::BIGINT AS errors, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM r GROUP BY GROUPING SETS ((config), (config, query_type))""",
    "crawl_latest": f"SELECT page_id, url, {DOMAIN} AS domain FROM pages ORDER BY page_id DESC, url LIMIT 100",
    "web_metadata": "SELECT doc_id AS id, (2 + (doc_id % 2 = 0)::INT)::INT AS n_keys, lang AS language, CASE WHEN doc_id % 2 = 0 THEN source END AS dump FROM documents",
}
