"""The queries over what the library keeps, in DuckDB's SQL."""

from __future__ import annotations

from lodestar.plans.oracles import C, _bm25

TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
UPDATED = """SELECT chunk_id, CASE WHEN doc_id::BIGINT % 2 = 0 AND doc_id::BIGINT % 5 = 0 THEN substr(text, 301, 400) || ' the und les para' ELSE text END AS text
  FROM c WHERE NOT (doc_id::BIGINT % 2 = 0 AND doc_id::BIGINT % 7 = 0)"""

ORACLES = {
    "index_build": f"""WITH {C}, w AS (SELECT chunk_id, len(t) AS n, unnest(t) AS term FROM (SELECT chunk_id, {TOKENS} AS t FROM c)),
      p AS (SELECT chunk_id, term, n, count(*) AS tf FROM w GROUP BY ALL)
      SELECT term, count(*) AS rows, max(tf)::INT AS most, min(n)::INT AS least FROM p GROUP BY term""",
    "lexical_indexed": f"WITH {C}, {_bm25(10)} SELECT * FROM lex",
    "index_updated": f"WITH {C}, {_bm25(10, rows=UPDATED)} SELECT * FROM lex",
    "vectors_in_parts": """SELECT vec_id AS faiss_id, CASE WHEN vec_id % 5 = 0 THEN 'c9' ELSE 'c' || (label % 4) END AS company_id,
      round(CASE WHEN vec_id % 5 = 0 THEN -1 ELSE 1 END * embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id % 7 <> 0""",
    "vectors_moved": "SELECT CASE WHEN vec_id % 3 <> 0 THEN 'c' || (label % 4) END AS company_id, count(*) AS vectors, sum(vec_id)::BIGINT AS ids FROM embeddings GROUP BY 1",
    "ingest_committed": f"""WITH {C}, k AS (SELECT company, length(text) < 1000 AS again, 'chunks' AS name FROM c UNION ALL SELECT source, doc_id % 17 > 2, 'documents' FROM documents)
      SELECT v AS version, name, company, count(*) AS rows FROM k, (SELECT unnest([1::BIGINT, 2::BIGINT]) AS v) WHERE v = 1 OR company IS DISTINCT FROM 'src1' OR again GROUP BY ALL""",
    "footer_rows": "SELECT 'documents' AS name, count(*) AS rows FROM documents UNION ALL SELECT 'lineitem', count(*) FROM lineitem",
    "web_row_range": "SELECT doc_id, lang FROM documents ORDER BY doc_id OFFSET 50 LIMIT 200",
}
