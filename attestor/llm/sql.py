"""SQL twins that stand apart from their operators."""

from __future__ import annotations

#: op3_near_dup by joining all shingles of all documents, and the closure of the links.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
links AS (SELECT u, v FROM near UNION ALL SELECT v, u FROM near),
reach AS (SELECT doc_id, doc_id AS met FROM w UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON l.u = r.met),
least AS (SELECT doc_id, min(met) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, l.component_id, w.doc_id = l.component_id AS kept
FROM w JOIN least l ON l.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
