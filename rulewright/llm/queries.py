"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from . import bytebpe, language, media, packing, passages, quality, setjoin, sharding, toxicity, warc

QUERIES = {
    "op1_sharding": sharding.op1,
    "op2_media": media.op2,
    "op3_packing": packing.op3,
    "op4_toxicity": toxicity.op4,
    "op5_passages": passages.op5,
    "op6_quality": quality.op6,
    "op7_bytebpe": bytebpe.op7,
    "op8_warc": warc.op8,
    "op9_setjoin": setjoin.op9,
    "op10_language": language.op10,
}

#: Only set joins have a form in SQL: by all pairs that share a shingle, for small tables.
ORACLE_SQL: dict[str, str] = {
    "op9_setjoin": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] END) AS e FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        l AS (
            SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.e = y.e AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
            GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))
        ), r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) c ON c.id = d.doc_id
    """,
}
