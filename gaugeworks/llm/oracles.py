"""SQL for DuckDB, for the queries that SQL can express."""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = f"""
WITH texts AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
    SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM texts
), keyed AS (
    SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM lines
), shared AS (
    SELECT line_key, min(doc_id) AS keeper FROM keyed
    WHERE length(line_key) >= 10 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
    SELECT k.*, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN shared s USING (line_key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""



def _assigned(book: str) -> str:
    """Every part with its nearest entry of a codebook, the lower one of equally near ones."""
    gap = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    return f"""(
    SELECT vec_id, label, p, any_value(x) AS x, min({gap}::HUGEINT * 256 + e) % 256 AS e, min({gap}) AS d
    FROM parts JOIN {book} USING (p) GROUP BY vec_id, label, p
)"""


def _moved(book: str, assigned: str) -> str:
    """The codebook with each entry at the floored mean of its parts; entries without parts stay."""
    return f"""(
    SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM {book} b LEFT JOIN (
        SELECT p, e, list(c ORDER BY i) AS c FROM (
            SELECT p, e, i, floor(sum(x[i]) / count(*))::BIGINT AS c FROM {assigned}, range(1, 1000) r(i) WHERE i <= len(x) GROUP BY p, e, i
        ) GROUP BY p, e
    ) m ON m.p = b.p AND m.e = b.e
)"""


OP13 = f"""
WITH sound AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
    SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM sound, range(16) r(p)
), book0 AS (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts
    WHERE vec_id IN (SELECT vec_id FROM sound ORDER BY vec_id LIMIT 64)
), assigned0 AS {_assigned("book0")}, book1 AS {_moved("book0", "assigned0")},
assigned1 AS {_assigned("book1")}, book2 AS {_moved("book1", "assigned1")}, assigned2 AS {_assigned("book2")},
coded AS (
    SELECT vec_id, label, string_agg(format('{{:02x}}', e::BIGINT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
    FROM assigned2 GROUP BY vec_id, label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM coded
"""

ORACLE = {"op1_line_dedup": OP1, "op13_vector_codes": OP13}
