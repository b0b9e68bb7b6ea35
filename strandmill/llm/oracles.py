"""DuckDB SQL for those of this package's queries that SQL can express."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The checksum of a text's UTF-8, one table step per byte; the table follows from the polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    byte = f"CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT)"
    values = f"list_transform(range(0, octet_length(encode({text}))), lambda i: {byte})"
    step = f"xor(c >> 8, ([{', '.join(map(str, table))}]::BIGINT[])[CAST(xor(c, b) & 255 AS INTEGER) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {values}), lambda c, b: {step}), 4294967295::BIGINT)"


def vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    part = "w[1 + part * (len(w) // {p}) : (part + 1) * (len(w) // {p})]".format(p=parts)
    apart = "CAST(list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i]))) AS BIGINT)"
    nearest = "SELECT v.vec_id, v.part, any_value(v.x) AS x, min(row({d}, b.entry)) AS m FROM p v JOIN {b} b USING (part) GROUP BY v.vec_id, v.part"
    steps = ""
    for r in range(rounds):
        floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
        steps += f""",
        a{r} AS MATERIALIZED ({nearest.format(d=apart, b=f"b{r}")}),
        s{r} AS (
          SELECT part, entry, list({floor} ORDER BY i) AS x
          FROM (SELECT part, m[2] AS entry, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY ALL) GROUP BY ALL
        ),
        b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(s{r}.x, b{r}.x) AS x FROM b{r} LEFT JOIN s{r} USING (part, entry))"""
    return f"""
        WITH e AS (
          SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS w
          FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        p AS MATERIALIZED (SELECT vec_id, part, {part} AS x FROM e, range({parts}) t(part)),
        b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY entry < {entries}){steps},
        last AS MATERIALIZED ({nearest.format(d=apart, b=f"b{rounds}")}),
        coded AS (
          SELECT vec_id, string_agg(lower(lpad(hex(CAST(m[2] AS BIGINT)), 2, '0')), '' ORDER BY part) AS code, CAST(sum(m[1]) AS BIGINT) AS error
          FROM last GROUP BY vec_id
        ),
        digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM b{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
        FROM coded JOIN e USING (vec_id), digest
    """


def spelling(every: int = 199, shortest: int = 6, least: int = 5, ratio: int = 5) -> str:
    return f"""
        WITH RECURSIVE runs AS (
          SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS r FROM documents
        ), low AS (
          SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS c FROM runs GROUP BY ALL
        ), hashed AS (
          SELECT r, c, {crc32("doc || ':' || r")} AS h FROM low
        ), w AS MATERIALIZED (
          SELECT CASE WHEN h % {every} = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, CAST(sum(c) AS BIGINT) AS n
          FROM hashed GROUP BY 1 HAVING sum(c) >= {least} AND length(word) >= {shortest}
        ), cut AS MATERIALIZED (
          SELECT word, n, substr(word, 1, i) || '*' || substr(word, i + 2) AS pattern, substr(word, 1, i) || substr(word, i + 2) AS rest
          FROM w, LATERAL (SELECT unnest(range(length(word))) AS i)
        ), one AS (
          SELECT a.word, b.word AS near FROM cut a JOIN cut b USING (pattern) WHERE a.word <> b.word
          UNION SELECT cut.word, w.word FROM cut JOIN w ON w.word = rest
          UNION SELECT w.word, cut.word FROM cut JOIN w ON w.word = rest
        ), ranked AS (
          SELECT one.word, near, m.n AS near_n, count(*) OVER (PARTITION BY one.word) AS n_near, row_number() OVER (PARTITION BY one.word ORDER BY m.n DESC, near) AS place
          FROM one JOIN w m ON m.word = near
        ), named AS MATERIALIZED (
          SELECT w.word, CASE WHEN near_n >= {ratio} * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {ratio} * n THEN near_n END AS form_n
          FROM w LEFT JOIN ranked ON ranked.word = w.word AND place = 1
        ), followed AS (
          SELECT word, word AS root FROM named
          UNION ALL SELECT followed.word, form FROM followed JOIN named ON named.word = root WHERE form IS NOT NULL
        )
        SELECT word, form, root, n, n_near, form_n FROM named JOIN followed USING (word)
        WHERE NOT EXISTS (SELECT 1 FROM named x WHERE x.word = root AND x.form IS NOT NULL)
    """


def repeated_passages(window: int = 50) -> str:
    return f"""
        WITH t AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS size FROM documents),
        w AS MATERIALIZED (SELECT doc_id, i, substr(x, 2 * i + 1, {2 * window}) AS s FROM t, LATERAL (SELECT unnest(range(size - {window - 1})) AS i)),
        first AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s),
        hit AS (SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {window} AS apart FROM w JOIN first USING (s) WHERE first_id < doc_id),
        run AS (
          SELECT doc_id, min(i) AS begin_at, max(i) + {window} AS end_at
          FROM (SELECT doc_id, i, sum(CAST(coalesce(apart, false) AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit) GROUP BY doc_id, g
        ),
        gone AS (SELECT doc_id, sum(end_at - begin_at) AS n_removed, count(*) AS n_spans, max(end_at) AS last FROM run GROUP BY doc_id),
        piece AS (
          SELECT doc_id, lag(end_at, 1, 0) OVER (PARTITION BY doc_id ORDER BY begin_at) AS a, begin_at AS z FROM run
          UNION ALL SELECT doc_id, coalesce(last, 0), size FROM t LEFT JOIN gone USING (doc_id)
        ),
        kept AS (SELECT doc_id, string_agg(substr(x, CAST(2 * a + 1 AS BIGINT), CAST(2 * (z - a) AS BIGINT)), '' ORDER BY a) AS k FROM piece JOIN t USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(size AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
        FROM t JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
    """
